"""Streams of features made and read line by line, for features that no table needs.

A line is parsed once a pass, in a worker; it is never split into objects and vertices that are then gathered again.
Lines without white space and escapes are parsed many at once: Arrow's reader checks that they are JSON, and the names
of objects are then told by quotes and braces alone.  All others are parsed one by one, with the same result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.sources import model_json

#: An id (kind is null) or a fact of a line: what it is, a text to show, its file and place.
_FOUND = "stream long, kind string, text string, file string, block long, line long"

#: Before what is wrong with a line's header, in place of the line; no JSON begins so.
_WRONG = "\x00"


class _Twice(dict):
    """An object of which a name is there twice; pairs: all that stands there."""


def _named(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        found = _Twice(found)
        found.pairs = pairs
    return found


_decode = json.JSONDecoder(object_pairs_hook=_named).decode


def _parsed(text: str) -> dict:
    """The line, or an empty object if it is none."""
    try:
        found = _decode(text)
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def _held(feature: dict) -> list[tuple[str, object]]:
    """The objects of a feature, also those of one name."""
    found = feature.get("CityObjects")
    if isinstance(found, _Twice):
        return found.pairs
    return list(found.items()) if isinstance(found, dict) else []


def _texts(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half of a pair of surrogates
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


class Lines(NamedTuple):
    """Lines parsed: a value a line, and the line, id and type of each object of the features."""

    kind: pa.Array
    version: pa.Array
    id: pa.Array
    line: np.ndarray
    name: pa.Array
    type: pa.Array


_TOP = pa.schema([(n, pa.string()) for n in ("type", "version", "id")])
_MARKS = np.zeros(256, bool)
_MARKS[list(b'"{}\\\n')] = True


def parsed(lines: pa.Array) -> Lines:
    return _at_once(lines) or _one_by_one(lines.to_pylist())


def _one_by_one(texts: list[str]) -> Lines:
    found = [_parsed(x) for x in texts]
    held = [(i, name, _text(o.get("type")) if isinstance(o, dict) else None) for i, v in enumerate(found) if v.get("type") == "CityJSONFeature" for name, o in _held(v)]
    line, name, kind = zip(*held) if held else ((), (), ())
    return Lines(*[_texts([_text(v.get(k)) for v in found]) for k in ("type", "version", "id")], np.array(line, np.int64), _texts(list(name)), _texts(list(kind)))


def _is(text: np.ndarray, start: np.ndarray, size: np.ndarray, word: bytes) -> np.ndarray:
    found = size == len(word)
    at = start[found]
    found[found] = (text[at[:, None] + np.arange(len(word))] == np.frombuffer(word, np.uint8)).all(axis=1)
    return found


def _cut(text: np.ndarray, start: np.ndarray, size: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    ends = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=ends[1:])
    held = text[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    there = None if none is None else pa.py_buffer(np.packbits(~none, bitorder="little"))
    return pa.Array.from_buffers(pa.string(), len(size), [there, pa.py_buffer(ends), pa.py_buffer(held)])


def _at_once(lines: pa.Array) -> Lines | None:
    """All lines, or None if some have white space or escapes, are no JSON, or are not of the usual kinds."""
    if not len(lines) or lines.nbytes > 1 << 30:
        return None
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines.cast(pa.string())), "\n")[0].as_buffer()
    try:
        top = pj.read_json(pa.BufferReader(whole), pj.ReadOptions(use_threads=False, block_size=whole.size + 1), pj.ParseOptions(explicit_schema=_TOP, unexpected_field_behavior="ignore"))
    except pa.ArrowInvalid:
        return None
    text = np.frombuffer(whole, np.uint8)
    marks = np.flatnonzero(_MARKS[text])
    what = text[marks]
    quote = what == ord('"')
    if len(top) != len(lines) or (what == ord("\\")).any() or not quote.any():
        return None
    quotes = np.cumsum(quote)
    outside = ~quote & (quotes % 2 == 0)
    depth = np.cumsum(np.where(outside, (what == ord("{")).astype(np.int8) - (what == ord("}")), 0), dtype=np.int32)
    row = np.cumsum(what == ord("\n"))
    places = np.flatnonzero(quote)
    first, start, size = places[0::2], marks[places[0::2]] + 1, marks[places[1::2]]
    size = size - start
    depth, row, after = depth[first], row[first], text[start + size + 1]
    key = after == ord(":")
    if not (key | np.isin(after, np.frombuffer(b",]}", np.uint8))).all():
        return None
    then = np.zeros(len(key), np.uint8)  # what a member's value begins with
    then[key] = text[start[key] + size[key] + 2]
    if np.isin(then, np.frombuffer(b" \t\r", np.uint8)).any():
        return None
    members = np.flatnonzero(key & (depth == 1))
    tops = members[_is(text, start[members], size[members], b"CityObjects")]
    if (then[tops] != ord("{")).any() or (np.diff(row[tops]) == 0).any():
        return None
    ids = np.flatnonzero(key & (depth == 2))
    ids = ids[np.isin(members[np.searchsorted(members, ids) - 1], tops)]
    if (then[ids] != ord("{")).any():
        return None
    kinds = np.flatnonzero(key & (depth == 3))
    kinds = kinds[_is(text, start[kinds], size[kinds], b"type")]
    owners = np.flatnonzero(key & (depth == 2))
    owner = owners[np.searchsorted(owners, kinds) - 1] if len(owners) else kinds[:0]
    own = np.searchsorted(ids, owner)
    of_object = own < len(ids)
    of_object[of_object] = ids[own[of_object]] == owner[of_object]
    kinds, own = kinds[of_object], own[of_object]
    if (then[kinds] != ord('"')).any() or (np.diff(own) == 0).any():
        return None
    value = np.full(len(ids), -1)
    value[own] = kinds + 1  # the text after the name
    kind, version, model = (top[n].combine_chunks() for n in ("type", "version", "id"))
    of_feature = pc.fill_null(pc.equal(kind, "CityJSONFeature"), False).to_numpy(zero_copy_only=False)[row[ids]]
    ids, value = ids[of_feature], value[of_feature]
    none = value < 0
    return Lines(kind, version, model, row[ids], _cut(text, start[ids], size[ids]), _cut(text, start[value], np.where(none, 0, size[value]), none))


def _shown(text: str) -> str:
    return text if text.startswith(_WRONG) else text[:80]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of objects and the facts of lines (stream, file, block, line, value)."""
    fields = [("stream", pa.int64()), ("kind", pa.string()), ("text", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("line", pa.int64())]
    for b in batches:
        stream, file, block, line, texts = (b.column(n) for n in ("stream", "file", "block", "line", "value"))
        held = parsed(texts)
        kind = pc.fill_null(held.kind, "")
        feature = pc.equal(kind, "CityJSONFeature")
        first = pa.Table.from_arrays([stream, file, block, line], ["stream", "file", "block", "line"]).filter(feature).group_by(["stream", "file", "block"]).aggregate([("line", "min")])
        facts = [(r["stream"], "feature", "", r["file"], r["block"], r["line_min"]) for r in first.to_pylist()]
        for i in np.flatnonzero(~(pc.and_(feature, pc.is_valid(held.id))).to_numpy(zero_copy_only=False)).tolist():
            at, k = (file[i].as_py(), block[i].as_py(), line[i].as_py()), kind[i].as_py()
            if k == "CityJSON":
                facts.append((stream[i].as_py(), "head", "", *at))
                if not (held.version[i].as_py() or "").startswith("2."):
                    facts.append((stream[i].as_py(), "old", "", *at))
            else:
                facts.append((stream[i].as_py(), "nameless" if k == "CityJSONFeature" else "bad", _shown(texts[i].as_py()), *at))
        n = len(held.name)
        yield pa.RecordBatch.from_arrays([stream.take(pa.array(held.line)), pa.nulls(n, pa.string()), held.name, *[pa.nulls(n, t) for _, t in fields[3:]]], [f for f, _ in fields])
        if facts:
            yield pa.RecordBatch.from_arrays([_texts(list(c)) if t == pa.string() else pa.array(c, t) for c, (_, t) in zip(zip(*facts), fields)], [f for f, _ in fields])


def _facts(lines: DataFrame, stream: Column) -> dict[int, dict[str, object]]:
    """By stream and kind: how often, the first text, file and place; of ids (kind is null) only those that are there twice.  One pass over the lines."""
    rows = lines.select(stream.alias("stream"), "file", F.col("block"), F.col("line"), "value").mapInArrow(_found, _FOUND)
    rows = rows.groupBy("stream", "kind", "text", "file", "block").agg(F.count("*").alias("n"), F.min("line").alias("line")).where("kind IS NOT NULL OR n > 1")
    out: dict[int, dict[str, object]] = {}
    for r in rows.groupBy("stream", "kind").agg(F.sum("n").alias("n"), F.min("text").alias("text"), F.min("file").alias("file"), F.min(F.struct("block", "line")).alias("at")).collect():  # a row a stream and kind
        out.setdefault(r["stream"], {})[r["kind"]] = r
    return out


def of_files(spark: SparkSession, directory: str, transform: dict, path: str, header: dict | None = None, shards: int = 1, compression: str = "none") -> dict:
    """The features below ``directory`` (see ``read_feature_files``) as streams, one a shard, each under the same header; gives the header.

    The header is ``header``, or comes from the metadata of the headers in the directory, as in ``write_stream``.  A feature
    whose header has this transform is written as it stands; of others objects, metadata and appearance are kept and the
    vertices are rounded to this transform.  A line that is no feature, a feature without id, an object id in two features
    and what ``read_feature_files`` calls an error are ValueErrors.  All is checked before anything is written.  The shards
    are runs of the files, which are not dealt out nor sorted.
    """
    lines = model_json.feature_lines(spark, directory)
    head = model_json.stream_header(transform, model_json._headers(spark, directory).select(F.col("h.metadata").alias("metadata")), header)
    zero = F.lit(0).cast("long")
    checked = lines.withColumn("value", F.coalesce(F.concat(F.lit(_WRONG), "problem"), "value"))
    found = _facts(checked.withColumns({"block": zero, "line": zero}), zero).get(0, {})
    for kind, what in (("bad", "no feature: "), ("head", "a header among the features of "), ("nameless", "a feature without id: ")):
        if kind in found:
            if found[kind]["text"].startswith(_WRONG):
                raise PySparkValueError(found[kind]["text"][1:])
            raise PySparkValueError(what + (found[kind]["text"] or found[kind]["file"]))
    if None in found:
        raise PySparkValueError(f"object {found[None]['text']} is in two features")
    lines = lines.select(F.when(F.col("h.transform").eqNullSafe(_column(transform)), F.col("value")).otherwise(_under(transform)).alias("value"))
    n = spark.read.option("recursiveFileLookup", "true").text(directory).rdd.getNumPartitions()  # of the lines' scan, which nothing deals out
    if n < shards:
        lines = lines.repartition(shards)
    rows = spark.range(0, 1, 1, 1).select(F.lit(json.dumps(head)).alias("value"), F.lit(True).alias("is_head")).unionByName(lines.select("value", F.lit(False).alias("is_head"))).coalesce(shards)
    # the first row of each file gets the header in front; the row of the header alone is for a stream without features
    rows = rows.withColumn("first", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0).where("first OR NOT is_head")
    value = F.when(F.col("first") & ~F.col("is_head"), F.concat(F.lit(json.dumps(head) + "\n"), "value")).otherwise(F.col("value"))
    rows.select(value.alias("value")).write.option("compression", compression).option("zlib.compress.level", "THREE").text(path)
    return head


def _column(transform: dict) -> Column:
    return F.struct(*[F.array(*[F.lit(float(x)) for x in transform[k]]).alias(k) for k in ("scale", "translate")])


def _under(transform: dict) -> Column:
    """A feature's line with its vertices under another transform; halves round away from zero."""
    root, s, t = F.from_json("value", model_json._ROOT), transform["scale"], transform["translate"]
    own = lambda part, i: F.col("h.transform")[part][i]
    world = lambda v, i: F.coalesce(v[i] * own("scale", i) + own("translate", i), v[i].cast("double"))
    vertices = F.transform(F.coalesce(root["vertices"], F.array().cast("array<array<bigint>>")), lambda v: F.array(*[F.round((world(v, i) - t[i]) / s[i]).cast("long") for i in range(3)]))
    members = F.array_join(F.transform(F.map_entries(root["CityObjects"]), lambda e: F.concat(model_json._quoted(e.key), F.lit(":"), F.coalesce(e.value, F.lit("null")))), ",")
    more = [F.coalesce(F.concat(F.lit(f',"{m}":'), root[m]), F.lit("")) for m in ("metadata", "appearance")]
    return F.concat(F.lit('{"type":"CityJSONFeature","id":'), model_json._quoted(root["id"]), F.lit(',"CityObjects":{'), F.coalesce(members, F.lit("")), F.lit('},"vertices":'), F.to_json(vertices), *more, F.lit("}"))


def _of_stream(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.where(F.trim("value") != "")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, external_id, cityobject_type) of streams: these columns of ``model_json.objects`` of ``read_stream``.

    All lines are read once to check them; what ``read_stream`` calls an error is a ValueError here, an object id in two features of a file too.
    """
    lines = _of_stream(spark, path)
    by_file = {}
    for found in _facts(lines, F.xxhash64("file")).values():
        at = {k: r["at"] for k, r in found.items()}
        what = (
            f"neither header nor feature: {found['bad']['text']}" if "bad" in found else "no header" if "head" not in found else "two headers" if found["head"]["n"] > 1
            else "the header is not the first line" if "feature" in at and at["feature"] < at["head"] else "the header is not of version 2" if "old" in found
            else "a feature without id" if "nameless" in found else f"id twice: {found[None]['text']}" if None in found else None
        )
        if what:
            by_file[next(r["file"] for k, r in found.items() if k)] = what
    if by_file:
        raise PySparkValueError("{}: {}".format(*min(by_file.items())))
    return lines.select("value").mapInArrow(_objects, "model_id string, external_id string, cityobject_type string")


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = parsed(b.column(0))
        yield pa.RecordBatch.from_arrays([held.id.take(pa.array(held.line)), held.name, held.type], ["model_id", "external_id", "cityobject_type"])


def _text(value: object) -> str | None:
    """A member as text; what is none stays JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"))
