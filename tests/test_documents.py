"""Documents of many objects: written in lines, read object by object, with the same packages as by the tables."""

import gzip
import json
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from urbanframe.operators import packages
from urbanframe.sources import json_stream, model_json

HEAD = {"type": "CityJSON", "version": "2.0", "transform": {"scale": [-0.5, 2, 1], "translate": [0.1, 0, 5]}, "metadata": {"identifier": 'd "1"'}}


def shape(*at):
    return [{"type": "MultiSurface", "boundaries": [[list(at)]], "lod": "1"}, {"type": "MultiPoint", "boundaries": list(at[:1])}]


def odd():
    things = {
        "b": {"type": "Building", "children": ["z", "aé", "z"], "attributes": {"children": ["no"], "x": "]]},{"}}, "z": {"type": "Part", "parents": ["b"], "children": ["deep"], "geometry": shape(0, 1, 2)},
        "aé": {"type": "Part", "parents": ["b"], "children": ["deep"]}, "deep": {"type": "Part", "geometry": shape(3, 9, -1)}, "B": {"type": "Road", "geometry": shape(7)},
        "Z": {"type": "Group", "children": ["deep", "B2"], "parents": []}, "B2": {"type": "Road", "geometry": []}, 'q"\\\n': {"type": "Road", "geometry": shape(2)}, "orphan": {"type": "Part", "parents": ["b"]},
    }
    vertices = [[0, 0, 0], [5, -1, 2], [9, 9, 9], [4, 4, 1 << 40]]
    return HEAD | {"CityObjects": things, "vertices": vertices}, {"vertices": [], "CityObjects": {}, "extensions": {}} | HEAD | {"metadata": {"identifier": "none"}}, {"vertices": [[1, 2, 3]] * 70, "type": "CityJSON", "version": "2.0", "CityObjects": {"o": {"type": "Road", "geometry": shape(0)}}, "metadata": {"identifier": "plain"}}


def test_packages_of_files_are_those_of_the_tables(spark, tmp_path):
    for i, d in enumerate(odd()):
        text = json.dumps(d, indent=i or None, ensure_ascii=i == 1)
        (tmp_path / f"d{i}.json").write_text(text) if i else (tmp_path / "d0.json.gz").write_bytes(gzip.compress(text[:100].encode()) + gzip.compress(text[100:].encode()))
    got, want = packages.of_files(spark, str(tmp_path)), packages.of_documents(spark, model_json.read_documents(spark, str(tmp_path)))
    for name in ("packages", "members"):
        assert got[name].columns == want[name].columns
        assert sorted(map(str, got[name].collect())) == sorted(map(str, want[name].collect())), name
    assert got["members"].count() == 10 and "Exchange" not in got["packages"]._jdf.queryExecution().executedPlan().toString()


def test_faults_of_files(spark, tmp_path):
    loop = {"a": {"type": "A", "children": ["b"]}, "b": {"type": "B", "children": ["a"]}}
    faults = [({"CityObjects": loop}, "cycle"), ({"CityObjects": {"a": {"type": "A", "children": ["q"]}}}, "missing child q"), ({"version": "1.1"}, "not a 2.x document"), ({"vertices": [[1, 2, 3], [1.5, 2, 3]]}, "whole numbers"), ({"vertices": [[1, 2]]}, "whole numbers")]
    for i, (change, what) in enumerate(faults):
        (tmp_path / f"{i}").mkdir()
        (tmp_path / f"{i}/d.json").write_text(json.dumps(HEAD | {"CityObjects": {}, "vertices": []} | change))
        with pytest.raises(Exception, match=what):
            packages.of_files(spark, str(tmp_path / f"{i}"))["packages"].collect()


def test_reader_of_parts():
    for document in odd():
        for text in (json.dumps(document), json.dumps(document, indent=1)):
            for size in (1, 3, 50, 1 << 20):
                parts = lambda: (text[i : i + size] for i in range(0, len(text), size))
                reader, got = json_stream.Reader(parts()), {}
                for name in reader.names():
                    got[name] = dict(reader.objects()) if name == "CityObjects" else reader.triples().tolist() if name == "vertices" else reader.value()
                assert got == document and reader.peek() == ""
                assert dict(json_stream.Reader(parts()).members()) == document
    for bad in ('{"a":1,}', '{"a" 1}', '{"a":', '{,"a":1}', '{"a":1 "b":2}', "[", ""):
        for read in (json_stream.Reader.members, json_stream.Reader.objects):
            with pytest.raises(ValueError):
                list(read(json_stream.Reader(iter([bad]))))
    many = [[i, -i, i * i] for i in range(1000)]
    assert np.array_equal(json_stream.Reader(iter([json.dumps(many) + "}"])).triples(), many)
    with pytest.raises(ValueError):
        list(json_stream.texts(gzip.compress(b"{}" * 1000)[:-12]))


def test_documents_are_written_in_lines(spark, tmp_path):
    objs = spark.range(5000).selectExpr("'m' AS model_id", "concat('o\"', id) AS external_id", "'Road' AS cityobject_type", "CAST(NULL AS array<string>) AS parents", "CAST(NULL AS array<string>) AS children", "CAST(NULL AS string) AS attributes", "'[]' AS geometry")
    verts = spark.range(5000).selectExpr("if(id < 4990, 'm', 'bare') AS model_id", "CAST(if(id < 4990, id, id - 4990) AS int) AS vertex_id", "CAST(id AS double) AS x", "0D AS y", "1D AS z")
    more = spark.createDataFrame([("n", "only", "Road", None, None, '{"a": 1}', None)], "model_id string, external_id string, cityobject_type string, parents array<string>, children array<string>, attributes string, geometry string")
    meta = spark.createDataFrame([("n", '{"identifier": "n", "title": "t"}'), ("else", "{}")], "model_id string, metadata string")
    model_json.write_documents(objs.unionByName(more), verts, {"scale": [1.0] * 3, "translate": [0.0] * 3}, str(tmp_path / "d"), meta)
    texts = {f.parent.name: f.read_text() for f in (tmp_path / "d").glob("*/*.txt")}
    whole = {k: json.loads(t) for k, t in texts.items()}
    assert sorted(whole) == ["model=bare", "model=m", "model=n"] and max(map(len, texts["model=m"].split("\n"))) < len(texts["model=m"]) / 5
    assert len(whole["model=m"]["CityObjects"]) == 5000 and whole["model=m"]["vertices"] == [[i, 0, 1] for i in range(4990)] and whole["model=m"]["metadata"] == {"identifier": "m"}
    assert whole["model=n"]["metadata"]["title"] == "t" and whole["model=n"]["vertices"] == [] and whole["model=n"]["CityObjects"]["only"]["attributes"] == {"a": 1}
    assert len(whole["model=bare"]["vertices"]) == 10 and whole["model=bare"]["CityObjects"] == {}


def held(run):
    """The most bytes that Python, NumPy and Arrow hold at once while ``run`` runs."""
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)


def large(n):
    """A document of ``n`` packages of five objects, in parts, compressed."""
    parts = lambda i: [f"P{i * 10 + k}" for k in range(4)]
    part = lambda i, k: f'"P{i * 10 + k}":{{"type":"Part","parents":["B{i}"],"geometry":{json.dumps(shape(*range(i * 4, i * 4 + 4)))}}}'
    objects = ",".join(f'"B{i}":{{"type":"Building","children":{json.dumps(parts(i))}}},' + ",".join(part(i, k) for k in range(4)) for i in range(n))
    return gzip.compress(f'{{"type":"CityJSON","version":"2.0","CityObjects":{{{objects}}},"vertices":{[[i, i, i] for i in range(n * 4)]}}}'.encode())


def test_a_document_of_many_objects_takes_little_memory():
    n, content = 6000, large(6000)
    rows = lambda which, files: sum(b.num_rows for b in packages._rows_of(which)(iter([pa.RecordBatch.from_arrays([pa.array(["f"] * files), pa.array([content] * files)], ["path", "content"])])))
    found = []
    for which, want, most in (("members", 5 * n, 250), ("packages", n, 400)):  # bytes an object; 1 MB parts of text count too
        rows(which, 1)  # what is imported on the way does not count
        one, three = held(lambda: found.append(rows(which, 1))), held(lambda: found.append(rows(which, 3)))
        assert found == [want, 3 * want] and one < most * 5 * n and three < 1.4 * one  # no document beside the next
        found.clear()


def test_packages_are_whole_across_batches(monkeypatch):
    rows = lambda of: [r for b in of for r in b.to_pylist()]
    for document in odd():
        made = packages.Document(iter([json.dumps(document)]), "f")
        want = rows(made.packages()), rows(made.members())
        for size in (1, 2, 3):
            monkeypatch.setattr(packages, "_SLICE", size)
            again = packages.Document(iter([json.dumps(document)]), "f")
            assert (rows(again.packages()), rows(again.members())) == want
            assert rows(packages.Document(iter([json.dumps(document)]), "f", False).members()) == want[1]
            monkeypatch.undo()
    twice = '{"type":"CityJSON","version":"2.0","CityObjects":{"b":{},"a":{},"b":{}}}'
    with pytest.raises(ValueError, match="there twice"):
        packages.Document(iter([twice]), "f")


def test_stored_bytes_are_read_in_parts(monkeypatch):
    text = "é€ \U0001f3e0" * 500
    raw = text.encode()
    many = b"".join(gzip.compress(raw[i : i + 900]) + b"\0" * (i % 7) for i in range(0, len(raw), 900))
    for stored in (1, 7, 1 << 16):
        monkeypatch.setattr(json_stream, "_STORED", stored, raising=False)
        for content in (raw, gzip.compress(raw), many, pa.py_buffer(many), pa.array([many]).slice(0)[0].as_buffer()):
            assert all("".join(json_stream.texts(content, size)) == text for size in (3, 1000, 1 << 20))
        with pytest.raises(ValueError):
            list(json_stream.texts(many[:-9], 5))
    assert list(json_stream.texts(b"")) == [""]
