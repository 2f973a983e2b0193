"""Readers and writers of JSON city models: whole documents, JSON-lines streams and directories of features.

Unknown members of objects are kept as JSON text in ``extra``; coordinates are de-quantised with the root's transform.
"""

from __future__ import annotations

import json

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROOT = "type string, version string, id string, transform struct<scale: array<double>, translate: array<double>>, metadata string, vertices array<array<bigint>>, CityObjects map<string, string>, appearance string, extensions string, `geometry-templates` string"
_OBJECT = "type string, parents array<string>, children array<string>, attributes string, geometry string, geographicalExtent array<double>"
_MEMBERS = ("type", "parents", "children", "attributes", "geometry", "geographicalExtent")
_GEOMETRY = "array<struct<type: string, lod: string, boundaries: string, semantics: string>>"


def probe(text: Column) -> Column:
    """(type, version) without the rest."""
    return F.struct(F.get_json_object(text, "$.type").alias("type"), F.get_json_object(text, "$.version").alias("version"))


def parsed_root(df: DataFrame, text: str = "value") -> DataFrame:
    """Adds root, the parsed members, and raw, the text."""
    return df.withColumn("root", F.from_json(text, _ROOT)).withColumn("raw", F.col(text))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, root, raw): a row a file; anything but a 2.x document is an error.  Lines files are refused."""
    if path.endswith(".jsonl"):
        raise ValueError("a lines file is no document")
    df = parsed_root(spark.read.text(path, wholetext=True)).withColumn("model_id", F.coalesce(F.get_json_object("value", "$.metadata.identifier"), F.input_file_name()))
    good = (F.col("root.type") == "CityJSON") & F.coalesce(F.col("root.version"), F.lit("")).startswith("2.")
    return df.select("model_id", F.when(good, F.col("root")).otherwise(F.raise_error(F.concat(F.lit("not a 2.x document: "), "model_id"))).alias("root"), "raw")


def _stream_problem(lines: DataFrame) -> str | None:
    """What is wrong with the streams, by file, or None: one aggregation over all lines."""
    lines = lines.withColumn("top", F.from_json("raw", "type string, version string, id string"))
    kind, version = F.col("top.type"), F.coalesce("top.version", F.lit(""))
    at = F.struct("block", "line")
    files = lines.groupBy("file").agg(
        F.min_by(F.coalesce(kind, F.lit("")), at).alias("first"), F.count_if(kind == "CityJSON").alias("heads"), F.count_if((kind == "CityJSON") & ~version.startswith("2.")).alias("old"),
        F.min(F.when(kind.isNull() | ~kind.isin("CityJSON", "CityJSONFeature"), F.substring("raw", 1, 80))).alias("bad"), F.count_if((kind == "CityJSONFeature") & F.col("top.id").isNull()).alias("nameless"),
    )
    what = (
        F.when(F.col("bad").isNotNull(), F.concat(F.lit("neither header nor feature: "), "bad")).when(F.col("heads") == 0, "no header").when(F.col("heads") > 1, "two headers")
        .when(F.col("first") != "CityJSON", "the header is not the first line").when(F.col("old") > 0, "the header is not of version 2").when(F.col("nameless") > 0, "a feature without id")
    )
    found = files.select("file", what.alias("what")).where("what IS NOT NULL").orderBy("file").first()
    return f"{found['file']}: {found['what']}" if found else None


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, root, raw): a row a feature of JSON-lines files whose header line is joined to each of its features.

    Blank lines are skipped.  All lines are read once to check them: a file whose first line is no 2.x header, a second header,
    a line that is neither header nor feature, and a feature without id are errors (ValueError), and so is, when
    the rows are read, an object id in two features of a file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    lines = parsed_root(lines)
    if problem := _stream_problem(lines):
        raise PySparkValueError(problem)
    heads = lines.where("root.type = 'CityJSON'").select("file", F.col("root.transform").alias("t"), F.col("root.metadata").alias("m"))
    features = lines.where("root.type = 'CityJSONFeature'").join(F.broadcast(heads), "file")  # a row a file: the features stay where they are
    ids = features.select("file", F.explode(F.map_keys("root.CityObjects")).alias("id")).groupBy("file", "id").count().where("count > 1").groupBy("file").agg(F.min("id").alias("twice"))
    features = features.join(F.broadcast(ids), "file", "left")
    root = F.col("root").withField("transform", F.col("t")).withField("metadata", F.coalesce("root.metadata", "m"))
    return features.select(F.when(F.col("twice").isNull(), F.col("root.id")).otherwise(F.raise_error(F.concat(F.lit("id twice: "), "twice"))).alias("model_id"), root.alias("root"), "raw")


_HEAD = "/metadata.json"


def _headers(spark: SparkSession, directory: str) -> DataFrame:
    """(folder, h): the header of each metadata.json below ``directory``; the topmost may be a folder of one part, as Spark writes it."""
    read = lambda path: spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("path"))
    heads = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").text(directory, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    top = spark._jvm.org.apache.hadoop.fs.Path(directory + _HEAD)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(top) and fs.getFileStatus(top).isDirectory():
        heads = heads.unionByName(read(directory + _HEAD))
    return heads.select(F.regexp_replace("path", "/metadata\\.json(/[^/]*)?$", "").alias("folder"), F.from_json("value", _ROOT).alias("h"))


def feature_lines(spark: SparkSession, directory: str) -> DataFrame:
    """(file, value, h, problem): the lines below ``directory`` as they stand, each with the header of the metadata.json of its nearest folder upwards, and what is wrong with that header, or null.

    Two headers of one folder are a ValueError.
    """
    heads = _headers(spark, directory)
    if twice := heads.groupBy("folder").count().where("count > 1").first():
        raise PySparkValueError(f"two headers in {twice['folder']}")
    lines = spark.read.option("recursiveFileLookup", "true").text(directory).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "").where(~F.col("file").rlike("/metadata\\.json(/[^/]*)?$"))
    folder = lambda file: F.regexp_replace(file, "/[^/]*$", "")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select(folder(F.col("_metadata.file_path")).alias("own")).distinct()  # names alone, no content
    parts = F.split("own", "/")
    above = there.select("own", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("levels")).select("own", "levels", F.array_join(F.slice(F.split("own", "/"), F.lit(1), F.col("levels")), "/").alias("folder"))
    nearest = above.join(heads, "folder").groupBy("own").agg(F.max_by(F.struct("h.transform", "h.metadata", "h.version"), "levels").alias("h"))
    both = lines.withColumn("own", folder(F.col("file"))).join(F.broadcast(nearest), "own", "left")  # a row a folder: the lines stay where they are
    problem = F.when(F.col("h").isNull(), F.concat(F.lit("no metadata.json above "), "file")).when(~F.coalesce(F.col("h.version"), F.lit("")).startswith("2."), F.concat(F.lit("the header is not of version 2: "), "file"))
    return both.select("file", "value", "h", problem.alias("problem"))


def read_feature_files(spark: SparkSession, directory: str) -> DataFrame:
    """Features below ``directory``, each under the header of the metadata.json of its nearest folder upwards.

    A file without any header, and a header that is not of version 2, are errors when its rows are read; two headers of one folder are a ValueError.
    """
    both = parsed_root(feature_lines(spark, directory))
    sound = F.when(F.col("problem").isNotNull(), F.raise_error("problem")).otherwise(F.col("root.id"))
    root = F.col("root").withField("transform", F.col("h.transform")).withField("metadata", F.coalesce("root.metadata", "h.metadata"))
    return both.select(sound.alias("model_id"), root.alias("root"), "raw")


def objects(models: DataFrame) -> DataFrame:
    """(model_id, external_id, cityobject_type, parents, children, attributes, geometry, geographical_extent, extra); extra: the members not listed, as JSON, or null."""
    return object_rows(models.select("model_id", F.explode("root.CityObjects").alias("external_id", "json")))


def object_rows(texts: DataFrame) -> DataFrame:
    """The columns of ``objects`` from rows with external_id and json, an object's text; other columns stay in front."""
    o = texts.withColumn("o", F.from_json("json", _OBJECT))
    rest = F.map_filter(F.from_json("json", "map<string, variant>"), lambda k, v: ~k.isin(*_MEMBERS))
    return o.select(*[c for c in texts.columns if c not in ("external_id", "json")], "external_id", F.col("o.type").alias("cityobject_type"), "o.parents", "o.children", "o.attributes", "o.geometry", F.col("o.geographicalExtent").alias("geographical_extent"), F.when(F.size(rest) > 0, F.to_json(rest)).alias("extra"))


def relationships(objs: DataFrame) -> DataFrame:
    return objs.select("model_id", F.col("external_id").alias("parent_id"), F.posexplode("children").alias("child_ordinal", "child_id"))


def geometries(objs: DataFrame) -> DataFrame:
    """(model_id, external_id, geometry_ordinal, geometry_type, lod, boundaries, semantics)."""
    g = objs.select("model_id", "external_id", F.posexplode(F.from_json("geometry", _GEOMETRY)).alias("geometry_ordinal", "g"))
    return g.select("model_id", "external_id", "geometry_ordinal", F.col("g.type").alias("geometry_type"), "g.lod", "g.boundaries", "g.semantics")


def boundary_indices(geoms: DataFrame) -> DataFrame:
    """Adds vertex_indices: the numbers of the nested boundaries in order."""
    return geoms.withColumn("vertex_indices", indices(F.col("boundaries")))


def indices(text: Column) -> Column:
    """The numbers in a boundary's text."""
    return F.transform(F.regexp_extract_all(text, F.lit("-?[0-9]+"), F.lit(0)), lambda v: v.cast("int"))


def in_world(number: Column, axis: int) -> Column:
    """A coordinate under the column ``transform``; without one the number is taken as it is."""
    return F.coalesce(number * F.col("transform.scale")[axis] + F.col("transform.translate")[axis], number.cast("double"))


def vertices(models: DataFrame) -> DataFrame:
    """(model_id, vertex_id, x, y, z) in world coordinates; without a transform the numbers are taken as they are."""
    v = models.select("model_id", "root.transform", F.posexplode("root.vertices").alias("vertex_id", "v"))
    return v.select("model_id", "vertex_id", *[in_world(F.col("v")[i], i).alias(a) for i, a in enumerate("xyz")])


def auto_transform(verts: DataFrame, scale: float = 0.001) -> dict:
    """Scale and translation for writing: the smallest corner of all vertices."""
    low = verts.agg(*[F.min(a).alias(a) for a in "xyz"]).first()
    return {"scale": [scale] * 3, "translate": [low[a] or 0.0 for a in "xyz"]}


def _quoted(text: Column) -> Column:
    """The text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), "(?s)^\\[(.*)\\]$", 1)


def _whole(verts: DataFrame, transform: dict) -> DataFrame:
    """Adds v: the integers of a vertex; halves round away from zero."""
    s, t = transform["scale"], transform["translate"]
    return verts.withColumn("v", F.array(*[F.round((F.col(a) - t[i]) / s[i]).cast("long") for i, a in enumerate("xyz")]))


def _body() -> Column:
    return F.struct(F.col("cityobject_type").alias("type"), "parents", "children", F.parse_json("attributes").alias("attributes"), F.parse_json("geometry").alias("geometry"))


def _bodies(objs: DataFrame, verts: DataFrame, transform: dict) -> DataFrame:
    """(model_id, members, vertices): the objects and the integer vertices of each model as JSON text."""
    pools = _whole(verts, transform).groupBy("model_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vertex_id", "v"))), lambda x: x.v).alias("vertices"))
    o = objs.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("external_id", F.to_json(_body()).alias("o")))).alias("o"))
    members = F.array_join(F.transform("o", lambda e: F.concat(_quoted(e.external_id), F.lit(":"), e.o)), ",")
    return o.join(pools, "model_id", "left").select("model_id", members.alias("members"), F.coalesce(F.to_json("vertices"), F.lit("[]")).alias("vertices"))


def _features(bodies: DataFrame) -> DataFrame:
    line = F.concat(F.lit('{"type":"CityJSONFeature","id":'), _quoted(F.col("model_id")), F.lit(',"CityObjects":{'), F.col("members"), F.lit('},"vertices":'), F.col("vertices"), F.lit("}"))
    return bodies.select("model_id", line.alias("value"))


def write_features(objs: DataFrame, verts: DataFrame, transform: dict, path: str) -> None:
    """JSON lines, a feature a model, vertices as integers of the transform; no header line."""
    _features(_bodies(objs, verts, transform)).select("value").write.text(path)


def inside(text: Column) -> Column:
    """A JSON list's text without its brackets."""
    return F.substring(text, F.lit(2), F.char_length(text) - 2)


#: Vertices a line of a document.
_LINE = 1024


def write_pieces(pieces: DataFrame, text: Column, transform: dict, path: str, compression: str = "none") -> None:
    """A document a model, each a file in a folder of its own below ``path``, a line a piece: no row ever holds a document.

    pieces: (model_id, kind, name, place, ...) in order of kind, name and place.  ``text``, made after they are sorted, is
    the metadata of kind 0 (at most one; without it the model's id is its identifier), some objects of kind 1 as
    ``"id":{...}``, and some vertices of kind 2 as ``[x,y,z]``, with commas between them; none of them may be empty.
    """
    order = Window.partitionBy("model_id").orderBy("kind", "name", "place")
    kind, before = F.col("kind"), F.col("kind_before")
    top = F.lit(f'{{"type":"CityJSON","version":"2.0","transform":{json.dumps(transform)},"metadata":')
    head = lambda meta: F.concat(top, meta, F.lit(',"CityObjects":{'))
    own = F.concat(F.lit('{"identifier":'), _quoted(F.col("model_id")), F.lit("}"))
    front = F.when(kind == 0, head(text)).when(before.isNull(), head(own)).otherwise("")
    link = F.when(kind == 0, "").when(kind == before, ",").when(kind == 2, '},"vertices":[').otherwise("")
    end = F.when(F.col("kind_after").isNotNull(), "").when(kind == 2, "]}").otherwise('},"vertices":[]}')
    line = F.concat(front, link, F.when(kind == 0, "").otherwise(text), end)
    rows = pieces.withColumns({"kind_before": F.lag("kind").over(order), "kind_after": F.lead("kind").over(order)})
    rows.select(F.col("model_id").alias("model"), line.alias("value")).write.partitionBy("model").option("compression", compression).text(path)


def write_documents(objs: DataFrame, verts: DataFrame, transform: dict, path: str, metadata: DataFrame | None = None, compression: str = "none") -> None:
    """A whole document a model, each a file in a folder of its own below ``path``.

    ``metadata`` (model_id, metadata as JSON text) is optional; a model without any gets its id as identifier.  A model
    without objects is written if it has vertices.
    """
    piece = lambda df, kind, name, place, text: df.select("model_id", F.lit(kind).alias("kind"), name.alias("name"), place.cast("long").alias("place"), text.alias("text"))
    o = piece(objs, 1, F.col("external_id"), F.lit(0), F.concat(_quoted(F.col("external_id")), F.lit(":"), F.to_json(_body())))
    pools = _whole(verts, transform).groupBy("model_id", F.floor(F.col("vertex_id") / _LINE).alias("place"))
    pools = pools.agg(F.transform(F.array_sort(F.collect_list(F.struct("vertex_id", "v"))), lambda x: x.v).alias("vs"))
    v = piece(pools, 2, F.lit(""), F.col("place"), inside(F.to_json("vs")))
    pieces = o.unionByName(v)
    if metadata is not None:
        m = metadata.where("metadata IS NOT NULL").join(pieces.select("model_id").distinct(), "model_id", "left_semi")
        pieces = pieces.unionByName(piece(m, 0, F.lit(""), F.lit(0), F.col("metadata")))
    write_pieces(pieces, F.col("text"), transform, path, compression)


def stream_header(transform: dict, metadata: DataFrame | None = None, header: dict | None = None) -> dict:
    """The header of a stream: ``header``, or what ``metadata`` (metadata as JSON text) says, which must agree in all rows but for the extent."""
    shown = {}
    if header is None and metadata is not None:
        parts = F.map_filter(F.from_json("metadata", "map<string, string>"), lambda k, v: k != "geographicalExtent")
        roots = metadata.select(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(parts)))).alias("m"), F.col("metadata").alias("text")).groupBy("m").agg(F.min("text").alias("text")).limit(2).collect()
        if len(roots) > 1:
            raise ValueError("the features' metadata differ")
        shown = {k: v for k, v in json.loads(roots[0]["text"] or "{}").items() if k != "geographicalExtent"} if roots else {}
    return {"type": "CityJSON", "version": "2.0", "transform": transform} | (header or {"metadata": shown}) | {"CityObjects": {}, "vertices": []}


def write_stream(spark: SparkSession, objs: DataFrame, verts: DataFrame, transform: dict, path: str, metadata: DataFrame | None = None, header: dict | None = None, shards: int = 1, compression: str = "none") -> dict:
    """Streams of features, one a shard, each under the same header line; gives the header.

    The header is ``header``, or comes from ``metadata`` (model_id, metadata as JSON text), which must agree in all models
    but for the extent.  An object id in two models is an error.  All is checked before anything is written.
    """
    twice = objs.select("model_id", "external_id").groupBy("external_id").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"object {twice['external_id']} is in two features")
    head = stream_header(transform, metadata, header)
    lines = _features(_bodies(objs, verts, transform)).select(F.pmod(F.xxhash64("model_id"), F.lit(shards)).alias("shard"), F.lit(1).alias("kind"), "model_id", "value")
    heads = spark.range(shards).select(F.col("id").alias("shard"), F.lit(0).alias("kind"), F.lit("").alias("model_id"), F.lit(json.dumps(head)).alias("value"))
    heads.unionByName(lines).repartition("shard").sortWithinPartitions("shard", "kind", "model_id").select("shard", "value").write.partitionBy("shard").option("compression", compression).text(path)
    return head


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file, such as a header, by the file system that the path names."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to)
    out.write(bytearray(text.encode()))
    out.close()


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A dataset: a Parquet directory a table."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}
