"""The stages against brute force on a small corpus, and the whole run on its driver tables."""


import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_removal, prose

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    passage, item = prose(60, 1), prose(20, 2)
    rows = [(i, prose(90, 10 + i)) for i in range(60)]
    rows += [(60 + i, f"{rows[i][1]} more") for i in range(6)] + [(70 + i, f"{prose(70, 300 + i)} {passage}") for i in range(5)] + [(80, f"{prose(40, 400)} {item} {prose(40, 401)}"), (81, rows[0][1]), (82, None), (83, "")]
    rows += [(90 + i, " ".join(w.upper() + "!!" for w in prose(90, 500 + i).split())) for i in range(20)] + [(None, prose(50, 600))]
    spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], KIND).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i, _ in rows if i is not None and 0 <= i < 110 and i not in (82, 83)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    show = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    rows = show(docs)

    one = corpus_pipeline.quality(spark, docs, folder)
    assert one.columns == docs.columns
    kept = show(one)
    assert set(kept) <= set(rows) and {i for i, _ in kept if i is not None and i >= 90} == set()
    assert {i for i, t in rows if i is not None and i < 82} <= {i for i, _ in kept}

    two = show(corpus_pipeline.near_duplicates(spark, one, folder))
    found = brute_components([r for r in kept if r[0] is not None])
    assert {r for r in two if r[0] is not None} == {(i, t) for i, t in kept if i is not None and found[i][1] == i}
    assert sum(i is None for i, _ in two) == sum(i is None for i, _ in kept)

    three = show(corpus_pipeline.repeats(spark, spark.createDataFrame([(i, t, None, "s", 1) for i, t in two], KIND), folder))
    removed = {r[0]: r for r in brute_removal(two)}
    for i, t in three:
        n, gone = removed[i][1], removed[i][2]
        assert len((t or "").encode()) == n - gone
    assert sum(removed[i][2] > 0 for i, _ in three) == 5

    four = show(corpus_pipeline.decontamination(spark, spark.createDataFrame([(i, t, None, "s", 1) for i, t in three], KIND), folder))
    assert sorted(three, key=str) == sorted([*four, next(r for r in three if r[0] == 80)], key=str)


def test_one_row_of_each_component_outlives_stages_two_and_three(spark, folder):
    twice, nulls, other, low = prose(60, 700), prose(60, 701), prose(60, 702), prose(60, 703)
    assert min(len(t) for t in (twice, nulls, other, low)) > 200
    rows = [(5, twice), (5, twice), (5, twice), (None, nulls), (6, nulls), (None, prose(60, 704)), (None, prose(60, 704)), (7, low), (8, low), (8, other), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], KIND).repartition(3)
    two = corpus_pipeline.near_duplicates(spark, docs, folder)
    three = corpus_pipeline.repeats(spark, two, folder)
    want = sorted([(5, twice), (6, nulls), (None, prose(60, 704)), (7, low), (8, other), (9, None), (9, None)], key=str)
    assert sorted([(r["doc_id"], r["text"]) for r in two.collect()], key=str) == want
    assert sorted([(r["doc_id"], r["text"] or None) for r in three.collect()], key=str) == want


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert 80 not in set(got.doc_id) and 81 not in set(got.doc_id) and 61 not in set(got.doc_id)
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "packing"]


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], KIND)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
