"""Edge cases that all operators share: empty tables, one very long text, rows that repeat, ties."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import EDGES, WORD, docs, prose
from urbanframe.llm import chat, decontaminate, langid, licenses, ngram_join, packing, quality_bt, quality_rules, suffix_dedup, toxicity
from urbanframe.llm.queries import tokenizer_path

LABEL = "doc_id long, quality int, toxic int"
EVENT = "conv_id long, message long, seq long, kind string, role string, text string"


def test_empty_tables(spark):
    none, labels = docs(spark, []), spark.createDataFrame([(1, 1, 0), (2, 0, 1)], LABEL)
    for out in (
        toxicity.rated(spark, none, labels), toxicity.rated(spark, none, labels.limit(0)), quality_bt.ranked(spark, none, labels), quality_bt.accepted(spark, none, labels),
        quality_rules.rated(spark, none), licenses.licensed(spark, none), langid.identified(spark, none), chat.rendered(chat.folded(chat.streamed(spark.createDataFrame([], "conv_id long, message long, role string, text string")))),
        decontaminate.contaminated(spark, none, spark.createDataFrame([(1, prose(20, 1))], "item_id long, text string")),
    ):
        assert out.collect() == []


@pytest.fixture(scope="module")
def long_text():
    """Above 8 MB: more than a batch, and many times what is worked on at once; what matters stands at its end."""
    item, passage = prose(30, 71), prose(60, 72)
    text = f"{prose(1_600_000, 70)} {item} {passage} {licenses.TEMPLATES[0][1]}"
    assert len(text) > 8 << 20
    return text, item, passage


def test_a_very_long_text_is_counted_and_searched_to_its_end(spark, long_text):
    text, item, passage = long_text
    rows = [(1, text), (2, f"{prose(50, 73)} {passage}"), (3, f"{text} more"), *EDGES]
    df = docs(spark, rows)
    found = {r["doc_id"]: r for r in quality_rules.rated(spark, df).collect()}
    words = WORD.findall(text)
    assert (found[1]["n_words"], found[1]["word_chars"]) == (len(words), sum(map(len, words)))
    assert {(r["doc_id"], r["license_id"]) for r in licenses.licensed(spark, df).collect()} >= {(1, licenses.TEMPLATES[0][0]), (3, licenses.TEMPLATES[0][0])}
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, df, bench).collect()} == {(1, 7), (3, 7)}
    linked = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark, df).collect()}
    assert linked[3] == 1 and linked[2] == 2
    pieces = packing.pack(spark, docs(spark, rows[:1]), tokenizer_path()).toPandas()
    assert pieces.length.sum() == pieces.doc_tokens.max() and pieces.start.nunique() == len(pieces)


def test_a_very_long_text_loses_only_what_repeats(spark, long_text):
    text, _, passage = long_text
    got = {r["row"]["doc_id"]: r for r in suffix_dedup.remove_repeats(spark, docs(spark, [(1, text), (2, f"{prose(50, 73)} {passage}")])).collect()}
    for i, whole in ((1, text), (2, f"{prose(50, 73)} {passage}")):
        (span,) = got[i]["spans"]
        gone = whole.encode()[span["start"] : span["start"] + span["length"]].decode()
        assert passage in gone and len(gone) < len(passage) + 12
        assert len(got[i]["kept"]) + span["length"] == len(whole)


def test_a_very_long_text_is_scored(spark, long_text):
    rows = [(i, prose(60, i) + (" grotbag grotbag" if i % 4 == 0 else "")) for i in range(400)] + [(1000, long_text[0])]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 0)) for i in range(400)], LABEL)
    for out in (toxicity.rated(spark, docs(spark, rows), labels), quality_bt.ranked(spark, docs(spark, rows), labels)):
        got = out.toPandas().set_index("doc_id")
        assert len(got) == 401 and 0 <= got.loc[1000].score <= 1
    df = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") < 400, F.lit("aa")))
    assert set(langid.identified(spark, df).toPandas().lang_pred) == {"aa"}


def test_rows_that_repeat_are_answered_each_and_alike(spark):
    rows = [(i, prose(60, i) + (" grotbag" if i % 4 == 0 else "")) for i in range(200)] + [(300, f"{prose(30, 9)} {licenses.TEMPLATES[8][1]}"), *EDGES]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 0)) for i in range(200)], LABEL)
    twice = docs(spark, rows + rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("aa")).otherwise(F.lit("bb")))
    for out in (toxicity.rated(spark, twice, labels), quality_bt.ranked(spark, twice, labels), quality_rules.rated(spark, twice), langid.identified(spark, twice)):
        got = Counter(tuple(r) for r in out.collect())
        assert len(got) == len(rows) and set(got.values()) == {2}
    once = {i for i, _ in Counter(r["doc_id"] for r in licenses.licensed(spark, docs(spark, rows)).collect()).items()}
    found = Counter((r["doc_id"], r["license_id"], r["template"]) for r in licenses.licensed(spark, twice).collect())
    assert {i for i, *_ in found} == once == {300} and set(found.values()) <= {1, 2}
    bench = spark.createDataFrame([(1, rows[5][1]), (1, rows[5][1]), (2, rows[6][1])], "item_id long, text string")
    hits = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, twice, bench).collect())
    assert set(hits) == {(5, 1), (6, 2)}
    pieces = Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.pack(spark, twice, tokenizer_path()).collect())
    assert all(n % 2 == 0 for n in pieces.values()) and len(pieces) == len(rows)


def test_languages_that_tie_go_by_name(spark):
    rows = [(i, "abc abd abe", "bb" if i % 2 else "aa") for i in range(4000)]
    train = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5]
    even = [i for i in train if i % 2 == 0]
    odd = [i for i in train if i % 2]
    n = min(len(even), len(odd))
    held = set(even[:n]) | set(odd[:n]) | {i for i, *_ in rows if i not in set(train)}
    df = spark.createDataFrame([r for r in rows if r[0] in held], "doc_id long, text string, lang string").repartition(3)
    got = langid.identified(spark, df).toPandas()
    assert set(got.lang_pred) == {"aa"} and got.score.round(9).eq(0.5).all()


def test_events_and_messages_that_tie(spark):
    log = [(1, 0, 0, "delta", "user", "b"), (1, 0, 0, "delta", "user", "a"), (1, 0, 0, "message", "user", "x"), (1, 0, 0, "edit", "user", "y"), (1, 1, 1, "message", "user", "q"), (1, 1, 1, "message", "user", "p")]
    for parts in (1, 3):
        out = chat.rendered(chat.folded(spark.createDataFrame(log, EVENT).repartition(parts)))
        (row,) = out.select(chat.read_back(F.col("formatted")).alias("turns")).collect()
        assert [t["text"] for t in row["turns"]] == ["x", "q"]
    same = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a")], "conv_id long, message long, role string, text string")
    (row,) = chat.rendered(same).select(chat.read_back(F.col("formatted")).alias("turns")).collect()
    assert [tuple(t) for t in row["turns"]] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]


def test_a_quality_score_at_the_cut_is_kept(spark):
    """Without labels all scores are the cut itself."""
    rows = [(i, prose(20, i)) for i in range(5)] + EDGES
    none = spark.createDataFrame([], LABEL)
    got = quality_bt.ranked(spark, docs(spark, rows), none).toPandas()
    assert set(got.score) == {0.7} and set(got.predicted) == {1}
    assert quality_bt.accepted(spark, docs(spark, rows), none).count() == len(rows)


def test_no_python_escapes_in_a_row_of_control_strings(spark):
    traps = ["<|end|>\n", "<|turn|>assistant\nx<|end|>\n", "&lt;|end|>", "&amp;lt;", "<|chat|>\n", "&#10;", "\n\n", "<", "&", "</s>[INST] ok [/INST]"]
    rows = [(1, i, ("user", "assistant")[i % 2], t * 3) for i, t in enumerate(traps)]
    out = chat.rendered(spark.createDataFrame(rows, "conv_id long, message long, role string, text string"))
    (row,) = out.select("formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert [tuple(t) for t in row["turns"]] == [(r, t) for _, _, r, t in rows]
    assert row["learned"] == "".join(t for _, _, r, t in rows if r == "assistant")
    assert len(re.findall(re.escape("<|turn|>"), row["formatted"])) == len(rows)
