"""One query for each operator over the driver's tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, licenses, ngram_join, packing, quality_bt, quality_rules, suffix_dedup, toxicity
from .util import documents


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rated(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bt.ranked(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rated(spark, documents(spark, sf_dir))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, documents(spark, sf_dir))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(spark, documents(spark, sf_dir)).select("doc_id", "license_id", "template", "shared", "notice_shingles")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(spark, documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.length)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(spark, documents(spark, sf_dir))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "</s>[INST] ok [/INST]"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string"))
    # each row is a message of its own, written as a log of deltas, edits and regenerations; turns of equal number in order of role and text
    events = chat.streamed(rows.select("conv_id", F.struct("turn", F.monotonically_increasing_id().alias("row")).alias("message"), "role", "text"))
    messages = chat.folded(events).withColumn("message", F.struct("message.turn", "role", "text", "message.row"))
    out = chat.rendered(messages).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, documents(spark, sf_dir), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_bradley_terry, op3_quality_rules, op4_ngram_jaccard, op5_licenses, op6_suffix_dedup, op7_language_id, op8_chat_format, op9_decontamination, op10_packing)}

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_SHINGLES = "list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))"


def _values(rows: list[tuple[str, int, str]]) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(a)}, {n}, {quote(b)})" for a, n, b in rows)


_NOTICES = _values([(name, i, s) for i, (name, t) in enumerate(licenses.TEMPLATES) for s in licenses.notice_shingles(t)])
_TRIM = "list_filter(list_transform(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: trim(x, '" + licenses.ENDS.replace("'", "''") + "')), lambda w: w <> '')"

ORACLES = {
    "op5_licenses": f"""
WITH notice(license_id, template, s) AS (VALUES {_NOTICES}),
sized AS (SELECT template, count(*) AS n FROM notice GROUP BY template),
words AS (SELECT doc_id, {_TRIM} AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM words WHERE len(w) > 0)
SELECT doc_id, license_id, template::INT AS template, count(*)::BIGINT AS shared, any_value(n)::BIGINT AS notice_shingles
FROM sh JOIN notice USING (s) JOIN sized USING (template)
GROUP BY doc_id, license_id, template HAVING 10 * count(*) >= 8 * any_value(n)""",
    "op8_chat_format": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  (9 + sum(18 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) - 1
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op9_decontamination": f"""
WITH items AS (SELECT item_id, {_WORDS.format(text=f"translate(text, '{_A}', '{_Z}')")} AS w FROM benchmark WHERE text IS NOT NULL),
item AS (SELECT DISTINCT item_id, unnest({_SHINGLES}) AS s, len(w) < 5 AS whole FROM items WHERE len(w) > 0),
sized AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id),
docs AS (SELECT doc_id, {_WORDS.format(text=f"translate(text, '{_A}', '{_Z}')")} AS w FROM documents WHERE text IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s, len(w) < 5 AS whole FROM docs WHERE len(w) > 0)
SELECT doc_id, item_id, any_value(n)::BIGINT AS item_shingles, count(*)::BIGINT AS shared
FROM sh JOIN item USING (s, whole) JOIN sized USING (item_id)
GROUP BY doc_id, item_id HAVING 10 * count(*) >= 8 * any_value(n)""",
}
