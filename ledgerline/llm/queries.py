"""One registered query for each text operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import chat, conversation_repair, decontaminate, exact_dedup, licenses, line_dedup, packing, quality_model, quality_rules, secrets, simhash, spelling, toxicity
from ledgerline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them are copies, and their links."""
    return line_dedup.line_report(table(spark, sf_dir, "documents")).drop("text_hash")


#: A conversation whose texts look like control strings, read beside the table's own.
CONTROL_CASE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


@_query
def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every conversation, read back from its formatted windows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.createDataFrame(CONTROL_CASE, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(turns.unionByName(case)))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the two language models."""
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


@_query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    judged = quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's judgement; the value only as its hash."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word", "nth", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("chars"), "score", "is_secret")


@_query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its coverage."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "covered_words", "item_words", "n_tiles")


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the rule ensemble."""
    scored = quality_model.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@_query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@_query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of its text that stays."""
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"), digest_all=True)


ORACLES["op11_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents) AS digests
WINDOW same AS (PARTITION BY text_sha256)
"""


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and the digest of the result."""
    turns = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.report(conversation_repair.repair(turns, dropped="dropped"))


@_query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with the number of its near words, its form and its root."""
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


# crc32 byte by byte over a table made from its polynomial; neighbours by the words without one letter
ORACLES["op13_spelling_variants"] = r"""
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents) AS found),
keyed AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_concat([4294967295], list_transform(range(length(digits) // 2), lambda k: CAST('0x' || substr(digits, 2 * k + 1, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h
  FROM keyed, crc_table),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) AS damaged
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words) AS places),
pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, cut FROM cuts WHERE cut IN (SELECT word FROM words)
  UNION SELECT cut, word FROM cuts WHERE cut IN (SELECT word FROM words)),
ranked AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS place
  FROM pairs p JOIN words w ON w.word = p.near),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.at WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk ON walk.word = f.word JOIN forms last ON last.word = walk.at AND last.form IS NULL
"""
