"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame functions only.

A candidate is a run of 16 or more letters, digits, ``+ / _ -`` with a letter and a digit in it, or of
the shape of a known access key. A forest, trained on labelled findings, judges it by its length, by its steps between kinds of
characters, by how much of it dictionary words cover, by the path it was found under and by the words
in front of it. The dictionary is counted on all documents.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import text_hash, text_of
from ledgerline.session import materialize

PATTERN = "[A-Za-z0-9+/_-]{16,}"
THRESHOLD = 0.5
TREES, DEPTH = 40, 6
#: Findings of either label the forest is trained on at most, thinned by a hash.
FIT_ROWS = 20_000
#: A dictionary word stands in this many documents at least; the most frequent ones are kept.
MIN_DOCUMENTS, DICTIONARY_WORDS = 20, 100_000
WORDS_BEFORE = 3

# Shape of access keys of one provider, and words in front of secrets or of harmless ids.
ACCESS_KEY = "^(AKIA|ASIA)[0-9A-Z]{16}$"
SECRET_WORDS = "(?i)(passw|secret|token|api.?key|auth|credential|bearer)"
HARMLESS_WORDS = "(?i)(commit|revision|checksum|digest|sha1|md5|uuid|version|href|http|example|id)\\b"
TEST_PATHS = "(?i)(test|example|sample|fixture|mock|doc)"

FEATURES = ["length", "digits", "uppers", "others", "letter_digit", "digit_letter", "case_steps", "vowel_steps", "hex", "covered", "path_depth", "test_path", "secret_word", "harmless_word", "assigned", "quoted"]


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, text_hash, path, word, nth, candidate, before) of every candidate in ``docs``.

    ``word`` counts words between white space from 0, ``nth`` the candidates inside it; ``before`` holds the
    words in front and what stands before the candidate in its own word.
    """
    known = docs[path].cast("string") if path in docs.columns else F.lit(None).cast("string")
    words = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), F.coalesce(known, F.lit("")).alias("path"), F.split(text_of(docs), r"[\x20\x09-\x0D]+").alias("words")
    )
    # the length test spares most words the pattern
    long = F.filter(
        F.transform("words", lambda w, i: F.when((F.length(w) >= 16) & w.rlike(PATTERN), F.struct(i.alias("at"), w.alias("own")))), lambda x: x.isNotNull()
    )
    found = words.withColumn("long", long).where(F.size("long") > 0).select("doc_id", "text_hash", "path", "words", F.explode("long").alias("l"))
    parts = found.select("doc_id", "text_hash", "path", "words", F.col("l.at").alias("word"), F.col("l.own").alias("own"), F.posexplode(F.regexp_extract_all("l.own", F.lit(PATTERN), F.lit(0))).alias("nth", "candidate"))
    parts = parts.where((F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")) | F.col("candidate").rlike(ACCESS_KEY))
    first = F.greatest(F.lit(0), F.col("word") - WORDS_BEFORE)
    front = F.array_join(F.slice("words", first + 1, F.col("word") - first), " ")
    return parts.select("doc_id", "text_hash", "path", "word", "nth", "candidate", F.concat_ws(" ", front, F.expr("substring_index(own, candidate, 1)")).alias("before"))


def dictionary(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, at_most: int = DICTIONARY_WORDS) -> DataFrame:
    """(entry) words of 4 to 12 letters a-z that stand in many documents."""
    words = F.filter(F.array_distinct(F.split(F.lower(text_of(docs)), "[^a-z]+")), lambda w: (F.length(w) >= 4) & (F.length(w) <= 12))
    counted = docs.select(F.explode(words).alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents)
    return counted.orderBy(F.desc("n"), "entry").limit(at_most).select("entry")


def covered(found: DataFrame, entries: DataFrame) -> DataFrame:
    """(candidate, covered): share of a candidate's characters inside dictionary words."""
    once = found.select("candidate").distinct()
    starts = F.sequence(F.lit(1), F.length("candidate") - 3)
    parts = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(4), F.least(F.lit(12), F.length("candidate") - s + 1)), lambda n: F.struct(s.alias("s"), n.alias("n")))))
    pieces = once.select("candidate", F.explode(parts).alias("p")).withColumn("entry", F.lower(F.col("candidate").substr(F.col("p.s"), F.col("p.n")))).where(F.col("entry").rlike("^[a-z]+$"))
    inside = pieces.join(entries, "entry").groupBy("candidate").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("p.s"), F.col("p.s") + F.col("p.n") - 1))))).alias("inside"))
    return once.join(inside, "candidate", "left").select("candidate", (F.coalesce("inside", F.lit(0)) / F.length("candidate")).alias("covered"))


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def _is(column: str, pattern: str) -> Column:
    return F.col(column).rlike(pattern).cast("double")


def features(found: DataFrame, entries: DataFrame) -> DataFrame:
    """``found`` (candidate, before, path and others) with ``FEATURES``."""
    last = F.element_at(F.split("before", " "), -1)
    return (
        found.join(covered(found, entries), "candidate")
        .withColumn("length", F.length("candidate").cast("double"))
        .withColumn("digits", _share("[0-9]"))
        .withColumn("uppers", _share("[A-Z]"))
        .withColumn("others", _share("[^A-Za-z0-9]"))
        .withColumn("letter_digit", _share("[A-Za-z](?=[0-9])"))
        .withColumn("digit_letter", _share("[0-9](?=[A-Za-z])"))
        .withColumn("case_steps", _share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"))
        .withColumn("vowel_steps", _share("(?i)[bcdfghjklmnpqrstvwxz](?=[aeiouy])|[aeiouy](?=[bcdfghjklmnpqrstvwxz])"))
        .withColumn("hex", _is("candidate", "^[0-9a-f]+$"))
        .withColumn("path_depth", F.regexp_count("path", F.lit("/")).cast("double"))
        .withColumn("test_path", _is("path", TEST_PATHS))
        .withColumn("secret_word", _is("before", SECRET_WORDS))
        .withColumn("harmless_word", _is("before", HARMLESS_WORDS))
        .withColumn("assigned", _is("before", r"[=:]\s*[\"']?$"))
        .withColumn("quoted", last.rlike("[\"']$").cast("double"))
    )


def labelled_findings(docs: DataFrame, found: DataFrame, at_most: int = FIT_ROWS) -> DataFrame:
    """(candidate, before, path, label) by rule, for corpora that nobody has gone through by hand.

    Positive: access keys of known shape, and values assigned to a secret's name. Negative: harmless ids of
    the same length and alphabet that the rule makes from a document's own words and hash (slugs, commit hashes, UUIDs).
    """
    sure = F.col("candidate").rlike(ACCESS_KEY) | F.col("before").rlike(SECRET_WORDS + r"\w*\s*[=:]\s*[\"']?$")
    good = found.where(sure).select("candidate", "before", "path", F.lit(1).alias("label"))
    rows = docs.select(text_of(docs).alias("text"), F.coalesce(docs["source"].cast("string") if "source" in docs.columns else F.lit(""), F.lit("")).alias("path"))
    rows = _thinned(rows, F.col("text"), at_most)
    words = F.filter(F.split(F.substring("text", 1, 400), r"[^A-Za-z]+"), lambda w: F.length(w) > 2)
    digest = F.sha1("text")
    uuid = F.concat_ws("-", digest.substr(1, 8), digest.substr(9, 4), digest.substr(13, 4), digest.substr(17, 4), digest.substr(21, 12))
    number = F.pmod(F.xxhash64("text"), F.lit(9000)) + 1000
    bad = rows.withColumn("w", words).where(F.size("w") >= 8).select(
        "path",
        F.explode(
            F.array(
                F.struct(F.concat_ws("-", F.slice("w", 1, 4), number).alias("candidate"), F.concat_ws(" ", F.slice("w", 5, 3)).alias("before")),
                F.struct(F.concat_ws("_", F.slice("w", 2, 3), number).alias("candidate"), F.concat(F.concat_ws(" ", F.slice("w", 6, 2)), F.lit(" name = \"")).alias("before")),
                F.struct(digest.alias("candidate"), F.concat(F.concat_ws(" ", F.slice("w", 5, 2)), F.lit(" commit")).alias("before")),
                F.struct(uuid.alias("candidate"), F.concat(F.concat_ws(" ", F.slice("w", 5, 2)), F.lit(" id: ")).alias("before")),
                F.struct(F.concat_ws("/", F.slice("w", 1, 4), number).alias("candidate"), F.concat(F.concat_ws(" ", F.slice("w", 4, 2)), F.lit(" http:/")).alias("before")),
            )
        ).alias("n"),
    )
    bad = bad.select("n.candidate", "n.before", "path", F.lit(0).alias("label")).where(F.col("candidate").rlike(f"^{PATTERN}$"))
    return _thinned(good, F.concat("candidate", "before"), at_most).unionByName(_thinned(bad, F.concat("candidate", "before"), at_most))


def _thinned(rows: DataFrame, key: Column, at_most: int) -> DataFrame:
    n = rows.count()
    return rows if n <= at_most else rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(at_most / n * (1 << 30)))


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str = "source") -> DataFrame:
    """Every candidate of ``docs`` with the forest's judgement.

    Returns ``doc_id, text_hash, word, nth, candidate, score, is_secret``. ``findings`` (candidate, before, path,
    label) is what the forest learns; without it labels come from ``labelled_findings``. With one label only the
    forest has nothing to remove: every candidate has that label's score. A null text has no candidate, a null
    path is empty, a null id is scanned, repeated rows repeat their findings, other columns are ignored, no
    rows give no rows.
    """
    found = materialize(candidates(docs, path), "secret_candidates")
    entries = materialize(dictionary(docs), "secret_dictionary")
    known = findings if findings is not None else labelled_findings(docs, found)
    train = materialize(features(known.select("candidate", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("path", F.lit("")).alias("path"), "label").where("candidate is not null and label is not null"), entries).select("label", *FEATURES), "secret_findings")
    judged = features(found, entries)
    n, ones = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        score = F.lit(0.0 if n and not ones else 1.0)
    else:
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, labelCol="label", featuresCol="features").fit(assembler.transform(train))
        judged, score = forest.transform(assembler.transform(judged)), vector_to_array("probability")[1]
    return judged.select("doc_id", "text_hash", "word", "nth", "candidate", score.alias("score")).withColumn("is_secret", F.col("score") >= THRESHOLD)
