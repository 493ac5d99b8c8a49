"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits share
at least six of them. Postings of one positional byte would hold 1/256 of all fingerprints at any
size, so that pairs would grow with the square of the corpus; postings are therefore formed for
sets of four positions. The six unions of two of the four byte pairs leave out every pair of bytes
at least once, so every link meets in a posting. Pairs from the postings are tallied byte by byte,
pairs below six shared bytes are dropped, the rest is verified on the bits.

Two bits of 64 are far fewer than near copies of a given similarity differ in. ``similar_documents``
therefore takes the fingerprints' links, each verified by the similarity of the two sets of shingles,
first, and completes them by a join of the sets: two sets of similarity s share one of the first
n - ceil(s * n) + 1 shingles of either in any fixed order. The order is that of a bounded array of
counters, rare shingles first, so that few sets meet. Where many do, they are tied to one of them and
verified; then only sets of different components make pairs. Each pair is verified; no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerline.llm.common import text_hash
from ledgerline.llm.exact_dedup import Filter
from ledgerline.llm.graph import components
from ledgerline.session import materialize

SHINGLE_WORDS = 3
MAX_BITS = 2
MIN_SHARED_BYTES = 8 - MAX_BITS
#: A posting of up to this many fingerprints is joined with itself; a longer one is refined.
POSTING_ROWS = 48
_ROWS_AT_ONCE = 1 << 14
#: Counters by which shingles are ordered (4 MB); those that share one are only ordered less well.
ORDER_COUNTERS = 1 << 20
_SHINGLES_AT_ONCE = 1 << 21


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of one text; zero when it has no word."""
    # bytes: lower() changes A-Z only, split() cuts at exactly \x20 \x09-\x0D
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """Unsigned number of the bits that are set in over half of the hashes; zero of none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _ROWS_AT_ONCE):
        part = hashes[at : at + _ROWS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def _mask(positions) -> int:
    """Signed long with the bits of the given byte positions set."""
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


#: Kept positions of the six blocks, and of the six refinements of each.
_BLOCKS = [sorted(a + b) for a, b in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]
_REFINED = [[(kept, *two) for two in combinations(sorted(set(range(8)) - set(kept)), 2)] for kept in _BLOCKS]


def _shared_bytes(x: Column) -> Column:
    return sum((F.when(x.bitwiseAND(_mask([p])) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def _postings(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Short and long postings of (block, key, fp); those of a single fingerprint link nothing."""
    sized = entries.join(entries.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), ["block", "key"])
    return sized.where(F.col("n") <= POSTING_ROWS).drop("n"), sized.where(F.col("n") > POSTING_ROWS).drop("n")


def _pairs(short: DataFrame) -> DataFrame:
    x = F.col("a").bitwiseXOR(F.col("b"))
    return (
        short.select("block", "key", F.col("fp").alias("a"))
        .join(short.select("block", "key", F.col("fp").alias("b")), ["block", "key"])
        .where(F.col("a") < F.col("b"))
        .where(_shared_bytes(x) >= MIN_SHARED_BYTES)
        .where(F.bit_count(x) <= MAX_BITS)
        .select("a", "b")
    )


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the distinct fingerprints ``fp``.

    A posting of few fingerprints gives its pairs. A long one (near copies beside each other) is
    refined by two more positions, and what is still long then differs in the bits of two bytes
    only: its fingerprints are grouped by value with two of these bits blanked, any two members of
    such a group being a link, and each is tied to the group's smallest. That is exact and linear
    in the posting, so no group ever emits all its pairs.
    """
    entries = fps.select(
        "fp",
        F.explode(F.array(*(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(_mask(kept)).alias("key")) for i, kept in enumerate(_BLOCKS)))).alias("e"),
    ).select("fp", "e.block", "e.key")
    short, long = _postings(entries)
    options = F.array(
        *(
            F.when(
                F.col("block") == i,
                F.array(*(F.struct(F.lit(6 * i + j).alias("block"), F.col("fp").bitwiseAND(_mask([*kept, *more])).alias("key")) for j, (kept, *more) in enumerate(options))),
            )
            for i, options in enumerate(_REFINED)
        )
    )
    refined = materialize(
        long.select("fp", F.explode(F.flatten(F.filter(options, lambda x: x.isNotNull()))).alias("e")).select("fp", "e.block", "e.key"), "refined"
    )
    short_refined, long_refined = _postings(refined)
    blanks = F.array(*(F.when(F.col("block") == 6 * i + j, F.array(*(F.lit(m) for m in _two_bit_masks(kept, more)))) for i, options in enumerate(_REFINED) for j, (kept, *more) in enumerate(options)))
    blanked = long_refined.select("fp", F.explode(F.flatten(F.filter(blanks, lambda x: x.isNotNull()))).alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("value")
    )
    least = blanked.groupBy("mask", "value").agg(F.min("fp").alias("a"))
    tied = blanked.join(least, ["mask", "value"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    return _pairs(short).unionByName(_pairs(short_refined)).unionByName(tied)


def _two_bit_masks(kept, more) -> list[int]:
    free = [8 * p + bit for p in range(8) if p not in {*kept, *more} for bit in range(8)]
    masks = [(1 << a) | (1 << b) for a, b in combinations(free, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of two or fewer differing bits.
    A null text is the empty text, whose fingerprint is zero and linked like any other; a null id is
    kept and names a component only when no id in it is known (then the component is null).
    Repeated rows stay rows. Other columns are ignored, whatever their names. No rows give no rows.
    """
    rows = materialize(docs.select(docs[doc_id].alias("doc_id"), text_hash(docs[text]).alias("text_hash"), fingerprints(docs[text]).alias("fp")), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    of = components(links(fps.select("fp")))
    roots = fps.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of all its words when they are fewer, none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(min(shingle_words, len(words)))), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8").view(np.int64))


def prefix_length(n: int, similarity: float) -> int:
    """Elements of a set of ``n`` of which a similar set has one at least."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def _tallied(shingle_words: int):
    """Of the sets of a task, how many elements fall on each of ``ORDER_COUNTERS`` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_COUNTERS, np.uint32)
        for batch in batches:
            held, n = [], 0
            for text in batch.column(0):
                held.append(shingle_set(text.as_py(), shingle_words) & (ORDER_COUNTERS - 1))
                n += len(held[-1])
                if n > _SHINGLES_AT_ONCE:
                    total += np.bincount(np.concatenate(held), minlength=ORDER_COUNTERS).astype(np.uint32)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=ORDER_COUNTERS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def _tally(texts: DataFrame, shingle_words: int) -> np.ndarray:
    """The counters over all ``texts``: a fixed number, added up in a tree of tasks."""
    counted = texts.select("text").mapInArrow(_tallied(shingle_words), "counts binary")
    return counted.rdd.map(lambda r: np.frombuffer(r[0], np.uint32)).treeAggregate(np.zeros(ORDER_COUNTERS, np.uint32), np.add, np.add)


def _sets(shingle_words: int, similarity: float | None, counters=None):
    """Number, hash, fingerprint and elements of each set; with a similarity only its prefix, rare elements first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle_words) for t in batch.column(2)]
            keys = [xxhash.xxh64_intdigest(x.tobytes()) for x in found]
            held, bits = found, np.zeros(len(found), np.uint64)
            if similarity is not None:
                tally = counters.value
                held = [x[np.lexsort((x, tally[x & (ORDER_COUNTERS - 1)]))[: prefix_length(len(x), similarity)]] for x in found]
                bits = np.array([majority(x) for x in found], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                    pa.array(bits.view(np.int64)),
                    pa.array([len(x) for x in found], pa.int32()),
                    pa.array(held, pa.list_(pa.int64())),
                ],
                names=["row", "text_hash", "fp", "bits", "n", "shingles"],
            )

    return run


def _met(sets: DataFrame) -> DataFrame:
    """(shingle, fp, n, rest) for the prefix shingles of distinct sets that two of them share at least.

    ``rest`` is the number of elements from this one on. All shingles are counted by themselves; most stand
    in one prefix only and are ruled out by a bitmap before anything else of them is shuffled.
    """
    shared = materialize(sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where("count > 1").select("shingle"), "shared_shingles")
    entries = sets.select("fp", "n", F.posexplode("shingles").alias("at", "shingle")).select("shingle", "fp", "n", (F.col("n") - F.col("at")).alias("rest"))
    marked = Filter(shared, ["shingle"]).mark(entries, ["shingle"], "shared").where("shared").drop("shared")
    return materialize(marked.join(shared, "shingle", "left_semi"), "met_shingles")


def _near_fingerprints(sets: DataFrame) -> DataFrame:
    """Candidates (a, b) among distinct sets (fp, bits): equal fingerprints, tied to one set, and linked ones, by ``links``."""
    first = materialize(sets.groupBy("bits").agg(F.min("fp").alias("a")), "set_fingerprints")
    equal = sets.join(first, "bits").where("a <> fp").select("a", F.col("fp").alias("b"))
    of = links(first.select(F.col("bits").alias("fp")))
    for side in "ab":
        of = of.join(first.select(F.col("bits").alias(side), F.col("a").alias(f"set_{side}")), side)
    return equal.unionByName(of.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")))


def _tied(met: DataFrame) -> DataFrame:
    """Candidates (a, b) that tie the sets of each crowded posting to the one that meets them earliest in its own order."""
    centres = met.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct(F.col("rest") - F.col("n"), "fp"))["fp"].alias("a")).where(F.col("size") > POSTING_ROWS)
    return met.join(centres, "shingle").where("a <> fp").select("a", F.col("fp").alias("b"))


def _similar_pairs(met: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b) of different components among the sets that meet in a posting.

    Two similar sets share elements from the first common one on only, so that as many must be left of both
    there. A posting within one component gives nothing and goes before the join.
    """
    entries = met.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    entries = materialize(entries, "met_roots")
    mixed = entries.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("shingle")
    entries = entries.join(mixed, "shingle")
    a, b = (entries.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("fp", "n", "rest", "root"))) for side in "ab")
    enough = F.least("rest_a", "rest_b") * (1 + similarity) >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-6
    return a.join(b, "shingle").where((F.col("fp_a") < F.col("fp_b")) & (F.col("root_a") != F.col("root_b")) & enough).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def similar_documents(docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of ``docs``, as ``near_duplicates``.

    Links are those of a Jaccard similarity of at least ``similarity`` between the sets of shingles of
    ``shingle_words`` words (one shingle of all words in a shorter text); ``fp`` is the hash of the set. Texts
    without a word have equal sets. Nulls, repeated rows and other columns are treated as there.
    """
    texts = docs.select(docs["doc_id"].alias("row"), text_hash(docs["text"]).alias("text_hash"), docs["text"].alias("text"))
    kinds = f"row {texts.schema['row'].dataType.simpleString()}, text_hash bigint, fp bigint, bits bigint, n int, shingles array<bigint>"
    counters = docs.sparkSession.sparkContext.broadcast(_tally(texts, shingle_words))
    rows = materialize(texts.mapInArrow(_sets(shingle_words, similarity, counters), kinds), "shingle_prefixes")
    sets = rows.dropDuplicates(["fp"])

    def verified(candidates: DataFrame) -> DataFrame:
        pairs = materialize(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar_candidates")
        # whole sets of the candidates only
        wanted = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        chosen = rows.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("text_hash").alias("text_hash")).select("text_hash")
        whole = texts.join(chosen, "text_hash", "left_semi").select("row", "text_hash", "text").mapInArrow(_sets(shingle_words, None), kinds)
        whole = materialize(whole.select("fp", "n", "shingles").dropDuplicates(["fp"]), "shingle_sets")
        sides = pairs.join(whole.select(F.col("fp").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a")), "a").join(
            whole.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b")), "b"
        )
        shared = F.size(F.array_intersect("s_a", "s_b"))
        return materialize(sides.where(shared >= similarity * (F.col("n_a") + F.col("n_b") - shared) - 1e-6).select("a", "b"), "similar_links")

    met = _met(sets.select("fp", "n", "shingles"))
    close = verified(_near_fingerprints(sets.select("fp", "bits")).unionByName(_tied(met)))
    rest = verified(_similar_pairs(met, components(close), similarity))
    of = components(close.unionByName(rest))
    least = materialize(rows.groupBy("fp").agg(F.min("row").alias("least")), "distinct_sets")
    roots = least.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = roots.join(roots.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.select(F.col("row").alias("doc_id"), "text_hash", "fp").join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row for each component: that of the smallest id.

    Components are those of ``similar_documents`` when a similarity is given, else of ``near_duplicates``, whose
    fingerprints have shingles of ``SHINGLE_WORDS`` only.
    Among rows that repeat this id the one of the smallest text hash stays, equal rows once.
    Rows of a component without any id are kept by their text hash. Other columns stay, whatever their names.
    """
    if similarity is None and shingle_words != SHINGLE_WORDS:
        raise ValueError(f"fingerprints are of {SHINGLE_WORDS} words; give a similarity for other shingles")
    found = near_duplicates(docs) if similarity is None else similar_documents(docs, shingle_words, similarity)
    firsts = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("text_hash"))).alias("_hash")
    )
    chosen = (
        found.join(firsts, found["component_id"].eqNullSafe(firsts["component_id"]) & (found["text_hash"] == firsts["_hash"]), "left_semi")
        .where("doc_id <=> component_id")
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    joined = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_id"]) & (text_hash(docs["text"]) == chosen["_hash"]))
    once = joined.where(chosen["_copies"] == 1).select(*(docs[c] for c in docs.columns))
    again = joined.where(chosen["_copies"] > 1).select(*(docs[c] for c in docs.columns)).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)
