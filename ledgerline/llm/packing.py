"""Best-fit packing of tokenised documents with large-item matching.

Sizes are whole numbers of tokens up to the capacity, so the packing is decided on the counts of each
size: at most ``capacity`` numbers, whatever the corpus. The decision is a short list of runs
"the pieces of size s with ranks from a to b go to these sequences at this place", which is
joined back to the pieces by size and rank.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import text_hash, text_of
from ledgerline.session import materialize

CAPACITY = 1024
END_OF_DOCUMENT = 2
#: Characters tokenised before their pieces are handed on.
_CHARS_AT_ONCE = 4_000_000

PIECES = "doc_id bigint, text_hash bigint, piece int, start bigint, length bigint, ids binary"


@lru_cache(maxsize=2)
def encoder(name: str):
    """Text to ids of the named public vocabulary, as a little-endian uint32 array.

    The byte-pair ranks of a vocabulary are the same in both libraries and give the same ids;
    the rank form is several times as fast. A vocabulary without it is read by ``tokenizers``.
    """
    import public_tokenizers

    ranks = public_tokenizers.path(name.replace(".json", ".tiktoken"))
    try:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (ImportError, FileNotFoundError):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(public_tokenizers.path(name))
        return lambda text: np.array(model.encode(text, add_special_tokens=False).ids, dtype="<u4")
    found = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})
    return lambda text: found.encode_to_numpy(text, allowed_special="all").astype("<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, but for the first."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _tokenised(name: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        kinds = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            out, chars = [], 0
            for doc_id, text_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                t = text.as_py()
                ids = np.append(encode(t), np.array([end], dtype="<u4"))
                out += [(doc_id.as_py(), text_id.as_py(), i, at, n, ids[at : at + n].tobytes()) for i, (at, n) in enumerate(cuts(len(ids), capacity))]
                chars += len(t)
                if chars > _CHARS_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
                    out, chars = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    return run


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (size, first rank, ranks, first sequence, pieces per sequence, offset) for ``counts``.

    Above one third of the capacity at most two pieces share a sequence: each largest remaining
    piece takes the largest remaining one that fits beside it. Smaller sizes then go, largest first,
    to the smallest gap that holds them, filling a sequence as often as the size fits.
    """
    left = {s: n for s, n in sorted(counts.items(), reverse=True) if n}
    placed: dict[int, int] = defaultdict(int)  # pieces of a size that have a place
    runs, gaps, next_sequence = [], defaultdict(list), 0  # gap -> [(first sequence, sequences)]

    def put(size: int, first: int, sequences: int, each: int, offset: int) -> None:
        runs.append((size, placed[size], sequences * each, first, each, offset))
        placed[size] += sequences * each
        left[size] -= sequences * each

    large = [s for s in left if 3 * s > capacity]
    for s in large:
        while left[s]:
            # beside it: the largest that fits and is left once this one has its own place
            other = next((o for o in large if o + s <= capacity and left[o] > (o == s)), None)
            if other is None:
                n, used = left[s], s
                put(s, next_sequence, n, 1, 0)
            elif other == s:
                n, used = left[s] // 2, 2 * s
                put(s, next_sequence, n, 2, 0)
            else:
                n, used = min(left[s], left[other]), s + other
                put(s, next_sequence, n, 1, 0)
                put(other, next_sequence, n, 1, s)
            gaps[capacity - used].append((next_sequence, n))
            next_sequence += n
    for s in [s for s in left if 3 * s <= capacity]:
        while left[s]:
            gap = next((g for g in range(s, capacity) if gaps.get(g)), None)
            if gap is None:  # whole new sequences of this size
                each = capacity // s
                n = left[s] // each
                if n:
                    put(s, next_sequence, n, each, 0)
                    gaps[capacity - each * s].append((next_sequence, n))
                else:
                    n, each = 1, left[s]
                    put(s, next_sequence, n, each, 0)
                    gaps[capacity - each * s].append((next_sequence, n))
                next_sequence += n
                continue
            first, sequences = gaps[gap].pop()
            each = min(gap // s, left[s])
            n = min(sequences, left[s] // each)
            put(s, first, n, each, capacity - gap)
            gaps[gap - each * s].append((first, n))
            if n < sequences:
                gaps[gap].append((first + n, sequences - n))
    return runs


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END_OF_DOCUMENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    ``ids`` holds little-endian unsigned 32-bit ids. A null or empty text is the end id alone. A text
    longer than the capacity is cut into full pieces, the first of which may be shorter. Ranks within
    a size follow a hash of the row, then id, text hash and piece; repeated rows and a null id are
    packed like any other. Other columns are ignored, whatever their names. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].cast("bigint").alias("doc_id"), text_hash(docs[text]).alias("text_hash"), text_of(docs, text).alias("text"))
    pieces = materialize(rows.mapInArrow(_tokenised(vocabulary, capacity, end), PIECES), "pieces", compression="zstd")
    # a size can be that of a third of all pieces: ranks are counted per share of a size and then offset
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), F.lit(shares)).alias("share")
    per_share = materialize(pieces.groupBy("length", share).agg(F.count(F.lit(1)).alias("n")), "sizes")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_share.select(F.col("length").alias("_length"), F.col("share").alias("_share"), before.alias("_before"))
    counts = {r["length"]: r["n"] for r in per_share.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` numbers
    runs = plan_sequences(counts, capacity)
    plan = spark.createDataFrame(runs, "_size long, _from long, _ranks long, _first long, _each long, _at long")
    order = Window.partitionBy("length", "share").orderBy("doc_id", "text_hash", "piece")
    ranked = pieces.withColumn("share", share).withColumn("_row", F.row_number().over(order) - 1)
    rank = F.col("_row") + F.col("_before")
    placed = ranked.join(starts, (ranked["length"] == starts["_length"]) & (ranked["share"] == starts["_share"])).withColumn("_rank", rank)
    # the plan has a few runs for each size, and sizes are at most `capacity`
    return placed.join(F.broadcast(plan), (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_ranks"))).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        (F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each"))).alias("sequence_id"),
        (F.col("_at") + (F.col("_rank") - F.col("_from")) % F.col("_each") * F.col("length")).alias("offset"),
    )
