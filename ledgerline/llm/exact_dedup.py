"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then of everything.

Two texts are equal when they are identical after lower-casing A to Z. A first pass over the texts
keeps two numbers of each, its length in bytes and a hash of its beginning. Rows whose length nobody
shares are out, then rows whose beginning nobody of that length shares. The groups that are left reach
the second pass as a bitmap of bounded size, so that texts are hashed in full where they are read and
never travel: a bit set by chance costs one more hash, never a wrong result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import attach, text_of
from ledgerline.session import materialize

#: Code points of the beginning that the second step hashes.
PREFIX = 256
#: Bits of a filter for each group it holds, and its ceiling (16 MB).
BITS_PER_GROUP, MAX_BITS = 16, 1 << 27


def normalised(text: Column) -> Column:
    """``text`` with A to Z in lower case and nothing else changed."""
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def _beginning(text: Column) -> Column:
    return F.xxhash64(normalised(F.substring(text, 1, PREFIX)))


class Filter:
    """Groups of ``df``, told by the columns ``key``, as a bitmap in slices of 4 KB."""

    def __init__(self, groups: DataFrame, key: list[str]):
        self.bits = min(MAX_BITS, 1 << (groups.count() * BITS_PER_GROUP).bit_length())
        place = self._place(*key)
        self.slices = groups.groupBy(F.bitmap_bucket_number(place).alias("_slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bitmap"))

    def _place(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.bits)) + 1

    def mark(self, df: DataFrame, key: list[str], flag: str) -> DataFrame:
        """``df`` with a flag: false where the row's group is certainly none of those held."""
        bit = F.bitmap_bit_position(self._place(*key))
        byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.getbit(byte, (bit % 8).cast("int")) == 1
        found = df.withColumn("_slice", F.bitmap_bucket_number(self._place(*key))).join(F.broadcast(self.slices), "_slice", "left")
        return found.withColumn(flag, F.coalesce(is_set, F.lit(False))).drop("_slice", "_bitmap")


def survivors(keyed: DataFrame) -> Filter:
    """Filter of the (length, beginning) groups of more than one row."""
    lengths = Filter(keyed.groupBy("length").count().where("count > 1"), ["length"])
    shared = lengths.mark(keyed, ["length"], "_shared").where("_shared")
    return Filter(materialize(shared.groupBy("length", "beginning").count().where("count > 1"), "beginnings"), ["length", "beginning"])


def _candidates(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` of every row with its text, length and beginning, and whether others may share them."""
    text = text_of(docs)
    step = [F.octet_length(text).alias("length"), _beginning(text).alias("beginning")]
    found = survivors(materialize(docs.select(*step), "lengths"))
    keyed = docs.select(*(c.alias(n) for n, c in columns.items()), text.alias("text"), *step)
    return found.mark(keyed, ["length", "beginning"], "candidate")


def mark_copies(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """Decision on every row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest doc_id stays; ``keep_id`` names it. Rows that
    repeat both id and text count in ``group_size`` and exactly one of them stays. A null text is the
    empty text and empty texts equal each other; a null doc_id is smaller than any other. A text that
    length or beginning already told apart has no digest unless ``digest_all`` asks for it. An empty
    table gives no rows; columns other than the two are ignored, whatever their names.
    """
    text = normalised(F.col("text"))
    full = F.when(F.col("candidate"), F.sha2(text, 256))
    rows = _candidates(docs, doc_id=docs["doc_id"]).select(
        "doc_id", full.alias("full"), (F.sha2(text, 256) if digest_all else full).alias("text_sha256"), F.monotonically_increasing_id().alias("row")
    )
    rows = materialize(rows, "digests")
    classes = rows.where("full is not null").groupBy("full").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("n"))
    copies = attach(rows.where("full is not null"), materialize(classes, "classes"), ["full"])
    return copies.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256").unionByName(
        rows.where("full is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns; the cases are those of ``mark_copies``.

    Rows nobody may equal pass through; the others are reduced to one a text before they are
    shuffled, so a group of any size costs each task one row. Where id and text repeat, the row that
    comes last by a hash of its columns stays.
    """
    row = F.struct(*(docs[c] for c in docs.columns))
    marked = _candidates(docs, row=row)
    order = F.struct(F.col("row.doc_id"), F.xxhash64("row"))
    one = marked.where("candidate").groupBy(F.sha2(normalised(F.col("text")), 256).alias("full")).agg(F.max_by("row", order).alias("row"))
    return marked.where(~F.col("candidate")).select("row").unionByName(one.select("row")).select("row.*")
