"""Reading and narrowing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(docs[text], F.lit(""))


def text_hash(text: Column) -> Column:
    """Second half of a row's identity: rows with equal id and equal text are one document."""
    return F.xxhash64(F.lit(17), F.coalesce(text, F.lit("")))


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


#: A key is hot when it holds more than one row in this many; so there are at most this many hot keys.
HOT_KEYS = 1000


def attach(rows: DataFrame, side: DataFrame, key: list[str], n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row a key and counts in ``n`` its rows in ``rows``.

    Keys with more than one row in ``HOT_KEYS`` are broadcast, of which no more than ``HOT_KEYS`` can exist
    at any size; all others meet by a shuffle in which no key weighs more than that share. Keys are not null.
    ``side`` should be stored, as it is read more than once.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT_KEYS > F.lit(total)
    by_broadcast = rows.join(F.broadcast(side.where(hot)), key)
    rest = rows.join(F.broadcast(side.where(hot).select(*key)), key, "left_anti")
    return by_broadcast.unionByName(rest.join(side.where(~hot), key))
