"""Exact quantiles and order statistics of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task. Here the bracket around
each wanted rank is narrowed by small counting aggregates: first buckets on a log scale, then even
sub-buckets between the extremes of the bucket that holds the rank, as often as a bracket still
holds more than ``BRACKET_ROWS`` rows; at last the few values inside are counted one by one. Every
pass combines on the map side, so one group may hold any share of the rows, and no task ever orders
more than ``max(SUB_BUCKETS, BRACKET_ROWS)`` counts of a bracket, however the values lie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.joins import checked_broadcast
from ledgerline.session import materialize

SUB_BUCKETS = 65535
#: A bracket of at most this many rows is counted value by value.
BRACKET_ROWS = 10_000
_STEPS_PER_E = 32
_LOG_SHIFT = 746.0
_ALL = "_all"  # key of a statistic over all rows


def _log_bucket(v: Column) -> Column:
    size = F.floor((F.ln(F.abs(v)) + _LOG_SHIFT) * _STEPS_PER_E)
    return F.when(v == 0, F.lit(0).cast("bigint")).otherwise(F.signum(v).cast("bigint") * size)


def _sub_bucket(v: Column, lo: Column, hi: Column) -> Column:
    # halves keep the width finite between extremes of either sign; lowest and highest value never share a bucket
    share = (v / 2 - lo / 2) / F.when(hi > lo, hi / 2 - lo / 2)
    return F.when(v >= hi, F.lit(SUB_BUCKETS)).when(v <= lo, F.lit(-1)).otherwise(F.coalesce(F.floor(share * SUB_BUCKETS), F.lit(0))).cast("bigint")


def _inside(data: DataFrame, by: list[str], brackets: DataFrame) -> DataFrame:
    """Rows of ``data`` inside a bracket of their group, one row per bracket."""
    if by == [_ALL]:
        # one group has a bracket for each wanted rank at most: they become literals, and nothing is joined
        held = [F.struct(F.lit(b.t).alias("t"), F.lit(b.r).cast("bigint").alias("r"), F.lit(b.n).cast("bigint").alias("n"), F.lit(b.lo).alias("lo"), F.lit(b.hi).alias("hi")) for b in brackets.collect()]
        kind = "array<struct<t:int,r:bigint,n:bigint,lo:double,hi:double>>"
        inside = F.filter(F.array(*held).cast(kind), lambda t: F.col("_v").between(t["lo"], t["hi"]))
        return data.select(*by, "_v", F.inline(inside))
    targets = brackets.groupBy(*by).agg(F.collect_list(F.struct("t", "r", "n", "lo", "hi")).alias("_targets"))
    joined = data.join(checked_broadcast(targets), by)
    inside = F.filter("_targets", lambda t: F.col("_v").between(t["lo"], t["hi"]))
    return joined.select(*by, "_v", F.inline(inside))


def _narrow(rows: DataFrame, by: list[str], bucket: Column) -> DataFrame:
    """The bucket of every target that contains its rank; the rank becomes relative to it."""
    counts = rows.groupBy(*by, "t", "r", "n", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    upto = F.sum("c").over(Window.partitionBy(*by, "t").orderBy("_b"))
    return (
        counts.withColumn("_upto", upto)
        .filter((F.col("r") < F.col("_upto")) & (F.col("r") >= F.col("_upto") - F.col("c")))
        .select(*by, "t", (F.col("r") - (F.col("_upto") - F.col("c"))).alias("r"), "n", "lo", "hi", "c")
    )


#: Plain statistics that the first pass yields beside the ranks.
MOMENTS = ("mean", "std", "min", "max")


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: Callable[[Column], list[Column]], moments: bool = False) -> DataFrame:
    """Values at 0-based ranks of each group: columns ``by``, ``n``, ``s0``, ``s1``, ...

    ``ranks`` maps the group size to the wanted ranks. NULLs are ignored. With ``moments`` the mean,
    the sample deviation and the extremes come along from the first counting pass. ``df`` is read in
    every pass, so it should be a stored table or a scan; the brackets (a few numbers a group) are
    stored after each pass, counted, and broadcast if there are few of them. No groups at all
    (``by`` is empty) is one group.
    """
    keys = by or [_ALL]
    key = [F.col(c) for c in by] or [F.lit(0).alias(_ALL)]
    data = df.select(*key, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    for c in by:
        data = data.filter(F.col(c).isNotNull())

    hist = data.groupBy(*keys, _log_bucket(F.col("_v")).alias("_b")).agg(
        F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.avg("_v").alias("_avg"), F.var_pop("_v").alias("_var")
    )
    group = Window.partitionBy(*keys)
    sized = hist.withColumns({"_upto": F.sum("c").over(group.orderBy("_b")), "n": F.sum("c").over(group)})
    wanted = ranks(F.col("n"))
    targets = F.array(*[F.struct(F.lit(i).alias("t"), r.cast("bigint").alias("r")) for i, r in enumerate(wanted)])
    start = F.col("_upto") - F.col("c")
    sized = materialize(sized.withColumn("_hits", F.filter(targets, lambda t: (t["r"] >= start) & (t["r"] < F.col("_upto")))), "quantile-buckets")
    brackets = sized.select(*keys, "n", "lo", "hi", "_upto", "c", F.inline("_hits")).select(*keys, "t", (F.col("r") - start).alias("r"), "n", "lo", "hi", "c")

    settled, narrowing = [], brackets
    while True:
        open_ = narrowing.filter((F.col("lo") < F.col("hi")) & (F.col("c") > BRACKET_ROWS))
        settled.append(narrowing.filter((F.col("lo") >= F.col("hi")) | (F.col("c") <= BRACKET_ROWS)))
        if open_.isEmpty():
            break
        rows = _inside(data, keys, open_)
        narrowing = materialize(_narrow(rows, keys, _sub_bucket(F.col("_v"), F.col("lo"), F.col("hi"))), "quantile-brackets")
    brackets = settled[0]
    for more in settled[1:]:
        brackets = brackets.unionByName(more)
    single = F.col("lo") == F.col("hi")
    found = brackets.filter(single).select(*keys, "t", "n", "lo").unionByName(_narrow(_inside(data, keys, brackets.filter(~single)), keys, F.col("_v")).select(*keys, "t", "n", "lo"))
    out = found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("t") == i, F.col("lo"))).alias(f"s{i}") for i in range(len(wanted))])
    if moments:
        out = out.join(_moments(sized, keys), keys)
    return out if by else out.drop(_ALL)


def _moments(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of groups from those of their buckets; spreads add up about the means."""
    total = Window.partitionBy(*keys)
    mean = F.sum(F.col("c") * F.col("_avg")).over(total) / F.col("n")
    spread = F.sum(F.col("c") * (F.col("_var") + F.pow(F.col("_avg") - F.col("_m"), 2)))
    std = F.when(F.max("n") > 1, F.sqrt(spread / (F.max("n") - 1)))
    return buckets.withColumn("_m", mean).groupBy(*keys).agg(F.max("_m").alias("mean"), std.alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"))


def grouped_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], moments: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs``.

    With ``moments`` also ``n`` and the columns of ``MOMENTS``. See :func:`order_statistics`.
    """
    points = list(probs.values())

    def ranks(n: Column) -> list[Column]:
        out = []
        for p in points:
            out += [F.floor((n - 1) * F.lit(p)), F.ceil((n - 1) * F.lit(p))]
        return out

    stats = order_statistics(df, by, value, ranks, moments)
    out = []
    for i, (name, p) in enumerate(probs.items()):
        lo, hi = F.col(f"s{2 * i}"), F.col(f"s{2 * i + 1}")
        pos = (F.col("n") - 1) * F.lit(p)
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return stats.select(*by, *out, *(("n", *MOMENTS) if moments else ()))
