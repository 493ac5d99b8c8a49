"""Chat formatting in windows of a token budget.

A turn is written ``<turn ROLE>TEXT</turn>`` and a newline. Inside role and text the three characters
``\\ < >`` are preceded by a backslash, so that no text can hold a control string and every
text can be read back exactly.

Windows are chosen from prefix sums alone, without walking through a conversation: the tokens
before a turn decide its cell of the payload (budget less system turn and history). Turns that lie
in one cell share a window; a turn across a border of cells has a window of its own. So a window
never exceeds the budget, unless a single turn does by itself, which then stays whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ledgerline.llm.packing import encoder
from ledgerline.session import materialize

BUDGET = 2048
HISTORY_TURNS = 2
HISTORY_SHARE = 4  # history takes at most this part of the budget
TARGET = "assistant"
_CONTROL = r"([\\<>])"
_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turns_of(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn written in a window; start and end span the escaped text."""
    out, at = [], 0
    while at < len(window):
        m = _TURN.match(window, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped(m[1]), unescaped(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def _token_counter(vocabulary: str):
    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(vocabulary)
        return texts.map(lambda t: len(encode(t))).astype("int64")

    return count


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def format_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, target: str = TARGET, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Training windows of the conversations in ``turns`` (conv_id, turn, role, text).

    Returns ``conv_id, window, text, tokens, repeated_turns, loss_spans``. A window holds the system
    turn that opens its conversation, up to ``history_turns`` turns before its own ones (as far as a
    quarter of the budget holds them), then its own. ``repeated_turns`` counts the leading turns
    that were already written by an earlier window; ``loss_spans`` are the code-point spans of the
    texts of the target role among the others, so each target is learned once.

    Turns are ordered by turn, role and text; a null turn comes last, a null role or text is empty,
    rows of a null conv_id are one conversation, repeated rows are turns of their own. Windows of a
    conversation are numbered upwards with gaps. Other columns are ignored, whatever their names.
    """
    written = turns.select(
        turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text")
    ).withColumn("text", F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">"), escaped(F.col("text")), F.lit("</turn>\n")))
    # the long texts stay behind here; what is ordered and summed below is numbers
    costed = written.withColumn("cost", _token_counter(vocabulary)("text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        costed.withColumn("rank", F.row_number().over(in_order) - 1)
        .withColumn("is_system", (F.col("rank") == 0) & (F.col("role") == "system"))
        .withColumn("system_cost", F.sum(F.when(F.col("is_system"), F.col("cost")).otherwise(0)).over(upto))
        .withColumn("sum_after", F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("cost"))).over(upto))
        .withColumn("sum_before", F.col("sum_after") - F.when(F.col("is_system"), 0).otherwise(F.col("cost")))
        .withColumn("payload", F.greatest(F.lit(1), F.lit(budget) - F.col("system_cost")))
    )
    history = F.lit(budget // HISTORY_SHARE)
    # the first cell needs no history; later ones leave room for it
    room = F.greatest(F.lit(1), F.col("payload") - history)

    def cell(total: Column) -> Column:
        return F.when(total < F.col("payload"), 0).otherwise(1 + F.floor((total - F.col("payload")) / room))

    first, last = cell(F.col("sum_before")), cell(F.greatest(F.col("sum_after") - 1, F.col("sum_before")))
    # even numbers: within a cell; odd ones: across a border
    placed = materialize(
        placed.withColumn("window", F.when(F.col("is_system"), 0).when(first == last, 2 * first).otherwise(2 * first + 1).cast("long")).drop("payload", "turn"), "turns"
    )
    own = placed.select("conv_id", "window", "rank", "role", "text", "cost", F.lit(False).alias("repeated"))
    starts = placed.groupBy("conv_id", "window").agg(
        F.min("rank").alias("first_rank"), F.min_by("sum_before", "rank").alias("first_before"), F.max("system_cost").alias("system_cost"), F.sum("cost").alias("own_cost")
    ).where("first_rank > 0")
    wanted = starts.select(
        "conv_id", "window", "first_before", "system_cost", "own_cost", "first_rank",
        F.explode(F.concat(F.array(F.lit(0)), F.sequence(F.greatest(F.lit(1), F.col("first_rank") - history_turns).cast("int"), F.greatest(F.lit(1), F.col("first_rank") - 1).cast("int")))).alias("rank"),
    ).where("rank < first_rank").distinct()
    # history only as far as its share, and the window's own turns, leave room; the system turn always
    fits = (F.col("first_before") - F.col("sum_before") <= history) & (F.col("first_before") - F.col("sum_before") + F.col("w.system_cost") + F.col("own_cost") <= budget)
    near = F.col("t.rank") >= F.col("first_rank") - history_turns
    repeated = (
        wanted.alias("w")
        .join(placed.alias("t"), F.col("w.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("w.rank") == F.col("t.rank")))
        .where(F.col("is_system") | (near & fits))
        .select("w.conv_id", "w.window", "t.rank", "t.role", "t.text", "t.cost", F.lit(True).alias("repeated"))
    )
    turn = F.struct("rank", "text", "cost", "repeated", (F.col("role") == target).alias("is_target"), F.length(escaped(F.col("role"))).alias("role_chars"))
    # a window is bounded by the budget, so gathering its turns is
    windows = own.unionByName(repeated).groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head, tail = len("<turn ") + len(">"), len("</turn>\n")
    walked = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["text"])).alias("at"),
            F.when(
                t["is_target"] & ~t["repeated"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + head + t["role_chars"]).alias("start"), (acc["at"] + F.length(t["text"]) - tail).alias("end")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return windows.select(
        "conv_id",
        "window",
        F.concat_ws("", F.transform("turns", lambda t: t["text"])).alias("text"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["cost"]).alias("tokens"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("repeated_turns"),
        walked["spans"].alias("loss_spans"),
    )


DIGEST = StructType(
    [
        StructField("conv_id", LongType()), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
        StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType()), StructField("n_windows", LongType()), StructField("max_tokens", LongType()),
    ]
)


def read_back(windows: DataFrame) -> DataFrame:
    """Digest of each conversation from its formatted windows alone; see ``DIGEST``.

    A conversation's digest runs over all its text in order, so its windows are sorted and hashed
    one after the other in a task, one window in memory at a time.
    """
    window = windows.select(
        F.col("conv_id"), "window", "text", "tokens", "repeated_turns", F.col("loss_spans.start").alias("starts"), F.col("loss_spans.end").alias("ends")
    )
    return window.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInPandas(_digests, DIGEST)


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    state, rows, nothing = None, [], object()
    key = nothing

    def closed():
        n, turns, chars, loss, formatted, count, tokens = state
        return (key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count, tokens)

    for frame in frames:
        for conv_id, text, tokens, repeated, starts, ends in frame[["conv_id", "text", "tokens", "repeated_turns", "starts", "ends"]].itertuples(index=False):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if key is nothing or conv_id != key:
                if key is not nothing:
                    rows.append(closed())
                key, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, content, _, _ in turns_of(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
            for start, end in zip(starts, ends, strict=True):
                target = unescaped(text[start:end])
                state[2] += len(target)
                state[3].update(target.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
            state[5] += 1
            state[6] = max(state[6], int(tokens))
        if rows:
            yield _frame(rows)
            rows = []
    if key is not nothing:
        yield _frame([closed()])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=DIGEST.names)
    return out.assign(conv_id=out["conv_id"].astype("Int64"))
