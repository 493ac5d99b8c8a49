"""Exact and near copies of lines by a segment-partition edit join; DataFrame functions only.

Two lines are near copies when at most ``allowed`` edits (insertions, deletions, substitutions) lead from
one to the other: none below 10 characters, one below 20, else two, by the shorter line. The shorter line is
cut into one segment more than that, so at least one segment stands unchanged in the longer line. Index
entries hold length, segment number and segment; a longer line probes, for each length in reach, only
the substrings at which a segment can stand. Whatever meets is verified by a banded bit-parallel
edit distance on what lies between the common prefix and suffix.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import spare_name, text_hash, text_of
from ledgerline.session import materialize

ONE_EDIT, TWO_EDITS = 10, 20
MAX_EDITS = 2
#: An index entry that more rows than this meet in is refined before pairs are formed.
GROUP_ROWS = 48
#: Letter classes of the refinement: two edits touch at most four of them, so two stay as they are.
CLASSES = 6
NOT_BLANK = r"[^\x20\x09-\x0D]"
#: Line hashes broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def allowed(length: Column) -> Column:
    return F.when(length < ONE_EDIT, 0).when(length < TWO_EDITS, 1).otherwise(MAX_EDITS)


def probes() -> list[tuple[int, int, int, int]]:
    """(edits, length difference, segment, shift): where segment i of the shorter line can stand.

    Of several ways to align the lines one has at most i - 1 edits left of segment i and at most
    edits + 1 - i right of it; other shifts need not be probed.
    """
    out = []
    for t in range(1, MAX_EDITS + 1):
        for more in range(t + 1):
            for i in range(1, t + 2):
                low, high = max(-(i - 1), more - (t + 1 - i)), min(i - 1, more + (t + 1 - i))
                out += [(t, more, i, shift) for shift in range(low, high + 1)]
    return out


def entries(lines: DataFrame) -> DataFrame:
    """(key, id, is_index) of lines (id, line). An index entry is at the same time the probe of its own place."""
    n = F.col("n")
    found = []
    for t, more, i, shift in probes():
        short = n - more
        start, stop = F.floor(short * (i - 1) / (t + 1)), F.floor(short * i / (t + 1))
        key = F.xxhash64(F.lit(8 * t + i), short, F.col("line").substr((start + 1 + shift).cast("int"), (stop - start).cast("int")))
        found.append(F.when((short >= ONE_EDIT) & (allowed(short) == t), F.struct(key.alias("key"), F.lit(more == 0 and shift == 0).alias("is_index"))))
    exploded = lines.withColumn("n", F.length("line")).where(n >= ONE_EDIT).select("id", F.explode(F.array_compact(F.array(*found))).alias("e"))
    return exploded.select("e.key", "id", "e.is_index")


def _common(a: Column, b: Column, most: Column) -> Column:
    """Length of the common prefix, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= most) & (a.substr(n + 1, k) == b.substr(n + 1, k)), n + k).otherwise(n))


def banded_distance(p: Column, t: Column, band: int = MAX_EDITS) -> Column:
    """Edit distance of two arrays of characters if it is at most ``band``, else a larger number.

    Bit k of a column's vectors stands for row j - band + k of column j: only the diagonals within the band are kept, in
    2 * band + 1 bits. ``vp`` and ``vn`` hold the steps of +1 and -1 down a column, ``d`` the cells equal to
    their diagonal neighbour; the result is followed down the lowest diagonal, then along the last row.
    """
    full, top = (1 << (2 * band + 1)) - 1, 1 << (2 * band)
    m, n = F.size(p), F.size(t)
    start = F.struct(
        F.lit(full & ~((1 << band) - 1)).alias("vp"),  # below the first row a column starts with steps of +1
        F.lit(0).alias("vn"),
        F.least(m, F.lit(band)).alias("score"),
    )

    def bit(x: Column) -> Column:
        return F.when(x, 1).otherwise(0)

    def step(acc: Column, j: Column) -> Column:
        c = F.get(t, j - 1)
        equal = sum((F.when((j - band + k >= 1) & (F.get(p, j - band + k - 1) == c), 1 << k).otherwise(0) for k in range(2 * band + 1)), F.lit(0))
        vp, vn = acc["vp"], acc["vn"]
        d = let(equal, lambda e: ((e.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(full))
        return let(F.struct(d.alias("d"), vp.alias("vp"), vn.alias("vn"), acc["score"].alias("score")), lambda s: advanced(s, j))

    def advanced(s: Column, j: Column) -> Column:
        hp = s["vn"].bitwiseOR(F.bitwise_not(s["d"].bitwiseOR(s["vp"]))).bitwiseAND(full)
        hn = s["d"].bitwiseAND(s["vp"])
        x = F.shiftright(s["d"], 1)
        last = F.pow(F.lit(2), F.least(F.lit(2 * band), F.greatest(F.lit(0), m - j + band))).cast("int")  # the last row's bit
        score = s["score"] + F.when(j + band <= m, 1 - bit(s["d"].bitwiseAND(top) != 0)).otherwise(bit(hp.bitwiseAND(last) != 0) - bit(hn.bitwiseAND(last) != 0))
        return F.struct(hn.bitwiseOR(F.bitwise_not(x.bitwiseOR(hp))).bitwiseAND(full).alias("vp"), x.bitwiseAND(hp).alias("vn"), score.alias("score"))

    walked = F.aggregate(F.sequence(F.lit(1), n), start, step)["score"]
    return F.when(F.abs(m - n) > band, F.lit(band + 1)).when(n == 0, m).otherwise(walked)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def line_distance(a: Column, b: Column) -> Column:
    """``banded_distance`` of two lines on what lies between their common prefix and suffix."""

    def cut(s: Column) -> Column:
        return F.struct(F.reverse(s["a"].substr(s["prefix"] + 1, F.length(s["a"]))).alias("a"), F.reverse(s["b"].substr(s["prefix"] + 1, F.length(s["b"]))).alias("b"))

    def shared(s: Column, name: str) -> Column:
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), _common(s["a"], s["b"], F.least(F.length(s["a"]), F.length(s["b"]))).alias(name))

    def middle(s: Column) -> Column:
        return F.struct(*(_characters(s[c].substr(s["suffix"] + 1, F.length(s[c]))).alias(c) for c in ("a", "b")))

    behind = let(let(F.struct(a.alias("a"), b.alias("b")), lambda s: shared(s, "prefix")), cut)
    return let(let(let(behind, lambda s: shared(s, "suffix")), middle), lambda s: banded_distance(s["a"], s["b"]))


def verified(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, line_a, line_b) within the edits allowed."""
    shorter = F.least(F.length("line_a"), F.length("line_b"))
    return pairs.where(line_distance(F.col("line_a"), F.col("line_b")) <= allowed(shorter)).select("a", "b")


def parities(line: Column) -> Column:
    """One bit for each of 64 classes of letters: whether the line has an odd number of them.

    An edit changes the number of at most two letters, so it flips two bits at most.
    """
    bits = F.array(*(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)))
    return F.aggregate(_characters(line), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(F.element_at(bits, F.pmod(F.xxhash64(c), F.lit(64)).cast("int") + 1)))


def _refined(rows: DataFrame) -> DataFrame:
    """Entries of crowded keys (key, id, is_index, parity, line) under finer keys.

    An edit changes the number of at most two letters, so two edits touch at most four of the six
    classes letters are dealt to: near copies have equal letters in at least two classes.
    """

    def bag(letters: Column, k: int) -> Column:
        return F.xxhash64(F.array_sort(F.filter(letters, lambda c: F.pmod(F.xxhash64(c), F.lit(CLASSES)) == k)))

    def bags(letters: Column) -> Column:
        return F.array(*(bag(letters, k) for k in range(CLASSES)))

    def keys(of: Column) -> Column:
        return F.array(
            *(F.struct(F.xxhash64(F.col("key"), F.lit(1 << a | 1 << b), of[a], of[b]).alias("key"), F.lit(1 << a | 1 << b).alias("same"), of.alias("bags")) for a, b in combinations(range(CLASSES), 2))
        )

    entry = F.explode(let(let(_characters(F.col("line")), bags), keys)).alias("e")
    return rows.select(entry, "id", "is_index", "parity").select("e.key", "e.same", "e.bags", "id", "is_index", "parity").distinct()


def _first_meeting() -> Column:
    """Of the keys that two lines share, only that of their first two equal classes gives the pair."""
    equal = sum((F.when(F.col("bags")[k] == F.col("other_bags")[k], 1 << k).otherwise(0) for k in range(CLASSES)), F.lit(0))
    rest = equal.bitwiseAND(equal - 1)
    return (equal - rest) + rest.bitwiseAND(-rest) == F.col("same")


def _met(rows: DataFrame, refined: bool = False) -> DataFrame:
    """Pairs (a, b) of different ids under a key of which one is an index entry, as far as parities allow."""
    more = [F.col("bags").alias("other_bags")] if refined else []
    index = rows.where("is_index").select("key", F.col("id").alias("i"), F.col("parity").alias("p"), *more)
    close = F.bit_count(F.col("parity").bitwiseXOR(F.col("p"))) <= 2 * MAX_EDITS
    once = (F.col("i") != F.col("id")) & (~F.col("is_index") | (F.col("i") < F.col("id")))  # two index entries meet twice
    met = rows.join(index, "key").where(once & close)
    return (met.where(_first_meeting()) if refined else met).select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b"))


def near_pairs(lines: DataFrame) -> DataFrame:
    """(a, b) of all near copies among lines (id, line); ids name different lines."""
    of_key = Window.partitionBy("key")
    live = materialize(
        entries(lines).withColumn("low", F.min("id").over(of_key)).withColumn("high", F.max("id").over(of_key)).withColumn("indexed", F.max("is_index").over(of_key)).withColumn("n", F.count(F.lit(1)).over(of_key))
        .where("low <> high and indexed").select("key", "id", "is_index", "n"),
        "line_entries",
    )
    ids = live.select("id").distinct()
    few = ids.count() <= BROADCAST_ROWS
    texts = materialize(lines.join(F.broadcast(ids) if few else ids, "id", "left_semi").withColumn("parity", parities(F.col("line"))), "line_texts")
    loose = live.where(F.col("n") <= GROUP_ROWS).join(texts.select("id", "parity"), "id")
    crowded = live.where(F.col("n") > GROUP_ROWS).distinct().join(texts, "id")
    pairs = _met(loose).unionByName(_met(_refined(crowded), refined=True)).distinct()
    sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    return verified(sides)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, line) of each different line of each document that is not blank."""
    lines = F.filter(F.array_distinct(F.split(text_of(docs), "\n")), lambda x: x.rlike(NOT_BLANK))
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_hash(docs["text"]).alias("text_hash"), F.posexplode(lines).alias("at", "line"))


def verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, id, owner, exact, near, links) of each different line of each document.

    ``exact``: an earlier document has the line. ``near``: an earlier line anywhere is a near copy of it. Order is by
    id (null last), text hash and place. ``owner`` says that the line stays here unless ``near``;
    ``links`` counts the different lines that are near copies of it.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"), F.col("at"))
    lines = _lines(docs).withColumn("id", F.xxhash64("line"))
    check = F.xxhash64(F.lit(1), F.col("line"))
    classes = materialize(
        lines.groupBy("id").agg(F.min(first).alias("first"), F.first("line").alias("line"), F.min(check).alias("low"), F.max(check).alias("high"))
        # two lines of one hash are both left alone; two hashes of 64 bits tell that they are two
        .where("low = high").select("id", "first", "line"),
        "line_classes",
    )
    pairs = materialize(near_pairs(classes.select("id", "line")), "line_pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    firsts = classes.select("id", "first")
    linked = both.join(firsts.select(F.col("id").alias("a"), F.col("first").alias("own")), "a").join(firsts.select(F.col("id").alias("b"), F.col("first").alias("other")), "b")
    near = linked.groupBy(F.col("a").alias("id")).agg(F.max(F.col("other") < F.col("own")).alias("near"), F.count(F.lit(1)).alias("links"))
    judged = firsts.join(near, "id", "left")
    return lines.select("doc_id", "text_hash", "at", "id").join(judged, "id").select(
        "doc_id",
        "text_hash",
        "id",
        (F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))).alias("owner"),
        F.coalesce("near", F.lit(False)).alias("near"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_exact, n_near, n_links) of every row of ``docs``.

    Different lines that are not blank; those dropped as exact copies of an earlier document's line; those
    dropped as near copies of an earlier line; links to near copies. A null text is empty and has no lines,
    rows with equal id and text are one document and get equal results, a null id is kept and comes last in
    order, other columns are ignored, no rows give no rows.
    """
    counts = verdicts(docs).distinct().groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count(F.when(~F.col("owner"), 1)).alias("n_exact"), F.count(F.when(F.col("owner") & F.col("near"), 1)).alias("n_near"), F.sum("links").alias("n_links")
    )
    rows = docs.select(docs["doc_id"].cast("bigint").alias("_id"), text_hash(docs["text"]).alias("_hash"))
    joined = rows.join(counts, rows["_id"].eqNullSafe(counts["doc_id"]) & (rows["_hash"] == counts["text_hash"]), "left")
    return joined.select(F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_lines", "n_exact", "n_near", "n_links")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with every line kept once in all: at its first place, without near copies of earlier lines.

    Blank lines stay. A text that loses no line stays as it is, null included; a text may become empty.
    ``n_chars``, if there, follows the new text. Other columns stay as they are, whatever their names.
    """
    found = verdicts(docs)
    drops = found.where("near or not owner").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("id").alias("_drop"))
    repeated = docs.join(drops, docs["doc_id"].cast("bigint").eqNullSafe(drops["_id"]) & (text_hash(docs["text"]) == drops["_hash"]), "left")
    # a blank line gets its number in front, behind a line feed that no line has, so that it is not taken for a copy
    marked = F.array_distinct(F.transform(F.split(docs["text"], "\n"), lambda x, i: F.when(~x.rlike(NOT_BLANK), F.concat(F.lit("\n"), i.cast("string"), F.lit("\n"), x)).otherwise(x)))
    hashes = F.coalesce(drops["_drop"], F.array().cast("array<bigint>"))
    kept = F.filter(marked, lambda x: ~F.array_contains(hashes, F.xxhash64(x)))
    text = F.array_join(F.transform(kept, lambda x: F.when(x.startswith("\n"), F.substring_index(x, "\n", -1)).otherwise(x)), "\n")
    new = spare_name(docs, "_text")
    out = repeated.withColumn(new, text)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(new).alias("text"))
        elif c == "n_chars":
            columns.append(F.length(new).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(docs[c])
    return out.select(*columns)
