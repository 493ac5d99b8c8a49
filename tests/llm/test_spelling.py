from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from ledgerline.llm import spelling
from ledgerline.llm.queries import ORACLES, QUERIES
from tests.compare import connect

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    found, forms = {}, {}
    for w, n in words.items():
        close = sorted(((-words[v], v) for v in words if near(w, v)))
        best = close[0] if close and -close[0][0] >= 10 * n else (None, None)
        forms[w] = best[1]
        found[w] = (n, len(close), best[1], best[0] and -best[0])
    out = []
    for w, columns in found.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, *columns, root))
    return sorted(out)


def found(spark, rows, partitions=3):
    return sorted(map(tuple, spelling.variants(spark.createDataFrame(rows, SCHEMA).repartition(partitions)).collect()))


def texts(seed, alphabet, n_words, lengths):
    """Documents of few stems with copies that lost, gained or changed a letter."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices(alphabet, k=rng.choice(lengths))) for _ in range(n_words)]
    out = []
    for stem in stems:
        at = rng.randrange(len(stem))
        forms = [stem, stem[:at] + stem[at + 1 :], stem[:at] + rng.choice(alphabet) + stem[at:], stem[:at] + rng.choice(alphabet) + stem[at + 1 :], stem[:at] + stem[at] + stem[at:]]
        out += [w for w in forms for _ in range(rng.choice([1, 2, 3, 40]))]
    rng.shuffle(out)
    return [(i, rng.choice([" ", "\n", "1", "-"]).join(out[i * 50 : i * 50 + 50])) for i in range(len(out) // 50 + 1)]


def test_equals_plain_code(spark):
    rows = texts(1, "abéÉBn", 120, [6, 7, 8, 9, 12])
    assert found(spark, rows) == plain(rows)


def test_dense_words_of_two_letters(spark):
    """Runs of equal letters and words that are all near each other: no pair twice, none lost."""
    rows = texts(2, "ab", 80, [7, 8, 9])
    assert found(spark, rows) == plain(rows)


def test_long_words(spark):
    rows = texts(3, "abc", 12, [62, 63, 64, 65, 66, 200])
    assert found(spark, rows) == plain(rows)
    assert any(len(w) > 64 and n_near for w, _, n_near, *_ in plain(rows))


def test_hot_nodes_are_broadcast(spark):
    rows = texts(4, "abcd", 150, [7, 8])
    rows = [(i, re.sub("[a-d]{7,}", lambda m: "zzzz" + m[0], t)) for i, t in rows]
    assert found(spark, rows, 7) == plain(rows)


def test_forms_are_followed_to_the_last(spark):
    rows = [(i, "aaaaabc " * 2 + "aaaabbc " * 30 + "aaabbbc " * 400) for i in range(1)]
    by_word = {w: (form, root) for w, _, _, form, _, root in found(spark, rows)}
    assert by_word["aaaaabc"] == ("aaaabbc", "aaabbbc")
    assert found(spark, rows) == plain(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, "winterly winterly"), (None, None), (1, ""), (2, "summers"), (2, "summers"), (3, "Summerz " * 30_000), (4, "sümmers sümmers summer×s summer×s")]
    assert found(spark, rows) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "lettering lettering", "x", 4)]
    assert spelling.variants(spark.createDataFrame(rows, SCHEMA + ", word string, n int")).collect()[0].word == "lettering"



def test_query_equals_sql(spark, sf_dir):
    actual = QUERIES["op13_spelling_variants"](spark, sf_dir)
    checked = connect(sf_dir).execute(ORACLES["op13_spelling_variants"])
    assert [c[0] for c in checked.description] == actual.columns
    actual = list(map(tuple, actual.collect()))
    assert sorted(actual, key=str) == sorted(checked.fetchall(), key=str) and any(r[1] for r in actual)
