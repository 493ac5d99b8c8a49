"""Spelling variants by a frontier that walks a relational trie.

Words within one edit of each other are found without comparing words. The trie is a table of nodes
(``node`` is the prefix itself) with the steps of up to two letters that continue it. States (word,
position, node, one edit spent) are joined with it level by level: the edit is spent at a node of the
word's own path, then every further step must match the word. A state that has used up its word where
another word ends has found a neighbour.

An edit in the second half of a word is searched from its beginning, one in the first half from its end
in a second trie of reversed words. So the walk starts where the trie has branched out, each edit
position is tried in one direction only, and each pair is found once: a replacement from the word with
the smaller letter, an insertion from the longer word, with equal neighbouring letters counted once.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import attach, text_of
from ledgerline.session import materialize

MIN_LETTERS = 7
MIN_COUNT = 2
#: A form has at least this many times the occurrences of its variant.
RATIO = 10
#: One occurrence in this many loses a letter, which plants variants to be found.
DAMAGED = 31
#: Words up to this length walk the trie, whose prefixes grow with the square of a word's length.
TRIE_LETTERS = 64
#: Multiplier of the rolling hashes for longer words; odd, so that it can be undone modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
#: Step that stands for the end of a word at its node.
END = ""


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters of all texts with at least ``min_letters`` and ``min_count`` occurrences.

    A to Z are lower-cased. Where the crc32 of ``<doc_id>:<run>`` is divisible by ``DAMAGED`` the run loses
    the letter at that number modulo its length. A null text has no words, a null doc_id is empty.
    """
    runs = docs.select(
        F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(text_of(docs, text), F.lit(rf"[A-Za-zÀ-ÿ]{{{min_letters},}}"), F.lit(0))).alias("run"),
    )
    # occurrences of a run within a document share their damage
    runs = runs.select("doc", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    key = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (key % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(key % DAMAGED == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _substr(text: str | Column, start: Column, length: Column) -> Column:
    return F.substring(text, start.cast("int"), length.cast("int"))


def _both_ways(vocabulary: DataFrame) -> DataFrame:
    """Words as they are and reversed; ``letters`` is what the trie of that direction spells."""
    ways = F.explode(F.array(F.struct(F.lit(False).alias("reversed"), F.col("word").alias("letters")), F.struct(F.lit(True).alias("reversed"), F.reverse("word").alias("letters"))))
    return vocabulary.select("word", ways.alias("way")).select("word", "way.reversed", "way.letters", F.length("word").alias("size"))


def trie(ways: DataFrame) -> DataFrame:
    """(reversed, node, steps, n): prefixes with the steps below them and how many edits are spent there.

    A node's steps are pairs of letters, single letters where a word ends after one, and ``END`` where a
    word ends at the node; their number is bounded by the alphabet, not by the words.
    """
    # no walk passes a node above the first one at which an edit can be spent
    at = F.explode(F.sequence(F.lit(MIN_LETTERS // 2), "size"))
    nodes = ways.select("reversed", "letters", "size", at.alias("at"))
    spends = (F.col("at") >= _first_edit()) & (F.col("at") < F.col("size"))
    return (
        nodes.select("reversed", _substr("letters", F.lit(1), F.col("at")).alias("node"), _substr("letters", F.col("at") + 1, F.lit(2)).alias("step"), spends.cast("int").alias("spends"))
        .groupBy("reversed", "node")
        .agg(F.collect_set("step").alias("steps"), F.sum("spends").alias("n"))
    )


def _first_edit() -> Column:
    """Letters of the word that are passed before its first edit in this direction."""
    half = F.floor(F.col("size") / 2)
    return F.when(F.col("reversed"), F.col("size") - half).otherwise(half)


def _spend(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """States after the only edit and up to two more letters: reversed, letters, at, node, done."""
    own = ways.select("reversed", "letters", "size", F.explode(F.sequence(_first_edit().cast("int"), F.col("size") - 1)).alias("at"))
    own = own.select("reversed", "letters", "at", _substr("letters", F.lit(1), F.col("at")).alias("node"))
    met = attach(own, nodes.where("n > 0"), ["reversed", "node"])
    letter, after = _substr("letters", F.col("at") + 1, F.lit(1)), _substr("letters", F.col("at") + 2, F.lit(1))
    rest = _substr("letters", F.col("at") + 2, F.lit(2))
    met = met.withColumn("letter", letter).withColumn("after", after).withColumn("rest", rest)
    # a replaced letter and the one behind it
    replaced = F.filter("steps", lambda s: (F.substring(s, 2, 1) == F.col("after")) & (F.substring(s, 1, 1) > F.col("letter")))
    states = F.transform(replaced, lambda s: F.struct((F.col("at") + 2).alias("at"), s.alias("step"), (F.length(s) < 2).alias("done")))
    # a letter left out, of equal neighbours the one that comes last in the word, and the two behind it
    equal = F.when(F.col("reversed"), _substr("letters", F.col("at"), F.lit(1))).otherwise(F.col("after"))
    left_out = (F.col("letter") != equal) & F.array_contains("steps", F.col("rest"))
    deleted = F.struct((F.col("at") + 3).alias("at"), F.col("rest").alias("step"), (F.length("rest") < 2).alias("done"))
    found = F.explode(F.concat(states, F.when(left_out, F.array(deleted)).otherwise(F.array().cast("array<struct<at:int,step:string,done:boolean>>"))))
    return met.select("reversed", "letters", "node", found.alias("s")).select("reversed", "letters", "s.at", F.concat("node", "s.step").alias("node"), "s.done")


def _advance(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """States whose next two letters continue their node."""
    step = _substr("letters", F.col("at") + 1, F.lit(2))
    met = states.join(nodes.select("reversed", "node", "steps"), ["reversed", "node"]).withColumn("step", step).where("array_contains(steps, step)")
    return met.select("reversed", "letters", (F.col("at") + 2).alias("at"), F.concat("node", "step").alias("node"), (F.length("step") < 2).alias("done"))


def _trie_pairs(vocabulary: DataFrame) -> DataFrame:
    """Near words (a, b) of at most ``TRIE_LETTERS`` letters, each pair once."""
    ways = _both_ways(vocabulary.where(F.length("word") <= TRIE_LETTERS))
    nodes = materialize(trie(ways), "trie")
    frontier, found = materialize(_spend(ways, nodes), "frontier"), []
    while True:
        found.append(frontier.where("done"))
        states = frontier.where("not done")
        if states.isEmpty():
            break
        frontier = materialize(_advance(states, nodes), "frontier")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)

    def word(spelled: str) -> Column:
        return F.when(F.col("reversed"), F.reverse(spelled)).otherwise(F.col(spelled))

    return pairs.select(word("letters").alias("a"), word("node").alias("b"))


SIGNATURES = "word_id long, size int, at int, signature long, whole boolean"


def _signatures(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of every long word, and of what is left of it without its letter ``at``."""
    undo = np.uint64(pow(BASE, -1, 1 << 64))
    for frame in frames:
        for word_id, word in frame.itertuples(index=False):
            letters = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
            weights = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(letters) - 1, BASE, np.uint64)]))
            sums = np.cumsum(letters * weights)  # modulo 2 ** 64
            without = (sums - letters * weights) + (sums[-1] - sums) * undo
            size = len(letters)
            yield pd.DataFrame({
                "word_id": word_id, "size": np.int32(size), "at": np.concatenate([np.arange(size), [-1]]).astype(np.int32),
                "signature": np.concatenate([without, sums[-1:]]).view(np.int64), "whole": np.arange(size + 1) == size,
            })


def _long_pairs(vocabulary: DataFrame) -> DataFrame:
    """Near words (a, b) the longer of which has more than ``TRIE_LETTERS`` letters, each pair once.

    Words are equal but for one letter if they agree without the letter at the same place; a word is
    another one with a letter added if that one is what a place leaves over. Hashes that agree are
    verified, and the letter of equal neighbours that is left out is the last one.
    """
    words = materialize(vocabulary.where(F.length("word") >= TRIE_LETTERS).select(F.xxhash64("word").alias("word_id"), "word"), "long_words")
    marks = materialize(words.select("word_id", "word").mapInPandas(_signatures, SIGNATURES), "signatures")
    a, b = marks.alias("a"), marks.alias("b")
    same_place = (F.col("a.signature") == F.col("b.signature")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.size") == F.col("b.size"))
    replaced = a.where("not whole").join(b.where("not whole"), same_place).where("a.word_id < b.word_id")
    longer = (F.col("a.signature") == F.col("b.signature")) & (F.col("a.size") == F.col("b.size") + 1)
    added = a.where("not whole").join(b.where("whole"), longer)
    ids = replaced.select("a.word_id", F.col("b.word_id").alias("other_id")).unionByName(added.select("a.word_id", F.col("b.word_id").alias("other_id"))).distinct()
    named = ids.join(words.withColumnRenamed("word", "a"), "word_id").join(words.select(F.col("word_id").alias("other_id"), F.col("word").alias("b")), "other_id")
    longest = F.greatest(F.length("a"), F.length("b"))
    return named.where((longest > TRIE_LETTERS) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, b) of all words of ``vocabulary`` (word) that differ by one inserted, deleted or replaced letter.

    Every pair comes once, in either order. Words shorter than ``MIN_LETTERS`` or repeated ones are not
    expected; an empty vocabulary has no pairs.
    """
    return _trie_pairs(vocabulary).unionByName(_long_pairs(vocabulary))


def variants(docs: DataFrame) -> DataFrame:
    """Words of ``docs`` (doc_id, text) with their neighbours and forms: word, n, n_near, form, form_n, root.

    A word's form is its most frequent neighbour (of equally frequent ones the first in code-point
    order) if that has ``RATIO`` times its occurrences; its root is the last form that forms lead to,
    or itself. See ``words`` for what counts as a word and for nulls. Very long words and texts are
    whole; an empty table gives no rows; repeated rows count as often as they stand; other columns are
    ignored, whatever their names.
    """
    vocabulary = materialize(words(docs), "words")
    pairs = near_words(vocabulary)
    # one exchange by word serves the counts of the one side, a second one those of the other
    counted = pairs.join(vocabulary.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").join(vocabulary.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a")
    sides = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    ))
    best = counted.select(sides.alias("s")).groupBy("s.word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("s.near_n")).alias("order"), F.col("s.near").alias("near"))).alias("best"))
    has_form = -F.col("best.order") >= RATIO * F.col("n")
    found = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.order")).alias("form_n"),
    )
    return _with_root(materialize(found, "forms"))


def _with_root(found: DataFrame) -> DataFrame:
    """Follow forms to the last. Each has ``RATIO`` times the occurrences of the one before, so rounds are few."""
    forms = found.where("form is not null").select("word", "form")
    after = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        moved = roots.join(after, "root", "left")
        if moved.where("next is not null").isEmpty():
            return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
        roots = materialize(moved.select("word", F.coalesce("next", "root").alias("root")), "roots")
