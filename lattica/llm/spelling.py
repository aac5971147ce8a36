"""Spelling variants by forward and backward minimal acyclic automata.

Two words are near if one insertion, deletion or replacement of a code point makes one of the
other. Of the shorter one, of length L, the first L // 2 code points then start the other, or
the rest ends it. So the dictionary is dealt by such halves, forward and backward, with words of
length L and L + 1 together: all that can be near a word by its error in the other half is in
one group. Groups are hashed to bins of about ``BIN_WORDS`` words, and a bin is a task.

A task builds the minimal acyclic automaton of a bin's words (reversed ones for the backward
direction), state by state from the sorted list. Each arc has the number of words that come
before those behind it, so the sum along a path is the word's number: a perfect hash without
gaps. A query walks the exact half, then completes the word with one replacement or one
insertion, and gets numbers, not strings. Pairs found from both directions are dropped once.

A half that more than ``HOT_WORDS`` words share is split into chunks by a hash: each chunk has
an automaton of its own, and the half's queries go to all of them.

``variants`` picks a word's form: of its near words the one of largest count, if that is at least
``ratio`` times its own. Counts grow along forms, so chains end; roots come from pointer
doubling, as many rounds as the logarithm of the longest chain.

Defined cases: null and empty texts have no words; repeated rows count again; an empty table
gives an empty result; a word without near ones has n_near 0, no form and itself as root.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Maximal runs of these are words; A-Z are lower-cased before.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a bin, and of a half before it is split; distinct words that a task counts before it passes them on.
BIN_WORDS, HOT_WORDS, HELD_WORDS = 40_000, 20_000, 200_000


def words_of(text: bytes, key: str, least: int, every: int) -> list[str]:
    """Words of at least so many code points; where ``every`` divides the hash of key and word, a code point goes."""
    start, crc, found = zlib.crc32(f"{key}:".encode()), zlib.crc32, []
    for w in RUN.findall(text.lower().decode()):  # lower() of bytes: ASCII letters only
        if len(w) >= least:
            if every and not (h := crc(w.encode(), start)) % every:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
                if len(w) < least:
                    continue
            found.append(w)
    return found


def count_words(docs: DataFrame, *, least: int = 7, occurrences: int = 2, every: int = 0) -> DataFrame:
    """word and n, for words that occur often enough; counted in each task before they are exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                if t.is_valid:
                    held.update(words_of(t.as_buffer().to_pybytes(), "" if k is None else k, least, every))
                if len(held) >= HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, with word numbers.

    A state is its arcs, (letter, state, words before), and whether a word ends there.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        # the path of the last word: states that may still get arcs
        path: list[list] = [[False, {}]]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._settle(path, last, same)
            for letter in word[same:]:
                path[-1][1][letter] = None
                path.append([False, {}])
            path[-1][0] = True
            last = word
        self._settle(path, last, 0)
        self.start = self._state(path[0])
        del self._known

    def _settle(self, path: list[list], word: str, depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(path.pop())
            path[-1][1][word[len(path) - 1]] = state

    def _state(self, node: list) -> int:
        final, arcs = node
        key = (final, *arcs.items())
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            before, numbered = int(final), {}
            for letter, to in arcs.items():
                numbered[letter] = (to, before)
                before += self.size[to]
            self.arcs.append(numbered)
            self.final.append(final)
            self.size.append(before)
        return found

    def walk(self, word: str, state: int, number: int) -> tuple[int, int] | None:
        """State and number after the letters, or None."""
        arcs = self.arcs
        for letter in word:
            arc = arcs[state].get(letter)
            if arc is None:
                return None
            state, number = arc[0], number + arc[1]
        return state, number

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of words that start with ``word[:exact]`` and are ``word`` after one replacement or insertion."""
        found: set[int] = set()
        at = self.walk(word[:exact], self.start, 0)
        for i in range(exact, len(word) + 1):
            if at is None:
                break
            state, number = at
            for letter, (to, before) in self.arcs[state].items():
                for rest in (word[i + 1 :], word[i:]) if i < len(word) and letter != word[i] else (word[i:],):
                    end = self.walk(rest, to, number + before)
                    if end and self.final[end[0]]:
                        found.add(end[1])
            at = self.walk(word[i : i + 1], state, number) if i < len(word) else None
        return found


def _near(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs (word, near) of a bin: the word has the length that its half is of, near that length or one more."""
    backward = bool(rows["backward"].iloc[0])
    turned = (lambda w: w[::-1]) if backward else (lambda w: w)
    held = rows["chunk"] == rows["own"]  # other rows are queries only
    words = sorted({turned(w) for w in rows.loc[held, "word"]})
    automaton = Automaton(words)
    pairs = []
    for word, length in rows.loc[rows["word"].str.len() == rows["length"], ["word", "length"]].drop_duplicates().itertuples(index=False):
        half = length - length // 2 if backward else length // 2
        pairs += [(word, turned(words[i])) for i in automaton.one_error(turned(word), half)]
    return pd.DataFrame(pairs, columns=["word", "near"])


def near_words(words: DataFrame, *, least: int = 7) -> DataFrame:
    """word and near, each pair once in either order. words: distinct ``word`` of at least ``least`` code points, written."""
    n = F.length("word")
    sides = F.array(*[F.struct(F.lit(back).alias("backward"), (n - less).cast("int").alias("length")) for back in (False, True) for less in (0, 1)])
    rows = words.select("word", F.inline(sides)).where(F.col("length") >= least)
    half = F.floor(F.col("length") / 2).cast("int")
    # a longer word's half is that of the shorter word's length, from the same end
    rows = rows.withColumn("half", F.when(F.col("backward"), F.expr("right(word, length - length div 2)")).otherwise(F.substring("word", F.lit(1), half)))
    key = ["backward", "length", "half"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > HOT_WORDS)
    hot = materialise(counts.select(*key, F.ceil(F.col("m") / HOT_WORDS).cast("int").alias("chunks")), "hot")
    rows = rows.join(hot, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    query = F.sequence(F.lit(0), F.col("chunks") - 1)
    rows = rows.withColumn("chunk", F.explode(F.when(n == F.col("length"), query).otherwise(F.array("own"))))
    bins = max(1, math.ceil(4 * words.count() / BIN_WORDS))
    task = F.when(F.col("chunks") > 1, F.xxhash64(*key, "chunk")).otherwise(F.pmod(F.xxhash64(*key), F.lit(bins)))
    rows = rows.select(task.alias("task"), F.col("chunks") > 1, "backward", "length", "word", "own", "chunk").toDF("task", "hot", "backward", "length", "word", "own", "chunk")
    found = rows.groupBy("hot", "backward", "task").applyInPandas(_near, "word string, near string")
    both = F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))
    return found.select(F.inline(both)).distinct()


def variants(words: DataFrame, *, ratio: int = 10, least: int = 7) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word (``word``, ``n``)."""
    words = materialise(words.select("word", "n"), "words")
    pairs = near_words(words, least=least).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    one = words.join(best, "word", "left").withColumn("most", -F.col("best.m"))
    formed = F.col("most") >= ratio * F.col("n")
    one = materialise(one.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, F.col("most")).alias("form_n")), "forms")
    up = materialise(one.where("form is not null").select("word", F.col("form").alias("root")), "up")
    while True:
        next_ = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        longer = materialise(up.join(next_, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "up")
        up = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return one.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
