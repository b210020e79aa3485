"""Pairs of words that are one edit apart, by composing automata, and the groups of spellings they make.

The vocabulary is an acceptor A, minimal and without cycles. A one-edit transducer E passes letters on and replaces, inserts
or deletes one of them once; A o E o A accepts just the pairs wanted. Before the edit both sides are in one state of A, so
the composition is: a path from the initial state, a state where the edit is made, and a string that the two states behind
the edit both accept. The edit is made where the words first differ, so that a pair is accepted once.

The vocabulary does not fit one task. It is cut by initial states: all words that share a prefix have the state behind it as
theirs, and one task builds the acceptor of the words behind it and enumerates the pairs that differ later. An initial state
with too many words is replaced by its successors; the edits at that state itself are then taken by the shuffle: words meet
under the string that is left without the letter at this place, of which each has as many as the alphabet has letters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import saved

#: An initial state with more words, or more code points in them, is replaced by its successors.
MOST_WORDS, MOST_CHARS = 20_000, 2_000_000
#: Up to so many crowded initial states are broadcast; there is one for each MOST_WORDS words at most.
BROADCAST_STATES = 100_000


class Acceptor:
    """The minimal acyclic acceptor of sorted, distinct words; state 0 is initial."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        known: dict[tuple, int] = {}
        open_arcs: list[tuple[int, str]] = []  # the last word's states that may still get arcs, by the arc into each

        def close(length: int) -> None:
            while len(open_arcs) > length:
                at, letter = open_arcs.pop()
                state = self.arcs[at][letter]
                form = (self.final[state], *self.arcs[state].items())
                self.arcs[at][letter] = known.setdefault(form, state)

        last = ""
        for word in words:
            shared = len(commonprefix((last, word)))
            close(shared)
            at = self.arcs[open_arcs[-1][0]][open_arcs[-1][1]] if open_arcs else 0
            for letter in word[shared:]:
                self.arcs[at][letter] = len(self.arcs)
                open_arcs.append((at, letter))
                at = len(self.arcs)
                self.arcs.append({})
                self.final.append(False)
            self.final[at] = True
            last = word
        close(0)

    def both(self, a: int, b: int, not_first: str = "") -> Iterator[str]:
        """The strings that are accepted from both states, without those that begin with not_first."""
        first, todo = True, [(a, b, "")]
        while todo:
            a, b, head = todo.pop()
            run: list[str] = []
            while True:
                if self.final[a] and self.final[b]:
                    yield head + "".join(run)
                of_a, of_b = self.arcs[a], self.arcs[b]
                if len(of_a) > len(of_b):
                    of_a, of_b = of_b, of_a
                shared = [x for x in of_a if x in of_b and not (first and x == not_first)]
                first = False
                if len(shared) != 1:
                    break
                run.append(shared[0])  # without a fork, no string is copied
                a, b = of_a[shared[0]], of_b[shared[0]]
            head += "".join(run)
            todo += [(of_a[x], of_b[x], head + x) for x in shared]

    def edits(self, state: int) -> list[tuple[str, str]]:
        """What can follow on either side when the edit is made at a state: a letter replaced, or one more on the right side.
        The letter after an inserted one differs from it, or the words would first differ later."""
        arcs = sorted(self.arcs[state].items())
        out = [(a + s, b + s) for i, (a, x) in enumerate(arcs) for b, y in arcs[i + 1 :] for s in self.both(x, y)]
        if len(arcs) > 1 or self.final[state]:
            out += [(s, b + s) for b, y in arcs for s in self.both(state, y, b)]
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Every pair of words that are one edit apart, once."""
        states = self.states()
        edits = {q: e for q in states if (e := self.edits(q))}
        into: dict[int, list[int]] = {}
        for q in states:
            for x in self.arcs[q].values():
                into.setdefault(x, []).append(q)
        live, todo = set(edits), list(edits)
        while todo:
            for q in into.get(todo.pop(), ()):
                if q not in live:
                    live.add(q)
                    todo.append(q)
        paths = [(0, "")] if 0 in live else []
        while paths:
            q, head = paths.pop()
            run: list[str] = []
            while True:
                if q in edits:
                    head, run = head + "".join(run), []
                    yield from ((head + x, head + y) for x, y in edits[q])
                on = [(x, y) for x, y in self.arcs[q].items() if y in live]
                if len(on) != 1:
                    break
                run.append(on[0][0])
                q = on[0][1]
            head += "".join(run)
            paths += [(y, head + x) for x, y in on]

    def states(self) -> list[int]:
        """Those that can be reached; states that were merged into others can't."""
        seen, todo = {0}, [0]
        while todo:
            new = [x for x in self.arcs[todo.pop()].values() if x not in seen]
            seen.update(new)
            todo += new
        return list(seen)


@F.pandas_udf(IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(commonprefix((x, y))) for x, y in zip(a, b, strict=True)], dtype="int32")


def _enumerate(rows: pa.Table) -> pa.Table:
    """Both directions of each pair of one initial state's words that differ behind the prefix they share."""
    n = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
    words = sorted(n)
    prefix = commonprefix((words[0], words[-1]))
    found = list(Acceptor([w[len(prefix) :] for w in words]).pairs()) if len(words) > 1 else []
    found = [(prefix + a, prefix + b) for a, b in found]
    found += [(b, a) for a, b in found]
    return pa.table({"word": pa.array([a for a, _ in found], pa.string()), "near": pa.array([b for _, b in found], pa.string()), "near_n": pa.array([n[b] for _, b in found], pa.int64())})


def _edits_here(d: DataFrame) -> DataFrame:
    """word, near, near_n of the pairs of rows (word, n, at) that share the first `at` code points and differ at the next."""
    a, rest = F.col("at"), F.substring("word", F.col("at") + 2, F.length("word"))
    cut = d.where(F.length("word") > a).select("at", F.concat(F.substring("word", F.lit(1), a), rest).alias("left"), F.substring("word", a + 1, F.lit(1)).alias("letter"), "word", "n")
    own = d.select("at", F.col("word").alias("left"), F.lit("").alias("letter"), "word", "n")
    g = cut.unionByName(own).groupBy("at", "left").agg(F.collect_list(F.struct("letter", "word", "n")).alias("m")).where(F.size("m") > 1)
    p = g.select("at", "left", "m", F.explode("m").alias("x")).select("at", "left", "x", F.explode("m").alias("y"))
    letter, other, follows = F.col("x.letter"), F.col("y.letter"), F.substring("left", F.col("at") + 1, F.lit(1))
    inserted = F.concat(letter, other)  # where one of the two is the word without a letter here
    p = p.where((letter != other) & (((letter != "") & (other != "")) | (inserted != follows)))
    return p.select(F.col("x.word").alias("word"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))


def near_pairs(words: DataFrame, most_words: int = MOST_WORDS, most_chars: int = MOST_CHARS) -> DataFrame:
    """word, near, near_n: every ordered pair of the distinct words (word, n) that are exactly one inserted, deleted or
    replaced code point apart. Empty and very long words take part like all others; a null word has no pairs."""
    rows = saved(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"), F.lit(0).alias("depth")))
    settled, out = [], []
    while True:
        keyed = rows.withColumn("key", F.substring("word", F.lit(1), F.col("depth")))
        size = keyed.groupBy("depth", "key").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("word")).alias("_c"), F.min("word").alias("_a"), F.max("word").alias("_z"))
        crowded = saved(size.where((F.col("_n") > 1) & ((F.col("_n") > most_words) | (F.col("_c") > most_chars))).select("depth", "key", _shared("_a", "_z").alias("at")))
        states = crowded.limit(BROADCAST_STATES + 1).count()
        if not states:
            settled.append(keyed)
            break
        marked = keyed.join(F.broadcast(crowded) if states <= BROADCAST_STATES else crowded, ["depth", "key"], "left")
        settled.append(marked.where("at IS NULL").drop("at"))
        moved = marked.where("at IS NOT NULL")
        out.append(_edits_here(moved.select("word", "n", "at")))
        rows = saved(moved.select("word", "n", (F.col("at") + 1).alias("depth")))
    whole = settled[0]
    for s in settled[1:]:
        whole = whole.unionByName(s)
    pairs = whole.groupBy("depth", "key").applyInArrow(_enumerate, "word string, near string, near_n long")
    for p in out:
        pairs = pairs.unionByName(p)
    return pairs


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each distinct word (word, n).

    n_near: words one edit away. form: the most frequent of them (ties: the smallest in code-point order), if it is at least
    `ratio` (above 1) times as frequent, else null; root: where forms lead in the end, the word itself if it has none. An
    empty table gives an empty one; a null word has no form, and null as its root.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, so that forms lead to an end")
    words = saved(words.select("word", F.col("n").cast("long").alias("n")))
    first = F.struct(-F.col("near_n"), F.col("near"))
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min_by("near", first).alias("form"), F.max("near_n").alias("form_n"))
    d = words.join(best, "word", "left")
    enough = F.col("form_n") >= ratio * F.col("n")
    d = saved(d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")))
    most = d.agg(F.max("n")).first()[0] or 1
    roots = d.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(math.log(max(most, 2), ratio) + 1))):  # each form is ratio times as frequent; each join doubles the steps taken
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return d.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_counts(runs: DataFrame, least_length: int, least_n: int) -> DataFrame:
    """word, n of the words with enough code points and occurrences; counted before they move, whatever word is frequent."""
    d = runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return d.where(F.col("n") >= least_n)
