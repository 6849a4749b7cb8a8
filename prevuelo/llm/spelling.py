"""Spelling variants by a frequency-vector trie.

A word's vector counts its letters by letter group; the words of a corpus are arranged in a trie of these counts, one
level a group. One inserted, deleted or replaced letter raises at most one count by one and lowers at most one by one, so
the words near a given one are found by a depth-first search that may spend one surplus and one deficit; the words of the
leaves that it reaches are then compared letter by letter. Every pair is searched for from one side only, the word whose
vector comes first (or, of equal vectors, the word itself), so the first change on the way down is always the surplus.

On Spark the upper levels are keys: a word lies in the cell of its first counts and asks in the at most 1 + d + d(d-1)/2
cells that it can reach there, d being the number of levels. A cell with more than ``MOST`` rows is divided by further
levels, as often as it takes; one that all levels leave too large (letters in another order are another word) is dealt
out in parts, each pair of parts once. So a task walks below one cell of bounded size, whatever the vocabulary.

A null text has no words and a null id is hashed as no digits. Repeated rows count each time. Empty tables, and words
without a near one, have counts of 0 and themselves as root. Extra columns are not read. Words of any length are whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prevuelo.llm.store import prepare, written

#: Letters that make a word, and what is lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Levels of the trie: two letters of the alphabet a group, and three groups of all others.
LEVELS = 16

#: Levels that are keys at first, how many are added to a cell that is too large, and the rows of a cell.
FIRST, MORE, MOST = 5, 3, 20_000

#: A node of fewer pairs is compared in one step.
_SMALL = 4_096


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 5, one_in: int = 199) -> DataFrame:
    """(word, n): runs of letters in lower case, of ``least`` letters and ``times`` occurrences in all documents.

    Where the crc32 of ``<doc_id>:<run>`` is a multiple of ``one_in``, the run has lost the letter at that hash modulo
    its length; 0 leaves all runs as they are.
    """
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"),
    )
    word = F.col("run")
    if one_in:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(h % one_in == 0, shorter).otherwise(word)
    found = runs.select(word.alias("word")).where(F.length("word") >= least)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def group(letter: str) -> int:
    place = ord(letter) - 97
    return place // 2 if 0 <= place < 26 else 13 + ord(letter) % 3


_GROUPS = {c: group(c) for c in map(chr, range(256))}


def vector(word: str) -> list[int]:
    counts = [0] * LEVELS
    for c in word:
        counts[_GROUPS[c] if c in _GROUPS else group(c)] += 1
    return counts


def reachable(counts: list[int], start: int, surplus: bool, deficit: bool) -> Iterator[list[int]]:
    """What the counts from level ``start`` on can be in a word that is asked for, given what has been spent above."""
    tail = counts[start:]
    yield list(tail)
    for i in range(len(tail) if not surplus else 0):
        raised = [*tail[:i], tail[i] + 1, *tail[i + 1 :]]
        yield raised
        for j in range(i + 1, len(tail)):
            if tail[j]:
                yield [*raised[:j], tail[j] - 1, *raised[j + 1 :]]
    for j in range(len(tail) if surplus and not deficit else 0):
        if tail[j]:
            yield [*tail[:j], tail[j] - 1, *tail[j + 1 :]]


def _key(counts: list[int]) -> str:
    return ",".join(map(str, counts))


def _counts(key: str) -> list[int]:
    return list(map(int, key.split(","))) if key else []


_ROUTED = "cell string, asks boolean, word string, n long"


def _route(rows: DataFrame, depth: int) -> DataFrame:
    """The rows (cell, asks, word, n) in the cells of ``depth`` levels below theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for cell, asks, word, n in zip(*(c.to_pylist() for c in b.columns)):
                counts, above = vector(word), _counts(cell)
                at = len(above)
                if not asks:
                    out.append((_key(counts[:depth]), False, word, n))
                    continue
                spent = [a - c for a, c in zip(above, counts)]
                for tail in reachable(counts[:depth], at, 1 in spent, -1 in spent):
                    out.append((_key(above + tail), True, word, n))
            columns = list(zip(*out)) or [()] * 4
            kinds = [pa.string(), pa.bool_(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["cell", "asks", "word", "n"])

    return rows.select("cell", "asks", "word", "n").mapInArrow(run, _ROUTED)


def one_apart(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced letter; equal words are not."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _verified(asked: list[str], lying: list[str]) -> Iterator[tuple[int, int]]:
    """Places of the pairs that are one letter apart, from two lists of one leaf, in time linear in their letters.

    Replaced letters: both without the same place are equal. Inserted ones: one without a place is the other.
    """
    without = defaultdict(list)
    for j, word in enumerate(lying):
        for i in range(len(word)):
            without[word[:i] + word[i + 1 :]].append((j, i))
    for k, word in enumerate(asked):
        found = {j for j, _ in without.get(word, ())}
        for i in range(len(word)):
            found |= {j for j, place in without.get(word[:i] + word[i + 1 :], ()) if place == i and lying[j] != word}
        yield from ((k, j) for j in found)


def search(asked: list[str], lying: list[str], level: int = 0) -> Iterator[tuple[int, int]]:
    """Places (in ``asked``, in ``lying``) of all pairs one letter apart, each searched for from its first side.

    The vectors may differ above ``level`` by what has been spent there.
    """
    if not asked or not lying:
        return
    q, t = np.array([vector(w) for w in asked], np.int32), np.array([vector(w) for w in lying], np.int32)
    above = t[:1, :level] - q[:, :level]  # all that lie here have the same counts above
    surplus, deficit = (above > 0).any(1), (above < 0).any(1)
    stack = [(level, np.arange(len(q)), surplus, deficit, np.arange(len(t)))]
    while stack:
        at, qs, plus, minus, ts = stack.pop()
        if at == LEVELS or len(qs) * len(ts) <= _SMALL:
            yield from _leaf(asked, lying, q, t, at, qs, plus, minus, ts)
            continue
        counts = t[ts, at]
        for count in np.unique(counts):
            change = count - q[qs, at]
            same = change == 0
            up, down = (change == 1) & ~plus, (change == -1) & plus & ~minus
            kept = same | up | down
            if kept.any():
                stack.append((at + 1, qs[kept], (plus | up)[kept], (minus | down)[kept], ts[counts == count]))


def _leaf(asked, lying, q, t, at, qs, plus, minus, ts) -> Iterator[tuple[int, int]]:
    if len(qs) * len(ts) > _SMALL:  # all levels are used up: many words of the same letters
        for a, b in _verified([asked[i] for i in qs], [lying[j] for j in ts]):
            if plus[a] or asked[qs[a]] < lying[ts[b]]:
                yield int(qs[a]), int(ts[b])
        return
    change = t[ts][None, :, at:] - q[qs][:, None, at:]
    raised = (change > 0) * change
    first = np.cumsum(change != 0, axis=2) == 1
    starts_up = ~((change < 0) & first).any(2) | plus[:, None]
    fits = (raised.sum(2) + plus[:, None] <= 1) & ((raised - change).sum(2) + minus[:, None] <= 1) & starts_up
    equal = ~plus[:, None] & ~(change != 0).any(2)
    for a, b in zip(*np.nonzero(fits)):
        x, y = asked[qs[a]], lying[ts[b]]
        if (not equal[a, b] or x < y) and one_apart(x, y):
            yield int(qs[a]), int(ts[b])


def _walk(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(word, n, near, near_n) of the pairs of each cell; no cell has more rows than a task can hold."""

    def run(table: pa.Table) -> pa.Table:
        asks = np.array(table["asks"].to_pylist(), bool)
        found, n = table["word"].to_pylist(), table["n"].to_pylist()
        mine, theirs = np.flatnonzero(asks).tolist(), np.flatnonzero(~asks).tolist()
        level = len(_counts(table["cell"][0].as_py()))
        pairs = search([found[i] for i in mine], [found[j] for j in theirs], level)
        rows = [(found[i], n[i], found[j], n[j]) for i, j in ((mine[a], theirs[b]) for a, b in pairs)]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "n", "near", "near_n"])

    return rows.groupBy(*keys).applyInArrow(run, "word string, n long, near string, near_n long")


def near_pairs(vocabulary: DataFrame, most: int = MOST, first: int = FIRST) -> DataFrame:
    """(word, n, near, near_n): each pair of different words (word, n) that are one letter apart, once."""
    prepare(vocabulary.sparkSession)
    both = F.explode(F.array(F.lit(False), F.lit(True)))
    rows = vocabulary.select(F.lit("").alias("cell"), both.alias("asks"), "word", "n")
    depth, done = min(first, LEVELS), []
    while True:
        routed = written(_route(rows, depth), "cells")
        sizes = routed.groupBy("cell").agg(F.count_if(~F.col("asks")).alias("lying"), F.count_if("asks").alias("asking"))
        sizes = sizes.where("lying > 0 AND asking > 0")
        large = sizes.where(F.col("lying") + F.col("asking") > most)
        fitting = routed.join(sizes.where(F.col("lying") + F.col("asking") <= most).select("cell"), "cell")
        done.append(_walk(fitting, ["cell"]))
        if large.isEmpty():
            break
        rows = routed.join(large, "cell")
        if depth == LEVELS:
            parts = {k: F.ceil(F.col(k) * 2 / most).cast("int") for k in ("lying", "asking")}
            own, other = F.when(F.col("asks"), parts["asking"]).otherwise(parts["lying"]), F.when(F.col("asks"), parts["lying"]).otherwise(parts["asking"])
            dealt = rows.withColumn("own", F.pmod(F.xxhash64("word"), own)).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
            dealt = dealt.withColumn("x", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other")))
            dealt = dealt.withColumn("y", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")))
            done.append(_walk(dealt, ["cell", "x", "y"]))
            break
        depth = min(depth + MORE, LEVELS)
    return reduce(DataFrame.unionByName, done)


def forms(vocabulary: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    ends = [F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(f"{b}_n" if b == "near" else "n").alias("near_n")) for a, b in (("word", "near"), ("near", "word"))]
    ways = pairs.select(F.inline(F.array(*ends)))
    best = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = vocabulary.join(best, "word", "left")
    is_form = -F.col("best.less") >= F.col("n") * ratio
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    known = written(known, "forms")
    # counts grow by ``ratio`` with each step, which bounds the steps (to 14 at 10^10 words); each round doubles what is followed
    links = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    top = known.where("form IS NOT NULL").agg(F.max("form_n"), F.min("n")).first()
    steps = math.ceil(math.log(top[0] / top[1], ratio)) + 1 if top[0] and ratio > 1 else 1
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return known.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12(docs: DataFrame) -> DataFrame:
    vocabulary = written(words(docs), "words")
    found = forms(vocabulary, near_pairs(vocabulary))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
