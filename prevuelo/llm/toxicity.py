"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers are composed into one machine over the symbols of a clause. A lexical transducer turns words into
symbols: insult (with a weight), threat, target, negation, reported speech. The other four keep a few tokens of memory:
a target near an insult or after a threat raises the weight, a negation just before lowers it, a verb of speaking or an
opening quote earlier in the clause lowers it. A clause scores the sum of its weighted matches; a document's features
are sums over clauses, and a logistic curve gives the score.

The insult lexicon is a short list plus words and word beginnings learned from labelled rows by their log-odds, so that
it follows the corpus and its languages. Everything learned comes from a sample of at most ``PER_CLASS`` labelled rows of
each class, in hash order; the score itself reads whole texts of all rows.

Null texts count as empty and get the score of a text without matches. Rows may repeat and stay rows. Extra columns are
not read. Without labelled rows of both classes the listed words and the fixed curve ``PRIOR`` hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prevuelo.llm.samples import crc, labelled, texts_of
from prevuelo.llm.store import free, prepare

#: Labelled rows of each class that may be used for fitting.
PER_CLASS = 10_000
#: Learned words and beginnings kept, best first; longest beginning.
MAX_UNITS, MAX_BEGINNING = 3_000, 7
#: Units that a worker counts before it sends them on.
COUNTED = 100_000
#: A learned unit needs this log-odds ratio, so many standard errors of it, and this many toxic rows.
MIN_WEIGHT, MIN_ERRORS, MIN_ROWS = 2.0, 3.2, 4

# A few plain words of each symbol in four languages.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
LISTED = {
    INSULT: "idiot moron scum loser worthless trash pathetic disgusting stupid clown imbecile idiota imbécil estúpido basura "
    "idiote imbécile stupide ordure crétin abschaum versager wertlos dumm trottel",
    THREAT: "kill hurt destroy crush beat burn matar destruir golpear tuer frapper détruire töten schlagen vernichten",
    TARGET: "you your yours tu vous toi votre usted ustedes du dich dir euch",
    NEGATION: "not never no isn't aren't nicht kein keine nie pas jamais nunca jamás",
    REPORT: "said says claimed quoted dijo dice dit selon sagte sagt laut",
}
BASE_WEIGHT = 5.0
#: Tokens that a negation, a target and a threat stay in force; factors and bonus of the weights.
REACH = {NEGATION: 2, TARGET: 3, THREAT: 3}
NEGATED, REPORTED, AIMED, THREATENING = 0.4, 0.6, 1.25, 6.0
#: Curve without labelled rows: intercept and one factor per feature.
PRIOR = np.array([-4.0, 0.0, 0.3, 2.0, 1.0])

_CLAUSE_END = re.compile(r"[.!?;\n]")
#: What opens a quotation: the quotes that only open, and a straight one behind a blank or at the beginning.
_OPENING = re.compile(r"[\u201c\u201e\u00ab\u2018]|(?:^|(?<=[\s(:,]))[\"']", re.MULTILINE)
_WORD = re.compile(r"[^\W\d_]+")

State = tuple[int, int, int, bool]


def _countdown(symbol: int):
    """Transducer that remembers ``symbol`` for its reach."""
    return lambda left, seen: REACH[symbol] if seen == symbol else max(0, left - 1)


_NEGATION, _TARGET, _THREAT = (_countdown(s) for s in (NEGATION, TARGET, THREAT))


def compose() -> dict[tuple[State, int], tuple[State, float, float]]:
    """(state, symbol) -> (next state, factor on the symbol's weight, added weight) of the composed machine."""
    table = {}
    states = product(range(REACH[NEGATION] + 1), range(REACH[TARGET] + 1), range(REACH[THREAT] + 1), (False, True))
    for state, symbol in product(states, range(6)):
        negated, aimed, threat, reported = state
        factor, added = 0.0, 0.0
        damp = (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
        if symbol == INSULT:
            factor = damp * (AIMED if aimed else 1.0)
        elif symbol == TARGET and threat:
            added = THREATENING * damp
        after = _NEGATION(negated, symbol), _TARGET(aimed, symbol), _THREAT(threat, symbol), reported or symbol == REPORT
        table[state, symbol] = (after, factor, added)
    return table


START: State = (0, 0, 0, False)
_TABLE = compose()


#: An opening quote has the effect of a verb of speaking, and takes no place.
_QUOTED = {state: (*state[:3], True) for state, _ in _TABLE}


@dataclass(frozen=True)
class Model:
    """Learned units (word or beginning, True for a beginning, weight) and the logistic curve."""

    units: tuple[tuple[str, bool, float], ...]
    curve: tuple[float, ...]


@lru_cache(maxsize=4)
def lexicon(units: tuple[tuple[str, bool, float], ...]) -> ahocorasick.Automaton:
    """Automaton of the lexical transducer: each key carries (length, symbol, weight, needs a word end)."""
    entries: dict[str, list] = {}
    for symbol, words in LISTED.items():
        for w in words.split():
            entries.setdefault(w, []).append((len(w), symbol, BASE_WEIGHT, True))
    for unit, beginning, weight in units:
        entries.setdefault(unit, []).append((len(unit), INSULT, weight, not beginning))
    found = ahocorasick.Automaton()
    for key, values in entries.items():
        found.add_word(key, values)
    found.make_automaton()
    return found


def symbols(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int, float]]:
    """(start, end, symbol, weight) of words with a symbol; of several readings of a word the heaviest insult."""
    best: dict[int, tuple[int, int, float]] = {}
    n = len(text)
    for last, values in automaton.iter(text):
        end = last + 1
        ended = end == n or not text[end].isalpha()
        for size, symbol, weight, whole in values:
            start = end - size
            if (whole and not ended) or (start and text[start - 1].isalpha()):
                continue
            old = best.get(start)
            if old is None or (symbol == INSULT and (old[1] != INSULT or weight > old[2])):
                best[start] = (end, symbol, weight)
    return [(s, *best[s]) for s in sorted(best)]


def features(text: str | None, automaton: ahocorasick.Automaton) -> np.ndarray:
    """1, log of the summed score, best clause, score per square root and per hundred words."""
    text = (text or "").lower()
    state, at, clause, best, total = START, 0, 0.0, 0.0, 0.0
    for start, end, symbol, weight in symbols(text, automaton):
        ended = None
        for ended in _CLAUSE_END.finditer(text, at, start):
            pass
        if ended:
            best, state, clause, at = max(best, clause), START, 0.0, ended.end()
        else:
            for _ in range(min(4, max(0, text.count(" ", at, start) - 1))):
                state = _TABLE[state, OTHER][0]
        if _OPENING.search(text, at, start):
            state = _QUOTED[state]
        state, factor, added = _TABLE[state, symbol]
        gain = factor * weight + added
        clause += gain
        total += gain
        at = end
    words = text.count(" ") + 1
    return np.array([1.0, math.log1p(total), min(max(best, clause), 30.0) / 10, total / math.sqrt(words) / 3, min(total * 100 / words, 40) / 10])


def learn_units(sample: DataFrame, counts: tuple[int, int], most: int = MAX_UNITS) -> tuple[tuple[str, bool, float], ...]:
    """Words and word beginnings that mark toxic rows of the sample (label, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(_WORD.findall(text.lower()))
                units = {w + "$" for w in words}
                for k in range(3, MAX_BEGINNING + 1):
                    units.update({w[:k] for w in words if len(w) > k})
                seen[label].update(units)
            if len(seen[0]) + len(seen[1]) > COUNTED:
                yield _counted(seen)
                seen = (Counter(), Counter())
        yield _counted(seen)

    clean, toxic = counts
    t, c = F.col("t"), F.col("c")
    weight = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((c + 0.5) / (clean - c + 0.5))
    units = sample.select("label", "text").mapInArrow(count, "unit string, t long, c long")
    units = units.groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(t >= MIN_ROWS)
    units = units.withColumn("w", weight).withColumn("z", weight / F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)))
    units = units.where((F.col("w") >= MIN_WEIGHT) & (F.col("z") >= MIN_ERRORS))
    best = units.orderBy(F.desc("z"), "unit").limit(most).collect()
    return tuple((r["unit"].rstrip("$"), not r["unit"].endswith("$"), float(min(r["w"], 2 * BASE_WEIGHT))) for r in best)


def _counted(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    units = list(seen[0].keys() | seen[1].keys())
    cells = [pa.array(units, pa.string()), *(pa.array([seen[k][u] for u in units], pa.int64()) for k in (1, 0))]
    return pa.RecordBatch.from_arrays(cells, ["unit", "t", "c"])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Weighted, slightly ridged logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    shrink = ridge * np.eye(x.shape[1])
    shrink[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + shrink, x.T @ (weight * (y - p)) - shrink @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_units: int = MAX_UNITS) -> Model:
    """Learn from rows whose crc32(doc_id as text) mod 4 is not 2."""
    ids, counts = labelled(labels, "toxic", 4, 2, per_class)
    sample = texts_of(docs, ids).select("label", "text")
    taken = tuple(min(counts[k], per_class) for k in (0, 1))
    if not all(taken):
        return Model((), tuple(PRIOR))
    units = learn_units(sample, taken, most_units)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon(units)
        for b in batches:
            rows = [features(t, found).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

    rows = sample.mapInArrow(measured, "label int, x array<double>").collect()  # at most two classes of the bound
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(units, tuple(PRIOR))
    x = np.array([r["x"] for r in rows])
    weight = np.where(y == 1, counts[1] / max(1, taken[1]), counts[0] / max(1, taken[0]))
    return Model(units, tuple(logistic(x, y, weight / weight.mean()).tolist()))


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "_score") -> DataFrame:
    """``keep`` columns and their score in 0 to 1."""
    prepare(df.sparkSession)
    n = len(keep)
    curve = np.array(model.curve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lexicon(model.units)
        for b in batches:
            z = [float(features(t, found) @ curve) for t in b.column(n).to_pylist()]
            p = [1 / (1 + math.exp(-min(max(v, -30), 30))) for v in z]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(p, pa.float64())], [*keep, name])

    out = StructType([*[df.schema[k] for k in keep], StructField(name, DoubleType())])
    return df.select(*keep, F.col(text).alias(free(df, "_text"))).mapInArrow(run, out)


THRESHOLD = 0.3


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels), ["doc_id"])
    held_out = F.coalesce(crc() % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of the rows that are not toxic."""
    columns, name = docs.columns, free(docs, "_score")
    return score(docs, fit(docs, labels), columns, name=name).where(F.col(name) < THRESHOLD).select(*columns)
