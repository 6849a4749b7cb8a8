"""Quality by positive-unlabelled learning.

A small network is trained on trusted positives and on unlabelled web text: a sample of all documents outside the held-out
fold, whatever their labels, which are not looked at; so training does not depend on the share that is labelled. With
the class prior p, the risk of a classifier over all text is the positives' share p of its loss on positives, plus its
loss on unlabelled text called negative, less what the positives among that text add. The last two are an estimate of
the negatives' risk, which cannot be below zero; where a batch makes it so, the step goes against the overfit (the
non-negative estimator). The prior is estimated from positives and unlabelled text alone; labelled negatives are not read.

Fitting sees at most ``PER_CLASS`` positives and ``UNLABELLED`` documents of the sample, in hash order; scores read whole texts of
all rows. The features are shares and rates of characters, words and lines, so no vocabulary is learned.

Null texts count as empty and get the score of an empty text. Rows may repeat and stay rows. Extra columns are not read.
Without labelled positives, or without any document outside the fold, every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from prevuelo.llm.samples import crc, labelled, texts_of
from prevuelo.llm.store import free, prepare

#: Positives and unlabelled rows that fitting may use.
PER_CLASS, UNLABELLED = 8_000, 12_000
#: Rows that half of a sample must have for a prior to be estimated, steps of its classifier, and the least and largest one.
LEAST_ROWS, PRIOR_STEPS, PRIORS = 5, 300, (0.02, 0.98)
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1000, 2048, 0.005, 3e-3

# Characters that are counted one by one.
SINGLE = "#$%&*!|<>{}[]()/\\@=_~^+-:;,.?\"'"

_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 beyond ASCII, 7.. single
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t", 4), ("\n", 5)):
    _KIND[[ord(c) for c in _chars]] = _kind
_KIND[128:] = 6
for _i, _c in enumerate(SINGLE):
    _KIND[ord(_c)] = 7 + _i
_KINDS = 7 + len(SINGLE)
_KIND_TABLE = bytes(_KIND.tolist())


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw.translate(_KIND_TABLE), np.uint8), minlength=_KINDS).astype(float)
    n = max(1, len(raw))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    distinct = set(words)
    top = Counter(words).most_common(1)[0][1] if words else 0
    letters = max(1.0, counts[1] + counts[2] + counts[6])
    shares = np.sqrt(counts / n)
    more = [
        np.log1p(len(raw)) / 10,
        len(distinct) / n_words,
        top / n_words,
        len(set(lines)) / n_lines,
        np.log1p(n / n_lines) / 6,
        min(20.0, sum(map(len, words)) / n_words) / 10,
        counts[2] / letters,
        counts[7:].sum() / n_words / 3,
        len(zlib.compress(raw, 1)) / n if raw else 1.0,
        float(not raw),
    ]
    return np.concatenate([shares, np.array(more)])


@dataclass(frozen=True)
class Model:
    """Shift and scale of the features, the two layers; ``layers`` None: every score is ``prior``."""

    prior: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        a, b, c, d = self.layers
        z = np.tanh(_scaled(x, self.shift, self.scale) @ a + b) @ c + d
        return 1 / (1 + np.exp(-np.clip(z[:, 0], -30, 30)))


def _scaled(x: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - shift) / scale, -6, 6)


def train(positive: np.ndarray, other: np.ndarray, prior: float, steps: int = STEPS, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk under the sigmoid loss, by Adam."""
    both = np.concatenate([positive, other])
    shift, scale = both.mean(0), both.std(0) + 1e-3
    positive, other = _scaled(positive, shift, scale), _scaled(other, shift, scale)
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, (HIDDEN, 1)), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for t in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), BATCH // 2)]
        u = other[rng.integers(0, len(other), BATCH // 2)]
        x = np.concatenate([p, u])
        h = np.tanh(x @ layers[0] + layers[1])
        z = (h @ layers[2] + layers[3])[:, 0]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        sp, su = s[: len(p)], s[len(p) :]
        # the loss is s where called negative, 1 - s where called positive
        negative = su.mean() - prior * sp.mean()
        slope_of = s * (1 - s)
        down = -prior * slope_of[: len(p)] / len(p)
        rise = np.concatenate([down, slope_of[len(p) :] / len(u)])
        slope = np.concatenate([down, np.zeros(len(u))]) + rise if negative >= 0 else -rise
        back = slope[:, None] @ layers[2].T * (1 - h * h)
        slopes = [x.T @ back, back.sum(0), h.T @ slope[:, None], slope.sum(keepdims=True)]
        rate = RATE * (1 - t / (steps + 1))
        for i, g in enumerate(slopes):
            g = g + DECAY * layers[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Model(prior, shift, scale, tuple(layers))


def estimate_prior(positive: np.ndarray, other: np.ndarray, seed: int = 11) -> float:
    """The share of positives among unlabelled rows, from where a classifier of the two finds almost positives alone.

    Above any threshold lie a share of the positives and at least the prior's part of that share of the unlabelled rows;
    the quotient of the two is the prior where no negative lies above it. The threshold is the one with the least upper
    confidence bound of the quotient, on rows that the classifier has not seen; halves change places and are averaged.
    """
    rng, found = np.random.default_rng(seed), []
    positive, other = positive[rng.permutation(len(positive))], other[rng.permutation(len(other))]
    p, u = len(positive) // 2, len(other) // 2
    if p < LEAST_ROWS or u < LEAST_ROWS:
        return 0.5
    for mine, theirs in ((slice(0, p), slice(p, None)), (slice(p, None), slice(0, p))):
        own, rest = (slice(0, u), slice(u, None)) if mine.start == 0 else (slice(u, None), slice(0, u))
        model = train(positive[mine], other[own], 0.5, PRIOR_STEPS)
        high, all_ = np.sort(model.score(positive[theirs])), np.sort(model.score(other[rest]))
        share_p = 1 - np.searchsorted(high, high) / len(high)
        share_u = 1 - np.searchsorted(all_, high) / len(all_)
        slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(high)) + 1 / np.sqrt(len(all_)))
        found.append((share_u / share_p)[np.argmin((share_u + slack) / share_p)])
    return float(np.clip(np.mean(found), *PRIORS))


def _measured(sample: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["x"])

    rows = sample.select("text").mapInArrow(run, "x array<double>").collect()  # at most the bound of the sample
    return np.array([r["x"] for r in rows])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, unlabelled: int = UNLABELLED, prior: float | None = None) -> Model:
    """Learn from documents whose crc32(doc_id as text) mod 3 is not 1: labelled positives, and all without their labels.

    ``per_class`` positives and ``unlabelled`` documents at most are used. ``prior``, the share of positives among all
    documents, is estimated where it is not given.
    """
    ids, _ = labelled(labels, "quality", 3, 1, per_class)
    rest = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & (crc() % 3 != 1))
    rest = rest.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    positive, other = _measured(texts_of(docs, ids.where("label = 1"))), _measured(texts_of(docs, rest))
    if not len(positive) or not len(other):
        return Model(0.5)
    return train(positive, other, estimate_prior(positive, other) if prior is None else prior)


def score(df: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "_score") -> DataFrame:
    """``keep`` columns and their score in 0 to 1."""
    prepare(df.sparkSession)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(n).to_pylist()
            found = model.score(np.array([features(t) for t in texts])) if texts else []
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(found, pa.float64())], [*keep, name])

    out = StructType([*[df.schema[k] for k in keep], StructField(name, DoubleType())])
    return df.select(*keep, F.col(text).alias(free(df, "_text"))).mapInArrow(run, out)


THRESHOLD = 0.5


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels), ["doc_id"])
    held_out = F.coalesce(crc() % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
