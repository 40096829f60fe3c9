"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled sample is of documents
without a label.  The class prior is estimated from both alone: a discriminator of
positives against unlabelled text is fitted on one half of them, and the prior is the
smallest ratio of tail shares on the other half, with a margin for sampling error
(best bin estimation; Garg et al., 2021).  A linear model over whole-text statistics
then minimises the non-negative risk (Kiryo et al., 2017)

    prior E_P[l(+)] + max(0, E_U[l(-)] - prior E_P[l(-)])

with the logistic loss, so that its sigmoid estimates the share of good documents.

Only a bounded sample is used for fitting (``MAX_POSITIVE``, ``MAX_UNLABELLED``, taken
in order of a hash of the id); every document is scored, over its whole text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, lowest, release_memory

#: documents that the model is fitted on at most: those with the lowest hashes of their ids, so a fair sample of all at
#: any size; a linear model of some 600 weights has no use for more.  All documents are scored.
MAX_POSITIVE = 8000
MAX_UNLABELLED = 16000
CUTOFF = 0.7
FIT_PARTITIONS = 16

# classes of UTF-8 bytes: letters, digits, white space, each frequent mark, and the rest
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b";:", b"'\"`", b"-_", b"#", b"*", b"$", b"%", b"&", b"|", b"<>{}[]\\", b"()/@=+~^", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 256))]
CLASSES = len(_GROUPS) + 1
_CLASS = np.full(256, CLASSES - 1, np.int64)
for _k, _group in enumerate(_GROUPS):
    _CLASS[list(_group)] = _k
EXTRA = 8
SIZE = CLASSES * CLASSES + CLASSES + EXTRA
_STRIP = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Whole-text statistics of one document; a null text is empty.  No label, language, source or id goes in."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    pairs = np.zeros(CLASSES * CLASSES, np.int64)
    packer, packed = zlib.compressobj(1), 0
    for k in range(0, len(raw), _STRIP):  # bounded memory for very long texts
        strip = raw[k : k + _STRIP + 1]
        c = _CLASS[np.frombuffer(strip, np.uint8)]
        pairs += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        packed += len(packer.compress(strip[:_STRIP]))
    packed += len(packer.flush())
    single = pairs.reshape(CLASSES, CLASSES).sum(axis=1)
    if raw:
        single[_CLASS[raw[-1]]] += 1
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(raw)), max(1, len(words))
    out = np.empty(SIZE, np.float32)
    out[: pairs.size] = np.sqrt(pairs / n)
    out[pairs.size : -EXTRA] = np.sqrt(single / n)
    distinct = len(set(words)) / m
    out[-EXTRA:] = (
        math.log1p(len(words)),
        math.log(packed / n),
        distinct,
        math.log(distinct + 1e-3) if words else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        n / m / 10,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        math.log1p(n / max(1, len(lines))) / 10,
    )
    return out


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float
    fitted: bool = True

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, size: int, steps: int, rate: float = 0.02) -> np.ndarray:
    """Adam from zero; the last parameter is the bias."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 150, confidence: float = 0.1) -> float:
    """The share of positives in u, from standardised features of positives and unlabelled rows; the last column is 1."""
    a, b = p[::2], u[::2]

    def gradient(w):
        w32 = w.astype(np.float32)
        return -((1 - _sigmoid(a @ w32)) @ a) / len(a) + (_sigmoid(b @ w32) @ b) / len(b) + 1e-3 * w

    w = _descend(gradient, a.shape[1], steps)
    w32 = w.astype(np.float32)
    ps, us = np.sort(p[1::2] @ w32), np.sort(u[1::2] @ w32)
    if not len(ps) or not len(us):
        return 0.5
    cuts = ps[: max(1, int(0.5 * len(ps)))]  # tails with at least half of the positives
    tail_p = 1 - np.searchsorted(ps, cuts, "left") / len(ps)
    tail_u = 1 - np.searchsorted(us, cuts, "left") / len(us)
    margin = math.sqrt(math.log(4 / confidence) / 2) * (1 / math.sqrt(len(ps)) + 1 / math.sqrt(len(us)))
    best = np.argmin(tail_u / tail_p + margin / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.01, 0.99))


STRIP = 1024


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the columns in double precision; a strip at a time."""
    strips = range(0, len(x), STRIP)
    mean = sum(x[k : k + STRIP].sum(axis=0, dtype=np.float64) for k in strips) / len(x)
    return mean, np.sqrt(sum(((x[k : k + STRIP] - mean) ** 2).sum(axis=0) for k in strips) / len(x))


def _standardise(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Clipped standard scores in the place of all columns but the last, which is 1; a strip at a time."""
    for k in range(0, len(x), STRIP):
        x[k : k + STRIP, :-1] = np.clip((x[k : k + STRIP, :-1] - mean) / scale, -8, 8)
    return x


def fit(p: np.ndarray, u: np.ndarray, **options) -> Model:
    """A model from features (single precision) of positives and of unlabelled documents.

    Without one or the other every document gets the score 0.5."""
    with_ones = lambda x: np.hstack([x, np.ones((len(x), 1), np.float32)])
    return fit_in_place(with_ones(p), with_ones(u), **options)


def fit_in_place(p: np.ndarray, u: np.ndarray, steps: int = 400, l2: float = 3e-4) -> Model:
    """fit() of matrices with a last column of ones, which it overwrites, so that the driver holds each once."""
    if not len(p) or not len(u):
        return Model(np.zeros(SIZE), np.ones(SIZE), np.zeros(SIZE), 0.0, 0.5, False)
    mean, scale = _moments(u[:, :-1])
    scale += 1e-3
    a, b = _standardise(p, mean, scale), _standardise(u, mean, scale)
    prior = estimate_prior(a, b)

    def gradient(w):
        w32 = w.astype(np.float32)
        za, zb = (a @ w32).astype(np.float64), (b @ w32).astype(np.float64)
        sa, sb = _sigmoid(za).astype(np.float32), _sigmoid(zb).astype(np.float32)
        # losses: l(+) = log(1 + exp(-z)), l(-) = log(1 + exp(z))
        negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
        g_negative = (sb @ b) / len(b) - prior * (sa @ a) / len(a)
        if negative < 0:
            return -g_negative  # step back from a negative risk
        decay = l2 * w
        decay[-1] = 0
        return -prior * ((1 - sa) @ a) / len(a) + g_negative + decay

    w = _descend(gradient, a.shape[1], steps)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features_of(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["chosen", "x"])

    return texts.mapInArrow(run, "chosen long, x binary")


def train(docs: DataFrame, labels: DataFrame, *, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fits on documents that are not held out; ``labels(doc_id, quality)``.

    A document with several labels is positive if all are 1.  Rows without doc_id are
    not used.  Where no document lacks a label, unlabelled ones are drawn from all, their
    labels unread.  At most ``max_positive + max_unlabelled`` documents reach the driver, as
    statistics of fixed size."""
    docs = docs.select("doc_id", "text")  # other columns may have any names
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("low"))
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    marked = ids.join(known.withColumn("labelled", F.lit(True)), "doc_id", "left").select("doc_id", "low", "labelled", F.xxhash64("doc_id", F.lit(17)).alias("h"))
    good, without, every = marked.agg(F.count_if(F.col("low") == 1), F.count_if(F.col("labelled").isNull()), F.count("*")).first()
    some = lambda rows, n, total, positive: lowest(rows, n, total).select(F.col("doc_id").alias("chosen"), F.lit(positive).alias("positive"))
    unlabelled = some(marked.where("labelled IS NULL"), max_unlabelled, without, False) if without else some(marked, max_unlabelled, every, False)
    sample = cut(some(marked.where("low = 1"), max_positive, good, True).unionAll(unlabelled))
    texts = docs.join(F.broadcast(sample.select("chosen").distinct()), docs["doc_id"] == F.col("chosen")).select("chosen", docs["text"])  # bounded by the two limits
    drawn = {(r["chosen"], r["positive"]) for r in sample.collect()}  # a document may be drawn as both
    # a bounded sample: made by a few tasks and kept in as few files, then read one at a time
    known = cut(_features_of(texts.dropDuplicates(["chosen"]).select("chosen", "text").coalesce(FIT_PARTITIONS)))
    ids = {kind: {k: at for at, k in enumerate(sorted(k for k, positive in drawn if positive is kind))} for kind in (True, False)}  # in order, so that fits can be repeated
    features_of = {kind: np.ones((len(at), SIZE + 1), np.float32) for kind, at in ids.items()}
    met = {kind: np.zeros(len(at), bool) for kind, at in ids.items()}
    for r in known.toLocalIterator():
        for kind, at in ids.items():
            if r["chosen"] in at:
                features_of[kind][at[r["chosen"]], :-1] = np.frombuffer(r["x"], np.float32)
                met[kind][at[r["chosen"]]] = True
    return fit_in_place(*[x if met[kind].all() else x[met[kind]] for kind, x in features_of.items()])


def score_column(text: Column, model: Model) -> Column:
    """Scores of whole texts, 0 to 1; the model (a few KB) goes with the task."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        out = np.empty(len(texts))
        for k in range(0, len(texts), 256):
            out[k : k + 256] = model.score(np.array([features(t) for t in texts.iloc[k : k + 256]], np.float64).reshape(-1, SIZE))
        return pd.Series(out)

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Null and empty texts are scored like any other, repeated rows each get a row, and
    a null doc_id is not held out.  An empty table gives an empty result."""
    model = train(docs, labels, **options)
    release_memory()
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))


def rejected_removed(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` whose score is at least the cutoff; all columns stay.

    Where no model could be fitted there is no ground to reject any: all stay."""
    model = train(docs, labels, **options)
    release_memory()
    if not model.fitted:
        return docs
    return docs.where(score_column(F.col("text"), model) >= CUTOFF)
