"""Quality scores by positive-unlabelled learning.

A linear model over shares of hashed byte runs (case, digits as one class, punctuation kept) minimises the non-negative
unbiased risk  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))  with the logistic loss: trusted
positives are labelled 1, web text is unlabelled whatever it holds. The class prior is estimated from positives and
unlabelled text alone: whatever the margin, no smaller a share of the unlabelled lies above it than the prior times that of
positives that the fit has not seen, so the least ratio of the two shares bounds it. Labelled negatives serve for the last
step only, a logistic curve fitted on labelled rows of the learning fold that turns margins into scores.

Defined cases: null counts as the empty text, which scores as any text without runs; without positives every score is
the prior (0.5 if nothing is known); null labels are left out; a document labelled more than once counts as its largest
label; repeated rows and extra columns pass through.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import arrow_schema, batch, sliced, steps

BITS = 12
_table = np.arange(256, dtype=np.uint8)
_table[49:58] = 48


def _runs(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    padded = pc.binary_join_element_wise(pa.scalar("\n"), pc.fill_null(texts, ""), pa.scalar("\n"), "")
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(padded).to_numpy(zero_copy_only=False).astype(np.int64))])
    one = _table[np.frombuffer(b"".join(padded.cast(pa.binary()).to_pylist()), np.uint8)].astype(np.uint32)
    two = np.zeros_like(one)
    two[1:] = one[:-1] << 8 | one[1:]
    three = np.zeros_like(one)
    three[2:] = one[:-2] << 16 | two[2:]
    # no run reaches back into the text before
    starts = offsets[:-1]
    two[starts] = three[starts] = three[starts + 1] = 0
    return [((x + np.uint32(k << 24)) * np.uint32(2246822519)) >> np.uint32(32 - BITS) for k, x in ((1, one), (2, two), (3, three))], offsets


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float
    curve: tuple[float, float]

    def score(self, texts: pa.Array) -> np.ndarray:
        runs, offsets = _runs(texts)
        total = np.add.reduceat(sum(self.weights[x] for x in runs), offsets[:-1], dtype=np.float64) if len(texts) else np.zeros(0)
        margin = total / (3 * np.diff(offsets)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30)))


def _log1pexp(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, *, rounds: int = 200, rate: float = 0.02, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk, by Adam. Where the estimate of the negative risk falls below
    zero, a step raises it again instead of following the whole risk."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    w, m, v = (np.zeros(p.shape[1] + 1, np.float32) for _ in range(3))
    for i in range(1, rounds + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        negative = _log1pexp(zu).mean() - prior * _log1pexp(zp).mean()
        back = lambda x, g: np.append(g.astype(np.float32) @ x, g.sum()).astype(np.float32) / np.float32(len(x))
        g_negative = back(u, sig(zu)) - prior * back(p, sig(zp))
        g = -prior * back(p, sig(-zp)) + g_negative if negative >= 0 else -g_negative
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)).astype(np.float32)
    return w[:-1], float(w[-1])


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least loss, by Newton's steps on standardised margins, halved until the
    loss falls; a small penalty keeps the slope finite where margins tell all labels apart."""
    mean, spread = float(z.mean()), max(float(z.std()), 1e-9)
    x = np.stack([(z - mean) / spread, np.ones_like(z)], 1).astype(np.float64)
    loss = lambda c: (_log1pexp(x @ c) - y * (x @ c)).sum() + 0.5 * c[0] ** 2 * 1e-2 * len(y) ** 0.5
    c = np.array([1.0, float(np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3)))])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        penalty = np.array([1e-2 * len(y) ** 0.5, 1e-9])
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (q - y) + penalty * [c[0], 0])
        size = 1.0
        while size > 1e-6 and loss(c - size * step) > loss(c):
            size /= 2
        if size <= 1e-6 or np.abs(step).max() * size < 1e-9:
            break
        c = c - size * step
    a, b = c[0] / spread, c[1] - c[0] * mean / spread
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from margins of positives and unlabelled that the fit has not seen: the
    least ratio of the shares above a margin, taken where a tenth of the positives or more lie above, and two standard
    errors of the ratio allowed for. 0.5 where either is missing."""
    if len(positive) < 2 or not len(unlabelled):
        return 0.5
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    p = (positive[:, None] >= cuts).mean(0)
    u = (unlabelled[:, None] >= cuts).mean(0)
    error = u / p * np.sqrt((1 - p) / (p * len(positive)) + (1 - u) / (np.maximum(u, 1e-9) * len(unlabelled)))
    best = (u / p + 2 * error).argmin()
    return float(np.clip(u[best] / p[best], 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 2000) -> Model:
    """Fits the model on rows that are already without the held-out fold. It reads a bounded sample, chosen by a hash of
    the key: about `most` rows of each label and twice as many unlabelled ones, whole texts each."""
    draw = F.pmod(F.xxhash64(F.col("key"), F.lit("quality")), F.lit(1_000_000))
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    total = docs.count()
    if not counts.get(1) or not total:
        prior = 0.0 if counts.get(0) else 0.5
        return Model(np.zeros(1 << BITS, np.float32), 0.0, prior, (1.0, float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))))
    limit = F.when(F.col("label") == 1, F.lit(int(1e6 * most / counts[1]))).otherwise(F.lit(int(1e6 * most / max(1, counts.get(0, 0)))))
    few = known.filter(draw < limit).limit(4 * most)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(few), "key").select("label", "text")
    rows = rows.unionByName(texts.filter(draw < F.lit(int(2e6 * most / total))).limit(4 * most).select(F.lit(-1).alias("label"), "text"))
    schema = arrow_schema("label int, at binary, share binary")

    def sparse(b: pa.RecordBatch) -> pa.RecordBatch:
        runs, offsets = _runs(b.column(1))
        at, share = [], []
        for i, j in itertools.pairwise(offsets):
            c = sum(np.bincount(x[i:j], minlength=1 << BITS) for x in runs)
            nz = np.flatnonzero(c)
            at.append(nz.astype(np.uint16).tobytes())
            share.append((c[nz] / (3 * (j - i))).astype(np.float32).tobytes())
        return batch(schema, b.column(0), at, share)

    got = rows.mapInArrow(sliced(sparse), "label int, at binary, share binary").collect()
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.share, np.float32)
    y = np.array([r.label for r in got])
    del got
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    x *= scale
    p, u = x[y == 1], x[y == -1]
    first, bias = nnpu(p[::2], u[::2], 0.5)
    prior = class_prior(p[1::2] @ first + bias, u[1::2] @ first + bias)
    w, b = nnpu(x[y == 1], x[y == -1], prior)
    z, known_y = x[y >= 0] @ w + b, y[y >= 0]
    curve = _curve(z, known_y) if len(counts) > 1 else (1.0, 0.0)
    return Model((w * scale).astype(np.float32), b, prior, curve)


def score(df: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """df with a double column of scores; the model has a fixed size and goes with the tasks."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(shared.value.score(texts.slice(a, b - a)) for a, b in steps(texts))]))

    return df.withColumn(into, scored.asNondeterministic()(F.col(text)))
