"""Language ID by hierarchical discrimination: the language family first, then one-versus-one linear support vector
machines between the languages of that family.

Features are hashed runs of one to three bytes of the lower-cased text (whole text; digits and punctuation count as
blanks), as shares of the text's runs. Scores are linear in them, so a text is scored by summing weights over its bytes.

Defined cases: a null text or one without a letter is `und` with score 0; a model without labelled rows answers `und`
for every text; labels outside FAMILIES form a family of their own; equal scores go to the alphabetically first
language; repeated rows and extra columns pass through; a column named as the result is replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import arrow_schema, batch, sliced, steps

#: Languages by family, as ISO 639-1 codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BITS = 13
RESULT = "struct<lang_pred: string, score: double>"

_table = np.full(256, 32, np.uint8)
_table[97:123] = np.arange(97, 123)
_table[65:91] = np.arange(97, 123)
_table[128:] = np.arange(128, 256)


def _features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed runs at each byte (for 1, 2 and 3 bytes) and offsets by text; every text begins with a blank."""
    low = pc.binary_join_element_wise(pa.scalar(" "), pc.utf8_lower(pc.fill_null(texts, "")), pa.scalar(" "), "")
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64))])
    data = _table[np.frombuffer(b"".join(low.cast(pa.binary()).to_pylist()), np.uint8)].astype(np.uint32)
    one = data
    two = np.zeros_like(data)
    two[1:] = data[:-1] << 8 | data[1:]
    three = np.zeros_like(data)
    three[2:] = data[:-2] << 16 | two[2:]
    # no run reaches back into the text before
    starts = offsets[:-1]
    two[starts] = three[starts] = three[starts + 1] = 0
    mul, shift = np.uint32(2654435761), np.uint32(32 - BITS)
    return [((x + np.uint32(k << 24)) * mul) >> shift for k, x in ((1, one), (2, two), (3, three))], offsets


def _sums(runs: list[np.ndarray], offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean over each text's runs of weights (features x outputs)."""
    out = np.zeros((len(offsets) - 1, weights.shape[1]))
    for k in range(weights.shape[1]):
        w = np.ascontiguousarray(weights[:, k])
        total = sum(w[x] for x in runs)
        out[:, k] = np.add.reduceat(total, offsets[:-1], dtype=np.float64)
    return out / (3 * np.diff(offsets))[:, None]


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a linear SVM (squared hinge, classes of equal weight), by accelerated gradient descent. The last column
    of x is 1, so the last weight is the bias."""
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 0.5 / max(1e-9, float((each * np.einsum("ij,ij->i", x, x)).sum()))
    w = v = np.zeros(x.shape[1], np.float32)
    y, each = y.astype(np.float32), each.astype(np.float32)
    for i in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ v))
        step = v - np.float32(rate) * (np.float32(penalty) * v - 2 * ((each * y * gap) @ x))
        v = step + np.float32(i / (i + 3)) * (step - w)
        w = step
    return w


@dataclass
class Model:
    """weights: features x outputs; families and pairs say what each output separates."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        names, scores = np.full(n, "und", object), np.zeros(n)
        if not self.languages:
            return list(names), scores
        runs, offsets = _features(texts)
        s = _sums(runs, offsets, self.weights) + self.bias
        by_family = s[:, : len(self.families)]
        best = by_family.argmax(1)
        sure = 1 / (1 + np.exp(-4 * by_family[np.arange(n), best])) if len(self.families) > 1 else np.ones(n)
        for f, family in enumerate(self.families):
            members = [x for x in self.languages if FAMILY.get(x, x) == family]
            mine = best == f
            votes, least = np.zeros((n, len(members))), np.full((n, len(members)), np.inf)
            for k, (a, b) in enumerate(self.pairs):
                if a in members:
                    m, i, j = s[:, len(self.families) + k], members.index(a), members.index(b)
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
            pick = (votes + np.tanh(np.where(np.isinf(least), 0, least)) / 4).argmax(1)
            margin = least[np.arange(n), pick]
            within = np.where(np.isinf(margin), 1.0, 1 / (1 + np.exp(-4 * np.where(np.isinf(margin), 0, margin))))
            names[mine] = np.array(members, object)[pick[mine]]
            scores[mine] = np.minimum(sure, within)[mine]
        blank = ~pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names[blank], scores[blank] = "und", 0.0
        return list(names), np.clip(scores, 0, 1)


def _outputs(languages: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    families = sorted({FAMILY.get(k, k) for k in languages})
    return families, [(a, b) for a, b in itertools.combinations(languages, 2) if FAMILY.get(a, a) == FAMILY.get(b, b)]


def _fitted(y: np.ndarray, at: list, share: list) -> tuple[list[str], np.ndarray]:
    """Languages, and a row of weights and a bias for each output."""
    x = np.zeros((len(y), (1 << BITS) + 1), np.float32)
    for i, (a, s) in enumerate(zip(at, share, strict=True)):
        x[i, np.frombuffer(a.as_buffer(), np.uint16)] = np.frombuffer(s.as_buffer(), np.float32)
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    scale[-1] = 1
    x *= scale
    x[:, -1] = 1
    languages = sorted(set(y.tolist()))
    families, pairs = _outputs(languages)
    of = np.array([FAMILY.get(k, k) for k in y])
    fits = [_svm(x, np.where(of == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1]) for f in families]
    for a, b in pairs:
        mine = (y == a) | (y == b)
        fits.append(_svm(x[mine], np.where(y[mine] == a, 1.0, -1.0)))
    return languages, (np.stack(fits) * scale).astype(np.float32)


def train(rows: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 800, most: int = 6400) -> Model:
    """Fits the hierarchy on rows (already without the held-out fold). The classifiers are fitted on a bounded sample:
    about per_language labelled rows of each language (never over twice as many) and `most` in all, chosen by a hash of
    the key and read whole. One task fits them, and only the weights come to the driver."""
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return Model([], [], [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    per_language = max(1, min(per_language, most // len(counts)))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("langid")), F.lit(1_000_000))
    limit = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1_000_000, int(1e6 * per_language / v)))) for k, v in counts.items()))
    sample = rows.filter(draw < limit[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text")).limit(2 * per_language * len(counts))
    schema, told = arrow_schema("lang string, at binary, share binary"), arrow_schema("languages array<string>, weights binary")

    def sparse(b: pa.RecordBatch) -> pa.RecordBatch:
        runs, offsets = _features(b.column(1))
        at, share = [], []
        for i, j in itertools.pairwise(offsets):
            c = sum(np.bincount(x[i:j], minlength=1 << BITS) for x in runs)
            nz = np.flatnonzero(c)
            at.append(nz.astype(np.uint16).tobytes())
            share.append((c[nz] / (3 * (j - i))).astype(np.float32).tobytes())
        return batch(schema, b.column(0), at, share)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if sum(b.num_rows for b in parts):
            languages, weights = _fitted(np.array([x for b in parts for x in b.column(0).to_pylist()]), [x for b in parts for x in b.column(1)], [x for b in parts for x in b.column(2)])
            yield batch(told, [languages], [weights.tobytes()])

    got = sample.mapInArrow(sliced(sparse), "lang string, at binary, share binary").repartition(1).mapInArrow(fit, "languages array<string>, weights binary").first()
    if got is None:
        return Model([], [], [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    w = np.frombuffer(got.weights, np.float32).reshape(-1, (1 << BITS) + 1).T
    return Model(list(got.languages), *_outputs(list(got.languages)), np.ascontiguousarray(w[:-1]), w[-1].astype(np.float64))


def identify(df: DataFrame, model: Model, *, text: str = "text", into: str = "language") -> DataFrame:
    """df with a struct column `into` (lang_pred, score); the model has a fixed size and goes with the tasks."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def predicted(texts: pa.Array) -> pa.Array:
        names, scores = [], [np.zeros(0)]
        for a, b in steps(texts):
            n, s = shared.value.predict(texts.slice(a, b - a))
            names += n
            scores.append(s)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])

    return df.withColumn(into, predicted.asNondeterministic()(F.col(text)))
