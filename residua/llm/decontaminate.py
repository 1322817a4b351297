"""Benchmark decontamination by latent semantic retrieval.

Inverse document frequencies come from all documents. A randomised singular value decomposition of TF-IDF passages (all
items of the benchmark and all passages of the corpus, over the words of the benchmark: a passage's other words have no
part in its cosines but for its norm) runs as Spark jobs: each round adds up partial products of the partitions, the small
orthogonalisations are of a fixed size. Every document is cut into overlapping passages of one
to two times an item's length (a power of two, at least LEAST words; items share the passages of their size),
all are projected, and those whose cosine with a benchmark item in the latent space reaches `cosine` times that which
the item has with itself are candidates (all of them, not the first few). So is every place of a document that holds RUN
words of an item in a row (the whole of a shorter item), whatever the words weigh. A candidate counts if the longest common subsequence of the item and a stretch of the
document holds `share` of the item's words, or `weak` of them and the item's answer with `answer_share` of its words (an
answer of one or two words: whole and in a row).
The answer is the column `answer` if the benchmark has one, else the item's last sentence.

Words are compared in lower case without what is neither letter nor digit. The latent cosine takes the passage's whole
norm, so words that the benchmark lacks count against a passage.

Defined cases: null and empty texts match nothing, nor do items without words; items of under 8 words must match whole;
items equal to one another are each reported; a repeated doc_id reports the best match among its rows; an empty corpus
or benchmark gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import ODD, arrow_schema, batch, free, mixed, run_hashes, sliced, written

BITS = 18
#: Words of a passage in the decomposition, and the least in the search.
WINDOW, LEAST = 64, 8
RANK, EXTRA, POWERS = 128, 16, 2
#: Sum of squares of the benchmark's rows in the decomposition, against that of the corpus's: items must be well told.
SHARE = 6.0
#: Bytes of benchmark text that go to the tasks at once; each such part of a benchmark takes a pass over the corpus.
ITEM_BYTES = 16 << 20
#: Words in a row that make a place a candidate.
RUN = 3
_CHUNK = 256
#: Bytes of text in one step.
STEP = 3 << 20
#: Words whose passages are projected at once; a longer document stands alone.
BLOCK = 200_000
#: Values that are multiplied at once: they stay in a core's cache.
FEW = 1000
#: Cells whose sums are made at once, letters that are hashed at once and words that are looked up at once, for the same reason.
CELLS, LETTERS, LOOKUPS = 256, 1 << 17, 1 << 14
_PART = pa.schema([("chunk", pa.int32()), ("body", pa.binary())])
#: Bytes of lower-cased text: 1 parts words, 2 belongs to them, 0 is left out.
_KIND = np.full(256, 2, np.uint8)
_KIND[:128] = [1 if c in b" \t\n\x0b\x0c\r" else 2 if chr(c).isalnum() else 0 for c in range(128)]
#: For bytes.translate: which bytes do not belong to words, as a mask and as what to delete.
_BETWEEN, _DROPPED = (_KIND != 2).tobytes(), np.flatnonzero(_KIND != 2).astype(np.uint8).tobytes()


@dataclass
class Terms:
    """Words of texts in lower case, without what is neither letter nor digit; those with nothing left are none."""

    hashed: np.ndarray
    offsets: np.ndarray  # words by text
    letters: np.ndarray
    at: np.ndarray  # letters by word

    @property
    def buckets(self) -> np.ndarray:
        return (self.hashed >> np.uint64(64 - BITS)).astype(np.int32)

    def shown(self, first: int, last: int) -> list[bytes]:
        if first >= last:
            return []
        cut = (self.at[first : last + 1] - self.at[first]).tolist()
        body = self.letters[self.at[first] : self.at[last]].tobytes()
        return [body[a:b] for a, b in itertools.pairwise(cut)]


def _terms(texts: pa.Array) -> Terms:
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    odd = pc.match_substring_regex(low, r"[^\x00-\x7f\p{L}\p{N}]")
    if pc.any(odd).as_py():
        low = pc.if_else(odd, pc.replace_substring_regex(low, r"[^\x00-\x7f\p{L}\p{N}]+", ""), low)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64))])
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(low)], pa.int32()), low), "")[0].as_buffer().to_pybytes() if len(low) else b""
    between = np.flatnonzero(np.frombuffer(data.translate(_BETWEEN), bool))
    letters = np.frombuffer(data.translate(None, _DROPPED), np.uint8)
    gaps = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8)[between]] == 1)
    bounds = ends - np.searchsorted(between, ends)  # letters before each text; its first letter begins a word
    start = np.sort(np.concatenate([between[gaps] - gaps, bounds]), kind="stable")
    start = start[np.r_[True, start[1:] != start[:-1]] & (start < len(letters))]
    at = np.append(start, len(letters))
    hashed = np.zeros(len(start), np.uint64)
    a = 0
    while a < len(start):  # about as many letters at a time
        b = max(a + 1, int(np.searchsorted(at, at[a] + LETTERS)) - 1)
        cut = at[a : b + 1] - at[a]
        total = letters[at[a] : at[b]].astype(np.uint64)
        total += np.uint64(1)
        total *= _powers(len(total))[: len(total)]
        sums = np.cumsum(total, out=total)[cut[1:] - 1]
        hashed[a:b] = np.diff(sums, prepend=np.uint64(0)) * _INVERSE[cut[:-1]]  # as if each word began at power 0
        a = b
    return Terms(mixed(hashed), np.searchsorted(start, bounds), letters, at)


_table = [np.ones(1, np.uint64)]
#: The inverse of ODD, modulo 2 to the 64, to the powers from 0: a word that is hashed with others begins within LETTERS.
_INVERSE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(LETTERS, pow(int(ODD), -1, 1 << 64), np.uint64))])


def _powers(n: int) -> np.ndarray:
    """ODD to the powers from 0."""
    if len(_table[0]) < n:
        _table[0] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, LETTERS), ODD, np.uint64))])
    return _table[0]


def _summed(parts: DataFrame, width: int, size: int) -> np.ndarray:
    """The sum of partial tables: rows (chunk, body of float32) of _CHUNK x width values. The size is fixed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for b in batches:
            for k, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != at:
                    if total is not None:
                        yield batch(_PART, [at], [total.astype(np.float32).tobytes()])
                    at, total = k, np.zeros(_CHUNK * width)
                total += np.frombuffer(body.as_buffer(), np.float32)
        if total is not None:
            yield batch(_PART, [at], [total.astype(np.float32).tobytes()])

    out = np.zeros((-(-size // _CHUNK) * _CHUNK, width), np.float32)
    summed = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, body binary").toArrow()
    for k, body in zip(summed.column(0).to_pylist(), summed.column(1), strict=True):
        out[k * _CHUNK : (k + 1) * _CHUNK] = np.frombuffer(body.as_buffer(), np.float32).reshape(_CHUNK, width)
    return out[:size]


def _chunks(total: np.ndarray) -> pa.RecordBatch:
    width = total.size // len(total)
    cut = np.zeros((-(-len(total) // _CHUNK) * _CHUNK, width), np.float32)
    cut[: len(total)] = total.reshape(len(total), width)
    cut = cut.reshape(-1, _CHUNK * width)
    full = np.flatnonzero(cut.any(1))
    return batch(_PART, full.astype(np.int32), [cut[i].tobytes() for i in full])


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket's words, and the number of documents; over all documents."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS)

        def rows(b: pa.RecordBatch) -> None:
            terms = _terms(b.column(0))
            doc = np.repeat(np.arange(len(terms.offsets) - 1), np.diff(terms.offsets))
            seen = np.sort(doc << BITS | terms.buckets)
            total[:] += np.bincount(seen[np.r_[True, seen[1:] != seen[:-1]][: len(seen)]] & ((1 << BITS) - 1), minlength=1 << BITS)

        for _ in sliced(rows, "text", STEP)(batches):
            pass
        yield _chunks(total)

    found = _summed(docs.select(F.col(text).alias("text")).mapInArrow(tally, "chunk int, body binary"), 1, 1 << BITS)[:, 0]
    return found, docs.count()


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    """Positive for every word, those of all documents too."""
    return np.log((n + 2) / (np.minimum(df, n) + 1)).astype(np.float32)


PASSAGES = "item boolean, squares double, ends binary, slots binary, weights binary"


def _passages(texts: DataFrame, idf, slot, whole: bool) -> DataFrame:
    """TF-IDF rows of norm 1 over all words, but only the words that have a slot: whole texts, or stretches of WINDOW words
    one after the other. Many rows come as one: its sum of squares, where each ends, slots and weights."""
    schema = arrow_schema(PASSAGES)

    def rows(b: pa.RecordBatch) -> pa.RecordBatch | None:
        terms = _terms(b.column(0))
        bucket, counts = terms.buckets, np.diff(terms.offsets)
        doc = np.repeat(np.arange(len(counts)), counts)
        if whole:
            row, many = doc, len(counts)
        else:
            cells = -(-counts // WINDOW)
            row = (np.cumsum(cells) - cells)[doc] + (np.arange(len(doc)) - terms.offsets[doc]) // WINDOW
            many = int(cells.sum())
        norm = np.sqrt(np.bincount(row, idf.value[bucket].astype(np.float64) ** 2, many))
        known = slot.value[bucket]
        mine = np.flatnonzero(known >= 0)
        at, n = np.unique(row[mine].astype(np.int64) << BITS | known[mine], return_counts=True)
        if not len(at):
            return None
        row, at = at >> BITS, at & ((1 << BITS) - 1)
        weight = n * slot_idf.value[at] / np.maximum(norm[row], 1e-12)
        ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))
        return batch(schema, [whole], [float((weight * weight).sum())], [ends.astype(np.int32).tobytes()], [at.astype(np.int32).tobytes()], [weight.astype(np.float32).tobytes()])

    by_slot = np.zeros(int(slot.value.max()) + 1, np.float32)
    by_slot[slot.value[slot.value >= 0]] = idf.value[slot.value >= 0]
    slot_idf = texts.sparkSession.sparkContext.broadcast(by_slot)
    return texts.select("text").mapInArrow(sliced(rows, "text", STEP), PASSAGES)


def _numbered(slots: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """The distinct slots; spot, which has a place for each slot there is, then tells their numbers. Nothing is sorted."""
    count = np.arange(len(slots), dtype=np.int32)
    spot[slots] = count
    at = slots[spot[slots] == count]
    spot[at] = count[: len(at)]
    return at


def decomposition(rows: DataFrame, size: int, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors of the sparse matrix of PASSAGES rows: size x rank. Items are scaled to SHARE."""
    width = rank + EXTRA
    squares = {r["item"]: r["squares"] for r in rows.groupBy("item").agg(F.sum("squares").alias("squares")).collect()}
    scale = np.float32(math.sqrt(SHARE * squares[False] / squares[True])) if squares.get(False) and squares.get(True) else np.float32(1)
    spark = rows.sparkSession
    basis = np.random.default_rng(11).standard_normal((size, width)).astype(np.float32)

    def product(v, gram: bool) -> DataFrame:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width if gram else size, width), np.float32)
            spot = np.zeros(size, np.int32)
            for b in batches:
                for is_item, e, s, w in zip(b.column(0).to_pylist(), *b.columns[2:], strict=True):
                    ends, slots, weights = np.frombuffer(e.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.int32), np.frombuffer(w.as_buffer(), np.float32)
                    weights = weights * scale if is_item else weights
                    starts, i = np.append(0, ends[:-1]), 0
                    row = np.repeat(np.arange(len(ends)), ends - starts)
                    while i < len(ends):  # some rows at a time
                        j = max(i + 1, int(np.searchsorted(ends, starts[i] + FEW)))
                        some = slice(starts[i], ends[j - 1])
                        at = _numbered(slots[some], spot)
                        dense = np.zeros((j - i, len(at)), np.float32)
                        dense[row[some] - i, spot[slots[some]]] = weights[some]
                        y = dense @ v.value.take(at, 0)
                        if gram:
                            total += y.T @ y
                        else:
                            total[at] += dense.T @ y
                        i = j
            yield _chunks(total)

        return rows.mapInArrow(partial, "chunk int, body binary")

    for _ in range(POWERS):
        shared = spark.sparkContext.broadcast(basis)
        z = _summed(product(shared, False), width, size)
        basis = np.zeros_like(z)
        q = np.linalg.qr(z)[0]
        basis[:, : q.shape[1]] = q
        shared.destroy()
    shared = spark.sparkContext.broadcast(basis)
    gram = _summed(product(shared, True), width, width)
    shared.destroy()
    order = np.linalg.eigh(gram.astype(np.float64))
    return basis @ order[1][:, ::-1][:, :rank].astype(np.float32)


@dataclass
class Item:
    key: int
    words: list[bytes]
    answer: list[bytes]
    vector: np.ndarray
    least: float

    def __post_init__(self):
        self.known_counts = Counter(self.words)
        self.known = frozenset(self.words)


def _blocks(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with up to BLOCK words."""
    start, total = 0, 0
    for i, n in enumerate(counts.tolist()):
        if total and total + n > BLOCK:
            yield start, i
            start, total = i, 0
        total += n
    if total:
        yield start, len(counts)


@dataclass
class Size:
    """The items that passages of two times `half` words are compared with."""

    half: int
    items: np.ndarray
    matrix: np.ndarray
    least: np.ndarray


def _by_size(chosen: list[Item]) -> list[Size]:
    halves = np.array([max(LEAST, 1 << (len(c.words) - 1).bit_length()) // 2 for c in chosen])
    return [Size(int(h), at, np.stack([chosen[k].vector for k in at], 1), np.array([chosen[k].least for k in at], np.float32)) for h in np.unique(halves) for at in [np.flatnonzero(halves == h)]]


def _cell_sums(latent: np.ndarray, slots: np.ndarray, weights: np.ndarray | None, places: np.ndarray, cells: int, size: int) -> np.ndarray:
    """Weighted sums of latent rows by cell (without weights: latent's rows have theirs). Cells have `size` places each; a
    word's place is given, in ascending order, and words without a slot (below 0) weigh nothing. All first words of some cells
    that hold as many are added at once, then all second ones: ranges of rows added one by one (reduceat) take several times
    as long."""
    mine = np.flatnonzero(slots >= 0)
    cell = places[mine] // size
    many = np.bincount(cell, minlength=cells)
    nth = np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many)
    order = np.argsort(-many.astype(np.int8 if size < 128 else np.int64), kind="stable")  # fullest first
    spot = np.empty(cells, np.int64)
    spot[order] = np.arange(cells)
    to = nth * cells + spot[cell]
    slot = np.zeros(size * cells, slots.dtype)
    slot[to] = slots[mine]
    slot = slot.reshape(size, cells)
    if weights is not None:
        weight = np.zeros(size * cells, np.float32)
        weight[to] = weights[mine]
        weight = weight.reshape(size, cells)
    sums = np.zeros((cells, latent.shape[1]), np.float32)
    for a in range(0, cells, CELLS):
        most, some = many[order[a]], order[a : a + CELLS]
        least = many[some[-1]]
        part = np.zeros((len(some), latent.shape[1]), np.float32)
        for n in range(most):
            full = len(some) if n < least else int(np.searchsorted(-many[some], -n))  # cells that have such a word
            rows = latent.take(slot[n, a : a + full], 0)
            if weights is not None:
                rows *= weight[n, a : a + full, None]
            part[:full] += rows
        sums[some] = part
    return sums


class Runs:
    """The runs of `size` words of items, to look up those of documents."""

    def __init__(self, size: int, hashed: dict[int, np.ndarray]):
        self.size = size
        found = {k: run_hashes(h, size) for k, h in hashed.items()}
        keys = np.concatenate(list(found.values()))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.repeat(np.fromiter(found, np.int64, len(found)), [len(x) for x in found.values()])[order]
        self.offset = np.concatenate([np.arange(len(x)) for x in found.values()])[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def places(self, hashed: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, items and where the item would begin (it may be before the document does), for each run found."""
        runs = run_hashes(hashed, self.size) if len(hashed) >= self.size else np.zeros(0, np.uint64)
        at = np.flatnonzero(self.seen[(runs >> np.uint64(44)).astype(np.int64)])
        at = at[doc[at] == doc[at + self.size - 1]]
        low, high = np.searchsorted(self.keys, runs[at]), np.searchsorted(self.keys, runs[at], "right")
        many = high - low
        each = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        at = np.repeat(at, many)
        return doc[at], self.item[each], at - self.offset[each]


class Known:
    """The words of items, to bound what an item can have in common with a stretch."""

    def __init__(self, hashed: dict[int, np.ndarray]):
        keys, counts = zip(*(np.unique(self._key(h, k), return_counts=True) for k, h in hashed.items()), strict=True)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _key(hashed: np.ndarray, item) -> np.ndarray:
        return mixed(hashed + Known._salt(item))

    @staticmethod
    def _salt(item) -> np.ndarray:
        return (np.atleast_1d(item).astype(np.uint64) + np.uint64(1)) * ODD

    def held(self, hashed: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How many words of each item are among the words from first to last."""
        out, a, ends, salt = np.zeros(len(item), np.int64), 0, np.cumsum(last - first), self._salt(item)
        while a < len(item):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LOOKUPS, "right")))
            size = (last - first)[a:b]
            each = np.repeat(np.arange(a, b), size)
            key = mixed(hashed[np.arange(len(each)) + np.repeat(first[a:b] - (np.cumsum(size) - size), size)] + salt[each])
            maybe = np.flatnonzero(self.seen[(key >> np.uint64(44)).astype(np.int64)])
            key, each = key[maybe], each[maybe]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            pair = np.unique((each[hit] - a) * len(self.keys) + at[hit])
            out[a:b] = np.bincount(pair // len(self.keys), self.counts[pair % len(self.keys)], b - a)
            a = b
        return out


def _masks(item: list[bytes]) -> dict[bytes, int]:
    """The places of each word of an item, as bits."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _common(size: int, found: list[int]) -> int:
    """Length of the longest common subsequence of an item of `size` words and words given by their masks, bit-parallel;
    words that the item lacks may be left out."""
    v = full = (1 << size) - 1
    for m in found:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def subsequence(item: list[bytes], stretch: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    masks = _masks(item)
    return _common(len(item), [masks[w] for w in stretch if w in masks])


def stretches(item: Sequence, text: Sequence) -> Iterator[tuple[int, Sequence]]:
    """Stretches of at most 1.5 times the item's length, and where they begin."""
    size, step = math.ceil(1.5 * len(item)), max(1, len(item) // 4)
    return ((a, text[a : a + size]) for a in range(0, max(1, len(text) - size + step), step))


def best_stretch(item: list[bytes], text: list[bytes], least: float = 0) -> tuple[int, int, int]:
    """Most common words of the item with a stretch; minus where the first such stretch is, and its size. Where no stretch
    can have `least` words in common, 0 of them."""
    size, masks = math.ceil(1.5 * len(item)), _masks(item)
    found = [masks.get(w, 0) for w in text]
    before = list(itertools.accumulate((m > 0 for m in found), initial=0))
    found = [m for m in found if m]
    common, where = -1, 0
    for a, x in stretches(item, range(len(text))):
        low, high = before[a], before[a + len(x)]  # the stretch's words that the item has bound what is in common
        if high - low > common and high - low >= least and (n := _common(len(item), found[low:high])) > common:
            common, where = n, -a
    return max(common, 0), where, size


def answered(answer: list[bytes], stretch: list[bytes], share: float) -> bool:
    """Whether the stretch holds the answer; one of under 3 words must stand there in a row. Without words: no."""
    if len(answer) >= 3:
        return subsequence(answer, stretch) >= share * len(answer)
    return bool(answer) and any(stretch[a : a + len(answer)] == answer for a in range(len(stretch)))


def _benchmark(items: DataFrame) -> DataFrame:
    """(item, words, answer, hashed) of items (item, text, answer) that have words; an item without an answer has its last
    sentence as one."""
    ddl = "item bigint, words array<binary>, answer array<binary>, hashed binary"
    schema = arrow_schema(ddl)

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        tails = [x if x is not None else next((s for s in reversed(re.split(r"[.!?]+", t)) if s.strip()), "") for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        text, tail = _terms(b.column(1)), _terms(pa.array(tails, pa.string()))
        told = lambda t, i: t.shown(t.offsets[i], t.offsets[i + 1])
        full = [i for i in range(b.num_rows) if text.offsets[i] < text.offsets[i + 1]]
        return batch(schema, b.column(0).take(pa.array(full, pa.int64())), [told(text, i) for i in full], [told(tail, i) for i in full], [text.hashed[text.offsets[i] : text.offsets[i + 1]].tobytes() for i in full])

    return items.mapInArrow(sliced(rows), ddl)


def matches(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", cosine: float = 0.2, share: float = 0.7, weak: float = 0.5, answer_share: float = 0.9) -> DataFrame:
    """(doc_id, item_id, cosine, common): the best match of each document and item that match."""
    spark = docs.sparkSession
    found = "doc bigint, item bigint, cosine double, common double"
    none = spark.createDataFrame([], found.replace("doc ", "doc_id ").replace("item ", "item_id "))
    df, n = document_frequencies(docs, text)
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col("text").alias("text"), F.col("answer").cast("string").alias("answer") if "answer" in benchmark.columns else F.lit(None).cast("string").alias("answer")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if not n or not size:
        return none
    told = written(_benchmark(items), "items")
    used = arrow_schema("bucket int")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        for b in batches:
            for x in b.column(0):
                seen[Terms(np.frombuffer(x.as_buffer(), np.uint64), *[None] * 3).buckets] = True
        yield batch(used, np.flatnonzero(seen).astype(np.int32))

    live = np.sort(told.select("hashed").mapInArrow(buckets, "bucket int").distinct().toArrow().column(0).to_numpy())  # at most all buckets
    if not len(live):
        return none
    by_bucket = np.full(1 << BITS, -1, np.int32)
    by_bucket[live] = np.arange(len(live))
    idf, slot = spark.sparkContext.broadcast(_idf(df, n)), spark.sparkContext.broadcast(by_bucket)
    corpus = _passages(docs.select(F.col(text).alias("text")), idf, slot, False)
    latent = decomposition(written(_passages(items, idf, slot, True).union(corpus), "passages"), len(live))
    table = spark.sparkContext.broadcast((by_bucket, latent * idf.value[live][:, None]))  # a slot's words weigh the same
    schema = arrow_schema(found)
    parts = []
    many = -(-size // ITEM_BYTES)
    for block in range(many):
        chosen, hashed = [], {}
        for r in told.filter(F.pmod(F.xxhash64("item"), F.lit(many)) == block).toArrow().to_batches():
            for key_, words, answer, h in zip(*(r.column(k).to_pylist() for k in range(4)), strict=True):
                hashed[len(chosen)] = h = np.frombuffer(h, np.uint64)
                bucket = Terms(h, *[None] * 3).buckets
                v = idf.value[bucket] @ latent[by_bucket[bucket]]
                norm, whole = float(np.sqrt(v @ v)), float(np.sqrt((idf.value[bucket] ** 2).sum()))
                unit, least = (v / norm, cosine * min(1.0, norm / whole)) if norm > 0 else (v, np.inf)  # without norm: by runs alone
                chosen.append(Item(key_, words, answer, unit.astype(np.float32), least))
        if not chosen:
            continue
        sizes = sorted({min(RUN, len(c.words)) for c in chosen})
        runs = [Runs(n, {k: hashed[k] for k, c in enumerate(chosen) if min(RUN, len(c.words)) == n}) for n in sizes]
        shared = spark.sparkContext.broadcast((chosen, _by_size(chosen), runs, Known(hashed)))

        def search(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            ids = b.column(0).to_pylist()
            terms = _terms(b.column(1))
            bucket = terms.buckets
            doc = np.repeat(np.arange(len(ids)), np.diff(terms.offsets))
            if not len(bucket):
                return None
            counts = np.bincount(doc, minlength=len(ids))
            begin = np.cumsum(counts) - counts
            weight = idf.value[bucket]
            seen = table.value[0][bucket]
            chosen, by_size, runs, known = shared.value
            slotted, before = terms.hashed[seen >= 0], np.concatenate([[0], np.cumsum(seen >= 0)])  # no other word is one of an item
            long = np.array([len(c.words) for c in chosen])
            out = {}

            def settle(d: int, k: int, first: int, last: int, cos: float | None) -> None:
                it = chosen[k]
                stretch = terms.shown(first, last)
                held = it.known.intersection(stretch)  # bounds the subsequence
                if sum(it.known_counts[w] for w in held) < weak * len(it.words):
                    return
                common, where, size = best_stretch(it.words, stretch, min(share, weak) * len(it.words))
                enough = common >= (share if len(it.words) >= 8 else 1) * len(it.words)
                if not enough and len(it.words) >= 8 and common >= weak * len(it.words):
                    enough = any(answered(it.answer, x, answer_share) and subsequence(it.words, x) >= weak * len(it.words) for _, x in stretches(it.words, stretch))
                if enough:
                    if cos is None:
                        m = np.arange(first - where, min(first - where + size, last))
                        m, whole = m[seen[m] >= 0], float(np.sqrt((weight[m] * weight[m]).sum()))
                        cos = float(table.value[1][seen[m]].sum(0) @ it.vector) / whole if whole else 0.0
                    out[(ids[d], it.key)] = max(out.get((ids[d], it.key), (0, 0)), (common / len(it.words), float(cos)))

            def settle_all(d: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray, cos: np.ndarray | None) -> None:
                """Candidates that hold enough of the item's words."""
                first, last = np.maximum(begin[d], first), np.minimum(begin[d] + counts[d], last)
                last = np.maximum(first, last)
                likely = np.flatnonzero(known.held(slotted, item, before[first], before[last]) >= weak * long[item])
                for i in likely.tolist():
                    settle(int(d[i]), int(item[i]), int(first[i]), int(last[i]), None if cos is None else cos[i])

            for x, y in _blocks(counts):
                word = slice(begin[x], begin[y - 1] + counts[y - 1])
                size = min(by_size[0].half, LEAST)
                cells = -(-counts[x:y] // size)  # half passages of a document
                total = int(cells.sum())
                place = np.arange(word.stop - word.start) + np.repeat((np.cumsum(cells) - cells) * size - (begin[x:y] - begin[x]), counts[x:y])
                norm = np.bincount(place // size, weight[word] * weight[word], total)
                sums = _cell_sums(table.value[1], seen[word], None, place, total, size)
                for group in by_size:
                    while size < group.half:
                        fewer = -(-cells // 2)
                        owner = np.repeat(np.arange(y - x), cells)
                        to = (np.cumsum(fewer) - fewer)[owner] + (np.arange(len(owner)) - (np.cumsum(cells) - cells)[owner]) // 2
                        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                        two = np.diff(cut, append=len(to)) == 2
                        both, other = sums.take(cut, 0), sums.take(cut + two, 0)
                        other[~two] = 0
                        both += other
                        sums, norm, cells, size = both, np.add.reduceat(norm, cut), fewer, 2 * size
                    owner, first = np.repeat(np.arange(x, y), cells), np.cumsum(cells) - cells
                    goes_on = np.append(owner[1:] == owner[:-1], False)  # a passage is a half and the next one of the same document
                    norms = np.sqrt(norm + np.where(goes_on, np.append(norm[1:], 0), 0))
                    for a in range(0, len(owner), 2000):
                        part = np.arange(a, min(a + 2000, len(owner)))
                        vectors = sums[a : a + 2000].copy()
                        vectors[: len(sums) - a - 1] += sums[a + 1 : a + 2001]
                        vectors[~goes_on[part]] = sums[part[~goes_on[part]]]
                        near = np.flatnonzero((np.einsum("ij,ij->i", vectors, vectors) >= (group.least.min() * norms[part]) ** 2) & (norms[part] > 0))
                        if len(near):
                            some = near
                            cos = vectors[some] @ group.matrix
                            cos /= norms[part[some], None].astype(np.float32)
                            p, k = np.nonzero(cos >= group.least)
                            d, item = owner[part[some[p]]], group.items[k]
                            start = begin[d] + (part[some[p]] - first[d - x]) * size - size
                            settle_all(d, item, start, start + 4 * size + long[item], cos[p, k])
            for r in runs:
                d, k, start = r.places(terms.hashed, doc)
                step = np.maximum(1, long[k] // 2)  # runs that begin their item within half its length share a check
                cell = (start - begin[d] + long[k]) // step
                _, one = np.unique(np.stack([d, k, cell]), axis=1, return_index=True)
                d, k, first, step = d[one], k[one], (begin[d] - long[k] + cell * step)[one], step[one]
                settle_all(d, k, first - step, first + 2 * step + 2 * long[k], None)
            if not out:
                return None
            return batch(schema, [k[0] for k in out], [k[1] for k in out], [v[1] for v in out.values()], [v[0] for v in out.values()])

        parts.append(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(sliced(search, "text", STEP), found))
    if not parts:
        return none
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"))


def clean(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without those that match a benchmark item."""
    (bad,) = free(docs, "bad")
    return docs.join(matches(docs, benchmark, key=key, text=text, **options).select(F.col("doc_id").alias(bad)).distinct(), F.col(key) == F.col(bad), "left_anti")
