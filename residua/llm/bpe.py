"""Byte-level BPE encoding and decoding by tree concatenation.

The pre-tokeniser's pattern always splits before a blank that follows a character that isn't one, so texts are cut there,
many at once, and each distinct segment is encoded once. A segment or a run that the pattern doesn't split can have any
length: halves of it are encoded each by itself, and a join of two takes a few ids of both sides, encodes the bytes that
they stand for again, and takes more until its first and its last id are those that were there. That is exact: ids are
the encoding of their bytes if every two neighbours are, and any two are neighbours in the left half, the right half or
the window. All windows of a level are encoded together. Texts of over BIG bytes are dealt over the cluster: parts of
them are encoded as rows of their own, and the joins of a level meet by text and half of their place, a shuffle a level.

Defined cases: null counts as the empty text, which has no ids; texts of any length are encoded whole; the strings of
special tokens in a text are those tokens, as the library takes them; repeated rows and extra columns pass through, but a
column named as the result is replaced; equal long texts are encoded once; an id that is not in the vocabulary decodes to
nothing; bytes that are no UTF-8 decode to replacement characters.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.common import arrow_schema, batch, blobs, free, lists, steps, written

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
from tokenizers import Tokenizer  # noqa: E402

#: Characters of a run that is encoded by halves, and of what is not halved again.
LONG = 2048
#: Bytes of a text that is dealt over the cluster, and characters of its parts.
BIG = 96 << 10
PART = 16 << 10
#: Ids of each side that a join's first window takes.
WINDOW = 4
#: Segments whose ids a worker remembers.
KNOWN = 1 << 18
DIGEST = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
#: One of a text's parts: whether it goes on inside a run, whether it lies in one run, and its ids.
NODE = "text_key string, at int, joins boolean, inner boolean, head int, tail int, ids binary"


@lru_cache(1)
def _letters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Node:
    """Ids of a part: head and tail of them lie in its first and its last run; inner: all of them lie in one."""

    def __init__(self, ids: np.ndarray, inner: bool, head: int | None = None, tail: int | None = None):
        self.ids, self.inner = ids, inner
        self.head, self.tail = (len(ids) if x is None else x for x in (head, tail))


class Encoder:
    def __init__(self, model: bytes):
        spec = json.loads(model)
        self.library = Tokenizer.from_str(model.decode())
        self.library.no_truncation()
        self.library.no_padding()
        split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.specials = [t["content"] for t in added]
        self.known: dict[str, bytes] = {}
        #: Whether texts can be cut as said above; else they are encoded whole.
        self.cuts = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not spec["model"].get("ignore_merges")
            and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        letters, size = _letters(), self.library.get_vocab_size()
        words = [self.library.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode() for w in words]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.flat, self.starts = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.lengths) - self.lengths
        self.decimals = pa.array([str(i) for i in range(size)])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def runs(self, segment: str) -> list[tuple[bool, str]]:
        """What the pattern splits a segment into; true for those that are no special token."""
        if not self.specials:
            return [(True, segment[a:b]) for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(segment)]
        out = []
        for k, part in enumerate(re.split("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")", segment)):
            out += [(False, part)] if k % 2 else [(True, part[a:b]) for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)] if part else []
        return out

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of texts, one text's after another's, and where each text's begin and end."""
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_buffer()
        data = np.frombuffer(whole, np.uint8)
        at = np.flatnonzero(data == 32)
        at = at[at > 2] if len(at) else at
        a, b, c = data[at - 1], data[at - 2], data[at - 3]
        # characters of more bytes that count as blanks: U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000
        wide = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
        wide |= (c == 0xE2) & ((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)) | (b == 0x81) & (a == 0x9F))
        at = at[(a > 32) & (a != 127) & ~((a >= 128) & wide)]
        starts = np.unique(np.concatenate([ends[:-1][np.diff(ends) > 0], at]))
        out = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), whole])
        return out, np.searchsorted(starts, ends)

    def distinct(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, as bytes."""
        new = [s for s in segments if s not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known = {}
            new = segments
        short = [s for s in new if len(s) <= LONG]
        for s, ids in zip(short, self.batch(short), strict=True):
            self.known[s] = ids.tobytes()
        long = [s for s in new if len(s) > LONG]
        found = dict(zip(long, self.halved(long), strict=True))
        return [found[s].tobytes() if s in found else self.known[s] for s in segments]

    def halved(self, segments: list[str]) -> list[np.ndarray]:
        """Ids of long segments: runs of them that are long too go by halves."""
        runs = [self.runs(s) for s in segments]
        flat = [r for own in runs for r in own]
        rows = [_pieces(r, LONG // 2) if free_ and len(r) > LONG else [r] for free_, r in flat]
        coded = iter(self.batch([p for row in rows for p in row]))
        trees = [[Node(next(coded), True) for _ in row] for row in rows]
        while any(len(t) > 1 for t in trees):
            pairs = [(t[k], t[k + 1]) for t in trees for k in range(0, len(t) - 1, 2)]
            met = iter(self.joined(pairs))
            trees = [[next(met) if k + 1 < len(t) else t[k] for k in range(0, len(t), 2)] for t in trees]
        ids = iter([t[0].ids for t in trees])
        return [np.concatenate([next(ids) for _ in own]) for own in runs]

    def joined(self, pairs: list[tuple[Node, Node]]) -> list[Node]:
        """Neighbours that meet inside a run, as one."""
        out: list[Node | None] = [None] * len(pairs)
        todo = [(k, self._window(*pair, WINDOW, WINDOW)) for k, pair in enumerate(pairs)]
        while todo:
            coded, rest = self.batch([text for _, (_, _, text) in todo]), []
            for (k, (i, j, _)), ids in zip(todo, coded, strict=True):
                left, right = pairs[k]
                if (i == left.tail or ids[0] == left.ids[-i]) and (j == right.head or ids[-1] == right.ids[j - 1]):
                    ids = np.concatenate([left.ids[len(left.ids) - left.tail : len(left.ids) - i], ids, right.ids[j : right.head]])
                    whole = np.concatenate([left.ids[: len(left.ids) - left.tail], ids, right.ids[right.head :]])
                    out[k] = Node(whole, left.inner and right.inner, len(ids) if left.inner else left.head, len(ids) if right.inner else right.tail)
                else:
                    rest.append((k, self._window(left, right, 2 * i, 2 * j)))
            todo = rest
        return out

    def _window(self, left: Node, right: Node, i: int, j: int) -> tuple[int, int, str]:
        """About i ids of the left and j of the right, whole characters, and their text."""
        i, j = min(i, left.tail), min(j, right.head)
        while True:
            data = b"".join(self.bytes[x] for x in chain(left.ids[len(left.ids) - i :], right.ids[:j]))
            try:
                return i, j, data.decode()
            except UnicodeDecodeError:
                assert i < left.tail or j < right.head
                i, j = min(i + 1, left.tail), min(j + 1, right.head)

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one text's after another's, and where each text's begin and end."""
        texts = pc.fill_null(texts, "")
        if not self.cuts:
            ids = self.batch(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        segments, ends = self.segments(texts)
        coded = segments.dictionary_encode()
        rows = self.distinct(coded.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in rows], np.int64)
        ids, codes = np.frombuffer(b"".join(rows), np.int32), coded.indices.to_numpy(zero_copy_only=False)
        each, starts = size[codes], (np.cumsum(size) - size)[codes]
        before = np.cumsum(each)
        total = int(before[-1]) if len(before) else 0
        return ids[np.repeat(starts - (before - each), each) + np.arange(total)], np.concatenate([[0], before])[ends]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The texts of runs of ids, in UTF-8."""
        size = self.lengths[ids]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        data = self.flat[np.repeat(self.starts[ids] - (after - size), size) + np.arange(total)].tobytes()
        at = np.concatenate([[0], after])[ends]
        return [_utf8(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """DIGEST of runs of ids."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.decimals.take(pa.array(ids))), ",")
        sha = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
        return pa.StructArray.from_arrays([pa.array(np.diff(ends), pa.int64()), sha(joined.cast(pa.binary()).to_pylist()), sha(self.decoded(ids, ends))], ["n_tokens", "ids_sha256", "decoded_sha256"])

    def parts(self, text: str) -> list[tuple[bool, bool, str]]:
        """A long text's parts: whether one goes on inside the run of the one before, and whether it lies in one run."""
        out: list[tuple[bool, bool, str]] = []
        pending: list[str] = []
        size = 0

        def close() -> None:
            nonlocal size
            if pending:
                out.append((False, False, "".join(pending)))
                pending.clear()
                size = 0

        for segment in self.segments(pa.array([text]))[0].to_pylist():
            for free_, run in self.runs(segment) if len(segment) > PART else [(True, segment)]:
                if free_ and len(run) > PART:
                    close()
                    out += [(k > 0, True, p) for k, p in enumerate(_pieces(run, PART))]
                    continue
                pending.append(run)
                size += len(run)
                if size > PART:
                    close()
        close()
        return out


def _pieces(text: str, most: int) -> list[str]:
    return [text[k : k + most] for k in range(0, len(text), most)]


def _utf8(data: bytes) -> bytes:
    try:
        data.decode()
    except UnicodeDecodeError:
        return data.decode(errors="replace").encode()
    return data


@lru_cache(2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _nodes(e: Encoder, rows: list[dict]) -> list[Node]:
    return [Node(np.frombuffer(r["ids"], np.int32), r["inner"], r["head"], r["tail"]) for r in rows]


def _tree(long: DataFrame, shared) -> DataFrame:
    """(text_key, ids) of long texts (text_key, text), each once."""
    parts = "text_key string, at int, joins boolean, inner boolean, part string"
    schema, out = arrow_schema(NODE), arrow_schema(parts)

    def cut(batches):
        e = _encoder(shared.value)
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                rows = e.parts(text.as_py())
                if rows:
                    joins, inner, part = zip(*rows, strict=True)
                    yield batch(out, [key.as_py()] * len(rows), np.arange(len(rows), dtype=np.int32), joins, inner, part)

    def leaves(batches):
        e = _encoder(shared.value)
        for b in batches:
            for i, j in steps(b.column(4)):
                own = b.slice(i, j - i)
                ids, ends = e.encoded(own.column(4))
                size = np.diff(ends).astype(np.int32)
                yield batch(schema, *own.columns[:4], size, size, blobs(ids, ends))

    def meet(table: pa.Table) -> pa.Table:
        e, rows = _encoder(shared.value), sorted(table.to_pylist(), key=lambda r: r["at"])
        nodes = _nodes(e, rows)
        if len(rows) == 2 and rows[1]["joins"]:
            one = e.joined([(nodes[0], nodes[1])])[0]
        elif len(rows) == 2:
            one = Node(np.concatenate([n.ids for n in nodes]), False, nodes[0].head, nodes[1].tail)
        else:
            one = nodes[0]
        return pa.Table.from_batches([batch(schema, [rows[0]["text_key"]], [rows[0]["at"] >> 1], [rows[0]["joins"]], [one.inner], [one.head], [one.tail], [one.ids.tobytes()])])

    # the parts of a text go to tasks of their own
    cuts = long.dropDuplicates(["text_key"]).mapInArrow(cut, parts).repartition("text_key", "at")
    nodes = written(cuts.mapInArrow(leaves, NODE), "bpe-parts")
    last = nodes.agg(F.max("at")).first()[0] or 0
    while last > 0:
        nodes, last = nodes.groupBy("text_key", F.shiftright("at", 1).alias("pair")).applyInArrow(lambda _, t: meet(t), NODE), last >> 1
    return nodes.select("text_key", "ids")


def _routed(df: DataFrame, model: str, text: str, into: str, kind: str, finish, big: int) -> DataFrame:
    """df with a column of finish(encoder, ids, ends): short texts in place, long ones by the tree."""
    shared = df.sparkSession.sparkContext.broadcast(_read(model))

    @F.arrow_udf(kind)
    def short(texts: pa.Array) -> pa.Array:
        e = _encoder(shared.value)
        out = [finish(e, *e.encoded(texts.slice(a, b - a))) for a, b in steps(texts, 4 << 20)]
        return pa.concat_arrays(out) if out else finish(e, np.zeros(0, np.int32), np.zeros(1, np.int64))

    @F.arrow_udf(kind)
    def long(rows: pa.Array) -> pa.Array:
        e = _encoder(shared.value)
        out = [finish(e, ids, np.array([0, len(ids)])) for ids in (np.frombuffer(r.as_py(), np.int32) for r in rows)]
        return pa.concat_arrays(out) if out else finish(e, np.zeros(0, np.int32), np.zeros(1, np.int64))

    names = [c for c in df.columns if c.lower() != into.lower()]
    (key,) = free(df, "text_key")
    size = F.coalesce(F.octet_length(text), F.lit(0))
    near = df.filter(size <= big).select(*names, short.asNondeterministic()(F.col(text)).alias(into))
    if not _encoder(shared.value).cuts:
        return df.select(*names, short.asNondeterministic()(F.col(text)).alias(into))
    far = df.filter(size > big)
    if far.isEmpty():
        return near
    keyed = F.sha2(F.col(text).cast("binary"), 256)
    coded = _tree(far.select(keyed.alias("text_key"), F.col(text).alias("text")), shared)
    coded = coded.select(F.col("text_key").alias("_key"), long.asNondeterministic()(F.col("ids")).alias("_out"))
    far = far.select(*names, keyed.alias(key)).join(coded, F.col(key) == F.col("_key")).select(*names, F.col("_out").alias(into))
    return near.union(far)


def digest(df: DataFrame, model: str, *, text: str = "text", into: str = "encoded", big: int = BIG) -> DataFrame:
    """df with a struct column of counts and digests. model: the tokenizer's file on the driver; its bytes go to the tasks."""
    return _routed(df, model, text, into, DIGEST, lambda e, ids, ends: e.digests(ids, ends), big)


def encode(df: DataFrame, model: str, *, text: str = "text", into: str = "ids", big: int = BIG) -> DataFrame:
    """df with an array<int> column of ids."""
    return _routed(df, model, text, into, "array<int>", lambda e, ids, ends: lists(ids, ends), big)


def decode(df: DataFrame, model: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text of an array<int> column; null decodes to the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(_read(model))

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        e = _encoder(shared.value)
        size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rows.flatten()
        good = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(e.bytes))), False).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(good)])[np.concatenate([[0], np.cumsum(size)])]
        return pa.array([x.decode() for x in e.decoded(pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)[good], ends)], pa.string())

    return df.withColumn(into, decoded.asNondeterministic()(F.col(ids)))
