"""SentencePiece encoding and decoding with offsets into the original bytes.

A text is normalised by longest-prefix match through the model's compiled character map, and each normalised byte keeps
the place of the original byte that it comes from; every piece is projected through that alignment to a span of the
original. Byte pieces of one character share its span: the last has it, those before it are empty.

No piece of the vocabulary goes on past a blank (checked when a model is loaded), so a text's encoding is that of its
blank-led segments, one after the other; each distinct segment of a batch is encoded once. A model that breaks this rule
is encoded whole text by whole text.

`digest` works on many texts at once: their characters go through the map together, the alignment is one array over all
normalised bytes, and the running sum of the pieces' sizes is where it is read.

Defined cases: null counts as the empty text, which has no pieces; texts of any length are encoded whole; repeated rows
and extra columns pass through, but a column named as the result is replaced; an unknown piece spans what the library makes
it stand for.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from residua.llm.common import steps

MARK = "▁"
DIGEST = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string, span_bytes: bigint, widest_span: bigint>"
OFFSETS = "array<struct<id: int, piece: string, begin: int, end: int>>"


class CharMap:
    """The compiled map: a double-array trie of byte strings whose values point to replacements. b'' maps nothing."""

    def __init__(self, compiled: bytes):
        self.units, self.texts = (), b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units, self.texts = struct.unpack_from(f"<{size // 4}I", compiled, 4), compiled[4 + size :]

    def longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix of data[start:] in the map."""
        if not self.units:
            return None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        at, found = step(self.units[0]), None
        for n, c in enumerate(data[start:], 1):
            at ^= c
            if at >= len(self.units) or (u := self.units[at]) & 0x800000FF != c:
                break
            at ^= step(u)
            if u >> 8 & 1:
                v = self.units[at] & 0x7FFFFFFF
                found = n, self.texts[v : self.texts.index(b"\0", v)]
        return found

    def longest_of(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """longest() at many starts together, each up to its stop: lengths (0: none), and where the replacements begin in
        texts."""
        size, value = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
        if not self.units or not len(starts):
            return size, value
        units = np.array(self.units, np.int64)
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        live, at, n = np.arange(len(starts)), np.full(len(starts), step(units[0])), 0
        while len(live):
            inside = starts[live] + n < stops[live]
            live, at = live[inside], at[inside]
            c = data[starts[live] + n].astype(np.int64)
            at = at ^ c
            u = units[np.minimum(at, len(units) - 1)]
            good = (at < len(units)) & (u & 0x800000FF == c)
            live, at, u = live[good], at[good] ^ step(u[good]), u[good]
            n += 1
            leaf = (u >> 8 & 1) > 0
            size[live[leaf]], value[live[leaf]] = n, units[at[leaf]] & 0x7FFFFFFF
        return size, value


class Encoder:
    def __init__(self, model: bytes):
        proto = pb.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.map, self.dummy, self.squeeze = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.plain = self.dummy and not self.squeeze and spec.escape_whitespaces
        raw = pb.ModelProto.FromString(model)  # the same pieces for text that is normalised already
        raw.normalizer_spec.CopyFrom(pb.NormalizerSpec(name="identity", add_dummy_prefix=True, remove_extra_whitespaces=False, escape_whitespaces=True))
        self.raw = sentencepiece.SentencePieceProcessor(model_proto=raw.SerializeToString())
        self.split = self.dummy and spec.escape_whitespaces and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes (blanks as marks, dummy prefix included) and the original offset of each, and of the end."""
        data, out, at, i = text.encode(), bytearray(), [], 0
        if not data:
            return b"", np.zeros(1, np.int64)
        mark = MARK.encode()

        def put(b: bytes, origin: int) -> None:
            for k in b:
                if k == 32:
                    if self.squeeze and (not out or out.endswith(mark)):
                        continue
                    out.extend(mark)
                    at.extend([origin] * 3)
                else:
                    out.append(k)
                    at.append(origin)

        if self.dummy and not self.squeeze:
            out += mark
            at += [0] * 3
        while i < len(data):
            n, b = self.map.longest(data, i) or (0, b"")
            if not n:
                n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                b = data[i : i + n]
            put(b, i)
            i += n
        if self.squeeze:
            while out.endswith(mark):
                del out[-3:], at[-3:]
            if self.dummy and out:
                out[:0], at[:0] = mark, [at[0]] * 3
        return bytes(out), np.array([*at, len(data)], np.int64)

    def _segments(self, marked: str) -> list[str]:
        """Segments of a marked text without the first mark of each, in the form that the library takes."""
        return [x[1:].replace(MARK, " ") for x in re.findall(f"{MARK}+[^{MARK}]*", marked)]

    def _ids(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments; one of a mark alone is that piece (the library takes it for an empty text)."""
        alone = [self.raw.piece_to_id(MARK)]
        return [x or alone for x in self.raw.encode(segments, num_threads=1)]

    def offsets(self, text: str | None) -> list[dict]:
        """Pieces of a text with ids and spans of original bytes."""
        normal, at = self.normalise(text or "")
        if not normal:
            return []
        marked = normal.decode()
        ids = [i for s in self._ids(self._segments(marked)) for i in s] if self.split else self.library.encode(text)
        held = iter(self._unknown(text, ids))
        out, place, pending = [], 0, b""
        for i in ids:
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                pending += bytes([int(piece[3:5], 16)])
                whole = normal[place : place + len(pending)]
                size = len(pending) if _complete(pending) else 0
                assert pending == whole
            else:
                size = len(piece.encode()) if not self.library.is_unknown(i) else next(held)
            end = place + size
            out.append({"id": i, "piece": piece, "begin": int(at[place]), "end": int(at[end])})
            if size:
                place, pending = end, b""
        return out

    def _unknown(self, text: str, ids: list[int]) -> list[int]:
        """Normalised bytes of each unknown piece."""
        if not any(self.library.is_unknown(i) for i in ids):
            return []
        return [len(p.piece.encode()) for p in self.library.encode(text, out_type="immutable_proto").pieces if self.library.is_unknown(p.id)]

    def normalised(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Many texts normalised, with blanks as they are (a mark counts as one), and the alignment: for each byte of a
        leading blank and the text, of one text after the other, the place in all original bytes; the end comes last."""
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_buffer(), np.uint8)
        starts = np.flatnonzero(data & 0xC0 != 0x80).astype(np.int32)  # characters
        width = np.diff(np.append(starts, np.int32(len(data))))
        size, value = self.map.longest_of(data, starts, ends[np.searchsorted(ends, starts, "right")])
        marks = (width == 3) & (data[starts] == 0xE2)
        marks[marks] = (data[starts[marks] + 1] == 0x96) & (data[starts[marks] + 2] == 0x81)
        full = np.flatnonzero(np.diff(ends))  # the others get no leading blank
        if not size.any() and not marks.any():  # every character stands for itself
            return texts, np.append(np.insert(np.repeat(starts, width), ends[full], ends[full]), np.int32(len(data)))
        stays, until = np.ones(len(starts), bool), 0
        for k in np.flatnonzero(size > width):  # a match of several characters covers those after its first
            if starts[k] >= until:
                until = starts[k] + size[k]
                stays[k + 1 : np.searchsorted(starts, until)] = False
        starts, width, size, value, marks = starts[stays], width[stays], size[stays], value[stays], marks[stays]
        tail = np.frombuffer(self.map.texts, np.uint8)
        zeros = np.flatnonzero(tail == 0)
        long = np.where(size > 0, zeros[np.searchsorted(zeros, value)] - value, width) if len(zeros) else width
        origin_of = np.where(size > 0, len(data) + value, starts)
        long, origin_of = np.where((size == 0) & marks, 1, long), np.where((size == 0) & marks, len(data) + len(tail), origin_of)
        every = np.concatenate([data, tail, np.array([32], np.uint8)])
        total = np.cumsum(long)
        out = every[np.repeat(origin_of - (total - long), long) + np.arange(total[-1] if len(total) else 0)]
        origin = np.repeat(starts, long)
        cut = np.concatenate([[0], total])[np.searchsorted(starts, ends)]  # normalised bytes before each text
        origin = np.append(np.insert(origin, cut[full], ends[full]), len(data))
        texts = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(out)])
        return texts, origin

    def digests(self, texts: pa.Array) -> pa.Array:
        """DIGEST of each text: ids in decimal joined by commas, the decoded text, and the pieces' spans."""
        texts = pc.fill_null(texts, "")
        if not (self.plain and self.split and self.bytes_):
            return self._whole(texts.to_pylist())
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        texts, origin = self.normalised(texts)
        rough = pc.match_substring_regex(texts, "^ | $|  ")
        if pc.any(rough).as_py():
            mine, rows = rough.to_pylist(), texts.to_pylist()
            parts = [self._segments(MARK + t.replace(" ", MARK)) if r else t.split(" ") for t, r in zip(rows, mine, strict=True)]
            parts = pa.array(parts, pa.list_(pa.string()))
        else:
            parts = pc.split_pattern(texts, " ")
        many = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = parts.flatten()
        if empty.any():  # an empty text has no segment
            flat, many = flat.filter(pa.array(np.repeat(~empty, many))), np.where(empty, 0, many)
        coded = flat.dictionary_encode()
        n, ids, joined, back = self._encoded(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(many)])
        text_of = lambda xs, sep: pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), xs.take(coded.indices)), sep)
        each = n[codes]
        starts = np.concatenate([[0], np.cumsum(n)])[codes]
        before = np.cumsum(each)
        tokens = ids[np.repeat(starts - (before - each), each) + np.arange(before[-1] if len(each) else 0)]
        spans = np.diff(origin[np.concatenate([[0], np.cumsum(self._surfaces()[1][tokens])])])
        assert spans.sum() == origin[-1], "pieces must cover their texts"
        at = np.concatenate([[0], before])[ends]
        sums = np.concatenate([[0], np.cumsum(spans)])
        full = np.flatnonzero(np.diff(at))
        widest = np.zeros(len(empty), np.int64)
        if len(full):
            widest[full] = np.maximum.reduceat(spans, at[:-1][full])
        sha = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs.cast(pa.binary()).to_pylist()]
        return _digest(np.diff(at), sha(text_of(joined, ",")), sha(text_of(back, " ")), np.diff(sums[at]), widest)

    def _encoded(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
        """Of each segment: its number of ids, the ids one after the other, in decimal with commas, and the decoded text."""
        segments = distinct.to_pylist()
        coded = self._ids(segments)
        n = np.array([len(x) for x in coded], np.int64)
        flat = list(chain.from_iterable(coded))
        ids = np.array(flat, np.int32)
        back = distinct
        if self.raw.decode(flat) != " ".join(segments):  # one call decodes them all
            back = pa.array([self.raw.decode(x) for x in coded], pa.string())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), self._surfaces()[0].take(pa.array(ids))), ",")
        return n, ids, joined, back

    @cached_property
    def bytes_(self) -> bool:
        """Whether every byte is a piece, so that no text has unknown ones."""
        return any(self.library.is_byte(i) for i in range(self.library.get_piece_size()))

    @lru_cache(1)  # noqa: B019
    def _surfaces(self) -> tuple[pa.Array, np.ndarray]:
        """Of each id: its decimal form, and the normalised bytes that it covers, a mark counted as one."""
        sp = self.library
        every = range(sp.get_piece_size())
        return pa.array([str(i) for i in every]), np.array([1 if sp.is_byte(i) else len(sp.id_to_piece(i).replace(MARK, " ").encode()) for i in every], np.int32)

    def _whole(self, texts: list[str]) -> pa.Array:
        found = [self.offsets(t) for t in texts]
        ids = [[p["id"] for p in f] for f in found]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return _digest(np.array([len(x) for x in ids]), [sha(",".join(map(str, x))) for x in ids], [sha(self.library.decode(x)) for x in ids], *(np.array([g((p["end"] - p["begin"] for p in f), **o) for f in found], np.int64) for g, o in ((sum, {}), (max, {"default": 0}))))


def _complete(b: bytes) -> bool:
    n = 1 if b[0] < 0x80 else 2 if b[0] < 0xE0 else 3 if b[0] < 0xF0 else 4
    return len(b) >= n


def _digest(n, ids, decoded, spans, widest) -> pa.Array:
    columns = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string()), "span_bytes": pa.array(spans, pa.int64()), "widest_span": pa.array(widest, pa.int64())}
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


@lru_cache(2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def digest(df: DataFrame, model: str, *, text: str = "text", into: str = "encoded") -> DataFrame:
    """df with a struct column of counts and digests. model: the model file on the driver; its bytes go to the tasks."""
    shared = df.sparkSession.sparkContext.broadcast(_read(model))

    @F.arrow_udf(DIGEST)
    def encoded(texts: pa.Array) -> pa.Array:
        e = _encoder(shared.value)
        out = [e.digests(texts.slice(a, b - a)) for a, b in steps(texts, 4 << 20)]
        return pa.concat_arrays(out) if out else _digest([], [], [], [], [])

    return df.withColumn(into, encoded.asNondeterministic()(F.col(text)))


def encode(df: DataFrame, model: str, *, text: str = "text", into: str = "pieces") -> DataFrame:
    """df with an array column of pieces: id, piece, and the span [begin, end) in the UTF-8 bytes of the text."""
    shared = df.sparkSession.sparkContext.broadcast(_read(model))

    @F.arrow_udf(OFFSETS)
    def encoded(texts: pa.Array) -> pa.Array:
        e = _encoder(shared.value)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("piece", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
        return pa.array([e.offsets(t) for t in texts.to_pylist()], kind)

    return df.withColumn(into, encoded.asNondeterministic()(F.col(text)))


def decode(df: DataFrame, model: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text of an array<int> column; null decodes to the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(_read(model))

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        return pa.array(_encoder(shared.value).library.decode([x or [] for x in rows.to_pylist()]), pa.string())

    return df.withColumn(into, decoded.asNondeterministic()(F.col(ids)))
