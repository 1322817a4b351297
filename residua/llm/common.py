"""Shared helpers of the corpus operators: scratch tables, Arrow batches and vectorised word handling."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step works on; it bounds the memory of a Python worker.
STEP_BYTES = 2 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, as the cluster names it, or the
    warehouse where it names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and lost executors take nothing with them."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has: each of names, with underscores in front as needed."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """True for the fold that no model learns from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text each; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def sliced(rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text", most: int = STEP_BYTES):
    """A function for mapInArrow that gives rows() short slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(batch.column(batch.schema.get_field_index(text)), most):
                out = rows(batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out

    return run


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words [^\\x20\\x09-\\x0D]+ of texts (null: none): a code per word, offsets by row, and the distinct words."""
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
    split = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    if (empty := pc.equal(texts, "").to_numpy(zero_copy_only=False)).any():
        flat = flat.filter(pc.not_equal(flat, ""))
        counts[empty] = 0
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(counts)]), coded.dictionary


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string; the same on every executor."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x, seed) for x in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    return x * np.uint64(0x81DADEF4BC2DD44D)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of every n neighbours in h, by doubling: log2(n) passes."""
    out, done = None, 0
    block, size = h, 1
    while True:
        if n & size:
            if out is None:
                out, done = block, size
            else:  # the block follows what is done
                m = len(h) - done - size + 1
                if m <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:m] * _power(size) + block[done : done + m]
                done += size
        if size * 2 > n:
            return mixed(out)
        m = len(h) - 2 * size + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        block = block[:m] * _power(size) + block[size : size + m]
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(ODD), n, 1 << 64))


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of fixed-width values as binary; offsets count values."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
