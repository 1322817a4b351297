"""WARC archives as a chunked record table.

Writing: an archive row is a header and at most `segment` payload bytes, so an oversized payload becomes a record and its
continuation records (WARC-Segment-Number and WARC-Segment-Origin-ID). Rows end with the blank lines that end a WARC
record; Spark's text writer therefore writes the archives, gzip-compressed, to any store that it knows.

Reading: archives are read as a stream of short byte rows in file order. A small state machine follows the
Content-Length of each header and gives rows (record_id, chunk_no, chunk, bytes so far, SHA-1 so far): the digest is
carried on from chunk to chunk and from a record to its continuations, and no record is ever held whole. The row marked
last has the digest and length of the full payload.

Payloads are equal if their SHA-1 digests and lengths are; of equal ones of at least `least` bytes the record with the
largest id is the response and the others are revisits without payload.

Defined cases: a null payload is the empty one; a null url is written as urn:record:ID; blanks and line ends in a url are
percent-encoded; each row is a record, rows of one id too (each by its own payload; those of the largest id of a payload
are all responses); the name of a null id is urn:record:null, and it is the response only where no other id has its
payload; columns other than id, url and payload are not archived; an empty table gives an empty archive.

Archives of others are read as well: record names are strings as they stand there (without <>), `record_id` and
`refers_to` are the numbers of our own names and null for others. A continuation whose origin isn't the record before it
is a record of its own. Blocks of responses and revisits have a HTTP header of up to HEAD bytes, without which the whole
block is payload; resource and conversion records are payload; other types are passed over. Spark reads a file by lines: a
payload is held from one line feed to the next, so one without any (2 GB at most) is held as one row by the reader, though
not in chunks, digests or anything after it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.common import arrow_schema

#: Most bytes of a HTTP header.
HEAD = 64 << 10
CHUNKS = "name string, record_type string, refers_to_name string, record_id bigint, refers_to bigint, chunk_no int, chunk binary, bytes_so_far bigint, sha1_so_far string, last boolean, declared_digest string, declared_bytes bigint"
END = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 8 groups of 20 bits, 4 digits each."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deduplicated(records: DataFrame, least: int = 0) -> DataFrame:
    """records (id, url, payload binary) with name, size, digest, and refers_to: the response's id for a revisit, else null.
    Only ids and digests go through the grouping; payloads move once, dealt by id and digest."""
    rows = records.select("id", "url", "payload", F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("name"), base32_sha1(F.col("payload")).alias("digest"), F.length("payload").cast("long").alias("size"))
    keyed = rows.select("id", "name", "digest", "size")
    best = keyed.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1 and best is not null")
    refers = keyed.join(best, ["digest", "size"]).filter("id is null or id <> best").select("name", "digest", "size", F.col("best").alias("refers_to")).distinct()
    return rows.join(refers, ["name", "digest", "size"], "left")


def write(records: DataFrame, path: str, *, least: int = 0, segment: int = 1 << 20) -> None:
    """Writes records (id long, url string, payload binary) as gzip-compressed WARC archives."""
    records = records.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    rows = deduplicated(records, least)
    sent = F.when(F.col("refers_to").isNull(), F.col("size")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("sent", sent).withColumn("segments", F.greatest(F.lit(1), F.ceil(F.col("sent") / segment)).cast("int"))
    rows = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    part = F.when(F.col("sent") == 0, F.lit(b"")).otherwise(F.expr(f"substring(payload, (n - 1) * {segment} + 1, {segment})"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(F.col("n") == 1, F.concat(http, F.col("part").cast("string"))).otherwise(F.col("part").cast("string"))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:record:"), F.col("name"))), " ", "%20"), "\r", "%0D"), "\n", "%0A")
    kind = F.when(F.col("n") > 1, "continuation").when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    origin = F.concat(F.lit("<urn:record:"), F.col("name"), F.lit(">"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    many = F.col("segments") > 1
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", F.when(F.col("n") == 1, origin).otherwise(F.concat(F.lit("<urn:record:"), F.col("name"), F.lit(":"), F.col("n").cast("string"), F.lit(">")))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        field("WARC-Target-URI", url),
        F.when(F.col("n") == 1, F.concat(field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), field("X-Payload-Length", F.col("size")))).otherwise(F.lit("")),
        F.when(F.col("refers_to").isNotNull(), F.concat(field("WARC-Refers-To", F.concat(F.lit("<urn:record:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.when(many, field("WARC-Segment-Number", F.col("n"))).otherwise(F.lit("")),
        F.when(many & (F.col("n") > 1), field("WARC-Segment-Origin-ID", origin)).otherwise(F.lit("")),
        F.when(many & (F.col("n") == F.col("segments")), field("WARC-Segment-Total-Length", F.col("sent") + F.length(http))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        field("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    rows = rows.withColumn("part", part).withColumn("block", block)
    rows.select(F.concat(header, F.col("block")).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _number(name: str | None) -> int | None:
    """The id of one of our own names."""
    own = (name or "").removeprefix("urn:record:")
    return int(own) if own != name and own.lstrip("-").isdecimal() else None


class _Parser:
    """Follows the rows of archives; feed() gives chunk rows."""

    def __init__(self, most: int):
        self.most, self.need, self.head, self.state, self.record = most, 0, [], "between", None

    def feed(self, data: bytes) -> Iterator[tuple]:
        """data: the next bytes of a file, up to and with a line end."""
        while data:
            if self.state == "between":
                if data.strip(b"\r\n"):
                    self.state, self.head = "header", []
                else:
                    return
            if self.state == "header":
                line, data = data.rstrip(b"\r\n"), b""
                if line:
                    self.head.append(line.decode("utf-8", "replace"))
                    return
                yield from self._begin()
            elif self.state == "block":
                take, data = data[: self.need], data[self.need :]
                self.need -= len(take)
                yield from self._block(take)
                if not self.need:
                    self.state = "between"

    def _begin(self) -> Iterator[tuple]:
        field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in self.head[1:])}
        self.need, kind = int(field.get("content-length", 0)), field.get("warc-type", "")
        self.state = "block" if self.need else "between"
        named = lambda k: field.get(k, "").strip("<>") or None
        if kind == "continuation" and self.record and self.record["name"] == named("warc-segment-origin-id"):
            return  # it goes on with the record
        yield from self.close()
        if kind in ("response", "revisit", "resource", "conversion", "continuation"):
            refers = named("warc-refers-to") if kind == "revisit" else named("warc-segment-origin-id")
            self.record = {"name": named("warc-record-id"), "kind": kind, "refers": refers, "sha": hashlib.sha1(), "size": 0, "no": 0, "http": kind in ("response", "revisit"), "held": bytearray(), "digest": field.get("warc-payload-digest", "").removeprefix("sha1:") or None, "declared": int(field.get("x-payload-length", -1))}

    def _block(self, data: bytes) -> Iterator[tuple]:
        r = self.record
        if r is None:
            return
        if r["http"]:  # its header ends with an empty line
            r["held"] += data
            at = r["held"].find(END.encode())
            if at < 0 and len(r["held"]) < HEAD:
                return
            data, r["http"] = bytes(r["held"][at + 4 if at >= 0 else 0 :]), False
            r["held"].clear()
        r["held"] += data
        while len(r["held"]) >= self.most:
            chunk = bytes(r["held"][: self.most])
            del r["held"][: self.most]
            yield self._row(chunk, False)

    def _row(self, chunk: bytes, last: bool) -> tuple:
        r = self.record
        r["sha"].update(chunk)
        r["size"] += len(chunk)
        r["no"] += 1
        return r["name"], r["kind"], r["refers"], _number(r["name"]), _number(r["refers"]), r["no"] - 1, chunk, r["size"], base64.b32encode(r["sha"].digest()).decode(), last, r["digest"], r["declared"] if r["declared"] >= 0 else r["size"]

    def close(self) -> Iterator[tuple]:
        if self.record is not None:
            yield self._row(bytes(self.record["held"]), True)
            self.record = None


def read(spark: SparkSession, path: str, *, chunk_bytes: int = 64 << 10, with_chunks: bool = True) -> DataFrame:
    """CHUNKS rows of gzip-compressed archives (each file is one stream, so a record never meets a split)."""
    schema = arrow_schema(CHUNKS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, out, size = _Parser(chunk_bytes), [], 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        at = None
        for b in batches:
            files = b.column(1).to_pylist()
            for i, line in enumerate(b.column(0)):
                if files[i] != at:
                    out += parser.close()
                    parser, at = _Parser(chunk_bytes), files[i]
                for row in parser.feed(line.as_py() + b"\n"):
                    size += len(row[6])
                    out.append(row if with_chunks else (*row[:6], None, *row[7:]))
                    if size > 4 << 20 or len(out) >= 5000:
                        yield flush()
                        out, size = [], 0
        out += parser.close()
        if out:
            yield flush()

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    return lines.mapInArrow(rows, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record, from the chunk row that ends it. A revisit has the length and digest that its header names;
    others have those that their chunks added up to."""
    whole = F.col("record_type") != "revisit"
    return chunks.filter("last").select(
        "name", "record_id", "record_type", "refers_to", "refers_to_name",
        F.when(whole, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("sha1_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        (F.col("chunk_no") + 1).alias("n_chunks"),
        (~whole | F.col("declared_digest").isNull() | (F.col("declared_digest") == F.col("sha1_so_far"))).alias("digest_ok"),
    )
