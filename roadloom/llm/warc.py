"""WARC archives: a writer with payload de-duplication and a reader that splits one file over many tasks.

Every record is one gzip member. The reader cuts files into byte ranges; a task looks for gzip magic in its range, decodes
the candidate's first bytes and accepts it if a WARC header comes out, and owns the records that start inside its range
(it reads beyond the end to finish the last one). Storage is reached through pyarrow.fs, by URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.functions.shared import scratch_path
from roadloom.llm.words import lean

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
RECORD = T.StructType([
    T.StructField("target_uri", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("intact", T.BooleanType()),
])


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_bytes(uri, record_id, record_type, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One gzip member: WARC header, HTTP header with the full payload's length, and for a response the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2020-01-01T00:00:00Z",
        "WARC-Target-URI: " + (uri or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def record_id(key: str | None, digest: str) -> str:
    """Of the key; rows that share a key share the id, and their payload digests tell them apart. A null key's is of the payload."""
    from urllib.parse import quote

    return f"urn:nokey:{digest}" if key is None else f"urn:page:{quote(key, safe='')}"


def record_key(record_id: Column) -> Column:
    """The key in a record id as text; null if it has none."""
    return F.url_decode(F.regexp_extract(F.when(F.startswith(record_id, F.lit("urn:page:")), record_id), "^urn:page:(.*)$", 1))


def plan_revisits(records: DataFrame, key: str, payload: str, min_bytes: int = 0, salts: int = 16) -> DataFrame:
    """records plus payload_digest (base32 SHA-1 of the UTF-8 payload; null: empty) and response_key.

    Of equal payloads of at least min_bytes the largest key is the response and response_key names it in every row;
    smaller payloads and rows with null keys stand alone (response_key is their own key). Rows that repeat the response's
    key and payload are responses too. An empty table gives an empty one; other columns stay. The group's key is joined
    back on a salted digest, so copies of one payload are spread over `salts` tasks.
    """
    r = records.withColumn("_sha1", F.sha1(F.coalesce(F.col(payload), F.lit("")).cast("binary")))
    size = F.octet_length(F.coalesce(F.col(payload), F.lit("")))
    r = r.withColumn("_size", size.cast("long")).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    groups = (
        r.where(F.col(key).isNotNull() & (F.col("_size") >= min_bytes)).groupBy("_sha1").agg(F.max(key).alias("_top"), F.count("*").alias("_n"))
        .where("_n > 1").select("_sha1", "_top").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    out = r.join(groups, ["_sha1", "_salt"], "left")
    own = F.col(key).isNull() | (F.col("_size") < min_bytes) | F.col("_top").isNull()
    return out.withColumn("response_key", F.when(own, F.col(key)).otherwise(F.col("_top"))).drop("_salt", "_top", "_sha1", "_size")


def write_warc(planned: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """Write one archive per task under path; returns (file, records, bytes). planned: see plan_revisits.

    A task writes to a name of its own and renames at its end, so a lost or repeated task leaves no half file under
    the final name; only the files that the returned rows name count. Empty input writes nothing.
    """
    cols = [F.col(key).cast("string").alias("k"), F.col(uri).cast("string").alias("u"), F.col(payload).cast("string").alias("p"), F.col("response_key").cast("string").alias("t")]

    def write(batches):
        import pyarrow as pa

        fs, root = _fs(path)
        out, tmp, n, size = None, None, 0, 0
        for part in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):  # few payloads at a time as Python texts
            for k, u, p, t in zip(*(c.to_pylist() for c in part.columns)):
                if out is None:
                    name = uuid.uuid4().hex
                    tmp, final = f"{root}/_tmp-{name}", f"{root}/part-{name}.warc.gz"
                    out = fs.open_output_stream(tmp)
                body = (p or "").encode()
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                first = t == k
                rec = record_bytes(u, record_id(k, digest), "response" if first else "revisit", body, digest, None if first else record_id(t, digest))
                out.write(rec)
                n, size = n + 1, size + len(rec)
        if out is not None:
            out.close()
            fs.move(tmp, final)
            yield pa.RecordBatch.from_pydict({"file": [final], "records": [n], "bytes": [size]}, schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    fs, root = _fs(path)
    fs.create_dir(root, recursive=True)
    return planned.select(*cols).mapInArrow(lean(write), "file string, records long, bytes long")


def parse_record(raw: bytes, file: str, offset: int):
    """A record's fields (see RECORD), or None if raw doesn't hold one whole WARC record.

    A response's digest and length are those of the payload read; intact tells whether the headers say the same. A revisit
    has no payload: they are its headers', and intact is null."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        return None
    h = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]))
    block = rest[: int(h.get("content-length", 0))]
    http, sep, body = block.partition(b"\r\n\r\n")
    length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), len(body))
    strip = lambda x: x.strip("<>") if x is not None else None
    digest, intact = (h.get("warc-payload-digest") or "").rpartition(":")[2], None
    if h.get("warc-type") != "revisit":
        read = base64.b32encode(hashlib.sha1(body).digest()).decode()
        intact, digest, length = (read, len(body)) == (digest, length), read, len(body)
    return (h.get("warc-target-uri"), h.get("warc-type"), strip(h.get("warc-record-id")), strip(h.get("warc-refers-to")), digest, length, body, file, offset, intact)


class _Window:
    """Bytes of a file from `base` on, read once and in order, `chunk` at a time."""

    def __init__(self, read_at, size: int, base: int, chunk: int):
        self.read_at, self.size, self.base, self.chunk, self.buf = read_at, size, base, chunk, bytearray()

    def more(self) -> bool:
        at = self.base + len(self.buf)
        if at >= self.size:
            return False
        self.buf += self.read_at(at, min(self.chunk, self.size - at))
        return True

    def drop_before(self, pos: int) -> None:
        if pos - self.base >= self.chunk:
            del self.buf[: pos - self.base]
            self.base = pos


def owned_records(read_at, size: int, start: int, end: int, file: str = "", chunk: int = CHUNK):
    """Records of a file whose first byte lies in [start, end). read_at(offset, n) gives bytes; each byte is read once."""
    win, pos = _Window(read_at, size, start, chunk), start
    while pos < min(end, size):
        win.drop_before(pos)
        at = win.buf.find(MAGIC, pos - win.base)
        if at < 0:
            pos = max(pos, win.base + len(win.buf) - len(MAGIC) + 1)
            if not win.more():
                return
            continue
        pos = win.base + at
        if pos >= end:
            return
        raw, used = _member(win, at)
        rec = parse_record(raw, file, pos) if raw is not None else None
        if rec is not None:
            yield rec
        pos += 1 if rec is None else used


def _member(win: _Window, at: int, step: int = 1 << 14):
    """(decoded bytes, compressed length) of the gzip member at `at` of the window, or (None, 0); gives up as soon as no WARC
    header comes."""
    z, out, nxt, head = zlib.decompressobj(31), [], at, b""
    try:
        while not z.eof:
            if nxt == len(win.buf) and not win.more():
                return None, 0
            piece = bytes(win.buf[nxt : nxt + step])
            nxt += len(piece)
            out.append(z.decompress(piece))
            if len(head) < 5:
                head = (head + out[-1][:5])[:5]
                if not b"WARC/".startswith(head):
                    return None, 0
        return b"".join(out), nxt - len(z.unused_data) - at
    except zlib.error:
        return None, 0


def read_warc(files: DataFrame, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Records of the archives that files names (file, bytes), by byte ranges of split_bytes: see RECORD."""
    spark = files.sparkSession
    parts = max(1, spark.sparkContext.defaultParallelism)
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))

    def scan(batches):
        import pyarrow as pa

        fs, _ = _fs(path)
        schema = pa.schema([("target_uri", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("intact", pa.bool_())])
        for b in batches:
            for file, size, start in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(file) as f:
                    held, held_bytes = [], 0
                    for rec in owned_records(lambda o, n: f.read_at(n, o), size, start, start + split_bytes, file):
                        held.append(rec)
                        held_bytes += len(rec[6])
                        if held_bytes > 8 << 20 or len(held) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
                            held, held_bytes = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

    return ranges.repartition(parts * 2, "file", "start").mapInArrow(lean(scan), RECORD)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, and report each page's record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = scratch_path(spark, "warc")
    files = write_warc(plan_revisits(pages, "page_id", "html"), path)
    listing = scratch_path(spark, "warc-files")
    files.write.parquet(listing)
    back = read_warc(spark.read.parquet(listing), path)
    kind = pages.schema["page_id"].dataType
    key = lambda c: record_key(F.col(c)).cast(kind).alias("page_id" if c == "record_id" else c)
    return back.select(key("record_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to"))
