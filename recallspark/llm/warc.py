"""WARC archives with a two-level capture index.

Archives are files of gzip members, one a record, written by the tasks into a shared folder. The index sorts the captures by
reversed-host url key into compressed blocks, which lie in index files, a range of keys each; a sparse directory has one
row a block. A lookup finds the index file by its range, the block by binary search in the file's directory,
the capture by binary search in the block, and then reads the record's byte range.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hinted, shared_dir, short_batches

#: Payloads of fewer bytes are never revisits.
LEAST_PAYLOAD = 100
#: Captures a block; blocks make an index file of this many captures or so.
BLOCK_LINES, FILE_LINES = 500, 200_000
#: Tasks that share the lookups of one index file.
SALTS = 4
NO_ID = -(1 << 63)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def surt(url: Column) -> Column:
    """Key of a url: reversed host, then the rest, as `org,example)/path?query`; lower-case A-Z in the host, no fragment; empty for null."""
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#:]*", 0))
    tail = F.regexp_extract(rest, r"^[^/?#:]*([^#]*)", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail), F.lit(""))


# --- records


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One gzip member. Control characters and spaces in the url are written as %XX."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    body = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target}')}>", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record; a response whose payload isn't that of its digest is an error."""
    plain = zlib.decompress(member, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    _, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"][7:] or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return fields, payload


# --- writing


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages (page_id, url, html) -> key, id, file, offset, length of every record, after writing them below folder (a uri).

    In urls malformed UTF-8 becomes U+FFFD; payloads are written byte by byte.
    A file has a name of its own for each attempt of a task; only those of finished tasks are in the result, so a repeated task does no harm.
    """
    p = short_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.make_valid_utf8(F.col("url").cast("string")).alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"").cast("binary")).alias("body"))
    p = p.withColumn("digest", F.sha2("body", 256))
    same = p.where(F.octet_length("body") >= LEAST_PAYLOAD).select("page_id", F.unhex("digest").alias("d"))
    groups = same.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = cut(same.join(groups, "d").where("first <> page_id OR page_id IS NULL").select(F.col("page_id").alias("again"), F.col("d").alias("d2"), "first").distinct())
    p = p.join(hinted(again), F.col("page_id").eqNullSafe(F.col("again")) & (F.unhex("digest") == F.col("d2")), "left").select("page_id", "url", surt(F.col("url")).alias("key"), "body", "digest", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        name, out, at = f"{top}/part-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, key, body, digest, first in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if out is None:
                    store.create_dir(top, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                revisit = first is not None
                member = record("revisit" if revisit else "response", page_id, url, digest, len(body), first, body)
                out.write(member)
                rows.append((key, NO_ID if page_id is None else page_id, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return cut(p.mapInArrow(work, "key string, id long, file string, offset long, length long"))


# --- index


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """The sparse directory (part, first_key, first_id, file, offset, length, n) of compressed blocks of sorted captures, after writing the blocks below folder."""
    parts = max(1, min(4000, -(-captures.count() // FILE_LINES)), captures.sparkSession.sparkContext.defaultParallelism)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        part = uuid.uuid4().hex
        name, out, at, lines = f"{top}/index-{part}", None, 0, []

        def flush():
            nonlocal out, at
            if out is None:
                store.create_dir(top, recursive=True)
                out = store.open_output_stream(name, compression=None)
            block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode())
            out.write(block)
            row = pa.RecordBatch.from_pydict({"part": [part], "first_key": [lines[0][0]], "first_id": [lines[0][1]], "file": [name], "offset": [at], "length": [len(block)], "n": [len(lines)]})
            at += len(block)
            lines.clear()
            return row

        for batch in batches:
            for x in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                # Captures with the same key and id stay in one block.
                if len(lines) >= BLOCK_LINES and lines[-1][:2] != list(x[:2]):
                    yield flush()
                lines.append(list(x))
        if lines:
            yield flush()
        if out is not None:
            out.close()

    ordered = captures.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    return cut(ordered.mapInArrow(work, "part string, first_key string, first_id long, file string, offset long, length long, n long"))


_FOUND = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def lookup(wanted: DataFrame, directory: DataFrame, payloads: bool = False) -> DataFrame:
    """wanted (key, id; distinct) -> page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of all captures with that key and id.

    Keys without captures give no row. payload is null unless asked for, and for revisits.
    """
    # One row an index file: at most 4000, or one for each core.
    bounds = sorted((r["k"].encode(), r["i"], r["part"]) for r in directory.groupBy("part").agg(F.min(F.struct("first_key", "first_id")).alias("x")).select("part", F.col("x.first_key").alias("k"), F.col("x.first_id").alias("i")).collect())
    starts, names = [x[:2] for x in bounds], [x[2] for x in bounds]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect.bisect_right(starts, (k.encode(), i)) - 1 for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([names[max(0, x)] if names else None for x in at], pa.string()), b.column(0), b.column(1)], names=["part", "key", "id"])

    asked = wanted.mapInArrow(place, "part string, key string, id long").where("part IS NOT NULL")
    salt = F.pmod(F.xxhash64("key", "id"), F.lit(SALTS)).cast("int")
    asked = asked.select("part", salt.alias("salt"), F.lit(1).alias("turn"), "key", "id", F.lit(None).cast("string").alias("file"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"))
    blocks = directory.select("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("turn"), F.col("first_key").alias("key"), F.col("first_id").alias("id"), "file", "offset", "length")
    # A set number of tasks: keys are short and the records that they stand for are not.
    tasks = max(1, min(len(names) * SALTS, 20_000))
    stream = blocks.unionByName(asked).repartition(tasks, "part", "salt").sortWithinPartitions("part", "salt", "turn", "key", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, files, now, heads, places, block_at, lines = None, {}, None, [], [], None, []
        rows, held = [], 0

        def read(name: str, offset: int, length: int) -> bytes:
            nonlocal store
            if store is None:
                store = opened(uri)[0]
            if name not in files:
                if len(files) > 200:
                    files.popitem()[1].close()
                files[name] = store.open_input_file(name)
            return files[name].read_at(length, offset)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

        for b in batches:
            for part, salt, turn, key, i, file, offset, length in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if (part, salt) != now:
                    now, heads, places, block_at = (part, salt), [], [], None
                want = (key.encode(), i)
                if turn == 0:
                    heads.append(want)
                    places.append((file, offset, length))
                    continue
                at = bisect.bisect_right(heads, want) - 1
                if at < 0:
                    continue
                if at != block_at:
                    lines = [((x[0].encode(), x[1]), x) for x in map(json.loads, zlib.decompress(read(*places[at])).decode().split("\n"))]
                    block_at = at
                k = bisect.bisect_left(lines, want, key=lambda x: x[0])
                while k < len(lines) and lines[k][0] == want:
                    fields, payload = parse(read(*lines[k][1][2:]))
                    kind = fields["WARC-Type"]
                    rows.append((int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][7:], kind, int(fields["X-Refers-To-Page"]) if kind == "revisit" else None, fields["WARC-Target-URI"], payload if payloads and kind == "response" else None))
                    held += len(payload) if payloads else 200
                    k += 1
                    if held > 8 << 20:
                        yield batch_of()
                        rows, held = [], 0
        if rows:
            yield batch_of()
        for f in files.values():
            f.close()

    uri = shared_dir(directory.sparkSession)
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    return stream.mapInArrow(work, kind)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive and its index, looks every page up and returns what its record says; the files are removed at the end.

    Null html is an empty payload, null urls have the empty key, and a null page_id comes back null. Of repeated rows each has its record, all alike.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    try:
        captures = write_archives(pages, folder)
        directory = build_index(captures, folder)
        return cut(lookup(captures.select("key", "id").distinct(), directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
