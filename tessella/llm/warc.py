"""WARC archives as seekable Zstandard bundles.

A bundle file is a row of independent Zstandard frames, each holding whole
WARC records, then a seek table in a skippable frame (the public seekable
format: magic, size, ``(compressed, decompressed)`` per frame, footer).  The
index maps each record to its bundle, frame and offset within the frame, so a
record is read by decompressing one frame.

Records are written where their rows stand, without moving payloads.  A file
is named for its partition and task attempt and never written again.  The index
is committed by Spark with the attempt that wrote it, so it always names whole
files, whatever executors are lost; files of other attempts are in no index.

Null html is the empty payload, null url the empty target.  Equal payloads of
at least ``least`` bytes are stored once, in the record with the largest id;
the others are revisits without payload.  Rows that repeat that id and payload
are responses too.  Rows without an id take part as revisits, or as responses
where no row with an id has their payload.

A record's id is made of its place (task, frame, offset), so rows that repeat a
page or have none still have ids of their own; the page's own number stands in
an extension field.  A revisit names the page and the target that it repeats.
"""

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, scratch, shared_uri, slices, table

# The seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME, BUNDLE = 1 << 20, 64 << 20
LEAST = 1000
#: Duplicate payloads are joined by broadcast up to so many rows, by shuffle beyond; there, rows of one payload (or of none) are dealt to so many tasks.
SMALL, SALTS = 50_000, 32
#: Frames that a task reads.
READ = 16
#: The date of records of pages without one.
NO_DATE = "1970-01-01T00:00:00Z"


def record(kind: str, place: str, page_id, url: str, payload: bytes, digest: str, refers_to=None, refers_url: str = "", date: str = NO_DATE) -> bytes:
    """One WARC record, named by its place; a revisit has no block."""
    one_line = lambda x: "".join(x.splitlines())
    block = payload if kind == "response" else b""
    name = uuid.uuid5(uuid.NAMESPACE_URL, place)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Target-URI: {one_line(refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: bytes, at: int = 0):
    """``(headers, block, end)`` of the record at an offset."""
    stop = frame.index(b"\r\n\r\n", at)
    first, *lines = frame[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    end = stop + 4 + int(headers["Content-Length"])
    return headers, frame[stop + 4 : end], end + 4


def seek_table(frames: list) -> bytes:
    """The skippable frame that ends a bundle; ``frames``: (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(data) -> list:
    """``(offset, compressed, decompressed)`` of each frame, from the seek table of an open random-access file."""
    size = data.size()
    count, flags, magic = struct.unpack("<IBI", data.read_at(9, size - 9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    body = data.read_at(count * entry, size - 9 - count * entry)
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", body, i * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def _write(folder: str, date: str):
    def run(batches):
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        packer, state = zstandard.ZstdCompressor(level=3, write_content_size=True), {}

        def begin(seq):
            state.update(path=f"{base}/bundle-{part:06d}-{seq:04d}-{attempt}.warc.zst", frames=[], size=0, plain=[], plain_size=0, seq=seq)
            state["out"] = store.open_output_stream(state["path"], compression=None)  # frames are made here

        def frame():
            if state["plain"]:
                packed = packer.compress(b"".join(state["plain"]))
                state["out"].write(packed)
                state["frames"].append((len(packed), state["plain_size"]))
                state.update(size=state["size"] + len(packed), plain=[], plain_size=0)

        def end():
            frame()
            state["out"].write(seek_table(state["frames"]))
            state.pop("out").close()

        for batch in slices(batches, 256):
            index = []
            for page, url, html, keep, keep_url in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if "out" not in state:
                    begin(state.get("seq", -1) + 1)
                payload = (html or "").encode()
                kind = "response" if keep is None or keep == page else "revisit"
                place = f"{state['path']}/{len(state['frames'])}/{state['plain_size']}"
                data = record(kind, place, page, url or "", payload, hashlib.sha1(payload).hexdigest(), keep, keep_url or "", date)
                index.append((page, state["path"], len(state["frames"]), state["plain_size"]))
                state["plain"].append(data)
                state["plain_size"] += len(data)
                if state["plain_size"] >= FRAME:
                    frame()
                if state["size"] >= BUNDLE:
                    end()
            kinds, names = (pa.int64(), pa.string(), pa.int32(), pa.int64()), ["page_id", "bundle", "frame", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names=names)
        if "out" in state:
            end()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, date: str = NO_DATE) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as bundles; returns the index
    ``(page_id, bundle, frame, offset, folder)``, written beside them.

    ``folder``: a URI that driver and executors share; by default a new one in
    the shared folder.  ``date``: when the pages were fetched, in W3C form.  An
    empty table gives no bundle and an empty index.
    """
    spark = pages.sparkSession
    folder = shared_uri(spark, folder or fresh_path(spark, "warc"))
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"))
    big = F.octet_length("html") >= least
    digest = F.sha1(F.col("html").cast("binary"))
    with scratch(spark) as keep:
        last = F.max(F.struct("page_id", "url"))
        same = rows.where(big).select("page_id", "url", digest.alias("digest")).groupBy("digest").agg(last.alias("last"), F.count("*").alias("n")).where("n > 1")
        same = table(same.select("digest", F.col("last.page_id").alias("keep"), F.col("last.url").alias("keep_url")), "same-payloads")
        if same.count() <= SMALL:
            marked = rows.withColumn("digest", F.when(big, digest)).join(F.broadcast(same), "digest", "left")
        else:  # pages that are too small to be joined, and those of one payload, are spread
            salt = F.pmod(F.xxhash64("page_id", "url", F.spark_partition_id()), F.lit(SALTS))
            dealt = rows.withColumn("digest", F.when(big, digest).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))).withColumn("salt", salt)
            marked = dealt.join(same.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["digest", "salt"], "left")
        index = marked.select("page_id", "url", "html", "keep", "keep_url").mapInArrow(_write(folder, date), "page_id long, bundle string, frame int, offset long")
        return keep(index.withColumn("folder", F.lit(folder)), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """``(page_id, record_type, payload_bytes, payload_digest, refers_to, payload)`` of every indexed record.

    Each frame named in the index is read once, by its place in the seek table,
    and each record at its offset; a task reads about READ frames, in order, so a
    bundle's seek table is read once a task; lengths and digests of stored payloads are
    checked against the headers.
    """

    def run(batches):
        opened: dict = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for folder, bundle, frame, offsets in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if opened.get("bundle") != bundle:
                    data = fs.FileSystem.from_uri(folder)[0].open_input_file(bundle)
                    opened = {"bundle": bundle, "data": data, "frames": frames_of(data)}
                at, packed, plain = opened["frames"][frame]
                whole = unpack.decompress(opened["data"].read_at(packed, at), max_output_size=plain)
                for offset in offsets:
                    head, block, _ = parse(whole, offset)
                    kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if kind == "response" and (len(block) != size or hashlib.sha1(block).hexdigest() != digest):
                        raise ValueError(f"damaged record in {bundle}")
                    page, refers = (int(head[x]) if head.get(x) else None for x in ("X-Page-ID", "X-Refers-To-Page-ID"))
                    rows.append((page, kind, size, digest, refers, block.decode() if kind == "response" else None))
                if len(rows) >= 500:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)

    def emit(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    frames = index.groupBy("folder", "bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))  # the records of one frame
    tasks = -(-index.select("folder", "bundle", "frame").distinct().count() // READ)
    frames = frames.repartitionByRange(max(1, tasks), "folder", "bundle", "frame").sortWithinPartitions("folder", "bundle", "frame")
    return frames.mapInArrow(run, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string")
