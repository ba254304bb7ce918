"""WARC archives of pages, normalised from monolithic gzip.

Writing: each task streams its records into gzip files that are one stream from end to end, the
form in which archives often come; a file is closed at ARCHIVE_BYTES, so its size is bounded.
Normalising: each such file is inflated once as a stream; every record is rewritten as a gzip
member of its own, and a sidecar index (offset, length, record id, one line a record) stands
beside the new file. Reading: members are cut out by the sidecar's offsets and inflated singly.

Files are written under a temporary name and renamed, under names that depend only on the rows, so
a task that runs again writes the same file. Of records with equal payloads of REVISIT_BYTES or
more the one with the largest page_id is the response, the others are revisits without payload.

Null html is an empty payload; a null page_id sorts below every other. Of repeated rows one is the
response. An empty table gives an empty result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import posixpath
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, drop_folder, fresh_path, stage, staging

REVISIT_BYTES = 1000
#: Uncompressed bytes after which an archive is closed. One record may exceed it.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
WHEN = "2000-01-01T00:00:00Z"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _put(store, path: str, data: bytes) -> None:
    """Whole or not at all: written beside, then renamed."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(beside) as out:
        out.write(data)
    store.move(beside, path)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record where refers_to is a tuple (page_id,)."""
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {WHEN}",
        f"WARC-Target-URI: {'' if url is None else ' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{'' if refers_to[0] is None else refers_to[0]}>",
        ]
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict, bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def stream_records(chunks):
    """Records of an inflated stream, one after another, holding no more than one and a chunk."""
    held = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        piece = next(chunks, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held:
                    raise ValueError("the archive ends within a record's header")
                return
        head = bytes(held[:cut])
        length = next(int(x[16:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length: "))
        whole = cut + 4 + length + 4
        while len(held) < whole:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(held[:whole])
        del held[:whole]


def inflate(data: bytes):
    """Pieces of a gzip file's content; further members are read on."""
    at = 0
    while at < len(data):
        engine = zlib.decompressobj(31)
        while not engine.eof:
            if at >= len(data):
                raise ValueError("the gzip stream is cut short")
            piece = engine.decompress(data[at : at + CHUNK])
            at += CHUNK
            if piece:
                yield piece
        at = min(at, len(data)) - len(engine.unused_data)


def _gzip(data: bytes) -> bytes:
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


def _attempt() -> int:
    """A number of this attempt at a task. It is part of the names of files, so an attempt that was lost leaves
    none under a name of the one that counts; the lists name only those of attempts that count."""
    from pyspark import TaskContext

    return TaskContext.get().taskAttemptId()


def _listed(spark: SparkSession, folder: str, only: DataFrame | None) -> DataFrame:
    """path, content of folder's archives, or of those in a list (name)."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    if only is None:
        return archives
    names = checked_broadcast(only.select(F.col("name").alias("_name")), 128)
    return archives.join(names, F.element_at(F.split("path", "/"), -1) == F.col("_name"), "left_semi")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages (row_id, page_id, url, html, refers) -> archives in folder; their list."""

    def write(frames):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        attempt = _attempt()
        first, size, out, engine = None, 0, io.BytesIO(), None
        done = []

        def close():
            out.write(engine.flush())
            name = f"pages-{first:020d}-{attempt}.warc.gz"
            _put(store, posixpath.join(base, name), out.getvalue())
            done.append((name, size))

        for frame in frames:
            for row in frame.itertuples(index=False):
                payload = (row.html or "").encode("utf-8", "surrogatepass")
                refers = None if not row.revisit else (None if pd.isna(row.refers) else int(row.refers),)
                data = record_bytes(
                    None if pd.isna(row.page_id) else int(row.page_id),
                    row.url,
                    payload,
                    hashlib.sha1(payload).hexdigest(),
                    refers,
                )
                if engine is None:
                    first, size, out, engine = row.row_id, 0, io.BytesIO(), zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(engine.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    engine = None
        if engine is not None:
            close()
        yield pd.DataFrame(done, columns=["name", "bytes"])

    return pages.mapInPandas(write, "name string, bytes long")


def normalise_archives(spark: SparkSession, folder: str, into: str, only: DataFrame | None = None) -> DataFrame:
    """Rewrite folder's *.warc.gz, or those in a list, record by record into the folder `into`; list of files and counts."""

    def rewrite(frames):
        store, base = _store(into)
        store.create_dir(base, recursive=True)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                out, index = io.BytesIO(), []
                for record in stream_records(inflate(content)):
                    member = _gzip(record)
                    head = parse_record(record)[0]
                    index.append({"o": out.tell(), "n": len(member), "id": head["WARC-Record-ID"]})
                    out.write(member)
                name = posixpath.basename(path).removesuffix(".warc.gz") + f"-{_attempt()}.warc.gz"
                side = "".join(json.dumps(x) + "\n" for x in index).encode()
                _put(store, posixpath.join(base, name + ".idx"), side)
                _put(store, posixpath.join(base, name), out.getvalue())
                yield pd.DataFrame({"name": [name], "records": [len(index)]})

    return _listed(spark, folder, only).mapInPandas(rewrite, "name string, records long")


FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, folder: str, only: DataFrame | None = None) -> DataFrame:
    """The records of normalised archives, each cut out by its sidecar's offset; digests are checked."""

    def number(urn: str):
        digits = urn.strip("<>").rpartition(":")[2]
        return int(digits) if digits else None

    def read(frames):
        store, base = _store(folder)
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with store.open_input_stream(posixpath.join(base, posixpath.basename(path) + ".idx")) as side:
                    index = [json.loads(x) for x in side.read().decode().splitlines()]
                rows = []
                for x in index:
                    head, body = parse_record(zlib.decompress(content[x["o"] : x["o"] + x["n"]], 31))
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Record-ID"] != x["id"] or kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"{path} at {x['o']}: not the record its index or digest names")
                    refers = number(head["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((number(x["id"]), int(head["X-Payload-Length"]), digest, kind, refers))
                columns = [c.split()[0] for c in FIELDS.split(", ")]
                out = pd.DataFrame(rows, columns=columns)
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return _listed(spark, folder, only).mapInPandas(read, FIELDS)


def assign_records(pages: DataFrame) -> DataFrame:
    """pages -> staged row_id, page_id, url, html, revisit, refers."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = stage(
        pages.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col("page_id").cast("long").alias("page_id"),
            "url",
            "html",
            F.when(F.octet_length(html) >= REVISIT_BYTES, F.unhex(F.sha2(html.cast("binary"), 256))).alias("sha"),
        ),
        "pages",
    )
    groups = stage(
        rows.filter("sha is not null")
        .groupBy("sha")
        .agg(F.max(F.struct("page_id", "row_id")).alias("top"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("sha", F.col("top.page_id").alias("refers"), F.col("top.row_id").alias("top_row")),
        "payloads",
    )
    return rows.join(checked_broadcast(groups, 80), "sha", "left").select(
        "row_id",
        "page_id",
        "url",
        "html",
        F.coalesce(F.col("row_id") != F.col("top_row"), F.lit(False)).alias("revisit"),
        "refers",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back; one row a page."""
    spark = pages.sparkSession
    raw, clean = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    with staging(spark) as made:
        written = made.keep(stage(write_archives(assign_records(pages), raw), "warc-list"))
    if not written.limit(1).count():
        return spark.createDataFrame([], FIELDS)
    listed = stage(normalise_archives(spark, raw, clean, written), "warc-clean")
    drop_folder(spark, raw)
    return read_archives(spark, clean, listed)
