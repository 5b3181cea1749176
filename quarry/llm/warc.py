"""WARC records inside ZIP packages: a writer, and a reader that extracts nothing.

A package holds stored (not deflated) members: ``archive/data.warc.gz``, gzip member by
record, and ``indexes/index.cdx``, one line a record with its offset and length.  The reader
looks for the end-of-central-directory record (ZIP64 too), walks the central directory, finds the stored
members' first bytes through their local headers, reads the indexes, and then reads only the
byte ranges of single records.  Packages live in the folder the cluster shares and are
opened by pyarrow's file systems, so that folder may be HDFS or an object store.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO, NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import chunks, shared_dir, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Repeated payloads up to which their digests (some 100 bytes each) are sent to every task; beyond, pages are joined by id.
FEW = 100_000
#: Ranges that a task reads.
RANGES = 8
EOCD, EOCD64, LOCATOR, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


class Member(NamedTuple):
    """A stored member: its bytes are ``[start, start + size)`` of the package."""

    name: str
    start: int
    size: int


def span(at: BinaryIO, start: int, size: int) -> bytes:
    at.seek(start)
    out = at.read(size)
    if len(out) != size:
        raise ValueError(f"the package ends within bytes {start}..{start + size}")
    return out


def directory(at: BinaryIO, total: int) -> list[Member]:
    """The members of a ZIP or ZIP64 package, by its central directory alone."""
    tail_at = max(0, total - 65557)
    tail = span(at, tail_at, total - tail_at)
    end = tail.rfind(EOCD)
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(EOCD, 0, end)
    if end < 0:
        raise ValueError("no end of a central directory: not a ZIP package")
    count, size, start = struct.unpack_from("<HII", tail, end + 10)
    where = tail_at + end
    if where >= 20 and (locator := span(at, where - 20, 20))[:4] == LOCATOR:
        head = span(at, struct.unpack_from("<Q", locator, 8)[0], 56)
        if head[:4] != EOCD64:
            raise ValueError("the ZIP64 locator points elsewhere")
        count, size, start = struct.unpack_from("<QQQ", head, 32)
    body, k, out = span(at, start, size), 0, []
    for _ in range(count):
        if body[k : k + 4] != CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", body, k + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", body, k + 20)
        (header,) = struct.unpack_from("<I", body, k + 42)
        name = body[k + 46 : k + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, e = body[k + 46 + n_name : k + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # ZIP64: only the fields that are full above, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            e += 4 + n
        if method == 0 and not flags & 1:
            local = span(at, header, 30)
            if local[:4] != LOCAL:
                raise ValueError(f"no local header for {name}")
            out.append(Member(name, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed))
        k += 46 + n_name + n_extra + n_comment
    return out


def entries(at: BinaryIO, total: int) -> Iterator[tuple[str, int, int]]:
    """``record id, offset in the package, length`` of every indexed record."""
    members = directory(at, total)
    by_name = {m.name: m for m in members}
    for m in members:
        if m.name.endswith(".cdx"):
            for line in span(at, m.start, m.size).decode().splitlines():
                record, data, offset, length = line.split(" ")
                yield record, by_name[data].start + int(offset), int(length)


def record(fields: dict[str, str], payload: bytes) -> bytes:
    """One WARC 1.1 record as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    fields = fields | {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the payload of a record."""
    plain = zlib.decompress(raw, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def package(rows: Iterable[tuple[bytes, str]]) -> bytes:
    """A ZIP package of the records ``(gzip member, record id)``."""
    data, index = io.BytesIO(), []
    for raw, name in rows:
        index.append(f"{name} {DATA} {data.tell()} {len(raw)}\n")
        data.write(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, body in ((DATA, data.getvalue()), (INDEX, "".join(index).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(body)
    return out.getvalue()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def clean(value: Any) -> str:
    """A value that can stand in a header line: white space, control characters and the percent sign escaped."""
    return "".join(c if c.isprintable() and c not in " %" else quote(c) for c in str(value))


def write_packages(records: DataFrame, folder: str, package_bytes: int = 8 << 20) -> DataFrame:
    """Writes ``id, url, html, digest, n_bytes, kind, refers_to`` into packages; returns ``path, size`` of each.

    A task writes each package under a fresh name and renames it when whole, so a task that
    runs again leaves orphans, not damage: only the packages named in the result are read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        held: list[tuple[bytes, str]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n
            body, name = package(held), f"{root}/{uuid.uuid4().hex}.wacz"
            with system.open_output_stream(f"{name}.part") as f:
                f.write(body)
            system.move(f"{name}.part", name)
            held, n = [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(body)], pa.int64())], ["path", "size"])

        for batch in chunks(batches, "html"):
            for row in batch.to_pylist():
                fields = {"WARC-Type": row["kind"], "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Target-URI": clean(row["url"] or ""), "WARC-Date": "2000-01-01T00:00:00Z"}
                fields |= {"WARC-Payload-Digest": f"sha256:{row['digest']}", "WARC-Payload-Length": str(row["n_bytes"])}
                if row["id"] is not None:
                    fields["WARC-Page-ID"] = clean(row["id"])
                if row["kind"] == "revisit":
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Page-ID": clean(row["refers_to"])}
                raw = record(fields, (row["html"] or "").encode())
                held.append((raw, fields["WARC-Record-ID"]))
                n += len(raw)
                if n >= package_bytes:
                    yield flush()
        if held:
            yield flush()

    return records.mapInArrow(write, "path string, size long")


def read_packages(packages: DataFrame, folder: str, range_bytes: int = 4 << 20) -> DataFrame:
    """``id, url, payload, kind, digest, n_bytes, refers_to`` of each record in the packages.

    First the directories and indexes are read, a row a package; then the records, dealt out to tasks by ranges
    of about ``range_bytes``, each by one read of its own bytes.
    """
    spark = packages.sparkSession

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as f:
                    found = list(entries(f, row["size"]))
                groups: dict[int, list[tuple[int, int]]] = {}
                for _, start, size in found:
                    groups.setdefault(start // range_bytes, []).append((start, size))
                yield pa.RecordBatch.from_pydict(
                    {"path": [row["path"]] * len(groups), "starts": [[a for a, _ in g] for g in groups.values()], "sizes": [[b for _, b in g] for g in groups.values()]},
                    schema=pa.schema([("path", pa.string()), ("starts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]),
                )

    names = ["id", "url", "payload", "kind", "digest", "n_bytes", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                with system.open_input_file(row["path"]) as f:
                    for start, size in zip(row["starts"], row["sizes"], strict=True):
                        h, payload = parsed(span(f, start, size))
                        page, refers = (None if (x := h.get(k)) is None else unquote(x) for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID"))
                        out.append((page, unquote(h["WARC-Target-URI"]), payload, h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["WARC-Payload-Length"]), refers))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    some = packages.repartition(max(1, min(packages.count(), 4 * spark.sparkContext.defaultParallelism)))
    ranges = stored(some.mapInArrow(index, "path string, starts array<long>, sizes array<long>"), "ranges")
    tasks = max(1, spark.sparkContext.defaultParallelism, ranges.count() // RANGES)
    return ranges.repartition(tasks).mapInArrow(read, "id string, url string, payload binary, kind string, digest string, n_bytes long, refers_to string")


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, few: int = FEW) -> DataFrame:
    """Pages as records: equal payloads of ``least`` bytes or more are stored once, at the smallest id.

    Copies are found by digests alone, without the payloads.  Where at most ``few`` payloads repeat, their first ids are sent to
    every task and no payload moves; beyond, those of the revisits are joined to the pages by id, so copies don't meet in one task.
    Rows that share the smallest id and the payload are all responses; a null id never is the smallest unless all are null.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "n_bytes": F.octet_length("html").cast("long")})
    large = rows.where(F.col("n_bytes") >= least).select("id", "digest")
    first = stored(large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-payloads")
    if first.count() <= few:
        out = rows.join(F.broadcast(first), "digest", "left")
    else:
        again = large.distinct().join(first, "digest").where(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
        again = stored(again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first"), "revisits")
        out = rows.join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return out.select(
        "id", "url", F.when(~revisit, F.col("html")).alias("html"), "digest", "n_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).cast("string").alias("refers_to"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """Writes pages as packages into the shared folder and reads the packages back.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to``, a row for each page.
    A response's digest and length are taken from the payload as read; a revisit's come from its
    record.  Null html is an empty payload; an empty table makes no package and no row; a payload may be of any length.
    Ids of any type come back as they went, null or empty text too; further columns aren't read, whatever their names.
    """
    spark = pages.sparkSession
    kind = pages.select(F.col(id_col)).schema[0].dataType
    folder = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    packages = stored(write_packages(deduplicated(pages, id_col, url_col, html_col, least), folder), "packages")
    got = read_packages(packages, folder)
    whole = F.col("kind") == "response"
    return got.select(
        F.col("id").cast(kind).alias("page_id"),
        F.when(whole, F.length("payload").cast("long")).otherwise(F.col("n_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"),
    )
