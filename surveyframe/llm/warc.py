"""WARC archives and a two-level capture index over them.

Writing: each task writes one archive, a gzip member per record. Of captures with
equal payloads the one with the smallest id is the response; the others become
revisits of it. Which those are is settled on digests alone, so payloads are not
shuffled (but those whose id collides with a revisit's in a bit map).

Index: one line for each record, keyed by the reversed host and the path of its URL
and by its id. Lines are range-partitioned and sorted; every part writes a file of
compressed blocks of ``BLOCK`` lines and a directory with each block's first line.
A directory is read by binary search with small range reads, as is its block, and
the list of parts (one row each) is all that a reader holds.

Reading: lookups are sorted like the index, so a task opens each block once; the
places found are sorted by archive, and neighbouring records are fetched in one
range read. Files are reached through ``pyarrow.fs``, so archives may lie in any
store it knows, and in the folder that the cluster shares.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyframe.llm.common import attach, id_bits, keep_bits, open_store, prepare, release, scratch_path, settled

#: Lines of an index block.
BLOCK = 1_000
#: Bytes of one read of neighbouring records.
READ = 8 << 20
DATE = "2024-01-01T00:00:00Z"

_URL = re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", re.I)
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _plain(text: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def url_key(url: str | None) -> str:
    """Reversed host, then the path: ``http://a.b.org/x?y#z`` is ``org,b,a)/x?y``. Null is empty."""
    if url is None:
        return ""
    if m := _URL.match(url):
        host = ",".join(reversed(m[1].lower().split(".")))
        return _plain(f"{host}{m[2] or ''}){m[3] or '/'}")
    return _plain(url)


def entry(url: str | None, page_id: int | None) -> bytes:
    """The sort key of a capture; ids in numeric order, null first."""
    return f"{url_key(url)} {'-' if page_id is None else format(page_id + 2**63, '020d')}".encode()


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record(url: str | None, page_id: int | None, payload: bytes | None, size: int, sha1: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit has the payload's headers without the payload."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    name = lambda i: f"<urn:page:{i}>" if i is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_plain(url) if url else 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{base32(sha1)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {name(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + (payload or b"") + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of its response, and the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    named = lambda x: {k.lower(): v for k, _, v in (line.partition(": ") for line in x.decode().split("\r\n")[1:])}
    warc = named(head)
    body = rest[: int(warc["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, named(http), payload


def _deflate(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


PLACES = "entry binary, page_id long, archive string, at long, size long"
_PLACES = pa.schema([("entry", pa.binary()), ("page_id", pa.int64()), ("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def _write(root: str, bits):
    """Archive the rows of a task; with ``bits``, rows that may be revisits are left to a second pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                if bits is not None:
                    batch = batch.filter(pa.array(~keep_bits(batch.column("h").to_numpy(), bits.value)))
                rows = []
                if batch.num_rows and out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                for page_id, url, html, sha1, size, refers_to in zip(
                    *(batch.column(c) for c in ("page_id", "url", "html", "sha1", "size", "refers_to")), strict=True
                ):
                    page, link = page_id.as_py(), url.as_py()
                    first = refers_to.as_py()
                    payload = None if first is not None else (html.as_buffer().to_pybytes() if html.is_valid else b"")
                    z = _deflate(_record(link, page, payload, size.as_py(), sha1.as_py(), first))
                    out.write(z)
                    rows.append((entry(link, page), page, name, at, len(z)))
                    at += len(z)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACES, strict=True)], schema=_PLACES)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Write every page to archives under ``root``; the place of each record."""
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(
        "page_id", "url", html.alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"), F.octet_length(html).cast("long").alias("size")
    )
    light = settled(pages.select("page_id", "sha1", "size").where(F.col("size") >= min_bytes), "digests")
    groups = light.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("w")).where("w > 1")
    # repeated rows of the smallest id are one capture: each is a response
    again = attach(light, groups, "sha1", "w").where("refers_to is not null and (page_id is null or page_id > refers_to)")
    again = settled(again.select("page_id", "sha1", "refers_to").distinct(), "revisits")
    bits = spark.sparkContext.broadcast(id_bits(again.select(F.xxhash64("page_id", "sha1").alias("h")), "h"))
    pages = pages.withColumn("h", F.xxhash64("page_id", "sha1"))
    plain = pages.withColumn("refers_to", F.lit(None).cast("long")).mapInArrow(_write(root, bits), PLACES)

    def suspect(batches):
        for batch in batches:
            yield batch.filter(pa.array(keep_bits(batch.column("h").to_numpy(), bits.value)))

    kinds = pages.schema
    rest = pages.mapInArrow(suspect, kinds).alias("p").join(again.alias("a"), F.expr("p.page_id <=> a.page_id and p.sha1 = a.sha1"), "left")
    rest = rest.select("p.page_id", "p.url", F.expr("if(a.refers_to is null, p.html, null)").alias("html"), "p.sha1", "p.size", "a.refers_to", "p.h")
    return settled(plain.unionByName(rest.mapInArrow(_write(root, None), PLACES)), "places")


def _index_part(root: str):
    """Blocks and directory of one sorted part: lines ``entry TAB archive at size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        name = uuid.uuid4().hex
        out, lines, directory, at, last = None, [], [], 0, b""

        def block() -> None:
            nonlocal at, lines
            z = _deflate(b"\n".join(b"\t".join(x) for x in lines), 6)
            out.write(z)
            directory.append((lines[0][0], at, len(z)))
            at += len(z)
            lines = []

        for batch in batches:
            for e, archive, a, n in zip(*(batch.column(c).to_pylist() for c in ("entry", "archive", "at", "size")), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}.blocks")
                lines.append((e, archive.encode(), b"%d" % a, b"%d" % n))
                last = e
                if len(lines) == BLOCK:
                    block()
        if out is None:
            return
        if lines:
            block()
        out.close()
        with store.open_output_stream(f"{base}/{name}.directory") as d:  # lines, where each begins, how many there are
            begins, to = [], 0
            for first, a, n in directory:
                line = struct.pack(">qq", a, n) + first
                begins.append(to)
                to += len(line)
                d.write(line)
            d.write(struct.pack(f">{len(begins) + 2}q", *begins, to, len(begins)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (directory[0][0], last, name)], names=["first", "last", "part"]
        )

    return run


def build_index(places: DataFrame, root: str, partitions: int) -> list[tuple[bytes, bytes, str]]:
    """Write the index; its parts in order, at most ``partitions`` of them."""
    ordered = places.select("entry", "archive", "at", "size").repartitionByRange(partitions, "entry").sortWithinPartitions("entry", "archive", "at")
    parts = settled(ordered.mapInArrow(_index_part(root), "first binary, last binary, part string"), "parts")
    return sorted((bytes(r.first), bytes(r.last), r.part) for r in parts.select("first", "last", "part").collect())


class Directory:
    """The block directory of one part, read by ranges."""

    def __init__(self, store: fs.FileSystem, base: str, part: str):
        self.file = store.open_input_file(f"{base}/{part}.directory")
        self.blocks = store.open_input_file(f"{base}/{part}.blocks")
        end = self.file.size()
        (self.count,) = struct.unpack(">q", self.file.read_at(8, end - 8))
        self.table = end - 8 * (self.count + 2)

    def line(self, k: int) -> tuple[bytes, int, int]:
        a, b = struct.unpack(">qq", self.file.read_at(16, self.table + 8 * k))
        raw = self.file.read_at(b - a, a)
        return raw[16:], *struct.unpack(">qq", raw[:16])

    def find(self, key: bytes) -> int:
        """The first block that may hold ``key``: the one before the first block that begins at or after it."""
        return max(0, bisect.bisect_left(range(self.count), key, key=lambda k: self.line(k)[0]) - 1)

    def read(self, k: int) -> list[list[bytes]]:
        _, at, size = self.line(k)
        return [x.split(b"\t") for x in zlib.decompress(self.blocks.read_at(size, at), 31).split(b"\n")]


def _look_up(root: str, parts: list[tuple[bytes, bytes, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        lasts = [p[1] for p in parts]
        opened: tuple[int, Directory | None] = (-1, None)
        held: tuple[tuple[int, int], list] = ((-1, -1), [])
        for batch in batches:
            rows = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                key = entry(url, page)
                part = bisect.bisect_left(lasts, key)
                found = False
                while part < len(parts) and parts[part][0] <= key:
                    if opened[0] != part:
                        opened = (part, Directory(store, base, parts[part][2]))
                    directory = opened[1]
                    k = held[0][1] if held[0][0] == part and held[1][0][0] < key <= held[1][-1][0] else directory.find(key)
                    while k < directory.count:
                        if held[0] != (part, k):
                            held = ((part, k), directory.read(k))
                        at = bisect.bisect_left(held[1], key, key=lambda x: x[0])
                        while at < len(held[1]) and held[1][at][0] == key:
                            _, archive, a, n = held[1][at]
                            rows.append((key, page, archive.decode(), int(a), int(n)))
                            found, at = True, at + 1
                        if at < len(held[1]):
                            break
                        k += 1
                    part += 1
                if not found:
                    raise LookupError(f"no capture of {key!r}")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PLACES, strict=True)], schema=_PLACES)

    return run


def look_up(pages: DataFrame, root: str, parts: list[tuple[bytes, bytes, str]], partitions: int) -> DataFrame:
    """Places of the captures of all (url, page_id), told from the index alone."""
    wanted = pages.select("url", "page_id").distinct()
    # reversed host first, as the index is ordered: neighbours in the index go to one task
    host = F.reverse(F.split(F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), "//([^/?#:]*)", 1), r"\."))
    ordered = wanted.withColumn("host", host).repartitionByRange(partitions, "host", "url", "page_id").sortWithinPartitions("host", "url", "page_id")
    return ordered.select("url", "page_id").mapInArrow(_look_up(root, parts), PLACES)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(root: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        file, name, lo, data = None, None, 0, b""
        for batch in batches:
            rows = []
            pages, archives, ats, sizes = (batch.column(c).to_pylist() for c in ("page_id", "archive", "at", "size"))
            for k, (page, archive, at, size) in enumerate(zip(pages, archives, ats, sizes, strict=True)):
                if archive != name:
                    file, name, data = store.open_input_file(f"{base}/{archive}"), archive, b""
                if not lo <= at <= at + size <= lo + len(data):
                    end = at + size  # as far as the next places lie close by
                    for j in range(k + 1, len(pages)):
                        if archives[j] != archive or ats[j] > end + 65_536 or ats[j] + sizes[j] > at + READ:
                            break
                        end = max(end, ats[j] + sizes[j])
                    lo, data = at, file.read_at(end - at, at)
                warc, http, payload = parse(zlib.decompress(data[at - lo : at - lo + size], 31))
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                kind, first = warc["warc-type"], None
                if kind == "response":
                    if base32(hashlib.sha1(payload).digest()) != digest or len(payload) != int(http["content-length"]):
                        raise ValueError(f"damaged payload in {archive} at {at}")
                else:
                    first = int(warc["warc-refers-to"].removeprefix("<urn:page:").rstrip(">"))
                row = (page, int(http["content-length"]), digest, kind, first)
                rows.append((*row, payload.decode() if kind == "response" else None) if payloads else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            n = 6 if payloads else 5
            cols = list(zip(*rows, strict=True)) if rows else [[]] * n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds[:n], strict=True)], names=names[:n])

    return run


def read_records(places: DataFrame, root: str, partitions: int, payloads: bool = False) -> DataFrame:
    """Fetch and check the records at these places."""
    ordered = places.select("page_id", "archive", "at", "size").repartitionByRange(partitions, "archive", "at").sortWithinPartitions("archive", "at")
    return ordered.mapInArrow(_read(root, payloads), RECORDS + ", payload string" * payloads)


def archive_round_trip(pages: DataFrame, *, min_bytes: int = 0, partitions: int | None = None, payloads: bool = False) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html), index it, and read all back through the index.

    (page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]), a row
    for each record. Payloads are the html in UTF-8, null html the empty payload. Of
    equal payloads of at least ``min_bytes`` the smallest page_id is the response and
    the others revisit it; repeated rows of that id are one capture, each a response.
    Null ids never are what others refer to, unless all ids of a payload are null: then
    all are responses. Null and odd URLs have keys like any others; other columns are
    ignored. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    prepare(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root, index = scratch_path(spark, "archives"), scratch_path(spark, "index")
    places = write_archives(pages, root, min_bytes)
    release(spark)
    parts = build_index(places, index, partitions)
    found = settled(look_up(pages, index, parts, partitions), "found")
    return read_records(found, root, partitions, payloads)
