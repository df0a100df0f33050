"""Legacy archive converter: ARC files of version 1 or 2 become WARC files, with revisit records for equal payloads.

``write_arcs`` lays pages down as ARC files (each record a gzip member) with an index; ``convert`` reads ARC files,
whoever wrote them, and writes WARC files; ``read_warcs`` reads those back. All files lie in the shared folder. Each
task attempt writes files of its own name, and only files of committed tasks are listed in the returned tables.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hf_path, new_dir, written

#: Fields of the header lines by version. Fixed values of the ARC format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: Uncompressed bytes from which a new ARC file is begun; also bounds a file's part of the index in memory.
ARC_BYTES = 64 << 20
LEVEL = 4
#: Bytes of payload from which equal payloads are written once.
REVISIT_BYTES = 1000


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(uri: str):
    fs, path = hf_path(uri)
    return io.BufferedReader(gzip.GzipFile(fileobj=fs.open_input_stream(path), mode="rb"), 1 << 18)


def _create(uri: str):
    fs, path = hf_path(uri)
    fs.create_dir(path.rpartition("/")[0])
    return fs.open_output_stream(path)


def no_spaces(url: str | None) -> str:
    """A URL as a header field: no white space or line ends; "-" where there is none."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "-"


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that begins an ARC file."""
    body = f"{version} 0 crawl\n{' '.join(ARC_FIELDS[version])}\n"
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version]) + "\n" + body + "\n").encode()


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, name: str = "-", offset: int = 0) -> bytes:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode() + block + b"\n"


def http_block(payload: bytes, page_id: int | None) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def parse_arc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records behind the version block, whose first digit says how header lines are read.

    A block is exactly as long as declared, whatever it contains. A URL may hold spaces in old files: the fields are
    taken from the line's end.
    """
    fields = None
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue  # the line end behind a block
        if fields is None:
            length = int(line.rsplit(b" ", 1)[1])
            body = stream.read(length)
            fields = ARC_FIELDS[int(body.split(b" ", 1)[0])]
            continue
        values = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"not an ARC header of {len(fields)} fields: {line[:100]!r}")
        head = dict(zip(fields, values, strict=True))
        block = stream.read(length := int(head["Archive-length"]))
        if len(block) != length:
            raise ValueError("the ARC file ends within a block")
        yield head, block


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(head, lower-cased header fields, payload) of an HTTP response; a block of another kind is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    at = block.find(b"\r\n\r\n")
    head, payload = (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])
    pairs = (x.split(":", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ":" in x)
    return head, {k.strip().lower(): v.strip() for k, v in pairs}, payload


def warc_date(arc_date: str) -> str:
    d = "".join(c for c in arc_date if c.isdigit()).ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(url: str, arc_date: str, digest: str, page_id) -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {arc_date} {digest} {page_id}')}>"


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def converted(head: dict[str, str], block: bytes, refers: tuple | None) -> bytes:
    """The WARC record of an ARC record. ``refers``: (page_id, url, date) of the record whose payload it repeats."""
    http, names, payload = split_http(block)
    digest, date = hashlib.sha1(payload).hexdigest(), warc_date(head["Archive-date"])
    kind = ("revisit" if refers else "response") if http else "resource"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(head["URL"], head["Archive-date"], digest, names.get("x-page-id"))), ("WARC-Date", date),
        ("WARC-Target-URI", head["URL"]), ("WARC-IP-Address", head["IP-address"]), ("WARC-Payload-Digest", _base32(digest)),
        ("Content-Type", "application/http; msgtype=response" if http else head["Content-type"]),
    ]
    if kind == "revisit":
        page, url, arc_date = refers
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(url, arc_date, digest, page)),
            ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", warc_date(arc_date)), ("X-Refers-To-Page-Id", str(page)),
        ]
    return warc_record(fields, http if kind == "revisit" else block)


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-cased fields, block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(length := int(fields["content-length"]))
        if len(block) != length:
            raise ValueError("the WARC file ends within a block")
        yield fields, block


def _rows(names: list[str], types: list, rows: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20200101000000", versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Writes the pages as ARC files and returns their index: arc, seq, page_id, url, date, bytes, digest.

    The files of a partition take the ``versions`` in turn. No shuffle; the payload never leaves its task.
    """
    import pyarrow as pa

    folder = new_dir(pages.sparkSession, "arc")
    names = ["arc", "seq", "page_id", "url", "date", "bytes", "digest"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turn = TaskContext.get().partitionId(), 0
        out, rows, size = None, [], 0
        for batch in batches:
            for page, url, html in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if out is None:
                    version = versions[(part + turn) % len(versions)]
                    name = f"{part:06d}-{turn:04d}-{uuid.uuid4().hex}.arc.gz"
                    out = _create(uri := f"{folder}/{name}")
                    out.write(first := _member(arc_head(version, name, date)))
                    at, size, turn = len(first), 0, turn + 1
                payload, field = (html.as_py() or "").encode(), no_spaces(url.as_py())
                data = arc_record(version, field, date, "text/html", http_block(payload, page.as_py()), name, at)
                out.write(member := _member(data))
                rows.append((uri, len(rows), page.as_py(), field, date, len(payload), hashlib.sha1(payload).hexdigest()))
                at, size = at + len(member), size + len(data)
                if size >= ARC_BYTES:
                    out.close()
                    yield _rows(names, types, rows)
                    out, rows = None, []
        if out is not None:
            out.close()
            yield _rows(names, types, rows)

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return written(own.mapInArrow(run, "arc string, seq long, page_id long, url string, date string, bytes long, digest string"), "arc-index")


def convert(index: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Converts the index's ARC files to WARC files; returns their list: warc, records.

    Of records with equal payloads of ``min_bytes`` or more, the one of the largest page_id (then of the last place) is
    the response, the others revisit it; records without a page_id come first. Only index rows are grouped and joined:
    leaders by digest with partial aggregates, and back by a merge join, whose large partitions Spark splits.
    """
    import pyarrow as pa

    large = index.where(F.col("bytes") >= min_bytes)
    leaders = large.groupBy("digest").agg(F.max(F.struct("page_id", "arc", "seq", "url", "date")).alias("leader"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    is_leader = (F.col("leader.arc") == F.col("arc")) & (F.col("leader.seq") == F.col("seq"))
    repeats = (F.col("bytes") >= min_bytes) & F.col("leader").isNotNull() & ~is_leader
    plan = index.join(leaders.hint("merge"), "digest", "left").select("arc", "seq", F.when(repeats, F.col("leader")).alias("leader"))
    plan = plan.select("arc", "seq", F.col("leader").isNotNull().alias("repeats"), "leader.page_id", "leader.url", "leader.date")
    files = max(1, index.select("arc").distinct().count())
    folder = new_dir(index.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = stream = out = None
        done: list[tuple] = []
        for batch in batches:
            for arc, seq, repeats, *refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if arc != uri:
                    if out:
                        out.close()
                    uri, count = arc, 0
                    stream = parse_arc(_open(arc))
                    name = f"{folder}/{arc.rpartition('/')[2].removesuffix('.arc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out = _create(name)
                    info = f"software: ARC converter\r\nformat: WARC File Format 1.1\r\nisPartOf: {arc.rpartition('/')[2]}\r\n".encode()
                    out.write(_member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(arc, "", "", None)), ("WARC-Date", warc_date("20200101")), ("Content-Type", "application/warc-fields")], info)))
                    done.append((name, 0))
                if seq != count:
                    raise ValueError("the index does not cover its ARC file")
                head, block = next(stream)
                out.write(_member(converted(head, block, tuple(refers) if repeats else None)))
                count += 1
                done[-1] = (name, count)
        if out:
            out.close()
            yield _rows(["warc", "records"], [pa.string(), pa.int64()], done)

    placed = plan.repartition(files, "arc").sortWithinPartitions("arc", "seq")
    return written(placed.mapInArrow(run, "warc string, records long"), "warc-list")


def read_warcs(warcs: DataFrame) -> DataFrame:
    """One row per page record: page_id, url, date, record_type, record_id, refers_to_id, refers_to, payload_bytes,
    payload_digest (hex). A response's digest is computed from its payload and must equal its header's; a revisit's is
    its header's, and its length the one that its HTTP head declares."""
    import pyarrow as pa

    names = ["page_id", "url", "date", "record_type", "record_id", "refers_to_id", "refers_to", "payload_bytes", "payload_digest"]
    types = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64(), pa.string()]
    number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for head, block in parse_warc(_open(name)):
                    if head["warc-type"] == "warcinfo":
                        continue
                    _, http, payload = split_http(block)
                    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if head["warc-type"] != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{head['warc-record-id']}: the payload does not match its digest")
                    size = number(http.get("content-length")) if head["warc-type"] == "revisit" else len(payload)
                    rows.append((number(http.get("x-page-id")), head["warc-target-uri"], head["warc-date"], head["warc-type"], head["warc-record-id"], head.get("warc-refers-to"), number(head.get("x-refers-to-page-id")), size, digest))
                    if len(rows) >= 10_000:
                        yield _rows(names, types, rows)
                        rows = []
                if rows:
                    yield _rows(names, types, rows)

    spread = warcs.select("warc").repartition(max(1, warcs.count()))
    return spread.mapInArrow(run, "page_id long, url string, date string, record_type string, record_id string, refers_to_id string, refers_to long, payload_bytes long, payload_digest string")


def archive_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Pages to ARC files, converted to WARC files, read back: ``read_warcs`` with a row per page.

    Null or empty html: an empty payload. Null url: "-". Null page_id: no id, never a response while a copy has one.
    Repeated rows: a record each; one of them is the response. An empty table writes no file and gives no rows.
    """
    return read_warcs(convert(write_arcs(pages, **columns)))
