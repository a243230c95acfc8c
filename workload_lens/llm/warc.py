"""WARC archives: a committed writer and a splittable reader.

Archives are ``.warc.gz`` files with one gzip member a record. The reader cuts
files into byte ranges. A task scans its range for the gzip magic, accepts a
position when the member there inflates to a WARC header, and owns the records
that start inside its range; it reads past the range's end only to finish the
last one. After an accepted member the next one starts where it ends.

Pages with equal payloads of at least ``min_bytes`` are stored once: the one with
the smallest id is the response, the others are revisits that refer to it.

A task writes to a file of its own and reports it; only files of tasks that Spark
committed are in the manifest, so the leavings of lost executors are never read.

Defined results: a null html is an empty payload; rows with equal ids and
payloads are all responses if their id is the smallest; null page ids are
written as such, and never referred to while another page has the payload; an
empty table gives an archive without files; other columns are ignored. A record is
held whole while it is written or read, so a task needs memory for its largest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_batches

MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1\r\n"
_DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, path string, offset long"


# -- files -------------------------------------------------------------------


def filesystem(path: str):
    """(file system, path in it) of a path or URI, for Python code in tasks."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][\w+.-]*:", path):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
        return fs.FileSystem.from_uri(path)
    raise ValueError(f"a URI with its scheme is needed, as only that names the same file everywhere: {path}")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of Spark's default file system if it has none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


# -- records -----------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _clean(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    if kind == "revisit":
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of an inflated record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.") or not sep:
        raise ValueError("no WARC header")
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:  # a folded line
            fields[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    size = int(fields.get("content-length", "-1"))
    if size < 0 or len(rest) < size:
        raise ValueError("truncated record")
    return fields, rest[:size]


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn)
    return int(m[1]) if m else None


def _row(fields: dict[str, str], block: bytes, path: str, offset: int) -> tuple:
    kind = fields.get("warc-type", "")
    head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
        size, payload = int(m[1]) if m else 0, None
    else:
        size = len(payload)
        told = digest(payload)
    refers = _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return _page(fields.get("warc-record-id", "")), fields.get("warc-target-uri"), kind, refers, size, told, payload, path, offset


# -- the splittable reader ---------------------------------------------------


class _Window:
    """A file read forwards in steps, with random access to what was read."""

    def __init__(self, source, start: int, step: int) -> None:
        self.source, self.begin, self.step, self.data, self.done = source, start, step, bytearray(), False
        source.seek(start)

    def more(self) -> bool:
        got = b"" if self.done else self.source.read(self.step)
        self.done = not got
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        if to - self.begin > 4 * self.step:
            del self.data[: to - self.begin]
            self.begin = to


def _inflate(window: _Window, at: int) -> tuple[bytes, int] | None:
    """(contents, end) of the gzip member at ``at``; None if there is no WARC record."""
    d, out, fed, checked = zlib.decompressobj(31), [], at, False
    size = 0
    while not d.eof:
        if fed - window.begin >= len(window.data) and not window.more():
            return None  # truncated
        part = bytes(window.data[fed - window.begin : fed - window.begin + window.step])
        try:
            got = d.decompress(part)
        except zlib.error:
            return None
        fed += len(part)
        out.append(got)
        size += len(got)
        if not checked and size >= 7:
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            checked = True
    raw = b"".join(out)
    return (raw, fed - len(d.unused_data)) if raw.startswith(b"WARC/1.") else None


def records_in(source, path: str, start: int, stop: int, step: int = 1 << 18):
    """Rows of the records whose gzip member starts in ``start:stop``."""
    window, at = _Window(source, start, step), start
    while at < stop:
        while len(window.data) - (at - window.begin) < len(MAGIC) and window.more():
            pass
        rel = window.data.find(MAGIC, at - window.begin)
        if rel < 0:
            at = max(at, window.begin + len(window.data) - len(MAGIC) + 1)  # the magic may span the edge
            if not window.more():
                return
            window.drop(at)
            continue
        at = window.begin + rel
        if at >= stop:
            return
        found = _inflate(window, at)
        if found is None:
            at += 1
            continue
        try:
            yield _row(*parse_record(found[0]), path, at)
        except ValueError:
            at += 1
            continue
        at = found[1]
        window.drop(at)


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64())
    names = ("page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "path", "offset")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=list(names))


def read(files: DataFrame, *, split_bytes: int = 8 << 20, most_tasks: int = 100_000) -> DataFrame:
    """Records of the archives listed in ``files`` (path, size), read by byte ranges.

    Ranges are few bytes but much work, so they are dealt to a given number of tasks,
    one for ``split_bytes`` of archives, which Spark doesn't put together by size.
    """
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(most_tasks, n + size // split_bytes))
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start")).where("size > 0")
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("stop"))

    def scan(batches):
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                system, local = filesystem(path)
                rows, held = [], 0
                with system.open_input_file(local) as source:
                    for row in records_in(source, path, start, stop):
                        rows.append(row)
                        held += len(row[6] or b"") + 256
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.repartition(tasks, "path", "start").mapInArrow(scan, RECORD)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the archives under a folder, listed by Spark."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("size"))


# -- the writer --------------------------------------------------------------


def assign(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, record_type, refers_to.

    Digests shared by several pages are joined back; the join's skewed side holds
    one row a page and can be split, as each digest is one row on the other side.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first")
    joined = rows.join(shared, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, *, level: int = 6, **options) -> DataFrame:
    """Write archives below ``folder`` (which all executors reach); returns the manifest (path, size, records)."""
    folder = qualified(pages.sparkSession, folder).rstrip("/")
    root, inside = filesystem(folder)
    root.create_dir(inside, recursive=True)

    def archive(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        path = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        sink, size, n = None, 0, 0
        for batch in text_batches(batches, "payload"):
            if sink is None:
                system, local = filesystem(path)
                sink = system.open_output_stream(local, compression=None)
            for page_id, url, payload, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                member = gzip_member(record(page_id, url, payload, refers, kind), level)
                sink.write(member)
                size, n = size + len(member), n + 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "size", "records"])

    rows = assign(pages, **options).mapInArrow(archive, "path string, size long, records long")
    return materialize(rows, "warc-manifest")
