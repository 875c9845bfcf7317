"""WARC 1.1 archives as a PySpark Python data source ("warc"), written and read in parallel.

Writing: each task streams its rows to archives of about ``file_bytes`` each and notes where a record starts every
``mark_bytes``. Each commit writes a manifest of its own with its files and their marks; readers go by all of them, so files
of failed or repeated attempts are not seen and writers at the same time don't hinder each other. Reading: archives are
planned into partitions of about ``partition_bytes``: small files share one, large ones are cut at marks (an archive
without a manifest is not cut: a payload may look like the start of a record). Predicates on the record type and on headers
are pushed down; the header of a record is parsed first, and the block of a record that fails them, or any block with
option ``payload=false``, is skipped by seeking without being read or decoded (archives packed as a whole, .gz, must be
unpacked to get past it). Files go through pyarrow's file systems, so a path may be local, file://, s3://, gs:// or hdfs://.

Spark 4.1 plans a Python source once for each loaded frame, with the predicates of the first query on it: load a frame
anew (``spark.read.format("warc")``) for each query that filters it.

``archive_pages`` turns a pages table into rows for the writer: of equal payloads of at least ``least`` bytes, the one
with the smallest page_id is a response and the others are revisits of it without a payload. Only payloads whose digest a
bitmap of the repeated ones lets through are shuffled. ``read_pages`` reads responses and revisits apart: the scan for
revisits parses headers and skips every payload; their size and digest are those measured of the response they refer to.

Defined results: null html is an empty payload (always a response); rows equal in page_id and payload tie and are all
responses; a null page_id sorts last (it is referred to by none unless all are null); a null url writes no target URI;
other columns are ignored; an empty table writes no records.
"""

from __future__ import annotations

import gzip
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .session import Scratch, arrow_rows, shared_dir
from .sieve import sifted, with_lookup

MANIFEST = "_manifest-"
SCHEMA = "record_id string, type string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, payload binary"
#: Header of each column that has one; fixed values of the format.
HEADERS = {"record_id": "warc-record-id", "type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "content_length": "content-length", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAKS = re.compile(r"[\r\n]+")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    """Header values hold no line ends."""
    return _BREAKS.sub(" ", value)


def record(row: dict, date: str, packed: bool = True) -> bytes:
    """A whole record. A response's block is an HTTP message with the payload as body; a revisit's has no body.

    A packed body is under the transfer coding gzip, which leaves the payload and its digest what they are and the
    record's header readable, so that a reader can still seek past what it doesn't want.
    """
    payload = (row["payload"] or b"") if row["type"] == "response" else b""
    coding = b"Content-Length: %d\r\n" % len(payload) if row["type"] == "response" else b""
    if packed and len(payload) >= 256:
        payload, coding = gzip.compress(payload, 6, mtime=0), b"Transfer-Encoding: gzip\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n%s\r\n" % coding
    head = ["WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: <{_clean(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["type"] == "revisit":
        head += [f"WARC-Refers-To: <{_clean(row['refers_to'])}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


class _Files(WriterCommitMessage):
    def __init__(self, files: dict[str, list[int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.mark_bytes = int(options.get("mark_bytes", 4 << 20))
        self.date = options.get("date", "2000-01-01T00:00:00Z")
        self.packed = str(options.get("packed", "true")).lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        files: dict[str, list[int]] = {}
        out, name = None, ""
        store.create_dir(root, recursive=True)
        try:
            for batch in iterator:
                columns = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
                for k in range(batch.num_rows):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc"
                        files[name] = [0]
                        out = store.open_output_stream(f"{root}/{name}")
                    elif out.tell() - files[name][-1] >= self.mark_bytes:
                        files[name].append(out.tell())
                    out.write(record({c: v[k] for c, v in columns.items()}, self.date, self.packed))
                    if out.tell() >= self.file_bytes:
                        out.close()
                        out = None
        except BaseException:
            # Spark tells abort() of finished tasks only: an attempt that fails takes its own files away.
            if out is not None:
                out.close()
            for f in files:
                store.delete_file(f"{root}/{f}")
            raise
        if out is not None:
            out.close()
        return _Files(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files = {f: marks for m in messages if m for f, marks in m.files.items()}
        with store.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files, sort_keys=True).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _store(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/{f}")


class _Part(InputPartition):
    """Stretches of archives: path, where the first record starts, and where the next stretch does (None: to the end)."""

    def __init__(self, stretches: list[tuple[str, int, int | None]]):
        self.stretches = stretches


def read_head(file) -> dict[str, str] | None:
    """The header of the next record, by lower-case name; None at the end. Folded lines continue the value before."""
    line = file.readline()
    while line in (b"\r\n", b"\n"):
        line = file.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    head, name = {}, ""
    while (line := file.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:
            head[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            head[name] = value.strip()
    return head


def value_of(head: dict[str, str], column: str) -> str | int | None:
    value = head.get(HEADERS[column])
    if value is None:
        return None
    if column == "content_length":
        return int(value)
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha256:") if column == "payload_digest" else value


def body(block: bytes, content_type: str | None) -> bytes:
    """The payload of a block: the body of an HTTP message without its transfer coding, or all of it."""
    if not (content_type or "").startswith("application/http"):
        return block
    head, _, payload = block.partition(b"\r\n\r\n")
    return gzip.decompress(payload) if re.search(rb"\r\nTransfer-Encoding:\s*gzip\s*(\r\n|$)", head, re.I) else payload


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"].rstrip("/")
        self.partition_bytes = int(options.get("partition_bytes", 32 << 20))
        self.columns = schema.fieldNames()
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.wanted.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.path)
        marks: dict[str, list[int]] = {}
        if store.get_file_info(root).type == fs.FileType.File:
            found = [store.get_file_info(root)]
        else:
            here = [x for x in store.get_file_info(fs.FileSelector(root, recursive=False)) if x.type == fs.FileType.File]
            found = [x for x in here if re.search(r"\.warc(\.gz)?$", x.base_name)]
            manifests = [x for x in here if x.base_name.startswith(MANIFEST)]
            for x in manifests:
                with store.open_input_stream(x.path) as file:
                    marks |= json.loads(file.read())
            if manifests:  # archives of other writers have none
                found = [x for x in found if x.base_name in marks]
        plan, size = [], 0
        for x in sorted(found, key=lambda x: x.path):
            starts = marks.get(x.base_name, [0])
            for start, end in zip(starts, [*starts[1:], None], strict=True):
                length = (end or x.size) - start
                if not plan or size + length > self.partition_bytes:
                    plan.append(_Part([]))
                    size = 0
                held = plan[-1].stretches
                if held and held[-1][0] == x.path and held[-1][2] == start:
                    held[-1] = (x.path, held[-1][1], end)
                else:
                    held.append((x.path, start, end))
                size += length
        return plan or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, start, end in partition.stretches:
            packed = path.endswith(".gz")
            with store.open_input_stream(path, compression="gzip", buffer_size=1 << 20) if packed else store.open_input_file(path) as raw:
                yield from self.records(raw, packed, start, end)

    def records(self, raw, packed: bool, start: int = 0, end: int | None = None) -> Iterator[tuple]:
        import io

        file = io.BufferedReader(_Raw(raw, not packed), 1 << 18)
        if start:
            file.seek(start)
        # A record ends in two line ends, which the next header's reading passes over.
        while (end is None or file.tell() + 4 < end) and (head := read_head(file)) is not None:
            size = int(head.get("content-length", 0))
            keep = all(value_of(head, c) in values for c, values in self.wanted)
            if keep and "payload" in self.columns:
                block = file.read(size)
                yield tuple(body(block, head.get("content-type")) if c == "payload" else value_of(head, c) for c in self.columns)
                continue
            if packed:
                while size:
                    size -= len(file.read(min(size, 1 << 20)))
            else:
                file.seek(size, 1)
            if keep:
                yield tuple(value_of(head, c) for c in self.columns)


class _Raw:
    """A pyarrow file with what io.BufferedReader calls."""

    def __new__(cls, file, seekable: bool):
        import io

        class Raw(io.RawIOBase):
            def readable(self):
                return True

            def seekable(self):
                return seekable

            def readinto(self, into):
                data = file.read(len(into))
                into[: len(data)] = data
                return len(data)

            def seek(self, at, whence=0):
                file.seek(at, whence)
                return file.tell()

            def tell(self):
                return file.tell()

        return Raw()


class WarcSource(DataSource):
    """format("warc"): options path, payload (true), partition_bytes; for writing also file_bytes, date and packed (true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA if str(self.options.get("payload", "true")).lower() == "true" else SCHEMA.removesuffix(", payload binary")

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Rows for the writer. A hot payload's rows meet its smallest id by digest and salt, and that id comes from a combined aggregate."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    known = F.octet_length("payload") >= least
    first = p.where(known).groupBy(F.col("payload_digest").alias("first_key")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = Scratch(pages.sparkSession, "warc-digests").write(first, "digests")
    rows = sifted(p, ["payload_digest"], first, ["first_key"], first.count()).withColumn("__hit", F.col("__hit") & known)
    none = F.lit(None).cast(first.schema["first_id"].dataType)
    met = with_lookup(rows.where("__hit").withColumn("__id", F.xxhash64("page_id", "url")), "payload_digest", "__id", first.withColumn("__known", F.lit(True)), "first_key").drop("__id", "__hit")
    p = rows.where("not __hit").drop("__hit").withColumn("first_id", none).withColumn("__known", F.lit(False)).unionByName(met)
    revisit = F.coalesce("__known", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return p.select(urn("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("type"), F.col("url").alias("target_uri"), F.when(revisit, urn("first_id")).alias("refers_to"), "payload_digest", F.when(~revisit, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    arrow_rows(pages.sparkSession)
    archive_pages(pages).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, measured from the payload that was read, for revisits that of the response they refer to."""
    register(spark)
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS long)")
    measured = [F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")]
    # Each kind by a frame of its own, since a frame keeps the predicates of its first query.
    responses = spark.read.format("warc").load(path).where(F.col("type") == "response").select("record_id", *measured)
    responses = Scratch(spark, "warc-responses").write(responses, "responses")
    revisits = spark.read.format("warc").option("payload", "false").load(path).where(F.col("type") == "revisit").select("record_id", "refers_to", "payload_digest")
    # Equal rows of a smallest id are all responses: one of them answers.
    sizes = responses.groupBy(F.col("record_id").alias("response_id"), F.col("payload_digest").alias("response_digest")).agg(F.first("payload_bytes").alias("payload_bytes"))
    told = revisits.withColumn("__key", F.concat("refers_to", F.lit(" "), "payload_digest"))
    told = with_lookup(told, "__key", "record_id", sizes.select(F.concat("response_id", F.lit(" "), "response_digest").alias("__of_key"), "payload_bytes"), "__of_key")
    same = [page("record_id").alias("page_id"), "payload_bytes", "payload_digest"]
    return responses.select(*same, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(told.select(*same, F.lit("revisit").alias("record_type"), page("refers_to").alias("refers_to")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of the pages into the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_pages(pages, path)
    return read_pages(spark, path)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
