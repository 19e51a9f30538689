"""Operator 6, WARC archives as a PySpark data source.

The reader plans one partition a file, takes predicates on the record type and on header fields,
parses a record's headers before anything else, and goes past the payload of a record that isn't
wanted without inflating it: members of .gz archives carry their length in the gzip header (the
"sl" extra field); where another writer left that out, the member is inflated and thrown away.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from clauseworks.llm._streams import small_batches
from clauseworks.runtime import shared_dir

#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Bytes after which a task begins another archive, of a batch that the reader yields, and of the first read of a record.
ARCHIVE_BYTES, BATCH_BYTES, HEAD_BYTES = 128 << 20, 4 << 20, 2048
DATE = "1970-01-01T00:00:00Z"

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, content_length long, payload binary, archive string, position long"
#: Column -> header field.
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(value: str | None) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value or "")


def record(kind: str, ident: str | None, uri: str | None, payload: bytes, digest: str | None, refers_to: str | None, length: int | None = None, date: str | None = None) -> bytes:
    """The bytes of one record. A revisit has no payload of its own; `length` is that of the full one."""
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload) if length is None else length}", "", ""]
    block = "\r\n".join(head).encode() + (payload if kind != "revisit" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {_clean(kind)}", f"WARC-Record-ID: {_clean(ident)}", f"WARC-Date: {_clean(date) or DATE}", f"WARC-Target-URI: {_clean(uri)}", "Content-Type: application/http;msgtype=response"]
    if digest:
        lines.append(f"WARC-Payload-Digest: sha256:{_clean(digest)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_clean(refers_to)}", f"WARC-Profile: {_IDENTICAL}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with the lengths of its compressed and original bytes in an extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 24 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if total >> 32 or len(data) >> 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data)) + body + tail


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


def _payload(block: bytes) -> tuple[bytes, int]:
    """The entity of an HTTP message, and the length that its header states (else its own)."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return b"", 0
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    return body, int(stated[1]) if stated else len(body)


def _wanted(headers: dict[str, str], filters: list[tuple[str, str, object]]) -> bool:
    for field, how, value in filters:
        own = headers.get(field)
        own = own.removeprefix("sha256:") if own and field == "warc-payload-digest" else own
        if own is None or (how == "in" and own not in value) or (how == "starts" and not own.startswith(value)):
            return False
    return True


def _until(pull, have: bytes, mark: bytes) -> bytes:
    """have, with more pulled until mark is in it or nothing is left."""
    while mark not in have:
        more = pull()
        if not more:
            break
        have += more
    return have


def records(f, filters: list[tuple[str, str, object]], with_payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(position, headers, block or None) of the wanted records of an open archive, compressed or not."""
    position, size = 0, f.size()
    while position < size:
        f.seek(position)
        first = f.read(HEAD_BYTES)
        if first[:2] == b"\x1f\x8b":
            length = None
            if first[3] & 4 and first[12:14] == b"sl":
                length = struct.unpack("<I", first[16:20])[0]
            inflate = zlib.decompressobj(31)
            out = inflate.decompress(first, HEAD_BYTES)

            def pull(inflate=inflate) -> bytes:
                while not inflate.eof:
                    data = inflate.unconsumed_tail or f.read(1 << 16)
                    if not data:
                        raise ValueError("a compressed record is cut short")
                    if more := inflate.decompress(data, 1 << 20):
                        return more
                return b""

            out = _until(pull, out, b"\r\n\r\n")
            head, _, rest = out.partition(b"\r\n\r\n")
            headers = _headers(head)
            wanted = _wanted(headers, filters)
            take = wanted and (with_payload or headers.get("warc-type") == "revisit")
            if take or length is None:
                parts = [rest] if take else []
                while more := pull():
                    if take:
                        parts.append(more)
            if length is None:
                length = f.tell() - position - len(inflate.unused_data)
            n = int(headers.get("content-length", 0))
            if wanted:
                yield position, headers, b"".join(parts)[:n] if take else None
            position += length
        else:
            out = _until(lambda: f.read(1 << 16), first, b"\r\n\r\n")
            head, found, _ = out.partition(b"\r\n\r\n")
            if not found:
                if out.strip():
                    raise ValueError(f"no WARC record at {position}")
                return
            headers = _headers(head)
            start, n = position + len(head) + 4, int(headers.get("content-length", 0))
            if _wanted(headers, filters):
                block = None
                if with_payload or headers.get("warc-type") == "revisit":
                    f.seek(start)
                    block = f.read(n)
                yield position, headers, block
            position = start + n + 4


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


#: What a write job leaves: a folder of archives, and in it the names of those that count.
BATCH, MANIFEST = re.compile("batch-[0-9a-f]{32}"), "_manifest"


def _paths(root: str) -> list[str]:
    """The archives under root. In a folder of a write job only those that its manifest names count, none without one."""
    store, base = _store(root)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [base]
    files = [x.path for x in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File]
    written = {}
    for path in files:
        folder, _, name = path.rpartition("/")
        if name == MANIFEST:
            with store.open_input_stream(path) as f:
                written[folder] = set(f.read().decode().split())

    def counts(path: str) -> bool:
        folder, _, name = path.rpartition("/")
        return not BATCH.fullmatch(folder.rpartition("/")[2]) or name in written.get(folder, ())

    return sorted(x for x in files if x.endswith((".warc", ".warc.gz")) and "/_" not in x.removeprefix(base) and counts(x))


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and prefixes of header fields; the rest stays with Spark."""
        for x in filters:
            field = FIELDS.get(x.attribute[0]) if len(getattr(x, "attribute", ())) == 1 else None
            if field and isinstance(x, EqualTo) and x.value is not None:
                self.filters.append((field, "in", {x.value}))
            elif field and isinstance(x, In):
                self.filters.append((field, "in", {v for v in x.value if v is not None}))
            elif field and isinstance(x, StringStartsWith):
                self.filters.append((field, "starts", x.value))
            else:
                yield x

    def partitions(self) -> list[Archive]:
        return [Archive(p) for p in _paths(self.root)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"payload_bytes": pa.int64(), "content_length": pa.int64(), "payload": pa.binary(), "position": pa.int64()}
        store, _ = _store(self.root)
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        with store.open_input_file(partition.path) as f:
            for position, headers, block in records(f, self.filters, self.with_payload):
                payload, stated = _payload(block) if block is not None else (None, None)
                digest = headers.get("warc-payload-digest")
                head = [headers.get(FIELDS[n]) or None for n in names[:4]]
                rows.append((*head, digest and digest.removeprefix("sha256:"), headers.get("warc-refers-to"), stated, int(headers.get("content-length", 0)), payload if headers.get("warc-type") != "revisit" else None, partition.path, position))
                size += 500 + len(payload or b"")
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write under names of their own to a folder of the job; what they wrote counts once its manifest is there.

    So a commit moves no archives, jobs that write to one place don't meet, and what lost attempts left is never read.
    An overwriting job takes away the archives that were there when it commits, after its own count.
    """

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.root = options["path"]
        self.archive_bytes = int(options.get("archiveBytes", ARCHIVE_BYTES))
        self.overwrite = overwrite
        self.batch = f"batch-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _store(self.root)
        files, out = [], None
        try:
            for b in iterator:
                columns = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                for i in range(b.num_rows):
                    if out is None:
                        store.create_dir(f"{base}/{self.batch}", recursive=True)
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(f"{base}/{self.batch}/{files[-1]}", compression=None)
                    x = {n: c[i].as_py() for n, c in columns.items()}
                    payload = x.get("payload") or b""
                    payload = payload.encode("utf-8", "replace") if isinstance(payload, str) else payload
                    out.write(member(record(x["record_type"], x.get("record_id"), x.get("target_uri"), payload, x.get("payload_digest"), x.get("refers_to"), x.get("payload_bytes"), x.get("date"))))
                    if out.tell() >= self.archive_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.root)
        store.create_dir(base, recursive=True)
        before = _paths(self.root) if self.overwrite else []
        names = sorted(name for m in messages if m for name in m.files)
        folder = f"{base}/{self.batch}"
        if names:
            with store.open_output_stream(f"{folder}/{MANIFEST}.part", compression=None) as out:
                out.write("\n".join(names).encode())
            store.move(f"{folder}/{MANIFEST}.part", f"{folder}/{MANIFEST}")
        for path in before:
            store.delete_file(path)
        for old in {p.rpartition("/")[0] for p in before}:
            if BATCH.fullmatch(old.rpartition("/")[2]):
                store.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _store(self.root)
        if store.get_file_info(f"{base}/{self.batch}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.batch}")


class Warc(DataSource):
    """format("warc"): reads a .warc or .warc.gz file or a folder of them; appends folders of .warc.gz, or overwrites.

    Reading options: path; payload (false: no payload is decoded at all). Writing options: path,
    archiveBytes. A file that isn't there or a folder without archives reads as no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def write_archives(pages: DataFrame, path: str, ident: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> None:
    """A record for each row. Of equal payloads of `least` bytes or more the row of least id is a response, others revisit it.

    The payload is html in UTF-8 (null: empty). Smaller payloads, and rows with a null id, are all
    responses; rows that repeat the least id are responses too. Only ids and digests are grouped;
    the least id of a digest is found with a partial aggregate, so a digest with a third of all
    rows is no burden, and the join back to the pages is on the id. Extra columns are ignored.
    """
    small_batches(pages.sparkSession, 1000)
    given = pages.select(F.col(ident).cast("long").alias("id"), F.col(url).cast("string").alias("target_uri"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    given = given.withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    long = given.where(F.col("payload_bytes") >= least).where("id is not null").select("id", "payload_digest")
    first = long.groupBy("payload_digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("payload_digest", "first")
    again = long.join(first, "payload_digest").where("id <> first").select(F.col("id").alias("__id"), F.col("payload_digest").alias("__digest"), "first").distinct()
    joined = given.join(again, (given.id == again["__id"]) & (given.payload_digest == again["__digest"]), "left")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    repeat = F.col("first").isNotNull()
    out = joined.select(
        urn(F.col("id")).alias("record_id"),
        F.when(repeat, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(repeat, F.lit("")).otherwise(F.col("payload")).alias("payload"),
        "payload_digest",
        urn(F.col("first")).alias("refers_to"),
        "payload_bytes",
    )
    register(pages.sparkSession)
    out.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under path; filters on record_type and header columns reach the reader."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, then read them back: digests of responses come from their decoded payloads."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    whole = read_archives(spark, path).where("record_type = 'response'")
    whole = whole.select(page(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_archives(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
    return whole.unionByName(again)


OP6_SQL = f"""
with p as (
  select page_id, coalesce(html, '') as payload, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages
), f as (
  select *, min(page_id) over (partition by payload_digest) as first from p
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= {LEAST_REVISIT} and page_id <> first then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= {LEAST_REVISIT} and page_id <> first then first end as refers_to
from f
"""
