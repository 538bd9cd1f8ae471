"""WARC archives: writing, and normalising of monolithic gzip files.

write_pages() lets each task stream its pages into archives that are one gzip
member from start to end, the way careless crawlers write them. Such a file
can't be read from the middle. normalise() inflates each of them once, in
pieces, writes every record as a gzip member of its own, turns records whose
payload another record has into revisits, and leaves a sidecar index of member
offsets next to the archive. read_archives() takes the offsets from the sidecar
and fetches single members. Payloads never cross the network: only digests are
shuffled. A task's attempt writes files under names of its own, which its rows
give, so an attempt that is lost or repeated leaves files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable, work_dir

#: Bytes of whole records after which a task starts another archive; bounds the records of an archive, empty ones too.
ROLL_BYTES = 32 << 20
READ_BYTES = 1 << 18
READ_ROWS = 4096
MAX_PARTITIONS = 1 << 16
DATE = "2000-01-01T00:00:00Z"
#: Header fields of our own, as page ids have none in the format.
PAGE_FIELD, REFERS_FIELD = "Lodestrata-Page-Id", "Lodestrata-Refers-To-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a folder as Spark names it."""
    if folder.startswith("dbfs:/"):
        folder = "/dbfs/" + folder[len("dbfs:/") :].lstrip("/")
    for own, other in (("s3a://", "s3://"), ("s3n://", "s3://")):
        folder = other + folder[len(own) :] if folder.startswith(own) else folder
    return fs.FileSystem.from_uri(folder)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def http_head(payload_bytes: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes


def clean(value: str) -> str:
    """A header value without line breaks or other controls."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def response_fields(key: str, page_id: int | None, url: str | None, digest: str) -> dict[str, str]:
    fields = {"WARC-Type": "response", "WARC-Record-ID": record_name(key), "WARC-Date": DATE, "WARC-Target-URI": url or "about:blank", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    return fields | ({} if page_id is None else {PAGE_FIELD: str(page_id)})


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed stream, holding one record at a time."""
    held = bytearray()

    def fill() -> bool:
        for chunk in chunks:
            held.extend(chunk)
            return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill():
                if held.strip():
                    raise ValueError("the archive ends inside a record's head")
                return
        version, *lines = held[:end].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        start, size = end + 4, int(fields["Content-Length"])
        while len(held) < start + size + 4:
            if not fill():
                raise ValueError("the archive ends inside a record")
        yield fields, bytes(held[start : start + size])
        del held[: start + size + 4]


def inflate(stream) -> Iterator[bytes]:
    """The contents of a gzip stream of one or more members, in pieces."""
    inflater = zlib.decompressobj(31)
    while data := stream.read(READ_BYTES):
        while data:
            if piece := inflater.decompress(data, READ_BYTES * 8):
                yield piece
            data = inflater.unconsumed_tail
            if inflater.eof:
                data, inflater = inflater.unused_data, zlib.decompressobj(31)
    if piece := inflater.flush():
        yield piece


def gzipped(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


WRITTEN = "archive string, ordinal long, page_id long, payload_bytes long, payload_digest string, sha256 string"
INDEXED = "archive string, sidecar string, n_records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _write_batches(folder: str, roll_bytes: int):
    schema = _arrow(WRITTEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        task = TaskContext.get()
        out = packer = None
        number = ordinal = size = 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                payload = html.as_py()
                if out is None:
                    # An attempt has files of its own; only those of the attempt whose rows count are ever looked at.
                    name = f"{task.partitionId()}-{number}-{task.taskAttemptId()}.warc.gz"
                    out, packer = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    number, ordinal, size = number + 1, 0, 0
                digest = payload_digest(payload)
                key = f"page:{page_id}" if page_id is not None else f"{name}:{ordinal}"
                made = record(response_fields(key, page_id, url, digest), http_head(len(payload)) + payload)
                out.write(packer.compress(made))
                rows.append((name, ordinal, page_id, len(payload), digest, hashlib.sha256(payload).hexdigest()))
                ordinal, size = ordinal + 1, size + len(made)
                if size >= roll_bytes:
                    out.write(packer.flush())
                    out.close()
                    out = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if out is not None:
            out.write(packer.flush())
            out.close()

    return run


def write_pages(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes monolithic archives into folder; the rows say what is where: see WRITTEN."""
    _make_folder(folder)
    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), as_bytes(F.col("html")).alias("html"))
    return durable(columns.mapInArrow(_write_batches(folder, roll_bytes), WRITTEN), "warc-written")


def _make_folder(folder: str) -> None:
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)


def _normalise_archive(source: str, target: str):
    schema = _arrow(INDEXED)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ordinal")
        plan = zip(*(table.column(c).to_pylist() for c in ("page_id", "payload_bytes", "revisit", "refers_to")), strict=True)
        source_name = table.column("archive")[0].as_py()
        (store, root), (target_store, target_root) = store_of(source), store_of(target)
        name = f"{source_name.removesuffix('.warc.gz')}-{TaskContext.get().taskAttemptId()}.warc.gz"
        sidecar = f"{name}.index.jsonl"
        n = at = 0
        with (
            store.open_input_stream(f"{root}/{source_name}", compression=None) as stream,
            target_store.open_output_stream(f"{target_root}/{name}", compression=None) as out,
            target_store.open_output_stream(f"{target_root}/{sidecar}", compression=None) as index,
        ):
            for (fields, block), (page_id, payload_bytes, revisit, refers_to) in zip(parse_records(inflate(stream)), plan, strict=True):
                del fields["Content-Length"]
                if revisit:
                    fields |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": record_name(f"page:{refers_to}"), REFERS_FIELD: str(refers_to)}
                    block = http_head(payload_bytes)
                member = gzipped(record(fields, block))
                out.write(member)
                index.write(json.dumps({"offset": at, "length": len(member), "page_id": page_id}).encode() + b"\n")
                n, at = n + 1, at + len(member)
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip((name, sidecar, n), schema, strict=True)], schema=schema)

    return run


def _dealt(df: DataFrame, archives: int) -> DataFrame:
    """df with about a partition for each archive, which is a task's worth of work however few rows describe it."""
    return df.repartition(min(MAX_PARTITIONS, max(1, archives)), "archive")


def normalise(written: DataFrame, source: str, target: str, min_bytes: int = 0) -> DataFrame:
    """Rewrites the archives of source into target; the rows name the new archives and their sidecars: see INDEXED."""
    _make_folder(target)
    keepers = written.filter(F.col("payload_bytes") >= min_bytes).groupBy("sha256").agg(F.max("page_id").alias("refers_to"))
    revisit = F.col("refers_to").isNotNull() & ~F.col("refers_to").eqNullSafe(F.col("page_id")) & (F.col("payload_bytes") >= min_bytes)
    plan = written.join(keepers, "sha256", "left").select("archive", "ordinal", "page_id", "payload_bytes", revisit.alias("revisit"), "refers_to")
    archives = written.select("archive").distinct().count()
    return durable(_dealt(plan, archives).groupBy("archive").applyInArrow(_normalise_archive(source, target), INDEXED), "warc-index")


def read_sidecar(folder: str, sidecar: str) -> Iterator[dict]:
    """The entries of a sidecar: offset and length of a member, page_id of its record."""
    store, root = store_of(folder)
    with store.open_input_stream(f"{root}/{sidecar}", compression=None) as file:
        held = b""
        while data := file.read(READ_BYTES):
            *lines, held = (held + data).split(b"\n")
            yield from map(json.loads, lines)


def _read_record(member: bytes) -> tuple:
    ((fields, block),) = parse_records(iter([zlib.decompress(member, 31)]))
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError("damaged payload")
    page_id, refers_to = fields.get(PAGE_FIELD), fields.get(REFERS_FIELD)
    return page_id and int(page_id), length, digest, fields["WARC-Type"], refers_to and int(refers_to)


def _read_batches(folder: str):
    schema = _arrow(READ)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        rows = []
        for batch in batches:
            for name, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    for entry in read_sidecar(folder, sidecar):
                        file.seek(entry["offset"])
                        rows.append(_read_record(file.read(entry["length"])))
                        if len(rows) >= READ_ROWS:
                            yield made(rows)
                            rows = []
        if rows:
            yield made(rows)

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives that index lists, read member by member at the sidecar's offsets; payloads are checked against their digests. Columns: see READ."""
    archives = index.count()
    return _dealt(index.select("archive", "sidecar"), archives).mapInArrow(_read_batches(folder), READ)


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes a record per row of pages(page_id, url, html), normalises the archives and reads them back: see READ.

    Null html is an empty payload. Of equal payloads of at least min_bytes, the
    record with the largest page_id is a response and others revisit it; rows
    that repeat that page_id are all responses, rows without a page_id revisit
    one that has any, else they are responses. Other columns are not read. No
    rows give no rows. A payload has to fit in a task, an archive doesn't.
    """
    folder = folder or f"{work_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    source, target = f"{folder}/monolithic", f"{folder}/members"
    return read_archives(normalise(write_pages(pages, source), source, target, min_bytes), target)
