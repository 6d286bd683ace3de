"""WARC writing, monolithic-gzip normalising and indexed reading.

* ``write_archives``: one WARC record per row; each archive is ONE gzip stream over all of its records, the form in
  which many archives are delivered and in which no record can be reached without inflating all before it.
* ``normalise``: inflates such a stream once, in bounded pieces, and rewrites every record as a gzip member of its
  own, with a sidecar index of (offset, length) per record.
* ``read_records``: seeks to the members that the index names; any split of the index can be read by any task.

Archives are written under names of the task attempt, and only a finished attempt reports its names, so a task that
runs again leaves no half-written file in the result. Paths go through ``pyarrow.fs``, so the folder may be local,
HDFS or an object store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anomalytics.llm.common import free_worker, materialize, prepare, scratch_path

MIN_REVISIT = 100
PIECE = 1 << 18
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
INDEX = "path string, offset bigint, length bigint"


def open_store(uri: str):
    """(file system, path) of a URI or local path."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit (``refers_to`` is set) carries the HTTP header and no payload."""
    http = HTTP.format(len(payload)).encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>",
             "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(" " if c in "\r\n" else c for c in url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields (lower-case names), and the payload behind the HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in
              (line.partition(":") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    return {"fields": fields, "payload": payload, "declared": declared}


def records_of(stream, piece: int = PIECE):
    """Whole records of a gzip file, inflated once from front to back; memory holds one piece and one record.

    The file may be one gzip stream or many members one after the other.
    """
    inflate, data = zlib.decompressobj(31), bytearray()
    need = None                                      # bytes of the record at the front, once its header is there
    raw = b""
    while True:
        while True:
            if need is None:
                head = data.find(b"\r\n\r\n")
                if head < 0:
                    break
                size = next(int(x.split(b":")[1]) for x in bytes(data[:head]).split(b"\r\n")
                            if x.lower().startswith(b"content-length:"))
                need = head + 4 + size + 4
            if len(data) < need:
                break
            yield bytes(data[:need])
            del data[:need]
            need = None
        if inflate.eof:
            raw = inflate.unused_data + raw
            inflate = zlib.decompressobj(31)
        raw = inflate.unconsumed_tail or raw or stream.read(piece)
        if not raw:
            if data:
                raise ValueError("the archive ends inside a record")
            return
        data += inflate.decompress(raw, piece)
        raw = b""


def with_roles(pages: DataFrame, id_col: str, payload_col: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds ``_w_digest`` (SHA-256 of the payload) and ``_w_refers`` (the response's id, for revisits)."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    hashed = pages.withColumn("_w_digest", F.sha2(payload, 256))
    first = materialize(
        hashed.where(F.length(payload) >= min_revisit).groupBy("_w_digest")
        .agg(F.min(id_col).alias("_w_first"), F.count("*").alias("_w_n")).where("_w_n > 1 and _w_first is not null")
        .select("_w_digest", "_w_first"), "warc-first")
    refers = F.when(~F.col(id_col).eqNullSafe(F.col("_w_first")), F.col("_w_first"))
    return hashed.join(first, "_w_digest", "left").withColumn("_w_refers", refers).drop("_w_first")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", archive_bytes: int = 64 << 20, level: int = 1) -> DataFrame:
    """Write one record per row to monolithic archives in ``folder``; returns (path, n_records), written once.

    A task starts a new archive after ``archive_bytes`` of records, so no archive grows with the input.
    """
    prepare(pages.sparkSession)
    store = open_store(folder)[0]
    store.create_dir(open_store(folder)[1], recursive=True)

    def write(batches):
        free_worker()
        fs, base = open_store(folder)
        name, sink, deflate, size, n = "", None, None, 0, 0
        done: list[tuple[str, int]] = []

        def close():
            sink.write(deflate.flush())
            sink.close()
            done.append((f"{folder}/{name}", n))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for page_id, url, html, digest, refers in zip(*columns, strict=True):
                if sink is None:
                    name, size, n = f"{uuid.uuid4().hex}.mono.warc.gz", 0, 0
                    sink, deflate = fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, refers)
                sink.write(deflate.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()),
                                              "n_records": pa.array([c for _, c in done], pa.int64())})

    rows = with_roles(pages, id_col, payload_col).select(id_col, url_col, payload_col, "_w_digest", "_w_refers")
    return materialize(rows.mapInArrow(write, "path string, n_records bigint"), "warc-archives")


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite every monolithic archive with a gzip member per record; returns the index (path, offset, length).

    Beside each new archive stands a sidecar file (``.idx``, tab-separated offset, length and record id).
    """
    prepare(archives.sparkSession)
    fs, base = open_store(folder)
    fs.create_dir(base, recursive=True)

    def rewrite(batches):
        free_worker()
        fs, base = open_store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name, at, index, ids = f"{uuid.uuid4().hex}.warc.gz", 0, [], []
                store, source = open_store(path)
                with store.open_input_stream(source, compression=None) as stream, \
                        fs.open_output_stream(f"{base}/{name}", compression=None) as sink:
                    for data in records_of(stream):
                        deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = deflate.compress(data) + deflate.flush()
                        sink.write(member)
                        index.append((at, len(member)))
                        ids.append(data[data.index(b"WARC-Record-ID: ") + 16:].split(b"\r\n", 1)[0].decode())
                        at += len(member)
                with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as sink:
                    sink.write("".join(f"{o}\t{n}\t{i}\n" for (o, n), i in zip(index, ids, strict=True)).encode())
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([f"{folder}/{name}"] * len(index), pa.string()),
                    "offset": pa.array([o for o, _ in index], pa.int64()),
                    "length": pa.array([n for _, n in index], pa.int64())})

    spread = archives.select("path").repartition(max(1, archives.count()))
    return materialize(spread.mapInArrow(rewrite, INDEX), "warc-index")


def read_records(index: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every indexed record.

    The digest of a response is computed from the payload that was read; a revisit names its digest and, in its HTTP
    header, its length.
    """
    prepare(index.sparkSession)
    schema = ("page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, "
              "refers_to string, payload binary")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def read(batches):
        free_worker()
        open_path, handle = None, None
        for batch in batches:
            rows, size = [], 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != open_path:
                    fs, source = open_store(path)
                    handle, open_path = fs.open_input_file(source), path
                found = parse_record(zlib.decompress(handle.read_at(length, offset), 31))
                fields, payload = found["fields"], found["payload"]
                response = fields["warc-type"] == "response"
                rows.append((fields.get("x-page-id"), fields.get("warc-target-uri"), fields["warc-type"],
                             len(payload) if response else found["declared"],
                             hashlib.sha256(payload).hexdigest() if response else fields["warc-payload-digest"].removeprefix("sha256:"),
                             fields.get("x-refers-to-page-id"), payload))
                size += len(payload)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = index.mapInArrow(read, schema)
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def warc_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                    payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to monolithic archives, normalise them and read every record back through the index.

    Of records with equal payloads of at least 100 bytes the one with the smallest id is the response, others revisit
    it; smaller payloads are all responses. Returns the columns of ``read_records``.

    * A null payload is an empty one. A null URL is left out of the record and comes back as null.
    * A null id comes back as null; such a record is never what others refer to, and revisits if another id has the
      payload. Repeated rows give one record each; all rows that repeat the smallest id are responses.
    * Very long payloads are one record each; memory holds one record at a time. Other columns are not read.
    * An empty table gives no archive and an empty result.
    """
    spark = prepare(pages.sparkSession)
    folder = folder or scratch_path(spark, "warc")
    archives = write_archives(pages, f"{folder}/mono", id_col, url_col, payload_col)
    index = normalise(archives, f"{folder}/members")
    return read_records(index, pages.schema[id_col].dataType.simpleString())
