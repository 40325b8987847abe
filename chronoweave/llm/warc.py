"""WARC archives, written with an index and read back by byte ranges.

Writing: every row becomes one record, in a gzip member of its own. Of records with equal payloads of at least
`least_bytes`, that with the largest id is a response and the others are revisits of it. Each task writes one archive
under a name of its own to the shared folder, and gives an index row (offset, length, URL, digest, ...) per record; the
index is a table written once, so an archive of a failed or repeated attempt is never referred to.

Reading: selected index rows are sorted by archive and offset; neighbouring ranges are joined into one read.

Nulls: a null payload is empty, a null URL is the empty text; a record with a null id never is the one that others
revisit, unless all of them are null (then all are responses). Rows of equal id and payload are of one kind. Line ends in
a URL are percent-encoded. Payloads of any length are written whole, and a damaged one fails the reading. Columns other than
id, URL and payload are not read, so their names don't matter. An empty table gives an empty index."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared_path

#: Ranges at most this far apart are read at once, and at most so much of an archive belongs to one reading group.
GAP, GROUP = 1 << 16, 32 << 20
_HEADER = re.compile(rb"([A-Za-z-]+): (.*)\r\n")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(record_id: str, url: str, payload: bytes, size: int, digest: str, refers_to: str | None, date: str, content_type: str) -> bytes:
    """A response record, or, given the record it refers to, a revisit record, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:record:{record_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\n" in url or "\r" in url else f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:record:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    coder = zlib.compressobj(1, zlib.DEFLATED, 31)
    return coder.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + coder.flush()


def parse(member: bytes) -> dict:
    """A record's fields: record_id, url, record_type, digest, refers_to, payload, payload_bytes.

    A response's payload is held against the size and digest of its headers; a revisit's are those of the payload it refers to."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.decode(): v.decode() for k, v in _HEADER.findall(head + b"\r\n")}
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    bare = lambda x: x.removeprefix("<urn:record:").removesuffix(">")
    size = int(dict(_HEADER.findall(http.partition(b"\r\n")[2] + b"\r\n"))[b"Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of record {fields['WARC-Record-ID']} does not have the size and digest of its headers")
    return {"record_id": bare(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "digest": digest, "refers_to": bare(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload, "payload_bytes": size}


def write_archives(pages: DataFrame, path: str | None = None, *, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", content_type: str = "text/html; charset=utf-8") -> DataFrame:
    """Writes the archives and gives their index: id, url, digest, record_type, refers_to, archive, offset, length."""
    spark = pages.sparkSession
    folder = path or shared_path(spark, "warc")
    kind = pages.schema[id_col].dataType
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    whole = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = whole.select("id", "digest", F.length("payload").alias("size")).where(F.col("size") >= least_bytes)
    first = keys.groupBy(F.col("digest").alias("f_digest")).agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    revisits = keys.join(first, F.col("digest") == F.col("f_digest")).where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "first").distinct()
    revisits = materialize(revisits, "revisits")
    marked = whole.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("id", F.col("id").cast("string").alias("name"), "url", "payload", "digest", F.col("first"), F.col("first").cast("string").alias("first_name"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", kind), T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        archive, offset, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                if out is None:
                    out = system.open_output_stream(f"{base}/{archive}", compression=None)
                offsets, lengths, types = [], [], []
                for name, url, body, digest, first_name in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4, 6))):
                    member = record(name or "", url, body, len(body), digest, first_name, date, content_type)
                    out.write(member)
                    offsets.append(offset)
                    lengths.append(len(member))
                    types.append("response" if first_name is None else "revisit")
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), pa.array(types, pa.string()), batch.column(5), pa.array([archive] * batch.num_rows, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], schema.names)
        finally:
            if out is not None:
                out.close()

    index = materialize(marked.mapInArrow(run, schema), "warc-index")
    return index.withColumn("archive", F.concat(F.lit(f"{folder}/"), F.col("archive"))).withColumnsRenamed({"id": id_col})


def read_records(index: DataFrame, *, gap: int = GAP, group: int = GROUP) -> DataFrame:
    """The records of the index rows given: record_id, url, record_type, digest, refers_to (as texts), payload, payload_bytes."""
    schema = "record_id string, url string, record_type string, digest string, refers_to string, payload binary, payload_bytes long"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(system, base: str, wanted: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        with system.open_input_file(base) as f:
            k = 0
            while k < len(wanted):
                n, end = k, wanted[k][0]
                while n < len(wanted) and wanted[n][0] - end <= gap and wanted[n][0] + wanted[n][1] - wanted[k][0] <= max(4 << 20, wanted[k][1]):
                    end, n = wanted[n][0] + wanted[n][1], n + 1
                f.seek(wanted[k][0])
                data, at = f.read(end - wanted[k][0]), wanted[k][0]
                rows = [parse(data[a - at : a - at + b]) for a, b in wanted[k:n]]
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in rows], pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c == "payload_bytes" else pa.string()) for c in names]))
                k = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, wanted = None, []
        for batch in batches:
            for name, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if wanted and (name != archive or len(wanted) >= 4096):
                    yield from read(*_file_system(archive), wanted)
                    wanted = []
                archive = name
                wanted.append((offset, length))
        if wanted:
            yield from read(*_file_system(archive), wanted)

    # as many partitions as groups of archive bytes: left to itself, Spark would size them by the far smaller index
    total = index.agg(F.sum("length")).first()[0] or 0
    places = index.select("archive", "offset", "length").repartition(int(total // group) + 1, "archive", F.expr(f"offset div {group}")).sortWithinPartitions("archive", "offset")
    return places.mapInArrow(run, schema)
