"""WARC archives: writing, the monolithic gzip normaliser with its offset index, and reading back.

A *monolithic* archive is one gzip stream over a whole file of records: nothing in it can be read without
inflating all before. :func:`normalise_stream` inflates it once, in chunks, rewrites every record as a gzip
member of its own and returns (offset, length, record id) of each, which become a sidecar index; a record is
then read by one seek. Files live in the folder all executors share and are written under fresh names, so a
task that is run again never meets its own leftovers.

Defined results: a null html is an empty payload, a null url an empty target; a null page_id is written as
``none`` and read back as null; repeated rows give repeated records; an empty table gives no archives and no
rows; extra columns are ignored. Payloads are streamed, so a long one needs no more memory than its row.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import batches as arrow, shared_dir, stage_table

#: Payloads of at least this many bytes become revisits of an equal one.
REVISIT_BYTES = 1000
#: Tasks that share the pages of one payload.
SALTS = 16
CHUNK = 1 << 18
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit that has the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(src: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in bounded chunks."""
    engine = zlib.decompressobj(31)
    while raw := src.read(CHUNK):
        while raw:
            if out := engine.decompress(raw, CHUNK):
                yield out
            if engine.eof:
                raw, engine = engine.unused_data, zlib.decompressobj(31)
            else:
                raw = engine.unconsumed_tail
    while out := engine.decompress(engine.unconsumed_tail, CHUNK):
        yield out


class _Bytes:
    """Reads by line and by count from an iterator of chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def head(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            more = next(self.chunks, None)
            if more is None:
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
            self.held += more
        out = bytes(self.held[: at + 4])
        del self.held[: at + 4]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self.held:
                more = next(self.chunks, None)
                if more is None:
                    raise ValueError("the archive ends inside a record")
                self.held += more
            part = bytes(self.held[:n])
            del self.held[:n]
            n -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def normalise_stream(src: BinaryIO, dst: BinaryIO, level: int = 6) -> Iterator[tuple[int, int, str]]:
    """Rewrite a monolithic archive with a member per record; yields (offset, length, record id)."""
    source, offset = _Bytes(inflated(src)), 0
    while (head := source.head()) is not None:
        known = fields(head)
        engine, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        size += dst.write(engine.compress(head))
        for part in source.take(int(known["content-length"]) + 4):
            size += dst.write(engine.compress(part))
        size += dst.write(engine.flush())
        yield offset, size, known.get("warc-record-id", "")
        offset += size


def parse_member(member: bytes) -> dict:
    """What the query returns of one record: sizes and digests of responses are taken from their payload."""
    raw = zlib.decompress(member, 31)
    at = raw.index(b"\r\n\r\n") + 4
    known = fields(raw[:at])
    block = raw[at : at + int(known["content-length"])]
    cut = block.index(b"\r\n\r\n") + 4
    ident = known["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    out = {"page_id": None if ident == "none" else int(ident), "record_type": known["warc-type"], "refers_to": None}
    if known["warc-type"] == "revisit":
        out |= {
            "payload_bytes": int(fields(block[:cut])["content-length"]),
            "payload_digest": known["warc-payload-digest"].removeprefix("sha1:"),
            "refers_to": int(known["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")),
        }
    else:
        out |= {"payload_bytes": len(block) - cut, "payload_digest": hashlib.sha1(block[cut:]).hexdigest()}
    return out


def _open(uri: str, mode: str):
    """A file of any store that pyarrow knows by its URI; ``file:`` needs nothing else."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path, compression=None)
    return store.open_input_file(path)


def _delete(uri: str) -> None:
    """A file that an earlier attempt of the task has deleted is not missed."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        try:
            store.delete_file(path)
        except FileNotFoundError:
            pass


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages with digest and refers_to: the largest page_id of an equal payload of REVISIT_BYTES or more."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    equal = (
        base.where(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
        .where("n > 1")
        .select(F.col("digest").alias("equal_digest"), "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("equal_salt"))
    )
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(equal, (salted.digest == equal.equal_digest) & (salted.salt == equal.equal_salt) & (salted.size >= REVISIT_BYTES), "left")
    return joined.select("page_id", "url", "html", "digest", F.expr("CASE WHEN last <> page_id OR page_id IS NULL THEN last END").alias("refers_to"))


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """One monolithic archive per partition under ``folder``; returns their URIs."""

    def write(batches):
        import pyarrow as pa

        uri, out, engine = f"{folder}/mono-{uuid.uuid4().hex}.warc.gz", None, zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in batches:
            out = out or _open(uri, "wb")
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                page_id, url, html, digest, refers = (x.as_py() for x in row)
                out.write(engine.compress(record(page_id, url, html.encode(), digest, refers)))
        if out:
            out.write(engine.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri]})

    return stage_table(arrow(pages).mapInArrow(write, "uri string"), "mono-manifest")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive of ``archives`` (uri); returns uri and index of the new files, deletes nothing."""

    def rewrite(batches):
        import pyarrow as pa

        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                with _open(uri, "rb") as src, _open(name, "wb") as dst, _open(f"{name}.idx", "wb") as index:
                    for entry in normalise_stream(src, dst):
                        index.write("{}\t{}\t{}\n".format(*entry).encode())
                yield pa.RecordBatch.from_pydict({"uri": [name], "index": [f"{name}.idx"]})

    return stage_table(_each(archives).mapInArrow(rewrite, "uri string, index string"), "warc-manifest")


def _each(manifest: DataFrame) -> DataFrame:
    """Spread a manifest of files over the cluster."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow(manifest).repartition(max(2, n))


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(archives: DataFrame) -> DataFrame:
    """Rows of every record, each found through the index by its offset."""

    def read(batches):
        import pyarrow as pa

        types = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for uri, index in zip(batch.column("uri").to_pylist(), batch.column("index").to_pylist(), strict=True):
                with _open(uri, "rb") as src, _open(index, "rb") as entries:
                    rows = []
                    for line in io.BufferedReader(entries):
                        offset, length = map(int, line.split(b"\t")[:2])
                        src.seek(offset)
                        rows.append(parse_member(src.read(length)))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, types)

    return _each(archives).mapInArrow(read, SCHEMA)


def archive(pages: DataFrame, folder: str | None = None, keep_monolithic: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as normalised archives; returns uri and index of each file."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    mono = write_monolithic(with_revisits(pages), f"{folder}/mono")
    done = normalise(mono, folder)
    if not keep_monolithic:
        mono.foreachPartition(lambda rows: [_delete(r.uri) for r in rows] and None)
    return done


def query(pages: DataFrame) -> DataFrame:
    return read_records(archive(pages.select("page_id", "url", "html")))
