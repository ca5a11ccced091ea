"""WARC archives with dictionary compression (``.warc.zst``).

Each archive starts with a skippable frame that holds a Zstandard dictionary trained on its own
records; each record is a frame of its own. Tasks write archives of about ``ARCHIVE_BYTES`` of
records straight to the shared file system and hand on their names; what a failed attempt wrote
is in no list and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import handing_back, scratch, shared_dir, stored

REVISIT_BYTES = 1000  # least payload of a revisit record
ARCHIVE_BYTES = 16 << 20
BROADCAST_ROWS = 200_000  # revisits of about 60 bytes each
READ_BYTES = 64 << 20  # archived bytes that a task reads
DICT_BYTES, SAMPLE_BYTES = 32 << 10, 2 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
MAGIC = 0x184D2A5D  # fixed value: the skippable frame of a dictionary
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record, which leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe='%/:?#[]@!$&()*+,;=~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Page id, url, type, referred page, and length and hex digest of the full payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(x) if (x := name.removeprefix("<urn:x-page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To", "")),
    }


def dictionary(records: list[bytes]):
    """Trained on records spread evenly over the archive; of too few, their own bytes serve."""
    import zstandard as zstd

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = records[::step]
    try:
        return zstd.train_dictionary(DICT_BYTES, sample, k=512, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(sample)[:DICT_BYTES], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    import zstandard as zstd

    shared = dictionary(records)
    known = shared.as_bytes()
    press = zstd.ZstdCompressor(level=LEVEL, dict_data=shared)
    return b"".join([struct.pack("<II", MAGIC, len(known)), known, *map(press.compress, records)])


def read_archive(stream):
    """Records of an archive, one at a time; the stream is read in pieces."""
    import zstandard as zstd

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("the archive does not start with a dictionary")
    press = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(stream.read(size)))
    piece, frame, out = b"", press.decompressobj(), []
    while piece := piece or stream.read(1 << 20):
        out.append(frame.decompress(piece))
        piece = b""
        if frame.eof:
            yield b"".join(out)
            piece, frame, out = frame.unused_data, press.decompressobj(), []
    if out:
        raise ValueError("the archive ends within a record")


def _write(folder: str):
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)

        def flush(records):
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            data = archive(records)
            with store.open_output_stream(path, compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(records)], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "records", "bytes"])

        store.create_dir(root, recursive=True)
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                columns = (batch.column(c).slice(at, 64).to_pylist() for c in ("page_id", "url", "html", "refers_to"))
                for page_id, url, html, refers_to in zip(*columns):
                    held.append(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to))
                    size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def with_targets(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, refers_to``: the page whose equal payload a page revisits, or null.

    Groups of equal payloads are found on ids and digests alone. Where the list of revisits is of at
    most ``BROADCAST_ROWS`` rows it goes to the pages; beyond that the pages of large payloads, and
    no others, are shuffled once by id and digest, which no group of copies shares.
    """
    payload = F.coalesce("html", F.lit(""))
    digest, large = F.unhex(F.sha1(F.encode(payload, "UTF-8"))), F.octet_length(payload) >= REVISIT_BYTES
    keyed = stored(pages.filter(large & F.col("page_id").isNotNull()).select("page_id", digest.alias("digest"), F.octet_length(payload).alias("size")))
    same = keyed.groupBy("digest", "size").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1").select("digest", "size", "target")
    revisits = stored(keyed.join(same, ["digest", "size"]).filter("page_id <> target").select("page_id", "digest", "target").distinct())
    named = pages.select("page_id", "url", "html", digest.alias("digest"))
    none = F.lit(None).cast("long").alias("refers_to")
    if revisits.count() <= BROADCAST_ROWS:
        return named.join(F.broadcast(revisits), ["page_id", "digest"], "left").select("page_id", "url", "html", F.col("target").alias("refers_to"))
    known = large & F.col("page_id").isNotNull()
    moved = named.filter(known).join(revisits.hint("merge"), ["page_id", "digest"], "left").select("page_id", "url", "html", F.col("target").alias("refers_to"))
    return moved.unionByName(named.filter(~known).select("page_id", "url", "html", none))


def write(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Archives all pages below ``folder``; returns it with the list ``(path, records, bytes)``.

    Of pages with equal payloads of at least ``REVISIT_BYTES`` the one with the largest page_id is
    a response and the others revisit it; rows that repeat the largest id, and rows without id,
    are responses. A null html is an empty payload, a null url an empty address. Other columns are
    ignored; an empty table makes no archive.
    """
    folder = folder or shared_dir(pages.sparkSession)
    with scratch(pages.sparkSession) as s:
        archives = stored(with_targets(pages).mapInArrow(handing_back(_write(folder)), "path string, records long, bytes long"))
        s.keep(archives)
    return folder, archives


def read(archives: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of all archived records.

    ``archives(path, bytes)`` are dealt evenly over tasks of about ``READ_BYTES``, and over as many
    as run at once where there are fewer bytes.
    """

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    rows = []
                    for data in read_archive(f):
                        rows.append(parse(data))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                    yield pa.RecordBatch.from_pylist(rows, kinds).select(names)

    n, size = archives.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(n, archives.sparkSession.sparkContext.defaultParallelism), -(-size // READ_BYTES))
    return archives.select("path").repartition(tasks).mapInArrow(handing_back(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
