"""Web archives: one gzip member per record, read back sequentially.

``write`` makes a record of each page. Of records with equal payloads, that with the largest page_id is a *response* and the others
*revisit* it: they hold the HTTP head, with the full payload's length and digest, and name the response. Records go into archives of about
``ARCHIVE`` bytes, rows of bytes that Spark writes to the cluster's shared folder (executors share no other). ``read`` goes through an
archive's bytes in order: it inflates member by member in steps of ``STEP`` bytes, frames the block by its content length, and verifies
the payload's digest.

Defined results: null html is an empty payload; null url leaves out the target; control characters in a url are percent-encoded; equal rows
(same page_id and payload) are all responses, and of equal payloads those without a page_id revisit the one with the largest (all are responses if none has one); very long pages are written and read whole; an empty table gives no archives; extra columns are ignored.
Of archives by other writers, records that are neither response nor revisit (``warcinfo``, ``request``, ``metadata``) are framed and passed over;
digests are verified where a record has them; a name that isn't one of ours gives a null page_id or refers_to, and a revisit that doesn't tell
the payload's length or digest has null there. A broken record, any kind, raises ``ValueError``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm._stage import bit_table, kept, salted, shared_dir

ARCHIVE, STEP, LEVEL = 1 << 22, 1 << 16, 6
PREFIX = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """A record's bytes; ``response`` is the page that a revisit refers to, None for a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response is None else 'revisit'}",
        f"WARC-Record-ID: <{PREFIX}{name}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if response is not None:
        head += [f"WARC-Refers-To: <{PREFIX}{response}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, archive: int = ARCHIVE) -> DataFrame:
    """(archive, data): the archives' bytes, one row each.

    Only pages whose payload may have copies are moved, spread over ``SALT`` tasks for each payload; the others are written where they are read.
    """
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha"))
    copies = kept(keyed.groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    shared = bit_table(copies, "sha")(F.col("sha"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    alone = keyed.where(~shared).select("page_id", "url", "html", F.lit(None).cast("bigint").alias("refers"))
    rows = alone.unionByName(salted(keyed.where(shared), copies, ["sha"], "left").select("page_id", "url", "html", refers.alias("refers")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for page_id, url, html, response in zip(*(batch.column(i) for i in range(4))):
                held.append(member(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), response.as_py())))
                size += len(held[-1])
                if size >= archive:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)

    def made(members: list[bytes]) -> pa.RecordBatch:
        data = b"".join(members)
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{hashlib.sha1(data).hexdigest()[:16]}.warc.gz"]), pa.array([data], pa.binary())], ["archive", "data"])

    return rows.mapInArrow(run, "archive string, data binary")


def records(data: bytes | memoryview, step: int = STEP) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record, in order; each gzip member is inflated step by step and holds one record."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), bytearray()
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a member")
            part = view[at : at + step]
            try:
                out += z.decompress(part)
            except zlib.error as error:
                raise ValueError("the member isn't gzip") from error
            at += len(part) - len(z.unused_data)
        cut = out.find(b"\r\n\r\n")
        lines = bytes(out[: max(cut, 0)]).decode().split("\r\n")
        if cut < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("not a record")
        header = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if "content-length" not in header:
            raise ValueError("the record has no content length")
        length = int(header["content-length"])
        block = bytes(out[cut + 4 : cut + 4 + length])
        if len(block) != length or out[cut + 4 + length :] != b"\r\n\r\n":
            raise ValueError("the content length doesn't frame the block")
        yield header, block


def page_of(name: str) -> int | None:
    """The page that one of our names stands for."""
    found = re.fullmatch(re.escape(PREFIX) + "(-?[0-9]+)", name.strip("<>"))
    return int(found[1]) if found else None


def agrees(said: str | None, data: bytes) -> bool:
    """Whether a digest header (algorithm:base32 or algorithm:hex) is that of ``data``; a record may have none."""
    if said is None:
        return True
    name, _, value = said.partition(":")
    if name.lower() not in hashlib.algorithms_guaranteed or name.lower().startswith("shake"):
        raise ValueError(f"unknown digest {name}")
    raw = hashlib.new(name.lower(), data).digest()
    return value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=") or value.lower() == raw.hex()


def parsed(header: dict[str, str], block: bytes) -> tuple[int | None, int | None, str | None, str, int | None, bytes | None] | None:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (None for a revisit) of a verified record; None for other kinds."""
    kind = header.get("warc-type")
    if kind is None or "warc-record-id" not in header:
        raise ValueError("the record has no type or no name")
    if not agrees(header.get("warc-block-digest"), block):
        raise ValueError("the block's digest differs")
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", head)
    length, said = int(found[1]) if found else None, header.get("warc-payload-digest")
    name = page_of(header["warc-record-id"])
    if kind == "revisit":
        return name, length, said and said.removeprefix("sha1:"), kind, page_of(header.get("warc-refers-to", "")), None
    if length not in (None, len(payload)) or not agrees(said, payload):
        raise ValueError("the payload's digest or length differs")
    return name, len(payload), digest(payload), kind, None, payload


def read(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload of every record of the archives' ``data``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                out: list[list] = [[] for _ in range(7)]
                for header, block in records(memoryview(data.as_buffer())):
                    found = parsed(header, block)
                    if found is None:
                        continue
                    page_id, n, said, kind, refers, payload = found
                    for column, value in zip(out, (page_id, n, said, kind, refers, header.get("warc-target-uri"), payload)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    return archives.select("data").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``*.warc.gz`` files in any store that Spark reads."""
    return read(spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages).write.parquet(path)
    return read(spark.read.schema("archive string, data binary").parquet(path))
