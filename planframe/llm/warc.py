"""WARC archives: writing pages as (segmented) records, and reading archives back.

Records go through Spark's text sink and come back through its binaryFile source, so the archives may lie
in any store that Spark reaches. A payload is sent in HTTP chunked framing; a block over ``segment``
characters is cut into a first record and continuation records. Reading groups continuations by the origin's
record id, orders them by segment number, checks the total length, and undoes the chunked framing. A record is
named by its page_id and, where rows repeat that or it is null, by a number of its own.
"""

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planframe.llm.common import BROADCAST_ROWS, hot_join, settle, shared_dir

#: Characters of a block in one record; a longer block is continued.
SEGMENT = 32_768

#: Characters in a chunk of the chunked framing.
CHUNK = 8_192

#: Most records in an archive file; with SEGMENT it bounds the compressed bytes that a reading task holds.
ARCHIVE = 3_000

_DATE = "2024-01-01T00:00:00Z"
_ID = "urn:planframe:page:"

#: Stands in a record's name for a page_id that is null.
NAMELESS = "none"
_RECORD_SCHEMA = (
    "page_id long, kind string, refers_to long, digest string, segment int, origin string, total long, declared long, block binary"
)


def digest(payload: bytes) -> str:
    """The SHA-1 of a payload in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(text: str) -> str:
    """A text in chunked transfer framing; sizes are of its UTF-8 bytes."""
    out = []
    for lo in range(0, len(text), CHUNK):
        part = text[lo : lo + CHUNK]
        out.append(f"{len(part.encode()):x}\r\n{part}\r\n")
    return "".join(out) + "0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends early")
        out.append(body[at : at + size])
        at += size + 2


def _line(value: str | None) -> str:
    return "".join(c for c in value or "" if c not in "\r\n")


def records(name: str, url: str | None, payload: str | None, refers_to: str | None, sha: str, length: int) -> list[str]:
    """The WARC records of a page, without the two line ends that follow each; ``name`` and ``refers_to`` are record names."""
    head = ["WARC/1.1", f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{sha}"]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = f"{http}Content-Length: {length}\r\n\r\n"
        head += [f"WARC-Record-ID: <{_ID}{name}>", "WARC-Type: revisit", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
        return ["\r\n".join([*head, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block.encode())}"]) + "\r\n\r\n" + block]
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n{chunked(payload or '')}"
    parts = [block[lo : lo + SEGMENT] for lo in range(0, len(block), SEGMENT)]
    out = []
    for k, part in enumerate(parts):
        own = list(head)
        if k == 0:
            own += [f"WARC-Record-ID: <{_ID}{name}>", "WARC-Type: response", "Content-Type: application/http;msgtype=response"]
        else:
            own += [f"WARC-Record-ID: <{_ID}{name}:{k + 1}>", "WARC-Type: continuation", f"WARC-Segment-Origin-ID: <{_ID}{name}>"]
        if len(parts) > 1:
            own.append(f"WARC-Segment-Number: {k + 1}")
            if k == len(parts) - 1:
                own.append(f"WARC-Segment-Total-Length: {len(block.encode())}")
        out.append("\r\n".join([*own, f"Content-Length: {len(part.encode())}"]) + "\r\n\r\n" + part)
    return out


def record_name(page_id: str, copy: str) -> Column:
    """What names a record: the page_id, with the row's own number where rows repeat the page_id or it is null."""
    return F.concat_ws(".", F.coalesce(F.col(page_id).cast("string"), F.lit(NAMELESS)), F.col(copy).cast("string"))


def write(pages: DataFrame, path: str, least_revisit: int = 0) -> None:
    """Writes ``pages(page_id, url, html)`` as gzipped WARC files below ``path``.

    Of pages with one payload of at least ``least_revisit`` bytes, that with the largest page_id is written
    as response, the others as revisits of it; pages with smaller payloads are responses. A null html is an
    empty payload, a null url an empty one. Rows that repeat a page_id are records of their own, responses
    where they hold their payload's largest page_id. Rows with a null page_id are records of their own too:
    revisits where a page with an id has their payload, else responses, as nothing can refer to them.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    html = F.coalesce("html", F.lit(""))
    seen = pages.select("page_id", "url", F.sha1(html.cast("binary")).alias("_sha"), F.octet_length(html).cast("long").alias("_length"))
    seen = settle(seen, "payloads")
    total = seen.count()
    again = settle(seen.where("page_id is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("page_id"), "again")
    n_again = again.count()
    again = F.broadcast(again) if n_again <= BROADCAST_ROWS else again
    nothing = F.lit(None)
    keys = seen.withColumn("_copy", nothing.cast("long"))
    copied = bool(n_again) or bool(seen.where("page_id is null").limit(1).count())
    if copied:
        # Only rows without an id of their own are written out with their payloads, to have numbers that stay.
        copies = pages.join(again, "page_id", "left_semi").unionByName(pages.where("page_id is null"))
        copies = settle(copies.withColumns({"_sha": F.sha1(html.cast("binary")), "_length": F.octet_length(html).cast("long"), "_copy": F.monotonically_increasing_id()}), "copies")
        keys = keys.where("page_id is not null").join(again, "page_id", "left_anti").unionByName(copies.drop("html"))
    last = keys.where(F.col("_length") >= least_revisit).groupBy("_sha", "_length").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "_copy"))).alias("_last"), F.count(F.lit(1)).alias("_n"))
    last = settle(last.select("_sha", "_length", F.col("_last.page_id").alias("_last"), record_name("_last.page_id", "_last._copy").alias("_name"), "_n").where("_n > 1"), "repeated")
    # Payloads that no other row has join with nothing, and those that many rows have are not dealt by their digest.
    told = hot_join(keys, last, ["_sha", "_length"], "_n", total, "left")
    told = settle(told.withColumn("refers_to", F.when(F.coalesce(F.col("_last") > F.col("page_id"), F.col("_last").isNotNull()), F.col("_name"))), "told")
    revisits = told.where("refers_to is not null")
    gone = revisits.where("_copy is null").select(F.col("page_id").alias("_gone")).unionByName(again.select(F.col("page_id").alias("_gone")))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    columns = [record_name("page_id", "_copy").alias("name"), "url", "html", "refers_to", "_sha", "_length"]
    fresh = {"refers_to": nothing.cast("string"), "_sha": nothing.cast("string"), "_length": nothing.cast("long")}
    responses = pages.where("page_id is not null").join(gone, F.col("page_id") == F.col("_gone"), "left_anti").withColumns(fresh | {"_copy": nothing.cast("long")}).select(*columns)
    if copied:
        kept = copies.join(revisits.where("_copy is not null").select("_copy"), "_copy", "left_anti")
        responses = responses.unionByName(kept.withColumns(fresh).select(*columns))
    revisits = revisits.withColumn("html", nothing.cast("string")).select(*columns)

    def run(batches):
        for batch in batches:
            out = []
            for name, url, text, refers_to, sha, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if refers_to is None:
                    data = (text or "").encode()
                    sha, length = digest(data), len(data)
                else:
                    sha = base64.b32encode(bytes.fromhex(sha)).decode()
                out += records(name, url, text, refers_to, sha, length)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    # Pages are written where they are read, so that no payload is shuffled to be written.
    responses.unionByName(revisits).mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE).text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", errors="replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _name(record_id: str | None) -> str | None:
    return record_id.strip("<>").removeprefix(_ID).split(":")[0] if record_id else None


def _page(record_id: str | None) -> int | None:
    own = _name(record_id).split(".")[0] if record_id else NAMELESS
    return None if own == NAMELESS else int(own)


def parse(data: bytes | io.BufferedIOBase):
    """The records of an archive: (fields, block). Raises ValueError where one does not start or end as it says.

    An archive that is a stream is read a record at a time.
    """
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should start")
        head = line
        while (line := source.readline()) != b"\r\n":
            if not line:
                raise ValueError("a record's head ends early")
            head += line
        fields = _fields(head)
        size = int(fields["content-length"])
        block = source.read(size)
        if len(block) != size or source.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield fields, block


def read_records(spark, path: str) -> DataFrame:
    """One row for each record of the archives below ``path``."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)):
                    length = None
                    if f["warc-type"] == "revisit":
                        length = int(_fields(block.split(b"\r\n\r\n")[0])["content-length"])
                        block = b""
                    total = f.get("warc-segment-total-length")
                    own = f["warc-record-id"]
                    rows.append((_page(own), f["warc-type"], _page(f.get("warc-refers-to")), f["warc-payload-digest"].removeprefix("sha1:"), int(f.get("warc-segment-number", 0)), _name(f.get("warc-segment-origin-id") or own), int(total) if total else None, length, block))
                    held += len(block)
                    if held > 4_000_000 or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _RECORD_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = ["page_id", "kind", "refers_to", "digest", "segment", "origin", "total", "declared", "block"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read(spark, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes, payload, complete) of each page in the archives.

    A payload is put together from its segments; ``complete`` is false, and the payload null, where segments
    are missing, the total length differs, the framing is broken or the digest does not match.
    """
    rows = read_records(spark, path)
    none = F.lit(None).cast("long")
    alone = rows.where("kind <> 'continuation' and segment = 0").select("page_id", F.col("kind").alias("record_type"), "refers_to", "digest", "declared", F.array("block").alias("blocks"), none.alias("total"), F.lit(True).alias("ordered"))
    parts = rows.where("kind = 'continuation' or segment > 0").groupBy("page_id", "origin", "digest")
    # A block has as many segments as its length asks for, and its length bounds the group.
    joined = parts.agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("p"), F.max("total").alias("total"), F.max("segment").alias("last"))
    joined = joined.select("page_id", F.lit("response").alias("record_type"), none.alias("refers_to"), "digest", none.alias("declared"), F.col("p.block").alias("blocks"), F.coalesce("total", F.lit(-1)).alias("total"), (F.size("p") == F.col("last")).alias("ordered"))

    def run(batches):
        for batch in batches:
            out = []
            for page_id, kind, refers_to, sha, declared, blocks, total, ordered in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, length, good = None, declared, True
                if kind == "response":
                    block = b"".join(blocks)
                    ordered = ordered and (total is None or len(block) == total)
                    try:
                        head, _, body = block.partition(b"\r\n\r\n")
                        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                        good = ordered and digest(payload) == sha
                    except ValueError:
                        good = False
                    length = len(payload) if good else None
                out.append((page_id, kind, refers_to, sha, length, payload if good else None, good))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
            names = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "complete"]
            cols = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return alone.unionByName(joined).mapInArrow(run, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, complete boolean")


def round_trip(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex[:12]}"
    write(pages, path, least_revisit)
    return read(spark, path)
