"""WARC archives: writing pages as segmented records, and putting them together again.

Archives are gzip files written and read by Spark alone, so they may lie in any store that
Spark reaches. A response holds an HTTP message with chunked transfer framing. A record whose
block is longer than a segment goes into several: the first keeps the record's type, the
others are continuations that name the first as their origin; the last tells the total
length. Reading groups segments by origin, orders them by number, verifies numbers and total
length, and decodes the framing.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.registry import query, table
from ledgerloom.session import stage, staged_path

SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
#: With segments of 32 KiB an archive holds 64 MiB at most before compression.
RECORDS_PER_ARCHIVE = 2048
REVISIT_BYTES = 100
_END = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for low in range(0, len(payload), CHUNK_BYTES):
        part = payload[low : low + CHUNK_BYTES]
        parts += [b"%x" % len(part), _END, part, _END]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload in a chunked body; a broken framing is an error."""
    parts, at = [], 0
    while True:
        line = body.index(_END, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != _END:
            raise ValueError("a chunk does not end where it should")
        parts.append(body[at : at + size])
        at += size + 2


def _record_name(page_id: int | None, digest: str, part: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest} {part}')}>"


def _head(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block


def records(row: dict) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end them."""
    name = _record_name(row["page_id"], row["digest"])
    revisit = row["first"] is not None
    url = "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"] or "")
    payload = (row["html"] or "").encode()
    block = _HTTP + (b"" if revisit else chunked(payload))
    parts = [block[low : low + SEGMENT_BYTES] for low in range(0, len(block), SEGMENT_BYTES)]
    common = [
        ("WARC-Target-URI", url),
        ("WARC-Page-ID", row["page_id"]),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
    ]
    for number, part in enumerate(parts, 1):
        more = len(parts) > 1
        if number == 1:
            fields = [
                ("WARC-Type", "revisit" if revisit else "response"),
                ("WARC-Record-ID", name),
                ("Content-Type", "application/http; msgtype=response"),
                *common,
                ("WARC-Refers-To", _record_name(row["first"], row["digest"]) if revisit else None),
                ("WARC-Profile", _PROFILE if revisit else None),
            ]
        else:
            fields = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", _record_name(row["page_id"], row["digest"], number)),
                ("WARC-Segment-Origin-ID", name),
            ]
        fields += [
            ("WARC-Instance", row["instance"]),
            ("WARC-Segment-Number", number if more else None),
            ("WARC-Segment-Total-Length", len(block) if more and number == len(parts) else None),
        ]
        yield _head(fields, part)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            rows = batch.slice(low, 256).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for row in rows for r in records(row)], pa.binary())], ["value"]
            )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) to gzip archives in ``path``.

    Of rows with equal html of at least 100 bytes, the one with the smallest page_id is a
    response and the others, those without a page_id too, revisit it. Repeated rows of that
    page are responses all, and so are rows if none has a page_id; they share a record id and
    differ in WARC-Instance, which also tells the segments of repeated rows apart. Null html is
    an empty payload, a null url an empty one. Other columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("instance"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.sha2(html, 256).alias("digest"),
    )
    firsts = (
        rows.filter(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "first")
    )
    later = ~F.col("first").eqNullSafe(F.col("page_id"))
    rows = rows.join(firsts, "digest", "left").select(
        "instance", "page_id", "url", "html", "digest", F.when(later, F.col("first")).alias("first")
    )
    (
        rows.mapInArrow(_encode, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", "\r\n\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_ARCHIVE)
        .text(path)
    )


def _read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of one archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()) not in (_END, b"\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]):
            raise ValueError("a record is cut off")
        yield fields, block


_SEGMENT = pa.schema(
    [
        ("origin", pa.string()), ("instance", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("stated", pa.string()), ("refers", pa.string()), ("number", pa.int32()), ("total", pa.int64()),
        ("block", pa.binary()),
    ]
)
_SEGMENT_SQL = (
    "origin string, instance string, kind string, page_id long, url string, stated string,"
    " refers string, number int, total long, block binary"
)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows: list[dict] = []
            held = 0
            for fields, block in _read_records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                page = fields.get("warc-page-id")
                total = fields.get("warc-segment-total-length")
                rows.append(
                    {
                        "origin": fields.get("warc-segment-origin-id") or fields["warc-record-id"],
                        "instance": fields.get("warc-instance"),
                        "kind": fields["warc-type"],
                        "page_id": int(page) if page else None,
                        "url": fields.get("warc-target-uri"),
                        "stated": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                        "refers": fields.get("warc-refers-to"),
                        "number": int(fields.get("warc-segment-number", 0)),
                        "total": int(total) if total else None,
                        "block": block,
                    }
                )
                held += len(block)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _SEGMENT)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _SEGMENT)


def _payloads(keep: bool):
    """Put blocks together and take the payload out of them; drop it again unless ``keep``.

    A record without a block, or whose blocks do not have its total length, has no payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, digests, payloads = [], [], []
            for kind, total, blocks in zip(batch["kind"], batch["total"], batch["blocks"], strict=True):
                payload, total = None, total.as_py()
                block = b"".join(blocks.as_py()) if kind.as_py() == "response" and blocks.is_valid else None
                if block is not None and total in (None, len(block)):
                    head, _, body = block.partition(b"\r\n\r\n")
                    framed = b"transfer-encoding: chunked" in head.lower()
                    payload = unchunked(body) if framed else body
                lengths.append(None if payload is None else len(payload))
                digests.append(None if payload is None else hashlib.sha256(payload).hexdigest())
                payloads.append(payload if keep else None)
            out = [batch[n] for n in ("origin", "kind", "page_id", "url", "stated", "refers")]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(lengths, pa.int64()), pa.array(digests, pa.string()), pa.array(payloads, pa.binary())],
                ["origin", "kind", "page_id", "url", "stated", "refers", "n_bytes", "digest", "payload"],
            )

    return run


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record in the archives of ``path``, with its whole payload.

    A revisit has the length and digest of the response that it refers to, and no payload of
    its own. ``intact`` is false where segments are missing, the total length is not met, a
    digest differs from the stated one, or a revisit's response is missing; length and digest
    are then null as far as they are not known. An archive that is cut off is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    parts = files.select("content").mapInArrow(_decode, _SEGMENT_SQL)
    fields = ["origin", "kind", "page_id", "url", "stated", "refers", "total", "blocks"]
    head = lambda name: F.max(F.when(F.col("number") == 1, F.col(name))).alias(name)
    reassembled = (
        parts.filter("number > 0")
        .groupBy("origin", "instance")
        .agg(
            *(head(n) for n in ("kind", "page_id", "url", "stated", "refers")),
            F.max("total").alias("total"),
            F.max("number").alias("last"),
            F.countDistinct("number").alias("seen"),
            F.collect_set(F.struct("number", "block")).alias("parts"),
        )
        .withColumn(
            "blocks",
            F.when(
                (F.col("last") == F.col("seen")) & (F.size("parts") == F.col("seen")) & F.col("total").isNotNull(),
                F.transform(F.array_sort("parts"), lambda x: x["block"]),
            ),
        )
        .filter("kind IS NOT NULL")
    )
    alone = parts.filter("number = 0").withColumns({"total": F.lit(None).cast("long"), "blocks": F.array("block")})
    whole = alone.select(*fields).union(reassembled.select(*fields))
    found = whole.mapInArrow(
        _payloads(payloads),
        "origin string, kind string, page_id long, url string, stated string, refers string,"
        " n_bytes long, digest string, payload binary",
    )
    found = stage(found, "records")
    seen = found.filter("kind = 'response'").select(
        F.col("origin").alias("refers"),
        F.col("page_id").alias("refers_to"),
        F.col("n_bytes").alias("seen_bytes"),
        F.col("digest").alias("seen_digest"),
    ).dropDuplicates(["refers"])
    # Only revisits are joined: all other rows have the same key, none.
    others = found.filter("kind != 'revisit'").withColumns(
        {c: F.lit(None).cast(t) for c, t in seen.dtypes if c != "refers"}
    )
    revisits = found.filter("kind = 'revisit'").join(seen, "refers", "left")
    digest = F.coalesce("digest", "seen_digest")
    return others.unionByName(revisits).select(
        "page_id",
        "url",
        F.col("kind").alias("record_type"),
        "refers_to",
        F.coalesce("n_bytes", "seen_bytes").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "payload",
        F.coalesce(digest == F.col("stated"), F.lit(False)).alias("intact"),
    )


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to, TRUE AS intact
FROM f
"""


@query("op4_warc", OP4_SQL)
def _op4(spark, folder):
    path = staged_path(spark, "archives")
    write_archives(table(spark, folder, "pages"), path)
    return read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"
    )
