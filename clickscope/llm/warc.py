"""WARC archives compressed record by record with one Zstandard dictionary.

An archive is a skippable frame that holds the dictionary, then one frame a record, so a
reader with the dictionary can open any record alone.  Spark's text writer puts the frames
down as they are: each row is a frame, and the "line separator" is itself an empty
skippable frame, which Zstandard readers pass over.  So archives are written by tasks under
Spark's commit protocol to any file system, and read back in splits at the same separator.

The dictionary is trained on records of a bounded sample of distinct payloads (those of the
smallest digests: ``sample_records`` at most, ``sample_bytes`` at most); it changes sizes
only.  Payloads are compared by their SHA-256 in one aggregate; the table of payloads that
occur more than once is stored, so Spark knows its size and broadcasts it or shuffles.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickscope.llm.common import materialize, ship
from clickscope.session import shared_path

ship(__name__)

# Fixed values of the formats: frame magic numbers, little endian, and WARC names.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
EMPTY_FRAME = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SEPARATOR = EMPTY_FRAME.decode("ascii")
END = b"\r\n\r\n"
BATCH_BYTES = 16 << 20


@dataclass(frozen=True)
class WarcParams:
    min_bytes: int = 0  # shorter payloads are stored each time
    level: int = 3
    dictionary_bytes: int = 112_640
    sample_records: int = 2_000
    sample_bytes: int = 8 << 20
    date: str = "2026-01-01T00:00:00Z"  # of every record: pages carry no capture time


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1, as archives name payloads."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _header_text(value: str) -> str:
    """A header value on one line: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record_id(page_id: str | None, url: str | None, payload_name: str) -> str:
    """The same for rows of one id, address and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {payload_name} {url}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, first: tuple[str, str | None] | None, date: str) -> bytes:
    """A whole WARC record: a response, or a revisit of ``first`` (its id and address)."""
    name = payload_digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first else http + payload
    head = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, url, name)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _header_text(url)))
    if page_id is not None:
        head.append(("Page-ID", page_id))
    if first:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(first[0], first[1], name)), ("WARC-Refers-To-Date", date)]
        if first[1] is not None:
            head.append(("WARC-Refers-To-Target-URI", _header_text(first[1])))
        head.append(("Refers-To-Page-ID", first[0]))
    head += [("WARC-Payload-Digest", f"sha1:{name}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8") + b"\r\n" + block + END


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record; raises where lengths or digests don't fit."""
    head, end, rest = data.partition(END)
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    length = int(headers["Content-Length"])
    block = rest[:length]
    if lines[0].encode() != VERSION or not end or rest[length:] != END or len(block) != length:
        raise ValueError("not a whole WARC record")
    if headers["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(END)
    return headers, http, payload


def one_frame(data: bytes, compressor: zstandard.ZstdCompressor) -> bytes:
    """``data`` as one frame that does not hold the separator: if the plain one does, its
    blocks are cut at other places until none does."""
    frame = compressor.compress(data)
    step = 1 << 16
    while EMPTY_FRAME in frame:
        if step < 2:
            raise ValueError("no frame without the separator found")
        writer = compressor.compressobj(size=len(data))
        parts = []
        for at in range(0, len(data), step):
            parts += [writer.compress(data[at:at + step]), writer.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)]
        frame, step = b"".join([*parts, writer.flush()]), step // 3
    return frame


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame with the (compressed) dictionary, for an archive's beginning."""
    packed = one_frame(dictionary, zstandard.ZstdCompressor(level=12))
    return DICTIONARY_MAGIC + len(packed).to_bytes(4, "little") + packed


def dictionary_of(frame: bytes) -> bytes:
    content = frame[8:8 + int.from_bytes(frame[4:8], "little")]
    return zstandard.ZstdDecompressor().decompress(content) if content[:4] == ZSTD_MAGIC else content


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def train(samples: list[bytes], params: WarcParams) -> bytes | None:
    """A dictionary from records, or None where they are too few or too short for one."""
    try:
        return zstandard.train_dictionary(params.dictionary_bytes, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def _sample(pages: DataFrame, sums: DataFrame, params: WarcParams) -> list[bytes]:
    """Records of a bounded sample of distinct payloads, for training."""
    n = sums.count()
    share = min(1.0, 8 * params.sample_records / max(n, 1))  # digests are uniform: one in 1 / share
    few = sums.where(F.col("sum") <= f"{int(share * (16 ** 8 - 1)):08x}g").select("sum", "size").distinct()
    chosen, total = [], 0
    for r in few.orderBy("sum").limit(params.sample_records).collect():
        if r["size"] and total + r["size"] <= params.sample_bytes:
            chosen.append((r["sum"],))
            total += r["size"]
    if not chosen:
        return []
    wanted = pages.sparkSession.createDataFrame(chosen, "sum string")
    rows = pages.join(F.broadcast(wanted), "sum", "left_semi").groupBy("sum").agg(  # sample_records rows at most
        F.min(F.struct(F.col("id").cast("string").alias("id"), "url", "html")).alias("p")).orderBy("sum").collect()
    return [record(r.p.id, r.p.url, (r.p.html or "").encode("utf-8"), None, params.date) for r in rows]


def _frames(rows: DataFrame, dictionary: bytes | None, params: WarcParams) -> DataFrame:
    """``id, url, html, first_id, first_url`` as frames, after the dictionary's in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=params.level, dict_data=known, write_checksum=True)
        out, held = [dictionary_frame(dictionary)] if dictionary else [], 0
        for batch in batches:
            for page_id, url, html, first_id, first_url in zip(*[c.to_pylist() for c in batch.columns[:2]], batch.column(2), *[c.to_pylist() for c in batch.columns[3:]]):
                payload = (html.as_py() or "").encode("utf-8")
                out.append(one_frame(record(page_id, url, payload, (first_id, first_url) if first_id is not None else None, params.date), compressor))
                held += len(out[-1])
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return rows.select(F.col("id").cast("string"), "url", "html", F.col("first_id").cast("string"), "first_url").mapInArrow(run, "frame binary")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   params: WarcParams = WarcParams()) -> None:
    """Writes a record for each row of ``pages`` into a new folder ``path``, an archive a
    task, all with one dictionary.

    Of rows with equal payloads of ``min_bytes`` or more, that with the smallest id is a
    response and the others revisit it.  Null html is an empty payload.  Rows that repeat
    the smallest id are each a response; rows without an id are never the first, and if no
    copy has an id, all are responses.  A null url leaves its header out.  Extra columns are
    not read; an empty table gives an empty folder."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    own = own.withColumn("sum", F.sha2(_payload(F.col("html")), 256))
    sums = materialize(own.select("sum", "id", "url", F.octet_length(_payload(F.col("html"))).cast("long").alias("size")), "payloads")
    # min ignores null: a copy without an id is never the first
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    firsts = (sums.where(F.col("size") >= params.min_bytes).groupBy("sum").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
              .where("n > 1 AND first IS NOT NULL").select(F.col("sum").alias("sum_"), "first"))
    firsts = materialize(firsts, "first_copies")
    dictionary = train(_sample(own, sums, params), params)
    joined = own.join(firsts, F.col("sum") == F.col("sum_"), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    rows = joined.select("id", "url", "html", F.when(again, F.col("first.id")).alias("first_id"), F.when(again, F.col("first.url")).alias("first_url"))
    frames = _frames(rows, dictionary, params)
    # rows of raw bytes: the cast keeps them, and the writer adds the separator only
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("page_id", T.StringType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_digest", T.StringType()),
    ("payload_bytes", T.LongType()), ("refers_to", T.StringType()), ("payload", T.BinaryType()))])


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of a folder that ``write_archives`` wrote: ``page_id, url, record_type,
    payload_digest, payload_bytes, refers_to, payload`` (ids as text; the payload is null for
    revisits, whose digest and size are those of the response).  Each record is opened by
    itself; a damaged one raises.  ``url`` is as the header has it."""
    frames = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("frame"))
    leading = F.substring(F.col("frame"), 1, 4) == F.lit(DICTIONARY_MAGIC)
    # one dictionary a call of write_archives
    found = [dictionary_of(bytes(r["frame"])) for r in frames.where(leading).distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dicts = {d.dict_id(): d for d in map(zstandard.ZstdCompressionDict, found)}
        openers = {i: zstandard.ZstdDecompressor(dict_data=d) for i, d in dicts.items()} | {0: zstandard.ZstdDecompressor()}
        for batch in batches:
            out, held = [], 0
            for frame in batch.column(0):
                frame = frame.as_py()
                data = openers[zstandard.get_frame_parameters(frame).dict_id].decompress(frame)
                headers, http, payload = parse(data)
                name = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                revisit = headers["WARC-Type"] == "revisit"
                if revisit:
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", http).group(1))
                else:
                    size = len(payload)
                    if payload_digest(payload) != name:
                        raise ValueError(f"damaged payload in {headers['WARC-Record-ID']}")
                out.append((headers.get("Page-ID"), headers.get("WARC-Target-URI"), headers["WARC-Type"], name, size,
                            headers.get("Refers-To-Page-ID"), payload if with_payload and not revisit else None))
                held += len(data) if with_payload else 0
                if held >= BATCH_BYTES:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return frames.where(~leading).mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], RECORD.fieldNames())


def archived_pages(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back: ``page_id,
    payload_bytes, payload_digest, record_type, refers_to``, one row a page."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, params=params)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, path, with_payload=False).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
