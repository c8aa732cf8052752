"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64 bits.  They are split into ``max_bits // 2 + 1`` parts, so that two
fingerprints that differ in at most ``max_bits`` bits have a part in which they differ in
at most one.  The anchors of a part are the words of a covering code: a Hamming code of
length 2^r - 1 (perfect, covering radius 1) next to the part's remaining bits as they
are.  Every fingerprint has its *home* at the anchor that covers it (distance at most 1)
and *visits* every anchor within covering radius plus one bit (distance at most 2): 17
anchors of a 32-bit part.  If x and y differ in at most one bit of a part, y visits the
home of x, so comparing homes with visitors anchor by anchor finds every link.

2 bits: two parts of 32 bits, 2^27 anchors each, 34 visits a distinct fingerprint.
Copies with one fingerprint are one row here, so a group of copies costs nothing; a
fingerprint has at most 2,080 others within 2 bits, so links are linear in fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickscope.llm.common import broadcast_checked, fresh, materialize, ship
from clickscope.llm.components import connected_components

ship(__name__)

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
_BLOCK = 1 << 16  # shingles counted at once: bounds the memory of a very long text
_BYTE_AT = np.arange(8) * 256
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def simhash(text: bytes | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of a UTF-8 text: a bit is set if it is set in over half of the
    shingles' XXH64.  No words (null, empty, blank): 0."""
    words = (text or b"").lower().split()  # of bytes: A-Z and \x20 \x09-\x0D only
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
        n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=n)
    # how often each of the 8 bytes has each value, times the bits of that value
    seen = np.zeros(2048, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        seen += np.bincount((hashes[at:at + _BLOCK].view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048)
    votes = (seen.reshape(8, 256) @ _BITS_OF).ravel()
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint",
                     shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``df`` plus the fingerprint as a signed long.  Other columns pass through."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            marks = np.fromiter((simhash(x.as_py(), shingle_words, seed) for x in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks.view(np.int64))], [*batch.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.LongType())]))


def _parts(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each part."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def anchors(marks: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each fingerprint (uint64) in the part of ``width`` bits from ``first``: the home
    anchor; and all visits as (row index, anchor)."""
    length = 2 ** ((width + 1).bit_length() - 1) - 1  # of the Hamming code; the other bits are taken as they are
    part = (marks >> np.uint64(first)) & np.uint64(2**width - 1)
    syndrome = np.zeros(len(marks), dtype=np.uint64)
    for i in range(1, length + 1):
        syndrome ^= np.where((part >> np.uint64(i - 1)) & np.uint64(1), np.uint64(i), np.uint64(0))

    def bit(i):  # of Hamming position i >= 1; position 0 is no bit
        return np.where(i > 0, np.uint64(1) << (np.maximum(i, np.uint64(1)) - np.uint64(1)), np.uint64(0))

    home = part ^ bit(syndrome)
    rows = np.arange(len(marks))
    who, where = [rows], [home]
    for i in range(length, width):
        who.append(rows)
        where.append(home ^ np.uint64(1 << i))
    for f in range(1, length + 1):  # codewords at distance 2: flip a pair f, g whose syndrome is this one
        g = syndrome ^ np.uint64(f)
        pick = (syndrome > 0) & (g > np.uint64(f))
        who.append(rows[pick])
        where.append(part[pick] ^ np.uint64(1 << (f - 1)) ^ bit(g[pick]))
    return home, np.concatenate(who), np.concatenate(where)


def links(marks: DataFrame, max_bits: int = MAX_BITS, col: str = "fingerprint") -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints (signed longs) that differ in at
    most ``max_bits`` bits.  A pair may be found in several parts and is then repeated."""
    parts = _parts(max_bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _BLOCK // 8):
                own = whole.column(0).slice(start, _BLOCK // 8).to_numpy(zero_copy_only=False)
                for k, (first, width) in enumerate(parts):
                    home, who, where = anchors(own.view(np.uint64), first, width)
                    for is_home, values, at in ((True, own, home), (False, own[who], where)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at.astype(np.uint64).view(np.int64)),
                             pa.array(values), pa.array(np.full(len(at), is_home))], ["part", "anchor", "mark", "home"])

    distinct = marks.select(F.col(col).alias("mark")).where("mark IS NOT NULL").distinct()
    placed = distinct.mapInArrow(places, "part int, anchor long, mark long, home boolean")
    homes = placed.where("home").select("part", "anchor", F.col("mark").alias("a"))
    visits = placed.where("NOT home").select("part", "anchor", F.col("mark").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return homes.join(visits, ["part", "anchor"]).where(near).select("a", "b")


def mark_components(marked: DataFrame, id_col: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``(fingerprint, root, component_id)`` of every fingerprint in ``marked`` (id,
    fingerprint): ``root`` is the least fingerprint that links reach, ``component_id`` the
    least id of those reached."""
    least = marked.groupBy("fingerprint").agg(F.min(id_col).alias("least_id"))
    roots = connected_components(links(marked, max_bits)).select(F.col("node").alias("fingerprint"), "root")
    rooted = materialize(roots.join(least, "fingerprint"), "rooted")  # only fingerprints that have a link
    of_root = rooted.groupBy("root").agg(F.min("least_id").alias("of_root"))
    linked = rooted.join(of_root, "root").select("fingerprint", "root", "of_root")
    return least.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), F.coalesce("of_root", "least_id").alias("component_id"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """``(id, fingerprint, component_id)``, one row for each row of ``df``.

    ``fingerprint``: 16 hex digits.  ``component_id``: least id reachable over links.
    Null, empty and blank texts have fingerprint 0 and link like any other; repeated rows
    stay; a null id is never a component's id unless all its ids are null; extra columns
    are not read; an empty table gives an empty one."""
    marked = materialize(
        with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "fingerprint",
                         shingle_words, seed).drop("text"), "fingerprints")
    # stored, so that both sides of the join come from an exchange: AQE splits a fingerprint of many copies
    of_mark = materialize(mark_components(marked, "id", max_bits), "components")
    return marked.join(of_mark, "fingerprint").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """The rows of ``df``, one of each component: that of the least id (nulls last; of
    rows with one id the first stored).  Columns are those of ``df``."""
    row, mark = fresh(df, "_row"), fresh(df, "_mark")
    stored = materialize(
        with_fingerprint(df, text_col, mark, shingle_words, seed).withColumn(row, F.monotonically_increasing_id()), "marked")
    marked = stored.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(mark).alias("fingerprint"))
    placed = marked.join(materialize(mark_components(marked.select("id", "fingerprint"), "id", max_bits), "components"), "fingerprint")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    kept = materialize(placed.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row")), "kept")
    dropped = materialize(marked.select("row").join(kept, "row", "left_anti"), "dropped")
    return stored.join(broadcast_checked(dropped.select(F.col("row").alias(row))), row, "left_anti").select(*df.columns)
