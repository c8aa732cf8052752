"""Phrase collocations: Apriori levels, counted by broadcast double-array tries.

Texts are cut into words once; a word of a language becomes one 64-bit hash (a second word
with the same hash makes the job start again with another seed), a cut between pieces 0, and
every later pass is numpy over stored arrays of hashes.  Three steps follow.

* **Candidates.**  A pair of words can be frequent only if both words are, a longer phrase
  only if all its pairs are.  Of the frequent words, then pairs, a bitmap of fixed
  size is broadcast (a phrase that it doesn't have is not frequent; one that it has by chance
  only costs work).  Positions whose two words are in it are emitted as distinct pairs with
  their number in the task, and those whose sum is below ``min_count`` go.  All longer
  phrases come from one pass: a position emits the longest phrase (``max_words`` at most)
  whose pairs are all frequent, and a shorter phrase's places are the sum over the longer
  ones that begin with it.  Words and first pairs are shuffled as 32 bits and joined back to
  what remains: phrases that share them are counted together, so none is lost, and all of
  them are candidates.
* **Tries.**  The candidates are cut into slices of ``slice_phrases``, each a double array
  (``base``, ``check``) over the slice's own dense word codes, built on the driver and
  broadcast: its size is bounded, however many slices there are.  A task moves the states of
  all positions of a batch one level at a time, counts the accepting ones with bincount, and
  the shards' counts are summed.  All figures of the result come from these counts.
* **Scores** are joins and aggregates over phrases.

The distinct words and phrases are shuffled with their number after a first sum in each task, so a
frequent word or phrase is a row a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickscope.llm.common import materialize, ship
from clickscope.operators.rank import unique_rank
from clickscope.session import shared_path

ship(__name__)

# Fixed values of the contract: where a text is cut into pieces.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
LANG_OF_NULL = "und"

_CUT = b"\xff"  # no UTF-8 text holds it
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz" + _CUT * len(PIECE_ENDS))
_MAP_BITS = 27  # a bitmap of 16 MiB
_BLOCK_BITS = 15  # bits of a block of Spark's bitmap functions
_HELD = 1 << 19  # positions a task holds
_STEP = 1 << 18  # positions handled at once
_VOCABULARY = 1 << 17  # words a task holds


@dataclass(frozen=True)
class CollocationParams:
    min_count: int = 30
    max_words: int = 4
    scale: int = 2_000_000
    absorb_percent: int = 80
    top: int = 2_000
    slice_phrases: int = 250_000


def text_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, a cut mark between and after pieces."""
    if not text:
        return [_CUT]
    return text.translate(_PLAIN).replace(_CUT, b" \xff ").split() + [_CUT]


class Vocabulary:
    """The words of one language in a task: numbers, hashes, places seen."""

    def __init__(self, lang: str, seed: int):
        self.lang, self.seed, self.mark = lang, seed, (lang + "\0").encode("utf-8")
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.hashes, self.seen = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.known, self.waiting, self.held = 0, [], 0

    def code(self, words: list[bytes]) -> np.ndarray:
        """The words' hashes."""
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > self.known:
            if len(self.number) > len(self.hashes):
                more = np.zeros(2 * len(self.number) - len(self.hashes), np.int64)
                self.hashes, self.seen = np.concatenate([self.hashes, more]), np.concatenate([self.seen, more])
            new = list(islice(reversed(self.number), len(self.number) - self.known))[::-1]
            self.hashes[self.known:len(self.number)] = [
                0 if w == _CUT else (xxhash.xxh64_intdigest(self.mark + w, self.seed) - (1 << 63)) or 1 for w in new]
            self.known = len(self.number)
        self.waiting.append(at)
        self.held += len(at)
        if self.held >= _HELD:
            self.count()
        return self.hashes[at]

    def count(self) -> None:
        if self.waiting:
            n = np.bincount(np.concatenate(self.waiting))
            self.seen[:len(n)] += n
            self.waiting, self.held = [], 0

    def rows(self, names: list[str], size: int = 50_000) -> Iterator[pa.RecordBatch]:
        self.count()
        words = iter(self.number)
        for first in range(0, self.known, size):
            part = [w.decode("utf-8", "replace") for w in islice(words, size)]
            h, n = self.hashes[first:first + len(part)], self.seen[first:first + len(part)]
            batch = pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array([self.lang] * len(part)), pa.array(part), pa.array(h), pa.array(n)], names)
            yield batch.filter(pa.array(h != 0))  # 0 is the cut
        self.number.default_factory = None  # else the dictionary holds itself and stays


def _coded(docs: DataFrame, seed: int) -> DataFrame:
    """Rows of two kinds: ``codes`` (the hashes of a text's words, 0 for a cut) and ``lang,
    word, hash, n`` (a word's number of places in a task)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["codes", "lang", "word", "hash", "n"]
        of: dict[str, Vocabulary] = {}

        def texts(rows: list[bytes]) -> pa.RecordBatch:
            null = [pa.nulls(len(rows), t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), *null], names)

        for batch in batches:
            rows, held = [], 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                if lang not in of:
                    of[lang] = Vocabulary(lang, seed)
                codes = of[lang].code(text_words(text.as_py()))
                rows.append(codes.tobytes())
                held += len(codes)
                if held >= _HELD:
                    yield texts(rows)
                    rows, held = [], 0
                if sum(v.known for v in of.values()) >= _VOCABULARY:
                    for v in of.values():
                        yield from v.rows(names)
                    of.clear()
            if rows:
                yield texts(rows)
        for v in of.values():
            yield from v.rows(names)

    return docs.mapInArrow(run, "codes binary, lang string, word string, hash long, n long")


def _stored(coded: DataFrame) -> DataFrame:
    """As ``materialize``, with the codec that finds a text's repeated hashes."""
    path = shared_path(coded.sparkSession, "coded")
    coded.write.option("compression", "zstd").parquet(path)
    return coded.sparkSession.read.parquet(path)


def _values(batch: pa.RecordBatch) -> np.ndarray:
    """The hashes of all texts of a batch, one after the other (each ends in a cut)."""
    texts = batch.column(0)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    return np.frombuffer(texts.buffers()[2], np.int64, int(offsets[-1] - offsets[0]) // 8, int(offsets[0]))


def _steps(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[np.ndarray]:
    """The hashes in steps, each with the ``words - 1`` that follow it: a phrase starts in one."""
    for batch in batches:
        values = _values(batch) if batch.num_rows else np.zeros(0, np.int64)
        for at in range(0, len(values), _STEP):
            yield values[at:at + _STEP + words - 1]


_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit mixture of phrases, given word by word."""
    out = np.zeros(len(columns[0]), np.uint64)
    for column, factor in zip(columns, _MIX):
        out = (out ^ column.view(np.uint64)) * factor
        out ^= out >> np.uint64(29)
    return out


def _bit(columns: list[np.ndarray]) -> np.ndarray:
    return (_mixed(columns) >> np.uint64(64 - _MAP_BITS)).astype(np.int64)


def _names(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def phrase_bitmap(phrases: DataFrame, k: int) -> np.ndarray:
    """Bytes of the bitmap of the phrases ``w1..wk``: 16 MiB, whatever their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_bit([c.to_numpy() for c in batch.columns]))], ["bit"])

    bits = phrases.select(*_names(k)).mapInArrow(run, "bit long")
    blocks = bits.groupBy(F.expr(f"shiftright(bit, {_BLOCK_BITS})").alias("block")).agg(
        F.bitmap_construct_agg(F.expr(f"bit & {(1 << _BLOCK_BITS) - 1}")).alias("bits"))
    out = np.zeros(1 << (_MAP_BITS - 3), np.uint8)
    size = 1 << (_BLOCK_BITS - 3)
    for r in blocks.collect():  # 4,096 blocks at most
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["block"] * size:r["block"] * size + len(part)] = part
    return out


def _has(bitmap: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    bit = _bit(columns)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def distinct_rows(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases and their numbers; by a mixture of their words, and where two phrases
    share one, by the words themselves."""
    _, first, place, n = np.unique(_mixed(columns), return_index=True, return_inverse=True, return_counts=True)
    found = [c[first] for c in columns]
    if all((f[place] == c).all() for f, c in zip(found, columns)):
        return found, n
    rows, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    return [rows[:, i] for i in range(len(columns))], n


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct rows in order and their numbers: neighbours differ little, which packs well."""
    if not len(columns[0]):
        return [*columns, np.zeros(0, np.int64)]
    by = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
    columns = [c[by] for c in columns]
    new = np.zeros(len(by), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    new[0] = True
    first = np.flatnonzero(new)
    return [*(c[first] for c in columns), np.diff(np.r_[first, len(by)])]


def _short(columns: list[np.ndarray]) -> np.ndarray:
    """32 bits of a phrase, given word by word, as a number from 0 on."""
    return (_mixed(columns) >> np.uint64(32)).astype(np.int64)


def _with_short(phrases: DataFrame, k: int) -> DataFrame:
    """``short``, then the words: what stands for the phrases ``w1..wk`` while they are
    counted.  Two may share it, which makes candidates that the tries don't find."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_short([c.to_numpy() for c in batch.columns])), *batch.columns], ["short", *_names(k)])

    return phrases.select(*_names(k)).mapInArrow(run, ", ".join(f"{x} long" for x in ["short", *_names(k)]))


def _word(shorts: DataFrame, i: int) -> DataFrame:
    """``s<i>, w<i>`` of the words by ``short``."""
    return shorts.select(F.col("short").alias(f"s{i}"), F.col("w1").alias(f"w{i}"))


_LOW = (1 << 32) - 1


def frequent_pairs(texts: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """The pairs ``w1, w2`` (stored) that may have ``min_count`` places: both are in the bitmap
    of ``words`` (``w1``) and the sum over all tasks reaches it.  A pair is shuffled as 32
    bits of each of its words."""
    shared = texts.sparkSession.sparkContext.broadcast(phrase_bitmap(words, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held, size = shared.value, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _summed([np.concatenate(held)])], ["pair", "n"])

        for values in _steps(batches, 2):
            part = (values != 0) & _has(bitmap, [values])
            at = np.flatnonzero(part[:-1] & part[1:])
            if len(at):
                short = _short([values])
                held.append((short[at] << 32) | short[at + 1])
                size += len(at)
            if size >= _HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    found = texts.select("codes").mapInArrow(run, "pair long, n long")
    found = materialize(found.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).drop("n"), "short_pairs")
    shared.destroy()
    shorts = materialize(_with_short(words, 1), "short_words")
    found = found.select(F.shiftrightunsigned("pair", 32).alias("s1"), F.col("pair").bitwiseAND(_LOW).alias("s2"))
    return materialize(found.join(_word(shorts, 1), "s1").join(_word(shorts, 2), "s2").select("w1", "w2"), "phrases_2")


def longer_phrases(texts: DataFrame, pairs: DataFrame, min_count: int, max_words: int) -> list[DataFrame]:
    """Of 3, 4, .. ``max_words`` words the phrases ``w1..wk`` that may have ``min_count``
    places: all pairs are in the bitmap of ``pairs`` and the sum over all tasks reaches it.

    A phrase is shuffled as 32 bits of its first pair and of the third word, and 32 bits of
    each further word."""
    shared = texts.sparkSession.sparkContext.broadcast(phrase_bitmap(pairs, 2))
    further = [f"s{i}" for i in range(4, max_words + 1)]  # 0: no such word, else one more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held, size = shared.value, [], 0

        def flush() -> pa.RecordBatch:
            columns = _summed([np.concatenate(c) for c in zip(*held)])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["begin", *further, "n"])

        for values in _steps(batches, max_words):
            if len(values) < 3:
                continue
            pair = (values[:-1] != 0) & (values[1:] != 0)
            pair[pair] = _has(bitmap, [values[:-1][pair], values[1:][pair]])
            at = np.flatnonzero((pair[:-1] & pair[1:])[:_STEP])
            if len(at):
                columns, on = [(_short([values[at], values[at + 1]]) << 32) | _short([values[at + 2]])], np.ones(len(at), bool)
                for j in range(3, max_words):
                    last = np.minimum(at + j, len(values) - 1)
                    on &= (at + j < len(values)) & pair[last - 1]
                    columns.append(np.where(on, _short([values[last]]) + 1, 0))
                held.append(columns)
                size += len(at)
            if size >= _HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    found = texts.select("codes").mapInArrow(run, ", ".join(f"{x} long" for x in ["begin", *further, "n"]))
    # a task has summed its own rows; what begins with the same three words meets once
    longest = found.repartition("begin").groupBy("begin", *further).agg(F.sum("n").alias("n"))
    begun = F.sum("n").over(Window.partitionBy("begin"))
    longest = materialize(longest.withColumn("begun", begun).where(F.col("begun") >= min_count).drop("begun"), "longest_phrases")
    shared.destroy()
    firsts = materialize(_with_short(pairs, 2), "short_pairs")
    words = pairs.select("w1").unionAll(pairs.select(F.col("w2").alias("w1"))).distinct()
    words = materialize(_with_short(words, 1), "short_words")
    levels = []
    for k in range(3, max_words + 1):
        own = further[:k - 3]
        level = longest.where(F.col(own[-1]) != 0) if own else longest
        level = level.groupBy("begin", *own).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
        level = level.select(F.shiftrightunsigned("begin", 32).alias("short"), F.col("begin").bitwiseAND(_LOW).alias("s3"), *((F.col(c) - 1).alias(c) for c in own))
        level = level.join(firsts, "short")
        for i in range(3, k + 1):
            level = level.join(_word(words, i), f"s{i}")
        levels.append(materialize(level.select(*_names(k)), f"phrases_{k}"))
    return levels


Trie = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _room(free: np.ndarray, low: int, children: np.ndarray) -> np.ndarray | None:
    """Places of the children of one state: the first base at which all are free."""
    at, span = low, 64
    while at < len(free):
        first = at + np.flatnonzero(free[at:at + span])
        for child in children[1:]:  # few bases are left after a few children
            if not len(first):
                break
            place = first + (child - children[0])
            first = first[(place < len(free)) & free[np.minimum(place, len(free) - 1)]]
        if len(first):
            return first[0] + (children - children[0])
        at, span = at + span, min(span * 4, 1 << 16)
    return None


def double_array(phrases: np.ndarray) -> Trie:
    """``words, base, check, number`` of distinct phrases (rows of word hashes, 0 after the
    last word): word ``words[c - 1]`` has code ``c`` and leads from state ``s`` to
    ``t = base[s] + c`` if ``check[t] == s``.  State 1 is the root, 0 none; ``number[t]`` is
    the phrase that ends in ``t`` or -1.  Places 0, 1 and the last are nobody's child."""
    words = np.unique(phrases[phrases != 0])
    codes = np.where(phrases != 0, np.searchsorted(words, phrases) + 1, 0)
    free = np.ones(int((phrases != 0).sum()) + 2 * len(words) + 3, bool)
    free[:2], low = False, 2
    order = np.lexsort(codes.T[::-1])
    codes, state = codes[order], np.ones(len(codes), np.int64)
    edges_of, ends = [], []
    for depth in range(codes.shape[1]):
        live = codes[:, depth] > 0
        if not live.any():
            break
        edges, place = np.unique(np.stack([state[live], codes[live, depth]], axis=1), axis=0, return_inverse=True)
        starts = np.flatnonzero(np.r_[True, edges[1:, 0] != edges[:-1, 0]])
        counts = np.diff(np.r_[starts, len(edges)])
        target = np.zeros(len(edges), np.int64)
        for g in np.argsort(-counts, kind="stable"):  # the widest states first
            if counts[g] == 1:
                break
            children = slice(starts[g], starts[g] + counts[g])
            while low < len(free) and not free[low]:
                low += 1
            found = _room(free, low, edges[children, 1])
            while found is None:
                free = np.concatenate([free, np.ones(len(free), bool)])
                found = _room(free, low, edges[children, 1])
            target[children] = found
            free[found] = False
            low = max(low, int(found[0]) - 64)  # states of one child fill what is passed over
        low, single = 2, starts[counts == 1]
        while free.sum() < len(single):
            free = np.concatenate([free, np.ones(len(free), bool)])
        target[single] = np.flatnonzero(free)[:len(single)]  # one child fits anywhere
        free[target[single]] = False
        edges_of.append((edges, target))
        state[live] = target[place.reshape(-1)]
        last = live & (codes[:, depth + 1] == 0 if depth + 1 < codes.shape[1] else True)
        ends.append((state[last], order[last]))
    size = int(np.flatnonzero(~free)[-1]) + 2
    base, check, number = np.zeros(size, np.int32), np.zeros(size, np.int32), np.full(size, -1, np.int32)
    for edges, target in edges_of:
        base[edges[:, 0]], check[target] = target - edges[:, 1], edges[:, 0]
    for states, which in ends:
        number[states] = which
    return words, base, check, number


def phrase_places(trie: Trie, values: np.ndarray, phrases: int, depth: int) -> np.ndarray:
    """Places of each phrase that start in the first ``_STEP`` word hashes: the states of all
    positions advance together."""
    words, base, check, number = trie
    code = np.searchsorted(words, values)
    code[code == len(words)] = 0
    code = np.where(words[code] == values, code + 1, 0)
    at = np.flatnonzero(code[:_STEP])
    state, end, total = np.ones(len(at), np.int64), len(check) - 1, np.zeros(phrases, np.int64)
    for level in range(depth):
        inside = at + level < len(code)
        at, state = at[inside], state[inside]
        word = code[at + level]
        to = np.clip(base[state] + word, 0, end)  # the ends are nobody's child
        ok = (word > 0) & (check[to] == state)
        at, state = at[ok], to[ok]
        found = number[state]
        total += np.bincount(found[found >= 0], minlength=phrases)
    return total


def trie_counts(texts: DataFrame, phrases: DataFrame, max_words: int, slice_phrases: int) -> DataFrame:
    """``phrases`` (``w1..`` with 0 after the last word) with ``f``, the places in all texts."""
    names = _names(max_words)
    ranked = materialize(unique_rank(phrases, names, "rank").withColumn("slice", F.floor((F.col("rank") - 1) / slice_phrases)), "phrases")
    slices = ranked.agg(F.max("slice")).first()[0]
    counted = None
    for s in range(0 if slices is None else int(slices) + 1):
        rows = ranked.where(F.col("slice") == s)
        # slice_phrases rows of max_words longs
        own = rows.orderBy("rank").select(*names).toPandas().to_numpy(np.int64)
        shared = texts.sparkSession.sparkContext.broadcast(double_array(own))
        n, first = len(own), int(s) * slice_phrases + 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, n=n, first=first) -> Iterator[pa.RecordBatch]:
            trie, total = shared.value, np.zeros(n, np.int64)
            for values in _steps(batches, max_words):
                total += phrase_places(trie, values, n, max_words)
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(hit + first), pa.array(total[hit])], ["rank_", "f"])

        part = texts.select("codes").mapInArrow(run, "rank_ long, f long")
        part = materialize(part.groupBy("rank_").agg(F.sum("f").alias("f")), "trie_counts")
        shared.destroy()
        counted = part if counted is None else counted.unionAll(part)
    if counted is None:
        return phrases.withColumn("f", F.lit(0).cast("long"))
    return ranked.join(counted, F.col("rank") == F.col("rank_")).select(*names, "f")


def _phrase(k: int, max_words: int) -> list[Column]:
    return [F.col(f"w{i}") if i <= k else F.lit(0).cast("long").alias(f"w{i}") for i in range(1, max_words + 1)]


def _part(first: Column, length: Column) -> Column:
    """``length`` words of ``words`` from place ``first`` (from 1)."""
    return F.slice(F.col("words"), first, length)


def scored(candidates: DataFrame, counts: DataFrame, params: CollocationParams) -> DataFrame:
    """``words, a, l, r, score`` of the candidates (``words``: arrays of hashes) by their
    lowest cut, from ``counts`` (``part, f``), without those that a longer one absorbs."""
    size = F.size("words")
    longer = candidates.where(size > 2).select("words", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    longer = longer.select("a", F.explode(F.expr("transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))")).alias("inner"))
    longest = longer.groupBy("inner").agg(F.max("a").alias("most"))
    kept = (candidates.join(longest, F.col("words") == F.col("inner"), "left")
            .where(F.coalesce(100 * F.col("most") < params.absorb_percent * F.col("a"), F.lit(True))).select("words", "a"))
    cuts = kept.select("words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, size - F.col("k")).alias("right"))
    side = lambda name: counts.select(F.col("part").alias(f"{name}_part"), F.col("f").alias(name))
    cuts = cuts.join(side("l"), F.col("left") == F.col("l_part")).join(side("r"), F.col("right") == F.col("r_part"))
    # decimal: a product may pass 64 bits
    score = F.expr(f"(CAST({params.scale} AS DECIMAL(8, 0)) * CAST(a AS DECIMAL(19, 0))) div CAST(l + r AS DECIMAL(20, 0))")
    best = cuts.select("words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("words", "a").agg(F.min("cut").alias("cut"))
    return best.select("words", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", params: CollocationParams = CollocationParams()) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of all candidates that no longer one absorbs, per
    language: phrases of 2 to ``max_words`` words with ``min_count`` places inside pieces.

    A null text is empty, a null language ``und``; empty texts hold nothing, long ones are
    read whole, repeated rows count each; extra columns are not read; an empty table gives
    an empty one."""
    own = docs.select(F.coalesce(F.col(lang_col), F.lit(LANG_OF_NULL)).alias("lang"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        coded = _stored(_coded(own, seed))
        words = coded.where("word IS NOT NULL").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
        words = materialize(words, "words")
        if words.groupBy("hash").count().where("count > 1").isEmpty():
            break
        seed += 1  # two words have one hash
    texts = coded.where("codes IS NOT NULL").select("codes")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    usual = materialize(words.where(F.col("n") >= params.min_count), "frequent_words")
    pairs = frequent_pairs(texts, usual.select(F.col("hash").alias("w1")), params.min_count)
    found = pairs.select(*_phrase(2, params.max_words))
    if params.max_words > 2:
        for k, level in enumerate(longer_phrases(texts, pairs, params.min_count, params.max_words), 3):
            found = found.unionAll(level.select(*_phrase(k, params.max_words)))
    f = trie_counts(texts, found, params.max_words, params.slice_phrases)
    f = materialize(f.select(F.filter(F.array(*_names(params.max_words)), lambda w: w != 0).alias("words"), F.col("f").alias("a"))
                    .where(F.col("a") >= params.min_count), "candidates")
    counts = f.select(F.col("words").alias("part"), F.col("a").alias("f")).unionAll(usual.select(F.array("hash"), "n"))
    best = materialize(scored(f, counts, params), "scored")
    spelled = (best.select("words", F.posexplode("words").alias("at", "hash")).join(usual.select("hash", "word", "lang"), "hash")
               .groupBy("words").agg(F.min("lang").alias("lang"), F.array_join(F.expr("transform(sort_array(collect_list(struct(at, word))), x -> x.word)"), " ").alias("phrase")))
    # a row a language
    return best.join(spelled, "words").join(totals, "lang").select("lang", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def top_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", params: CollocationParams = CollocationParams()) -> DataFrame:
    """The first ``top`` collocations of each language by score, then ``a`` (both descending),
    then phrase in byte order: ``lang, rank, phrase, a, l, r, n, score``.  Odd rows as in
    ``collocations``."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = collocations(docs, text_col, lang_col, params).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= params.top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
