"""Substring dedup by paragraph MinHash banding.

Paragraphs of a text are (a) its lines that are not blank, however short, and (b) passages:
runs of ``min_words`` words whose place the words themselves choose, so that a passage
copied into the middle of other text yields the same paragraphs there.  (Of every
``gap`` consecutive 3-word windows the one least by hash begins a passage: winnowing.
A copied run of ``min_words + gap - 1`` words or more holds a passage, wherever it
stands; with 32 and 19 that is 50 words.)

Equal lines meet by a 128-bit digest, passages by 64 bits and their words.  Lines also get MinHash signatures of their
5-word shingles (a line of fewer words is one shingle: the digest decides); bands are tuned for recall (``tune_bands``), distinct lines that collide
in a band are joined, and the exact Jaccard similarity decides.  A bucket is compared in
blocks of bounded size and gives at most a spanning tree of its links.  Components of
linked lines are one paragraph.  A passage's document is then read beside the document of
its first occurrence, and what they share goes as far as the words agree, both ways.
Documents also meet by seeds, runs of ``seed_words`` words placed by winnowing: an edited
copy has no long run in common but some short ones.  Common runs that follow one another
in both documents are one passage if the exact Jaccard similarity of all from the first to
the last reaches the threshold, whatever the lines and what stands around.  (Two
passages of 44 words or more over the threshold that differ by single words have 22 words
in a row in common.)  A paragraph's first occurrence (least document id, then place) stays; the others, merged
into passages, are what a dedup removes.  Components of
passages that share a paragraph are the clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickscope.llm.collocations import _has, phrase_bitmap
from clickscope.llm.common import broadcast_checked, materialize, ship
from clickscope.llm.components import connected_components

ship(__name__)

_SHINGLE_HASHES = np.random.default_rng(42).integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)


_SEED_BASE = 0x2545F4914F6CDD1D

_XXH64 = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=np.uint64)  # its primes

_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))  # what ``bytes.split`` splits at


@dataclass(frozen=True)
class ParagraphParams:
    min_words: int = 32
    gap: int = 19
    shingle_words: int = 5
    seed_words: int = 12  # two documents side by side: a common run of
    seed_gap: int = 11    # seed_words + seed_gap - 1 words or more is seen
    similarity: float = 0.8
    recall: float = 0.98
    band_rows: int = 2
    block: int = 256  # lines of a bucket that are compared at once


def tune_bands(similarity: float, recall: float, rows: int) -> int:
    """Least number of bands of ``rows`` rows in which a pair of just this similarity
    collides with the probability ``recall``."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _mix(h: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit polynomial hashes (xor-shift and odd multiplications)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def run_hashes(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes."""
    out, width, done = None, 1, 0
    power, part, length = np.uint64(base), h, n
    # binary digits of n from the least: ``part`` has runs of ``width`` words
    while length:
        if length & 1:
            if out is None:
                out, done = part, width
            else:
                m = len(h) - done - width + 1
                out = out[:m] * power + part[done:done + m] if m > 0 else out[:0]
                done += width
        length >>= 1
        if length:
            m = len(part) - width
            part = part[:m] * power + part[width:] if m > 0 else part[:0]
            width *= 2
            power = power * power
    return _mix(out[:max(0, len(h) - n + 1)])


class _Hashes(dict):
    """Hashes of long words, made once each."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _short_hashes(lanes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """XXH64 of the words of ``n`` bytes (under 32) that begin at ``at``; ``lanes`` has the 8 bytes
    from each place on."""
    one, two, three, four, five = _XXH64
    h = np.full(len(at), five + np.uint64(n))
    for k in range(0, n - 7, 8):
        lane = lanes[at + k] * two
        h ^= (lane << np.uint64(31) | lane >> np.uint64(33)) * one
        h = (h << np.uint64(27) | h >> np.uint64(37)) * one + four
    rest = lanes[at + (n & ~7)] if n & 7 else None
    if n & 4:
        h ^= (rest & np.uint64(0xFFFFFFFF)) * one
        h = (h << np.uint64(23) | h >> np.uint64(41)) * two + three
    for k in range(n & 4, n & 7):
        h ^= (rest >> np.uint64(8 * k) & np.uint64(255)) * five
        h = (h << np.uint64(11) | h >> np.uint64(53)) * one
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return h ^ h >> np.uint64(32)


def _word_hashes(texts: list[bytes | None], known: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of the words (A-Z lower-cased) of texts that lie one after the other; the word count of
    each text; the words before each line's end, in all texts."""
    raw = b"\n".join([b"", *(t or b"" for t in texts), bytes(8)]).lower()  # a line's end around each text
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data[:-8]]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    begin = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
    lines = np.searchsorted(starts, np.flatnonzero(data[1:-8] == 10) + 1)
    # words of one length at a time
    lanes = np.ascontiguousarray(np.ndarray(len(data) - 7, "<u8", data, strides=(1,)))
    length = np.minimum(sizes, 32).astype(np.uint8)
    by = np.argsort(length, kind="stable")
    h, edges = np.empty(len(starts), dtype=np.uint64), np.searchsorted(length[by], np.arange(34))
    with np.errstate(over="ignore"):
        for n in range(1, 32):
            if len(at := by[edges[n]:edges[n + 1]]):
                h[at] = _short_hashes(lanes, starts[at], n)
    for k in by[edges[32]:].tolist():
        h[k] = known[raw[starts[k]:starts[k] + sizes[k]]]
    return h, np.diff(np.searchsorted(starts, begin)), lines


def _words(text: bytes | None, known: _Hashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased), and the word count before each line's end."""
    h, _, ends = _word_hashes([text], _Hashes() if known is None else known)
    return h, ends


def _band_keys(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: ParagraphParams) -> np.ndarray:
    """Band keys of each line; all have ``shingle_words`` words or more."""
    bands = tune_bands(p.similarity, p.recall, p.band_rows)
    edges = np.stack([starts, ends - p.shingle_words + 1], axis=1).ravel()
    top = np.array([2**64 - 1], dtype=np.uint64)  # an edge may be the end
    keys = np.zeros((len(starts), bands), dtype=np.uint64)
    for k, (a, b) in enumerate(zip(*_SHINGLE_HASHES[:, :bands * p.band_rows])):
        low = np.minimum.reduceat(np.concatenate([_mix(shingles * a + b), top]), edges)[::2]
        keys[:, k // p.band_rows] = keys[:, k // p.band_rows] * np.uint64(0x9FB21C651E98DF25) + low
    return _mix(keys).view(np.int64)


def _hashes(text: bytes, known: _Hashes) -> np.ndarray:
    """Hashes of one text's words alone."""
    return _word_hashes([text], known)[0]


def _least(order: np.ndarray, gap: int) -> np.ndarray:
    """The first place of the least value of each ``gap`` consecutive ones, from runs of 1, 2, 4
    .. places."""
    at, width = np.arange(len(order)), 1
    while width < gap:
        step = min(width, gap - width)
        later = order[step:] < order[:-step]
        at, order = np.where(later, at[step:], at[:-step]), np.minimum(order[step:], order[:-step])
        width += step
    return at


def _anchors(h: np.ndarray, n: int, gap: int) -> list[int]:
    """Of every ``gap`` consecutive places among the first ``n`` the one whose 3-word window
    is least by hash; of fewer places one."""
    order = run_hashes(h, 3, 0x165667B19E3779F9)[:n]
    if n <= gap:
        return [int(order.argmin())]
    return _runs_once(_least(order, gap)).tolist()


def _runs_once(at: np.ndarray) -> np.ndarray:
    """Distinct places; the least place of a window never moves back."""
    return at[np.r_[True, at[1:] != at[:-1]]]


def _winnowed(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray, gap: int) -> np.ndarray:
    """``_anchors`` of texts that lie one after the other, each with its first ``places``
    places; ``order`` has the hashes of all 3-word windows."""
    chosen = [np.array([s + order[s:s + n].argmin() for s, n in zip(starts.tolist(), places.tolist()) if 0 < n <= gap], dtype=np.int64)]
    if (places > gap).any():
        room = np.repeat(starts + places, sizes)  # end of the places of the text around
        at = np.flatnonzero(np.arange(len(room)) + gap <= room)
        chosen.append(_runs_once(_least(order, gap)[at]))
    return np.sort(np.concatenate(chosen))


def _apart(text: np.ndarray, x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``at`` without places that overlap an equal run of their text: it may repeat itself at
    every word."""
    by = np.lexsort((at, x, text))
    text, x, at = text[by], x[by], at[by]
    again = np.r_[False, (text[1:] == text[:-1]) & (x[1:] == x[:-1])]
    keep, last = np.ones(len(at), dtype=bool), 0
    if (again[1:] & (np.diff(at) < n)).any():
        for i in np.flatnonzero(again).tolist():
            last = last if again[i - 1] else at[i - 1]
            keep[i] = last + n <= at[i]
            last = at[i] if keep[i] else last
    return np.sort(at[keep])


@dataclass(frozen=True)
class Units:
    """The paragraphs of some texts, as columns: text, first word, words, digest; ``band_keys``
    of the lines that have any, and how many each unit has (-1: no line)."""

    of: np.ndarray
    at: np.ndarray
    n: np.ndarray
    x: np.ndarray
    y: np.ndarray
    bands: np.ndarray
    band_keys: np.ndarray


def paragraphs(texts: list[bytes | None], p: ParagraphParams, known: _Hashes) -> Units:
    """Paragraphs of the texts; a line of less than ``shingle_words`` has no band keys but is
    a line."""
    h, sizes, end = _word_hashes(texts, known)
    starts, text = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)
    first = np.r_[0, end[:-1]]
    first, end = first[end > first], end[end > first]
    kinds = []  # (places, words, x, y)
    with np.errstate(over="ignore"):
        order = run_hashes(h, 3, 0x165667B19E3779F9)
        for n, gap, base in ((p.min_words, p.gap, 0x100000001B3), (p.seed_words, p.seed_gap, _SEED_BASE)):
            x = run_hashes(h, n, base)
            at = _winnowed(order, starts, sizes, np.where(sizes >= p.min_words, sizes - n + 1, 0), gap)
            at = _apart(text[at], x[at], at, n)
            kinds.append((at, np.full(len(at), n), x[at], np.zeros(len(at), dtype=np.uint64)))  # the words decide later
        data = memoryview(h.tobytes())
        lines = [data[8 * s:8 * e] for s, e in zip(first.tolist(), end.tolist())]
        kinds.append((first, end - first, *(np.fromiter((xxhash.xxh64_intdigest(d, seed) for d in lines), np.uint64, len(lines)) for seed in (1, 2))))
        banded = end - first >= p.shingle_words
        keys = np.zeros((0, tune_bands(p.similarity, p.recall, p.band_rows)), dtype=np.int64)
        if banded.any():
            keys = _band_keys(run_hashes(h, p.shingle_words, 0x27D4EB2F165667C5), first[banded], end[banded], p)
    at, n, x, y = (np.concatenate(c) for c in zip(*kinds))
    bands = np.concatenate([np.full(len(at) - len(first), -1), np.where(banded, keys.shape[1], 0)])
    return Units(text[at], at - starts[text[at]], n, x.view(np.int64), y.view(np.int64), bands, keys.ravel())


def _agreement(a: list[int], i: int, b: list[int], j: int) -> int:
    """Number of words from ``i`` and ``j`` on up to the first that differs."""
    n, at, step = min(len(a) - i, len(b) - j), 0, 16
    while at < n:
        end = min(at + step, n)
        if a[i + at:i + end] != b[j + at:j + end]:
            while a[i + at] == b[j + at]:
                at += 1
            return at
        at, step = end, min(step * 4, 1024)
    return n


def _agreement_before(a: list[int], i: int, b: list[int], j: int) -> int:
    """The same from the words before ``i`` and ``j`` backwards."""
    n, at, step = min(i, j), 0, 16
    while at < n:
        end = min(at + step, n)
        if a[i - end:i - at] != b[j - end:j - at]:
            while a[i - at - 1] == b[j - at - 1]:
                at += 1
            return at
        at, step = end, min(step * 4, 1024)
    return n


def _seeds(h: np.ndarray, p: ParagraphParams) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the runs of ``seed_words`` words, and the places the words choose."""
    x = run_hashes(h, p.seed_words, _SEED_BASE)
    return x, np.array(_anchors(h, len(x), p.seed_gap) if len(x) else [], dtype=np.int64)


class Text:
    """The word hashes of a text and what is made of them when asked for."""

    def __init__(self, h: np.ndarray, p: ParagraphParams):
        self.h, self.p = h, p

    @cached_property
    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return _seeds(self.h, self.p)

    @cached_property
    def first(self) -> dict[int, int]:
        """The first place of each seed."""
        y, there = self.seeds
        return dict(zip(y[there[::-1]].tolist(), there[::-1].tolist()))

    @cached_property
    def known_seeds(self) -> np.ndarray:
        """The seeds in order."""
        y, there = self.seeds
        return np.unique(y[there])

    @cached_property
    def words(self) -> list[int]:
        return self.h.tolist()

    @cached_property
    def shingles(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return run_hashes(self.h, self.p.shingle_words, 0x27D4EB2F165667C5)


def _texts(texts: list[bytes], p: ParagraphParams, known: _Hashes) -> list[Text]:
    """The texts with their words hashed and their seeds found all at once."""
    h, sizes, _ = _word_hashes(texts, known)
    ends = np.cumsum(sizes)
    starts, places = ends - sizes, np.maximum(sizes - p.seed_words + 1, 0)
    with np.errstate(over="ignore"):
        x, shingles = run_hashes(h, p.seed_words, _SEED_BASE), run_hashes(h, p.shingle_words, 0x27D4EB2F165667C5)
        at = _winnowed(run_hashes(h, 3, 0x165667B19E3779F9), starts, sizes, places, p.seed_gap)
    cuts = np.searchsorted(at, np.r_[starts, len(h)]).tolist()
    out = []
    for k, (s, e, n) in enumerate(zip(starts.tolist(), ends.tolist(), places.tolist())):
        out.append(one := Text(h[s:e], p))
        one.seeds = x[s:s + n], at[cuts[k]:cuts[k + 1]] - s
        one.shingles = shingles[s:max(s, e - p.shingle_words + 1)]
    return out


def _shingle_counts(one: Text, two: Text) -> list[tuple[list[int], list[int], list[int]]]:
    """For each of the texts: its shingles as small numbers, and before each place how many
    stand in the other text too, and how many nowhere else."""
    n = len(one.shingles)
    _, number = np.unique(np.concatenate([one.shingles, two.shingles]), return_inverse=True)
    sides = (number[:n], number[n:])
    times = [np.bincount(side, minlength=number.max() + 1) for side in sides]
    out = []
    for side, own, other in zip(sides, times, times[::-1]):
        flags = (other[side] > 0, (other[side] == 0) & (own[side] == 1))
        out.append((side.tolist(), *(np.r_[0, np.cumsum(f)].tolist() for f in flags)))
    return out


def common_runs(one: Text, two: Text, p: ParagraphParams, only: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """(start and end in ``one``, start and end in ``two``) of runs of equal word hashes, each
    as long as the words agree.  With ``only``, ``two`` is ``one``: these places of it are
    held against earlier ones."""
    (x, at), seeds = one.seeds, two.known_seeds
    places = at if only is None else np.array(sorted(i for i in set(only) if i < len(x)), dtype=np.int64)
    if not len(places) or not len(seeds):
        return []
    # most seeds are in one of the texts only
    found = x[places]
    met = seeds[np.minimum(np.searchsorted(seeds, found), len(seeds) - 1)] == found
    words, others, first = one.words, two.words, two.first
    runs, ends, reach = set(), {}, 0
    for i, seed in zip(places[met].tolist(), found[met].tolist()):
        j = first[seed]
        if i + p.seed_words <= reach or only is not None and j >= i or ends.get(i - j, 0) > i:
            continue
        right, left = _agreement(words, i, others, j), _agreement_before(words, i, others, j)
        runs.add((i - left, i + right, j - left, j + right))
        ends[i - j] = i + right
        if left + right >= p.min_words:  # what is covered needs no second copy
            reach = max(reach, i + right)
    return sorted(runs)


def _beyond_edits(runs: list[tuple[int, int, int, int]], one: Text, two: Text, p: ParagraphParams) -> list[tuple[int, int, int, int]]:
    """``runs`` and the runs of ``shingle_words`` or more next to one with a word changed, put
    in or left out between: too short for a seed."""
    known, todo, n = set(runs), list(runs), p.shingle_words
    words, others = one.words, two.words
    while todo:
        a0, a1, b0, b1 = todo.pop()
        for da, db in ((1, 1), (1, 0), (0, 1)):
            # most have no run there: the words that it takes are held against each other first
            i, j = a1 + da, b1 + db
            if j + n <= len(others) and i + n <= len(words) and words[i:i + n] == others[j:j + n]:
                m = _agreement(words, i, others, j)
                if (r := (i, i + m, j, j + m)) not in known:
                    known.add(r)
                    todo.append(r)
            i, j = a0 - da, b0 - db
            if i >= n and j >= n and words[i - n:i] == others[j - n:j]:
                m = _agreement_before(words, i, others, j)
                if (r := (i - m, i, j - m, j)) not in known:
                    known.add(r)
                    todo.append(r)
    return sorted(known)


def copies(one: Text, two: Text, p: ParagraphParams, only: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """Passages of ``min_words`` or more on both sides: runs, and runs in a row that are
    similar as a whole."""
    runs = common_runs(one, two, p, only)
    if not runs:
        return []
    if only is None:
        runs = _beyond_edits(runs, one, two, p)

    counts = []  # made for the first two runs in a row
    sets = {}  # of a passage: the shingles of each side, and how many are on both

    def similar(part: tuple[int, int, int, int], whole: tuple[int, int, int, int]) -> bool:
        """``whole`` begins where ``part`` does: only what it adds is looked at."""
        if not counts:
            counts.extend(_shingle_counts(one, two))
        (left, shared, own), (right, others_shared, others_own) = counts
        a0, a1, b0, b1 = whole
        a1, b1 = a1 - p.shingle_words + 1, b1 - p.shingle_words + 1
        # at most so many shingles are on both sides, and at least so many on one only
        most = min(shared[a1] - shared[a0], others_shared[b1] - others_shared[b0])
        if most < p.similarity * (most + own[a1] - own[a0] + others_own[b1] - others_own[b0]):
            return False
        a, b = max(a0, part[1] - p.shingle_words + 1), max(b0, part[3] - p.shingle_words + 1)
        if part not in sets:
            x, y = set(left[a0:a]), set(right[b0:b])
            sets[part] = x, y, len(x & y)
        x, y, both = sets[part]
        more_x, more_y = set(left[a:a1]) - x, set(right[b:b1]) - y
        both += len(more_x & y) + len(x & more_y) + len(more_x & more_y)
        if both < p.similarity * (len(x) + len(more_x) + len(y) + len(more_y) - both):
            return False
        del sets[part]
        x |= more_x
        y |= more_y
        sets[whole] = x, y, both
        return True

    def merged(chains: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        done, near = [], []
        longest = max(c[1] - c[0] for c in chains)
        slack = 1 / p.similarity - 1  # words between, as a share of the words around: more can't be similar
        for a0, a1, b0, b1 in chains:
            done += [c for c in near if a0 - c[1] > slack * (c[1] - c[0] + longest) + p.shingle_words]
            near = [c for c in near if a0 - c[1] <= slack * (c[1] - c[0] + longest) + p.shingle_words]
            for k in range(len(near) - 1, -1, -1):
                c0, c1, d0, d1 = near[k]
                both = (c0, max(c1, a1), d0, max(d1, b1))
                close = max(a0 - c1, b0 - d1) <= slack * (c1 - c0 + a1 - a0) + p.shingle_words
                if b0 >= d0 and close and (only is None or both[3] <= both[0]) and similar(near[k], both):
                    near[k] = both
                    break
            else:
                near.append((a0, a1, b0, b1))
        return sorted(done + near)

    chains, before = merged(runs), len(runs)
    while len(chains) < before:
        chains, before = merged(chains), len(chains)
    return [c for c in chains if min(c[1] - c[0], c[3] - c[2]) >= p.min_words]


def whole_copy(two: Text, p: ParagraphParams) -> list[tuple[int, int, int, int]]:
    """``copies`` of a text and another one that equals it: the first seed's run is all of it."""
    n = len(two.h)
    return [(0, n, 0, n)] if n >= max(p.min_words, p.seed_words) else []


_SLICE = 1 << 16  # words handled at once: some 20,000 paragraphs
_KNOWN = 1 << 17  # long words whose hashes a task holds


_COPY = pa.list_(pa.struct([(c, pa.int32()) for c in ("at", "end", "first_at", "first_end")]))


def _with_row(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``row`` (a digest of id and text: what is told apart as one document), ``text``."""
    return df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.lit("/"), text_col).alias("row"), F.col(text_col).alias("text"))


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """The texts in slices of about ``_SLICE`` words, whatever Spark's batch size (a batch of texts
    holds a million paragraphs), and the place of each slice's first."""
    texts, first, size = [], 0, 0
    for k, text in enumerate(column.cast(pa.binary())):
        texts.append(text.as_py())
        size += len(texts[-1] or b"") // 6  # about so many words
        if size >= _SLICE:
            yield first, texts
            texts, first, size = [], k + 1, 0
    if texts:
        yield first, texts


def _paragraphs(docs: DataFrame, p: ParagraphParams) -> DataFrame:
    """A row a paragraph."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "row", "at", "n", "x", "y", "bands"]
        known = _Hashes()

        def rows(batch: pa.RecordBatch, first: int, texts: list[bytes | None]) -> pa.RecordBatch:
            u = paragraphs(texts, p, known)
            if len(known) > _KNOWN:
                known.clear()
            edges = pa.array(np.r_[0, np.cumsum(np.maximum(u.bands, 0))].astype(np.int32))
            bands = pa.ListArray.from_arrays(edges, pa.array(u.band_keys), mask=pa.array(u.bands < 0))
            of = pa.array(u.of + first)
            columns = [pa.array(c.astype(np.int32)) for c in (u.at, u.n)] + [pa.array(c) for c in (u.x, u.y)]
            return pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *columns, bands], names)

        for batch in batches:
            for first, texts in _slices(batch.column(2)):
                yield rows(batch, first, texts)

    kind = f"id {docs.schema['id'].dataType.simpleString()}, row long, at int, n int, x long, y long, bands array<long>"
    return docs.mapInArrow(run, kind)


def _similar_pairs(sets: list[np.ndarray], other: list[np.ndarray] | None, least: float) -> Iterator[tuple[int, int]]:
    """(i, j) with exact Jaccard similarity of ``sets[i]`` and ``other[j]`` of ``least`` or
    more; without ``other`` of ``sets[i]`` and ``sets[j]``, i < j."""
    if other is None and len(sets) <= 6:
        for i, a in enumerate(sets):
            for j in range(i + 1, len(sets)):
                both = len(a) + len(sets[j])
                union = len(np.unique(np.concatenate([a, sets[j]])))
                if both - union >= least * union:
                    yield i, j
        return
    right = sets if other is None else other
    every = np.unique(np.concatenate([*sets, *right]))
    shared = np.zeros((len(sets), len(right)), dtype=np.float32)
    for k in range(0, len(every), 4096):
        some = every[k:k + 4096]
        one = [np.array([np.isin(some, s, assume_unique=True) for s in group], dtype=np.float32) for group in ([sets] if other is None else [sets, other])]
        shared += one[0] @ one[-1].T
    sizes = [np.array([len(s) for s in group], dtype=np.float64) for group in (sets, right)]
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    hit = shared >= least * union
    yield from zip(*(k.tolist() for k in np.nonzero(np.triu(hit, 1) if other is None else hit)))


def _spanning(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    kept = []
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            kept.append((i, j))
    return kept


def _line_links(docs: DataFrame, units: DataFrame, p: ParagraphParams) -> DataFrame:
    """``(a, b)``: digests x of distinct lines (those with bands) whose similarity reaches the threshold (a
    spanning tree of each block of a bucket)."""
    lines = units.where("size(bands) > 0").groupBy("x", "y").agg(F.first("bands").alias("bands"), F.min(F.struct("row", "at", "n")).alias("place"))
    lines = materialize(lines, "lines")
    banded = lines.select("x", "y", F.posexplode("bands").alias("band", "key"))
    buckets = materialize(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = materialize(banded.join(broadcast_checked(buckets), ["band", "key"]), "members")
    # the shingles of the lines that collide, from the texts that hold them
    places = lines.join(members.select("x", "y").distinct(), ["x", "y"]).select("place.row", F.struct("place.at", "place.n", "x", "y").alias("u"))
    wanted = materialize(places.groupBy("row").agg(F.collect_list("u").alias("wanted")), "wanted")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            out: dict[str, list] = {"x": [], "y": [], "shingles": []}
            lines = batch.column(1).to_pylist()
            for first, texts in _slices(batch.column(0)):
                if len(known) > _KNOWN:
                    known.clear()
                h, sizes, _ = _word_hashes(texts, known)
                with np.errstate(over="ignore"):
                    whole = run_hashes(h, p.shingle_words, 0x27D4EB2F165667C5).view(np.int64)
                for start, units_ in zip((np.cumsum(sizes) - sizes).tolist(), lines[first:]):
                    for u in units_:
                        at = start + u["at"]
                        out["x"].append(u["x"])
                        out["y"].append(u["y"])
                        out["shingles"].append(np.unique(whole[at:at + u["n"] - p.shingle_words + 1]))
            yield pa.RecordBatch.from_arrays([pa.array(out["x"], pa.int64()), pa.array(out["y"], pa.int64()), pa.array(out["shingles"], pa.list_(pa.int64()))], list(out))

    # one row of docs each: repeated rows have one ``row``
    texts = docs.select("row", "text").join(broadcast_checked(wanted), "row").select("text", "wanted")
    shingles = texts.mapInArrow(shingled, "x long, y long, shingles array<long>").groupBy("x", "y").agg(F.first("shingles").alias("shingles"))
    # cut a bucket into blocks, and pair them: a line is copied once for each block of its bucket
    blocks = F.ceil(F.col("size") / p.block).cast("int")
    placed = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("y", "x"), F.col("blocks")).cast("int"))
    placed = placed.select("x", "y", "band", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    placed = placed.select("x", "y", "band", "key", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))

    def tree(key: tuple, own: list[int], x: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        i, j = key[2], key[3]
        left = [k for k, o in enumerate(own) if o == i]
        right = left if i == j else [k for k, o in enumerate(own) if o == j]
        if not left or not right or len(own) < 2:
            return []
        pairs = _similar_pairs([sets[k] for k in left], None if i == j else [sets[k] for k in right], p.similarity)
        return [(x[a], x[b]) for a, b in _spanning(len(own), ((left[a], right[b]) for a, b in pairs))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (band, key, i, j): one block pair at a time is held."""
        now, own, x, sets = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            owns, xs = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            lists = batch.column(6)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_pylist()
            out: list[tuple[int, int]] = []
            for k, key in enumerate(keys):
                if key != now:
                    if now is not None:
                        out += tree(now, own, x, sets)
                    now, own, x, sets = key, [], [], []
                own.append(owns[k])
                x.append(xs[k])
                sets.append(values[offsets[k]:offsets[k + 1]].copy())
            yield pa.RecordBatch.from_arrays([pa.array([e[c] for e in out], pa.int64()) for c in (0, 1)], ["a", "b"])
        if now is not None:
            out = tree(now, own, x, sets)
            yield pa.RecordBatch.from_arrays([pa.array([e[c] for e in out], pa.int64()) for c in (0, 1)], ["a", "b"])

    pair = ["band", "key", "i", "j"]
    met = placed.join(shingles, ["x", "y"]).select(*pair, "own", "x", "shingles").repartition(*pair).sortWithinPartitions(*pair)
    return met.mapInArrow(compare, "a long, b long")


def _copies(docs: DataFrame, pairs: DataFrame, p: ParagraphParams) -> DataFrame:
    """``(id, row, at, end, first_id, first_row, first_at, first_end)``: what the documents
    of ``pairs`` (id, row, first_id, first_row, only) share, as far as it goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, two = _Hashes(), None, None
        todo, texts = [], []  # pairs (is the first document new, does the text differ, places) and the texts to cut for them

        def shared() -> list[list[dict[str, int]]]:
            nonlocal two
            made, found = iter(_texts(texts, p, known)), []
            for new, other, only in todo:
                two = next(made) if new else two
                found.append(copies(next(made), two, p, only) if other else whole_copy(two, p))
            todo.clear()
            texts.clear()
            if len(known) > _KNOWN:
                known.clear()
            return [[dict(zip(("at", "end", "first_at", "first_end"), c)) for c in some] for some in found]

        for batch in batches:
            found, size = [], 0
            for row in zip(batch.column(1).cast(pa.binary()), batch.column(2).cast(pa.binary()), batch.column(3)):
                one, right, only = (c.as_py() for c in row)
                new, other = right != seen, only is not None or one != right  # pairs of one first document come together
                seen = right
                some = [t for t, wanted in ((right, new), (one, other)) if wanted]
                todo.append((new, other, only))
                texts += some
                size += sum(len(t) for t in some) // 6  # about so many words
                if size >= _SLICE:
                    found += shared()
                    size = 0
            if todo:
                found += shared()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _COPY)], ["ids", "c"])

    # one row of docs each: repeated rows have one ``row``
    rows = pairs.select("row").unionAll(pairs.select("first_row")).distinct()
    texts = docs.select("row", "text").join(broadcast_checked(materialize(rows, "rows")), "row", "left_semi").dropDuplicates(["row"])
    ids = F.struct("id", "row", "first_id", "first_row").alias("ids")
    both = pairs.join(texts.withColumnRenamed("text", "one"), "row").join(texts.select(F.col("row").alias("first_row"), F.col("text").alias("two")), "first_row")
    both = both.select(ids, "one", "two", "only")
    kind = f"ids {both.schema['ids'].dataType.simpleString()}, c array<struct<at:int,end:int,first_at:int,first_end:int>>"
    return both.mapInArrow(run, kind).select("ids.*", F.inline("c"))


def _perhaps(units: DataFrame, wanted: DataFrame) -> tuple[DataFrame, Broadcast]:
    """``units`` without most of those whose ``x`` isn't in ``wanted``, which need not be
    shuffled then: by a broadcast bitmap of 16 MiB, whatever the number of digests."""
    shared = units.sparkSession.sparkContext.broadcast(phrase_bitmap(wanted.select(F.col("x").alias("w1")), 1))

    @F.arrow_udf("boolean")
    def perhaps(x: pa.Array) -> pa.Array:
        return pa.array(_has(shared.value, [x.to_numpy(zero_copy_only=False)]))

    return units.where(perhaps("x")), shared


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: ParagraphParams = ParagraphParams()) -> DataFrame:
    """One row for each passage of a document that repeats in another document: the id,
    ``first_word``, ``n_words`` (places among the text's words), ``component_id`` (least
    id of the cluster's documents), ``n_removed`` (its words within paragraphs that occur
    earlier, here or in another document: what a dedup takes out).

    Documents without such passages have no row.  Null and empty texts have no words;
    rows equal in id and text are one document; a null id is an id of its own, last;
    extra columns are not read; an empty table gives an empty one."""
    docs = _with_row(df, id_col, text_col)
    units = materialize(_paragraphs(docs, params), "paragraphs")
    links = materialize(_line_links(docs, units, params), "line_links")
    roots = materialize(connected_components(links), "line_roots")
    # what may be repeated: half a digest that occurs again (the whole digest decides below)
    equal = units.groupBy("x").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("x", F.lit(None).cast("long").alias("root"))
    # a linked line is repeated even if each of its forms occurs once
    wanted = materialize(equal.unionAll(roots.select(F.col("node").alias("x"), "root")).groupBy("x").agg(F.max("root").alias("root")), "wanted_digests")
    root = F.when(F.col("line"), F.col("root"))
    again, bitmap = _perhaps(units.select("x", "id", "row", "at", "n", "y", F.col("bands").isNotNull().alias("line")), wanted)
    found = materialize(again.join(wanted, "x").select(
        "id", "row", "at", (F.col("at") + F.col("n")).alias("end"), "line", F.coalesce(root, "x").alias("class"),
        F.when(root.isNull(), F.col("y")).otherwise(0).alias("rest")), "occurrences")
    bitmap.destroy()
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row", "at")
    same = ["class", "rest"]  # one paragraph: equal digests, or linked lines

    def repeated(some: DataFrame) -> DataFrame:
        """Lines and passages never meet: each kind is grouped by itself, once."""
        firsts = some.groupBy(*same).agg(F.min(place).alias("first"), F.min("row").alias("low"), F.max("row").alias("high")).where("low < high")
        return some.join(firsts.select(*same, "first"), same).withColumn("later", place != F.col("first"))

    # passages: the documents side by side, each with that of the first occurrence
    again = repeated(found.where("NOT line")).where("later").groupBy("row", F.col("first.row").alias("first_row")).agg(
        F.first("id").alias("id"), F.first("first.id").alias("first_id"),
        F.collect_list(F.when(F.col("row") == F.col("first.row"), F.col("at"))).alias("only"))
    again = materialize(again.withColumn("only", F.when(F.col("row") == F.col("first_row"), F.col("only"))), "pairs")
    shared = materialize(_copies(docs, again, params), "copies")
    mark = [F.xxhash64(F.lit(k), "row", "at", "first_row", "first_at").alias(c) for k, c in enumerate(same)]
    own_side = shared.select("id", "row", "at", "end", *mark, F.lit(True).alias("later"))
    first_side = shared.select(F.col("first_id").alias("id"), F.col("first_row").alias("row"), F.col("first_at").alias("at"), F.col("first_end").alias("end"), *mark, F.lit(False).alias("later"))
    known = repeated(found.where("line")).select("id", "row", "at", "end", *same, "later").unionAll(own_side).unionAll(first_side)
    # paragraphs that touch are one passage
    own = Window.partitionBy("id", "row").orderBy("at", "end", *same)
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = known.withColumn("new", F.coalesce(F.col("at") > reach, F.lit(True)).cast("int"))
    numbered = materialize(marked.withColumn("span", F.xxhash64("row", F.col("id").cast("string"), F.sum("new").over(own))).drop("new"), "passages")
    # the passages that share a paragraph are linked through the one where it occurs first
    heads = numbered.where("NOT later").groupBy(*same).agg(F.min("span").alias("head"))
    clusters = connected_components(numbered.select(*same, "span").join(heads, same).where("span != head").select(
        F.col("span").alias("a"), F.col("head").alias("b")))
    # a passage goes as far as later occurrences cover it
    spans = numbered.groupBy("id", "row", "span").agg(
        F.min("at").alias("first_word"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.when(F.col("later"), F.struct("at", "end")))).alias("later"))
    covered = F.aggregate("later", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(x["end"] - F.greatest(acc["end"], x["at"]), F.lit(0))).alias("n")))
    spans = spans.withColumn("n_removed", covered["n"]).drop("later")
    spans = spans.join(clusters.withColumnRenamed("node", "span"), "span", "left").withColumn("cluster", F.coalesce("root", "span"))
    spans = materialize(spans, "spans")
    least = spans.groupBy("cluster").agg(F.min("id").alias("component_id"))
    return spans.join(least, "cluster").select(
        F.col("id").alias(id_col), F.col("first_word").cast("long").alias("first_word"), (F.col("end") - F.col("first_word")).cast("long").alias("n_words"),
        "component_id", "n_removed")
