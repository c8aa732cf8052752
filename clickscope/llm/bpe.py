"""BPE encoding and decoding.

Texts are cut into words some at a time, and the words not known yet are merged together:
their symbols are the rows of a matrix, beside it the ranks of neighbours, and in each
round every row joins its least rank, leftmost first, until no merge applies.  The symbols
of a long word form a doubly linked list; a priority queue holds the merges possible
now by (rank, place).  The best is taken; it is stale, and skipped, if one of its two
symbols has changed since; else the right symbol is joined into the left, and the new
pairs on both sides enter the queue.  Decoding joins the vocabulary's strings.

Reads the ``tokenizers`` JSON format of the word-level family: an NFC / replace /
lower-case normalizer, a regular-expression split, byte-level symbols, a suffix at the
end of a word.  Anything else in the file is refused.  The file's path is a parameter;
each Python worker reads it once, so it must be there on every machine (the vocabulary
files are installed with the workers' Python).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickscope.llm.common import once_per_worker, ship

ship(__name__)

#: A worker keeps what it has found for so many words, twice: the latest and those before.
#: Longer ones than so many characters are kept only as long as they are needed.  Bounds
#: memory only.
KEPT_WORDS, KEPT_CHARS = 200_000, 64

#: Texts of about so many characters are handled together.
TOGETHER = 1 << 20

#: Words of up to so many symbols are merged as rows of a matrix, of so many rows at most.
SHORT_WORD, ROWS = 48, 4096

_decimal, _decoded = itemgetter(0), itemgetter(1)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others
    for the letters from U+0100 on, in byte order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(own))
    return letters


class Codec:
    """One vocabulary: encodes texts into ids and decodes ids."""

    def __init__(self, spec: str):
        self._read(json.loads(spec))
        letters = _byte_letters()
        self.byte_ids = np.array([self.vocab.get(letters[b], -1) for b in range(256)])
        self.last_byte_ids = np.array([self.vocab.get(letters[b] + self.suffix, -1) for b in range(256)])
        # of a word (a special string is its id): ids in decimal, decoded text, both joined by a space
        self.known: dict[str | int, tuple[str, str]] = {}
        self.older: dict[str | int, tuple[str, str]] = {}

    def _read(self, spec: dict) -> None:
        model = spec["model"]
        steps = [(s["type"], s.get("pattern"), s.get("content")) for s in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        supported = (
            model["type"] == "BPE" and steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]
            and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and spec["post_processor"] is None and spec["decoder"] is None
            and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
        if not supported:
            raise ValueError("this kind of tokenizer file is not supported")
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.rules = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.rank_of = {a << 32 | b: rank for rank, (a, b, _) in enumerate(self.rules)}
        # the same as sorted arrays; the last entry is no pair
        self.pairs = np.array([*sorted(self.rank_of), -1], dtype=np.int64)
        self.pair_ranks = np.array([*(self.rank_of[x] for x in sorted(self.rank_of)), len(self.rules)], dtype=np.int32)
        self.joined = np.array([joined for _, _, joined in self.rules], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.decimal = {i: str(i) for i in self.strings}
        self.words = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids left of a word's symbols when no merge applies any more."""
        rank_of, rules, push = self.rank_of, self.rules, heapq.heappush
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank and place in one number; the rank tells the two symbols
        queue = [rank << 32 | i for i in range(n - 1) if (rank := rank_of.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            left, right, joined = rules[entry >> 32]
            if symbols[i] != left or (j := after[i]) == n or symbols[j] != right:
                continue  # stale
            symbols[i], symbols[j] = joined, -1  # no rule has -1: entries for j are stale from now on
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of.get(joined << 32 | symbols[k])) is not None:
                    push(queue, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := rank_of.get(symbols[h] << 32 | joined)) is not None:
                push(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, the number of rules where there is no merge."""
        pairs = left << 32 | right
        at = np.searchsorted(self.pairs[:-1], pairs)
        return np.where(self.pairs[at] == pairs, self.pair_ranks[at], self.pair_ranks[-1])

    def merge_rows(self, symbols: np.ndarray) -> list[list[int]]:
        """``merge`` of words that are rows of a matrix, -1 after the last symbol."""
        out: list[list[int]] = [[]] * len(symbols)
        word, ranks = np.arange(len(symbols)), self.ranks(symbols[:, :-1], symbols[:, 1:])
        while len(word):
            # a column more, so that there is a least rank
            ranks = np.c_[ranks, np.full(len(word), self.pair_ranks[-1])]
            best = ranks.argmin(axis=1)
            least = ranks[np.arange(len(word)), best]
            more = least < self.pair_ranks[-1]
            for w, row in zip(word[~more].tolist(), symbols[~more].tolist()):
                out[w] = [s for s in row if s >= 0]
            word, symbols, ranks, best, joined = word[more], symbols[more], ranks[more, :-1], best[more], self.joined[least[more]]
            if not len(word):
                break
            # the right symbol goes, and with it the rank of the pair
            rows, place = np.arange(len(word)), np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, place + (place > best[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, place[:-1] + (place[:-1] >= best[:, None]), axis=1)
            symbols[rows, best] = joined
            for side, there in ((best - 1, best > 0), (best, best < len(place) - 1)):
                r, c = rows[there], side[there]
                ranks[r, c] = self.ranks(symbols[r, c], symbols[r, c + 1])
        return out

    def merged(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Words of the split pattern with their ids, in any order."""
        words = sorted(words, key=len)
        for k in range(0, len(words), ROWS):
            part = words[k:k + ROWS]
            data = [w.encode() for w in part]
            sizes = np.array([len(d) for d in data])
            flat, ends = np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes)
            symbols = self.byte_ids[flat]
            symbols[ends - 1] = self.last_byte_ids[flat[ends - 1]]
            if sizes.max() > SHORT_WORD or (symbols < 0).any():
                for w, own in zip(part, np.split(symbols, ends[:-1])):
                    yield w, self.merge(own[own >= 0].tolist())
            else:
                rows = np.full((len(part), sizes.max()), -1)
                rows[np.arange(sizes.max()) < sizes[:, None]] = symbols
                yield from zip(part, self.merge_rows(rows))

    def normalized(self, text: str) -> str:
        # one character at a time, so the capital sigma never becomes a final one
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def cut_up(self, text: str | None) -> list[str | int]:
        """The words of a text; special strings are their own ids."""
        if self.cut is None or not self.cut.search(text or ""):
            return self.words.findall(self.normalized(text or ""))
        parts = enumerate(self.cut.split(text))
        return [x for k, part in parts for x in ([self.special[part]] if k % 2 else self.words.findall(self.normalized(part)))]

    def learn(self, words: set[str | int]) -> None:
        """Puts the words into ``known``."""
        new = []
        for w in words:
            if isinstance(w, int):
                self.known[w] = self.decimal[w], self.strings[w]
            elif (x := self.older.get(w)) is not None:
                self.known[w] = x
            else:
                new.append(w)
        for w, ids in self.merged(new):
            self.known[w] = " ".join([self.decimal[i] for i in ids]), self.decode(ids)

    def pieces(self, texts: Iterable[str | None]) -> Iterator[list[tuple[str, str]]]:
        """For each text the words that have ids, in order: the ids in decimal and the decoded
        text, both joined by a space."""
        held, size = [], 0
        for text in texts:
            held.append(self.cut_up(text))
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._pieces(held)
                held, size = [], 0
        yield from self._pieces(held)

    def _pieces(self, texts: list[list[str | int]]) -> Iterator[list[tuple[str, str]]]:
        if len(self.known) >= KEPT_WORDS:
            self.known, self.older = {}, self.known
        new = set().union(*texts).difference(self.known)
        self.learn(new)
        for words in texts:
            yield list(filter(_decimal, map(self.known.__getitem__, words)))
        for w in new:
            if isinstance(w, str) and len(w) > KEPT_CHARS:
                del self.known[w]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null as empty."""
        for pieces in self.pieces(texts):
            yield np.array([int(i) for x in pieces for i in x[0].split(" ")], dtype=np.int32)

    def encode(self, text: str | None) -> np.ndarray:
        ids, = self.encode_all([text])
        return ids

    def digests(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
        for pieces in self.pieces(texts):
            ids = " ".join(map(_decimal, pieces)).encode()
            yield (ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(),
                   hashlib.sha256(" ".join(map(_decoded, pieces)).encode()).hexdigest())

    def decode(self, ids) -> str:
        """The vocabulary's strings in order, joined as the format says without a decoder:
        by one space.  Unknown ids have no string."""
        return " ".join([s for s in map(self.strings.get, ids) if s is not None])


def _codec(path: str) -> Codec:
    def read() -> Codec:
        with open(path, encoding="utf-8") as f:
            return Codec(f.read())

    return once_per_worker(("bpe", path), read)


def _added(df: DataFrame, fields: list[T.StructField], col: str, run) -> DataFrame:
    """``df`` plus ``fields``, which ``run`` makes of a batch's column ``col``."""
    at = df.columns.index(col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *run(batch.column(at))], [*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(go, T.StructType([*df.schema.fields, *fields]))


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` plus the ids of every whole text as ``array<int>``.

    Null and empty texts have no ids (an empty array).  Every row is on its own: repeated
    rows, null keys and extra columns pass through; an empty table gives an empty one."""
    def run(texts):
        codec = _codec(path)
        ids = list(codec.encode_all(x.as_py() for x in texts))
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))]

    return _added(df, [T.StructField(out_col, T.ArrayType(T.IntegerType()))], text_col, run)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` plus the text of every row's ids; null ids as none (an empty text)."""
    def run(lists):
        codec = _codec(path)
        return [pa.array((codec.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in lists), pa.string())]

    return _added(df, [T.StructField(out_col, T.StringType())], ids_col, run)


def bpe_digests(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` without the text, plus ``n_tokens``, ``ids_sha256`` (of the decimal ids joined
    by a space) and ``decoded_sha256`` (of the text that decoding gives): both directions
    in one pass, so neither ids nor texts leave the worker."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def run(texts):
        codec = _codec(path)
        found = list(codec.digests(x.as_py() for x in texts))
        return [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return _added(df, fields, text_col, run).drop(text_col)


def bpe_query(documents: DataFrame, path: str) -> DataFrame:
    return bpe_digests(documents.select(F.col("doc_id"), F.col("text")), path)
