"""WARC archives, the Merkle manifest and collocations against plain versions, and odd rows."""

import base64
import collections
import hashlib
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
import zstandard

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ------------------------------------------------------------------ archives


def _plain_records(folder):
    """Records of archives, read frame by frame without the module under test."""
    out = []
    for name in sorted(os.listdir(folder)):
        if not name.startswith("part-"):
            continue
        data, at, known, frames = open(f"{folder}/{name}", "rb").read(), 0, None, 0
        while at < len(data):
            magic, size = int.from_bytes(data[at:at + 4], "little"), int.from_bytes(data[at + 4:at + 8], "little")
            if magic == 0x184D2A5D:
                assert at == 0  # the dictionary leads
                known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                at += 8 + size
                continue
            reader = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
            record = reader.decompress(data[at:])
            assert reader.eof
            at, frames = len(data) - len(reader.unused_data), frames + 1
            head, rest = record.split(b"\r\n\r\n", 1)
            assert record.count(b"WARC/1.1\r\n") >= 1 and rest.endswith(b"\r\n\r\n")
            out.append((dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), rest[:-4]))
    return out


def _plain_pages(rows, least=0):
    """The contract's rows of ``(page_id, html)``."""
    same = collections.defaultdict(list)
    for i, html in rows:
        same[(html or "").encode()].append(i)
    out = []
    for i, html in rows:
        body = (html or "").encode()
        first = min((x for x in same[body] if x is not None), default=None)
        again = len(body) >= least and first is not None and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def _rows(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_archives_of_the_whole_table(spark):
    from clickscope.llm.catalog import QUERIES

    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    assert _rows(QUERIES["op11_warc"](spark, SF)) == _plain_pages(list(zip(pages.page_id, pages.html)))


PAGES = "page_id long, url string, html string, payload string, id int, first int"
ODD_PAGES = [
    (7, "http://a/7", "<p>same</p>", "x", 1, 1), (3, "http://a/3\r\nWARC-Type: response", "<p>same</p>", "x", 1, 1), (9, None, "<p>same</p>", "x", 1, 1),
    (None, "http://a/n", "<p>same</p>", "x", 1, 1), (3, "http://a/3b", "<p>same</p>", "x", 1, 1), (4, "u", None, None, 1, 1), (5, "u", "", None, 1, 1),
    (None, None, None, None, None, None), (None, "http://x", "only null ids", None, 1, 1), (None, "http://y", "only null ids", None, 1, 1),
    (11, "http://a/é?q=1 2", "P*M\x18\x00\x00\x00\x00" * 3 + "tail   é", "x", 1, 1), (12, "http://long", "word " * 400_000, "x", 1, 1)]


def test_archives_of_odd_pages(spark):
    from clickscope.llm.warc import WarcParams, archived_pages, read_archives, write_archives
    from clickscope.session import shared_path

    pages = spark.createDataFrame(ODD_PAGES, PAGES).repartition(3)
    assert _rows(archived_pages(pages)) == _plain_pages([(r[0], r[2]) for r in ODD_PAGES])
    short = WarcParams(min_bytes=5)
    assert _rows(archived_pages(pages, params=short)) == _plain_pages([(r[0], r[2]) for r in ODD_PAGES], 5)
    path = shared_path(spark, "warc_test")
    write_archives(pages, path)
    records = _plain_records(path.removeprefix("file:"))
    assert len(records) == len(ODD_PAGES)
    bodies = collections.Counter(b.split(b"\r\n\r\n", 1)[1].decode() for h, b in records if h["WARC-Type"] == "response")
    read = read_archives(spark, path).collect()
    assert collections.Counter(bytes(r["payload"]).decode() for r in read if r["record_type"] == "response") == bodies
    assert {r["page_id"]: r["url"] for r in read}["3"] in ("http://a/3%0D%0AWARC-Type:%20response", "http://a/3b")
    ids = {h["WARC-Record-ID"] for h, _ in records if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in ids for h, _ in records if h["WARC-Type"] == "revisit")
    assert archived_pages(pages.where("false")).collect() == []


def test_archives_share_a_trained_dictionary(spark):
    from clickscope.llm.warc import DICTIONARY_MAGIC, WarcParams, read_archives, write_archives
    from clickscope.session import shared_path

    r = random.Random(3)
    rows = [(i, f"http://site/{i}", "<html><head><title>Fixed heading of the site</title></head><body>" + " ".join(r.choices("alpha beta gamma delta".split(), k=60)) + "</body></html>")
            for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    path = shared_path(spark, "warc_test")
    write_archives(pages, path, params=WarcParams(dictionary_bytes=8_192))
    folder = path.removeprefix("file:")
    parts = [open(f"{folder}/{n}", "rb").read() for n in os.listdir(folder) if n.startswith("part-")]
    assert len(parts) == 4 and all(p[:4] == DICTIONARY_MAGIC for p in parts)
    assert len(_plain_records(folder)) == 600
    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(x[2].encode())) for x in rows)
    assert sum(map(len, parts)) - 4 * 8_192 < 0.9 * (alone + 600 * 400)
    got = {int(x["page_id"]): bytes(x["payload"]).decode() for x in read_archives(spark, path).collect()}
    assert got == {i: html for i, _, html in rows}


def test_frames_never_hold_the_separator():
    from clickscope.llm.warc import EMPTY_FRAME, one_frame

    r = random.Random(1)
    for _ in range(50):
        data = bytes(r.randbytes(r.randint(0, 300))) + EMPTY_FRAME + bytes(r.randbytes(r.randint(0, 300)))
        frame = one_frame(data, zstandard.ZstdCompressor(level=3))
        assert EMPTY_FRAME not in frame and zstandard.ZstdDecompressor().decompress(frame) == data


def test_damaged_records_are_refused():
    from clickscope.llm.warc import parse, record

    good = record("1", "http://a", b"body", None, "2026-01-01T00:00:00Z")
    assert parse(good)[2] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodY"), good.replace(b"WARC/1.1", b"WARC/9.9"), b""):
        with pytest.raises((ValueError, KeyError)):
            parse(bad)


# ------------------------------------------------------------------ manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _plain_tree(nodes):
    """The top node and each leaf's path: lists of (run, slot)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        for leaf, at in enumerate(where):
            paths[leaf].append((runs[at // 8], at % 8))
        where, nodes = [at // 8 for at in where], [_h(*run) for run in runs]
    return nodes[0], paths


def _plain_manifest(rows):
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of documents."""
    def leaf(i, text, lang, source, n):
        return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])

    def lower(text):
        return text and re.sub("[A-Z]", lambda m: m.group().lower(), text)

    groups = collections.defaultdict(list)
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups[r[2]].append((r[0], leaf(*r[:5]), leaf(r[0], lower(r[1]) if tampered else r[1], *r[2:5])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: _plain_tree([x[1] for x in groups[g]]) for g in names}
    root, above = _plain_tree([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for k, g in enumerate(names):
        for (i, own, other), path in zip(groups[g], trees[g][1]):
            proof, node = "", other
            for run, slot in path + above[k]:
                proof += "".join(run[:slot] + run[slot + 1:])
                node = _h(*run[:slot], node, *run[slot + 1:])
            out.append((i, own, trees[g][0], root, _h(proof), node, node == root))
    return sorted(out, key=str)


def _manifest(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_manifest_of_the_whole_table(spark):
    from clickscope.llm.catalog import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    got = _manifest(QUERIES["op12_merkle_manifest"](spark, SF))
    assert got == _plain_manifest([tuple(r) for r in docs.collect()])
    assert {r[6] for r in got} == {True, False}


ODD_DOCS = [
    (1, "Aa", "en", "s", 2), (1, "Aa", "en", "s", 2), (1, "Zz", "en", "s", 2), (None, "Aa", "en", None, None), (None, None, None, None, None), (2, "", None, "", 0),
    (3, "LONG " * 50_000, "de", "s", 9), (4, "é Ä", "", "s", 3), (5, "X", "é", "s", 1), (6, "X", "\U0001f600", "s", 1), (7, "X", "￮", "s", 1)]


def test_manifest_of_odd_rows(spark):
    from pyspark.sql import functions as F

    from clickscope.llm.merkle import tamper_check

    docs = spark.createDataFrame(ODD_DOCS, DOCS).withColumns({c: F.lit(7) for c in ("id", "gid", "pos", "n", "leaf", "root", "digest", "other", "rank")})
    assert _manifest(tamper_check(docs)) == _plain_manifest(ODD_DOCS)
    assert _manifest(tamper_check(docs.limit(1))) == _plain_manifest(ODD_DOCS[:1])
    assert tamper_check(docs.where("false")).collect() == []


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_over_several_rounds(spark, levels):
    """Chunks of 8 and 64 leaves: trees that one task doesn't hold, 1 to 700 leaves a group."""
    from clickscope.llm.merkle import tamper_check

    sizes = {"aa": 1, "ab": 8, "ac": 9, "ad": 64, "ae": 65, "af": 700, None: 513, **{f"b{i}": i + 1 for i in range(12)}}
    rows = [(1000 * k + i, f"Text {i}", g, "s", i) for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert _manifest(tamper_check(docs, chunk_levels=levels)) == _plain_manifest(rows)


def test_a_fold_reads_right_siblings_only():
    from clickscope.llm.merkle import Branch

    children = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(8)]
    branch, new = Branch(list(children)), b"0" * 64
    for slot in range(8):
        want = hashlib.sha256(b"".join(children[:slot] + [new] + children[slot + 1:])).hexdigest().encode()
        branch.children[:slot] = [b"?"] * slot  # what stands left is in the retained state
        assert branch.fold(slot, new) == want


# ------------------------------------------------------------------ collocations


def _plain_collocations(rows, least=30, top=2000):
    """``lang, rank, phrase, a, l, r, n, score`` of ``(lang, text)``."""
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang in f:
        cand = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                if j - i < len(p) and 100 * a >= 80 * f[lang][p[i:j]]}
        rank = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[lang][p[:k]] + f[lang][p[k:]]), k) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), f[lang][p[:k]], f[lang][p[k:]]))
        for at, (score, a, phrase, l, r) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, at, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def _found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_of_the_whole_table(spark):
    from clickscope.llm.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = _found(QUERIES["op13_collocations"](spark, sf))
    assert len(got) > 100 and got == _plain_collocations([tuple(r) for r in docs.select("lang", "text").collect()])


ODD_TEXTS = [
    (None, "a b c. a b c! A B c"), ("und", "a b c\ta  b"), ("en", None), ("en", ""), ("en", " .,;:!?\n\x0b\x0c\r "), ("en", "x x x x x"), ("en", "x x x x x"),
    ("", "q w q w q w"), ("de", "straße ÄB Äb straße ÄB, straße\nÄB"), ("de", "w1 w2 " * 30_000)]


@pytest.mark.parametrize("slice_phrases", [3, 1_000_000])
def test_collocations_of_odd_rows(spark, slice_phrases):
    from pyspark.sql import functions as F

    from clickscope.llm.collocations import CollocationParams, top_collocations

    params = CollocationParams(min_count=2, top=5, slice_phrases=slice_phrases)
    docs = spark.createDataFrame(ODD_TEXTS, "lang string, text string").withColumns({c: F.lit(1) for c in ("n", "word", "hash", "codes", "rank", "a", "words")})
    got = _found(top_collocations(docs.repartition(3), params=params))
    assert got == _plain_collocations(ODD_TEXTS, 2, 5)
    assert {r[0] for r in got} == {"und", "en", "de", ""}
    assert top_collocations(docs.where("false"), params=params).collect() == []
    assert top_collocations(docs.where("lang = 'none'"), params=params).collect() == []


def test_collocations_of_random_texts_with_ties(spark):
    from clickscope.llm.collocations import CollocationParams, top_collocations

    r = random.Random(7)
    rows = [(r.choice(["en", "fr", None]), "".join(r.choice("abcdE") + r.choice([" ", " ", " ", ". ", "\t", "\n"]) for _ in range(r.randint(0, 40)))) for _ in range(400)]
    params = CollocationParams(min_count=6, slice_phrases=50)
    got = _found(top_collocations(spark.createDataFrame(rows, "lang string, text string").repartition(7), params=params))
    assert len(got) > 100 and got == _plain_collocations(rows, 6)


def test_double_array_counts_like_a_dictionary():
    from clickscope.llm.collocations import double_array, phrase_places

    r = random.Random(5)
    for _ in range(30):
        vocabulary = [r.randint(-2**63, 2**63 - 1) or 1 for _ in range(r.randint(1, 40))]
        text = [r.choice([*vocabulary, 0, 77]) for _ in range(600)]
        phrases = list({tuple(r.choice(vocabulary) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 120))})
        want = [sum(tuple(text[i:i + len(p)]) == p for i in range(len(text))) for p in phrases]
        table = np.array([p + (0,) * (4 - len(p)) for p in phrases], np.int64)
        assert phrase_places(double_array(table), np.array(text, np.int64), len(phrases), 4).tolist() == want


def test_longer_phrases_come_from_one_pass(spark):
    from collections import Counter

    import numpy as np

    from clickscope.llm.collocations import longer_phrases

    r = np.random.default_rng(3)
    texts = [np.append(r.integers(0, 7, r.integers(0, 80)), 0).astype(np.int64) for _ in range(60)]
    count = lambda k: Counter(tuple(t[i:i + k].tolist()) for t in texts for i in range(len(t) - k + 1) if t[i:i + k].all())
    usual = [x for x, n in count(2).items() if n >= 45]
    pairs = spark.createDataFrame(usual, "w1 long, w2 long")
    codes = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "codes binary")
    levels = longer_phrases(codes, pairs, 6, 5)
    assert [len(x.columns) for x in levels] == [3, 4, 5]
    for k, level in enumerate(levels, 3):
        want = {x for x, n in count(k).items() if n >= 6 and all(x[i:i + 2] in usual for i in range(k - 1))}
        assert {tuple(x) for x in level.collect()} == want
    assert levels[0].count()


def test_phrases_are_shuffled_as_short_numbers(spark):
    from clickscope.llm import collocations as c

    kinds = []  # what a pass over the texts emits

    class Texts:
        sparkSession = spark

        def __init__(self, frame):
            self.frame = frame

        def select(self, name):
            return self

        def mapInArrow(self, run, kind):
            out = self.frame.mapInArrow(run, kind)
            kinds.append(out.columns)
            return out

    r = np.random.default_rng(8)
    texts = [np.append(r.integers(0, 6, 70), 0).astype(np.int64) for _ in range(20)]
    codes = Texts(spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "codes binary"))
    words = spark.createDataFrame([(w,) for w in range(1, 6)], "w1 long")
    pairs = c.frequent_pairs(codes, words, 30)
    every = [tuple(t[i:i + 2].tolist()) for t in texts for i in range(len(t) - 1) if t[i:i + 2].all()]
    want = {x for x in every if every.count(x) >= 30}
    assert want and {tuple(x) for x in pairs.collect()} == want
    assert len(c.longer_phrases(codes, pairs, 3, 4)) == 2
    assert kinds == [["pair", "n"], ["begin", "s4", "n"]]


def test_phrases_that_share_their_short_number_stay_candidates(spark, monkeypatch):
    from clickscope.llm import collocations as c

    monkeypatch.setattr(c, "_short", lambda columns: np.zeros(len(columns[0]), np.int64))
    rows = [("en", "a b c d. x y"), ("en", "a b c d e"), ("en", "a b, x y z")]
    got = _found(c.top_collocations(spark.createDataFrame(rows, "lang string, text string"), params=c.CollocationParams(min_count=2)))
    assert got == _plain_collocations(rows, 2)


def test_phrases_that_share_a_mixture_stay_apart(monkeypatch):
    from clickscope.llm import collocations as c

    columns = [np.array([5, 6, 5, 6, 5], np.int64), np.array([1, 1, 1, 2, 1], np.int64)]
    monkeypatch.setattr(c, "_mixed", lambda columns: np.zeros(len(columns[0]), np.uint64))
    found, n = c.distinct_rows(columns)
    assert sorted(zip(*[f.tolist() for f in found], n.tolist())) == [(5, 1, 3), (6, 1, 1), (6, 2, 1)]


def test_words_that_share_a_hash_start_again(spark, monkeypatch):
    from clickscope.llm import collocations as c

    text = c.text_words(b"One two,THREE\tfour  five")
    assert text == [b"one", b"two", b"\xff", b"three", b"four", b"five", b"\xff"]
    tries = []
    real = c._coded

    def coded(docs, seed):
        tries.append(seed)
        out = real(docs, seed)
        return out if seed else out.withColumn("hash", out["hash"] * 0 + 1)

    monkeypatch.setattr(c, "_coded", coded)
    rows = [("en", "a b c d a b c d")]
    got = _found(c.top_collocations(spark.createDataFrame(rows, "lang string, text string"), params=c.CollocationParams(min_count=2)))
    assert tries == [0, 1] and got == _plain_collocations(rows, 2)
