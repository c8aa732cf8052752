"""Every operator against a plain version written from its contract, on a whole table."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import sys
import zlib

import pytest
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


def _query(spark, name, sf=SF):
    from clickscope.llm.catalog import QUERIES

    return QUERIES[name](spark, sf)


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    from clickscope.llm.catalog import vocabulary_path

    t = Tokenizer.from_file(vocabulary_path())
    got = {r["doc_id"]: r for r in _query(spark, "op1_bpe").collect()}
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_odd_texts_equal_the_library():
    from tokenizers import Tokenizer

    from clickscope.llm.bpe import Codec
    from clickscope.llm.catalog import vocabulary_path

    path = vocabulary_path()
    t, codec = Tokenizer.from_file(path), Codec(open(path, encoding="utf-8").read())
    r = random.Random(5)
    pool = [chr(x) for x in [*range(0x250), *range(0x370, 0x500), *range(0x2000, 0x2070), 0x1F600, 0xFEFF, 0xAC00, 0x1100, 0x1161, 0x300, 0x323, 0x130, 0x212B]]
    texts = ["".join(r.choice(pool) if r.random() < 0.5 else r.choice("abth 'sTHE\n") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["", "a" * 3000, "<|startoftext|>hello<|endoftext|>  World's", "ΟΔΟΣ ΣΑΣ,", "don'T 'LL", " \x1c \x85 "]
    for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        ids = codec.encode(x).tolist()
        assert ids == e.ids
        assert codec.decode(ids) == t.decode(e.ids, skip_special_tokens=False)


def test_bpe_short_words_are_merged_together(monkeypatch):
    from clickscope.llm.bpe import SHORT_WORD, Codec
    from clickscope.llm.catalog import vocabulary_path

    r = random.Random(6)
    words = ["".join(r.choice("aeionrst") for _ in range(r.randint(1, 2 * SHORT_WORD if k < 20 else SHORT_WORD))) for k in range(6000)] + ["é" * 9]
    with open(vocabulary_path(), encoding="utf-8") as f:
        codec = Codec(f.read())
    text, singly = " ".join(words), []
    merge = codec.merge
    monkeypatch.setattr(codec, "merge", lambda symbols: singly.append(len(symbols)) or merge(symbols))
    ids = codec.encode(text).tolist()
    assert len(singly) < len(words) // 3 + 1, "only blocks that hold a long word go word by word"
    plain = []
    for w in words:
        data = w.encode()
        plain += merge([*codec.byte_ids[list(data[:-1])].tolist(), int(codec.last_byte_ids[data[-1]])] if len(data) > 1 else [int(codec.last_byte_ids[data[0]])])
    assert ids == plain


def test_bpe_encode_then_decode(spark, docs):
    from clickscope.llm.bpe import bpe_decode, bpe_digests, bpe_encode
    from clickscope.llm.catalog import vocabulary_path

    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    path = vocabulary_path()
    long = bpe_decode(bpe_encode(df, path), path).toPandas().set_index("doc_id")
    short = bpe_digests(df, path).toPandas().set_index("doc_id")
    for i, row in long.iterrows():
        assert len(row.ids) == short.loc[i].n_tokens
        assert hashlib.sha256(row.decoded.encode()).hexdigest() == short.loc[i].decoded_sha256


def _plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _least_reachable(nodes, linked):
    """node -> least node reachable over the pairs ``linked``."""
    near = collections.defaultdict(set)
    for a, b in linked:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def test_simhash_fingerprints_and_components(spark, docs):
    got = {r["doc_id"]: r for r in _query(spark, "op4_simhash").collect()}
    marks = {i: _plain_simhash(t) for i, t in zip(docs.doc_id, docs.text)}
    linked = [(a, b) for a, b in itertools.combinations(marks, 2) if (marks[a] ^ marks[b]).bit_count() <= 2]
    least = _least_reachable(marks, linked)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{m:016x}", least[i]) for i, m in marks.items()}
    assert linked


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_covering_finds_every_link(spark, bits):
    from clickscope.llm.simhash import links

    r = random.Random(bits)
    marks = {0, (1 << 64) - 1}
    for _ in range(60):
        m = r.getrandbits(64)
        marks.add(m)
        for _ in range(6):
            for b in r.sample(range(64), r.randint(1, bits + 1)):
                m ^= 1 << b
            marks.add(m)
    signed = {m - (1 << 64) if m >> 63 else m: m for m in marks}
    df = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    got = {(x["a"], x["b"]) for x in links(df, bits).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if (signed[a] ^ signed[b]).bit_count() <= bits}


def test_components_of_random_graphs(spark):
    from clickscope.llm.components import connected_components

    r = random.Random(3)
    for n, m in ((30, 20), (200, 150), (60, 400)):
        edges = [(r.randint(-n, n), r.randint(-n, n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1080)]
        want = _least_reachable({x for e in edges if e[0] != e[1] for x in e}, edges)
        got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {x["node"]: x["root"] for x in got} == want and len(got) == len(want)


def _plain_contamination(docs, items, n=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = collections.defaultdict(set)
    for item, text in items:
        w = norm(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[k:k + n])].add(str(item))
    for i, text in docs:
        w, hit, found = norm(text), set(), set()
        for g, own in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= own
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_with_short_items_and_slices(spark):
    from clickscope.llm import decontam

    items = [(1, "One two, THREE four five six seven eight nine ten eleven"), (2, "short item"), (10, "x"), (3, ""), (4, None),
             (5, "one two three four five six seven eight nine ten"), (6, "a a a a a a a a a a a a")]
    docs = [(1, "zero one two three four five six seven eight nine ten eleven end"), (2, "a Short item, x! a short item"), (3, None), (4, ""),
            (5, "a " * 40), (6, "nothing here"), (7, "one two three four five six seven eight nine"), (1, "short item")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(_plain_contamination(docs, items))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(tuple(r) for r in decontam.decontamination_report(d, b).select(cols).collect()) == want
    for at_once in (1, 3):
        got = decontam.contamination(d, b, ["doc_id"], grams_at_once=at_once).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"])) for r in got) == [w[:4] for w in want]


def test_long_clean_texts_stay_clean(spark):
    """A noisy-or over all sentences would call a text toxic for its length."""
    from clickscope.llm import toxicity as t

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    model = t.fit(t._sample(docs, labels, t.ToxicityParams(), "doc_id", "text", "toxic", t.held_out_fifth))
    one = t.score(docs, model).toPandas()
    clean = one[one.score < 0.5].text.dropna().tolist()
    assert len(clean) > 300
    joined = [(k, ". ".join(clean[:k])) for k in (10, 100, 300)] + [(0, ""), (-1, None)]
    got = {r["k"]: r for r in t.score(spark.createDataFrame(joined, "k int, text string"), model).collect()}
    assert all(r["score"] < 0.5 for r in got.values()) and got[0]["score"] == got[-1]["score"] == 0
    toxic = one[one.score >= 0.9].text.iloc[0]
    long = t.score(spark.createDataFrame([(1, got[300]["text"] + ".\n" + toxic)], "k int, text string"), model).first()
    assert long["score"] >= 0.9 and long["worst_sentence"]["start"] > len(got[300]["text"])


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = _query(spark, "op6_toxicity", sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    own = got[got.held_out].merge(labels, on="doc_id")
    hit, positive = ((own.predicted == 1) & (own.toxic == 1)).sum(), (own.toxic == 1).sum()
    # some of this table's toxic documents hold none of the words that mark the others
    assert hit / positive > 0.85
    assert hit / (own.predicted == 1).sum() > 0.97
    above = own.score.rank()[own.toxic == 1].sum() / positive - (positive + 1) / 2
    assert above / (own.toxic == 0).sum() > 0.97


def test_toxicity_finds_the_sentence(spark):
    from clickscope.llm import toxicity as X

    r = random.Random(1)
    words = ["".join(r.choice("aeioubcdfg") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(400):
        s = [" ".join(r.choices(words, k=8)) + "." for _ in range(5)]
        if i % 3 == 0:
            s[i % 5] = "you utter grumblefink " + s[i % 5]
        rows.append((" ".join(s), int(i % 3 == 0)))
    model = X.fit(spark.createDataFrame(rows, "text string, toxic int"))
    out = X.score(spark.createDataFrame([("Fine words here. What a grumblefink you are. All is well.",), ("",), (None,)], "text string"), model).collect()
    worst = out[0]["worst_sentence"]
    assert out[0]["score"] > 0.5 and "grumblefink" in out[0]["text"][worst["start"]:worst["end"]]
    assert out[1]["score"] == out[2]["score"] == 0 and out[1]["worst_sentence"] is None


def _minimax(sizes, shards):
    """Least possible largest shard over runs, by dynamic programming."""
    total = [0, *itertools.accumulate(sizes)]
    best = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], total[i] - total[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("cells", [4, 16, 65536])
def test_minimax_cuts(spark, cells):
    from clickscope.llm.sharding import minimax_cuts

    r = random.Random(cells)
    for n, shards in ((1, 3), (7, 3), (60, 7), (90, 40)):
        sizes = [r.randint(1, 50) * r.choice([1, 1, 20]) for _ in range(n)]
        ends = list(itertools.accumulate(sizes))
        df = spark.createDataFrame([(e,) for e in ends], "total long")
        cuts = minimax_cuts(df, "total", shards, max(sizes), cells)
        edges = [0, *cuts, ends[-1]]
        assert len(cuts) < shards and set(cuts) <= set(ends) and edges == sorted(edges)
        assert max(b - a for a, b in zip(edges, edges[1:])) == _minimax(sizes, shards)


def test_sharding_law(spark, docs):
    got = _query(spark, "op8_sharding").toPandas().merge(docs[["doc_id", "text"]], on="doc_id")
    assert len(got) == len(docs) and set(got.law) == {"bytes"}
    data = [(t or "").encode() for t in got.text]
    assert got["size"].tolist() == [len(b) + 16 for b in data] and got.text_crc32.tolist() == [zlib.crc32(b) for b in data]
    assert (got.groupby("text").shard.nunique() == 1).all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    # groups over the mean of what is left have a shard of their own; the rest, in order of the first id, is a minimax
    groups = got.groupby("text").agg(size=("size", "sum"), first=("doc_id", "min"), shard=("shard", "first"))
    total, left = groups["size"].sum(), 40
    alone = []
    for size, first in sorted(zip(groups["size"], groups["first"]), reverse=True):
        if size * left <= total:
            break
        alone.append(first)
        total, left = total - size, left - 1
    rest = groups[~groups["first"].isin(alone)].sort_values("first")
    assert rest.shard.is_monotonic_increasing
    assert rest.groupby("shard")["size"].sum().max() == _minimax(rest["size"].tolist(), left)


def test_url_rules_and_learned_verdicts(spark):
    sf = "/root/testdata/sf0.1"
    got = _query(spark, "op10_url_filter", sf).toPandas()
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").toPandas()
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    got = got.merge(pages, on="page_id")
    assert len(got) == len(pages)
    for r in got.itertuples():
        rest = r.url.partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [x for x in rules if ("." + host).endswith("." + x[1]) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path) == (host, path)
        assert (r.rule == best[1] + best[2] and r.verdict == best[0]) if best else (r.rule is None and r.verdict == ("block" if r.score >= 0.5 else "allow"))
    learned = got[got.rule.isna()]
    assert len(learned) and set(got.verdict) == {"allow", "block"}


def test_url_features(spark):
    from pyspark.sql import functions as F

    from clickscope.llm.url_filter import entropy, host_and_path

    urls = ["http://A.b/c?d#e", "x", None, "", "p://h", "p://h?q=/x", "a://b://c/d", "http://h/π%20?x=1&y=2", "://", "aab"]
    host, path = host_and_path(F.col("u"))
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", host.alias("h"), path.alias("p"), entropy(F.coalesce("u", F.lit(""))).alias("e")).collect()
    assert [(r.h, r.p) for r in rows] == [("a.b", "/c"), ("", ""), ("", ""), ("", ""), ("h", ""), ("h", ""), ("b:", "//c/d"), ("h", "/π%20"), ("", ""), ("", "")]
    for r in rows:
        c = collections.Counter(r.u or "")
        n = sum(c.values())
        assert r.e == pytest.approx(-sum(k / n * math.log2(k / n) for k in c.values()) if n else 0)


def test_main_text_of_the_pages(spark):
    import html as H

    got = {r["page_id"]: r for r in _query(spark, "op3_html_text").collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    assert len(got) == len(pages)
    for i, page in zip(pages.page_id, pages.html):
        article = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))


@pytest.mark.parametrize("page, want", [
    ("", ""), (None, ""), ("plain  text", "plain text"), ("<p>a<p>b &amp; c<br>d", "a\n\nb & c d"), ("<!-- open", ""), ("<script>x", ""),
    ("<article><p>a</p><form>f</form><div class='comments'><p>c c c c</p></div><aside>x</aside></article>", "a"),
    ("<body><div class='menu'><a href=/>home</a></div><div id=main><h2>T</h2><p>one two three four five six</p><p>seven eight nine</p></div>"
     "<div class='cookie-notice'>we use cookies, many of them, all day long</div></body>", "T\n\none two three four five six\n\nseven eight nine"),
    ("<article><p title='a>b' hidden>no</p><p title='a>b'>yes&nbsp;&#x41;</p></article>", "yes A"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
    ("<div>" * 3000 + "deep", "deep"), ("a < b", "a < b"), ("</p></div>x", "x"),
])
def test_main_text_of_small_pages(page, want):
    from clickscope.llm.html_text import main_text

    assert main_text(page) == want


@pytest.mark.parametrize("block", ["div", "section"])
def test_main_text_in_two_blocks_of_the_body(block):
    """Without article or main, the article may stand in several children of the body."""
    from clickscope.llm.html_text import main_text

    texts = [" ".join(f"word{i}x{k}" for k in range(80)) for i in range(6)]
    part = lambda ps: f"<{block}>" + "".join(f"<p>{p}</p>" for p in ps) + f"</{block}>"
    links = "<div>" + "".join(f"<a href=/{i}>link {i}</a>" for i in range(5)) + "</div>"
    page = f"<body><div class=menu>menu</div>{part(texts[:3])}{part(texts[3:])}{links}<div class=footer>foot</div></body>"
    assert main_text(page) == "\n\n".join(texts)


def test_repeated_passages(spark):
    """Passages planted inside other text are found in all their documents, in no other."""
    from clickscope.llm.paragraph_dedup import repeated_passages

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    filler = lambda n: [word() for _ in range(n)]
    passages = [filler(51), filler(60), filler(120)]
    near = filler(100)
    rows, planted = [], collections.defaultdict(set)
    for i in range(60):
        words = filler(r.randint(40, 200))
        if i % 4 < 3:
            k = r.randint(0, len(words))
            words[k:k] = passages[i % 4]
            planted[i % 4].add(i)
        text = " ".join(words)
        if i in (3, 7, 11):  # lines that differ in one word
            line = list(near)
            line[r.randint(0, 99)] = word()
            text += "\n" + " ".join(line) + "\n" + " ".join(filler(5))
            planted["near"].add(i)
        rows.append((i, text))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    clusters = got.groupby("component_id").doc_id.agg(set).to_dict()
    assert clusters == {min(p): p for p in planted.values()}
    assert set(got[got.n_removed == 0].doc_id) == {min(p) for p in planted.values()}
    for row in got.itertuples():
        assert row.n_words >= 32 and (row.n_removed == 0 or 32 <= row.n_removed <= row.n_words)


def test_passages_go_as_far_as_the_words_agree(spark):
    """The whole common run is reported and removed, wherever it stands."""
    from clickscope.llm.paragraph_dedup import repeated_passages

    r = random.Random(12)
    filler = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    rows, want = [], []
    for k, n in enumerate([51, 60, 80, 120, 200]):
        passage = filler(n)
        for i, (before, after) in enumerate([(20, 30), (0, 41), (77, 0)]):
            rows.append((10 * k + i, " ".join([*filler(before), *passage, *filler(after)])))
            want.append((10 * k + i, before, n, 10 * k, n if i else 0))
    passage = filler(70)  # twice in the first document
    rows += [(90, " ".join([*passage, *filler(9), *passage, *filler(9)])), (91, " ".join([*filler(15), *passage]))]
    want += [(90, 0, 70, 90, 0), (90, 79, 70, 90, 70), (91, 15, 70, 90, 70)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(row) for row in got) == want


def test_edited_copies_inside_other_text(spark):
    """A word changed, put in or left out in the middle of 60, inside longer lines or
    wrapped; not what has a similarity under 0.8."""
    from clickscope.llm.paragraph_dedup import repeated_passages

    r = random.Random(13)
    filler = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    wrap = lambda words, n: "\n".join(" ".join(words[i:i + n]) for i in range(0, len(words), n))
    rows, want = [], []
    edits = [lambda w: [*w[:30], "new", *w[31:]], lambda w: [*w[:30], "new", *w[30:]], lambda w: [*w[:30], *w[31:]],
             lambda w: [*w[:53], "new", *w[54:]], lambda w: [*w[:20], "new", *w[21:40], "new", *w[41:]]]
    for k, edit in enumerate(edits):
        passage = filler(60)
        other = edit(passage)
        rows.append((10 * k, " ".join([*filler(25), *passage, *filler(35)])))
        rows.append((10 * k + 1, " ".join([*filler(40), *other, *filler(10)])))
        rows.append((10 * k + 2, wrap([*filler(18), *other, *filler(30)], 9)))
        rows[-1] = (10 * k + 2, rows[-1][1] if k < 4 else "none")  # equal edits are exact copies
        if k < 4:
            n = len(other)
            want += [(10 * k, 25, 60, 10 * k, 0), (10 * k + 1, 40, n, 10 * k, n), (10 * k + 2, 18, n, 10 * k, n)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(row) for row in got) == want


def test_short_lines_are_paragraphs(spark):
    """Lines of any length are found; a line of 20 words also by similarity."""
    from clickscope.llm.paragraph_dedup import repeated_passages

    r = random.Random(11)
    filler = lambda n: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    long, short, one = filler(20), filler(8), filler(1)
    near = [*long[:19], "other"]
    texts = [[filler(40), short, filler(3)], [short], [filler(9), long], [near, filler(30)], [one, filler(12)], [filler(10), [], one]]
    rows = [(i, "\n".join(" ".join(line) for line in t)) for i, t in enumerate(texts)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(row) for row in got) == [
        (0, 40, 8, 0, 0), (1, 0, 8, 0, 8), (2, 9, 20, 2, 0), (3, 0, 20, 2, 20), (4, 0, 1, 4, 0), (5, 10, 1, 4, 1)]


def test_similar_lines_of_a_large_bucket(spark):
    """Blocks of a bucket are compared with one another: no link is lost, output stays a tree."""
    from clickscope.llm.paragraph_dedup import ParagraphParams, repeated_passages

    r = random.Random(8)
    base = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    rows = []
    for i in range(90):
        line = list(base)
        line[i % 60] += str(i)
        rows.append((i, " ".join(line)))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), params=ParagraphParams(block=8)).toPandas()
    assert set(got.component_id) == {0} and set(got.doc_id) == set(range(90))


def test_quality_counts():
    from clickscope.llm.quality import counts

    r = random.Random(2)
    texts = ["", "a b c a b c", "x " * 60, "é#é \n\n é#é\n é#é \n", "a a a a"] + [
        "".join(r.choice("ab é\n\t#$|") for _ in range(r.randint(0, 120))) for _ in range(300)]
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert counts(t.encode()) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)),
                                      sum(x in lines[:i] for i, x in enumerate(lines)), len(inside), len(lines))


def test_quality_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = _query(spark, "op7_quality", sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    good = got[(got.quality == 1) & ~got.base_failed]
    assert good.kept.all()
    assert not got[got.quality == 0].kept.any()


def test_sketch_quartiles(spark):
    from clickscope.llm.quality import quartiles, sketches

    r = random.Random(4)
    rows = [("en", s, "r", r.choice([r.randint(0, 90), r.randint(0, 10**6)])) for s in ("a", "b") for _ in range(500)]
    bins = sketches(spark.createDataFrame(rows, "lang string, source string, rule string, value long"))
    for by, keys in ((["source"], [("a",), ("b",)]), (["lang"], [("en",)])):
        for q in quartiles(bins, by).collect():
            own = sorted(x[3] for x in rows if q[by[0]] in (x[0], x[1]))
            for k in (1, 2, 3):
                exact = own[math.ceil(len(own) * k / 4) - 1]
                assert exact - exact / 64 <= q[f"q{k}"] <= exact


def test_quality_limits_come_from_the_sketches(spark):
    """Limits are the plain ones of blended quartiles, and every rule's differ."""
    from clickscope.llm.quality import QualityParams, counts, fences, sketches

    p = QualityParams()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("lang", "source", "text").toPandas()
    rows = []
    for d in docs.itertuples():
        c = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"), counts((d.text or "").encode())))
        if c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"]:
            rows += [(d.lang, d.source, r.name, 1000 * c[r.over] // max(c[r.under], 1)) for r in p.rules]
            rows += [(d.lang, d.source, x, c[x]) for x in p.sizes]
    frame = spark.createDataFrame(rows, "lang string, source string, rule string, value long")
    got = {(r["lang"], r["source"]): r for r in fences(sketches(frame), p).collect()}
    groups = collections.defaultdict(list)
    least_of_bin = lambda v: v >> max(v.bit_length() - 7, 0) << max(v.bit_length() - 7, 0)
    for lang, source, rule, v in rows:
        for key in ((lang, source, rule), (lang, rule), (rule,)):
            groups[key].append(least_of_bin(v))
    own = {k: (len(v), [sorted(v)[math.ceil(len(v) * q / 4) - 1] for q in (1, 2, 3)]) for k, v in groups.items()}
    blend = lambda one, wider: [(one[0] * a + p.prior * b) // (one[0] + p.prior) for a, b in zip(one[1], wider)]
    assert {k[:2] for k in own if len(k) == 3} == set(got)
    for (lang, source), r in got.items():
        q = {x: blend(own[lang, source, x], blend(own[lang, x], own[x,][1])) for x in (*[y.name for y in p.rules], *p.sizes)}
        for rule in p.rules:
            step = 1000 * rule.unit // max(q[rule.under][0], 1)
            assert r["most"][rule.name] == q[rule.name][2] + rule.spread * max(q[rule.name][2] - q[rule.name][1], step)
            if rule.low:
                assert r["least"][rule.name] == q[rule.name][0] - rule.spread * max(q[rule.name][1] - q[rule.name][0], step)
    for rule in p.rules:
        assert len({r["most"][rule.name] for r in got.values()}) > 1


def test_quality_limits_change_without_a_step(spark):
    """One document more moves a limit by its share only, whatever the group's size."""
    from clickscope.llm.quality import QualityParams, fences, sketches

    p, limits = QualityParams(), {}
    rest = [("en", "big", rule, v) for rule, v in (("word_length", 5000), ("symbols", 0), ("dup_lines", 0), ("repeats", 0), ("n_words", 128), ("n_lines", 8)) for _ in range(3000)]
    for n in (1, 50, 99, 100, 101, 400):
        small = [("en", "small", rule, v) for rule, v in (("word_length", 6016), ("symbols", 100), ("dup_lines", 0), ("repeats", 0), ("n_words", 64), ("n_lines", 8)) for _ in range(n)]
        made = fences(sketches(spark.createDataFrame(rest + small, "lang string, source string, rule string, value long")), p)
        limits[n] = made.where("source = 'small'").first()["most"]["symbols"]
    assert abs(limits[100] - limits[99]) <= p.rules[1].spread and abs(limits[101] - limits[100]) <= p.rules[1].spread
    assert limits[1] < limits[50] < limits[100] < limits[400]


@pytest.mark.parametrize("page", ["<b></i>" * 150_000, "<b>" * 60_000 + "</i>" * 60_000, "<b>" * 60_000 + "<hr>" * 60_000, "<li><b>" * 60_000])
def test_broken_pages_take_linear_time(page):
    import time

    from clickscope.llm.html_text import main_text

    began = time.perf_counter()
    assert main_text(page + "end") == "end"
    assert time.perf_counter() - began < 10  # minutes when each tag walks the open ones


def test_main_text_without_an_article_element():
    """Density finds the same text when nothing is called article."""
    import pandas as pd

    from clickscope.llm.html_text import main_text

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    assert len(pages) and all(main_text(re.sub(r"(</?)article\b", r"\1div", p)) == main_text(p) for p in pages)


def _plain_density_roots(page):
    """Roots of the main text, every sum taken anew over its subtree."""
    from clickscope.llm.html_text import BLOCK

    every = range(len(page.tag))
    above = lambda i: {i} | (above(page.parent[i]) if i else set())
    lines = [above(i) for i in every]
    tree = lambda i: [j for j in every if i in lines[j] and not page.cut[j]]
    chars = lambda nodes: sum(len(t.strip()) for j, t in page.items if t is not None and j in nodes)
    linked = lambda i: {j for j in tree(i) if any(page.tag[k] == "a" for k in lines[j] if i in lines[k])}

    def density(i):
        c, lc, t = chars(set(tree(i))), chars(linked(i)), len(tree(i))
        if not c or page.cut[i]:
            return 0.0
        share = chars(linked(0)) / max(chars(set(tree(0))), 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        lt = max(sum(page.tag[j] == "a" for j in tree(i)), 1)
        return c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / max(1.0, math.log(max(base, math.e)))

    block = lambda i: not i or page.tag[i] in BLOCK
    nearest = lambda i: page.parent[i] if block(page.parent[i]) else nearest(page.parent[i])
    all_of = [density(i) for i in every]
    inner = collections.defaultdict(list)
    for i in reversed(every[1:]):  # the order of the sum counts in the last digit
        if block(i) and all_of[i]:
            inner[nearest(i)].append(all_of[i])
    best = max((i for i in every if block(i)), key=lambda i: (round(sum(inner.get(i, [all_of[i]])), 6), -i))
    if not chars(set(tree(best))):
        return []
    if page.article[best] >= 0:
        return [page.article[best]]
    path = lines[best] - {0} or {0}
    least = min(all_of[i] for i in path)
    return sorted({best} | {i for i in every[1:] if i not in path and page.parent[i] in path and page.parent[i] != best
                            and not page.cut[i] and all_of[i] and all_of[i] >= least})


def test_density_against_plain_sums():
    from clickscope.llm.html_text import Page

    r = random.Random(5)
    names = "div p section b span a ul li h2 td article nav".split()
    for _ in range(400):
        page = Page("".join(r.choice(["<%s>", "<%s>", "</%s>"]) % r.choice(names) + r.choice(["", "one ", "two words here " * r.randint(1, 9)]) for _ in range(r.randint(1, 40))))
        assert page.main_nodes() == _plain_density_roots(page)


def test_common_runs_and_similar_passages_equal_plain_ones():
    import numpy as np

    from clickscope.llm import paragraph_dedup as P

    r, p = random.Random(11), P.ParagraphParams()
    for _ in range(60):
        blocks = [[r.randrange(1, 40 if r.random() < 0.2 else 10**6) for _ in range(r.randint(5, 60))] for _ in range(12)]
        sides = []
        for _ in range(2):
            words = [w for b in r.sample(blocks, 9) for w in [*b, *(r.randrange(10**6) for _ in range(r.randint(0, 3)))]]
            sides.append([w if r.random() > 0.02 else 7 for w in words])
        a, b = sides
        for i, j in [(r.randrange(len(a) + 1), r.randrange(len(b) + 1)) for _ in range(20)] + [(0, 0), (len(a), len(b))]:
            ahead = next((k for k, (x, y) in enumerate(zip(a[i:], b[j:])) if x != y), min(len(a) - i, len(b) - j))
            behind = next((k for k, (x, y) in enumerate(zip(a[:i][::-1], b[:j][::-1])) if x != y), min(i, j))
            assert (P._agreement(a, i, b, j), P._agreement_before(a, i, b, j)) == (ahead, behind)
        one, two = (P.Text(np.array(x, dtype=np.uint64), p) for x in sides)
        assert P._agreement(a, 0, a, 0) == P._agreement_before(a, len(a), a, len(a)) == len(a)
        # the counts bound what sets of shingles say, for any two passages
        (left, shared, own), (right, others_shared, others_own) = P._shingle_counts(one, two)
        for _ in range(20):
            s, t = sorted(r.sample(range(len(left) + 1), 2)), sorted(r.sample(range(len(right) + 1), 2))
            x, y = set(one.shingles[s[0]:s[1]].tolist()), set(two.shingles[t[0]:t[1]].tolist())
            assert (len(set(left[s[0]:s[1]]) & set(right[t[0]:t[1]])), len(set(left[s[0]:s[1]])), len(set(right[t[0]:t[1]]))) == (len(x & y), len(x), len(y))
            assert len(x & y) <= min(shared[s[1]] - shared[s[0]], others_shared[t[1]] - others_shared[t[0]])
            assert len(x ^ y) >= own[s[1]] - own[s[0]] + others_own[t[1]] - others_own[t[0]]
        for a0, a1, b0, b1 in P.copies(one, two, p):
            x, y = set(one.shingles[a0:a1 - 4].tolist()), set(two.shingles[b0:b1 - 4].tolist())
            assert min(a1 - a0, b1 - b0) >= p.min_words and len(x & y) >= p.similarity * len(x | y)


def test_first_least_place_of_consecutive_ones():
    import numpy as np

    from clickscope.llm import paragraph_dedup as P

    r = np.random.default_rng(6)
    for n, most in ((1, 5), (11, 3), (40, 4), (300, 2**63)):
        order = r.integers(0, most, n).astype(np.uint64)
        for gap in (g for g in (1, 2, 11, 19) if g <= n):
            assert P._least(order, gap).tolist() == [i + int(order[i:i + gap].argmin()) for i in range(n - gap + 1)]


def test_equal_texts_are_copied_whole():
    import numpy as np

    from clickscope.llm import paragraph_dedup as P

    r, p = random.Random(3), P.ParagraphParams()
    for n in (0, 5, 11, 12, 31, 32, 33, 60, 400):
        for most in (1, 2, 7, 10**9):  # texts that repeat themselves, and others
            h = P._hashes(b" ".join(b"w%d" % r.randrange(most) for _ in range(n)), P._Hashes())
            assert P.whole_copy(P.Text(h, p), p) == P.copies(P.Text(h.copy(), p), P.Text(h, p), p)
    text = b" One\ttwo\n\nTHREE \xc3\x84 four\r\nfive\x0bsix\n"
    assert np.array_equal(P._hashes(text, P._Hashes()), P._words(text)[0])


def test_words_of_many_texts_are_hashed_at_once():
    import numpy as np
    import xxhash

    from clickscope.llm import paragraph_dedup as P

    r, p = random.Random(8), P.ParagraphParams()
    some = ["".join(r.choice("abAZ\u00c4\x00\x1c\u2003 \t\n\x0b\x0c\r" if r.random() < q else "xY") for _ in range(r.randint(0, 400))).encode() for q in (0.01, 0.05, 0.2, 0.5, 1) for _ in range(12)]
    texts = [None, b"", b" \n ", b"\nx", b"y" * 31, b"Z" * 32, b"z" * 200, *some, b"", None]
    words = [(t or b"").lower().split() for t in texts]
    known = P._Hashes()
    h, sizes, ends = P._word_hashes(texts, known)
    assert known.keys() == {w for text in words for w in text if len(w) >= 32}  # no other word goes one by one
    assert h.tolist() == [xxhash.xxh64_intdigest(w) for text in words for w in text]
    assert sizes.tolist() == [len(w) for w in words]
    lines = [len(line.split()) for t in texts for line in (t or b"").split(b"\n")]
    assert ends.tolist() == np.cumsum(lines).tolist()
    # seeds and shingles of texts side by side are those of each alone
    for text, one in zip(texts, P._texts(texts, p, P._Hashes())):
        alone = P.Text(P._hashes(text or b"", P._Hashes()), p)
        assert one.words == alone.words and one.shingles.tolist() == alone.shingles.tolist()
        assert [x.tolist() for x in one.seeds] == [x.tolist() for x in alone.seeds]


def test_passages_that_grow_keep_their_sets_of_shingles():
    import numpy as np

    from clickscope.llm import paragraph_dedup as P

    r, p = random.Random(4), P.ParagraphParams()

    def plain(one, two):  # of all words from the first to the last, anew for each step
        x, y = ({tuple(s[i:i + 5]) for i in range(len(s) - 4)} for s in (one, two))
        return len(x & y) >= p.similarity * len(x | y)

    for share in (0.01, 0.04, 0.06, 0.1):
        for most in (30, 10**6):  # texts that repeat themselves, and others
            one = [r.randrange(1, most) for _ in range(600)]
            two = [w if r.random() > share else 0 for w in one]
            found = P.copies(*(P.Text(np.array(x, dtype=np.uint64), p) for x in (one, two)), p)
            assert found if share < 0.05 else True
            assert all(plain(one[a:b], two[c:d]) for a, b, c, d in found)


def test_pairs_are_read_in_slices(spark, monkeypatch):
    from clickscope.llm import paragraph_dedup as P

    r = random.Random(9)
    passages = [" ".join(f"p{k}w{i}" for i in range(70)) for k in range(4)]
    rows = []
    for i in range(40):
        own = " ".join(f"o{i}x{k}" for k in range(r.randint(0, 30)))
        rows.append((i, f"{own}\n{r.choice(passages)} {own}" if i % 5 else r.choice([passages[0], "", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = sorted(map(tuple, P.repeated_passages(df).collect()))
    assert whole
    monkeypatch.setattr(P, "_SLICE", 100)
    assert sorted(map(tuple, P.repeated_passages(df).collect())) == whole


def test_first_occurrences_are_looked_for_once_a_row(spark, monkeypatch):
    from clickscope.llm import paragraph_dedup as P

    plans, real = {}, P.materialize

    def kept(df, name="table"):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(P, "materialize", kept)
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{words}\nshort line"), (2, f"x y z {words} more\nshort line"), (3, "short line")]
    got = P.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {1, 2, 3}
    # the filter by kind is below the sums: each kind's rows are grouped alone
    for name, kind in (("pairs", "NOT line#"), ("passages", "line#")):
        sides = [line for line in plans[name].splitlines() if "Filter" in line and "line#" in line]
        assert len(sides) >= 2 and all((kind in line) and (("NOT line#" in line) == (name == "pairs")) for line in sides)
