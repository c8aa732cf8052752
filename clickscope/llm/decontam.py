"""Benchmark decontamination.

The benchmark's distinct n-grams of normalised words are a hash set, broadcast to all
tasks: n-gram hash -> the n-gram and the items it occurs in.  Documents are scanned word
by word: the hash of the window that begins there is looked up, and a hit is verified
word by word.  Scan, window hash and look-up run in one stage of generated code; only
hits and one row a document leave it, to be put together by document.

The hash set is bounded: with more than ``GRAMS_AT_ONCE`` n-grams the set is cut by hash
into as many slices as it takes, and the documents are scanned once a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickscope.llm.common import broadcast_checked, fresh, materialize, word_separators

NGRAM_WORDS = 10
GRAMS_AT_ONCE = 2_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return word_separators(text, SEPARATORS)


def _window_hash(words: Column, at: Column | int, n: int) -> Column:
    """Of the ``n`` words from the 0-based place ``at`` (words beyond the end don't count)."""
    return F.xxhash64(F.lit(n), *[F.get(words, F.lit(at) + i if isinstance(at, int) else at + i) for i in range(n)])


def benchmark_grams(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = NGRAM_WORDS) -> DataFrame:
    """``(hash, gram, len, items)``: every distinct window of an item's words, with the ids
    (as strings) of the items that hold it.  Items of fewer than ``n`` words are one
    window; items without words have none; a null id is not listed."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), _words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    placed = items.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0)))).alias("at"))
    grams = placed.select("item", F.slice("words", F.col("at") + 1, F.lit(n)).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items")).select(
        F.expr(" ".join(["CASE size(gram)", *[f"WHEN {k} THEN xxhash64({k}, {', '.join(f'get(gram, {i})' for i in range(k))})" for k in range(1, n + 1)], "END"])).alias("hash"),
        F.array_join("gram", " ").alias("gram"), F.size("gram").alias("len"), "items")


def contamination(documents: DataFrame, benchmark: DataFrame, id_cols: list[str], text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", n: int = NGRAM_WORDS,
                  grams_at_once: int = GRAMS_AT_ONCE) -> DataFrame:
    """One row for each row of ``documents`` (which must be stored: rows are told apart by
    their place): the ``id_cols`` as they are, ``n_words``, ``n_hit`` (words inside any
    occurrence of a benchmark window), ``items`` (sorted ids, as strings, of the items
    with an occurring window).

    Null texts have no words; repeated rows are judged each on its own; an empty
    benchmark hits nothing; other columns are not read."""
    grams = materialize(benchmark_grams(benchmark, item_col, item_text_col, n), "grams")
    lengths = grams.groupBy("len").count().collect()  # at most n rows
    slices = max(1, -(-sum(r["count"] for r in lengths) // grams_at_once))
    docs = documents.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*id_cols).alias("ids"), _words(F.col(text_col)).alias("words"))
    places = docs.select("row", "ids", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))).alias("at"))
    parts = []
    for s in range(slices):
        hits = places
        for k in sorted(r["len"] for r in lengths):
            own = grams.where((F.col("len") == k) & (F.pmod(F.col("hash"), F.lit(slices)) == s)).select(
                F.col("hash").alias(f"hash_{k}"), F.col("gram").alias(f"gram_{k}"), F.col("items").alias(f"items_{k}"))
            fits = F.col("at") + k <= F.size("words")
            found = F.when(fits, _window_hash(F.col("words"), F.col("at"), k)) == F.col(f"hash_{k}")
            exact = F.array_join(F.slice("words", F.col("at") + 1, F.lit(k)), " ") == F.col(f"gram_{k}")
            hits = hits.join(F.broadcast(own), found & exact, "left").drop(f"hash_{k}")
        kept = [r["len"] for r in lengths]
        any_hit = F.lit(False)
        for k in kept:
            any_hit = any_hit | F.col(f"gram_{k}").isNotNull()
        spans = [F.when(F.col(f"gram_{k}").isNotNull(), F.struct("at", (F.col("at") + k).alias("end"), F.col(f"items_{k}").alias("items"))) for k in kept]
        none = F.array().cast("array<struct<at:int,end:int,items:array<string>>>")
        parts.append(hits.where((F.col("at") == 0) | any_hit).select(
            "row", "ids", F.when(F.col("at") == 0, F.size("words")).alias("n_words"),
            (F.array_compact(F.array(*spans)) if spans else none).alias("spans")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    # a document's spans: at most one for each word and length, less than the text itself
    of_doc = rows.groupBy("row").agg(F.first("ids").alias("ids"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(x["at"].alias("at"), x["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["end"]).alias("end"),
        (acc["n"] + F.greatest(x["end"] - F.greatest(x["at"], acc["end"]), F.lit(0))).alias("n"))
    return of_doc.select(
        "ids.*", F.col("n_words").cast("long").alias("n_words"), F.aggregate(ordered, start, step)["n"].alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: x["items"])))).alias("items"))


def decontamination_report(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           item_col: str = "item_id", item_text_col: str = "text", n: int = NGRAM_WORDS) -> DataFrame:
    """``contamination`` with the number and digest of the items, and ``contaminated``."""
    return contamination(documents, benchmark, [id_col], text_col, item_col, item_text_col, n).select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", n: int = NGRAM_WORDS) -> DataFrame:
    """The rows of ``documents`` without any hit; columns as they are."""
    row = fresh(documents, "_row")
    stored = materialize(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hit = materialize(contamination(stored, benchmark, [row], text_col, item_col, item_text_col, n).where("n_hit > 0").select(row), "hit")
    return stored.join(broadcast_checked(hit), row, "left_anti").select(*documents.columns)
