"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence is toxic with probability sigmoid(bias +
sum of its distinct words' weights); a document is toxic if one of its sentences is
(noisy-or: 1 - product of (1 - p), in training over the sentences with words of the model).
Only document labels are known; the gradient of their likelihood passes through the noisy-or to the sentences.
A word's weight is the sum over its features: the word and its first letters, so that
inflected and compound forms share what is learned.  The sentence scores then locate the
offending sentences.

Small probabilities add up in a noisy-or, so a long text of clean sentences would come out
toxic by its length alone: the score is the noisy-or of the offending sentences, or 0.49
of that of all where none offends (which ranks such texts).  A sentence offends from the trained p of ``offending`` on (in
threefold cross-validation on training documents of one table, the value of 0.2, 0.3, 0.4
and 0.5 with the most hits less false alarms); the model's bias is moved so that this is 0.5.

Training takes a bounded sample: the ``train_documents`` labelled documents least by a
hash of their id, whole, and of each document the ``train_sentences`` sentences with words of
the model that are least by hash (scoring has no bounds).  Feature counts over the sample
are a ``groupBy``; the ``max_features`` features that documents' labels set apart most, and
those sentences' features, are what reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickscope.llm.common import materialize, ship

ship(__name__)

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
_HALF = float(np.log(0.5))
_KEPT_WORDS = 200_000  # weights of words that a task remembers


@dataclass(frozen=True)
class ToxicityParams:
    train_documents: int = 10_000
    train_sentences: int = 1_000
    min_documents: int = 4  # that hold a feature, else it isn't learned
    max_features: int = 4_096
    min_apart: float = 3.0  # standard deviations that labels must set a feature apart
    prefixes: tuple[int, ...] = (4, 5, 6)
    steps: int = 500
    rate: float = 0.1
    penalty: float = 1e-4
    offending: float = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)  # feature -> weight
    prefixes: tuple[int, ...] = ()

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word, self.prefixes))


def features(word: str, prefixes: tuple[int, ...]) -> list[int]:
    """Signed 64-bit feature ids of a lower-case word."""
    names = [f"={word}", *(f"^{word[:n]}" for n in prefixes if len(word) > n)]
    return [x - (1 << 64) if (x := xxhash.xxh64_intdigest(s.encode())) >> 63 else x for s in names]


def sentences(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of the sentences that have words."""
    for m in _SENTENCE.finditer(text or ""):
        if words := set(_WORD.findall(m[0].lower())):
            yield m.start(), m.end(), words


def _log_clean(model: ToxicityModel, text: str | None, known: dict[str, float]) -> list[tuple[int, int, float]]:
    """(start, end, log of (1 - p)) of each sentence."""
    out = []
    for start, end, words in sentences(text):
        z = model.bias
        for w in words:
            if (s := known.get(w)) is None:
                if len(known) >= _KEPT_WORDS:
                    known.clear()
                s = known[w] = model.word(w)
            z += s
        out.append((start, end, -np.logaddexp(0.0, z)))
    return out


def text_score(clean: list[float]) -> float:
    """The score of a text from its sentences' logs of (1 - p)."""
    offending = [c for c in clean if c <= _HALF]
    return float(-np.expm1(sum(offending))) if offending else float(-0.49 * np.expm1(sum(clean)))


def _sample(documents: DataFrame, labels: DataFrame, params: ToxicityParams, id_col: str, text_col: str, label_col: str, held_out) -> DataFrame:
    """``(id, text, toxic)`` of the training documents: one row an id, toxic if any label of
    it is 1.  Null ids and labels teach nothing."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max(F.col("y").cast("int")).alias("toxic"))
    own = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # the ids are chosen before texts move: ids of documents that have labels, the least by hash
    chosen = materialize(
        own.select("id").join(known, "id").distinct().orderBy(F.xxhash64("id"), "id").limit(params.train_documents), "train_ids")
    one = own.join(F.broadcast(chosen), "id")  # at most train_documents rows
    return materialize(one.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), "train")


def fit(sample: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """The model of ``(text, toxic)`` rows, which must be few enough to train on the driver
    (see ``ToxicityParams``).  Without rows of both labels every score is the bias'."""
    prefixes, most = params.prefixes, params.train_sentences

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for x in batch.column(0):
                words = set().union(*(w for _, _, w in sentences(x.as_py())))
                lists.append(list({f for w in words for f in features(w, prefixes)}))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int64()))], ["toxic", "features"])

    n, toxic = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not toxic or toxic == n:
        return ToxicityModel(bias=(8.0 if toxic else -8.0), prefixes=prefixes)
    share = toxic / n
    counted = (sample.select("text", "toxic").mapInArrow(bags, "toxic int, features array<long>")
               .select("toxic", F.explode("features").alias("feature"))
               .groupBy("feature").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("tf")).where(F.col("df") >= params.min_documents))
    apart = F.abs(F.col("tf") - F.col("df") * share) / F.sqrt(F.col("df") * (share * (1 - share)))
    apart = counted.withColumn("apart", apart).where(F.col("apart") >= params.min_apart)
    best = [r["feature"] for r in apart.orderBy(F.desc("apart"), "feature").limit(params.max_features).collect()]
    number = {f: k for k, f in enumerate(best)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for x in batch.column(0):
                text = x.as_py()
                found = [(a, b, own) for a, b, words in sentences(text) if (own := [number[f] for w in words for f in features(w, prefixes) if f in number])]
                if len(found) > most:
                    found = sorted(found, key=lambda s: (xxhash.xxh64_intdigest(text[s[0]:s[1]].encode()), s[0]))[:most]
                lists.append([own for _, _, own in found])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.list_(pa.int32())))], ["toxic", "hits"])

    rows = sample.select("text", "toxic").mapInArrow(hits, "toxic int, hits array<array<int>>").toArrow()
    y = rows.column(0).to_numpy().astype(float)
    bag, of, at, s = [], [], [], 0
    for d, found in enumerate(rows.column(1)):
        for own in found.as_py():
            bag.append(d)
            of += own
            at += [s] * len(own)
            s += 1
    weights, bias = _train(y, np.array(bag, int), np.array(of, int), np.array(at, int), len(best), params)
    bias += float(np.log(1 / params.offending - 1))
    return ToxicityModel(bias, {f: float(w) for f, w in zip(best, weights) if w}, prefixes)


def _train(y, bag, of, at, n_features: int, params: ToxicityParams) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or likelihood.  y: label of each document; bag: document of each
    sentence with features; of, at: feature and sentence of each occurrence."""
    w, n, n_sentences = np.zeros(n_features + 1), len(y), len(bag)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, params.steps + 1):
        z = w[-1] + np.bincount(at, w[of], n_sentences)
        clean = -np.bincount(bag, np.logaddexp(0, z), n)  # log of P(no toxic sentence)
        # d/dz of the log likelihood: -p if the label is 0, p * P(clean) / P(toxic) if it is 1
        pull = np.where(y > 0, np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), -1.0)
        push = pull[bag] / (1 + np.exp(-z))
        gradient = np.zeros_like(w)
        gradient[:-1] = np.bincount(of, push[at], n_features)
        gradient[-1] = push.sum()
        gradient = gradient / n - params.penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w + params.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` plus the score of every whole text and, in ``worst_sentence``, the start, end
    and score of its most toxic sentence (null for a text without words)."""
    at = df.columns.index(text_col)
    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores, worst = [], []
            for x in batch.column(at):
                found = _log_clean(model, x.as_py(), known)
                scores.append(text_score([c for _, _, c in found]))
                low = min(found, key=lambda s: s[2], default=None)
                worst.append(low and {"start": low[0], "end": low[1], "score": float(-np.expm1(low[2]))})
            kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(worst, kind)],
                                             [*batch.schema.names, out_col, "worst_sentence"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType()), T.StructField("worst_sentence", place)]))


def held_out_fifth(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(id, held_out, score, predicted, worst_sentence)`` for each row of ``documents``.

    Labels of held-out ids (crc32 of the id's text mod 5 = 0) are not learned from.  Null
    and empty texts have no sentence and score 0; a null id is not held out; repeated rows
    stay; extra columns are not read; without labels of both kinds every sentence has the
    same score."""
    model = fit(_sample(documents, labels, params, id_col, text_col, label_col, held_out_fifth), params)
    scored = score(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model).drop("text")
    return scored.select(F.col("id").alias(id_col), held_out_fifth(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_sentence")
