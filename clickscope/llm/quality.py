"""Quality rules with adaptive thresholds.

Each text gets counts (Arrow batches, byte operations).  Their ratios go into quantile
sketches, one per language, source and ratio: log-linear histograms of integers (the
value's leading ``SKETCH_BITS`` bits name its bin, so a bin is 1/64 of its value wide at
most).  Sketches of parts merge by adding counts, in any order and to the same result,
so they are a plain ``groupBy().count()``, combined before the shuffle; a sketch has at
most some 4,000 bins however many documents it holds.  The fences come from the
sketch's quartiles and are joined back to the texts' rows.  A group's quartiles are blended
with those of its language's sketch (merged from its sources'), and these with the whole
table's, as if ``prior`` documents of the wider sketch belonged to the group: the larger the group,
the more its own count, without a step.  Where quartiles agree, as for what
most texts don't hold at all, the distance is the weight of one occurrence in a short text of the group,
by the sketch of the texts' sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickscope.llm.common import broadcast_checked, fresh, materialize, ship

ship(__name__)

SKETCH_BITS = 7


@dataclass(frozen=True)
class Rule:
    """A ratio, 1000 * ``over`` / ``under`` rounded down, must lie within ``spread`` times
    a distance of the upper quartile: that to the median, or the ratio of one occurrence
    (``unit`` of ``over``) in a text of the lower quartile's ``under`` if that is more.
    ``low``: below the lower quartile is judged as well."""

    name: str
    over: str
    under: str
    spread: int
    unit: int = 1
    low: bool = False


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    prior: int = 100  # documents of the wider sketch in a group's blend
    rules: tuple[Rule, ...] = (
        Rule("word_length", "word_chars", "n_words", 16, low=True),
        Rule("symbols", "n_symbols", "n_words", 32),
        Rule("dup_lines", "n_dup_lines", "n_lines", 2),
        Rule("repeats", "n_repeat_words", "n_words", 10, unit=6),  # a 3-word window and its copy
    )

    @property
    def sizes(self) -> tuple[str, ...]:
        """What the ratios are taken of; sketched as well."""
        return tuple(dict.fromkeys(r.under for r in self.rules))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SPACE = b" \t\n\r\x0b\x0c"
_NO_LETTER_START = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first time included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, seen = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = seen[which] > 1
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k:len(words) - 2 + k] |= twice
    return int(inside.sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """``COUNTS`` of a UTF-8 text; null as empty: all 0."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), len(text.translate(None, _NO_LETTER_START)), len(text) - len(text.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words), len(lines))


def with_counts(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` plus the struct of ``COUNTS``.  Other columns pass through."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(x.as_py()) for x in batch.column(at).cast(pa.binary())]
            made = pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(COUNTS))], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out_col])

    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, kind)]))


def sketch_bin(value: Column) -> Column:
    """Least value of the bin of a long >= 0."""
    shift = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(ratios: DataFrame) -> DataFrame:
    """``(lang, source, rule, bin, n)`` from ``(lang, source, rule, value)``."""
    return ratios.groupBy("lang", "source", "rule", sketch_bin(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(bins: DataFrame, by: list[str]) -> DataFrame:
    """``by`` plus ``size, q1, q2, q3`` of merged sketches: the first bin whose running count
    reaches the quantile's share."""
    merged = bins.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    # one row a bin: a window over a sketch, not over documents
    upto = Window.partitionBy(*by).orderBy("bin")
    run = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(Window.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("size") * q, F.col("bin")))
    return run.groupBy(*by).agg(F.max("size").alias("size"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))


def fences(bins: DataFrame, params: QualityParams) -> DataFrame:
    """``(lang, source, least, most)``: maps of rule to limit for every language and source."""
    own, lang, whole = (quartiles(bins, by) for by in (["lang", "source", "rule"], ["lang", "rule"], ["rule"]))
    renamed = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    lang, whole = renamed(lang, "lang"), renamed(whole, "all")
    joined = (own.join(lang, F.col("lang").eqNullSafe(F.col("lang_lang")) & (F.col("rule") == F.col("lang_rule")))
              .join(F.broadcast(whole), F.col("rule") == F.col("all_rule")))  # a row a rule
    blend = lambda size, q, wider: F.call_function("div", size * q + params.prior * wider, size + params.prior)
    blended = [blend(F.col("size"), F.col(q), blend(F.col("lang_size"), F.col(f"lang_{q}"), F.col(f"all_{q}"))).alias(q) for q in ("q1", "q2", "q3")]
    groups = joined.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct(*blended)))).alias("q"))

    def limits(edge: str, sign: int, rules: list[Rule]) -> Column:
        out = []
        for r in rules:
            q, size = F.col("q")[r.name], F.greatest(F.col("q")[r.under]["q1"], F.lit(1).cast("long"))
            step = F.call_function("div", F.lit(1000 * r.unit).cast("long"), size)
            out += [F.lit(r.name), q[edge] + sign * r.spread * F.greatest(sign * (q[edge] - q["q2"]), step)]
        return F.create_map(*out) if out else F.lit(None).cast("map<string,bigint>")

    return groups.select("lang", "source", limits("q1", -1, [r for r in params.rules if r.low]).alias("least"),
                         limits("q3", 1, list(params.rules)).alias("most"))


def _judged(counted: DataFrame, c: str, lang_col: str, source_col: str, params: QualityParams) -> tuple[DataFrame, Column, Column]:
    """``counted`` (stored, with the struct ``c``) joined to its fences; base_failed; kept."""
    n = lambda name: F.col(f"{c}.{name}")
    base_failed = (n("n_words") < params.min_words) | (100 * n("n_repeat_words") > params.max_repeat_percent * n("n_words"))
    value = {r.name: F.when(n(r.under) > 0, F.floor(1000 * n(r.over) / n(r.under))).otherwise(0) for r in params.rules}
    measured = {**value, **{x: n(x) for x in params.sizes}}
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("value")) for k, v in measured.items()]))
    # texts that the base rules reject have no say in what is usual
    ratios = counted.where(~base_failed).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), stack.alias("r"))
    bins = materialize(sketches(ratios.select("lang", "source", "r.rule", "r.value")), "sketches")
    limits = materialize(fences(bins, params), "fences")
    l, s, least, most = (fresh(counted, f"_{x}") for x in ("fence_lang", "fence_source", "least", "most"))
    limits = limits.select(F.col("lang").alias(l), F.col("source").alias(s), F.col("least").alias(least), F.col("most").alias(most))
    fits = F.lit(True)
    for r in params.rules:
        fits = fits & (value[r.name] <= F.col(most)[r.name])
        if r.low:
            fits = fits & (value[r.name] >= F.col(least)[r.name])
    joined = counted.join(broadcast_checked(limits, 100_000), counted[lang_col].eqNullSafe(F.col(l)) & counted[source_col].eqNullSafe(F.col(s)), "left")
    return joined, base_failed, ~base_failed & fits


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     source_col: str = "source", params: QualityParams = QualityParams()) -> DataFrame:
    """One row for each row of ``df``: the id, the counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules; null is a language and a
    source like any other; repeated rows each count and stay; extra columns are not read;
    an empty table gives an empty one."""
    own = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = materialize(with_counts(own, "text", "c").drop("text"), "counts")
    joined, base_failed, kept = _judged(counted, "c", "lang", "source", params)
    return joined.select(F.col("id").alias(id_col), *[F.col(f"c.{x}").alias(x) for x in COUNTS[:5]],
                         base_failed.alias("base_failed"), kept.alias("kept"))


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
              params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``df`` that are kept; columns as they are."""
    c = fresh(df, "_counts")
    counted = materialize(with_counts(df, text_col, c), "counted")
    joined, _, kept = _judged(counted, c, lang_col, source_col, params)
    return joined.where(kept).select(*[counted[x] for x in df.columns])
