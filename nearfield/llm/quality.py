"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document gets base figures (words, symbols, repeated lines, repeated 3-word windows). Four
ratios of them go, in whole thousandths, into quantile sketches: counts on a fixed grid of GRID + 1
bins per metric, kept per language and source. Such sketches merge by adding counts, so those of a
language and of the whole come from the same counts. What a group is used to in a metric is median +
SPREAD * (third quartile - first quartile); a group's own value counts with its documents, that of its
language with PRIOR documents beside it, and that of the whole likewise with the language's: groups of
any size are held against their own habits as far as they have shown them. A document is joined to its
group's limits and rejected where it lies more than MARGIN above one of them, or breaks a base rule.

Defined cases: null or blank text has no words and fails the base rule; null language or source is a
group of its own; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, let, words_of, written

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
GRID = 1000
PRIOR = 20
SPREAD = 4
#: Metric -> the least distance, in thousandths, of a limit from its group's median.
MARGIN = {"symbols": 50, "dup_lines": 500, "repeats": 400, "long_words": 600}


def repeated_words(words: Column, hash_bits: int = 64) -> Column:
    """How many words stand in a 3-word window that occurs twice or more in the text.

    The upper bits of each window's hash and its position make a long; sorting these brings equal windows
    side by side. Positions of equal neighbours, sorted, cover min(3, gap) words each. Neighbours whose hashes
    agree are held against each other word by word; where two differ, the text's windows are sorted by
    their words instead, so that the count is exact.
    """

    def counted(w: Column) -> Column:
        n = F.size(w)
        bits = F.length(F.bin(n.cast("long"))).cast("int")
        hashed = lambda i: F.call_function("shiftrightunsigned", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), F.lit(64 - hash_bits))
        keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", hashed(i), bits).bitwiseOR(i.cast("long")))
        plain = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("at")))

        def from_hashes(s: Column) -> Column:
            high = lambda x: F.call_function("shiftright", x, bits)
            low = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
            m = F.size(s) - 1
            twins = F.filter(F.zip_with(F.slice(s, 1, m), F.slice(s, 2, m), lambda a, b: F.when(high(a) == high(b), F.array(low(a), low(b)))), lambda x: x.isNotNull())
            unlike = lambda t: F.exists(F.array(*[F.get(w, F.get(t, F.lit(0)) + k) != F.get(w, F.get(t, F.lit(1)) + k) for k in range(3)]), lambda x: x)
            return let(twins, lambda t: F.when(F.exists(t, unlike), let(F.array_sort(plain), from_words)).otherwise(places(t)))

        def from_words(s: Column) -> Column:
            m = F.size(s) - 1
            same = lambda a, b: (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])
            return places(F.filter(F.zip_with(F.slice(s, 1, m), F.slice(s, 2, m), lambda a, b: F.when(same(a, b), F.array(a["at"].cast("int"), b["at"].cast("int")))), lambda x: x.isNotNull()))

        def places(twins: Column) -> Column:
            return let(F.array_sort(F.array_distinct(F.flatten(twins))), covered)

        def covered(at: Column) -> Column:
            m = F.size(at) - 1
            gaps = F.zip_with(F.slice(at, 1, m), F.slice(at, 2, m), lambda a, b: F.least(b - a, F.lit(3)).cast("long"))
            return F.when(m < 0, F.lit(0).cast("long")).otherwise(F.aggregate(gaps, F.lit(3).cast("long"), lambda total, x: total + x))

        return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(F.array_sort(keys), from_hashes))

    return let(words, counted)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    facts = F.struct(
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("rep"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    return docs.select(
        *keep,
        (F.char_length(text) - F.regexp_count(text, F.lit(SPACE_RUN[:-1]))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        facts.alias("_facts"),
    ).select(*keep, F.col("_facts.w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_facts.l.n").alias("n_lines"), F.col("_facts.l.dup").alias("n_dup_lines"), F.col("_facts.w.rep").alias("n_repeat_words"))


def metric_bins() -> dict[str, Column]:
    """Each metric as whole thousandths from 0 to GRID; 0 where there is nothing to divide by."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.least(F.call_function("div", a * 1000, b), F.lit(GRID).cast("long"))).otherwise(F.lit(0).cast("long"))

    c = F.col
    return {
        "symbols": ratio(c("n_symbols"), c("word_chars")),
        "dup_lines": ratio(c("n_dup_lines"), c("n_lines")),
        "repeats": ratio(c("n_repeat_words"), c("n_words")),
        "long_words": ratio(c("word_chars"), c("n_words") * 20),
    }


def sketches(facts: DataFrame) -> DataFrame:
    """(lang, source, metric, bin, n): the mergeable quantile sketch of each metric per language and source."""
    bins = F.array(*[F.struct(F.lit(m).alias("metric"), b.alias("bin")) for m, b in metric_bins().items()])
    return facts.select("lang", "source", F.inline(bins)).groupBy("lang", "source", "metric", "bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, *group: str) -> DataFrame:
    """(group, metric, docs, q25, q50, q75): the least bin whose cumulated count reaches each share."""
    merged = sketch.groupBy(*group, "metric", "bin").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*group, "metric").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(*group, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(total))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("bin")))
    return ranked.groupBy(*group, "metric").agg(F.first("docs").alias("docs"), at(1).alias("q25"), at(2).alias("q50"), at(3).alias("q75"))


def limits(sketch: DataFrame) -> DataFrame:
    """(lang, source, limit_<metric>...): one row per language and source."""
    own, lang, whole = quantiles(sketch, "lang", "source"), quantiles(sketch, "lang"), quantiles(sketch)
    limit = lambda: F.col("q50") + SPREAD * (F.col("q75") - F.col("q25"))
    own = own.select("lang", "source", "metric", F.col("docs").alias("n_own"), limit().alias("own"))
    lang = lang.select(F.col("lang").alias("_lang"), F.col("metric").alias("_m"), F.col("docs").alias("n_lang"), limit().alias("of_lang"))
    whole = whole.select(F.col("metric").alias("_w"), limit().alias("of_all"))
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_m"))).join(whole, F.col("metric") == F.col("_w"))
    wide = (F.col("n_lang") * F.col("of_lang") + PRIOR * F.col("of_all")) / (F.col("n_lang") + PRIOR)
    blended = (F.col("n_own") * F.col("own") + PRIOR * wide) / (F.col("n_own") + PRIOR)
    picked = joined.select("lang", "source", "metric", blended.alias("limit"))
    return picked.groupBy(F.col("lang").alias("_glang"), F.col("source").alias("_gsource")).agg(*[(F.max(F.when(F.col("metric") == m, F.col("limit"))) + add).alias(f"limit_{m}") for m, add in MARGIN.items()])


def judged(facts: DataFrame, limit: DataFrame) -> DataFrame:
    """``facts`` with base_failed and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    joined = facts.join(limit, F.col("lang").eqNullSafe(F.col("_glang")) & F.col("source").eqNullSafe(F.col("_gsource")), "left")
    above = F.lit(False)
    for m, b in metric_bins().items():
        above = above | F.coalesce(b > F.col(f"limit_{m}"), F.lit(False))
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & ~above).drop("_glang", "_gsource", *[f"limit_{m}" for m in MARGIN])


def assess(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, figures, base_failed, kept) of every row; the figures are worked out once and written."""
    facts = written(measured(docs, "doc_id", "lang", "source"), "quality")
    return judged(facts, limits(sketches(facts)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, in its columns.

    Rows are written with their figures, so that these are worked out once and no join on ids is needed.
    """
    facts = written(measured(docs.withColumn("_row", F.struct(*docs.columns)), "_row", "lang", "source"), "quality")
    return judged(facts, limits(sketches(facts))).where("kept").select("_row.*")
