"""Mix sources to target weights.

Tokens are summed per source, which gives each source a repetition rate; a document is then emitted
floor(rate) times, plus one copy more with a probability equal to the fraction, drawn from a hash of
its id. Everything is an aggregation over sources and a per-row expression; no document is shuffled
but by the join to the rates, which Spark broadcasts where the list of sources is small.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows with a
null id draw by their text; repeated rows draw alike; other columns may have any names; an empty table gives an empty result; a source
without words has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import words_of, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: 13 hexadecimal digits of a hash are 52 bits, which a double holds exactly.
DRAW_BITS = 52


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Targets share ``share`` times all sizes by weight; no target passes ``most`` times its source's size
    and the excess goes to the others by weight. That is a water level: it rises as sources reach their
    cap, and each round sums up what is left for the others, until no more do. Sources are numbered by
    range of their names and a round is one aggregation, so that there may be as many sources as hosts.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("last", F.col("source").isNull())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    per = numbered(per, ["last", "source"], "nth").select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap"))
    per = written(per, "sources")
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w") if capped >= 0 else F.lit(False)
        r = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("held"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if r["w"] is None or r["n"] == capped:
            break
        level, capped = (r["all"] * share - (r["held"] or 0.0)) / r["w"], r["n"]
    target = F.col("cap") if r["w"] is None else F.least(F.col("cap"), F.lit(level) * F.col("w"))
    return per.select("source", "source_size", target.alias("target"))


def draw(id_col: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone, or the text where the id is null."""
    key = F.concat_ws(":", F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, DRAW_BITS // 4), 16, 10).cast("double") / F.lit(float(2**DRAW_BITS))


def copies(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(row, size, source_size, target, copies): each row of ``docs`` as a struct, and how often the mix takes it."""
    sized = docs.select(F.struct(*docs.columns).alias("row"), F.size(words_of(F.col("text"))).cast("long").alias("size"))
    targets = source_targets(sized.select("row.source", "size"), weights, share, most).withColumnRenamed("source", "of")
    rated = sized.join(targets, F.col("row.source").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    taken = F.floor(rate) + F.when(draw(F.col("row.doc_id"), F.col("row.text"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return rated.select("row", "size", "source_size", "target", taken.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as the mix takes it, in the columns of ``docs``."""
    found = copies(docs, seed, **how).where(F.col("copies") > 0)
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
