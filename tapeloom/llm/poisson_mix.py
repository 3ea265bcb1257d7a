"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's repetition rate is the ratio of its target bytes to the bytes it has. Each document draws its copies from a Poisson
distribution with its source's rate by inverting a uniform number that a hash of seed and doc_id gives: no state, no order, the
same answer in every retry. Copies are put in one global random order by a second hash.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.frames import staged, without

SEED = 17
# Shares of the mixture for named sources; the others divide what is left in proportion to their bytes.
TARGET_WEIGHTS = {"src0": 0.15, "src1": 0.08, "src2": 0.08, "src3": 0.02, "src4": 0.06}
MOST_RATE = 500.0           # of one draw
MOST_SENT_SOURCES = 5_000   # with more sources than this, rates are joined by a shuffle


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 hash."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_rates(docs: DataFrame, weights: Mapping[str, float], source: str, text: str, total: float | None = None) -> DataFrame:
    """source, bytes, rate: copies per document that give each source its share of `total` bytes (default: what there is).

    A source without bytes has rate 0; if no source is left for the unnamed share, the named shares are scaled to 1.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("bytes"))
    named = F.coalesce(*[F.when(F.col("source") == name, F.lit(float(w))) for name, w in weights.items()], F.lit(None).cast("double")) if weights else F.lit(None).cast("double")
    sized = staged(sizes.withColumn("named", named))
    whole = sized.agg(F.sum("bytes").alias("all_bytes"), F.sum(F.when(F.col("named").isNull(), F.col("bytes"))).alias("other_bytes"),
                      F.coalesce(F.sum(F.when(F.col("bytes") > 0, F.col("named"))), F.lit(0.0)).alias("named_share"))
    target = F.lit(total) if total is not None else F.col("all_bytes").cast("double")
    others = F.coalesce(F.col("other_bytes"), F.lit(0)) > 0
    share = F.when(F.col("named").isNotNull(), F.when(others, F.col("named")).otherwise(F.col("named") / F.col("named_share")))
    share = share.otherwise((F.lit(1.0) - F.col("named_share")) * F.col("bytes") / F.col("other_bytes"))
    rate = F.when(F.col("bytes") > 0, share * target / F.col("bytes")).otherwise(0.0)
    # One row of totals.
    return sized.join(F.broadcast(whole)).select("source", "bytes", rate.alias("rate"))


def parts_of(rate: Column) -> Column:
    """In how many equal parts a rate is drawn: sums of independent Poisson draws are Poisson draws of the summed rate."""
    return F.greatest(F.ceil(rate / MOST_RATE), F.lit(1)).cast("int")


def poisson_steps(rate: Column) -> Column:
    """P(copies <= k) for k = 0, 1, ... until what is left is below the resolution of `uniform`; for rates up to MOST_RATE.

    Summed from logarithms, so that a large rate doesn't underflow.
    """
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    first = F.struct(F.lit(0.0).alias("log_factorial"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("steps"))

    def add(state: Column, k: Column) -> Column:
        log_factorial = state["log_factorial"] + F.log(k.cast("double"))
        total = state["sum"] + F.exp(k * F.log(rate) - rate - log_factorial)
        return F.struct(log_factorial.alias("log_factorial"), total.alias("sum"), F.concat(state["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), first, add)["steps"]).otherwise(F.array(F.lit(1.0)))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, key: str = "doc_id", source: str = "source", text: str = "text",
                seed: int = SEED, total: float | None = None) -> DataFrame:
    """Every document as often as its Poisson draw says, in one global random order; `replica` (1, 2, ...) and `shuffle_key` are added.

    Null sources are one source of their own; a null or empty text weighs nothing, and is drawn with its source's rate; rows
    that repeat a key are drawn alike and each copied; a null key is drawn by its text; an empty table gives an empty result;
    columns of the added names are replaced. The rows of the result are sorted by shuffle_key over all its partitions.
    """
    weights = TARGET_WEIGHTS if weights is None else weights
    shared = source_rates(docs, weights, source, text, total).withColumn("parts", parts_of(F.col("rate")))
    rates = staged(shared.select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), poisson_steps(F.col("rate") / F.col("parts")).alias("__steps")))
    if rates.count() <= MOST_SENT_SOURCES:
        rates = F.broadcast(rates)
    base = without(docs, ["replica", "shuffle_key"])
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    drawn = base.withColumn("__name", name).join(rates, F.col(source).eqNullSafe(F.col("__source")))
    def drawn_copies(u: Column) -> Column:
        return F.size(F.filter("__steps", lambda step: step <= u))
    # Nearly all sources are drawn at once; only a rate beyond MOST_RATE is a sum of draws.
    once = drawn.withColumn("__u", uniform(F.lit(str(seed)), F.col("__name"))).withColumn("__copies", drawn_copies(F.col("__u")).cast("long"))
    more = F.aggregate(F.sequence(F.lit(2), F.col("__parts")), F.lit(0).cast("long"),
                       lambda total, k: total + drawn_copies(uniform(F.concat(F.lit(f"{seed}:"), k.cast("string")), F.col("__name"))))
    copies = once.withColumn("__copies", F.when(F.col("__parts") > 1, F.col("__copies") + more).otherwise(F.col("__copies")))
    copies = copies.filter("__copies > 0").withColumn("replica", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), "__name", "replica")))
    return keyed.drop("__name", "__source", "__parts", "__steps", "__u", "__copies").sort("shuffle_key")
