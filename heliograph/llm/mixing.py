"""Operator 1: mixing sources to target weights.

Tokens are summed per source, each source gets a target and so a repetition rate, and each document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction. A document's draw depends on the
seed and its id alone. So that a source's words come near its target even where it has few documents, the draws are held against
the fraction in words, not in documents: of a source's documents in order of draw those get a copy that come before the words
of copies reach the fraction of its words, so what is taken misses the target by half a document at most.

Where a source reaches its fraction is found by two aggregations: words by source and DRAWS ranges of the draw (the same
reading that sums the sources), then the documents of the one range in which that happens.

Defined results: a null text has size 0; a null source is a source of its own, last in order; an empty table gives
an empty result; repeated rows are separate documents that draw alike (a null id draws as the text "null"), and documents of one
draw get a copy together or not at all; a source of size 0 has target 0 and rate 0; very long texts are counted whole, and one may be
most of its source, which then misses its target by up to half of it; sources that reach their cap at one level do so in order of
name. Columns of the input named like those added here are replaced, but mix_sources() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, saved, table, word_count

#: Rates of at most so many bytes are broadcast; beyond that they are joined by source and salt.
BROADCAST_BYTES = 8 << 20
SALTS = 32
#: Ranges of the draw for which a source's words are summed.
DRAWS = 1024


def source_rates(docs: DataFrame, source: str = "source", text: str = "text", weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """One row per source: source, source_size, weight, target, rate.

    Weights go to the sources by code point (null last), repeating. The targets share the total size by weight; none
    exceeds ``most`` times its source's size, and the excess goes to the others by weight. With sources in order of
    cap / weight, those that stop at their cap are a prefix, so running sums find the level at once.
    The window below runs over one row per source, not per document.
    """
    return _rates(docs.groupBy(F.col(source).alias("source")).agg(F.sum(word_count(F.col(text))).alias("source_size")), weights, most)


def _rates(sized: DataFrame, weights, most: int) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ordered = sized.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long"))
    ordered = ordered.withColumn("cap", F.col("source_size") * most).withColumn("at", F.col("cap").cast("double") / F.col("weight"))
    by_level = Window.orderBy("at", F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    filled = ordered.withColumn("total", total).withColumn("c", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("r", F.sum("weight").over(after))
    filled = filled.withColumn("capped", F.col("cap").cast("double") * F.col("r") <= (F.col("total") - F.col("c")).cast("double") * F.col("weight"))
    held = F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    left = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        F.least((F.col("total") - held).cast("double") * F.col("weight") / left.cast("double"), F.col("cap").cast("double"))
    )
    return filled.withColumn("target", target).select(
        "source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def draw_of(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long").cast("double") / float(1 << 48)


def thresholds(docs: DataFrame, doc_id: str, source: str, text: str, weights, most: int, seed: int) -> DataFrame:
    """One row per source: what source_rates() gives, and below: documents whose draw is less get the copy."""
    draw = draw_of(F.col(doc_id), seed)
    each = docs.select(F.col(source).alias("source"), draw.alias("draw"), F.floor(draw * DRAWS).cast("int").alias("range"), F.col(text).alias("text"))
    sums = saved(each.groupBy("source", "range").agg(F.sum(word_count(F.col("text"))).alias("size")), "mix-sums")
    rates = saved(_rates(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-rates")
    goals = rates.withColumn("goal", (F.col("rate") - F.floor("rate")) * F.col("source_size")).select(F.col("source").alias("s"), "goal")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = sums.withColumn("before", before).join(goals, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("goal") > 0) & (F.col("before") + F.col("size") > F.col("goal")))
    reached = saved(reached.groupBy("s", "goal").agg(F.min(F.struct("range", "before")).alias("at")).select("s", "goal", F.col("at.range").alias("r"), F.col("at.before").alias("b")), "mix-reached")
    own = each.join(F.broadcast(reached) if _light(reached, "s") else reached, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    drawn = own.groupBy("s", "goal", "r", "b", "draw").agg(F.sum(word_count(F.col("text"))).alias("size"))
    so_far = F.col("b") + F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    late = drawn.withColumn("late", so_far + F.col("size") / 2 > F.col("goal"))
    below = late.groupBy("s").agg(F.coalesce(F.min(F.when(F.col("late"), F.col("draw"))), F.max((F.col("r") + 1) / F.lit(float(DRAWS)))).alias("below"))
    return rates.join(below, F.col("source").eqNullSafe(F.col("s")), "left").select(*rates.columns, F.coalesce("below", F.lit(0.0)).alias("below"))


def _light(rates: DataFrame, source: str) -> bool:
    return (rates.agg(F.sum(F.coalesce(F.octet_length(source), F.lit(0)) + 64).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES


def with_copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=(1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_rate and mix_copies."""
    docs = docs.drop("mix_source_size", "mix_target", "mix_rate", "mix_size", "mix_copies", "_mix_key", "_mix_below")
    rates = saved(thresholds(docs, doc_id, source, text, weights, most, seed), "mix-thresholds").select(
        F.col("source").alias("_mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate"), F.col("below").alias("_mix_below")
    )
    if _light(rates, "_mix_key"):
        joined = docs.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col("_mix_key")))
    else:
        salted = rates.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in (doc_id, text)]), F.lit(SALTS)).cast("int")
        joined = docs.withColumn("_mix_salt_of", salt).join(salted, F.col(source).eqNullSafe(F.col("_mix_key")) & (F.col("_mix_salt_of") == F.col("_mix_salt"))).drop("_mix_salt", "_mix_salt_of")
    copies = F.floor("mix_rate").cast("long") + (draw_of(F.col(doc_id), seed) < F.col("_mix_below")).cast("long")
    return joined.withColumn("mix_size", word_count(F.col(text))).withColumn("mix_copies", copies).drop("_mix_key", "_mix_below")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, its own columns and mix_copy (from 0)."""
    docs, back = aside(docs.drop("mix_copy"), "mix_source_size", "mix_target", "mix_rate", "mix_size", "mix_copies")
    taken = with_copies(docs, **options).filter("mix_copies > 0")
    return back(taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_copies") - 1)).alias("mix_copy")))


def op1_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_copies(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    )


OP1_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, (1 + (row_number() over (order by source asc nulls last) - 1) % 3)::bigint as weight, 3 * source_size as cap from s),
a as (select *, cap::double / weight as lvl from w),
f as (select *, (sum(source_size) over ())::bigint as total,
        coalesce(sum(cap) over (order by lvl, source asc nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as c,
        (sum(weight) over (order by lvl, source asc nulls last rows between current row and unbounded following))::bigint as r from a),
g as (select *, cap::double * r <= (total - c)::double * weight as capped from f),
t as (select source, source_size, case when capped then cap::double else least((total - (sum(case when capped then cap else 0 end) over ())::bigint)::double * weight
        / (sum(case when capped then 0 else weight end) over ())::double, cap::double) end as target from g),
k as (select d.doc_id, d.source, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
        ('0x' || substr(md5('17:' || coalesce(d.doc_id::varchar, 'null')), 1, 12))::bigint::double / 281474976710656.0 as draw
      from d join t on d.source is not distinct from t.source),
e as (select source, draw, sum(size)::bigint as size, any_value((rate - floor(rate)) * source_size) as goal from k group by source, draw),
l as (select source, draw, coalesce(sum(size) over (partition by source order by draw rows between unbounded preceding and 1 preceding), 0) + size / 2 > goal as late, goal from e),
b as (select source, case when max(goal) <= 0 then 0.0 else coalesce(min(case when late then draw end), 1.0) end as below from l group by source)
select doc_id, size, source_size, target, (size * (floor(rate)::bigint + (draw < below)::int))::bigint as taken from k join b on k.source is not distinct from b.source
"""
