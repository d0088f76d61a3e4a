"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the total in proportion to its weight, but no more
than ``max_epochs`` times its own size; what a clamped source cannot take is
shared again among the others by weight until none is above its cap. A source
then repeats its documents: whole repetitions for the integer part of its rate
and a seeded fractional one for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

MAX_EPOCHS = 3.0
WEIGHTS = (1, 2, 3)
SEED = "mix"
#: Slots of the seeded order within a source: three hexadecimal digits of an MD5.
SLOTS_HEX = 3
#: Sources whose plan is broadcast at most; beyond it rows are shuffled to their source.
BROADCAST_SOURCES = 100_000


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target`` added.

    The level (target per unit of weight) is raised until the clamped set stops
    changing. One row of sums a round comes to the driver; a round clamps at
    least one more source or ends."""
    cap = F.col("source_size") * F.lit(max_epochs)
    level = None
    while True:
        clamped = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        s = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(clamped, cap)).alias("held"),
            F.sum(F.when(~clamped, F.col("weight"))).alias("free"),
        ).first()
        if not s["free"]:
            break
        new = (float(s["total"]) - (s["held"] or 0.0)) / s["free"]
        if level is not None and new <= level:
            break
        level = new
    target = F.least(cap, F.col("weight") * F.lit(level)) if level is not None else cap
    return sources.withColumn("target", target.cast("double"))


def ranked_sources(sizes: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """Weights by the position of each source in code-point order, null last."""
    placed = common.numbered(sizes, F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    return placed.select("source", "source_size", weight.alias("weight"))


def word_count(text: str) -> Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def text_key() -> Column:
    """A digest of the whole text, which tells rows without or with equal doc_ids apart."""
    return F.coalesce(F.md5("text"), F.lit(""))


def _slot(part: int, seed: str, key: Column) -> Column:
    """The ``part``-th group of hexadecimal digits of the seeded digest of doc_id and text."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), key))
    return F.substring(digest, 1 + part * SLOTS_HEX, SLOTS_HEX)


def _before(*keys: str) -> Column:
    """Words of the slots before this one."""
    return F.coalesce(F.sum("words").over(W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def mix_plan(sized: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, int]:
    """What the mix takes of each source of ``sized(doc_id, source, size, key)``, and the
    number of sources.

    One row a source: ``mix_source, source_size, target, whole, full_slot, cut_slot,
    cut_part``. Its rows are taken ``whole`` times; those in slots up to ``full_slot``,
    and in ``cut_slot`` up to ``cut_part``, once more."""
    placed = sized.select("source", "size", _slot(0, seed, F.col("key")).alias("slot"), _slot(1, seed, F.col("key")).alias("part"))
    slots = common.cut(placed.groupBy("source", "slot").agg(F.sum("size").alias("words")))
    sizes = slots.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = water_fill(common.cut(ranked_sources(sizes, weights)), max_epochs).select(
        F.col("source").alias("mix_source"), "source_size", "target",
        F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).alias("whole"),
    )
    plan = common.cut(plan.withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size")))
    n = plan.count()
    of = F.col("source").eqNullSafe(F.col("mix_source"))
    below = slots.join(common.small(plan.select("mix_source", "rest"), n, BROADCAST_SOURCES), of).where("words > 0")
    below = below.withColumn("open", F.col("rest") - _before("mix_source", "slot")).where("open > 0")
    ends = common.cut(below.groupBy("mix_source").agg(
        F.max(F.when(F.col("open") >= F.col("words"), F.col("slot"))).alias("full_slot"),
        F.max(F.when(F.col("open") < F.col("words"), F.col("slot"))).alias("cut_slot"),
        F.max(F.when(F.col("open") < F.col("words"), F.col("open"))).alias("open"),
    ))
    last = placed.join(common.small(ends.where("cut_slot is not null").select("mix_source", "cut_slot", "open"), n, BROADCAST_SOURCES), of & (F.col("slot") == F.col("cut_slot")))
    last = last.groupBy("mix_source", "part").agg(F.sum("size").alias("words"), F.max("open").alias("open")).where("words > 0")
    last = last.withColumn("before", _before("mix_source", "part")).groupBy("mix_source").agg(
        F.max(F.when(2 * F.col("before") + F.col("words") <= 2 * F.col("open"), F.col("part"))).alias("cut_part")
    )
    for more in (ends.drop("open"), common.cut(last)):
        name = F.col("mix_source").eqNullSafe(F.col("other"))
        plan = plan.join(more.withColumnRenamed("mix_source", "other"), name, "left").drop("other")
    return common.cut(plan.drop("rest")), n


def _taken(docs: DataFrame, plan: tuple[DataFrame, int], seed: str, some: Column, key: Column, prefix: str) -> DataFrame:
    """``docs`` with ``times``, ``source_size`` and ``target``, under names with ``prefix``.
    ``some`` says that a row has words; one without is taken whole times only."""
    named = plan[0].toDF(*[prefix + c for c in plan[0].columns])
    at, slot = (lambda c: F.col(prefix + c)), _slot(0, seed, key)
    again = F.coalesce(slot <= at("full_slot"), F.lit(False)) | F.coalesce((slot == at("cut_slot")) & (_slot(1, seed, key) <= at("cut_part")), F.lit(False))
    joined = docs.join(common.small(named, plan[1], BROADCAST_SOURCES), F.col("source").eqNullSafe(at("mix_source")))
    joined = joined.withColumn(prefix + "times", at("whole") + F.when(again & some, 1).otherwise(0))
    return joined.drop(*[prefix + c for c in ("mix_source", "whole", "full_slot", "cut_slot", "cut_part")])


def mix(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, times, taken`` of each row of ``docs``.

    ``size`` is the number of words of the whole text (null: 0; texts are read once),
    ``times`` how often the mix takes the row, ``taken`` the words that makes. All rows
    of a source are taken the whole number of times that fits its target. For the
    fractional repetition a seeded digest of doc_id and text places them in ``16 ** SLOTS_HEX``
    slots; the slots below the cut are taken once more, and the slot of the cut is
    divided again in the same way, to the nearest slot. So the words of a source meet
    its target to half a slot of a slot. A source of size 0 has target 0 and is taken
    0 times; a row of size 0 is never taken once more. Rows with null or equal doc_ids
    are told apart by their texts; rows equal in both are treated alike; an empty table
    gives no rows; further columns are ignored."""
    sized = common.cut(docs.select("doc_id", "source", word_count("text").alias("size"), text_key().alias("key")))
    out = _taken(sized, mix_plan(sized, weights, max_epochs, seed), seed, F.col("size") > 0, F.col("key"), "")
    return out.drop("key").withColumn("taken", F.col("size") * F.col("times"))


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, in the same columns.

    Texts are read twice, once to count words and once to be handed on; they are
    shuffled only if there are more than ``BROADCAST_SOURCES`` sources. Nulls, ties
    and empty tables are treated as in ``mix``; whatever columns ``docs`` has keep
    their values."""
    sized = common.cut(docs.select("doc_id", "source", word_count("text").alias("size"), text_key().alias("key")))
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    some = F.coalesce(F.col("text").rlike(common.WORD), F.lit(False))
    taken = _taken(docs, mix_plan(sized, weights, max_epochs, seed), seed, some, text_key(), prefix).where(F.col(prefix + "times") > 0)
    return taken.withColumn(prefix + "copy", F.explode(F.expr(f"sequence(1L, {prefix}times)"))).select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Target and taken words of every document."""
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    substr(digest, 1, 3) as slot, substr(digest, 4, 3) as part
  from (select *, md5('mix' || coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')) as digest from documents)),
s as (select source, sum(size)::bigint as source_size from d group by source),
k as (select *, [1.0, 2.0, 3.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight,
    source_size * 3.0 as cap from s),
o as (select *, row_number() over (order by cap / weight, source) as i,
    sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cap / weight, source rows between unbounded preceding and 1 preceding), 0) as held,
    sum(weight) over (order by cap / weight, source rows between current row and unbounded following) as free from k),
lv as (select coalesce(max(case when (total - held) / free * weight <= cap then null else 0 end), 0) as z,
    min(case when (total - held) / free * weight <= cap then i end) as first_free from o),
level as (select ((total - held) / free)::double as level from o, lv where i = first_free),
p as (select source, source_size, least(cap::double, weight::double * (select level from level))::double as target from o),
b as (select source, slot, sum(size)::bigint as words from d group by all),
r as (select b.source, b.slot, b.words, p.source_size, p.target, coalesce(floor(p.target / nullif(p.source_size, 0)), 0)::bigint as whole, round(p.target)::bigint as goal,
    coalesce(sum(b.words) over (partition by b.source order by b.slot rows between unbounded preceding and 1 preceding), 0)::bigint as below
  from b join p on b.source is not distinct from p.source),
q as (select *, goal - whole * source_size - below as remaining from r),
m as (select d.*, q.source_size, q.target, q.whole, q.words, q.remaining
  from d join q on d.source is not distinct from q.source and d.slot = q.slot),
c as (select source, part, sum(size)::bigint as words, max(remaining) as remaining from m where remaining > 0 and remaining < words group by all),
c2 as (select *, coalesce(sum(words) over (partition by source order by part rows between unbounded preceding and 1 preceding), 0)::bigint as below from c),
c3 as (select source, max(part) as last from c2 where words > 0 and 2 * below + words <= 2 * remaining group by source)
select m.doc_id, m.size, m.source_size, m.target, (m.size * (m.whole + case
    when m.source_size > 0 and (m.remaining >= m.words or (m.remaining > 0 and m.part <= c3.last)) then 1 else 0 end))::bigint as taken
from m left join c3 on m.source is not distinct from c3.source
"""
