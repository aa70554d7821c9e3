"""Mixing sources to target shares of the total size by Pareto order sampling.

A source's quota is its share of the total.  Spread over its documents by
weight, the quota asks each for a number of copies: the whole part is certain,
the rest is a chance.  Documents are ranked by the odds of a uniform number
over the odds of that chance, and taken in this order until the quota is met.

Everything that decides is small: sums by source and weight set the chances,
sums by source and rank find the rank where a source is full.  Documents are
then told apart by that rank alone, and only the few in the bin where it lies
are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Ranks are counted in so many bins a source before the bin that meets the quota is looked at in full.
_BINS = 4096
#: Weights are counted in bins of a 64th of a power of two.
_STEPS = 64
#: Up to so many target sources, what is known of each is sent to all executors; beyond, it is shuffled.
_BROADCAST_SOURCES = 10_000


def plan(sums: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """What each target source can give: ``(source, target_share, max_repeats, available, n_docs, quota, binds)``.

    ``sums`` has ``source``, ``available`` and ``n_docs``.  Without ``total``,
    it is the largest that lets every source with any text reach its share; a
    source without text can't, and the others then keep their shares to each
    other.  So the poorest source for its share holds the size of the whole
    mix; a source ``binds`` if its quota takes all it may give.
    """
    rows = targets.join(sums, "source", "left").fillna(0, ["available", "n_docs"])
    most = F.col("max_repeats") * F.col("available")
    if total is None:
        can = F.when((F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), most / F.nullif(F.col("target_share"), F.lit(0.0)))
        rows = rows.withColumn("_total", F.min(can).over(Window.partitionBy(F.lit(1))))  # a row a target source
    else:
        rows = rows.withColumn("_total", F.lit(float(total)))
    wanted = F.coalesce(F.col("_total"), F.lit(0.0)) * F.col("target_share")
    # The source that sets the total may miss it by rounding.
    binds = F.coalesce((wanted > 0) & (most > 0) & (wanted * F.lit(1 + 1e-9) >= most), F.lit(False))
    return rows.withColumns({"quota": F.least(wanted, most.cast("double")), "binds": binds}).drop("_total")


def _uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) for each key, the same on every run."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _scales(weights: DataFrame, quotas: DataFrame) -> DataFrame:
    """``(source, _scale)``: copies of a document are its weight times the scale, at most ``max_repeats``, and add up to the quota.

    Documents whose copies are limited leave their part to the others.  Bins
    of weight from the heaviest down: the first from which on nobody exceeds
    the limit sets the scale.  A quota that takes everything has no scale.
    """
    rows = weights.join(quotas.where("quota > 0").select("source", "quota", "max_repeats", "available"), "source")
    down = Window.partitionBy("source").orderBy(F.desc("_wbin"))
    above = F.coalesce(F.sum("_sum").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum("_mass").over(down.rowsBetween(0, Window.unboundedFollowing))
    scale = (F.col("quota") - F.col("max_repeats") * above) / F.nullif(below, F.lit(0.0))
    fits = F.when((scale > 0) & (scale * F.col("_wmax") <= F.col("max_repeats") * F.lit(1 + 1e-9)), F.struct(-F.col("_wbin"), scale.alias("s")))
    rows = rows.withColumn("_fit", fits)
    one = rows.groupBy("source").agg(F.first("quota").alias("quota"), F.first("max_repeats").alias("max_repeats"), F.first("available").alias("_available"), F.min("_fit")["s"].alias("_scale"))
    everything = F.col("quota") * F.lit(1 + 1e-9) >= F.col("max_repeats") * F.col("_available")
    return one.select("source", F.when(~everything, F.col("_scale")).alias("_scale"))


def mix(docs: DataFrame, targets: DataFrame, key: str, source: Column, size: Column, weight: Column | None = None, total: float | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Select documents so that each source has its share of the total size.

    Returns the selection ``(key, source, size, copies)`` and the report
    ``(source, target_share, max_repeats, available, n_docs, selected,
    most_copies, reached_share, reached, binds, quota)``.  No document gets
    more than its source's ``max_repeats`` copies.  A source is filled in the
    order of the ranks up to its quota; the document that would go beyond is
    taken if that comes nearer to the quota, so a source misses it by half of
    one document's size at most, to either side, or gives all it has where
    that is less.  ``weight`` makes the chances unequal: twice the weight asks
    for twice the copies (default: equal).  Documents with a null key, of an
    unknown or null source, of size 0 or of a weight that is null or not
    positive are never selected; rows of one key count once.
    """
    # Sizes and sources in place, so that the texts are read once.
    rows = docs.select(F.col(key).alias("_key"), source.alias("source"), size.cast("bigint").alias("size"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("_w"))
    rows = cut(rows.where("_key is not null and source is not null and size > 0 and _w > 0 and _w < double('Infinity')").dropDuplicates(["_key"]))
    known = targets.groupBy("source").agg(F.first("target_share").alias("target_share"), F.first("max_repeats").alias("max_repeats")).where("source is not null")
    weights = rows.withColumn("_wbin", F.floor(F.log2("_w") * _STEPS)).groupBy("source", "_wbin").agg(F.sum("size").alias("_sum"), F.count("*").alias("_n"), F.sum(F.col("_w") * F.col("size")).alias("_mass"), F.max("_w").alias("_wmax"))
    quotas = plan(weights.groupBy("source").agg(F.sum("_sum").alias("available"), F.sum("_n").alias("n_docs")), known, total)  # a row a target source
    quotas = cut(quotas.join(_scales(weights, quotas), "source", "left"))
    small = F.broadcast if quotas.count() <= _BROADCAST_SOURCES else lambda x: x
    asked = rows.join(small(quotas.where("quota > 0").select("source", "quota", "max_repeats", "_scale")), "source")
    wish = F.coalesce(F.least(F.col("_w") * F.col("_scale"), F.col("max_repeats").cast("double")), F.col("max_repeats").cast("double"))
    # A whole copy short of the limit by rounding only is a whole copy.
    whole = F.least(F.floor(wish + F.lit(1e-9)).cast("int"), F.col("max_repeats"))
    asked = asked.withColumn("_whole", whole).withColumn("_chance", wish - F.col("_whole"))
    odds = lambda p: p / (1 - p)
    # A document whose chance is nought comes last, but comes, should the quota be open still.
    chance = F.least(F.greatest(F.col("_chance"), F.lit(1e-9)), F.lit(1 - 1e-9))
    # Odds over odds, brought into (0, 1): documents up to about a half are taken, whatever their chances.
    relative = odds(_uniform(F.col("_key"), seed)) / odds(chance)
    asked = asked.withColumn("_rank", relative / (1 + relative)).withColumn("_open", F.col("max_repeats") > F.col("_whole"))
    asked = asked.withColumn("_bin", F.when(F.col("_open"), F.least(F.floor(F.col("_rank") * _BINS), F.lit(_BINS - 1)).cast("int")).otherwise(F.lit(-1)))
    asked = asked.select("_key", "source", "size", "_whole", "_rank", "_bin", "quota")
    bins = asked.groupBy("source", "_bin").agg(F.first("quota").alias("quota"), F.sum(F.col("_whole") * F.col("size")).alias("_certain"), F.sum(F.when(F.col("_bin") >= 0, F.col("size")).otherwise(0)).alias("_sum"))
    every, so_far = Window.partitionBy("source"), Window.partitionBy("source").orderBy("_bin")
    bins = bins.withColumns({"_free": F.col("quota") - F.sum("_certain").over(every), "_upto": F.sum("_sum").over(so_far)})
    # The first bin that goes beyond what is free, and what is free when it begins; none if all fit.
    edge = bins.where("_bin >= 0 and _upto > _free").groupBy("source").agg(F.min(F.struct("_bin", (F.col("_free") - F.col("_upto") + F.col("_sum")).alias("_room"))).alias("_e"))
    edge = cut(edge.select("source", F.col("_e._bin").alias("_edge"), F.col("_e._room").alias("_room")))
    placed = asked.join(small(edge), "source", "left")
    more = (F.col("_bin") >= 0) & (F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")))
    plain = placed.where("_edge is null or _bin <> _edge").withColumn("_more", more.cast("int"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("_rank", "_key").rowsBetween(Window.unboundedPreceding, 0))
    # The document over the edge is taken if at least half of it is free.
    at_edge = placed.where("_bin = _edge").withColumn("_more", (upto - F.col("size") / 2 <= F.col("_room")).cast("int"))
    columns = ["_key", "source", "size", (F.col("_whole") + F.col("_more")).alias("copies")]
    chosen = plain.select(*columns).unionByName(at_edge.select(*columns)).where("copies > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("selected"), F.max("copies").alias("most_copies"))
    report = quotas.join(got, "source", "left").fillna(0, ["selected", "most_copies"])
    share = F.coalesce(F.col("selected") / F.nullif(F.sum("selected").over(Window.partitionBy(F.lit(1))), F.lit(0)), F.lit(0.0))
    report = report.select("source", "target_share", "max_repeats", "available", "n_docs", "selected", "most_copies", share.alias("reached_share"), (F.abs(share - F.col("target_share")) <= F.lit(0.005)).alias("reached"), "binds", "quota")
    return chosen.withColumnRenamed("_key", key), report
