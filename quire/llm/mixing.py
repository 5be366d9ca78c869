"""Sources mixed to target weights by Sainte-Lague apportionment of equal blocks of words.

A source's target decides how many blocks of BLOCK words it gets: seats go to the highest
quotients target / (2 s + 1). Its blocks go to its shards the same way, by shard size. In
a shard, documents lie on a line in a seeded order; whole passes over it are taken while
the quota lasts, and the blocks left over are the run that begins at a seeded block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import n_words
from quire.session import written

#: Words in a block: the step of every quota.
BLOCK = 16
#: Words in a shard, about; it bounds the rows that one task orders.
SHARD_WORDS = 1 << 20
#: Share that a source's place in code point order gives it.
WEIGHTS = (5, 2, 1)
#: Times a source may be repeated.
MOST = 3


def seeded(*parts: Column) -> Column:
    """28 bits from a text, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 7), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Each source's words, weight and target, from one row (source, source_size) per source.

    Weighted shares of all words stop at MOST times a source's words, and what is above is
    shared out again by weight until none is above: sources in order of MOST * size / weight
    are full as long as the level of those not yet full reaches theirs.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(k)) + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (rows.withColumn("total", F.sum("source_size").over(everyone)).withColumn("weights", F.sum("weight").over(everyone))
            .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("left_weight", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    full = F.col("cap") * F.col("left_weight") < F.col("weight") * F.col("left_words")
    rows = rows.withColumn("full", full)
    level_words = F.max(F.when(~F.col("full"), F.col("left_words"))).over(everyone)
    level_weight = F.max(F.when(~F.col("full"), F.col("left_weight"))).over(everyone)
    share = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("weight") * level_words).cast("double") / level_weight)
    return rows.withColumn("target", F.coalesce(share, F.lit(0.0))).select("source", "source_size", "weight", "total", "target")


def apportion(rows: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """Integer ``quota`` of each row: its group's ``seats`` by highest quotients votes / (2 s + 1).

    Rounding votes * seats / all gives all but a few seats; these go to the highest quotients
    next in line, or come from the lowest held. A row can gain or lose no more than its share
    of the difference and of the roundings, so only that many quotients per row are listed.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    rows = rows.withColumn("q_all", F.sum(F.col(votes).cast("double")).over(w)).withColumn("q_n", F.count("*").over(w))
    rows = rows.withColumn("q_part", F.when(F.col("q_all") > 0, F.col(votes) / F.col("q_all")).otherwise(0.0))
    rows = rows.withColumn("q_base", F.floor(F.col("q_part") * F.col(seats) + 0.5).cast("long"))
    rows = rows.withColumn("q_diff", F.when(F.col("q_all") > 0, F.col(seats) - F.sum("q_base").over(w)).otherwise(0))
    steps = F.sequence(F.lit(1), F.ceil(F.col("q_part") * (F.abs("q_diff") + F.col("q_n"))).cast("int") + 2)
    held = F.col("q_base") + F.when(F.col("q_diff") > 0, F.col("q_step") - 1).otherwise(-F.col("q_step"))
    moved = rows.filter("q_diff != 0").withColumn("q_step", F.explode(steps)).withColumn("q_held", held).filter("q_held >= 0")
    quotient = F.col(votes) / (2 * F.col("q_held") + 1)
    up, down = F.col("q_diff") > 0, F.col("q_diff") < 0
    order = [F.when(up, -quotient).otherwise(quotient), *[F.col(k).asc_nulls_last() for k in key], "q_step"]
    moved = moved.withColumn("q_rank", F.row_number().over(w.orderBy(*order))).filter(F.col("q_rank") <= F.abs("q_diff"))
    change = moved.groupBy(*group, *key).agg(F.sum(F.when(down, -1).otherwise(1)).alias("q_change"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in group + key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = rows.alias("r").join(change.alias("c"), on, "left")
    kept = [F.col(f"r.{c}") for c in rows.columns if not c.startswith("q_")]
    return joined.select(*kept, (F.col("q_base") + F.coalesce("q_change", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(q_row, doc_id, size, source, source_size, target, taken) for every row of ``docs`` (doc_id, source, text).

    ``taken`` is how many of its words the mix takes, repeats counted: at most MOST times its
    size. A document without words has size 0 and is never taken. Rows that repeat an id lie
    side by side and are mixed as rows of their own. Sources are compared by code point, null
    last, and null is a source like any other. An empty table gives an empty result; a mix
    without words has targets of 0.
    """
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source).withColumn("seats", F.round(F.col("total") / BLOCK).cast("long"))
    goal = apportion(goal, [], ["source"], "target", "seats").withColumnRenamed("quota", "source_blocks")
    goal = goal.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("long"))
    goal = written(goal.select(F.col("source").alias("g_source"), "source_size", "target", "source_blocks", "shards"), "targets")
    order = seeded(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    placed = (sizes.join(goal, sizes["source"].eqNullSafe(goal["g_source"]))
              .withColumn("order", order).withColumn("shard", F.pmod(seeded(F.lit(seed + 1), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "shards")))
    placed = written(placed.drop("g_source", "shards"), "placed")
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    shards = apportion(shards, ["source"], ["shard"], "shard_size", "source_blocks")
    start = F.pmod(seeded(F.lit(seed + 2), F.coalesce("source", F.lit("")), F.col("shard")), F.greatest(F.lit(1), F.ceil(F.col("shard_size") / BLOCK))) * BLOCK
    shards = shards.select(F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "shard_size", F.least(F.col("quota") * BLOCK, F.col("shard_size") * MOST).alias("words"), start.alias("start"))
    w = Window.partitionBy("source", "shard").orderBy("order", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = placed.withColumn("until", F.sum("size").over(w)).withColumn("since", F.col("until") - F.col("size"))
    laid = laid.join(shards, laid["source"].eqNullSafe(shards["s_source"]) & (laid["shard"] == shards["s_shard"]))
    length = F.greatest(F.col("shard_size"), F.lit(1))
    rest, end = F.pmod(F.col("words"), length), F.col("start") + F.pmod(F.col("words"), length)
    first = F.greatest(F.lit(0), F.least("until", end) - F.greatest("since", "start"))
    wrapped = F.greatest(F.lit(0), F.least(F.col("until"), end - F.col("shard_size")) - F.col("since"))
    taken = F.floor(F.col("words") / length).cast("long") * F.col("size") + F.when(rest > 0, first + wrapped).otherwise(0)
    return laid.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def repeat_to_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents of the mix, each as often as it is taken (words taken / size, rounded), with the input's columns."""
    times = mix(docs, seed).filter("taken > 0").withColumn("q_times", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).filter("q_times > 0")
    times = times.groupBy("doc_id").agg(F.sum("q_times").cast("int").alias("q_times"), F.count("*").alias("q_rows"))
    times = times.select(F.col("doc_id").alias("q_id"), F.ceil(F.col("q_times") / F.col("q_rows")).cast("int").alias("q_times"))
    found = docs.join(times, F.col("doc_id").eqNullSafe(F.col("q_id")))
    return found.withColumn("q_copy", F.explode(F.sequence(F.lit(1), F.col("q_times")))).select(*docs.columns)
