"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Every document gets a rate between 0 and 2, the exponential tilt 2 / (1 + exp(-tilt * size / mean size)) of a flat
rate of 1; the tilt of a source is where the convex dual of its token constraint is smallest, found by Newton steps
that are one aggregation each, over counts by source and size. Rates become copies by systematic rounding along
sizes, and a few rounds of the largest size that still fits close what is left of each source's target.

Defined cases: a null text has size 0; null is a source of its own, last in order; documents of size 0 get
a copy each and count for nothing; a source without words has target 0; repeated rows count each on their own; an empty table gives an empty
result; reruns agree, since order comes from hashes of doc_id and text alone.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segloom.llm.tables import aside, restored, settle

#: What the sources weigh, in order and repeating; their share of all sizes; the most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Rows of one source and size beyond which they are dealt into parts, and the most such groups there can be.
GROUP_ROWS, GROUPS = 500, 20000
NEWTON_STEPS, CLOSING_ROUNDS = 24, 6


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets_of(sizes: DataFrame) -> DataFrame:
    """skey, source_size, docs, target: one row for each source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    per = sizes.groupBy("skey", "source").agg(F.sum("source_size").alias("source_size"), F.sum("docs").alias("docs"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST))
    # Targets are min(cap, level * weight): with sources in the order of cap / weight, the capped ones come first.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    all_of = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = filling.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(all_of) * SHARE)
    left = F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    shares = F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    per = per.withColumn("level", left / shares).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("skey"), F.col("level")))).over(all_of)["level"]
    return per.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("skey", "source_size", "docs", "target")


def _rate(tilt: Column, x: Column) -> Column:
    return F.lit(float(MOST)) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), tilt * x))))


def tilts(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """The tilt of each source that has words and a target below its cap."""
    state = targets.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(MOST))).select(
        "skey", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(1.0).alias("off")
    )
    for step in range(NEWTON_STEPS):
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("tilt"), x)
        sums = (
            cells.join(state, "skey")
            .groupBy("skey", "target", "mean", "tilt", "low", "high")
            .agg((F.sum(F.col("n") * F.col("size") * rate) - F.col("target")).alias("over"), F.sum(F.col("n") * F.col("size") * x * rate * (1 - rate / MOST)).alias("slope"))
        )
        low = F.when(F.col("over") < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("over") > 0, F.col("tilt")).otherwise(F.col("high"))
        move = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), F.coalesce(F.try_divide(F.col("over"), F.col("slope")), F.signum("over") * 4)))
        newton = F.col("tilt") - move
        state = sums.select(
            "skey", "target", "mean", F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2).alias("tilt"), low.alias("low"), high.alias("high"),
            F.abs(F.col("over") / F.col("target")).alias("off"),
        )
        if step % 4 == 3:
            state = settle(state, 1)
            off = state.agg(F.max("off")).first()[0] or 0.0
            if off < 1e-10:
                break
    else:
        if off > 1e-6:
            warnings.warn(f"a source's tilted rates miss its target by {off:.2g} of it after {NEWTON_STEPS} steps; closing rounds follow", stacklevel=2)
    return state.select("skey", "mean", F.round("tilt", 9).alias("tilt"))


def _close(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Add or take copies of the largest size that still fits, until little of each target is left."""
    for _ in range(CLOSING_ROUNDS):
        left = cells.groupBy("skey").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(targets, "skey").select("skey", (F.round("target").cast("long") - F.col("taken")).alias("left"))
        room = F.when(F.col("left") > 0, F.col("n") * MOST - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("left")) & (room > 0)
        change = (
            cells.join(left, "skey").where(fits)
            .groupBy("skey")
            .agg(F.max(F.struct("size", F.col("salt").alias("salt"), F.least(room, F.expr("abs(left) div size")).alias("by"), F.signum("left").cast("long").alias("sign"))).alias("m"))
            .select("skey", F.col("m.size").alias("size"), F.col("m.salt").alias("salt"), (F.col("m.by") * F.col("m.sign")).alias("change"))
        )
        cells = settle(cells.join(change, ["skey", "size", "salt"], "left").select("skey", "size", "salt", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")), 8)
    return cells


def mix(docs: DataFrame) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies beside their columns."""
    columns = docs.columns
    docs, names = aside(docs, ("doc_id", "text", "source"))
    base = docs.withColumns(
        {
            "mix_size": words_in(F.col("text")),
            "mix_key": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")),
            "mix_hash": F.xxhash64("doc_id", "text"),
        }
    )
    counted = settle(
        base.groupBy(F.col("mix_key").alias("skey"), F.col("source").alias("source"), F.col("mix_size").alias("size"), F.pmod("mix_hash", F.lit(1024)).alias("bucket")).agg(F.count("*").alias("n"))
    )
    whole = counted.groupBy("skey", "source", "size").agg(F.sum("n").alias("n"))
    targets = settle(targets_of(whole.select("skey", "source", (F.col("n") * F.col("size")).alias("source_size"), F.col("n").alias("docs"))), 1)
    rows = targets.agg(F.sum("docs")).first()[0] or 0
    most = max(GROUP_ROWS, rows // GROUPS)
    # At most GROUPS rows, so their broadcast is bounded.
    hot = whole.where(F.col("n") > most).select("skey", "size", F.least(F.lit(1024), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / most)))).cast("int").alias("parts"))
    hot = settle(hot, 1)
    salted = counted.join(F.broadcast(hot), ["skey", "size"], "left").withColumn("salt", F.pmod("bucket", F.coalesce("parts", F.lit(1))).cast("int"))
    cells = settle(salted.groupBy("skey", "size", "salt").agg(F.sum("n").alias("n")))

    tilt = tilts(cells.groupBy("skey", "size").agg(F.sum("n").alias("n")), targets)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0)).when(F.col("tilt").isNull(), F.lit(float(MOST))).otherwise(_rate(F.col("tilt"), F.col("size") / F.col("mean")))
    along = Window.partitionBy("skey").orderBy(F.col("size").desc(), "salt").rowsBetween(Window.unboundedPreceding, 0)
    rounded = (
        cells.join(targets, "skey").join(tilt, "skey", "left")
        .withColumn("millionths", F.round(F.col("n") * rate * 1e6).cast("long"))
        .withColumn("part", F.pmod("millionths", F.lit(1_000_000)))
        .withColumn("upto", F.sum("part").over(along) + 500_000)
        .withColumn("copies", F.expr("millionths div 1000000 + upto div 1000000 - (upto - part) div 1000000"))
        .select("skey", "size", "salt", "n", F.least(F.col("copies"), F.col("n") * MOST).alias("copies"))
    )
    final = _close(settle(rounded, 8), targets).join(targets, "skey")
    final = final.select(F.col("skey").alias("mix_key"), F.col("size").alias("mix_size"), F.col("salt").alias("mix_salt"), F.col("n").alias("mix_n"), F.col("copies").alias("mix_all"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    hot = hot.select(F.col("skey").alias("mix_key"), F.col("size").alias("mix_size"), F.col("parts").alias("mix_parts"))
    within = Window.partitionBy("mix_key", "mix_size", "mix_salt").orderBy("mix_hash", "doc_id")
    out = (
        base.join(F.broadcast(hot), ["mix_key", "mix_size"], "left")
        .withColumn("mix_salt", F.pmod(F.pmod("mix_hash", F.lit(1024)), F.coalesce("mix_parts", F.lit(1))).cast("int"))
        .withColumn("mix_rank", F.row_number().over(within))
        .join(final, ["mix_key", "mix_size", "mix_salt"])
        .withColumn("mix_copies", F.expr("cast(mix_all div mix_n + if(mix_rank <= mix_all % mix_n, 1, 0) as int)"))
    )
    return restored(out, columns, names, "mix_size", "mix_source_size", "mix_target", "mix_copies")


def repeated(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it, and their columns only."""
    columns = docs.columns
    docs, names = aside(docs, ("doc_id", "text", "source"))
    return restored(mix(docs).where("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), "mix_copies"))), columns, names)
