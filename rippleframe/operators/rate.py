"""Rate bookkeeping: ledgers, motion bytes, budgets, truncation, offsets, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE = 0.55


def bit_ledger(bits: DataFrame, keys: list[str], value: str = "bits") -> DataFrame:
    """(keys, level_of_total, bits): totals of every prefix of keys, grouping_id telling which."""
    return bits.rollup(*keys).agg(F.grouping_id().alias("gid"), F.sum(value).alias("bits"))


def epoch_metrics(steps: DataFrame) -> DataFrame:
    """(epoch, phase, pos, loss, psnr, bpp): means by epoch and phase, and by position within them; pos NULL is the whole."""
    mean = lambda *k: steps.groupBy(*k).agg(*[F.avg(c).alias(c) for c in ("loss", "psnr", "bpp")])
    return mean("epoch", "phase", "pos").unionByName(mean("epoch", "phase").withColumn("pos", F.lit(None).cast("int")))


def motion_bytes(mv_bytes: DataFrame, level: int) -> DataFrame:
    """(gop, used, existing): bytes of the levels kept, and of all."""
    return mv_bytes.groupBy("gop").agg(F.sum(F.when(F.col("level") >= level, F.col("bytes")).otherwise(0)).alias("used"), F.sum("bytes").alias("existing"))


def bits_per_sample(bits: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip, plane, bits, samples, per_sample): planes, their clip (plane NULL) and everything (clip NULL).

    bits (clip, plane, bits); clips (clip, start, last, ywidth, yheight, cwidth, cheight) say how many samples a plane has.
    """
    sums = bits.groupBy("clip", "plane").agg(F.sum("bits").alias("bits")).join(clips, "clip")
    frames = F.col("last") - F.col("start") + 1
    area = F.when(F.col("plane") == "y", F.col("ywidth") * F.col("yheight")).otherwise(F.col("cwidth") * F.col("cheight"))
    out = sums.withColumn("samples", frames.cast("bigint") * area).rollup("clip", "plane").agg(F.sum("bits").alias("bits"), F.sum("samples").alias("samples"))
    return out.withColumn("per_sample", F.when(F.col("samples") > 0, F.col("bits") / F.col("samples")))


def position_bytes(bits: DataFrame) -> DataFrame:
    """(clip, position, tband, idx, bytes): bytes of each coded frame over all planes, frames by band and place, and their sum (position NULL)."""
    each = bits.groupBy("clip", "tband", "idx").agg((F.sum("bits") / 8).alias("bytes"))
    order = Window.partitionBy("clip").orderBy("tband", "idx")
    rows = each.select("clip", (F.row_number().over(order) - 1).alias("position"), "tband", "idx", "bytes")
    total = bits.groupBy("clip").agg((F.sum("bits") / 8).alias("bytes"))
    return rows.unionByName(total, allowMissingColumns=True)


def motion_drop_order(mv_bytes: DataFrame, clips: DataFrame, t_level: int = 0, share: float = SHARE) -> DataFrame:
    """(clip, level, step, size, budget, left_before, dropped): the steps of a clip's motion in the order in which they go.

    mv_bytes (clip, gop, level, part, sub_bit, bytes), clips (clip, start, last,
    framerate, bitrate in kbit/s). A step is one sub-symbol of a level over all
    GOPs of the clip; a level's sign bytes belong to its last step. The lowest
    level from t_level up goes first and of it the last sub-symbol, while the
    motion that is left takes more than share of the clip's bytes. Sign bytes
    of a level without sub-symbols count nowhere (left_before NULL, dropped).
    A clip that clips does not list keeps all.
    """
    unit = ["clip", "level", "step"]
    rows = mv_bytes.filter(F.col("level") >= t_level).withColumn("step", _step())
    sizes = rows.groupBy(*unit).agg(F.sum("bytes").alias("size"), F.max((F.col("part") == "sub").cast("int")).alias("_sub"))
    level, clip = Window.partitionBy("clip", "level"), Window.partitionBy("clip")
    counts = F.col("step").isNull() | (F.max("_sub").over(level) == 1)
    sizes = sizes.withColumn("_counts", counts).withColumn("_total", F.sum(F.when(F.col("_counts"), F.col("size"))).over(clip))
    budget = F.col("bitrate") * 1000 / 8 * (F.col("last") - F.col("start") + 1) / F.col("framerate")
    steps = sizes.filter("step is not null").join(clips.select("clip", budget.alias("budget")), "clip", "left")
    ahead = clip.orderBy("level", F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_total") - F.coalesce(F.sum(F.when(F.col("_counts"), F.col("size"))).over(ahead), F.lit(0))
    steps = steps.withColumn("left_before", F.when(F.col("_counts"), left))
    dropped = ~F.col("_counts") | F.coalesce(F.col("left_before") > share * F.col("budget"), F.lit(False))
    return steps.select(*unit, "size", "budget", "left_before", dropped.alias("dropped"))


def _step() -> Column:
    return F.when(F.col("part") == "sub", F.col("sub_bit")).when(F.col("part") == "sign", F.lit(0))


def motion_budget_prune(mv_bytes: DataFrame, clips: DataFrame, t_level: int = 0, share: float = SHARE) -> DataFrame:
    """Rows of mv_bytes from t_level up that stay within share of their clip's budget, by motion_drop_order()."""
    gone = motion_drop_order(mv_bytes, clips, t_level, share).filter("dropped").select("clip", "level", "step")
    rows = mv_bytes.filter(F.col("level") >= t_level).withColumn("step", _step())
    return rows.join(gone, ["clip", "level", "step"], "left_anti").drop("step")


def truncate_streams(substreams: DataFrame) -> DataFrame:
    """substreams with size = least(alloc, avail) and header: none for 0, else 2 or 4 bytes."""
    size = F.least("alloc", "avail")
    return substreams.withColumn("size", size).withColumn("header", F.when(size == 0, 0).when(size < (1 << 15), 2).otherwise(4))


def stream_offsets(sizes: DataFrame, mv_bytes: DataFrame) -> DataFrame:
    """(gop, bytes, start) of truncated sizes: 4 + n for each motion set, after a flag bit for each GOP rounded up to bytes."""
    motion = mv_bytes.groupBy("gop").agg(F.sum(F.col("bytes") + 4).alias("m"))
    streams = sizes.groupBy("gop").agg(F.sum(F.col("size") + F.col("header")).alias("s"))
    both = streams.join(motion, "gop", "full").withColumn("bytes", F.coalesce("m", F.lit(0)) + F.coalesce("s", F.lit(0)))
    flags = both.agg(F.ceil(F.count("*") / 8).alias("flags"))
    # the running sum over all GOPs in two steps: inside blocks of GOPs, then over the blocks' totals
    both = both.withColumn("block", F.expr("gop div 1024"))
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("block").orderBy("gop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = both.groupBy("block").agg(F.sum("bytes").alias("t"))
    ahead = totals.withColumn("ahead", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    out = both.withColumn("inside", inside).join(ahead, "block").join(F.broadcast(flags))  # flags is one row
    return out.select("gop", "bytes", (F.col("flags") + F.col("ahead") + F.col("inside")).alias("start"))


def allocation_report(sizes: DataFrame, mv_bytes: DataFrame) -> DataFrame:
    """(gop, item, bytes): headers, motion and subbands of each GOP, its total (item NULL) and the grand total."""
    parts = sizes.select("gop", F.lit("header").alias("item"), F.col("header").cast("bigint").alias("bytes")).unionByName(sizes.select("gop", F.concat(F.lit("band"), F.col("band").cast("string")).alias("item"), F.col("size").alias("bytes"))).unionByName(mv_bytes.select("gop", F.lit("motion").alias("item"), "bytes"))
    return parts.rollup("gop", "item").agg(F.sum("bytes").alias("bytes"))


def validate_targets(targets: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip, name, reason): targets below the source's levels, at or above its rate, or for an unknown clip."""
    both = targets.join(clips.select("clip", "t_levels", F.col("bitrate").alias("source_rate")), "clip", "left")
    reason = F.when(F.col("t_levels").isNull(), "unknown clip").when(F.col("t_level") > F.col("t_levels"), "level").when(F.col("rate") >= F.col("source_rate"), "rate")
    return both.withColumn("reason", reason).filter("reason is not null").select("clip", "name", "reason")
