"""What a bit-plane coder with contexts would spend, and rate-distortion curves and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.functions.scalars import clip_round, dequantize, psnr, quantize
from rippleframe.operators.contexts import AROUND, neighbours, refine_classes, sign_classes, zero_classes
from rippleframe.operators.entropy import conditional_entropy
from rippleframe.operators.lifting import pyramid, restored

KINDS = ("significance", "sign", "refinement")


def plane_events(coeffs: DataFrame, keys: list[str], planes: int, parents: DataFrame | None = None, band: str = "band") -> DataFrame:
    """(coeffs' columns, plane, kind, class, sym): every bit that the planes planes-1 .. 0 code, with the class of its context.

    coeffs (keys, y, x, q), keys naming one band of one frame; parents (keys, y,
    x, q) is the same band a level up. A coefficient that is not yet significant
    codes a significance bit and, when it becomes so, whether its sign is the
    predicted one; one that is codes a refinement bit. Neighbours count by the
    plane above, the parent by the plane itself, which are coded before. One
    shuffle by keys finds all neighbours; the planes are rows made from them.
    """
    rows = neighbours(coeffs, keys)
    if parents is None:
        rows = rows.withColumn("_pq", F.lit(0))
    else:
        up = parents.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("q").alias("_pq"))
        rows = rows.withColumn("_y", F.expr("y div 2").cast("int")).withColumn("_x", F.expr("x div 2").cast("int")).join(up, [*keys, "_y", "_x"], "left").drop("_y", "_x").withColumn("_pq", F.coalesce("_pq", F.lit(0)))
    rows = rows.withColumn("plane", F.explode(F.sequence(F.lit(planes - 1), F.lit(0), F.lit(-1))))
    level = lambda c, up: F.expr(f"shiftright(cast(abs({c}) as int), plane + {up})")
    seen = lambda name, up: (level(f"n_{name}", up) > 0).cast("int")
    total = lambda names, up: sum((seen(n, up) for n in names[1:]), seen(names[0], up))
    h, v, d = (total(n, 1) for n in (("l", "r"), ("t", "b"), ("tl", "tr", "bl", "br")))
    signs = {n: seen(n, 1) * F.signum(F.col(f"n_{n}").cast("double")).cast("int") for n in AROUND}
    here, above, own = level("q", 0), level("q", 1), F.col(band)
    joint = zero_classes(h, v, d, (level("_pq", 0) > 0).cast("int"), own)[1]
    refine = refine_classes(h, v, total(("l", "r"), 2), total(("t", "b"), 2), own)[0]
    sign_class, flip = sign_classes(signs, own)
    event = lambda kind, klass, sym: F.struct(F.lit(kind).alias("kind"), klass.cast("int").alias("class"), sym.cast("int").alias("sym"))
    fresh = (above == 0) & (here > 0)
    agrees = flip == (F.col("q") < 0).cast("int")
    coded = F.array(F.when(above == 0, event(KINDS[0], joint, here > 0)).otherwise(event(KINDS[2], refine, here % 2)), F.when(fresh, event(KINDS[1], sign_class, agrees)))
    names = [c for c in coeffs.columns]
    return rows.select(*names, "plane", F.explode(F.filter(coded, lambda e: e.isNotNull())).alias("_e")).select(*names, "plane", "_e.kind", "_e.class", "_e.sym")


def coder_bits(events: DataFrame, group: list[str], context: list[str]) -> DataFrame:
    """(group, plane, kind, n, bits): -log2 of each bit's share in its context (class and the columns of context)."""
    return conditional_entropy(events, [*group, "plane", "kind"], [*[c for c in context if c not in group], "class"])


def plane_distortion(coeffs: DataFrame, group: list[str], planes: int, step: float) -> DataFrame:
    """(group, plane, mse) of coeffs (c, q) known down to each plane, `planes` standing for nothing known; the middle of what is left is taken."""
    rows = coeffs.withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(planes))))
    known = F.expr("shiftright(cast(abs(q) as int), plane)")
    value = F.when(known == 0, F.lit(0.0)).otherwise(F.signum(F.col("q").cast("double")) * (known + 0.5) * F.pow(F.lit(2.0), F.col("plane")) * step)
    return rows.groupBy(*group, "plane").agg(F.avg((F.col("c") - value) * (F.col("c") - value)).alias("mse"))


def coded_rd_curve(coeffs: DataFrame, keys: list[str], group: list[str], planes: int, step: float, parents: DataFrame | None = None, band: str = "band") -> DataFrame:
    """(group, plane, significance, sign, refinement, bits, total, mse, gain, slope), the highest plane first.

    The three kinds' bits of a plane, their sum and its running total, the error
    once the plane is known, how much the plane took off it, and that a bit.
    """
    spent = coder_bits(plane_events(coeffs, keys, planes, parents, band), group, [band])
    kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("bits"))), F.lit(0.0)).alias(k)
    spent = spent.groupBy(*group, "plane").agg(*map(kind, KINDS))
    error = plane_distortion(coeffs, group, planes, step)
    down = Window.partitionBy(*group).orderBy(F.desc("plane"))
    error = error.withColumn("gain", F.lag("mse").over(down) - F.col("mse"))
    bits: Column = F.col(KINDS[0]) + F.col(KINDS[1]) + F.col(KINDS[2])
    out = spent.withColumn("bits", bits).withColumn("total", F.sum("bits").over(down.rowsBetween(Window.unboundedPreceding, 0))).join(error, [*group, "plane"])
    return out.withColumn("slope", F.when(F.col("bits") > 1e-9, F.col("gain") / F.col("bits")))


def sample_rd_sweep(samples: DataFrame, keys: list[str], channel: str, steps: list[float], discards: list[int], levels: int = 4, peak: float = 255) -> DataFrame:
    """(channel, step, discard, gid, bits, frames, psnr) on the grid of steps, discarded bands and channels, and totals over any of them.

    samples (keys, y, x, v), keys naming a frame of a channel. A grid point is a
    column: a coefficient's row carries its values at all of them, and its own
    sample, through one inverse pyramid, where they were put by the first
    shuffle. Symbols are counted by step; what a discard drops becomes zeros of
    the counts. bits are those of the symbols in their level and band; psnr is
    the mean over frames of what comes back, rounded and cut to 0..peak; frames
    counts those with an error. In totals (gid by grouping_id) bits add up and
    psnr is the mean over all frames.
    """
    point = [channel, "step", "discard"]
    rank = F.when(F.col("band") == "LL", 13).otherwise(3 * F.col("level") + F.when(F.col("band") == "HL", 3).when(F.col("band") == "LH", 2).otherwise(1))
    rows = pyramid(samples.withColumn("_v", F.col("v")), keys, levels, ["_v"])
    symbol = lambda step: quantize(F.round("c", 9), step).cast("bigint")
    counts = rows.withColumn("step", F.explode(F.array(*map(F.lit, steps)))).groupBy(channel, "step", "level", "band", symbol(F.col("step")).alias("sym")).agg(F.count("*").alias("c"))
    counts = counts.withColumn("discard", F.explode(F.array(*map(F.lit, discards)))).withColumn("sym", F.when(F.col("discard") < rank, F.col("sym")).otherwise(F.lit(0)))
    counts = counts.groupBy(*point, "level", "band", "sym").agg(F.sum("c").alias("c"))
    sums = counts.groupBy(*point, "level", "band").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    bits = sums.groupBy(*point).agg(F.sum(F.col("n") * F.log2("n") - F.col("s")).alias("bits"))
    grid = {f"_c{k}": (step, discard) for k, (step, discard) in enumerate((s, d) for s in steps for d in discards)}
    known = {c: F.when(F.lit(discard) < rank, dequantize(symbol(F.lit(step)).cast("double"), step)).otherwise(F.lit(0.0)) for c, (step, discard) in grid.items()}
    back = restored(rows.select(*keys, "level", "band", "y", "x", "_v", *[v.alias(c) for c, v in known.items()]), keys, levels, list(grid))
    off = lambda c: clip_round(F.col(c), 0, peak) - F.col("_v")
    each = back.groupBy(*keys).agg(*[F.avg(off(c) * off(c)).alias(c) for c in grid])
    each = each.select(channel, F.inline(F.array(*[F.struct(F.lit(step).alias("step"), F.lit(discard).alias("discard"), F.col(c).alias("mse")) for c, (step, discard) in grid.items()])))
    seen = each.withColumn("psnr", psnr(F.col("mse"), peak)).groupBy(*point).agg(F.count("psnr").alias("frames"), F.sum("psnr").alias("_sum"))
    out = bits.join(seen, point).cube(*point).agg(F.grouping_id().alias("gid"), F.sum("bits").alias("bits"), F.sum("frames").alias("frames"), F.sum("_sum").alias("_sum"))
    return out.withColumn("psnr", F.when(F.col("frames") > 0, F.col("_sum") / F.col("frames"))).drop("_sum")
