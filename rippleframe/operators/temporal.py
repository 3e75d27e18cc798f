"""Temporal lifting over frames and GOP bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rippleframe.functions.scalars import ALPHA, BETA, copy_weight
from rippleframe.operators.filters import phases_in_place
from rippleframe.operators.motion import blended, fourfold

POINT = ["y", "x"]


def _predicted(odd: Column, w: WindowSpec) -> Column:
    """v of odd frames minus the mean of their neighbours, times alpha; a missing right neighbour is the left one."""
    left, right = F.lag("v").over(w), F.coalesce(F.lead("v").over(w), F.lag("v").over(w))
    return F.when(odd, (F.col("v") - (left + right) / 2) * ALPHA).otherwise(F.col("v"))


def _updates(w: WindowSpec) -> Column:
    """What an even frame gets from its high neighbours; a missing one is the other, without any it is 0."""
    right = F.coalesce(F.lead("v").over(w), F.lag("v").over(w))
    return F.coalesce(F.coalesce(F.lag("v").over(w), right) + right, F.lit(0.0)) / 4 / ALPHA


def t_predict(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, h): odd frames minus the mean of their neighbours, times alpha; a missing right neighbour is the left one."""
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = frames.withColumn("h", _predicted(F.col("frame") % 2 == 1, w))
    return rows.filter("frame % 2 = 1").select(*keys, F.expr("frame div 2").cast("int").alias("i"), "h")


def t_update(frames: DataFrame, high: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, l): even frames plus a quarter of the neighbouring h over alpha, times beta; the left h of frame 0 is its own."""
    even = frames.filter("frame % 2 = 0").select(*keys, "frame", "v")
    rows = even.unionByName(high.select(*keys, (2 * F.col("i") + 1).alias("frame"), F.col("h").alias("v")))
    rows = rows.withColumn("l", (F.col("v") + _updates(Window.partitionBy(*keys).orderBy("frame"))) * BETA)
    return rows.filter("frame % 2 = 0").select(*keys, F.expr("frame div 2").cast("int").alias("i"), "l")


def t_pyramid(frames: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """(keys, tband, idx, v): H1 .. Hn and Ln, across GOP borders.

    One scan and one shuffle for all levels: rows of bands that are done stay in
    the same table, told apart by tband, and the windows go by (keys, tband).
    """
    rows = frames.select(*keys, F.lit(None).cast("string").alias("tband"), F.col("frame").cast("int").alias("frame"), "v").repartition(*keys)
    w, going, odd = Window.partitionBy(*keys, "tband").orderBy("frame"), F.col("tband").isNull(), F.col("frame") % 2 == 1
    for level in range(1, levels + 1):
        rows = rows.withColumn("v", _predicted(going & odd, w))
        rows = rows.withColumn("v", F.when(going & ~odd, (F.col("v") + _updates(w)) * BETA).otherwise(F.col("v")))
        rows = rows.withColumns({"tband": F.when(going & odd, f"H{level}").otherwise(F.col("tband")), "frame": F.when(going, F.expr("frame div 2").cast("int")).otherwise(F.col("frame"))})
    return rows.select(*keys, F.coalesce("tband", F.lit(f"L{levels}")).alias("tband"), F.col("frame").alias("idx"), "v")


def t_unpyramid(bands: DataFrame, keys: list[str], levels: int = 3) -> DataFrame:
    """(keys, frame, v) of t_pyramid: updates are undone first, then predictions, in one table as there."""
    wanted = [f"L{levels}", *(f"H{k}" for k in range(1, levels + 1))]
    rows = bands.filter(F.col("tband").isin(wanted)).select(*keys, F.when(F.col("tband") != wanted[0], F.col("tband")).alias("tband"), F.col("idx").cast("int").alias("frame"), "v").repartition(*keys)
    w, going, odd = Window.partitionBy(*keys, "tband").orderBy("frame"), F.col("tband").isNull(), F.col("frame") % 2 == 1
    for level in range(levels, 0, -1):
        high = F.col("tband") == f"H{level}"
        rows = rows.withColumns({"frame": F.when(going, 2 * F.col("frame")).when(high, 2 * F.col("frame") + 1).otherwise(F.col("frame")), "tband": F.when(~high, F.col("tband"))})
        rows = rows.withColumn("v", F.when(going & ~odd, F.col("v") / BETA - _updates(w)).otherwise(F.col("v")))
        left, right = F.lag("v").over(w), F.coalesce(F.lead("v").over(w), F.lag("v").over(w))
        rows = rows.withColumn("v", F.when(going & odd, F.col("v") / ALPHA + (left + right) / 2).otherwise(F.col("v")))
    return rows.select(*keys, "frame", "v")


def scene_cut_fallback(bands: DataFrame, frames: DataFrame, masks: DataFrame, weight: float) -> DataFrame:
    """bands (frame, y, x, v) with the frame's own samples times weight where all of its masks are zero."""
    cut = masks.groupBy("frame").agg((F.max("m") == 0).alias("cut"))
    own = frames.select("frame", *POINT, F.col("v").alias("_own"))
    out = bands.join(cut, "frame", "left").join(own, ["frame", *POINT])
    return out.withColumn("v", F.when(F.col("cut"), F.col("_own") * weight).otherwise(F.col("v"))).select("frame", *POINT, "v")


def scene_cut_restore(frames: DataFrame, bands: DataFrame, masks: DataFrame, weight: float) -> DataFrame:
    """The way back: frames (frame, y, x, v) with the band's own samples over weight where all masks of a frame are zero."""
    return scene_cut_fallback(frames, bands, masks, 1 / weight)


# ---- along motion: keys name the clip; motion is (keys, level, frame, y, x, side, mvx, mvy, m), frames counted within their level;
# vectors of odd frames predict, those of even frames update (with the sign turned). A frame whose
# masks are all zero is a scene cut: it is copied times its level's weight. A side without
# a frame counts as masked, so the other side stands in for it. Where the source frame lacks the sample that a
# vector points at, the point drops out of the high frame and has no update; with `whole` such a side counts as
# masked too (without any the prediction is 0), so that the way back, with the same setting, restores every sample.


def _along(own: DataFrame, source: DataFrame, motion: DataFrame, keys: list[str], height: int, width: int, whole: bool = False) -> DataFrame:
    """own (keys, frame, y, x, v) with p, the blended prediction from source (keys, at, y, x, v) by motion with the place `at` of each side, cut, and seen: whether the point has a prediction (else p and cut are NULL).

    Vectors go to the sample they look at and stay in its row while the phases
    are made, so no array of phases is shuffled or joined. Both sides of a point,
    its own sample and its frame's masks then meet in one aggregate by its frame:
    two shuffles, no join, one scan of each table (two and a join with one row a
    clip without `whole`).
    """
    known = motion.withColumn("_mask", F.col("m"))
    if not whole:  # beyond the last frame of a clip (one row a clip) the last one tells whether there is a sample; with `whole` no sample is a mask anyway
        known = known.join(source.groupBy(*keys).agg(F.max("at").alias("_last")), keys)
        known = known.withColumn("m", F.when(F.col("at") > F.col("_last"), 0).otherwise(F.col("m"))).withColumn("at", F.least("at", "_last")).drop("_last")
    asked = fourfold(known, height, width).withColumn("_ask", F.struct("frame", *POINT, "side", "m", "_mask", "_phase"))
    asked = asked.select(*keys, "at", F.col("_y").alias("y"), F.col("_x").alias("x"), F.lit(None).cast("double").alias("v"), "_ask")
    places = source.select(*keys, "at", *POINT, F.col("v").cast("double").alias("v"), F.lit(None).cast(asked.schema["_ask"].dataType).alias("_ask")).unionByName(asked)
    places = places.repartition(*keys, "at").groupBy(*keys, "at", *POINT).agg(F.max("v").alias("v"), F.collect_list("_ask").alias("_asks"))
    warped = phases_in_place(places, [*keys, "at"], height, width, ["_asks"]).select(*keys, "phases", F.explode("_asks").alias("_ask"))
    warped = warped.select(*keys, "_ask.*", F.col("phases")[F.col("_ask._phase")].alias("v"))
    if whole:
        warped = warped.withColumn("m", F.when(F.col("v").isNull(), 0).otherwise(F.col("m"))).withColumn("v", F.coalesce("v", F.lit(0.0)))
    blank = [F.lit(None).cast("int").alias(c) for c in ("m", "_mask")]
    rows = own.select(*keys, "frame", *POINT, F.lit(-1).alias("side"), "v", *blank).unionByName(warped.select(*keys, "frame", *POINT, "side", "v", "m", "_mask"))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    sides = [of(s, c).alias(f"_{c}{s}") for s in (0, 1) for c in ("v", "m")]
    points = rows.repartition(*keys, "frame").groupBy(*keys, "frame", *POINT).agg(F.max(F.col("side") == -1).alias("_own"), of(-1, "v").alias("v"), *sides, F.max("_mask").alias("_mask"))
    points = points.withColumn("cut", F.max("_mask").over(Window.partitionBy(*keys, "frame")) == 0).filter("_own")
    seen, left, right = F.col("_v0").isNotNull() & F.col("_v1").isNotNull(), F.col("_v0") * F.col("_m0"), F.col("_v1") * F.col("_m1")
    return points.select(*keys, "frame", *POINT, "v", F.when(seen, blended(left, F.col("_m0"), right, F.col("_m1"))).alias("p"), F.when(seen, F.col("cut")).alias("cut"), seen.alias("seen"))


def _motion_of(motion: DataFrame, keys: list[str], odd: bool) -> DataFrame:
    """Vectors of the odd (or, turned, even) frames with the place of the frame, or high frame, that each side looks at."""
    turn = 1 if odd else -1
    at = F.expr("frame div 2") + F.col("side") - (0 if odd else 1)  # even frame or high frame number
    rows = motion.filter(F.col("frame") % 2 == int(odd))
    return rows.select(*keys, "frame", *POINT, "side", (turn * F.col("mvx")).alias("mvx"), (turn * F.col("mvy")).alias("mvy"), "m", F.greatest(at, F.lit(0)).cast("int").alias("at"))


def t_predict_along(frames: DataFrame, motion: DataFrame, keys: list[str], height: int, width: int, level: int = 1, whole: bool = False) -> DataFrame:
    """(keys, i, y, x, h): odd frames minus the blend of both neighbours along motion, times alpha."""
    even = frames.filter("frame % 2 = 0").withColumn("at", F.expr("frame div 2").cast("int"))
    own = _along(frames.filter("frame % 2 = 1"), even, _motion_of(motion, keys, True), keys, height, width, whole)
    h = F.when(F.col("cut"), copy_weight("H", level - 1) * F.col("v")).otherwise(F.col("v") - F.coalesce("p", F.lit(0.0))) * ALPHA
    return (own if whole else own.filter("seen")).select(*keys, F.expr("frame div 2").cast("int").alias("i"), *POINT, h.alias("h"))


def t_update_along(frames: DataFrame, high: DataFrame, motion: DataFrame, keys: list[str], height: int, width: int, level: int = 1, whole: bool = False) -> DataFrame:
    """(keys, i, y, x, l): even frames plus half the blend of the neighbouring h over alpha, times beta."""
    source = high.select(*keys, F.col("i").alias("at"), *POINT, F.col("h").alias("v"))
    own = _along(frames.filter("frame % 2 = 0"), source, _motion_of(motion, keys, False), keys, height, width, whole)
    low = F.when(F.col("cut"), copy_weight("L", level - 1) * F.col("v")).otherwise(F.col("v") + F.coalesce("p", F.lit(0.0)) / 2 / ALPHA) * BETA
    return own.select(*keys, F.expr("frame div 2").cast("int").alias("i"), *POINT, low.alias("l"))


def t_pyramid_along(frames: DataFrame, motion: DataFrame, keys: list[str], height: int, width: int, levels: int = 3, store: Callable[[DataFrame], DataFrame] = lambda df: df, whole: bool = False) -> DataFrame:
    """(keys, tband, idx, y, x, v) like t_pyramid, along motion. `store` writes a level's frames before they are used again."""
    out, rest = None, frames.select(*keys, "frame", *POINT, "v")
    for level in range(1, levels + 1):
        own = motion.filter(F.col("level") == level).drop("level")
        high = store(t_predict_along(rest, own, keys, height, width, level, whole))
        low = store(t_update_along(rest, high, own, keys, height, width, level, whole))
        part = high.select(*keys, F.lit(f"H{level}").alias("tband"), F.col("i").alias("idx"), *POINT, F.col("h").alias("v"))
        out = part if out is None else out.unionByName(part)
        rest = low.select(*keys, F.col("i").alias("frame"), *POINT, F.col("l").alias("v"))
    return out.unionByName(rest.select(*keys, F.lit(f"L{levels}").alias("tband"), F.col("frame").alias("idx"), *POINT, "v"))


def t_unpyramid_along(bands: DataFrame, motion: DataFrame, keys: list[str], height: int, width: int, levels: int = 3, store: Callable[[DataFrame], DataFrame] = lambda df: df, whole: bool = False) -> DataFrame:
    """(keys, frame, y, x, v) of t_pyramid_along: updates are undone first, then predictions; copied frames are divided by their weights."""
    rest = bands.filter(F.col("tband") == f"L{levels}").select(*keys, F.col("idx").alias("i"), *POINT, F.col("v").alias("l"))
    for level in range(levels, 0, -1):
        own = motion.filter(F.col("level") == level).drop("level")
        high = bands.filter(F.col("tband") == f"H{level}").select(*keys, F.col("idx").alias("at"), *POINT, "v")
        both = _along(rest.select(*keys, (2 * F.col("i")).alias("frame"), *POINT, F.col("l").alias("v")), high, _motion_of(own, keys, False), keys, height, width, whole)
        back = F.when(F.col("cut"), F.col("v") / BETA / copy_weight("L", level - 1)).otherwise(F.col("v") / BETA - F.coalesce("p", F.lit(0.0)) / 2 / ALPHA)
        even = store(both.select(*keys, "frame", *POINT, back.alias("v")))
        both = _along(high.select(*keys, (2 * F.col("at") + 1).alias("frame"), *POINT, "v"), even.withColumn("at", F.expr("frame div 2").cast("int")), _motion_of(own, keys, True), keys, height, width, whole)
        back = F.when(F.col("cut"), F.col("v") / ALPHA / copy_weight("H", level - 1)).otherwise(F.col("v") / ALPHA + F.coalesce("p", F.lit(0.0)))
        odd = (both if whole else both.filter("seen")).select(*keys, "frame", *POINT, back.alias("v"))
        rest = even.unionByName(store(odd) if level > 1 else odd).select(*keys, F.col("frame").alias("i"), *POINT, F.col("v").alias("l"))
    return rest.select(*keys, F.col("i").alias("frame"), *POINT, F.col("l").alias("v"))


def assign_gop(frames: DataFrame, keys: list[str], size: int = 8) -> DataFrame:
    """frames with gop, pos, effective size (the last GOP may be short) and padded, the frames of (GOPs + 1) * size."""
    own, clip = Window.partitionBy(*keys, "gop"), Window.partitionBy(*keys)
    out = frames.withColumn("gop", F.expr(f"frame div {size}").cast("int")).withColumn("pos", (F.col("frame") % size).cast("int"))
    out = out.withColumn("eff_size", F.count("*").over(own))
    return out.withColumn("padded", (F.max("gop").over(clip) + 2) * size)
