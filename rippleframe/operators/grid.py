"""Projections, filters and placements on tables of samples and coefficients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions import scalars as S

#: Rows of luma and chroma weights, and of the way back.
TO_YUV = {"601": ((0.299, 0.587, 0.114), (-0.169, -0.331, 0.5), (0.5, -0.419, -0.081)), "240m": ((0.212, 0.701, 0.087), (-0.116, -0.384, 0.5), (0.5, -0.445, -0.055))}
TO_RGB = {"601": ((1.0, -0.0009, 1.4017), (1.0, -0.3437, -0.7142), (1.0, 1.7722, 0.001)), "240m": ((1.0, -0.0007, 1.5758), (1.0, -0.2264, -0.4765), (1.0, 1.826, -0.0004))}
#: A detail band survives while discard is below 3 * level + this; LL below 13.
BAND_RANK = {"HL": 3, "LH": 2, "HH": 1}
BLACK, WHITE, GAMMA = 95, 685, 2.2


def fixed_point(df: DataFrame, column: str, scale: int = 16, inverse: bool = False) -> DataFrame:
    """The column as round(v * scale) in 16 bits, or back by division."""
    c = F.col(column)
    return df.withColumn(column, c / scale if inverse else F.round(c * scale).cast("smallint"))


def color_convert(df: DataFrame, matrix: str = "601", to: str = "yuv") -> DataFrame:
    """(frame, plane, y, x, v) with planes r, g, b into y, u, v or back; points without all three planes drop out."""
    source, target, table = ("rgb", "yuv", TO_YUV) if to == "yuv" else ("yuv", "rgb", TO_RGB)
    spots = df.select("frame", F.col("y").alias("_y"), F.col("x").alias("_x"), "plane", "v")  # a plane is called y too
    wide = spots.groupBy("frame", "_y", "_x").pivot("plane", list(source)).agg(F.first("v")).dropna(subset=list(source))
    planes = [F.struct(F.lit(p).alias("plane"), reduce(Column.__add__, [w * F.col(s) for w, s in zip(row, source, strict=True)]).alias("v")) for p, row in zip(target, table[matrix], strict=True)]
    return wide.select("frame", "_y", "_x", F.explode(F.array(*planes)).alias("s")).select("frame", "s.plane", F.col("_y").alias("y"), F.col("_x").alias("x"), "s.v")


def tone_table(df: DataFrame, peak: int = 255, domain: str = "linear", curve: str = "two") -> DataFrame:
    """(code, value) of the 1024 ten-bit log codes: linear light between black and white, or (`video`) its gamma curve.

    `two` takes codes as powers of two, 102.4 steps each; `ten` as powers of ten, 300 steps each.
    """
    base, steps = (2.0, 102.4) if curve == "two" else (10.0, 300.0)
    black, white = base ** (BLACK / steps), base ** (WHITE / steps)
    light = F.least(F.greatest((F.pow(F.lit(base), F.col("code") / steps) - black) / (white - black), F.lit(0.0)), F.lit(1.0))
    codes = df.sparkSession.range(1024).select(F.col("id").cast("int").alias("code"))
    return codes.select("code", F.round(peak * (light if domain == "linear" else F.pow(light, F.lit(1 / GAMMA)))).cast("int").alias("value"))


def log_to_linear(df: DataFrame, peak: int = 255, domain: str = "linear", curve: str = "two") -> DataFrame:
    """df with value for its column code; in the domain `log` codes stay as they are."""
    if domain not in ("log", "linear", "video") or curve not in ("two", "ten"):
        raise ValueError(f"unknown domain or curve: {domain}, {curve}")
    if domain == "log":
        return df.withColumn("value", F.col("code"))
    return df.join(F.broadcast(tone_table(df, peak, domain, curve)), "code")  # 1024 rows


def level_table(df: DataFrame) -> DataFrame:
    """(kind, level, quant, copy): gains of the eight levels, high and low."""
    rows = [(k, n, (S.HIGH_WEIGHTS if k == "H" else S.LOW_WEIGHTS)[n], S.copy_weight(k, n)) for k in "HL" for n in range(8)]
    return df.sparkSession.createDataFrame(rows, "kind string, level int, quant double, copy double")


def level_weight(df: DataFrame, value: str = "v", weight: str = "quant") -> DataFrame:
    """df (kind, level, ..) with its value times the level's gain."""
    table = level_table(df).select("kind", "level", F.col(weight).alias("_w"))
    return df.join(F.broadcast(table), ["kind", "level"]).withColumn(value, F.col(value) * F.col("_w")).drop("_w")  # 16 rows


def _rank() -> Column:
    rank = F.lit(None).cast("int")
    for band, r in BAND_RANK.items():
        rank = F.when(F.col("band") == band, 3 * F.col("level") + r).otherwise(rank)
    return F.coalesce(rank, F.lit(13))


def keep_bands(coeffs: DataFrame, discard: int) -> DataFrame:
    """Coefficients whose band survives `discard`."""
    return coeffs.filter(F.lit(discard) < _rank())


def rebuild_bands(base: DataFrame, discard: int, scale: float) -> DataFrame:
    """base (.., level, band, c) of the bands that keep_bands drops: a rounded coefficient moves away from zero by scale, 0 stays 0; the low band is only rounded."""
    r = F.rint("c")
    moved = F.when(F.col("band") == "LL", r).otherwise(F.signum(r) * (F.abs(r) + F.when(r == 0, 0.0).otherwise(scale)))
    return base.filter(F.lit(discard) >= _rank()).withColumn("c", moved)


def keep_temporal(df: DataFrame, level: int) -> DataFrame:
    return df.filter(F.col("level") >= level)


def pad_to(samples: DataFrame, keys: list[str], block: int = 16) -> DataFrame:
    """Frames grown to a multiple of block by repeating their last row and column."""
    size = samples.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    up = lambda n: (F.ceil(F.col(n) / block) * block - 1).cast("int")
    edge_y = F.when(F.col("y") == F.col("h") - 1, F.sequence(F.col("y"), up("h"))).otherwise(F.array("y"))
    edge_x = F.when(F.col("x") == F.col("w") - 1, F.sequence(F.col("x"), up("w"))).otherwise(F.array("x"))
    return samples.join(size, keys).select(*keys, F.explode(edge_y).alias("y"), "v", edge_x.alias("xs")).select(*keys, "y", F.explode("xs").alias("x"), "v")


def crop_to(samples: DataFrame, keys: list[str], block: int = 16, height: int | None = None, width: int | None = None) -> DataFrame:
    """Frames cut to a multiple of block, from height and width where both are given (a frame may lack samples then), else from the last row and column that a frame has."""
    if height and width:
        return samples.filter((F.col("y") < height - height % block) & (F.col("x") < width - width % block))
    size = samples.groupBy(*keys).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    return samples.join(size, keys).filter((F.col("y") < F.col("h") - F.col("h") % block) & (F.col("x") < F.col("w") - F.col("w") % block)).drop("h", "w")


def sample_grid(clips: DataFrame, height: str, width: str) -> DataFrame:
    """clips with one row for each (y, x)."""
    return clips.withColumn("y", F.explode(F.sequence(F.lit(0), F.col(height) - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col(width) - 1)))


def upscale_nearest(samples: DataFrame, k: int) -> DataFrame:
    """Every sample k x k times."""
    out = samples.withColumn("_dy", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_dx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return out.withColumn("y", F.col("y") * k + F.col("_dy")).withColumn("x", F.col("x") * k + F.col("_dx")).drop("_dy", "_dx")


def apply_layout(stacked: DataFrame, layout: DataFrame) -> DataFrame:
    """Rows of stacked (channel, ..) with what layout (channel, kind, idx) says of their channel."""
    return stacked.join(layout, "channel")


def place_bands(coeffs: DataFrame, half_h: int, half_w: int) -> DataFrame:
    """Band coordinates into one tile: HL to the right, LH below, HH at the diagonal."""
    y = F.col("y") + F.when(F.col("band").isin("LH", "HH"), half_h).otherwise(0)
    x = F.col("x") + F.when(F.col("band").isin("HL", "HH"), half_w).otherwise(0)
    return coeffs.withColumn("y", y).withColumn("x", x).drop("band")


def unplace_bands(tile: DataFrame, half_h: int, half_w: int) -> DataFrame:
    down, right = F.col("y") >= half_h, F.col("x") >= half_w
    band = F.when(down & right, "HH").when(down, "LH").when(right, "HL").otherwise("LL")
    return tile.withColumn("band", band).withColumn("y", F.col("y") % half_h).withColumn("x", F.col("x") % half_w)


def stack_bands(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
