"""9/7 lifting as windows: one series, one frame, pyramids.

Halves are extended by reflection after the even/odd split: the missing
neighbour of the last low sample is the one before it, that of the first high
sample the one after it. Each half needs two samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The four lifting steps and the gains of the high and low half.
STEPS = (-1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971)
HIGH_GAIN, LOW_GAIN = 0.869864451624781, 1.149604398860241
BANDS = (("LL", "HL"), ("LH", "HH"))


def polyphase_split(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """(keys, n, l, h): even and odd samples of each series side by side; an odd last sample has h NULL."""
    w = Window.partitionBy(*keys).orderBy(index)
    return df.withColumn("_next", F.lead(value).over(w)).filter(F.col(index) % 2 == 0).select(*keys, F.expr(f"`{index}` div 2").cast("int").alias("n"), F.col(value).alias("l"), F.col("_next").alias("h"))


def polyphase_merge(halves: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """(keys, index, value): l at 2n and h at 2n + 1."""
    both = F.explode(F.array(F.struct((2 * F.col("n")).alias("i"), F.col("l").alias("v")), F.struct((2 * F.col("n") + 1).alias("i"), F.col("h").alias("v"))))
    return halves.select(*keys, both.alias("s")).select(*keys, F.col("s.i").alias(index), F.col("s.v").alias(value))


def _steps(halves: DataFrame, keys: list[str], sign: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("n")
    after: Column = F.coalesce(F.lead("l").over(w), F.lag("l").over(w))
    before: Column = F.coalesce(F.lag("h").over(w), F.lead("h").over(w))
    for k in range(4)[::sign]:
        if k % 2 == 0:
            halves = halves.withColumn("h", F.col("h") + sign * STEPS[k] * (F.col("l") + after))
        else:
            halves = halves.withColumn("l", F.col("l") + sign * STEPS[k] * (F.col("h") + before))
    return halves


#: Pairs that a block of a long series sees beyond its own on each side: what four lifting steps reach, and one more for the reflection at the ends.
HALO = 3


def _blocked(df: DataFrame, pair: Column, block: int) -> DataFrame:
    """df with _block: rows of pair numbers that the block holds, and those that it only looks at."""
    if block < HALO:
        raise ValueError(f"a block needs {HALO} pairs")
    own = F.floor(pair / block)
    before, after = F.when(pair % block < HALO, own - 1), F.when(pair % block >= block - HALO, own + 1)
    return df.withColumn("_block", F.explode(F.array_compact(F.array(own, before, after))))


def lift97(df: DataFrame, keys: list[str], index: str, value: str, block: int | None = None) -> DataFrame:
    """(keys, n, l, h): low and high half of each series.

    With `block`, a series is cut into blocks of so many pairs (at least 3),
    each a window of its own that also sees three pairs to both sides: one long
    series is the work of many tasks. The index must run without gaps then.
    """
    if block:
        df = _blocked(df, F.expr(f"`{index}` div 2"), block)
        halves = lift97(df, [*keys, "_block"], index, value)
        return halves.filter(F.floor(F.col("n") / block) == F.col("_block")).drop("_block")
    out = _steps(polyphase_split(df, keys, index, value), keys, 1)
    return out.withColumn("l", F.col("l") * LOW_GAIN).withColumn("h", F.col("h") * HIGH_GAIN)


def unlift97(halves: DataFrame, keys: list[str], index: str, value: str, block: int | None = None) -> DataFrame:
    """The series of lift97's halves, in blocks like lift97's where `block` is given."""
    if block:
        out = unlift97(_blocked(halves, F.col("n"), block), [*keys, "_block"], index, value)
        return out.filter(F.floor(F.expr(f"`{index}` div 2") / block) == F.col("_block")).drop("_block")
    scaled = halves.withColumn("l", F.col("l") / LOW_GAIN).withColumn("h", F.col("h") / HIGH_GAIN)
    return polyphase_merge(_steps(scaled, keys, -1), keys, index, value)


def wavelet2d(samples: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """(keys, band, y, x, c) of samples (keys, y, x, v): columns first, then rows; one shuffle by keys, into `parts` partitions where given, serves all windows."""
    own = samples.select(*keys, "y", "x", "v").repartition(*([parts] if parts else []), *keys)
    down = lift97(own, [*keys, "x"], "y", "v")
    tall = down.select(*keys, "x", F.col("n").alias("y"), F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("l").alias("v")), F.struct(F.lit(1).alias("half"), F.col("h").alias("v")))).alias("s"))
    tall = tall.select(*keys, F.col("s.half").alias("half"), "y", "x", F.col("s.v").alias("v"))
    across = lift97(tall, [*keys, "half", "y"], "x", "v")
    name = lambda k: F.when(F.col("half") == 0, BANDS[0][k]).otherwise(BANDS[1][k]).alias("band")
    both = F.explode(F.array(F.struct(name(0), F.col("l").alias("c")), F.struct(name(1), F.col("h").alias("c"))))
    return across.select(*keys, both.alias("s"), "y", F.col("n").alias("x")).select(*keys, "s.band", "y", "x", "s.c")


def unwavelet2d(coeffs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, v) of one level of coefficients."""
    own = coeffs.select(*keys, "band", "y", "x", "c").repartition(*keys)
    half = F.when(F.col("band").isin(*BANDS[1]), 1).otherwise(0)
    high = F.col("band").isin("HL", "HH")
    w = Window.partitionBy(*keys, "half", "y", "x").orderBy("high")
    rows = own.withColumn("half", half).withColumn("high", high).withColumn("_h", F.lead("c").over(w)).filter(~F.col("high"))
    rows = rows.select(*keys, "half", "y", F.col("x").alias("n"), F.col("c").alias("l"), F.col("_h").alias("h"))
    across = unlift97(rows, [*keys, "half", "y"], "x", "v")
    w = Window.partitionBy(*keys, "y", "x").orderBy("half")
    cols = across.withColumn("_h", F.lead("v").over(w)).filter("half = 0").select(*keys, "x", F.col("y").alias("n"), F.col("v").alias("l"), F.col("_h").alias("h"))
    return unlift97(cols, [*keys, "x"], "y", "v").select(*keys, "y", "x", "v")


def _in_place(rows: DataFrame, keys: list[str], line: str, index: str, live: Column, sign: int, values: Sequence[str] = ("c",)) -> DataFrame:
    """The values of the live rows lifted (sign 1) or restored (-1) along index, every sample staying in its row: even ones low, odd ones high."""
    w = Window.partitionBy(*keys, "level", "band", line).orderBy(index)
    low = F.col(index) % 2 == 0
    near = lambda c, k: F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w)
    every = lambda new: rows.withColumns({v: new(F.col(v)) for v in values})
    if sign < 0:
        rows = every(lambda c: F.when(live, c / F.when(low, LOW_GAIN).otherwise(HIGH_GAIN)).otherwise(c))
    for k in range(4)[::sign]:
        odd = k % 2 == 0  # even steps change the high half
        beside = (lambda c: near(c, 1) + F.coalesce(near(c, -1), near(c, 3))) if odd else (lambda c: near(c, -1) + F.coalesce(near(c, 1), near(c, -3)))
        rows = every(lambda c, k=k, odd=odd, beside=beside: F.when(live & (low != F.lit(odd)), c + sign * STEPS[k] * beside(c)).otherwise(c))
    if sign > 0:
        rows = every(lambda c: F.when(live, c * F.when(low, LOW_GAIN).otherwise(HIGH_GAIN)).otherwise(c))
    return rows


def _live(level: int) -> Column:
    return (F.col("level") == level) & (F.col("band") == "LL")


def pyramid(samples: DataFrame, keys: list[str], levels: int = 4, beside: Sequence[str] = ()) -> DataFrame:
    """(keys, level, band, y, x, c): detail bands of each level and the last LL. Heights and widths are multiples of 2**levels.

    Columns named in `beside` stay with the row of their sample.

    All levels live in one table: a level transforms the rows of the LL before
    it where they stand and renames them. One shuffle by keys serves all
    windows, eight for each level.
    """
    rows = samples.select(*keys, F.lit(0).alias("level"), F.lit("LL").alias("band"), "y", "x", F.col("v").alias("c"), *beside).repartition(*keys)
    for level in range(1, levels + 1):
        live = _live(level - 1)
        rows = _in_place(_in_place(rows, keys, "x", "y", live, 1), keys, "y", "x", live, 1)
        name = F.concat(F.when(F.col("x") % 2 == 0, "L").otherwise("H"), F.when(F.col("y") % 2 == 0, "L").otherwise("H"))
        half = lambda c: F.when(live, F.expr(f"{c} div 2")).otherwise(F.col(c)).cast("int").alias(c)
        rows = rows.select(*keys, F.when(live, level).otherwise(F.col("level")).alias("level"), F.when(live, name).otherwise(F.col("band")).alias("band"), half("y"), half("x"), "c", *beside)
    return rows


def unpyramid(coeffs: DataFrame, keys: list[str], levels: int = 4) -> DataFrame:
    """(keys, y, x, v) of pyramid(), the same way back: bands take their places between each other, then are restored where they stand."""
    rows = restored(coeffs.select(*keys, "level", "band", "y", "x", "c").repartition(*keys), keys, levels)
    return rows.select(*keys, "y", "x", F.col("c").alias("v"))


def restored(rows: DataFrame, keys: list[str], levels: int, values: Sequence[str] = ("c",)) -> DataFrame:
    """rows (keys, level, band, y, x, ..) of a pyramid, partitioned by keys, with each of the values taken back to samples in the row of its coefficient."""
    for level in range(levels, 0, -1):
        own = F.col("level") == level
        place = lambda c, high: F.when(own, 2 * F.col(c) + F.col("band").isin(*high).cast("int")).otherwise(F.col(c)).alias(c)
        moved = {"level": F.when(own, level - 1).otherwise(F.col("level")).alias("level"), "band": F.when(own, "LL").otherwise(F.col("band")).alias("band"), "y": place("y", ("LH", "HH")), "x": place("x", ("HL", "HH"))}
        rows = rows.select(*[moved.get(c, F.col(c)) for c in rows.columns])
        live = _live(level - 1)
        rows = _in_place(_in_place(rows, keys, "y", "x", live, -1, values), keys, "x", "y", live, -1, values)
    return rows
