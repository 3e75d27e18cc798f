"""Significance, sign and refinement contexts of quantised coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AROUND = ("tl", "t", "tr", "l", "r", "bl", "b", "br")


def _rows_of_three(df: DataFrame, keys: list[str], value: Column, names: dict[str, str]) -> DataFrame:
    """df with value's eight neighbours by place: a window along each row, column and both diagonals; where there is no sample 0."""
    out = df.withColumn("_c", value)
    lines = (("y", "x", "l", "r"), ("x", "y", "t", "b"), (F.col("x") - F.col("y"), "y", "tl", "br"), (F.col("x") + F.col("y"), "y", "tr", "bl"))
    for line, index, before, after in lines:
        w = Window.partitionBy(*keys, line).orderBy(index)
        near = lambda k, w=w, i=index: F.when(F.lag(i, k).over(w) == F.col(i) - k, F.lag("_c", k).over(w)).otherwise(F.lit(0))
        out = out.withColumns({names[before]: near(1), names[after]: near(-1)})
    return out.drop("_c")


def neighbours(coeffs: DataFrame, keys: list[str], prefix: str = "n_") -> DataFrame:
    """coeffs with the eight neighbours' q as n_tl, n_t, .. n_br, 0 outside a band: every plane's contexts follow from them."""
    return _rows_of_three(coeffs.repartition(*keys), keys, F.col("q"), {n: prefix + n for n in AROUND})


def significance_context(coeffs: DataFrame, keys: list[str], plane: int, parents: DataFrame | None = None, height: int | None = None, width: int | None = None) -> DataFrame:
    """coeffs (keys, y, x, q) with sig, the eight neighbour bits, border, h, v, d and the parent bit p at a bit plane.

    parents (keys, y, x, q) is the same band one level up; without it p is 0.
    The border is that of a band of height and width; where they are not given,
    the first row and column and the last that the band has.
    """
    own = coeffs.repartition(*keys).withColumn("sig", F.when(F.shiftright(F.abs("q").cast("int"), plane) > 0, 1).otherwise(0))
    out = _rows_of_three(own, keys, F.col("sig"), {n: n for n in AROUND})
    w = Window.partitionBy(*keys)
    last = {c: F.lit(n - 1) if n else F.max(c).over(w) for c, n in (("y", height), ("x", width))}
    out = out.withColumn("border", ((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == last["y"]) | (F.col("x") == last["x"])).cast("int"))
    out = out.withColumn("h", F.col("l") + F.col("r")).withColumn("v", F.col("t") + F.col("b")).withColumn("d", F.col("tl") + F.col("tr") + F.col("bl") + F.col("br"))
    if parents is None:
        return out.withColumn("p", F.lit(0))
    up = parents.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.when(F.shiftright(F.abs("q").cast("int"), plane) > 0, 1).otherwise(0).alias("p"))
    out = out.withColumn("_y", F.expr("y div 2").cast("int")).withColumn("_x", F.expr("x div 2").cast("int"))
    return out.join(up, [*keys, "_y", "_x"], "left").withColumn("p", F.coalesce("p", F.lit(0))).drop("_y", "_x")


def zero_classes(h: Column, v: Column, d: Column, p: Column, band: Column) -> tuple[Column, Column]:
    """(alone, joint): classes of a significance bit by the number of significant neighbours, without and with the parent.

    HL is transposed before coding, so its h and v swap. HH has its own table.
    """
    diag = band == "HH"
    s, h = h + v, F.when(band == "HL", v).otherwise(h)
    lone = F.when(d == 1, 0).otherwise(1)
    main = F.when(s == 0, lone).when(s == 1, 1 + h)
    alone = F.when(diag, F.when(s == 0, lone).when(s == 1, 1).otherwise(2)).otherwise(main.otherwise(3))
    few = (h == 1) & (s == 2)  # one each way
    many = lambda limit: (d >= limit).cast("int")
    with_parent = F.when(diag, F.when(s == 0, lone).when(s == 1, 1 + many(3)).when(few, 1 + many(2)).when(s == 2, 2).otherwise(3)).otherwise(main.when(s == 2, 3).otherwise(4))
    without = F.when(diag, F.lit(4)).otherwise(5) + F.when(s == 0, 0).when(s == 1, many(3)).when(s == 2, 1).otherwise(2)
    return alone, F.when(p == 1, with_parent).otherwise(without)


def significance_class(ctx: DataFrame, band: str = "band") -> DataFrame:
    """ctx with alone and joint, by zero_classes()."""
    alone, joint = zero_classes(*[F.col(c) for c in ("h", "v", "d", "p", band)])
    return ctx.withColumn("alone", alone).withColumn("joint", joint)


def refine_classes(h: Column, v: Column, old_h: Column, old_v: Column, band: Column) -> tuple[Column, Column]:
    """(refine, aged): classes of a refinement bit from h and v, and from those of the plane above; HL swaps both."""
    swap, diag = band == "HL", band == "HH"
    turned = lambda a, b: F.when(swap, b).otherwise(a)
    h, v, oh, ov = turned(h, v), turned(v, h), turned(old_h, old_v), turned(old_v, old_h)
    none, full = (h == 0) & (v == 0), (h == 2) & (v == 2)
    refine = F.when(none, 0).when(diag, F.when((h == 0) | (v == 0), 1).when(full, 3).otherwise(2)).when(h == 0, 1).when(v == 0, 2).when(full, 4).otherwise(3)
    mixed = F.when(diag, 1).otherwise(2)
    return refine, F.when(none | ((oh == 0) & (ov == 0)), 0).when((oh == 0) | (ov == 0), mixed).when((oh == 2) | (ov == 2), 1).otherwise(mixed)


def refinement_class(now: DataFrame, old: DataFrame, keys: list[str], band: str = "band") -> DataFrame:
    """(keys, y, x, refine, aged), where now and old are significance contexts at a plane and at the one above it."""
    before = old.select(*keys, "y", "x", F.col("h").alias("_oh"), F.col("v").alias("_ov"))
    refine, aged = refine_classes(*[F.col(c) for c in ("h", "v", "_oh", "_ov", band)])
    return now.join(before, [*keys, "y", "x"]).select(*keys, band, "y", "x", refine.alias("refine"), aged.alias("aged"))


def sign_classes(signs: dict[str, Column], band: Column) -> tuple[Column, Column]:
    """(class, flip): of a sign, from the neighbours' signs (0 where they are not significant); flip is 1 where it is predicted negative.

    The balance of horizontal, vertical, then diagonal neighbours' signs (each
    clipped to -1..1 by direction) gives the class; the predicted sign is
    negative where the stronger direction says so. Opposite balances share a
    class, with the prediction turned.
    """

    def balance(a: str, b: str) -> Column:
        some = lambda s: ((signs[a] == s) | (signs[b] == s)).cast("int")
        return some(1) - some(-1)

    swap, diag = band == "HL", band == "HH"
    across, down, fall, rise = balance("l", "r"), balance("t", "b"), balance("tl", "br"), balance("tr", "bl")
    h, v = F.when(swap, down).otherwise(across), F.when(swap, across).otherwise(down)
    turned = F.when(v < 0, -h).otherwise(h)
    klass = F.when(v != 0, 3 + turned).when(h != 0, 1).when((fall != 0) | (rise != 0), 5).otherwise(0)
    # as a bit that flips the sign: main bands flip on a negative horizontal balance, HH on a positive one
    first = F.when(v > 0, 1).when(v < 0, 0).when(h != 0, F.when(diag, (h > 0).cast("int")).otherwise((h < 0).cast("int")))
    second = F.when(fall < 0, 1).when(fall > 0, 0).when(rise != 0, F.when(diag, (rise < 0).cast("int")).otherwise((rise > 0).cast("int"))).otherwise(0)
    return klass, F.coalesce(first, second)


def sign_context(coeffs: DataFrame, keys: list[str], plane: int, band: str = "band") -> DataFrame:
    """coeffs significant at a plane with sign_class and agrees (with the predicted sign), by sign_classes()."""
    sign = F.when(F.shiftright(F.abs("q").cast("int"), plane) > 0, F.signum(F.col("q").cast("double")).cast("int")).otherwise(0)
    out = _rows_of_three(coeffs.repartition(*keys), keys, sign, {n: f"_{n}" for n in AROUND})
    klass, flip = sign_classes({n: F.col(f"_{n}") for n in AROUND}, F.col(band))
    kept = out.withColumn("sign_class", klass).withColumn("agrees", (flip == (F.col("q") < 0).cast("int")).cast("int"))
    return kept.filter(F.shiftright(F.abs("q").cast("int"), plane) > 0).select(*keys, band, "y", "x", "q", "sign_class", "agrees")


def sign_agreement(signs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sign_class, n, rate)."""
    return signs.groupBy(*keys, "sign_class").agg(F.count("*").alias("n"), F.avg("agrees").alias("rate"))
