"""Entropy, coding cost, bit planes and rate-distortion tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.functions.adaptive import capped_step
from rippleframe.functions.scalars import dequantize, normal_mass, quantize


def symbol_entropy(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, entropy): bits a symbol; one row for each group with symbols."""
    counts = symbols.groupBy(*keys, "sym").agg(F.count("*").alias("c"))
    total = F.sum("c").alias("n")
    return counts.groupBy(*keys).agg(total, (F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def binary_model_cost(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, c0, c1, bits0, bits1, total, average, gap): a two-symbol model; gap is the loss against a model of even chances."""
    one = F.col("sym") != 0
    out = symbols.groupBy(*keys).agg(F.sum(F.when(one, 0).otherwise(1)).alias("c0"), F.sum(F.when(one, 1).otherwise(0)).alias("c1"))
    n = F.col("c0") + F.col("c1")
    bits = lambda c: F.when(F.col(c) > 0, F.log2(n / F.col(c)))
    out = out.withColumn("bits0", bits("c0")).withColumn("bits1", bits("c1"))
    total = F.coalesce(F.col("c0") * F.col("bits0"), F.lit(0.0)) + F.coalesce(F.col("c1") * F.col("bits1"), F.lit(0.0))
    return out.withColumn("total", total).withColumn("average", F.col("total") / n).withColumn("gap", 1 - F.col("total") / n)


def conditional_entropy(df: DataFrame, keys: list[str], context: list[str]) -> DataFrame:
    """(keys, n, bits): sum of -log2 P(sym | context) from two-level counts."""
    joint = df.groupBy(*keys, *context, "sym").agg(F.count("*").alias("c"))
    sums = joint.groupBy(*keys, *context).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n") - F.col("s")).alias("bits"))


def mixture_bits(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, bits): -log2 of the mass that a Gaussian mixture gives [x - 1/2, x + 1/2].

    params (keys, k, logit, mu, sigma); weights are a softmax, sigma at least 1e-6, a mass at least 1e-9.
    """
    own = Window.partitionBy(*keys)
    weights = params.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(own))).withColumn("w", F.col("_e") / F.sum("_e").over(own))
    values = df.groupBy(*keys, "x").agg(F.count("*").alias("c"))
    sd = F.greatest(F.abs("sigma"), F.lit(1e-6))
    rows = values.join(weights.select(*keys, "w", "mu", "sigma"), keys)
    rows = rows.withColumn("_low", (F.col("x") - 0.5 - F.col("mu")) / sd).withColumn("_high", (F.col("x") + 0.5 - F.col("mu")) / sd)
    rows = rows.withColumn("m", normal_mass(F.col("_low"), F.col("_high")) * F.col("w"))
    each = rows.groupBy(*keys, "x", "c").agg(F.greatest(F.sum("m"), F.lit(1e-9)).alias("p"))
    return each.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(-F.log2("p") * F.col("c")).alias("bits"))


def code_bits(word: Column, code: str, order: int = 0, levels: int | None = None) -> Column:
    """Bits of a word under exp-Golomb of an order, signed truncated unary, a 2/4-byte length or a 1/2/4-byte number.

    With so many levels at most, exp-Golomb needs no stop bit at the last one, where larger words are cut to the largest.
    """
    if code == "golomb":
        level = F.length(F.bin(F.shiftright(word.cast("bigint"), order) + 1)) - 1  # the bit length is exact where a logarithm would round up
        if levels is None:
            return 1 + order + 2 * level
        return 1 + order + 2 * F.least(level, F.lit(levels - 1)) - F.when(level >= levels - 1, 1).otherwise(0)
    if code == "unary":
        return F.abs(word) + 1 + F.when(word != 0, 1).otherwise(0)
    if code == "length":
        return F.when(word < (1 << 15), 16).otherwise(32)
    return F.when(word < (1 << 7), 8).when(word < (1 << 14), 16).otherwise(32)


def code_size(df: DataFrame, keys: list[str], word: str, code: str, order: int = 0, levels: int | None = None) -> DataFrame:
    """(keys, n, bits)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(code_bits(F.col(word), code, order, levels)).cast("bigint").alias("bits"))


def frequency_rank(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sym, c, rank): most frequent first, ties by symbol."""
    counts = symbols.groupBy(*keys, "sym").agg(F.count("*").alias("c"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), "sym")))


#: Symbols of a stream that adaptive_cost() counts in one window.
COUNT_BLOCK = 1 << 16


def adaptive_cost(symbols: DataFrame, size: int, prior: Sequence[int] | None = None, block: int = COUNT_BLOCK) -> DataFrame:
    """symbols (stream, seq, ctx, sym) with bits, -log2 of the symbol's share before it is counted; counts start at one, or at prior[sym].

    A stream is counted in blocks of seq: windows inside a block, and sums of
    the blocks before it, so that a long stream or a context of most of the rows
    is the work of many tasks.
    """
    start = [1] * size if prior is None else list(prior)
    rows = symbols.withColumn("_block", F.floor(F.col("seq") / block))
    for name, own in (("_all", ["stream", "ctx"]), ("_same", ["stream", "ctx", "sym"])):
        totals = rows.groupBy(*own, "_block").agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*own).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = F.count("*").over(Window.partitionBy(*own, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.join(totals.select(*own, "_block", before.alias("_before")), [*own, "_block"]).withColumn(name, inside + F.col("_before")).drop("_before")
    bits = F.log2((F.col("_all") + sum(start)) / (F.col("_same") + F.array(*map(F.lit, start))[F.col("sym")]))
    return rows.withColumn("bits", bits).select(*symbols.columns, "bits")


def adaptive_cost_capped(symbols: DataFrame, size: int, cap: int | dict[int, int], prior: Sequence[int] | None = None) -> DataFrame:
    """adaptive_cost with halving at the cap, one for all or by context (a context that is not listed has none).

    Serial by nature within a (stream, ctx), parallel across them. A task gets
    its contexts in order and carries the counts from one Arrow batch to the
    next, so a context of any length takes the memory of a batch.
    """
    start = [1] * size if prior is None else list(prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, most = None, [], 0
        for batch in batches:
            bits = []
            for stream, ctx, sym in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if (stream, ctx) != now:
                    now, counts = (stream, ctx), list(start)
                    most = cap.get(ctx, inf) if isinstance(cap, dict) else cap
                bits.append(capped_step(counts, sym, most))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.float64())], [*batch.schema.names, "bits"])

    rows = symbols.select("stream", "seq", "ctx", "sym")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition("stream", "ctx").sortWithinPartitions("stream", "ctx", "seq").mapInArrow(run, kinds + ", bits double")


def band_planes(coeffs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, planes): floor(log2(max |q|)) + 1, 0 where all are zero."""
    most = F.max(F.abs("q"))
    return coeffs.groupBy(*keys).agg(F.when(most > 0, F.floor(F.log2(most)) + 1).otherwise(0).cast("int").alias("planes"))


def magnitude_pyramid(coeffs: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """(keys, up, y, x, bits): each parent the OR of its four children's magnitudes."""
    now = coeffs.select(*keys, F.lit(0).alias("up"), "y", "x", F.abs("q").cast("int").alias("bits"))
    out = now
    for up in range(1, levels + 1):
        now = now.groupBy(*keys, F.expr("y div 2").cast("int").alias("py"), F.expr("x div 2").cast("int").alias("px")).agg(F.bit_or("bits").alias("bits"))
        now = now.select(*keys, F.lit(up).alias("up"), F.col("py").alias("y"), F.col("px").alias("x"), "bits")
        out = out.unionByName(now)
    return out


def plane_census(coeffs: DataFrame, keys: list[str], planes: int) -> DataFrame:
    """(keys, plane, fresh, still_zero, ones, zeros, negative): what each bit plane codes."""
    rows = coeffs.withColumn("m", F.abs("q").cast("int")).withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(planes - 1))))
    here, above = F.expr("shiftright(m, plane)"), F.expr("shiftright(m, plane + 1)")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    fresh = (here > 0) & (above == 0)
    return rows.groupBy(*keys, "plane").agg(count(fresh).alias("fresh"), count(here == 0).alias("still_zero"), count((above > 0) & (here % 2 == 1)).alias("ones"), count((above > 0) & (here % 2 == 0)).alias("zeros"), count(fresh & (F.col("q") < 0)).alias("negative"))


def progressive_planes(coeffs: DataFrame, planes: int) -> DataFrame:
    """coeffs (.., c) with one row for each plane k: base (step 2**(9-k)), current (2**(8-k)), residual q_k - base / step, recon."""
    rows = coeffs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(planes))))
    step = F.pow(F.lit(2.0), 8 - F.col("k"))
    base = dequantize(quantize(F.round("c", 9), step * 2), step * 2)
    q = quantize(F.round("c", 9), step)
    return rows.withColumn("base", base).withColumn("current", q).withColumn("residual", q - F.col("base") / step).withColumn("recon", dequantize(q, step))


def rd_curve(coeffs: DataFrame, keys: list[str], planes: int) -> DataFrame:
    """(keys, k, bits, mse, gain, slope): zero-order bits and distortion of each plane count, with the change from the one before."""
    rows = progressive_planes(coeffs, planes).withColumn("sym", F.col("current").cast("bigint"))
    n = symbol_entropy(rows, [*keys, "k"]).select(*keys, "k", (F.col("n") * F.col("entropy")).alias("bits"))
    mse = rows.groupBy(*keys, "k").agg(F.avg((F.col("c") - F.col("recon")) * (F.col("c") - F.col("recon"))).alias("mse"))
    w = Window.partitionBy(*keys).orderBy("k")
    out = n.join(mse, [*keys, "k"]).withColumn("gain", F.lag("mse").over(w) - F.col("mse"))
    more = F.col("bits") - F.lag("bits").over(w)
    return out.withColumn("slope", F.when(F.abs(more) > 1e-9, F.col("gain") / more))


def rd_sweep(coeffs: DataFrame, steps: list[float], discards: list[int], keys: list[str]) -> DataFrame:
    """(keys, step, discard, bits, mse) on a grid of quantiser steps and discarded bands; coeffs (keys, level, band, c)."""
    rank = 3 * F.col("level") + F.when(F.col("band") == "HL", 3).when(F.col("band") == "LH", 2).otherwise(1)
    rank = F.when(F.col("band") == "LL", 13).otherwise(rank)
    rows = coeffs.withColumn("step", F.explode(F.array(*map(F.lit, steps)))).withColumn("discard", F.explode(F.array(*map(F.lit, discards))))
    rows = rows.withColumn("sym", F.when(F.col("discard") < rank, quantize(F.round("c", 9), F.col("step"))).otherwise(0.0).cast("bigint"))
    rows = rows.withColumn("recon", dequantize(F.col("sym").cast("double"), F.col("step")))
    own = [*keys, "step", "discard"]
    bits = symbol_entropy(rows, own).select(*own, (F.col("n") * F.col("entropy")).alias("bits"))
    mse = rows.groupBy(*own).agg(F.avg((F.col("c") - F.col("recon")) * (F.col("c") - F.col("recon"))).alias("mse"))
    return bits.join(mse, own)


def rd_objective(stats: DataFrame, lam: float = 0.064) -> DataFrame:
    """stats (bpp, psnr) with both objectives: bpp and -lam * psnr."""
    return stats.withColumn("rate_loss", F.col("bpp")).withColumn("quality_loss", -lam * F.col("psnr"))
