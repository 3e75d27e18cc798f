"""Streaming forms of the running metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

from rippleframe.functions.adaptive import capped_step


def stream_quality(stream: DataFrame, keys: list[str], value: str = "psnr") -> DataFrame:
    """Running mean of a value for each key; use with outputMode update or complete."""
    return stream.groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("n"))


def stream_gop_bytes(stream: DataFrame, time: str, value: str, length: str, late: str) -> DataFrame:
    """Bytes of each closed window; rows later than the watermark drop out; use with outputMode append."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length).alias("w")).agg(F.sum(value).alias(value), F.count("*").alias("n")).select(F.col("w.start").alias("start"), value, "n")


def stream_adaptive_cost(stream: DataFrame, size: int, cap: int) -> DataFrame:
    """adaptive_cost_capped over a stream of symbols (stream, seq, ctx, sym); rows of a batch are taken in order of seq.

    The counts of a stream, by context, are one state, which comes and goes with
    its rows: many streams share an Arrow batch, and none asks the state store.
    """

    def whole(ctx: object) -> object:
        """A null makes integers of a column floats."""
        return None if pd.isna(ctx) else int(ctx) if integral else ctx

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, flat = state.get if state.exists else ([], [])
        counts = {ctx: list(flat[k * size : (k + 1) * size]) for k, ctx in enumerate(known)}
        parts = list(parts)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts)
        pdf = pdf.iloc[np.argsort(pdf["seq"].to_numpy(), kind="stable")]
        contexts = pdf["ctx"].tolist()
        contexts = [whole(c) for c in contexts] if pdf["ctx"].hasnans else contexts
        bits = [capped_step(counts.setdefault(ctx, [1] * size), sym, cap) for ctx, sym in zip(contexts, pdf["sym"].tolist(), strict=True)]
        state.update((list(counts), [c for own in counts.values() for c in own]))
        yield pdf.assign(bits=bits)

    rows = stream.select("stream", "seq", "ctx", "sym")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    integral = isinstance(rows.schema["ctx"].dataType, IntegralType)
    counted = f"contexts array<{rows.schema['ctx'].dataType.simpleString()}>, counts array<int>"
    return rows.groupBy("stream").applyInPandasWithState(run, kinds + ", bits double", counted, "append", GroupStateTimeout.NoTimeout)
