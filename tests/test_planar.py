"""Planar containers: written and read back, commit and abort, filters that reach the files."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

from rippleframe.sources import planar

PLANES = {"y": (4, 6), "u": (2, 3), "v": (2, 3)}
CHROMA = {"cheight": 2, "cwidth": 3}


def samples(spark, clips):
    """Rows of clips {name: frames}, shuffled."""
    rows = [(c, p, f, y, x, float((f * 31 + y * 7 + x * 3 + len(p) * ord(p)) % 256)) for c, n in clips.items() for f in range(n) for p, (h, w) in PLANES.items() for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "clip string, plane string, frame int, y int, x int, v double").repartition(5)


def files(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


@pytest.fixture
def many_tasks(spark):
    """Small partitions stay apart, so that a clip is written by several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("dtype", ["uint8", "float32"])
@pytest.mark.usefixtures("many_tasks")
def test_what_is_written_is_read(spark, tmp_path, dtype):
    df, path = samples(spark, {"a": 23, "b": 1, "c.d": 9}), f"file://{tmp_path}/out"
    planar.write_planar(df, path, 4, 6, dtype=dtype, **CHROMA)
    back = planar.scan_planar(spark, path, 4, 6, dtype=dtype, frames_per_task=4, **CHROMA)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    names = files(tmp_path / "out")
    assert {"a.yuv", "b.yuv", "c.d.yuv"} <= set(names) and len(names) > 3 and not [n for n in names if n.startswith("_")]
    assert sum(os.path.getsize(tmp_path / "out" / n) for n in names) == 33 * 36 * (4 if dtype == "float32" else 1)


def test_values_are_rounded_and_cut(spark, tmp_path):
    df = samples(spark, {"a": 1}).withColumn("v", F.lit(-3.0) + F.col("x") * 60.5)
    planar.write_planar(df, f"file://{tmp_path}", 4, 6, **CHROMA)
    got = {(r.plane, r.x): r.v for r in planar.scan_planar(spark, f"file://{tmp_path}", 4, 6, **CHROMA).collect()}
    assert [got["y", x] for x in range(6)] == [0.0, 58.0, 118.0, 179.0, 239.0, 255.0]


BROKEN = {
    "a sample is missing": lambda df: df.filter("not (clip = 'a' and frame = 7 and plane = 'u' and x = 1 and y = 1)"),
    "a sample is double": lambda df: df.unionByName(df.filter("clip = 'a' and frame = 7 and plane = 'v' and x = 1")),
    "a frame is missing": lambda df: df.filter("not (clip = 'b' and frame = 3)"),
    "a task fails": lambda df: df.withColumn("v", F.when(F.col("frame") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))),
}


@pytest.mark.parametrize("how", sorted(BROKEN))
@pytest.mark.usefixtures("many_tasks")
def test_a_failed_write_leaves_the_folder_as_it_was(spark, tmp_path, how):
    planar.write_planar(samples(spark, {"old": 2}), f"file://{tmp_path}", 4, 6, **CHROMA)
    before = files(tmp_path)
    with pytest.raises(Exception):  # noqa: B017
        planar.write_planar(BROKEN[how](samples(spark, {"a": 12, "b": 6})), f"file://{tmp_path}", 4, 6, mode="overwrite", **CHROMA)
    assert files(tmp_path) == before


def test_overwrite_and_append(spark, tmp_path):
    path = f"file://{tmp_path}"
    planar.write_planar(samples(spark, {"a": 30}), path, 4, 6, **CHROMA)
    planar.write_planar(samples(spark, {"b": 2}), path, 4, 6, **CHROMA)
    assert {n[0] for n in files(tmp_path)} == {"a", "b"}
    with pytest.raises(Exception, match="exists"):
        planar.write_planar(samples(spark, {"b": 2}), path, 4, 6, **CHROMA)
    planar.write_planar(samples(spark, {"c": 3}), path, 4, 6, mode="overwrite", **CHROMA)
    back = planar.scan_planar(spark, path, 4, 6, **CHROMA)
    assert {(r.clip, r.n) for r in back.groupBy("clip").agg(F.countDistinct("frame").alias("n")).collect()} == {("c", 3)}


def test_an_empty_table_writes_nothing(spark, tmp_path):
    planar.write_planar(samples(spark, {"a": 1}).filter("false"), f"file://{tmp_path}/none", 4, 6, **CHROMA)
    assert files(tmp_path / "none") == []


def test_filters_cut_the_ranges(spark, tmp_path):
    path = f"file://{tmp_path}"
    planar.write_planar(samples(spark, {"a": 40}).repartition(1), path, 4, 6, **CHROMA)
    options = {"path": path, "height": 4, "width": 6, "frames_per_task": 5, **CHROMA}
    reader = planar.PlanarReader(options)
    assert sum(r.stop - r.start for r in reader.partitions()) == 40
    list(reader.pushFilters([GreaterThanOrEqual(("frame",), 11), LessThanOrEqual(("frame",), 20)]))
    assert sorted(f for r in reader.partitions() for f in range(r.start, r.stop)) == list(range(11, 21))
    df = planar.scan_planar(spark, path, 4, 6, **CHROMA).filter("frame between 11 and 20")
    assert df.select("frame").distinct().count() == 10
