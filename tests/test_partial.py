"""Tables whose last frame lacks samples, and sums beyond 32 bits."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rippleframe.operators import contexts, rate
from rippleframe.plans import registry
from rippleframe.sources import logs
from tests.compare import differences

SF = "/root/testdata/sf0.001"
NAMES = """AGG2_roi_psnr_legacy JOI6_warp_subpel PRJ10_crop_to SNK1_write_planar SRC1_scan_planar SRC2_scan_planar_template SRC4_scan_clip_bundle
WIN10_chroma_down WIN12_t_predict_along WIN13_t_update_along WIN14_t_pyramid_along WIN15_t_unpyramid_along WIN21_significance_context
WIN6_fir_all_banks WIN6_fir_analysis WIN7_fir_all_banks WIN7_fir_synthesis""".split()


@pytest.fixture(scope="module")
def partial(tmp_path_factory):
    """Folders of sf0.001 with so many vectors: frame 8 has three quarters (35) or one (33), frame 6 the upper half (26)."""

    def make(n):
        folder = tmp_path_factory.mktemp(f"first{n}")
        for name in os.listdir(SF):
            if name != "embeddings.parquet":
                os.symlink(f"{SF}/{name}", folder / name)
        duckdb.sql(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < {n}) TO '{folder}/embeddings.parquet'")
        return str(folder)

    return {n: make(n) for n in (26, 33, 35)}


@pytest.mark.parametrize("n", [26, 33, 35])
@pytest.mark.parametrize("name", NAMES)
def test_frames_that_lack_samples(spark, partial, name, n):
    assert not differences(registry.QUERIES[name](spark, partial[n]), registry.ORACLE_SQL[name], partial[n])[:3]


def test_samples_of_a_long_clip_pass_32_bits(spark):
    bits = spark.createDataFrame([("a", "y", 5)], "clip string, plane string, bits bigint")
    clips = spark.createDataFrame([("a", 0, 99_999, 352, 288, 176, 144)], "clip string, start int, last int, ywidth int, yheight int, cwidth int, cheight int")
    assert rate.bits_per_sample(bits, clips).filter("plane = 'y'").first()["samples"] == 100_000 * 352 * 288


def test_log_of_late_frames_passes_32_bits(spark, tmp_path):
    for name in os.listdir(SF):
        if name != "embeddings.parquet":
            os.symlink(f"{SF}/{name}", tmp_path / name)
    duckdb.sql(f"COPY (SELECT vec_id + 20000 AS vec_id, embedding, label FROM '{SF}/embeddings.parquet' WHERE vec_id < 8) TO '{tmp_path}/embeddings.parquet'")
    got = registry.QUERIES["SRC5_scan_tagged_log"](spark, str(tmp_path)).filter("kind = 'dmv'")
    assert got.agg(F.min("id"), F.max("id")).first() == (5_000_000_000, 5_001_012_012)


def test_neighbours_are_those_of_the_place(spark):
    rows = spark.createDataFrame([(0, 0, 1), (0, 3, 2), (1, 2, 4), (2, 1, 8), (5, 2, 16)], "y int, x int, q int").withColumn("frame", F.lit(0))
    got = {(r.y, r.x): [r[f"n_{n}"] for n in contexts.AROUND] for r in contexts.neighbours(rows, ["frame"]).collect()}
    expected = {(0, 3): {"bl": 4}, (1, 2): {"tr": 2, "bl": 8}, (2, 1): {"tr": 4}}
    assert got == {at: [expected.get(at, {}).get(n, 0) for n in contexts.AROUND] for at in got}


def test_bundles_keep_gaps(spark, tmp_path):
    rows = spark.createDataFrame([("a", "frame", 0, 0, 0, 5.0), ("a", "frame", 2, 1, 3, 0.0)], "clip string, kind string, channel int, y int, x int, v double")
    logs.write_clip_bundle(rows, f"file://{tmp_path}")
    assert sorted(map(tuple, logs.scan_clip_bundle(spark, f"file://{tmp_path}").collect())) == sorted(map(tuple, rows.collect()))
