"""Stand-in tables for frames, series, motion, blocks, symbols and sizes, from the given tables.

Each has a Spark form and the same view in SQL; `views` puts the SQL of a view
and of what it needs in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {
    "frames16": ((), """
        SELECT CAST(vec_id div 4 AS INT) AS frame, CAST(((vec_id % 4) div 2) * 8 + i div 8 AS INT) AS y, CAST((vec_id % 2) * 8 + i % 8 AS INT) AS x,
               CAST(greatest(0, least(255, round(128 + 256 * CAST(e AS DOUBLE)))) AS DOUBLE) AS v
        FROM embeddings LATERAL VIEW posexplode(embedding) p AS i, e"""),
    "series": ((), """
        WITH d AS (SELECT l_returnflag AS sid, CAST(l_shipdate AS DATE) AS d, SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
             n AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY d) - 1 AS t, v, count(*) OVER (PARTITION BY sid) AS c FROM d)
        SELECT sid, CAST(t AS INT) AS t, v FROM n WHERE t < c - c % 2"""),
    "symbols": ((), """
        SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CAST(event_id % 4 AS INT) AS ctx,
               CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS sym FROM events"""),
    "motion": (("frames16",), """
        SELECT frame, y, x, s AS side, ((frame * 7 + (x div 4) * 3 + (y div 4) + s) % 17 - 8) / CAST(4 AS DOUBLE) AS mvx,
               ((frame * 5 + (x div 4) + (y div 4) * 3 + s) % 13 - 6) / CAST(4 AS DOUBLE) AS mvy,
               CASE WHEN frame % 31 = 0 OR (frame + y div 4 + x div 4 + s) % 7 = 0 THEN 0 ELSE 1 END AS m
        FROM frames16 CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1) sides"""),
    "blocks": (("frames16", "motion"), """
        SELECT m.frame, CASE WHEN m.frame % 2 = 0 AND cy < 8 AND cx < 8 THEN '0' ELSE concat(CAST((cy div 8) * 2 + cx div 8 AS STRING), '/', CAST((cy % 8 div 4) * 2 + cx % 8 div 4 AS STRING)) END AS path,
               cx, cy, xblk, xblk AS yblk, CAST((m.frame + cx + cy) % 8 AS INT) AS mode, m.mvx, m.mvy
        FROM (SELECT frame, y AS cy, x AS cx, CASE WHEN frame % 2 = 0 AND y < 8 AND x < 8 THEN 8 ELSE 4 END AS xblk FROM frames16
              WHERE CASE WHEN frame % 2 = 0 AND y < 8 AND x < 8 THEN y = 0 AND x = 0 ELSE y % 4 = 0 AND x % 4 = 0 END) b
        JOIN motion m ON m.frame = b.frame AND m.y = b.cy AND m.x = b.cx AND m.side = 0"""),
    "substreams": ((), """
        SELECT l_orderkey div 64 AS gop, CAST(l_linenumber - 1 AS INT) AS fr, CAST(l_suppkey % 10 AS INT) AS band, SUM(CAST(l_quantity AS BIGINT) * 700) AS avail,
               SUM(CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 100 * (l_partkey % 9) END) AS alloc FROM lineitem GROUP BY 1, 2, 3"""),
    "mv_bytes": ((), """
        SELECT o_orderkey div 128 AS gop, CAST(o_orderkey % 3 AS INT) AS level, CAST(o_orderkey div 3 % 9 AS INT) AS set_k,
               CASE WHEN o_custkey % 4 = 0 THEN 'major' WHEN o_custkey % 4 = 1 THEN 'sign' ELSE 'sub' END AS part,
               CASE WHEN o_custkey % 4 >= 2 THEN CAST(o_custkey % 4 - 2 AS INT) END AS sub_bit, o_orderkey * 37 % 9001 AS bytes FROM orders"""),
    "steps": ((), """
        SELECT day(ts) AS epoch, CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS phase, CAST(event_id % 8 AS INT) AS pos,
               CAST(round(value * 100) AS BIGINT) % 997 / CAST(10 AS DOUBLE) AS loss, 20 + CAST(round(value * 100) AS BIGINT) % 1009 / CAST(50 AS DOUBLE) AS psnr,
               CAST(round(value * 100) AS BIGINT) % 541 / CAST(100 AS DOUBLE) AS bpp FROM events"""),
    "rgb": (("frames16",), """
        SELECT CAST(frame div 3 AS INT) AS frame, CASE frame % 3 WHEN 0 THEN 'r' WHEN 1 THEN 'g' ELSE 'b' END AS plane, y, x, v FROM frames16
        WHERE frame < (SELECT (max(frame) + 1) div 3 * 3 FROM frames16)"""),
    "mv_clips": (("mv_bytes",), "SELECT CAST(gop % 11 AS INT) AS clip, gop, level, set_k, part, sub_bit, bytes FROM mv_bytes WHERE gop % 11 <> 3 OR part <> 'sub' OR level > 0"),
    "clips": (("mv_clips",), """
        SELECT clip, 0 AS start, CAST(8 * count(DISTINCT gop) - 1 AS INT) AS last, CAST(25 + 5 * (clip % 2) AS DOUBLE) AS framerate,
               CAST(sum(bytes) * (1 + clip % 5) * (25 + 5 * (clip % 2)) div (2000 * count(DISTINCT gop)) AS INT) AS bitrate FROM mv_clips GROUP BY clip"""),
    "frame_bits": (("substreams",), """
        SELECT concat('c', CAST(gop % 3 AS STRING)) AS clip, CASE band % 3 WHEN 0 THEN 'y' WHEN 1 THEN 'u' ELSE 'v' END AS plane,
               CASE fr % 4 WHEN 0 THEN 'H1' WHEN 1 THEN 'H2' WHEN 2 THEN 'H3' ELSE 'L3' END AS tband, CAST(gop div 3 AS INT) AS idx, avail AS bits FROM substreams"""),
    "clip_sizes": (("frame_bits",), """
        SELECT clip, 0 AS start, CAST(8 * count(DISTINCT idx) - 1 AS INT) AS last, 352 AS ywidth, 288 AS yheight, 176 AS cwidth, 144 AS cheight FROM frame_bits GROUP BY clip"""),
    "codes10": ((), "SELECT CAST(l_partkey * 31 % 1024 AS INT) AS code FROM lineitem"),
}
_TABLES = {"frames16": "embeddings", "series": "lineitem", "symbols": "events", "substreams": "lineitem", "mv_bytes": "orders", "steps": "events", "codes10": "lineitem"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table; what it is made of is passed to SQL by name, not registered."""
    needs, text = _SPARK[name]
    frames = {n: fixture(spark, sf_dir, n) for n in needs}
    if name in _TABLES:
        frames[_TABLES[name]] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{_TABLES[name]}.parquet")
    for n in frames:
        text = _named(text, n)
    return spark.sql(text, **frames)


def _named(text: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)


def _duck(name: str) -> str:
    text = _SPARK[name][1].replace(" div ", " // ").replace("AS STRING", "AS VARCHAR")
    if name == "frames16":
        text = text.replace("FROM embeddings LATERAL VIEW posexplode(embedding) p AS i, e", "FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)")
    return text


def views(*names: str) -> str:
    """WITH .. of views in DuckDB's spelling, each after what it needs; ends with a comma for more."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        for other in _SPARK[n][0]:
            add(other)
        done.setdefault(n, _duck(n))

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in done.items())
