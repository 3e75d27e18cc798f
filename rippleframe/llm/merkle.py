"""A Merkle manifest with a proof for every row (operator 13).

Rows become leaves (one hash of their fields), ordered by id in a tree for each
source; the trees' roots, ordered by source, form one more tree. A block is an
aligned run of fanout**k leaves of a tree; one task hashes it up to its root.
The rest is a butterfly exchange among blocks, one shuffle a round: in a round
every block swaps the root of its subtree with one block of each sibling
subtree, so that all of them learn the siblings and hash the same parent. After
the last round each block knows the root and every sibling above it, without a
pass back down. A subtree with fewer blocks than its siblings sends copies, so
that all lanes hear of it; groups never hold more than fanout rows, however
many rows a source has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.llm.tables import stored
from rippleframe.llm.twins import crc32_sql

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3
#: Levels that one task hashes: blocks of 3**7 = 2187 leaves.
BLOCK_LEVELS = 7
_PATH = "array<struct<left:string,right:string>>"


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def levels_of(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * fanout
    return levels


def _levels(n: str, fanout: int) -> Column:
    """levels_of() as a column of counts below 2**62."""
    powers = [fanout**i for i in range(62) if fanout**i < 1 << 62]
    return F.expr(" + ".join(f"cast({n} > {p} as int)" for p in powers))


# ---- leaves, their numbers and their blocks


def numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with _n, the leaf's number in its tree, and the tree's _size; one row for each tree and part).

    One range partitioning puts all rows in order; parts are cut inside large
    trees too. Counts of a tree's rows in each part give the numbers.
    """
    order = ["_tree", "doc_id", "leaf", "_row"]
    rows = stored(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    own = Window.partitionBy("_tree")
    spans = rows.groupBy("_tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = stored(spans.select("_tree", "_part", "_first", before.alias("_before"), F.sum("_rows").over(own).alias("_size")))
    out = rows.join(spans, ["_tree", "_part"]).withColumn("_n", F.col("_before") + F.col("_at") - F.col("_first"))
    return out.select("_tree", "_part", "_n", "_size", "doc_id", "leaf", "changed"), spans


def _hashed_up(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """Nodes of each level, the given ones first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([_hex("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def _blocks(fanout: int, most: int):
    def made(held: list[pa.RecordBatch]) -> dict:
        rows = pa.Table.from_batches(held)
        first = {n: rows[n][0].as_py() for n in ("_tree", "_block", "_part", "_size")}
        leaves = rows["leaf"].to_pylist()
        changed = [c or x for c, x in zip(rows["changed"].to_pylist(), leaves, strict=True)]
        top = _hashed_up(leaves, min(most, levels_of(first["_size"], fanout)), fanout)[-1]
        return first | {"node": top[0], "ids": rows["doc_id"].to_pylist(), "leaves": bytes.fromhex("".join(leaves)), "changed": bytes.fromhex("".join(changed))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = pa.list_(batch.schema.field("doc_id").type)
            schema = pa.schema([("_tree", pa.string()), ("_block", pa.int64()), ("_part", pa.int64()), ("_size", pa.int64()), ("node", pa.string()), ("ids", ids), ("leaves", pa.binary()), ("changed", pa.binary())])
            keys = [batch.column(batch.schema.get_field_index(n)) for n in ("_tree", "_block")]
            moved = pc.or_(*[pc.not_equal(k[1:], k[:-1]) for k in keys])
            starts = [0, *[i + 1 for i in pc.indices_nonzero(moved).to_pylist()], batch.num_rows]
            done = []
            for a, b in zip(starts, starts[1:], strict=False):
                part = batch.slice(a, b - a)
                if held and any(part[n][0] != held[0][n][0] for n in ("_tree", "_block")):
                    done.append(made(held))
                    held = []
                held.append(part)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([made(held)], schema=schema)

    return run


def blocks_of(rows: DataFrame, fanout: int, most: int) -> DataFrame:
    """One row for each block of fanout**most leaves: its ids, leaves, changed leaves and the root of its subtree."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    own = rows.withColumn("_block", F.expr(f"_n div {fanout**most}")).repartition("_tree", "_block").sortWithinPartitions("_tree", "_block", "_n")
    return own.mapInArrow(_blocks(fanout, most), f"_tree string, _block bigint, _part bigint, _size bigint, node string, ids array<{kind}>, leaves binary, changed binary")


# ---- the butterfly


def _trees(spans: DataFrame, fanout: int, most: int) -> DataFrame:
    """One row for each tree: its number _k in the order of trees, its blocks and the blocks ahead of it."""
    first = spans.filter("_before = 0").withColumn("_blocks", F.ceil(F.col("_size") / fanout**most).cast("long"))
    prior = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = first.groupBy("_part").agg(F.count("*").alias("_t"), F.sum("_blocks").alias("_b"))
    parts = parts.select("_part", prior("_t", Window.orderBy("_part")).alias("_t"), prior("_b", Window.orderBy("_part")).alias("_b"))  # a row for each part at most
    inside = Window.partitionBy("_part").orderBy("_first")
    return first.join(parts, "_part").select("_tree", "_size", "_blocks", (F.col("_t") + F.row_number().over(inside) - 1).alias("_k"), (F.col("_b") + prior("_blocks", inside)).alias("_ahead"))


def _with_lanes(trees: DataFrame, levels: int, fanout: int) -> DataFrame:
    """trees with _lanes: for each level above them, the blocks of the own subtree, the most that a sibling has, and the own first lane."""
    numbers = F.array(*[F.expr(f"_k div {fanout**j}") for j in range(levels)]) if levels else F.array().cast("array<bigint>")
    rows = trees.select("_k", "_blocks", "_ahead", F.posexplode(numbers).alias("_j", "_q"))
    sizes = rows.groupBy("_j", "_q").agg(F.sum("_blocks").alias("have"), F.min("_ahead").alias("_from"))
    sizes = sizes.withColumn("most", F.max("have").over(Window.partitionBy("_j", F.expr(f"_q div {fanout}"))))
    lanes = rows.join(sizes, ["_j", "_q"]).groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("_j", "have", "most", (F.col("_ahead") - F.col("_from")).alias("lane")))).alias("_lanes"))
    return trees.join(lanes, "_k", "left")


def _round(state: DataFrame, keys: list[Column], sub: Column, lane: Column, have: Column, most: Column, active: Column | None = None) -> DataFrame:
    """One exchange: blocks with the same keys and lane swap nodes, hash their parent and note the siblings; others stay as they are."""
    kept = [c for c in state.columns if c not in ("node", "path")]
    active = F.lit(True) if active is None else active
    sent = state.withColumns({"_sub": sub, "_lane": lane, "_have": have, "_most": most, "_active": active, **{f"_key{i}": k for i, k in enumerate(keys)}})
    sent = sent.withColumn("_to", F.explode(F.when(F.col("_active"), F.sequence("_lane", F.col("_most") - 1, "_have")).otherwise(F.array("_lane"))))
    own = F.when(F.col("_to") == F.col("_lane"), F.struct(*kept, "path", "_active"))  # a copy brings its node alone
    met = sent.groupBy(*[f"_key{i}" for i in range(len(keys))], "_to").agg(F.sort_array(F.collect_list(F.struct("_sub", "node", own.alias("own")))).alias("met"))
    joined = lambda members: F.array_join(F.transform(members, lambda m: m["node"]), "")
    met = met.select("met", F.sha2(joined(F.col("met")), 256).alias("up"), F.explode(F.filter("met", lambda m: m["own"].isNotNull())).alias("me"))
    left = joined(F.filter("met", lambda m: m["_sub"] < F.col("me._sub")))
    right = joined(F.filter("met", lambda m: m["_sub"] > F.col("me._sub")))
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    is_active = F.col("me.own._active")
    return met.select(*[F.col(f"me.own.{c}").alias(c) for c in kept], F.when(is_active, F.col("up")).otherwise(F.col("me.node")).alias("node"), F.when(is_active, F.concat("me.own.path", step)).otherwise(F.col("me.own.path")).alias("path"))


def upper_proofs(blocks: DataFrame, spans: DataFrame, fanout: int, most: int) -> DataFrame:
    """(_tree, _block, subroot, root, path): what each block learns in the exchange; path holds the siblings above the block, level by level."""
    trees = stored(_trees(spans, fanout, most))
    n, largest = trees.agg(F.count("*"), F.max("_size")).first()
    tops = levels_of(n, fanout)
    where = spans.select("_tree", "_part").join(_with_lanes(trees, tops, fanout), "_tree").drop("_size", "_ahead")
    state = blocks.select("_tree", "_part", "_block", "_size", "node").join(where, ["_tree", "_part"]).drop("_part")
    state = state.select("_tree", "_block", "_blocks", "_k", "_lanes", (_levels("_size", fanout) - most).alias("_rounds"), "node", F.array().cast(_PATH).alias("path"))
    for j in range(max(0, levels_of(largest or 0, fanout) - most)):
        reach = fanout**j
        active, q = F.col("_rounds") > j, F.expr(f"_block div {reach}")
        parent = F.when(active, F.expr(f"_block div {reach * fanout}")).otherwise(-1 - F.col("_block"))
        have = F.least(F.lit(reach), F.col("_blocks") - q * reach)
        state = _round(state, [F.col("_tree"), parent], q % fanout, F.when(active, F.col("_block") % reach).otherwise(0), have, F.when(q % fanout > 0, F.lit(reach)).otherwise(have), active)
    state = state.select("_tree", "_block", "_k", "_lanes", F.col("node").alias("subroot"), "node", "path")
    for j in range(tops):
        at = F.col("_lanes")[j]
        state = _round(state, [F.expr(f"_k div {fanout ** (j + 1)}")], F.expr(f"_k div {fanout**j} % {fanout}"), at["lane"] + F.col("_block"), at["have"], at["most"])
    return state.select("_tree", "_block", "subroot", F.col("node").alias("root"), "path")


def _proven(fanout: int, most: int, with_proof: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = {n: batch.column(batch.schema.get_field_index(n))[row].as_py() for n in ("_size", "leaves", "changed", "subroot", "root", "path")}
                ids = batch.column(batch.schema.get_field_index("ids"))[row].values
                cut = lambda raw: [raw[i : i + 32].hex() for i in range(0, len(raw), 32)]
                leaves, changed = cut(b["leaves"]), cut(b["changed"])
                nodes = _hashed_up(leaves, min(most, levels_of(b["_size"], fanout)), fanout)
                above = [(p["left"], p["right"]) for p in b["path"]]
                rest = ["".join(x + y for x, y in above)]
                for level in nodes[-2::-1]:
                    rest = ["".join(level[i - i % fanout : i] + level[i + 1 : i - i % fanout + fanout]) + rest[i // fanout] for i in range(len(level))]
                folded, proofs = [], []
                for k, h in enumerate(changed):
                    steps, i = [], k
                    for level in nodes[:-1]:
                        a = i - i % fanout
                        steps.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
                        i //= fanout
                    steps += above
                    for x, y in steps:
                        h = _hex(x + h + y)
                    folded.append(h)
                    if with_proof:
                        proofs.append([{"left": x, "right": y} for x, y in steps])
                n = len(leaves)
                columns = [ids, pa.array(leaves), pa.array([b["subroot"]] * n), pa.array([b["root"]] * n), pa.array([_hex(r) for r in rest]), pa.array(folded), pa.array([f == b["root"] for f in folded])]
                if with_proof:
                    columns.append(pa.array(proofs, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def manifest(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS, changed: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS, with_proof: bool = False) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, proof.

    `changed` gives other values of some fields, as a reader may find them;
    folded_root is made of the leaf of those values (null in none of them: the
    row's own) and the untouched siblings, and verified tells whether it is the
    root. proof_sha256 is the hash of all siblings, level by level.

    Null fields count as `-`; a null source is a tree of its own, ahead of the
    others; null ids come first in their tree. Equal ids go by leaf; repeated
    rows are leaves of their own. An empty table gives an empty result. Columns
    that are no field are ignored. Ids are integers or strings.
    """
    quoted = lambda c: F.col(f"`{c}`")
    seen = changed or {}
    other = leaf_of([seen.get(c, quoted(c)) for c in fields])
    rows = df.select(F.coalesce(F.concat(F.lit("1"), quoted(source_col).cast("string")), F.lit("0")).alias("_tree"), quoted(id_col).alias("doc_id"), leaf_of([quoted(c) for c in fields]).alias("leaf"), (other if seen else F.lit(None).cast("string")).alias("changed"))
    rows = rows.withColumn("changed", F.when(F.col("changed") != F.col("leaf"), F.col("changed")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    leaves, spans = numbered(stored(rows.withColumn("_row", F.monotonically_increasing_id())))
    blocks = stored(blocks_of(leaves, fanout, block_levels))
    found = upper_proofs(blocks, spans, fanout, block_levels)
    both = blocks.select("_tree", "_block", "_size", "ids", "leaves", "changed").join(found, ["_tree", "_block"])
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * with_proof
    kinds = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", proof {_PATH}" * with_proof
    return both.mapInArrow(_proven(fanout, block_levels, with_proof, names), kinds)


def without_line_feeds(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """The change that the query looks for: no line feeds in texts whose id has an even crc32."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return {text_col: F.when(even, F.translate(F.col(text_col), "\n", "")).otherwise(F.col(text_col))}


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(map(_field_sql, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs {name} (t, level, i, h) of all nodes above leaves (t, i, h), and {name}_s with the siblings to the left and right of each."""
    return f"""{name} AS (SELECT t, 0 AS level, i, h FROM ({leaves}) UNION ALL
 SELECT t, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY t) AS c FROM {name}) WHERE c > 1 GROUP BY t, level, i // 3),
{name}_s AS (SELECT a.t, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
 FROM {name} a JOIN {name} b ON b.t = a.t AND b.level = a.level AND b.i // 3 = a.i // 3 WHERE a.level < (SELECT max(level) FROM {name} z WHERE z.t = a.t) GROUP BY ALL),
{name}_r AS (SELECT t, max_by(h, level) AS h FROM {name} GROUP BY 1)"""


ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('1' || source, '0') AS t, {_leaf_sql('text')} AS leaf, {_leaf_sql("CASE WHEN " + crc32_sql('doc_id::VARCHAR') + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS other FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{_tree_sql('a', 'SELECT t, i, leaf AS h FROM n')},
k AS (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS i FROM a_r),
{_tree_sql('b', "SELECT 'all' AS t, i, h FROM k")},
p AS (SELECT n.t, n.i, a_s.level, a_s.l, a_s.r FROM n JOIN a_s ON a_s.t = n.t AND a_s.i = n.i // CAST(3 ** a_s.level AS BIGINT)
 UNION ALL SELECT n.t, n.i, 1000 + b_s.level, b_s.l, b_s.r FROM n JOIN k ON k.t = n.t JOIN b_s ON b_s.i = k.i // CAST(3 ** b_s.level AS BIGINT)),
q AS (SELECT t, i, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256, list({{'l': l, 'r': r}} ORDER BY level) AS steps FROM p GROUP BY ALL),
o AS (SELECT n.doc_id, n.leaf, a_r.h AS subroot, (SELECT h FROM b_r) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
 list_reduce(coalesce(steps, []), lambda x, y: {{'l': sha256(y.l || x.l || y.r), 'r': ''}}, {{'l': n.other, 'r': ''}}).l AS folded_root FROM n JOIN a_r USING (t) LEFT JOIN q ON q.t = n.t AND q.i = n.i)
SELECT *, folded_root = root AS verified FROM o"""
