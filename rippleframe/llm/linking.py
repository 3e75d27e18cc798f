"""Connected groups from buckets, without listing the pairs of a bucket.

Members that share a bucket are candidates. A bucket first links its members to
one of them, another one in each bucket (a star); where members of a bucket
still lie in different groups, those outside its largest group are tried with a
few of that group. Only what then is left outside meets the members of the other
groups. So a bucket of many copies costs a few pairs for each member, and yet
every candidate pair is either checked or already connected: the groups are
those of all links. Later links join groups, not members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.llm.tables import discard, map_arrow, stored

Check = Callable[[DataFrame], DataFrame]
Near = Callable[[F.Column, F.Column], F.Column]


#: Links that one task may join: two ids each, some tens of MB.
LINKS_A_TASK = 500_000


def _joined_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label) of all links (a, b) of a partition, by smallest neighbours with pointer jumping."""
    links = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if links is None or not links.num_rows:
        return
    ids = pa.chunked_array([*links["a"].chunks, *links["b"].chunks]).unique()
    ids = ids.take(pc.array_sort_indices(ids))
    a, b = (pc.index_in(links[c], ids).to_numpy() for c in ("a", "b"))
    label, old = np.arange(len(ids)), None
    while old is None or (label != old).any():
        old = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        label = label[label]
    yield pa.RecordBatch.from_arrays([ids, ids.take(pa.array(label))], ["id", "label"])


def components(links: DataFrame, most: int = LINKS_A_TASK) -> DataFrame:
    """(id, label): the smallest id reachable over links (a, b), for every id with a link.

    The links are counted first: up to `most` are joined in one task, more by
    smallest-neighbour rounds with pointer jumping, where every round is a join and a
    partial aggregation, written to the scratch folder. Self-links and repeated
    links do no harm; without links the result is empty.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    if links.count() <= most:
        kind = links.schema["a"].dataType.simpleString()
        return stored(map_arrow(links.coalesce(1), _joined_in_task, f"id {kind}, label {kind}"))
    both = stored(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = stored(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        if not step.filter("label <> old").head(1):
            return step.select("id", "label")
        labels = step.select("id", "label")


def _buckets(members: DataFrame, extra: list[str]) -> DataFrame:
    """(key, id, *extra, centre, centre_traits) of the members of buckets with two ids or more; centres differ between buckets."""
    some = [F.max("anchor").alias("some")] if "anchor" in members.columns else []
    stars = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", "key").alias("order"), "id", *extra)).alias("c"), F.min("id").alias("low"), F.max("id").alias("last"), *some).filter("low < last" + " and some" * len(some))
    stars = stars.select("key", F.col("c.id").alias("centre"), *[F.col("c.traits").alias("centre_traits")] * len(extra))
    return stored(members.select("key", "id", *extra).join(stars, "key"))


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (id, label) after more links (a, b): these connect labels."""
    label = lambda end: groups.select(F.col("id").alias(end), F.col("label").alias(f"label_{end}"))
    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).filter("a <> b").distinct()
    moved = components(between)
    old = groups.union(between.select("a", F.col("a")).union(between.select("b", F.col("b")))).toDF("id", "label").groupBy("id").agg(F.min("label").alias("label"))
    return stored(old.join(moved.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label")))


#: Members of its largest group that a bucket tries with those outside.
TRIED = 4


def linked_groups(members: DataFrame, check: Check, near: Near | None = None, refine: Callable[[DataFrame], tuple[DataFrame, Near]] | None = None, once: bool = False, cross: Callable[[DataFrame], tuple[DataFrame, Near]] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(id, label) of the linked ids among members (key, id), with `traits` if near is given and, at will, `anchor`.

    check keeps those of its stored pairs (a, b), a < b, that are links; near is
    a necessary condition on the traits of two members; with anchors, buckets
    without one are skipped. refine, given the stored (id) of all members of
    buckets that the stars left in several groups,
    returns finer members of them, in whose buckets all their links can be found
    too, with their own near; these take the place of those buckets. cross, given the
    stored (id) of those finer members that still lie in several groups, returns wider
    (id, traits) of them and the near by which they cross. once lets
    members that cross meet in the first bucket they share only; it is meant for
    members of some tens of buckets. pairs (a, b), a < b, are candidates from elsewhere.
    Without pairs and buckets of two ids the result is empty.
    """

    def fits(x: str, y: str, near: Near | None) -> F.Column:
        return near(F.col(x), F.col(y)) if near else F.lit(True)

    def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
        return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    def stars(buckets: DataFrame, near: Near | None) -> DataFrame:
        return ordered(buckets.filter((F.col("id") != F.col("centre")) & fits("traits", "centre_traits", near)), "centre", "id")

    def open_members(buckets: DataFrame, groups: DataFrame, extra: list[str]) -> DataFrame:
        """(key, id, *extra, label, largest) of the buckets whose members lie in several groups."""
        placed = buckets.join(groups, "id", "left").select("key", "id", *extra, F.coalesce("label", "id").alias("label"))
        several = placed.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).getField("label").alias("largest"), F.count("*").alias("labels")).filter("labels > 1")
        return stored(placed.join(several.select("key", "largest"), "key"))

    def closer(buckets: DataFrame, groups: DataFrame, near: Near | None, extra: list[str], tried: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(open members, groups, pairs tried) after members outside the largest group of a bucket have met a few of it."""
        placed = open_members(buckets, groups, extra)
        order = Window.partitionBy("key").orderBy(F.xxhash64("key", "id", F.lit(1)))
        chosen = placed.filter("label = largest").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= TRIED)
        chosen = chosen.select("key", F.col("id").alias("centre"), *[F.col("traits").alias("centre_traits")] * len(extra))
        pairs = placed.filter("label <> largest").join(chosen, "key").filter(fits("traits", "centre_traits", near))
        fresh = stored(ordered(pairs, "centre", "id").join(tried, ["a", "b"], "left_anti"))
        found = stored(check(fresh))
        if found.head(1):
            groups, before = _joined(groups, found), placed
            placed = open_members(before.select("key", "id", *extra), groups, extra)
            discard(before)
        return placed, groups, tried.unionByName(fresh)

    def crossed(placed: DataFrame, near: Near | None, extra: list[str]) -> DataFrame:
        own = ["keys"] if once else []
        if once:
            placed = placed.join(placed.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
        rest = placed.filter("label <> largest").select("key", F.col("id").alias("i"), *[F.col(c).alias(f"i_{c}") for c in ("label", *extra, *own)])
        apart = (F.col("label") != F.col("i_label")) & ((F.col("label") == F.col("largest")) | (F.col("i") < F.col("id")))
        first = F.col("key") == F.array_min(F.array_intersect("keys", "i_keys")) if once else F.lit(True)
        pairs = rest.join(placed, "key").filter(apart & fits("traits", "i_traits", near) & first)
        return ordered(pairs, "i", "id")

    extra = ["traits"] if near else []
    buckets = _buckets(members, extra)
    tried = stars(buckets, near)
    tried = stored(tried if pairs is None else tried.union(pairs.select("a", "b")).distinct())
    groups = components(stored(check(tried)))
    placed, groups, tried = closer(buckets, groups, near, extra, tried)
    discard(buckets)
    if refine:
        finer, finer_near = refine(stored(placed.select("id").distinct()))
        buckets = _buckets(finer, ["traits"])
        fresh = stored(stars(buckets, finer_near).join(tried, ["a", "b"], "left_anti"))
        found = stored(check(fresh))
        groups = _joined(groups, found) if found.head(1) else groups
        finer_placed, groups, tried = closer(buckets, groups, finer_near, ["traits"], tried.unionByName(fresh))
        discard(buckets)
        if cross:
            wider, finer_near = cross(stored(finer_placed.select("id").distinct()))
            finer_placed = finer_placed.drop("traits").join(wider, "id")
        more = crossed(finer_placed, finer_near, ["traits"])
    else:
        more = crossed(placed, near, extra)
    untried = stored(more.distinct().join(tried, ["a", "b"], "left_anti"))
    found = stored(check(untried))
    return _joined(groups, found) if found.head(1) else groups
