"""Classes of nodes from shared buckets and verified links, without expanding buckets into pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the least node of its component.

    Each round takes the least label among the neighbours and then the label's label; rounds grow with the logarithm of
    the diameter. Every round is written to the shared folder."""
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = materialize(least.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "labels")
        changed = not new.where(F.col("old") != F.col("label")).isEmpty()
        labels = new.select("node", "label")
        if not changed:
            release(both)
            return labels


#: Most rounds of random pairs between components of a bucket, and the links a member below which no further one is run.
ROUNDS, WORTH = 6, 0.01


def classes(entries: DataFrame, prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], traits: DataFrame | None = None, possible: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(node, label): the components of the verified links among nodes that share a bucket; nodes without a link are left out.

    entries: (node, bucket). prepare gets the nodes (node) in buckets of two and more, and gives the function that keeps
    the links (a, b) of pairs (a, b). First each bucket's members are held against its center, the member that meets most
    others over all its buckets. Then come rounds for buckets with several components: each member is dealt to one of as
    many places as its bucket has members and held against those of other components at the next place, about one a
    bucket and round. Rounds end once the pairs between components are no more than the members, or links have become
    rare. The pairs from different components that then remain in a bucket are all verified; so every pair that shares a
    bucket is either verified or known to be joined through others.

    traits (node, traits) and possible, a condition on the traits of two nodes that every link meets, keep pairs that
    cannot be links from being made at all in the rounds and after them."""
    entries = materialize(entries.distinct(), "entries")
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = materialize(entries.join(shared, "bucket"), "buckets")
    weight = materialize(crowded.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    centers = crowded.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("c")).select("bucket", F.col("c.node").alias("center"))
    members = crowded.select("bucket", "node")
    verify = prepare(weight.select("node"))
    tried = materialize(members.join(centers, "bucket").where(F.col("node") != F.col("center")).select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b")).distinct(), "tried")
    links = materialize(verify(tried), "links")
    labels = components(links)
    for k in range(ROUNDS):
        mixed, size, between = _mixed(members, labels, traits)
        if between <= size:
            break
        spot = F.pmod(F.xxhash64("bucket", "node", F.lit(k)), "n")
        x, y = _side(mixed.withColumn("spot", spot), "a"), _side(mixed.withColumn("spot", F.pmod(spot + 1, "n")), "b")
        pairs = x.join(y, (x["spot"] == y["spot"]) & _between(x, y, possible)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "tried")
        found = materialize(verify(new), "links")
        n_found = found.count()
        tried = tried.unionByName(new)
        if n_found:
            links = links.unionByName(found)
            labels = components(links)
        release(mixed)
        if n_found < WORTH * size:
            break
    mixed, _, _ = _mixed(members, labels, traits)
    x, y = _side(mixed, "a"), _side(mixed, "b")
    cross = x.join(y, _between(x, y, possible) & (x["a"] < y["b"])).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    more = materialize(verify(cross), "links")
    release(entries, crowded, mixed)
    return labels if more.isEmpty() else components(links.unionByName(more))


def _side(mixed: DataFrame, name: str) -> DataFrame:
    return mixed.withColumnRenamed("node", name).withColumnRenamed("label", f"{name}_label").withColumnRenamed("traits", f"{name}_traits")


def _between(x: DataFrame, y: DataFrame, possible: Callable[[Column, Column], Column] | None) -> Column:
    apart = (x["bucket"] == y["bucket"]) & (x["a_label"] != y["b_label"])
    return apart if possible is None else apart & possible(x["a_traits"], y["b_traits"])


def _mixed(members: DataFrame, labels: DataFrame, traits: DataFrame | None) -> tuple[DataFrame, int, int]:
    """(bucket, node, label, n, traits) of the members of buckets with several components, n members; their number; the pairs of different components among them."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = named.groupBy("bucket", "label").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.sum("m").alias("n"), F.count("*").alias("several"), F.sum(F.col("m") * F.col("m")).alias("same"))
    counts = materialize(counts.where("several > 1"), "mixed-counts")
    size, between = counts.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()
    found = named.join(counts.select("bucket", "n"), "bucket").select("bucket", "node", "label", "n")
    return materialize(found if traits is None else found.join(traits, "node"), "mixed"), size or 0, int(between or 0)
