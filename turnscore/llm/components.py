"""Connected components of a link table, by alternating large-star and
small-star steps (each a group minimum and a join), until nothing changes.

Tasks first contract their own links by union-find, which leaves at most one
link per node and task. Nothing comes to the driver but two numbers per round;
each round's links are a written table in the shared folder, so a lost
executor costs a re-read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.session import reliable_checkpoint


def contract(links: DataFrame) -> DataFrame:
    """Links (a, b) replaced, task by task, by stars around the smallest node of
    each group of links."""

    def run(batches):
        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > 1_000_000:  # bounded: hand on what there is
                yield _stars(parent, root, schema)
                parent.clear()
        if parent:
            yield _stars(parent, root, schema)

    links = links.select("a", "b")
    schema = pa.schema([(n, _arrow_type(t)) for n, t in links.dtypes])
    return links.mapInArrow(run, links.schema)


def _arrow_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[name]


def _stars(parent: dict, root, schema: pa.Schema) -> pa.RecordBatch:
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    return pa.record_batch(
        [pa.array([p[i] for p in pairs], schema.field(i).type) for i in range(2)], names=["a", "b"]
    )


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b): one row (node, component) per node that has a link to
    another; ``component`` is the smallest node reachable. Links of a node to
    itself or to null are ignored."""
    edges = contract(links.where("a <> b"))
    edges = reliable_checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: every larger neighbour of a node gets the node's smallest neighbour (or the node itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        # small star: a node and its smaller neighbours get the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            down.select("a", F.col("m").alias("b"))
        )
        edges = reliable_checkpoint(small.where("a <> b").distinct())
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("h"), F.sum(F.xxhash64("b", "a") % 999983).alias("g")).first()
        now = (seen["n"], seen["h"], seen["g"])
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
