"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Vectors are compared within a label only. Equal vectors of a label are one
class with a weight. A label with more classes than ``CELL`` gets cells by
spherical k-means, fitted on a bounded sample (``SAMPLE`` vectors over all
labels, ``MOST_CELLS`` centroids); every class is assigned by its largest
cosine. A class also visits the other cells that could hold a partner: linked
unit vectors are at most ``sqrt(2 - 2 t)`` apart, so a vector whose margin
between its own centroid and another exceeds that reach times the centroids'
distance has no partner there. Hence no link is lost.

A cell's members and visitors are cut into blocks of bounded size, and each
pair of blocks is one matrix product in one task. A task adds up the weights of
each visitor's links and hands on one link per node (stars around the smallest
node of each local group), never all pairs.

Cases: a null label, and a vector that is null, empty, zero or holds null or
non-finite components link with nothing; vectors of different length never
link; repeated rows are links of one another; an id that is null takes its
component's id, if any; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnscore.llm import words as W
from turnscore.llm.components import connected_components
from turnscore.session import reliable_checkpoint

THRESHOLD = 0.98
CELL = 2048
BLOCK = 2048
SAMPLE = 20_000
MOST_CELLS = 8192
ROUNDS = 8


def usable(vector: Column, label: Column) -> Column:
    """Whether a row can link at all."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(flat: np.ndarray, size: int) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = flat.reshape(-1, size).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors; starts from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        c[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    return c


def fit_cells(classes: DataFrame) -> dict[tuple, np.ndarray]:
    """Centroids of each (label, length) with more than ``CELL`` classes."""
    sizes = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL)
    sizes = sizes.orderBy(F.desc("n"), "label", "size").limit(MOST_CELLS // 2).collect()
    total = sum(r["n"] for r in sizes)
    if not total:
        return {}
    steps = 1 << 30
    share = min(1.0, SAMPLE / total)
    drawn = classes.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(steps)) < int(share * steps))
    wanted = classes.sparkSession.createDataFrame([(r["label"], r["size"]) for r in sizes], classes.select("label", "size").schema)
    rows = drawn.join(F.broadcast(wanted), ["label", "size"]).select("label", "size", "vector").toArrow()
    found: dict[tuple, list] = {}
    for label, size, vector in zip(rows["label"].to_pylist(), rows["size"].to_pylist(), rows["vector"].to_pylist()):
        found.setdefault((label, size), []).append(vector)
    cells = max(1, total // CELL)
    shrink = min(1.0, MOST_CELLS / 2 / cells)
    out = {}
    for r in sizes:
        own = found.get((r["label"], r["size"]), [])
        k = min(len(own), max(2, int(np.ceil(r["n"] / CELL * shrink))))
        if k > 1:
            x = unit(np.array(sorted(own), np.float64), r["size"])
            out[(r["label"], r["size"])] = spherical_kmeans(x, k)
    return out


def visits(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's home) of all cells that rows visit."""
    s = x @ centroids.T
    home = s.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    near = s[np.arange(len(x)), home][:, None] - s <= reach * apart[home] + 1e-9
    row, cell = np.nonzero(near)
    return row, cell, cell == home[row]


def assign(classes: DataFrame, cells: dict[tuple, np.ndarray], threshold: float) -> DataFrame:
    """A row per class and visited cell."""
    shared = classes.sparkSession.sparkContext.broadcast(cells)
    reach = float(np.sqrt(2 - 2 * threshold))
    schema = classes.select("label", "size", "node", "vector", "weight").schema.simpleString()[7:-1].replace(":", " ")

    def run(batches):
        for batch in batches:
            label, size = batch.column("label").to_pylist(), batch.column("size").to_numpy()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(label, size.tolist())):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                own = batch.take(pa.array(at))
                c = shared.value.get(key)
                if c is None:
                    row, cell, home = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
                else:
                    row, cell, home = visits(unit(own.column("vector").flatten().to_numpy(), key[1]), c, reach)
                got = own.take(pa.array(row))
                yield pa.record_batch([*got.columns, pa.array(cell, pa.int32()), pa.array(home)], names=[*got.schema.names, "cell", "home"])

    return classes.select("label", "size", "node", "vector", "weight").mapInArrow(W.lean(run), f"{schema}, cell int, home boolean")


def _compare(threshold: float):
    """One pair of blocks: links of the visitors to the home members."""

    def run(key, table: pa.Table) -> pa.Table:
        at_home = table["at_home"].to_numpy(zero_copy_only=False).astype(bool)
        size = table["size"][0].as_py()
        x = unit(table["vector"].combine_chunks().flatten().to_numpy(), size)
        names = np.array(table["node"].to_pylist(), object)
        weight = table["weight"].to_numpy()
        h, v = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        linked = x[v] @ x[h].T >= threshold
        linked &= names[v][:, None] != names[h][None, :]
        links = linked @ weight[h]
        rows = np.flatnonzero(linked.any(axis=1))
        columns = np.flatnonzero(linked.any(axis=0))
        part = linked[np.ix_(rows, columns)]
        _, number = np.unique(np.concatenate([names[v[rows]], names[h[columns]]]), return_inverse=True)
        order = np.concatenate([names[v[rows]], names[h[columns]]])
        best = number.astype(np.int64)  # smallest node known so far, by rank of the name
        k = len(rows)
        while len(rows):
            old = best.copy()
            far = len(order) + 1
            best[:k] = np.minimum(best[:k], np.where(part, best[k:], far).min(axis=1))
            best[k:] = np.minimum(best[k:], np.where(part, best[:k, None], far).min(axis=0))
            least = np.full(number.max() + 1, far)
            np.minimum.at(least, number, best)  # a node may stand on both sides
            best = least[number]
            if (best == old).all():
                break
        name_of = dict(zip(number.tolist(), order.tolist()))
        hub = [name_of[b] for b in best[:k].tolist()] if k else []
        hubs_home = [name_of[b] for b in best[k:].tolist()] if k else []
        node = [*names[v[rows]].tolist(), *names[h[columns]].tolist()]
        return pa.table({
            "node": pa.array(node, pa.binary()), "hub": pa.array(hub + hubs_home, pa.binary()),
            "links": pa.array(np.r_[links[rows], np.zeros(len(columns), np.int64)].astype(np.int64), pa.int64()),
        })

    return run


def compare_cells(placed: DataFrame, threshold: float) -> DataFrame:
    """(node, hub, links) from every pair of blocks of every cell."""
    place = ["label", "size", "cell"]
    counts = placed.groupBy(*place).agg(
        F.ceil(F.sum(F.col("home").cast("long")) / BLOCK).cast("int").alias("hb"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("vb")
    ).where("hb > 0")
    rows = placed.join(counts, place)
    spot = F.xxhash64("node")
    visitors = rows.withColumn("at_home", F.lit(False)).withColumn("v", F.pmod(spot, F.col("vb")).cast("int")).withColumn(
        "h", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)))
    homes = rows.where("home").withColumn("at_home", F.lit(True)).withColumn("h", F.pmod(spot, F.col("hb")).cast("int")).withColumn(
        "v", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))
    columns = [*place, "h", "v", "at_home", "node", "vector", "weight"]
    both = visitors.select(*columns).unionByName(homes.select(*columns))
    return both.groupBy(*place, "h", "v").applyInArrow(W.lean2(_compare(threshold)), "node binary, hub binary, links long")


def dedup(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, ``n_links`` (other rows linked directly), ``component_id`` (the
    smallest id that links reach) and ``kept`` (the row names its component)."""
    rows = vectors.select(
        F.col(f"`{id_column}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")
    ).withColumn("ok", usable(F.col("vector"), F.col("label")))
    good = rows.where("ok").select("id", "label", F.xxhash64("label", "vector").alias("k1"), F.xxhash64("vector", "label", F.lit(2)).alias("k2"), "vector")
    classes = good.groupBy("label", "k1", "k2").agg(
        F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least")
    ).withColumn("size", F.size("vector")).withColumn("node", F.unhex(F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))))
    classes = reliable_checkpoint(classes)
    found = reliable_checkpoint(compare_cells(assign(classes, fit_cells(classes), threshold), threshold))
    component = connected_components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.select("k1", "k2", "node", "weight", "least").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "component").join(links, "node", "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "component_id"
    )
    linked = good.select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_column), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
