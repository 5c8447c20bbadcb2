"""Retrieval of rated examples: J9, J10, J11, J12, T4.

Exact k-nearest neighbours (squared L2, ties by id) with the triangle inequality
instead of all distances:

* Pivots are store vectors drawn by a hash of their ids (a bounded number, about
  four times the root of the store). Every store vector lies in the cell of its
  nearest pivot; a cell has a least and a largest distance from its pivot.
* A query's distances to the pivots bound its k-th neighbour from above (the k-th
  nearest pivot; the cells that hold k vectors for sure), and every cell from
  below (its shell around the pivot; half the detour over the plane between two
  pivots). A query visits just the cells whose lower bound is not above its
  upper bound.
* Cells are put together to blocks of bounded size (a larger cell is cut), and a
  query is sent once to every block that holds a cell for it, not once to every
  cell: vectors without clusters visit all cells, and then rows by cell would grow
  with the power 1.5 of the table. Blocks and parties of their visitors meet in
  one task (``cogroup``), where a BLAS product screens the pairs against each
  query's bound, what passes is computed directly, and the bound shrinks to the
  ``k``-th distance found so far. A window per query picks the final ``k``.

Nothing but pivots and cell statistics comes to the driver, both bounded. Memory of
a task is bounded by the sizes of blocks; the number of distances is quadratic
where the vectors have no clusters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnscore.functions.ids import sample_key
from turnscore.operators.identity import written

_CAND = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("ex_id", T.LongType()),
        T.StructField("dist", T.DoubleType()),
        T.StructField("computed", T.LongType()),
    ]
)
#: Most pivots; most vectors of a block and of a party of visitors that meet in one task.
MOST_PIVOTS, STORE_BLOCK, VISIT_BLOCK = 4096, 1 << 16, 1 << 16
#: Small tables are cut into so many blocks, of so many rows at least.
BLOCKS, LEAST_BLOCK = 8, 1024
#: Queries and vectors of one product; distances to pivots held at once; pairs computed, and kept, at once.
TOGETHER, STEP, TO_PIVOTS, PAIRS, KEPT = 2048, 256, 1 << 19, 1 << 15, 1 << 17


def _exact_d2(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    diff = x - q
    return np.einsum("...j,...j->...", diff, diff)


def _best(at: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` smallest (distance, id) of every query ``at``, in order, and their numbers from 0."""
    order = np.lexsort((ids, dist, at))
    at, ids, dist = at[order], ids[order], dist[order]
    row = np.arange(len(at))
    nth = row - np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]][: len(at)], row, 0))
    own = nth < k
    return at[own], ids[own], dist[own], nth[own]


def _vectors(t: pa.Table, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    ids = t[id_col].to_numpy().astype(np.int64)
    return ids, _matrix(t["embedding"].combine_chunks())


def _matrix(vectors) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows x pivots), not below 0; good to about 1e-7 of the vectors' length."""
    d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _exact_distance(x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(_exact_d2(x, pivot))


def pivots_of(store: DataFrame, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the pivots, drawn by a hash of the ids."""
    if n is None:
        n = min(MOST_PIVOTS, 4 * math.isqrt(store.count()) + 1)
    drawn = store.select("ex_id", "embedding").orderBy(F.xxhash64(F.lit("pivot"), "ex_id"), "ex_id").limit(n).toArrow()
    return _vectors(drawn, "ex_id")


def in_cells(store: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The store with each vector's cell and its distance ``d`` from the cell's pivot."""
    shared = store.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = shared.value
        rows = max(16, TO_PIVOTS // len(p))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = _matrix(part.column("embedding"))
                cell = _to_pivots(x, p).argmin(axis=1)
                yield pa.record_batch([*part.columns, pa.array(cell, pa.int32()), pa.array(_exact_distance(x, p[cell]))], names=[*part.schema.names, "cell", "d"])

    schema = T.StructType([*store.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())])
    return store.mapInArrow(run, schema)


def reach_and_visits(q: np.ndarray, qids: np.ndarray, ids: np.ndarray, pivots: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, k: int,
                     exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For queries: an upper bound of the distance of the k-th neighbour, the
    distances to the pivots, and which cells (``n`` vectors each between ``low``
    and ``high`` from the pivot) can hold a neighbour within it. Rounding is
    allowed for, always to the safe side."""
    d = _to_pivots(q, pivots)
    slack = 1e-6 * (1.0 + np.sqrt(np.einsum("ij,ij->i", q, q)) + np.sqrt(np.einsum("ij,ij->i", pivots, pivots).max()))[:, None]
    known = np.where(ids[None] == qids[:, None], np.inf, d) if exclude_self else d
    reach = np.partition(known, k - 1, axis=1)[:, k - 1] if k <= known.shape[1] else np.full(len(q), np.inf)
    far = np.where(n[None] > 0, d + high[None], np.inf)
    order = np.argsort(far, axis=1)
    held = np.cumsum(n[order], axis=1) >= k + exclude_self
    enough = held.argmax(axis=1)
    sure = np.where(held.any(axis=1), np.take_along_axis(far, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0], np.inf)
    reach = np.minimum(reach, sure) + slack[:, 0]
    shell = np.maximum(d - high[None], low[None] - d)
    plane = (d - d.min(axis=1, keepdims=True)) / 2
    return reach, d, (n[None] > 0) & (np.maximum(shell, plane) <= reach[:, None] + slack)


def groups_of(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of cells (``n`` vectors each) with up to ``size`` vectors together: the
    first cell of every run, and into how many pieces it is cut (more than one
    only where it is a single larger cell)."""
    starts, pieces, held = [], [], 0
    for cell, m in enumerate(int(m) for m in n):
        if not starts or held + m > size:
            starts.append(cell)
            pieces.append(max(1, -(-m // size)))
            held = m
        else:
            held += m
    return np.array(starts), np.array(pieces)


def _visits(k: int, exclude_self: bool, shared):
    """Per query the bound, its nearest pivot and the runs of cells to visit."""

    def run(batches):
        ids, pivots, n, low, high, starts = shared.value
        rows = max(16, TO_PIVOTS // len(pivots))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                q, qids = _matrix(part.column("embedding")), part.column("query_id").to_numpy()
                reach, d, visited = reach_and_visits(q, qids, ids, pivots, n, low, high, k, exclude_self)
                row, group = np.nonzero(np.logical_or.reduceat(visited, starts, axis=1))
                ends = np.searchsorted(row, np.arange(len(q) + 1)).astype(np.int32)
                groups = pa.ListArray.from_arrays(pa.array(ends), pa.array(group, pa.int32()))
                yield pa.record_batch([*part.columns, pa.array(d.argmin(axis=1), pa.int32()), pa.array(d.min(axis=1)), pa.array(reach), groups],
                                      names=["query_id", "embedding", "home", "near", "reach", "groups"])

    return run


def _repeats(ids: np.ndarray, x: np.ndarray, cell: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Which rows (by cell, distance, id) cannot be neighbours, since ``k + 1``
    smaller ids have an equal vector."""
    same = (cell[1:] == cell[:-1]) & (d[1:] == d[:-1])
    maybe = np.flatnonzero(same)
    for at in range(0, len(maybe), PAIRS):
        i = maybe[at : at + PAIRS]
        same[i] = (x[i + 1] == x[i]).all(axis=1)
    nth = np.cumsum(np.r_[0, ids[1:] != ids[:-1]])
    first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(ids)), 0))
    return nth - nth[first] > k


def _search(qids, q, near, reach, sids, x, cell, d, pivots, k: int, exclude_self: bool):
    """(query's row, id, distance, number from 0) of the ``k`` best vectors of a
    block within reach for up to ``TOGETHER`` queries, and how many distances
    each took. The block is ordered by cell and distance from the pivot.

    A product ``|x|^2 - 2 x.q`` screens the pairs with an allowance for rounding;
    the distances of those that pass are computed directly, so nothing is lost."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    ends = np.r_[starts[1:], len(cell)]
    points = pivots[cell[starts]]
    xx, qq = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    to = _to_pivots(points, q)  # cells x queries
    low, high = d[starts][:, None], d[ends - 1][:, None]
    least = np.maximum(np.maximum(to - high, low - to), (to - near) / 2)
    slack = 1e-6 * (1.0 + np.sqrt(qq) + np.sqrt(np.einsum("ij,ij->i", points, points).max()))
    error = 1e-9 * (xx.max() + qq) + 1e-12
    bound = (reach + slack) ** 2
    twice, computed = -2.0 * q, np.zeros(len(q), np.int64)
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    found, held = [], 0

    def merged():
        at, ids, dist = (np.concatenate([best[i], *[f[i] for f in found]]) for i in range(3))
        kept = _best(at, ids, dist, k)
        last = kept[3] == k - 1
        bound[kept[0][last]] = np.minimum(bound[kept[0][last]], kept[2][last])
        return kept

    for c in np.argsort(least.mean(axis=1)):
        who = np.flatnonzero(least[c] <= np.sqrt(bound) + slack)
        if not len(who):
            continue
        computed[who] += ends[c] - starts[c]
        factor = (twice if len(who) == len(q) else twice[who]).T
        for a in range(starts[c], ends[c], STEP):
            b = min(a + STEP, ends[c])
            screen = x[a:b] @ factor
            screen += xx[a:b, None]
            row, column = np.nonzero(screen <= (bound + error - qq)[who])
            for at in range(0, len(row), PAIRS):
                i, j = a + row[at : at + PAIRS], who[column[at : at + PAIRS]]
                dist = _exact_d2(x[i], q[j])
                own = dist <= bound[j]
                if exclude_self:
                    own &= sids[i] != qids[j]
                found.append((j[own], sids[i[own]], dist[own]))
                held += len(found[-1][0])
                if held > KEPT:
                    best = merged()
                    found, held = [], 0
    best = merged()
    return best, computed


def _meet(k: int, exclude_self: bool, shared):
    """Visitors and vectors of one block: each query's ``k`` best, and how many
    distances were computed for it."""

    def run(queries: pa.Table, store: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and store.num_rows:
            pivots = shared.value[1]
            sids, x = _vectors(store, "ex_id")
            cell, d = store["cell"].to_numpy(), store["d"].to_numpy()
            order = np.lexsort((sids, d, cell))
            order = order[~_repeats(sids[order], x[order], cell[order], d[order], k)]
            sids, x, cell, d = sids[order], x[order], cell[order], d[order]
            queries = queries.sort_by([("home", "ascending"), ("query_id", "ascending")])
            for at in range(0, queries.num_rows, TOGETHER):
                part = queries.slice(at, TOGETHER)
                qids, q = _vectors(part, "query_id")
                (row, ids, dist, nth), computed = _search(qids, q, part["near"].to_numpy(), part["reach"].to_numpy(), sids, x, cell, d, pivots, k, exclude_self)
                none = np.setdiff1d(np.flatnonzero(computed), row)  # carry counts only
                found.append((qids[row], ids, dist, np.where(nth == 0, computed[row], 0)))
                found.append((qids[none], np.zeros(len(none), np.int64), np.full(len(none), np.inf), computed[none]))
        columns = [np.concatenate([f[i] for f in found]) if found else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, float, np.int64))]
        return pa.table({"query_id": columns[0], "ex_id": columns[1], "dist": columns[2], "computed": columns[3]})

    return run


def candidates(queries: DataFrame, store: DataFrame, k: int, exclude_self: bool = True, pivots: int | None = None,
               query_id: str = "query_id", query_vec: str = "embedding") -> DataFrame:
    """(query_id, ex_id, dist, computed): every query's neighbours within its
    reach (infinitely far rows carry counts only); ``computed`` adds up to the
    number of distances computed, those to pivots included."""
    spark = store.sparkSession
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).alias("embedding"))
    s = store.select(F.col("ex_id").cast("long").alias("ex_id"), "embedding")
    ids, points = pivots_of(s, pivots)
    if not len(ids):
        return spark.createDataFrame([], _CAND)
    s, _ = written(in_cells(s, points))
    n, low, high = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
    for r in s.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect():  # a row per pivot
        n[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]
    starts, pieces = groups_of(n, _block_size(int(n.sum()), STORE_BLOCK))
    shared = spark.sparkContext.broadcast((ids, points, n, low, high, starts))
    vector = dict(q.dtypes)["embedding"]
    visits, seen = written(q.mapInArrow(_visits(k, exclude_self, shared), f"query_id long, embedding {vector}, home int, near double, reach double, groups array<int>"),
                           n=F.count(F.lit(1)))
    size = _block_size(seen["n"], VISIT_BLOCK)
    visitors = {r["g"]: r["count"] for r in visits.select(F.explode("groups").alias("g")).groupBy("g").count().collect()}  # a row per group of cells
    parties = [-(-visitors.get(g, 0) // size) for g in range(len(starts))]
    group = np.searchsorted(starts, np.arange(len(n)), side="right") - 1
    whole, cut = F.get(F.lit(parties), F.col("group")), F.get(F.lit([int(p) for p in pieces]), F.col("group"))
    met = visits.select("query_id", "embedding", "home", "near", "reach", F.explode("groups").alias("group")).select(
        "group", F.explode(F.sequence(F.lit(0), cut - 1)).alias("piece"), F.pmod(F.xxhash64("query_id"), whole).cast("int").alias("party"),
        "query_id", "embedding", "home", "near", "reach")
    held = s.withColumn("group", F.get(F.lit([int(g) for g in group]), F.col("cell"))).where(whole > 0).select(
        "group", F.pmod(F.xxhash64("ex_id"), cut).cast("int").alias("piece"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("party"),
        "ex_id", "embedding", "cell", "d")
    key = ("group", "piece", "party")
    cand = met.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(_meet(k, exclude_self, shared), _CAND)
    counts = visits.select("query_id", F.lit(None).cast("long").alias("ex_id"), F.lit(float("inf")).alias("dist"), F.lit(len(ids)).cast("long").alias("computed"))
    return cand.unionByName(counts)


def _block_size(rows: int, most: int) -> int:
    return min(most, max(LEAST_BLOCK, -(-rows // BLOCKS)))


def nearest(
    queries: DataFrame,
    store: DataFrame,
    k: int,
    exclude_self: bool = True,
    pivots: int | None = None,
    query_id: str = "query_id",
    query_vec: str = "embedding",
) -> DataFrame:
    """Exact top-``k`` store rows per query: ``(query_id, ex_id, dist, rk)``,
    ``rk`` 1..k by (distance, id). Pivots and cells are found when this is
    called (small jobs); ``pivots`` sets their number."""
    cand = candidates(queries, store, k, exclude_self, pivots, query_id, query_vec).where(F.col("dist") < float("inf")).drop("computed")
    w = Window.partitionBy("query_id").orderBy("dist", "ex_id")
    return cand.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def has_qualities(qualities_map: str, wanted: Sequence[str]):
    cond = F.lit(True)
    for q in wanted:
        cond = cond & F.coalesce(F.array_contains(F.map_keys(F.col(qualities_map)), F.lit(q)), F.lit(False))
    return cond


def similar_examples(
    queries: DataFrame, store: DataFrame, n: int, wanted: Sequence[str], exclude_self: bool = True,
    fetch_factor: int = 3,
) -> DataFrame:
    """Fetch ``fetch_factor * n`` nearest, keep those that carry every
    wanted quality, take the first ``n``: ``(query_id, rank, ex_id, dist)``."""
    near = nearest(queries, store, fetch_factor * n, exclude_self)
    flags = store.select(F.col("ex_id").cast("long").alias("ex_id"), has_qualities("qualities", wanted).alias("_ok"))
    kept = near.join(flags, "ex_id").where("_ok")
    w = Window.partitionBy("query_id").orderBy("rk")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(
        "query_id", "rank", "ex_id", "dist"
    )


def with_backup(
    queries: DataFrame, store: DataFrame, n: int, wanted: Sequence[str], exclude_self: bool = True, fetch_factor: int = 3
) -> DataFrame:
    """J9 and J10 over one store in a single search: of the ``fetch_factor * n``
    nearest (2 n at least), the first ``n`` with all wanted qualities are
    chosen; a query left short is topped up with the nearest others. ``(query_id,
    rank, ex_id, dist, source)``."""
    fetch = fetch_factor * n
    near = nearest(queries, store, max(fetch, 2 * n), exclude_self)
    flags = store.select(F.col("ex_id").cast("long").alias("ex_id"), has_qualities("qualities", wanted).alias("_ok"))
    rows = near.join(flags, "ex_id").withColumn("_ok", F.col("_ok") & (F.col("rk") <= fetch))
    before = Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("query_id")
    rows = rows.withColumn("_nth", F.sum(F.col("_ok").cast("int")).over(before))
    rows = rows.withColumn("_in", F.col("_ok") & (F.col("_nth") <= n))
    rows = rows.withColumn("_have", F.sum(F.col("_in").cast("int")).over(whole))
    rows = rows.withColumn("_spare", F.sum((~F.col("_in") & (F.col("rk") <= 2 * n)).cast("int")).over(before))
    fill = ~F.col("_in") & (F.col("rk") <= 2 * n) & (F.col("_spare") <= n - F.col("_have"))
    return rows.where(F.col("_in") | fill).select(
        "query_id", F.when(F.col("_in"), F.col("_nth")).otherwise(F.col("_have") + F.col("_spare")).cast("int").alias("rank"),
        "ex_id", "dist", F.when(F.col("_in"), F.lit("store")).otherwise(F.lit("backup")).alias("source"),
    )


def backup_fill(
    chosen: DataFrame, queries: DataFrame, backup: DataFrame, n: int, exclude_self: bool = True
) -> DataFrame:
    """J10 with a backup store of its own: top up queries with fewer than ``n``
    examples from the backup's nearest rows (not filtered by quality),
    excluding ids already chosen. ``(query_id, rank, ex_id, dist, source)``.
    Where both stores are one, :func:`with_backup` searches once.

    ``chosen`` feeds several branches, so it is written once."""
    from turnscore.session import reliable_checkpoint

    chosen = reliable_checkpoint(chosen)
    have = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("_have"))
    qs = queries.select(F.col("query_id").cast("long").alias("query_id"))
    need = qs.join(have, "query_id", "left").select("query_id", F.coalesce("_have", F.lit(0)).alias("_have"))
    short = need.where(F.col("_have") < n)
    # 2n candidates always leave n after removing the (< n) chosen ones
    near = nearest(queries.join(short.select("query_id"), "query_id", "left_semi"), backup, 2 * n, exclude_self)
    near = near.join(chosen.select("query_id", "ex_id"), ["query_id", "ex_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("dist", "ex_id")
    fill = near.join(short, "query_id").withColumn("_r", F.row_number().over(w))
    fill = fill.where(F.col("_r") <= n - F.col("_have")).select(
        "query_id", (F.col("_have") + F.col("_r")).cast("int").alias("rank"), "ex_id", "dist",
        F.lit("backup").alias("source"),
    )
    return chosen.withColumn("source", F.lit("store")).unionByName(fill)


def example_payload(chosen: DataFrame, store: DataFrame, qualities: Sequence[str]) -> DataFrame:
    """Attach context, response and the wanted ratings (NULL when an
    example lacks the quality)."""
    s = store.select(F.col("ex_id").cast("long").alias("ex_id"), "context", "response", "qualities")
    j = chosen.join(s, "ex_id")
    return j.select(
        *chosen.columns, "context", "response",
        *[F.try_element_at(F.col("qualities"), F.lit(q)).alias(q) for q in qualities],
    )


def sample_examples(df: DataFrame, n: int, seed: int = 42, key: str = "ex_id") -> DataFrame:
    """T4: ``n`` rows without replacement, reproducible under a seed (order
    by ``md5(seed|key)``; a top-n, so each partition sends only n rows)."""
    return df.withColumn("sample_key", sample_key(seed, key)).orderBy("sample_key", key).limit(n)
