"""Embedding near-duplicates by an exact metric range join.

Cosine at least t is the same as a distance of at most r = sqrt(2 - 2t) between unit vectors, a metric.

1. Equal vectors become one class with a count, so copies are never paired.
2. Pivots (a hash sample of classes, at most ``MAX_PIVOTS``) split the classes into cells, each class at home with its
   nearest pivot.  A class also visits a cell j when a member of j may be within r of it.  The triangle inequality
   bounds that: d(x, p_j) <= radius_j + r and d(x, p_j) <= d(x, p_i) + 2 r must hold, and, distances to two pivots being
   those of a Euclidean space, (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)) <= r.
3. Cells join independently.  A cell's home members are split into blocks of about ``BLOCK`` and its visitors into blocks
   of about ``VISITORS``, counted per cell, so a task's size is bounded however many vectors share a cell.  A block pair multiplies
   matrices in single precision to find candidates and settles those near the threshold in double precision.
   A visitor meets each linked class in that class's home cell only, so links are counted once.
4. A block pair returns link counts and, per connected group inside it, a star of edges; never the pairs.  Components
   of the stars are the components of the links.

On vectors without structure (uniform on a sphere of many dimensions) no metric bound prunes: each vector then visits most
cells and the join is exact but quadratic, bounded per task.

Cases: null or zero vectors and vectors with null or non-finite components link with nothing, as do vectors of a length of
their own.  Rows repeating a vec_id give one row each; equal vectors under one id link to each other like any two rows.
A null vec_id never links.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import components
from textlab.session import materialize

BLOCK = 8192
VISITORS = 32768
#: Bound of the pivot table that every task holds (pivots x dimensions x 8 bytes).
MAX_PIVOTS = 1024


def _rows(col: pa.Array) -> list[np.ndarray | None]:
    """Arrays without nulls as float64, others None."""
    out = []
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    off, ok = col.offsets.to_numpy(), col.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(col)):
        v = flat[off[i]:off[i + 1]]
        out.append(v if ok[i] and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _vectors(table: DataFrame, vec_col: str, id_col: str) -> DataFrame:
    """``vec_id, vec`` with the vector as float64 bytes, null where it links with nothing (-0.0 counts as 0.0)."""
    src = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))

    def run(it):
        for batch in it:
            vec = [None if v is None else (v + 0.0).tobytes() for v in _rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary())], ["vec_id", "vec"])

    return src.mapInArrow(run, "vec_id long, vec binary")


def _unit(blobs) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * x @ pivots.T))


def _groups(i: np.ndarray, j: np.ndarray, n_left: int, n_right: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the connected groups of a bipartite link list: the smallest left row of each group."""
    left, right = np.arange(n_left), np.full(n_right, n_left)
    while True:
        np.minimum.at(right, j, left[i])
        new = left.copy()
        np.minimum.at(new, i, right[j])
        new = new[new]
        if (new == left).all():
            return left, right
        left = new


def _block_links(home: np.ndarray, visit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home rows, visitor rows) at a cosine of at least ``threshold``, by blocks of the visitors."""
    slack = 1e-5 + 4e-7 * home.shape[1]
    h32 = home.astype(np.float32)
    out_i, out_j = [], []
    for at in range(0, len(visit), 1024):
        v = visit[at:at + 1024]
        s = h32 @ v.astype(np.float32).T
        i, j = np.nonzero(s >= np.float32(threshold - slack))
        close = np.flatnonzero(s[i, j] < threshold + slack)
        keep = np.ones(len(i), bool)
        for k in range(0, len(close), 1 << 16):
            c = close[k:k + (1 << 16)]
            keep[c] = np.einsum("ij,ij->i", home[i[c]], v[j[c]]) >= threshold
        out_i.append(i[keep])
        out_j.append(j[keep] + at)
    return np.concatenate(out_i or [np.empty(0, int)]), np.concatenate(out_j or [np.empty(0, int)])


def range_join(table: DataFrame, threshold: float = 0.95, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row."""
    vectors = materialize(_vectors(table, vec_col, id_col), "vectors")
    usable = vectors.where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull())
    classes = materialize(usable.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
                          .withColumn("dim", F.length("vec")), "classes")
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-9
    tallies = None
    for dim, n in [(r["dim"], r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()]:
        got = _join_dim(classes.where(F.col("dim") == dim), int(n), threshold, radius)
        tallies = got if tallies is None else tallies.unionByName(got)
    if tallies is None:
        tallies = table.sparkSession.createDataFrame([], "id long, n_links long, rep long")
    tallies = materialize(tallies, "tallies")
    links = tallies.groupBy("id").agg(F.sum("n_links").alias("n"))
    groups = components(tallies.where("rep is not null and rep != id").select(F.col("id").alias("src"), F.col("rep").alias("dst")))
    known = materialize(classes.join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
                        .select("vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("component")), "known")
    link = F.when(F.col("vec_id").isNotNull(), F.col("vec"))
    out = vectors.withColumn("vec", link).join(known, "vec", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
                      F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"))


def _dealt(classes: DataFrame, n: int, radius: float) -> DataFrame:
    """Classes of one dimension by the groups in which they meet, ``(cell, block, chunk)``: at home or as visitors."""
    k = max(1, min(MAX_PIVOTS, -(-n // BLOCK)))
    sample = classes.orderBy(F.xxhash64("vec"), "id").limit(k).collect()
    pivots = _unit([bytes(r["vec"]) for r in sample])
    between = _distances(pivots, pivots)

    def home(it):
        for batch in it:
            if not batch.num_rows:
                continue
            d = _distances(_unit(batch.column(1).to_pylist()), pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])],
                                             ["id", "vec", "copies", "cell", "dist"])

    homes = materialize(classes.select("id", "vec", "copies").mapInArrow(home, "id long, vec binary, copies long, cell int, dist double"), "homes")
    # per cell: its radius and how many blocks it has (at most MAX_PIVOTS rows)
    radii, blocks = np.full(k, -np.inf), np.ones(k, np.int64)
    for r in homes.groupBy("cell").agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect():
        radii[r["cell"]], blocks[r["cell"]] = r["r"], -(-r["n"] // BLOCK)

    def reachable(x, cell):
        d = _distances(x, pivots)
        near = d[np.arange(len(d)), cell][:, None]
        gap = np.maximum(between[cell], 1e-12)
        reach = (d <= radii + radius + 1e-6) & (d <= near + 2 * radius + 1e-6) & (d ** 2 - near ** 2 <= 2 * gap * (radius + 1e-6))
        reach[np.arange(len(d)), cell] = True
        return reach & np.isfinite(radii)

    def visitors(it):
        total = np.zeros(k, np.int64)
        for batch in it:
            if batch.num_rows:
                total += reachable(_unit(batch.column(1).to_pylist()), batch.column(3).to_numpy()).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(total)], ["cell", "n"])

    # how many chunks the visitors of a cell make: home rows are written once for each of them
    chunks = np.ones(k, np.int64)
    for r in homes.mapInArrow(visitors, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        chunks[r["cell"]] = max(1, -(-r["n"] // VISITORS))

    def deal(it):
        """Home rows go to every visitor chunk of their block, visitors to every block of the cells they may reach."""
        for batch in it:
            ids, cell = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            if not len(ids):
                continue
            reach = reachable(_unit(batch.column(1).to_pylist()), cell)
            h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            row, to = np.nonzero(reach)
            row, to = np.repeat(row, blocks[to]), np.repeat(to, blocks[to])
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (to[1:] != to[:-1])]) if len(row) else np.empty(0, bool)
            at = np.arange(len(row))
            block = at - np.maximum.accumulate(np.where(first, at, 0))
            chunk = (h[row] % chunks[to].astype(np.uint64)).astype(np.int64)
            mine_row = np.repeat(np.arange(len(ids)), chunks[cell])
            mine_chunk = np.arange(len(mine_row)) - np.repeat(np.cumsum(chunks[cell]) - chunks[cell], chunks[cell])
            mine_block = ((h >> np.uint64(11)) % blocks[cell].astype(np.uint64)).astype(np.int64)[mine_row]
            rows = np.concatenate([row, mine_row])
            task = np.stack([np.concatenate([to, cell[mine_row]]), np.concatenate([block, mine_block]), np.concatenate([chunk, mine_chunk])])
            is_home = np.concatenate([np.zeros(len(row), bool), np.ones(len(mine_row), bool)])
            for i in range(0, len(rows), 8192):
                take = pa.array(rows[i:i + 8192])
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(t[i:i + 8192], pa.int32()) for t in task], pa.array(is_home[i:i + 8192]),
                     *[batch.column(c).take(take) for c in (0, 1, 2)]], ["cell", "block", "chunk", "home", "id", "vec", "copies"])

    return homes.mapInArrow(deal, "cell int, block int, chunk int, home boolean, id long, vec binary, copies long")


def _join_dim(classes: DataFrame, n: int, threshold: float, radius: float) -> DataFrame:
    """``id, n_links, rep`` rows for classes of one dimension: partial link counts and star edges."""

    def join(part: pa.Table) -> pa.Table:
        is_home = part.column("home").to_numpy()
        ids, copies = part.column("id").to_numpy(), part.column("copies").to_numpy()
        at_home, away = np.flatnonzero(is_home), np.flatnonzero(~is_home)
        empty = {"id": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64()), "rep": pa.array([], pa.int64())}
        if not len(at_home) or not len(away):
            return pa.table(empty)
        x = _unit(part.column("vec").to_pylist())
        i, j = _block_links(x[at_home], x[away], threshold)
        other = ids[at_home][i] != ids[away][j]
        i, j = i[other], j[other]
        if not len(i):
            return pa.table(empty)
        count = np.bincount(j, weights=copies[at_home][i], minlength=len(away)).astype(np.int64)
        left, right = _groups(i, j, len(at_home), len(away))
        linked, on = np.unique(i), np.flatnonzero(count)
        rep = ids[at_home]
        return pa.table({"id": np.concatenate([ids[away][on], rep[linked]]), "n_links": np.concatenate([count[on], np.zeros(len(linked), np.int64)]),
                         "rep": np.concatenate([rep[right[on]], rep[left[linked]]])})

    return _dealt(classes, n, radius).groupBy("cell", "block", "chunk").applyInArrow(join, "id long, n_links long, rep long")
