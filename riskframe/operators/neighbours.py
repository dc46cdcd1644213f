"""Exact nearest neighbours and borderline oversampling.

Rows are gathered around a few pivots.  Distances to the pivots bound how far
a row's neighbours can be, so a query visits only the cells that may hold one
(triangle inequality; Lu et al., "Efficient processing of k nearest neighbor
joins using MapReduce", 2012).  Large cells are cut into blocks of rows and of
queries, and each pair of blocks returns at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.scalars import to_double
from riskframe.operators.augment import IS_GENERATED, PARENT, SPLIT
from riskframe.operators.impute import column_medians
from riskframe.operators.ordering import hash_order, hash_unit, running_totals
from riskframe.operators.schema import META_PREFIX
from riskframe.session import shared_folder

MAX_PIVOTS = 128
ROW_BLOCK, QUERY_BLOCK = 20_000, 5_000
PAIRS = 65_536  # candidates ordered at a time


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def choose_pivots(rows: DataFrame, n: int, id_col: str, features: str, seed: int) -> np.ndarray:
    """A fixed small sample of the rows in hash order."""
    k = int(min(MAX_PIVOTS, max(1, n**0.5 / 4)))
    picked = rows.orderBy(hash_order([id_col], f"{seed}#pivot"), id_col).limit(k).select(features).collect()
    return np.array([r[0] for r in picked], dtype=float)


def assign_cells(rows: DataFrame, pivots: np.ndarray, features: str) -> DataFrame:
    """Add the nearest pivot and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cell int, radius double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        if len(x) == 0:
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "radius": pd.Series(dtype=float)})
        d = _distances(_matrix(x), shared.value)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": d[np.arange(len(d)), cell]})

    return rows.withColumn("_n", nearest(features)).select("*", "_n.cell", "_n.radius").drop("_n")


def visited_cells(queries: DataFrame, pivots: np.ndarray, stats: dict, k: int, features: str) -> DataFrame:
    """One row per query and cell that may hold one of its k nearest rows."""
    gaps = _distances(pivots, pivots)
    shared = queries.sparkSession.sparkContext.broadcast((pivots, gaps, stats))

    @F.pandas_udf("array<int>")
    def cells(x: pd.Series) -> pd.Series:
        piv, gap, st = shared.value
        if len(x) == 0:
            return pd.Series([], dtype=object)
        d = _distances(_matrix(x), piv)
        # every listed row is at most (way to its pivot + its radius) away
        reach = np.sort(d[:, st["near_cell"]] + st["near_radius"][None, :], axis=1)
        bound = reach[:, min(k, reach.shape[1]) - 1] if reach.shape[1] >= k else np.full(len(d), np.inf)
        bound = bound * (1 + 1e-9) + 1e-6
        own = d.argmin(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - (d[np.arange(len(d)), own] ** 2)[:, None]) / (2 * gap[own])
        plane = np.where(np.isfinite(plane), plane, 0.0)
        keep = (d - st["radius"][None, :] <= bound[:, None]) & (plane <= bound[:, None]) & (st["size"] > 0)[None, :]
        return pd.Series([np.flatnonzero(row).astype("int32") for row in keep])

    return queries.withColumn("cell", F.explode(cells(features)))


def _cell_stats(celled: DataFrame, n_pivots: int, k: int) -> dict:
    """Size, radius and the k smallest radii of every cell (few hundred numbers)."""
    size, radius = np.zeros(n_pivots), np.zeros(n_pivots)
    for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("r")).collect():
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    w = Window.partitionBy("cell").orderBy("radius")
    near = (celled.select("cell", "radius").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .select("cell", "radius").collect())
    return {"size": size, "radius": radius, "near_cell": np.array([r["cell"] for r in near], dtype=int),
            "near_radius": np.array([r["radius"] for r in near], dtype=float)}


def _block_neighbours(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k nearest other rows of every query of one block, ties by id."""
    x, ids, labels = _matrix(rows["x"]), rows["id"].to_numpy(), rows["label"].to_numpy()
    q_all, q_ids = _matrix(queries["x"]), queries["id"].to_numpy()
    by_id = np.argsort(ids)
    first, last = (np.searchsorted(ids, q_ids, side, sorter=by_id) for side in ("left", "right"))
    largest = np.abs(x).max()
    for start in range(0, len(q_all), 256):
        q = q_all[start:start + 256]
        d = _distances(q, x)
        for i in np.flatnonzero(last[start:start + 256] > first[start:start + 256]):
            d[i, by_id[first[start + i]:last[start + i]]] = np.inf
        if len(ids) > k:
            limit = np.partition(d, k - 1, axis=1)[:, k - 1]
        else:
            limit = np.full(len(q), np.inf)
        slack = 1e-6 * (1.0 + largest + np.abs(q).max())
        # candidates by the fast formula, order by the exact one; a bounded number of pairs at a time
        near = np.isfinite(d) & (d <= (limit + slack)[:, None])
        cuts = np.flatnonzero(np.diff(np.cumsum(near.sum(1)) // PAIRS)) + 1
        for piece in np.split(np.arange(len(q)), cuts):
            at, row = np.nonzero(near[piece])
            exact = np.sqrt(((x[row] - q[piece[at]]) ** 2).sum(1))
            order = np.lexsort((ids[row], exact, at))
            at, row, exact = at[order], row[order], exact[order]
            best = np.arange(len(at)) - np.searchsorted(at, at) < k
            yield pd.DataFrame({"query_id": q_ids[start + piece[at[best]]], "neighbour_id": ids[row[best]],
                                "distance": exact[best], "label": labels[row[best]]})


def nearest_neighbours(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "row_id", features: str = "features",
                       label: str = "y", seed: int = 42) -> DataFrame:
    """Exact k nearest rows of every query: (query_id, rank, neighbour_id, distance, label).

    A row is never its own neighbour; ties go to the smaller id.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(features).alias("x"),
                                F.col(label).cast("int").alias("label"))
    shared_folder(rows.sparkSession)
    rows, queries = pick(rows), pick(queries)
    pivots = choose_pivots(rows, rows.count(), "id", "x", seed)
    celled = assign_cells(rows, pivots, "x").checkpoint()  # read for the sizes, the radii and the blocks
    stats = _cell_stats(celled, len(pivots), k + 1)
    visits = visited_cells(queries, pivots, stats, k + 1, "x")
    asked = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    cells = range(len(pivots))
    row_blocks = F.array(*[F.lit(int(-(-stats["size"][c] // ROW_BLOCK)) or 1) for c in cells])
    query_blocks = F.array(*[F.lit(-(-asked.get(c, 0) // QUERY_BLOCK) or 1) for c in cells])
    share = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    n_rows, n_queries = F.element_at(row_blocks, F.col("cell") + 1), F.element_at(query_blocks, F.col("cell") + 1)
    left = visits.withColumns({"qb": share(n_queries), "rb": F.explode(F.sequence(F.lit(0), n_rows - 1))})
    right = celled.drop("radius").withColumns({"rb": share(n_rows), "qb": F.explode(F.sequence(F.lit(0), n_queries - 1))})
    keys = ["cell", "rb", "qb"]
    schema = "query_id long, neighbour_id long, distance double, label int"

    def join_blocks(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = list(_block_neighbours(q, r, k)) if len(q) and len(r) else []
        return pd.concat(found) if found else pd.DataFrame(
            {"query_id": pd.Series(dtype="int64"), "neighbour_id": pd.Series(dtype="int64"),
             "distance": pd.Series(dtype=float), "label": pd.Series(dtype="int32")})

    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(join_blocks, schema)
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def danger_rows(train: DataFrame, m: int = 10, label: str = "y", **knn) -> DataFrame:
    """Minority rows with their majority neighbours; at least half but not all means danger."""
    minority = train.where(F.col(label) == 1)
    near = nearest_neighbours(minority, train, m, label=label, **knn)
    counts = near.groupBy(F.col("query_id").alias("row_id")).agg(F.count_if(F.col("label") == 0).alias("n_majority"))
    return counts.withColumn("danger", (F.col("n_majority") >= m / 2) & (F.col("n_majority") < m))


def feature_array(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median-imputed features as one array column."""
    medians = {c: 0.0 if v is None else v for c, v in column_medians(train, cols).items()}
    return train.withColumn("features", F.array(*[F.coalesce(to_double(F.col(f"`{c}`")), F.lit(medians[c])) for c in cols]))


def borderline_smote(train: DataFrame, k: int = 5, m: int = 10, seed: int = 42, kind: str = "borderline-1",
                     label: str = "y") -> DataFrame:
    """New minority rows between danger rows and their neighbours, up to class parity.

    ``train`` has row_id, features (array of doubles) and a 0/1 label.  Draw j
    picks a danger row, one of its k nearest minority rows and a point between
    them, all by hashes of j.  With "borderline-2" every second draw uses the
    nearest majority rows instead and stays in the nearer half.
    """
    if kind not in ("borderline-1", "borderline-2"):
        raise ValueError(f"unknown kind: {kind}")
    shared_folder(train.sparkSession)
    train = train.select("row_id", F.col("features").cast("array<double>").alias("features"), F.col(label).cast("int").alias("y")).checkpoint()
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    if len(sizes) < 2:
        raise ValueError(f"only one class in the training part: {sizes}")
    k = min(k, max(1, sizes[1] - 1))
    m = min(m, max(1, sum(sizes.values()) - 1))
    wanted = max(0, sizes[0] - sizes[1])
    minority = train.where(F.col("y") == 1)
    # stored: the numbering, the counts and each further search read them, and none searches for them again
    risky = danger_rows(train, m, seed=seed).where("danger").select("row_id").join(train, "row_id").checkpoint()
    numbered = running_totals(
        risky.withColumn("_h", hash_order(["row_id"], f"{seed}#danger")).withColumn("_b", F.substring("_h", 1, 4)),
        [], ["_b"], ["_h", "row_id"], {"_rn": F.lit(1)})
    n_danger = risky.count()
    if n_danger == 0 or wanted == 0:
        return train.limit(0).select(F.col("row_id").alias("generated_id"), "features", F.lit(1.0).alias("step"),
                                     F.col("row_id").alias("from_id"), F.col("row_id").alias("to_id"))
    u = lambda part: hash_unit(F.md5(F.concat_ws("|", F.col("generated_id").cast("string"), F.lit(f"{seed}#{part}"))))
    draws = train.sparkSession.range(wanted).withColumnRenamed("id", "generated_id").select(
        "generated_id", (F.floor(u("row") * n_danger) + 1).alias("_rn"), (F.floor(u("to") * k) + 1).cast("int").alias("rank"),
        u("step").alias("step"))
    near = nearest_neighbours(risky, minority, k, seed=seed).withColumn("side", F.lit(0))
    draws = draws.withColumn("side", F.lit(0))
    if kind == "borderline-2":
        other = nearest_neighbours(risky, train.where(F.col("y") == 0), k, seed=seed).withColumn("side", F.lit(1))
        near = near.unionByName(other)
        draws = draws.withColumn("side", (F.col("generated_id") % 2).cast("int"))
        draws = draws.withColumn("step", F.when(F.col("side") == 1, F.col("step") * 0.5).otherwise(F.col("step")))
    ends = train.select(F.col("row_id").alias("neighbour_id"), F.col("features").alias("to_features"))
    picked = (draws.join(numbered.select("_rn", F.col("row_id").alias("query_id"), "features"), "_rn")
              .join(near.select("query_id", "rank", "side", "neighbour_id"), ["query_id", "rank", "side"])
              .join(ends, "neighbour_id"))
    point = F.zip_with("features", "to_features", lambda a, b: a + (b - a) * F.col("step"))
    return picked.select("generated_id", point.alias("features"), "step", F.col("query_id").alias("from_id"),
                         F.col("neighbour_id").alias("to_id"))


def smote_rows(generated: DataFrame, columns: Sequence[str], features: Sequence[str], target: str, threshold: float,
               method: str = "borderline_smote") -> DataFrame:
    """Generated rows in the shape of the training table.

    The target takes the threshold, every other outcome stays NULL, and the
    parent is -1.
    """
    position = {c: i for i, c in enumerate(features)}
    value = lambda c: (F.get("features", position[c]) if c in position
                       else F.lit(float(threshold)) if c == target else F.lit(None).cast("double"))
    meta = {IS_GENERATED: F.lit(1), SPLIT: F.lit("train"), PARENT: F.lit(-1).cast("long"),
            f"{META_PREFIX}augmentation_method": F.lit(method), f"{META_PREFIX}target_column": F.lit(target),
            f"{META_PREFIX}target_threshold": F.lit(float(threshold)), f"{META_PREFIX}binary_target": F.lit(1).cast("long"),
            f"{META_PREFIX}generated_row_id": F.col("generated_id")}
    return generated.select(*[value(c).alias(c) for c in columns], *[e.alias(n) for n, e in meta.items()])
