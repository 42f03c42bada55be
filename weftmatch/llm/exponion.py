"""Centroid clustering of integer vectors by Exponion search.

Each vector carries its cluster, an upper bound of the distance to its own centroid and a lower bound of the distance to
any other. After a round the bounds give way by the distances that the centroids moved. A vector is looked at again only if
its bounds do not show that its centroid is the nearest. Then the own distance is computed, and only centroids inside the
ball around the own centroid of radius ``2 * upper + distance to the nearest other centroid`` are scanned, along the list
of centroids sorted by distance from the own one. The ball holds the two nearest centroids; its border counts as inside and
the bounds are compared strictly, so ties are seen and go to the smaller number. Squared distances are exact integers;
the bounds are floating numbers with room for rounding.

Between rounds vectors, clusters and bounds lie in a table of the shared folder, which survives lost executors; the table before it
is deleted. Only centroids (``k`` times the dimensions, so bounded by parameters) pass through the driver. New centroids
come from sums that each task forms over its own vectors before they are shuffled.

Defined results: a vector is kept if it has exactly ``dims`` components, none null or not finite. ``floor(scale * x)`` is held to ±``LARGEST``,
so that squared distances fit 64 bits. Fewer kept vectors than centroids give as many centroids as there are vectors. Repeated ids are
vectors each for itself; ties among starting vectors fall to the smaller components, null ids come last. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

LARGEST = 1 << 27
#: room for rounding in bounds
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9
_STATE = ["x", "cluster", "distance", "upper", "lower"]


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of two integer arrays, pair by pair."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """The centroids of a round with their sorted distance lists, and how far each moved since the round before."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        k = len(at)
        apart = np.sqrt(np.stack([_between(at, np.broadcast_to(c, at.shape)) for c in at]).astype(float)) * _DOWN
        #: other centroids of each in order of distance, and these distances (a little less, so that none is missed)
        self.order = np.stack([np.array([j for j in np.argsort(apart[i], kind="stable") if j != i], np.int64) for i in range(k)])
        self.apart = np.take_along_axis(apart, self.order, 1)
        moved = np.zeros(k) if before is None else np.sqrt(_between(at, before).astype(float)) * _UP
        self.moved, most = moved, np.argsort(-moved, kind="stable")
        #: the largest move among the others of each centroid
        self.others_moved = np.zeros(k) if k < 2 else np.where(np.arange(k) == most[0], moved[most[1]], moved[most[0]])

    def assign(self, x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> int:
        """Bring the state of some vectors up to date in place; the number of distances computed. A cluster of -1 is unknown.

        ``exact``: every distance is to be right, also where the bounds settle the cluster without it."""
        count, k = 0, len(self.at)
        new = np.flatnonzero(cluster < 0)
        if len(new):
            # the first centroid stands in for the unknown one; its ball is then searched like any other
            cluster[new], upper[new], lower[new] = 0, np.inf, -1.0
        upper += self.moved[cluster]
        lower -= self.others_moved[cluster]
        nearest = self.apart[:, 0] if k > 1 else np.full(k, np.inf)
        sure = upper < np.maximum(lower, nearest[cluster] / 2)
        stale = np.arange(len(x)) if exact else np.flatnonzero(~sure)
        distance[stale] = _between(x[stale], self.at[cluster[stale]])
        upper[stale] = np.sqrt(distance[stale].astype(float)) * _UP
        count += len(stale)
        open_ = np.flatnonzero(~sure)
        open_ = open_[upper[open_] >= np.maximum(lower[open_], nearest[cluster[open_]] / 2)]
        if k < 2:
            lower[open_] = np.inf
            return count
        for own in np.unique(cluster[open_]):
            rows = open_[cluster[open_] == own]
            radius = 2 * upper[rows] + nearest[own] * _UP * _UP
            inside = np.searchsorted(self.apart[own], radius, "right")
            best, at, second = distance[rows].copy(), np.full(len(rows), own), np.full(len(rows), np.iinfo(np.int64).max)
            for place in range(int(inside.max())):
                scan = np.flatnonzero(inside > place)
                other = int(self.order[own, place])
                d = _between(x[rows[scan]], np.broadcast_to(self.at[other], (len(scan), x.shape[1])))
                count += len(scan)
                nearer = (d < best[scan]) | ((d == best[scan]) & (other < at[scan]))
                second[scan] = np.where(nearer, best[scan], np.minimum(second[scan], d))
                won = scan[nearer]
                best[won], at[won] = d[nearer], other
            cluster[rows], distance[rows] = at, best
            upper[rows] = np.sqrt(best.astype(float)) * _UP
            lower[rows] = np.sqrt(second.astype(float)) * _DOWN
        return count


def quantised(vectors: DataFrame, keep: list[str], vector: str, dims: int, scale: float) -> DataFrame:
    """keep_0.., x: the kept vectors as arrays of long."""
    x = F.col("x_")
    held = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))))
    fine = (F.size(x) == dims) & ~F.exists(x, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    named = vectors.select(*[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(vector).cast("array<double>").alias("x_"))
    return named.where(F.coalesce(fine, F.lit(False))).withColumn("x", held).drop("x_")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _assigned(state: DataFrame, centroids: Centroids, dims: int, exact: bool = False) -> DataFrame:
    schema = state.schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            x = _matrix(part.column("x"), dims)
            cluster, distance, upper, lower = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in _STATE[1:])
            cluster = cluster.astype(np.int64)
            centroids.assign(x, cluster, distance, upper, lower, exact)
            columns = [pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-4], *columns], names=schema.names)

    return state.mapInArrow(run, schema)


def _means(state: DataFrame, dims: int) -> dict[int, list[int]]:
    """Cluster -> floor(sum / count) of each component; a row for each cluster."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for part in parts:
            x, cluster = _matrix(part.column("x"), dims), part.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                own = x[cluster == c]
                sums = [len(own), *own.sum(axis=0).tolist()]
                total[c] = [a + b for a, b in zip(total[c], sums, strict=True)] if c in total else sums
        if total:
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(list(total), pa.int32()), "n": pa.array([v[0] for v in total.values()], pa.int64()), "sums": pa.array([v[1:] for v in total.values()], pa.list_(pa.int64()))})

    partial = state.select("x", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    each = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)])
    return {row[0]: [int(s) // row[1] for s in row[2:]] for row in each.collect()}


def hashed_start(seed: str, column: str) -> Column:
    """A starting order: SHA-256 of ``seed:id``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")), 256)


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, keep: Iterable[str] = ("vec_id",), vector: str = "embedding", seed: str = "1"
) -> tuple[DataFrame, DataFrame]:
    """Two tables: a row a vector with ``keep``, cluster (int) and distance (long, squared); a row a centroid with cluster and centroid (array of long).

    The ``k`` starting centroids are the vectors whose first ``keep`` column has the smallest hashes."""
    keep, scratch, spark = list(keep), Scratch(vectors.sparkSession), vectors.sparkSession
    kept = quantised(vectors, keep, vector, dims, scale)
    first = kept.select(hashed_start(seed, "keep_0").alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    fresh = {"cluster": F.lit(-1), "distance": F.lit(0).cast("long"), "upper": F.lit(float("inf")), "lower": F.lit(-1.0)}
    state = kept.withColumns(fresh)
    at = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
    if len(at):
        known = Centroids(at)
        for _ in range(rounds):
            new = scratch.put(_assigned(state, known, dims), "state")
            scratch.drop(state)
            means, state = _means(new, dims), new
            known = Centroids(np.array([means.get(c, own) for c, own in enumerate(known.at.tolist())], np.int64), known.at)
        new = scratch.put(_assigned(state, known, dims, exact=True).drop("x", "upper", "lower"), "assigned")
        scratch.drop(state)
        at, state = known.at, new
    centroids = spark.createDataFrame(list(enumerate(at.tolist())), "cluster int, centroid array<long>")
    return state.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "cluster", "distance"), centroids
