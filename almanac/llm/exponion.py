"""Operator 13: k-means by exponion search, on whole numbers.

Each vector keeps its centroid, an upper bound of its distance to it and a lower
bound of that to any other. Centroids' moves loosen the bounds. A vector whose
bounds leave a doubt looks only at the centroids inside a ball around its own
one: with distance u to it, whose nearest other centroid is s away, the nearest
and the second-nearest centroid are within 2u + s of it. Each centroid has the
others in a list by distance, taken up to the next power of two. Distances are
exact integers, bounds are rounded outwards and the ball is closed, so ties are
seen and go to the smaller number.

A round is one pass over the staged vectors, which writes them with their new
state and each task's sums; only the sums of k centroids come to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read_table, remove_path, shipped

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
#: Components up to 2**27 have exact distances in 64 bits; up to 2**22, products are exact in doubles too.
LARGEST, EXACT = 2**27, 2**22
#: Relative slack of bounds and radii, far above the rounding of a square root.
SLACK = 1e-12
ROWS = 8192
_STATE = "vec_id long, x binary, cluster int, upper double, lower double, distance long, sums array<long>, n long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c."""
    if max(abs(x).max(initial=0), abs(c).max(initial=0)) <= EXACT:
        cross = (x.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        return (x * x).sum(1)[:, None] - 2 * cross + (c * c).sum(1)[None, :]
    found = np.empty((len(x), len(c)), np.int64)
    for k in range(len(c)):
        found[:, k] = ((x - c[k]) ** 2).sum(1)
    return found


class Search:
    """The centroids of a round: distances between them, each one's list of the others, and their moves since the round before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, k = centroids, len(centroids)
        apart = np.sqrt(squared(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, -1.0)  # itself is first
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.sorted = np.take_along_axis(apart, self.order, axis=1)
        self.sorted[:, 0] = 0.0
        self.nearest = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        self.moved = moved
        most = np.sort(moved)
        # The largest move of another centroid.
        self.others = np.where(moved == most[-1], most[-2] if k > 1 and (moved == most[-1]).sum() == 1 else most[-1], most[-1])

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Each vector's nearest centroid with new bounds, and how many distances that took. cluster -1: no state yet."""
        cluster, upper, lower, looked = cluster.copy(), upper.copy(), lower.copy(), 0
        new = cluster < 0
        if new.any():  # the first pass starts from centroid 0
            cluster[new], lower[new] = 0, 0.0
            upper[new] = np.inf
        old = ~new
        upper[old] = upper[old] * (1 + SLACK) + self.moved[cluster[old]]
        lower[old] = np.maximum(0.0, lower[old] * (1 - SLACK) - self.others[cluster[old]] * (1 + SLACK))
        sure = np.maximum(lower, self.nearest[cluster] * (0.5 - SLACK))
        todo = np.flatnonzero(~(upper < sure))
        if len(todo):
            own = ((x[todo] - self.c[cluster[todo]]) ** 2).sum(1)
            looked += len(todo)
            upper[todo] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
            todo = todo[~(upper[todo] < sure[todo])]
        if not len(todo) or len(self.c) == 1:
            lower[todo] = np.inf
            return cluster, upper, lower, looked
        radius = (2 * upper[todo] + self.nearest[cluster[todo]]) * (1 + SLACK)
        base = cluster[todo]
        for a in np.unique(base):
            rows, reach = todo[base == a], radius[base == a]
            count = np.searchsorted(self.sorted[a], reach, side="right")
            size = np.minimum(len(self.c), 2 ** np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64))
            for m in np.unique(size):
                at = rows[size == m]
                number = np.sort(self.order[a][:m])  # of equal distances, the first is the smaller number
                found = squared(x[at], self.c[number])
                looked += found.size
                best = found.argmin(1)
                nearest = found[np.arange(len(at)), best]
                found[np.arange(len(at)), best] = np.iinfo(np.int64).max
                cluster[at] = number[best]
                upper[at] = np.sqrt(nearest.astype(np.float64)) * (1 + SLACK)
                lower[at] = np.sqrt(found.min(1).astype(np.float64)) * (1 - SLACK)
        return cluster, upper, lower, looked


def whole_vectors(table: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of the vectors with exactly `dims` components, none null or non-finite."""
    v = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), table["embedding"].alias("embedding"))
    rows = rows.where((F.size("embedding") == dims) & F.forall(v, fine))
    fits = F.forall(v, lambda x: F.abs(x) * scale <= LARGEST)
    told = F.raise_error(F.lit(f"components times {scale} must be within 2**27 for exact distances"))
    return rows.select("vec_id", F.when(fits, F.transform(v, lambda x: F.floor(x * scale))).otherwise(told.cast("array<long>")).alias("v"))


def _first(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest digests of `seed:vec_id`; repeated ids go by their vectors. At most k rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r["v"] for r in vectors.orderBy(key, "v").limit(k).select("v").collect()], dtype=np.int64)


def _pass(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None, packed: bool, last: bool) -> DataFrame:
    """Rows with their state, and a row for each task and cluster with its sums; v holds the vectors unless they are packed in x."""
    k, dims = centroids.shape
    small = bool(abs(centroids).max(initial=0) < 2**15)

    def unpack(batch):
        if packed:
            raw = [y.as_buffer() for y in batch["x"]]
            return np.stack([np.frombuffer(y, dtype="<i2" if y.size == 2 * dims else "<i4") for y in raw]).astype(np.int64)
        return batch["v"].flatten().to_numpy().reshape(-1, dims).astype(np.int64)

    def run(batches):
        search, sums, count, names = Search(centroids, before), np.zeros((k, dims), np.int64), np.zeros(k, np.int64), ["vec_id", "x", "cluster", "upper", "lower", "distance", "sums", "n"]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = unpack(batch)
                n = len(x)
                state = [batch[c].to_numpy() for c in ("cluster", "upper", "lower")] if packed else [np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)]
                cluster, upper, lower, _ = search.assign(x, *state)
                own = ((x - centroids[cluster]) ** 2).sum(1) if last else np.zeros(n, np.int64)
                order = np.argsort(cluster, kind="stable")
                here, begin = np.unique(cluster[order], return_index=True)
                sums[here] += np.add.reduceat(x[order], begin, axis=0)
                count += np.bincount(cluster, minlength=k)
                raw = pa.nulls(n, pa.binary()) if last else batch["x"] if packed else _packed(x, small)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], raw, pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(own), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=names)
        if not last:
            some = np.flatnonzero(count)
            none = lambda t: pa.nulls(len(some), t)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.binary()), pa.array(some, pa.int32()), none(pa.float64()), none(pa.float64()), none(pa.int64()), pa.array(list(sums[some]), pa.list_(pa.int64())), pa.array(count[some])], names=names)

    source = rows.select("vec_id", *(("x", "cluster", "upper", "lower") if packed else ("v",)))
    return shipped(source).mapInArrow(run, _STATE)


def _packed(x: np.ndarray, small: bool) -> pa.Array:
    """Vectors as 16-bit integers where they fit, else as 32-bit ones."""
    narrow = small and abs(x).max(initial=0) < 2**15
    return pa.array([y.tobytes() for y in x.astype("<i2" if narrow else "<i4")], pa.binary())


def clusters(table: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of table that counts.

    Vectors with another number of components, or with a null or non-finite
    one, don't count, nor do null ones; an extra column is ignored. With fewer
    than k vectors each is a centroid of its own. Equal vectors are in one
    cluster, the smallest number of equally near ones. A cluster that gets no
    vector keeps its centroid. Repeated and null ids count as rows of their own.
    Components beyond 2**27 after scaling are an error, as distances would not
    be exact. An empty table gives no rows.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table, dims, scale)
    centroids = _first(vectors, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    before, rows, path = None, vectors, None
    for step in range(rounds + 1):
        done = new_path(spark, f"vectors-{step}")
        _pass(rows, centroids, before, step > 0, step == rounds).write.option("compression", "zstd").parquet(done)
        if path:
            remove_path(spark, path)  # the round before is read no more
        path, staged = done, spark.read.schema(_STATE).parquet(done)
        rows = staged.where("n IS NULL")
        if step < rounds:
            # k rows of `dims` sums come to the driver.
            sums = staged.where("n IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("part").alias("total"), F.sum("n").alias("n"))
            before, centroids = centroids, centroids.copy()
            for r in sums.collect():
                centroids[r["cluster"], r["at"]] = r["total"] // r["n"]  # Python's division rounds down
    inertia = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    facts = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read_table(spark, sf_dir, "embeddings"))


def _sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> str:
    apart = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))".format(d=dims)
    parts = [
        f"e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {dims})",
        f"v AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda y: CAST(floor({scale} * y) AS BIGINT)) AS x FROM e WHERE len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS m FROM (SELECT v.r, c.c, CAST({apart} AS BIGINT) AS d FROM v, c{t} c) GROUP BY r)")
        if t < rounds:
            parts += [
                f"s{t} AS (SELECT m.c AS c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN v USING (r), range(1, {dims} + 1) t(i) GROUP BY ALL)",
                f"c{t + 1} AS MATERIALIZED (SELECT c0.c, coalesce(z.x, c{t}.x) AS x FROM c0 JOIN c{t} USING (c) LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{t} GROUP BY c) z USING (c))".replace("FROM c0 JOIN c0 USING (c)", "FROM c0").replace("JOIN c0 USING (c) ", ""),
            ]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = m.c"
    )


OP13_SQL = _sql()
