"""Plain Lloyd clustering of integer vectors, the same on every run and for every partitioning.

Kept are vectors with DIMENSIONS components, none null or non-finite; a component x becomes floor(64 * x). The first
centroids are the kept vectors with the smallest sha256 of `1:<vec_id>`. In each round the centroids are broadcast, mapInPandas
takes the integer squared differences to one centroid after the other in NumPy, argmin takes the lowest index, and each
partition returns one row of integer sums for every centroid it met. A groupBy merges these rows; the sums of a
round are at most CLUSTERS rows, which the driver divides with exact floors. An empty cluster keeps its centroid.

Driver and broadcast: CLUSTERS centroids of DIMENSIONS integers, with counts, sums and inertias: a fixed size. The
vectors are read anew in each round, are never exchanged, and no group is ever gathered: rows of one cluster, or a
third of all rows with one vector, only add to sums. A lost executor's partitions are read again.

Rows: vectors of another length, null ones and those with a null, NaN or infinite component are left out. A null vec_id
has the hash of `1:`; of equal hashes the smaller vector comes first. Repeated rows count each. With fewer kept rows than
clusters there are that many centroids, two of which may be equal: the lower index then takes all. Components beyond
LIMIT / 64 in size are held to that bound, so that no squared distance leaves 64 bits; sums that would are the greatest
long. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
LIMIT = 1 << 27
LONGEST = (1 << 63) - 1


def kept(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and v, the integer components."""
    v = F.col(column)
    whole = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * SCALE)))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(v, held).alias("v"))


def seed_hash(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(vec_id.cast("string"), F.lit(""))).cast("binary"), 256)


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    found = rows.select(seed_hash(F.col("vec_id")).alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r.v for r in found], np.int64).reshape(len(found), len(found[0].v) if found else 0)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest index of a nearest centroid, and the squared distance to it."""
    distances = np.empty((len(centroids), len(vectors)), np.int64)
    for c, centroid in enumerate(centroids):
        difference = vectors - centroid
        np.einsum("ij,ij->i", difference, difference, out=distances[c])
    cluster = distances.argmin(axis=0)
    return cluster, distances[cluster, np.arange(len(vectors))]


def _stacked(frame: pd.DataFrame, dimensions: int) -> np.ndarray:
    return np.concatenate(frame["v"].to_numpy()).astype(np.int64, copy=False).reshape(-1, dimensions)


def sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """cluster -> (vectors, summed distance, summed components), from one row a partition and cluster."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    width = centroids.shape[1]

    def partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        count, inertia, total = np.zeros(len(known), np.int64), np.zeros(len(known), object), np.zeros((len(known), width), object)
        for frame in frames:
            if len(frame):
                vectors = _stacked(frame, width)
                cluster, distance = nearest(vectors, known)
                for c in np.unique(cluster):
                    own = cluster == c
                    count[c] += int(own.sum())
                    inertia[c] += sum(distance[own].tolist())
                    total[c] += vectors[own].sum(axis=0).astype(object)
        met = np.flatnonzero(count)
        if len(met):
            yield pd.DataFrame({"cluster": met.astype(np.int32), "n": count[met], "inertia": [Decimal(inertia[c]) for c in met], "total": [[Decimal(x) for x in total[c]] for c in met]})

    parts = rows.select("v").mapInPandas(partition, "cluster int, n long, inertia decimal(38,0), total array<decimal(38,0)>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *(F.sum(F.get("total", F.lit(k))).alias(f"t{k}") for k in range(width)))
    found = {r["cluster"]: (r["n"], int(r["inertia"]), [int(r[f"t{k}"]) for k in range(width)]) for r in merged.collect()}
    shared.destroy()
    return found


def fitted(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after the given rounds."""
    centroids = first_centroids(rows, clusters)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for c, (n, _, total) in sums(rows, centroids).items():
            centroids[c] = [x // n for x in total]
    return centroids


def clustered(vectors: DataFrame, column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    rows = kept(vectors, column, dimensions)
    kind = dict(rows.dtypes)["vec_id"]
    centroids = fitted(rows, clusters, rounds)
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    final = sums(rows, centroids)
    inertias = [min(LONGEST, final.get(c, (0, 0, []))[1]) for c in range(len(centroids))]
    inertia = min(LONGEST, sum(x[1] for x in final.values()))
    digests = np.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids])
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cluster, distance = nearest(_stacked(frame, dimensions), shared.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": cluster.astype(np.int32), "distance": distance, "cluster_inertia": np.array(inertias, np.int64)[cluster], "inertia": np.int64(inertia), "centroid_sha256": digests[cluster]})

    named = rows.withColumn("vec_id", F.col("vec_id").cast("string"))  # pandas has no null among integers
    return named.mapInPandas(assign, schema.replace(f"vec_id {kind}", "vec_id string", 1)).withColumn("vec_id", F.col("vec_id").cast(kind))


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    """The same rounds in DuckDB's SQL, for tables with one row per vec_id."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k, c{k}),
a{k} AS MATERIALIZED (SELECT vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM d{k}) WHERE r = 1)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY c, i),
m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS u FROM s{k} GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.u, c{k}.u) AS u FROM c{k} LEFT JOIN m{k} USING (c))""")
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions} AND len(embedding) = {dimensions}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h)::INTEGER - 1 AS c, u FROM (SELECT sha256('1:' || vec_id) AS h, v AS u FROM k ORDER BY h LIMIT {clusters})),
{', '.join(steps)}
SELECT vec_id, c AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(u, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""
