"""An index for the nearest vectors of a question: lists of vectors around centroids, of which a search reads a few.

Centroids are fitted to a bounded sample; every row is then filed in the list of its nearest centroid, and each list knows
the widest angle at which it holds one. A search reads the `probes` nearest lists and reranks them exactly. By the triangle
inequality of angles a list can hold nothing nearer than its centroid's angle less its width, so an exact search then reads
those further lists, and only those, that this doesn't rule out. Lists are partitions of the table: a search prunes the
rest. The driver holds centroids only, `MOST_LISTS` of them at most.

Defined results: vectors of another length are left out; zero vectors and those with NaN are filed apart and always read, so
distances equal those of `vector_topk`; ties are ordered by id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from nodeweft.operators.retrieval import TOP, vector_topk

#: Rows that centroids are fitted to, and the most of these.
SAMPLE, MOST_LISTS = 20_000, 1024
#: The list of what has no direction.
APART = -1


def _directions(values: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have a direction, and these at length one."""
    x = np.array([v if v is not None and len(v) == dim else [math.nan] * dim for v in values], dtype=np.float64).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return good, x[good] / norm[good, None]


def fit_centroids(x: np.ndarray, lists: int, seed: int = 0, rounds: int = 8) -> np.ndarray:
    """Directions that stand for the rows of `x`, by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1.0), c)
    return c


def build_index(rows: DataFrame, row_id: str, vector: str, dim: int, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 0) -> None:
    """Writes the index of `rows` into the folder `path`: `vectors`, partitioned by list, and `centroids`."""
    spark = rows.sparkSession
    given = rows.where(F.size(vector) == dim).select(F.col(row_id).alias("id"), F.col(vector).alias("x"))
    _, x = _directions([r[0] for r in given.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("x").collect()], dim)
    count = given.count()
    centroids = fit_centroids(x, min(lists or max(1, round(math.sqrt(count))), MOST_LISTS), seed) if len(x) else np.zeros((0, dim))

    @arrow_udf(T.StructType([T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
    def filed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            good, u = _directions(batch.to_pylist(), dim)
            place, angle = np.full(len(batch), APART, dtype=np.int32), np.full(len(batch), math.nan)
            if len(u) and len(centroids):
                near = u @ centroids.T
                best = near.argmax(axis=1)
                place[good], angle[good] = best, np.arccos(np.clip(near[np.arange(len(u)), best], -1, 1))
            yield pa.StructArray.from_arrays([pa.array(place), pa.array(angle)], names=["list", "angle"])

    given.withColumn("f", filed("x")).select("id", "x", "f.list", "f.angle").repartition("list").write.partitionBy("list").parquet(f"{path}/vectors")
    widths = spark.read.parquet(f"{path}/vectors").groupBy("list").agg(F.max("angle").alias("width")) if count else spark.createDataFrame([], "list int, width double")
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    known.join(widths, "list").coalesce(1).write.parquet(f"{path}/centroids")


def search(spark: SparkSession, path: str, query: list[float], k: int = TOP, probes: int = 8, exact: bool = False) -> DataFrame:
    """(id, distance) of the k nearest rows in the `probes` nearest lists, or with `exact` of all rows."""
    centroids = spark.read.parquet(f"{path}/centroids").collect()
    if not centroids:
        return spark.createDataFrame([], "id string, distance double")
    vectors = spark.read.parquet(f"{path}/vectors").select("id", "x", "list")
    q = np.asarray(query, dtype=np.float64)
    q = q / (np.linalg.norm(q) or 1.0)
    angles = sorted((math.acos(max(-1.0, min(1.0, float(np.dot(q, r["centroid"]))))), r["list"], r["width"]) for r in centroids)

    def among(lists: list[int]) -> DataFrame:
        return vector_topk(vectors.where(F.col("list").isin(APART, *lists)), "id", "x", query, k)

    first = [number for _, number, _ in angles[:probes]]
    if not exact or len(first) == len(angles):
        return among(first)
    distances = [r["distance"] for r in among(first).collect() if not math.isnan(r["distance"])]
    # Beyond the k-th angle found nothing counts; without k of them everything does.
    reach = math.acos(max(-1.0, min(1.0, 1.0 - distances[-1]))) if len(distances) == k else math.inf
    return among([number for angle, number, width in angles if number in first or angle - width <= reach + 1e-7])
