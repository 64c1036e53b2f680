"""Problem 5: the most similar vectors for every vector, by cross-polytope hashing.

A unit vector is rotated by a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and assigned to
the nearest signed axis. Each of `tables` rotations is one hash table; a vector stands in the bucket of its nearest axis
and, multiprobe, in those of the next nearest. Buckets give candidates, a sketch of 512 sign bits that travels with each
row drops those that can't be near, and the rest are compared exactly in double precision.

Scale. Only ids, codes and sketches (under 100 bytes a row) are shuffled for the candidates; the vectors themselves move
once, and only those that have a candidate. With more vectors the hash gets finer (a partial second rotation splits each
bucket), so buckets keep their size; tables are added so that the chance to meet at `min_similarity` doesn't sink. The
buckets are spread over as many groups as the rows ask for, so no task's share grows with the data. Copies of a vector are
hashed and compared once, as a class; a class keeps the few smallest ids that a list of k neighbours can need, taken by a
partial top-k, so copies never meet in pairs.

Crowds. Within a tight group sketches can't tell which candidates are nearest. A row with more than `crowd` candidates in a
bucket, and every row of a bucket larger than `block`, is compared by the vectors themselves with everything in its crowded
buckets: nothing is capped. Buckets that hold much the same rows are compared as one, so a tight group moves about once for
each of its blocks and not once for each table and probe. Every task compares two blocks; for a crowd of n different vectors
this is n^2 work by n / CROWD_BLOCK moves of a vector, the price of its exact order, which no hash of a tight group keeps.

Accuracy. The index loses a pair only if no table brings it together or if its sketches lie more than four deviations further
apart than `min_similarity` makes likely. Measured recall is in the README and the tests.

Defined results: the current row of an id (latest indexed_at, then the greatest content) decides; a missing vector, one of
another length, with NaN or infinite values or all zero isn't usable; vectors needn't have length one; ties in similarity
are ordered by id; rows with a null id are left out; an empty table gives no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from nodeweft.operators.rows import broadcast_if_small
from nodeweft.session import stage

BITS = 512
#: Rows that a bucket holds on average before the hash gets finer.
BUCKET = 128
#: Rows (of about 90 bytes) of ordinary buckets that share a task's call on average.
GROUP_ROWS = 32_768
#: Candidate classes and hot buckets up to this number are broadcast (8 and 20 bytes each).
BROADCAST_ROWS = 200_000
#: Vectors of a crowded group that are compared in one task, with as many others.
CROWD_BLOCK = 8192


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), dtype=np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


class CrossPolytope:
    """The hash functions: the same seed gives the same ones on every worker."""

    def __init__(self, dim: int, tables: int, probes: int, fine: int, seed: int) -> None:
        self.size = 1 << max(4, (dim - 1).bit_length())
        self.left = 1 << (self.size.bit_length() - 1) // 2
        self.h_left, self.h_right = _hadamard(self.left), _hadamard(self.size // self.left)
        rng = np.random.RandomState(seed)
        # For each table one rotation for the axis and one for the finer part; the rest are for the sketch.
        self.signs = rng.choice(np.array([-1, 1], dtype=np.float32), (2 * tables + -(-BITS // self.size), 3, self.size))
        self.dim, self.tables, self.probes, self.fine = dim, tables, probes, fine

    def rotate(self, x: np.ndarray, which: int) -> np.ndarray:
        y = np.zeros((len(x), self.size), dtype=np.float32)
        y[:, : self.dim] = x
        for s in self.signs[which]:
            # A Hadamard matrix of this size is the product of two small ones.
            y = np.matmul(self.h_left, (y * s).reshape(-1, self.left, self.size // self.left) @ self.h_right).reshape(-1, self.size)
            y *= np.float32(self.size**-0.5)
        return y

    @staticmethod
    def axes(y: np.ndarray, count: int) -> np.ndarray:
        """The `count` nearest signed axes, nearest first, as 2 x coordinate + sign."""
        size = np.abs(y)
        count = min(count, y.shape[1])
        top = np.argpartition(-size, count - 1, axis=1)[:, :count]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
        return top * 2 + (np.take_along_axis(y, top, 1) > 0)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables x probes) bucket numbers, the table's number included."""
        out = []
        for t in range(self.tables):
            code = self.axes(self.rotate(x, 2 * t), self.probes).astype(np.int64)
            if self.fine:
                code = code * (2 * self.fine) + self.axes(self.rotate(x, 2 * t + 1)[:, : self.fine], 1)
            out.append(code * self.tables + t)
        return np.concatenate(out, axis=1)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        y = np.concatenate([self.rotate(x, r) for r in range(2 * self.tables, len(self.signs))], axis=1)[:, :BITS]
        return np.packbits(y > 0, axis=1)


def meeting(dim: int, probes: int, fine: int, min_similarity: float, seed: int, count: int = 4000) -> float:
    """The chance that two vectors of that similarity meet in a table, estimated over random pairs and four tables."""
    rng = np.random.RandomState(seed)
    x, y = rng.standard_normal((2, count, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dim > 1:
        y -= np.einsum("ij,ij->i", x, y)[:, None] * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = min_similarity * x + math.sqrt(max(0.0, 1 - min_similarity**2)) * y
    h = CrossPolytope(dim, 4, probes, fine, seed)
    a, b = (h.codes(v.astype(np.float32)).reshape(count, 4, -1) for v in (x, y))
    return float((a[:, :, :, None] == b[:, :, None, :]).any(axis=(2, 3)).mean())


def enough_tables(dim: int, tables: int, probes: int, fine: int, min_similarity: float, seed: int) -> int:
    """With how many tables of a finer hash a pair of `min_similarity` meets as surely as with `tables` that aren't finer."""
    if not fine:
        return tables
    coarse, finer = (meeting(dim, probes, f, min_similarity, seed) for f in (0, fine))
    if coarse in (0.0, 1.0) or finer == 1:
        return tables
    return max(tables, math.ceil(tables * math.log(1 - coarse) / math.log(1 - max(finer, 1e-4))))


def usable(batch: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which elements of a list column are usable vectors, and these, scaled to length one."""
    ok = np.zeros(len(batch), dtype=bool)
    right = np.flatnonzero(np.nan_to_num(pc.list_value_length(batch).to_numpy(zero_copy_only=False), nan=-1) == dim)
    if not len(right):
        return ok, np.zeros((0, dim), dtype=np.float32)
    values = pc.list_flatten(batch.take(pa.array(right)))
    x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    ok[right[good]] = True
    x = x[good]
    x /= np.abs(x).max(axis=1, keepdims=True)
    return ok, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


HASHED = T.StructType([T.StructField("codes", T.ArrayType(T.LongType(), False)), T.StructField("sketch", T.BinaryType())])


def hashed_vectors(rows: DataFrame, vector: str, dim: int, tables: int, probes: int, fine: int, seed: int) -> DataFrame:
    """`rows` with the column `_h`: codes and sketch of a usable vector, null for any other."""
    made: list[CrossPolytope] = []

    @arrow_udf(HASHED)
    def hashing(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not made:
            made.append(CrossPolytope(dim, tables, probes, fine, seed))
        h = made[0]
        for batch in batches:
            codes: list = [None] * len(batch)
            sketches: list = [None] * len(batch)
            for start in range(0, len(batch), 2048):
                ok, x = usable(batch.slice(start, 2048), dim)
                at = np.flatnonzero(ok) + start
                for i, c, s in zip(at, h.codes(x) if len(x) else [], h.sketch(x) if len(x) else [], strict=True):
                    codes[i], sketches[i] = c, s.tobytes()
            fields = [pa.array(codes, type=pa.list_(pa.int64())), pa.array(sketches, type=pa.binary())]
            yield pa.StructArray.from_arrays(fields, names=["codes", "sketch"], mask=pa.array([c is None for c in codes]))

    return rows.withColumn("_h", hashing(F.col(vector)))


def near_bits(min_similarity: float) -> int:
    """The greatest distance of two sketches whose vectors may be that similar: the mean and four deviations."""
    p = math.acos(min(1.0, max(-1.0, min_similarity))) / math.pi
    return min(BITS, math.ceil(BITS * p + 4 * math.sqrt(BITS * p * (1 - p))))


def _compare(group: pd.DataFrame, most: int, crowd: int) -> pd.DataFrame:
    """Candidates of some whole buckets: pairs (a < b) of classes with bucket -1, and for rows with more than `crowd`
    candidates (b = 1) and these candidates (b = 0) the class a and the bucket."""
    out: list[np.ndarray] = []
    order = np.argsort(group["bucket"].to_numpy(), kind="stable")
    bucket, keys = (group[c].to_numpy()[order] for c in ("bucket", "v"))
    packed = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint8).reshape(len(group), -1)[order]
    starts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for start, end in zip(starts, starts[1:], strict=False):
        if end - start < 2:
            continue
        # Dot products of signs give the distances of sketches.
        bits = np.unpackbits(packed[start:end], axis=1).astype(np.float32) * 2 - 1
        key = keys[start:end]
        for at in range(0, len(key), 1024):
            rows = slice(at, at + 1024)
            near = ((BITS - bits[rows] @ bits.T) / 2 <= most) & (key[rows][:, None] != key[None, :])
            full = near.sum(axis=1) > crowd
            if full.any():
                for members, asks in ((key[rows][full], 1), (key[near[full].any(axis=0)], 0)):
                    out.append(np.stack([members, np.full(len(members), asks), np.full(len(members), bucket[start])], axis=1))
                near[full] = False
            r, c = np.nonzero(near)
            p, q = key[rows][r], key[c]
            out.append(np.stack([np.minimum(p, q), np.maximum(p, q), np.full(len(p), -1)], axis=1))
    found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), dtype=np.int64)
    return pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "bucket": found[:, 2]})


def groups_for(codes: int) -> int:
    """How many groups the ordinary buckets are spread over: it grows with the rows, so a group keeps its size."""
    return max(64, -(-codes // GROUP_ROWS))


def candidates(classes: DataFrame, min_similarity: float, block: int, crowd: int, codes: int) -> DataFrame:
    """Distinct rows of `_compare`: pairs of classes that a bucket brings together and whose sketches are near enough, and
    the members of crowds; all rows of a bucket of more than `block` are a crowd. `codes` is how many bucket rows there are
    at most."""
    rows = classes.select("v", "sketch", F.explode("codes").alias("bucket"))
    hot = stage(classes.select(F.explode("codes").alias("bucket")).groupBy("bucket").count().where(F.col("count") > block).select("bucket"), "hot-buckets")
    few = broadcast_if_small(hot, BROADCAST_ROWS)
    spread, most = groups_for(codes), near_bits(min_similarity)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _compare(group, most, crowd)

    ordinary = rows.join(few, "bucket", "left_anti").withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(spread)))
    crowded = rows.select("v", "bucket").join(few, "bucket", "left_semi").select(F.col("v").alias("a"), F.lit(1).cast("long").alias("b"), "bucket")
    return ordinary.groupBy("part").applyInPandas(compare, "a long, b long, bucket long").distinct().unionByName(crowded)


def _cosine(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", u, w) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", w, w))


def _similarity(dim: int):
    @arrow_udf(T.DoubleType())
    def cosine(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array(_cosine(*(pc.list_flatten(c).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) for c in (x, y))))

    return cosine


def _nearest(group: pd.DataFrame, k: int, min_similarity: float) -> pd.DataFrame:
    """(v, w, s, tie): the k most similar w of each v that asks, among the vectors of a crowd or of two blocks of it."""
    keys, own, asks = (group[c].to_numpy() for c in ("v", "own", "asks"))
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    raw = np.stack(group["x"].to_list())
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    # Equal similarities are ordered by the smallest id of a class.
    tie = np.argsort(np.argsort(group["tie"].to_numpy(dtype=object), kind="stable"))
    sides = [np.flatnonzero(own == n) for n in sorted({i, j})]
    out: list[np.ndarray] = []
    for a, b in ((sides[0], sides[0]),) if i == j else ((sides[0], sides[1]), (sides[1], sides[0])):
        a = a[asks[a] > 0]
        for at in range(0, len(a) if len(b) else 0, 512):
            rows = a[at : at + 512]
            s = x[rows] @ x[b].T
            s[keys[rows][:, None] == keys[b][None, :]] = -2
            last = min(k, len(b))
            # The margin is for rounding: what single precision can't tell apart is ordered in double precision.
            least = np.maximum(np.partition(s, len(b) - last, axis=1)[:, len(b) - last], min_similarity) - np.float32(1e-5)
            r, c = np.nonzero(s >= least[:, None])
            p, q = rows[r], b[c]
            swap = keys[p] > keys[q]
            first, second = np.where(swap, q, p), np.where(swap, p, q)
            exact = np.concatenate([np.zeros(0), *(_cosine(raw[first[n : n + 8192]].astype(np.float64), raw[second[n : n + 8192]].astype(np.float64)) for n in range(0, len(p), 8192))])
            order = np.lexsort((tie[q], -np.round(exact, 12), r))
            begins = np.searchsorted(r[order], np.arange(len(rows)))
            order = order[np.arange(len(order)) - begins[r[order]] < k]
            order = order[exact[order] >= min_similarity]
            out.append(np.stack([p[order], q[order], exact[order]], axis=1))
    found = np.concatenate(out) if out else np.zeros((0, 3))
    p, q = (found[:, n].astype(np.int64) for n in (0, 1))
    return pd.DataFrame({"v": keys[p], "w": keys[q], "s": found[:, 2], "tie": group["tie"].to_numpy(dtype=object)[q]})


def crowded_pairs(members: DataFrame, vectors: DataFrame, ids: DataFrame, k: int, min_similarity: float, block: int = CROWD_BLOCK) -> DataFrame:
    """(a, b, s) with a < b: the pairs of each class that asks and the k most similar classes of its crowded buckets.

    members: v, bucket, asks; vectors: v, x; ids: v, tie.
    """
    # A bucket is compared within the largest one that holds half of its rows or more.
    held = members.groupBy("v").agg(F.collect_set("bucket").alias("b"))
    shared = stage(held.select(F.explode("b").alias("bucket"), "b").select("bucket", F.explode("b").alias("other")).groupBy("bucket", "other").count(), "shared")
    sizes = shared.where("bucket = other").select("bucket", F.col("count").alias("size"))
    choices = shared.join(sizes, "bucket").where(F.col("count") * 2 >= F.col("size")).select("bucket", "other")
    crowds = choices.join(sizes.withColumnRenamed("bucket", "other"), "other").groupBy("bucket").agg(F.max(F.struct("size", "other"))["other"].alias("crowd"))
    rows = stage(members.join(crowds, "bucket").groupBy("crowd", "v").agg(F.max("asks").alias("asks")), "crowds")
    blocks = rows.groupBy("crowd").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = rows.join(blocks, "crowd").withColumn("own", F.pmod(F.xxhash64("v", F.lit(13)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("crowd", "v", "asks", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        return _nearest(group, k, min_similarity)

    found = placed.join(ids, "v").join(vectors, "v").groupBy("crowd", "i", "j").applyInPandas(nearest, "v long, w long, s double, tie string")
    found = found.groupBy("v", "w").agg(F.max("s").alias("s"), F.first("tie").alias("tie"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(F.round("s", 12).desc(), "tie"))).where(F.col("n") <= k)
    return best.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"), "s")


def similar_pairs(
    rows: DataFrame,
    record_id: str,
    vector: str,
    order: str,
    dim: int,
    k: int = 5,
    min_similarity: float = 0.85,
    tables: int = 4,
    probes: int = 3,
    block: int = 4096,
    crowd: int = 64,
    seed: int = 20,
) -> DataFrame:
    """(node_a, node_b, similarity), node_a < node_b, of the current records: every pair of at least `min_similarity` in
    which one record is among the k most similar of the other."""
    # How fine the hash has to be goes by the number of rows (their footers tell it): `fine` axes split each bucket.
    size, count = 2 << max(4, (dim - 1).bit_length()), rows.count()
    parts = count / (size * BUCKET)
    fine = 0 if parts < 1.5 else 1 << max(0, round(math.log2(parts / 2)))
    tables = enough_tables(dim, tables, probes, fine, min_similarity, seed)

    given = rows.where(F.col(record_id).isNotNull()).select(F.col(record_id).alias("id"), F.col(order).alias("at"), F.col(vector).alias("x"))
    hashed = hashed_vectors(given, "x", dim, tables, probes, fine, seed)
    # A vector's key: equal vectors have equal keys; two 64-bit hashes of different vectors agree by chance once in 2^64.
    kept = hashed.select("id", "at", F.xxhash64("x").alias("v"), "_h")
    now = kept.groupBy("id").agg(F.max_by(F.struct("v", "_h"), F.struct("at", "v")).alias("r"))
    nodes = stage(now.where(F.col("r._h").isNotNull()).select("id", "r.v", "r._h.codes", "r._h.sketch"), "hashed")

    met = stage(candidates(nodes.select("v", "codes", "sketch").dropDuplicates(["v"]), min_similarity, block, crowd, count * tables * probes), "candidates")
    pairs, crowded = met.where("bucket < 0").select("a", "b"), met.where("bucket >= 0").select(F.col("a").alias("v"), "bucket", F.col("b").alias("asks"))
    given = given.where(F.col("x").isNotNull() & (F.size("x") == dim)).select(F.xxhash64("x").alias("v"), "x")

    def vectors(wanted: DataFrame) -> DataFrame:
        return given.join(broadcast_if_small(wanted.distinct(), BROADCAST_ROWS), "v", "left_semi").dropDuplicates(["v"])

    ends = vectors(pairs.select(F.explode(F.array("a", "b")).alias("v")))
    both = pairs.join(ends.select(F.col("v").alias("a"), F.col("x").alias("xa")), "a").join(ends.select(F.col("v").alias("b"), F.col("x").alias("xb")), "b")
    compared = both.select("a", "b", _similarity(dim)(F.col("xa"), F.col("xb")).alias("s")).where(F.col("s") >= min_similarity)
    if crowded.take(1):
        ids = nodes.groupBy("v").agg(F.min("id").alias("tie"))
        compared = compared.unionByName(crowded_pairs(crowded, vectors(crowded.select("v")), ids, k, min_similarity)).groupBy("a", "b").agg(F.max("s").alias("s"))
    near = stage(compared, "near")

    # The k + 1 smallest ids of a class are all that any list of k can need of it.
    members = nodes.select("v", "id").withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    links = near.select(F.col("a").alias("v"), F.col("b").alias("w"), "s").unionByName(near.select(F.col("b").alias("v"), F.col("a").alias("w"), "s"))
    outside = links.join(members.select(F.col("v").alias("w"), F.col("id").alias("other")), "w").select("v", "other", "s")
    copies = members.groupBy("v").agg(F.count("*").alias("c"), F.collect_list("id").alias("ids")).where(F.col("c") > 1).select("v", F.explode("ids").alias("other"), F.lit(1.0).alias("s"))
    first = Window.partitionBy("v").orderBy(F.desc("s"), "other")
    listed = outside.unionByName(copies).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("far"), F.col("other")))).alias("list"))
    # A record's own id may be one of the k + 1 of its class.
    own = nodes.select("id", "v").join(listed, "v")
    best = own.select("id", F.explode(F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, k)).alias("y"))
    return best.select(F.least("id", "y.other").alias("node_a"), F.greatest("id", "y.other").alias("node_b"), (-F.col("y.far")).alias("similarity")).distinct()


def similar_nodes(nodes: DataFrame) -> DataFrame:
    return similar_pairs(nodes, "id", "embedding", "indexed_at", 384)
