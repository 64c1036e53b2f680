import numpy as np
import pytest

from nodeweft.llm import neighbours

SCHEMA = "id string, v array<float>, at int, extra string"


def brute(ids, x, k=5, least=0.85):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    pairs = set()
    for i in range(len(ids)):
        for j in sorted(np.flatnonzero(s[i] >= least), key=lambda j: (-s[i, j], ids[j]))[:k]:
            pairs.add(tuple(sorted((ids[i], ids[j]))))
    return pairs


def clustered(rng, clusters, size, dim, noise):
    centres = rng.standard_normal((clusters, dim))
    return np.repeat(centres, size, axis=0) + noise * rng.standard_normal((clusters * size, dim))


def found(spark, ids, x, **kw):
    df = spark.createDataFrame([(i, v.tolist(), 1, None) for i, v in zip(ids, x, strict=True)], SCHEMA)
    return {(r["node_a"], r["node_b"]) for r in neighbours.similar_pairs(df, "id", "v", "at", x.shape[1], **kw).collect()}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([clustered(rng, 60, 6, 64, 0.2), rng.standard_normal((600, 64))]).astype(np.float32)
    ids = [f"n{i:05d}" for i in range(len(x))]
    want, got = brute(ids, x.astype(np.float64)), found(spark, ids, x)
    assert len(got & want) >= 0.97 * len(want) and not got - want


def test_recall_in_a_hot_group(spark):
    """A third of all vectors in one tight group, in blocks smaller than it."""
    rng = np.random.default_rng(2)
    x = np.concatenate([clustered(rng, 1, 400, 64, 0.25), rng.standard_normal((800, 64))]).astype(np.float32)
    ids = [f"n{i:05d}" for i in range(len(x))]
    want, got = brute(ids, x.astype(np.float64)), found(spark, ids, x, block=128)
    assert len(got & want) >= 0.9 * len(want)


def test_recall_in_a_hot_group_with_defaults(spark):
    """Thousands of vectors of mutual cosine 0.94: sketches can't rank them."""
    rng = np.random.default_rng(5)
    x = np.concatenate([clustered(rng, 1, 5000, 384, 0.25), rng.standard_normal((1000, 384))]).astype(np.float32)
    ids = [f"n{i:05d}" for i in range(len(x))]
    want, got = brute(ids, x.astype(np.float64)), found(spark, ids, x)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_a_crowd_is_compared_in_parts(spark, monkeypatch):
    """Equal results in one task and in many, with scaled copies that tie."""
    rng = np.random.default_rng(6)
    x = clustered(rng, 1, 300, 64, 0.25).astype(np.float32)
    x = np.concatenate([x, x[:40] * 2, x[:40] * 4, rng.standard_normal((100, 64)).astype(np.float32)])
    ids = [f"n{i:05d}" for i in rng.permutation(len(x))]
    want = brute(ids, x.astype(np.float64))
    got = found(spark, ids, x, crowd=8)
    whole = neighbours.crowded_pairs
    monkeypatch.setattr(neighbours, "crowded_pairs", lambda *a: whole(*a, block=64))
    assert found(spark, ids, x, crowd=8, block=128) == got
    assert len(got & want) >= 0.97 * len(want)


def test_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    base, other = rng.standard_normal(64).astype(np.float32), rng.standard_normal(64).astype(np.float32)
    v = lambda a: [float(t) for t in a]
    data = [(f"c{i}", v(base), 1, None) for i in range(9)] + [("scaled", v(base * 4), 1, None), ("z", [0.0] * 64, 1, None), ("short", v(base[:10]), 1, None), ("null", None, 1, None), ("nan", [float("nan")] + v(base[1:]), 1, None), (None, v(base), 1, None)]
    data += [("moved", v(base), 1, None), ("moved", v(other), 2, None), ("gone", v(base), 1, None), ("gone", None, 2, None)] + data[:3]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["node_a"], r["node_b"]) for r in neighbours.similar_pairs(df, "id", "v", "at", 64).collect()}
    members = [f"c{i}" for i in range(9)]
    expected = {tuple(sorted((a, b))) for a in members for b in [m for m in members if m != a][:5]} | {(c, "scaled") for c in members[:5]}
    assert got == expected
    assert neighbours.similar_pairs(df.limit(0), "id", "v", "at", 64).count() == 0


def test_finer_hash_keeps_its_pairs():
    rng = np.random.default_rng(4)
    x = clustered(rng, 300, 2, 64, 0.15)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    codes = neighbours.CrossPolytope(64, 4, 3, 4, 20).codes(x)
    together = [bool(set(codes[i].tolist()) & set(codes[i + 1].tolist())) for i in range(0, 600, 2)]
    assert np.mean(together) > 0.97


def pairs_of(rng, count, dim, low, high):
    """Rows 2i and 2i + 1 have a cosine between low and high."""
    x, y = rng.standard_normal((2, count, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(low, high, (count, 1))
    return np.stack([x, c * x + np.sqrt(1 - c**2) * y], axis=1).reshape(2 * count, dim).astype(np.float32)


def test_finer_hash_keeps_pairs_near_the_threshold():
    x = pairs_of(np.random.default_rng(7), 2000, 384, 0.85, 0.85)
    for fine in (1, 8):
        codes = neighbours.CrossPolytope(384, neighbours.enough_tables(384, 4, 3, fine, 0.85, 20), 3, fine, 20).codes(x)
        assert (codes[::2, :, None] == codes[1::2, None, :]).any(axis=(1, 2)).mean() >= 0.994
    assert neighbours.enough_tables(384, 4, 3, 0, 0.85, 20) == 4


@pytest.mark.parametrize("fine", [8, 16, 512])
def test_recall_with_the_hash_of_millions(spark, monkeypatch, fine):
    """The `fine` that 1.5, 4 and 134 million rows take, near the threshold."""
    x = pairs_of(np.random.default_rng(8), 800, 384, 0.8505, 0.9)
    ids = [f"n{i:05d}" for i in range(len(x))]
    monkeypatch.setattr(neighbours, "BUCKET", len(x) / (1024 * 2 * fine))
    want, got = brute(ids, x.astype(np.float64)), found(spark, ids, x)
    assert len(got & want) >= 0.985 * len(want) and not got - want


def test_groups_keep_their_size():
    """Bucket rows of a group on average, from thousands of vectors to billions."""
    for rows in (10**3, 10**5, 10**6, 10**8, 10**10):
        assert rows * 12 / neighbours.groups_for(rows * 12) <= neighbours.GROUP_ROWS
