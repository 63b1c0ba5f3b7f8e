import numpy as np
from pyspark.sql import functions as F

from tramline.llm import ann


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, h string, v string")


def exact(rows, k):
    """Brute force over usable rows: query -> its k nearest (vec_id, score)."""
    use = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for i, v in use:
        if i % 20 == 0:
            scored = sorted((-float(np.float64(np.float32(v)) @ np.float64(np.float32(w))), j) for j, w in use if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_against_brute_force_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    hot = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(1000 + i, hot) for i in range(300)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [1.0, None] + [0.0] * 6), (2080, [float("nan")] * 8), (2100, [float("inf")] * 8), (2120, [1.0] * 5), (None, hot), rows[0], rows[0]]
    df = frame(spark, rows)
    want = exact(rows, 20)
    for search, least in ((1.0, 1.0), (0.8, 0.9)):
        shards = 1.0 if search == 1.0 else ann.SHARDS
        got = {}
        for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, shard=200, search=search, shards=shards).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert set(got) == set(want)
        hit = 0
        for q, found in got.items():
            found.sort()
            assert [r for r, _, _ in found] == list(range(1, 21))
            assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
            hit += len({i for _, i, _ in found} & {i for i, _ in want[q]})
        assert hit / sum(map(len, want.values())) >= least
    full = {q: [i for i, _ in v] for q, v in want.items()}
    one = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, search=1.0).collect()
    assert all(r.vec_id == full[r.query_id][r.rank - 1] for r in one)


def test_few_and_no_rows(spark):
    df = frame(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])])
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert ann.nearest_neighbours(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_forest_search_reaches_everything_when_asked():
    x = np.random.default_rng(3).normal(size=(500, 6))
    forest = ann.Forest(x, 3, 20)
    assert forest.search(x[7] @ forest.matrix.T, 500).tolist() == list(range(500))
    assert len(forest.search(x[7] @ forest.matrix.T, 50)) < 200
    same = ann.Forest(np.ones((300, 4)), 2, 10)
    assert len(same.search(np.ones(4) @ same.matrix.T, 300)) == 300


def test_clustered_vectors_are_found_in_few_shards(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(scale=0.01, size=(3000, 16))
    tree = ann.TopTree(x[:1000], 12)
    home = tree.home(x)
    assert set(home.tolist()) == set(range(tree.shards)) and np.bincount(home).max() < 800
    longest, asked, hit = float(np.linalg.norm(x, axis=1).max()), 0, 0
    for q in range(0, 3000, 100):
        score = x @ x[q]
        want = np.argsort(-score)[:20]
        own = np.sort(score[home == home[q]])[::-1]
        kth = own[19] if len(own) >= 20 else -np.inf
        others = tree.others(x[q], kth, (x[q] @ x[q] + longest**2) / 2, 1.0)
        asked += len(others)
        hit += np.isin(home[want], [home[q], *others]).sum()
        assert home[q] not in others
    assert hit == 30 * 20 and asked < 30 * tree.shards / 2


def test_recall_at_the_shipped_setting(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    v = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    ids = np.array(sorted(v))
    x = np.stack([v[i] for i in ids.tolist()])
    got = {}
    for r in ann.nearest_neighbours(rows, F.col("vec_id") % 20 == 0, shard=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in got:
        score = x @ v[q]
        score[ids == q] = -np.inf
        hit += len(got[q] & set(ids[np.argsort(-score)[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.9
