import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import components, linededup, lm_score, ngram_join
from tramline.llm.common import Workspace
from tramline.llm.oracle import LINE_DEDUP

from .conftest import prose


def word_edit(a, b):
    """Whether two lists of units lie within one substitution, insertion or deletion, by full dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1] <= 1


def near_texts(rng):
    """Documents of lines that repeat, differ by one word, by two, or in case and spacing."""
    base = [prose(rng, n) for n in (5, 6, 7, 12, 13, 30)]
    out = []
    for i in range(30):
        lines = []
        for _ in range(4):
            w = rng.choice(base).split()
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + ["xx"] + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + ["yy"] + w[k:], w])
            lines.append(("  " if i % 7 == 0 else " ").join(w) if i % 5 else " ".join(w).upper())
        lines.append(rng.choice(["terms of service", "terms of zervice", "term of service", "東京都千代田区一丁目", "東京都千代田区二丁目", "page 1", "page 2"]))
        out.append((i, "\n".join(lines)))
    return out


def brute_lines(texts):
    """Line numbers dropped in each document, exact and near, by comparing all lines with all."""
    places = collections.defaultdict(list)
    for i, t in texts:
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            w = [x for x in line.lower().replace("\t", " ").replace("\r", " ").split(" ") if x]
            if w:
                by_word = len(w) >= 5
                places[by_word, tuple(w if by_word else " ".join(w))].append((i is None, i or 0, row_of(t), k))
    first = {w: min(p) for w, p in places.items()}
    able = [(by_word, w) for by_word, w in first if by_word or len(w) >= 10]
    near = {(a, w) for a, w in able if any(a == b and first[b, v] < first[a, w] and abs(len(v) - len(w)) <= 1 and word_edit(v, w) for b, v in able)}
    out = collections.defaultdict(lambda: (set(), set()))
    for w, ps in places.items():
        for p in ps:
            if w in near:
                out[p[:3]][1].add(p[3])
            elif p != first[w]:
                out[p[:3]][0].add(p[3])
    return out


def row_of(text):
    return hashlib.md5((text or "").encode()).hexdigest()[:7]


def test_lines_against_brute_force_and_sql(spark, make_docs, edge_texts):
    texts = near_texts(random.Random(1)) + [(100 + (i or 0) if i is not None else None, t) for i, t in edge_texts]
    docs = make_docs(texts)
    got = linededup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "_lines"]
    gone = brute_lines(texts)
    want = []
    for i, t in texts:
        exact, near = gone.get((i is None, i or 0, row_of(t)), (set(), set()))
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in exact | near)
        want.append((str(i), str(kept), 0 if t is None else len(t.split("\n")), len(exact), len(near)))
    rows = [(str(r.doc_id), str(r.text), r._lines.n_lines, r._lines.n_exact, r._lines.n_near) for r in got.collect()]
    assert sorted(rows) == sorted(want)
    assert sum(r[4] for r in rows) > 20
    c = duckdb.connect()
    c.register("docs", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    sql = [(str(a), str(b), *rest) for a, b, *rest in c.execute(LINE_DEDUP.format(docs="docs", columns="r.doc_id,")).fetchall()]
    assert sorted(sql) == sorted(want)


def test_rows_that_share_or_lack_an_id_keep_their_own_lines(spark, make_docs):
    x, own = "the same line stands in many places", "a unique line that stands nowhere else at all"
    texts = [(1, x), (7, x), (7, own), (None, f"first of none of them\n{x}"), (None, f"quite another line to begin\n{x}"), (None, "and a third row without an id"), (8, f"{own} twice"), (8, f"{own} twice")]
    docs = make_docs(texts).withColumn("_lines", F.lit(1)).withColumn("_gone_doc", F.lit(2)).withColumn("row", F.lit(3))
    got = linededup.dedup_lines(docs)
    assert sorted(got.columns) == sorted(docs.columns)
    kept = sorted(r.text for r in got.collect())
    assert all(kept.count(line) == 1 for line in (x, own, "first of none of them", "quite another line to begin", "and a third row without an id"))
    assert kept == sorted(brute_kept(texts))


def brute_kept(texts):
    gone = brute_lines(texts)
    out = []
    for i, t in texts:
        exact, near = gone.get((i is None, i or 0, row_of(t)), (set(), set()))
        out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in exact | near))
    return out


def test_lines_without_broadcast_are_the_same(spark, make_docs, monkeypatch):
    docs = make_docs(near_texts(random.Random(2)))
    want = sorted(map(tuple, linededup.dedup_lines(docs).select("doc_id", "text").collect()))
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    assert sorted(map(tuple, linededup.dedup_lines(docs).select("doc_id", "text").collect())) == want
    assert linededup.dedup_lines(make_docs([])).count() == 0


def test_word_comparison_is_exact(spark):
    cases = [("a b c", "a b c"), ("a b c", "a x c"), ("a b", "a b c"), ("b c", "a b c"), ("a c", "a b c"), ("a b c", "c b a"), ("a b c d", "b c d a"), ("a", "a b c"), ("a b c", "x b y"), ("a a a", "a a"), ("x", "y")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(a.split(), b.split()) for a, b in cases], "x array<string>, y array<string>")
    both = df.select("x", "y", linededup.within_one(F.col("x"), F.col("y")).alias("r"), linededup.within_one(F.col("y"), F.col("x")).alias("s")).collect()
    for r in both:
        assert r.r == r.s == word_edit(r.x, r.y), (r.x, r.y)


def variants(rng, text, n, edits):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append(" ".join(w))
    return out


def brute_components(texts):
    sets = [(i, ngram_join.shingles(t)) for i, t in texts]
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if len(x) and len(y):
                inter = len(np.intersect1d(x, y))
                if 100 * inter >= 75 * (len(x) + len(y) - inter):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_jaccard_components_against_all_pairs(spark, make_docs):
    rng = random.Random(4)
    texts = []
    for size, n, edits in ((200, 60, 9), (40, 40, 4), (12, 30, 2), (6, 20, 1), (5, 8, 1), (3, 6, 1), (120, 1, 0)):
        texts += variants(rng, prose(rng, size), n, edits)
    shared = prose(rng, 30)
    texts += [f"{prose(rng, rng.randint(20, 60))} {shared} {prose(rng, 40)}" for _ in range(60)]
    long_text = prose(rng, 150)
    texts += [" ".join(long_text.split()[:k]) for k in range(60, 150, 3)]  # a chain of growing texts
    rng.shuffle(texts)
    pairs = list(enumerate(texts))
    got = ngram_join.jaccard_components(make_docs(pairs)).collect()
    assert sorted(map(tuple, got)) == brute_components(pairs)
    assert sorted(r.doc_id for r in ngram_join.first_of_groups(make_docs(pairs)).collect()) == sorted({c for _, _, c in brute_components(pairs)})


def test_jaccard_without_broadcast_and_with_tiny_buckets(spark, make_docs, monkeypatch):
    rng = random.Random(5)
    texts = [*enumerate(variants(rng, prose(rng, 80), 40, 8))]
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    assert sorted(map(tuple, ngram_join.jaccard_components(make_docs(texts)).collect())) == brute_components(texts)


def test_jaccard_edge_rows(make_docs, edge_texts):
    got = ngram_join.jaccard_components(make_docs(edge_texts)).collect()
    assert len(got) == len(edge_texts)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == by[5] and next(iter(by[1]))[1] == 1
    assert by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[7] == {(1, 7)}
    assert {c for _, c in by[None]} == {None} and len(by[8]) == 2
    assert ngram_join.jaccard_components(make_docs([])).count() == 0


def test_shingles_follow_the_contract():
    assert len(ngram_join.shingles("A b\tC\x0bd\x0ce")) == 1
    assert ngram_join.shingles("A B c D e").tolist() == ngram_join.shingles("a b C d E").tolist()
    assert ngram_join.shingles("É b c d e").tolist() != ngram_join.shingles("é b c d e").tolist()
    assert ngram_join.shingles("a b c d e f").tolist() == ngram_join.shingles("a b  c d e f").tolist()
    assert len(ngram_join.shingles("a b")) == 1 and ngram_join.shingles("a b").tolist() != ngram_join.shingles("a b c").tolist()


@pytest.mark.parametrize("size", [3, 5, 9, 20, 57, 130, 400])
def test_signatures_meet_for_every_linked_pair(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        pool = rng.integers(1, 1 << 62, 2 * size + 4, dtype=np.uint64)
        a = np.unique(pool[:size])
        cut = rng.integers(0, size // 4 + 1)
        b = np.unique(np.concatenate([a[cut:], pool[size : size + rng.integers(0, size // 3 + 1)]]))
        if ngram_join.linked(a, b):
            hashes, ends = np.concatenate([a, b]), np.cumsum([len(a), len(b)])
            sigs, owner = ngram_join.signatures(hashes, ends)
            both = set(sigs[owner == 0].tolist()) & set(sigs[owner == 1].tolist())
            assert both
            j = max(ngram_join.band(len(a)), ngram_join.band(len(b)))
            spare = max(ngram_join.instances(s, np.array([len(s)]), j - ngram_join.band(len(s)))[4][0] for s in (a, b))
            assert sum(x & 1 == j & 1 for x in both) >= max(spare, 1)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_exact_copies_alone_over_partitions(make_docs, parts):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve thirteen"
    texts = [(i, a if i % 3 else b) for i in range(12)] + [(50, None), (51, "alone among them all here")]
    got = ngram_join.jaccard_components(make_docs(texts).repartition(parts)).collect()
    assert sorted(map(tuple, got)) == brute_components(texts)


def test_a_thousand_near_misses_stay_apart(make_docs):
    rng = random.Random(8)
    base = prose(rng, 60).split()
    texts = []
    for i in range(1000):
        w = list(base)
        for k in rng.sample(range(60), rng.choice([1, 2, 3, 3, 3])):
            w[k] = f"x{rng.randrange(10**9)}"
        texts.append((i, " ".join(w)))
    got = ngram_join.jaccard_components(make_docs(texts).repartition(5)).collect()
    want = brute_components(texts)
    assert sorted(map(tuple, got)) == want
    assert 1 < len({c for _, _, c in want}) < 1000


def test_one_row_of_each_group_stays_where_ids_repeat(make_docs):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "another text that has no partner at all"
    texts = [(3, a), (8, a), (8, c), (9, b), (9, b), (None, a), (4, None), (4, None), (5, "")]
    kept = ngram_join.first_of_groups(make_docs(texts)).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(3, a), (8, c), (9, b), (None, a), (4, None), (4, None), (5, "")]))
    got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(make_docs([(3, a), (8, a), (8, c)])).collect()}
    assert got == {(3, 3), (8, 3), (8, 8)}


def test_components_of_paths_and_stars(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 901), (901, 900)]
    rng.shuffle(edges)
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 100) for i in range(101, 161)} | {(i, 500) for i in range(501, 560)} | {(901, 900)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_scores_against_plain_counts(make_docs, edge_texts):
    rng = random.Random(9)
    base = prose(rng, 80)
    texts = [*edge_texts, *((50 + i, t) for i, t in enumerate(variants(rng, base, 12, 6)))]
    got = lm_score.stupid_backoff(make_docs(texts)).collect()
    words = [(i, (t or "").lower().split()) for i, t in texts]
    grams = lambda w, k: collections.Counter(tuple(w[i - k + 1 : i + 1]) for i in range(k - 1, len(w)))
    total = {k: sum((grams(w, k) for _, w in words), collections.Counter()) for k in (1, 2, 3)}
    n, want = sum(len(w) for _, w in words), []
    for i, w in words:
        own, s = {k: grams(w, k) for k in (1, 2, 3)}, 0.0
        c = lambda g, own=own: total[len(g)][g] - own[len(g)][g]
        for p in range(len(w)):
            f, value = 1.0, None
            for k in (3, 2):
                g = tuple(w[p - k + 1 : p + 1])
                if p >= k - 1 and value is None:
                    if c(g) > 0:
                        value = f * c(g) / c(g[:-1])
                    else:
                        f *= 0.4
            s += math.log(value if value is not None else f * max(c((w[p],)), 0.5) / max(n - len(w), 1))
        want.append((str(i), len(w), round(s / len(w), 9) if w else None))
    assert sorted((str(r.doc_id), r.n_words, None if r.score is None else round(r.score, 9)) for r in got) == sorted(want, key=str)
    assert lm_score.stupid_backoff(make_docs([])).count() == 0


def test_packed_columns_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        v = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
        assert lm_score.unpack(lm_score.pack(v)).tolist() == v.tolist()
        c = np.where(rng.random(n) < 0.2, rng.integers(1, 1 << 40, n), 1)
        assert lm_score.unpack_counts(lm_score.pack_counts(c)).tolist() == c.tolist()
