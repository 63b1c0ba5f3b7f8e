"""Runs against brute force over all periods."""

import random
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from tramline.llm import periodic


def brute_runs(words, length=24, exponent=3):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            size = k - start + q
            if size >= max(length, exponent * q):
                part = words[start : start + size]
                if not any(all(part[t] == part[t + p] for t in range(size - p)) for p in range(1, q)):
                    out.append((start, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    words, word = [], ""
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    return words + ([word] if word else [])


def brute(docs):
    out = []
    for doc_id, text in docs:
        words = split(text or "")
        h, n = (1 if doc_id is None else zlib.crc32(str(doc_id).encode())), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        keep = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)]
        digest = lambda s: sha256(s.encode()).hexdigest()
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        out.append((doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], digest(lines), digest(" ".join(keep))))
    return sorted(out, key=repr)


def repetitive(rng, n):
    words = [rng.choice("a b c".split()[: rng.randint(1, 3)]) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        end = min(n, a + p * rng.randint(2, 9))
        words = [w if not a <= i < end else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("limits", [(24, 3), (2, 2), (6, 3), (5, 2), (4, 4), (1, 2)])
def test_runs_equal_brute_force(limits):
    rng = random.Random(sum(limits))
    for _ in range(60):
        docs = [repetitive(rng, rng.choice([1, 5, 30, 70])) for _ in range(rng.randint(0, 5))] + [[]]
        found = periodic.runs_of([np.array([ord(w) - 96 for w in d], np.int64) for d in docs], *limits)
        assert [[tuple(r) for r in f.tolist()] for f in found] == [brute_runs(d, *limits) for d in docs]


def test_run_rich_words():
    a, b = [1], [1, 2]
    while len(b) < 700:
        a, b = b, b + a
    for word in (b, [1] * 500, [1, 2] * 250 + [1], b[:300] * 3):
        assert [tuple(r) for r in periodic.runs_of([np.array(word)], 8, 2)[0].tolist()] == brute_runs(word, 8, 2)


def test_next_past():
    rng = random.Random(2)
    for n in (1, 2, 50):
        rank = np.array(rng.sample(range(n), n))
        for smaller in (True, False):
            brute_next = [next((j for j in range(i + 1, n) if (rank[j] < rank[i]) == smaller), n) for i in range(n)]
            assert periodic.next_past(rank, smaller).tolist() == brute_next


def test_exponents_are_compared_exactly():
    big = 10**9
    assert periodic.strongest(np.array([[0, 3 * big, big], [7, 3 * big + 1, big], [9, 3 * big + 4, big + 1]])) == (7, 3 * big + 1, big)
    assert periodic.strongest(np.array([[3, 30, 10], [5, 60, 20]])) == (3, 30, 10)


def sample(edge_texts):
    rng = random.Random(11)
    own = [(i, " ".join(repetitive(rng, rng.choice([0, 10, 90]) or 1))) for i in range(20, 120)]
    return [*edge_texts, *own, (200, "na " * 3000), (201, "x y z\x1cw " * 30), (None, "la \t la\x0bla\n" * 12)]


def test_query_equals_brute_force(spark, make_docs, edge_texts, tmp_path):
    docs = sample(edge_texts)
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    df = periodic.op13_runs(spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.select(*(c.split()[0] for c in periodic.RUNS.split(", "))).collect()), key=repr)
    assert got == brute(docs)
    assert sum(r[1] > 0 for r in got) > 15


def test_operator_gives_runs_and_texts(make_docs):
    rows = periodic.find_runs(make_docs([(1, "so  la la\tla la end"), (2, None)]), length=4).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in sorted(rows)] == [(1, [(1, 4, 1)], "so la end"), (2, [], "")]


def test_empty_table(make_docs):
    assert periodic.run_digests(make_docs([])).collect() == []
