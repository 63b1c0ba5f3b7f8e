"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tramline.llm import spelling


def brute_words(docs, typos, least, occurrences):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if typos and h % 199 == 0:
                word = "".join(c for i, c in enumerate(word) if i != h % len(word))
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, typos=True, least=6, occurrences=5):
    n = brute_words(docs, typos, least, occurrences)
    near = {w: sorted((v for v in n if one_edit(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 5 * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def invented(seed, words=1000):
    """Texts over few letters, full of near words and of bigrams that stand more than once in a word."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abAé×") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    base += [b[:i] + rng.choice("abé") + b[i + rng.randint(0, 1) :] for b in base for i in (0, 3, len(b) - 1)]
    weights = [6.0 ** -(i % 4) for i in range(len(base))]
    return [(i, " ".join(rng.choices(base, weights, k=words)) + rng.choice(["", ".", " 12 ß東"])) for i in range(20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(make_docs, seed):
    docs = invented(seed)
    expected = brute(docs)
    assert got(spelling.variants(make_docs(docs), typos=True)) == expected
    assert any(r[1] for r in expected)


def test_short_words_and_single_occurrences(make_docs):
    docs = [(i, t[:800]) for i, t in invented(3)]
    assert got(spelling.variants(make_docs(docs), typos=False, least=4, occurrences=1)) == brute(docs, False, 4, 1)


def test_chains_lead_to_the_last_form(make_docs):
    chain = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg", "lkjihg"]
    docs = [(1, " ".join(w for i, w in enumerate(chain) for _ in range(5 ** (i + 1)))), (2, None)]
    rows = {r[0]: r for r in got(spelling.variants(make_docs(docs)))}
    assert {rows[w][2] for w in chain} == {"lkjihg"} and rows["lkjihg"][1] is None
    assert [rows[w][1] for w in chain[:-1]] == chain[1:]


def test_ties_go_to_the_smaller_word(make_docs):
    docs = [(1, " ".join(["bbbbbb"] * 5 + ["bbbbbz"] * 25 + ["bbbbbc"] * 25))]
    assert {r[0]: r[1] for r in got(spelling.variants(make_docs(docs)))}["bbbbbb"] == "bbbbbc"


def test_defined_cases(make_docs, edge_texts):
    docs = [*edge_texts, (None, "Wörter Wörter wörter WÖRTER " * 3), (20, "x" * 100_000 + " " + "y" * 99_999)]
    assert got(spelling.variants(make_docs(docs), typos=True)) == brute(docs)
    assert got(spelling.variants(make_docs([]))) == []
    with pytest.raises(ValueError):
        spelling.variants(make_docs([]), least=3)


def test_query_over_a_written_table(spark, make_docs, tmp_path):
    docs = invented(4)
    make_docs(docs).write.parquet(f"{tmp_path}/documents.parquet")
    assert got(spelling.op11_spelling(spark, str(tmp_path))) == brute(docs)
