import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tramline.llm import decontaminate, pii, quality
from tramline.llm.pii_training import KINDS, labelled_sentences

from .conftest import prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def naive(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ["email", "ip", "card", "phone"].index(s[2])))


@given(st.text(alphabet=st.sampled_from("a.b@@c-%+(0123456789 )é\n"), max_size=80))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == naive(text)


def test_base_examples():
    text = "mail a.b@x.org, 4111 1111 1111 1111 or +1 (415) 555-2671; 10.0.0.256 and 10.0.0.25 01.2.3.4.5"
    assert [text[a:b] for a, b, _ in pii.base_spans(text)] == ["a.b@x.org", "4111 1111 1111 1111", "+1 (415) 555-2671", "10.0.0.25", "01.2.3.4"]


@pytest.fixture(scope="module")
def crf():
    return pii.train_crf(labelled_sentences())


def test_tagger_on_held_out_sentences(crf):
    rows = labelled_sentences(205, seed=99)
    want = np.array([KINDS.index(k) for _, kinds in rows for k in kinds])
    got = crf.decode([w for w, _ in rows])
    assert (got == want).mean() > 0.98
    assert (got[want > 0] == want[want > 0]).mean() > 0.9


def test_viterbi_finds_the_best_path(crf):
    rng = np.random.default_rng(4)
    sizes = np.array([1, 3, 5, 2, 5])
    score = rng.normal(0, 2, (sizes.sum(), len(KINDS))).astype(np.float32)
    got, at = crf._viterbi(score, sizes), 0
    import itertools

    for n in sizes:
        own = score[at : at + n]
        value = lambda path, own=own, n=n: crf.begin[path[0]] + sum(own[i, path[i]] for i in range(n)) + sum(crf.links[path[i], path[i + 1]] for i in range(n - 1))
        best = max(itertools.product(range(len(KINDS)), repeat=int(n)), key=value)
        assert abs(value(best) - value(tuple(got[at : at + n]))) < 1e-4
        at += n


def test_personal_data_of_documents(crf, make_docs, edge_texts):
    texts = [*edge_texts, (50, "My name is Anna Miller and\ntoken = \"" + "ab12" * 10 + "\" here, mail x@y.zz +49 170 1234567")]
    got = pii.find_personal_data(make_docs(texts), crf).collect()
    assert len(got) == len(texts)
    want = sorted((str(i), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in naive(t or "")).encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    (row,) = [r for r in got if r.doc_id == 50]
    found = {k: texts[-1][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in row.spans.split(","))}
    assert found["email"] == "x@y.zz" and found["phone"] == "+49 170 1234567" and "Anna Miller" in found["name"] and found["secret"] == "ab12" * 10
    assert pii.find_personal_data(make_docs([]), crf).count() == 0


def test_quality_tells_junk_from_prose(spark, make_docs):
    rng = random.Random(6)
    good = [(i, prose(rng, rng.randint(40, 300))) for i in range(0, 240, 2)]
    bad = [(i, " | ".join(prose(rng, 1) for _ in range(60)) if i % 4 == 1 else " ".join(w + "$$$" for w in prose(rng, 80).split())) for i in range(1, 240, 2)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0, "x") for i, _ in good[:60] + bad[:60]] + [(None, 1, 0, "x"), (7, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    docs = make_docs(good + bad)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert len(kept & {i for i, _ in good[60:]}) >= 54 and len(kept & {i for i, _ in bad[60:]}) <= 3
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_quality_of_edge_rows(spark, make_docs, edge_texts):
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 1)], "doc_id long, quality int")
    docs = make_docs(edge_texts)
    docs = docs.unionByName(docs.limit(1).selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars", "cls", "n", "label", "k1", "doc", "first"))
    model = quality.fit_quality(docs, labels)
    rows = docs.select(quality.score_column(model)(docs).alias("q")).collect()
    assert len(rows) == len(edge_texts) + 1 and all(0 <= r.q.score <= 1 for r in rows)


ITEM = "A train leaves the old harbour station with 240 passengers and after 3 hours Maria counts the seats that Peter left empty for 15 km of track."


def plain_template(text, opening=True, names=True):
    """(word, placeholder or literal) of each word, by the rules alone."""
    out, opens = [], opening
    for w in (text or "").split():
        bare = w.strip(decontaminate.OUTER)
        if decontaminate.NUMBER.fullmatch(bare) or bare.lower() in decontaminate.NUMBER_WORDS:
            kind = "<num>"
        elif bare.lower() in decontaminate.UNITS:
            kind = "<unit>"
        elif names and bare[:1].isupper() and not bare.isupper() and not opens:
            kind = "<name>"
        else:
            kind = bare.lower()
        out.append((bare.lower(), kind))
        opens = w[-1:] in tuple(".!?:\"”»")
    return out


def runs_of(template):
    size = min(5, len(template))
    return [template[i : i + size] for i in range(len(template) - size + 1)] if template else []


def brute(texts, items):
    """(document, item, windows, counted, verbatim) by comparing all windows with all, slots included."""
    kinds = lambda run: tuple(k for _, k in run)
    out = []
    for i, t in texts:
        there = runs_of(plain_template(t))
        for j, text in items:
            own = runs_of(plain_template(text))
            other = [runs_of(plain_template(text, names=False)), runs_of(plain_template(text, opening=False))[:1]]
            pairs = [(p, q) for q in range(len(own)) for p, run in enumerate(there) if kinds(run) in {kinds(own[q]), *(kinds(r[q]) for r in other if q < len(r))}]
            total = len({kinds(r) for r in own})
            if not total or len({kinds(own[q]) for _, q in pairs}) < 0.75 * total:
                continue
            shifts = collections.defaultdict(list)
            for p, q in pairs:
                shifts[p - q].append((p, q))
            to, back, counted, verbatim = {}, {}, set(), set()
            for s in sorted(shifts, key=lambda s: (-len(shifts[s]), s)):
                for p, q in sorted(shifts[s]):
                    slots = [(k, a, b) for (a, k), (b, m) in zip(own[q], there[p], strict=True) if k == m and k in ("<num>", "<name>", "<unit>")]
                    if all(to.get((k, a), b) == b and back.get((k, b), a) == a for k, a, b in slots):
                        to.update({(k, a): b for k, a, b in slots})
                        back.update({(k, b): a for k, a, b in slots})
                        counted.add(kinds(own[q]))
                        if all(a == b for _, a, b in slots):
                            verbatim.add(kinds(own[q]))
            if len(counted) >= 0.75 * total:
                out.append((i, j, total, len(counted), len(verbatim)))
    return sorted(out)


def test_decontamination(spark, make_docs, edge_texts):
    rng = random.Random(8)
    other = ITEM.replace("240", "3,100").replace("Maria", "Olga").replace("Peter", "Ivan").replace("15 km", "9 miles")
    texts = [*edge_texts, (20, f"{prose(rng, 30)} {ITEM} {prose(rng, 30)}"), (21, f"{prose(rng, 30)}\n{other}\n{prose(rng, 30)}"), (22, " ".join(ITEM.split()[:12])), (23, prose(rng, 300)), (24, ITEM.upper())]
    items = [(1, ITEM), (2, ITEM), (3, None), (4, ""), (None, ITEM), (5, "one two"), (6, prose(rng, 25))]
    benchmark = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    docs = make_docs(texts)
    for most in (10**6, 30):
        got = decontaminate.contaminated(docs, benchmark, most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(20, 1), (20, 2), (21, 1), (21, 2), (24, 1), (24, 2), (7, 5)}
        assert all(r.n_verbatim < r.n_matched for r in got if r.doc_id == 21) and all(r.n_verbatim == r.n_matched for r in got if r.doc_id == 20)
        left = decontaminate.drop_contaminated(docs, benchmark, most)
        assert {r.doc_id for r in left.collect()} == {i for i, _ in texts} - {20, 21, 24, 7} and left.columns == docs.columns
        named = [(i, j) for i, j in items if i is not None]
        assert sorted((r.doc_id, r.item_id, r.n_windows, r.n_matched, r.n_verbatim) for r in got) == brute(texts, named)
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def test_inconsistent_slots_do_not_count(spark, make_docs):
    item = "so then Maria met Peter and Maria saw Peter when Maria left Peter alone near Maria and Peter again"
    texts = [(1, "so then Olga met Ivan and Olga saw Ivan when Olga left Ivan alone near Olga and Ivan again"), (2, "so then Olga met Ivan and Lena saw Karl when Nina left Hugo alone near Otto and Emil again")]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.contaminated(make_docs(texts), benchmark).collect()
    assert [r.doc_id for r in got] == [1] and brute(texts, [(1, item)]) == [(1, 1, r.n_windows, r.n_matched, r.n_verbatim) for r in got]


def test_decontamination_of_generated_questions(spark, make_docs):
    rng = random.Random(11)
    names, units = ["Maria", "Peter", "Olga", "Ivan"], ["km", "kg", "hours"]
    words = prose(rng, 40).replace(".", "").lower().split()
    made = lambda: " ".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(names), str(rng.randint(1, 9)), rng.choice(units)]) for _ in range(14))
    items = [(i, made()) for i in range(12)]
    swap = lambda t: " ".join(rng.choice(names) if w in names else str(rng.randint(1, 9)) if w.isdigit() else w for w in t.split())
    texts = [(100 + k, f"{prose(rng, 8)} {rng.choice([t, swap(t), t.upper()])} {prose(rng, 8)} {swap(items[(k + 5) % 12][1])}") for k, (_, t) in enumerate(items * 3)]
    texts = [(i + 1000 * n, t) for n, (i, t) in enumerate(texts)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(make_docs(texts), benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.n_windows, r.n_matched, r.n_verbatim) for r in got) == brute(texts, items) and len(got) > 20
