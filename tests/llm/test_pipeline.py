import random

import corpus_pipeline
from tramline.llm import quality

from .conftest import prose, rows
from .test_dedup import brute_components, brute_lines, row_of
from .test_text import brute


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    item = prose(rng, 40)
    common = prose(rng, 55)
    texts = [(i, prose(rng, rng.randint(30, 120)) + "\n" + prose(rng, 20)) for i in range(0, 120, 2)]
    texts += [(i, " | ".join(prose(rng, 1) for _ in range(70))) for i in range(1, 120, 2)]
    texts += [(200, texts[0][1]), (201, texts[1][1].replace("an", "en", 2)), (202, f"{prose(rng, 30)}\n{item}\n{prose(rng, 9)}"), (203, f"{prose(rng, 30)} {item} {prose(rng, 30)}"), (204, None), (205, "")]
    texts += [(210 + i, f"{prose(rng, 60)}\n{common}") for i in range(4)]
    near = prose(rng, 120)
    texts += [(220 + i, " ".join(w if j != 10 + 7 * i else "xx yy" for j, w in enumerate(near.split()))) for i in range(5)]
    docs = spark.createDataFrame([r[:5] for r in rows(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, int(i % 2 == 0), 0) for i in range(90)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    stage, now = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")

    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = stage["quality classifier"](spark, now, sf)
    good = {i for i, t in texts if model.score(quality._views([t], ["src"], ["en"], [None if t is None else len(t)]))[2][0] >= quality.KEEP}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    left = [(i, t) for i, t in texts if i in good]

    gone = brute_lines(left)
    want = []
    for i, t in left:
        out = set().union(*gone.get((False, i, row_of(t)), ((), ())))
        text = t if not out else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out)
        if not out or text.split():
            want.append((i, text))
    now = spark.createDataFrame([r[:5] for r in rows(left)], docs.schema)
    deduped = stage["line dedup"](spark, now, sf)
    assert sorted((r.doc_id, str(r.text)) for r in deduped.collect()) == sorted((i, str(t)) for i, t in want)
    assert all(r.text is None or r.n_chars == len(r.text) for r in deduped.collect()) and deduped.columns == docs.columns

    firsts = {c for _, _, c in brute_components(want)}
    now = spark.createDataFrame([r[:5] for r in rows(want)], docs.schema)
    single = stage["n-gram Jaccard join"](spark, now, sf)
    assert {r.doc_id for r in single.collect()} == firsts and single.columns == docs.columns
    left = [(i, t) for i, t in want if i in firsts]

    clean = {i for i, _ in left} - {i for i, *_ in brute(left, [(1, item)])}
    assert {i for i, _ in left} - clean <= {202, 203}
    now = spark.createDataFrame([r[:5] for r in rows(left)], docs.schema)
    assert {r.doc_id for r in stage["benchmark decontamination"](spark, now, sf).collect()} == clean

    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == clean
    assert all(r.offset + r.length <= 2048 for r in packed)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_dedup_keeps_rows_without_an_id_apart(spark, tmp_path):

    x, own = "the same line stands in many places", "a unique line that stands nowhere else at all"
    docs = spark.createDataFrame([r[:5] for r in rows([(1, x), (7, x), (7, own), (None, own + " but here"), (None, "something else entirely is written"), (None, None), (9, " ")])], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, str(tmp_path)).collect()
    # the second x goes with its row; null and blank texts have lost nothing
    assert sorted(str(r.text) for r in kept) == sorted([x, own, own + " but here", "something else entirely is written", "None", " "])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
