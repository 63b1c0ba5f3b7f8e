import random

from tramline.llm import quality

from .conftest import prose


def test_toxic_documents_are_rejected(spark, make_docs):
    rng = random.Random(8)
    texts = []
    for i in range(240):
        w = prose(rng, rng.randint(40, 120)).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["Moron,", "idiot"]))
        texts.append((i, " ".join(w)))
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert not {i for i in kept if i >= 160 and i % 4 == 0} and len({i for i in kept if i >= 160}) >= 57
    assert quality.keep_good(docs, labels).columns == docs.columns
