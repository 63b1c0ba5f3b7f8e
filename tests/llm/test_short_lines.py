from collections import Counter

import corpus_pipeline
from tramline.llm import linededup

from .conftest import rows

TEXTS = [(1, "Read more\n\na b c d e f\n東京都千代田区一丁目"), (2, "read  MORE\n\na b c d x f\nRead less"), (3, "東京都千代田区一丁目\n東京都千代田区二丁目\nread more"), (None, "Read more\nlast one")]
KEPT = {1: TEXTS[0][1], 2: "\nRead less", 3: "", None: "last one"}


def test_short_lines_and_scripts_without_spaces(spark, make_docs, tmp_path):
    make_docs(TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = linededup.op2_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == KEPT
    assert {r.doc_id: (r.n_lines, r.n_exact, r.n_near) for r in got} == {1: (4, 0, 0), 2: (4, 1, 1), 3: (3, 2, 1), None: (2, 1, 0)}
    docs = spark.createDataFrame([r[:5] for r in rows(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == {k: v for k, v in KEPT.items() if v}


def test_no_exact_repeat_is_left(spark, make_docs):
    docs = make_docs([(i, "\n".join(" ".join("abcdefg"[: 1 + (i + k) % 7]) for k in range(4))) for i in range(9)])
    left = Counter(line for r in linededup.dedup_lines(docs).collect() for line in r.text.split("\n") if line.strip())
    assert left and max(left.values()) == 1
