"""Lines merged within a row and in rounds give the same lines."""

import random

from pyspark.sql import functions as F

from tramline.operators import lines
from tramline.plans.stages import stored


def _ways():
    rng, rows = random.Random(3), []
    for way in range(120):
        for part in rng.sample(range(1000), rng.randint(1, 12)):
            a, b = ((float(rng.randint(-2, 2)), 0.0) for _ in range(2))
            rows.append((way if way else None, part, [a, (float(part) + 0.5, 1.0), b]))
    rows += [(500, 7, [(0.0, 0.0), (1.0, 0.0)]), (500, 8, [(2.0, 0.0), (-0.0, 0.0)]), (500, 9, [(5.0, 5.0)]), (501, 1, [(float("nan"), 0.0), (1.0, 0.0)]), (501, 2, [(float("nan"), 0.0), (2.0, 0.0)])]
    return rows + [(600, i, [(float(i), 0.0), (float(i + 1), 0.0)]) for i in range(lines.FEW_PARTS + 9)]


def test_few_parts_as_in_rounds(spark):
    df = spark.createDataFrame(_ways(), "id int, part int, line array<struct<lon:double,lat:double>>").repartition(4)
    plain = lambda frame: sorted(repr(tuple(r)) for r in frame.collect())
    kept = df.where(F.size("line") >= 2).withColumn("g", F.struct("id"))
    rounds = plain(lines._merged_many(kept, ["id"], stored))
    assert plain(lines.merge_lines(df, ["id"], stored)) == rounds
    one = df.where("id = 600").select("part", "line")
    assert [len(r.line) for r in lines.merge_lines(one, [], stored).collect()] == [lines.FEW_PARTS + 10]


def test_few_parts_take_no_rounds(spark):
    df = spark.createDataFrame([r for r in _ways() if r[0] != 600], "id int, part int, line array<struct<lon:double,lat:double>>")
    rows = []

    def store(frame):
        out = stored(frame)
        rows.append(out.count())
        return out

    assert lines.merge_lines(df, ["id"], store).count() > 100
    assert sum(rows) == 0
