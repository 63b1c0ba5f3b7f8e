"""What a union of areas moves."""

from tramline.operators import polygons
from tramline.plans.stages import stored


def test_rings_of_their_own_take_no_rounds(spark):
    def square(x, y):
        return [(x, y), (x + 1.0, y), (x + 1.0, y + 1.0), (x, y + 1.0), (x, y)]

    apart = [("a", i, 0, square(3.0 * i, 0.0)) for i in range(50)]
    beside = [("b", i, 0, square(float(i), 9.0)) for i in range(2)]
    df = spark.createDataFrame(apart + beside, "state string, polygon int, nth int, ring array<struct<lon:double,lat:double>>")
    rows = []

    def store(frame):
        out = stored(frame)
        rows.append(out.count())
        return out

    got = polygons.union_polygons(df, ["state"], store).collect()
    assert sorted((r.state, len(r.ring) - 1) for r in got) == [("a", 4)] * 50 + [("b", 6)]
    assert rows[:1] == [206] and rows[1] < 60 and max(rows[2:]) < 10, rows
