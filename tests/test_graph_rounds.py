"""How much the searches over graphs write and how often, beside their results."""

import itertools

from tramline.operators import rail
from tramline.plans.stages import stored


class Counted:
    """stored, and the rows of each frame that it wrote."""

    def __init__(self):
        self.rows = []

    def __call__(self, df):
        out = stored(df)
        self.rows.append(out.count())
        return out


EDGE = "edge_id string, source string, target string, cost double"


def test_components_write_edges_once(spark):
    pairs = [(f"s{i % 7}", f"p{i:03d}") for i in range(120)] + [(f"s{i % 7}", f"p{(i + 1) % 120:03d}") for i in range(120)]
    pairs += [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("one", "one"), ("x", "y"), ("y", "x")]
    edges = spark.createDataFrame([(str(n), a, b, 1.0) for n, (a, b) in enumerate(pairs)], EDGE)
    store = Counted()
    got = {r.node: r.component for r in rail.components(edges, store).collect()}
    expected = {}
    for a, b in pairs:
        expected.setdefault(a, a), expected.setdefault(b, b)
    for _ in pairs:
        for a, b in pairs:
            expected[a] = expected[b] = min(expected[a], expected[b])
    assert got == expected
    assert max(store.rows) <= len(pairs)


def test_only_edges_at_a_through_node_are_put_in_order(spark):
    pairs = list(itertools.combinations([f"k{i}" for i in range(6)], 2)) + [("k0", "m"), ("m", "k1")]
    edges = spark.createDataFrame([(f"e{n}", a, b, 1.0) for n, (a, b) in enumerate(pairs)], EDGE)
    store = Counted()
    ways, members = rail.contracted(edges, spark.createDataFrame([("k5",)], "node string"), store)
    assert max(store.rows) <= 4
    ways, members = ways.collect(), members.collect()
    assert sorted(r.edge_id for r in members) == sorted(f"e{n}" for n in range(len(pairs))) and len(ways) == len(pairs) - 1
    through = [r for r in ways if {r.source, r.target} == {"k0", "k1"} and r.cost == 2.0]
    assert len(through) == 1 and sorted(m.edge_id for m in members if m.way == through[0].way) == ["e15", "e16"]


def test_several_arcs_are_followed_in_a_stored_round(spark):
    arcs = [(f"n{i:02d}", f"n{i + 1:02d}", 1.0 + i % 3, f"w{i}", False) for i in range(40)]
    arcs += [(b, a, c, w, True) for a, b, c, w, _ in arcs]
    store = Counted()
    asked = spark.createDataFrame([("n00", "n40"), ("n07", "n03")], "source string, target string")
    found = {(r.source, r.target): (r.cost, [(p.way, p.back) for p in r.path]) for r in rail.cheapest(spark.createDataFrame(arcs, "a string, b string, cost double, way string, back boolean"), asked, store).collect()}
    assert found == {("n00", "n40"): (sum(1.0 + i % 3 for i in range(40)), [(f"w{i}", False) for i in range(40)]), ("n07", "n03"): (sum(1.0 + i % 3 for i in range(3, 7)), [(f"w{i}", True) for i in range(6, 2, -1)])}
    assert len(store.rows) <= 55
