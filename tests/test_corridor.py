"""Tracks that meet a corridor, in both directions."""

from tests.test_whole import write
from tramline.plans import maps

W, S, E, N = 9.55, 53.50, 10.45, 54.45


def test_tracks_to_the_east_and_north_meet_the_corridor(spark, tmp_path):
    keys = range(2400)  # all places that there are
    d = write(spark, tmp_path, "customer", [(k,) for k in keys], "c_custkey long")
    want = set()
    for k in keys:
        x, y = 6.5 + k * 37 % 800 / 100, 52 + k * 53 % 300 / 100
        if x + 0.4 >= W and x <= E and S <= y <= N:
            want.add(f"e-{k}")
        if W <= x <= E and y + 0.25 >= S and y <= N:
            want.add(f"n-{k}")
    got = [r.edge_id for r in maps.corridor_filter(spark, d).collect()]
    assert set(got) == want and len(got) == len(want)
    # some enter from outside in either direction
    outside = {e for e in want if not (W <= 6.5 + int(e[2:]) * 37 % 800 / 100 <= E and S <= 52 + int(e[2:]) * 53 % 300 / 100 <= N)}
    assert {e[0] for e in outside} == {"e", "n"}
