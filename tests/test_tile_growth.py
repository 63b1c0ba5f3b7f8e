"""The time that a tile takes grows as its features do."""

import time

from tramline.operators import mvt


def test_features_are_not_copied_with_each_other():
    def took(n):
        features = [([(10.0 + i % 1000 / 1000, 53.5)], {"name": f"C{i}", "text": "x" * 200}) for i in range(n)]
        began = time.process_time()
        data = mvt.encode_layer("places", features, 0, 0, 0)
        return time.process_time() - began, len(mvt.decode_layer(data)["features"])

    took(100)
    (few, n), (many, m) = took(10_000), took(80_000)
    assert (n, m) == (10_000, 80_000)
    assert many < 16 * few, (few, many)  # 8 times the features
