"""Queries whose rows must cover the whole of their tables, against brute force on small fixtures."""

import math

from skyledger import queries


def test_nearest_grid_looks_at_the_whole_grid(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(25)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    spark.createDataFrame([(p,) for p in range(1, 5001)], "p_partkey bigint").write.parquet(str(tmp_path / "part.parquet"))

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, x)))

    def nearest(k, last):
        return min(km(k * 13 % 120 - 60 + 0.3, k * 37 % 360 + 0.2, p * 7 % 130 - 65, p * 11 % 360) for p in range(1, last + 1))

    got = {r.k: r.grid_dist_km for r in queries.QUERIES["nearest_grid"](spark, str(tmp_path)).collect()}
    want = {k: nearest(k, 5000) for k in range(25)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert any(nearest(k, 2000) > want[k] + 1 for k in want)  # the fixture shows a grid that is cut
