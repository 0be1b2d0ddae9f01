import numpy as np
import pytest

from tessera.operators import demosaic, kernels, tiles


@pytest.mark.parametrize("pattern", ["RGGB", "GRBG", "GBRG", "BGGR"])
@pytest.mark.parametrize("method", sorted(kernels.KERNELS))
def test_constant_and_tiles(spark, method, pattern):
    flat = kernels.demosaic(np.full((40, 38), 5000), method, pattern)
    assert all(abs(c[6:-6, 6:-6] - 5000).max() <= 1 for c in flat)
    s = np.random.default_rng(1).integers(0, 65536, (41, 35))
    whole = kernels.demosaic(s, method, pattern)
    df = spark.createDataFrame([(0, y, x, int(s[y, x])) for y in range(41) for x in range(35)], "image_id int, y int, x int, s int")
    got = tiles.demosaic(df, method, pattern, tile=20).toPandas().sort_values(["y", "x"])
    assert len(got) == s.size
    assert all((got[c].to_numpy().reshape(s.shape) == w).all() for c, w in zip("rgb", whole))


@pytest.mark.parametrize("method", [m for m in demosaic.METHODS if m != "NONE"])
def test_long_form_keeps_a_constant(spark, method):
    df = spark.createDataFrame([(0, y, x, 777) for y in range(9) for x in range(7)], "image_id int, y int, x int, s int")
    assert {tuple(r) for r in demosaic.demosaic(df, method, "GBRG").select("r", "g", "b").collect()} == {(777, 777, 777)}


def test_similarity_of_equals():
    a = np.random.default_rng(2).random((30, 30))
    assert np.allclose(kernels.similarity(a, a), 1)
