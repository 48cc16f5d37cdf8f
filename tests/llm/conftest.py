import numpy as np
import pytest


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="session")
def cloud():
    """Vectors with near-duplicates, copies, scaled copies and strangers: key -> vector."""
    rng = np.random.default_rng(5)
    base = unit(rng.normal(size=(120, 64)))
    rows, key = {}, 1
    for i, b in enumerate(base):
        for _ in range(1 + (i % 4 == 0) * 5):
            rows[key] = (b + 0.03 * rng.normal(size=64)).astype("f4") if i % 8 == 0 else b.astype("f4") * (1 + key % 3)
            key += 1
    return rows


VECTORS = "model string, masking string, key long, embedding array<float>, rep long, grp string"


@pytest.fixture(scope="session")
def vector_table(spark, cloud):
    rows = [("m", "unmasked", k, v.tolist(), 7, "x") for k, v in cloud.items()]
    rows += rows[:5]  # repeated rows
    rows += [("m", "masked", 1, [1.0] * 64, 7, "x"), ("m", "unmasked", 9001, [0.0] * 64, 7, "x"), ("m", "unmasked", 9002, [1.0] * 48, 7, "x"), ("m", "unmasked", 9003, None, 7, "x"), ("m", "unmasked", None, [1.0] * 64, 7, "x")]
    rows += [("m", None, 9004, [1.0] * 64, 7, "x"), ("m", "unmasked", 9005, [float("nan")] + [1.0] * 63, None, None), ("m", "unmasked", 9006, [None] + [1.0] * 63, None, None)]
    return spark.createDataFrame(rows, VECTORS)
