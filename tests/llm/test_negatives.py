import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from casebook.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 2), (64, 64, 64), (100, 70, 130), (128, 64, 1000), (33, 0, 4)])
def test_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
    assert (negatives.strassen(a, b, leaf=4) == a @ b).all()
    large, other = a * 2**40 + 1, b * 2**20  # partial sums may wrap, the product is the same modulo 2**64
    assert (negatives.strassen(large, other, leaf=4) == large @ other).all()


def mined(spark, table, **settings):
    df = spark.createDataFrame(table, SCHEMA)
    out = negatives.mine(df, F.col("vec_id") % 10 == 0, negatives.MiningSettings(**settings)).collect()
    return sorted(tuple(r) for r in out)


def test_same_as_plain(llm):
    rng = np.random.default_rng(3)
    rows = [(i - 20, int(rng.integers(0, 4)), [float(x) for x in rng.normal(0.1, 0.2, 12).astype(np.float32)]) for i in range(300)]
    rows += [(i, 1, rows[5][2]) for i in range(400, 440)] + [(500, 77, [0.5] * 12), (501, 77, [0.375] * 12)]  # ties, a small label
    want = plain.hard_negatives(rows)
    assert want == mined(llm, rows) == mined(llm, rows, group=37, rows=3, columns=11, leaf=2)


def test_odd_rows(llm):
    good = [(i, i % 2, [0.5 + i / 64, 0.25]) for i in range(12)]
    bad = [(20, None, [1.0, 1.0]), (30, 1, None), (40, 1, [1.0, None]), (50, 0, [math.nan, 1.0]), (60, 1, [math.inf, 0.0]), (None, 1, [1.0, 1.0]), (70, 0, [1e30, 1.0])]
    assert mined(llm, good + bad) == mined(llm, good) == mined(llm, good * 2) != []
    assert mined(llm, []) == []
    uneven = [*good, (80, 0, []), (90, 1, [0.5]), (91, 0, [0.75, 0.5, 3.0])]
    assert mined(llm, uneven) == plain.hard_negatives(uneven)
    # one id with two vectors: both take part
    twice = [*good, (10, 0, [0.25, 0.875]), (3, 1, [0.875, 0.125])]
    assert len({r[1] for r in mined(llm, twice)}) >= len({r[1] for r in mined(llm, good)})
    clash = llm.createDataFrame(good, SCHEMA).withColumns({"key": F.lit("k"), "vector": F.lit(1), "g": F.lit(2), "anchor": F.lit("a")})
    assert sorted(tuple(r) for r in negatives.mine(clash, F.col("vec_id") % 10 == 0).collect()) == mined(llm, good)
