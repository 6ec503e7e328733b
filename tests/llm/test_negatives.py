import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from briarlake.llm.negatives import Lists, Mining, hard_negatives
from briarlake.llm.queries import op11_hard_negatives
from briarlake.scratch import Scratch
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, label int"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every=50, how=Mining()):
    """Over (vec_id, vector, label), by comparing each anchor with all rows; ids differ."""
    usable = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, va, la in usable:
        if a is None or a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i is None, i, y) for i, v, y in usable if i != a)
        for s, _, p, y in [x for x in scored if x[3] == la][: how.positives]:
            fit = [(n, -t) for t, _, n, z in scored if z != la and how.low * -s <= 100 * -t <= how.high * -s]
            out |= {(a, p, k + 1, n, -s, t) for k, (n, t) in enumerate(fit[: how.negatives])}
    return out


def found(frame):
    rows = [tuple(r[n] for n in NAMES) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def mined(spark, rows, lists=Lists(), every=50, how=Mining(), schema=SCHEMA):
    return found(hard_negatives(spark.createDataFrame(rows, schema), Scratch(spark, "t"), F.col("vec_id") % every == 0, how, lists))


def clouds(seed, n=400, d=8, labels=3):
    draw = np.random.default_rng(seed)
    middles = draw.standard_normal((9, d))
    return [(k, (middles[draw.integers(9)] + 0.3 * draw.standard_normal(d)).tolist(), int(draw.integers(labels))) for k in range(n)]


@pytest.mark.parametrize("lists", [Lists(), Lists(rows=20, visits=1, growth=2), Lists(rows=40, block=7, chunk=2, visits=1, growth=3, sample=50)])
def test_against_all_rows(spark, lists):
    rows = clouds(1)
    assert mined(spark, rows, lists, every=20) == plain(rows, every=20)


def test_other_windows_and_counts(spark):
    rows = clouds(2)
    how = Mining(positives=2, negatives=7, low=20, high=80)
    assert mined(spark, rows, Lists(rows=25, visits=2), 10, how) == plain(rows, 10, how)


def test_ties_fall_to_smaller_ids_across_lists(spark):
    rows = [(k, [1.0, float(k % 4 == 0)], k % 2) for k in range(100)]
    assert mined(spark, rows, Lists(rows=5, block=4, visits=1), 10) == plain(rows, 10)


def test_odd_rows(spark):
    rows = [*clouds(3, 120), (200, None, 0), (201, [1.0] * 8, None), (202, [float("nan")] * 8, 1), (203, [None] + [1.0] * 7, 1), (204, [float("inf")] * 8, 1), (205, [], 0), (206, [1.0, 2.0], 1), (None, [0.5] * 8, 1), (250, [1e300] * 8, 2)]
    assert mined(spark, rows[:-1], every=10) == plain(rows[:-1], 10)
    assert mined(spark, rows) is not None  # parts beyond 31 bits stop at their bounds
    assert mined(spark, rows[:0] or [(1, None, None)]) == set()
    frame = spark.createDataFrame(rows[:2], SCHEMA)
    assert hard_negatives(frame.limit(0), Scratch(spark, "t"), F.col("vec_id") % 50 == 0).count() == 0


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.9, 0.0], 1), (1, [0.9, 0.0], 1)]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r[n] for n in NAMES) for r in got) == sorted([(0, 0, 1, 1, 65536, 58880), (0, 0, 2, 1, 65536, 58880)] * 2)


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(2**20 + k), float(2**19 - 3 * k)], k % 2) for k in range(60)]
    assert mined(spark, rows, every=10, how=Mining(low=1, high=100)) == plain(rows, 10, Mining(low=1, high=100))


def test_clashing_names(spark):
    rows = [(*r, 1, 2, 3) for r in clouds(4, 100)]
    assert mined(spark, rows, every=10, schema=SCHEMA + ", row int, list int, score int") == plain([r[:3] for r in rows], 10)


def test_query_against_all_rows(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{brute.SMALL}/embeddings.parquet").collect()]
    assert found(op11_hard_negatives(spark, brute.SMALL)) == plain(rows)
