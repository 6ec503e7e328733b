import numpy as np

from briarlake.llm.embeddings import Tables, near_duplicates
from briarlake.llm.queries import op3_embedding_near_dedup
from briarlake.scratch import Scratch
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, label int"


def found(frame):
    return {r.vec_id: (r.n_links, r.component_id) for r in frame.collect()}


def clustered(seed, n=160):
    draw = np.random.default_rng(seed)
    bases = draw.standard_normal((12, 16))
    rows = []
    for k in range(n):
        v = bases[draw.integers(12)] + draw.standard_normal(16) * draw.choice([0, 0.02, 0.12])
        rows.append((k, v.tolist(), int(draw.integers(2))))
    return rows


def test_against_all_pairs(spark):
    rows = clustered(1)
    want = brute.cosine_links(rows)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"))
    assert found(got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_large_buckets_are_compared_by_blocks(spark):
    rows = clustered(2)
    assert found(near_duplicates(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"), Tables(block=5))) == brute.cosine_links(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, None), (4, v, 1), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0), (8, [float("nan"), 1.0, 1.0], 0), (9, [1.0, None, 3.0], 0), (10, [2.0, 4.0, 6.0], 0), (11, [1.0, 2.0], 0), (12, [float("inf"), 0.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(near_duplicates(frame, Scratch(spark, "t"))) == brute.cosine_links(rows)
    assert near_duplicates(frame.limit(0), Scratch(spark, "t")).count() == 0
    with_null = near_duplicates(spark.createDataFrame([(None, v, 0), (3, v, 0), (None, None, 0)], SCHEMA), Scratch(spark, "t")).collect()
    assert sorted(map(tuple, with_null), key=str) == sorted([(3, 1, 3, True), (None, 1, 3, False), (None, 0, None, False)], key=str)


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{brute.SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(op3_embedding_near_dedup(spark, brute.SMALL)) == brute.cosine_links(rows)


def test_signs_and_tables_follow_the_data():
    for largest in (0, 1, 600, 10_000, 10**6, 10**10):
        tables, bits = Tables().sizes(largest)
        assert 4 <= bits <= 20 and (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 0.001
    assert Tables().sizes(10**6)[1] > Tables().sizes(1000)[1]


def test_huge_parts_and_single_precision(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [2e200, 2e200], 0), (3, [1e-200, 1e-200], 0), (4, [1.0, -1.0], 0)]
    assert found(near_duplicates(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"))) == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
    rows = [(k, np.float32(v).tolist(), label) for k, v, label in clustered(3)]
    single = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert found(near_duplicates(single, Scratch(spark, "t"))) == brute.cosine_links(rows)


def test_clashing_names_and_long_vectors(spark):
    rows = [(k, [float(x % 7 + k % 2 * x) for x in range(5000)], 0, 1, 2, 3) for k in range(4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key int, cid int, vector int")
    assert found(near_duplicates(frame, Scratch(spark, "t"))) == brute.cosine_links([r[:3] for r in rows])
