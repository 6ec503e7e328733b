import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from briarlake.llm.mixing import emit, mix_documents
from briarlake.llm.queries import op4_mixing
from briarlake.llm.text import word_count
from briarlake.scratch import Scratch
from tests.llm import brute


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return mix_documents(docs.withColumn("size", word_count(F.col("text"))), Scratch(spark, "t"))


def test_against_plain_version(spark):
    draw = random.Random(5)
    rows = [(k, draw.choice(["a", "b", "é", "z", None]) if k % 3 else "hot", " ".join("w" for _ in range(draw.choice([0, 3, 40, 300])))) for k in range(400)]
    rows += [(None, "a", None), (7, "empty", "")]
    copies, sizes, aims = brute.mix(rows)
    got = {(r.doc_id, r.source): r for r in mixed(spark, rows).collect()}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for k, (d, s, t) in enumerate(rows):
        r = got[d, s]
        assert (r.copies, r.source_size) == (copies[k], sizes[s]) and r.target == pytest.approx(aims[s])
        taken[s] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= max((len(brute.words(t)) for _, x, t in rows if x == s))


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a", "x y z")] * 10 + [(2, "b", "q " * 500)]
    out = mixed(spark, rows)
    assert out.count() == 11 and max(r.copies for r in out.collect()) <= 2
    assert emit(out, ["doc_id"]).count() == sum(r.copies for r in out.collect())
    assert mixed(spark, rows[:0]).count() == 0


def test_query_comes_near_the_targets(spark):
    rows = op4_mixing(spark, brute.SMALL).collect()
    again = op4_mixing(spark, brute.SMALL).collect()
    assert sorted(rows) == sorted(again)
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").collect()]
    copies, sizes, aims = brute.mix(docs)
    got = {r.doc_id: r.taken for r in rows}
    assert all(got[d] == copies[k] * len(brute.words(t)) for k, (d, _, t) in enumerate(docs))
