import random

import numpy as np
import pytest

from briarlake.llm import simhash
from briarlake.operators.graph import components
from briarlake.llm.queries import op9_simhash_near_dedup
from briarlake.scratch import Scratch
from tests.llm import brute

TEXTS = [None, "", "  ", "One", "one TWO", "ÉTÉ été", "a b c", "a b c d e a b c", "A\tB\x0bC  d\ne", "nb sp x y"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprints(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute.fingerprint(text)


def near(draw, n):
    """Fingerprints of which many are 1 to 4 bits apart."""
    out = set()
    while len(out) < n:
        base = draw.getrandbits(64)
        out.add(base)
        for _ in range(draw.randrange(6)):
            base ^= sum(1 << draw.randrange(64) for _ in range(draw.randrange(1, 4)))
            out.add(base)
    return sorted(out)


def test_bit_planes_find_exactly_the_close_pairs():
    draw = random.Random(8)
    sizes = [1, 2, 63, 64, 65, 200, 3]
    groups = [near(draw, s)[:s] for s in sizes]
    values = np.array([v for g in groups for v in g], np.uint64)
    for radius in (1, 2, 3, 5):
        a, b = simhash.close_pairs(values, np.array(sizes), radius)
        got, want, at = set(zip(a.tolist(), b.tolist())), set(), 0
        for g in groups:
            want |= {(at + i, at + j) for i in range(len(g)) for j in range(i + 1, len(g)) if (g[i] ^ g[j]).bit_count() <= radius}
            at += len(g)
        assert got == want


@pytest.mark.parametrize("limit", [2048, 3])
def test_components_of_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
    draw = random.Random(limit)
    prints = [p - (p >> 63 << 64) for p in near(draw, 500)]
    scratch = Scratch(spark, "t")
    links = simhash.link(spark.createDataFrame([(p,) for p in prints], "fp long"), scratch)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 64 for a, b in links.collect())
    got = {r.node: r.root for r in components(links, scratch).collect()}
    close = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    want = brute.components(prints, close)
    assert {p: got.get(p, p) for p in prints} == want


def test_long_chain_is_one_component(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(1, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {k: 0 for k in range(301)} | {1000 + k: 1000 for k in range(200)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_tables_with_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(5, "x y z w", "e"), (3, "X Y z w", "e"), (3, "X Y z w", "e"), (None, "x y z w", "e"), (9, None, "e"), (8, "", "e"), (7, "other words here", "e"), (None, "quite alone", "e")], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, Scratch(spark, "t")).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7), (None, None)], key=str)
    left = simhash.filter_documents(docs, Scratch(spark, "t"))
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 8, 7, None, None], key=str)
    assert simhash.filter_documents(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").collect()]
    want = brute.simhash(rows)
    got = op9_simhash_near_dedup(spark, brute.SMALL).collect()
    assert len(got) == len(rows)
    assert all((int(r.fingerprint, 16), r.component_id) == want[r.doc_id] and len(r.fingerprint) == 16 for r in got)
