import random

import pytest

from briarlake.llm import quality
from briarlake.llm.queries import op1_quality_rules
from briarlake.scratch import Scratch
from tests.llm import brute

ODD = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x\x0by\x0cz\r\nq", "é é é é é", "nb sp em sp", "# * $ % & | < >", "l\nl\nl\n\n \n l", "one two " * 60, "w\n" * 70]


@pytest.mark.parametrize("text", ODD)
def test_measures_odd_texts(text):
    assert quality.measure(None if text is None else text.encode()) == brute.metrics(text)


def test_measures_random_texts():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(["ab", "c", "é", " ", " ", "\n", "\t", "#", "d "]) for _ in range(draw.randrange(200)))
        assert quality.measure(text.encode()) == brute.metrics(text)


def good(k):
    return " ".join(f"word{k}x{i}" for i in range(60))


def test_rejects_a_bad_host_and_keeps_the_others(spark):
    rows = [(i, "short", "bad", "extra") for i in range(100)] + [(1000, good(0), "bad", "e")]
    rows += [(2000 + i, good(i), f"host{i % 7}", None) for i in range(140)] + [(4000, "short", "tiny", None), (4001, good(9), "tiny", None)] + [(3000, "tiny", "host1", None), (3001, good(1), None, None), (3002, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host_rejected string")
    got = {r.doc_id: r for r in quality.judge(docs, Scratch(spark, "t")).collect()}
    assert len(got) == len(rows)
    assert not got[1000].base_failed and got[1000].host_rejected and not got[1000].kept
    assert all(got[2000 + i].kept for i in range(140))
    # Half of the two documents of `tiny` fail, over four times the odds of all but `bad`: too few to tell.
    assert got[4001].kept and not got[4001].host_rejected and 0.4 < got[4001].too_short_rate < 0.6
    want = brute.host_verdicts([(r[2], r[1]) for r in rows])
    for r in got.values():
        assert r.host_rejected == (r.host is not None and want[r.host][1])
        if r.host is not None:
            assert [r[f"{x}_rate"] for x in quality.RULES] == pytest.approx(want[r.host][0])
    assert not got[3000].kept and got[3001].kept and not got[3002].kept
    left = quality.filter_documents(docs, Scratch(spark, "t"))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([2000 + i for i in range(140)] + [3001, 4001])


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, good(0), "h")] * 3, "doc_id long, text string, source string")
    assert quality.filter_documents(docs, Scratch(spark, "t")).count() == 3
    assert quality.judge(docs.limit(0), Scratch(spark, "t")).count() == 0
    assert quality.filter_documents(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").collect()}
    hosts = brute.host_verdicts([(r.source, r.text) for r in docs.values()])
    rates = set()
    for r in op1_quality_rules(spark, brute.SMALL).collect():
        assert tuple(r[1:6]) == brute.metrics(docs[r.doc_id].text)
        assert r.base_failed == brute.base_failed(docs[r.doc_id].text)
        shrunk, rejected = hosts[r.host]
        assert r.host_rejected == rejected and r.kept == (not r.base_failed and not rejected)
        assert [r[f"{x}_rate"] for x in quality.RULES] == pytest.approx(shrunk, abs=1e-6)
        rates.add(r.too_short_rate)
    assert len(rates) > 1


def test_clashing_names_and_very_long_text(spark):
    docs = spark.createDataFrame([(1, good(0) + " x y z" * 500_000, "h", 1, 2, 3, 4), (2, good(1), "h", 1, 2, 3, 4)], "doc_id long, text string, source string, _host int, host int, n_words int, `_m.x` int")
    left = quality.filter_documents(docs, Scratch(spark, "t"))
    assert left.columns == docs.columns and [tuple(r[3:]) for r in left.collect()] == [(1, 2, 3, 4)]
    assert {r.doc_id: r.kept for r in quality.judge(docs, Scratch(spark, "t")).collect()} == {1: False, 2: True}


def test_stub_sections_are_rejected_as_hosts(spark):
    from briarlake.llm.queries import op1_quality_rules_of_sections

    rows = op1_quality_rules_of_sections(spark, brute.SMALL).collect()
    rejected = {r.host for r in rows if r.host_rejected}
    assert sum(h.endswith("/stubs") for h in rejected) > len(rejected) / 2  # a source of repetitive pages may go too
    assert any(not r.kept and not r.base_failed for r in rows)  # the verdict takes effect beyond the base rules
    texts = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").collect()}
    hosts = brute.host_verdicts([(None if s is None else s + ("/stubs" if len(t) < 400 else "/pages"), t) for s, t in texts.values()])
    assert rejected == {h for h, (_, bad) in hosts.items() if bad}
