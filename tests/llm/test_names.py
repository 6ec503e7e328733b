"""Every operator and stage on a table whose other columns have the names that are used inside, and on a very long text."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from briarlake.llm import chat, embeddings, html, mixing, pieces, pii, quality, sharding, simhash, urls
from briarlake.scratch import Scratch
from tests.llm import brute

FOLDER = Path(quality.__file__).parent
#: Every name that the operators give to a column.
GIVEN = re.compile(r'(?:alias|withColumn|fresh|withColumnRenamed)\((?:[^()]*, )?"(_?[a-z][a-z_0-9]*)"')
NAMES = sorted(({w for f in [*FOLDER.glob("*.py"), FOLDER.parent / "operators" / "order.py"] for w in GIVEN.findall(f.read_text())} | {"ids", "fp", "prefix", "rank"}) - {"doc_id", "text", "source", "lang", "n_chars", "size", "page_id", "url", "html", "fetch_ts", "vec_id", "embedding", "label", "conv_id", "turn", "role"})


def clashing(frame):
    return frame.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES], F.lit("own").alias("a.b `c`"))


def test_names_are_many():
    assert {"_row", "_made", "host", "fp", "component_id", "copies", "ids", "prefix", "row", "_gone"} <= set(NAMES)


@pytest.fixture(scope="module")
def documents(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good, "en", "s", 1), (2, good + " call 555-123-4567", "en", None, 2), (3, None, None, "s", None), (4, "", "en", "t", 0), (5, "x y z " * 300_000, "en", "t", 9), (1, good, "en", "s", 1), (None, "a b " + good, None, "t", 3)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages(spark, documents, name, stage):
    after = stage(spark, documents, brute.SMALL)
    assert after.columns == documents.columns
    rows = after.collect()
    assert rows and all(r[n] == f"own {n}" for r in rows for n in NAMES) and all(r["a.b `c`"] == "own" for r in rows)


def test_document_operators(spark, documents):
    plain = documents.select("doc_id", "text", "lang", "source", "n_chars")
    scratch = lambda: Scratch(spark, "t")
    for run in (
        lambda d: quality.digest(quality.judge(d, scratch())),
        lambda d: sharding.digest(sharding.shard_documents(d, scratch())),
        lambda d: simhash.digest(simhash.near_duplicates(d, scratch())),
        lambda d: pii.pseudonyms(d, b"k"),
        lambda d: pieces.encode_documents(d),
    ):
        assert sorted(run(documents).collect(), key=str) == sorted(run(plain).collect(), key=str)
        assert run(documents.limit(0)).count() == 0
    sized = lambda d: mixing.mix_documents(d.withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long")), scratch())
    mixed = sized(documents)
    assert sorted(mixed.select("doc_id", "source_size", "target", "copies").collect(), key=str) == sorted(sized(plain).select("doc_id", "source_size", "target", "copies").collect(), key=str)
    assert {r["rank"] for r in mixed.select("rank").collect()} == {"own rank"}


def test_other_operators(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x", "<p>one</p>"), (2, None, None)], "page_id long, url string, html string")
    assert sorted(html.extract_pages(clashing(pages)).collect()) == sorted(html.extract_pages(pages).collect())
    vectors = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, None, 0)], "vec_id long, embedding array<double>, label int")
    near = lambda v: sorted(embeddings.near_duplicates(v, Scratch(spark, "t")).collect())
    assert near(clashing(vectors)) == near(vectors)
    turns = spark.createDataFrame([("x", 0, "user", "a"), ("y", 0, "user", "a"), ("y", 1, "assistant", "b" * 3_000_000)], "conv_id string, turn long, role string, text string")
    chats = lambda t: sorted(chat.format_chats(t, Scratch(spark, "t")).collect())
    assert chats(clashing(turns)) == chats(turns) and [r.conv_id for r in chats(turns)] == ["y"]
    captures = pages.selectExpr("page_id", "url", "timestamp '2024-01-02' AS fetch_ts")
    events = spark.createDataFrame([("domain", "a.com", "l")], "kind string, pattern string, list_name string").selectExpr("*", "timestamp '2024-01-01' AS at", "'add' AS action")
    match = lambda c: sorted(urls.match_lists(c, events, Scratch(spark, "t")).collect())
    assert match(clashing(captures)) == match(captures) and [r.blocked for r in match(captures)] == [True, False]
