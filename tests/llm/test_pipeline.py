from collections import Counter

import sentencepiece

import corpus_pipeline
from briarlake.llm.pieces import MODEL
from briarlake.llm.pii import pseudonymize
from briarlake.llm.quality import METRICS  # noqa: F401
from tests.llm import brute


def test_against_plain_version(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{brute.SMALL}/documents.parquet").collect()]
    hosts = brute.host_verdicts([(s, t) for _, s, t in docs])
    docs = [d for d in docs if not brute.base_failed(d[2]) and not hosts[d[1]][1]]
    classes = brute.simhash([(d, t) for d, _, t in docs])
    docs = [(d, s, pseudonymize(t)[0]) for d, s, t in docs if classes[d][1] == d]
    copies, _, _ = brute.mix(docs)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter({(d, tuple(library.encode(t))): copies[k] for k, (d, _, t) in enumerate(docs) if copies[k]})
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, brute.SMALL).collect())
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{brute.SMALL}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, brute.SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), brute.SMALL).count() == 0


def test_stages_on_odd_rows(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good, "en", "s", 3, "x", 7), (1, good, "en", "s", 3, "x", 7), (None, good + " more", None, None, None, None, None), (2, None, "en", "s", 0, "x", 7), (3, "", "en", "s", 0, "x", 7), (4, "long " + good * 2000, "en", None, 1, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, copies int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, brute.SMALL)
        assert after.columns == docs.columns and after.count() <= 2 * len(rows)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, brute.SMALL).collect()
    assert len(ids) == len(rows) and all(r.restored for r in ids)
