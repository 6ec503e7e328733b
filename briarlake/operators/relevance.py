"""Fusion of observations, corpus statistics, TF-IDF and BM25+, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briarlake.functions import text as T
from briarlake.functions.numeric import fixed
from briarlake.operators.order import ranked
from briarlake.scratch import Scratch


def fuse(observations: DataFrame) -> DataFrame:
    """One row per identity: sources, providers, queries, lanes; the longest content wins, the earliest of equals."""
    keyed = observations.withColumn("identity", T.observation_identity(F.col("url"), F.col("title"), F.col("content"))).where("identity <> 'text:'")
    best = F.max(F.struct(F.length("content").alias("n"), (-F.col("seq")).alias("s")))
    return keyed.groupBy("identity").agg(
        F.count("*").alias("source_count"), F.collect_set("provider").alias("providers"), F.collect_set("query").alias("queries"), F.collect_set(F.nullif("lane", F.lit(""))).alias("lanes"),
        F.min("seq").alias("first_seq"), (-best["s"]).alias("content_seq"), (F.count("*") > 1).alias("corroborated"),
    )


def tokens(text: Column) -> Column:
    """Lower-case words of three characters or more."""
    return F.filter(F.split(F.lower(T.text(text)), r"\s+"), lambda w: F.length(w) > 2)


def term_statistics(docs: DataFrame) -> DataFrame:
    """(term, df, tf), a row being a document. One shuffle, of partly counted terms.

    A row's words are sorted within the row, where the first of equal words
    counts for df; no (document, term) pair is shuffled.
    """
    words = docs.select(F.sort_array(tokens(F.col("text"))).alias("w"))
    marked = words.select(F.explode(F.transform("w", lambda x, k: F.struct(x.alias("term"), ((k == 0) | (F.get("w", k - 1) != x)).alias("first")))).alias("t"))
    return marked.groupBy(F.col("t.term").alias("term")).agg(F.count_if("t.first").alias("df"), F.count("*").alias("tf"))


def signal_frequency(docs: DataFrame, signals: list[str]) -> DataFrame:
    """(signal, df) for a fixed list of lower-case signals in one pass."""
    low = F.lower("text")
    counted = docs.agg(*[F.count_if(low.contains(s)).alias(f"s{k}") for k, s in enumerate(signals)])
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"s{k}").alias("df")) for k, s in enumerate(signals)])
    return counted.select(F.inline(pairs))


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75, delta: float = 0.5) -> DataFrame:
    """(doc_id, score): BM25+ of a fixed query, times 1.5 and at most 10.

    Each text is split once, into a narrow written table of its length and the
    counts of the few query terms; statistics and scores come from that table.
    """
    words = docs.select("doc_id", tokens(F.col("text")).alias("w"))
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    counts = Scratch(docs.sparkSession, "bm25").keep(words.select("doc_id", F.size("w").alias("n"), *[count(t).alias(f"t{k}") for k, t in enumerate(terms)]))
    stats = counts.agg(F.count("*").alias("n_docs"), (F.sum("n") / F.count("*")).alias("avg"), *[F.count_if(F.col(f"t{k}") > 0).alias(f"d{k}") for k in range(len(terms))])
    total = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"t{k}"), F.col(f"d{k}")
        idf = F.greatest(F.lit(0.0), F.ln((F.col("n_docs") - df + 0.5) / (df + 0.5) + 1))
        gain = idf * (tf * (k1 + 1) / (tf + (F.col("n") / F.col("avg") * b + (1 - b)) * k1) + delta)
        total = total + F.when(tf > 0, gain).otherwise(0.0)
    return counts.crossJoin(F.broadcast(stats)).select("doc_id", F.least(F.lit(10.0), fixed(total * 1.5)).alias("score"))


def tfidf(docs: DataFrame, terms: dict[str, float]) -> DataFrame:
    """(doc_id, n_signals, score): sum of count ln(N / (1 + df)) by category weight, over 10 and at most 1.

    Document frequencies cover the whole corpus; `tfidf_in_order` has them as of each page.
    """
    low, names = F.lower("text"), list(terms)
    counts = docs.select("doc_id", *[T.overlapping_count(low, t).alias(f"t{k}") for k, t in enumerate(names)])
    stats = counts.agg(F.count("*").alias("n_docs"), *[F.count_if(F.col(f"t{k}") > 0).alias(f"d{k}") for k in range(len(names))])
    total, found = F.lit(0.0), F.lit(0)
    for k, t in enumerate(names):
        total = total + F.greatest(F.lit(0.0), F.col(f"t{k}") * F.ln(F.col("n_docs") / (F.col(f"d{k}") + 1))) * terms[t]
        found = found + F.when(F.col(f"t{k}") > 0, 1).otherwise(0)
    return counts.crossJoin(F.broadcast(stats)).select("doc_id", found.cast("long").alias("n_signals"), F.least(F.lit(1.0), fixed(total / 10, 4)).alias("score"))


def tfidf_in_order(docs: DataFrame, terms: dict[str, float], order: str = "doc_id") -> DataFrame:
    """(doc_id, n_signals, score) as `tfidf`, but N and df count the pages up to and with each page, in order of `order`.

    They are prefix sums over range partitions, so the corpus is no single window.
    """
    low, names = F.lower("text"), list(terms)
    counts = docs.select("doc_id", *([order] if order != "doc_id" else []), *[T.overlapping_count(low, t).alias(f"t{k}") for k, t in enumerate(names)])
    hits = counts.withColumns({f"h{k}": (F.coalesce(F.col(f"t{k}"), F.lit(0)) > 0).cast("long") for k in range(len(names))})
    placed = ranked(hits, [], [F.col(order).asc_nulls_last()], Scratch(docs.sparkSession, "arrivals"), "place", tuple(f"h{k}" for k in range(len(names))))
    total, found = F.lit(0.0), F.lit(0)
    for k, t in enumerate(names):
        df = F.col(f"h{k}_before") + F.col(f"h{k}")
        total = total + F.greatest(F.lit(0.0), F.col(f"t{k}") * F.ln((F.col("place") + 1) / (df + 1))) * terms[t]
        found = found + F.col(f"h{k}")
    return placed.select("doc_id", found.cast("long").alias("n_signals"), F.least(F.lit(1.0), fixed(total / 10, 4)).alias("score"))


def verdicts(judgments: DataFrame, requirements: DataFrame) -> DataFrame:
    """(candidate_id, verdict): a failed hard profile requirement fails, all passed qualify, else unknown.

    What a candidate passed is counted against what is asked, so candidates meet
    no requirements that nobody judged. The first judgment of a requirement is
    the least of one number, its line and then the place of its status in order,
    which a hash aggregate holds without sorting.
    """
    profile = (F.col("importance") == "hard") & (F.col("scope") != "signal")
    kinds = requirements.where("requirement_id IS NOT NULL").groupBy(F.col("requirement_id").alias("_r")).agg(F.coalesce(F.bool_or(profile), F.lit(False)).alias("_profile"))
    asked = kinds.agg(F.count("*").alias("_asked"), F.count_if("_profile").alias("_hard"))
    status = F.col("status")
    place = F.when(status.isNull(), 0).when(status < "fail", 1).when(status == "fail", 2).when(status < "pass", 3).when(status == "pass", 4).otherwise(5)
    line = F.coalesce(F.col("line_no").cast("decimal(20,0)"), F.lit(f"-{10**19}").cast("decimal(20,0)"))
    first = judgments.groupBy("candidate_id", "requirement_id").agg(F.min((line * 8 + place).cast("decimal(24,0)")).alias("_first"))
    known = F.when(F.col("candidate_id").isNotNull(), F.pmod(F.col("_first"), F.lit(8)).cast("int"))
    rated = first.join(kinds.where("_profile"), F.col("requirement_id") == F.col("_r"), "left").withColumn("_known", F.when(F.col("_r").isNotNull(), known))
    counted = rated.groupBy("candidate_id").agg(F.count_if(F.col("_known") == 2).alias("_failed"), F.count_if(F.col("_known") == 4).alias("_passed"))
    told = counted.crossJoin(F.broadcast(asked)).where("_asked > 0")
    return told.select("candidate_id", F.when(F.col("_failed") > 0, "hard_fail").when(F.col("_passed") == F.col("_hard"), "qualified").otherwise("unknown").alias("verdict"))
