"""Quality rules: document rules, host failure rates shrunk by an empirical beta prior, host verdicts.

Every document is tried by four rules. Failures are counted by host (the
`source` column), each host's failure rate of each rule is shrunk towards the
rate of all hosts by a beta prior fitted to the hosts by the method of moments,
and a host is rejected when the odds of a shrunk rate are several times those of
the prior's mean and the rate is not small. A host is thus judged against the
others: where all hosts are alike, none goes, and a few bad documents of a small
host don't condemn it. The verdict is joined back to the documents.

Defined results: a null or empty text has no words and fails `too_short`; a
document of null source has no host and stands by its own rules; repeated rows
count as often as they occur; a rate at the limit (a tie) does not reject; an
empty table has no hosts. `judge` and `host_verdicts` return the columns named
there; `filter_documents` returns the columns of `docs`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from briarlake.functions.numeric import fixed
from briarlake.llm.text import fresh, named, small_batches
from briarlake.scratch import Scratch

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
#: UTF-8 continuation bytes and the six separators: what is left counts one byte a code point.
_NOT_COUNTED = bytes([*range(0x80, 0xC0), 0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class HostRules:
    """A host is rejected when a shrunk failure rate exceeds `min_rate` and its odds are over `odds` times the prior mean's.

    `max_strength` bounds the prior's weight in documents, for hosts that hardly differ.
    """

    odds: float = 4.0
    min_rate: float = 0.25
    max_strength: float = 1000.0


def _repeat_words(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    if len(number) < 1 << 21:
        windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
    else:  # beyond 63 bits: number the pairs first
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True)[1]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    """METRICS of one whole text. bytes.split() knows exactly the six separators."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return len(words), len(text.translate(None, _NOT_COUNTED)), len(text.translate(None, _NOT_SYMBOL)), len(lines) - len(set(lines)), _repeat_words(words)


_KIND = T.StructType([T.StructField(m, T.LongType()) for m in METRICS])


@F.arrow_udf(_KIND)
def _measured(texts: pa.Array) -> pa.Array:
    columns = list(zip(*(measure(x) for x in texts.to_pylist()), strict=True)) or [()] * len(METRICS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(METRICS))


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add METRICS of the whole text to every row; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    made = fresh(docs, "_measured")
    kept = [named(c) for c in docs.columns if c.lower() not in METRICS]
    return docs.withColumn(made, _measured(named(text).cast("binary"))).select(*kept, *[F.col(made)[m].alias(m) for m in METRICS])


#: Rule name and its failure, over METRICS. The first two fail the document itself.
RULES = {
    "too_short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > n_words",
}
BASE = ("too_short", "repetitive")


def base_failed() -> Column:
    return F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))


def host_verdicts(metrics: DataFrame, rules: HostRules = HostRules(), host: str = "host") -> DataFrame:
    """One row per non-null host: documents, failures and shrunk rate of each rule, host_odds and host_rejected.

    The prior of a rule has mean m = failures / documents over all N documents
    of H hosts. Of d = sum of n (rate - m)^2 / (m (1 - m)), H is what chance
    alone gives; the hosts' own share is rho = (d - H) / (N - H), and the prior's
    strength 1 / rho - 1, within 1 and `max_strength`. host_odds is the greatest
    ratio, over the rules, of the shrunk rate's odds to those of m, counting
    rates over `min_rate` only; 0 if there is none.
    """
    hosts = metrics.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("host_docs"), *[F.sum(F.expr(f"CAST({x} AS INT)")).alias(f"{r}_failed") for r, x in RULES.items()])
    rate = lambda r: F.col(f"{r}_failed") / F.col("host_docs")
    mean = hosts.agg(*[F.try_divide(F.sum(f"{r}_failed"), F.sum("host_docs")).alias(f"{r}_mean") for r in RULES])
    own = lambda r: F.col("host_docs") * (rate(r) - F.col(f"{r}_mean")) * (rate(r) - F.col(f"{r}_mean"))
    spread = hosts.crossJoin(F.broadcast(mean)).agg(
        F.count("*").alias("_hosts"), F.sum("host_docs").alias("_docs"), *[F.max(f"{r}_mean").alias(f"{r}_mean") for r in RULES], *[F.sum(own(r)).alias(f"{r}_spread") for r in RULES]
    )
    noise = lambda r: F.try_divide(F.col(f"{r}_spread"), F.col(f"{r}_mean") * (1 - F.col(f"{r}_mean")))
    rho = lambda r: F.try_divide(noise(r) - F.col("_hosts"), F.col("_docs") - F.col("_hosts"))
    strength = lambda r: F.when(rho(r) > 0, F.least(F.greatest(1 / rho(r) - 1, F.lit(1.0)), F.lit(rules.max_strength))).otherwise(rules.max_strength)
    shrunk = {r: (F.col(f"{r}_failed") + F.col(f"{r}_mean") * strength(r)) / (F.col("host_docs") + strength(r)) for r in RULES}
    judged = hosts.crossJoin(F.broadcast(spread)).select(host, "host_docs", *[f"{r}_failed" for r in RULES], *[f"{r}_mean" for r in RULES], *[v.alias(f"{r}_rate") for r, v in shrunk.items()])
    odds = lambda r: F.try_divide(F.col(f"{r}_rate") * (1 - F.col(f"{r}_mean")), (1 - F.col(f"{r}_rate")) * F.col(f"{r}_mean"))
    most = F.greatest(*[F.when(F.col(f"{r}_rate") > rules.min_rate, odds(r)).otherwise(0.0) for r in RULES])
    judged = judged.withColumn("host_odds", F.coalesce(most, F.lit(0.0))).drop(*[f"{r}_mean" for r in RULES])
    return judged.withColumn("host_rejected", F.col("host_odds") > rules.odds)


def judge(docs: DataFrame, scratch: Scratch, rules: HostRules = HostRules(), text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, host, METRICS, base_failed, host_docs, the host's shrunk rates, host_odds, host_rejected and kept for every row.

    The metrics are written once, without the texts, and serve both the host
    rates and the result. Hosts are partially aggregated before the shuffle and
    their table is written: Spark broadcasts it only if it is small, else AQE
    splits the partition of a hot host.
    """
    narrow = docs.select(named(doc_id).alias("doc_id"), named(host).cast("string").alias("host"), named(text).alias("_text"))
    metrics = scratch.keep(with_metrics(narrow, "_text").drop("_text"))
    verdicts = scratch.keep(host_verdicts(metrics, rules)).drop(*[f"{r}_failed" for r in RULES]).withColumnRenamed("host", "_host")
    joined = metrics.withColumn("base_failed", base_failed()).join(verdicts, F.col("host") == F.col("_host"), "left").drop("_host")
    joined = joined.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def digest(judged: DataFrame) -> DataFrame:
    """The documents' verdicts with what speaks for them; rates to six decimals, null without a host."""
    shown = [fixed(F.col(f"{r}_rate"), 6).alias(f"{r}_rate") for r in RULES]
    return judged.select("doc_id", *METRICS, "base_failed", "kept", "host", "host_docs", *shown, "host_rejected")


def filter_documents(docs: DataFrame, scratch: Scratch, rules: HostRules = HostRules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of `docs` that `judge` keeps, with their own columns.

    Texts are measured again instead of being shuffled: only rejected hosts, a
    written table, meet the documents.
    """
    narrow = docs.select(named(host).cast("string").alias("host"), named(text).alias("_text"))
    rejected = host_verdicts(scratch.keep(with_metrics(narrow, "_text").drop("_text")), rules).where("host_rejected")
    row = F.struct(*[named(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("_row")
    tried = with_metrics(docs.select(row, named(host).cast("string").alias("_host"), named(text).alias("_text")), "_text")
    good = tried.where(~base_failed()).join(scratch.keep(rejected.select("host")), F.col("_host") == F.col("host"), "left_anti")
    return good.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


#: The same in DuckDB; `documents` has doc_id, text and source.
SQL = r"""
WITH words AS (
  SELECT rowid AS r, doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times
  FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words))
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) t(k) WHERE times > 1 GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM words) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), base AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)
), tried AS (
  SELECT source, n_words < 50 AS too_short, 100 * n_repeat_words > 50 * n_words AS repetitive,
         n_symbols > n_words AS symbol_heavy, 10 * n_dup_lines > n_words AS duplicate_lines
  FROM base WHERE source IS NOT NULL
), hosts AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS f
  FROM (UNPIVOT tried ON too_short, repetitive, symbol_heavy, duplicate_lines INTO NAME rule VALUE failed) GROUP BY ALL
), means AS (
  SELECT rule, sum(f) / sum(n) AS m FROM hosts GROUP BY rule
), noises AS (
  SELECT rule, m, (sum(n * (f / n - m) * (f / n - m)) / nullif(m * (1 - m), 0) - count(*)) / nullif(sum(n) - count(*), 0) AS rho
  FROM hosts JOIN means USING (rule) GROUP BY rule, m
), priors AS (
  SELECT rule, m, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 1000) ELSE 1000 END AS s FROM noises
), shrunk AS (
  SELECT source, rule, n, m, (f + m * s) / (n + s) AS rate FROM hosts JOIN priors USING (rule)
), verdicts AS (
  SELECT source, max(n)::BIGINT AS host_docs, max(CASE WHEN rate > 0.25 THEN coalesce(rate * (1 - m) / nullif((1 - rate) * m, 0), 0) ELSE 0 END) > 4 AS rejected,
         max(floor(rate * 1e6 + 0.5) / 1e6) FILTER (rule = 'too_short') AS too_short_rate, max(floor(rate * 1e6 + 0.5) / 1e6) FILTER (rule = 'repetitive') AS repetitive_rate,
         max(floor(rate * 1e6 + 0.5) / 1e6) FILTER (rule = 'symbol_heavy') AS symbol_heavy_rate, max(floor(rate * 1e6 + 0.5) / 1e6) FILTER (rule = 'duplicate_lines') AS duplicate_lines_rate
  FROM shrunk GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(rejected, false) AS kept,
       source AS host, host_docs, too_short_rate, repetitive_rate, symbol_heavy_rate, duplicate_lines_rate, coalesce(rejected, false) AS host_rejected
FROM base LEFT JOIN verdicts USING (source)
"""
