"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.functions import text as T
from briarlake.functions.numeric import fixed, percent, to_ten
from briarlake.operators import records as R
from briarlake.operators import relevance as V
from briarlake.operators import telemetry as L
from briarlake.queries import sql as S
from briarlake.registry import Frames, query

C = F.col


@query("d01_stage_counts", "SELECT stage, CAST(count(*) AS BIGINT) AS n FROM leads GROUP BY ROLLUP (stage)")
def _(f: Frames) -> DataFrame:
    return f.leads.rollup("stage").agg(F.count("*").alias("n"))


@query("d02_zero_filled_stages", f"SELECT d.stage, CAST(count(l.id) AS BIGINT) AS n FROM (VALUES {', '.join(f"('{s}')" for s in R.STAGES)}) d(stage) LEFT JOIN (SELECT * FROM leads WHERE id % 9 <> 4) l ON l.stage = d.stage GROUP BY d.stage")
def _(f: Frames) -> DataFrame:
    return L.zero_filled(f.leads.where("id % 9 <> 4"), "stage", R.STAGES)


@query("d03_average_qualification", f"SELECT {S.fixed('avg(CASE WHEN s > 0 THEN CASE WHEN s <= 10 THEN s * 10 ELSE s END END)', 1)} AS average FROM (SELECT coalesce(qualification, predictive, composite) AS s FROM leads)")
def _(f: Frames) -> DataFrame:
    s = F.coalesce("qualification", "predictive", "composite")
    return f.leads.agg(fixed(F.avg(F.when(s > 0, F.when(s <= 10, s * 10).otherwise(s))), 1).alias("average"))


@query("d04_top_industries", "SELECT coalesce(industry, 'Uncategorized') AS industry, CAST(count(*) AS BIGINT) AS n FROM leads GROUP BY 1 ORDER BY n DESC, industry LIMIT 4")
def _(f: Frames) -> DataFrame:
    return f.leads.groupBy(F.coalesce("industry", F.lit("Uncategorized")).alias("industry")).agg(F.count("*").alias("n")).orderBy(C("n").desc(), "industry").limit(4)


@query("d05_conversion_rate", "SELECT CAST(floor(100.0::DOUBLE * count(*) FILTER (WHERE stage = 'CONVERTED') / count(*) + 0.5) AS BIGINT) AS rate FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.agg(percent(F.count_if(C("stage") == "CONVERTED"), F.count("*")).alias("rate"))


@query("d06_option_lists", "SELECT DISTINCT industry AS option FROM leads WHERE industry IS NOT NULL")
def _(f: Frames) -> DataFrame:
    return f.leads.where("industry IS NOT NULL").select(C("industry").alias("option")).distinct()


@query("d07_count_before_paging", "SELECT CAST(count(*) AS BIGINT) AS total FROM leads WHERE stage = 'NURTURE'")
def _(f: Frames) -> DataFrame:
    return R.filtered(f.leads, {"stage": "NURTURE"}).agg(F.count("*").alias("total"))


@query("d08_metric_upsert", "SELECT lower(family || '|' || lane || '|' || provider) AS scope_key, CAST(sum(greatest(0, outcome_runs - 3)) AS BIGINT) AS outcome_runs, CAST(sum(greatest(0, qualified)) AS BIGINT) AS qualified, CAST(sum(greatest(0, latency_ms)) AS BIGINT) AS latency_ms FROM arms GROUP BY 1")
def _(f: Frames) -> DataFrame:
    delta = lambda c: F.sum(F.greatest(F.lit(0), F.floor(c)))
    return f.arms.groupBy(F.lower(F.concat_ws("|", "family", "lane", "provider")).alias("scope_key")).agg(delta(C("outcome_runs") - 3).alias("outcome_runs"), delta(C("qualified")).alias("qualified"), delta(C("latency_ms")).alias("latency_ms"))


@query("d09_monthly_usage", "SELECT provider, strftime(ts, '%Y-%m') AS period, CAST(count(*) AS BIGINT) AS units FROM trace_events WHERE provider IS NOT NULL GROUP BY 1, 2")
def _(f: Frames) -> DataFrame:
    return f.trace_events.where("provider IS NOT NULL").groupBy("provider", F.date_format("ts", "yyyy-MM").alias("period")).agg(F.count("*").alias("units"))


@query("d10_capped_reservations", """WITH RECURSIVE r AS MATERIALIZED (SELECT session_id, event_id % 4 + 1 AS u, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k FROM trace_events),
 w AS (SELECT session_id, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS granted, 0::BIGINT AS denied FROM (SELECT DISTINCT session_id FROM trace_events) UNION ALL
 SELECT w.session_id, w.k + 1, CASE WHEN used + u <= 12 THEN used + u ELSE used END, granted + (used + u <= 12)::BIGINT, denied + (used + u > 12)::BIGINT FROM w JOIN r ON r.session_id = w.session_id AND r.k = w.k + 1)
 SELECT session_id, arg_max(used, k) AS used, arg_max(granted, k) AS granted, arg_max(denied, k) AS denied FROM w GROUP BY session_id""")
def _(f: Frames) -> DataFrame:
    """L8 too: requests of a session in order; one is granted if it still fits, else it takes nothing."""
    requests = f.trace_events.select("session_id", "event_id", (C("event_id") % 4 + 1).alias("units"))
    return L.capped_reservations(requests, "session_id", "event_id", "units", 12)


@query("e14_month_period_counters", """WITH RECURSIVE r AS MATERIALIZED (SELECT provider || '|' || strftime(ts, '%Y-%m') AS period, event_id % 4 + 1 AS u, row_number() OVER (PARTITION BY provider, strftime(ts, '%Y-%m') ORDER BY event_id) AS k FROM trace_events WHERE provider IS NOT NULL),
 w AS (SELECT period, 0::BIGINT AS k, 0::BIGINT AS used, 0::BIGINT AS granted, 0::BIGINT AS denied FROM (SELECT DISTINCT period FROM r) UNION ALL
 SELECT w.period, w.k + 1, CASE WHEN used + u <= 1000 THEN used + u ELSE used END, granted + (used + u <= 1000)::BIGINT, denied + (used + u > 1000)::BIGINT FROM w JOIN r ON r.period = w.period AND r.k = w.k + 1)
 SELECT period, arg_max(used, k) AS used, arg_max(granted, k) AS granted, arg_max(denied, k) AS denied FROM w GROUP BY period""")
def _(f: Frames) -> DataFrame:
    """Units of a provider's calendar month against its limit."""
    period = F.concat_ws("|", "provider", F.date_format("ts", "yyyy-MM"))
    requests = f.trace_events.where("provider IS NOT NULL").select(period.alias("period"), "event_id", (C("event_id") % 4 + 1).alias("units"))
    return L.capped_reservations(requests, "period", "event_id", "units", 1000)


_PROVIDERS = ("llm", "tavily", "brightdata", "system", "cache")


@query("d11_provider_summary", f"""SELECT d.provider, CAST(count(e.event_id) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS successes, CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS failures, CAST(count(*) FILTER (WHERE status = 'skipped') AS BIGINT) AS skipped,
  CAST(coalesce(sum(latency_ms), 0) AS BIGINT) AS latency_ms, CAST(coalesce(floor(sum(latency_ms)::DOUBLE / nullif(count(e.event_id), 0) + 0.5), 0) AS BIGINT) AS avg_latency_ms, CAST(coalesce(sum(CASE WHEN total_tokens > 0 THEN total_tokens ELSE input_tokens + output_tokens END), 0) AS BIGINT) AS total_tokens,
  CAST(count(*) FILTER (WHERE fallback_used) AS BIGINT) AS fallback_uses FROM (VALUES {', '.join(f"('{p}')" for p in _PROVIDERS)}) d(provider) LEFT JOIN (SELECT * FROM trace_events WHERE status <> 'started') e ON e.provider = d.provider GROUP BY d.provider""")
def _(f: Frames) -> DataFrame:
    return L.provider_summary(f.trace_events, _PROVIDERS)


@query("d12_phase_timeline", """SELECT session_id, phase, CAST(count(*) AS BIGINT) AS n_events, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) // 1000 AS duration_ms,
  CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'success') THEN 'success' ELSE coalesce(arg_min(status, event_id) FILTER (WHERE status <> 'info'), 'info') END AS status FROM trace_events GROUP BY session_id, phase""")
def _(f: Frames) -> DataFrame:
    return L.phase_timeline(f.trace_events)


@query("d13_session_cost", "SELECT session_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(floor(sum(input_tokens + output_tokens)::DOUBLE / nullif(count(*) FILTER (WHERE phase = 'persistence'), 0) + 0.5) AS BIGINT) AS tokens_per_accepted FROM trace_events WHERE provider = 'llm' GROUP BY session_id")
def _(f: Frames) -> DataFrame:
    total = F.sum(C("input_tokens") + C("output_tokens"))
    accepted = F.count_if(C("phase") == "persistence")
    return f.trace_events.where("provider = 'llm'").groupBy("session_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.floor(F.try_divide(total.cast("double"), accepted) + 0.5).alias("tokens_per_accepted"))


@query("d14_trace_summary", "SELECT coalesce(provider, CASE WHEN total_tokens IS NOT NULL THEN 'llm' ELSE 'system' END) AS provider, phase, CASE WHEN bool_or(status = 'error') THEN 'error' ELSE 'ok' END AS status, CAST(count(*) AS BIGINT) AS n FROM trace_events GROUP BY 1, 2")
def _(f: Frames) -> DataFrame:
    provider = F.coalesce("provider", F.when(C("total_tokens").isNotNull(), "llm").otherwise("system"))
    return f.trace_events.groupBy(provider.alias("provider"), "phase").agg(F.when(F.bool_or(C("status") == "error"), "error").otherwise("ok").alias("status"), F.count("*").alias("n"))


@query("d15_rejection_counts", "SELECT status AS reason, CAST(count(*) AS BIGINT) AS n FROM trace_events WHERE status IN ('error', 'skipped') GROUP BY 1")
def _(f: Frames) -> DataFrame:
    return f.trace_events.where(C("status").isin("error", "skipped")).groupBy(C("status").alias("reason")).agg(F.count("*").alias("n"))


_TEXT = "lower(concat_ws(' ', full_name, title, headline, company, location, industry))"


@query("d16_requirement_rates", f"""WITH m AS (SELECT l.id, r.requirement_id, r.importance, bool_or(contains({_TEXT}, r.term)) AS ok FROM leads l CROSS JOIN requirements r GROUP BY ALL)
  SELECT requirement_id, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS passed, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS failed, {S.fixed('count(*) FILTER (WHERE ok)::DOUBLE / count(*)')} AS pass_rate, importance = 'hard' AND {S.fixed('count(*) FILTER (WHERE ok)::DOUBLE / count(*)')} < 0.25 AS missing_hard FROM m GROUP BY requirement_id, importance""")
def _(f: Frames) -> DataFrame:
    """B19 gives the matches; viable leads pass all hard requirements."""
    hits = R.requirement_hits(f.leads, f.requirements, ["full_name", "title", "headline", "company", "location", "industry"])
    passed = hits.groupBy(C("requirement_id").alias("r")).agg(F.count("*").alias("_passed"))
    kinds = f.requirements.select("requirement_id", "importance").distinct().join(passed, C("requirement_id") == C("r"), "left").crossJoin(f.leads.agg(F.count("*").alias("_all")))
    n = F.coalesce("_passed", F.lit(0))
    rate = fixed(n.cast("double") / C("_all"))
    return kinds.select("requirement_id", n.alias("passed"), (C("_all") - n).alias("failed"), rate.alias("pass_rate"), ((C("importance") == "hard") & (rate < 0.25)).alias("missing_hard"))


@query("d17_round_summary", "SELECT round, CAST(count(*) AS BIGINT) AS n_raw, CAST(count(DISTINCT query) AS BIGINT) AS n_queries, CAST(count(*) FILTER (WHERE lane = 'signal') AS BIGINT) AS n_signals FROM observations GROUP BY round")
def _(f: Frames) -> DataFrame:
    return f.observations.groupBy("round").agg(F.count("*").alias("n_raw"), F.count_distinct("query").alias("n_queries"), F.count_if(C("lane") == "signal").alias("n_signals"))


@query("d18_observation_fusion", f"""WITH o AS (SELECT *, {S.observation('url', 'title', 'content')} AS k FROM observations)
  SELECT k AS identity, CAST(count(*) AS BIGINT) AS source_count, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, CAST(count(DISTINCT query) AS BIGINT) AS n_queries, coalesce(array_to_string(list_sort(list(DISTINCT lane) FILTER (WHERE coalesce(lane, '') <> '')), ','), '') AS lanes,
  min(seq) AS first_seq, arg_max(seq, (length(content), -seq)) AS content_seq, count(*) > 1 AS corroborated FROM o WHERE k <> 'text:' GROUP BY k""")
def _(f: Frames) -> DataFrame:
    fused = V.fuse(f.observations)
    join = lambda c: F.array_join(F.array_sort(C(c)), ",")
    return fused.select("identity", "source_count", join("providers").alias("providers"), F.size("queries").cast("long").alias("n_queries"), join("lanes").alias("lanes"), "first_seq", "content_seq", "corroborated")


@query("d19_company_groups", f"SELECT {S.collapse('lower(company)')} AS company_key, max(fit) AS top_rank, CAST(count(*) - 1 AS BIGINT) AS n_deduped FROM candidates WHERE trim(coalesce(company, '')) <> '' GROUP BY 1 ORDER BY top_rank DESC, company_key LIMIT 10")
def _(f: Frames) -> DataFrame:
    groups = f.candidates.where(F.trim(T.text(C("company"))) != "").groupBy(T.collapse(F.lower("company")).alias("company_key"))
    return groups.agg(F.max("fit").alias("top_rank"), (F.count("*") - 1).alias("n_deduped")).orderBy(C("top_rank").desc(), "company_key").limit(10)


_TOKENS = r"tokens AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 2)) AS term FROM documents)"


@query("d20_corpus_statistics", f"WITH {_TOKENS} SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS tf FROM tokens GROUP BY term")
def _(f: Frames) -> DataFrame:
    return V.term_statistics(f.documents.select("doc_id", "text"))


@query("d21_signal_frequency", f"SELECT s AS signal, CAST(count(*) FILTER (WHERE contains(lower(text), s)) AS BIGINT) AS df FROM documents, (VALUES ('the'), ('ing'), ('ea'), ('zz')) t(s) GROUP BY s")
def _(f: Frames) -> DataFrame:
    return V.signal_frequency(f.documents.select("text"), ["the", "ing", "ea", "zz"])


@query("d23_finalist_outcomes", "SELECT provider, CAST(count(*) FILTER (WHERE fit >= 7) AS BIGINT) AS qualified, CAST(count(*) FILTER (WHERE fit < 7 AND skyline) AS BIGINT) AS rescued, CAST(count(*) FILTER (WHERE fit >= 7 OR skyline) AS BIGINT) AS returned FROM candidates GROUP BY provider")
def _(f: Frames) -> DataFrame:
    good = C("fit") >= 7
    return f.candidates.groupBy("provider").agg(F.count_if(good).alias("qualified"), F.count_if(~good & C("skyline")).alias("rescued"), F.count_if(good | C("skyline")).alias("returned"))


_JUDGED = """asked AS (SELECT DISTINCT requirement_id, importance, scope FROM requirements), j AS (SELECT candidate_id, requirement_id, arg_min(status, (line_no, status)) AS status FROM judgments GROUP BY ALL), c AS (SELECT DISTINCT candidate_id FROM judgments),
  a AS (SELECT c.candidate_id, asked.requirement_id, importance = 'hard' AND scope <> 'signal' AS profile, coalesce(status, 'unknown') AS status FROM c CROSS JOIN asked LEFT JOIN j ON j.candidate_id = c.candidate_id AND j.requirement_id = asked.requirement_id),
  o AS (SELECT candidate_id, CASE WHEN bool_or(profile AND status = 'fail') THEN 'hard_fail' WHEN bool_and(NOT profile OR status = 'pass') THEN 'qualified' ELSE 'unknown' END AS verdict FROM a GROUP BY candidate_id)"""


@query("d24_judgment_counts", f"WITH {_JUDGED} SELECT verdict, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY verdict")
def _(f: Frames) -> DataFrame:
    return V.verdicts(f.judgments, f.requirements).groupBy("verdict").agg(F.count("*").alias("n"))


@query("k23_judgment_validation", f"WITH {_JUDGED} SELECT candidate_id, verdict FROM o")
def _(f: Frames) -> DataFrame:
    return V.verdicts(f.judgments, f.requirements)


@query("d25_key_pool", "SELECT provider, CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS active, CAST(count(*) FILTER (WHERE status = 'error') AS BIGINT) AS cooling, CAST(count(*) FILTER (WHERE status = 'skipped') AS BIGINT) AS exhausted FROM trace_events WHERE provider IS NOT NULL GROUP BY provider")
def _(f: Frames) -> DataFrame:
    return f.trace_events.where("provider IS NOT NULL").groupBy("provider").agg(F.count_if(C("status") == "success").alias("active"), F.count_if(C("status") == "error").alias("cooling"), F.count_if(C("status") == "skipped").alias("exhausted"))


@query("d26_historical_yield", f"SELECT family || ':' || lane || ':' || provider AS key, {S.fixed('qualified / runs')} AS value FROM arms ORDER BY runs DESC, family, lane, provider LIMIT 30")
def _(f: Frames) -> DataFrame:
    """The 30 busiest arms as one map of scope to mean yield, shown by its entries."""
    top = f.arms.orderBy(C("runs").desc(), "family", "lane", "provider").limit(30)
    entry = F.struct(F.concat_ws(":", "family", "lane", "provider").alias("key"), fixed(F.try_divide(C("qualified"), C("runs"))).alias("value"))
    return top.agg(F.map_from_entries(F.collect_list(entry)).alias("yields")).select(F.explode("yields").alias("key", "value"))


@query("d27_pool_entropy", f"SELECT {S.fixed('-sum(p * log2(p))', 6)} AS entropy FROM (SELECT s / sum(s) OVER () AS p FROM (SELECT greatest(fit, 1) AS s FROM candidates))")
def _(f: Frames) -> DataFrame:
    """K9's entropy without gathering the pool: H = log2(S) - sum(s log2 s) / S from two sums."""
    s = F.greatest("fit", F.lit(1.0))
    total, weighted = F.sum(s), F.sum(s * F.log2(s))
    return f.candidates.agg(fixed(F.log2(total) - weighted / total, 6).alias("entropy"))


@query("d28_word_count", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_words, CAST(len(list_filter(['ention', 'guarantee', 'the '], lambda p: contains(lower(text), p))) AS BIGINT) AS n_spam FROM documents")
def _(f: Frames) -> DataFrame:
    phrases = F.array(*map(F.lit, ("ention", "guarantee", "the ")))
    n_words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return f.documents.select("doc_id", n_words.cast("long").alias("n_words"), F.size(F.filter(phrases, lambda p: F.lower("text").contains(p))).cast("long").alias("n_spam"))


@query("d29_assistant_context", "SELECT id, composite FROM (SELECT id, composite FROM leads ORDER BY created_at DESC NULLS LAST, id LIMIT 50) ORDER BY composite DESC NULLS LAST, id LIMIT 10")
def _(f: Frames) -> DataFrame:
    newest = f.leads.select("id", "composite", "created_at").orderBy(C("created_at").desc_nulls_last(), "id").limit(50)
    return newest.orderBy(C("composite").desc_nulls_last(), "id").limit(10).select("id", "composite")
