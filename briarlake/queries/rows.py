"""Scans, projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.functions import text as T
from briarlake.functions.numeric import whole
from briarlake.operators import records as R
from briarlake.queries import sql as S
from briarlake.registry import Frames, query

C = F.col
_LEAST = "2000-01-01"


@query("a01_filtered_lead_scan", """SELECT id, stage, created_at, (SELECT count(*) FROM leads WHERE stage = 'ENRICHED' AND lower(coalesce(company, '')) LIKE '%labs%') AS total FROM leads
  WHERE stage = 'ENRICHED' AND lower(coalesce(company, '')) LIKE '%labs%' ORDER BY created_at DESC NULLS LAST, updated_at DESC NULLS LAST, id LIMIT 20 OFFSET 5""")
def _(f: Frames) -> DataFrame:
    return R.lead_page(f.leads, {"stage": "ENRICHED", "review_status": "All"}, "labs", ["company"], limit=20, offset=5).select("id", "stage", "created_at", "total")


@query("a02_json_payloads", "SELECT id, CAST(length(full_name) + length(industry) AS BIGINT) AS size, industry FROM leads")
def _(f: Frames) -> DataFrame:
    payload = F.to_json(F.struct("id", "full_name", "industry"))
    back = F.from_json(payload, "id long, full_name string, industry string")
    return f.leads.select("id", (F.length(back["full_name"]) + F.length(back["industry"])).cast("long").alias("size"), back["industry"].alias("industry"))


@query("a03_point_lookup", "SELECT id, full_name, stage FROM leads WHERE id = 77")
def _(f: Frames) -> DataFrame:
    return f.leads.where("id = 77").select("id", "full_name", "stage")


@query("a04_tolerant_json_scan", "SELECT session_id, CAST(json_extract_string(checkpoint_json, '$.round') AS BIGINT) AS round FROM sessions WHERE checkpoint_json IS NOT NULL AND session_id % 5 <> 0")
def _(f: Frames) -> DataFrame:
    broken = F.when(C("session_id") % 5 == 0, F.lit('{"round":')).otherwise(C("checkpoint_json"))
    return R.readable_json(f.sessions.withColumn("payload", broken), "payload", "round long").select("session_id", "payload.round")


@query("a05_identity_keys", f"""SELECT DISTINCT key FROM (SELECT {S.identity('url')} AS key FROM leads WHERE {S.identity('url')} <> '' UNION ALL SELECT 'email:' || lower(email) FROM leads WHERE coalesce(email, '') <> ''
  UNION ALL SELECT 'name_company:' || lower(trim(full_name)) || '::' || lower(company) FROM leads WHERE trim(full_name) <> '' AND coalesce(company, '') <> '')""")
def _(f: Frames) -> DataFrame:
    """G1 too: a distinct union of three key sources."""
    ids = f.leads.select(T.profile_identity(C("url")).alias("key")).where("key <> ''")
    mails = f.leads.where("coalesce(email, '') <> ''").select(F.concat(F.lit("email:"), F.lower("email")).alias("key"))
    names = f.leads.where("trim(full_name) <> '' AND coalesce(company, '') <> ''").select(F.concat(F.lit("name_company:"), F.lower(F.trim("full_name")), F.lit("::"), F.lower("company")).alias("key"))
    return ids.union(mails).union(names).distinct()


@query("a11_serp_rows", "SELECT seq, 'hit ' || k AS title, 'http://h' || k || '.org' AS url FROM observations, (VALUES (1), (2)) t(k) WHERE seq % 3 <> 2")
def _(f: Frames) -> DataFrame:
    body = F.concat(F.lit('{"'), F.when(C("seq") % 3 == 0, "organic").when(C("seq") % 3 == 1, "results").otherwise("none"), F.lit('":[{"title":"hit 1","link":"http://h1.org"},{"title":"hit 2","link":"http://h2.org"},{"title":"no link"}]}'))
    return R.serp_rows(f.observations.select("seq", body.alias("body")), "body").select("seq", "title", "url")


@query("a14_chunks_of_five", "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 5 AS chunk FROM leads WHERE stage = 'SCRAPED'")
def _(f: Frames) -> DataFrame:
    return R.chunked(f.leads.where("stage = 'SCRAPED'").select("id"), ["id"], 5)


@query("a15_csv_import", f"SELECT id, trim(full_name) AS full_name, coalesce(nullif(trim(coalesce(company, '')), ''), 'Independent') AS company, coalesce(nullif(trim(title), ''), 'Professional') AS title, 'Tech' AS industry FROM leads WHERE trim(full_name) <> ''")
def _(f: Frames) -> DataFrame:
    raw = f.leads.select(C("id").alias("Row id"), C("full_name").alias("Contact Full Name"), C("company").alias("Organization / Company"), C("title").alias("Job Title"))
    return R.imported(raw)


@query("a16_csv_export", rf"""SELECT id, CASE WHEN regexp_matches(p[1], '^\s*[=+\-@]') THEN '''' || p[1] ELSE coalesce(p[1], '') END AS first_name, array_to_string(p[2:], ' ') AS last_name, CASE WHEN regexp_matches(e, '^\s*[=+\-@]') THEN '''' || e ELSE e END AS email
  FROM (SELECT id, string_split_regex(trim(full_name), '\s+') AS p, CASE WHEN id % 4 = 0 THEN '=' || id ELSE coalesce(email, '') END AS e FROM leads)""")
def _(f: Frames) -> DataFrame:
    parts = F.split(F.trim("full_name"), r"\s+")
    mail = F.when(C("id") % 4 == 0, F.concat(F.lit("="), C("id").cast("string"))).otherwise(C("email"))
    return f.leads.select("id", T.csv_safe(F.get(parts, F.lit(0))).alias("first_name"), T.csv_safe(F.array_join(F.slice(parts, 2, 100), " ")).alias("last_name"), T.csv_safe(mail).alias("email"))


@query("a21_delete_with_cascade", "SELECT id, key FROM (SELECT id, lower(email) AS key FROM leads WHERE coalesce(email, '') <> '') WHERE id % 10 <> 3")
def _(f: Frames) -> DataFrame:
    keys = f.leads.where("coalesce(email, '') <> ''").select("id", F.lower("email").alias("key"))
    doomed = f.leads.where("id % 10 = 3").select(C("id").alias("gone"))
    kept = f.leads.join(doomed, C("id") == C("gone"), "left_anti").select(C("id").alias("kept"))
    return keys.join(kept, C("id") == C("kept"), "left_semi")


@query("a22_log_retention", "SELECT log_id, logged_at FROM search_logs WHERE status IS NOT NULL ORDER BY logged_at DESC, log_id DESC LIMIT 50")
def _(f: Frames) -> DataFrame:
    """E12 and G6 too: upsert by id, then only the newest N stay."""
    newer = f.search_logs.where("status IS NOT NULL").select("log_id", "logged_at")
    return R.upsert_keep_newest(newer.limit(0), newer, "log_id", "logged_at", 50)


@query("a24_stage_logs", "SELECT event_id, ts, input_tokens, output_tokens FROM trace_events WHERE provider = 'llm' AND session_id = 7 ORDER BY ts, event_id LIMIT 500")
def _(f: Frames) -> DataFrame:
    return f.trace_events.where("provider = 'llm' AND session_id = 7").select("event_id", "ts", "input_tokens", "output_tokens").orderBy("ts", "event_id").limit(500)


@query("a25_activities", "SELECT id, max(logged_at) AS logged_at FROM (SELECT session_id AS id, logged_at FROM search_logs) GROUP BY id ORDER BY logged_at DESC, id LIMIT 100")
def _(f: Frames) -> DataFrame:
    return f.search_logs.groupBy(C("session_id").alias("id")).agg(F.max("logged_at").alias("logged_at")).orderBy(C("logged_at").desc(), "id").limit(100)


@query("a26_drafts", "SELECT log_id, prompt, logged_at FROM search_logs WHERE log_id % 7 <> 0 ORDER BY logged_at DESC, log_id LIMIT 50")
def _(f: Frames) -> DataFrame:
    gone = f.search_logs.where("log_id % 7 = 0").select(C("log_id").alias("gone"))
    return f.search_logs.join(gone, C("log_id") == C("gone"), "left_anti").select("log_id", "prompt", "logged_at").orderBy(C("logged_at").desc(), "log_id").limit(50)


@query("a27_saved_searches", "SELECT o.log_id, coalesce(s.logged_at, o.logged_at + INTERVAL '1' DAY) AS created_at, o.prompt FROM search_logs o LEFT JOIN (SELECT * FROM search_logs WHERE log_id % 2 = 0) s ON o.log_id = s.log_id")
def _(f: Frames) -> DataFrame:
    stored = f.search_logs.where("log_id % 2 = 0").select(C("log_id").alias("id"), C("logged_at").alias("was"))
    return f.search_logs.join(stored, C("log_id") == C("id"), "left").select("log_id", F.coalesce("was", C("logged_at") + F.expr("INTERVAL '1' DAY")).alias("created_at"), "prompt")


@query("a28_local_drafts_first", "SELECT log_id, src FROM (SELECT log_id, logged_at, 0 AS src FROM search_logs WHERE log_id % 3 = 0 AND log_id % 2 <> 0 UNION ALL SELECT log_id, logged_at, 1 FROM search_logs WHERE log_id % 2 = 0) ORDER BY src, logged_at DESC, log_id LIMIT 12")
def _(f: Frames) -> DataFrame:
    """C14 and G4 too: local rows that the server lacks, then the server's."""
    server = f.search_logs.where("log_id % 2 = 0").select("log_id", "logged_at")
    local = f.search_logs.where("log_id % 3 = 0").select("log_id", "logged_at").join(server.select(C("log_id").alias("known")), C("log_id") == C("known"), "left_anti")
    return local.withColumn("src", F.lit(0)).unionByName(server.withColumn("src", F.lit(1))).orderBy("src", C("logged_at").desc(), "log_id").limit(12).select("log_id", "src")


@query("a30_ttl_cache", "SELECT cache_id, created_at FROM cache WHERE username = 'user-7' AND expires_at > TIMESTAMP '1996-01-01'")
def _(f: Frames) -> DataFrame:
    """I8 too: only what has not expired at a given time."""
    return R.unexpired(f.cache.where("username = 'user-7'"), "1996-01-01").select("cache_id", "created_at")


@query("a31_performance_scan", "SELECT family, lane, provider, runs FROM arms ORDER BY runs DESC, family, lane, provider LIMIT 100")
def _(f: Frames) -> DataFrame:
    return f.arms.select("family", "lane", "provider", "runs").orderBy(C("runs").desc(), "family", "lane", "provider").limit(100)


@query("a32_resumable_sessions", "SELECT session_id FROM sessions WHERE status = 'interrupted' AND checkpoint_json IS NOT NULL ORDER BY age_days, session_id LIMIT 20")
def _(f: Frames) -> DataFrame:
    return f.sessions.where("status = 'interrupted' AND checkpoint_json IS NOT NULL").orderBy("age_days", "session_id").limit(20).select("session_id")


@query("a33_session_deletes", "SELECT CAST(count(*) FILTER (WHERE status = 'interrupted') AS BIGINT) AS n_deleted, CAST(count(*) FILTER (WHERE status <> 'interrupted') AS BIGINT) AS n_left FROM sessions")
def _(f: Frames) -> DataFrame:
    return f.sessions.agg(F.count_if(C("status") == "interrupted").alias("n_deleted"), F.count_if(C("status") != "interrupted").alias("n_left"))


@query("a34_by_id_readers", "SELECT session_id, status FROM sessions WHERE session_id IN (5, 9)")
def _(f: Frames) -> DataFrame:
    return f.sessions.where("session_id IN (5, 9)").select("session_id", "status")


@query("a35_enrichment_upsert", "SELECT username, person, company, max(created_at) AS created_at FROM cache GROUP BY username, person, company HAVING max(created_at) + INTERVAL '400' DAY > TIMESTAMP '1997-01-01'")
def _(f: Frames) -> DataFrame:
    latest = f.cache.groupBy("username", "person", "company").agg(F.max("created_at").alias("created_at"))
    return latest.where("created_at + INTERVAL '400' DAY > TIMESTAMP_NTZ '1997-01-01'")


@query("b01_promoted_columns", """SELECT id, nullif(trim(full_name), '') AS full_name, nullif(trim(coalesce(company, '')), '') AS company, coalesce(nullif(trim(title), ''), nullif(trim(headline), '')) AS title, coalesce(nullif(trim(stage), ''), 'NEW') AS stage,
  coalesce(qualification, predictive, composite) AS score, lower(nullif(trim(coalesce(email, '')), '')) AS email FROM leads""")
def _(f: Frames) -> DataFrame:
    return R.promoted(f.leads)


@query("b02_legacy_record", r"""SELECT id, CASE WHEN regexp_matches(lower(trim(coalesce(email, ''))), '^[^\s@]+@[^\s@]+\.[^\s@]+$') THEN lower(trim(email)) WHEN id % 2 = 0 THEN 'old' || id || '@mail.org' ELSE email END AS email FROM leads""")
def _(f: Frames) -> DataFrame:
    old = F.when(C("id") % 2 == 0, F.concat(F.lit("Old"), C("id").cast("string"), F.lit("@mail.org")))
    nested = f.leads.select("id", F.struct(F.struct("email", F.lit("x").alias("emailStatus"), F.lit(1).alias("emailConfidence")).alias("contact"), F.struct(old.alias("bestEmail")).alias("emailDiscovery")).alias("profile"))
    return R.without_legacy(nested).select("id", "profile.contact.email")


@query("b03_domain_defaults", "SELECT id, CASE WHEN review_status IN ('UNREVIEWED', 'KEEP', 'MAYBE', 'REJECT') THEN review_status ELSE 'UNREVIEWED' END AS review, CASE WHEN next_action IN ('NONE', 'OPEN_LINKEDIN', 'RESEARCH', 'CONNECT', 'MESSAGE') THEN next_action ELSE 'NONE' END AS action FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", R.in_domain(C("review_status"), R.REVIEW_STATUSES, "UNREVIEWED").alias("review"), R.in_domain(C("next_action"), R.NEXT_ACTIONS, "NONE").alias("action"))


@query("b04_wildcard_filter", "SELECT id FROM leads WHERE industry = 'BUILDING'")
def _(f: Frames) -> DataFrame:
    return R.filtered(f.leads, {"industry": "BUILDING", "stage": "All", "location": ""}).select("id")


@query("b05_substring_search", "SELECT id FROM leads WHERE lower(full_name) LIKE '%1_0%' OR lower(coalesce(company, '')) LIKE '%1_0%' OR lower(title) LIKE '%1_0%' OR lower(coalesce(email, '')) LIKE '%1_0%'")
def _(f: Frames) -> DataFrame:
    return R.searched(f.leads, "1_0", ["full_name", "company", "title", "email"]).select("id")


@query("b06_concatenated_search", "SELECT id FROM leads WHERE contains(lower(concat_ws(chr(1), full_name, company, title, headline, industry, location, email, stage)), 'vp of')")
def _(f: Frames) -> DataFrame:
    return f.leads.where(F.lower(F.concat_ws("\u0001", "full_name", "company", "title", "headline", "industry", "location", "email", "stage")).contains("vp of")).select("id")


@query("b07_board", "SELECT stage, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id FROM leads WHERE industry = 'MACHINERY' AND (contains(lower(full_name), '1') OR contains(lower(coalesce(company, '')), '1') OR contains(lower(title), '1')) GROUP BY stage")
def _(f: Frames) -> DataFrame:
    hit = F.lower("full_name").contains("1") | F.lower(T.text(C("company"))).contains("1") | F.lower("title").contains("1")
    return f.leads.where((C("industry") == "MACHINERY") & hit).groupBy("stage").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("b08_incoming_batch", f"SELECT coalesce(CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id AS VARCHAR) END, 'gen-' || substr(sha256(full_name), 1, 12)) AS lead_id, coalesce(created_at, TIMESTAMP '{_LEAST}') AS created_at FROM leads WHERE id % 13 <> 0")
def _(f: Frames) -> DataFrame:
    given = F.when(C("id") % 6 != 0, C("id").cast("string"))
    rows = f.leads.where("id % 13 <> 0")
    return rows.select(F.coalesce(given, F.concat(F.lit("gen-"), F.substring(F.sha2("full_name", 256), 1, 12))).alias("lead_id"), F.coalesce("created_at", F.lit(_LEAST).cast("timestamp_ntz")).alias("created_at"))


_REASON = """CASE WHEN trim(full_name) = '' THEN 'missing_identity' WHEN trim(coalesce(title, '')) = '' AND trim(coalesce(company, '')) = '' AND trim(coalesce(headline, '')) = '' THEN 'missing_role_context'
  WHEN id % 19 = 0 THEN 'duplicate_existing_lead' WHEN ignored_title AND coalesce(authority, 0) < 4 AND fit < 6 THEN 'not_decision_maker' WHEN fit < 5 THEN 'score_below_minimum' END"""


@query("b09_filter_cascade", f"SELECT coalesce(reason, 'accepted') AS reason, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_REASON} AS reason FROM candidates) GROUP BY 1")
def _(f: Frames) -> DataFrame:
    reason = R.first_reason(
        ("missing_identity", F.trim("full_name") == ""),
        ("missing_role_context", F.concat(*[F.trim(T.text(C(c))) for c in ("title", "company", "headline")]) == ""),
        ("duplicate_existing_lead", C("id") % 19 == 0),
        ("not_decision_maker", C("ignored_title") & (F.coalesce("authority", F.lit(0.0)) < 4) & (C("fit") < 6)),
        ("score_below_minimum", C("fit") < 5),
    )
    return f.candidates.select(F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("b10_exclusion_list", f"SELECT id FROM leads WHERE NOT ({S.dedupe('company')} IN ('techflow ai, llc', 'beacon & sons, inc.') OR {S.dedupe('email')} IN ('no-reply@corp.io') OR {S.dedupe('full_name')} IN ('techflow ai, llc'))")
def _(f: Frames) -> DataFrame:
    excluded = f.spark.createDataFrame([("techflow ai, llc",), ("beacon & sons, inc.",), ("no-reply@corp.io",)], "excluded string")
    return R.without_excluded(f.leads, ["full_name", "company", "email"], excluded, "id").select("id")


@query("b11_borderline", "SELECT id, fit FROM candidates WHERE fit BETWEEN 5 AND 7 OR quality <> 'good' ORDER BY fit DESC, id LIMIT 25")
def _(f: Frames) -> DataFrame:
    return f.candidates.where(C("fit").between(5, 7) | (C("quality") != "good")).orderBy(C("fit").desc(), "id").limit(25).select("id", "fit")


@query("b12_acceptance", "SELECT id, fit FROM candidates WHERE NOT ignored_title AND coalesce(authority, 0) >= 5 AND fit >= 6 ORDER BY id LIMIT 40")
def _(f: Frames) -> DataFrame:
    return f.candidates.where(~C("ignored_title") & (F.coalesce("authority", F.lit(0.0)) >= 5) & (C("fit") >= 6)).orderBy("id").limit(40).select("id", "fit")


@query("b13_provider_routing", """SELECT id, coalesce(preference = 'tavily' OR lane = 'person' OR preference = 'corroborate', false) AS run_primary, coalesce(preference = 'brightdata', false) OR results < 5 AS run_fallback,
  coalesce(preference IN ('corroborate', 'brightdata') OR lane IN ('account', 'signal'), false) AS run_secondary FROM tasks""")
def _(f: Frames) -> DataFrame:
    return routed(f.tasks)


def routed(tasks: DataFrame) -> DataFrame:
    preferred, lane, no = C("preference"), C("lane"), F.lit(False)
    return tasks.select("id", F.coalesce((preferred == "tavily") | (lane == "person") | (preferred == "corroborate"), no).alias("run_primary"), (F.coalesce(preferred == "brightdata", no) | (C("results") < 5)).alias("run_fallback"), F.coalesce(preferred.isin("corroborate", "brightdata") | lane.isin("account", "signal"), no).alias("run_secondary"))


@query("b35_provider_task_lists", """SELECT 'primary' AS provider, id FROM tasks WHERE preference IN ('tavily', 'corroborate') OR lane = 'person'
 UNION ALL SELECT 'secondary', id FROM tasks WHERE preference IN ('corroborate', 'brightdata') OR lane IN ('account', 'signal')""")
def _(f: Frames) -> DataFrame:
    """Each provider's list of tasks, by the routing predicates of B13."""
    lists = F.array(F.when(C("run_primary"), "primary"), F.when(C("run_secondary"), "secondary"))
    return routed(f.tasks).select(F.explode(F.array_compact(lists)).alias("provider"), "id")


@query("b15_blocked_urls", f"SELECT seq, NOT regexp_matches({S.host('url')}, '{T.PUBLIC_HOST}') OR {S.under(S.host('url'), T.BLOCKED_DOMAINS)} AS blocked FROM observations")
def _(f: Frames) -> DataFrame:
    return f.observations.select("seq", T.blocked_url(C("url")).alias("blocked"))


@query("b16_signal_observations", f"SELECT seq FROM observations WHERE ({S.handle('url')}) = '' AND (coalesce(lane, '') = 'signal' OR coalesce(intent, '') = 'find_buying_signal')")
def _(f: Frames) -> DataFrame:
    return f.observations.where((T.profile_handle(C("url")) == "") & ((T.text(C("lane")) == "signal") | (T.text(C("intent")) == "find_buying_signal"))).select("seq")


@query("b17_thin_pages", f"SELECT seq FROM observations WHERE ({S.handle('url')}) = '' AND length(content) < 420")
def _(f: Frames) -> DataFrame:
    return f.observations.where((T.profile_handle(C("url")) == "") & (F.length("content") < 420)).select("seq")


@query("b18_usable_email", r"SELECT id FROM leads WHERE regexp_matches(lower(trim(coalesce(email, ''))), '^[^\s@]+@[^\s@]+\.[^\s@]+$')")
def _(f: Frames) -> DataFrame:
    return f.leads.where(F.lower(F.trim(T.text(C("email")))).rlike(T.USABLE_EMAIL)).select("id")


_LEAD_TEXT = "lower(concat_ws(' ', full_name, title, headline, company, location, industry))"


@query("b19_requirement_matches", f"SELECT l.id, r.requirement_id, bool_or(contains({_LEAD_TEXT}, r.term)) AS matched FROM leads l CROSS JOIN requirements r GROUP BY l.id, r.requirement_id")
def _(f: Frames) -> DataFrame:
    return R.requirement_matches(f.leads, f.requirements, ["full_name", "title", "headline", "company", "location", "industry"])


@query("b20_whole_terms", "SELECT l.id, r.requirement_id, r.term FROM leads l CROSS JOIN requirements r WHERE contains(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || r.term || ' ')")
def _(f: Frames) -> DataFrame:
    hits = R.whole_term_hits(f.leads, "id", C("title"), f.requirements, "term").withColumnRenamed("term", "_term")
    return hits.join(f.requirements, C("_term") == C("term")).select("id", "requirement_id", "term")


_STRICT = """strict AS (SELECT l.id, r.requirement_id, r.importance, r.scope, bool_or(contains(' ' || trim(regexp_replace(lower(coalesce(CASE r.scope WHEN 'person_role' THEN title || ' ' || coalesce(headline, '') WHEN 'person_location' THEN location
  WHEN 'company_type' THEN concat_ws(' ', company, industry, headline) WHEN 'company_industry' THEN concat_ws(' ', company, industry, headline) END, '')), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || r.term || ' ')) AS matched FROM leads l CROSS JOIN requirements r GROUP BY ALL)"""


@query("b21_strict_matches", f"WITH {_STRICT} SELECT id, requirement_id, matched FROM strict")
def _(f: Frames) -> DataFrame:
    return R.strict_matches(f.leads, f.requirements).select("id", "requirement_id", "matched")


@query("b22_strict_partition", f"WITH {_STRICT} SELECT id, bool_and(matched) AS auto_qualified FROM strict WHERE importance = 'hard' AND scope <> 'signal' GROUP BY id")
def _(f: Frames) -> DataFrame:
    found = R.strict_matches(f.leads, f.requirements).where("importance = 'hard' AND scope <> 'signal'")
    return found.groupBy("id").agg(F.bool_and("matched").alias("auto_qualified"))


@query("b23_plausible_company", f"SELECT seq, {S.plausible('title')} AS plausible FROM observations")
def _(f: Frames) -> DataFrame:
    return f.observations.select("seq", T.plausible_hint(C("title")).alias("plausible"))


@query("b24_snippets", rf"""WITH lines AS (SELECT seq, list_filter(list_transform(string_split('LINK: x' || chr(10) || '[P 1] ' || content, chr(10)), lambda x: {S.collapse(r"regexp_replace(x, '^\[[^\]]+\]\s*', '')")}),
  lambda x: x <> '' AND NOT starts_with(x, 'LINK:') AND NOT starts_with(x, 'SOURCE_PROVIDER:'))[1:3] AS s FROM observations)
  SELECT seq, array_to_string(list_transform(s, lambda x: CASE WHEN length(x) > 260 THEN trim(substr(x, 1, 257)) || '...' ELSE x END), '|') AS snippets FROM lines""")
def _(f: Frames) -> DataFrame:
    block = F.concat(F.lit("LINK: x\n[P 1] "), C("content"))
    return f.observations.select("seq", F.array_join(T.snippets(block), "|").alias("snippets"))


@query("b25_evidence_quality", f"SELECT seq, CASE WHEN seq % 2 = 0 AND length({S.collapse('content')}) >= 700 THEN 'good' WHEN length({S.collapse('content')}) >= CASE WHEN seq % 2 = 0 THEN 120 ELSE 120 END THEN 'partial' ELSE 'weak' END AS quality FROM observations")
def _(f: Frames) -> DataFrame:
    raw = F.when(C("seq") % 2 == 0, C("content"))
    return f.observations.select("seq", R.inferred_quality(raw, C("content")).alias("quality"))


@query("b26_safe_merge", "SELECT w.id, coalesce(nullif(w.company, ''), l.company) AS company, coalesce(nullif(w.email, ''), l.email) AS email, array_to_string(list_sort(list_distinct([w.stage, l.stage, 'merged'])), ',') AS tags FROM leads w JOIN leads l ON l.id = w.id + 1")
def _(f: Frames) -> DataFrame:
    """G3 and L2 too: the winner's filled fields, the loser's for the rest, tags united."""
    loser = f.leads.select((C("id") - 1).alias("into"), C("company").alias("l_company"), C("email").alias("l_email"), C("stage").alias("l_stage"))
    pair = f.leads.join(loser, C("id") == C("into"))
    tags = F.array_union(F.array("stage"), F.array("l_stage", F.lit("merged")))
    return pair.select("id", F.coalesce(F.nullif("company", F.lit("")), "l_company").alias("company"), F.coalesce(F.nullif("email", F.lit("")), "l_email").alias("email"), F.array_join(F.array_sort(tags), ",").alias("tags"))


@query("b27_fill_only_empty", "SELECT id, coalesce(nullif(nullif(trim(coalesce(company, '')), ''), 'Unknown'), 'Found Co') AS company, CASE WHEN trim(coalesce(company, '')) IN ('', 'Unknown') THEN 'company' ELSE '' END || CASE WHEN trim(coalesce(headline, '')) = '' THEN ',headline' ELSE '' END AS changed FROM leads")
def _(f: Frames) -> DataFrame:
    empty = F.trim(T.text(C("company"))).isin("", "Unknown")
    changed = F.concat(F.when(empty, "company").otherwise(""), F.when(F.trim(T.text(C("headline"))) == "", ",headline").otherwise(""))
    return f.leads.select("id", F.when(empty, "Found Co").otherwise(F.trim("company")).alias("company"), changed.alias("changed"))


@query("b28_persisted_lead", "SELECT id, CAST(floor(fit * 10 + 0.5) AS BIGINT) AS composite, CAST(least(96, floor(floor(fit * 10 + 0.5) * CASE WHEN account_pain IS NULL THEN 0.9::DOUBLE ELSE 0.96::DOUBLE END)) AS BIGINT) AS predictive, concat_ws(',', provider, quality, CASE WHEN skyline THEN 'skyline' END) AS tags FROM candidates")
def _(f: Frames) -> DataFrame:
    composite = whole(C("fit") * 10)
    predictive = F.least(F.lit(96), F.floor(composite * F.when(C("account_pain").isNull(), 0.9).otherwise(0.96)))
    tags = F.array_distinct(F.array_compact(F.array("provider", "quality", F.when(C("skyline"), F.lit("skyline")))))
    return f.candidates.select("id", composite.cast("long").alias("composite"), predictive.cast("long").alias("predictive"), F.array_join(tags, ",").alias("tags"))


@query("b29_provenance", "SELECT id, coalesce(headline, title, '') AS discovery_query, location, coalesce(industry, '') AS industry FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", F.coalesce("headline", "title", F.lit("")).alias("discovery_query"), "location", T.text(C("industry")).alias("industry"))


@query("b30_three_way_rebase", "SELECT id, CASE WHEN CASE WHEN id % 3 = 0 THEN 'KEEP' ELSE review_status END IS DISTINCT FROM review_status THEN CASE WHEN id % 3 = 0 THEN 'KEEP' ELSE review_status END ELSE CASE WHEN id % 2 = 0 THEN 'MAYBE' ELSE review_status END END AS review FROM leads")
def _(f: Frames) -> DataFrame:
    base = C("review_status")
    desired, canonical = F.when(C("id") % 3 == 0, "KEEP").otherwise(base), F.when(C("id") % 2 == 0, "MAYBE").otherwise(base)
    return f.leads.select("id", R.rebased(canonical, desired, base).alias("review"))


@query("b31_prefer_newer", "SELECT l.id, CASE WHEN (l.id % 4) > l.revision THEN 'known' ELSE 'candidate' END AS chosen FROM leads l")
def _(f: Frames) -> DataFrame:
    both = f.leads.select("id", C("revision").alias("rev"), F.lit("candidate").alias("chosen")).unionByName(f.leads.select("id", (C("id") % 4).alias("rev"), F.lit("known").alias("chosen")))
    return both.groupBy("id").agg(F.max_by("chosen", F.struct("rev", (C("chosen") == "candidate").alias("first"))).alias("chosen"))


@query("b33_profile_text", f"""SELECT id, substr({S.collapse("concat_ws(chr(10), CASE WHEN full_name <> '' THEN 'Name: ' || substr(" + S.collapse('full_name') + ", 1, 120) END, 'Title: ' || substr(" + S.collapse('title') + ", 1, 120), CASE WHEN coalesce(company, '') <> '' THEN 'Company: ' || substr(" + S.collapse('company') + ", 1, 120) END, 'Location: ' || location)")}, 1, 280) AS profile FROM leads""")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", T.profile_text([("Name", C("full_name")), ("Title", C("title")), ("Company", C("company")), ("Location", C("location"))]).alias("profile"))


@query("b32_evidence_record", rf"""WITH lines AS (SELECT seq, url, provider, query, round, list_filter(list_transform(string_split('LINK: x' || chr(10) || '[P 1] ' || content, chr(10)), lambda x: {S.collapse(r"regexp_replace(x, '^\[[^\]]+\]\s*', '')")}),
  lambda x: x <> '' AND NOT starts_with(x, 'LINK:') AND NOT starts_with(x, 'SOURCE_PROVIDER:'))[1:3] AS s FROM observations)
  SELECT seq, url, provider, query, round, array_to_string(list_transform(s, lambda x: CASE WHEN length(x) > 260 THEN trim(substr(x, 1, 257)) || '...' ELSE x END), '|') AS snippets FROM lines""")
def _(f: Frames) -> DataFrame:
    """The snippets of B24 from the whole content."""
    block = F.concat(F.lit("LINK: x\n[P 1] "), C("content"))
    record = F.struct("url", "provider", "query", "round", T.snippets(block).alias("snippets"))
    return f.observations.select("seq", record.alias("e")).select("seq", "e.url", "e.provider", "e.query", "e.round", F.array_join("e.snippets", "|").alias("snippets"))


@query("b34_finalist_evidence", "SELECT id, 'e' || k AS evidence_id, CASE k WHEN 0 THEN 'Title: ' || title WHEN 1 THEN headline ELSE industry END AS body FROM leads, (VALUES (0), (1), (2)) t(k) WHERE CASE k WHEN 0 THEN true WHEN 1 THEN coalesce(headline, '') <> '' ELSE true END AND NOT (k = 1 AND headline IS NULL)")
def _(f: Frames) -> DataFrame:
    items = F.array(F.concat(F.lit("Title: "), C("title")), C("headline"), C("industry"))
    return f.leads.select("id", F.posexplode(items).alias("k", "body")).where("coalesce(body, '') <> ''").select("id", F.concat(F.lit("e"), C("k").cast("string")).alias("evidence_id"), "body")
