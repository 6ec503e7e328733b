"""Joins: equi, anti, as-of latest, fuzzy and dominance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.functions import text as T
from briarlake.operators import identity as I
from briarlake.operators import matching as M
from briarlake.queries import sql as S
from briarlake.registry import Frames, query
from briarlake.scratch import Scratch

C = F.col
_KEYS = f"keys AS (SELECT id, created_at, unnest({S.keys('email', 'url', 'full_name', 'company', 'website')}) AS k FROM leads)"


def _keys(f: Frames) -> DataFrame:
    return f.leads.select("id", "created_at", F.explode(T.dedupe_keys(C("email"), C("url"), C("full_name"), C("company"), C("website"))).alias("k"))


@query("c01_identity_registry", f"WITH {_KEYS}, owners AS (SELECT k, arg_min(id, (created_at IS NULL, created_at, id)) AS owner FROM keys GROUP BY k) SELECT keys.id, keys.k, owner <> keys.id AS taken FROM keys JOIN owners USING (k)")
def _(f: Frames) -> DataFrame:
    keys = _keys(f)
    owners = I.key_owners(keys, "k").select(C("k").alias("_k"), "owner")
    return keys.join(owners, C("k") == C("_k")).select("id", "k", (C("owner") != C("id")).alias("taken"))


@query("c02_anti_on_any_key", f"WITH {_KEYS} SELECT id FROM leads WHERE id % 2 = 0 AND id NOT IN (SELECT id FROM keys WHERE k IN (SELECT k FROM keys WHERE id % 2 = 1))")
def _(f: Frames) -> DataFrame:
    keys = _keys(f)
    known = keys.where("id % 2 = 1").select("k")
    return I.without_known(f.leads.where("id % 2 = 0").select("id"), keys.where("id % 2 = 0"), known)


@query("c03_first_matching_key", f"""WITH probes AS (SELECT id, 1 AS pos, nullif({S.handle('url')}, '') AS k FROM leads UNION ALL SELECT id, 2, 'user-' || id % 400 FROM leads UNION ALL SELECT id, 3, lower(full_name) FROM leads),
  known AS (SELECT username AS k, max(cache_id) AS evidence_id FROM cache WHERE quality = 'good' GROUP BY username)
  SELECT l.id, coalesce(e.evidence_id, -1) AS evidence_id FROM leads l LEFT JOIN (SELECT id, arg_min(evidence_id, pos) AS evidence_id FROM probes JOIN known USING (k) GROUP BY id) e ON l.id = e.id""")
def _(f: Frames) -> DataFrame:
    probes = F.array(F.nullif(T.profile_handle(C("url")), F.lit("")), F.concat(F.lit("user-"), (C("id") % 400).cast("string")), F.lower("full_name"))
    known = f.cache.where("quality = 'good'").groupBy(C("username").alias("k")).agg(F.max("cache_id").alias("evidence_id"))
    return M.first_match(f.leads.select("id", probes.alias("probes")), "id", "probes", known, "evidence_id").select("id", F.coalesce("evidence_id", F.lit(-1)).alias("evidence_id"))


@query("c04_log_session_status", "SELECT g.log_id, coalesce(s.status, g.status) AS status FROM search_logs g LEFT JOIN sessions s ON g.session_id = s.session_id")
def _(f: Frames) -> DataFrame:
    sessions = f.sessions.select(C("session_id").alias("sid"), C("status").alias("session_status"))
    return f.search_logs.join(sessions, C("session_id") == C("sid"), "left").select("log_id", F.coalesce("session_status", "status").alias("status"))


_SCOPE = "lower(coalesce(nullif({0}, ''), 'general') || '|' || coalesce(nullif({1}, ''), 'person') || '|' || coalesce(nullif({2}, ''), 'tavily'))"


def scope(family: str, lane: str, provider: str) -> F.Column:
    filled = lambda c, d: F.coalesce(F.nullif(C(c), F.lit("")), F.lit(d))
    return F.lower(F.concat_ws("|", filled(family, "general"), filled(lane, "person"), filled(provider, "tavily")))


@query("c05_task_arm_statistics", f"SELECT t.id, coalesce(a.outcome_runs, 0) AS outcome_runs FROM tasks t LEFT JOIN arms a ON {_SCOPE.format('t.family', 't.lane', 't.preference')} = {_SCOPE.format('a.family', 'a.lane', 'a.provider')}")
def _(f: Frames) -> DataFrame:
    arms = f.arms.select(scope("family", "lane", "provider").alias("arm"), "outcome_runs")
    return f.tasks.withColumn("scope", scope("family", "lane", "preference")).join(arms, C("scope") == C("arm"), "left").select("id", F.coalesce("outcome_runs", F.lit(0)).alias("outcome_runs"))


_SIGNALS = "sig AS (SELECT DISTINCT company FROM leads WHERE coalesce(company, '') <> ''), cand AS (SELECT DISTINCT company FROM leads WHERE coalesce(company, '') <> '')"


@query("c06_fuzzy_companies", f"""WITH {_SIGNALS}, a AS (SELECT company, {S.company('company')} AS n, {S.distinctive('company')} AS t FROM cand), b AS (SELECT company, {S.company('company')} AS n, {S.distinctive('company')} AS t FROM sig)
  SELECT DISTINCT a.company AS candidate, b.company AS signal FROM a, b WHERE a.n <> '' AND b.n <> '' AND (a.n = b.n OR (length(replace(a.n, ' ', '')) >= 8 AND replace(a.n, ' ', '') = replace(b.n, ' ', '')) OR list_has_any(a.t, b.t))""")
def _(f: Frames) -> DataFrame:
    named = f.leads.where("coalesce(company, '') <> ''")
    return M.fuzzy_companies(named.select(C("company").alias("candidate")).distinct(), "candidate", named.select(C("company").alias("signal")).distinct(), "signal")


@query("c07_url_or_username", f"""WITH byurl AS (SELECT {S.profile_url('url')} AS u, max(cache_id) AS c FROM cache WHERE url IS NOT NULL GROUP BY 1), byname AS (SELECT username, max(cache_id) AS c FROM cache GROUP BY 1)
  SELECT l.id, coalesce(byurl.c, byname.c) AS scrape_id FROM leads l LEFT JOIN byurl ON {S.profile_url('l.url')} = u AND u <> '' LEFT JOIN byname ON ({S.handle('l.url')}) = username""")
def _(f: Frames) -> DataFrame:
    urls = f.cache.where("url IS NOT NULL").groupBy(T.profile_url(C("url")).alias("u")).agg(F.max("cache_id").alias("by_url")).where("u <> ''")
    names = f.cache.groupBy("username").agg(F.max("cache_id").alias("by_name"))
    leads = f.leads.select("id", T.profile_url(C("url")).alias("lead_url"), T.profile_handle(C("url")).alias("handle"))
    return leads.join(urls, C("lead_url") == C("u"), "left").join(names, C("handle") == C("username"), "left").select("id", F.coalesce("by_url", "by_name").alias("scrape_id"))


_ASOF = "FROM cache WHERE {where} AND created_at <= TIMESTAMP '1997-06-01' AND expires_at > TIMESTAMP '1997-06-01'"


@query("c08_cache_as_of", f"""WITH hit AS (SELECT username, arg_max(cache_id, (created_at, cache_id)) AS c {_ASOF.format(where="quality IN ('good', 'partial')")} GROUP BY username),
  fallback AS (SELECT company, arg_max(cache_id, (created_at, cache_id)) AS c {_ASOF.format(where="quality IN ('good', 'partial')")} GROUP BY company)
  SELECT l.id, coalesce(h.c, b.c) AS cache_id FROM leads l LEFT JOIN hit h ON h.username = 'user-' || l.id % 500 LEFT JOIN fallback b ON b.company = 'company ' || l.id % 25""")
def _(f: Frames) -> DataFrame:
    """E3 too: the newest entry that is valid at the time, by user name, else by company."""
    valid = M.valid_at(f.cache.where("quality IN ('good', 'partial')"), "1997-06-01")
    hit, fallback = M.latest(valid, "username", "by_user"), M.latest(valid, "company", "by_company")
    leads = f.leads.select("id", F.concat(F.lit("user-"), (C("id") % 500).cast("string")).alias("u"), F.concat(F.lit("company "), (C("id") % 25).cast("string")).alias("c"))
    return leads.join(hit, C("u") == C("username"), "left").join(fallback, C("c") == C("company"), "left").select("id", F.coalesce("by_user", "by_company").alias("cache_id"))


@query("c09_intent_cache", f"SELECT username, fingerprint, arg_max(cache_id, (created_at, cache_id)) AS cache_id {_ASOF.format(where='fingerprint IS NOT NULL')} GROUP BY username, fingerprint")
def _(f: Frames) -> DataFrame:
    return M.valid_at(f.cache.where("fingerprint IS NOT NULL"), "1997-06-01").groupBy("username", "fingerprint").agg(F.max_by("cache_id", F.struct("created_at", "cache_id")).alias("cache_id"))


@query("c10_negative_cache", f"SELECT id FROM leads WHERE ({S.handle('url')}) NOT IN (SELECT username {_ASOF.format(where="quality = 'bad'")})")
def _(f: Frames) -> DataFrame:
    bad = M.valid_at(f.cache.where("quality = 'bad'"), "1997-06-01").select("username")
    return f.leads.select("id", T.profile_handle(C("url")).alias("handle")).join(bad, C("handle") == C("username"), "left_anti").select("id")


_OBJECTIVES = ["total", "n_parts", "quantity", "discount"]
_SUPPLIERS = "objectives AS (SELECT l_suppkey AS id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS n_parts, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(max(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS discount FROM lineitem GROUP BY l_suppkey)"


def objectives(f: Frames) -> DataFrame:
    decimal = lambda c: C(c).cast("decimal(18,2)")
    return f.lineitem.groupBy(C("l_suppkey").alias("id")).agg(
        F.sum(decimal("l_extendedprice")).cast("double").alias("total"), F.count_distinct("l_partkey").cast("double").alias("n_parts"), F.sum(decimal("l_quantity")).cast("double").alias("quantity"), F.max(decimal("l_discount")).cast("double").alias("discount")
    )


@query("c11_pareto_skyline", f"WITH {_SUPPLIERS} SELECT id FROM objectives a WHERE NOT EXISTS (SELECT 1 FROM objectives b WHERE {' AND '.join(f'b.{o} >= a.{o}' for o in _OBJECTIVES)} AND ({' OR '.join(f'b.{o} > a.{o}' for o in _OBJECTIVES)}))")
def _(f: Frames) -> DataFrame:
    """K16 too."""
    suppliers = Scratch(f.spark, "suppliers").keep(objectives(f))  # read twice
    return M.skyline(suppliers, "id", _OBJECTIVES).select("id")


@query("c12_judged_requirements", """WITH asked AS (SELECT DISTINCT requirement_id FROM requirements), j AS (SELECT candidate_id, requirement_id, arg_min(status, (line_no, status)) AS status FROM judgments GROUP BY ALL)
  SELECT c.candidate_id, a.requirement_id, CASE WHEN j.status IN ('pass', 'fail') THEN j.status ELSE 'unknown' END AS status FROM (SELECT DISTINCT candidate_id FROM judgments) c CROSS JOIN asked a LEFT JOIN j ON j.candidate_id = c.candidate_id AND j.requirement_id = a.requirement_id""")
def _(f: Frames) -> DataFrame:
    return M.assessed(f.judgments, f.requirements.select("requirement_id").distinct())


@query("c13_query_attribution", f"WITH runs AS (SELECT ({S.handle('url')}) AS h, min(seq) AS run FROM observations WHERE ({S.handle('url')}) <> '' GROUP BY 1) SELECT l.id, r.run FROM leads l LEFT JOIN runs r ON 'u' || l.id % 70 = r.h")
def _(f: Frames) -> DataFrame:
    handle = T.profile_handle(C("url"))
    runs = f.observations.where(handle != "").groupBy(handle.alias("h")).agg(F.min("seq").alias("run"))
    return f.leads.select("id", F.concat(F.lit("u"), (C("id") % 70).cast("string")).alias("k")).join(runs, C("k") == C("h"), "left").select("id", "run")


def _walk_sql(stored: str, batch: str) -> str:
    """Leads in order of id, each against the keys held so far; recursion, a step a lead."""
    return f"""WITH RECURSIVE owned AS (SELECT id, list_distinct({S.keys('email', 'url', 'full_name', 'company', 'website')}) AS ks FROM leads), known AS (SELECT coalesce(flatten(list(ks)), []::VARCHAR[]) AS held FROM owned WHERE {stored}),
 r AS MATERIALIZED (SELECT id, ks, row_number() OVER (ORDER BY id) AS n FROM owned WHERE {batch}),
 w AS (SELECT 0::BIGINT AS n, 0::BIGINT AS id, false AS duplicate, held FROM known UNION ALL
 SELECT r.n, r.id, list_has_any(w.held, r.ks), CASE WHEN list_has_any(w.held, r.ks) THEN w.held ELSE list_concat(w.held, r.ks) END FROM w JOIN r ON r.n = w.n + 1)
 SELECT id, duplicate FROM w WHERE n > 0"""


@query("c16_keep_first_duplicates", _walk_sql("false", "true"))
def _(f: Frames) -> DataFrame:
    """Exact sequential rule over e-mail, URL and name with company: only rows that are kept register their keys."""
    return I.sequential_duplicates(f.leads, _keys(f))


@query("c17_identity_conflicts", f"WITH {_KEYS}, o AS (SELECT id, k, first_value(id) OVER (PARTITION BY k ORDER BY created_at NULLS LAST, id) AS canonical FROM keys) SELECT k, canonical AS canonical_id, id AS duplicate_id FROM o WHERE id <> canonical")
def _(f: Frames) -> DataFrame:
    keys = _keys(f)
    owners = I.key_owners(keys, "k").select(C("k").alias("_k"), "owner")
    return keys.join(owners, (C("k") == C("_k")) & (C("owner") != C("id"))).select("k", C("owner").alias("canonical_id"), C("id").alias("duplicate_id"))


@query("c18_unseen_events", "SELECT event_id FROM trace_events WHERE event_id % 4 <> 0")
def _(f: Frames) -> DataFrame:
    seen = f.trace_events.where("event_id % 4 = 0").select(C("event_id").alias("seen"))
    return f.trace_events.select("event_id").distinct().join(seen, C("event_id") == C("seen"), "left_anti")


@query("c19_bulk_reconciliation", "SELECT l.id, CASE WHEN l.id % 3 = 0 THEN 'server' ELSE 'local' END AS src, CASE WHEN l.id % 3 = 0 THEN l.revision + 1 ELSE l.revision END AS revision FROM leads l WHERE l.id % 11 <> 5")
def _(f: Frames) -> DataFrame:
    server = f.leads.where("id % 3 = 0").select(C("id").alias("sid"), (C("revision") + 1).alias("srev"))
    gone = f.leads.where("id % 11 = 5").select(C("id").alias("gone"))
    joined = f.leads.join(server, C("id") == C("sid"), "left").join(gone, C("id") == C("gone"), "left_anti")
    return joined.select("id", F.when(C("sid").isNotNull(), "server").otherwise("local").alias("src"), F.coalesce("srev", "revision").alias("revision"))


@query("c20_unseen_queries", "WITH t AS (SELECT id, lower(query || ' ' || id) AS q FROM tasks) SELECT id, q FROM t WHERE q NOT IN (SELECT q FROM t WHERE id % 2 = 0 AND q IS NOT NULL)")
def _(f: Frames) -> DataFrame:
    """Half the tasks are seen, in capitals; the id makes each query its own, so rows stay at every size."""
    text = F.concat("query", F.lit(" "), C("id").cast("string"))
    seen = f.tasks.where("id % 2 = 0").select(F.lower(F.upper(text)).alias("seen"))
    return f.tasks.select("id", F.lower(text).alias("q")).join(seen, C("q") == C("seen"), "left_anti")


@query("c22_first_alias_with_signals", f"""WITH {_SIGNALS}, alias AS (SELECT id, 1 AS pos, company AS name FROM leads UNION ALL SELECT id, 2, 'Northwind ' || location FROM leads UNION ALL SELECT id, 3, 'Beacon & Sons' FROM leads),
  hit AS (SELECT DISTINCT a.id, a.pos, a.name FROM alias a JOIN sig b ON {S.company('a.name')} = {S.company('b.company')} AND {S.company('a.name')} <> '') SELECT id, arg_min(name, pos) AS name FROM hit GROUP BY id""")
def _(f: Frames) -> DataFrame:
    signals = f.leads.where("coalesce(company, '') <> ''").select(T.company_name(C("company")).alias("norm")).distinct()
    aliases = f.leads.select("id", F.posexplode(F.array("company", F.concat(F.lit("Northwind "), C("location")), F.lit("Beacon & Sons"))).alias("pos", "name")).withColumn("_n", T.company_name(C("name")))
    return aliases.join(signals.where("norm <> ''"), C("_n") == C("norm"), "left_semi").groupBy("id").agg(F.min_by("name", "pos").alias("name"))


@query("c21_sequential_bulk_insert", _walk_sql("id % 2 = 1", "id % 2 = 0"))
def _(f: Frames) -> DataFrame:
    """A kept row's keys block later rows of the batch, as the stored leads' keys do: even ids come in, odd ones are stored."""
    keys = _keys(f)
    return I.sequential_duplicates(f.leads.where("id % 2 = 0"), keys.where("id % 2 = 0"), keys.where("id % 2 = 1"))
