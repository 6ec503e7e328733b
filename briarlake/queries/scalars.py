"""Scalar functions over whole domain frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.functions import numeric as N
from briarlake.functions import scoring as K
from briarlake.functions import text as T
from briarlake.queries import sql as S
from briarlake.registry import Frames, query

C = F.col


@query("h01_dedupe_value", f"SELECT id, {S.dedupe('url')} AS url_key, {S.dedupe('website')} AS website_key, {S.dedupe('email')} AS email_key FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", T.dedupe_value(C("url")).alias("url_key"), T.dedupe_value(C("website")).alias("website_key"), T.dedupe_value(C("email")).alias("email_key"))


@query("h02_company_name", f"SELECT id, {S.company('company')} AS company_norm FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", T.company_name(C("company")).alias("company_norm"))


@query("h03_distinctive_words", f"SELECT id, array_to_string(list_sort({S.distinctive('company')}), ',') AS tokens FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", F.array_join(F.array_sort(T.distinctive_words(C("company"))), ",").alias("tokens"))


@query("h04_site_words_and_company_key", rf"""SELECT id, trim(regexp_replace(regexp_replace(lower(coalesce(company, '')), '\b({T.SITE_SUFFIXES})\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS site_words,
  {S.collapse("lower(coalesce(company, ''))")} AS group_key FROM leads""")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", T.site_words(C("company")).alias("site_words"), T.collapse(F.lower(T.text(C("company")))).alias("group_key"))


def site_score(company: F.Column, url: F.Column, body: F.Column) -> F.Column:
    """0 unless a word of the company is in the host; else words in host or text plus three for each in the host."""
    tokens = F.filter(F.split(T.site_words(company), r"\s+"), lambda w: F.length(w) > 2)
    host = F.regexp_replace(F.regexp_replace(T.host_of(url), r"\.[a-z.]+$", ""), "[^a-z0-9]+", " ")
    whole = F.lower(F.concat(host, F.lit(" "), T.text(body)))
    in_host = F.size(F.filter(tokens, lambda w: host.contains(w)))
    return F.when(in_host == 0, 0).otherwise(F.size(F.filter(tokens, lambda w: whole.contains(w))) + in_host * 3)


_SITE = rf"""tokens AS (SELECT id, website, headline, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(company, '')), '\b({T.SITE_SUFFIXES})\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2) AS t,
  regexp_replace(regexp_replace({S.host('website')}, '\.[a-z.]+$', ''), '[^a-z0-9]+', ' ', 'g') AS h FROM leads)"""


@query("h05_company_match_score", f"""WITH {_SITE} SELECT id, CAST(CASE WHEN len(list_filter(t, lambda w: contains(h, w))) = 0 THEN 0
  ELSE len(list_filter(t, lambda w: contains(lower(h || ' ' || coalesce(headline, '')), w))) + 3 * len(list_filter(t, lambda w: contains(h, w))) END AS BIGINT) AS match_score FROM tokens""")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", site_score(C("company"), C("website"), C("headline")).cast("long").alias("match_score"))


@query("h06_overlapping_count", """SELECT doc_id, CAST(len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = 'ere')) AS BIGINT) AS n_ere,
  CAST(len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 4) = 'haha')) AS BIGINT) AS n_haha FROM (SELECT doc_id, lower(text) AS text FROM documents)""")
def _(f: Frames) -> DataFrame:
    low = F.lower(C("text"))
    return f.documents.select("doc_id", T.overlapping_count(low, "ere").cast("long").alias("n_ere"), T.overlapping_count(low, "haha").cast("long").alias("n_haha"))


_RAW = "string_split(coalesce(headline, '') || ',' || title || ',' || coalesce(company, '') || ',hiring,a,lead generation', ',')"
_TOKEN = r"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s-]', '', 'g'), '\s+', ' ', 'g'))"


def raw_signals() -> F.Column:
    return F.split(F.concat(T.text(C("headline")), F.lit(","), C("title"), F.lit(","), T.text(C("company")), F.lit(",hiring,a,lead generation")), ",")


@query("h07_dynamic_signals", f"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform({_RAW}, lambda r: {_TOKEN.format(x='r')}),
  lambda t: length(t) BETWEEN 2 AND 50 AND len(string_split(t, ' ')) <= 3 AND t NOT IN ({S.quoted(T.UNIVERSAL_SIGNALS)})))), '|') AS signals FROM leads""")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", F.array_join(F.array_sort(T.dynamic_signals(raw_signals())), "|").alias("signals"))


@query("h08_title_words", f"SELECT id, {S.words('title')} AS words FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", T.title_words(C("title")).alias("words"))


def labels_sql(x: str) -> str:
    arms = ", ".join(f"CASE WHEN regexp_matches({x}, '{p}')" + (f" AND NOT regexp_matches({x}, '{K.PRINCIPAL_EXCEPT}')" if label == "principal" else "") + f" THEN '{label}' END" for label, p in K.AUTHORITY)
    return f"list_distinct(list_filter([{arms}], lambda k: k IS NOT NULL))"


def weak_sql(x: str) -> str:
    arms = ", ".join(f"CASE WHEN regexp_matches({x}, '{p}')" + (f" AND NOT regexp_matches({x}, '{K.QUALIFIED}')" if label in ("consultant", "specialist") else "") + f" THEN '{label}' END" for label, p in K.WEAK)
    return f"list_filter([{arms}], lambda k: k IS NOT NULL)"


@query("h09_title_labels", f"WITH w AS (SELECT id, {S.words('title')} AS x FROM leads) SELECT id, array_to_string(list_sort({labels_sql('x')}), ',') AS authority, array_to_string(list_sort({weak_sql('x')}), ',') AS weak FROM w")
def _(f: Frames) -> DataFrame:
    words = T.title_words(C("title"))
    return f.leads.select("id", F.array_join(F.array_sort(K.authority_labels(words)), ",").alias("authority"), F.array_join(F.array_sort(K.weak_labels(words)), ",").alias("weak"))


@query("h10_sentences", r"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sentences, CAST(max(length(s)) AS BIGINT) AS longest FROM (SELECT DISTINCT doc_id, substr(trim(regexp_replace(s, '\s+', ' ', 'g')), 1, 520) AS s
  FROM (SELECT doc_id, unnest(string_split_regex(replace(text, chr(13), ''), '\n+|[.!?;]+\s+')) AS s FROM documents)) WHERE s <> '' GROUP BY doc_id""")
def _(f: Frames) -> DataFrame:
    found = T.sentences(C("text"))
    return f.documents.where(F.size(found) > 0).select("doc_id", F.size(found).cast("long").alias("n_sentences"), F.array_max(F.transform(found, lambda s: F.length(s))).cast("long").alias("longest"))


@query("h11_crop", rf"""WITH w AS (SELECT doc_id, substr({S.collapse('text')}, 1, 2000) AS t FROM documents), p AS (SELECT *, strpos(lower(t), 'tion') - 1 AS pos FROM w),
  q AS (SELECT *, greatest(0, pos - 60) AS a, least(length(t), greatest(0, pos - 60) + 198) AS b FROM p)
  SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN pos < 0 THEN trim(substr(t, 1, 197)) || '...' ELSE (CASE WHEN a > 0 THEN '...' ELSE '' END) || trim(substr(t, a + 1, b - a)) || (CASE WHEN b < length(t) THEN '...' ELSE '' END) END AS cropped FROM q""")
def _(f: Frames) -> DataFrame:
    return f.documents.select("doc_id", T.crop(C("text"), 200, "tion").alias("cropped"))


@query("h12_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n_tokens FROM documents")
def _(f: Frames) -> DataFrame:
    return f.documents.select("doc_id", N.token_estimate(C("text")).alias("n_tokens"))


@query("h13_output_budget", """SELECT event_id, CAST(CASE WHEN 7200 - input_tokens * 9 - 400 < 800 THEN greatest(1, least(2000, 7200 - input_tokens * 9 - 400)) ELSE least(2000, 7200 - input_tokens * 9 - 400) END AS BIGINT) AS output_tokens_max FROM trace_events""")
def _(f: Frames) -> DataFrame:
    return f.trace_events.select("event_id", N.output_budget(F.lit(2000), C("input_tokens") * 9, 7200).cast("long").alias("output_tokens_max"))


_QUERY = r"trim(regexp_replace(regexp_replace(regexp_replace(query, '(?i)site:linkedin\.com/in/', '', 'g'), '(?i)linkedin', '', 'g'), '\s+', ' ', 'g'))"


@query("h14_query_text", f"SELECT id, {_QUERY} AS clean_query, CASE WHEN lane = 'signal' THEN {_QUERY} ELSE 'site:linkedin.com/in/ ' || {_QUERY} END AS search_query FROM tasks")
def _(f: Frames) -> DataFrame:
    clean = T.query_text(C("query"))
    return f.tasks.select("id", clean.alias("clean_query"), F.when(C("lane") == "signal", clean).otherwise(F.concat(F.lit("site:linkedin.com/in/ "), clean)).alias("search_query"))


@query("h15_telemetry_text", r"""WITH s AS (SELECT event_id, regexp_replace(repeat(message || ' ', 12), '(?i)Bearer\s+[A-Za-z0-9._-]+', 'Bearer [REDACTED]', 'g') AS m FROM trace_events)
  SELECT event_id, CASE WHEN length(m) > 300 THEN substr(m, 1, 300) || '... [truncated]' ELSE m END AS safe FROM s""")
def _(f: Frames) -> DataFrame:
    return f.trace_events.select("event_id", T.telemetry_text(F.repeat(F.concat(C("message"), F.lit(" ")), F.lit(12))).alias("safe"))


@query("h16_sanitized_metadata", """SELECT event_id, CAST(length(message) AS BIGINT) AS prompt_length, '[redacted]' AS token_count, operation FROM trace_events""")
def _(f: Frames) -> DataFrame:
    """Sensitive keys of a metadata map give way to their length or a mark."""
    pairs = F.create_map(F.lit("prompt"), C("message"), F.lit("tokenCount"), C("input_tokens").cast("string"), F.lit("operation"), C("operation"))
    secret = lambda k: F.lower(k).rlike("prompt|raw|evidence|api[_-]?key|token|secret")
    safe = F.transform_values(pairs, lambda k, v: F.when(secret(k) & (k != "tokenCount"), F.length(v).cast("string")).when(secret(k), F.lit("[redacted]")).otherwise(v))
    return f.trace_events.select("event_id", safe["prompt"].cast("long").alias("prompt_length"), safe["tokenCount"].alias("token_count"), safe["operation"].alias("operation"))


_HOSTED = f"CASE WHEN {S.host('url')} IN ({S.quoted(T.HOSTED_JOB_HOSTS)}) THEN regexp_extract(coalesce(url, ''), '^[a-zA-Z]+://[^/?#]+/+([^/?#]+)', 1) ELSE '' END"
_DHOST = f"CASE WHEN regexp_matches(coalesce(url, ''), '^[a-zA-Z]+://') THEN {S.host('url')} ELSE '' END"
_DLABEL = rf"""CASE WHEN len(string_split({_DHOST}, '.')) >= 2 AND NOT {S.under(f'({_DHOST})', T.JOB_DOMAINS)} THEN regexp_replace(coalesce(CASE WHEN regexp_matches({_DHOST}, '(^|\.)(co|com|org|net|gov|ac)\.[a-z]{{2}}$')
  THEN CASE WHEN len(string_split({_DHOST}, '.')) >= 3 THEN string_split({_DHOST}, '.')[-3] END ELSE string_split({_DHOST}, '.')[-2] END, ''), '[-_]+', ' ', 'g') ELSE '' END"""


@query("h19_company_hint", rf"""WITH parts AS (SELECT seq, raw_company, url, title, content, string_split_regex(coalesce(title, ''), '\s+[|:–—-]\s+') AS p FROM observations),
 tried AS (SELECT seq, coalesce(raw_company, '') AS a, CASE WHEN len(p) > 1 THEN p[-1] ELSE '' END AS b, regexp_extract(coalesce(title, '') || chr(10) || substr(content, 1, 240), '(?i)(?:^|\n)([A-Z][A-Za-z0-9&.'' -]{{2,60}})\s+(?:is\s+)?(?:hiring|looking for|seeking)\b', 1) AS c, {_HOSTED} AS d, {_DLABEL} AS e FROM parts)
 SELECT seq, CASE {' '.join(f"WHEN {S.plausible(x)} THEN {S.hint(x)}" for x in 'abcde')} ELSE '' END AS company_hint FROM tried""")
def _(f: Frames) -> DataFrame:
    return f.observations.select("seq", T.company_hint(C("raw_company"), C("title"), C("content"), C("url")).alias("company_hint"))


@query("h20_profile_company_hint", rf"""WITH tried AS (SELECT seq, coalesce(raw_company, '') AS a, regexp_extract(coalesce(headline, '') || chr(10) || substr(content, 1, 800), '(?:^|[^A-Za-z0-9_])(?:at|@)\s+([A-Z][A-Za-z0-9&.'' -]{{2,80}}?)\s*(?:\||\n|,|–|—|$)', 1) AS b,
  coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda x: {S.hint("regexp_replace(x, '^#+\\s*', '')")}), lambda x: x <> '')[2], '') AS c
  FROM (SELECT o.seq, o.raw_company, l.headline, o.content FROM observations o LEFT JOIN leads l ON o.seq = l.id))
 SELECT seq, CASE {' '.join(f"WHEN {S.plausible(x)} THEN {S.hint(x) if x < 'c' else x}" for x in 'abc')} ELSE '' END AS company_hint FROM tried""")
def _(f: Frames) -> DataFrame:
    joined = f.observations.join(f.leads.select("id", "headline"), C("seq") == C("id"), "left")
    return T.profile_company_hint(joined, C("raw_company"), C("headline"), C("content")).select("seq", "company_hint")


@query("h22_post_search_query", f"""SELECT id, CASE WHEN ({S.handle('url')}) <> '' THEN '(site:linkedin.com/posts OR site:linkedin.com/pulse) "' || ({S.handle('url')}) || '"'
  WHEN trim(full_name) <> '' AND trim(coalesce(company, '')) <> '' THEN '"' || trim(full_name) || '" "' || trim(company) || '" (site:linkedin.com/posts OR site:linkedin.com/pulse)'
  WHEN trim(full_name) <> '' THEN '"' || trim(full_name) || '" (site:linkedin.com/posts OR site:linkedin.com/pulse)' ELSE '' END AS post_query FROM leads""")
def _(f: Frames) -> DataFrame:
    places, name, firm, handle = "(site:linkedin.com/posts OR site:linkedin.com/pulse)", F.trim(C("full_name")), F.trim(T.text(C("company"))), T.profile_handle(C("url"))
    found = F.when(handle != "", F.concat(F.lit(f'{places} "'), handle, F.lit('"'))).when((name != "") & (firm != ""), F.concat(F.lit('"'), name, F.lit('" "'), firm, F.lit(f'" {places}')))
    return f.leads.select("id", found.when(name != "", F.concat(F.lit('"'), name, F.lit(f'" {places}'))).otherwise("").alias("post_query"))


@query("h23_name_split", "SELECT id, coalesce(p[1], '') AS first_name, array_to_string(p[2:], ' ') AS last_name FROM (SELECT id, string_split_regex(trim(replace(full_name, '#', ' ')), '\\s+') AS p FROM leads)")
def _(f: Frames) -> DataFrame:
    parts = F.split(F.trim(F.replace(C("full_name"), F.lit("#"), F.lit(" "))), r"\s+")
    return f.leads.select("id", T.text(F.get(parts, F.lit(0))).alias("first_name"), F.array_join(F.slice(parts, 2, 100), " ").alias("last_name"))


@query("h24_score_label", "SELECT id, CASE WHEN predictive >= 80 THEN 'Excellent' WHEN predictive >= 60 THEN 'Good' WHEN predictive >= 40 THEN 'Fair' WHEN predictive > 0 THEN 'Low' ELSE 'Unrated' END AS label FROM leads")
def _(f: Frames) -> DataFrame:
    p = C("predictive")
    return f.leads.select("id", F.when(p >= 80, "Excellent").when(p >= 60, "Good").when(p >= 40, "Fair").when(p > 0, "Low").otherwise("Unrated").alias("label"))


@query("h25_profile_handle", f"SELECT id, {S.handle('url')} AS handle FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", T.profile_handle(C("url")).alias("handle"))


@query("h26_profile_identity", f"SELECT id, {S.identity('url')} AS identity FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", T.profile_identity(C("url")).alias("identity"))


@query("h27_profile_url", f"SELECT id, {S.profile_url('url')} AS profile_url FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", T.profile_url(C("url")).alias("profile_url"))


@query("h28_observation_identity", f"SELECT seq, {S.observation('url', 'title', 'content')} AS identity FROM observations")
def _(f: Frames) -> DataFrame:
    return f.observations.select("seq", T.observation_identity(C("url"), C("title"), C("content")).alias("identity"))


@query("h29_dedupe_keys", f"SELECT id, unnest({S.keys('email', 'url', 'full_name', 'company', 'website')}) AS dedupe_key FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", F.explode(T.dedupe_keys(C("email"), C("url"), C("full_name"), C("company"), C("website"))).alias("dedupe_key"))


@query("h30_profile_domain", f"SELECT id, {S.domain('website', 'email')} AS domain FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", T.profile_domain(C("website"), C("email")).alias("domain"))


@query("h31_stable_id", f"""SELECT id, CASE WHEN ({S.handle('url')}) <> '' THEN ({S.handle('url')}) WHEN coalesce(url, '') <> '' THEN lower(url) WHEN trim(full_name) <> '' AND coalesce(company, '') <> '' THEN lower(trim(full_name) || '@' || company)
  WHEN trim(full_name) <> '' THEN lower(trim(full_name)) ELSE substr(sha256(CAST(id AS VARCHAR)), 1, 16) END AS stable_id FROM leads""")
def _(f: Frames) -> DataFrame:
    """The reference's random last resort is a hash of the row's id here."""
    handle, name = T.profile_handle(C("url")), F.trim(C("full_name"))
    found = F.when(handle != "", handle).when(T.text(C("url")) != "", F.lower("url")).when((name != "") & (T.text(C("company")) != ""), F.lower(F.concat(name, F.lit("@"), C("company")))).when(name != "", F.lower(name))
    return f.leads.select("id", found.otherwise(F.substring(F.sha2(C("id").cast("string"), 256), 1, 16)).alias("stable_id"))


_MAIL = r"lower(regexp_replace(regexp_replace(trim(email), '^(?i:mailto):', ''), '[),.;:]+$', ''))"
_EMAIL_SQL = T.EMAIL.replace("'", "''")


@query("h32_public_email", rf"""SELECT id, CASE WHEN regexp_matches({_MAIL}, '^{_EMAIL_SQL}$') AND split_part({_MAIL}, '@', 2) NOT IN ({S.quoted(T.INVALID_EMAIL_DOMAINS)}) AND NOT regexp_matches(split_part({_MAIL}, '@', 1), '^(no-?reply|do-?not-?reply|mailer-daemon)$')
  AND NOT regexp_matches(split_part({_MAIL}, '@', 2), '\.(png|jpe?g|gif|svg|webp|css|js)$') THEN {_MAIL} END AS public_email FROM leads""")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", T.public_email(C("email")).alias("public_email"))


@query("h33_domain_label", f"SELECT seq, {S.hint(_HOSTED)} AS hosted, {S.hint(_DLABEL)} AS label FROM observations")
def _(f: Frames) -> DataFrame:
    return f.observations.select("seq", T.hosted_job_company(C("url")).alias("hosted"), T.domain_company(C("url")).alias("label"))


@query("h34_url_hygiene", f"SELECT seq, {S.host('url')} AS host, CASE WHEN regexp_matches(lower(trim(coalesce(lang, ''))), '^[a-z]{{2}}$') THEN lower(trim(lang)) ELSE '' END AS geo FROM observations")
def _(f: Frames) -> DataFrame:
    geo = F.lower(F.trim(T.text(C("lang"))))
    return f.observations.select("seq", T.host_of(C("url")).alias("host"), F.when(geo.rlike("^[a-z]{2}$"), geo).otherwise("").alias("geo"))


def ages() -> F.Column:
    """Synthetic snippets of the test leads."""
    n = C("id") % 30
    first = F.when(C("id") % 5 == 0, F.concat(n.cast("string"), F.lit(" days ago"))).when(C("id") % 5 == 1, F.concat(n.cast("string"), F.lit("weeks ago"))).when(C("id") % 5 == 2, F.lit("Posted 2 months ago"))
    return F.array(first, F.when(C("id") % 7 == 0, F.lit("3 hrs ago")).when(C("id") % 7 == 1, F.lit("1 year ago")).otherwise(F.lit("no date")))


_AGES = "CASE WHEN id % 7 = 0 THEN 0 ELSE coalesce(least(CASE id % 5 WHEN 0 THEN id % 30 WHEN 1 THEN id % 30 * 7 WHEN 2 THEN 60 END, CASE WHEN id % 7 = 1 THEN 365 END), 0) END"


@query("h35_freshness_days", f"SELECT id, CAST({_AGES} AS BIGINT) AS age_days FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", N.freshness_days(ages()).cast("long").alias("age_days"))


@query("h36_freshness_multiplier", f"SELECT id, {S.fixed('least(greatest(exp(-0.02::DOUBLE * age), 0.2::DOUBLE), 1.0::DOUBLE)')} AS multiplier FROM (SELECT id, {_AGES} AS age FROM leads)")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", N.freshness(N.freshness_days(ages())).alias("multiplier"))


@query("h37_expiry_and_age", "SELECT cache_id, created_at + INTERVAL '7' DAY AS expires_at, date_diff('day', CAST(created_at AS DATE), DATE '2000-01-01') AS age_days FROM cache")
def _(f: Frames) -> DataFrame:
    return f.cache.select("cache_id", (C("created_at") + F.expr("INTERVAL '7' DAY")).alias("expires_at"), F.datediff(F.lit("2000-01-01").cast("date"), C("created_at").cast("date")).cast("long").alias("age_days"))


@query("h38_usage_period", "SELECT event_id, strftime(ts, '%Y-%m') AS period FROM trace_events")
def _(f: Frames) -> DataFrame:
    return f.trace_events.select("event_id", F.date_format("ts", "yyyy-MM").alias("period"))


@query("h39_signal_fingerprint", f"""WITH t AS (SELECT id, list_sort(list_distinct(list_filter(list_transform(CASE WHEN id % 9 = 0 THEN ['', '!!'] ELSE {_RAW} END, lambda r: {_TOKEN.format(x='r')}), lambda t: t <> ''))) AS s FROM leads)
  SELECT id, CASE WHEN len(s) = 0 THEN 'fallback' ELSE substr(sha256(array_to_string(s, '|')), 1, 16) END AS fingerprint FROM t""")
def _(f: Frames) -> DataFrame:
    raw = F.when(C("id") % 9 == 0, F.array(F.lit(""), F.lit("!!"))).otherwise(raw_signals())
    return f.leads.select("id", T.signal_fingerprint(raw).alias("fingerprint"))


@query("h40_cache_id", "SELECT cache_id, sha256(concat_ws('|', url, username, person, company)) AS key_hash, substr(sha256(username), 1, 8) AS short_hash FROM cache")
def _(f: Frames) -> DataFrame:
    return f.cache.select("cache_id", F.sha2(F.concat_ws("|", "url", "username", "person", "company"), 256).alias("key_hash"), F.substring(F.sha2("username", 256), 1, 8).alias("short_hash"))


@query("h41_clamps", f"SELECT id, {S.score_or('fit', 5)} AS fit_score, {S.clamp('base_score', 0, 10)} AS bounded, CASE WHEN base_score > 0 AND base_score <= 1 THEN base_score * 10 ELSE base_score END AS ten FROM candidates")
def _(f: Frames) -> DataFrame:
    return f.candidates.select("id", N.score_or(C("fit"), 5).alias("fit_score"), N.clamp(C("base_score"), 0, 10).alias("bounded"), N.to_ten(C("base_score")).alias("ten"))


@query("h42_llm_cost", "SELECT event_id, CAST((CAST(input_tokens AS DECIMAL(12,0)) * 2.5 + CAST(output_tokens AS DECIMAL(12,0)) * 10) * 0.000001 AS DECIMAL(18,6)) AS cost FROM trace_events")
def _(f: Frames) -> DataFrame:
    return f.trace_events.select("event_id", N.llm_cost(C("input_tokens"), C("output_tokens"), "2.5", "10").alias("cost"))


@query("h43_quality_and_source_scores", "SELECT id, CASE quality WHEN 'good' THEN 9.0::DOUBLE WHEN 'partial' THEN 7 ELSE 4 END AS evidence_score, CASE WHEN provider IN ('brightdata', 'manual') THEN 8.0::DOUBLE WHEN provider IN ('cache', 'import') THEN 7 ELSE 6 END AS source_score FROM candidates")
def _(f: Frames) -> DataFrame:
    return f.candidates.select("id", K.evidence_score(C("quality")).alias("evidence_score"), K.source_score(C("provider")).alias("source_score"))


_WORDS = "lower(title || ' ' || coalesce(headline, ''))"
_LEVEL = "lower(coalesce(seniority, ''))"


@query("h44_lead_score", rf"""SELECT id, CAST(least(100, 25 + CASE WHEN regexp_matches({_WORDS}, '\b(founder|owner|chief|c[eo]o|president|partner)\b') OR regexp_matches({_LEVEL}, 'c-suite|founder') THEN 35
  WHEN regexp_matches({_WORDS}, '\b(vp|vice president|head of|director)\b') OR regexp_matches({_LEVEL}, 'vp|head|director') THEN 25 WHEN regexp_matches({_WORDS}, '\b(manager|lead)\b') OR regexp_matches({_LEVEL}, 'manager') THEN 12 ELSE 0 END
  + CASE WHEN coalesce(company_size, '') IN ('', 'UNKNOWN') THEN 0 ELSE 8 END + least(n_pain, 4) * 5 + floor(least(pain_score, 10) * 2 + 0.5)) AS BIGINT) AS lead_score FROM leads""")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", K.lead_score(C("title"), C("headline"), C("seniority"), C("company_size"), C("n_pain"), C("pain_score")).cast("long").alias("lead_score"))


@query("h45_predictive_score", "SELECT id, CAST(CASE WHEN composite * 10 > 0 THEN least(96, floor(composite * 10 * 0.96::DOUBLE + 0.5)) ELSE 0 END AS BIGINT) AS with_account, CAST(CASE WHEN composite * 10 > 0 THEN least(96, floor(composite * 10 * 0.9::DOUBLE + 0.5)) ELSE 0 END AS BIGINT) AS without_account FROM leads")
def _(f: Frames) -> DataFrame:
    ten = C("composite") * 10
    return f.leads.select("id", K.predictive_score(ten, 0.96).cast("long").alias("with_account"), K.predictive_score(ten, 0.9).cast("long").alias("without_account"))


@query("h46_distinct_capped", "SELECT conv_id, CAST(least(20, count(DISTINCT trim(text))) AS BIGINT) AS n_kept FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def _(f: Frames) -> DataFrame:
    """Arrays stay bounded: the distinct set is counted, then capped."""
    return f.conversations.where(F.trim("text") != "").groupBy("conv_id").agg(F.least(F.lit(20), F.count_distinct(F.trim("text"))).alias("n_kept"))


@query("h48_safe_json", "SELECT session_id, CAST(json_extract_string(checkpoint_json, '$.round') AS BIGINT) AS round, coalesce(CAST(json_extract_string(checkpoint_json, '$.accepted') AS BIGINT), 0) AS accepted FROM sessions")
def _(f: Frames) -> DataFrame:
    parsed = F.from_json("checkpoint_json", "round long, accepted long")
    return f.sessions.select("session_id", parsed["round"].alias("round"), F.coalesce(parsed["accepted"], F.lit(0)).alias("accepted"))


@query("h49_effective_score", "SELECT id, CASE WHEN base_score > 0 THEN base_score ELSE greatest(fit, coalesce(timing, 0)) END AS effective FROM candidates")
def _(f: Frames) -> DataFrame:
    return f.candidates.select("id", F.when(C("base_score") > 0, C("base_score")).otherwise(F.greatest(C("fit"), F.coalesce("timing", F.lit(0.0)))).alias("effective"))


@query("h50_rejection_reason", "SELECT event_id, CASE WHEN status = 'error' THEN 'brightdata_login_wall' ELSE 'brightdata_low_quality' END AS reason FROM trace_events WHERE status IN ('error', 'skipped')")
def _(f: Frames) -> DataFrame:
    cause = F.when(C("status") == "error", "blocked_or_login_wall").otherwise("empty_or_too_short")
    return f.trace_events.where(C("status").isin("error", "skipped")).select("event_id", F.when(cause == "blocked_or_login_wall", "brightdata_login_wall").otherwise("brightdata_low_quality").alias("reason"))


@query("h51_headline_company", r"""SELECT id, CASE WHEN at_co <> '' THEN substr(at_co, 1, 100) WHEN of_co <> '' THEN substr(of_co, 1, 100) END AS company_from_headline FROM (SELECT id, trim(regexp_extract(coalesce(headline, ''), '(?i)\bat\s+([^|,;]+)', 1)) AS at_co,
  trim(regexp_extract(coalesce(headline, ''), '(?i)(?:founder|owner|ceo|co-founder|partner)\s*(?:&\s*\w+)?\s*(?:of|at)\s+([^|,;]+)', 1)) AS of_co FROM leads)""")
def _(f: Frames) -> DataFrame:
    line = T.text(C("headline"))
    at, of = F.trim(F.regexp_extract(line, r"(?i)\bat\s+([^|,;]+)", 1)), F.trim(F.regexp_extract(line, r"(?i)(?:founder|owner|ceo|co-founder|partner)\s*(?:&\s*\w+)?\s*(?:of|at)\s+([^|,;]+)", 1))
    return f.leads.select("id", F.when(at != "", F.substring(at, 1, 100)).when(of != "", F.substring(of, 1, 100)).alias("company_from_headline"))


@query("h53_evidence_label", "SELECT seq, trim(regexp_extract('LINK: ' || coalesce(url, '') || chr(10) || 'NAME: n' || seq || chr(10) || 'TITLE: ' || title, '(?m)^NAME: (.*)$', 1)) AS name_label FROM observations")
def _(f: Frames) -> DataFrame:
    block = F.concat(F.lit("LINK: "), T.text(C("url")), F.lit("\nNAME: n"), C("seq").cast("string"), F.lit("\nTITLE: "), C("title"))
    return f.observations.select("seq", T.evidence_label(block, "NAME").alias("name_label"))


@query("h54_search_evidence", f"SELECT seq, 'LINK: ' || coalesce(url, '') || chr(10) || 'TITLE: ' || CASE WHEN title = '' THEN 'Untitled result' ELSE title END || chr(10) || '[TAVILY SNIPPET]' || chr(10) || substr({S.collapse('content')}, 1, 900) AS block FROM observations")
def _(f: Frames) -> DataFrame:
    title = F.when(C("title") == "", F.lit("Untitled result")).otherwise(C("title"))
    return f.observations.select("seq", F.concat(F.lit("LINK: "), T.text(C("url")), F.lit("\nTITLE: "), title, F.lit("\n[TAVILY SNIPPET]\n"), F.substring(T.collapse(C("content")), 1, 900)).alias("block"))


@query("h55_llm_usage", "SELECT event_id, coalesce(total_tokens, input_tokens + output_tokens) AS tokens, total_tokens IS NULL AS estimated, status = 'error' OR fallback_used AS fallback FROM trace_events WHERE provider = 'llm'")
def _(f: Frames) -> DataFrame:
    return f.trace_events.where("provider = 'llm'").select("event_id", F.coalesce("total_tokens", C("input_tokens") + C("output_tokens")).alias("tokens"), C("total_tokens").isNull().alias("estimated"), ((C("status") == "error") | C("fallback_used")).alias("fallback"))


# Fixed values.
NEXT_STAGE = {"SCRAPED": "ENRICHED", "ENRICHED": "SEQUENCE ACTIVE", "SEQUENCE ACTIVE": "REPLIED", "REPLIED": "MEETING BOOKED", "MEETING BOOKED": "NEGOTIATING", "NEGOTIATING": "CONVERTED", "NURTURE": "SEQUENCE ACTIVE"}
PREVIOUS_STAGE = {b: a for a, b in NEXT_STAGE.items() if a != "NURTURE"}


def _case(c: str, pairs: dict[str, str]) -> str:
    return f"CASE {c} {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items())} END"


@query("h56_stage_transitions", f"SELECT id, {_case('stage', NEXT_STAGE)} AS next_stage, {_case('stage', PREVIOUS_STAGE)} AS previous_stage, 'pipeline-stage-' || regexp_replace(lower(stage), '[^a-z0-9]+', '-', 'g') AS dom_id FROM leads")
def _(f: Frames) -> DataFrame:
    literal = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    return f.leads.select("id", F.try_element_at(literal(NEXT_STAGE), C("stage")).alias("next_stage"), F.try_element_at(literal(PREVIOUS_STAGE), C("stage")).alias("previous_stage"), F.concat(F.lit("pipeline-stage-"), F.regexp_replace(F.lower("stage"), "[^a-z0-9]+", "-")).alias("dom_id"))


@query("h57_defaults", "SELECT id, coalesce(nullif(review_status, ''), 'UNREVIEWED') AS review, coalesce(nullif(next_action, ''), 'NONE') AS action FROM leads")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", F.coalesce(F.nullif("review_status", F.lit("")), F.lit("UNREVIEWED")).alias("review"), F.coalesce(F.nullif("next_action", F.lit("")), F.lit("NONE")).alias("action"))
