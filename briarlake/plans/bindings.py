"""Domain frames over the driver tables, in SQL that Spark and DuckDB both run.

The test tables hold no lead data. Each frame derives what an operator needs
from keys and columns by fixed arithmetic; `{name}` stands for a table or frame.
"""

from __future__ import annotations

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def pick(key: str, *values: str | None) -> str:
    """CASE over key modulo the number of values."""
    arms = " ".join(f"WHEN {k} THEN {'NULL' if v is None else v}" for k, v in enumerate(values))
    return f"CASE {key} % {len(values)} {arms} END"


_STAGES = ("SCRAPED", "ENRICHED", "SEQUENCE ACTIVE", "REPLIED", "MEETING BOOKED", "NEGOTIATING", "CONVERTED", "LOST", "NURTURE")
_TITLES = ("Founder & CEO", "Practice Owner", "VP of Sales", "Head of Growth", "Managing Director", "Principal Engineer", "Executive Assistant to the CEO", "Marketing Coordinator", "Senior Consultant", "Director, Operations", "Managing Partner", "Student")
_quoted = lambda values: [f"'{v}'" for v in values]

FRAMES: dict[str, str] = {
    "leads": f"""
SELECT c.c_custkey AS id, c.c_custkey % 5 AS revision,
       CASE WHEN c.c_custkey % 41 = 0 THEN '  ' ELSE c.c_name END AS full_name,
       {pick("c.c_custkey", "n.n_name || ' Labs, LLC'", "n.n_name || ' Labs'", "'Beacon & Sons, Inc.'", "''", "'Northwind ' || n.n_name", "'TechFlow AI, LLC'", "n.n_name || ' Holdings Group'", None)} AS company,
       {pick("c.c_custkey", *_quoted(_TITLES))} AS title,
       {pick("c.c_custkey", "'CEO at Beacon & Sons | speaker'", "'Founder of Northwind Europe, advisor'", "''", "'Helping teams grow with automation, hiring now'", None)} AS headline,
       c.c_mktsegment AS industry, n.n_name AS location, r.r_name AS region,
       {pick("c.c_custkey", *_quoted(_STAGES))} AS stage,
       {pick("c.c_custkey", "'UNREVIEWED'", "'KEEP'", "'MAYBE'", "'REJECT'", "'bogus'", None)} AS review_status,
       {pick("c.c_custkey", "'NONE'", "'OPEN_LINKEDIN'", "'RESEARCH'", "'CONNECT'", "'MESSAGE'", "'?'", "''")} AS next_action,
       {pick("c.c_custkey", "'User' || c.c_custkey || '@Mail.Org'", "''", None, "'no-reply@corp.io'", "'mailto:p' || c.c_custkey % 50 || '@beacon.co.uk.'", "'bad address'", "'x@example.com'")} AS email,
       {pick("c.c_custkey", "'https://www.Beacon.co.uk/team/'", None, "'http://techflow.ai'", "''", "'northwind.com/about'")} AS website,
       {pick("c.c_custkey", "'https://www.linkedin.com/in/User-' || c.c_custkey % 400 || '/'", "'linkedin.com/in/user-' || c.c_custkey % 400", "'https://example.com/in/p' || c.c_custkey", "'bare-handle'", None, "'https://uk.linkedin.com/company/acme'", "'HTTP://LinkedIn.com/in/user-' || c.c_custkey % 400 || '?x=1'")} AS url,
       CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE CAST(c.c_custkey % 101 AS DOUBLE) END AS qualification,
       CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE CAST(c.c_custkey % 97 AS DOUBLE) END AS predictive,
       CASE WHEN c.c_custkey % 10 = 3 THEN NULL ELSE CAST(c.c_custkey % 21 AS DOUBLE) / 2 END AS composite,
       {pick("c.c_custkey", "'C-Suite'", "'VP level'", "'Manager'", "''", None)} AS seniority,
       {pick("c.c_custkey", "'11-50'", "'UNKNOWN'", "''", None)} AS company_size,
       c.c_custkey % 7 AS n_pain, CAST(c.c_custkey % 13 AS DOUBLE) AS pain_score,
       o.first_at AS created_at, o.last_at AS updated_at, coalesce(o.n_orders, 0) AS n_orders
FROM {{customer}} c JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, count(*) AS n_orders FROM {{orders}} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
""",
    "candidates": f"""
SELECT id, full_name, company, title, headline, location, email, url,
       CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 12 AS DOUBLE) END AS authority, id % 11 = 0 AS ignored_title,
       CAST(id * 7 % 15 AS DOUBLE) - 1 AS fit, CAST(id * 3 % 12 AS DOUBLE) AS intent, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 13 AS DOUBLE) END AS timing,
       {pick("id", "'good'", "'partial'", "'weak'", "'bad'")} AS quality,
       {pick("id", "'brightdata'", "'tavily'", "'cache'", "'manual'", "'import'")} AS provider,
       {pick("id", "'auto_accept'", "'accept'", "'reject'", "'auto_reject'", None, None, None, None)} AS verdict,
       CASE WHEN id % 7 < 3 THEN NULL ELSE CAST(id % 11 AS DOUBLE) END AS identity_confidence,
       CASE WHEN id % 9 < 5 THEN NULL ELSE CAST(id % 10 AS DOUBLE) END AS employment_confidence,
       id % 4 <> 1 AS has_intent, id % 4 AS n_dynamic, id % 6 AS n_universal, id % 5 AS pages, id % 40 AS cache_age, CAST(id % 10 AS DOUBLE) / 10 AS tfidf,
       CASE WHEN id % 3 = 1 THEN CAST(id % 90 AS DOUBLE) ELSE NULL END AS account_pain,
       {pick("id", None, "'enriched_none'", "'enriched'", None, "'pending'")} AS post_state,
       {pick("id", "'strong'", "'moderate'", "'weak'", "'none'", None, "'strong'", "'moderate'")} AS post_quality,
       CAST(id % 12 AS DOUBLE) / 10 AS post_confidence, id * 5 % 120 AS post_age,
       CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 11 AS DOUBLE) END AS coverage, CASE WHEN id % 8 = 0 THEN NULL ELSE CAST(id % 10 AS DOUBLE) END AS corroboration,
       CASE WHEN id % 2 = 0 THEN CAST(id % 10 AS DOUBLE) / 10 ELSE CAST(id % 10 AS DOUBLE) END AS base_score, CAST(id % 20 AS DOUBLE) / 2 AS bm25, id % 10 = 0 AS skyline,
       id % 9 AS n_snippets, id % 5 AS source_count, CASE WHEN id % 4 = 2 THEN CAST(id % 10 AS DOUBLE) ELSE NULL END AS prior_score
FROM {{leads}}
""",
    "observations": f"""
SELECT doc_id AS seq, {pick("doc_id", "'Acme Labs | TechFlow AI'", "'n8n Developer - Northwind Europe'", "'Untitled'", "''", "'Beacon is hiring engineers'", "'12 jobs at Acme | careers'", "'Jane Roe: Founder'")} AS title,
       {pick("doc_id", "'https://www.linkedin.com/in/u' || doc_id % 60 || '/'", "'linkedin.com/in/U' || doc_id % 60", "'https://jobs.lever.co/acme-' || doc_id % 30 || '/123'", "'http://www.north-wind' || doc_id % 30 || '.co.uk/x/'", "''", "'https://indeed.com/viewjob'", "'https://News.Site' || doc_id % 40 || '.com/a'", None)} AS url,
       text AS content, source AS query, lang, {pick("doc_id", "'tavily'", "'brightdata'", "'tavily'")} AS provider,
       {pick("doc_id", "'person'", "'signal'", "'account'", "''", None)} AS lane, doc_id % 4 AS round,
       {pick("doc_id", "'find_buying_signal'", "'find_decision_makers'", None)} AS intent,
       {pick("doc_id", "'Raw Co ' || doc_id % 9", None, "'home'", "''")} AS raw_company
FROM {{documents}}
""",
    "trace_events": f"""
SELECT event_id, user_id AS session_id, ts, event_type AS operation,
       {pick("user_id", "'planning'", "'retrieval'", "'extraction'", "'filtering'", "'persistence'")} AS phase,
       {pick("event_id", "'started'", "'success'", "'success'", "'error'", "'skipped'", "'info'", "'success'")} AS status,
       {pick("event_id", "'llm'", "'tavily'", "'brightdata'", "'system'", None)} AS provider,
       CAST(floor(abs(value)) AS BIGINT) AS latency_ms, event_id % 900 AS input_tokens, event_id % 300 AS output_tokens,
       CASE WHEN event_id % 3 = 0 THEN event_id % 1000 ELSE NULL END AS total_tokens, event_id % 17 = 0 AS fallback_used,
       CASE WHEN event_id % 13 = 0 THEN 'Authorization: Bearer abc.DEF-' || event_id || ' failed' ELSE 'ok' END AS message
FROM {{events}}
""",
    "arms": """
SELECT event_type AS family, CASE user_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'account' ELSE 'signal' END AS lane, CASE user_id % 2 WHEN 0 THEN 'tavily' ELSE 'brightdata' END AS provider,
       CAST(count(*) AS BIGINT) AS runs, CAST(sum(event_id % 2) AS BIGINT) AS outcome_runs, CAST(sum(event_id % 3) AS BIGINT) AS qualified, CAST(sum(event_id % 5) AS BIGINT) AS returned,
       CAST(sum(event_id % 7) AS BIGINT) AS uniques, CAST(sum(event_id % 2) AS BIGINT) AS rescued, CAST(sum(event_id % 4) AS BIGINT) AS duplicates, CAST(sum(event_id % 6) AS BIGINT) AS units,
       CAST(sum(event_id % 1000) AS BIGINT) AS latency_ms
FROM {events} GROUP BY 1, 2, 3
""",
    "tasks": f"""
SELECT p_partkey AS id, 'Find ' || p_name || ' site:linkedin.com/in/ teams' AS query, {pick("p_partkey", "'view'", "'click'", "'purchase'", "''", None)} AS family,
       {pick("p_partkey", "'person'", "'account'", "'signal'", "'archetype'", None)} AS lane, {pick("p_partkey", "'tavily'", "'brightdata'", "'corroborate'", None)} AS preference, p_size AS priority,
       p_partkey % 7 AS results
FROM {{part}}
""",
    "cache": f"""
SELECT o_orderkey AS cache_id, {pick("o_custkey", "'https://www.linkedin.com/in/user-' || o_custkey % 400 || '/'", None)} AS url, 'user-' || o_custkey % 400 AS username, 'person ' || o_custkey % 300 AS person, 'company ' || o_custkey % 20 AS company,
       {pick("o_orderkey", "'good'", "'partial'", "'bad'", "'good'")} AS quality, {pick("o_orderkey", "'aa'", "'bb'", None)} AS fingerprint,
       {pick("o_orderkey", "'brightdata'", "'tavily'")} AS provider, o_orderdate AS created_at, o_orderdate + INTERVAL '400' DAY AS expires_at
FROM {{orders}}
""",
    "requirements": """
SELECT * FROM (VALUES ('person_role-1', 'person_role', 'hard', 'founder'), ('person_role-1', 'person_role', 'hard', 'owner'), ('person_location-1', 'person_location', 'hard', 'germany'),
  ('person_location-1', 'person_location', 'hard', 'france'), ('company_type-1', 'company_type', 'hard', 'labs'), ('company_industry-1', 'company_industry', 'soft', 'building'), ('signal-1', 'signal', 'soft', 'hiring')) AS t(requirement_id, scope, importance, term)
""",
    "careers": f"""
SELECT conv_id AS person_id, turn AS position, CASE (conv_id * 3 + turn * 5) % 12 {" ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TITLES))} END AS title,
       'Company ' || conv_id % 20 AS company, text AS description
FROM {{conversations}}
""",
    "judgments": f"""
SELECT l_orderkey AS candidate_id, {pick("l_linenumber", "'person_role-1'", "'company_type-1'", "'signal-1'", "'person_location-1'")} AS requirement_id,
       CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'N' THEN 'pass' ELSE CASE WHEN l_linestatus = 'F' THEN 'fail' ELSE 'odd' END END AS status, l_linenumber AS line_no
FROM {{lineitem}}
""",
    "search_logs": f"""
SELECT o_orderkey AS log_id, o_custkey AS session_id, o_orderdate AS logged_at, {pick("o_orderkey", "'running'", "'success'", "'error'", None)} AS status, 'brief ' || o_orderpriority AS prompt, o_orderkey % 40 AS raw_results, o_orderkey % 9 AS leads_found
FROM {{orders}}
""",
    "sessions": f"""
SELECT c_custkey AS session_id, {pick("c_custkey", "'running'", "'interrupted'", "'completed'", "'error'")} AS status, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE chr(123) || '"round":' || c_custkey % 6 || ',"accepted":' || c_custkey % 11 || chr(125) END AS checkpoint_json, c_custkey % 60 AS age_days
FROM {{customer}}
""",
}
