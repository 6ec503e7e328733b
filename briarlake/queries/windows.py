"""Windows, top-k, pagination and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from briarlake.functions import text as T
from briarlake.functions.numeric import fixed
from briarlake.operators import packing as G
from briarlake.operators import records as R
from briarlake.operators import selection as P
from briarlake.operators.order import affine_last
from briarlake.operators.order import ranked as ranked_rows
from briarlake.queries import sql as S
from briarlake.queries.scoring import FRONT_SQL, RANKED_SQL, candidate_front, ranked
from briarlake.registry import Frames, query
from briarlake.scratch import Scratch

C = F.col


@query("e01_company_cap", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY coalesce(nullif(lower(trim(coalesce(company, ''))), ''), 'unknown:' || id) ORDER BY fit DESC, id) AS n FROM candidates) WHERE n <= 3")
def _(f: Frames) -> DataFrame:
    return P.company_cap(f.candidates, T.text(C("company")), "fit", 3).select("id")


@query("e02_keep_first", f"SELECT {S.observation('url', 'title', 'content')} AS identity, min(seq) AS first_seq FROM observations GROUP BY 1")
def _(f: Frames) -> DataFrame:
    return f.observations.groupBy(T.observation_identity(C("url"), C("title"), C("content")).alias("identity")).agg(F.min("seq").alias("first_seq"))


_BLOCKS = "b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, least(length(text), 1600) AS n FROM conversations)"


def _chunks_sql(full: str) -> str:
    return f"""WITH RECURSIVE {_BLOCKS}, walk AS (SELECT conv_id, k, n AS held, 1 AS chunk, 1 AS blocks FROM b WHERE k = 1 UNION ALL
 SELECT b.conv_id, b.k, CASE WHEN {full} THEN b.n ELSE w.held + b.n END, w.chunk + CASE WHEN {full} THEN 1 ELSE 0 END, CASE WHEN {full} THEN 1 ELSE w.blocks + 1 END FROM walk w JOIN b ON b.conv_id = w.conv_id AND b.k = w.k + 1)
 SELECT conv_id, CAST(max(chunk) AS BIGINT) AS n_chunks, CAST(sum(n) AS BIGINT) AS n_chars FROM walk JOIN b USING (conv_id, k) GROUP BY conv_id"""


@query("e04_token_budget_chunks", _chunks_sql("ceil((w.held + b.n) / 4.0) > 400"))
def _(f: Frames) -> DataFrame:
    return G.token_chunks(f.conversations, "conv_id", "turn", "text", 400)


@query("e05_fixed_batches", "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 10 AS chunk FROM leads")
def _(f: Frames) -> DataFrame:
    return R.chunked(f.leads.select("id"), ["id"], 10)


@query("e06_prompt_packing", _chunks_sql("(ceil((w.held + b.n) / 4.0) > 400 OR w.blocks >= 6)"))
def _(f: Frames) -> DataFrame:
    """Batches of at most 6 turns and 400 tokens."""
    return G.token_chunks(f.conversations, "conv_id", "turn", "text", 400, most=6)


@query("e07_cutline_bubble", f"""WITH {RANKED_SQL}, o AS (SELECT id, rank, row_number() OVER (ORDER BY rank DESC, id) AS n FROM ranked), c AS (SELECT rank AS cut FROM o WHERE n = 20)
 SELECT id, abs(rank - cut) <= 0.39::DOUBLE AS in_bubble FROM o, c ORDER BY (abs(rank - cut) <= 0.39::DOUBLE) DESC, n LIMIT 40""")
def _(f: Frames) -> DataFrame:
    return G.cutline(ranked(f), target=20, most=40)


@query("e09_event_sequence", "SELECT event_id, session_id || '-' || row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS sequence_id FROM trace_events")
def _(f: Frames) -> DataFrame:
    places = ranked_rows(f.trace_events.select("session_id", "ts", "event_id"), ["session_id"], [C("ts"), C("event_id")], Scratch(f.spark, "sequence"))
    return places.select("event_id", F.concat_ws("-", "session_id", C("rank") + 1).alias("sequence_id"))


@query("e11_stall_streak", """WITH r AS (SELECT session_id, event_id, CASE WHEN status = 'success' THEN 1 ELSE 0 END AS gain FROM trace_events), i AS (SELECT *, sum(gain) OVER (PARTITION BY session_id ORDER BY event_id) AS island FROM r)
 SELECT session_id, CAST(max(streak) AS BIGINT) AS longest_stall FROM (SELECT session_id, count(*) FILTER (WHERE gain = 0) AS streak FROM i GROUP BY session_id, island) GROUP BY session_id""")
def _(f: Frames) -> DataFrame:
    """An event belongs to the island of the gains up to it; the gains come from prefix sums, so a hot session is no window."""
    events = f.trace_events.select("session_id", "event_id", F.when(C("status") == "success", 1).otherwise(0).alias("gain"))
    placed = ranked_rows(events, ["session_id"], [C("event_id")], Scratch(f.spark, "stall"), sums=("gain",))
    runs = placed.groupBy("session_id", (C("gain_before") + C("gain")).alias("island")).agg(F.count_if(C("gain") == 0).alias("streak"))
    return runs.groupBy("session_id").agg(F.max("streak").alias("longest_stall"))


@query("e13_sequential_fusion", f"""WITH RECURSIVE s AS MATERIALIZED (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS k, (event_id % 10 + 1)::DOUBLE AS seen FROM trace_events),
 w AS (SELECT session_id, k, seen AS x FROM s WHERE k = 1 UNION ALL SELECT s.session_id, s.k, w.x + (s.seen - w.x) * (1.0::DOUBLE / 3.0::DOUBLE) FROM w JOIN s ON s.session_id = w.session_id AND s.k = w.k + 1)
 SELECT session_id, {S.fixed('arg_max(x, k)', 6)} AS fused FROM w GROUP BY session_id""")
def _(f: Frames) -> DataFrame:
    """Every event of a session in order: the state moves a third of the way to what is seen."""
    seen = f.trace_events.select("session_id", "event_id", (C("event_id") % 10 + 1).cast("double").alias("s"))
    last = affine_last(seen, "session_id", ["event_id"], "s", 1.0 / 3.0, Scratch(f.spark, "fusion"))
    return last.select("session_id", fixed(C("last"), 6).alias("fused"))


@query("e15_failure_breaker", "SELECT event_id, sum((status = 'error')::INT) OVER (PARTITION BY session_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) >= 3 AS disabled FROM trace_events")
def _(f: Frames) -> DataFrame:
    events = f.trace_events.select("session_id", "event_id", F.when(C("status") == "error", 1).otherwise(0).alias("failed"))
    placed = ranked_rows(events, ["session_id"], [C("event_id")], Scratch(f.spark, "breaker"), sums=("failed",))
    return placed.select("event_id", (C("failed_before") + C("failed") >= 3).alias("disabled"))


@query("f01_newest_page", "SELECT id FROM leads ORDER BY created_at DESC NULLS LAST, updated_at DESC NULLS LAST, id LIMIT 30 OFFSET 60")
def _(f: Frames) -> DataFrame:
    return R.lead_page(f.leads, {}, "", [], limit=30, offset=60).select("id")


@query("f02_client_pages", "SELECT id, (row_number() OVER (ORDER BY created_at NULLS LAST, id) - 1) // 100 AS chunk FROM leads")
def _(f: Frames) -> DataFrame:
    return R.chunked(f.leads.select("id", "created_at"), ["created_at", "id"], 100).select("id", "chunk")


@query("f03_recent_four", "SELECT id, created_at FROM leads ORDER BY created_at DESC NULLS LAST, id LIMIT 4")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", "created_at").orderBy(C("created_at").desc_nulls_last(), "id").limit(4)


@query("f04_fused_ranking", f"""WITH o AS (SELECT seq, length(coalesce(title, '') || ' ' || content) + CASE WHEN ({S.handle('url')}) <> '' THEN 180 ELSE 0 END + CASE WHEN coalesce(lane, '') = 'signal' THEN 40 ELSE 0 END + (1 + seq % 3) * 160 + CASE WHEN seq % 3 > 0 THEN 180 ELSE 0 END AS score FROM observations)
 SELECT seq, CAST(score AS BIGINT) AS score FROM o ORDER BY score DESC, seq LIMIT 80""")
def _(f: Frames) -> DataFrame:
    sources = C("seq") % 3 + 1
    score = F.length(F.concat(T.text(C("title")), F.lit(" "), C("content"))) + F.when(T.profile_handle(C("url")) != "", 180).otherwise(0) + F.when(T.text(C("lane")) == "signal", 40).otherwise(0) + sources * 160 + F.when(sources > 1, 180).otherwise(0)
    return f.observations.select("seq", score.cast("long").alias("score")).orderBy(C("score").desc(), "seq").limit(80)


_TERMS = ["erea", "tion", "haha"]
_TAKEN = """CASE WHEN a.left >= 60 AND least(x.n, 280, a.left) >= 24 AND NOT list_contains(a.chosen, x.k)
 THEN {'k': a.k, 'n': a.n, 'has': a.has, 'left': a.left - least(x.n, 280, a.left) - 1, 'chosen': list_append(a.chosen, x.k), 'covered': list_transform(list_zip(a.covered, x.has), lambda z: z[1] OR z[2])} ELSE a END"""
_NONE = f"{{'k': 0::BIGINT, 'n': 0::BIGINT, 'has': []::BOOLEAN[], 'left': 850::BIGINT, 'chosen': []::BIGINT[], 'covered': [{', '.join('false' for _ in _TERMS)}]}}"


def _after_term(j: int) -> str:
    best = f"list_filter(items, lambda x: x.has[{j + 1}] AND NOT list_contains(s.chosen, x.k))[1:1]"
    return f"t{j + 1} AS (SELECT doc_id, items, list_reduce({best}, lambda a, x: {_TAKEN}, s) AS s FROM t{j})"


@query("f06_evidence_sentences", rf"""WITH u AS (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS k FROM (SELECT doc_id, string_split_regex(replace(text, chr(13), ''), '\n+|[.!?;]+\s+') AS p FROM documents)), c AS (SELECT doc_id, substr(trim(regexp_replace(s, '\s+', ' ', 'g')), 1, 520) AS s, k FROM u),
 d AS (SELECT doc_id, s, min(k) AS k, [{', '.join(f"contains(lower(s), '{t}')" for t in _TERMS)}] AS has FROM c WHERE s <> '' GROUP BY doc_id, s),
 t0 AS (SELECT doc_id, list({{'k': k, 'n': length(s)::BIGINT, 'has': has, 'left': 0::BIGINT, 'chosen': []::BIGINT[], 'covered': has}} ORDER BY -len(list_filter(has, lambda x: x)), k) AS items, {_NONE} AS s FROM d GROUP BY doc_id),
 {', '.join(_after_term(j) for j in range(len(_TERMS)))}, e AS (SELECT doc_id, list_reduce(items, lambda a, x: {_TAKEN}, s) AS s FROM t{len(_TERMS)})
 SELECT doc_id, coalesce(len(s.chosen), 0)::BIGINT AS n_chosen, coalesce(850 - s.left, 0)::BIGINT AS n_chars, coalesce(len(list_filter(s.covered, lambda x: x)), 0)::BIGINT AS n_covered FROM documents LEFT JOIN e USING (doc_id)""")
def _(f: Frames) -> DataFrame:
    """The best sentence per hard term, then the densest, within 850 characters."""
    return G.evidence_sentences(f.documents.select("doc_id", "text"), _TERMS, 850)


@query("f07_best_public_email", r"""WITH lines AS (SELECT id, unnest([coalesce(headline, ''), 'contact: ' || coalesce(email, ''), 'mailto:m' || id || '@corp.io', coalesce(email, '')]) AS line, unnest([0, 1, 2, 3]) AS k FROM leads),
 m AS (SELECT id, k, CASE WHEN contains(line, 'mailto:') THEN 3 WHEN regexp_matches(lower(line), '\b(email|contact|reach\s+me|reach\s+out)\b') THEN 2 ELSE 1 END AS p, lower(regexp_extract(line, '(?i)[a-z0-9._-]+@[a-z0-9-]+(\.[a-z0-9-]+)+')) AS mail FROM lines)
 SELECT id, arg_min(mail, (-p, k)) AS best_email FROM m WHERE mail <> '' AND split_part(mail, '@', 2) <> 'example.com' AND NOT regexp_matches(split_part(mail, '@', 1), '^no-?reply$') GROUP BY id""")
def _(f: Frames) -> DataFrame:
    lines = F.array(T.text(C("headline")), F.concat(F.lit("contact: "), T.text(C("email"))), F.concat(F.lit("mailto:m"), C("id").cast("string"), F.lit("@corp.io")), T.text(C("email")))
    return G.best_email(f.leads.select("id", F.posexplode(lines).alias("k", "line")), "id")


@query("f08_best_company_site", f"SELECT location, arg_max(id, (length(coalesce(website, '')), -id)) AS best_id FROM leads WHERE coalesce(website, '') <> '' GROUP BY location")
def _(f: Frames) -> DataFrame:
    return f.leads.where("coalesce(website, '') <> ''").groupBy("location").agg(F.max_by("id", F.struct(F.length("website"), -C("id"))).alias("best_id"))


@query("f11_pareto_reservation", f"{FRONT_SQL} ORDER BY id LIMIT 6")
def _(f: Frames) -> DataFrame:
    """The first 30 % of 20 places go to the skyline, in order of id."""
    return candidate_front(f).orderBy("id").limit(6)


@query("f12_safety_net", f"""WITH {RANKED_SQL}, r AS (SELECT *, coalesce(fit >= 12, false) AS good, coalesce(url, '') AS u FROM ranked), q AS (SELECT location, count(*) AS n FROM r WHERE good GROUP BY 1), o AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY rank DESC, id) AS k FROM r WHERE NOT good AND NOT EXISTS (SELECT 1 FROM r g WHERE g.good AND g.location = r.location AND g.u = r.u))
 SELECT location, id, 'qualified' AS verdict FROM r WHERE good UNION ALL SELECT o.location, id, 'rescued' FROM o LEFT JOIN q ON q.location = o.location WHERE k <= least(10, 20 - coalesce(n, 0))""")
def _(f: Frames) -> DataFrame:
    """Each location is a session that asks for 20: all that qualify, and up to half of the target from the best others."""
    return G.rescued(ranked(f).withColumn("qualified", F.coalesce(C("fit") >= 12, F.lit(False))), "location", target=20, share=0.5)


@query("f13_newest_n", "SELECT log_id FROM search_logs ORDER BY logged_at DESC, log_id DESC LIMIT 30")
def _(f: Frames) -> DataFrame:
    return f.search_logs.orderBy(C("logged_at").desc(), C("log_id").desc()).limit(30).select("log_id")


@query("g02_union_all_lanes", "SELECT seq, 'primary' AS wave FROM observations WHERE provider = 'tavily' UNION ALL SELECT seq, 'secondary' FROM observations WHERE lane = 'signal'")
def _(f: Frames) -> DataFrame:
    first = f.observations.where("provider = 'tavily'").select("seq", F.lit("primary").alias("wave"))
    return first.unionByName(f.observations.where("lane = 'signal'").select("seq", F.lit("secondary").alias("wave")))


@query("g05_intersections", f"SELECT a.id, CAST(len(list_intersect({S.distinctive('a.company')}, {S.distinctive('b.company')})) AS BIGINT) AS n_shared FROM leads a JOIN leads b ON b.id = a.id + 8")
def _(f: Frames) -> DataFrame:
    other = f.leads.select((C("id") - 8).alias("to"), T.distinctive_words(C("company")).alias("theirs"))
    return f.leads.join(other, C("id") == C("to")).select("id", F.size(F.array_intersect(T.distinctive_words(C("company")), "theirs")).cast("long").alias("n_shared"))


@query("g07_flatten", "SELECT conv_id, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS n_parts FROM conversations GROUP BY conv_id")
def _(f: Frames) -> DataFrame:
    return f.conversations.select("conv_id", F.explode(F.split("text", " ")).alias("part")).groupBy("conv_id").agg(F.count("*").alias("n_parts"))


@query("g08_backfill", "SELECT cache_id, username, created_at + INTERVAL '7' DAY AS expires_at FROM cache WHERE quality = 'good'")
def _(f: Frames) -> DataFrame:
    return f.cache.where("quality = 'good'").select("cache_id", "username", (C("created_at") + F.expr("INTERVAL '7' DAY")).alias("expires_at"))


@query("g09_signal_companies", "SELECT DISTINCT trim(company) AS company FROM leads WHERE length(trim(coalesce(company, ''))) >= 2")
def _(f: Frames) -> DataFrame:
    return f.leads.where(F.length(F.trim(T.text(C("company")))) >= 2).select(F.trim("company").alias("company")).distinct()


#: A search has up to nine results; every second search of a source finds posts among them.
_SEARCH = "query || '/' || CAST(floor(seq / 9.0) AS BIGINT)"
_POST_URL = "CASE WHEN CAST(floor(seq / 9.0) AS BIGINT) % 2 = 0 AND seq % 3 > 0 THEN 'https://www.LinkedIn.com/posts/p' || seq ELSE url END"
_IS_POST = "(" + " OR ".join(f"contains(lower(coalesce(url, '')), '{p}')" for p in G.POSTS) + ")"


@query("h21_post_snippets", rf"""WITH r AS (SELECT {_SEARCH} AS search, seq, {_POST_URL} AS url, CASE WHEN seq % 5 = 0 THEN title || ' | LinkedIn' ELSE title END AS title, content FROM observations), p AS (SELECT *, {_IS_POST} AS post FROM r),
 n AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY post DESC, seq) AS n, bool_or(post) OVER (PARTITION BY search) AS any_post FROM p), t AS (SELECT *, trim(regexp_replace(coalesce(title, ''), '\s*[-|]\s*linkedin.*$', '', 'i')) AS head, trim(coalesce(content, '')) AS body FROM n WHERE n <= CASE WHEN any_post THEN 5 ELSE 3 END AND (post OR NOT any_post)),
 l AS (SELECT *, CASE WHEN head <> '' AND body <> '' THEN head || ' - ' || body ELSE head || body END AS line FROM t)
 SELECT search, CAST(count(*) FILTER (WHERE line <> '') AS BIGINT) AS n_snippets, arg_min(coalesce(url, '?'), n) AS first_url, substr(coalesce(string_agg('[Post snippet]: ' || line, chr(10) ORDER BY n) FILTER (WHERE line <> ''), ''), 1, 1000) AS context FROM l GROUP BY search""")
def _(f: Frames) -> DataFrame:
    results = f.observations.select(F.expr(_SEARCH).alias("search"), "seq", F.expr(_POST_URL).alias("url"), F.when(C("seq") % 5 == 0, F.concat("title", F.lit(" | LinkedIn"))).otherwise(C("title")).alias("title"), "content")
    return G.post_snippets(results, "search").withColumn("first_url", F.coalesce("first_url", F.lit("?")))
