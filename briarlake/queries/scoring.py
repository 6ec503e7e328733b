"""Scores, ranks and selections of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.functions import numeric as N
from briarlake.functions import scoring as K
from briarlake.functions import text as T
from briarlake.functions.sampling import POSTERIOR, beta_sql
from briarlake.operators import matching as M
from briarlake.operators import relevance as V
from briarlake.operators import selection as P
from briarlake.queries import sql as S
from briarlake.queries.joins import objectives
from briarlake.queries.scalars import labels_sql, weak_sql
from briarlake.registry import Frames, query

C = F.col
_EV = "CASE quality WHEN 'good' THEN 9.0::DOUBLE WHEN 'partial' THEN 7 ELSE 4 END"
_SRC = "CASE WHEN provider IN ('brightdata', 'manual') THEN 8.0::DOUBLE WHEN provider IN ('cache', 'import') THEN 7 ELSE 6 END"
_FRESH = S.fixed("least(greatest(exp(-0.02::DOUBLE * post_age), 0.2::DOUBLE), 1.0::DOUBLE)")
_D = lambda x: f"{x}::DOUBLE"


def caps_sql(x: str) -> str:
    doubt = f"CASE WHEN coalesce(identity_confidence < 6, false) OR coalesce(employment_confidence < 6, false) THEN least({x}, 6.0::DOUBLE) ELSE {x} END"
    bare = f"CASE WHEN coalesce(email, '') = '' AND quality IN ('weak', 'bad') THEN least({doubt}, 7.5::DOUBLE) ELSE {doubt} END"
    return f"CASE WHEN coalesce(verdict IN ('reject', 'auto_reject'), false) THEN least({x}, 3.0::DOUBLE) ELSE {S.clamp(f'({bare})', 1, 10)} END"


def caps(score: F.Column) -> F.Column:
    return K.hard_caps(score, C("verdict"), C("identity_confidence"), C("employment_confidence"), C("email"), C("quality"))


_BLEND = f"""{S.score_or('fit', 5)} * 0.35::DOUBLE + {S.score_or('intent', 5)} * 0.3::DOUBLE + {S.score_or('timing', 5)} * 0.15::DOUBLE + {_EV} * 0.15::DOUBLE + {_SRC} * 0.05::DOUBLE
 + CASE WHEN authority >= 8 THEN 0.7::DOUBLE WHEN authority >= 6 THEN 0.3 ELSE 0 END - CASE WHEN authority IS NOT NULL AND ignored_title THEN 1.5::DOUBLE ELSE 0 END"""


def blend() -> F.Column:
    return K.blended_score(C("fit"), C("intent"), C("timing"), K.evidence_score(C("quality")), K.source_score(C("provider")), C("authority"), C("ignored_title"))


@query("k01_score_breakdown", f"SELECT id, {S.score_or('fit', 5)} AS fit_score, {S.fixed(caps_sql('b'), 1)} AS final_score FROM (SELECT *, {_BLEND} AS b FROM candidates)")
def _(f: Frames) -> DataFrame:
    return f.candidates.select("id", N.score_or(C("fit"), 5).alias("fit_score"), N.fixed(caps(blend()), 1).alias("final_score"))


@query("k02_hard_caps", f"SELECT id, {caps_sql('fit')} AS capped FROM candidates")
def _(f: Frames) -> DataFrame:
    return f.candidates.select("id", caps(C("fit")).alias("capped"))


_COMPANY = f"""CASE WHEN NOT has_intent THEN 5.0::DOUBLE ELSE coalesce(CASE WHEN quality = 'good' THEN least(10.0::DOUBLE, {S.fixed('tfidf * 2 + 9')}) WHEN quality = 'partial' THEN least(10.0::DOUBLE, {S.fixed('tfidf * 2 + 7')}) WHEN n_dynamic + n_universal >= 4 THEN 6.0::DOUBLE END,
 CASE WHEN account_pain > 10 THEN least(account_pain / 10, 10.0::DOUBLE) WHEN account_pain > 0 THEN account_pain END, 5.0::DOUBLE) END"""
_POST = f"""CASE WHEN coalesce(post_state = 'enriched_none', false) OR (post_state IS NULL AND coalesce(post_quality = 'none', false)) THEN 4.5::DOUBLE WHEN post_quality IS NULL OR post_quality = 'none' THEN 5.0::DOUBLE
 ELSE least(10.0::DOUBLE, {S.fixed(f"CASE post_quality WHEN 'strong' THEN 8.0::DOUBLE WHEN 'moderate' THEN 6.5 WHEN 'weak' THEN 5.5 ELSE 5 END + {S.clamp('post_confidence', 0, 1)} * {_FRESH}")}) END"""
_RANK = f"""{S.score_or('authority', 5)} * 0.3::DOUBLE + {_COMPANY} * 0.15::DOUBLE + {_EV} * 0.15::DOUBLE + {S.score_or('corroboration', 4)} * 0.15::DOUBLE + {S.score_or('coverage', 5)} * 0.1::DOUBLE + {_SRC} * 0.03::DOUBLE
 + {S.score_or('(CASE WHEN base_score > 0 AND base_score <= 1 THEN base_score * 10 ELSE base_score END)', 5)} * 0.02::DOUBLE + {_POST} * 0.1::DOUBLE + bm25 * 0.05::DOUBLE + CASE WHEN skyline THEN 0.3::DOUBLE ELSE 0 END"""
RANKED_SQL = f"ranked AS (SELECT id, company, location, fit, skyline, url, quality, {S.fixed(caps_sql('r'))} AS rank FROM (SELECT *, {_RANK} AS r FROM candidates))"


def company_intent() -> F.Column:
    return K.company_intent(C("has_intent"), C("quality"), C("tfidf"), C("n_dynamic") + C("n_universal"), C("account_pain"))


def post_intent() -> F.Column:
    return K.post_intent(C("post_state"), C("post_quality"), C("post_confidence"), N.freshness(C("post_age")))


def ranked(f: Frames) -> DataFrame:
    rank = K.selection_rank(C("authority"), company_intent(), K.evidence_score(C("quality")), C("corroboration"), C("coverage"), K.source_score(C("provider")), C("base_score"), post_intent(), C("bm25"), C("skyline"))
    return f.candidates.select("id", "company", "location", "fit", "skyline", "url", "quality", N.fixed(caps(rank)).alias("rank"))


@query("k03_selection_rank", f"WITH {RANKED_SQL} SELECT id, rank FROM ranked")
def _(f: Frames) -> DataFrame:
    return ranked(f).select("id", "rank")


@query("k04_company_intent", f"SELECT id, {_COMPANY} AS company_intent FROM candidates")
def _(f: Frames) -> DataFrame:
    return f.candidates.select("id", company_intent().alias("company_intent"))


@query("k05_post_intent", f"SELECT id, {_POST} AS post_intent FROM candidates")
def _(f: Frames) -> DataFrame:
    return f.candidates.select("id", post_intent().alias("post_intent"))


_POSTERIOR = "(0.25::DOUBLE * lik / (0.25::DOUBLE * lik + 0.75::DOUBLE))"
_DELTA = f"""WITH l AS (SELECT *, greatest(0.5::DOUBLE, (n_dynamic * 1.8::DOUBLE + n_universal * 0.4::DOUBLE) * least(CASE WHEN pages = 0 THEN 1 ELSE pages END, 3)) AS lik FROM candidates),
 d AS (SELECT *, CASE WHEN n_dynamic = 0 AND n_universal = 0 AND quality NOT IN ('good', 'partial') THEN 0.0::DOUBLE ELSE {S.fixed(f"CASE quality WHEN 'good' THEN greatest(0.8::DOUBLE, {_POSTERIOR} * 1.2::DOUBLE) WHEN 'partial' THEN greatest(0.4::DOUBLE, {_POSTERIOR} * 0.7::DOUBLE) ELSE {_POSTERIOR} * 0.3::DOUBLE END * exp(greatest(cache_age, 0) * -0.05::DOUBLE)")} END AS delta FROM l)"""


def delta() -> F.Column:
    return K.intent_delta(C("n_dynamic"), C("n_universal"), C("pages"), C("quality"), C("cache_age"))


@query("k06_intent_delta", f"{_DELTA} SELECT id, delta FROM d")
def _(f: Frames) -> DataFrame:
    return f.candidates.select("id", delta().alias("delta"))


def sigmoid_sql(x: str) -> str:
    at = lambda y: f"(1.0::DOUBLE / (exp(({y} - 5.5::DOUBLE) * -0.45::DOUBLE) + 1))"
    low, high = at("1.0::DOUBLE"), at("10.0::DOUBLE")
    return S.fixed(f"({at(S.clamp(x, 1, 10))} - {low}) / ({high} - {low}) * 9 + 1")


@query("k07_sigmoid", f"SELECT id, {sigmoid_sql('fit')} AS scaled FROM candidates")
def _(f: Frames) -> DataFrame:
    return f.candidates.select("id", K.sigmoid(C("fit")).alias("scaled"))


_GAIN = "(1.0::DOUBLE / 3.0::DOUBLE)"


@query("k08_kalman", f"SELECT id, {S.fixed(S.clamp(f'(fit + (intent - fit) * {_GAIN})', 1, 10))} AS fused FROM candidates")
def _(f: Frames) -> DataFrame:
    return f.candidates.select("id", K.kalman(C("fit"), C("intent")).alias("fused"))


_POOL = f"""pool AS (SELECT id, greatest(fit, 1.0::DOUBLE) AS s FROM candidates), stats AS (SELECT count(*) AS n, sum(s) AS total, log2(sum(s)) - sum(s * log2(s)) / sum(s) AS h FROM pool),
 spread AS (SELECT total / n AS mean, {S.fixed('1 + 0.15::DOUBLE * ((log2(n) - h) / log2(n))', 9)} AS factor FROM stats)"""


@query("k09_entropy_pool", f"WITH {_POOL} SELECT id, {S.fixed(S.clamp('(mean + (s - mean) * factor)', 1, 10))} AS normalized FROM pool, spread")
def _(f: Frames) -> DataFrame:
    """D27 gives the entropy."""
    return P.entropy_spread(f.candidates.select("id", F.greatest("fit", F.lit(1.0)).alias("s")), "s").select("id", C("normalized"))


@query("k10_tfidf_weight", f"""SELECT doc_id, {S.fixed("greatest(0, c * ln(n / (1.0::DOUBLE + df)))", 4)} AS weight FROM (SELECT doc_id, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 7) = 'ention ')) AS c FROM (SELECT doc_id, lower(text) AS text FROM documents)) t,
 (SELECT count(*) AS n, count(*) FILTER (WHERE contains(lower(text), 'ention ')) AS df FROM documents) s""")
def _(f: Frames) -> DataFrame:
    low = F.lower("text")
    stats = f.documents.agg(F.count("*").alias("n"), F.count_if(low.contains("ention ")).alias("df"))
    counted = f.documents.select("doc_id", T.overlapping_count(low, "ention ").alias("c")).crossJoin(F.broadcast(stats))
    return counted.select("doc_id", N.fixed(F.greatest(F.lit(0.0), C("c") * F.ln(C("n") / (C("df") + 1))), 4).alias("weight"))


_TERMS = {"erea": 1.5, "haha": 1.4, "zzz": 1.2, "tionth": 1.0}


@query("k11_company_tfidf", f"""WITH t AS (SELECT doc_id, {', '.join(f"len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, {len(t)}) = '{t}')) AS t{k}" for k, t in enumerate(_TERMS))} FROM (SELECT doc_id, lower(text) AS text FROM documents)),
 s AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE t{k} > 0) AS d{k}' for k in range(4))} FROM t)
 SELECT doc_id, CAST({' + '.join(f'(t{k} > 0)::INT' for k in range(4))} AS BIGINT) AS n_signals, least(1.0::DOUBLE, {S.fixed('(0.0::DOUBLE + ' + ' + '.join(f'greatest(0.0::DOUBLE, t{k} * ln(n / (d{k} + 1.0::DOUBLE))) * {w}::DOUBLE' for k, w in enumerate(_TERMS.values())) + ') / 10', 4)}) AS score FROM t, s""")
def _(f: Frames) -> DataFrame:
    return V.tfidf(f.documents.select("doc_id", "text"), _TERMS)


@query("k11_tfidf_in_order", f"""WITH t AS (SELECT doc_id, {', '.join(f"len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, {len(t)}) = '{t}')) AS t{k}" for k, t in enumerate(_TERMS))} FROM (SELECT doc_id, lower(text) AS text FROM documents)),
 s AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n, {', '.join(f'count(*) FILTER (WHERE t{k} > 0) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS d{k}' for k in range(4))} FROM t)
 SELECT doc_id, CAST({' + '.join(f'(t{k} > 0)::INT' for k in range(4))} AS BIGINT) AS n_signals, least(1.0::DOUBLE, {S.fixed('(0.0::DOUBLE + ' + ' + '.join(f'greatest(0.0::DOUBLE, t{k} * ln(n / (d{k} + 1.0::DOUBLE))) * {w}::DOUBLE' for k, w in enumerate(_TERMS.values())) + ') / 10', 4)}) AS score FROM s""")
def _(f: Frames) -> DataFrame:
    """K11 page by page: frequencies grow with the order of arrival."""
    return V.tfidf_in_order(f.documents.select("doc_id", "text"), _TERMS)


_BM25 = ["the", "erea", "and", "tion", "zzz"]


@query("k12_bm25", rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 2) AS w FROM documents),
 t AS (SELECT doc_id, len(w) AS n, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{k}" for k, t in enumerate(_BM25))} FROM w), s AS (SELECT count(*) AS nd, sum(n) / count(*) AS av, {', '.join(f'count(*) FILTER (WHERE t{k} > 0) AS d{k}' for k in range(5))} FROM t)
 SELECT doc_id, least(10.0::DOUBLE, {S.fixed('(0.0::DOUBLE + ' + ' + '.join(f"CASE WHEN t{k} > 0 THEN greatest(0.0::DOUBLE, ln((nd - d{k} + 0.5::DOUBLE) / (d{k} + 0.5::DOUBLE) + 1)) * (t{k} * 2.2::DOUBLE / (t{k} + (n / av * 0.75::DOUBLE + 0.25::DOUBLE) * 1.2::DOUBLE) + 0.5::DOUBLE) ELSE 0.0::DOUBLE END" for k in range(5)) + ') * 1.5::DOUBLE')}) AS score FROM t, s""")
def _(f: Frames) -> DataFrame:
    return V.bm25(f.documents.select("doc_id", "text"), _BM25)


@query("k13_apply_company_delta", f"""{_DELTA}, e AS (SELECT *, CASE WHEN base_score > 0 AND base_score <= 1 THEN base_score * 10 ELSE base_score END AS b FROM d), r AS (SELECT *, {caps_sql('(b + delta)')} AS raw FROM e)
 SELECT id, CASE WHEN NOT has_intent THEN b WHEN prior_score > 0 THEN {S.fixed(S.clamp(f'(p + (raw - p) * {_GAIN})', 1, 10))} ELSE {S.fixed('raw')} END AS enriched FROM (SELECT *, CASE WHEN prior_score > 0 AND prior_score <= 1 THEN prior_score * 10 ELSE prior_score END AS p FROM r)""")
def _(f: Frames) -> DataFrame:
    base, prior = N.to_ten(C("base_score")), N.to_ten(C("prior_score"))
    raw = caps(base + delta())
    return f.candidates.select("id", F.when(~C("has_intent"), base).when(prior > 0, K.kalman(prior, raw)).otherwise(N.fixed(raw)).alias("enriched"))


_SURE = S.clamp("post_confidence", 0, 1)
_PD = S.fixed(f"CASE post_quality WHEN 'strong' THEN {_SURE} * 0.3::DOUBLE + 0.5::DOUBLE WHEN 'moderate' THEN {_SURE} * 0.2::DOUBLE + 0.25::DOUBLE WHEN 'weak' THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END * {_FRESH}")


@query("k14_apply_post_delta", f"SELECT id, CASE WHEN post_quality IS NULL OR post_quality = 'none' THEN b ELSE {S.fixed(f'least(10.0::DOUBLE, b + {_PD})')} END AS enriched FROM (SELECT *, CASE WHEN base_score > 0 AND base_score <= 1 THEN base_score * 10 ELSE base_score END AS b FROM candidates)")
def _(f: Frames) -> DataFrame:
    base = N.to_ten(C("base_score"))
    moved = N.fixed(F.least(F.lit(10.0), base + K.post_delta(C("post_quality"), C("post_confidence"), N.freshness(C("post_age")))))
    return f.candidates.select("id", F.when(C("post_quality").isNull() | (C("post_quality") == "none"), base).otherwise(moved).alias("enriched"))


_SAME = f"c.firm <> '' AND p.firm <> '' AND (c.firm = p.firm OR list_has_any(c.words, p.words))"


def _mmr_sql(base: str, count: str) -> str:
    """c and w: greedy picks from `base` (id, rank, company, location), a step each; w.ids[n] is pick n."""
    return f"""c AS MATERIALIZED (SELECT id, rank, {S.company('company')} AS firm, {S.distinctive('company')} AS words, lower(coalesce(location, '')) AS place FROM {base}),
 w AS (SELECT 0 AS position, []::BIGINT[] AS ids, []::STRUCT(firm VARCHAR, words VARCHAR[], place VARCHAR)[] AS picks UNION ALL
 SELECT position + 1, list_append(any_value(ids), arg_max(id, (value, rank, -id))), list_append(any_value(picks), arg_max({{'firm': firm, 'words': words, 'place': place}}, (value, rank, -id))) FROM (SELECT w.*, c.*,
  0.75::DOUBLE * (c.rank / 10) - 0.25::DOUBLE * coalesce(list_max(list_transform(w.picks, lambda p: CASE WHEN {_SAME} THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN c.place <> '' AND c.place = p.place THEN 0.2::DOUBLE ELSE 0 END)), 0) AS value
  FROM w, c WHERE w.position < {count} AND NOT list_contains(w.ids, c.id)) GROUP BY position)"""


@query("k15_mmr_selection", f"WITH RECURSIVE {RANKED_SQL}, {_mmr_sql('ranked', '12')} SELECT ids[position] AS id, position::BIGINT AS position FROM w WHERE position > 0")
def _(f: Frames) -> DataFrame:
    """F10 too: greedy marginal relevance over all candidates by rank."""
    return P.mmr(ranked(f), 12)


_VECTOR = f"vec AS (SELECT id, {S.score_or('authority', 5)} AS a, {_COMPANY} AS b, {_POST} AS c, {_EV} AS d FROM candidates)"


_FRONT = f"{_VECTOR}, v AS (SELECT DISTINCT a, b, c, d FROM vec), front AS (SELECT * FROM v x WHERE NOT EXISTS (SELECT 1 FROM v y WHERE y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND y.d >= x.d AND (y.a > x.a OR y.b > x.b OR y.c > x.c OR y.d > x.d))), front_ids AS (SELECT id FROM vec JOIN front USING (a, b, c, d))"
FRONT_SQL = f"WITH {_FRONT} SELECT id FROM front_ids"


@query("k16_candidate_skyline", FRONT_SQL)
def candidate_front(f: Frames) -> DataFrame:
    vectors = f.candidates.select("id", N.score_or(C("authority"), 5).alias("a"), company_intent().alias("b"), post_intent().alias("c"), K.evidence_score(C("quality")).alias("d"))
    return M.skyline(vectors, "id", ["a", "b", "c", "d"]).select("id")


_SIGMA = """sqrt((info * info + corr * corr + doubt * doubt) / 3) AS sigma FROM (SELECT id, fit, 1.0::DOUBLE / (least(n_snippets, 6) * 0.35::DOUBLE + 1) AS info, 0.85::DOUBLE / sqrt(greatest(source_count, 1)::DOUBLE) AS corr, CASE quality WHEN 'good' THEN 0.15::DOUBLE WHEN 'partial' THEN 0.35 ELSE 0.7 END AS doubt FROM candidates)"""


@query("k17_credible_interval", f"SELECT id, greatest(0.0::DOUBLE, {S.fixed('fit - sigma * 1.96::DOUBLE')}) AS lower, least(10.0::DOUBLE, {S.fixed('fit + sigma * 1.96::DOUBLE')}) AS upper, {S.fixed('sigma', 3)} AS uncertainty FROM (SELECT id, fit, {_SIGMA})")
def _(f: Frames) -> DataFrame:
    sigma = K.credible_sigma(C("n_snippets"), C("source_count"), C("quality"))
    return f.candidates.select("id", F.greatest(F.lit(0.0), N.fixed(C("fit") - sigma * 1.96)).alias("lower"), F.least(F.lit(10.0), N.fixed(C("fit") + sigma * 1.96)).alias("upper"), N.fixed(sigma, 3).alias("uncertainty"))


_SPEC = {"target title": ["founder", "owner"], "target location": ["germany", "france"], "company keyword": ["labs"], "buying signal": ["hiring"]}
_HAY = "lower(concat_ws(' ', full_name, title, company, location, headline, industry))"
_HITS = " + ".join(f"({' OR '.join(f"contains({_HAY}, '{v}')" for v in values)})::INT" for values in _SPEC.values())


@query("k18_scout_evidence", f"SELECT id, CAST(h AS BIGINT) AS n_criteria, {S.clamp(S.fixed('2 + h / 4.0::DOUBLE * 8'), 1, 10)} AS coverage, {S.clamp(S.fixed('2 + least(1 + id % 3, 3) * 2.5::DOUBLE + least(1 + id % 5, 4) * 0.75::DOUBLE'), 1, 10)} AS corroboration FROM (SELECT id, {_HITS} AS h FROM leads)")
def _(f: Frames) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "full_name", "title", "company", "location", "headline", "industry"))
    hits = P.criteria_hits(hay, _SPEC)
    return f.leads.select("id", hits.cast("long").alias("n_criteria"), N.clamp(N.fixed(hits / float(len(_SPEC)) * 8 + 2), 1, 10).alias("coverage"), N.clamp(N.fixed(F.least(C("id") % 3 + 1, F.lit(3)) * 2.5 + 2 + F.least(C("id") % 5 + 1, F.lit(4)) * 0.75), 1, 10).alias("corroboration"))


@query("k19_diversified_selection", f"""WITH RECURSIVE {RANKED_SQL}, {_FRONT}, reserved AS (SELECT id, row_number() OVER (ORDER BY id) AS position FROM front_ids QUALIFY position <= 6),
 {_POOL.replace('SELECT id, greatest(fit, 1.0::DOUBLE) AS s FROM candidates', 'SELECT id, company, location, greatest(rank, 1.0::DOUBLE) AS s FROM ranked')},
 scaled AS (SELECT id, company, location, {sigmoid_sql(S.fixed(S.clamp('(mean + (s - mean) * factor)', 1, 10)))} AS rank FROM pool, spread),
 capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(lower(trim(coalesce(company, ''))), ''), 'unknown:' || id) ORDER BY rank DESC, id) AS n FROM scaled) WHERE n <= 2 AND id NOT IN (SELECT id FROM reserved)),
 {_mmr_sql('capped', '20 - (SELECT count(*) FROM reserved)')} SELECT id, position::BIGINT AS position FROM reserved UNION ALL SELECT ids[position], position + (SELECT count(*) FROM reserved) FROM w WHERE position > 0""")
def _(f: Frames) -> DataFrame:
    """Skyline share, entropy, company cap with sigmoid, then marginal relevance."""
    front = candidate_front(f).select(C("id").alias("_front"))
    flagged = ranked(f).drop("skyline").join(front, C("id") == C("_front"), "left").withColumn("skyline", C("_front").isNotNull())
    return P.diversified(flagged, limit=20, per_company=2)


@query("k20_authority_check", f"""WITH w AS (SELECT id, title, headline, {S.words('seniority')} AS level, concat_ws(' ', nullif({S.words("concat_ws(' ', title, headline)")}, ''), nullif({S.words('seniority')}, '')) AS x, {S.words('company')} AS firm, company FROM leads),
 m AS (SELECT *, len({labels_sql('x')}) > 0 OR regexp_matches(level, '{K.SENIORITY}') AS matched, len({weak_sql('x')}) > 0 AS weak, regexp_matches(x, '{K.STUDENT_BODY}') OR regexp_matches(x, '{K.ASSISTANT_TO}') AS overruled FROM w),
 i AS (SELECT *, weak AND (NOT matched OR overruled) AS ignored FROM m)
 SELECT id, matched AS title_matched, ignored AS ignored_title, coalesce(company, '') <> '' AND contains(x, firm) AS company_matched, CASE WHEN ignored THEN 2.0::DOUBLE WHEN matched THEN 7 WHEN title <> '' OR coalesce(headline, '') <> '' THEN 5 ELSE 4 END AS confidence FROM i""")
def _(f: Frames) -> DataFrame:
    """H9 gives the labels."""
    checked = K.verify_authority(f.leads, F.lit("find decision makers"), C("title"), C("headline"), C("seniority"), C("company"), F.lit(""), F.lit(0), F.lit(0.0))
    return checked.select("id", "title_matched", "ignored_title", "company_matched", "confidence")


_ROLE = f"""CASE WHEN list_has_any(l, ['founder', 'owner', 'c-suite']) THEN 10.0::DOUBLE WHEN list_has_any(l, ['president']) THEN 9 WHEN list_has_any(l, ['vp', 'head', 'managing director']) THEN 8 WHEN list_has_any(l, ['director']) THEN 7
 WHEN regexp_matches(x, '\\b(lead|manager|principal|supervisor)\\b') THEN 5.5 ELSE 4 END"""


_CAREER = f"""WITH w AS (SELECT person_id, position, {S.words("title || ' ' || company || ' ' || description")} AS x FROM careers WHERE position < 6), l AS (SELECT *, {labels_sql('x')} AS l FROM w),
 v AS (SELECT person_id, {_ROLE} * CASE WHEN contains(x, 'sales') THEN 1.0::DOUBLE ELSE 0.75 END * power(0.8::DOUBLE, position) AS s, power(0.8::DOUBLE, position) AS d FROM l) SELECT person_id, {S.fixed(S.clamp('(sum(s) / sum(d))', 1, 10))} AS trajectory FROM v GROUP BY person_id"""


def _trajectory(careers: DataFrame) -> DataFrame:
    """K21 too: six roles at most, each discounted by 1.25 a step."""
    words = T.title_words(F.concat_ws(" ", "title", "company", "description"))
    weight = F.pow(F.lit(0.8), C("position"))
    parts = careers.where("position < 6").select("person_id", (K.role_weight(words) * K.domain_weight(words, ["sales"]) * weight).alias("s"), weight.alias("d"))
    return parts.groupBy("person_id").agg(N.fixed(N.clamp(F.sum("s") / F.sum("d"), 1, 10)).alias("trajectory"))


@query("e08_career_relevance", _CAREER)
def _(f: Frames) -> DataFrame:
    return _trajectory(f.careers)


@query("k22_post_quality", """SELECT event_id, CASE WHEN cat IN ('hiring', 'evaluating_tools') AND c >= 0.5 THEN 'strong' WHEN (cat IN ('pain_signal', 'growth_signal') AND c >= 0.4) OR (cat IN ('hiring', 'evaluating_tools') AND c >= 0.25) THEN 'moderate'
 WHEN (cat = 'general' AND c >= 0.4) OR (c >= 0.3 AND cat <> 'none') THEN 'weak' ELSE 'none' END AS post_quality FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'hiring' WHEN 1 THEN 'evaluating_tools' WHEN 2 THEN 'pain_signal' WHEN 3 THEN 'growth_signal' WHEN 4 THEN 'general' ELSE 'none' END AS cat, least((event_id % 13) / 10.0::DOUBLE, 1) AS c FROM trace_events)""")
def _(f: Frames) -> DataFrame:
    names = F.array(*map(F.lit, ("hiring", "evaluating_tools", "pain_signal", "growth_signal", "general", "none")))
    return f.trace_events.select("event_id", K.post_quality(F.get(names, (C("event_id") % 6).cast("int")), (C("event_id") % 13) / 10.0).alias("post_quality"))


_REWARD = "(qualified * 2.5::DOUBLE + returned * 2 + uniques * 0.04::DOUBLE - rescued * 1.25::DOUBLE - duplicates * 0.08::DOUBLE - units * 0.12::DOUBLE - latency_ms / 1000 * 0.002::DOUBLE) / nullif(outcome_runs, 0) + sqrt(ln((t + 1)::DOUBLE) / nullif(outcome_runs, 0)) * 1.25::DOUBLE"
_COLD = "sqrt(ln((t + 2)::DOUBLE)) * 1.25::DOUBLE"
_ARM_KEY = "concat_ws('|', family, lane, provider)"
#: Every eleventh arm has no outcome yet.
_ARMS = "armed AS (SELECT * REPLACE (CASE WHEN units % 11 = 0 THEN 0 ELSE outcome_runs END AS outcome_runs) FROM arms), n AS (SELECT sum(outcome_runs) AS t FROM armed)"


def armed(f: Frames) -> DataFrame:
    arms = f.arms.withColumn("outcome_runs", F.when(C("units") % 11 == 0, 0).otherwise(C("outcome_runs")))
    return arms.crossJoin(F.broadcast(arms.agg(F.sum("outcome_runs").alias("t"))))


def _drawn_sql(base: str) -> str:
    posterior = f"SELECT *, {_ARM_KEY} AS scope, {POSTERIOR[0]} AS alpha, {POSTERIOR[1]} AS beta FROM {base}"
    return f"drawn AS (SELECT *, {beta_sql('scope', 'alpha', 'beta', duckdb=True)} AS draw, {beta_sql('scope', '1.5::DOUBLE', '1.0::DOUBLE', duckdb=True)} AS first_draw FROM ({posterior}))"


@query("k24_arm_score", f"""WITH {_ARMS}, {_drawn_sql('armed')} SELECT family, lane, provider, {S.fixed(f"CASE WHEN outcome_runs = 0 THEN {_COLD} * 1.15::DOUBLE ELSE {_REWARD} END", 6)} AS score,
 {S.fixed(f"CASE WHEN outcome_runs = 0 THEN {_COLD} * (first_draw * 0.3::DOUBLE + 0.85::DOUBLE) ELSE ({_REWARD}) * 0.65::DOUBLE + draw * 10 * 0.35::DOUBLE END", 6)} AS fused FROM drawn, n""")
def _(f: Frames) -> DataFrame:
    """Without draws, and fused with a draw of the arm's posterior; cold arms too."""
    return P.scored_arms(armed(f), C("t")).select("family", "lane", "provider", N.fixed(C("score"), 6).alias("score"), N.fixed(C("fused"), 6).alias("fused"))


@query("k25_beta_samples", f"WITH {_drawn_sql('arms')} SELECT family, lane, provider, {S.fixed('draw', 9)} AS sample FROM drawn")
def _(f: Frames) -> DataFrame:
    """A Beta draw per arm, seeded by its scope: the same in every run."""
    return P.beta_samples(f.arms).select("family", "lane", "provider", N.fixed(C("sample"), 9).alias("sample"))


#: Which of seven requirements a task covers: none to several.
_COVERS = [f"CASE WHEN {test} THEN 'r{k}' END" for k, test in enumerate(("id % 5 = 0", "id % 7 = 3", "id % 11 = 5", "id % 3 = 1 AND id % 4 = 2", "id % 13 = 7", "id % 17 = 4", "id % 19 IN (2, 3)"))]
_TASK_ARM = "coalesce(a.{0}, 0) AS {0}"
_BY_SCORE = "ORDER BY score DESC, priority, id"


@query("k26_scheduled_tasks", f"""WITH RECURSIVE n AS (SELECT sum(outcome_runs) AS t FROM arms), j AS (SELECT t.id, t.lane, t.priority, t.family, t.preference AS provider, {', '.join(_TASK_ARM.format(c) for c in P.ARM)} FROM tasks t LEFT JOIN arms a ON concat_ws('|', t.family, t.lane, t.preference) = concat_ws('|', a.family, a.lane, a.provider)), {_drawn_sql('j')},
 s AS MATERIALIZED (SELECT id, lane, priority, list_filter([{', '.join(_COVERS)}], lambda x: x IS NOT NULL) AS covers, {S.fixed(f"CASE WHEN outcome_runs = 0 THEN {_COLD} * (first_draw * 0.3::DOUBLE + 0.85::DOUBLE) ELSE ({_REWARD}) * 0.65::DOUBLE + draw * 10 * 0.35::DOUBLE END", 6)} AS score FROM drawn, n),
 w AS (SELECT 0 AS step, (SELECT list(DISTINCT c) FROM (SELECT unnest(covers) AS c FROM s)) AS open, []::BIGINT[] AS ids UNION ALL SELECT step + 1, list_filter(open, lambda x: NOT list_contains(best.covers, x)), list_append(ids, best.id) FROM
 (SELECT step, any_value(open) AS open, any_value(ids) AS ids, arg_max({{'id': id, 'covers': covers}}, (gain, score, -priority, -id)) AS best, max(gain) AS most FROM (SELECT w.*, s.*, len(list_intersect(s.covers, w.open)) AS gain FROM w, s WHERE NOT list_contains(w.ids, s.id)) GROUP BY step) WHERE most > 0),
 c AS (SELECT unnest(ids) AS id FROM (SELECT ids FROM w ORDER BY step DESC LIMIT 1)), g AS (SELECT id FROM s WHERE lane = 'person' AND NOT EXISTS (SELECT 1 FROM s x JOIN c ON c.id = x.id WHERE x.lane = 'person') {_BY_SCORE} LIMIT 1), b AS (SELECT id FROM c UNION SELECT id FROM g),
 r AS (SELECT id FROM (SELECT id, row_number() OVER ({_BY_SCORE}) AS k FROM s WHERE id NOT IN (SELECT id FROM b)) WHERE k <= 8 - (SELECT count(*) FROM b)) SELECT id, CAST(row_number() OVER ({_BY_SCORE}) AS INT) AS priority FROM s WHERE id IN (SELECT id FROM b UNION SELECT id FROM r)""")
def _(f: Frames) -> DataFrame:
    """F5 and F15 too: arms are scored in Spark, set cover and lane guard choose among the best of each class of tasks."""
    covers = F.expr(f"filter(array({', '.join(_COVERS)}), x -> x IS NOT NULL)")
    return P.scheduled(f.tasks.withColumn("covers", covers), f.arms, most=8)


@query("k27_collection_capacity", """SELECT id, CAST(batch AS BIGINT) AS batch_size, CAST(pool AS BIGINT) AS pool_target, CAST(need AS BIGINT) AS required_rounds, CAST(least(greatest(5, need + 1), CASE WHEN t <= 30 THEN 6 WHEN t <= 50 THEN 8 ELSE 10 END) AS BIGINT) AS max_rounds,
 CAST(least(1600, greatest(24, t * 8)) AS BIGINT) AS candidate_ceiling, CAST(least(240, greatest(32, t * 2)) AS BIGINT) AS query_ceiling FROM (SELECT id, t, batch, pool, greatest(1, ceil(pool / batch)) AS need FROM
 (SELECT id, t, least(36, greatest(12, ceil(t * 0.6::DOUBLE))) AS batch, least(240, ceil(t * CASE WHEN t <= 20 THEN 2.0::DOUBLE WHEN t <= 50 THEN 1.75 ELSE 1.5 END)) AS pool FROM (SELECT id, least(200, greatest(1, id % 230)) AS t FROM leads)))""")
def _(f: Frames) -> DataFrame:
    return f.leads.select("id", *[c.cast("long").alias(n) for n, c in K.capacity(C("id") % 230).items()])
