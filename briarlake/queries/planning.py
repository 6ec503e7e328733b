"""Planning over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.plans import briefs as B
from briarlake.registry import Frames, query

C = F.col


@query("m01_decomposition_mode", rf"SELECT doc_id, CASE WHEN regexp_matches(lower(t), '{B.INTENT_WORDS}') OR len(list_filter(string_split(t, ' '), lambda w: w <> '')) > 14 THEN 'dual_stream_intent' ELSE 'single_stream_identity' END AS mode FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def _(f: Frames) -> DataFrame:
    return f.documents.select("doc_id", B.mode_column(C("text")).alias("mode"))


_FAMILY = "coalesce(nullif(family, ''), 'persona_title')"
_LANE = "CASE WHEN lane = 'archetype' THEN 'person' ELSE coalesce(lane, 'person') END"


@query("m08_retrieval_tasks", rf"""WITH r AS (SELECT id, trim(regexp_replace(query, '\s+', ' ', 'g')) AS query, {_FAMILY} AS family, {_LANE} AS lane, preference, priority FROM tasks),
 n AS (SELECT *, coalesce(preference, CASE WHEN lane = 'person' THEN 'tavily' ELSE 'corroborate' END) AS pref, row_number() OVER (PARTITION BY lane, lower(query) ORDER BY priority, id) AS k FROM r) SELECT id, query, family, lane, pref AS preference, CASE WHEN lane = 'signal' THEN 'advanced' ELSE 'basic' END AS depth FROM n WHERE k = 1""")
def _(f: Frames) -> DataFrame:
    return B.retrieval_tasks(f.tasks)


@query("m09_plan_rows", "SELECT id, shape, query FROM tasks, (VALUES ('text'), ('object')) s(shape) WHERE query IS NOT NULL")
def _(f: Frames) -> DataFrame:
    """Each task's query as a string, in an object, as a number and missing: strings and objects become rows, items without a query go."""
    quoted = F.to_json(F.array("query"))
    shapes = {"text": F.substring(quoted, F.lit(2), F.length(quoted) - 2), "object": F.to_json(F.struct("query", "lane")), "number": F.to_json(F.struct(C("id").alias("query"), "lane")), "missing": F.to_json(F.struct("lane"))}
    told = f.tasks.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("shape"), t.alias("item")) for n, t in shapes.items()])).alias("s"))
    parsed = F.parse_json("s.item")
    text = F.coalesce(F.when(F.schema_of_variant(parsed) == "STRING", F.try_variant_get(parsed, "$", "string")), F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.query", "variant")) == "STRING", F.try_variant_get(parsed, "$.query", "string")))
    return told.select("id", "s.shape", text.alias("query")).where("query IS NOT NULL")


@query("m10_spec_from_contract", "SELECT scope, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM requirements GROUP BY scope")
def _(f: Frames) -> DataFrame:
    return f.requirements.groupBy("scope").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


@query("m13_round_refinement", f"SELECT session_id, [{', '.join(f"'{r}'" for r in B.REFINEMENTS)}][least(greatest(age_days, 3) - 2, {len(B.REFINEMENTS)})] AS phrase FROM sessions")
def _(f: Frames) -> DataFrame:
    return f.sessions.select("session_id", B.refinement(C("age_days")).alias("phrase"))
