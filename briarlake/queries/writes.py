"""Writes, transactions and resilience."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.functions import text as T
from briarlake.operators import records as R
from briarlake.operators import store as W
from briarlake.operators import upserts as U
from briarlake.operators.versions import Tables, VersionedStore
from briarlake.queries import sql as S
from briarlake.registry import Frames, query
from briarlake.scratch import Scratch

C = F.col
_IDENTITY = f"nullif({S.identity('url')}, '')"
_STORED = f"stored AS (SELECT id, revision, {_IDENTITY} AS identity, stage AS value FROM leads WHERE id % 3 <> 0)"
#: Even ids come in, a seventh of them stale; later each tenth moves to a shared identity or to none, and each fifth comes again without asking for a revision.
_INCOMING = f"""incoming AS (SELECT 2 * id AS seq, id, CASE WHEN id % 7 = 0 THEN revision + 1 ELSE revision END AS revision, {_IDENTITY} AS identity, 'NURTURE' AS value FROM leads WHERE id % 2 = 0
 UNION ALL SELECT 2 * id + 41, id, NULL, CASE WHEN id % 4 <> 0 THEN 'linkedin:moved-' || id % 50 END, 'REPLIED' FROM leads WHERE id % 10 = 0 UNION ALL SELECT 2 * id + 103, id, NULL, {_IDENTITY}, 'LOST' FROM leads WHERE id % 5 = 1)"""


def _upsert_sql(missing: str = "false") -> str:
    """The batch row by row: `s` is the store, a list of leads with the identity that each holds."""
    return f"""WITH RECURSIVE {_STORED}, {_INCOMING}, h AS (SELECT identity, min(id) AS holder FROM stored WHERE identity IS NOT NULL GROUP BY 1), r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM incoming),
 w AS (SELECT 0::BIGINT AS n, 0::BIGINT AS seq, 0::BIGINT AS id, '' AS disposition, NULL::BIGINT AS holder, list({{'id': id, 'rev': revision, 'key': CASE WHEN holder = id THEN stored.identity END}}) AS s FROM stored LEFT JOIN h ON h.identity = stored.identity UNION ALL
 SELECT n, seq, id, disposition, CASE WHEN disposition = 'duplicate' THEN owner END, CASE WHEN disposition IN ('created', 'updated') THEN list_append(list_filter(s, lambda x: x.id <> id), {{'id': id, 'rev': coalesce(cur.rev, 0) + 1, 'key': identity}}) ELSE s END FROM
 (SELECT *, CASE WHEN {missing} AND cur IS NULL THEN 'missing' WHEN owner IS NOT NULL AND owner <> id THEN 'duplicate' WHEN cur IS NOT NULL AND revision IS NOT NULL AND revision <> cur.rev THEN 'conflict' WHEN cur IS NULL THEN 'created' ELSE 'updated' END AS disposition FROM
 (SELECT r.*, w.s, list_filter(w.s, lambda x: x.id = r.id)[1] AS cur, list_filter(w.s, lambda x: x.key = r.identity)[1].id AS owner FROM w JOIN r ON r.n = w.n + 1)))"""


def _batch(f: Frames) -> tuple[DataFrame, DataFrame]:
    """What is stored and what comes in."""
    rows = f.leads.select("id", "revision", F.nullif(T.profile_identity(C("url")), F.lit("")).alias("identity"), C("stage").alias("value"))
    row = lambda seq, revision, identity, value: [seq.alias("seq"), "id", revision.cast("long").alias("revision"), identity.alias("identity"), F.lit(value).alias("value")]
    expected = F.when(C("id") % 7 == 0, C("revision") + 1).otherwise(C("revision"))
    moved = F.when(C("id") % 4 != 0, F.concat(F.lit("linkedin:moved-"), (C("id") % 50).cast("string")))
    first = rows.where("id % 2 = 0").select(*row(C("id") * 2, expected, C("identity"), "NURTURE"))
    second = rows.where("id % 10 = 0").select(*row(C("id") * 2 + 41, F.lit(None), moved, "REPLIED"))
    third = rows.where("id % 5 = 1").select(*row(C("id") * 2 + 103, F.lit(None), C("identity"), "LOST"))
    return rows.where("id % 3 <> 0"), first.unionByName(second).unionByName(third)


def upserted(f: Frames, **how: bool) -> DataFrame:
    return U.bulk_upsert(*_batch(f), Scratch(f.spark, "upsert"), **how)[0]


@query("l01_optimistic_upsert", f"{_upsert_sql()} SELECT seq, id, disposition, holder FROM w WHERE n > 0")
def _(f: Frames) -> DataFrame:
    """What becomes of each row of a batch that is taken row by row: revisions, identity guard, release of identities."""
    return upserted(f)


@query("a18_existing_only", f"{_upsert_sql('true')} SELECT seq, id, disposition, holder FROM w WHERE n > 0")
def _(f: Frames) -> DataFrame:
    """A36 too: the batch where every lead must be stored already."""
    return upserted(f, require_existing=True)


@query("a19_bulk_upsert", f"""{_upsert_sql()}, done AS (SELECT id, count(*) AS n, arg_max(seq, seq) AS seq FROM w WHERE disposition IN ('created', 'updated') GROUP BY id), new AS (SELECT done.id, done.n, incoming.identity, incoming.value FROM done JOIN incoming ON incoming.seq = done.seq)
 SELECT coalesce(s.id, new.id) AS id, coalesce(s.revision, 0) + coalesce(new.n, 0) AS revision, CASE WHEN new.id IS NULL THEN s.identity ELSE new.identity END AS identity, coalesce(new.value, s.value) AS value FROM stored s FULL JOIN new ON new.id = s.id""")
def _(f: Frames) -> DataFrame:
    """The table after the batch, committed as a new version and read back."""
    scratch = Scratch(f.spark, "bulk")
    store = VersionedStore(f.spark, f"{scratch.base}/store")
    stored, incoming = _batch(f)
    store.commit({"leads": stored})

    def written(tables: Tables) -> Tables:
        leads = U.bulk_upsert(tables["leads"], incoming, scratch)[1]
        return {"leads": U.written_leads(tables["leads"], incoming, leads, ["value"])}

    store.update(written)
    return store.read("leads")


@query("a20_replace_all", f"WITH o AS (SELECT id, revision, stage, {_IDENTITY} AS identity FROM leads) SELECT id, CASE WHEN revision > 0 THEN revision ELSE 1 END AS revision, stage, CASE WHEN identity IS NOT NULL THEN min(id) OVER (PARTITION BY identity) END AS owner, coalesce(id <> CASE WHEN identity IS NOT NULL THEN min(id) OVER (PARTITION BY identity) END, false) AS in_conflict FROM o")
def _(f: Frames) -> DataFrame:
    """All leads replace what was stored: three tables in one commit, read back."""
    leads = f.leads.select("id", "revision", "stage", F.nullif(T.profile_identity(C("url")), F.lit("")).alias("identity"))
    store = VersionedStore(f.spark, f"{Scratch(f.spark, 'replace').base}/store")
    store.commit(W.replaced(leads.where("id % 2 = 0")))
    store.update(lambda _: W.replaced(leads))
    owners = store.read("identities").select(C("identity").alias("k"), C("lead_id").alias("owner"))
    conflicts = store.read("conflicts").select(C("duplicate_id").alias("d"))
    joined = store.read("leads").join(owners, C("identity") == C("k"), "left").join(conflicts, C("id") == C("d"), "left")
    return joined.select("id", "revision", "stage", "owner", C("d").isNotNull().alias("in_conflict"))


_ROUND = "CAST(json_extract_string(checkpoint_json, '$.round') AS BIGINT)"


@query("a23_checkpoint_round_trip", f"SELECT session_id, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status, {_ROUND} + CASE WHEN status = 'running' THEN 1 ELSE 0 END AS round, {_ROUND} AS round_before FROM sessions")
def _(f: Frames) -> DataFrame:
    """Checkpoints are stored, running sessions advance a round and are stored again; both versions are read back."""
    round_ = F.get_json_object("checkpoint_json", "$.round").cast("long")
    store = VersionedStore(f.spark, f"{Scratch(f.spark, 'checkpoints').base}/store")
    first = store.commit({"sessions": f.sessions.select("session_id", "status", "checkpoint_json")})

    def advanced(tables: Tables) -> Tables:
        running = C("status") == "running"
        checkpoint = F.when(running & round_.isNotNull(), F.to_json(F.struct((round_ + 1).alias("round")))).otherwise(C("checkpoint_json"))
        return {"sessions": tables["sessions"].select("session_id", F.when(running, "interrupted").otherwise(C("status")).alias("status"), checkpoint.alias("checkpoint_json"))}

    second = store.update(advanced)
    before = store.read("sessions", first).select(C("session_id").alias("sid"), round_.alias("round_before"))
    return store.read("sessions", second).join(before, C("session_id") == C("sid")).select("session_id", "status", round_.alias("round"), "round_before")


@query("l03_stage_audit", "SELECT id, stage AS from_stage, 'LOST' AS to_stage FROM leads WHERE id % 5 = 0 AND stage <> 'LOST'")
def _(f: Frames) -> DataFrame:
    after = f.leads.withColumn("stage", F.when(C("id") % 5 == 0, "LOST").otherwise(C("stage")))
    return W.stage_changes(f.leads, after)


@query("l04_session_upsert", "SELECT session_id, CASE WHEN session_id % 4 = 1 THEN 'running' ELSE status END AS status, CASE WHEN session_id % 8 = 1 THEN 'new' ELSE checkpoint_json END AS checkpoint_json FROM sessions")
def _(f: Frames) -> DataFrame:
    """Stored sessions meet a batch of updates in a new version, which is read back."""
    updates = f.sessions.where("session_id % 4 = 1").select("session_id", F.lit("running").alias("status"), F.when(C("session_id") % 8 == 1, "new").alias("checkpoint_json"))
    store = VersionedStore(f.spark, f"{Scratch(f.spark, 'sessions').base}/store")
    store.commit({"sessions": f.sessions})
    store.update(lambda tables: {"sessions": W.merged_sessions(tables["sessions"], updates)})
    return store.read("sessions")


_MESSAGES = (
    "HTTP 401 from target", "Quota used up", "zone x not found", "status 400: bad", "socket hang up", "request timed out", "captcha shown", "odd failure", "MCP error -32602: bad arguments", "mcp error -32000: gone", "Unexpected non-JSON response for search.",
    "Unexpected non-JSON response for search. Response snippet: <html>", "This query recently failed and cannot be attempted at this time. Try after a minimum of 15 seconds.", "repeat_query_rejected", "HTTP 502 Bad Gateway", "status: 429 after a 401", "answer 403", "fetch failed with 404", "SSE stream disconnected",
)


def messages() -> F.Column:
    return F.get(F.array(*map(F.lit, _MESSAGES)), (C("event_id") % len(_MESSAGES)).cast("int"))


_MESSAGE_SQL = f"CASE event_id % {len(_MESSAGES)} {' '.join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_MESSAGES))} END || CASE WHEN event_id % 3 = 0 THEN ' (' || operation || ')' ELSE '' END"
_MATCHES = [f"({f'status IN ({S.quoted(tuple(map(str, codes)))}) OR ' if codes else ''}regexp_matches(lower(message), '{p}'))" for _, _, codes, p in W.FAILURES]
_KIND = f"CASE {' '.join(f"WHEN {m} THEN '{f[0]}'" for m, f in zip(_MATCHES, W.FAILURES))} ELSE 'unknown' END"
_AGAIN = f"CASE {' '.join(f'WHEN {m} THEN {str(f[1]).lower()}' for m, f in zip(_MATCHES, W.FAILURES))} ELSE false END"


@query("l05_key_states", "SELECT provider, session_id, CASE WHEN count(*) FILTER (WHERE status = 'error') >= 3 THEN 'cooldown' WHEN count(*) FILTER (WHERE status = 'skipped') > 2 THEN 'exhausted' ELSE 'active' END AS state FROM trace_events WHERE provider IS NOT NULL GROUP BY provider, session_id")
def _(f: Frames) -> DataFrame:
    state = F.when(F.count_if(C("status") == "error") >= 3, "cooldown").when(F.count_if(C("status") == "skipped") > 2, "exhausted").otherwise("active")
    return f.trace_events.where("provider IS NOT NULL").groupBy("provider", "session_id").agg(state.alias("state"))


@query("l06_failure_classes", rf"""WITH m AS (SELECT event_id, {_MESSAGE_SQL} AS message FROM trace_events), s AS (SELECT *, coalesce(nullif(regexp_extract(message, '(?i)\b(?:http|status)\s*:?\s*(\d{{3}})\b', 1), ''), regexp_extract(message, '\b(4\d{{2}}|5\d{{2}})\b', 1)) AS status FROM m),
 k AS (SELECT *, {_KIND} AS failure, {_AGAIN} AS retryable FROM s) SELECT event_id, failure, retryable, failure IN ('provider_auth', 'provider_quota', 'provider_config') AS disables, failure = 'target_transient' AND contains(lower(message), 'unexpected non-json response') AND NOT contains(lower(message), 'response snippet') AS empty_body,
 CASE WHEN failure = 'transport_transient' THEN 5000.0::DOUBLE ELSE 750 END * power(2.0::DOUBLE, event_id % 3) AS delay_ms FROM k""")
def _(f: Frames) -> DataFrame:
    """L11 too: reason, whether to retry, whether the provider is done for, whether only the body was empty."""
    message = F.concat(messages(), F.when(C("event_id") % 3 == 0, F.concat(F.lit(" ("), C("operation"), F.lit(")"))).otherwise(""))
    kind = W.failure_class(C("message"))
    told = f.trace_events.select("event_id", message.alias("message"))
    return told.select("event_id", kind.alias("failure"), W.retryable(C("message")).alias("retryable"), W.disables_provider(kind).alias("disables"), W.empty_body(C("message")).alias("empty_body"), W.backoff_ms(kind, C("event_id") % 3 + 1).alias("delay_ms"))


@query("d22_dispositions", f"""{_upsert_sql()} SELECT CAST(count(*) FILTER (WHERE disposition = 'created') AS BIGINT) AS created, CAST(count(*) FILTER (WHERE disposition = 'updated') AS BIGINT) AS updated,
 CAST(count(*) FILTER (WHERE disposition = 'duplicate') AS BIGINT) AS duplicates, CAST(count(*) FILTER (WHERE disposition = 'conflict') AS BIGINT) AS conflicts FROM w WHERE n > 0""")
def _(f: Frames) -> DataFrame:
    """What an upsert did with its batch."""
    kind = C("disposition")
    return upserted(f).agg(F.count_if(kind == "created").alias("created"), F.count_if(kind == "updated").alias("updated"), F.count_if(kind == "duplicate").alias("duplicates"), F.count_if(kind == "conflict").alias("conflicts"))


#: Each lead of an id that ends in 5 asks to take in the next one; a seventh of them with a stale revision.
_MERGE = f"""s AS (SELECT id, revision, nullif({S.identity('url')}, '') AS identity, company, email, stage FROM leads), h AS (SELECT identity, min(id) AS holder FROM s WHERE identity IS NOT NULL GROUP BY 1),
 p AS (SELECT w.id AS winner, l.id AS loser FROM s w JOIN s l ON l.id = w.id + 1 LEFT JOIN h ON h.identity = w.identity WHERE w.id % 10 = 5 AND w.id % 7 <> 0 AND coalesce(h.holder = w.id, true))"""


def merges(f: Frames) -> tuple[DataFrame, DataFrame]:
    leads = f.leads.select("id", "revision", F.nullif(T.profile_identity(C("url")), F.lit("")).alias("identity"), "company", "email", F.array("stage").alias("tags"))
    asked = f.leads.where("id % 10 = 5").select(C("id").alias("winner"), (C("id") + 1).alias("loser"), (C("revision") + F.when(C("id") % 7 == 0, 1).otherwise(0)).alias("revision"))
    return leads, W.mergeable(leads, asked)


@query("l02_merge_leads", f"""WITH {_MERGE} SELECT s.id, s.revision + CASE WHEN p.winner IS NULL THEN 0 ELSE 1 END AS revision, CASE WHEN p.winner IS NULL THEN s.company ELSE coalesce(nullif(s.company, ''), l.company) END AS company,
 CASE WHEN p.winner IS NULL THEN s.email ELSE coalesce(nullif(s.email, ''), l.email) END AS email, CASE WHEN l.stage IS NULL OR l.stage = s.stage THEN s.stage ELSE s.stage || ',' || l.stage END AS tags, p.loser AS merged_from
 FROM s LEFT JOIN p ON p.winner = s.id LEFT JOIN s l ON l.id = p.loser WHERE s.id NOT IN (SELECT loser FROM p)""")
def _(f: Frames) -> DataFrame:
    """The result table of a batch of merges, with revision guard; merged_from is the activity log's entry."""
    leads, pairs = merges(f)
    return W.merged_leads(leads, pairs).withColumn("tags", F.array_join("tags", ","))


@query("l12_identity_transfer", f"WITH {_MERGE} SELECT DISTINCT coalesce(p.winner, leads.id) AS id, lower(leads.email) AS k FROM leads LEFT JOIN p ON p.loser = leads.id WHERE coalesce(leads.email, '') <> ''")
def _(f: Frames) -> DataFrame:
    """The identities of merged leads go to their winners."""
    keys = f.leads.where("coalesce(email, '') <> ''").select("id", F.lower("email").alias("k"))
    return W.identities_moved(keys, merges(f)[1])


@query("i07_orphan_sweep", "SELECT session_id, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status FROM sessions")
def _(f: Frames) -> DataFrame:
    return W.orphans_interrupted(f.sessions).select("session_id", "status")


@query("a06_additive_columns", "SELECT id, stage, 0 AS score_version FROM leads")
def _(f: Frames) -> DataFrame:
    """The table's columns are looked at; only the missing one is added."""
    leads = f.leads.select("id", "stage")
    return W.with_column_if_missing(W.with_column_if_missing(leads, "score_version", "int", 0), "stage", "string")


#: Forward steps: a column, a backfill from another, a default for odd values, a promoted column, a dropped one.
_STEPS = [
    lambda d: W.with_column_if_missing(d, "score_version", "int", 0),
    lambda d: d.withColumn("contact", F.lower(F.trim(C("email")))),
    lambda d: d.withColumn("review_status", R.in_domain(C("review_status"), R.REVIEW_STATUSES, "UNREVIEWED")),
    lambda d: d.withColumn("score", F.coalesce("qualification", "predictive", "composite")),
    lambda d: d.drop("email", "qualification", "predictive", "composite"),
]


def _migrated(f: Frames) -> W.Migrations:
    store = W.Migrations(f.spark, f"{Scratch(f.spark, 'migrations').base}/leads", _STEPS)
    store.create(f.leads.select("id", "stage", "email", "review_status", "qualification", "predictive", "composite"))
    store.run()
    store.run()  # nothing is left to do
    return store


@query("a07_migration_runner", f"SELECT id, stage, CASE WHEN review_status IN ({S.quoted(R.REVIEW_STATUSES)}) THEN review_status ELSE 'UNREVIEWED' END AS review_status, 0 AS score_version, lower(trim(email)) AS contact, coalesce(qualification, predictive, composite) AS score FROM leads")
def _(f: Frames) -> DataFrame:
    return _migrated(f).table()


@query("a08_migration_snapshot", "SELECT id, stage, email, review_status, qualification, predictive, composite FROM leads")
def _(f: Frames) -> DataFrame:
    """The table as it was before the run."""
    return _migrated(f).snapshot(0)
