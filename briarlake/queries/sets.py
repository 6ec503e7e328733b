"""Set operations, retention and expiry on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.functions import text as T
from briarlake.operators import matching as M
from briarlake.queries import sql as S
from briarlake.queries.joins import _KEYS, _keys
from briarlake.registry import Frames, query

C = F.col
_NEWEST = "(SELECT log_id FROM search_logs ORDER BY logged_at DESC, log_id DESC LIMIT 50)"


@query("c14_local_drafts_over_server", "SELECT id, CASE WHEN id % 2 = 0 THEN 'local' ELSE 'server' END AS origin FROM leads")
def _(f: Frames) -> DataFrame:
    """Drafts of the server that no local one replaces, and the local ones."""
    local = f.leads.where("id % 2 = 0").select("id", F.lit("local").alias("origin"))
    return local.unionByName(f.leads.select("id", F.lit("server").alias("origin")).join(local.select(C("id").alias("_id")), C("id") == C("_id"), "left_anti"))


@query("c15_keys_of_stored_leads", f"WITH {_KEYS} SELECT id, k FROM keys WHERE id IN (SELECT id FROM leads WHERE stage <> 'LOST')")
def _(f: Frames) -> DataFrame:
    """Identities go with their lead."""
    stored = f.leads.where("stage <> 'LOST'").select(C("id").alias("_id"))
    return _keys(f).select("id", "k").join(stored, C("id") == C("_id"), "left_semi")


@query("e03_latest_unexpired", "SELECT username, arg_max(cache_id, (created_at, cache_id)) AS cache_id FROM cache WHERE created_at <= TIMESTAMP '1997-06-01' AND expires_at > TIMESTAMP '1997-06-01' GROUP BY username")
def _(f: Frames) -> DataFrame:
    return M.latest(M.valid_at(f.cache, "1997-06-01"), "username", "cache_id")


@query("e12_retained_logs", f"SELECT log_id FROM {_NEWEST}")
def _(f: Frames) -> DataFrame:
    return _newest(f)


def _newest(f: Frames) -> DataFrame:
    return f.search_logs.orderBy(C("logged_at").desc(), C("log_id").desc()).limit(50).select("log_id")


@query("g01_union_of_key_sources", f"SELECT lower(email) AS k FROM leads WHERE coalesce(email, '') <> '' UNION SELECT {S.handle('url')} FROM leads WHERE ({S.handle('url')}) <> ''")
def _(f: Frames) -> DataFrame:
    handle = T.profile_handle(C("url"))
    return f.leads.where("coalesce(email, '') <> ''").select(F.lower("email").alias("k")).unionByName(f.leads.where(handle != "").select(handle.alias("k"))).distinct()


@query("g03_array_union", "SELECT id, array_to_string(list_sort(list_distinct([stage, industry, industry, location, 'merged'])), ',') AS tags FROM leads")
def _(f: Frames) -> DataFrame:
    tags = F.array_union(F.array("stage", "industry"), F.array("industry", "location", F.lit("merged")))
    return f.leads.select("id", F.array_join(F.array_sort(tags), ",").alias("tags"))


@query("g04_except", "SELECT location, title FROM leads EXCEPT SELECT location, title FROM leads WHERE stage = 'LOST'")
def _(f: Frames) -> DataFrame:
    return f.leads.select("location", "title").subtract(f.leads.where("stage = 'LOST'").select("location", "title"))


@query("g06_not_in", f"SELECT log_id FROM search_logs WHERE log_id NOT IN {_NEWEST}")
def _(f: Frames) -> DataFrame:
    """The logs that retention culls."""
    return f.search_logs.select("log_id").join(_newest(f).withColumnRenamed("log_id", "_kept"), C("log_id") == C("_kept"), "left_anti")


@query("i08_expired_entries", "SELECT cache_id FROM cache WHERE expires_at <= TIMESTAMP '1997-06-01'")
def _(f: Frames) -> DataFrame:
    return f.cache.where(C("expires_at") <= F.lit("1997-06-01").cast("timestamp_ntz")).select("cache_id")
