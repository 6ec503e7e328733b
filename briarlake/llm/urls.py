"""URL filters by a temporal list join.

Dated additions to and removals from block lists become validity intervals of
each pattern. Every capture is matched, as of its fetch time, with the entries
that were active then: by exact URL, by host or parent domain, or by a path
prefix.

List entries and captures are brought to one form: small letters in scheme and
host, hosts beyond ASCII in punycode, no final dot or user in a host, no port that
its scheme implies, dot segments resolved, escapes of letters, digits and -._~
decoded and other escapes in capitals, no fragment. A URL that begins with // has
a host but no scheme: domains and prefixes match it, exact URLs only if spelt so.
Prefixes ignore ports and empty path parts.

Defined results: a null or unparsable URL, or a null fetch time, matches
nothing and is not blocked; an entry without a host blocks nothing; repeated
events count once, also when spelt differently; of an addition and a removal at
the same time the removal holds; a second addition does not end the first;
repeated captures each get a row; URLs are compared whole, however long; columns
beside key, URL and fetch time are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briarlake.operators.order import partitions
from briarlake.scratch import Scratch


_AUTHORITY = r"^(?:(?i:https?):)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)"


def ascii_host(name: Column) -> Column:
    """Small letters, no dots at the ends, punycode for labels beyond ASCII; null if nothing is left."""
    plain = F.lower(F.regexp_replace(name, r"^[*.]+|\.+$", ""))
    coded = F.when(plain.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), plain), plain)).otherwise(plain)
    return F.nullif(coded, F.lit(""))


def host(url: Column) -> Column:
    """Host of an http(s) URL without user and port; null if there is none."""
    return ascii_host(F.regexp_extract(url, _AUTHORITY, 1))


def decoded(text: Column) -> Column:
    """Escapes of letters, digits and -._~ become those characters, hex digits of other escapes capitals."""

    def piece(part: Column) -> Column:
        code, rest = F.conv(F.substring(part, 1, 2), 16, 10).cast("int"), F.substring(part, 3, 1 << 30)
        return F.when(~part.rlike(r"^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), part)).when(F.char(code).rlike(r"^[A-Za-z0-9._~-]$"), F.concat(F.char(code), rest)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(part, 1, 2)), rest))

    parts = F.split(text, "%")
    return F.when(F.contains(text, F.lit("%")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), piece), ""))).otherwise(text)


def path(url: Column) -> Column:
    """Path of the URL without query and fragment, dot segments resolved, "/" at least."""
    found = decoded(F.regexp_extract(url, r"^(?:(?i:https?):)?//[^/?#]+([^?#]*)", 1))
    steps = F.split(found, "/")
    step = lambda made, s: F.when(s == ".", made).when(s == "..", F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0)))).otherwise(F.concat(made, F.array(s)))
    plain = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"), step)
    plain = F.when(found.rlike(r"/\.{1,2}$"), F.concat(plain, F.array(F.lit("")))).otherwise(plain)
    return F.when(found == "", F.lit("/")).when(found.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(plain, "/"))).otherwise(found)


def canonical(url: Column) -> Column:
    """The URL in the one form; null if it has no host."""
    scheme, port, query = F.lower(F.regexp_extract(url, r"^(?i:https?:)?", 0)), F.regexp_extract(url, _AUTHORITY + r"(:\d+)?", 2), F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    told = F.when(F.concat(scheme, port).isin("http::80", "https::443"), F.lit("")).otherwise(port)
    return F.concat(scheme, F.lit("//"), host(url), told, path(url), decoded(query))


def entry_pattern(kind: Column, pattern: Column) -> Column:
    """A list entry in the form of `lookups`; prefixes may have a scheme."""
    whole = F.concat(F.lit("//"), F.regexp_replace(pattern, r"^(?:(?i:https?):)?//", ""))
    steps = parts(whole)
    return F.when(kind == "url", canonical(pattern)).when(kind == "domain", ascii_host(pattern)).when((kind == "prefix") & (F.size(steps) > 0), F.concat(host(whole), F.lit("/"), F.array_join(steps, "/")))


def intervals(events: DataFrame) -> DataFrame:
    """(kind, pattern, list_name, valid_from, valid_to) from dated events (kind, pattern, list_name, at, action).

    valid_to is exclusive, null while the entry stands. `kind` is url, domain
    (the host and all below it) or prefix (host and path parts).
    """
    per = Window.partitionBy("kind", "pattern", "list_name").orderBy("at")
    sided = events.select("kind", entry_pattern(F.col("kind"), F.col("pattern")).alias("pattern"), "list_name", "at", "action")
    sided = sided.where("kind IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    once = sided.groupBy("kind", "pattern", "list_name", "at").agg(F.max("action").alias("action"))  # remove > add
    turns = once.withColumn("_was", F.lag("action", 1, "remove").over(per)).where("action <> _was")
    return turns.withColumn("valid_to", F.lead("at").over(per)).where("action = 'add'").select("kind", "pattern", "list_name", F.col("at").alias("valid_from"), "valid_to")


def parts(url: Column) -> Column:
    """Path parts of the URL, without empty ones."""
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def lookups(url: Column, labels: Column, depths: Column) -> Column:
    """Every (kind, pattern) that would block the URL: by domains of `labels` many labels and prefixes of `depths` many parts."""
    own, steps = F.split(host(url), r"\."), parts(url)
    domains = F.transform(F.filter(labels, lambda k: k <= F.size(own)), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(own, -k, k), ".").alias("pattern")))
    prefixes = F.transform(F.filter(depths, lambda k: k <= F.size(steps)), lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(host(url), F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")).alias("pattern")))
    exact = F.array(F.struct(F.lit("url").alias("kind"), canonical(url).alias("pattern")))
    return F.when(host(url).isNotNull(), F.concat(exact, domains, prefixes))


def match_lists(captures: DataFrame, events: DataFrame, scratch: Scratch, key: str = "page_id", url: str = "url", fetched: str = "fetch_ts") -> DataFrame:
    """(key, url, fetched, n_entries, first_list, blocked) for every capture.

    Each distinct (url, fetch time) is looked up once, at the label counts and
    path depths that occur in the list: none is too deep. The intervals are a
    written table: broadcast if small, else AQE splits the partition of a hot
    host. Matches are counted per capture row by a partial aggregation.
    """
    valid = scratch.keep(intervals(events)).withColumnsRenamed({"kind": "_kind", "pattern": "_pattern"})
    own = captures.select(key, url, fetched)
    seen = own.where(F.col(url).isNotNull() & F.col(fetched).isNotNull()).select(F.col(url).alias("_url"), F.col(fetched).alias("_at"))
    seen = scratch.keep(seen.repartition(partitions(captures.sparkSession), "_url", "_at").distinct())  # AQE must not join them into one task: what follows multiplies rows
    in_list = lambda kind, n: F.filter(F.collect_set(F.when(F.col("_kind") == kind, n)), lambda k: k > 0)
    sizes = valid.agg(in_list("domain", F.size(F.split("_pattern", r"\."))).alias("_labels"), in_list("prefix", F.size(F.split("_pattern", "/")) - 1).alias("_depths"))
    asked = seen.crossJoin(F.broadcast(sizes)).select("_url", "_at", F.explode(lookups(F.col("_url"), F.col("_labels"), F.col("_depths"))).alias("_ask")).select("_url", "_at", "_ask.kind", "_ask.pattern")
    active = (F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    hits = asked.join(valid, (F.col("kind") == F.col("_kind")) & (F.col("pattern") == F.col("_pattern")) & active)
    hits = scratch.keep(hits.groupBy("_url", "_at").agg(F.count("*").alias("_n"), F.min("list_name").alias("first_list")))
    out = own.join(hits, (F.col(url) == F.col("_url")) & (F.col(fetched) == F.col("_at")), "left")
    return out.select(key, url, fetched, F.coalesce("_n", F.lit(0)).cast("long").alias("n_entries"), "first_list", F.col("_n").isNotNull().alias("blocked"))


def stand_in_fetch_time(key: Column) -> Column:
    """The test pages have no fetch time: a day of 2024 and 2025 by page id."""
    return F.timestamp_seconds(F.lit(1704067200) + F.pmod(key * 37, F.lit(730)) * 86400)


def stand_in_events(pages: DataFrame) -> DataFrame:
    """The test tables have no block list: dated entries for the pages' own hosts, URLs and path prefixes, by the pattern's MD5.

    A third of the patterns are listed at some day; half of these are taken off
    later and half of those listed again. One farm is listed all the time, one
    domain for a month. Prefixes are the first half of a path, one part at least.
    """
    url = F.col("url")
    half = F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts(url), 1, F.greatest(F.lit(1), F.floor(F.size(parts(url)) / 2).cast("int"))), "/"))
    made = {("domain", "hosts"): host(url), ("url", "urls"): canonical(url), ("prefix", "paths"): F.when(F.size(parts(url)) > 0, half)}
    listed = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("list_name"), p.alias("pattern")) for (k, n), p in made.items()])
    found = pages.select(F.explode(listed).alias("p")).select("p.*").where("pattern IS NOT NULL").distinct()
    nibble = lambda k: F.conv(F.substring(F.md5("pattern"), k, 1), 16, 10).cast("int")
    day = lambda n: F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    first = nibble(2) * 16 + nibble(3)
    event = lambda at, action, when: F.when(when, F.struct(at.alias("at"), F.lit(action).alias("action")))
    turns = F.array(event(day(first), "add", nibble(1) < 5), event(day(first + 200), "remove", (nibble(1) < 5) & (nibble(4) < 8)), event(day(first + 300), "add", (nibble(1) < 5) & (nibble(4) < 4)))
    dated = found.select("kind", "pattern", "list_name", F.explode(F.filter(turns, lambda t: t.isNotNull())).alias("e")).select("kind", "pattern", "list_name", "e.at", "e.action")
    fixed = found.sparkSession.createDataFrame([("domain", "spam-farm.example.org", "farms", 0, "add"), ("domain", "example.net", "zones", 600, "add"), ("domain", "example.net", "zones", 630, "remove")], "kind string, pattern string, list_name string, d int, action string")
    return dated.unionByName(fixed.select("kind", "pattern", "list_name", day(F.col("d")).alias("at"), "action"))


#: The same in DuckDB for the stand-ins; `pages` has page_id and url.
SQL = r"""
WITH split AS (
  SELECT page_id, url, make_timestamp((1704067200 + ((page_id * 37) % 730) * 86400)::BIGINT * 1000000) AS fetch_ts,
         rtrim(lower(regexp_extract(url, '^(?:[hH][tT]{2}[pP][sS]?:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
         lower(regexp_extract(url, '^([hH][tT]{2}[pP][sS]?:)?//', 1)) AS scheme, regexp_extract(url, '^(?:[hH][tT]{2}[pP][sS]?:)?//(?:[^/?#@]*@)?[^/?#:@]+(:\d+)', 1) AS port,
         list_transform(['/' || regexp_extract(url, '^(?:[hH][tT]{2}[pP][sS]?:)?//[^/?#]+/?([^?#]*)', 1), regexp_extract(url, '^[^?#]*(\?[^#]*)', 1)], lambda t:
           array_to_string(list_transform(string_split(t, '%'), lambda p, k: CASE WHEN k = 1 THEN p WHEN NOT regexp_matches(p, '^[0-9A-Fa-f]{2}') THEN '%' || p
             WHEN regexp_matches(chr(('0x' || p[1:2])::INT), '^[A-Za-z0-9._~-]$') THEN chr(('0x' || p[1:2])::INT) || p[3:] ELSE '%' || upper(p[1:2]) || p[3:] END), '')) AS told
  FROM pages
), resolved AS (
  SELECT *, list_reduce(list_transform(string_split(told[1], '/'), lambda p: [p]), lambda made, p: CASE p[1] WHEN '.' THEN made WHEN '..' THEN made[1:greatest(1, len(made) - 1)] ELSE made || p END)
    || CASE WHEN regexp_matches(told[1], '/\.{1,2}$') THEN [''] ELSE [] END AS steps FROM split
), parted AS (
  SELECT page_id, url, fetch_ts, host, list_filter(steps, lambda p: p <> '') AS parts,
         scheme || '//' || host || CASE WHEN scheme || port IN ('http::80', 'https::443') THEN '' ELSE port END || array_to_string(steps, '/') || told[2] AS canonical
  FROM resolved
), captures AS (
  SELECT *, host || '/' || array_to_string(parts, '/') || '/' AS whole, host || '/' || array_to_string(parts[1:greatest(1, len(parts) // 2)], '/') AS half FROM parted
), patterns AS (
  SELECT 'domain' AS kind, 'hosts' AS list_name, host AS pattern FROM captures WHERE host <> ''
  UNION SELECT 'url', 'urls', canonical FROM captures WHERE host <> ''
  UNION SELECT 'prefix', 'paths', half FROM captures WHERE host <> '' AND len(parts) > 0
), coded AS (
  SELECT *, ('0x' || md5(pattern)[1])::INT AS n1, ('0x' || md5(pattern)[2])::INT * 16 + ('0x' || md5(pattern)[3])::INT AS f, ('0x' || md5(pattern)[4])::INT AS n4 FROM patterns
), events AS (
  SELECT kind, list_name, pattern, f AS d, 'add' AS action FROM coded WHERE n1 < 5
  UNION ALL SELECT kind, list_name, pattern, f + 200, 'remove' FROM coded WHERE n1 < 5 AND n4 < 8
  UNION ALL SELECT kind, list_name, pattern, f + 300, 'add' FROM coded WHERE n1 < 5 AND n4 < 4
  UNION ALL VALUES ('domain', 'farms', 'spam-farm.example.org', 0, 'add'), ('domain', 'zones', 'example.net', 600, 'add'), ('domain', 'zones', 'example.net', 630, 'remove')
), valid AS (
  SELECT * FROM (SELECT *, lead(d) OVER (PARTITION BY kind, list_name, pattern ORDER BY d) AS until FROM events) WHERE action = 'add'
), hits AS (
  SELECT c.page_id, count(*) AS n, min(v.list_name) AS first_list
  FROM captures c JOIN valid v ON c.host <> '' AND ((v.kind = 'domain' AND (c.host = v.pattern OR ends_with(c.host, '.' || v.pattern))) OR (v.kind = 'url' AND c.canonical = v.pattern) OR (v.kind = 'prefix' AND starts_with(c.whole, v.pattern || '/')))
   AND c.fetch_ts >= make_timestamp((1704067200 + v.d * 86400)::BIGINT * 1000000) AND (v.until IS NULL OR c.fetch_ts < make_timestamp((1704067200 + v.until * 86400)::BIGINT * 1000000))
  GROUP BY c.page_id
)
SELECT page_id, url, fetch_ts, coalesce(n, 0) AS n_entries, first_list, n IS NOT NULL AS blocked FROM captures LEFT JOIN hits USING (page_id)
"""
