"""Filters and projections of lead records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briarlake.functions import text as T
from briarlake.operators.order import partitions, ranked
from briarlake.scratch import Scratch

# Fixed values.
STAGES = ("SCRAPED", "ENRICHED", "SEQUENCE ACTIVE", "REPLIED", "MEETING BOOKED", "NEGOTIATING", "CONVERTED", "LOST", "NURTURE")
REVIEW_STATUSES = ("UNREVIEWED", "KEEP", "MAYBE", "REJECT")
NEXT_ACTIONS = ("NONE", "OPEN_LINKEDIN", "RESEARCH", "CONNECT", "MESSAGE")
HEADER_ALIASES = {"full_name": ("full name", "fullname", "name"), "company": ("company", "organization"), "title": ("title", "role", "position"), "id": ("id",)}


def filtered(leads: DataFrame, equals: dict[str, str]) -> DataFrame:
    """Equality filters; an empty value or "All" filters nothing."""
    for column, value in equals.items():
        if value and value != "All":
            leads = leads.where(F.col(column) == value)
    return leads


def searched(leads: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring in any column; % and _ in the text stay wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).like(f"%{text.lower()}%"), F.lit(False))
    return leads.where(hit) if text else leads


def lead_page(leads: DataFrame, equals: dict[str, str], text: str, columns: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of matching leads, newest first, with the total before paging."""
    found = searched(filtered(leads, equals), text, columns)
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(F.col("created_at").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), "id").offset(offset).limit(min(max(limit, 1), 2000))
    return page.crossJoin(F.broadcast(total))


def readable_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows whose JSON parses under the schema; the others are dropped."""
    good = F.try_parse_json(F.col(column)).isNotNull()
    return rows.where(good).withColumn(column, F.from_json(column, schema))


def serp_rows(pages: DataFrame, body: str) -> DataFrame:
    """One row per result with title and URL from either list of the body."""
    item = "array<struct<title:string,link:string,url:string,description:string>>"
    parsed = F.from_json(body, f"organic {item}, results {item}")
    rows = pages.withColumn("_r", F.explode(F.coalesce(parsed["organic"], parsed["results"])))
    return rows.select("*", F.col("_r.title").alias("title"), F.coalesce("_r.link", "_r.url").alias("url"), F.col("_r.description").alias("content")).where("title IS NOT NULL AND url IS NOT NULL").drop("_r", body)


def chunked(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Numbers chunks of `size` rows in order, nulls last, by ranks over range partitions."""
    placed = ranked(rows, [], [F.col(c).asc_nulls_last() for c in order], Scratch(rows.sparkSession, "chunks"), "chunk")
    return placed.withColumn("chunk", F.floor(F.col("chunk") / size))


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """The first column whose name contains an alias, for each field."""
    out = {}
    for field, aliases in HEADER_ALIASES.items():
        for c in columns:
            if c not in out.values() and any(a in c.lower() for a in aliases):
                out[field] = c
                break
    return out


def imported(raw: DataFrame) -> DataFrame:
    """Leads of a table with free headers; rows without a name are dropped, other gaps get defaults."""
    head = resolve_headers(raw.columns)
    filled = lambda field, default: F.coalesce(T.blank_as_null(F.col(f"`{head[field]}`")), F.lit(default)) if field in head else F.lit(default)
    rows = raw.select(F.col(f"`{head['id']}`").alias("id"), F.trim(F.col(f"`{head['full_name']}`")).alias("full_name"), filled("company", "Independent").alias("company"), filled("title", "Professional").alias("title"), F.lit("Tech").alias("industry"))
    return rows.where("full_name <> ''")


def unexpired(cache: DataFrame, now: str) -> DataFrame:
    return cache.where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))


def upsert_keep_newest(stored: DataFrame, incoming: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """Incoming rows replace stored ones of their key; the newest `most` stay."""
    old = stored.join(incoming.select(F.col(key).alias("_new")), F.col(key) == F.col("_new"), "left_anti")
    return old.unionByName(incoming).orderBy(F.col(at).desc(), F.col(key).desc()).limit(most)


def promoted(leads: DataFrame) -> DataFrame:
    """Scalar columns for filtering, each the first filled of its fallbacks."""
    return leads.select(
        "id", T.first_filled(F.col("full_name")).alias("full_name"), T.first_filled(F.col("company")).alias("company"), T.first_filled(F.col("title"), F.col("headline")).alias("title"),
        F.coalesce(T.blank_as_null(F.col("stage")), F.lit("NEW")).alias("stage"), F.coalesce("qualification", "predictive", "composite").alias("score"), F.lower(T.first_filled(F.col("email"))).alias("email"),
    )


def without_legacy(leads: DataFrame) -> DataFrame:
    """Usable old addresses move to the contact; legacy fields go."""
    mail, old = F.col("profile.contact.email"), F.col("profile.emailDiscovery.bestEmail")
    usable = lambda c: F.lower(F.trim(T.text(c))).rlike(T.USABLE_EMAIL)
    best = F.when(usable(mail), F.lower(F.trim(mail))).when(usable(old), F.lower(F.trim(old))).otherwise(mail)
    contact = F.col("profile.contact").withField("email", best).dropFields("emailStatus", "emailConfidence")
    return leads.withColumn("profile", F.col("profile").withField("contact", contact).dropFields("emailDiscovery"))


def in_domain(c: Column, domain: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*domain), c).otherwise(F.lit(default))


def first_reason(*tests: tuple[str, Column]) -> Column:
    """The name of the first test that holds, else null."""
    return F.coalesce(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests])


def without_excluded(leads: DataFrame, columns: list[str], excluded: DataFrame, key: str) -> DataFrame:
    """Leads none of whose normalised fields is excluded."""
    keys = leads.select(F.col(key).alias("_id"), F.explode(F.array(*[T.dedupe_value(F.col(c)) for c in columns])).alias("_k"))
    hit = keys.join(excluded, F.col("_k") == F.col("excluded")).select("_id").distinct()
    return leads.join(hit, F.col(key) == F.col("_id"), "left_anti")


def every_pair(left: DataFrame, key: str, right: DataFrame, salts: int) -> DataFrame:
    """Each row of `left` with each of `right`, as an equi-join over `salts` parts of the left rows: no nested loop, no hot part."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, F.col("_salt") == F.col("_part")).drop("_salt", "_part")


def substring_hits(rows: DataFrame, key: str, body: Column, terms: DataFrame, term: str) -> DataFrame:
    """(key, term) for each distinct term that the text contains, through an index of the terms' first three characters.

    Texts give their distinct runs of that length, which meet the terms by
    equality; what meets is checked in full. Terms of one or two characters are
    indexed whole, an empty one is in every text.
    """
    known = terms.select(F.col(term).alias("_term")).where("_term IS NOT NULL").distinct().withColumn("_gram", F.substring("_term", 1, 3))
    lengths = [r[0] for r in known.select(F.length("_gram")).distinct().collect()]  # 0 to 3
    texts = rows.select(F.col(key).alias("_key"), body.alias("_body"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length("_body") - (n - 1)), lambda k: F.substr(F.col("_body"), k, F.lit(n))) if n else F.array(F.lit(""))
    grams = F.flatten(F.array(*[F.when(F.length("_body") >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in lengths])) if lengths else F.array().cast("array<string>")
    met = texts.select("_key", F.explode(F.array_distinct(grams)).alias("_run")).join(known, F.col("_run") == F.col("_gram")).select(F.col("_key").alias("_met"), "_term")
    return met.join(texts, F.col("_met") == F.col("_key")).where(F.col("_body").contains(F.col("_term"))).select(F.col("_met").alias(key), F.col("_term").alias(term))


def whole_term_hits(rows: DataFrame, key: str, field: Column, terms: DataFrame, term: str, scope: str | None = None) -> DataFrame:
    """(key, term, and scope if given) for each distinct term that stands in the text as whole words; both reduced to letters and digits.

    `field` is the text, or with `scope` an array of (scope, text) of which a
    term sees its own. Texts give their runs of as many words as terms have,
    which meet the terms by equality.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(T.text(c)), "[^a-z0-9]+", " "))
    columns = [term] + ([scope] if scope else [])
    known = terms.select(*columns).distinct().withColumn("_words", norm(F.col(term))).where("_words <> ''")
    sizes = [r[0] for r in known.select(F.size(F.split("_words", " "))).distinct().collect()]  # of the terms' lengths in words
    parts = F.array(F.struct(F.lit(None).cast("string").alias("scope"), field.alias("text"))) if scope is None else field
    texts = rows.select(F.col(key).alias("_key"), F.explode(parts).alias("_p")).select("_key", F.col("_p.scope").alias("_scope"), F.split(norm(F.col("_p.text")), " ").alias("_w"))
    runs = lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - (n - 1)), lambda k: F.array_join(F.slice("_w", k, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    grams = F.flatten(F.array(*map(runs, sizes))) if sizes else F.array().cast("array<string>")
    exploded = texts.select("_key", "_scope", F.explode(F.array_distinct(grams)).alias("_run"))
    same = F.col("_run") == F.col("_words")
    if scope:
        same = same & (F.col("_scope") == F.col(scope))
    return exploded.join(known, same).select(F.col("_key").alias(key), *columns).distinct()


def requirement_hits(leads: DataFrame, requirements: DataFrame, columns: list[str]) -> DataFrame:
    """(id, requirement_id): any of the requirement's terms in the lead's text; distinct."""
    found = substring_hits(leads, "id", F.lower(F.concat_ws(" ", *columns)), requirements, "term")
    asked = requirements.select("requirement_id", F.col("term").alias("_asked"))
    return found.join(asked, F.col("term") == F.col("_asked")).select("id", "requirement_id").distinct()


def _with_misses(leads: DataFrame, kinds: DataFrame, hits: DataFrame) -> DataFrame:
    salts = partitions(leads.sparkSession)
    hit = hits.select(F.col("id").alias("_id"), F.col("requirement_id").alias("_r"), F.lit(True).alias("_hit"))
    pairs = every_pair(leads.select("id"), "id", kinds, salts)
    joined = pairs.join(hit, (F.col("id") == F.col("_id")) & (F.col("requirement_id") == F.col("_r")), "left")
    return joined.select("id", *kinds.columns, F.col("_hit").isNotNull().alias("matched"))


def requirement_matches(leads: DataFrame, requirements: DataFrame, columns: list[str]) -> DataFrame:
    """(id, requirement_id, matched) for every lead and requirement: any of the requirement's terms in the lead's text."""
    return _with_misses(leads, requirements.select("requirement_id").distinct(), requirement_hits(leads, requirements, columns))


def strict_matches(leads: DataFrame, requirements: DataFrame) -> DataFrame:
    """(id, requirement_id, importance, scope, matched): whole-term matches in the fields of each requirement's scope; a signal never matches."""
    firm = F.concat_ws(" ", "company", "industry", "headline")
    text = lambda scope, c: F.struct(F.lit(scope).alias("scope"), c.alias("text"))
    fields = F.array(text("person_role", F.concat_ws(" ", "title", "headline")), text("person_location", F.col("location")), text("company_type", firm), text("company_industry", firm))
    found = whole_term_hits(leads, "id", fields, requirements, "term", "scope")
    asked = requirements.select("requirement_id", F.col("term").alias("_asked"), F.col("scope").alias("_in"))
    hits = found.join(asked, (F.col("term") == F.col("_asked")) & (F.col("scope") == F.col("_in"))).select("id", "requirement_id").distinct()
    return _with_misses(leads, requirements.select("requirement_id", "importance", "scope").distinct(), hits)


def inferred_quality(raw: Column, content: Column) -> Column:
    r, c = F.length(T.collapse(raw)), F.length(T.collapse(content))
    return F.when(r >= 700, "good").when((r >= 180) | (c >= 120), "partial").otherwise("weak")


def rebased(canonical: Column, desired: Column, baseline: Column) -> Column:
    """The desired value where it was changed from the baseline, else the canonical one."""
    return F.when(~desired.eqNullSafe(baseline), desired).otherwise(canonical)
