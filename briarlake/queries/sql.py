"""DuckDB text of the scalar functions, for oracles."""

from __future__ import annotations

from briarlake.functions import text as T


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def collapse(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def dedupe(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '^https?://', ''), '^www\.', ''), '/$', ''))"


def in_handle(x: str) -> str:
    return rf"regexp_extract({dedupe(x)}, 'linkedin\.com/in/([^/?#]+)', 1)"


def handle(x: str) -> str:
    d = dedupe(x)
    return f"CASE WHEN {in_handle(x)} <> '' THEN {in_handle(x)} WHEN {d} <> '' AND NOT contains({d}, '/') AND NOT contains({d}, 'linkedin.com') THEN {d} ELSE '' END"


def identity(x: str) -> str:
    return f"CASE WHEN {in_handle(x)} <> '' THEN 'linkedin:' || {in_handle(x)} ELSE '' END"


def profile_url(x: str) -> str:
    found = rf"lower(regexp_extract(coalesce({x}, ''), '(?i)^(?:https?://)?[^/?#]+[^?#]*?/in/([^/?#]+)', 1))"
    return f"CASE WHEN {found} <> '' THEN 'linkedin.com/in/' || {found} ELSE '' END"


def company(x: str) -> str:
    words = rf"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '&', ' and ', 'g'), '[^a-z0-9\s]', ' ', 'g')"
    return rf"regexp_replace({collapse(words)}, '(\s+({T.LEGAL_SUFFIXES}))+$', '')"


def distinctive(x: str) -> str:
    return f"list_distinct(list_filter(string_split({company(x)}, ' '), lambda w: length(w) >= 6 AND w NOT IN ({quoted(T.GENERIC_COMPANY_WORDS)})))"


def words(x: str) -> str:
    """title_words"""
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def host(x: str) -> str:
    return rf"regexp_replace(lower(regexp_extract(coalesce({x}, ''), '^(?:[a-zA-Z]+://)?([^/?#:\s]+)', 1)), '^www\.', '')"


def under(h: str, domains: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{h} = '{d}' OR ends_with({h}, '.{d}')" for d in domains) + ")"


def hint(x: str) -> str:
    return f"substr(trim(regexp_replace({collapse(x)}, '^[#@]+', '')), 1, 80)"


def plausible(x: str) -> str:
    h = hint(x)
    return (
        rf"(length({h}) BETWEEN 3 AND 80 AND regexp_matches(lower({h}), '[a-z0-9]') AND lower({h}) NOT IN ({quoted(T.HINT_BLOCKLIST)})"
        rf" AND NOT regexp_matches(lower({h}), '\b(hiring|job|jobs|careers|work|apply|vacancy|position|role)\b') AND NOT regexp_matches(lower({h}), '\b(connections?|followers?|people also viewed|about|experience|education)\b')"
        rf" AND NOT regexp_matches(lower({h}), '\b(available at|open to|looking for|seeking|working at)\b') AND NOT regexp_matches({h}, '^[\d\s,.-]+$'))"
    )


def domain(website: str, email: str) -> str:
    return f"CASE WHEN coalesce({website}, '') <> '' THEN split_part({dedupe(website)}, '/', 1) WHEN contains({email}, '@') THEN split_part(lower({email}), '@', 2) ELSE '' END"


def keys(email: str, url: str, name: str, firm: str, website: str) -> str:
    n, c, d = dedupe(name), dedupe(firm), domain(website, email)
    return (
        f"list_filter([CASE WHEN {dedupe(email)} <> '' THEN 'email:' || {dedupe(email)} END, nullif({identity(url)}, ''),"
        f" CASE WHEN {identity(url)} = '' AND {n} <> '' AND {c} <> '' THEN 'name_company:' || {n} || '::' || {c} END,"
        f" CASE WHEN {identity(url)} = '' AND {n} <> '' AND {d} <> '' THEN 'name_domain:' || {n} || '::' || {d} END], lambda k: k IS NOT NULL)"
    )


def observation(url: str, title: str, content: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower({collapse(url)}), '^https?://', ''), '/$', '')"
    site = f"CASE WHEN {profile_url(url)} <> '' THEN {profile_url(url)} ELSE {bare} END"
    joined = f"coalesce({title}, '') || ' ' || coalesce({content}, '')"
    body = f"substr(lower({collapse(joined)}), 1, 220)"
    return f"CASE WHEN {handle(url)} <> '' THEN 'linkedin:' || {handle(url)} WHEN {site} <> '' THEN 'url:' || ({site}) ELSE 'text:' || {body} END"


def fixed(x: str, digits: int = 2) -> str:
    return f"(floor(({x}) * {10**digits}.0::DOUBLE + 0.5::DOUBLE) / {10**digits}.0::DOUBLE)"


def clamp(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {float(low)}::DOUBLE), {float(high)}::DOUBLE)"


def score_or(x: str, default: float) -> str:
    return f"(CASE WHEN {x} IS NULL OR {x} <= 0 THEN {float(default)}::DOUBLE ELSE {clamp(x, 1, 10)} END)"
