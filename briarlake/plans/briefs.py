"""Compiles a prospect brief into requirements, queries and retrieval tasks.

Briefs are a few sentences and their plans a few dozen rows, so this runs on the
driver; `requirement_rows` and `retrieval_tasks` are where plans become frames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
INTENT_WORDS = r"\b(hiring|recruiting|looking\s+for|seeking|using|evaluating|migrating|switching|scaling\s+past|manual\s+process|bottleneck|open\s+role|partner\s+program|white\s*label|subcontract)\b"
ROLES = ("owner", "owners", "founder", "founders", "co-founder", "ceo", "chief executive officer", "president", "partner", "partners", "vp", "vice president", "head of", "director", "directors")
PLACES = {
    ("usa", "united states", "us", "america"): ("USA", "United States", "US", "U.S.", "America"),
    ("uk", "united kingdom", "britain", "england"): ("UK", "United Kingdom", "Britain", "England"),
    ("canada", "canadian"): ("Canada", "Canadian"),
    ("australia", "australian", "au"): ("Australia", "Australian"),
    ("new zealand", "newzealand", "nz"): ("New Zealand", "NZ"),
}
OWNER_TERMS = ("founder", "co-founder", "cofounder", "CEO", "chief executive officer", "managing partner", "managing director", "principal", "president", "proprietor")
AGENCY_TERMS = ("AI agency", "AI agencies", "AI marketing agency", "AI consultancy", "AI studio", "AI firm", "artificial intelligence agency", "AI-powered agency")
HINTS = ("", "public profile", "professional profile", "leadership profile")
REFINEMENTS = (
    "official website", "team page", "leadership team", "company leadership", "professional biography", "executive biography", "partner profile", "founder profile", "management profile",
    "leadership profile", "company about page", "team directory", "leadership contact", "executive team", "company leadership bio", "professional experience", "management team",
    "leadership experience", "company team bio", "business leadership", "executive contact", "leadership background",
)


@dataclass
class Requirement:
    scope: str
    phrase: str
    terms: list[str]
    importance: str = "hard"
    id: str = ""


@dataclass
class Contract:
    brief: str
    mode: str
    requirements: list[Requirement] = field(default_factory=list)
    exclusions: list[str] = field(default_factory=list)
    authority_required: bool = False


def tidy(value: object) -> str:
    return re.sub(r"\s+", " ", str(value or "")).strip()


def distinct(values: list[str], most: int = 8) -> list[str]:
    return list(dict.fromkeys(filter(None, map(tidy, values))))[:most]


def decomposition_mode(brief: str) -> str:
    """Two streams if the brief names an intent or has over 14 words."""
    text = tidy(brief)
    return "dual_stream_intent" if re.search(INTENT_WORDS, text, re.I) or len(text.split()) > 14 else "single_stream_identity"


def mode_column(brief: Column) -> Column:
    text = F.trim(F.regexp_replace(brief, r"\s+", " "))
    return F.when(F.lower(text).rlike(INTENT_WORDS) | (F.size(F.filter(F.split(text, " "), lambda w: w != "")) > 14), "dual_stream_intent").otherwise("single_stream_identity")


def expanded(scope: str, terms: list[str]) -> list[str]:
    """The terms with their country, owner or agency synonyms."""
    out, low = list(terms), [t.lower() for t in terms]
    if scope == "person_location":
        for marks, names in PLACES.items():
            if any(m in t for t in low for m in marks):
                out += names
    if scope == "person_role" and any(re.search(r"\bowners?\b", t) for t in low):
        out += OWNER_TERMS
    if scope == "company_type" and any(re.search(r"\bagenc", t) for t in low):
        out += AGENCY_TERMS
    return distinct(out)


def compile_brief(brief: str, exclusions: list[str] = ()) -> Contract:
    """Roles, places, firms and signals that the brief itself names; overlapping phrases of a scope merge."""
    text = tidy(brief)
    contract = Contract(text, decomposition_mode(text), exclusions=distinct(list(exclusions), 30))

    def add(scope: str, phrases: list[str], importance: str = "hard") -> None:
        phrases = [p for p in distinct(phrases) if p.lower() in text.lower()]
        if not phrases:
            return
        terms = expanded(scope, phrases)
        for known in contract.requirements:
            a, b = known.phrase.lower(), phrases[0].lower()
            if known.scope == scope and (a in b or b in a):
                known.terms = distinct(known.terms + terms)
                return
        n = sum(r.scope == scope for r in contract.requirements)
        contract.requirements.append(Requirement(scope, phrases[0], terms, importance, f"{scope}-{n + 1}"))

    add("person_role", [r for r in ROLES if re.search(rf"\b{re.escape(r)}\b", text, re.I)])
    place = re.search(r"\b(?:in|near|from)\s+([A-Za-z0-9 ,.'&/-]{1,120})", text, re.I)
    add("person_location", re.split(r",|\band\b|/", place[1]) if place else [])
    kind = re.search(r"([A-Za-z0-9\s-]{2,30}?)\s+(?:" + "|".join(map(re.escape, ROLES)) + r")\b", text, re.I)
    if kind and not re.fullmatch(r"with|and|or|in|from|at|the|a|an", kind[1].strip(), re.I):
        add("company_type", [kind[1].strip()])
    signal = re.search(r"\b(hiring(?:\s+intent)?|recruiting|scaling|funding)\b", text, re.I)
    add("signal", [signal[0]] if signal else [], "soft")
    if not contract.requirements and text:
        contract.requirements.append(Requirement("company_type", text, [text], "hard", "brief-1"))
    authority = r"\b(owners?|founders?|chief|ceo|president|partners?|vp|vice president|head|directors?|manager)\b"
    contract.authority_required = any(r.scope == "person_role" and re.search(authority, " ".join(r.terms), re.I) for r in contract.requirements)
    return contract


def normalized_contract(raw: list[Requirement], fallback: Contract) -> Contract:
    """Model requirements count only if the brief names their phrase; 4 hard and 5 soft at most, the fallback's first."""
    hard = [r for r in fallback.requirements if r.importance == "hard"][:4]
    named = [r for r in raw if r.importance != "hard" or r.phrase.lower() in fallback.brief.lower()]
    for r in named:
        if r.importance == "hard" and len(hard) < 4 and not any(h.scope == r.scope and h.phrase.lower() == r.phrase.lower() for h in hard):
            hard.append(r)
    soft = [r for r in named if r.importance == "soft"][:5]
    return Contract(fallback.brief, fallback.mode, hard + soft or fallback.requirements, fallback.exclusions, fallback.authority_required)


def fallback_queries(contract: Contract) -> list[dict]:
    """Four person queries by turning through the terms, then a query per signal."""
    hard = [r for r in contract.requirements if r.importance == "hard" and r.scope != "signal"]
    places = next((r.terms for r in hard if r.scope == "person_location"), [""])
    others = [r for r in hard if r.scope != "person_location"]
    made = []
    for k, hint in enumerate(HINTS):
        words = [*(r.terms[k % len(r.terms)] for r in others), places[k % len(places)]]
        made.append(tidy(" ".join([*words, hint])) or contract.brief)
    out = [{"query": q, "lane": "person", "family": "persona_title", "priority": k + 1} for k, q in enumerate(distinct(made, 4))]
    return out + [{"query": " OR ".join(r.terms[:3]), "lane": "signal", "family": "pain_signal", "priority": k + 1} for k, r in enumerate(r for r in contract.requirements if r.scope == "signal")]


def enforced_queries(raw: list[str], contract: Contract) -> list[dict]:
    """Without excluded, repeated or overlong queries; missing hard terms are appended; at least four."""
    out, seen = [], set()
    for text in raw[:6]:
        query = tidy(re.sub(r"(?i)\bsite:\S+|\blinkedin\b", "", text))
        if not query or len(query) > 240 or any(e.lower() in query.lower() for e in contract.exclusions):
            continue
        for r in contract.requirements:
            if r.importance == "hard" and r.scope != "signal" and not any(t.lower() in query.lower() for t in r.terms):
                query = f"{query} {r.terms[0]}"
        if query.lower() not in seen:
            seen.add(query.lower())
            out.append({"query": query, "lane": "person", "family": "persona_title", "priority": len(out) + 1})
    for item in fallback_queries(contract):
        if item["query"].lower() not in seen and (len(out) < 4 or item["lane"] == "signal"):
            seen.add(item["query"].lower())
            out.append(item)
    return out


# Fixed values of the search spec.
MODES = ("person_first", "account_first", "signal_first", "local_business")
LOCAL_HINTS = r"\b(local|near me|city|austin|dallas|houston|miami|chicago|new york|london|toronto|canada|usa|united states)\b"
SIGNAL_HINTS = r"\b(hiring|funding|raised|growing|growth|automation|crm|new patients|booking|expanding)\b"


def _number(value: object, default: int, low: int, high: int) -> int:
    try:
        return min(max(int(float(value)), low), high)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def normalized_spec(raw: object, brief: str, mode: str = "") -> dict:
    """A search spec with known modes, tidy distinct lists and bounded numbers, whatever a model answered."""
    part = lambda name: x if isinstance(x := source.get(name), dict) else {}
    listed = lambda owner, name, most=30: distinct(x, most) if isinstance(x := owner.get(name), list) else []
    source = raw if isinstance(raw, dict) else {}
    person, company, signals, exclusions = part("person"), part("company"), part("signals"), part("exclusions")
    staff = company.get("employeeRange") if isinstance(company.get("employeeRange"), dict) else {}
    low, high = (_number(staff.get(k), 0, 0, 1_000_000) for k in ("min", "max"))
    return {
        "mode": mode or (tidy(source.get("mode")) if tidy(source.get("mode")) in MODES else MODES[0]),
        "titles": listed(person, "includeTitles"), "excluded_titles": listed(person, "excludeTitles"), "seniorities": listed(person, "seniorities"), "places": listed(person, "locations"),
        "industries": listed(company, "industries"), "keywords": listed(company, "keywords") or distinct([brief]), "employees": (low, high) if low or high else None,
        "signals": listed(signals, "include"), "recency_days": _number(signals.get("recencyDays"), 30, 1, 365) if signals.get("recencyDays") else None,
        "excluded_companies": listed(exclusions, "companies", 100), "excluded_domains": listed(exclusions, "domains", 100), "max_per_company": _number(source.get("maxPerCompany"), 2, 1, 5),
    }


def fallback_spec(brief: str, mode: str = "person_first") -> dict:
    """The spec of a brief without a model: a place makes it local, else a signal word makes it signal-first."""
    text = tidy(brief)
    local, signal = re.search(LOCAL_HINTS, text.lower()), re.search(SIGNAL_HINTS, text.lower())
    if mode == "person_first":
        mode = "local_business" if local else "signal_first" if signal else mode
    return normalized_spec({"mode": mode, "company": {"keywords": [text]}, "signals": {"include": [text], "recencyDays": 90} if signal else {}}, text)


def fallback_plan(brief: str, titles: tuple[str, ...] = ("founder", "owner"), signal: str = "growth automation") -> list[dict]:
    text = tidy(brief)
    parts = (("person", "persona_title", " ".join(titles)), ("account", "company_type", "company founder owner"), ("signal", "growth_signal", signal), ("signal", "tooling_signal", "automation CRM"))
    return [{"query": f"{text} {tail}", "lane": lane, "family": family, "priority": k + 1} for k, (lane, family, tail) in enumerate(parts)]


def refinement(round_: Column) -> Column:
    """The refinement phrase of a collection round; the last repeats."""
    return F.element_at(F.array(*map(F.lit, REFINEMENTS)), F.least(F.greatest(round_, F.lit(3)) - 2, F.lit(len(REFINEMENTS))).cast("int"))


def requirement_rows(spark, contract: Contract) -> DataFrame:
    rows = [(r.id, r.scope, r.importance, t.lower()) for r in contract.requirements for t in r.terms]
    return spark.createDataFrame(rows, "requirement_id string, scope string, importance string, term string")


def retrieval_tasks(plan: DataFrame) -> DataFrame:
    """Lane, depth and preference of plan items, one task per lane and query: that of the least priority and id."""
    family = F.coalesce(F.nullif("family", F.lit("")), F.lit("persona_title"))
    by_family = F.when(family.isin("pain_signal", "growth_signal", "tooling_signal"), "signal").when(family.isin("company_type", "industry_vertical", "local_market"), "account").otherwise("person")
    lane = F.when(F.col("lane") == "archetype", "person").otherwise(F.coalesce("lane", by_family))
    rows = plan.select("id", F.trim(F.regexp_replace("query", r"\s+", " ")).alias("query"), family.alias("family"), lane.alias("lane"), F.coalesce("preference", F.when(lane == "person", "tavily").otherwise("corroborate")).alias("preference"), F.coalesce("priority", F.lit(99)).alias("priority"))
    first = F.min(F.struct("priority", "id", "query", "family", "preference"))
    return rows.where("query <> ''").groupBy("lane", F.lower("query").alias("_q")).agg(first.alias("t")).select("t.id", "t.query", "t.family", "lane", "t.preference", F.when(F.col("lane") == "signal", "advanced").otherwise("basic").alias("depth"))
