"""String, identity and URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LEGAL_SUFFIXES = "llc|inc|incorporated|ltd|limited|co|company|corp|corporation|gmbh|pty|plc|llp"
SITE_SUFFIXES = "inc|llc|ltd|limited|corp|corporation|company|co|pllc|pc|group"
GENERIC_COMPANY_WORDS = (
    "agency", "and", "capital", "company", "consultancy", "consulting", "digital", "global", "group", "holdings",
    "labs", "partners", "services", "solutions", "studio", "systems", "technologies", "technology", "the", "ventures",
)
UNIVERSAL_SIGNALS = ("hiring", "expanding", "launched", "growing", "automation", "operations", "workflow", "lead generation", "conversion")
HINT_BLOCKLIST = (
    "short notice", "home", "large", "will", "present", "remote", "available", "your service", "your company", "clients",
    "request", "application", "stealth", "freelance", "self employed", "confidential", "various",
)
HOSTED_JOB_HOSTS = ("jobs.lever.co", "boards.greenhouse.io", "jobs.ashbyhq.com", "apply.workable.com")
JOB_DOMAINS = ("linkedin.com", "indeed.com", "glassdoor.com", "angellist.com", "wellfound.com", "lever.co", "greenhouse.io", "ashbyhq.com", "workable.com")
BLOCKED_DOMAINS = ("linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "crunchbase.com", "indeed.com", "glassdoor.com", "yelp.com")
INVALID_EMAIL_DOMAINS = ("example.com", "email.com", "domain.com", "test.com", "linkedin.com")
PUBLIC_HOST = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$"
EMAIL = r"[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9-]+(\.[a-z0-9-]+)+"
USABLE_EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def text(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c, F.lit(""))


def blank_as_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*map(blank_as_null, cs))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r"\s+", " "))


def dedupe_value(c: Column) -> Column:
    """Lower case without scheme, leading www., one trailing slash; trimmed last."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "^https?://", ""), r"^www\.", "")
    return F.trim(F.regexp_replace(bare, "/$", ""))


def profile_handle(c: Column) -> Column:
    """The handle of a profile URL, else a bare string without slash, else empty."""
    value = dedupe_value(c)
    found = F.regexp_extract(value, r"linkedin\.com/in/([^/?#]+)", 1)
    bare = (value != "") & ~value.contains("/") & ~value.contains("linkedin.com")
    return F.when(found != "", found).when(bare, value).otherwise(F.lit(""))


def profile_identity(c: Column) -> Column:
    """linkedin:<handle> of a real profile URL, else empty."""
    found = F.regexp_extract(dedupe_value(c), r"linkedin\.com/in/([^/?#]+)", 1)
    return F.when(found != "", F.concat(F.lit("linkedin:"), found)).otherwise(F.lit(""))


def profile_url(c: Column) -> Column:
    """linkedin.com/in/<handle> from the path alone; the host is not looked at."""
    found = F.lower(F.regexp_extract(text(c), r"(?i)^(?:https?://)?[^/?#]+[^?#]*?/in/([^/?#]+)", 1))
    return F.when(found != "", F.concat(F.lit("linkedin.com/in/"), found)).otherwise(F.lit(""))


def host_of(c: Column) -> Column:
    """Lower-case host without www., with or without a scheme; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(text(c), r"^(?:[a-zA-Z]+://)?([^/?#:\s]+)", 1)), r"^www\.", "")


def under_domain(host: Column, domains: tuple[str, ...]) -> Column:
    hits = [(host == d) | host.endswith(f".{d}") for d in domains]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return out


def blocked_url(c: Column) -> Column:
    host = host_of(c)
    return ~host.rlike(PUBLIC_HOST) | under_domain(host, BLOCKED_DOMAINS)


def company_name(c: Column) -> Column:
    """Lower case, & as and, letters and digits, without trailing legal suffixes."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "&", " and "), r"[^a-z0-9\s]", " ")
    return F.regexp_replace(collapse(words), rf"(\s+({LEGAL_SUFFIXES}))+$", "")


def distinctive_words(c: Column) -> Column:
    """Distinct words of the company name with six letters or more that are not generic."""
    return F.array_distinct(F.filter(F.split(company_name(c), " "), lambda w: (F.length(w) >= 6) & ~w.isin(*GENERIC_COMPANY_WORDS)))


def site_words(c: Column) -> Column:
    """The company name as looked for in a web site's host and text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), rf"\b({SITE_SUFFIXES})\b", " "), "[^a-z0-9]+", " "))


def title_words(c: Column) -> Column:
    """Lower case, & as and, letters and digits only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), "&", " and "), "[^a-z0-9]+", " "))


def signal_token(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s-]", ""), r"\s+", " "))


def dynamic_signals(raw: Column) -> Column:
    """Distinct cleaned tokens of 2 to 50 characters and 3 words at most that are not universal; 25 at most."""
    tokens = F.transform(raw, signal_token)
    fits = F.filter(tokens, lambda t: F.length(t).between(2, 50) & (F.size(F.split(t, " ")) <= 3) & ~t.isin(*UNIVERSAL_SIGNALS))
    return F.slice(F.array_distinct(fits), 1, 25)


def signal_fingerprint(raw: Column) -> Column:
    tokens = F.array_sort(F.array_distinct(F.filter(F.transform(raw, signal_token), lambda t: t != "")))
    return F.when(F.size(tokens) == 0, F.lit("fallback")).otherwise(F.substring(F.sha2(F.array_join(tokens, "|"), 256), 1, 16))


def overlapping_count(haystack: Column, needle: str) -> Column:
    """Occurrences of a fixed text, overlapping ones too."""
    return F.regexp_count(haystack, F.lit("(?=\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E)"))


def profile_domain(website: Column, email: Column) -> Column:
    site = F.split_part(dedupe_value(website), F.lit("/"), F.lit(1))
    mail = F.when(email.contains("@"), F.split_part(F.lower(email), F.lit("@"), F.lit(2)))
    return F.when(text(website) != "", site).otherwise(text(mail))


def dedupe_keys(email: Column, url: Column, name: Column, company: Column, website: Column) -> Column:
    """email:, linkedin:, and without a profile name_company: and name_domain: keys."""
    mail, identity = dedupe_value(email), profile_identity(url)
    who, firm, domain = dedupe_value(name), dedupe_value(company), profile_domain(website, email)
    open_ = identity == ""
    return F.array_compact(
        F.array(
            F.when(mail != "", F.concat(F.lit("email:"), mail)),
            F.nullif(identity, F.lit("")),
            F.when(open_ & (who != "") & (firm != ""), F.concat(F.lit("name_company:"), who, F.lit("::"), firm)),
            F.when(open_ & (who != "") & (domain != ""), F.concat(F.lit("name_domain:"), who, F.lit("::"), domain)),
        )
    )


def observation_identity(url: Column, title: Column, content: Column) -> Column:
    handle = profile_handle(url)
    path = profile_url(url)
    bare = F.regexp_replace(F.regexp_replace(F.lower(collapse(url)), "^https?://", ""), "/$", "")
    site = F.when(path != "", path).otherwise(bare)
    body = F.substring(F.lower(collapse(F.concat(text(title), F.lit(" "), text(content)))), 1, 220)
    return F.when(handle != "", F.concat(F.lit("linkedin:"), handle)).when(site != "", F.concat(F.lit("url:"), site)).otherwise(F.concat(F.lit("text:"), body))


def public_email(c: Column) -> Column:
    """A usable public address in lower case, else null."""
    mail = F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), "^(?i:mailto):", ""), r"[),.;:]+$", ""))
    local, domain = F.split_part(mail, F.lit("@"), F.lit(1)), F.split_part(mail, F.lit("@"), F.lit(2))
    good = mail.rlike(f"^{EMAIL}$") & ~domain.isin(*INVALID_EMAIL_DOMAINS) & ~local.rlike("^(no-?reply|do-?not-?reply|mailer-daemon)$") & ~domain.rlike(r"\.(png|jpe?g|gif|svg|webp|css|js)$")
    return F.when(good, mail)


def hint(c: Column) -> Column:
    """A possible company name: collapsed, without leading # or @, 80 characters at most."""
    return F.substring(F.trim(F.regexp_replace(collapse(c), "^[#@]+", "")), 1, 80)


def plausible_hint(c: Column) -> Column:
    return _plausible(hint(c), F.lower(hint(c)))


def _plausible(value: Column, lower: Column) -> Column:
    return (
        F.length(value).between(3, 80)
        & lower.rlike("[a-z0-9]")
        & ~lower.isin(*HINT_BLOCKLIST)
        & ~lower.rlike(r"\b(hiring|job|jobs|careers|work|apply|vacancy|position|role)\b")
        & ~lower.rlike(r"\b(connections?|followers?|people also viewed|about|experience|education)\b")
        & ~lower.rlike(r"\b(available at|open to|looking for|seeking|working at)\b")
        & ~value.rlike(r"^[\d\s,.-]+$")
    )


def hosted_job_company(url: Column) -> Column:
    host = host_of(url)
    segment = F.regexp_extract(text(url), r"^[a-zA-Z]+://[^/?#]+/+([^/?#]+)", 1)
    return F.when(host.isin(*HOSTED_JOB_HOSTS), hint(segment)).otherwise(F.lit(""))


def domain_company(url: Column) -> Column:
    """The registrable label of the host, with compound suffixes such as co.uk in mind."""
    host = F.when(text(url).rlike("^[a-zA-Z]+://"), host_of(url)).otherwise(F.lit(""))
    labels = F.split(host, r"\.")
    place = F.when(host.rlike(r"(^|\.)(co|com|org|net|gov|ac)\.[a-z]{2}$"), F.lit(-3)).otherwise(F.lit(-2))
    label = F.try_element_at(labels, place)
    return F.when((F.size(labels) >= 2) & ~under_domain(host, JOB_DOMAINS), hint(F.regexp_replace(text(label), "[-_]+", " "))).otherwise(F.lit(""))


def company_hint(raw: Column, title: Column, content: Column, url: Column) -> Column:
    """The first plausible of: raw field, last part of the title, 'X is hiring', hosted-job path, domain label."""
    parts = F.split(text(title), r"\s+[|:–—-]\s+")
    last = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))
    opening = F.concat(text(title), F.lit("\n"), F.substring(text(content), 1, 240))
    hiring = F.regexp_extract(opening, r"(?i)(?:^|\n)([A-Z][A-Za-z0-9&.' -]{2,60})\s+(?:is\s+)?(?:hiring|looking for|seeking)\b", 1)
    tried = [hint(raw), hint(last), hint(hiring), hosted_job_company(url), domain_company(url)]
    return F.coalesce(*[F.when(plausible_hint(t), t) for t in tried], F.lit(""))


#: All up to the second line with more than space, # and @, which no cleaning empties; the whole text if it has none.
_TWO_LINES = r"^(?:[\s#@]*+[^\s#@][^\n]*+){0,2}[\s#@]*+"


def profile_company_hint(rows: DataFrame, raw: Column, title: Column, content: Column) -> DataFrame:
    """`rows` with company_hint, the first plausible of: raw field, 'at Company', second line.

    What is tried comes first and its cleaned forms second, so each is worked out
    once a row; no line after the second is looked at.
    """
    shown = F.concat(text(title), F.lit("\n"), F.substring(text(content), 1, 800))
    inline = F.regexp_extract(shown, r"(?:^|[^A-Za-z0-9_])(?:at|@)\s+([A-Z][A-Za-z0-9&.' -]{2,80}?)\s*(?:\||\n|,|–|—|$)", 1)
    top = F.regexp_extract(text(content), _TWO_LINES, 0)
    lines = F.filter(F.transform(F.split(top, "\r?\n"), lambda x: hint(F.regexp_replace(x, r"^#+\s*", ""))), lambda x: x != "")
    second = text(F.try_element_at(lines, F.lit(2)))
    tried = rows.withColumns({"_try0": hint(raw), "_try1": hint(inline), "_try2": second})
    tried = tried.withColumns({f"_value{k}": hint(F.col(f"_try{k}")) for k in range(3)})
    tried = tried.withColumns({f"_lower{k}": F.lower(f"_value{k}") for k in range(3)})
    found = [F.when(_plausible(F.col(f"_value{k}"), F.col(f"_lower{k}")), F.col(f"_try{k}")) for k in range(3)]
    return tried.withColumn("company_hint", F.coalesce(*found, F.lit(""))).drop(*[f"_{n}{k}" for n in ("try", "value", "lower") for k in range(3)])


def snippets(block: Column, most: int = 3) -> Column:
    """The first cleaned lines of an evidence block, without link and provider lines, 260 characters at most."""
    lines = F.transform(F.split(text(block), "\r?\n"), lambda x: collapse(F.regexp_replace(x, r"^\[[^\]]+\]\s*", "")))
    kept = F.slice(F.filter(lines, lambda x: (x != "") & ~x.startswith("LINK:") & ~x.startswith("SOURCE_PROVIDER:")), 1, most)
    return F.transform(kept, lambda x: F.when(F.length(x) > 260, F.concat(F.trim(F.substring(x, 1, 257)), F.lit("..."))).otherwise(x))


def sentences(body: Column) -> Column:
    cut = F.split(F.replace(text(body), F.lit("\r"), F.lit("")), r"\n+|[.!?;]+\s+")
    return F.filter(F.array_distinct(F.transform(cut, lambda x: F.substring(collapse(x), 1, 520))), lambda x: x != "")


def crop(body: Column, size: int, term: str) -> Column:
    """`size` characters around the first occurrence of the term, with ellipses."""
    whole = F.substring(collapse(body), 1, 2000)
    at = F.locate(term.lower(), F.lower(whole)) - 1
    start = F.greatest(F.lit(0), at - int(size * 0.3))
    end = F.least(F.length(whole), start + max(1, size - 2))
    around = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substring(whole, start + 1, end - start)), F.when(end < F.length(whole), "...").otherwise(""))
    head = F.concat(F.trim(F.substring(whole, 1, max(1, size - 3))), F.lit("..."))
    return F.when(F.length(whole) <= size, whole).when(at < 0, head).otherwise(around)


def whole_term(body: Column, term: Column) -> Column:
    """Whether the term stands in the text as whole words; both reduced to letters and digits."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))
    return (norm(term) != "") & F.concat(F.lit(" "), norm(body), F.lit(" ")).contains(F.concat(F.lit(" "), norm(term), F.lit(" ")))


def query_text(c: Column) -> Column:
    """Without the site operator and the network's name."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text(c), r"(?i)site:linkedin\.com/in/", ""), "(?i)linkedin", ""), r"\s+", " "))


def telemetry_text(c: Column, most: int = 300) -> Column:
    """Bearer tokens redacted, long texts truncated."""
    safe = F.regexp_replace(text(c), r"(?i)Bearer\s+[A-Za-z0-9._-]+", "Bearer [REDACTED]")
    return F.when(F.length(safe) > most, F.concat(F.substring(safe, 1, most), F.lit("... [truncated]"))).otherwise(safe)


def csv_safe(c: Column) -> Column:
    """Guards a spreadsheet cell against formulas."""
    return F.when(text(c).rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(text(c))


def evidence_label(block: Column, label: str) -> Column:
    return F.trim(F.regexp_extract(text(block), rf"(?m)^{label}: (.*)$", 1))


def profile_text(pairs: list[tuple[str, Column]], most: int = 280) -> Column:
    """'Label: value' for the filled fields, collapsed and cropped."""
    lines = [F.when(text(c) != "", F.concat(F.lit(f"{label}: "), F.substring(collapse(c), 1, 120))) for label, c in pairs]
    return F.substring(collapse(F.concat_ws("\n", *lines)), 1, most)
