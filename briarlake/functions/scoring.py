"""Scores of prospects as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briarlake.functions.numeric import clamp, fixed, score_or, to_ten, whole
from briarlake.functions.text import title_words

# Role patterns over title_words, by label, in order. The principal rule has an exception of its own.
AUTHORITY = (
    ("founder", r"\b(co founder|cofounder|founder|founding partner)\b"),
    ("owner", r"\b(practice owner|broker owner|agency owner|business owner|company owner|owner operator|owneroperator|operator owner|proprietor)\b"),
    ("owner", r"\bowner\s+(of|at)\b"),
    ("c-suite", r"\b(ceo|cfo|coo|cto|cio|cro|cmo|chro|cso|cpo)\b"),
    ("c-suite", r"\bchief\s+[a-z\s]{2,40}\s+officer\b"),
    ("president", r"\b(president|general manager)\b"),
    ("partner", r"\b(managing partner|partner)\b"),
    ("managing director", r"\bmanaging director\b"),
    ("head", r"\bhead\s+of\s+(growth|sales|revenue|marketing|engineering|operations|business development|customer success|product|technology|it)\b"),
    ("vp", r"\b(vp|svp|evp|vice president)\b"),
    ("director", r"\b(director|executive director)\b"),
    ("principal", r"\bprincipal\b"),
)
PRINCIPAL_EXCEPT = r"\bprincipal\s+(engineer|software|architect|developer|designer|researcher|scientist|consultant)\b"
WEAK = (
    ("assistant", r"\bassistant\b"),
    ("student", r"\b(student|campus club|university club|college club)\b"),
    ("intern", r"\bintern(ship)?\b"),
    ("coordinator", r"\bcoordinator\b"),
    ("associate", r"\bassociate\b"),
    ("specialist", r"\bspecialist\b"),
    ("representative", r"\brepresentative\b"),
    ("consultant", r"\bconsultant\b"),
)
#: Weak labels that a word of QUALIFIED lifts.
QUALIFIABLE = ("consultant", "specialist")
SENIORITY = r"\b(c suite|csuite|executive|founder|owner|partner|vp|vice president|head|director)\b"
WEAK_WANTED = r"\b(interns?|students?|assistants?|coordinators?|associates?|specialists?|representatives?|consultants?)\b"
QUALIFIED = r"\b(principal|senior|managing|strategy|technical|security|healthcare|medical|financial|lead|chief)\b"
STUDENT_BODY = r"\b(student|campus|university|college)\s+(club|organization|society|association)\b"
ASSISTANT_TO = r"\bassistant\s+(to|for)\s+(the\s+)?(ceo|cfo|coo|cto|cio|cro|cmo|chief|president|founder|owner|partner)\b"


def evidence_score(quality: Column) -> Column:
    return F.when(quality == "good", 9.0).when(quality == "partial", 7.0).otherwise(4.0)


def source_score(provider: Column) -> Column:
    return F.when(provider.isin("brightdata", "manual"), 8.0).when(provider.isin("cache", "import"), 7.0).otherwise(6.0)


def hard_caps(score: Column, verdict: Column, identity: Column, employment: Column, email: Column, quality: Column) -> Column:
    """Rejected 3 at most; doubtful identity or employment 6; no e-mail on weak evidence 7.5; then 1 to 10."""
    doubt = F.coalesce((identity < 6) | (employment < 6), identity < 6, employment < 6, F.lit(False))
    capped = F.when(doubt, F.least(score, F.lit(6.0))).otherwise(score)
    bare = (F.coalesce(email, F.lit("")) == "") & F.coalesce(quality.isin("weak", "bad"), F.lit(False))
    capped = F.when(bare, F.least(capped, F.lit(7.5))).otherwise(capped)
    return F.when(F.coalesce(verdict.isin("reject", "auto_reject"), F.lit(False)), F.least(score, F.lit(3.0))).otherwise(clamp(capped, 1, 10))


def blended_score(fit: Column, intent: Column, timing: Column, evidence: Column, source: Column, authority: Column, ignored: Column) -> Column:
    """.35 fit + .30 intent + .15 timing + .15 evidence + .05 source, authority bonus, penalty for an ignored title."""
    base = score_or(fit, 5) * 0.35 + score_or(intent, 5) * 0.30 + score_or(timing, 5) * 0.15 + evidence * 0.15 + source * 0.05
    bonus = F.when(authority >= 8, 0.7).when(authority >= 6, 0.3).otherwise(0.0)
    return base + bonus - F.when(authority.isNotNull() & ignored, 1.5).otherwise(0.0)


def company_intent(has: Column, quality: Column, tfidf: Column, n_signals: Column, pain: Column) -> Column:
    bonus = tfidf * 2
    account = F.when(pain > 10, F.least(pain / 10, F.lit(10.0))).when(pain > 0, pain)
    found = F.when(quality == "good", F.least(F.lit(10.0), fixed(bonus + 9))).when(quality == "partial", F.least(F.lit(10.0), fixed(bonus + 7))).when(n_signals >= 4, 6.0)
    return F.when(~has, 5.0).otherwise(F.coalesce(found, account, F.lit(5.0)))


def post_intent(state: Column, quality: Column, confidence: Column, fresh: Column) -> Column:
    none = F.coalesce(state == "enriched_none", F.lit(False)) | (state.isNull() & F.coalesce(quality == "none", F.lit(False)))
    base = F.when(quality == "strong", 8.0).when(quality == "moderate", 6.5).when(quality == "weak", 5.5).otherwise(5.0)
    return F.when(none, 4.5).when(quality.isNull() | (quality == "none"), 5.0).otherwise(F.least(F.lit(10.0), fixed(base + clamp(confidence, 0, 1) * fresh)))


def intent_delta(dynamic: Column, universal: Column, pages: Column, quality: Column, age: Column) -> Column:
    """Posterior of a .25 prior under the signals' likelihood, scaled by quality, decayed by age in days."""
    seen = F.when(pages == 0, F.lit(1)).otherwise(pages)
    likelihood = F.greatest(F.lit(0.5), (dynamic * 1.8 + universal * 0.4) * F.least(seen, F.lit(3)))
    posterior = likelihood * 0.25 / (likelihood * 0.25 + 0.75)
    base = F.when(quality == "good", F.greatest(F.lit(0.8), posterior * 1.2)).when(quality == "partial", F.greatest(F.lit(0.4), posterior * 0.7)).otherwise(posterior * 0.3)
    silent = (dynamic == 0) & (universal == 0) & ~quality.isin("good", "partial")
    return F.when(silent, 0.0).otherwise(fixed(base * F.exp(F.greatest(age, F.lit(0)) * -0.05)))


def sigmoid(score: Column, midpoint: float = 5.5, steepness: float = 0.45) -> Column:
    """Logistic curve rescaled to 1..10."""
    at = lambda x: F.lit(1.0) / (F.exp((x - midpoint) * -steepness) + 1)
    low, high = at(F.lit(1.0)), at(F.lit(10.0))
    return fixed((at(clamp(score, 1, 10)) - low) / (high - low) * 9 + 1)


def kalman(prior: Column, seen: Column, process: float = 1.0, noise: float = 2.0) -> Column:
    return fixed(clamp(prior + (seen - prior) * (process / (process + noise)), 1, 10))


def post_delta(quality: Column, confidence: Column, fresh: Column) -> Column:
    sure = clamp(confidence, 0, 1)
    raw = F.when(quality == "strong", sure * 0.30 + 0.50).when(quality == "moderate", sure * 0.20 + 0.25).when(quality == "weak", 0.10).otherwise(0.0)
    return fixed(raw * fresh)


def selection_rank(authority: Column, company: Column, evidence: Column, corroboration: Column, coverage: Column, source: Column, base: Column, post: Column, bm25: Column, skyline: Column) -> Column:
    """Weighted sum before the hard caps."""
    total = score_or(authority, 5) * 0.30 + company * 0.15 + evidence * 0.15 + score_or(corroboration, 4) * 0.15 + score_or(coverage, 5) * 0.10
    total = total + source * 0.03 + score_or(to_ten(base), 5) * 0.02 + post * 0.10 + bm25 * 0.05
    return total + F.when(skyline, 0.30).otherwise(0.0)


def credible_sigma(n_snippets: Column, sources: Column, quality: Column) -> Column:
    info = F.lit(1.0) / (F.least(n_snippets, F.lit(6)) * 0.35 + 1)
    corroboration = F.lit(0.85) / F.sqrt(F.greatest(sources, F.lit(1)).cast("double"))
    doubt = F.when(quality == "good", 0.15).when(quality == "partial", 0.35).otherwise(0.70)
    return F.sqrt((info * info + corroboration * corroboration + doubt * doubt) / 3)


def post_quality(category: Column, confidence: Column) -> Column:
    c = clamp(F.coalesce(confidence, F.lit(0.0)), 0, 1)
    buying, moving = category.isin("hiring", "evaluating_tools"), category.isin("pain_signal", "growth_signal")
    return (
        F.when(buying & (c >= 0.5), "strong")
        .when((moving & (c >= 0.4)) | (buying & (c >= 0.25)), "moderate")
        .when(((category == "general") & (c >= 0.4)) | ((c >= 0.3) & (category != "none")), "weak")
        .otherwise("none")
    )


def authority_labels(words: Column) -> Column:
    """Distinct authority labels of title_words; principal engineers and the like are none."""
    marks = [F.when(words.rlike(p) & (~words.rlike(PRINCIPAL_EXCEPT) if label == "principal" else F.lit(True)), F.lit(label)) for label, p in AUTHORITY]
    return _labels(marks)


def has_authority(words: Column) -> Column:
    """Whether `authority_labels` finds any, by one pattern for all labels without an exception."""
    every = "|".join(p for label, p in AUTHORITY if label != "principal")
    return words.rlike(every) | words.rlike(dict(AUTHORITY)["principal"]) & ~words.rlike(PRINCIPAL_EXCEPT)


def _labels(marks: list[Column]) -> Column:
    """Distinct marks that are not null, without a lambda: a lambda is interpreted, and then each mark works its words out anew."""
    return F.array_except(F.array(*marks), F.array(F.lit(None).cast("string")))


def weak_labels(words: Column) -> Column:
    qualified = words.rlike(QUALIFIED)
    marks = [F.when(words.rlike(p) & (~qualified if label in QUALIFIABLE else F.lit(True)), F.lit(label)) for label, p in WEAK]
    return _labels(marks)


def has_weak(words: Column) -> Column:
    """Whether `weak_labels` finds any."""
    always, unless = ("|".join(p for label, p in WEAK if (label in QUALIFIABLE) == q) for q in (False, True))
    return words.rlike(always) | words.rlike(unless) & ~words.rlike(QUALIFIED)


def verify_authority(rows: DataFrame, brief: Column, title: Column, headline: Column, seniority: Column, company: Column, evidence: Column, roles: Column, trajectory: Column) -> DataFrame:
    """`rows` with title_matched, company_matched, ignored_title and confidence: authority from title, headline, seniority and evidence; a serial career adds a half.

    Words come first, what they match second, so each is worked out once a row.
    """
    told = F.concat_ws(" ", F.nullif(title_words(F.concat_ws(" ", title, headline)), F.lit("")), F.nullif(F.col("_level"), F.lit("")), F.nullif(title_words(evidence), F.lit("")))
    staged = rows.withColumns({"_level": title_words(seniority), "_firm": title_words(company)}).withColumn("_words", told)
    words, firm = F.col("_words"), F.col("_firm")
    overruled = words.rlike(STUDENT_BODY) | words.rlike(ASSISTANT_TO)
    staged = staged.withColumns({"title_matched": has_authority(words) | F.col("_level").rlike(SENIORITY), "company_matched": (F.coalesce(company, F.lit("")) != "") & words.contains(firm)})
    staged = staged.withColumn("ignored_title", ~title_words(brief).rlike(WEAK_WANTED) & has_weak(words) & (~F.col("title_matched") | overruled))
    context = (F.coalesce(title, F.lit("")) != "") | (F.coalesce(headline, F.lit("")) != "")
    linked = F.coalesce(evidence, F.lit("")).contains("LINK:")
    matched, ignored = F.col("title_matched"), F.col("ignored_title")
    base = F.when(ignored, 2.0).when(matched & F.col("company_matched") & linked, 9.0).when(matched, 7.0).when(context, 5.0).otherwise(4.0)
    boosted = F.when((roles >= 2) & (trajectory >= 7.5) & ~ignored, F.least(F.lit(10.0), base + 0.5)).otherwise(base)
    return staged.withColumn("confidence", boosted).drop("_level", "_firm", "_words")


def role_weight(words: Column) -> Column:
    labels = authority_labels(words)
    has = lambda *names: F.arrays_overlap(labels, F.array(*map(F.lit, names)))
    return (
        F.when(has("founder", "owner", "c-suite"), 10.0).when(has("president"), 9.0).when(has("vp", "head", "managing director"), 8.0).when(has("director"), 7.0)
        .when(words.rlike(r"\b(lead|manager|principal|supervisor)\b"), 5.5).otherwise(4.0)
    )


def domain_weight(words: Column, keywords: list[str]) -> Column:
    if not keywords:
        return F.lit(0.85)
    hits = sum((F.when(words.contains(k.lower()), 1).otherwise(0) for k in keywords), F.lit(0))
    return F.when(hits > 0, F.least(F.lit(1.0), hits * 0.15 + 0.85)).otherwise(0.75)


def lead_score(title: Column, headline: Column, seniority: Column, size: Column, n_signals: Column, pain: Column) -> Column:
    """25, plus seniority 35 / 25 / 12, company size 8, 5 a signal up to 4, twice the pain; 0 to 100."""
    words = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(headline, F.lit(""))))
    level = F.lower(F.coalesce(seniority, F.lit("")))
    rank = (
        F.when(words.rlike(r"\b(founder|owner|chief|c[eo]o|president|partner)\b") | level.rlike("c-suite|founder"), 35)
        .when(words.rlike(r"\b(vp|vice president|head of|director)\b") | level.rlike("vp|head|director"), 25)
        .when(words.rlike(r"\b(manager|lead)\b") | level.rlike("manager"), 12).otherwise(0)
    )
    known = F.when(F.coalesce(size, F.lit("")).isin("", "UNKNOWN"), 0).otherwise(8)
    return F.least(F.lit(100), F.lit(25) + rank + known + F.least(n_signals, F.lit(4)) * 5 + whole(clamp(pain, 0, 10) * 2))


def predictive_score(composite: Column, factor: float) -> Column:
    return F.when(composite > 0, F.least(F.lit(96), whole(composite * factor))).otherwise(F.lit(0))


def arm_score(arm: dict[str, Column], total_runs: Column, exploration: float = 1.25) -> Column:
    """Mean reward plus exploration bonus; arms without outcome are scored by exploration alone. No sampling."""
    cold = F.sqrt(F.ln((total_runs + 2).cast("double"))) * exploration * 1.15
    reward = arm["qualified"] * 2.5 + arm["returned"] * 2 + arm["uniques"] * 0.04 - arm["rescued"] * 1.25 - arm["duplicates"] * 0.08 - arm["units"] * 0.12 - arm["latency_ms"] / 1000 * 0.002
    bonus = F.sqrt(F.try_divide(F.ln((total_runs + 1).cast("double")), arm["outcome_runs"])) * exploration
    return F.when(F.coalesce(arm["outcome_runs"], F.lit(0)) == 0, cold).otherwise(F.try_divide(reward, arm["outcome_runs"]) + bonus)


def fused_arm_score(arm: dict[str, Column], total_runs: Column, draw: Column, first_draw: Column, exploration: float = 1.25) -> Column:
    """The score with Thompson sampling: .65 of mean and bonus and .35 of ten times a draw of the arm's posterior; an arm without outcomes explores by a draw of Beta(1.5, 1)."""
    cold = F.sqrt(F.ln((total_runs + 2).cast("double"))) * exploration
    return F.when(F.coalesce(arm["outcome_runs"], F.lit(0)) == 0, cold * (first_draw * 0.3 + 0.85)).otherwise(arm_score(arm, total_runs, exploration) * 0.65 + draw * 10 * 0.35)


def capacity(target: Column) -> dict[str, Column]:
    """Pool, batch, rounds and ceilings of a collection run for 1 to 200 prospects."""
    t = F.least(F.greatest(F.floor(target), F.lit(1)), F.lit(200))
    pool = F.least(F.ceil(t * F.when(t <= 20, 2.0).when(t <= 50, 1.75).otherwise(1.5)), F.lit(240))
    batch = F.least(F.greatest(F.ceil(t * 0.6), F.lit(12)), F.lit(36))
    needed = F.greatest(F.lit(1), F.ceil(pool / batch))
    return {
        "batch_size": batch, "pool_target": pool, "required_rounds": needed,
        "max_rounds": F.least(F.greatest(F.lit(5), needed + 1), F.when(t <= 30, 6).when(t <= 50, 8).otherwise(10)),
        "candidate_ceiling": F.least(F.lit(1600), F.greatest(F.lit(24), t * 8)), "query_ceiling": F.least(F.lit(240), F.greatest(F.lit(32), t * 2)),
    }
