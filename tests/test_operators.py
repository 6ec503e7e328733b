"""Core operators against plain versions on small tables."""

import random
import re

import numpy as np
import pytest

from briarlake import catalog
from briarlake.operators import identity, matching, order, packing, selection, store, telemetry
from briarlake.plans import briefs
from briarlake.scratch import Scratch
from briarlake.sources import ports
from briarlake.streaming import events

SMALL = "/root/testdata/sf0.001"


def test_skyline_against_all_pairs(spark):
    draw = random.Random(1)
    rows = [(k, float(draw.randrange(9)), float(draw.randrange(9)), None if k % 20 == 0 else float(draw.randrange(9))) for k in range(300)]
    got = {r.id for r in matching.skyline(spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(7), "id", ["a", "b", "c"]).collect()}
    full = [r for r in rows if None not in r]
    beats = lambda x, y: all(p >= q for p, q in zip(x[1:], y[1:])) and x[1:] != y[1:]
    assert got == {y[0] for y in full if not any(beats(x, y) for x in full)}
    assert matching.skyline(spark.createDataFrame([], "id long, a double"), "id", ["a"]).count() == 0


def walked(keys, known=()):
    held, out = set(known), {}
    for lead in sorted(keys):
        out[lead] = any(k in held for k in keys[lead])
        if not out[lead]:
            held.update(keys[lead])
    return out


@pytest.mark.parametrize("rounds", [8, 1, 0])
def test_sequential_duplicates_of_chains_and_copies(spark, rounds):
    draw = random.Random(rounds)
    keys = {k: [f"c{k}", f"c{k + 1}"] for k in range(40)}  # a chain: every second is kept
    keys |= {100 + k: ["same"] for k in range(50)} | {200 + k: [f"r{draw.randrange(30)}" for _ in range(3)] for k in range(80)} | {900: []}
    leads = spark.createDataFrame([(k,) for k in keys], "id long")
    pairs = spark.createDataFrame([(k, x) for k, xs in keys.items() for x in xs], "id long, k string")
    assert {r.id: r.duplicate for r in identity.sequential_duplicates(leads, pairs, None, rounds).collect()} == walked(keys)
    known = spark.createDataFrame([("same",), ("c3",)], "k string")
    assert {r.id: r.duplicate for r in identity.sequential_duplicates(leads, pairs, known, rounds).collect()} == walked(keys, {"same", "c3"})


def greedy(rows, count, balance):
    """rows: (id, rank, firm, words, place)."""
    left, chosen = sorted(rows, key=lambda r: (-r[1], r[0])), []

    def near(a, b):
        return 0.8 * bool(a[2] and b[2] and (a[2] == b[2] or set(a[3]) & set(b[3]))) + 0.2 * bool(a[4] and a[4] == b[4])

    while left and len(chosen) < count:
        best = max(left, key=lambda r: (balance * (r[1] / 10) - (1 - balance) * max((near(r, c) for c in chosen), default=0.0), r[1], -r[0]))
        left.remove(best)
        chosen.append(best)
    return [r[0] for r in chosen]


def test_marginal_relevance_looks_at_every_row(spark):
    draw = random.Random(3)
    firms = ["Northwind Trading", "Northwind Labs", "Beacon", "Quartz Systems", "", None]
    rows = [(k, float(draw.randrange(100)) / 10, draw.choice(firms), draw.choice(["Oslo", "Rome", "", None])) for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, rank double, company string, location string")
    from briarlake.functions import text as T
    from pyspark.sql import functions as F

    known = frame.select("id", "rank", T.company_name(F.col("company")), T.distinctive_words(F.col("company")), F.lower(T.text(F.col("location")))).collect()
    for count, balance in ((9, 0.75), (5, 0.3)):
        got = selection.mmr(frame, count, balance).orderBy("position").collect()
        assert [r.id for r in got] == greedy([tuple(r) for r in known], count, balance) and [r.position for r in got] == list(range(1, count + 1))
    # 500 rows of one firm and place lead: the pool of any fixed size would hold no other.
    crowd = [(k, 9.0, "Beacon", "Oslo") for k in range(500)] + [(900, 8.0, "Quartz Systems", "Rome")]
    got = selection.mmr(spark.createDataFrame(crowd, "id long, rank double, company string, location string"), 2).orderBy("position").collect()
    assert [r.id for r in got] == [0, 900]
    assert selection.mmr(frame.limit(0), 3).count() == 0


def test_scheduler_covers_with_any_task(spark):
    arms = spark.createDataFrame([("f", "person", "p", 5, 9, 9, 9, 0, 0, 0, 0), ("f", "signal", "p", 5, 0, 0, 0, 9, 9, 9, 9)], "family string, lane string, provider string, outcome_runs long, qualified long, returned long, uniques long, rescued long, duplicates long, units long, latency_ms long")
    tasks = [(k, "f", "person", "p", k, ["hard-1"]) for k in range(200)] + [(500, "f", "signal", "p", 1, ["hard-2", "hard-3"])]
    frame = spark.createDataFrame(tasks, "id long, family string, lane string, preference string, priority int, covers array<string>")
    assert {r.id for r in selection.scheduled(frame, arms, 3).collect()} == {0, 1, 500}


ARM_COLUMNS = "family string, lane string, provider string, outcome_runs long, qualified long, returned long, uniques long, rescued long, duplicates long, units long, latency_ms long"
TASKS = [(1, "persona_title", "person", "tavily", 1, []), (2, "local_market", "account", "brightdata", 2, []), (3, "growth_signal", "signal", "corroborate", 3, []), (4, "tooling_signal", "signal", "brightdata", 4, [])]


def schedule(spark, tasks, arms, **how):
    frame = spark.createDataFrame(tasks, "id long, family string, lane string, preference string, priority int, covers array<string>")
    rows = [(f, lane, p, *(a.get(c, 0) for c in selection.ARM)) for (f, lane, p), a in arms.items()]
    return [r.id for r in selection.scheduled(frame, spark.createDataFrame(rows, ARM_COLUMNS), 2, 4, **how).orderBy("priority").collect()]


def test_the_scheduler_waits_for_outcomes(spark):
    person = ("persona_title", "person", "tavily")
    assert schedule(spark, TASKS, {person: {"uniques": 100}}) == [1, 2, 3, 4]
    assert schedule(spark, TASKS, {person: {"outcome_runs": 9}}, enabled=False) == [1, 2, 3, 4]
    assert schedule(spark, TASKS[:2], {person: {"outcome_runs": 9}}) == [1, 2]


def test_the_scheduler_drops_weak_arms_and_guards_the_person_lane(spark):
    keys = [t[1:4] for t in TASKS]
    weak = dict(zip(keys, ({"outcome_runs": 8, "qualified": 6, "returned": 5}, {"outcome_runs": 8, "units": 8}, {"outcome_runs": 1, "qualified": 1, "returned": 1}, {"outcome_runs": 8, "rescued": 5, "units": 8})))
    assert schedule(spark, TASKS, weak, sampling=False) == [3, 1] and set(schedule(spark, TASKS, weak)) == {1, 3}
    signals = dict(zip(keys, ({"outcome_runs": 10}, {"outcome_runs": 10, "qualified": 5}, {"outcome_runs": 10, "qualified": 8}, {"outcome_runs": 10, "qualified": 7})))
    assert 1 in schedule(spark, TASKS, signals, sampling=False)


def test_the_scheduler_never_prunes_coverage(spark):
    keys = [t[1:4] for t in TASKS]
    asked = [(*t[:5], [f"hard-{t[0]}"] if t[0] < 4 else []) for t in TASKS]
    arms = dict(zip(keys, [{"outcome_runs": 10}] * 3 + [{"outcome_runs": 10, "qualified": 10}]))
    assert set(schedule(spark, asked, arms)) == {1, 2, 3}


def test_folds_of_a_hot_group(spark):
    rows = [(1, k, (k * 7) % 5) for k in range(25_000)] + [(2, 0, 9), (None, 0, 1)]
    frame = spark.createDataFrame(rows, "g long, o long, u long")
    want, used = [0, 0], 0
    for _, _, u in sorted(r for r in rows if r[0] == 1):
        if used + u <= 100:
            used, want[0] = used + u, want[0] + 1
        else:
            want[1] += 1
    got = {r.g: tuple(r)[1:] for r in telemetry.capped_reservations(frame, "g", "o", "u", 100).collect()}
    assert got == {1: (used, *want), 2: (9, 1, 0)}
    assert telemetry.capped_reservations(frame.limit(0), "g", "o", "u", 1).count() == 0


def test_ranks_and_sums_of_a_hot_group(spark):
    draw = random.Random(4)
    rows = [("hot" if draw.random() < 0.8 else draw.choice(["a", None]), k, draw.randrange(10)) for k in range(500)]
    got = order.ranked(spark.createDataFrame(rows, "g string, o long, v long"), ["g"], [__import__("pyspark.sql.functions", fromlist=["col"]).col("o")], Scratch(spark, "t"), "n", ("v",)).collect()
    for g in ("hot", "a", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.o)
        assert [r.n for r in own] == list(range(len(own)))
        assert [r.v_before for r in own] == np.cumsum([0, *(r.v for r in own)])[:-1].tolist()


def test_live_view_sends_what_is_new(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("event_id").collect()
    write = lambda part: spark.createDataFrame(part, events.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    scratch, stream = Scratch(spark, "t"), events.source(spark, str(tmp_path)).select("event_id")
    write(rows[:60])
    assert events.deltas(stream, scratch) == [60]
    write(rows[60:150])
    assert events.deltas(stream, scratch) == [90]


def test_migrations_are_resumed_and_snapshots_kept(spark, tmp_path):
    steps = [lambda d: d.selectExpr("id", "id + 1 AS next"), lambda d: d.selectExpr("id", "next", "next * 2 AS twice")]
    old = store.Migrations(spark, str(tmp_path / "t"), steps[:1])
    old.create(spark.range(3))
    assert old.version() == 0 and old.run() == 1 and old.run() == 1
    new = store.Migrations(spark, str(tmp_path / "t"), steps)
    assert new.run() == 2 and new.table().columns == ["id", "next", "twice"] and new.snapshot(1).columns == ["id", "next"] and new.snapshot(0).columns == ["id"]
    broken = store.Migrations(spark, str(tmp_path / "t"), [*steps, lambda d: d.selectExpr("raise_error('no')")])
    with pytest.raises(Exception, match="no"):
        broken.run()
    assert broken.version() == 2


def test_merges_respect_revision_identity_and_order(spark):
    leads = spark.createDataFrame([(1, 3, "a", "", "x@y.z", ["p"]), (2, 0, None, "Firm", "b@y.z", ["q", "p"]), (3, 0, "c", "C", "", []), (4, 0, "c", "D", "", []), (5, 1, None, "E", "", ["r"])], "id long, revision int, identity string, company string, email string, tags array<string>")
    pairs = spark.createDataFrame([(1, 2, 3), (2, 5, 0), (4, 5, 0), (5, 3, 9), (3, 3, 0), (3, 77, 0)], "winner long, loser long, revision int")
    allowed = store.mergeable(leads, pairs)
    assert [tuple(r) for r in allowed.collect()] == [(1, 2)]  # 2 is taken, 3 holds the identity of 4, a stale revision, itself, unknown
    after = {r.id: r for r in store.merged_leads(leads, allowed).collect()}
    assert sorted(after) == [1, 3, 4, 5] and tuple(after[1])[1:] == (4, "Firm", "x@y.z", ["p", "q"], 2) and after[3].merged_from is None
    keys = spark.createDataFrame([(1, "k"), (2, "k"), (2, "m"), (3, "n")], "id long, k string")
    assert sorted(map(tuple, store.identities_moved(keys, allowed).collect())) == [(1, "k"), (1, "m"), (3, "n")]


def test_scraping_recovers_empty_bodies(spark, tmp_path):
    folder = str(tmp_path)

    def fetch(urls):
        import os

        if len(urls) > 1 and any("bad" in u for u in urls):
            raise OSError("batch refused")
        out = []
        for u in urls:
            seen = os.path.join(folder, u)
            first = not os.path.exists(seen)
            open(seen, "a").close()
            if "bad" in u:
                raise OSError("blocked by captcha")
            if "hiccup" in u and first:
                raise OSError("Unexpected non-JSON response for search.")
            if "challenge" in u:
                raise OSError("Unexpected non-JSON response for search. Response snippet: <html>")
            out.append("" if "slow" in u and first else None if "never" in u else f"page {u}")
        return out

    got = {r.url: r.content for r in ports.scraped(spark.createDataFrame([(u,) for u in ("a", "slow", "never", "bad", "a", "hiccup", "challenge")], "url string").coalesce(1), "url", fetch).collect()}
    assert got == {"a": "page a", "slow": "page slow", "never": None, "bad": None, "hiccup": "page hiccup", "challenge": None}


def test_model_ports_parse_and_fall_back(spark):
    rows = spark.createDataFrame([(1, "b", "dual_stream_intent", "r"), (2, "b", "single_stream_identity", "r")], "id long, brief string, mode string, requirements string")
    good = lambda ps: ['{"dynamic_signals": ["n8n", "Zapier!", "hiring"], "categorized": {"pain": ["manual work", "n8n"]}}' for _ in ps]
    got = {r.id: r for r in ports.compiled_signals(rows, good).collect()}
    assert "n8n" in got[1].signals and "zapier" in got[1].signals and "manual work" in got[1].signals and len(got[1].fingerprint) == 16
    assert got[2].signals == [] and got[2].fingerprint == "fallback"

    def broken(ps):
        raise OSError

    assert {r.fingerprint for r in ports.compiled_signals(rows, broken).collect()} == {"fallback"}
    posts = spark.createDataFrame([(1, "p" * 60, "n", "t", "c", "b"), (2, "short", "n", "t", "c", "b"), (3, "q" * 60, "n", "t", "c", "b")], "id long, posts string, name string, title string, company string, brief string")
    answer = lambda ps: ['{"intentCategory": "HIRING", "confidenceScore": 7}' if "ppp" in p else '{"intentCategory": "odd", "confidenceScore": -1}' for p in ps]
    assert [tuple(r) for r in ports.classified_posts(posts, answer).orderBy("id").select("category", "confidence", "quality").collect()] == [("hiring", 1.0, "strong"), ("none", 0.0, "none"), ("none", 0.0, "none")]
    seen = spark.createDataFrame([(1, "t", "u", "x" * 130, ""), (2, "t", "u", "short", None), (3, "t", "u", "x" * 130, "Known")], "id long, title string, url string, content string, hint string")
    assert [r.hint for r in ports.company_hints(seen, lambda ps: ['{"company": " Acme "}' for _ in ps]).orderBy("id").collect()] == ["Acme", "", "Known"]


def test_pasted_text_or_url(spark):
    page = "# Jane Roe\nFounder at Acme Labs, automation for clinics\nAustin, TX\n## About\nBuilds things for clinics and hospitals.\n## Experience\nFounder at Acme Labs"
    inputs = spark.createDataFrame([(1, page), (2, " https://x.org/jane "), (3, "hi"), (4, None)], "id long, pasted string")
    model = lambda ps: ['{"fullName": "Asked For", "currentTitle": "CTO"}' for _ in ps]
    got = {r.id: r for r in ports.pasted_profiles(inputs, lambda urls: [page for _ in urls], model).collect()}
    assert (got[1].name, got[1].company) == (got[2].name, got[2].company) == ("Jane Roe", "Acme Labs") and got[1].quality == "good"
    assert (got[3].name, got[3].quality, got[3].headline) == ("Asked For", "partial", "CTO") and got[4].name is None


def test_search_specs():
    spec = briefs.normalized_spec({"mode": "odd", "person": {"includeTitles": [" CEO ", "CEO", 3]}, "company": {"employeeRange": {"min": "5", "max": 10**9}}, "signals": {"recencyDays": 9999}, "maxPerCompany": "x"}, "clinics")
    assert (spec["mode"], spec["titles"], spec["keywords"], spec["employees"], spec["recency_days"], spec["max_per_company"]) == ("person_first", ["CEO", "3"], ["clinics"], (5, 1_000_000), 365, 2)
    assert briefs.normalized_spec("no", "b", "local_business")["mode"] == "local_business"
    assert [briefs.fallback_spec(b)["mode"] for b in ("dentists in Austin hiring", "firms hiring", "plumbers")] == ["local_business", "signal_first", "person_first"]
    assert briefs.fallback_spec("firms hiring")["signals"] == ["firms hiring"] and briefs.fallback_spec("x", "account_first")["mode"] == "account_first"


def test_evidence_sentences_against_a_loop(spark):
    terms, budget = ["alpha", "beta"], 200
    texts = ["Alpha is here in a long sentence. Beta too, with more words around it. Nothing at all in this one here. Alpha and beta both stand here.", "", "short. tiny.", "alpha " * 100 + ". " + "beta " * 10 + "."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in packing.evidence_sentences(frame, terms, budget).collect()}
    assert got[0].n_covered == 2 and got[0].n_chars <= budget and got[1].n_chosen == 0 and got[2].n_chosen == 0 and got[3].n_covered == 1  # the first long sentence takes all


def chosen_sentences(text, terms, budget):
    lines = list(dict.fromkeys(x for x in (" ".join(p.split())[:520] for p in re.split(r"\n+|[.!?;]+\s+", text.replace("\r", ""))) if x))
    scored = sorted((-sum(t in s.lower() for t in terms), k) for k, s in enumerate(lines))
    left, chosen = budget, []

    def take(k):
        nonlocal left
        size = min(len(lines[k]), 280, left)
        if left >= 60 and size >= 24 and k not in chosen:
            chosen.append(k)
            left -= size + 1

    for t in terms:
        best = next((k for _, k in scored if t in lines[k].lower() and k not in chosen), None)
        if best is not None:
            take(best)
    for _, k in scored:
        take(k)
    return len(chosen), budget - left, sum(any(t in lines[k].lower() for k in chosen) for t in terms)


def test_evidence_of_whole_documents_against_a_loop(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    terms = ["erea", "tion", "haha", "zzz"]
    got = {r.doc_id: (r.n_chosen, r.n_chars, r.n_covered) for r in packing.evidence_sentences(docs, terms, 700).collect()}
    assert got == {r.doc_id: chosen_sentences(r.text or "", terms, 700) for r in docs.collect()}


def test_diversified_selection_of_the_table(spark):
    rows = catalog.QUERIES["k19_diversified_selection"](spark, SMALL).orderBy("position").collect()
    front = sorted(r.id for r in catalog.QUERIES["k16_candidate_skyline"](spark, SMALL).collect())[:6]
    assert [r.id for r in rows][: len(front)] == front and [r.position for r in rows] == list(range(1, 21)) and len({r.id for r in rows}) == 20


def test_a_skyline_without_dominance_is_no_single_task(spark):
    """All points are on the front; repeats, one cell and many, NaN."""
    draw = np.random.default_rng(3)
    a = draw.random((20_000, 3))
    points = np.c_[a, 3 - a.sum(axis=1)]
    rows = [(k, *map(float, p)) for k, p in enumerate(points)] + [(50_000 + k, *map(float, points[k])) for k in range(5)] + [(60_000, float("nan"), 9.0, 9.0, 9.0), (60_001, None, 9.0, 9.0, 9.0)]
    got = {r.id for r in matching.skyline(spark.createDataFrame(rows, "id long, a double, b double, c double, d double"), "id", list("abcd"), cell=1024, strong=64).collect()}
    assert got == {r[0] for r in rows} - {60_001}


@pytest.mark.parametrize("cell", [4, 50, 10_000])
def test_skylines_of_any_cell_size(spark, cell):
    draw = random.Random(cell)
    rows = [(k, float(draw.randrange(12)), float(draw.randrange(12)) - (k % 3) * 2, float(draw.randrange(4)), 1.0) for k in range(600)]
    got = {r.id for r in matching.skyline(spark.createDataFrame(rows, "id long, a double, b double, c double, d double"), "id", list("abcd"), cell=cell, strong=3).collect()}
    beats = lambda x, y: all(p >= q for p, q in zip(x[1:], y[1:])) and x[1:] != y[1:]
    assert got == {y[0] for y in rows if not any(beats(x, y) for x in rows)}


def test_an_affine_fold_of_a_hot_group_is_split(spark):
    draw = random.Random(6)
    rows = [(1, k, float(draw.randrange(10))) for k in range(5000)] + [(2, 0, 4.0)] + [(3, k, float(k)) for k in range(9)]
    want = {}
    for g, _, v in rows:
        want[g] = want[g] + (v - want[g]) / 3 if g in want else v
    got = {r.g: r.last for r in order.affine_last(spark.createDataFrame(rows, "g long, o long, v double").repartition(5), "g", ["o"], "v", 1 / 3, Scratch(spark, "t")).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_marginal_relevance_past_its_bound_takes_passes(spark):
    rows = [(k, 9.0 - (k % 50) / 100, "Beacon" if k % 2 else f"Beacon {k}", "Oslo") for k in range(300)] + [(900, 6.6, "Quartz Systems", "Rome"), (901, 5.0, "Other Things", "Rome")]
    frame = spark.createDataFrame(rows, "id long, rank double, company string, location string")
    whole = [r.id for r in selection.mmr(frame, 6).orderBy("position").collect()]
    assert 900 in whole
    for most in (1, 7, 40, 301):
        assert [r.id for r in selection.mmr(frame, 6, most=most).orderBy("position").collect()] == whole


def test_draws_have_their_distribution(spark):
    from briarlake.functions.sampling import beta_sql, gamma_sql
    from pyspark.sql import functions as F

    keys = spark.range(4000).select(F.col("id").cast("string").alias("key"), F.lit(2.5).alias("a"), F.lit(0.6).alias("b"))
    found = keys.select(F.expr(gamma_sql("key", "x", "a")).alias("g"), F.expr(gamma_sql("key", "y", "b")).alias("h"), F.expr(beta_sql("key", "a", "b")).alias("p")).collect()
    for name, mean, var in (("g", 2.5, 2.5), ("h", 0.6, 0.6), ("p", 2.5 / 3.1, 2.5 * 0.6 / (3.1**2 * 4.1))):
        values = np.array([r[name] for r in found])
        assert abs(values.mean() - mean) < 5 * (var / 4000) ** 0.5 and abs(values.var() / var - 1) < 0.2 and (values > 0).all()


def test_terms_by_index_against_every_pair(spark):
    from briarlake.operators import records
    from pyspark.sql import functions as F

    draw = random.Random(9)
    texts = [(k, "".join(draw.choice("ab c-") for _ in range(draw.randrange(12)))) for k in range(80)] + [(100, None), (101, ""), (102, "Senior A-B c")]
    terms = ["", "a", "ab", "abc", "a b", "b c a", "-", "A-B", "zz", None]
    rows, asked = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(t,) for t in [*terms, "ab"]], "term string")
    got = {tuple(r) for r in records.substring_hits(rows, "id", F.col("t"), asked, "term").collect()}
    assert got == {(k, t) for k, x in texts if x is not None for t in terms if t is not None and t in x}
    norm = lambda x: " ".join("".join(c if c.isalnum() else " " for c in (x or "").lower()).split())
    got = [tuple(r) for r in records.whole_term_hits(rows, "id", F.col("t"), asked, "term").collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, t) for k, x in texts for t in terms if norm(t) and f" {norm(t)} " in f" {norm(x)} "}
    pairs = records.every_pair(rows, "id", asked.distinct(), 3)
    assert pairs.count() == len(texts) * len(terms)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rescues_by_group(spark):
    rows = [("a", k, k < 3, float(k), f"u{k}") for k in range(8)] + [("b", k, True, 1.0, None) for k in range(9)] + [("c", 1, False, 2.0, "x"), ("c", 2, False, 2.0, None), (None, 5, False, 1.0, "u")]
    got = packing.rescued(spark.createDataFrame(rows, "g string, id long, qualified boolean, rank double, url string"), "g", 5, 0.3).collect()
    want = {("a", k, "qualified") for k in range(3)} | {("a", 7, "rescued"), ("a", 6, "rescued")} | {("b", k, "qualified") for k in range(9)} | {("c", 1, "rescued"), ("c", 2, "rescued"), (None, 5, "rescued")}
    assert {(r.g, r.id, r.verdict) for r in got} == want


def test_draws_are_made_once_for_each_kind_of_task(spark, monkeypatch):
    """Each task drew for itself, though tasks of one family, lane and provider have one arm and one draw."""
    seen, real = [], selection.scored_arms
    monkeypatch.setattr(selection, "scored_arms", lambda arms, total: real(seen.append(arms) or arms, total))
    tasks = spark.createDataFrame([(n, ("view", None)[n % 2], "person", ("tavily", None)[n % 4 // 2], n % 7, ["a", "b"][: n % 3]) for n in range(60)], "id long, family string, lane string, preference string, priority int, covers array<string>")
    arms = spark.createDataFrame([("view", "person", "tavily", *range(9, 17))], "family string, lane string, provider string, " + ", ".join(f"{c} long" for c in selection.ARM))
    assert len(selection.scheduled(tasks, arms, 8).collect()) == 8
    assert seen[0].count() == 4
