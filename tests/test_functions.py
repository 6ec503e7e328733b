"""Functions and operators on literals."""

import pytest
from pyspark.sql import functions as F

from briarlake.functions import numeric as N
from briarlake.functions import scoring as K
from briarlake.functions import text as T
from briarlake.operators import matching, packing, records, relevance, selection, store, telemetry
from briarlake.plans import briefs
from briarlake.sources import parsers, ports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "want"), [("TechFlow AI, LLC", "techflow ai"), ("Beacon & Sons, Inc.", "beacon and sons"), ("Acme Co Ltd", "acme"), (None, ""), ("Company", "company")])
def test_company_names(spark, name, want):
    assert one(spark, T.company_name(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("TechFlow AI", "TechFlow AI, LLC", True), ("North Wind Traders", "NorthWind Traders", True), ("Acme Robotics", "Robotics Hub", True), ("Global Digital", "Digital Agency", False), ("Acme", "Birch", False)],
)
def test_fuzzy_companies(spark, a, b, same):
    left, right = spark.createDataFrame([(a,)], "a string"), spark.createDataFrame([(b,)], "b string")
    assert (matching.fuzzy_companies(left, "a", right, "b").count() == 1) == same


@pytest.mark.parametrize(
    ("url", "identity"),
    [("https://www.linkedin.com/in/Jane-Roe/", "linkedin:jane-roe"), ("linkedin.com/in/jane-roe?x=1", "linkedin:jane-roe"), ("HTTP://LinkedIn.com/in/Jane-Roe", "linkedin:jane-roe"), ("https://linkedin.com/company/acme", ""), ("jane-roe", ""), (None, "")],
)
def test_profile_identity(spark, url, identity):
    assert one(spark, T.profile_identity(F.lit(url).cast("string"))) == identity


def test_dedupe_keys_prefer_the_profile(spark):
    keys = lambda url: one(spark, T.dedupe_keys(F.lit("A@b.org"), F.lit(url), F.lit("Jane Roe"), F.lit("Acme"), F.lit("https://www.acme.com/x")))
    assert keys("linkedin.com/in/j") == ["email:a@b.org", "linkedin:j"]
    assert keys("") == ["email:a@b.org", "name_company:jane roe::acme", "name_domain:jane roe::acme.com"]


def test_numbers(spark):
    assert one(spark, N.fixed(F.lit(2.675))) in (2.67, 2.68) and one(spark, N.whole(F.lit(-2.5))) == -2
    assert one(spark, N.score_or(F.lit(None).cast("double"), 5)) == 5 and one(spark, N.score_or(F.lit(12.0), 5)) == 10
    assert one(spark, N.token_estimate(F.lit("abcde"))) == 2
    assert one(spark, N.freshness_days(F.array(F.lit("3 weeks ago"), F.lit("12 days ago")))) == 12
    assert one(spark, N.freshness_days(F.array(F.lit("12 days ago"), F.lit("2 hours ago")))) == 0
    assert one(spark, N.freshness(F.lit(1000))) == 0.2
    assert one(spark, T.overlapping_count(F.lit("aaaa"), "aa")) == 3


def test_score_breakdown_literal(spark):
    none = F.lit(None).cast("double")
    score = K.blended_score(F.lit(12.0), F.lit(8.0), F.lit(0.0), K.evidence_score(F.lit("good")), K.source_score(F.lit("brightdata")), none, F.lit(False))
    assert one(spark, N.fixed(score, 1)) == pytest.approx(8.4)


def test_rank_is_neutral_to_email_on_good_evidence(spark):
    capped = lambda mail: one(spark, K.hard_caps(F.lit(9.0), F.lit(None).cast("string"), F.lit(9.0), F.lit(9.0), F.lit(mail).cast("string"), F.lit("good")))
    assert capped("a@b.org") == capped(None) == 9.0


def test_credible_interval_narrows(spark):
    assert one(spark, K.credible_sigma(F.lit(4), F.lit(3), F.lit("good"))) < one(spark, K.credible_sigma(F.lit(1), F.lit(1), F.lit("weak")))


def test_arms(spark):
    arm = lambda q, r, d: {k: F.lit(v) for k, v in {"outcome_runs": 5, "qualified": q, "returned": r, "uniques": 25, "rescued": 0, "duplicates": d, "units": 5, "latency_ms": 1200}.items()}
    assert one(spark, K.arm_score(arm(12, 10, 1), F.lit(10))) > one(spark, K.arm_score(arm(0, 0, 10), F.lit(10)))


def test_skyline(spark):
    rows = spark.createDataFrame([(1, 6.0, 9.0), (2, 10.0, 4.0), (3, 4.0, 4.0), (4, 6.0, 9.0)], "id int, a double, b double")
    assert sorted(r.id for r in matching.skyline(rows, "id", ["a", "b"]).collect()) == [1, 2, 4]


def test_company_cap(spark):
    rows = spark.createDataFrame([(1, "Acme", 9.8), (2, "Acme", 9.5), (3, "acme ", 9.2), (4, "Beacon", 9.0), (5, None, 1.0), (6, None, 1.0)], "id long, company string, s double")
    assert sorted(r.id for r in selection.company_cap(rows, F.col("company"), "s", 2).collect()) == [1, 2, 4, 5, 6]


def test_mmr_prefers_another_company(spark):
    rows = spark.createDataFrame([(1, "Acme Robotics", "x", 9.0), (2, "Acme Robotics", "x", 8.9), (3, "Beacon", "y", 8.0)], "id long, company string, location string, rank double")
    assert [r.id for r in selection.mmr(rows, 2).orderBy("position").collect()] == [1, 3]


def test_entropy_leaves_a_pool_of_one(spark):
    assert selection.entropy_spread(spark.createDataFrame([(1, 4.0)], "id long, s double"), "s").first().normalized == 4.0


def test_set_cover():
    tasks = [{"id": k, "lane": lane, "covers": c} for k, (lane, c) in enumerate([("signal", []), ("account", ["h1"]), ("signal", ["h2", "h3"]), ("person", [])])]
    assert [t["id"] for t in selection.cover(tasks, 2)] == [1, 2, 3]


def test_fusion_literal(spark):
    rows = [(1, "https://www.linkedin.com/in/u/", "A", "short", "tavily", "q1", "person"), (2, "linkedin.com/in/u", "B", "a longer text", "brightdata", "q2", "signal"), (3, "", "", "", "tavily", "q", "person")]
    fused = relevance.fuse(spark.createDataFrame(rows, "seq long, url string, title string, content string, provider string, query string, lane string")).collect()
    assert len(fused) == 1 and fused[0].source_count == 2 and fused[0].corroborated and fused[0].content_seq == 2 and sorted(fused[0].lanes) == ["person", "signal"]


def test_bm25_literal(spark):
    docs = spark.createDataFrame([(1, "the agency uses automation for agentic work"), (2, "gardens and flowers all over town"), (3, "agency news from the city")], "doc_id int, text string")
    got = {r.doc_id: r.score for r in relevance.bm25(docs, ["agency", "agentic", "automation"]).collect()}
    assert 0 < got[1] <= 10 and got[2] == 0


def test_packing(spark):
    rows = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([10, 10, 30, 100, 4])], "g long, o long, t string")
    got = packing.token_chunks(rows, "g", "o", "t", 10).first()
    assert (got.n_chunks, got.n_chars) == (4, 94)


def test_reservations(spark):
    rows = spark.createDataFrame([(1, 1, 3), (1, 2, 9), (1, 3, 2), (1, 4, 1)], "s long, o long, u long")
    assert tuple(telemetry.capped_reservations(rows, "s", "o", "u", 6).first())[1:] == (6, 3, 1)


def test_failures(spark):
    texts = {"HTTP 403": "provider_auth", "quota": "provider_quota", "read ECONNRESET": "transport_transient", "status: 503": "target_transient", "what": "unknown"}
    for text, want in texts.items():
        assert one(spark, store.failure_class(F.lit(text))) == want
    assert store.round_robin(["a", "b", "c"], {"a", "c"}, 1) == "c" and store.round_robin(["a"], set(), 0) is None


def test_csv_import_headers(spark):
    raw = spark.createDataFrame([(1, " Jane ", None, ""), (2, " ", "x", "y")], "ID int, `Full Name` string, `Company Name` string, Role string")
    assert [tuple(r) for r in records.imported(raw).collect()] == [(1, "Jane", "Independent", "Professional", "Tech")]


def test_briefs():
    contract = briefs.compile_brief("AI agency owners in London and Canada hiring now", ["recruiter"])
    scopes = {r.scope: r for r in contract.requirements}
    assert contract.mode == "dual_stream_intent" and contract.authority_required
    assert {"person_role", "person_location", "company_type", "signal"} <= set(scopes) and "AI studio" in scopes["company_type"].terms
    queries = briefs.enforced_queries(["site:linkedin.com/in recruiter list", "founders"], contract)
    assert len(queries) >= 4 and not any("recruiter" in q["query"] for q in queries)
    assert briefs.decomposition_mode("dentists in Austin") == "single_stream_identity" and len(briefs.fallback_plan("x")) == 4
    assert [r.id for r in briefs.normalized_contract([briefs.Requirement("signal", "funding", ["funding"], "soft", "s")], contract).requirements][-1] == "s"


def test_parsers():
    assert parsers.markdown_results("[A title](https://a.org/x)\nsome  text\n[B](https://www.bing.com/y)\nlost\nsee [C c](http://c.org)") == [("A title", "https://a.org/x", "some text"), ("C c", "http://c.org", "C c")]
    assert parsers.json_in_text('x {"a": 1} y {"b": 2}', ("b",)) == '{"b": 2}' and parsers.json_in_text("none") is None
    assert parsers.profile("short") == {"quality": "bad"}


def test_ports_survive_failures(spark):
    def fetch(urls):
        if "bad" in urls:
            raise OSError
        return [u.upper() for u in urls]

    got = dict(map(tuple, ports.scraped(spark.createDataFrame([("a",), ("bad",), ("b",), ("a",)], "u string"), "u", fetch).collect()))
    assert got == {"a": "A", "bad": None, "b": "B"}


def test_a_heading_that_begins_with_a_bullet():
    assert [parsers.clean_line(x) for x in ("# +1 (168) 555", "- # x", "## - *Jane* [Roe](http://x)", "+ a  b")] == ["1 (168) 555", "# x", "Jane Roe", "a b"]


def test_authority_is_matched_once_a_row(spark):
    """A lambda is interpreted: the words of a title were worked out again for each of twenty patterns."""
    titles = ["principal engineer", "managing principal", "chief happy people officer", "assistant to the ceo", "security specialist", "specialist", "student club lead", "owner of x", ""]
    rows = spark.createDataFrame([(t,) for t in titles], "t string")
    none = F.lit("")
    checked = K.verify_authority(rows, F.lit("founders"), F.col("t"), none, none, none, none, F.lit(0), F.lit(0.0)).withColumn("n", F.size(K.authority_labels(F.col("t")))).withColumn("w", F.size(K.weak_labels(F.col("t"))))
    assert "lambda" not in checked._jdf.queryExecution().optimizedPlan().toString()
    told = {r.t: r for r in checked.collect()}
    assert all(r.title_matched == (r.n > 0) for r in told.values())
    assert {t for t in titles if told[t].ignored_title} == {"assistant to the ceo", "specialist", "student club lead"}
    assert told[""].confidence == 4.0 and told["specialist"].confidence == 2.0 and told["owner of x"].confidence == 7.0


def test_verdicts_meet_no_requirement_that_nobody_judged(spark):
    """Every candidate was paired with every requirement and sorted to meet its judgments."""
    asked = spark.createDataFrame([("a", "hard", "role"), ("b", "hard", "place"), ("c", "soft", "role"), ("d", "hard", "signal"), ("a", "hard", "role")], "requirement_id string, importance string, scope string")
    rows = [(1, "a", "pass", 2), (1, "b", "pass", 1), (1, "a", "fail", 3), (2, "a", "fail", 1), (2, "a", "aaa", 1), (2, "b", "pass", 1), (3, "b", "fail", -1), (3, "b", "pass", 0), (4, "zz", "fail", 1), (4, "c", "fail", 1), (None, "a", "fail", 1), (5, "a", "pass", 1), (5, "b", "pass", 1), (5, "b", "fail", None)]
    judged = spark.createDataFrame(rows, "candidate_id long, requirement_id string, status string, line_no int")
    found = relevance.verdicts(judged, asked)
    assert {r.candidate_id: r.verdict for r in found.collect()} == {1: "qualified", 2: "unknown", 3: "hard_fail", 4: "unknown", None: "unknown", 5: "hard_fail"}
    plan = relevance.verdicts(judged, asked)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "salt" not in plan
    assert relevance.verdicts(judged, asked.limit(0)).count() == 0


def test_the_second_line_is_found_without_the_rest(spark):
    """Each line of a text was cleaned again for each test of each hint."""
    texts = ["# Jane\n## Beacon Labs\nmore", "\n # @\n# # #\n Acme Works\nx", "#@\n#\r\n\r\nOne Works\r\n@@ Two Works\r\n#", "# # #\n# # @", None, "only", "A\n#"]
    want = ["Beacon Labs", "", "Two Works", "", "", "", ""]  # of the second text "# @" and "# # #" are lines: "@" and "#" are left of them
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    none = F.lit(None).cast("string")
    found = T.profile_company_hint(rows, none, none, F.col("t"))
    assert [r.company_hint for r in found.orderBy("k").collect()] == want and found.columns == ["k", "t", "company_hint"]
