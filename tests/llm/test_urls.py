from datetime import datetime

from briarlake.llm.urls import intervals, match_lists
from briarlake.scratch import Scratch

EVENTS = "kind string, pattern string, list_name string, at timestamp, action string"
CAPTURES = "page_id long, url string, fetch_ts timestamp, blocked string"


def day(n):
    return datetime(2024, 1, n)


def test_intervals(spark):
    rows = [("domain", "a.com", "l", day(k), x) for k, x in [(2, "add"), (3, "add"), (5, "remove"), (6, "remove"), (8, "add"), (9, "add"), (9, "remove"), (1, "remove")]]
    rows += [("domain", None, "l", day(1), "add"), ("domain", "b.com", "l", None, "add"), ("domain", "b.com", "l", day(1), "other"), ("domain", "a.com", "l", day(2), "add")]
    got = sorted((r.valid_from, r.valid_to) for r in intervals(spark.createDataFrame(rows, EVENTS)).collect())
    assert got == [(day(2), day(5)), (day(8), day(9))]


def test_matches_as_of_fetch_time(spark):
    events = [("domain", "bad.com", "hosts", day(3), "add"), ("domain", "bad.com", "hosts", day(6), "remove"), ("prefix", "site.org/x/y", "paths", day(1), "add"), ("url", "http://one.net/p?q=1", "urls", day(1), "add"), ("domain", "bad.com", "more", day(5), "add")]
    captures = [
        (1, "http://bad.com/a", day(2)),
        (2, "https://user@www.BAD.com:80/", day(3)),
        (3, "http://bad.com", day(5)),
        (4, "http://bad.com", day(6)),
        (5, "http://notbad.com", day(4)),
        (6, "https://site.org/x/y/z?k#f", day(4)),
        (7, "https://site.org/x/yy", day(4)),
        (8, "http://one.net/p?q=1", day(4)),
        (9, None, day(4)),
        (10, "http://bad.com/", None),
        (11, "not a url", day(4)),
        (2, "https://user@www.BAD.com:80/", day(3)),
        (None, "http://bad.com.", day(4)),
    ]
    frame = spark.createDataFrame([(*c, "x") for c in captures], CAPTURES)
    got = match_lists(frame, spark.createDataFrame(events, EVENTS), Scratch(spark, "t")).collect()
    assert len(got) == len(captures)
    assert sorted((r.page_id or 0, r.n_entries, r.first_list) for r in got if r.blocked) == [(0, 1, "hosts"), (2, 1, "hosts"), (2, 1, "hosts"), (3, 2, "hosts"), (4, 1, "more"), (6, 1, "paths"), (8, 1, "urls")]
    none = spark.createDataFrame([], EVENTS)
    assert not any(r.blocked for r in match_lists(frame, none, Scratch(spark, "t")).collect())
    assert match_lists(frame.limit(0), none, Scratch(spark, "t")).count() == 0


def test_deep_prefixes_and_hosts(spark):
    deep, labels = "/".join(f"p{k}" for k in range(100)), ".".join(["a"] * 140)
    events = [("prefix", f"site.org/{deep}", "paths", day(1), "add"), ("domain", f"{labels}.com", "hosts", day(1), "add")]
    captures = [(1, f"http://site.org/{deep}/more", day(2)), (2, f"http://site.org/{deep}x", day(2)), (3, f"http://b.{labels}.com/", day(2))]
    got = match_lists(spark.createDataFrame([(*c, "x") for c in captures], CAPTURES), spark.createDataFrame(events, EVENTS), Scratch(spark, "t")).collect()
    assert sorted((r.page_id, r.first_list) for r in got if r.blocked) == [(1, "paths"), (3, "hosts")]


def test_every_kind_is_hit_in_the_query(spark):
    import duckdb

    from briarlake.llm import queries
    from tests.llm import brute

    got = sorted((r.page_id, r.n_entries, r.first_list, r.blocked) for r in queries.op7_url_filters(spark, brute.SMALL).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{brute.SMALL}/pages.parquet'")
    want = con.execute(f"SELECT page_id, n_entries, first_list, blocked FROM ({queries.ORACLE_SQL['op7_url_filters'].strip()})").fetchall()
    assert got == sorted(want) and {"hosts", "urls", "paths"} <= {r[2] for r in got}


def test_entries_and_captures_in_other_spellings(spark):
    entries = [("domain", "B.com", 1), ("domain", "bücher.de", 2), ("domain", "*.wild.org.", 3), ("prefix", "A.com/x/", 4), ("prefix", "http://c.net//deep//er/", 5), ("url", "HTTP://One.net", 6), ("domain", "[2001:db8::1]", 7), ("prefix", "nohost", 8), ("domain", "", 9)]
    events = [(k, p, f"l{n}", day(1), "add") for k, p, n in entries] + [("domain", "b.COM", "l1", day(1), "add")]
    urls = ["http://www.b.com/", "http://xn--bcher-kva.de/", "http://BÜCHER.de:80/q", "http://x.wild.org", "https://a.com/x", "http://c.net/deep/er/end", "http://one.net/#frag", "http://[2001:DB8::1]:8080/p", "http://nohost.org/"]
    got = match_lists(spark.createDataFrame([(k, u, day(2), "x") for k, u in enumerate(urls)], CAPTURES), spark.createDataFrame(events, EVENTS), Scratch(spark, "t")).collect()
    assert {urls[r.page_id]: (r.n_entries, r.first_list) for r in got if r.blocked} == dict(zip(urls[:8], [(1, f"l{n}") for n in (1, 2, 2, 3, 4, 5, 6, 7)], strict=True))


def test_ports_dots_and_escapes(spark):
    entries = [("url", "http://a.com/x", 1), ("prefix", "a.com:80/y/", 2), ("url", "https://b.com/%7eu/%c3%a9?q=%41", 3), ("prefix", "b.com/d/../e", 4), ("url", "//c.com/x", 5), ("domain", "d.com", 6), ("url", "http://e.com/a/", 7), ("url", "http://f.com:443/", 8)]
    urls = {
        "http://a.com:80/x": 1, "http://A.com/%78": 1, "http://a.com/z/../x": 1, "http://a.com/./x": 1, "http://a.com/%2e%2E/../x": 1, "//a.com/y/k": 2, "http://a.com/x/../y": 2, "http://a.com:8080/y/1": 2,
        "https://b.com:443/~u/%C3%A9?q=A#f": 3, "//u@b.com/e/": 4, "//c.com/q/../x": 5, "//www.d.com": 6, "http://e.com/a/b/..": 7, "http://e.com/a/.": 7, "http://f.com:443/": 8,
    }
    free = ["http://a.com:443/x", "https://a.com:80/x", "http://a.com/%2Fx", "http://a.com/x/", "http://a.com/x%", "http://a.com/x/..", "http://a.com/..x", "http://c.com/x", "http://f.com/", "//", "/a.com/x"]
    captures = [*urls, *free]
    got = match_lists(spark.createDataFrame([(k, u, day(2), "x") for k, u in enumerate(captures)], CAPTURES), spark.createDataFrame([(k, p, f"l{n}", day(1), "add") for k, p, n in entries], EVENTS), Scratch(spark, "t")).collect()
    assert {captures[r.page_id]: (r.n_entries, r.first_list) for r in got if r.blocked} == {u: (1, f"l{n}") for u, n in urls.items()}


def test_sql_brings_urls_to_the_same_form(spark, tmp_path):
    import duckdb

    from briarlake.llm import queries

    odd = ["http://a.com:80/x/../y//z", "HTTPS://A.com:443/%7e%41/%2f?b=%63%2F", "//b.com/a/./b/..", "https://c.com/../..", "http://c.com?x", "http://c.com:8080/%zz%", None, "none", "http://d.com/" + "p/../" * 50 + "q"]
    spark.createDataFrame([(k, odd[k % len(odd)] and odd[k % len(odd)] + "x" * (k // len(odd)), "") for k in range(300)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.n_entries, r.first_list, r.blocked) for r in queries.op7_url_filters(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT page_id, n_entries, first_list, blocked FROM ({queries.ORACLE_SQL['op7_url_filters'].strip()})").fetchall()) and sum(r[3] for r in got) > 30
