"""Parsers and ports over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briarlake.registry import Frames, query
from briarlake.sources import parsers, ports

C = F.col


@query("a10_page_extracts", "SELECT DISTINCT url, html AS content FROM pages WHERE url IS NOT NULL")
def _(f: Frames) -> DataFrame:
    """A9, A13 and A37 offline: all distinct URLs answered from the pages table."""
    return ports.offline_pages(f.pages, "url", f.pages).distinct()


_TITLE = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\[\]]', ' ', 'g'), '\s+', ' ', 'g'))"
_LINES = "list_filter(list_transform(string_split(array_to_string(regexp_extract_all(html, '<p>([^<]*)</p>', 1), chr(10)), chr(10)), lambda x: trim(x)), lambda x: NOT starts_with(x, '![') AND NOT starts_with(x, '---') AND NOT starts_with(x, '***'))"


@query("a12_markdown_results", rf"""WITH p AS (SELECT page_id, url, {_TITLE} AS title, trim(regexp_replace(array_to_string({_LINES}, ' '), '\s+', ' ', 'g')) AS content FROM pages)
 SELECT page_id, title, url, coalesce(nullif(content, ''), title) AS content FROM p WHERE length(title) > 1 AND regexp_matches(url, '^https?://[^\s)]+$')""")
def _(f: Frames) -> DataFrame:
    """Each page as its own result in a list of results, between an advert, a picture and a link of the engine's own: title, address and all paragraphs come from the page."""
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), r"[\[\]]", " "), r"\s+", " "))
    head = F.concat(F.lit("# Results\n[advert](https://www.bing.com/aclk)\n### ["), title, F.lit("]("), C("url"), F.lit(")\n\n![picture](http://pictures.example/x.png)\n"))
    shown = F.concat(head, F.array_join(F.expr("regexp_extract_all(html, '<p>([^<]*)</p>', 1)"), "\n"), F.lit("\n---\n## [More](https://www.msn.com/more)\nnoise at the end"))
    found = f.pages.where(C("url").rlike(r"^https?://[^\s)]+$")).select("page_id", F.explode(parsers.linked_results(shown)).alias("r"))
    return found.select("page_id", "r.title", "r.url", "r.content")


_CLEAN = r"lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^#{1,6}\s*|^[-*+]\s*', ''), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '[*_`]', '', 'g'), '\s+', ' ', 'g'))"
_TITLES = ", ".join(f"'{n}'" for n in (*parsers.NOISE, *(n for names in parsers.SECTIONS.values() for n in names)))


def _cleaned(lines: str) -> str:
    return f"list_filter(list_transform({lines}, {_CLEAN}), lambda x: x <> '')"


@query("h18_profile_parser", rf"""WITH r AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
 c AS (SELECT doc_id, {_cleaned("l[1:2]")} AS top, {_cleaned("l[3:4]")} AS about, {_cleaned("l[5:]")} AS jobs, {_cleaned("l[1:1]")} AS posts,
  length(trim(regexp_replace('# ' || array_to_string(l[1:2] || ['## About'] || l[3:4] || ['## Experience'] || l[5:] || ['## Activity'] || l[1:1], ' '), '\s+', ' ', 'g'))) >= 80 AS enough FROM r),
 h AS (SELECT *, list_filter(top || about || jobs || posts, lambda x: length(x) > 1 AND lower(x) NOT IN ({_TITLES}) AND NOT regexp_matches(lower(x), 'linkedin|cookie|privacy policy'))[1:8] AS heads FROM c),
 n AS (SELECT *, list_filter(heads, lambda x: len(string_split(x, ' ')) BETWEEN 2 AND 5 AND NOT regexp_matches(x, '[|@]'))[1] AS name, list_filter(heads, lambda x: regexp_matches(x, ',\s*[A-Z]{{2}}([^\pL\pN_]|$)|United States|Canada|United Kingdom|Australia|UAE|Remote'))[1] AS location FROM h),
 m AS (SELECT *, list_filter(heads, lambda x: x IS DISTINCT FROM name AND length(x) BETWEEN 16 AND 179)[1] AS headline FROM n),
 f AS (SELECT *, left(trim(nullif(regexp_extract(coalesce(headline, array_to_string(jobs[1:12], ' ')), '(?i)(?:^|[^\pL\pN_])at\s+([^|,;]+)', 1), '')), 100) AS company FROM m)
 SELECT doc_id, CASE WHEN NOT enough OR name IS NULL OR headline IS NULL AND company IS NULL AND len(jobs) = 0 THEN 'bad' WHEN len(about) > 0 OR len(jobs) >= 3 THEN 'good' ELSE 'partial' END AS quality,
  CASE WHEN enough THEN name END AS name, CASE WHEN enough THEN headline END AS headline, CASE WHEN enough THEN company END AS company, CASE WHEN enough THEN location END AS location, CASE WHEN enough THEN least(len(jobs), 12) END AS n_experience FROM f""")
def _(f: Frames) -> DataFrame:
    """H17 too: every document laid out as a profile, its first two lines as the head, two about, all others as experience; noise at the end goes."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    laid = F.concat(F.slice(lines, 1, 2), F.array(F.lit("## About")), F.slice(lines, 3, 2), F.array(F.lit("## Experience")), F.slice(lines, 5, 1 << 30), F.array(F.lit("## Activity")), F.slice(lines, 1, 1))
    found = f.documents.select("doc_id", parsers.parsed_profile(F.concat(F.lit("# "), F.array_join(laid, "\n"))).alias("p"))
    return found.select("doc_id", "p.quality", "p.name", "p.headline", "p.company", "p.location", "p.n_experience")


@query("h47_json_in_text", "SELECT doc_id, shape, CASE WHEN shape <> 'broken' THEN doc_id END AS n, CASE WHEN shape <> 'broken' THEN string_split(coalesce(text, ''), chr(10))[1] END AS head FROM documents, (VALUES ('marked'), ('fenced'), ('bare'), ('broken')) s(shape)")
def _(f: Frames) -> DataFrame:
    """Each document as the prose around an object with its id and first line: marked, fenced after reasoning, bare, and without its end."""
    text = F.coalesce("text", F.lit(""))
    made = F.to_json(F.struct(C("doc_id").alias("n"), F.split(text, "\n")[0].alias("head")))
    shapes = {
        "marked": F.concat(text, F.lit(' {"draft" FINAL_JSON_START '), made, F.lit(" FINAL_JSON_END "), text),
        "fenced": F.concat(F.lit('<think>{"n": 0, "head": ""}</think> '), text, F.lit("\n```json\n"), made, F.lit("\n```")),
        "bare": F.concat(text, F.lit(" {x [y] "), made, text),
        "broken": F.concat(text, F.lit(" "), F.expr("left(made, length(made) - 1)")),
    }
    shaped = f.documents.withColumn("made", made).withColumn("shape", F.explode(F.array(*map(F.lit, shapes))))  # names, not texts: one text at a time is held
    told = F.coalesce(*[F.when(C("shape") == n, t) for n, t in shapes.items()])
    read = shaped.select("doc_id", "shape", F.from_json(parsers.extracted_json(told, ("n", "head")), "n long, head string").alias("j"))
    return read.select("doc_id", "shape", "j.n", "j.head")
