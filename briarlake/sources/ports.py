"""Ports to external services, with offline stand-ins over tables.

Search, scraping and language models are replaceable functions from batches of
keys to batches of rows. They run where the data is, in bounded batches, and
only on keys that no cache answers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briarlake.functions import scoring as K
from briarlake.functions import text as T
from briarlake.sources import parsers

#: Messages of a body that came back empty; only these are worth another try. With a snippet it is a challenge page.
EMPTY_BODY = re.compile(r"^(?!.*response snippet).*unexpected non-json response", re.IGNORECASE | re.DOTALL)

Fetch = Callable[[list[str]], list[str | None]]


def scraped(targets: DataFrame, url: str, fetch: Fetch, batch: int = 5, retries: int = 1) -> DataFrame:
    """(url, content) of each distinct URL, fetched in batches; a failed one has null content.

    After a failed batch its children are fetched one at a time; a child whose
    body came back empty is asked for `retries` (2 at most) times more.
    """

    def alone(one: str) -> str | None:
        for _ in range(1 + min(max(retries, 0), 2)):
            try:
                found = fetch([one])[0]
            except Exception as error:
                if not EMPTY_BODY.search(str(error)):
                    return None
                continue
            if found:
                return found
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            urls = frame["url"].tolist()
            out: list[str | None] = []
            for k in range(0, len(urls), batch):
                part = urls[k : k + batch]
                try:
                    found = list(fetch(part))
                except Exception:
                    found = [None] * len(part)
                out += [x or alone(u) for u, x in zip(part, found, strict=True)]
            yield pd.DataFrame({"url": urls, "content": out})

    return targets.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct().mapInPandas(run, "url string, content string")


def offline_pages(targets: DataFrame, url: str, pages: DataFrame) -> DataFrame:
    """The same from a table of pages instead of the network."""
    asked = targets.select(F.col(url).alias("_u")).where("_u IS NOT NULL").distinct()
    return asked.join(pages, F.col("_u") == F.col("url"), "left").select(F.col("_u").alias("url"), F.col("html").alias("content"))


def answered(candidates: DataFrame, prompt: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """Adds `answer`: a model's text for each prompt, in Arrow batches."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return pd.Series(model(prompts.tolist()), index=prompts.index)

    return candidates.withColumn("answer", ask(F.col(prompt)))


Model = Callable[[list[str]], list[str]]

#: What the model is asked; the braces are filled from columns.
PROMPTS = {
    "signals": "List 10 to 25 keyword phrases of one to three words that a company's site would show if this brief fits: {brief}\nRequirements: {requirements}\nAnswer in JSON: dynamic_signals, and categorized with tooling, hiring, pain and growth.",
    "post_intent": "Prospect: {name} ({title} at {company})\nOffer: {brief}\nPosts:\n{posts}\nAnswer in JSON: intentCategory, confidenceScore, keywords, reason.",
    "company": "Which company is hiring?\nTitle: {title}\nURL: {url}\nText: {content}\nAnswer in JSON: company.",
    "profile": "Turn this text into one profile.\n{text}\nAnswer in JSON: fullName, currentTitle, currentCompany, location, skills.",
}


def prompt(kind: str, **columns: Column) -> Column:
    """The prompt of a kind with its braces filled; nulls are empty."""
    parts = re.split(r"\{(\w+)\}", PROMPTS[kind])
    return F.concat(*[F.coalesce(columns[x].cast("string"), F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def _asked(rows: DataFrame, wanted: Column, text: Column, model: Model) -> DataFrame:
    """Adds `answer` for rows that are `wanted`; the model sees no other."""
    ask = rows.withColumn("_prompt", F.when(wanted, text))

    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        some = prompts[prompts.notna()]
        if len(some):
            try:
                out[some.index] = model(some.tolist())
            except Exception:  # a failed call is a missing answer: the fallback holds
                pass
        return out

    return ask.withColumn("answer", answer("_prompt")).drop("_prompt")


def compiled_signals(briefs: DataFrame, model: Model) -> DataFrame:
    """Adds `signals` (30 at most) and `fingerprint` to rows of brief, mode and requirements; a single-stream brief or a failed answer has none and `fallback`."""
    asked = _asked(briefs, F.col("mode") == "dual_stream_intent", prompt("signals", brief=F.col("brief"), requirements=F.col("requirements")), model)
    kinds = ("tooling", "hiring", "pain", "growth")
    parsed = F.from_json("answer", f"dynamic_signals array<string>, categorized struct<{', '.join(f'{k}: array<string>' for k in kinds)}>")
    lists = [parsed["dynamic_signals"], *[parsed["categorized"][k] for k in kinds]]
    some = F.flatten(F.array(*[F.coalesce(T.dynamic_signals(x), F.array().cast("array<string>")) for x in lists]))
    made = asked.withColumn("signals", F.slice(F.array_distinct(some), 1, 30)).drop("answer")
    return made.withColumn("fingerprint", T.signal_fingerprint(F.col("signals")))


CATEGORIES = ("hiring", "evaluating_tools", "pain_signal", "growth_signal", "general", "none")


def classified_posts(posts: DataFrame, model: Model) -> DataFrame:
    """Adds category, confidence and quality to rows of posts, brief, name, title, company; under 50 characters of posts the model isn't asked."""
    text = prompt("post_intent", **{c: F.col(c) for c in ("name", "title", "company", "brief", "posts")})
    asked = _asked(posts, F.length("posts") >= 50, text, model)
    parsed = F.from_json("answer", "intentCategory string, confidenceScore double")
    named = F.lower(parsed["intentCategory"])
    made = asked.withColumn("category", F.when(named.isin(*CATEGORIES), named).otherwise("none"))
    made = made.withColumn("confidence", F.coalesce(F.least(F.greatest(parsed["confidenceScore"], F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).drop("answer")
    return made.withColumn("quality", K.post_quality(F.col("category"), F.col("confidence")))


def company_hints(observations: DataFrame, model: Model) -> DataFrame:
    """`hint` as it is, else, for contents of 120 characters or more, the model's company, cut to 80."""
    text = prompt("company", title=F.col("title"), url=F.col("url"), content=F.substring("content", 1, 400))
    asked = _asked(observations, (F.coalesce("hint", F.lit("")) == "") & (F.length("content") >= 120), text, model)
    found = F.substring(F.trim(F.from_json("answer", "company string")["company"]), 1, 80)
    return asked.withColumn("hint", F.coalesce(F.nullif("hint", F.lit("")), found, F.lit(""))).drop("answer")


def pasted_profiles(inputs: DataFrame, fetch: Fetch, model: Model) -> DataFrame:
    """(id, quality, name, headline, company, location, n_experience) of pasted texts or URLs; a URL is scraped first.

    The parser reads it; where that finds no profile the model is asked for name,
    title and company.
    """
    is_url = F.trim("pasted").rlike(r"^(?i:https?)://\S+$")
    pages = scraped(inputs.where(is_url).select(F.trim("pasted").alias("pasted")), "pasted", fetch).withColumnRenamed("url", "_url")
    texts = inputs.join(pages, is_url & (F.trim("pasted") == F.col("_url")), "left").select("id", F.when(is_url, F.col("content")).otherwise(F.col("pasted")).alias("text"))
    read = texts.withColumn("p", parsers.parsed_profile(F.col("text"))).select("id", "text", "p.*")
    asked = _asked(read, (F.col("quality") == "bad") & (F.length("text") > 0), prompt("profile", text=F.col("text")), model)
    answer = F.from_json("answer", "fullName string, currentTitle string, currentCompany string, location string")
    named = F.col("name").isNull() & (F.coalesce(answer["fullName"], F.lit("")) != "")
    return asked.select(
        "id", F.when(named, "partial").otherwise(F.col("quality")).alias("quality"), F.coalesce("name", answer["fullName"]).alias("name"), F.coalesce("headline", answer["currentTitle"]).alias("headline"),
        F.coalesce("company", answer["currentCompany"]).alias("company"), F.coalesce("location", answer["location"]).alias("location"), "n_experience",
    )
