"""Parsers of free text that are state machines: result lists, JSON in prose, profile pages."""

from __future__ import annotations

import json
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Y

# Fixed values.
OWN_HOSTS = ("bing.com", "microsoft.com", "msn.com", "live.com", "bingapis.com", "azure.com", "microsoftedge.com")
NOISE = ("activity", "posts", "reactions", "comments", "featured", "recommendations", "interests", "groups", "people also viewed", "people you may know", "similar profiles", "licenses & certifications", "volunteering", "footer", "more profiles")
SECTIONS = {"about": ("about", "summary"), "experience": ("experience",), "education": ("education",), "skills": ("skills",)}
LIMITS = {"about": 6, "experience": 12, "education": 4, "skills": 10}
LOGIN_WALLS = ("sign in to view", "authwall", "join linkedin", "linkedin login")

_LINK = re.compile(r"\[([^\]]+)\]\((https?://[^\s)]+)\)")


def markdown_results(text: str | None) -> list[tuple[str, str, str]]:
    """(title, url, content) of each linked result; the lines after a link are its snippet."""
    out: list[list] = []
    open_ = False
    for line in filter(None, map(str.strip, (text or "").split("\n"))):
        head = re.match(r"#{0,6}\s*" + _LINK.pattern, line)
        link = head or (None if open_ else _LINK.search(line))
        if link:
            host = urlsplit(link[2]).hostname or ""
            usable = len(link[1].strip()) > 1 and not host.removeprefix("www.").startswith(OWN_HOSTS)
            if head or usable:
                open_ = usable
            if usable:
                out.append([link[1].strip(), link[2], []])
                continue
            if head:
                continue
        if open_ and not line.startswith(("![", "---", "***")):
            out[-1][2].append(line)
    return [(t, u, re.sub(r"\s+", " ", " ".join(s)).strip() or t) for t, u, s in out]


_RESULT = Y.ArrayType(Y.StructType([Y.StructField(n, Y.StringType()) for n in ("title", "url", "content")]))


@F.pandas_udf(_RESULT)
def _results(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("title", "url", "content"), r, strict=True)) for r in markdown_results(t)])


def linked_results(text: Column) -> Column:
    """The linked results of a text, in Arrow batches: an array of (title, url, content)."""
    return _results(text)


def json_in_text(text: str | None, required: tuple[str, ...] = ()) -> str | None:
    """The first JSON object with the required keys: in a marked block, else without reasoning and fences, else anywhere."""
    source = text or ""
    marked = re.search(r"FINAL_JSON_START\s*(.*?)\s*FINAL_JSON_END", source, re.S | re.I)
    plain = re.sub(r"<think>.*?</think>", "", source, flags=re.S | re.I)
    decoder = json.JSONDecoder()
    for body in filter(None, (marked and marked[1], plain, source)):
        for start in re.finditer(r"[{\[]", body):
            try:
                found, _ = decoder.raw_decode(body, start.start())
            except ValueError:
                continue
            if isinstance(found, dict) and all(k in found for k in required) or isinstance(found, list) and not required:
                return json.dumps(found, ensure_ascii=False)
    return None


def clean_line(line: str) -> str:
    line = re.sub(r"^[-*+]\s*", "", re.sub(r"^#{1,6}\s*", "", line))  # a bullet after a heading's mark goes too
    line = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", line)
    return " ".join(re.sub(r"[*_`]", "", line).split())


def _heads(line: str, names: tuple[str, ...]) -> bool:
    return any(line == n or line.startswith(f"{n} ") for n in names)


def profile(text: str | None) -> dict:
    """Name, headline, company, location and sections of a profile page, and its quality: good, partial or bad."""
    body = " ".join((text or "").split())
    low = body.lower()
    if any(w in low for w in LOGIN_WALLS) and not any(w in low for w in ("experience", "education", "about", "summary")) or len(body) < 80:
        return {"quality": "bad"}
    lines = list(filter(None, map(clean_line, (text or "").split("\n"))))
    every = tuple(n for names in SECTIONS.values() for n in names)
    found: dict[str, list[str]] = {s: [] for s in SECTIONS}
    section = None
    for line in lines:
        lower = line.lower()
        entered = next((s for s, names in SECTIONS.items() if _heads(lower, names)), None)
        if entered:
            section = entered
        elif _heads(lower, NOISE):
            section = None
        elif section and len(found[section]) < LIMITS[section]:
            found[section].append(line)
    header = [x for x in lines if len(x) > 1 and x.lower() not in NOISE + every and not any(w in x.lower() for w in ("linkedin", "cookie", "privacy policy"))][:8]
    name = next((x for x in header if 2 <= len(x.split()) <= 5 and "|" not in x and "@" not in x), None)
    headline = next((x for x in header if x != name and 15 < len(x) < 180), None)
    firm = re.search(r"\bat\s+([^|,;]+)", headline or " ".join(found["experience"]), re.I)
    place = next((x for x in header if re.search(r",\s*[A-Z]{2}\b|United States|Canada|United Kingdom|Australia|UAE|Remote", x)), None)
    core = bool(name and (headline or firm or found["experience"]))
    rich = bool(found["about"] or len(found["experience"]) >= 3 or len(found["skills"]) >= 3)
    return {"quality": "good" if core and rich else "partial" if core else "bad", "name": name, "headline": headline, "company": firm and firm[1].strip()[:100], "location": place, "n_experience": len(found["experience"])}


_TEXT_FIELDS = ("quality", "name", "headline", "company", "location")


@F.pandas_udf(Y.StructType([*[Y.StructField(n, Y.StringType()) for n in _TEXT_FIELDS], Y.StructField("n_experience", Y.LongType())]))
def _profiles(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([profile(t) for t in texts], columns=[*_TEXT_FIELDS, "n_experience"], dtype=object)  # strings of pandas may come in chunks, which no struct takes


def parsed_profile(text: Column) -> Column:
    return _profiles(text)


def extracted_json(text: Column, required: tuple[str, ...] = ()) -> Column:
    """The JSON with the required keys that a text holds, in Arrow batches; null if there is none."""

    @F.pandas_udf(Y.StringType())
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json_in_text(t, required))

    return found(text)
