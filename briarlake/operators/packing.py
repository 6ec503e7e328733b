"""Order-dependent packing and bounded selections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from briarlake.functions.text import sentences
from briarlake.operators.order import folded
from briarlake.scratch import Scratch


# Parts of the URLs of posts.
POSTS = ("linkedin.com/posts", "linkedin.com/feed/update", "linkedin.com/activity", "linkedin.com/pulse")


def token_chunks(rows: DataFrame, group: str, order: str, text: str, budget: int, most: int | None = None) -> DataFrame:
    """(group, n_chunks, n_chars): blocks of a group in order fill chunks of `budget` tokens (four characters each), `most` blocks at most.

    A block over the budget is cut to it. Lengths, not texts, are shuffled.
    """
    size = F.coalesce(F.least(F.length(text), F.lit(budget * 4)), F.lit(0)).cast("long")

    def step(state: tuple, n: int) -> tuple:
        held, blocks, chunks, total = state
        if not chunks or -(-(held + n) // 4) > budget or most is not None and blocks >= most:
            return n, 1, chunks + 1, total + n
        return held + n, blocks + 1, chunks, total + n

    kind = rows.schema[group].dataType.simpleString()
    sized = rows.select(group, order, size.alias("n"))
    return folded(sized, group, [order], ["n"], lambda: (0, 0, 0, 0), step, lambda s: s[2:], f"{group} {kind}, n_chunks long, n_chars long")


def cutline(rows: DataFrame, target: int, most: int, swing: float = 0.39) -> DataFrame:
    """(id, in_bubble): rows near the rank of place `target` first, then from the top.

    The cut is found by a top-k; no window over all rows.
    """
    cut = rows.orderBy(F.col("rank").desc(), "id").limit(target).agg(F.min("rank").alias("_cut"))
    near = F.abs(F.col("rank") - F.col("_cut")) <= swing
    joined = rows.crossJoin(F.broadcast(cut)).select("id", "rank", near.alias("in_bubble"))
    return joined.orderBy(F.col("in_bubble").desc(), F.col("rank").desc(), "id").limit(most).select("id", "in_bubble")


def rescued(rows: DataFrame, group: str, target: int, share: float) -> DataFrame:
    """(group, id, verdict): all rows that are `qualified`, and in groups with fewer than `target` of them the best others of other URLs, up to the target or `share` of it.

    The scored rows are written once. Counts and URLs of the qualified come from
    partial aggregates, and the rank filter has a group limit before its shuffle.
    """
    scratch = Scratch(rows.sparkSession, "rescued")
    kept = scratch.keep(rows.select(group, "id", "qualified", "rank", F.coalesce("url", F.lit("")).alias("url")))
    good = kept.where("qualified")
    urls = scratch.keep(good.select(F.col(group).alias("_g"), F.col("url").alias("_u")).distinct())
    counts = scratch.keep(good.groupBy(F.col(group).alias("_c")).agg(F.count("*").alias("_n")))
    others = kept.where("NOT qualified").join(urls, F.col(group).eqNullSafe(F.col("_g")) & (F.col("url") == F.col("_u")), "left_anti")
    most = math.ceil(target * share)
    order = Window.partitionBy(group).orderBy(F.col("rank").desc(), "id")
    best = others.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).join(counts, F.col(group).eqNullSafe(F.col("_c")), "left")
    extra = best.where(F.col("_k") <= target - F.coalesce("_n", F.lit(0)))
    return good.select(group, "id", F.lit("qualified").alias("verdict")).unionByName(extra.select(group, "id", F.lit("rescued").alias("verdict")))


def post_snippets(results: DataFrame, search: str, most: int = 5, others: int = 3, chars: int = 1000) -> DataFrame:
    """(search, n_snippets, first_url, context) from (search, seq, url, title, content): of a search the first posts, else its first results.

    The rank filter has a group limit before its shuffle, so a hot search sends few rows.
    """
    lower = F.lower(F.coalesce("url", F.lit("")))
    post = F.lit(False)
    for part in POSTS:
        post = post | lower.contains(part)
    order = Window.partitionBy(search).orderBy(F.col("_post").desc(), "seq")
    first = results.withColumn("_post", post).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?i)\s*[-|]\s*linkedin.*$", ""))
    line = F.array_join(F.filter(F.array(title, F.trim(F.coalesce("content", F.lit("")))), lambda x: x != ""), " - ")
    found = first.where(F.col("_post") | (F.col("_n") <= others)).withColumn("_line", line)
    grouped = found.groupBy(search).agg(F.max("_post").alias("_any"), F.array_sort(F.collect_list(F.struct("_n", "_post", "url", "_line"))).alias("_r"))
    taken = F.filter("_r", lambda r: r["_post"] | ~F.col("_any"))
    lines = F.filter(F.transform(taken, lambda r: r["_line"]), lambda x: x != "")
    context = F.substring(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("[Post snippet]: "), x)), "\n"), 1, chars)
    return grouped.select(search, F.size(lines).cast("long").alias("n_snippets"), F.get(taken, F.lit(0))["url"].alias("first_url"), context.alias("context"))


def best_email(lines: DataFrame, key: str) -> DataFrame:
    """(key, best_email): mailto before contact lines before others, then the first line."""
    line = F.lower("line")
    mail = F.regexp_extract(line, r"[a-z0-9._-]+@[a-z0-9-]+(\.[a-z0-9-]+)+", 0)
    rank = F.when(line.contains("mailto:"), 3).when(line.rlike(r"\b(email|contact|reach\s+me|reach\s+out)\b"), 2).otherwise(1)
    good = (mail != "") & (F.split_part(mail, F.lit("@"), F.lit(2)) != "example.com") & ~F.split_part(mail, F.lit("@"), F.lit(1)).rlike("^no-?reply$")
    return lines.where(good).groupBy(key).agg(F.min_by(mail, F.struct(-rank, "k")).alias("best_email"))


def evidence_sentences(docs: DataFrame, terms: list[str], budget: int) -> DataFrame:
    """(doc_id, n_chosen, n_chars, n_covered): per document the best sentence for each term, then the densest, within the budget.

    Sentences are ranked once by how many terms they hold; choices fold over that
    order in column expressions. A sentence counts 280 characters at most and is
    passed over below 24, the choice ends when fewer than 60 are left.
    """
    has = lambda s: F.array(*[F.lower(s).contains(t) for t in terms])
    scratch = Scratch(docs.sparkSession, "evidence")
    split = docs.select("doc_id", F.transform(sentences(F.col("text")), lambda s, k: F.struct(k.alias("k"), F.length(s).alias("n"), has(s).alias("has"))).alias("_found"))
    split = scratch.keep(split)  # texts are read and split once
    ranked = F.array_sort(F.transform("_found", lambda x: F.struct((-F.size(F.filter(x["has"], lambda h: h))).alias("rank"), x["k"].alias("k"), x["n"].alias("n"), x["has"].alias("has"))))

    def taken(state: Column, item: Column) -> Column:
        size = F.least(item["n"], F.lit(280), state["left"])
        fits = (state["left"] >= 60) & (size >= 24) & ~F.array_contains(state["chosen"], item["k"])
        return F.struct(
            F.when(fits, state["left"] - size - 1).otherwise(state["left"]).alias("left"), F.when(fits, F.array_append(state["chosen"], item["k"])).otherwise(state["chosen"]).alias("chosen"),
            F.when(fits, F.zip_with(state["covered"], item["has"], lambda a, b: a | b)).otherwise(state["covered"]).alias("covered"),
        )

    none = F.struct(F.lit(budget).alias("left"), F.array().cast("array<int>").alias("chosen"), F.array(*[F.lit(False) for _ in terms]).alias("covered"))
    found = scratch.keep(split.select("doc_id", ranked.alias("_items"))).withColumn("_s", none)
    new_of = lambda j: lambda x: x["has"][j] & ~F.array_contains(F.col("_s.chosen"), x["k"])
    for j in range(len(terms)):
        best = F.slice(F.filter("_items", new_of(j)), 1, 1)
        found = found.select("doc_id", "_items", F.aggregate(best, F.col("_s"), taken).alias("_s"))
    done = found.select("doc_id", F.aggregate("_items", F.col("_s"), taken).alias("_s"))
    covered = F.size(F.filter("_s.covered", lambda x: x))
    return done.select("doc_id", F.size("_s.chosen").cast("long").alias("n_chosen"), (F.lit(budget) - F.col("_s.left")).cast("long").alias("n_chars"), covered.cast("long").alias("n_covered"))
