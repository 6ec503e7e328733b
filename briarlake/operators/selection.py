"""Selection of candidates: caps, entropy, marginal relevance, scheduling."""

from __future__ import annotations

import heapq
import json
import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from briarlake.functions import text as T
from briarlake.functions.numeric import clamp, fixed
from briarlake.functions.sampling import POSTERIOR, gamma_sql, least_sql, ratio_sql
from briarlake.functions.scoring import arm_score, fused_arm_score, sigmoid
from briarlake.scratch import Scratch


def company_cap(rows: DataFrame, company: Column, score: str, most: int) -> DataFrame:
    """The best `most` rows per company by score and id; rows without a company are each their own.

    Spark plans the rank filter with a group limit before the shuffle, so a hot
    company sends few rows.
    """
    key = F.coalesce(F.nullif(F.lower(F.trim(company)), F.lit("")), F.concat(F.lit("unknown:"), F.col("id").cast("string")))
    order = Window.partitionBy("_company").orderBy(F.col(score).desc(), "id")
    return rows.withColumn("_company", key).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_company", "_n")


def entropy_spread(rows: DataFrame, score: str) -> DataFrame:
    """Adds `normalized`: scores drawn from their mean by 1 + .15 (Hmax - H) / Hmax. Scores are positive.

    H = log2(S) - sum(s log2 s) / S comes from three sums, not from the pool.
    """
    s = F.col(score)
    stats = rows.agg(F.count("*").alias("_n"), F.sum(s).alias("_t"), F.sum(s * F.log2(s)).alias("_w"))
    h, most = F.log2("_t") - F.col("_w") / F.col("_t"), F.log2("_n")
    factor = F.when(F.col("_n") < 2, 1.0).otherwise(fixed(F.try_divide(most - h, most) * 0.15 + 1, 9))
    mean = F.col("_t") / F.col("_n")
    return rows.crossJoin(F.broadcast(stats)).withColumn("normalized", fixed(clamp(mean + (s - mean) * factor, 1, 10))).drop("_n", "_t", "_w")


def criteria_hits(body: Column, spec: dict[str, list[str]]) -> Column:
    """How many criteria have one of their values in the text."""
    hits = F.lit(0)
    for values in spec.values():
        any_of = F.lit(False)
        for v in values:
            any_of = any_of | body.contains(v.lower())
        hits = hits + F.when(any_of, 1).otherwise(0)
    return hits


def mmr(rows: DataFrame, count: int, balance: float = 0.75, most: int = 4096) -> DataFrame:
    """(id, position): greedy maximal marginal relevance over all rows, as a rule in one job.

    Of rows of one firm and place, which are alike to all others, only the best
    `count` can be chosen; the `most` best of these by rank come to the driver and
    all picks are made there, lazily: a heap holds each class of like rows by the
    value it had when it was last looked at, which can only fall. No row that
    stayed behind is worth more than its rank alone, so a pick above that bound is
    exact; should one fall to it, the picks from there on each take a pass over all.
    """
    firm, place = T.company_name(F.col("company")), F.lower(T.text(F.col("location")))
    scratch = Scratch(rows.sparkSession, "mmr")
    scored = scratch.keep(rows.where("rank IS NOT NULL").select("id", "rank", "company", "location"))  # scores are long expressions: computed once
    seen = scored.select("id", "rank", firm.alias("firm"), T.distinctive_words(F.col("company")).alias("words"), place.alias("place"))
    alike = Window.partitionBy("firm", "place").orderBy(F.col("rank").desc(), "id")
    pool = seen.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= count).drop("n")
    top = pool.orderBy(F.col("rank").desc(), "id").limit(most + 1).collect()
    bound = balance * (top[most - 1]["rank"] / 10) if len(top) > most else -math.inf
    chosen = _greedy(top[:most], count, balance, bound)
    if len(chosen) < count and len(top) > most:
        chosen = _by_passes(scratch.keep(pool), chosen, count, balance)
    return rows.sparkSession.createDataFrame([(c["id"], k + 1) for k, c in enumerate(chosen)], "id long, position long")


def _likeness(a: Row, b: Row) -> float:
    same = a["firm"] and b["firm"] and (a["firm"] == b["firm"] or not set(a["words"]).isdisjoint(b["words"]))
    return (0.8 if same else 0.0) + (0.2 if a["place"] and a["place"] == b["place"] else 0.0)


def _greedy(rows: list[Row], count: int, balance: float, bound: float) -> list[Row]:
    """The picks whose value is above `bound`, at most `count`."""
    classes: dict[tuple, list[Row]] = {}
    for r in rows:  # by falling rank, then id
        classes.setdefault((r["firm"], tuple(r["words"]), r["place"]), []).append(r)
    worth = lambda r, closest: balance * (r["rank"] / 10) - (1 - balance) * closest
    heap = [(-worth(own[0], 0.0), -own[0]["rank"], own[0]["id"], 0, 0.0, key) for key, own in classes.items()]
    heapq.heapify(heap)
    chosen: list[Row] = []
    while heap and len(chosen) < count:
        value, _, _, known, closest, key = heapq.heappop(heap)
        best = classes[key][0]
        if known < len(chosen):
            closest = max(closest, *(_likeness(best, p) for p in chosen[known:]))
            heapq.heappush(heap, (-worth(best, closest), -best["rank"], best["id"], len(chosen), closest, key))
            continue
        if -value <= bound:
            break
        chosen.append(classes[key].pop(0))
        if classes[key]:
            after = classes[key][0]
            heapq.heappush(heap, (-worth(after, closest), -after["rank"], after["id"], known, closest, key))
    return chosen


def _by_passes(pool: DataFrame, chosen: list[Row], count: int, balance: float) -> list[Row]:
    """The picks after those that are made, each by a pass over the pool."""
    alike_to = lambda p: F.when((F.col("firm") != "") & (p["firm"] != "") & ((F.col("firm") == p["firm"]) | F.arrays_overlap("words", p["words"])), 0.8).otherwise(0.0)
    near_to = lambda p: F.when((F.col("place") != "") & (F.col("place") == p["place"]), 0.2).otherwise(0.0)
    while len(chosen) < count:  # what is chosen is one literal, so every pass runs the same compiled code
        picks = F.from_json(F.lit(json.dumps([c.asDict() for c in chosen])), "array<struct<id: bigint, firm: string, words: array<string>, place: string>>")
        closest = F.aggregate(picks, F.lit(0.0), lambda most, p: F.greatest(most, alike_to(p) + near_to(p)))
        value = F.lit(balance) * (F.col("rank") / 10) - F.lit(1 - balance) * closest
        left = pool.where(~F.exists(picks, lambda p: p["id"] == F.col("id")))
        best = left.agg(F.max_by(F.struct("id", "firm", "words", "place"), F.struct(value, F.col("rank"), -F.col("id")))).first()[0]
        if best is None:
            break
        chosen.append(best)
    return chosen


def diversified(rows: DataFrame, limit: int, per_company: int, share: float = 0.3) -> DataFrame:
    """(id, position): the first rows of the skyline (`skyline` is true) are guaranteed, then entropy, company cap and marginal relevance.

    The scored rows are written once and read by each step.
    """
    kept = Scratch(rows.sparkSession, "diversified").keep(rows.select("id", "company", "location", "rank", "skyline"))
    reserved = [r.id for r in kept.where("skyline").orderBy("id").limit(math.ceil(limit * share)).select("id").collect()]  # share * limit at most
    spread = entropy_spread(kept.withColumn("_s", F.greatest("rank", F.lit(1.0))), "_s").withColumn("rank", sigmoid(F.col("normalized"))).drop("_s", "normalized")
    capped = company_cap(spread, T.text(F.col("company")), "rank", per_company)
    found = mmr(capped.where(~F.col("id").isin(reserved)) if reserved else capped, limit - len(reserved))
    first = rows.sparkSession.createDataFrame([(x, k + 1) for k, x in enumerate(reserved)], "id long, position long")
    return first.unionByName(found.withColumn("position", F.col("position") + len(reserved)))


ARM = ("outcome_runs", "qualified", "returned", "uniques", "rescued", "duplicates", "units", "latency_ms")


def beta_samples(arms: DataFrame) -> DataFrame:
    """Adds `sample`, a Beta draw of each arm's posterior, and `first_sample`, one of Beta(1.5, 1), both seeded by the arm's scope."""
    scoped = arms.withColumns({"_scope": F.concat_ws("|", "family", "lane", "provider"), "_a": F.expr(least_sql(POSTERIOR[0])), "_b": F.expr(least_sql(POSTERIOR[1]))})
    drawn = scoped.withColumns({"_x": F.expr(gamma_sql("_scope", "x", "_a")), "_y": F.expr(gamma_sql("_scope", "y", "_b")), "_fx": F.expr(gamma_sql("_scope", "x", "1.5D")), "_fy": F.expr(gamma_sql("_scope", "y", "1.0D"))})
    return drawn.withColumns({"sample": F.expr(ratio_sql("_x", "_y")), "first_sample": F.expr(ratio_sql("_fx", "_fy"))}).drop("_scope", "_a", "_b", "_x", "_y", "_fx", "_fy")


def scored_arms(arms: DataFrame, total: Column) -> DataFrame:
    """Adds `score` by mean reward and exploration, and `fused` with Thompson sampling."""
    columns = {c: F.col(c) for c in ARM}
    return beta_samples(arms).withColumns({"score": arm_score(columns, total), "fused": fused_arm_score(columns, total, F.col("sample"), F.col("first_sample"))})


def cover(tasks: list[dict], most: int) -> list[dict]:
    """Greedy set cover of the requirements, one person task if there is any, then the best by score.

    `tasks` are ordered by score, priority and index; each has id, lane and covers.
    """
    chosen: list[dict] = []
    open_ = {r for t in tasks for r in t["covers"]}
    while open_:
        best = max((t for t in tasks if t not in chosen), key=lambda t: len(open_ & set(t["covers"])), default=None)
        if best is None or not open_ & set(best["covers"]):
            break
        chosen.append(best)
        open_ -= set(best["covers"])
    if not any(t["lane"] == "person" for t in chosen):
        chosen += [t for t in tasks if t["lane"] == "person" and t not in chosen][:1]
    for t in tasks:
        if len(chosen) >= most:
            break
        if t not in chosen:
            chosen.append(t)
    return sorted(chosen, key=tasks.index)


#: What a task shares with all tasks of its arm.
_KIND = ("family", "lane", "provider")


def scheduled(tasks: DataFrame, arms: DataFrame, most: int = 3, least_outcomes: int = 8, enabled: bool = True, sampling: bool = True) -> DataFrame:
    """(id, priority) of the tasks to run, by set cover, person guard and arm score, with draws if `sampling`.

    All tasks run with their own priorities unless there are more than `most`
    (1 to 8) and the arms have `least_outcomes` behind them. Tasks that cover the
    same requirements in the same lane are alike to the greedy choice, so only the
    best of each such class reach the driver, as many as there are requirements
    and places: 2 to the number of requirements (nine at most) classes a lane.
    Draws and scores are made once for each family, lane and provider.
    """
    most = min(max(most, 1), 8)
    known = arms.select(F.concat_ws("|", "family", "lane", "provider").alias("_arm"), *ARM)
    total = arms.agg(F.coalesce(F.sum("outcome_runs"), F.lit(0))).first()[0]
    if not enabled or total < max(least_outcomes, 1) or len(tasks.select("id").limit(most + 1).collect()) <= most:
        return tasks.select("id", F.col("priority").cast("int").alias("priority"))
    rows = tasks.select("id", "family", "lane", F.col("preference").alias("provider"), "priority", F.array_sort(F.array_distinct("covers")).alias("covers"))
    kinds = rows.select(*_KIND).distinct().join(known, F.concat_ws("|", *_KIND) == F.col("_arm"), "left").fillna(0, list(ARM))
    kinds = scored_arms(kinds, F.lit(total)).select(*[F.col(c).alias(f"_{c}") for c in _KIND], fixed(F.col("fused" if sampling else "score"), 6).alias("score"))
    scratch = Scratch(tasks.sparkSession, "scheduled")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _KIND))
    scored = rows.join(scratch.keep(kinds), same).select("id", "lane", "priority", "covers", "score")
    kept = scratch.keep(scored)
    order = [F.col("score").desc(), F.col("priority").asc(), F.col("id").asc()]
    best = kept.withColumn("_n", F.row_number().over(Window.partitionBy("lane", "covers").orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    chosen = cover([r.asDict() for r in best.orderBy(*order).collect()], most)
    return tasks.sparkSession.createDataFrame([(t["id"], k + 1) for k, t in enumerate(chosen)], "id long, priority int")
