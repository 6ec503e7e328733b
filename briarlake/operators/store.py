"""Writes as pure transforms: merges, audits, sessions; `upserts` has the bulk upsert, `versions` the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stage_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, from_stage, to_stage) where the stage differs."""
    new = after.select(F.col("id").alias("_id"), F.col("stage").alias("to_stage"))
    return before.join(new, F.col("id") == F.col("_id")).where(~F.col("stage").eqNullSafe(F.col("to_stage"))).select("id", F.col("stage").alias("from_stage"), "to_stage")


def merged_sessions(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates replace filled fields; a null checkpoint keeps the stored one."""
    new = updates.select(F.col("session_id").alias("_s"), F.col("status").alias("_status"), F.col("checkpoint_json").alias("_checkpoint"))
    return stored.join(new, F.col("session_id") == F.col("_s"), "left").select("session_id", F.coalesce("_status", "status").alias("status"), F.coalesce("_checkpoint", "checkpoint_json").alias("checkpoint_json"))


def orphans_interrupted(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")))


def replaced(leads: DataFrame) -> dict[str, DataFrame]:
    """The tables after the whole store is replaced by `leads` (id, revision, identity and more): leads, identities and conflicts.

    A revision that is no positive number becomes 1. An identity belongs to the
    first lead by id; each other lead of it is a conflict.
    """
    owners = leads.where("identity IS NOT NULL").groupBy("identity").agg(F.min("id").alias("lead_id"))
    meant = owners.select(F.col("identity").alias("_identity"), F.col("lead_id").alias("canonical_id"))
    conflicts = leads.join(meant, (F.col("identity") == F.col("_identity")) & (F.col("id") != F.col("canonical_id"))).select("identity", "canonical_id", F.col("id").alias("duplicate_id"))
    revision = F.when(F.col("revision") > 0, F.col("revision")).otherwise(1)
    return {"leads": leads.withColumn("revision", revision), "identities": owners, "conflicts": conflicts}


def identities_moved(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, k) with the keys of each pair's loser under its winner, distinct."""
    moves = pairs.select(F.col("loser").alias("_loser"), F.col("winner").alias("_winner"))
    return keys.join(moves, F.col("id") == F.col("_loser"), "left").select(F.coalesce("_winner", "id").alias("id"), "k").distinct()


def mergeable(leads: DataFrame, pairs: DataFrame) -> DataFrame:
    """(winner, loser) of the pairs that may merge: two stored leads, the winner at the expected revision, no other prospect holding its identity.

    `pairs` has winner, loser, revision. A lead is merged once at a time: of the
    pairs that share a lead the least (winner, loser) counts, if it is the least
    of both its leads.
    """
    stored = leads.select("id", "revision", "identity")
    holder = stored.where("identity IS NOT NULL").groupBy(F.col("identity").alias("_held")).agg(F.min("id").alias("_holder"))
    known = pairs.where("winner <> loser").join(stored.select(F.col("id").alias("loser")), "loser", "left_semi").select("winner", "loser", F.col("revision").alias("_expected"))
    checked = known.join(stored, F.col("winner") == F.col("id")).join(holder, F.col("identity") == F.col("_held"), "left")
    allowed = checked.where((F.col("revision") == F.col("_expected")) & F.coalesce(F.col("_holder") == F.col("winner"), F.lit(True))).select("winner", "loser")
    ends = allowed.select("winner", "loser", F.explode(F.array("winner", "loser")).alias("_end"))
    least = ends.groupBy("_end").agg(F.min(F.struct("winner", "loser")).alias("_least"))
    ok = ends.join(least, "_end").groupBy("winner", "loser").agg(F.bool_and(F.struct("winner", "loser") == F.col("_least")).alias("_ok"))
    return ok.where("_ok").select("winner", "loser")


def merged_leads(leads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Leads after merging the (winner, loser) of `mergeable`: winners keep filled fields and take the loser's for the rest, tags unite, losers go.

    Leads have id, revision, company, email, tags. `merged_from` of a winner is
    the row of the activity log: the loser, else null.
    """
    lost = leads.select(F.col("id").alias("_lost"), F.col("company").alias("_company"), F.col("email").alias("_email"), F.col("tags").alias("_tags"))
    into = pairs.select(F.col("winner").alias("_winner"), F.col("loser").alias("_loser")).join(lost, F.col("_loser") == F.col("_lost"))
    rest = leads.join(pairs.select(F.col("loser").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")
    joined = rest.join(into, F.col("id") == F.col("_winner"), "left")
    won, filled = F.col("_winner").isNotNull(), lambda a, b: F.when(F.col("_winner").isNotNull(), F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))).otherwise(F.col(a))
    return joined.select("id", F.when(won, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"), filled("company", "_company").alias("company"), filled("email", "_email").alias("email"), F.when(won, F.array_union("tags", "_tags")).otherwise(F.col("tags")).alias("tags"), F.col("_loser").alias("merged_from"))


# Message patterns of provider failures, first match wins: reason, whether a retry may help, status codes, pattern.
FAILURES = (
    ("provider_auth", False, (401, 403), r"unauthorized|forbidden|invalid token|api[_ -]?token"),
    ("provider_quota", False, (), r"quota|credit|usage limit|limit exceeded|billing|payment"),
    ("provider_config", False, (), r"tool .*unavailable|missing tool|invalid configuration|missing config|zone .*not found|required zone|not configured"),
    ("request_invalid", False, (400,), r"mcp error -32602|parameter validation failed|request validation failed|must be a valid uri|string\.uri|array must contain at most"),
    ("transport_transient", True, (), r"connection closed|sse stream disconnected|stdio|process exited|terminated|econnreset|socket hang up|mcp error -32000"),
    ("target_transient", False, (), r"minimum of \d+\s*seconds?|recently failed and cannot be attempted|cannot be attempted at this time|repeat.{0,20}rejected|failed.{0,20}rejected"),
    ("target_transient", False, (), r"unexpected non-json response"),
    ("target_transient", True, (502, 503, 504), r"timed out|fetch failed|empty response|empty body|returned no content"),
    ("target_blocked", False, (), r"captcha|login wall|blocked|privacy checkpoint|sign in to view|authwall"),
)
_STATUS = (r"(?i)\b(?:http|status)\s*:?\s*(\d{3})\b", r"\b(4\d{2}|5\d{2})\b")


def _failure(message: Column, value: Callable[[str, bool], Column], default: Column) -> Column:
    lower = F.lower(message)
    told = F.nullif(F.regexp_extract(message, _STATUS[0], 1), F.lit(""))
    status = F.coalesce(told, F.regexp_extract(message, _STATUS[1], 1))
    return F.coalesce(*[F.when(status.isin(*map(str, codes)) | lower.rlike(p) if codes else lower.rlike(p), value(name, again)) for name, again, codes, p in FAILURES], default)


def failure_class(message: Column) -> Column:
    return _failure(message, lambda name, _: F.lit(name), F.lit("unknown"))


def retryable(message: Column) -> Column:
    """Lockouts and challenge pages are transient, but a retry within their 15 seconds only prolongs them."""
    return _failure(message, lambda _, again: F.lit(again), F.lit(False))


def disables_provider(kind: Column) -> Column:
    return kind.isin("provider_auth", "provider_quota", "provider_config")


def empty_body(message: Column) -> Column:
    """An answer without a body, which is worth one more try after a pause; one with a snippet is a challenge page."""
    lower = F.lower(message)
    return (failure_class(message) == "target_transient") & lower.contains("unexpected non-json response") & ~lower.contains("response snippet")


def backoff_ms(kind: Column, attempt: Column, base: int = 750) -> Column:
    """Doubling delay; transport failures start at five seconds."""
    return F.when(kind == "transport_transient", max(base, 5000)).otherwise(base) * F.pow(F.lit(2.0), attempt - 1)


class Migrations:
    """Forward-only steps (each DataFrame to DataFrame) over a table of numbered versions.

    Version n is the folder `version-n` and counts once Spark has finished it, so
    a run applies all its steps or none. Before a run, the table as it is goes to
    `snapshot-n`.
    """

    def __init__(self, spark: SparkSession, path: str, steps: list[Callable[[DataFrame], DataFrame]]):
        self.spark, self.path, self.steps = spark, path.rstrip("/"), steps

    def _finished(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def version(self) -> int | None:
        return next((n for n in range(len(self.steps), -1, -1) if self._finished(f"version-{n}")), None)

    def create(self, frame: DataFrame) -> None:
        frame.write.mode("overwrite").parquet(f"{self.path}/version-0")

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version-{self.version()}")

    def snapshot(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshot-{version}")

    def run(self) -> int:
        """Apply the steps after the table's version; returns the version reached."""
        at, frame = self.version(), self.table()
        if at < len(self.steps):
            frame.write.mode("overwrite").parquet(f"{self.path}/snapshot-{at}")
            for step in self.steps[at:]:
                frame = step(frame)
            frame.write.mode("overwrite").parquet(f"{self.path}/version-{len(self.steps)}")
        return len(self.steps)


def with_column_if_missing(frame: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    return frame if name in frame.columns else frame.withColumn(name, F.lit(default).cast(kind))


def round_robin(keys: list[str], healthy: set[str], start: int) -> str | None:
    """The next healthy key from `start` on."""
    for offset in range(len(keys)):
        key = keys[(start + offset) % len(keys)]
        if key in healthy:
            return key
    return None


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key."""
    window = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
