"""Command executions: observations of tool runs, and failures that a later success resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, ascii_lower, truncate_output

KEY = ("runtime", "project", "session", "command")


def resolutions(obs: DataFrame) -> DataFrame:
    """observations (runtime, session, project, turn_key, source_order, history_epoch, execution_index, command, status, output_excerpt, completed_at) -> one row for each success that ends one or more failures of the same command.

    Rows of a key are in order of epoch, source order and index. Unknown rows count for nothing. The excerpt is that of the last failure.
    """
    order = Window.partitionBy(*KEY).orderBy("history_epoch", "source_order", "execution_index")
    known = obs.where(F.col("status").isin("failed", "succeeded"))
    island = F.coalesce(F.sum((F.col("status") == "succeeded").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = known.withColumn("island", island).withColumn("at", F.struct("history_epoch", "source_order", "execution_index"))
    failed, won = F.col("status") == "failed", F.col("status") == "succeeded"
    pick = lambda f, c, when: f(F.when(when, F.col(c)), F.when(when, F.col("at")))
    out = d.groupBy(*KEY, "island").agg(
        F.count_if(failed).alias("failure_count"),
        F.count_if(won).alias("successes"),
        pick(F.min_by, "turn_key", failed).alias("first_failure_turn"),
        pick(F.max_by, "turn_key", failed).alias("last_failure_turn"),
        pick(F.max_by, "output_excerpt", failed).alias("failure_excerpt"),
        pick(F.max_by, "turn_key", won).alias("success_turn"),
        pick(F.max_by, "execution_index", won).alias("success_index"),
        pick(F.max_by, "output_excerpt", won).alias("success_excerpt"),
        pick(F.max_by, "completed_at", won).alias("verified_at"),
    )
    return out.where("failure_count > 0 AND successes = 1").drop("island", "successes")


def search_resolutions(found: DataFrame, q: str, project: str | None = None, limit: int = 50) -> DataFrame:
    """The newest resolutions whose command or an excerpt contains q, A-Z in any case."""
    # The same fold for both sides: A-Z only.
    like = "%" + q.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%"
    hit = ascii_lower(F.col("command")).like(like) | ascii_lower(F.col("failure_excerpt")).like(like) | ascii_lower(F.col("success_excerpt")).like(like)
    if project is not None:
        hit = hit & (F.col("project") == project)
    return found.where(hit).orderBy(F.desc("verified_at"), *KEY).limit(limit)


def list_observations(obs: DataFrame, session: str | None = None) -> DataFrame:
    d = obs if session is None else obs.where(F.col("session") == session)
    return d.orderBy("history_epoch", "source_order", "execution_index")


def extract_executions(uses: DataFrame, results: DataFrame) -> DataFrame:
    """uses (session, message, block, tool_id, tool_name, command), results (session, message, tool_id, place, content, is_error) -> observations with execution_index, in order of message and block within the session.

    A use needs a command and a result. Results of one use that differ make it unknown; else is_error decides, and unknown without it.
    """
    same = results.groupBy("session", "message", "tool_id").agg(F.count_distinct(F.struct("content", F.coalesce(F.col("is_error").cast("string"), F.lit("")))).alias("kinds"), F.min_by("is_error", "place").alias("error"), F.min_by("content", "place").alias("first"))
    status = F.when(F.col("kinds") > 1, "unknown").when(F.col("error"), "failed").when(~F.col("error"), "succeeded").otherwise("unknown")
    found = uses.where("command IS NOT NULL").join(same, ["session", "message", "tool_id"])
    index = F.row_number().over(Window.partitionBy("session").orderBy("message", "block")) - 1
    return found.select("session", "message", "tool_name", "command", status.alias("status"), truncate_output(F.col("first")).alias("output_excerpt"), index.alias("execution_index"))


def replace_turn(obs: DataFrame, incoming: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """obs with the executions of turns (runtime, session, turn_key; default: incoming's) replaced by incoming's; a turn may have none."""
    key = ["runtime", "session", "turn_key"]
    return obs.join((incoming if turns is None else turns).select(*key).distinct(), key, "left_anti").unionByName(incoming.select(*obs.columns))
