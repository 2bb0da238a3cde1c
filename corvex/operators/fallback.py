"""Provider fallback as a table: which target of a chain answered a call, after which attempts.

Nothing here calls a provider: what each attempt came to is a row of the input, from a log or a script, and the rule is a
condition on ordered rows, so the calls of a log are judged all at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a call without an answer ends as.
UNAVAILABLE, AUTH = "unavailable", "auth"


def route_calls(calls: DataFrame, chains: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The results of calls, and the log of the attempts made.

    calls: call_id, profile. chains: profile, position (from 0), provider, registered, max_retries. outcomes: call_id,
    position, attempt (from 0), error (null: it succeeded), retryable; a transport error is retryable whatever the row says, and an
    attempt without a row is one; of several rows of an attempt a success counts, then the first error by name. Targets are tried in order, those not registered are passed over. A target is tried again
    while its error is retryable and retries are left. A success ends the call; so does an authentication error that is not
    retried at the chain's last target; any other failure goes on to the next target.

    Results: call_id, status (succeeded, auth, unavailable), provider (null without success), attempt_count, retry_count,
    fallback_used (not the chain's first target). A profile without a chain is unavailable. Repeated calls count once.
    Log: call_id, number (from 1), provider, status, error, retryable.
    """
    asked = calls.select("call_id", "profile").dropDuplicates(["call_id"])
    last = F.max("position").over(Window.partitionBy("profile"))
    targets = asked.join(chains.withColumn("last", last), "profile").where("registered")
    told = outcomes.groupBy("call_id", "position", "attempt").agg(F.min_by(F.struct("error", "retryable"), F.coalesce("error", F.lit(""))).alias("o"), F.lit(True).alias("known"))
    told = told.select("call_id", "position", "attempt", "o.error", "o.retryable", "known")
    each = targets.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.col("max_retries")))).join(told, ["call_id", "position", "attempt"], "left")
    error = F.when(F.col("known"), F.col("error")).otherwise("transport")
    each = each.withColumn("error", error).withColumn("retryable", F.col("error").isNotNull() & ((F.col("error") == "transport") | F.coalesce("retryable", F.lit(False))))
    # a target's attempts end with the first that is not retried
    order = Window.partitionBy("call_id", "position").orderBy("attempt")
    ends = ~F.col("retryable") | (F.col("attempt") == F.col("max_retries"))
    ended = F.coalesce(F.max(ends.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = each.withColumn("ended", ended).where("ended = 0").withColumn("ends", ends)
    # a call ends with the first success, or a last target's authentication error
    over = F.col("ends") & (F.col("error").isNull() | ((F.col("error") == AUTH) & (F.col("position") == F.col("last"))))
    run = Window.partitionBy("call_id").orderBy("position", "attempt")
    done = F.coalesce(F.max(over.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = made.withColumn("over", over).withColumn("done", done).where("done = 0").withColumn("number", F.row_number().over(run))
    won = F.col("over") & F.col("error").isNull()
    found = kept.groupBy("call_id").agg(
        F.max(F.when(F.col("over"), F.coalesce("error", F.lit("succeeded")))).alias("status"), F.max(F.when(won, F.col("provider"))).alias("provider"), F.count("*").alias("attempt_count"),
        F.count_if(F.col("attempt") > 0).alias("retry_count"), F.coalesce(F.bool_or(won & (F.col("position") > 0)), F.lit(False)).alias("fallback_used"),
    )
    results = asked.join(found, "call_id", "left").select(
        "call_id", F.coalesce("status", F.lit(UNAVAILABLE)).alias("status"), "provider", F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"),
        F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"))
    return results, kept.select("call_id", "number", "provider", F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), "error", "retryable")
