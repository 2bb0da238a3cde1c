"""Mutable tables over immutable files: replacement, upserts, folds of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("succeeded", "dead_letter", "failed", "cancelled")


def replace_by_key(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in `fresh` give way to it. As a write: dynamic partition overwrite by key."""
    return old.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def upsert(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, from `fresh` where it has one."""
    return old.join(fresh, keys, "left_anti").unionByName(fresh)


def insert_ignore(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(fresh.join(old, keys, "left_anti"))


def partial_update(old: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of the patch that are not null win."""
    columns = [c for c in old.columns if c not in keys]
    new = patch.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return old.join(new, keys, "left").select(*keys, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


def fold_jobs(updates: DataFrame, key: str) -> DataFrame:
    """Latest status, first start, last end and number of retries of each job from its updates (job_id, created_at, status)."""
    when = lambda *s: F.when(F.col("status").isin(*s), F.col("created_at"))
    return updates.groupBy(key).agg(
        F.max_by("status", F.struct("created_at", "job_id")).alias("status"), F.min(when("processing")).alias("started_at"), F.max(when(*TERMINAL)).alias("finished_at"), F.count_if(F.col("status") == "retrying").alias("attempts"))
