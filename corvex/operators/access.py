"""Row-level access: sensitivity ceilings, membership semi-joins, metadata filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANKS = {"public": 1, "internal": 2, "confidential": 3, "restricted": 4}


def sensitivity_rank(value: Column, unknown: int = 2) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in RANKS.items():
        out = F.when(value == name, F.lit(rank)).otherwise(out)
    return F.coalesce(out, F.lit(unknown))


def within_ceiling(value: Column, ceiling: str | None) -> Column:
    """True up to the ceiling; an unknown value ranks as internal, an unknown ceiling as restricted, no ceiling lets all pass."""
    return F.lit(True) if ceiling is None else sensitivity_rank(value) <= RANKS.get(ceiling, 4)


def visible_chunks(chunks: DataFrame, workspace: str | None = None, document_ids: list[int] | None = None, metadata: dict | None = None, ceiling: str | None = None) -> DataFrame:
    """Child chunks of live documents in a workspace, by document ids, equal metadata columns and ceiling; plain filters, so they reach the scan."""
    out = chunks
    if workspace is not None:
        out = out.where(F.col("workspace_id") == workspace)
    if document_ids:
        out = out.where(F.col("document_id").isin(*document_ids))
    for key, value in (metadata or {}).items():
        out = out.where(F.col(key).isin(*value) if isinstance(value, list) else F.col(key) == value)
    return out.where(within_ceiling(F.col("sensitivity"), ceiling))


def split_filters(filters: dict) -> tuple[dict, list]:
    """The metadata part of a request's filters, and its document ids."""
    return {k: v for k, v in filters.items() if k != "document_ids"}, list(filters.get("document_ids", []))


def sanitize_filters(filters: dict) -> dict:
    """Scalars, and lists and dicts of them; nulls and what becomes empty go."""
    clean = {}
    for key, value in filters.items():
        if isinstance(value, dict):
            value = sanitize_filters(value)
        elif isinstance(value, list):
            value = [v for v in value if isinstance(v, (str, int, float, bool))]
        elif not isinstance(value, (str, int, float, bool)):
            continue
        if value not in ([], {}):
            clean[key] = value
    return clean


def secure_view(rows: DataFrame, members: DataFrame, user: str | None = None, roles: list[str] | None = None, active_only: bool = True) -> DataFrame:
    """Rows of workspaces in which the user (any, if none is given) has a membership; a semi-join, so rows never multiply."""
    seen = members
    if user is not None:
        seen = seen.where(F.col("user_id") == user)
    if roles:
        seen = seen.where(F.col("role").isin(*roles))
    if active_only:
        seen = seen.where("active")
    return rows.join(seen.select("workspace_id").distinct(), "workspace_id", "left_semi")


def group_visible(documents: DataFrame, entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Documents without entries in the access list, or with one for a group of the user (the historic rule)."""
    open_ = documents.join(entries.select("document_id").distinct(), "document_id", "left_anti")
    granted = documents.join(entries.join(groups, "group_id", "left_semi").select("document_id").distinct(), "document_id", "left_semi")
    return open_.unionByName(granted)


def highest_sensitivity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the highest value; unknown ones rank as internal, an empty group would be public."""
    return rows.groupBy(*keys).agg(F.max_by("sensitivity", sensitivity_rank(F.col("sensitivity")) * 10 + F.when(F.col("sensitivity").isin(*RANKS), 1).otherwise(0)).alias("highest"))
