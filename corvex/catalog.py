"""All queries of the library by name, with the equivalent DuckDB SQL where SQL can express them."""

from corvex.plans import audio, evaluation, folds, lexical, more, outline, relational, retrieval, scalars, streams  # noqa: F401
from corvex.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
