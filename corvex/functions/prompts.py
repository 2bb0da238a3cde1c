"""Prompt texts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grounded_prompt(question: Column, blocks: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Question: "), question), F.lit("Sources:"), F.array_join(blocks, "\n\n"))


def planning_prompt(question: Column, blocks: Column, query_class: Column) -> Column:
    """Asks for a JSON plan of the answer."""
    return F.concat_ws("\n", F.concat(F.lit("Question type: "), query_class), grounded_prompt(question, blocks), F.lit('Reply with JSON: {"points": [], "sources": []}'))


def verification_prompt(question: Column, draft: Column, blocks: Column) -> Column:
    """Asks whether the sources carry the draft."""
    return F.concat_ws("\n", grounded_prompt(question, blocks), F.concat(F.lit("Draft: "), draft), F.lit('Reply with JSON: {"supported": true, "issues": []}'))
