"""Prompt templates. Every character, trailing blanks included, is fixed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _text(column: Column, null_token: str) -> Column:
    return F.coalesce(column.cast("string"), F.lit(null_token))


def classifier_text(priority: Column, description: Column, initial: Column, null_token: str = "") -> Column:
    """Input of the recommendation classifier; the description stays raw."""
    return F.concat(
        F.lit("Priority: "), _text(priority, null_token),
        F.lit(". Description: "), _text(description, null_token),
        F.lit(". Initial Rec: "), _text(initial, null_token),
        F.lit(". "),
    )


def summary_prompt(topic: Column, cleaned: Column, priority: Column, recommendation: Column, null_token: str = "") -> Column:
    """Prompt given to the generator when serving."""
    return F.concat(
        F.lit("[TOPIC: "), _text(topic, null_token),
        F.lit("] Finding: "), _text(cleaned, null_token),
        F.lit(" | Priority: "), _text(priority, null_token),
        F.lit(" | New recommendation: "), _text(recommendation, null_token),
        F.lit(" | "),
    )


def seq2seq_input(topic: Column, cleaned: Column, null_token: str = "") -> Column:
    return F.concat(
        F.lit("Topic: "), _text(topic, null_token),
        F.lit(". Description: "), _text(cleaned, null_token),
        F.lit(". Generate maintenance recommendation:"),
    )


def seq2seq_target(actions: Column, null_token: str = "") -> Column:
    return F.concat(F.lit("Actions: "), _text(actions, null_token))
