"""Messages of a conversation (survey S12, S13; the gate, S11, is ``functions.text.gate``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_of(messages: DataFrame, role: str, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last message (by, turn, text) of a role in each conversation; conversations without one are left out."""
    return messages.filter(F.col("role") == role).groupBy(by).agg(F.max(order).alias(order), F.max_by("text", order).alias("text"))


def token_estimate(messages: DataFrame, by: str = "conv_id", text: str = "text", chars: int = 4) -> DataFrame:
    """(by, jetons): four characters a token, rounded up, over all messages; a null text counts nothing."""
    return messages.groupBy(by).agg(F.ceil(F.coalesce(F.sum(F.length(text)), F.lit(0)) / chars).alias("jetons"))
