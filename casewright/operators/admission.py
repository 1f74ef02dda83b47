"""Message admission (trim, reject blank, reject over-long, top_k range)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions.text import py_strip

# Admission limits.
MAX_MESSAGE_CHARS = 2000
TOP_K_MIN, TOP_K_MAX = 1, 10


def flag_messages(df: DataFrame, text_col: str, top_k_col: str | None = None) -> DataFrame:
    """Every row with (accepted, reject_reason); nothing is dropped or joined, so repeated ids stay as they are."""
    msg = py_strip(text_col)
    reason = (F.when(F.col(text_col).isNull() | (msg == ""), F.lit("empty"))
               .when(F.length(msg) > MAX_MESSAGE_CHARS, F.lit("too_long")))
    if top_k_col:
        reason = reason.when(~F.col(top_k_col).between(TOP_K_MIN, TOP_K_MAX), F.lit("bad_top_k"))
    return df.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())


def admit_messages(df: DataFrame, id_col: str, text_col: str, top_k_col: str | None = None) -> DataFrame:
    """Id, trimmed message and verdict of every message."""
    return flag_messages(df, text_col, top_k_col).select(F.col(id_col), py_strip(text_col).alias("message"), "accepted", "reject_reason")
