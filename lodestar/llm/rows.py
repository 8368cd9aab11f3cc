"""Row ids for tables in which ids may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_id(docs: DataFrame) -> Column:
    """``doc_id`` as a long; where it is null, a number beyond all ids that a hash of ``text`` gives, so that rows without an id and with one text are one document."""
    beyond = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    return F.coalesce(docs["doc_id"].cast("long"), beyond)


def named(docs: DataFrame, name: str = "_row") -> tuple[DataFrame, str]:
    """``docs`` with its row ids in a column whose name it does not have yet, and that name."""
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, row_id(docs)), name
