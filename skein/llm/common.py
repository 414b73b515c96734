"""Helpers shared by the training-data operators: staged tables, hash splits, schemas."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.sources.staging import discard, new_folder, shared_dir, stage

__all__ = ["discard", "id_bucket", "names_aside", "new_folder", "shared_dir", "stage", "with_fields"]


def id_bucket(column: str | Column, n: int) -> Column:
    """``crc32`` of the id's decimal text modulo ``n`` (null ids: of the empty text)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with further fields behind it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def names_aside(*known: str):
    """For functions of a table that keep its other columns: those not ``known`` go in under plain names and come back under
    their own, whatever these are, so they never meet a name of the function's. Names inside are ``other_0`` and so on."""

    def wrap(f):
        @functools.wraps(f)
        def run(docs: DataFrame, *args, **named) -> DataFrame:
            plain = {c: f"other_{i}" for i, c in enumerate(c for c in docs.columns if c not in known)}
            back = {v: k for k, v in plain.items()}
            out = f(docs.select(*(F.col(f"`{c}`").alias(plain.get(c, c)) for c in docs.columns)), *args, **named)
            return out.select(*(F.col(c).alias(back.get(c, c)) for c in out.columns))

        return run

    return wrap
