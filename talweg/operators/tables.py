"""Reading and changing tables: filtered lists, look-ups, partial updates, deletes, set synchronisation, replacement."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.text import blank, normal_email


def all_of(*tests: Column | None) -> Column:
    """Conjunction of the tests that are given."""
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ``ids`` (column ``key``); none of them, no rows."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def in_order(ids: DataFrame, df: DataFrame, key: str = "id", position: str = "position") -> DataFrame:
    """Rows of ``df`` for each requested id with its position; unknown ids drop out, repeated requests stay."""
    return ids.join(df, key).orderBy(position)


def contains_any(word: str, *columns: str) -> Column:
    """Case-blind match in any column; % and _ in the word stand for any characters, as in LIKE."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{word}%"), F.lit(False)) for c in columns])


def json_contains(column: str, word: str) -> Column:
    """Case-blind match in the value's JSON text, field names included."""
    return F.coalesce(F.lower(F.to_json(column)).like(f"%{word.lower()}%"), F.lit(False))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def newest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest row of every key, by an aggregate that is combined before the shuffle."""
    whole = F.struct(*df.columns)
    # max of (time, row) would order by the row itself on ties; the tie column is stated instead
    best = df.groupBy(key).agg(F.max_by(whole, F.struct(at, tie)).alias("_row"))
    return best.select("_row.*")


def lookup_email(df: DataFrame, email: str, at: str = "updated_at") -> DataFrame:
    return df.where(normal_email(F.col("email")) == email.strip().lower()).orderBy(F.desc_nulls_last(at)).limit(1)


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` with ``rows`` appended; e-mail addresses are stored in lower case without blanks around them."""
    if "email" in rows.columns:
        rows = rows.withColumn("email", normal_email(F.col("email")))
    return df.unionByName(rows, allowMissingColumns=True)


def update(df: DataFrame, patch: DataFrame, key: str = "id", allowed: Sequence[str] | None = None) -> DataFrame:
    """Partial update: a non-null value of the patch replaces the old one, null keeps it, and only ``allowed`` columns change.

    Keys the table does not have are ignored. A key patched twice takes the last non-null values in no stated order, so patches should be unique.
    """
    columns = [c for c in patch.columns if c != key and c in df.columns and (allowed is None or c in allowed)]
    named = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(named, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def update_present(df: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Partial update in which nulls count too: column c is replaced where the patch's has_c is true."""
    columns = [c for c in df.columns if c in patch.columns and f"has_{c}" in patch.columns]
    named = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], *[F.col(f"has_{c}").alias(f"_has_{c}") for c in columns])
    joined = df.join(named, key, "left")
    return joined.select(*[F.when(F.coalesce(F.col(f"_has_{c}"), F.lit(False)), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_empty(df: DataFrame, patch: DataFrame, key: str, replace: Sequence[str] = ()) -> DataFrame:
    """Takes the patch's values where the table has null or blank; columns in ``replace`` take them whenever they are there."""
    columns = [c for c in patch.columns if c != key and c in df.columns]
    types = dict(df.dtypes)
    joined = df.join(patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns]), key, "left")

    def empty(c: Column, kind: str) -> Column:
        if kind == "string":
            return blank(c)
        return c.isNull() | (F.size(c) == 0) if kind.startswith("array") else c.isNull()

    def value(c: str) -> Column:
        new, old = F.col(f"_new_{c}"), F.col(c)
        if c in replace:
            return F.when(~empty(new, types[c]), new).otherwise(old)
        return F.when(empty(old, types[c]), F.coalesce(new, old)).otherwise(old)

    return joined.select(*[value(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def delete(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows left after deleting those whose values in the columns of ``keys`` are in it."""
    return df.join(keys.distinct(), keys.columns, "left_anti")


def synchronise(stored: DataFrame, desired: DataFrame, owner: Sequence[str], member: str) -> DataFrame:
    """Per owner in ``desired``: members not desired go, others are updated or added; other owners stay as they are."""
    owners = desired.select(*owner).distinct()
    others = stored.join(owners, list(owner), "left_anti")
    return others.unionByName(desired.where(F.col(member).isNotNull()), allowMissingColumns=True)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes the groups in ``df`` in place of the stored ones of the same ``by``; other groups stay, and nothing is half replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def first_of(df: DataFrame, key: str, test: Column, order: Sequence[Column]) -> DataFrame:
    """The first row of each key that passes the test."""
    return df.where(test).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
