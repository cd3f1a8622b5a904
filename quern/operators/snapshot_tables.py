"""Reading rules shared by the operators over snapshot-table metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def location(c: Column | str) -> Column:
    """One spelling per object: the schemes s3, s3a and s3n become s3, repeated slashes after the scheme become one.

    Other schemes, and case, are kept. Null gives null, "" gives "". The regular expressions run only on odd spellings.
    """
    c = F.col(c) if isinstance(c, str) else c
    odd = F.regexp_replace(F.regexp_replace(c, r"^s3[an]?:/+", "s3://"), r"(?<!^s3:)(?<!^s3:/)/{2,}", "/")
    plain = c.startswith("s3://") & (F.instr(F.substring(c, 6, 1 << 30), "//") == 0) & (F.substring(c, 6, 1) != "/")
    return F.when(plain, c).otherwise(F.when(c.rlike(r"^s3[an]?:/"), odd).otherwise(c))


def number(c: Column | str) -> Column:
    """A header value written as text, as bigint; blanks around it do not count, anything that is no number gives
    null."""
    return F.trim(F.col(c) if isinstance(c, str) else c).try_cast("bigint")


def headers(manifest_lists: DataFrame) -> DataFrame:
    """The manifest-list headers as (snapshot_id, parent_snapshot_id, table_id, sequence_number), one row per snapshot.

    A file that repeats a snapshot adds nothing; where its values differ, the greatest known one is taken of each.
    Headers without a readable snapshot id are left out.
    """
    h = manifest_lists.select(
        number("snapshot_id").alias("snapshot_id"), number("parent_snapshot_id").alias("parent_snapshot_id"),
        F.col("table_id").cast("bigint").alias("table_id"), number("sequence_number").alias("sequence_number"),
    ).where("snapshot_id is not null")
    return h.groupBy("snapshot_id").agg(
        *(F.max(c).alias(c) for c in ("parent_snapshot_id", "table_id", "sequence_number"))
    )


def with_numbers(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """``entries`` with null sequence_number and snapshot_id filled from the manifest's row in ``listed``.

    Only the rows that lack a number are joined: the others never shuffle. A manifest without any known number leaves
    null. ``manifest_path`` of both sides is read as one spelling.
    """
    lacking = F.col("sequence_number").isNull() | F.col("snapshot_id").isNull()
    known = (
        listed.select(location("manifest_path").alias("_path"), "sequence_number", "added_snapshot_id")
        .groupBy("_path").agg(F.max("sequence_number").alias("_seq"), F.max("added_snapshot_id").alias("_snap"))
    )
    cols = entries.columns
    r = entries.where(lacking).select(
        F.struct(*(f"`{c}`" for c in cols)).alias("r"), location("manifest_path").alias("_path")
    ).join(known, "_path", "left")
    fill = {"sequence_number": "_seq", "snapshot_id": "_snap"}
    filled = r.select(*(F.coalesce(f"r.{c}", fill[c]).alias(c) if c in fill else F.col(f"r.`{c}`") for c in cols))
    return entries.where(~lacking).unionByName(filled)
