"""Exact deduplication by skew-safe combining.

Rows are combined three times, and each time a group is the digest *and* the whole text, so two texts that only share
a digest stay apart:

1. locally: rows are salted by their partition, so the map side of the first aggregation leaves one row for each text of
   an input partition, however often the text stands there;
2. by (digest, salt): the local winners of a digest meet in ``salts`` places, so that a text which every partition holds
   doesn't send all its local winners to one task;
3. by digest: at most ``salts`` winners of a text meet.

No group is ever collected: all that a group keeps is its largest doc_id and its size. Membership then comes back by
the digest alone, which is exact where a digest has one text; digests with several texts, if any, are joined by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import quoted, whole_text, written

SALTS = 16


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return df.select(F.col(id_col).alias("doc_id"), _digest(text).alias("digest"), text.alias("body"))


def _salt(salts: int) -> Column:
    return F.pmod(F.spark_partition_id(), F.lit(salts))


def salted_winners(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Stages 1 and 2: digest, salt, body, keep_id, group_size. With as many salts as partitions, the rows of stage 1 as they leave their partitions."""
    rows = _digests(df, id_col, text_col).withColumn("salt", _salt(salts))
    return rows.groupBy("digest", "salt", "body").agg(F.max("doc_id").alias("keep_id"), F.sum(F.lit(1).cast("long")).alias("group_size"))


def winners(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each different text: digest, body, keep_id (its largest id; null if no row has one), group_size."""
    salted = salted_winners(df, id_col=id_col, text_col=text_col, salts=salts)
    return salted.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def assign(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; a null id is smaller than any other. Of equal texts the row with the largest id stays.
    Of rows that repeat both id and text exactly one stays. Extra columns are ignored. An empty table gives an empty result.
    """
    found = written(winners(df, id_col=id_col, text_col=text_col, salts=salts).drop("body"), "exact-dedup")
    rows = _digests(df, id_col, text_col)
    clash = found.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    if clash.isEmpty():
        members = _repeats(rows.select("doc_id", "digest"), ["digest"]).join(found, "digest")
    else:  # different texts under one digest: their rows are told apart by the texts themselves
        members = _repeats(rows.join(clash, "digest", "left_anti").select("doc_id", "digest"), ["digest"]).join(found, "digest")
        again = rows.join(clash, "digest", "left_semi")
        bodies = winners(again.withColumnRenamed("body", "text"), salts=salts)
        members = members.unionByName(_repeats(again, ["digest", "body"]).join(bodies, ["digest", "body"]).drop("body"))
    return members.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _repeats(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with copy, which numbers those that agree in id and text from 1; they are counted, not ordered, so no task gets them all."""
    counted = rows.groupBy("doc_id", *by).agg(F.count(F.lit(1)).alias("copies"))
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of df that stay, with all their columns: of equal texts one with the largest id.

    The winners carry their other columns along, so the texts are shuffled as often as in assign() and not once more.
    Nulls are as there; of rows that repeat id and text any one stays. Columns of df may have any names.
    """
    rest = [c for c in df.columns if c != text_col]
    text = whole_text(text_col)
    row = F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(rest)], F.col(text_col).isNull().alias("none"), F.struct(F.col(id_col)).alias("order"))
    rows = df.select(_digest(text).alias("digest"), _salt(salts).alias("salt"), text.alias("body"), row.alias("row"))
    salted = rows.groupBy("digest", "salt", "body").agg(F.max_by("row", "row.order").alias("row"))
    best = salted.groupBy("digest", "body").agg(F.max_by("row", "row.order").alias("row"))
    columns = {c: F.col(f"row.c{k}") for k, c in enumerate(rest)} | {text_col: F.when(~F.col("row.none"), F.col("body"))}
    return best.select(*[columns[c].alias(c) for c in df.columns])
