"""Exact deduplication by 128-bit content hash, with DataFrame functions only.

Texts are equal when they are identical after all ASCII white space is deleted (their form). Rows
are grouped by the 128-bit hash of the form and by the form itself, so the members of a group are
compared byte by byte and a collision of hashes can't merge different texts. Of a group, the row
with the longest original text stays, then the one with the smallest id.

A group of copies may be any share of all rows: groups are combined within each task before the
shuffle (one row per task and distinct text, values of fixed width). Rows then learn their group's
result through a join of narrow rows on two digests of the form, which Spark splits where it is
skewed; the rows that stay are fetched by (digests, rank), which spreads the copies of a text.

Defined results: a null text counts as empty, so null and empty texts are copies of each other; a
null id ranks after any other; of rows that repeat id and text, one stays; extra columns pass
through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .words import free_name

# Fixed value: the characters a comparison ignores.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
_TWO_63 = "9223372036854775808"
_TWO_65 = "36893488147419103232"


def normal_form(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, "")


def _rank(doc_id: Column, text: Column) -> Column:
    """One fixed-width number that orders rows by length in code points, then by smaller id, null last."""
    length = F.char_length(F.coalesce(text.cast("string"), F.lit(""))).cast("decimal(10,0)")
    id_part = F.coalesce(F.lit(_TWO_63).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    return (length * F.lit(_TWO_65).cast("decimal(20,0)") + id_part).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    id_part = rank % F.lit(_TWO_65).cast("decimal(38,0)")
    return F.when(id_part > 0, (F.lit(_TWO_63).cast("decimal(38,0)") - id_part).cast("long"))


def find_groups(docs: DataFrame) -> DataFrame:
    """Written table of the groups of equal texts: hash, sha256, group_size, best (the rank of the row that stays)."""
    rows = docs.select(normal_form(F.col("text")).alias("form"), _rank(F.col("doc_id"), F.col("text")).alias("rank"))
    groups = (
        rows.groupBy(F.md5(F.col("form").cast("binary")).alias("hash"), "form")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("rank").alias("best"))
        .select("hash", F.sha2(F.col("form").cast("binary"), 256).alias("sha256"), "group_size", "best")
    )
    return Workspace(docs.sparkSession, "exact").write(groups, "groups")


def find_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    form = normal_form(F.col("text")).cast("binary")
    rows = docs.select(F.md5(form).alias("hash"), F.sha2(form, 256).alias("sha256"), _rank(F.col("doc_id"), F.col("text")).alias("rank"))
    repeats = rows.groupBy("hash", "sha256", "rank").agg(F.count(F.lit(1)).cast("int").alias("repeats"))
    return (
        repeats.join(find_groups(docs), ["hash", "sha256"])
        .withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
        .select(
            _id_of(F.col("rank")).alias("doc_id"),
            _id_of(F.col("best")).alias("keep_id"),
            "group_size",
            ((F.col("rank") == F.col("best")) & (F.col("repeat") == 1)).alias("kept"),
            F.col("sha256").alias("text_sha256"),
        )
    )


def remove_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    keys = [free_name(docs.columns, k) for k in ("hash", "sha256", "rank")]
    form = normal_form(F.col("text")).cast("binary")
    digests = [F.md5(form), F.sha2(form, 256), _rank(F.col("doc_id"), F.col("text"))]
    kept = find_groups(docs).select(*[F.col(c).alias(k) for c, k in zip(("hash", "sha256", "best"), keys, strict=True)])
    number = free_name([*docs.columns, *keys], "number")
    once = Window.partitionBy(*keys).orderBy(*keys)  # more than one row only where id and text repeat
    return (
        docs.withColumns(dict(zip(keys, digests, strict=True)))
        .join(kept, keys)
        .withColumn(number, F.row_number().over(once))
        .where(F.col(number) == 1)
        .select(*docs.columns)
    )
