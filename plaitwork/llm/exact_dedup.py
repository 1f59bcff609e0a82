"""Exact deduplication by skew-safe combining, in DataFrame functions only.

1. Locally: within each map task, rows of equal (digest, salt, normalised text) fold into one count and
   one best row, so a huge group of copies leaves a task as a few rows.
2. Salted digest groups: the folds of one (digest, salt, text) meet.  The salt is a hash of the id, so
   even a group that holds a third of all rows is spread over SALTS keys.
3. Globally: the at most SALTS winners of a (digest, text) meet, and each learns the group's winner.

The normalised text itself is a grouping key in all three stages, so two texts that share a digest are
never merged.  The winners, without texts, are written once as a table in the shared folder.  Rows then find
their group by (digest, salt); where that key holds more than one text (a digest collision), by the text itself.

Defined results: null text counts as empty; a null id sorts after every id; of equal texts the row with the most
code points in the original text stays, then the one with the smallest id.  Repeated rows (same id and text)
are each returned and each marked kept if their id is the one that stays.  An empty table gives an empty
result.  Columns other than id and text are left out, so extra columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaitwork.llm.common import SEPARATORS, fresh, whole_text, written

SALTS = 128
# A length and an id share one decimal(38,0).  An id's place is id + 2**63; a null one's is 2**64, above every id's.
_HALF, _WHOLE, _SHIFT = (f"{1 << n}BD" for n in (63, 64, 65))


def normalised(text: Column) -> Column:
    """The text without the characters U+0020 and U+0009 to U+000D."""
    return F.translate(text, SEPARATORS, "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256_hex, salts: int = SALTS) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, digest."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("_text"))
    rows = rows.select("doc_id", F.char_length("_text").alias("_chars"), normalised(F.col("_text")).alias("_norm"))
    rows = rows.withColumn("_digest", digest(F.col("_norm"))).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    place = f"coalesce(cast(doc_id as decimal(38,0)) + {_HALF}, {_WHOLE})"
    order = F.expr(f"cast(_chars as decimal(38,0)) * {_SHIFT} + {_SHIFT} - 1 - {place}").cast("decimal(38,0)")

    # most characters first, then the smallest id, is the largest of one number
    salted = rows.groupBy("_digest", "_salt", "_norm").agg(F.max(order).alias("_best"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_digest", "_norm")
    won = salted.withColumn("_top", F.max("_best").over(group)).withColumn("_size", F.sum("_n").over(group))
    won = won.withColumn("_place", F.expr(f"{_SHIFT} - 1 - pmod(_top, {_SHIFT})"))
    won = won.withColumn("_keep", F.when(F.expr(f"_place < {_WHOLE}"), F.expr(f"_place - {_HALF}").cast("long")))

    by_key = written(won.groupBy("_digest", "_salt").agg(F.count(F.lit(1)).alias("_texts"), F.max("_keep").alias("_keep"), F.max("_size").alias("_size")), "exact-groups")
    single = rows.select("doc_id", "_digest", "_salt").join(by_key.where("_texts = 1").drop("_texts"), ["_digest", "_salt"])
    result = single.select("doc_id", "_keep", "_size", "_digest")
    keys = by_key.where("_texts > 1").select("_digest", "_salt")
    if not keys.isEmpty():  # texts that share a digest: found by the text
        hard = rows.join(keys, ["_digest", "_salt"], "left_semi").join(won.select("_digest", "_salt", "_norm", "_keep", "_size"), ["_digest", "_salt", "_norm"])
        result = result.unionByName(hard.select("doc_id", "_keep", "_size", "_digest"))
    return result.select("doc_id", F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_digest").alias("digest"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that stay, with df's columns; of rows that repeat both id and text one stays."""
    kept_id, kept_digest, row_digest = fresh(df, "kept_id"), fresh(df, "kept_digest"), fresh(df, "row_digest")
    groups = exact_groups(df, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest)).distinct()
    digest = options.get("digest", sha256_hex)
    named = df.withColumn(row_digest, digest(normalised(whole_text(text_col))))
    stay = named.join(groups, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(row_digest) == F.col(kept_digest)), "left_semi")
    return stay.dropDuplicates([id_col, row_digest]).drop(row_digest)
