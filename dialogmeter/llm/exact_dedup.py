"""Operator 5: exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text, its letters A-Z lower-cased, is cut at places its own content defines: after the first
sentence or line end that follows 256 characters. The recipe of a document is the ordered list of
its chunks' identifiers. Each different chunk text is moved once, to verify that its identifier
belongs to no other chunk; documents are then equal exactly when their recipes are, and only
recipes are grouped. Documents with an identifier that failed (a hash collision) are grouped by
recipe and text.

A null text counts as empty; all empty texts are one group. Of a group the row with the largest
doc_id stays (a null id is smallest); of rows that also share that id, one. Empty tables give
empty results. Other columns pass through ``keep_one`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogmeter.llm.store import stored

#: Up to 2048 characters: the shortest run of at least 256 that ends a sentence or line, else what is left.
CHUNK = r"(?s).{255,2047}?[.!?\n]|.{1,2048}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters other than A-Z that full lower-casing may change.
_OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; full lower-casing is the faster way where it changes no more."""
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(_OTHER_CAPITALS)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipe(text: Column) -> Column:
    return F.transform(chunks(text), lambda c: F.xxhash64(c))


def normal_text(text_col: str) -> Column:
    return lower_ascii(F.coalesce(F.col(text_col), F.lit("")))


def failed_identifiers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Identifiers that more than one chunk text has (none, but for hash collisions)."""
    pieces = docs.select(normal_text(text_col).alias("x_text")).select(F.explode(chunks(F.col("x_text"))).alias("chunk"))
    return (
        pieces.select(F.xxhash64("chunk").alias("c_id"), "chunk").distinct()
        .groupBy("c_id").agg(F.count("*").alias("texts")).where("texts > 1").select("c_id")
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, keep_id, group_size, kept, text_sha256) of every row; ``row`` numbers the rows."""
    rows = docs.select(id_col, normal_text(text_col).alias("x_text")).select(
        id_col, recipe(F.col("x_text")).alias("recipe"), F.sha2("x_text", 256).alias("text_sha256")
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "recipes")
    failed = stored(failed_identifiers(docs, text_col), "failed-chunks")
    if failed.isEmpty():
        rows = rows.withColumn("x_text", F.lit(None).cast("string"))
    else:
        # The digest finds the texts of the rows in question again; they are then compared as a whole.
        hit = rows.select("row", "text_sha256", F.explode("recipe").alias("c_id")).join(failed, "c_id").select("row", "text_sha256").distinct()
        texts = docs.select(normal_text(text_col).alias("x_text")).withColumn("text_sha256", F.sha2("x_text", 256)).join(
            hit.select("text_sha256").distinct(), "text_sha256", "left_semi").distinct()
        rows = rows.join(hit.join(texts, "text_sha256").select("row", "x_text"), "row", "left")
    key = ["k_hash", "recipe", "x_text"]
    rows = rows.withColumn("k_hash", F.xxhash64("recipe", "x_text"))
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    found = rows.groupBy(*key).agg(
        F.max(id_col).alias("keep_id"), F.count("*").alias("group_size"), F.max_by("row", rank).alias("keep_row")
    )
    found = found.select(*(F.col(k).alias(f"g_{k}") for k in key), "keep_id", "group_size", "keep_row")
    # Stored, so that the join starts from scans and a hot group's rows can be split.
    found = stored(found, "recipe-groups")
    same = (F.col("k_hash") == F.col("g_k_hash")) & (F.col("recipe") == F.col("g_recipe")) & F.col("x_text").eqNullSafe(F.col("g_x_text"))
    return rows.join(found, same).select(
        id_col, "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return groups(docs).drop("row")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows equal in id and text are one row of the result.
    """
    found = stored(groups(docs).select("doc_id", "text_sha256", "kept"), "exact-kept")
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_text"))
    gone = found.where("not kept").select("doc_id", "text_sha256")
    marked = docs.select(F.struct("*").alias("x_row"), F.col("doc_id").alias("x_id"), F.sha2(normal_text("text"), 256).alias("x_sha"))
    left = marked.join(kept, marked["x_id"].eqNullSafe(kept["kept_id"]) & (marked["x_sha"] == kept["kept_text"]), "left_semi")
    repeated = gone.join(kept, gone["doc_id"].eqNullSafe(kept["kept_id"]) & (gone["text_sha256"] == kept["kept_text"]), "left_semi")
    if not repeated.isEmpty():
        left = left.dropDuplicates(["x_id", "x_sha"])
    return left.select("x_row.*")


SQL = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from n
"""
