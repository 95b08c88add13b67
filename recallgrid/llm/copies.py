"""Copies hidden by differences of form (problem 2): dictionary-encoded records.

Every record is one value (prose) or several named fields. Each distinct raw value is brought into canonical form once and
gets an integer; a record becomes the sorted tuple of its integers, and the compact tuples are grouped. Only the distinct
values travel as text; records travel as two 64-bit hashes of their raw values, later as tuples of integers.

The integers are dense ranks within hash buckets, whose number goes up with the rows, so they are the same when a lost task
runs again. Values and groups that hold any share of the rows are counted before the shuffle and spread by ``lookup_join``. The
table is read twice, once for the dictionary and once for the records; both are written once, and tuples are made from there.

Defined results: null tenant, id or content means no copy of anything; contents that are empty in canonical form are equal
to each other; rows with the same id are one record; the smallest id is kept; an empty table has no rows; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from recallgrid.operators.skew import lookup_join
from recallgrid.session import cut_lineage

NAME_LENGTH = 24
#: Hash buckets of the dictionary at least, and rows that a bucket stands for beyond that.
BUCKETS, BUCKET_ROWS = 4096, 20_000
FIELDS = ArrayType(StructType([StructField("name", StringType()), StructField("value", StringType())]))
_BREAKS = "\n\r\x85\u2028\u2029"
_PIECES = re.compile(f"[;|{_BREAKS}]")
_FIELD = re.compile(r"\s*([^:=]*[^:=\s])\s*[:=](.*\S)\s*", re.S)


def split_fields(content: str | None) -> list[tuple[str, str]] | None:
    """The raw (name, value) fields of a content that is a list of named fields, else None."""
    if content is None:
        return None
    if content.lstrip().startswith("{"):
        try:
            found = json.loads(content)
        except (ValueError, RecursionError):  # too deep for a list of fields
            found = None
        if isinstance(found, dict):
            return [(k, v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)) for k, v in found.items()]
    pieces = [p for p in _PIECES.split(content) if p.strip()]
    if len(pieces) < 2:
        return None
    fields = [_FIELD.fullmatch(p) for p in pieces]
    if not all(m and len(m[1].strip()) <= NAME_LENGTH for m in fields):
        return None
    return [(m[1].strip(), m[2].strip()) for m in fields]


@F.pandas_udf(FIELDS)
def _split_fields(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if (f := split_fields(c)) is None else [{"name": n, "value": v} for n, v in f])


def canonical(text: Column) -> Column:
    """Lower case without Unicode punctuation, separators, control and format characters; punctuation directly between two digits stays."""
    return F.regexp_replace(F.lower(text), r"(?<!\p{Nd})\p{P}|\p{P}(?!\p{Nd})|[\p{Z}\p{Cc}\p{Cf}]", "")


def encoded(records: DataFrame, content: str = "content", by: str = "tenant_id", key: str = "id") -> DataFrame:
    """Rows ``(by, key, listed, tuple)``: each record's sorted integers; ``listed`` tells lists of named fields from prose."""
    rows = records.where(F.col(by).isNotNull() & F.col(key).isNotNull() & F.col(content).isNotNull())
    rows = rows.select(F.col(by).alias("_by"), F.col(key).alias("_key"), F.col(content).alias("_text"))
    buckets = max(BUCKETS, records.count() // BUCKET_ROWS)
    maybe = F.col("_text").rlike(r"^\s*\{") | (F.col("_text").rlike(f"[;|{_BREAKS}]") & F.col("_text").rlike("[:=]"))
    rows = rows.withColumn("_fields", _split_fields(F.when(maybe, F.col("_text"))))
    prose = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.col("_text").alias("value")))
    values = rows.select("_by", "_key", F.col("_fields").isNotNull().alias("listed"), F.inline(F.when(F.col("_fields").isNull(), prose).otherwise(F.col("_fields"))))
    values = values.select("_by", "_key", "listed", "name", "value", F.xxhash64("listed", "name", "value").alias("_h1"), F.xxhash64(F.lit(7), "value", "name", "listed").alias("_h2"))

    distinct = values.groupBy("_h1", "_h2", "listed", "name", "value").agg(F.count("*").alias("_n"))
    distinct = distinct.select("_h1", "_h2", "_n", F.col("listed").alias("_listed"), canonical(F.col("name")).alias("_name"), canonical(F.col("value")).alias("_value"))
    distinct = distinct.withColumn("_bucket", F.pmod(F.xxhash64("_listed", "_name", "_value"), F.lit(buckets)))
    rank = F.dense_rank().over(W.partitionBy("_bucket").orderBy("_listed", "_name", "_value"))
    dictionary = distinct.select("_h1", "_h2", "_n", (rank.cast("bigint") * buckets + F.col("_bucket")).alias("_code"))

    dictionary = cut_lineage(dictionary)
    coded = cut_lineage(lookup_join(values.select("_by", "_key", "listed", "_h1", "_h2"), dictionary, ["_h1", "_h2"], "_key", "_n").select("_by", "_key", "listed", "_code"))
    single = coded.where("not listed").select("_by", "_key", "listed", F.array("_code").alias("_tuple"))
    several = coded.where("listed").groupBy("_by", "_key", "listed").agg(F.array_sort(F.collect_set("_code")).alias("_tuple"))
    return single.unionByName(several).select(F.col("_by").alias(by), F.col("_key").alias(key), "listed", F.col("_tuple").alias("tuple"))


def _groups(codes: DataFrame, by: str, key: str) -> DataFrame:
    groups = codes.groupBy(by, "listed", "tuple").agg(F.min(key).alias("keep_id"), F.max(key).alias("_last"), F.count("*").alias("_n"))
    return groups.where("keep_id <> _last").drop("_last")


def copies(records: DataFrame, content: str = "content", by: str = "tenant_id", key: str = "id") -> DataFrame:
    """Rows ``(keep_id, copy_id)``: every other record of each group of copies with the kept one."""
    codes = encoded(records, content, by, key)
    pairs = lookup_join(codes, _groups(codes, by, key), [by, "listed", "tuple"], key, "_n")
    return pairs.where(F.col(key) != F.col("keep_id")).select("keep_id", F.col(key).alias("copy_id")).distinct()


def copy_counts(records: DataFrame, content: str = "content", by: str = "tenant_id", key: str = "id") -> DataFrame:
    """Rows ``(by, keep_id, n_copies)``: one for every distinct content, with the number of records that have it."""
    codes = encoded(records, content, by, key).dropDuplicates([by, key])
    return codes.groupBy(by, "listed", "tuple").agg(F.min(key).alias("keep_id"), F.count("*").alias("n_copies")).select(by, "keep_id", "n_copies")
