"""Candidate searches: exact vector neighbours of given queries, and lexical phrase coverage."""

from __future__ import annotations

import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from recallgrid.functions.text import tokens
from recallgrid.functions.time import epoch_micros
from recallgrid.functions.vectors import cosine_distance_sql, vector_sql
from recallgrid.operators.scope import Scope, effective_time

#: Queries, and rows, whose distances a task has at a time: 8 MB of doubles.
BLOCK = 1000


def _order(distance: str = "distance"):
    return [F.isnan(distance), F.col(distance), F.desc("recorded_at"), F.col("id")]


def vector_search(memories: DataFrame, vectors: DataFrame, query: Sequence[float], scope: Scope, k: int) -> DataFrame:
    """Rows ``(id, distance, recorded_at)`` of the ``k`` nearest in scope: a scan, a join and a top-k without a full sort.

    Vectors that can't be compared come last, newest first. ``vectors`` has ``(tenant_id, memory_id, embedding)``, one row an id.
    """
    rows = memories.where(scope.filter()).select("id", "recorded_at").dropDuplicates(["id"])
    own = vectors.where(F.col("tenant_id") == scope.tenant).select(F.col("memory_id").alias("id"), "embedding")
    distance = F.expr(cosine_distance_sql("embedding", vector_sql(query)))
    return rows.join(own, "id").select("id", distance.alias("distance"), "recorded_at").orderBy(*_order()).limit(k)


def _packed(*names: str):
    """A map of Arrow batches to rows of one binary: up to ``BLOCK`` of their rows, the last column as arrays of doubles."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            columns[-1] = [np.array(v if v is not None else [], "f8") for v in columns[-1]]
            parts = [pickle.dumps([c[i : i + BLOCK] for c in columns]) for i in range(0, batch.num_rows, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["packed"])

    return run


def _distances(a: list, b: list) -> np.ndarray:
    """``cosine_distance_sql`` of each in ``a`` to each in ``b``, added in the same order, so equal vectors have equal distances."""
    out = np.full((len(a), len(b)), np.nan)
    for n in {len(x) for x in a} - {0}:
        i, j = [k for k, x in enumerate(a) if len(x) == n], [k for k, x in enumerate(b) if len(x) == n]
        if not j:
            continue
        x, y = np.stack([a[k] for k in i], 1), np.stack([b[k] for k in j], 1)
        dots, xx, yy, product = np.zeros((len(i), len(j))), np.zeros(len(i)), np.zeros(len(j)), np.empty((len(i), len(j)))
        with np.errstate(all="ignore"):
            for u, v in zip(x, y, strict=True):
                dots += np.multiply.outer(u, v, out=product)
                xx += u * u
                yy += v * v
            norms = np.multiply.outer(np.sqrt(xx), np.sqrt(yy), out=product)
            out[np.ix_(i, j)] = np.where(norms > 0, 1 - dots / norms, np.nan)
    return out


def _nearest(k: int, key_type: pa.DataType):
    """A map of pairs of packed rows and packed queries to each query's ``k`` best of those rows."""

    def run(batches):
        for batch in batches:
            for packed_rows, packed_queries in zip(batch.column("rows").to_pylist(), batch.column("queries").to_pylist(), strict=True):
                ids, at, vectors = pickle.loads(packed_rows)
                keys, queries = pickle.loads(packed_queries)
                order = sorted(range(len(ids)), key=lambda i: (-at[i], ids[i]))
                found = _distances(queries, [vectors[i] for i in order])
                best = np.argsort(found, axis=1, kind="stable")[:, :k]  # NaN sorts last
                n, rows = best.shape[1], [order[i] for i in best.ravel()]
                columns = [pa.array([key for key in keys for _ in range(n)], key_type), pa.array([ids[i] for i in rows], pa.string()), pa.array([at[i] for i in rows], pa.int64()), pa.array(np.take_along_axis(found, best, 1).ravel(), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "recorded_at", "distance"])

    return run


def vector_search_many(memories: DataFrame, vectors: DataFrame, queries: DataFrame, scope: Scope, k: int) -> DataFrame:
    """Rows ``(key, place, id, distance)``: each query's own ranked list; of queries with one key the last counts.

    ``queries`` has ``(key, position, query)``, any number of them: they go to every task in blocks of at most ``BLOCK``, and
    all blocks are answered. Rows meet a block in parts of ``BLOCK`` too, and each part keeps its k best a query before the shuffle.
    """
    spark = memories.sparkSession
    last = queries.groupBy("key").agg(F.max_by("query", "position").alias("query"))
    blocks = last.select("key", "query").mapInArrow(_packed("key", "query"), "packed binary").select(F.col("packed").alias("queries"))
    rows = memories.where(scope.filter()).select("id", "recorded_at").dropDuplicates(["id"])
    own = vectors.where(F.col("tenant_id") == scope.tenant).select(F.col("memory_id").alias("id"), "embedding")
    at = F.coalesce(epoch_micros(spark, F.col("recorded_at")), F.lit(-(2**63) + 1))
    parts = rows.join(own, "id").select("id", at.alias("at"), "embedding").mapInArrow(_packed("id", "at", "embedding"), "packed binary")
    key = StructType([last.schema["key"]])
    schema = StructType([*key, *StructType.fromDDL("id string, recorded_at bigint, distance double")])
    pairs = parts.select(F.col("packed").alias("rows")).crossJoin(F.broadcast(blocks)).mapInArrow(_nearest(k, to_arrow_type(key[0].dataType)), schema)
    place = F.row_number().over(W.partitionBy("key").orderBy(*_order()))
    return pairs.withColumn("place", place).where(F.col("place") <= k).select("key", "place", "id", "distance")


def lexical_search(memories: DataFrame, phrases: Sequence[Sequence[str]], scope: Scope, k: int) -> DataFrame:
    """Rows ``(id, coverage, rank, recorded_at)``: share of the distinct phrases found contiguously in the content, then their occurrences."""
    phrases = [list(p) for p in dict.fromkeys(tuple(p) for p in phrases)]
    rows = memories.where(scope.filter()).select("id", "recorded_at", tokens(F.col("content")).alias("t")).dropDuplicates(["id"])
    # Tokens hold letters and digits only, so a bar between them makes contiguity a search in one string.
    line = F.concat(F.lit("|"), F.array_join("t", "||"), F.lit("|"))
    found = [F.regexp_count(line, F.lit("".join(f"\\|{w}\\|" for w in p))) for p in phrases]
    hits = sum((F.when(c > 0, 1).otherwise(0) for c in found), F.lit(0))
    out = rows.select("id", "recorded_at", (hits / float(len(phrases))).alias("coverage"), sum(found, F.lit(0)).cast("bigint").alias("rank"))
    return out.where(F.col("coverage") > 0).orderBy(F.desc("coverage"), F.desc("rank"), F.desc("recorded_at"), "id").limit(k).select("id", "coverage", "rank", "recorded_at")


def latest_vectors(vectors: DataFrame, model: str) -> DataFrame:
    """The vector sink's state: the last write of each (tenant, id) of a model."""
    rows = vectors.where(F.col("model") == model)
    return rows.groupBy("tenant_id", "memory_id").agg(F.max_by("embedding", "created_at").alias("embedding"))


__all__ = ["effective_time", "latest_vectors", "lexical_search", "vector_search", "vector_search_many"]
