"""Vector operators: similarities, top-k search, re-ranking, nearest neighbours with blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import require


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def l2_normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def distance_to_similarity(distance: Column, metric: str) -> Column:
    return {"cosine": 1 - distance, "l2": 1 - distance / 2, "dot": -distance}[metric]


def top_k(vectors: DataFrame, query: list[float], k: int, *, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", most: int = 200) -> DataFrame:
    """key and sim of the k nearest vectors; ties by key. Further filters belong behind it when they shall shrink the result,
    in front of it when they shall not. Plans as one scan with TakeOrderedAndProject."""
    require(vectors, key, vector)
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector)
    diff = F.aggregate(F.zip_with(v, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    sim = {"cosine": cosine(v, q), "l2": 1 - diff / 2, "dot": dot(v, q)}[metric]
    return vectors.select(key, F.round(sim, 6).alias("sim")).orderBy(F.desc("sim"), F.asc(key)).limit(max(1, min(most, k)))


def blended(hits: DataFrame, graph: DataFrame, alpha: float, beta: float, limit: int, key: str) -> DataFrame:
    """Final score alpha * sim + beta * graph / max graph over the hits, the best `limit`; a missing graph score is 0."""
    j = hits.join(graph, key, "left").withColumn("graph", F.coalesce("graph", F.lit(0.0)))
    top = F.max("graph").over(Window.partitionBy(F.lit(1)))  # over the hits alone, at most the over-fetched few
    score = alpha * F.col("sim") + F.when(top > 0, beta * F.col("graph") / top).otherwise(0.0)
    return j.withColumn("final", F.round(score, 6)).orderBy(F.desc("final"), F.asc(key)).limit(limit)


#: Bytes of query vectors that are broadcast at a time.
QUERY_BYTES = 32 << 20


def nearest(queries: DataFrame, base: DataFrame, k: int = 1, *, key: str = "vec_id", vector: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query, neighbour and sim of the k nearest other rows of base for every query row, exactly; ties by neighbour.

    Queries are taken in rounds of at most query_bytes, each broadcast as one matrix; a round reads base once, as matrix
    products batch by batch, and a partition sends on its k best per query, so what is shuffled is queries x partitions x k.
    """
    kind = dict(base.dtypes)[key]
    asked = queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    size = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] * 8
    rounds = max(1, -(-size // max(1, query_bytes)))
    spark = base.sparkSession
    schema = f"query {kind}, neighbour {kind}, sim double"
    part = None
    for r in range(rounds):
        rows = asked.filter(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r).collect()  # about query_bytes
        if not rows:
            continue
        m = np.array([x["v"] for x in rows], float)
        held = spark.sparkContext.broadcast((np.array([x["q"] for x in rows]), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)))

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            names, q = held.value
            top = np.full((len(q), 0), -np.inf)
            ids = None
            for pdf in batches:
                pdf = pdf[pdf["v"].notna()]
                if not len(pdf):
                    continue
                b = np.array(pdf["v"].tolist(), float)
                sim = np.round(q @ (b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)).T, 6)
                n = pdf["n"].to_numpy()
                sim[names[:, None] == n[None, :]] = -np.inf
                all_ids = np.broadcast_to(n, sim.shape) if ids is None else np.concatenate([ids, np.broadcast_to(n, sim.shape)], 1)
                top = np.concatenate([top, sim], 1)
                order = np.lexsort((all_ids, -top), axis=1)[:, :k]
                top, ids = np.take_along_axis(top, order, 1), np.take_along_axis(all_ids, order, 1)
            if ids is not None:
                row, col = np.nonzero(np.isfinite(top))
                yield pd.DataFrame({"query": names[row], "neighbour": ids[row, col], "sim": top[row, col]})

        got = base.select(F.col(key).alias("n"), F.col(vector).alias("v")).mapInPandas(best, schema)
        part = got if part is None else part.union(got)
    if part is None:
        return spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "neighbour"))  # k rows a partition
    return part.withColumn("__n", place).filter(F.col("__n") <= k).drop("__n")


def with_metadata(hits: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Hits in their order with the columns of their rows; hits without a row are dropped. Hits are few and broadcast."""
    return rows.join(F.broadcast(hits), key).orderBy(F.desc("sim"), F.asc(key))


def overfetch(limit: int) -> int:
    """Hits that are fetched before a re-rank to `limit`: five times as many, at most 100, never fewer than asked for."""
    return min(100, max(5 * limit, limit))


def novelty_band(sim: Column, low: float = 0.65, high: float = 0.85) -> Column:
    return F.when(sim.isNull() | (sim < low), "novel").when(sim > high, "derivative").otherwise("judge")
