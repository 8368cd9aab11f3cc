"""Vector search by cells: an inverted file whose probes widen until the best are proved, or until a measured recall is met."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.retrieval import COSINE, nearest, top, unit_rows
from lodestar.plans.registry import query
from lodestar.sources.tables import stored, table

#: Cells at most; rows that train a cell, about; rows (or queries) packed together; similarities closer than this are one.
MOST_CELLS, TRAINED_ON, PACK, CLOSE = 4096, 64, 2048, 1e-7
#: Cells that a query probes first; sample of queries that measures recall.
FIRST_PROBES, MEASURED = 4, 256


@dataclass(frozen=True)
class Cells:
    """Unit centroids, the widest angle of each cell's rows, and the stored ``blocks(cell, n, ids, v)``: the cells' rows, packed."""

    centroids: np.ndarray
    widest: np.ndarray
    sizes: np.ndarray
    blocks: DataFrame


def unit(column: str) -> Column:
    """A vector scaled to length one; a zero vector stays zero."""
    x = F.col(column).cast("array<double>")
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: v / F.greatest(length, F.lit(1e-300)))


def centroids_of(vectors: DataFrame, cells: int, seed: int = 5) -> np.ndarray:
    """Unit centroids of ``vectors(id, embedding)``, by k-means in Spark on about :data:`TRAINED_ON` rows a cell, drawn by a hash of the id."""
    n = vectors.count()
    share = min(1.0, TRAINED_ON * cells / max(1, n))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = stored(vectors.where(drawn).select(array_to_vector(unit("embedding")).alias("features")), "sample")
    if not sample.head(1):
        return np.zeros((1, 0))
    return unit_rows(pa.array([list(map(float, c)) for c in KMeans(k=cells, seed=seed, maxIter=12).fit(sample).clusterCenters()]))


def similarities(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of vectors to centroids; zero if there was no vector to make a centroid of."""
    return v @ centroids.T if centroids.shape[1] else np.zeros((len(v), len(centroids)))


def packed(rows: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``cell, n, ids, v`` of ``rows(id, v binary, cell)``: up to :data:`PACK` rows of a cell together, so a cell of any size is many blocks."""

    def run(batches):
        open_, ids_name, v_name = {}, *names

        def block(cell: int) -> pa.RecordBatch:
            ids, v = zip(*open_.pop(cell), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(v)], pa.binary())], ["cell", "n", ids_name, v_name])

        for batch in batches:
            for i, v, cell in zip(*(batch.column(c).to_pylist() for c in ("id", "v", "cell")), strict=True):
                if open_ and cell not in open_:  # rows come cell by cell
                    yield block(next(iter(open_)))
                open_.setdefault(cell, []).append((i, v))
                if len(open_[cell]) == PACK:
                    yield block(cell)
        for cell in list(open_):
            yield block(cell)

    return rows.sortWithinPartitions("cell").mapInArrow(run, f"cell long, n long, {names[0]} binary, {names[1]} binary")


def with_cells(vectors: DataFrame, key: str, centroids: np.ndarray, most: int = 1) -> DataFrame:
    """``id, v, cell, similarity`` for the ``most`` nearest cells of each of ``vectors(key, embedding)``; null vectors go."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(zero_copy_only=False), unit_rows(batch.column(1))
            s = similarities(v, centroids)
            near = np.argsort(-s, axis=1, kind="stable")[:, :most]
            row = np.repeat(np.arange(len(ids)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array([x.tobytes() for x in v[row]], pa.binary()), pa.array(near.ravel().astype(np.int64)), pa.array(s[row, near.ravel()])], ["id", "v", "cell", "similarity"])

    own = vectors.select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("id IS NOT NULL AND embedding IS NOT NULL")
    return own.mapInArrow(run, "id long, v binary, cell long, similarity double")


def built(vectors: DataFrame, cells: int | None = None) -> Cells:
    """The inverted file of ``vectors(id, embedding)``: every row is in the cell of its nearest centroid. About the root of their number are the cells."""
    k = cells or max(1, min(MOST_CELLS, round(math.sqrt(vectors.where("embedding IS NOT NULL").count()))))
    centroids = centroids_of(vectors.where("id IS NOT NULL AND embedding IS NOT NULL"), k)
    own = stored(with_cells(vectors, "id", centroids), "cells")
    widest, sizes = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
    for r in own.groupBy("cell").agg(F.min("similarity").alias("s"), F.count(F.lit(1)).alias("n")).collect():
        widest[r.cell], sizes[r.cell] = math.acos(max(-1.0, min(1.0, r.s))) + CLOSE, r.n
    # rows of a cell are together, and large cells in several tasks
    spread = own.withColumn("part", F.pmod(F.xxhash64("id"), F.array(*map(F.lit, (1 + sizes // (64 * PACK)).tolist()))[F.col("cell").cast("int")].cast("long")))
    blocks = stored(packed(spread.repartition("cell", "part").select("id", "v", "cell"), ("b_ids", "b_v")), "blocks")
    return Cells(centroids, widest, sizes, blocks)


def bounds(s: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """The most similar that a row of each cell can be to queries with similarities ``s`` to the centroids."""
    return np.cos(np.maximum(0.0, np.arccos(np.clip(s, -1.0, 1.0)) - widest))


def met(index: Cells, asked: DataFrame, most: int) -> DataFrame:
    """``query_id, id, similarity``: of each block that ``asked(id, v, cell)`` probes, its best ``most``; queries of a cell meet a block together.

    A query's vector stands beside each of its cells, which a file packs away: so the join is hinted, as its sides look small enough for the driver.
    """
    pairs = packed(asked.repartition("cell").select("id", "v", "cell"), ("q_ids", "q_v")).drop("n").hint("merge").join(index.blocks, "cell")

    def search(batches):
        for batch in batches:
            for row in batch.select(["q_ids", "q_v", "b_ids", "b_v"]).to_pylist():
                q, b = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["b_ids"], np.int64)
                s = np.frombuffer(row["q_v"]).reshape(len(q), -1) @ np.frombuffer(row["b_v"]).reshape(len(b), -1).T
                rounded = -np.round(s, 9)
                least = np.partition(rounded, min(most, len(b)) - 1, axis=1)[:, min(most, len(b)) - 1]
                rows, columns = np.nonzero(rounded <= least[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(q[rows]), pa.array(b[columns]), pa.array(s[rows, columns])], ["query_id", "id", "similarity"])

    return pairs.mapInArrow(search, "query_id long, id long, similarity double")


def ranked(found: DataFrame, most: int) -> DataFrame:
    return top(found, ["query_id"], [F.desc(F.round("similarity", 9)), "id"], most)


def probed(index: Cells, queries: DataFrame, most: int, probes: int) -> DataFrame:
    """``query_id, id, similarity, rank``: the best ``most`` among the rows of each query's ``probes`` nearest cells."""
    return ranked(met(index, with_cells(queries, "query_id", index.centroids, probes), most), most)


def proved(index: Cells, queries: DataFrame, most: int, probes: int = FIRST_PROBES) -> tuple[DataFrame, DataFrame]:
    """The exact ``most`` nearest of each of ``queries(query_id, embedding)``, and ``(query_id, cells, rows_read)``.

    The nearest cells are probed first. A cell whose widest angle keeps all its rows below the ``most``-th similarity found is
    never read; all others are, in a second turn.
    """
    first = stored(probed(index, queries, most, probes), "first")
    reached = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("least"))
    asked = queries.select("query_id", "embedding").where("query_id IS NOT NULL AND embedding IS NOT NULL").join(reached, "query_id", "left")
    centroids, widest, sizes = index.centroids, index.widest, index.sizes

    def rest(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column(0).to_numpy(zero_copy_only=False), unit_rows(batch.column(1))
            s = similarities(v, centroids)
            n, least = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in (2, 3))
            need = (bounds(s, widest) >= np.where(n < most, -2.0, least - CLOSE)[:, None]) & (sizes > 0)
            np.put_along_axis(need, np.argsort(-s, axis=1, kind="stable")[:, :probes], False, axis=1)
            rows, cells = np.nonzero(need)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array([x.tobytes() for x in v[rows]], pa.binary()), pa.array(cells.astype(np.int64))], ["id", "v", "cell"])

    cast = asked.select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "n", "least")
    more = stored(cast.mapInArrow(rest, "id long, v binary, cell long"), "rest")
    found = ranked(first.drop("rank").unionByName(met(index, more, most)), most)
    size = F.array(*map(F.lit, sizes.tolist()))[F.col("cell").cast("int")]
    read = with_cells(queries, "query_id", centroids, probes).select("id", "cell").unionByName(more.select("id", "cell"))
    return found, read.groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("cells"), F.sum(size.cast("long")).alias("rows_read"))


def probes_for(index: Cells, vectors: DataFrame, queries: DataFrame, most: int, recall: float = 0.95) -> tuple[int, float]:
    """The fewest probes, doubled from one, at which a sample of :data:`MEASURED` queries finds ``recall`` of its exact neighbours, and that recall.

    The sample is drawn by a hash; its exact neighbours come from :func:`proved`.
    """
    n = queries.count()
    drawn = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(1 << 30)) < int(min(1.0, MEASURED / max(1, n)) * (1 << 30)))
    drawn = drawn if drawn.head(1) else queries
    exact = stored(proved(index, drawn, most)[0].select("query_id", "id"), "exact")
    total, probes = exact.count(), 1
    while True:
        same = probed(index, drawn, most, probes).select("query_id", "id").join(exact, ["query_id", "id"]).count()
        share = same / total if total else 1.0
        if share >= recall or probes >= len(index.centroids):
            return probes, share
        probes = min(2 * probes, len(index.centroids))


def stored_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return own, own.where("id % 50 = 0").withColumnRenamed("id", "query_id")


@query("cell_vector_search", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(similarity, 5) AS similarity, rank FROM r WHERE rank <= 10")
def cell_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vector_search`` by cells: the same rows, proved by the cells' bounds."""
    vectors, queries = stored_vectors(spark, sf_dir)
    return proved(built(vectors), queries, 10)[0].select("query_id", "id", F.round("similarity", 5).alias("similarity"), "rank")


@query("cell_search_report")
def cell_search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, rows, rows_proved, probes, rows_probed, recall``: what a proof and what a recall of 0.95 read of all rows, and each query's own recall against ``nearest``."""
    vectors, queries = stored_vectors(spark, sf_dir)
    index = built(vectors)
    probes, _ = probes_for(index, vectors, queries, 10)
    exact = nearest(vectors, queries, 10).select("query_id", "id")
    near = probed(index, queries, 10, probes).select("query_id", "id").join(exact, ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("same"))
    size = F.array(*map(F.lit, index.sizes.tolist()))[F.col("cell").cast("int")].cast("long")
    read = with_cells(queries, "query_id", index.centroids, probes).groupBy(F.col("id").alias("query_id")).agg(F.sum(size).alias("rows_probed"))
    report = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(read, "query_id").join(near, "query_id", "left").join(proved(index, queries, 10)[1], "query_id")
    return report.select("query_id", F.lit(int(index.sizes.sum())).alias("rows"), F.col("rows_read").alias("rows_proved"), F.lit(probes).alias("probes"), "rows_probed", (F.coalesce("same", F.lit(0)) / F.col("n")).alias("recall"))
