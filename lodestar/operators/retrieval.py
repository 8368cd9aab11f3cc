"""Lexical and vector search, rank fusion, and article ranking."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import STOP_WORDS, content_terms, coverage, query_terms, tokens
from lodestar.operators.blocks import ASKED_PAIRS, KEPT, Best, best_by_terms, lowered, slices, tiles, words_in
from lodestar.plans.registry import query
from lodestar.sources.bindings import CHUNKS, TOKENS, articles, chunks, search_queries
from lodestar.sources.tables import stored, table

#: BM25 saturation and length weight, and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Reciprocal-rank constant; weights of the lexical and the vector list.
RRF_K, LEXICAL, VECTOR = 60, 0.35, 0.45
# The weights of a chunk's fields in lexical search, and of an article's parts in its rank.
CHUNK_FIELDS = {"section": 1.5, "text": 1.0}
ARTICLE_WEIGHTS = {"best": 0.40, "top3": 0.25, "title": 0.15, "abstract": 0.10, "concept": 0.10}
#: Queries that meet a block of rows together, and bytes of query vectors that may be broadcast; beyond, blocks are joined.
QUERY_BLOCK, BROADCAST_BYTES = 4096, 64 << 20
#: Rows of asked terms that may be broadcast (about 60 bytes each).
BROADCAST_TERMS = 1_000_000


def index_of(rows: DataFrame, key: str, fields: dict[str, float], asked: DataFrame) -> DataFrame:
    """``key, length, term, tf``, stored: the inverted index of the text columns ``fields`` with their weights, cut to the terms ``asked(term)``.

    ``tf`` adds up the weights of a term's places, ``length`` counts all words of all fields. Every row of ``rows`` is
    there: its words that nobody asked for are one entry with a null term. So one pass over the texts serves
    the statistics and the scores, and only asked terms are shuffled one by one.
    """
    held = rows.select(key, *[F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias(f"_w{i}") for i, f in enumerate(fields)])
    sizes = [F.size(f"_w{i}") for i in range(len(fields))]
    held = held.select(key, sum(sizes, F.lit(0)).alias("length"), *[x.alias(f"_s{i}") for i, x in enumerate(sizes)], F.posexplode_outer(F.concat(*[f"_w{i}" for i in range(len(fields))])).alias("_at", "_word"))
    weight, until = F.lit(float(list(fields.values())[-1])), []
    for i, w in enumerate(fields.values()):
        until.append((sum([F.col(f"_s{j}") for j in range(i + 1)], F.lit(0)), w))
    for end, w in reversed(until[:-1]):
        weight = F.when(F.col("_at") < end, float(w)).otherwise(weight)
    terms = asked.select(F.col("term").alias("_word"), F.col("term")).distinct()
    held = held.withColumn("_weight", weight).join(terms, "_word", "left")
    return stored(held.groupBy(key, "length", "term").agg(F.sum("_weight").alias("tf")), "index")


def bm25(index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """``query_id, key, score``, higher is better, for ``queries(query_id, term)`` with a row for each distinct term.

    The entries of a row are brought to one place first: so its scores are added up there, and no pair of query and
    row is shuffled before the best are chosen, as long as the asked terms can be broadcast.
    """
    size = index.groupBy(key).agg(F.first("length").alias("length")).agg(F.count(F.lit(1)).alias("N"), F.avg("length").alias("mean"))
    df = index.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.ln((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    asked = queries.join(df.join(F.broadcast(size)).select("term", idf.alias("idf"), "mean"), "term")
    if queries.count() <= BROADCAST_TERMS:
        asked = F.broadcast(asked)
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return index.where("term IS NOT NULL").repartition(key).join(asked, "term").groupBy("query_id", key).agg(F.sum(part).alias("score"))


#: Ratio of the lengths in neighbouring blocks; postings of a query's rarest terms that seed its threshold, and how many of the seeds, for each row wanted, are scored in full.
LENGTH_STEP, SEEDS, SEED_SHARE = 1.2, 4000, 5
#: How far below the threshold a row may be and still tie with it.
NEAR = 1e-5


def with_impacts(index: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """The postings of the asked terms: ``key, block, term, impact``. A posting's impact is all that its term adds to the row's score.

    A block is the rows of about one length, on which an impact hangs most; so its highest impact bounds it closely.
    """
    size = index.groupBy(key).agg(F.first("length").alias("length")).agg(F.count(F.lit(1)).alias("N"), F.avg("length").alias("mean"))
    df = index.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.ln((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    terms = df.join(queries.select("term").distinct(), "term", "left_semi").join(F.broadcast(size)).select("term", idf.alias("idf"), "mean")
    impact = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    block = F.floor(F.log(F.col("length").cast("double")) / float(np.log(LENGTH_STEP))).cast("int")
    return index.where("term IS NOT NULL").join(terms, "term").select(key, block.alias("block"), "term", impact.alias("impact"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def bounded_candidates(index: DataFrame, queries: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``query_id, key, block, score, bound, least`` of the rows that can be among a query's ``most`` best, :func:`with_impacts`'s postings by ``key``, and the ``query_id, term, block`` that were skipped.

    The rows with the rarest terms are scored in full first: the ``most``-th of their scores is a threshold (``least``) that the result cannot fall below.
    In each block a query's terms are taken in order of their highest impact; those whose impacts together stay below the
    threshold make no row a candidate. So the postings of frequent terms are skipped in almost all blocks, and only rows with a
    term that can matter are met. ``score`` adds up those terms, ``bound`` is the most that the skipped ones can add.
    """
    postings = stored(with_impacts(index, queries, key).repartition(key), "postings")
    asked = stored(queries.select("query_id", "term").distinct(), "asked")
    n = asked.count()
    highest = stored(postings.groupBy("term", "block").agg(F.max("impact").alias("highest"), F.count(F.lit(1)).alias("n")), "highest")
    held = highest.groupBy("term").agg(F.sum("n").alias("df"), F.max("highest").alias("highest")).join(asked, "term")
    before = F.sum("df").over(Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1))
    rare = held.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") < SEED_SHARE * most) | (F.col("before") + F.col("df") <= SEEDS)).select("query_id", "term")
    seeds = postings.join(small(rare, n), "term").groupBy("query_id", key).agg(F.sum("impact").alias("part"))
    seeds = stored(top(seeds, ["query_id"], [F.desc("part"), key], SEED_SHARE * most).select("query_id", key), "seeds")
    scored = seeds.join(postings, key).join(small(asked, n), ["query_id", "term"]).groupBy("query_id", key).agg(F.sum("impact").alias("score"))
    least = top(scored, ["query_id"], [F.desc("score"), key], most).where(F.col("rank") == most).select("query_id", (F.col("score") - NEAR).alias("least"))
    limits = asked.join(highest, "term").join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    weakest = Window.partitionBy("query_id", "block").orderBy("highest", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limits = stored(limits.withColumn("needed", F.sum("highest").over(weakest) >= F.col("least")).select("query_id", "term", "block", "highest", "least", "needed"), "limits")
    skipped = limits.where("NOT needed").groupBy("query_id", "block").agg(F.sum("highest").alias("bound"))
    rows = limits.count()
    needed = limits.where("needed").select("query_id", "term", "block", "least").join(skipped, ["query_id", "block"], "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)))
    met = postings.repartition(key).join(small(needed, rows), ["term", "block"])
    found = met.groupBy("query_id", key).agg(F.first("block").alias("block"), F.sum("impact").alias("score"), F.first("bound").alias("bound"), F.first("least").alias("least"))
    return found, postings, limits.where("NOT needed").select("query_id", "term", "block")


def best_by_bounds(index: DataFrame, queries: DataFrame, key: str, most: int) -> DataFrame:
    """``query_id, key, score, rank``: the ``most`` best of :func:`bm25`, without scoring the rows that cannot be among them."""
    found, postings, skipped = bounded_candidates(index, queries, key, most)
    found = stored(found.where(F.col("score") + F.col("bound") >= F.col("least")).select("query_id", key, "score"), "candidates")
    # the skipped terms' impacts, for the rows that are left only
    rest = found.select("query_id", key).join(postings, key).join(small(skipped, skipped.count()), ["query_id", "term", "block"]).select("query_id", key, F.col("impact").alias("score"))
    full = found.unionByName(rest).groupBy("query_id", key).agg(F.sum("score").alias("score"))
    return top(full, ["query_id"], [best_first(), key], most)


def best_first(score: str = "score") -> Column:
    """Descending order of a score in millionths, so that ties are ties however sums were added up."""
    return F.desc(F.floor(F.col(score) * 1e6 + 0.5))


def top(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group, numbered ``rank`` from one."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def impact(n: int, df: np.ndarray, tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What a term adds to a row's score in :func:`bm25`."""
    idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def best_lexical(rows: DataFrame, key: str, fields: dict[str, float], queries: DataFrame, most: int) -> DataFrame:
    """``query_id, key, score, rank``: the ``most`` best of ``rows`` by :func:`bm25` for each of ``queries(query_id, term)``; ``key`` is a whole number.

    The queries' terms go to every task, which scores its rows for all queries in blocks and hands on the best of each query only; so
    no word of a row and no pair of row and query is shuffled. Sets of queries that are too large for that are searched by bounds.
    """
    asked = stored(queries.select("query_id", "term").where("term IS NOT NULL").distinct(), "asked")
    size = asked.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("query_id").alias("queries")).first()
    if size.pairs > ASKED_PAIRS or size.queries * most > KEPT:
        return best_by_bounds(index_of(rows, key, fields, asked), asked, key, most)
    return top(best_by_terms(rows, key, fields, asked.toArrow(), most, impact), ["query_id"], [best_first(), key], most)


def asked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries(spark, sf_dir).select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))


QUERY_TERMS = f"qt AS (SELECT query_id, unnest(list_slice(list_distinct_ordered, 1, 24)) AS term FROM (SELECT item_id AS query_id, list_filter(list_transform(list_filter(list_zip(w, range(len(w))), lambda p: list_position(w, p[1]) = p[2] + 1), lambda p: p[1]), lambda t: length(t) >= 2 OR regexp_matches(t, '^[0-9]+$')) AS list_distinct_ordered FROM (SELECT item_id, {TOKENS.format(x='text')} AS w FROM benchmark)))"
POSTINGS = f"w0 AS (SELECT chunk_id, article_id, {TOKENS.format(x='section')} AS s, {TOKENS.format(x='text')} AS w FROM chunks), p AS (SELECT chunk_id, article_id, len(s) + len(w) AS length, unnest(list_concat(s, w)) AS term, unnest(list_concat(list_transform(s, lambda x: 1.5), list_transform(w, lambda x: 1.0))) AS weight FROM w0), idx AS (SELECT chunk_id, article_id, length, term, CAST(sum(weight) AS DOUBLE) AS tf FROM p GROUP BY chunk_id, article_id, length, term)"
SCORED = """st AS (SELECT count(*) AS n, avg(len(s) + len(w)) AS mean FROM w0),
 dfs AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
 sc AS (SELECT query_id, idx.chunk_id, idx.article_id, sum(greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / st.mean))) AS score
   FROM idx JOIN qt ON qt.term = idx.term JOIN dfs ON dfs.term = idx.term, st GROUP BY query_id, idx.chunk_id, idx.article_id)"""
LEXICAL_SQL = f"WITH {CHUNKS}, {QUERY_TERMS}, {POSTINGS}, {SCORED}"


def lexical_lists(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    asked = asked_terms(spark, sf_dir)
    return best_lexical(chunks(spark, sf_dir), "chunk_id", CHUNK_FIELDS, asked, most)


@query("lexical_search", LEXICAL_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM sc) SELECT query_id, chunk_id, round(score, 4) AS score, rank FROM r WHERE rank <= 20")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over all chunks, the best twenty of each query; rows that cannot be among them are not scored."""
    return lexical_lists(spark, sf_dir, 20).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


CANDIDATES = LEXICAL_SQL + ", cand AS (SELECT DISTINCT query_id, article_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM sc) WHERE rank <= 20)"


def lexical_candidates(spark: SparkSession, sf_dir: str, most: int = 20) -> DataFrame:
    """``query_id, article_id``: the articles of each query's best chunks."""
    found = stored(lexical_lists(spark, sf_dir, most).select("query_id", F.floor(F.col("chunk_id") / 100000).cast("long").alias("article_id")).distinct(), "candidates")
    return small(found, found.count())


@query("match_all_terms", LEXICAL_SQL + " SELECT qt.query_id, idx.chunk_id FROM idx JOIN (SELECT query_id, term FROM qt) qt ON qt.term = idx.term GROUP BY qt.query_id, idx.chunk_id HAVING count(*) = (SELECT count(*) FROM qt q2 WHERE q2.query_id = qt.query_id)")
def match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have every term of a query: those with its rarest term, looked at for the others."""
    asked = asked_terms(spark, sf_dir)
    index = index_of(chunks(spark, sf_dir), "chunk_id", CHUNK_FIELDS, asked).where("term IS NOT NULL").select("chunk_id", "term")
    held = index.groupBy("chunk_id").agg(F.collect_set("term").alias("terms"))
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    need = asked.join(df, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"), F.collect_set("term").alias("need"))
    return index.join(need, "term").join(held, "chunk_id").where(F.size(F.array_except("need", "terms")) == 0).select("query_id", "chunk_id")


@query("match_phrase", f"WITH {CHUNKS} SELECT item_id AS query_id, chunk_id FROM (SELECT item_id, array_to_string({TOKENS.format(x='text')}[1:4], ' ') AS phrase FROM benchmark) q JOIN (SELECT chunk_id, array_to_string({TOKENS.format(x='text')}, ' ') AS body FROM chunks) c ON contains(' ' || c.body || ' ', ' ' || q.phrase || ' ')")
def match_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have the first four words of a query side by side: a chunk's runs of as many words, joined where they are."""
    asked = stored(search_queries(spark, sf_dir).select("query_id", F.slice(tokens(F.col("query")), 1, 4).alias("w")).where(F.size("w") > 0), "phrases")
    sizes = sorted(r.n for r in asked.select(F.size("w").alias("n")).distinct().collect())
    if not sizes:
        return chunks(spark, sf_dir).select(F.lit(0).cast("long").alias("query_id"), "chunk_id").limit(0)
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    held = chunks(spark, sf_dir).select("chunk_id", tokens(F.col("text")).alias("w"))
    held = held.select("chunk_id", F.explode(F.concat(*[F.when(F.size("w") >= n, runs(F.col("w"), n)).otherwise(F.array().cast("array<string>")) for n in sizes])).alias("phrase"))
    phrases = asked.select("query_id", F.array_join("w", " ").alias("phrase"))
    return held.join(small(phrases, phrases.count()), "phrase").select("query_id", "chunk_id").distinct()


@query("match_prefix", f"WITH {CHUNKS}, q AS (SELECT DISTINCT item_id AS query_id, term[1:4] AS stem FROM (SELECT item_id, unnest({TOKENS.format(x='text')}) AS term FROM benchmark) WHERE length(term) >= 9), p AS (SELECT DISTINCT chunk_id, term FROM (SELECT chunk_id, unnest({TOKENS.format(x='text')}) AS term FROM chunks)) SELECT query_id, count(DISTINCT chunk_id) AS n FROM q JOIN p ON starts_with(term, stem) GROUP BY query_id")
def match_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks have a word that begins like a long word of the query; stems have one length, so the join is one of equal keys."""
    asked = search_queries(spark, sf_dir).select("query_id", F.explode(tokens(F.col("query"))).alias("term")).where(F.length("term") >= 9)
    asked = asked.select("query_id", F.substring("term", 1, 4).alias("stem")).distinct()
    held = chunks(spark, sf_dir).select("chunk_id", F.explode(tokens(F.col("text"))).alias("term")).select("chunk_id", F.substring("term", 1, 4).alias("stem")).distinct()
    return held.join(asked, "stem").groupBy("query_id").agg(F.countDistinct("chunk_id").alias("n"))


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a column as rows of length one; zero vectors stay zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def meetings(vectors: DataFrame, queries: DataFrame, judge, schema: str) -> DataFrame:
    """``judge`` of the ``(query ids, ids, similarities)`` of every block of ``queries(query_id, embedding)`` and of rows ``vectors(id, embedding)``, task by task.

    Rows are not shuffled: each batch of them meets the queries where it is, a block of queries at a time. The queries are sent to every task if they are small; else blocks of both are joined. Null vectors meet nothing.
    """

    def held(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col(key).isNotNull() & F.col("embedding").isNotNull())

    def packed(df: DataFrame, key: str, block: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    ids, v = batch.column(0).to_numpy(zero_copy_only=False), unit_rows(batch.column(1))
                    for at in range(0, len(ids), QUERY_BLOCK):
                        yield pa.RecordBatch.from_arrays([pa.array([x[at : at + QUERY_BLOCK].tobytes()], pa.binary()) for x in (ids.astype(np.int64), v)], [f"{block}_ids", f"{block}_v"])

        return held(df, key).mapInArrow(run, f"{block}_ids binary, {block}_v binary")

    def pieces(q: np.ndarray, q_v: np.ndarray, b: np.ndarray, b_v: np.ndarray):
        if len(q) and len(b):
            for block in tiles(len(q)):
                yield q[block], b, q_v[block] @ b_v.T

    n = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if n.n * (n.d or 0) * 8 <= BROADCAST_BYTES:
        asked = held(queries, "query_id").toArrow().combine_chunks()
        q, q_v = asked["query_id"].to_numpy(), unit_rows(asked["embedding"].combine_chunks())

        def meet(batches):
            return judge(p for batch in batches if batch.num_rows for p in pieces(q, q_v, batch.column(0).to_numpy(zero_copy_only=False), unit_rows(batch.column(1))))

        return held(vectors, "id").mapInArrow(meet, schema)
    parts = max(1, -(-n.n // QUERY_BLOCK))
    asked = stored(packed(queries.repartition(parts), "query_id", "q").withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks = F.array(*[F.lit(r.q) for r in asked.select("q").collect()]).cast("array<long>")
    met = packed(vectors, "id", "b").withColumn("q", F.explode(blocks)).join(asked, "q")

    def search(batches):
        def joined():
            for batch in batches:
                for row in batch.select(["q_ids", "q_v", "b_ids", "b_v"]).to_pylist():
                    q, b = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["b_ids"], np.int64)
                    yield from pieces(q, np.frombuffer(row["q_v"]).reshape(len(q), -1), b, np.frombuffer(row["b_v"]).reshape(len(b), -1))

        return judge(joined())

    return met.mapInArrow(search, schema)


def nearest(vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """``query_id, id, similarity, rank``: exact cosine neighbours of ``queries(query_id, embedding)`` among ``vectors(id, embedding)``; a task's best ``most`` leave it."""

    def judge(pieces):
        best, of = Best(most), {}

        def found():
            for block, q, i, s in best.taken():
                yield pa.RecordBatch.from_arrays([pa.array(of[block][q]), pa.array(i), pa.array(s)], ["query_id", "id", "similarity"])

        for q, b, s in pieces:
            block = (int(q[0]), len(q))
            of[block] = q
            best.add(block, b, s, np.round(s, 9))
            if len(best) > KEPT:
                yield from found()
                of.clear()
        yield from found()

    found = meetings(vectors, queries, judge, "query_id long, id long, similarity double")
    return top(found, ["query_id"], [F.desc(F.round("similarity", 9)), "id"], most)


def within(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """``query_id, n``: how many vectors have a cosine of ``least`` or more with each query; counted where they meet."""

    def judge(pieces):
        counts = {}
        for q, _, s in pieces:
            block = (int(q[0]), len(q))
            counts[block] = (q, counts[block][1] + (s >= least).sum(axis=1) if block in counts else (s >= least).sum(axis=1))
        for q, n in counts.values():
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(n)], ["query_id", "n"])

    return meetings(vectors, queries, judge, "query_id long, n long").groupBy("query_id").agg(F.sum("n").alias("n")).where("n > 0")


COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("vector_search", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {COSINE} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(similarity, 5) AS similarity, rank FROM r WHERE rank <= 10")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id 50 divides."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = nearest(own, own.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10)
    return found.select("query_id", "id", F.round("similarity", 5).alias("similarity"), "rank")


@query("vector_threshold", f"SELECT a.vec_id AS query_id, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {COSINE} >= 0.3 GROUP BY a.vec_id")
def vector_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many vectors are at least 0.3 alike, for every query."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return within(own, own.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 0.3)


def fused(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ``lists(query_id, origin, weight, id, rank)``.

    A document counts once in each list, at its first rank; other ranks stay as they are. Gives
    ``score``, the best rank, and the ranks and contributions by origin.
    """
    first = lists.groupBy("query_id", "origin", "id").agg(F.min("rank").alias("rank"), F.first("weight").alias("weight"))
    part = F.col("weight") / (k + F.col("rank"))
    return first.groupBy("query_id", "id").agg(
        F.sum(part).alias("score"),
        F.min("rank").alias("best_rank"),
        F.map_from_entries(F.collect_list(F.struct("origin", "rank"))).alias("ranks"),
        F.map_from_entries(F.collect_list(F.struct("origin", part.alias("part")))).alias("parts"),
    )


@query("rank_fusion", f"WITH {CHUNKS}, l AS (SELECT article_id % 40 AS query_id, 'length' AS origin, 0.35 AS weight, chunk_id AS id, row_number() OVER (PARTITION BY article_id % 40 ORDER BY length(text) DESC, chunk_id) AS rank FROM chunks UNION ALL SELECT article_id % 40, 'place', 0.45, chunk_id, row_number() OVER (PARTITION BY article_id % 40 ORDER BY chunk_index, chunk_id) FROM chunks), f AS (SELECT query_id, id, sum(weight / (60 + rank)) AS score, min(rank) AS best_rank FROM l WHERE rank <= 200 GROUP BY query_id, id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best_rank, id) AS place FROM f) SELECT query_id, id, round(score, 8) AS score, best_rank, place FROM r WHERE place <= 20")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of the chunks, by length and by place, fused within forty groups."""
    rows = chunks(spark, sf_dir).select((F.col("article_id") % 40).alias("query_id"), F.col("chunk_id").alias("id"), "text", "chunk_index")
    a = top(rows, ["query_id"], [F.desc(F.length("text")), "id"], 200).select("query_id", F.lit("length").alias("origin"), F.lit(0.35).alias("weight"), "id", "rank")
    b = top(rows, ["query_id"], ["chunk_index", "id"], 200).select("query_id", F.lit("place").alias("origin"), F.lit(0.45).alias("weight"), "id", "rank")
    best = fused(a.unionByName(b))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "best_rank", "id")))
    return placed.where("place <= 20").select("query_id", "id", F.round("score", 8).alias("score"), "best_rank", "place")


#: Slots of a stand-in vector.
SLOTS = 16


def slots_of(words: pa.Array) -> np.ndarray:
    """The slot of each topical word, the first digit of its hash; function words have none."""
    digests = b"".join(hashlib.md5(w).digest()[:1] for w in words.cast(pa.binary()).to_pylist())
    topical = pc.invert(pc.is_in(words, value_set=pa.array(STOP_WORDS))).to_numpy(zero_copy_only=False)
    return np.where(topical, np.frombuffer(digests, np.uint8).astype(np.int64) >> 4, -1)


def stand_in_vectors(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, embedding``: sixteen hashed counts of a text's topical words, a stand-in for an encoder's vectors; a null text has none.

    A word is hashed once a batch at most.
    """

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            n, words = words_in(batch.column(1))
            words = words.dictionary_encode()
            slot = slots_of(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)]
            place = np.repeat(np.arange(batch.num_rows), n) * SLOTS + slot
            counts = np.bincount(place[slot >= 0], minlength=batch.num_rows * SLOTS).astype(np.float64)
            until = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SLOTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(until, pa.array(counts), mask=batch.column(1).is_null())], [key, "embedding"])

    own = rows.select(key, lowered(text).alias("_low"))
    return own.mapInArrow(run, f"{key} {own.schema[key].dataType.simpleString()}, embedding array<double>")


CONTENT = "list_filter(" + TOKENS + ", lambda t: NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "], t))"
VECTOR_OF = "list_transform(range(16), lambda d: CAST(len(list_filter(list_transform(" + CONTENT + ", lambda t: md5(t)[1:1]), lambda h: h = '0123456789abcdef'[d + 1:d + 1])) AS DOUBLE))"
HYBRID = f""", lx AS (SELECT query_id, chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM sc),
 qv AS (SELECT item_id AS query_id, {VECTOR_OF.format(x='text')} AS v FROM benchmark), cv AS (SELECT chunk_id AS id, {VECTOR_OF.format(x='text')} AS v FROM chunks),
 vs AS (SELECT query_id, id, round(CASE WHEN list_sum(qv.v) = 0 OR list_sum(cv.v) = 0 THEN 0 ELSE list_cosine_similarity(qv.v, cv.v) END, 9) AS s FROM qv, cv), vr AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM vs),
 hl AS (SELECT query_id, id, rank, 0.35 / (60 + rank) AS part FROM lx WHERE rank <= 200 UNION ALL SELECT query_id, id, rank, 0.45 / (60 + rank) FROM vr WHERE rank <= 200),
 hy AS (SELECT query_id, id, sum(part) AS score, min(rank) AS best_rank FROM hl GROUP BY query_id, id),
 hr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best_rank, id) AS rank FROM hy)"""


def hybrid_lists(spark: SparkSession, sf_dir: str, most: int, candidates: int = 200) -> DataFrame:
    """``query_id, id, score, best_rank, rank`` of the ``most`` best chunks of each query: a lexical and a vector list of ``candidates``, fused."""
    lexical = lexical_lists(spark, sf_dir, candidates).select("query_id", F.lit("lexical").alias("origin"), F.lit(LEXICAL).alias("weight"), F.col("chunk_id").alias("id"), "rank")
    vectors = stand_in_vectors(chunks(spark, sf_dir), "chunk_id", "text").withColumnRenamed("chunk_id", "id")
    near = nearest(vectors, stand_in_vectors(search_queries(spark, sf_dir), "query_id", "query"), candidates)
    semantic = near.select("query_id", F.lit("vector").alias("origin"), F.lit(VECTOR).alias("weight"), "id", "rank")
    return top(fused(lexical.unionByName(semantic)), ["query_id"], [F.desc(F.round("score", 12)), "best_rank", "id"], most)


@query("hybrid_search", LEXICAL_SQL + HYBRID + " SELECT query_id, hr.rank, id, article_id, round(score, 8) AS score, text FROM hr JOIN chunks ON chunk_id = id WHERE hr.rank <= 10")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each query by both lists, with their texts."""
    best = hybrid_lists(spark, sf_dir, 10)
    own = chunks(spark, sf_dir).select(F.col("chunk_id").alias("id"), "article_id", "text")
    return own.join(best, "id").select("query_id", "rank", "id", "article_id", F.round("score", 8).alias("score"), "text")


def abstract_of(text: Column) -> Column:
    """The second line of a document, which stands in for its abstract; null if there is none."""
    line = F.split_part(text, F.lit("\n"), F.lit(2))
    return F.when(F.trim(line) != "", line)


def ranked_articles(hits: DataFrame, details: DataFrame, queries: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """``query_id, article_id, matched, score, best_rank, best_chunk, rank`` from ``hits(query_id, chunk_id, article_id, score, rank)``.

    An article's score weighs its best chunk and the mean of its three best, each against the query's best article,
    the share of the query's terms in the title and in the abstract (``details(article_id, title, abstract)``), and the
    share of the query's concepts, its three longest terms, that stand in title, abstract or the five best chunks (``texts(chunk_id, text)``).
    """
    hits = stored(hits, "hits")
    n = hits.count()
    # only the hits' own texts and articles are read word by word
    its = small(hits.select("article_id").distinct(), n)
    texts, details = texts.join(its, "article_id", "left_semi"), details.join(its, "article_id", "left_semi")
    texts = texts.join(small(hits.select("chunk_id").distinct(), n), "chunk_id", "left_semi")
    best_first = Window.partitionBy("query_id", "article_id").orderBy(F.desc(F.round("score", 12)), "rank", "chunk_id")
    placed = hits.withColumn("n", F.row_number().over(best_first))
    said = placed.where("n <= 5").join(texts.select("chunk_id", F.array_distinct(tokens(F.col("text"))).alias("said")), "chunk_id")
    said = said.groupBy("query_id", "article_id").agg(F.array_distinct(F.flatten(F.collect_list("said"))).alias("said"))
    own = placed.groupBy("query_id", "article_id").agg(
        F.max("score").alias("best"), F.avg(F.when(F.col("n") <= 3, F.col("score"))).alias("top3"), F.count(F.lit(1)).alias("matched"),
        F.min("rank").alias("best_rank"), F.min_by("chunk_id", "n").alias("best_chunk"),
    )
    peak = Window.partitionBy("query_id")
    own = own.withColumn("best", F.col("best") / F.max("best").over(peak)).withColumn("top3", F.col("top3") / F.max("top3").over(peak))
    terms = queries.select("query_id", F.array_distinct(content_terms(F.col("query"))).alias("terms"))
    longest = F.slice(F.transform(F.array_sort(F.transform("terms", lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t")))), lambda x: x["t"]), 1, 3)
    terms = terms.withColumn("concepts", longest)
    words = details.select("article_id", tokens(F.col("title")).alias("title"), F.coalesce(tokens(F.col("abstract")), F.array().cast("array<string>")).alias("abstract"))
    full = own.join(said, ["query_id", "article_id"]).join(terms, "query_id").join(words, "article_id")
    everything = F.concat("title", "abstract", "said")
    parts = {"best": F.col("best"), "top3": F.col("top3"), "title": coverage(F.col("terms"), F.col("title")), "abstract": coverage(F.col("terms"), F.col("abstract")), "concept": coverage(F.col("concepts"), everything)}
    score = sum((ARTICLE_WEIGHTS[k] * x for k, x in parts.items()), F.lit(0.0))
    full = full.select("query_id", "article_id", "matched", "best_rank", "best_chunk", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 9).alias("score"))
    return top(full, ["query_id"], [F.desc("score"), "best_rank", "article_id"], most)


def article_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best chunks of each query, with their articles."""
    return hybrid_lists(spark, sf_dir, 100).select("query_id", F.col("id").alias("chunk_id"), F.floor(F.col("id") / 100000).cast("long").alias("article_id"), "score", "rank")


def article_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("article_id", "title", abstract_of(F.col("body")).alias("abstract"), "doi", "status")


COVERAGE = "CASE WHEN len({q}) = 0 THEN 0 ELSE len(list_intersect({q}, {w})) / len({q}) END"
ARTICLE_RANK = HYBRID + f""", hits AS (SELECT query_id, chunk_id, article_id, score, hr.rank FROM hr JOIN chunks ON chunk_id = id WHERE hr.rank <= 100),
 pl AS (SELECT *, row_number() OVER (PARTITION BY query_id, article_id ORDER BY round(score, 12) DESC, rank, chunk_id) AS n FROM hits),
 sd AS (SELECT query_id, article_id, flatten(list(w)) AS said FROM pl JOIN w0 USING (chunk_id, article_id) WHERE n <= 5 GROUP BY query_id, article_id),
 ow AS (SELECT query_id, article_id, max(score) AS best, avg(score) FILTER (n <= 3) AS top3, count(*) AS matched, min(rank) AS best_rank, arg_min(chunk_id, n) AS best_chunk FROM pl GROUP BY query_id, article_id),
 tq AS (SELECT item_id AS query_id, list_distinct({CONTENT.format(x='text')}) AS terms FROM benchmark), tc AS (SELECT query_id, terms, list_transform(list_sort(list_transform(terms, lambda t: {{'l': -length(t), 't': t}}))[1:3], lambda x: x.t) AS concepts FROM tq),
 ti AS (SELECT doc_id AS article_id, {TOKENS.format(x="split_part(text, chr(10), 1)")} AS title, {TOKENS.format(x="split_part(text, chr(10), 2)")} AS abstract FROM documents),
 fin AS (SELECT ow.query_id, ow.article_id, matched, best_rank, best_chunk, round(least(1, greatest(0, 0.40 * best / max(best) OVER (PARTITION BY ow.query_id) + 0.25 * top3 / max(top3) OVER (PARTITION BY ow.query_id) + 0.15 * {COVERAGE.format(q='terms', w='title')} + 0.10 * {COVERAGE.format(q='terms', w='abstract')}
   + 0.10 * {COVERAGE.format(q='concepts', w='list_concat(title, abstract, said)')})), 9) AS score
  FROM ow JOIN sd USING (query_id, article_id) JOIN ti USING (article_id) JOIN tc USING (query_id)),
 ar AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, article_id) AS rank FROM fin)"""


@query("article_ranking", LEXICAL_SQL + ARTICLE_RANK + " SELECT query_id, article_id, matched, best_chunk, round(score, 4) AS score, rank FROM ar WHERE rank <= 10")
def article_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best articles of each query by their best chunks, title, abstract and concepts."""
    found = ranked_articles(article_hits(spark, sf_dir), article_details(spark, sf_dir), search_queries(spark, sf_dir), chunks(spark, sf_dir), 10)
    return found.select("query_id", "article_id", "matched", "best_chunk", F.round("score", 4).alias("score"), "rank")
