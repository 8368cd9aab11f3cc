"""Bounded top-k: the same rows as scoring everything, from far fewer pairs; vectors by cells against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import cells, retrieval


def test_bounded_search_gives_the_rows_of_full_scoring_from_a_tenth_of_the_pairs(spark):
    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.6)) % 4000}" for _ in range(60_000)]
    rows, at = [], 0
    for i in range(1500):
        n = r.randrange(3, 70)
        rows.append((i, " ".join(words[(at + k) % len(words)] for k in range(n))))
        at += n
    rows += [(2000, None), (2001, ""), (2002, rows[0][1])]
    asked = [(q, w) for q in range(25) for w in {*(r.choice(words) for _ in range(9)), "w1", "w2"}] + [(50, "unheard"), (51, "w1")]
    queries = spark.createDataFrame(asked, "query_id long, term string")
    index = retrieval.index_of(spark.createDataFrame(rows, "id long, text string"), "id", {"text": 1.0}, queries)
    scores = retrieval.bm25(index, queries, "id").cache()
    for most in (1, 10):
        wanted = retrieval.top(scores, ["query_id"], [retrieval.best_first(), "id"], most).select("query_id", "id", "rank").collect()
        got = retrieval.best_by_bounds(index, queries, "id", most).select("query_id", "id", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, wanted))
    narrow = queries.where("query_id < 25")
    met = retrieval.bounded_candidates(index, narrow, "id", 1)[0].count()
    assert met * 10 < scores.where("query_id < 25").count()
    assert retrieval.best_by_bounds(index, queries.limit(0), "id", 5).count() == 0


def test_cells_prove_the_nearest_and_read_few_rows_where_there_are_clusters(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 24))
    vectors = centres[r.integers(0, 40, 4000)] + 0.15 * r.normal(size=(4000, 24))
    vectors[:1300] = vectors[0]  # a third of the rows are one vector
    vectors[5] = 0.0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None)], "id long, embedding array<double>").repartition(3).cache()
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = cells.built(rows)
    assert int(index.sizes.sum()) == 4000
    found, read = cells.proved(index, queries, 10)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    wanted = {}
    for q in range(0, 4000, 50):
        s = np.round(unit @ unit[q], 9)
        wanted[q] = sorted(range(4000), key=lambda i: (-s[i], i))[:10]
    got = {}
    for x in sorted(found.collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append(x.id)
    plain = [q for q in wanted if q >= 1300]
    assert {q: got[q] for q in plain} == {q: wanted[q] for q in plain}
    assert all(round(float(unit[got[q][9]] @ unit[q]), 9) == round(float(unit[wanted[q][9]] @ unit[q]), 9) for q in wanted)
    rows_read = {x.query_id: x.rows_read for x in read.collect()}
    assert sorted(rows_read[q] for q in plain)[len(plain) // 2] < 1000
    probes, recall = cells.probes_for(index, rows, queries.where("query_id >= 1300"), 10)
    assert recall >= 0.95 and probes <= 8
    assert cells.proved(cells.built(rows.limit(0)), queries, 3)[0].count() == 0
    assert cells.proved(index, queries.limit(0), 3)[0].count() == 0
