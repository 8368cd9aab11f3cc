"""Ties at a bar, titles in capitals, and titles that differ by what their length allows, by hand and by brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestar.operators import enrichment, entities, passages


def test_mean_discount_at_the_bar_admits(spark, tmp_path):
    rows = [(k, d / 100, "N") for k, ds in enumerate([(10, 8, 2, 0, 0), (9, 9, 2, 0, 0), (9, 8, 3, 0, 0), (9, 8, 2, 1, 0), (10, 6, 2, 2, 0), (1, 1, 9)]) for d in ds]
    spark.createDataFrame(rows, "l_orderkey long, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.claim_id: r.level for r in passages.claim_admission(spark, str(tmp_path)).collect()}
    assert got == {0: "established", 1: "established", 2: "established", 3: "established", 4: "established", 5: "tentative"}


def test_title_in_capitals_is_the_same_title(spark, tmp_path):
    rows = [(1, "Erü erachß und\nx", "de", "web", 16), (4, "Straße\ny", "de", "web", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.verdict for r in entities.cross_validated_matches(spark, str(tmp_path)).collect()} == {"accepted"}


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alike_titles_by_brute_force(spark):
    draw = random.Random(3)
    keys = []
    for _ in range(25):
        key = "".join(draw.choice("abcd") for _ in range(draw.choice([23, 24, 25, 48, 50, 51, 75])))
        for edits in (0, 1, 1, 2, 3):
            other = list(key)
            for _ in range(edits):
                at = draw.randrange(len(other))
                other[at : at + draw.choice([0, 1])] = draw.choice(["", "e", "f"])
            keys.append("".join(other))
    keys = sorted(set(keys))
    like = {(i, j): 1 - distance(a, b) / max(len(a), len(b)) for i, a in enumerate(keys) for j, b in enumerate(keys) if abs(len(a) - len(b)) < 4}
    want = {p for p, x in like.items() if x >= 0.96 - 1e-9}
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    assert {(r.a, r.b) for r in entities.title_pairs(rows).collect()} == {(a, b) for a, b in want if a < b}
    found = enrichment.like_titles(rows, rows).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)
    assert all(abs(r.likeness - like[r.a, r.b]) < 1e-9 for r in found)
    assert "key" not in entities.placed_grams(rows.withColumn("key", F.col("key")), 0.96).columns
