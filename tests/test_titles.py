"""Alike titles: few grams, few meetings, distances within bounds, copies that ask and answer once."""

from __future__ import annotations

import random

from lodestar.operators import enrichment, entities


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(key: str, edits: int, r: random.Random, letters: str) -> str:
    out = list(key)
    for _ in range(edits):
        at = r.randrange(len(out) + 1)
        out[at : at + r.choice([0, 1])] = r.choice(["", *letters])
    return "".join(out)


def test_distances_within_bounds(monkeypatch):
    r = random.Random(2)
    for long in (entities.LONG, 1):  # by bits, then along diagonals
        monkeypatch.setattr(entities, "LONG", long)
        for _ in range(300):
            a = "".join(r.choice("ab") for _ in range(r.randrange(60)))
            b, most = edited(a or "a", r.randrange(8), r, "abc"), r.randrange(9)
            want = distance(a, b)
            assert entities.distance_within(a, b, most) == (want if want <= most else -1)


def test_most_lost_grams_are_those_of_the_worst_edits():
    import numpy as np

    assert [entities.most_lost(np.array([0, 1, 2, 20, 40, 41]), d, 5) for d in range(4)] == [0, 3, 5, 6]


def test_titles_of_one_vocabulary_hardly_meet_and_periodic_ones_are_found(spark):
    r = random.Random(4)
    parts = ["the", "an", "en", "er", "on", "ti", "re", "ou", "st", "he", "al", "ing"]
    keys = ["".join(r.choice(parts) for _ in range(r.randrange(60, 70))) for _ in range(150)]
    keys += [edited(x, r.randrange(1, 8), r, "xyz") for x in keys[:30]] + ["ab" * 60, "ab" * 60 + "c", "ba" * 60, "abb" * 40]
    like = {(i, j) for i, a in enumerate(keys) for j, b in enumerate(keys) if i < j and abs(len(a) - len(b)) <= 8 and distance(a, b) <= 0.04 * max(len(a), len(b)) + 1e-9}
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    placed = entities.placed_grams(rows, entities.ALIKE).cache()
    # each letter began a gram before, and titles of one vocabulary met by most of them
    assert placed.where("level = 0").count() < sum(map(len, keys)) / 2
    met = {(x.a, x.b) for x in entities.title_meetings(placed, placed, entities.ALIKE).where("a < b").distinct().collect()}
    assert like <= met and len(met) < len(like) + 60
    assert {(x.a, x.b) for x in entities.title_pairs(rows).collect()} == like and len(like) > 20

def test_copies_of_a_title_ask_and_answer_once(spark, monkeypatch):
    kept, rows = enrichment.first_by, []

    def watched(df, keys, order):
        rows.append(df.count())
        return kept(df, keys, order)

    monkeypatch.setattr(enrichment, "first_by", watched)
    kind = "id long, doi string, provider_id string, title string, year int, journal string, authors array<string>"
    title = "a rather long title about the ageing of something in bottles"
    targets = spark.createDataFrame([(i, None, None, title, 2000 + i % 2, None, None if i % 3 == 0 else ["b", "a"]) for i in range(60)], kind)
    records = spark.createDataFrame([(100 + i, f"10.1/{i}", None, title + "s" * (i % 2), 2001 + i % 3, "J", ["a", "c"]) for i in range(60)], kind.replace("id", "record_id", 1))
    got = enrichment.enriched(targets, [("t", "title", records)]).collect()
    assert max(rows) <= 60  # 3600 before
    assert {(x.id % 2, x.method, x.record_id, round(x.confidence, 6)) for x in got} == {(0, "t", 100, 1.0), (1, "t", 100, 1.0)}
    assert {x.id for x in got} == set(range(60))
