"""Near copies: no link is lost around hubs, templates of many documents, and sizes that differ."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestar.llm import components, copies, simhash
from lodestar.llm.components import connected_components


def jaccard(a: set, b: set) -> float:
    return len(a & b) / max(1, len(a | b))


def groups(rows: list[tuple]) -> dict[int, int]:
    """The least id that links at 0.8 or more reach, by comparing all pairs."""
    sets = {i: set(copies.shingles(t).tolist()) for i, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and (jaccard(sets[a], sets[b]) >= 0.8 or not sets[a] and not sets[b])]
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


def edited(words: list[str], places: list[int], r: random.Random) -> list[str]:
    return [f"z{r.randrange(10**9)}" if i in places else w for i, w in enumerate(words)]


def test_a_document_alike_to_one_member_of_a_dense_group_is_not_lost(spark):
    r, rows = random.Random(3), []
    for g in range(12):
        hub = [f"h{g}x{r.randrange(10**6)}" for _ in range(200)]
        base = 1000 * g
        rows += [(base + i, " ".join([*hub[:-1], f"end{g}y{i}"])) for i in range(24)]
        copy = edited(hub, [10, 40, 70], r)
        rows.append((base + 100, " ".join(copy)))
        rows.append((base + 101, " ".join(edited(copy, [100, 130, 160, 190], r))))
    sets = {i: set(copies.shingles(t).tolist()) for i, t in rows}
    assert all(jaccard(sets[1000 * g + 101], sets[1000 * g + 100]) >= 0.8 > max(jaccard(sets[1000 * g + 101], sets[1000 * g + i]) for i in range(24)) for g in range(12))
    got = {x.doc_id: x.component_id for x in copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == groups(rows)


def test_documents_of_one_template_do_not_meet_and_links_of_all_sizes_are_found(spark):
    r, rows = random.Random(5), []
    stem = [f"s{r.randrange(10**6)}" for _ in range(170)]
    rows += [(i, " ".join([*stem, *(f"o{r.randrange(10**9)}" for _ in range(40 + i % 7))])) for i in range(120)]
    for i in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randrange(8, 260))]
        rows.append((2000 + 3 * i, " ".join(words)))
        rows.append((2001 + 3 * i, " ".join(words[: int(len(words) * r.uniform(0.78, 1))])))
        rows.append((2002 + 3 * i, " ".join([*words, *(f"n{r.randrange(10**6)}" for _ in range(int(len(words) * r.uniform(0, 0.24))))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = groups(rows)
    sets = copies.shingle_sets(docs).select("node", "own").dropDuplicates(["node"]).cache()
    names = {x.node: x.doc_id for x in copies.keyed(docs).select("doc_id", "node").collect()}
    # every document meets every other by shingles alone: all links, and none of the template's 7140 pairs
    pairs = copies.rare_pairs(sets.select("node", F.col("node").alias("root")), sets).cache()
    met = {(names[p.a], names[p.b]) for p in pairs.collect()}
    assert not [p for p in met if max(p) < 2000] and len(met) < 1500
    roots = {names[x.node]: x.root for x in connected_components(copies.alike(pairs, sets)).collect()}
    same = {}
    for i, t in rows:
        same.setdefault(copies.set_key(copies.shingles(t)), []).append(i)
    roots |= {i: roots.get(names[node], -min(own) - 1) for node, own in same.items() for i in own}
    least = {}
    for i, root in roots.items():
        least[root] = min(least.get(root, i), i)
    assert {i: least[root] for i, root in roots.items()} == wanted
    got = {x.doc_id: x.component_id for x in copies.near_copies(docs).collect()}
    assert got == wanted


def test_stars_join_at_once_and_steps_cost_few_shuffles(spark, monkeypatch):
    kept, plans = components.stored, []

    def watched(df, label="stage"):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")))
        return kept(df, label)

    monkeypatch.setattr(components, "stored", watched)
    edges = [(i, 5000) for i in range(900)] + [(5000, 6000), (6000, 6001), (7000, 7001), (7001, 7002)]
    roots = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long"), hub_rounds=2).collect()}
    assert len({roots[i] for i in (*range(900), 5000, 6000, 6001)}) == 1 and len(set(roots.values())) == 2
    assert len([x for x in plans if x[0] == "moves"]) <= 2
    plans.clear()
    monkeypatch.setattr(copies, "stored", watched)
    r, rows = random.Random(7), []
    for g in range(20):
        hub = [f"h{g}x{r.randrange(10**6)}" for _ in range(60)]
        rows += [(100 * g + i, " ".join(edited(hub, [r.randrange(60)] if i else [], r))) for i in range(r.randrange(1, 9))]
    got = {x.doc_id: x.component_id for x in copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)
    assert max(n for _, n in plans) <= 9


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    r = random.Random(9)
    text = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    near = " ".join([*text[0].split()[:-1], "changed"])
    # 2 has a copy of 1's text and a text of its own; 3 and 4 repeat; 5 has two near copies of its own
    rows = [(1, text[0]), (2, near), (2, text[1]), (3, text[2]), (3, text[2]), (4, None), (4, ""), (5, text[3]), (5, text[3] + " more"), (6, text[1]), (6, text[4]), (None, text[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(simhash.simhash_stage(spark, docs, "").collect(), key=str)
    assert sorted(x.doc_id for x in got) == [1, 2, 3, 4, 5, 6]
    assert {(x.doc_id, x.text) for x in got if x.doc_id not in (4, 5)} == {(1, text[0]), (2, text[1]), (3, text[2]), (6, text[4])}
