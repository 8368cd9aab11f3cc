"""Enrichment, synthesis sources and grounding by hand and against plain loops."""

from __future__ import annotations

import random

from lodestar.operators import enrichment, grounding, synthesis

TARGET = "id long, doi string, provider_id string, title string, year int, journal string, authors array<string>"
RECORD = TARGET.replace("id long", "record_id long", 1)


def test_each_tier_gets_what_the_one_before_left(spark):
    t = lambda i, doi=None, pid=None, title=None, year=None, journal=None, authors=(): (i, doi, pid, title, year, journal, list(authors))
    long = "a rather long title about the ageing of something in bottles"
    targets = spark.createDataFrame([t(1, "10.1/A"), t(2, None, "p2", "x"), t(3, title="The Twin!", year=2000, authors=["Li"]), t(4, title=long + "s", year=2001), t(5, title=long, year=1990), t(6, title=""), t(7, "10.1/zz", title="The twin", journal="own"), t(8, title="double"), t(9, title="The twin", authors=["Bo"])], TARGET)
    first = spark.createDataFrame([t(100, "10.1/a", None, "n", 2005, "J"), t(99, "10.1/a", None, "n", 2004, "K")], RECORD)
    second = spark.createDataFrame([t(200, "10.1/b", "p2", "n", 2006)], RECORD)
    third = spark.createDataFrame([t(300, "10.1/c", None, "the twin", 2001, "J3", ["Li", "Ann"]), t(301, None, None, "double"), t(302, None, None, "Double")], RECORD)
    fourth = spark.createDataFrame([t(400, "10.1/d", None, long, 2001, "J4"), t(401, "10.1/e", None, long + "ss", 2001, "J5")], RECORD)
    rows = enrichment.enriched(targets, [("a", "doi", first), ("b", "id", second), ("c", "twin", third), ("d", "title", fourth)])
    got = {x.id: (x.method, x.record_id, x.doi, x.year, x.journal, x.authors, x.missing_before, x.missing_after) for x in rows.collect()}
    assert got == {
        1: ("a", 99, "10.1/A", 2004, "K", [], 3, 1), 2: ("b", 200, "10.1/b", 2006, None, [], 4, 2), 3: ("c", 300, "10.1/c", 2000, "J3", ["Li"], 2, 0), 4: ("d", 401, "10.1/e", 2001, "J5", [], 3, 1),
        5: ("review", 400, None, 1990, None, [], 3, 3), 6: ("none", None, None, None, None, [], 4, 4), 7: ("c", 300, "10.1/zz", 2001, "own", ["Li", "Ann"], 2, 0), 8: ("none", None, None, None, None, [], 4, 4), 9: ("none", None, None, None, None, ["Bo"], 3, 3),
    }
    assert {x.field: x.n for x in enrichment.gaps(targets).collect()} == {"doi": 7, "year": 6, "journal": 8, "authors": 7}


def test_like_titles_of_two_tables_are_those_of_all_pairs(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 70))) for _ in range(60)]

    def changed(x: str) -> str:
        x = list(x)
        for _ in range(r.randrange(4)):
            x[r.randrange(len(x))] = r.choice("abcdef")
        return "".join(x)

    left, right = [(i, changed(x)) for i, x in enumerate(base)], [(1000 + i, changed(x)) for i, x in enumerate(base)]

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    wanted = {(i, j) for i, a in left for j, b in right if 1 - distance(a, b) / max(len(a), len(b)) >= 0.96 - 1e-9}
    got = enrichment.like_titles(spark.createDataFrame(left, "id long, key string"), spark.createDataFrame(right, "id long, key string"))
    assert {(x.a, x.b) for x in got.collect()} == wanted and len(wanted) > 10


def test_passages_take_turns_until_the_budget_ends(spark):
    r = random.Random(8)
    records = [(q, q * 100 + i, r.randrange(9)) for q in range(4) for i in range(r.randrange(1, 15))]
    passages = [(rec, rec * 10 + k, r.choice(["text", "text", "figure"]), r.randrange(5), r.choice(["  ", "x" * r.randrange(1, 90), " y" * r.randrange(1, 40)])) for _, rec, _ in records for k in range(r.randrange(6))]
    got = synthesis.bounded_evidence(spark.createDataFrame(records, "query_id long, record_id long, at long"), spark.createDataFrame(passages, "record_id long, evidence_id long, kind string, at long, text string"), 9, 260, 60)
    wanted = set()
    for q in range(4):
        chosen = [rec for _, rec, _ in sorted((x for x in records if x[0] == q), key=lambda x: (x[2], x[1]))][:10]
        held = {}
        for rec in chosen:
            own = sorted((p for p in passages if p[0] == rec), key=lambda p: (p[3], p[1]))
            held[rec] = [p for p in own if p[2] == "text"][:2] + [p for p in own if p[2] == "figure"][:1]
        place = used = 0
        for turn in range(3):
            for rec in chosen:
                if turn < len(held[rec]) and place < 9 and used < 260:
                    text = held[rec][turn][4].strip(" ")[:60]
                    if text:
                        place += 1
                        text = text[: 260 - used]
                        wanted.add((q, place, rec, held[rec][turn][1], turn + 1, used, text))
                        used += len(text)
    assert {tuple(x) for x in got.collect()} == wanted
    cards = synthesis.synthesis_cards(spark.createDataFrame(records, "query_id long, record_id long, at long"), got).collect()
    assert all((c.gap is None) == bool(c.evidence_ids) for c in cards) and {e for c in cards for e in c.evidence_ids or []} == {w[3] for w in wanted}


def test_a_code_for_each_fault_of_a_statement(spark):
    evidence = [("e1", "The dose of 1,500 mg causes a rise; producers should test it.", "A"), ("e2", "Levels rose to 7.", "B"), ("e3", "Nothing was safe here.", "C"), ("e4", "It is always so.", "A")]
    cases = [
        ("The dose of 1500 mg causes a rise.", ["e1"], "grounded"), ("A claim.", [], "no_evidence"), ("A claim.", ["e1", "e9"], "outside"), ("- a list item", ["e1"], "fragment"), ("A heading:", ["e1"], "fragment"), ("As e1 says.", ["e1"], "leaked_id"), ("A claim.", ["e1", "e3"], "refused_grade"),
        ("Levels rose.", ["e2"], "not_called_indirect"), ("Indirectly, levels rose to 7.", ["e2"], "grounded"), ("One must test it.", ["e4"], "norm"), ("One should test it.", ["e1"], "grounded"), ("It is safe.", ["e1"], "safety"), ("It leads to decay.", ["e4"], "cause"), ("The best choice.", ["e1"], "superlative"),
        ("This is proven.", ["e1"], "certainty"), ("It is always so.", ["e4"], "grounded"), ("The dose is 1600 mg.", ["e1"], "number"), ("A dose of 1.5 g causes a rise.", ["e1"], "number"), ("Indirectly, 8 were found.", ["e2"], "number"), (" ", ["e1"], "fragment"),
    ]
    statements = spark.createDataFrame([(1, i, text, cited) for i, (text, cited, _) in enumerate(cases)], "answer_id long, statement_id long, text string, cited array<string>")
    allowed = spark.createDataFrame([(1, e) for e in ("e1", "e2", "e3", "e4")] + [(2, "e9")], "answer_id long, evidence_id string")
    got = {x.statement_id: (x.code, x.codes) for x in grounding.audited(statements, spark.createDataFrame(evidence, "evidence_id string, text string, grade string"), allowed).collect()}
    assert [got[i][0] for i in range(len(cases))] == [c[2] for c in cases]
    assert {c for c, _ in got.values()} == set(grounding.CODES)
