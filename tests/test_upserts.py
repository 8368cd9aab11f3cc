"""The harvest upsert against plain loops over random records: groups by pairs, folds in order, sticky states."""

from __future__ import annotations

import random

import pytest

from lodestar.operators import upserts

RECORD = "id long, doi string, title string, abstract string, authors array<string>, citations long, journal string, work_type string, publisher string, year int, url string, score double, decision string, status string"


def random_rows(seed: int, n: int, first: int) -> list[tuple]:
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    rows = []
    for i in range(n):
        rows.append((
            first + i, pick(None, None, " ", *(f"10.1/D{k}" for k in range(12)), *(f"10.1/d{k}" for k in range(12))), pick(None, "", upserts.NO_TITLE, *(f"Títle {k}" for k in range(9)), *(f"title  {k}" for k in range(9))),
            pick(None, "", " ", *("x" * k + str(k % 3) for k in range(1, 7))), pick(None, [], *([pick("Ann", "Bo", "Cé", " ", "Di") for _ in range(3)] for _ in range(5))), pick(None, *range(5)),
            pick(None, "", "J1", "J2"), pick(None, "article"), None, pick(None, 2001, 2002), pick(None, "", "u"), pick(None, 0.2, 0.5, 0.9), pick("accepted", "review", "rejected", "manual_rejected" if r.random() < 0.2 else "review", None), pick("indexed", "pending"),
        ))
    return rows


def key(title: str | None) -> str:
    return "".join(c for c in (title or "").lower().replace("í", "i") if c.isascii() and c.isalnum())


def text(x):
    return x if x is not None and str(x).strip() != "" else None


def groups_by_pairs(rows: list[dict]) -> list[list[dict]]:
    """Groups as the closure of pairs: equal DOIs, or equal title and year where the one without a DOI takes the first of the DOIs there are."""
    leader = list(range(len(rows)))

    def top(i: int) -> int:
        while leader[i] != i:
            i = leader[i]
        return i

    for i, a in enumerate(rows):
        same = [j for j, b in enumerate(rows) if (key(a["title"]), a["year"]) == (key(b["title"]), b["year"])]
        with_doi = [j for j in same if rows[j]["doi"]]
        for j, b in enumerate(rows):
            if a["doi"] and a["doi"] == b["doi"] or not a["doi"] and (j == with_doi[0] if with_doi else j in same):
                leader[top(i)] = top(j)
    found = {}
    for i, a in enumerate(rows):
        found.setdefault(top(i), []).append(a)
    return list(found.values())


def fold_in_order(rows: list[dict]) -> dict:
    out = {"doi": None, "title": None, "abstract": None, "authors": [], "citations": None, **dict.fromkeys(upserts.FIRST)}
    for x in rows:
        out["doi"] = out["doi"] or x["doi"]
        if text(x["title"]) and (out["title"] is None or out["title"] == upserts.NO_TITLE and x["title"] != upserts.NO_TITLE):
            out["title"] = x["title"]
        if text(x["abstract"]) and (out["abstract"] is None or len(x["abstract"]) > len(out["abstract"])):
            out["abstract"] = x["abstract"]
        out["authors"] += [a for a in dict.fromkeys(x["authors"] or []) if a.strip() and a not in out["authors"]]
        out["citations"] = x["citations"] if out["citations"] is None else max(out["citations"], x["citations"] if x["citations"] is not None else -1)
        for f in upserts.FIRST:
            out[f] = out[f] if text(out[f]) is not None else text(x[f])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_records_after_a_harvest_are_those_of_a_plain_loop(spark, seed):
    old, new = random_rows(seed, 25, 0), random_rows(seed + 50, 60, 0)
    records, hits = spark.createDataFrame(old, RECORD), spark.createDataFrame(new, RECORD).drop("status")
    gone = {"10.1/d3"}
    got = {x.canonical_key: x for x in upserts.upserted(records, hits, spark.createDataFrame([(" 10.1/D3 ",)], "doi string")).collect()}
    names = [f.split()[0] for f in RECORD.split(", ")]
    rows = [dict(zip(names, x, strict=True)) | {"kind": kind} for kind, part in ((0, old), (1, new)) for x in part]
    for x in rows:
        x["doi"] = text(x["doi"] and x["doi"].strip().lower())
    rows = [x for x in rows if not (x["kind"] and x["doi"] in gone)]
    wanted = groups_by_pairs(rows)
    assert len(got) == len(wanted)
    chains = 0
    for own in wanted:
        merged = fold_in_order(own)
        name = next(k for k in got if k == (f"doi:{merged['doi']}" if merged["doi"] else f"title:{key(own[0]['title']) or k.split(':')[1]}:{own[0]['year'] or 'unknown'}"))
        x, olds = got[name], [r for r in own if not r["kind"]]
        chains += len({(key(r["title"]), r["year"]) for r in own}) > 1 and any(not r["doi"] for r in own)
        assert {f: x[f] for f in merged} == merged
        assert (x.id, x.n_old, x.n_hits) == (olds[0]["id"] if olds else None, len(olds), len(own) - len(olds))
        manual = [r["decision"] for r in own if r["decision"] in upserts.MANUAL]
        best = max((r["score"] if r["score"] is not None else -1.0, upserts.RANKS.get(r["decision"], -1)) for r in own)
        mine = (max((r["score"] for r in own if r["score"] is not None), default=None), upserts.RANKS.get(x.decision, -1))
        assert x.decision == manual[0] if manual else (mine[0] if mine[0] is not None else -1.0, mine[1]) == best
        fresh = "pending" if merged["abstract"] else "not_applicable"
        unchanged = olds and fold_in_order(olds[:1]) == merged
        assert x.status == (olds[0]["status"] if unchanged else fresh)
    assert chains > 2
    assert upserts.upserted(records.limit(0), hits.limit(0)).count() == 0


def test_how_hits_find_their_records(spark):
    r = lambda i, doi, title, year=2001: (i, doi, title, None, None, None, None, None, None, year, None, None, None, None)
    records = spark.createDataFrame([r(0, "10.1/a", "One"), r(1, None, "Two")], RECORD)
    hits = spark.createDataFrame([r(0, "10.1/A ", "Other"), r(1, None, "one!"), r(2, "10.1/b", "TWO"), r(3, None, "Other"), r(4, None, "Three"), r(5, None, "three"), r(6, None, "Five"), r(7, "10.1/a", "Five"), r(8, None, "One", 1999), r(9, None, "One", None)], RECORD)
    got = {x.id: (x.canonical_key, x.matched_by) for x in upserts.hit_matches(records, hits).collect()}
    assert got == {
        0: ("doi:10.1/a", "doi"), 1: ("doi:10.1/a", "title"), 2: ("doi:10.1/b", "provisional"), 3: ("doi:10.1/a", "title"), 4: ("title:three:2001", "new"), 5: ("title:three:2001", "title"),
        6: ("doi:10.1/a", "chain"), 7: ("doi:10.1/a", "doi"), 8: ("title:one:1999", "new"), 9: ("title:one:unknown", "new"),
    }
