"""Operators on small literal tables with results worked out by hand."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import evidence, passages
from lodestar.operators.entities import filled, merged_providers, title_candidates
from lodestar.operators.evaluation import bootstrap, bradley_terry, ranking_metrics, threshold_sweep
from lodestar.operators.passages import canonical_number, chunked, numeric_verdicts, quantities
from lodestar.operators.relational import hydrated, optional_filter
from lodestar.operators.retrieval import bm25, fused, index_of, nearest, within
from lodestar.operators.selection import diversified
from lodestar.sources import datasets
from lodestar.streaming.events import accepted_once, event_stream, windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fold_and_keys(spark):
    assert one(spark, text.fold(F.lit("Éß Ñandú"))) == "ess nandu"
    assert one(spark, text.fold(F.lit("E\u0301te\u0301 ǅ ṩ ș"))) == "ete ǆ s s"
    assert one(spark, text.title_key(F.lit("The Étude: 2nd!"))) == "theetude2nd"
    assert len(one(spark, text.title_key(F.lit("!!!")))) == 64
    assert one(spark, text.tokens(F.lit("a-b_c 12"))) == ["a", "b", "c", "12"]
    assert one(spark, text.token_count(F.lit("Hi, you."))) == 4
    assert one(spark, text.query_terms(F.lit("a bb 7 bb"))) == ["bb", "7"]


def test_identifiers(spark):
    assert one(spark, text.doi_in(F.lit("see (10.1234/AbC.5)."))) == "10.1234/abc.5"
    assert one(spark, text.doi_in(F.lit("nothing"))) is None
    assert one(spark, text.all_dois(F.lit("10.1234/a 10.1234/B, 10.1234/a"))) == ["10.1234/a", "10.1234/b"]
    assert one(spark, text.verified_doi(F.lit(" 10.1234/A "))) == "10.1234/a"
    assert one(spark, text.verified_doi(F.lit("doi 10.1234/A"))) is None


def test_markup_is_read_before_tags_go(spark):
    assert one(spark, text.without_markup(F.lit("<p>a &amp; b</p><script>x<y</script> c"))) == "a & b c"
    assert one(spark, text.without_markup(F.lit("<br>"))) is None


def test_empty_sides(spark):
    none = F.array().cast("array<string>")
    assert one(spark, text.jaccard(none, F.array(F.lit("a")))) == 0.0
    assert one(spark, text.coverage(none, F.array(F.lit("a")))) == 0.0


def test_none_is_no_filter_and_empty_is_nothing(spark):
    df = spark.range(3)
    assert optional_filter(df, "id", None).count() == 3
    assert optional_filter(df, "id", []).count() == 0
    assert optional_filter(df, "id", [1]).count() == 1


def test_missing_authority_row_is_an_error(spark):
    hits, authority = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a")], "k long, v string")
    assert hydrated(hits, authority, "k", strict=False).count() == 1
    with pytest.raises(Exception, match="authority"):
        hydrated(hits, authority, "k").collect()


def test_rank_fusion_by_hand(spark):
    rows = [("q", "a", 0.35, 1, 1), ("q", "a", 0.35, 2, 2), ("q", "a", 0.35, 1, 3), ("q", "b", 0.45, 2, 1), ("q", "b", 0.45, 3, 2)]
    found = {r.id: r for r in fused(spark.createDataFrame(rows, "query_id string, origin string, weight double, id long, rank long")).collect()}
    assert found[1].score == pytest.approx(0.35 / 61)
    assert found[2].score == pytest.approx(0.35 / 62 + 0.45 / 61)
    assert found[2].ranks == {"a": 2, "b": 1} and found[2].best_rank == 1
    assert found[3].parts["b"] == pytest.approx(0.45 / 62)


def test_bm25_by_hand(spark):
    rows = spark.createDataFrame([(1, "cat cat dog", "cat"), (2, "dog", None), (3, "bird bird", ""), (4, None, None)], "id long, t string, h string")
    asked = spark.createDataFrame([(7, "cat"), (8, "fish")], "query_id long, term string")
    index = index_of(rows, "id", {"h": 1.5, "t": 1.0}, asked)
    assert {(r.id, r.term): (r.length, r.tf) for r in index.where("term IS NOT NULL").collect()} == {(1, "cat"): (4, 3.5)}
    got = {r.id: r.score for r in bm25(index, asked, "id").collect()}
    idf = math.log((4 - 1 + 0.5) / 1.5)
    assert got == {1: pytest.approx(idf * 3.5 * 2.2 / (3.5 + 1.2 * (0.25 + 0.75 * 4 / (7 / 4))))}
    assert bm25(index_of(rows.limit(0), "id", {"t": 1.0}, asked), asked, "id").count() == 0


def test_nearest_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None)], "id long, embedding array<float>")
    got = nearest(rows, spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>"), 2).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3] and got[1].similarity == pytest.approx(math.sqrt(0.5))
    assert nearest(rows.limit(0), rows.limit(0).withColumnRenamed("id", "query_id"), 2).count() == 0
    assert [(r.query_id, r.n) for r in within(rows, spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, embedding array<float>"), 0.5).collect()] == [(9, 2)]
    many = spark.range(500).select("id", F.array(F.cos(F.col("id") % 50), F.sin(F.col("id") % 50)).alias("embedding"))
    best = nearest(many, many.where("id < 2").withColumnRenamed("id", "query_id"), 12).collect()
    assert {(r.query_id, r.id) for r in best if r["rank"] <= 10} == {(q, q + 50 * i) for q in (0, 1) for i in range(10)} and len(best) == 24


def test_ranking_metrics_by_hand(spark):
    m = ranking_metrics(spark.createDataFrame([("c", 1, 0), ("c", 2, 2), ("c", 3, 1)], "case_id string, rank int, grade int"), 2).first()
    assert (m.precision, m.recall, m.mrr) == (0.5, 1.0, 0.5)
    assert m.ndcg == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))


def test_threshold_sweep(spark):
    got = {r.threshold: r for r in threshold_sweep(spark.createDataFrame([(0.9, True), (0.5, False), (0.5, True), (0.1, False)], "score double, relevant boolean")).collect()}
    assert got[0.9].precision == 1.0 and got[0.9].recall == 0.5
    assert got[0.5].f1 == pytest.approx(0.8) and got[0.5].specificity == 0.5


def test_chunks_lose_nothing_and_keep_their_bounds(spark):
    words = [f"w{i}" for i in range(90)]
    units = [(1, i // 30, i, "a" if i < 60 else "b", " ".join(words[i : i + 5])) for i in range(0, 90, 5)]
    got = sorted(chunked(spark.createDataFrame(units, "doc_id long, page int, pos int, section string, text string"), 20, 35, 5).collect(), key=lambda r: r.chunk)
    assert [w for w in words if not any(w in r.text.split() for r in got)] == []
    assert all(r.n_tokens <= 35 for r in got)
    assert any(r.first_page == 2 for r in got) and not any("w59" in r.text.split() and "w60" in r.text.split() for r in got)


def test_long_unit_is_cut(spark):
    df = spark.createDataFrame([(1, 0, 0, "a", "x " * 50)], "doc_id long, page int, pos int, section string, text string")
    assert sum(r.n_tokens for r in chunked(df, 20, 20, 0).collect()) == 50


def test_numbers():
    assert canonical_number("+01,50") == "1.5"
    assert canonical_number("1,000") == "1000"
    assert quantities("≥ 5 mg/L and 3–4 %") == [">=|5|||mg/L", "|3|-|4|%"]


def test_numeric_verdicts(spark):
    claims = spark.createDataFrame([(1, "5 mg"), (2, "5 mg and 6 g"), (3, "7 mg"), (4, "none")], "claim_id long, text string")
    evidence = spark.createDataFrame([(1, 1, "5 mg"), (2, 1, "5 mg"), (2, 2, "6 g"), (3, 1, "7 g")], "claim_id long, evidence_id long, text string")
    got = {r.claim_id: r.verdict for r in numeric_verdicts(claims, evidence).collect()}
    assert got == {1: "supported", 2: "ambiguous", 3: "unsupported", 4: "not_numeric"}


def test_strengths_follow_wins(spark):
    games = spark.createDataFrame([(1, 2, 1)] * 6 + [(2, 3, 2)] * 6 + [(1, 3, 1)] * 6, "left_id long, right_id long, winner_id long")
    got = {r.id: r.ability for r in bradley_terry(games, 8).collect()}
    assert got[1] > got[2] > got[3] and got[1] == pytest.approx(-got[3], abs=0.3)


def test_diversity_avoids_the_near_copy(spark):
    rows = [("q", 1, 1.0, ["a", "b"]), ("q", 2, 0.95, ["a", "b"]), ("q", 3, 0.9, ["c", "d"])]
    got = diversified(spark.createDataFrame(rows, "k string, id long, base double, words array<string>"), "k", 2).orderBy("place").collect()
    assert [r.id for r in got] == [1, 3]


def test_title_candidates(spark):
    r = random.Random(1)
    words = ["ageing", "cider", "in", "oak", "on", "the", "yeast", "under", "pressure", "of", "apple", "must"]
    titles = [" ".join(r.choice(words) for _ in range(r.randrange(2, 30))) for _ in range(80)]
    for t in titles[:60]:
        at = r.randrange(len(t))
        titles.append(r.choice([t[:at] + "x" + t[at:], t[:at] + t[at + 1 :], "a" + t, t + "s", t[:at] + "zz" + t[at + 2 :]]))
    rows = [(i, t, [2000, 2001, 2005, None][i % 4], [] if i % 5 == 0 else [f"n{i % 3}"]) for i, t in enumerate([*titles, None, titles[0].upper()])]
    got = {(x.target_id, x.article_id): (x.likeness, x.verdict) for x in title_candidates(spark.createDataFrame(rows, "article_id long, title string, year int, authors array<string>")).collect()}
    own = {}
    for i, t, y, n in rows:
        if t:
            own.setdefault(re.sub("[^a-z0-9]", "", t.lower()), []).append((i, y, n))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    wanted = {}
    for a in own:
        for b in own:
            if min(own[a])[0] < min(own[b])[0] and abs(len(a) - len(b)) <= 0.04 * max(len(a), len(b)):
                likeness = 1 - distance(a, b) / max(len(a), len(b))
                if likeness >= 0.96 - 1e-9:
                    years = any(y is None or z is None or abs(y - z) <= 1 for _, y, _ in own[a] for _, z, _ in own[b])
                    names = [{m for _, _, n in own[k] for m in n} for k in (a, b)]
                    wanted[min(own[a])[0], min(own[b])[0]] = (round(likeness, 6), "accepted" if years and (not all(names) or names[0] & names[1]) else "review")
    assert len(wanted) > 20 and got == wanted


def test_records_of_two_providers(spark):
    schema = "k long, title string, year int, doi string, journal string"
    first = spark.createDataFrame([(1, "a", None, "10.1/x", None), (2, None, 2000, "10.1/y", "j")], schema)
    second = spark.createDataFrame([(1, "b", 1999, "10.1/X", "z"), (2, "c", 2001, "10.1/other", None)], schema)
    with pytest.raises(Exception, match="different DOIs"):
        merged_providers(first, second, "k").collect()
    one = merged_providers(first, second, "k", strict=False).collect()
    assert [tuple(r) for r in one] == [(1, "a", 1999, "10.1/x", "z")]
    got = filled(first, second, "k").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1999, "10.1/x", "z", 2), (2, "c", 2000, "10.1/y", "j", 1)]


def test_streams(spark, tmp_path):
    rows = [(1, 7, "2024-01-01 00:00:10"), (2, 7, "2024-01-01 00:00:20"), (2, 7, "2024-01-01 00:00:20"), (3, 7, "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")

    def drained(stream, name, mode):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.sql(f"SELECT * FROM {name}").collect()

    source = lambda: event_stream(spark, f"{tmp_path}/in", df.schema)
    assert sorted(r.n for r in drained(windowed_counts(source()), "counts", "complete")) == [1, 3]
    assert len(drained(accepted_once(source(), ["event_id"]), "once", "append")) == 3


def test_intents_and_relevance_by_hand(spark):
    queries = spark.createDataFrame([(1, "Oxygen in red cider during must fining, aroma and colour"), (2, "anything else")], "query_id long, query string")
    lexicon = spark.createDataFrame(
        [("primary", "", "red cider"), ("close", "", "wine"), ("close", "", "must"), ("distant", "", "beer"), ("process", "", "fining"), ("facet", "smell", "aroma"), ("facet", "look", "colour"), ("facet", "look", "color"), ("exclusion", "", "oxygen"), ("primary", "", "red wine")],
        "kind string, facet string, phrase string",
    )
    asked = evidence.intents(queries, lexicon).orderBy("query_id").collect()
    assert (asked[0].primary, asked[0].close, asked[0].process, asked[0].exclusion) == (["red cider"], ["must"], ["fining"], ["oxygen"])
    assert [(f.facet, f.terms) for f in asked[0].facets] == [("look", ["colour"]), ("smell", ["aroma"])] and asked[1].facets == [] and asked[1].primary == []
    rows = [(1, 1, "Red cider fining", "the aroma and colour"), (1, 2, "A must", "red cider fining aroma"), (1, 3, "x", "fining of must, colour"), (1, 4, "x", "nothing here"), (1, 5, "Oxygen in red cider", "fining aroma colour"), (1, 6, "x", "red cider, colour"), (2, 7, "a", "b")]
    got = {r.rid: r for r in evidence.judged(spark.createDataFrame(rows, "query_id long, rid long, title string, text string"), evidence.intents(queries, lexicon)).collect()}
    assert got[1].relevance == pytest.approx(min(1, 1.0 * (0.82 + 0.18 * 0.8) + 0.02)) and got[1].grade == "A" and got[1].tier == "exact"
    assert got[2].tier == "near" and got[2].relevance == pytest.approx((0.45 * 0.88 + 0.30 + 0.25 * 0.5) * (0.82 + 0.18 * 0.45) + 0.02) and got[2].grade == "B"
    assert got[3].tier == "near" and got[3].relevance == pytest.approx((0.45 * 0.88 + 0.30 + 0.125) * 0.82 + 0.02)
    assert got[4].relevance == pytest.approx(0.0) and got[4].grade == "D" and got[5].grade == "D" and got[7].grade == "unassessed"
    assert got[6].relevance == pytest.approx((0.45 + 0.125) * 0.82 * 0.35) and got[6].grade == "C"


def test_reranking_and_merging_by_hand(spark):
    queries = spark.createDataFrame([(1, "cider fining aroma colour")], "query_id long, query string")
    lexicon = spark.createDataFrame([("primary", "", "cider"), ("process", "", "fining"), ("facet", "a", "aroma"), ("facet", "c", "colour")], "kind string, facet string, phrase string")
    asked = evidence.intents(queries, lexicon)
    schema = "query_id long, rid long, title string, text string, doi string, full boolean, rank int"
    rows = [(1, 1, "other", "nothing", None, False, 1), (1, 2, "cider fining", "aroma", "10.1/A", False, 2), (1, 3, "cider fining", "aroma", "10.1/a", True, 9), (1, 4, "Cider fining colour", "", None, False, 3), (1, 5, "cider  FINING colour!", "", None, False, 4)]
    got = evidence.reranked(spark.createDataFrame(rows, schema), asked, 3).orderBy("rank").collect()
    assert [(r.rid, r.grade) for r in got] == [(4, "A"), (3, "A"), (1, "D")]
    found = [(1, i, t, x, None, f, 0.5) for i, t, x, f in ((1, "cider fining colour", "", True), (2, "cider fining", "colour", True), (3, "cider", "aroma", False), (4, "cider fining", "aroma colour", False))]
    found = [(q, i, f"{t} {i}", x, d, f, s) for q, i, t, x, d, f, s in found]
    merged = evidence.merged_evidence(spark.createDataFrame(found, "query_id long, rid long, title string, text string, doi string, full boolean, score double"), asked, 4).orderBy("place").collect()
    assert [r.rid for r in merged] == [4, 1, 2, 3]


def test_passages_against_a_plain_loop(spark):
    r = random.Random(5)
    sections = ["results", "methods", "discussion", "introduction", None, "conclusion"]
    words = "yeast oak must pressure cider fining protein however mean 5 mg aroma colour methodology sample".split()
    texts = [(100 * a + i, a, i, r.choice(sections), " ".join(r.choice(words) for _ in range(r.randrange(3, 9)))) for a in (1, 2) for i in range(12)]
    texts += [(300 + i, 3, i, "results", "the same words of cider here") for i in range(6)] + [(400, 4, 0, "methods", "cider " * 7000), (401, 4, 1, "results", "oak " * 100)]
    hits = [(q, a, 100 * a + i, rank) for q in (1, 2) for a in (1, 2) for rank, i in enumerate(r.sample(range(12), 4), 1)] + [(1, 3, 302, 1), (1, 4, 400, 2), (1, 4, 401, 3)]
    queries = [(1, "cider fining protein aroma"), (2, "sample of oak")]
    got = passages.passage_candidates(spark.createDataFrame(hits, "query_id long, article_id long, chunk_id long, rank long"), spark.createDataFrame(texts, "chunk_id long, article_id long, chunk_index long, section string, text string"), spark.createDataFrame(queries, "query_id long, query string")).cache()
    rows = got.collect()
    assert {(x.query_id, x.chunk_id) for x in rows} == {(q, c) for q in (1, 2) for c, a, *_ in texts if any(h[0] == q and h[1] == a for h in hits)}
    assert next(x for x in rows if x.chunk_id == 302).score == pytest.approx(min(1, 0.25 + 0.4 + 0.22 * 0.25 + 0.22))
    wanted = {}
    for key in {(x.query_id, x.article_id) for x in rows}:
        pool = sorted((x for x in rows if (x.query_id, x.article_id) == key), key=lambda x: (-x.score, x.chunk_id))
        chosen, later, used = [], {"near": [], "methods": [], "same": []}, 0
        alike = lambda a, b: len({*a.said} & {*b.said}) / max(1, len({*a.said} | {*b.said})) >= 0.85 and a.said and b.said
        for x in pool:
            if len(chosen) >= 5 or used + len(x.text) > 32_000:
                continue
            if x.deferred:
                later["methods"].append(x)
            elif x.role and any(c.role == x.role for c in chosen) and any(o.role and o.role != x.role for o in pool):
                later["same"].append(x)
            elif any(alike(x, c) for c in chosen):
                later["near"].append(x)
            else:
                chosen.append(x)
                used += len(x.text)
        for x in [*later["near"], *later["methods"], *later["same"]]:
            if len(chosen) < min(3, len(pool)) and used + len(x.text) <= 32_000:
                chosen.append(x)
                used += len(x.text)
        chosen.sort(key=lambda x: (8 if x.pos is None else x.pos, -x.score, x.chunk_id))
        wanted |= {(*key, x.chunk_id): i for i, x in enumerate(chosen[:8], 1)}
    assert {(x.query_id, x.article_id, x.chunk_id): x.place for x in passages.selected_passages(got).collect()} == wanted


def test_bootstrap_intervals(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(400)] + [(None,)], "x double")
    a, b = passages_of_bootstrap(df.repartition(3)), passages_of_bootstrap(df.repartition(5))
    assert a == pytest.approx(b) and a[0] == pytest.approx(2.9925)
    spread = 1.96 * 2 / math.sqrt(400)
    assert a[1] == pytest.approx(a[0] - spread, abs=0.04) and a[2] == pytest.approx(a[0] + spread, abs=0.04)
    assert passages_of_bootstrap(df.limit(1)) == (0.0, 0.0, 0.0) and passages_of_bootstrap(df.limit(0)) == (None, None, None)


def passages_of_bootstrap(df):
    r = bootstrap(df).first()
    return (r.mean, r.low, r.high)


def test_scans_of_files(spark, tmp_path):
    csv, data = tmp_path / "v.csv", "kind,control_ph,control_empty,sample_id,replicate,compound,concentration,unit\nvolatiles,3.4,,a,1,ester,2.5,mg/L\nvolatiles,9,,b,2,acid,7,ug/L\n"
    csv.write_bytes(b"\xef\xbb\xbf" + data.encode())
    got = datasets.measurements(spark, str(csv)).orderBy("sample_id").collect()
    assert [(r.kind, r.controls, r.sample_id, r.replicate, r.concentration) for r in got] == [("volatiles", {"ph": "3.4"}, "a", 1, 2.5), ("volatiles", {"ph": "3.4"}, "b", 2, 7.0)]
    (tmp_path / "p.json").write_text(json.dumps({"kind": "polyphenols", "controls": {"oak": "no"}, "records": [{"sample_id": "s", "replicate": 1, "analyte": "x", "concentration_mg_l": 4.0}]}))
    assert [(r.controls, r.analyte, r.concentration_mg_l) for r in datasets.measurements(spark, str(tmp_path / "p.json")).collect()] == [({"oak": "no"}, "x", 4.0)]
    csv.write_text("kind,a\nother,1\n")
    with pytest.raises(ValueError, match="known kind"):
        datasets.measurements(spark, str(csv))
    question = lambda i, f: {"id": i, "family_id": f, "split": "x", "language": "en", "task": "t", "question": "q", "answerable": True}
    splits = []
    for name, own in (("development", [question("1", "a"), question("2", "a")]), ("final_test", [question("3", "b")])):
        text = json.dumps({"split": name, "questions": own})
        (tmp_path / f"{name}.json").write_text(text)
        splits.append({"split": name, "path": f"{name}.json", "sha256": hashlib.sha256(text.encode()).hexdigest(), "question_count": len(own)})
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps({"splits": splits}))
    assert datasets.question_splits(spark, str(tmp_path), "tuning").count() == 2 and datasets.question_splits(spark, str(tmp_path), "final_test").count() == 3
    manifest.write_text(json.dumps({"splits": [splits[0] | {"sha256": "0"}]}))
    with pytest.raises(ValueError, match="content"):
        datasets.question_splits(spark, str(tmp_path), "tuning")
    cases = [{"case_id": "c", "query": "q", "expected": ["a"], "acceptable": []}]
    for i, said in enumerate((cases, {"cases": cases})):
        (tmp_path / f"c{i}.json").write_text(json.dumps(said, indent=1))
        assert [(r.case_id, r.expected) for r in datasets.evaluation_cases(spark, str(tmp_path / f"c{i}.json")).collect()] == [("c", ["a"])]
    datasets.write_report(spark.createDataFrame([("mrr", 0.5), ("recall", 1.0)], "metric string, value double"), str(tmp_path / "report"))
    assert [r.value for r in spark.read.text(str(tmp_path / "report/markdown")).collect()] == ["| metric | value |", "| --- | --- |", "| mrr | 0.5 |", "| recall | 1.0 |"]
