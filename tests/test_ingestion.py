"""Ingestion, provider mappings and deep fusion by hand and against plain loops."""

from __future__ import annotations

import json
import random

import pytest

from lodestar.operators import fusion, ingestion, mappings


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicates_are_those_of_a_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, *"abcdefgh"]), r.choice([None, None, *"pqrstu"]), r.choice("xyz"), r.choice([None, 1, 2])) for i in r.sample(range(1000), 60)] + [(2000 + i, "same", None, "same", 1) for i in range(40)]
    got = {x.id: (x.duplicate_of, x.reason) for x in ingestion.first_of_their_kind(spark.createDataFrame(rows, "id long, sha string, doi string, key string, year int"), ingestion.LEVELS).collect()}
    taken, wanted = [], {}
    for i, sha, doi, key, year in sorted(rows):
        own = {"hash": (sha,), "doi": (doi,), "title": (key, year)}
        hits = {name: next((j for j, o in taken if o[name] == v), None) if None not in v else None for name, v in own.items()}
        name = next((n for n in own if hits[n] is not None), None)
        wanted[i] = (hits[name], name) if name else (None, None)
        if name is None:
            taken.append((i, own))
    assert got == wanted


def test_each_file_has_a_status_and_bad_ones_stop_nothing(spark):
    text = "A plain title line.\nThis is a sentence of the first page. And another one follows here.\nA second page of it."
    rows = [(1, text, "10.1/a", "One", 2001), (2, None, None, "Two", 2001), (3, "   ", None, "Three", 2001), (4, text + " more", "10.1/A ", "Four", 2002), (5, "§§ ## %% ^^ ~~ || ¬¬ 0", None, "Five", 2001), (6, text, None, "Six", 2003), (7, "Other words. " * 900, None, "one!", 2001), (8, "Fine text that is quite long enough to be read by anyone who can read, as it says.", None, " ", 2001), (9, "Fresh words. " * 900, None, "Nine", None)]
    results, chunks = ingestion.ingested(spark.createDataFrame(rows, "id long, body string, doi string, title string, year int"))
    got = {x.id: (x.status, x.error, x.duplicate_of, x.reason) for x in results.collect()}
    assert got == {
        1: ("chunks_ready", None, None, None), 2: ("failed", "no content", None, None), 3: ("failed", "no content", None, None), 4: ("duplicate", None, 1, "doi"), 5: ("ocr_required", None, None, None),
        6: ("duplicate", None, 1, "hash"), 7: ("duplicate", None, 1, "title"), 8: ("failed", "no title", None, None), 9: ("chunks_ready", None, None, None),
    }
    n = {x.id: x.n_chunks for x in results.collect()}
    assert n[1] >= 1 and n[9] > 3 and sum(n.values()) == chunks.count() and {x.doc_id for x in chunks.collect()} == {1, 9}
    assert ingestion.ingested(spark.createDataFrame([], "id long, body string, doi string, title string, year int"))[0].count() == 0


def test_records_of_providers_with_gaps_and_errors(spark):
    raw = [
        (1, "crossref", json.dumps({"DOI": "10.1234/X", "title": ["A <i>b</i>  c"], "author": [{"given": "Ann", "family": "Li"}, {"family": "Bo"}, {}], "issued": {"date-parts": [[2004]]}, "is-referenced-by-count": 3})),
        (2, "openalex", json.dumps({"display_name": "T", "abstract_inverted_index": {"b": [1, 3], "a": [0, 2]}, "publication_year": 3004, "cited_by_count": -1})),
        (3, "europe_pmc", json.dumps({"title": "T", "authorString": "Li A, Bo B, Li A.", "journalTitle": "", "journalInfo": {"journal": {"title": "J"}}, "pubYear": "c. 1999"})),
        (4, "datacite", json.dumps({"id": "10.5555/z", "attributes": {"titles": [{"title": None}]}})), (5, "crossref", "{broken"), (6, "nobody", "{}"), (7, None, "{}"), (8, "crossref", None), (9, "semantic_scholar", json.dumps({"title": "T", "authors": "none", "citationCount": "12.0"})),
    ]
    got = {x.id: x for x in mappings.common_records(spark.createDataFrame(raw, "id long, provider string, raw string"), mappings.SPECS).collect()}
    assert {i: x.error for i, x in got.items()} == {1: None, 2: None, 3: None, 4: "no title", 5: "no JSON", 6: "unknown provider", 7: "unknown provider", 8: "no JSON", 9: None}
    assert (got[1].doi, got[1].title, got[1].authors, got[1].year, got[1].citations, got[1].abstract) == ("10.1234/x", "A b c", ["Ann Li", "Bo"], 2004, 3, None)
    assert (got[2].abstract, got[2].year, got[2].citations) == ("a b a b", None, None)
    assert (got[3].authors, got[3].journal, got[3].year) == (["Li A", "Bo B"], "J", 1999)
    assert (got[9].authors, got[9].citations) == (None, 12) and got[5].title is None
    with pytest.raises(ValueError):
        mappings.compiled([("nothing", 0, "$.x", "text", "")], spark.range(1)["id"])


HITS = "query_id long, variant int, method string, scope string, article_id long, chunk_id long, rank int, title string, text string, page_start long, page_end long"


def test_fusion_with_anchors_and_a_conflict(spark):
    h = lambda v, m, c, rank, text="about Ciders", q=1, page=0: (q, v, m, "common", c // 10, c, rank, "t", text, page, page)
    hits = [h(1, "lexical", 11, 1), h(1, "lexical", 12, 2, "nothing"), h(1, "lexical", 13, 3), h(1, "vector", 12, 1, "nothing"), h(1, "vector", 13, 2), h(2, "vector", 11, 5), h(9, "lexical", 77, 1, "no anchors asked", 2)]
    weights = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.35), (2, 9, 0.65)], "query_id long, variant int, weight double")
    asked = spark.createDataFrame([(1, ["Cider", "Wine"]), (2, [])], "query_id long, anchors array<string>")
    got = {(x.query_id, x.chunk_id): x for x in fusion.deep_fused(spark.createDataFrame(hits, HITS), weights, asked).collect()}
    assert set(got) == {(1, 11), (1, 13), (2, 77)} and got[1, 11].raw_hits == 6 and got[1, 11].fused == 2
    # a vector list's ranks are counted anew
    assert got[1, 13].score == pytest.approx(1 / 63 + 1 / 61) and got[1, 11].score == pytest.approx(1 / 61 + 0.35 / 61) and got[1, 13].rank == 1
    assert got[1, 11].sources == "lexical:1,vector:2" and got[2, 77].score == pytest.approx(0.65 / 61)
    model = spark.createDataFrame([(1, "common", 1, 11, 1.0), (1, "common", 1, 13, 0.0)], "query_id long, scope string, article_id long, chunk_id long, model_score double")
    assert [x.chunk_id for x in fusion.deep_fused(spark.createDataFrame(hits, HITS), weights, asked, model).where("query_id = 1").orderBy("rank").collect()] == [11, 13]
    for bad in (h(2, "lexical", 11, 1, "about other ciders"), h(2, "lexical", 11, 1, page=4)):
        with pytest.raises(Exception, match="conflicting provenance of passage 11"):
            fusion.deep_fused(spark.createDataFrame([*hits, bad], HITS), weights, asked).collect()
    many = spark.createDataFrame([h(1, "lexical", 1000 + i, i + 1) for i in range(60)], HITS)
    cut = fusion.deep_fused(many, weights, asked).orderBy("rank").collect()
    assert [x.chunk_id for x in cut] == list(range(1000, 1012)) and {(x.fused, x.judged) for x in cut} == {(60, 40)}
