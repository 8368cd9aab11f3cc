"""The contracts of the numbered queries, and what the operators learn, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, hmm, langid, mixing, pii, secrets, simhash, syncmers, urls

SPACE = re.compile(r"[\x20\x09-\x0D]+")


# --- op10 ----------------------------------------------------------------------------------------


def anchors_by_hand(spark, words: list[str]) -> list[tuple[int, int]]:
    """Closed syncmers with Spark's own hash, k-mer by k-mer."""
    if not words:
        return []
    h = [spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in words]
    pair = {}

    def s(i):
        if i not in pair:
            pair[i] = spark.range(1).select(F.xxhash64(F.lit(h[i]), F.lit(h[i + 1]))).first()[0]
        return pair[i]

    out = []
    for i in range(len(words) - syncmers.K + 1):
        inner = [s(i + j) for j in range(syncmers.INNER)]
        if min(inner[0], inner[-1]) == min(inner):
            said = spark.range(1).select(F.shiftrightunsigned(F.xxhash64(F.lit(inner[0]), F.lit(inner[2]), F.lit(inner[4])), 33)).first()[0]
            out.append((i, said))
    return out


def likeness_by_hand(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    first = lambda x: {h: min(p for p, g in x if g == h) for _, h in x}
    a, b = first(a), first(b)
    if not a and not b:
        return 1.0
    shifts = [b[h] - a[h] for h in a if h in b]
    common = len(shifts) if min(len(a), len(b)) == 1 else sum(x == 0 or shifts.count(x) > 1 for x in shifts)
    return common / (len(a) + len(b) - common)


def test_anchors_are_closed_syncmers(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"w{r.randrange(30)}" for _ in range(n))) for i, n in enumerate((0, 1, 5, 6, 7, 12, 25))]
    for x in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        wanted = anchors_by_hand(spark, rows[x.doc_id][1].split())
        if wanted:
            assert [(a.pos, a["hash"]) for a in x.anchors] == wanted
        else:
            assert len(x.anchors) == (rows[x.doc_id][1] != "") and all(a.pos == 0 for a in x.anchors)
        assert x.fingerprint == "".join(f"{a['hash']:08x}" for a in x.anchors)


def test_fingerprints_and_likenesses_by_hand(spark):
    r = random.Random(2)
    long = [f"v{r.randrange(4000)}" for _ in range(3000)]
    edited = long[:1700] + ["new", "words"] + long[1702:]
    said = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(60))) for _ in range(60)]
    said += [" ".join(long), " ".join(edited), "x y z " + " ".join(long), "lone", "lone", "", "a b c d e f", " ".join(["again and again"] * 90)]
    rows = [*enumerate(said), (70, None), (None, "no id"), (None, "none either"), (71, "same id"), (71, "same id again"), (71, "same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("clash")).repartition(3)
    got = syncmers.edited_fingerprints(docs).collect()
    assert len(got) == len(rows)
    order = [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").na.fill("").orderBy(F.col("doc_id").asc_nulls_first(), F.shiftrightunsigned(F.xxhash64("text"), 1), "text").select("text").collect()]
    pairs = list(zip(order, order[1:] + order[:1], strict=True))
    after = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in pairs]
    every = {x.text: [(a.pos, a["hash"]) for a in x.anchors] for x in syncmers.with_anchors(spark.createDataFrame([(t,) for t in {*order, *after}], "text string"), "text", "anchors").collect()}
    print_of = lambda t: "".join(f"{h:08x}" for _, h in every[t])
    wanted = sorted((len(a), hashlib.sha256(e.encode()).hexdigest(), print_of(a), print_of(e), round(likeness_by_hand(every[a], every[e]), 9), round(likeness_by_hand(every[a], every[b]), 9)) for (a, b), e in zip(pairs, after, strict=True))
    assert sorted((x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, round(x.near_edited, 9), round(x.near_next, 9)) for x in got) == wanted
    by = {x.doc_id: x for x in got}
    assert 0.99 < by[60].near_next < 1 and by[61].near_next > 0.98 and by[63].near_next == 1.0
    assert len({print_of(t) for t in said if t and t != "lone"}) == len([t for t in said if t and t != "lone"])


def test_unrelated_short_texts_are_not_alike(spark):
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(6))) for i in range(40)]
    got = syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({x.fingerprint for x in got}) == 40 and all(x.fingerprint and x.near_next == 0.0 for x in got)


def test_ranges_of_ids_meet_at_their_ends(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 7)
    r = random.Random(3)
    ids = [None] * 40 + [5] * 60 + [*range(10, 110)] + [10**12] * 30
    rows = [(i, f"t{k} " + " ".join(r.choice("abcdef") for _ in range(5))) for k, i in enumerate(ids)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "_key long, text string").withColumn("_key", F.coalesce("_key", F.lit(-(2**63)).cast("long")))
    dealt, window = syncmers.beside_next(docs, "_key", "text")
    sizes = dealt.groupBy("_in").count().collect()
    assert len(sizes) > 20 and max(x["count"] for x in sizes) < 40
    got = {x.text: x.next for x in dealt.withColumn("next", F.lead("text").over(window)).where("NOT _ghost").select("text", "next").collect()}
    order = [x.text for x in docs.orderBy("_key", F.shiftrightunsigned(F.xxhash64("text"), 1), "text").collect()]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


# --- op4 -----------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def contract_spans(text: str) -> list[tuple[int, int, str]]:
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    out = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_plain_spans_are_the_contracts():
    r = random.Random(7)
    parts = ["a", "b.c", "x@y", "@", ".", "d@e.f", "%+", "-", "1", "25", "300", "1.2.3.4", "0.0.0.256", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 ", "+", "(", ")", " ", "  ", "9", "0007", "55", "é", "\n", "+49 170 1234567", "00000000000000"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert pii.plain_spans(text) == contract_spans(text), text
        base, every = pii.all_spans(text)
        assert base == contract_spans(text) and set(base) <= set(every)
    for path in ("sf0.001",):
        import pyarrow.parquet as pq

        for text in pq.read_table(f"/root/testdata/{path}/documents.parquet")["text"].to_pylist():
            assert pii.plain_spans(text or "") == contract_spans(text or "")


def test_more_disguises():
    found = lambda t: {(t[s:e], k) for s, e, k in pii.all_spans(t)[1]}
    for text, said, kind in (
        ("at 192 dot 168 dot 0 dot 1 now", "192 dot 168 dot 0 dot 1", "ip"),
        ("192[.]168[.]0[.]1 x", "192[.]168[.]0[.]1", "ip"),
        ("it is one nine two dot one six eight dot zero dot one", "one nine two dot one six eight dot zero dot one", "ip"),
        ("user[@]example[.]com", "user[@]example[.]com", "email"),
        ("john(at)example(dot)com", "john(at)example(dot)com", "email"),
        ("bob dot smith at mail.example dot org!", "bob dot smith at mail.example dot org", "email"),
        ("+four nine one seven zero one two three four five six", "+four nine one seven zero one two three four five six", "phone"),
        ("call +49 one seven zero 555 two two three three", "+49 one seven zero 555 two two three three", "phone"),
    ):
        assert found(text) == {(said, kind)}, text
    for clean in ("user at example.com", "the dot at the end", "x at y dot z", "one, two. three four", "in 2004 dot 5 or 6", "a dot b dot c dot d"):
        assert not found(clean), clean


def test_long_unbroken_texts_take_linear_time():
    n = 1_000_000
    for text in ("a" * n + " dot x", " " * n + "dot at", "a dot " * (n // 6), "@" * n + " dot ", "l(" * (n // 2) + " dot 1", "(at" * (n // 3) + " dot", "one " * (n // 4)):
        began = time.time()
        pii.all_spans(text)
        assert time.time() - began < 10, text[:10]


# --- op7 -----------------------------------------------------------------------------------------


def test_rates_are_the_nearest_to_one_that_meet_the_targets(spark):
    r = np.random.default_rng(5)
    p = r.dirichlet([2, 1, 0.3], 400)
    n = r.integers(0, 300, 400)
    soft = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p, strict=True)], "n_tokens long, p0 double, p1 double, p2 double").coalesce(1).cache()
    targets = {"good": 0.8, "plain": 0.195, "toxic": 0.005}
    weights, miss = mixing.fitted_weights(soft, targets)
    rate = np.maximum(0, 1 + p @ weights)
    goal = np.array([0.8, 0.195, 0.005])
    assert miss < mixing.MISS and np.abs((rate * n) @ p / n.sum() / goal - 1).max() < 1e-4
    # brute force: projections onto the targets' plane and the rates above zero in turn (Dykstra), weighed by tokens
    x, y, a = np.ones(400), np.zeros(400), p * n[:, None]
    for _ in range(20_000):
        z = np.maximum(0, x + y)
        y = x + y - z
        x = z - p @ np.linalg.solve(a.T @ p, a.T @ z - goal * n.sum())
    assert np.abs(np.maximum(0, x) - rate)[n > 0].max() < 1e-3
    assert mixing.fitted_weights(soft.limit(0), targets)[1] == 0.0
    one = soft.withColumn("p0", F.lit(1.0)).withColumn("p1", F.lit(0.0)).withColumn("p2", F.lit(0.0))
    assert mixing.fitted_weights(one, targets)[1] == pytest.approx(1.0)


def test_targets_are_met_on_the_given_tables(spark):
    got = mixing.op7_source_mixing(spark, "/root/testdata/sf0.01")
    sums = got.agg(*[(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) / F.sum("n_tokens")).alias(d) for d in mixing.DOMAINS], F.max("miss").alias("miss"), F.count_if(F.col("rate") < 0).alias("below")).first()
    assert sums.miss < 1e-4 and sums.below == 0
    assert all(sums[d] == pytest.approx(mixing.TARGETS[d], rel=1e-3) for d in mixing.DOMAINS)


# --- op2 -----------------------------------------------------------------------------------------


def test_most_frequent_words_are_cut_inside_ties(spark):
    rows = [(f"w{i}".encode(), c) for i, c in enumerate([1000, 999, 998, 7, 7, 7] + [1] * 500)]
    held = spark.createDataFrame(rows, "word binary, c long")
    for most in (0, 1, 2, 4, 6, 50, 505, 506, 900):
        got = hmm.most_frequent(held, most)
        assert len(got) == min(most, len(rows)) and len(set(got)) == len(got)
        assert sorted((c for c, _ in got), reverse=True) == sorted((c for _, c in rows), reverse=True)[:most]
        assert got == sorted(got, key=lambda x: (-x[0], x[1]))


# --- op6 and the language stage -------------------------------------------------------------------


def test_one_step_of_the_regularised_leader():
    w, p = np.zeros((2, 4)), np.array([0.5, 0.5])
    got = langid.ftrl([(np.array([0, 2]), np.array([0.6, 0.8]), 1)], w)
    for k in (0, 1):
        for b, x in ((0, 0.6), (2, 0.8)):
            g = (p[k] - (k == 1)) * x
            wanted = 0.0 if abs(g) <= langid.L1 else (np.sign(g) * langid.L1 - g) / ((langid.BETA + abs(g)) / langid.ALPHA + langid.L2)
            assert got[k, b] == pytest.approx(wanted)
    assert not got[:, [1, 3]].any()


def test_accuracy_on_the_given_tables_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op6_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) >= 0.99
    right, said = np.mean([x.lang == x.lang_pred for x in got]), np.mean([x.score for x in got])
    assert abs(right - said) < 0.05


def test_rare_languages_are_learnt(spark):
    r = random.Random(4)
    rows = [(f"{'zyx' if i % 2 else 'kuu'}{i} " * 30, f"l{i:03d}") for i in range(30) for _ in range(3)]
    rows = [(t + str(r.random()), x) for t, x in rows]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 30


def test_the_language_stage_rejects_what_is_in_no_language(spark):
    r = random.Random(9)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mine = docs.select("doc_id", "text", "lang").collect()
    first = {}
    for x in mine:
        if x.text and len(x.text) > 600:
            first.setdefault(x.lang, []).append(x.text)
    letters, base64 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    junk = [" ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 10))) for _ in range(120)) for _ in range(20)]
    junk += ["".join(r.choice(base64) for _ in range(900)) for _ in range(20)] + ["12 34 !!", "...", "", None]
    both = [a[:300] + "\n" + b[:300] for a, b in zip(first["en"][:20], first["fr"][:20], strict=False)] + [a[:300] + " " + b[:300] for a, b in zip(first["de"][:20], first["es"][:20], strict=False)]
    extra = [(10**6 + i, t, None, "junk", 0) for i, t in enumerate(junk)] + [(2 * 10**6 + i, t, None, "both", 0) for i, t in enumerate(both)] + [(None, first["en"][0], "en", "none", 0)]
    more = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("clash"))
    kept = langid.language_stage(spark, more, "")
    assert kept.columns == more.columns
    ids = {x.doc_id for x in kept.select("doc_id").collect()}
    assert not [i for i in ids if i is not None and 10**6 <= i < 2 * 10**6]
    assert None in ids and {2 * 10**6 + i for i in range(len(both))} <= ids
    assert {x.doc_id for x in mine if x.text and any(map(str.isalpha, x.text))} <= ids
    assert langid.language_stage(spark, more.limit(0), "").count() == 0
    unlabelled = more.withColumn("lang", F.lit(None).cast("string"))
    assert langid.language_stage(spark, unlabelled, "").count() >= len(mine)


@pytest.mark.parametrize("taught", [1, 2, 10, 70])
def test_a_rare_language_excuses_no_junk(spark, taught):
    r = random.Random(21)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = [" ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 10))) for _ in range(120)) for _ in range(50)]
    stems = ["ühe", "kõik", "päev", "sõna", "töö", "maja", "linn", "jõgi", "mets", "kevad", "suvi", "sügis", "talv", "laps", "ema", "isa", "õde", "vend", "kirik", "kool", "raamat", "laud", "tool", "aken"]
    ends = ["", "s", "st", "le", "lt", "ks", "ni", "ga", "ta", "de", "del", "dest", "sse"]
    estonian = [" ".join(r.choice(stems) + r.choice(ends) for _ in range(150)) for _ in range(taught + 8)]
    extra = [(10**6 + i, t, None, "junk", 0) for i, t in enumerate(junk)] + [(2 * 10**6 + i, t, "et" if i < taught else None, "rare", 0) for i, t in enumerate(estonian)]
    ids = {x.doc_id for x in langid.language_stage(spark, docs.unionByName(spark.createDataFrame(extra, docs.schema)), "").select("doc_id").collect()}
    assert not [i for i in ids if 10**6 <= i < 2 * 10**6]
    assert {x.doc_id for x in docs.collect() if x.text and any(map(str.isalpha, x.text))} <= ids
    assert taught < 10 or {2 * 10**6 + i for i in range(len(estonian))} <= ids


# --- op9 -----------------------------------------------------------------------------------------


def test_recall_of_substituted_passages_over_all_shifts(spark):
    r = random.Random(12)
    items = [[f"v{r.randrange(3000)}" for _ in range(r.choice([3, 5, 8, 12, 20, 40, 60]))] for _ in range(60)]
    docs, planted = [], []
    for i in range(400):
        item = r.randrange(60)
        own, share = list(items[item]), r.choice([0.0, 0.05, 0.1, 0.15])
        own = [x if r.random() >= share else f"z{r.randrange(10**6)}" for x in own]
        lead = [f"f{r.randrange(3000)}" for _ in range(r.randrange(40))]
        docs.append((i, " ".join([*lead, *own, "tail", "words"])))
        agree = sum(a == b for a, b in zip(own, items[item], strict=True))
        if agree >= min(10, len(own)) and agree >= 0.8 * len(own) and (len(own) >= 6 or agree == len(own)):
            planted.append((i, item))
    got = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    stage = {x.doc_id for x in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()}
    found = sum(p in got for p in planted) / len(planted)
    assert len(planted) > 250 and found >= 0.97, found
    assert sum(i in stage for i, _ in planted) / len(planted) >= 0.97
    assert not [p for p in got if p[0] >= 400] and len(got) < 1.1 * len(docs)


def test_short_items_and_a_long_text(spark):
    items = [(1, "a b c"), (2, "solo"), (3, "k1 k2 k3 k4 k5 k6 k7"), (4, None), (5, "")]
    long = " ".join(f"w{i}" for i in range(150_000)) + " a b c k1 k2 k3 k4 k5 k6 k7"
    docs = [(1, "x a b c y"), (2, "a b x c"), (3, "the Solo part"), (4, long), (None, "a b c"), (5, None), (6, "k1 k2 k3 zz k5 k6 k7")]
    began = time.time()
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("key", F.lit(1))
    got = {(x.doc_id, x.item_id, x.matched, x.start) for x in decontaminate.overlaps(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, 3, 1), (3, 2, 1, 1), (4, 1, 3, 150_000), (4, 3, 7, 150_003), (None, 1, 3, 0)}
    assert time.time() - began < 60


# --- op1 -----------------------------------------------------------------------------------------


def test_the_forest_removes_what_the_rules_take_for_secrets(spark):
    r = random.Random(21)
    words = "river stone garden window letter summer paper silver bridge forest".split()
    key = lambda: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    rows, truth = [], {}
    for i in range(600):
        kind = i % 3
        value = key() if kind == 0 else "-".join(r.choice(words) for _ in range(4)) + str(r.randrange(10)) if kind == 1 else key()
        path = "src/test/fixtures" if kind == 2 else "src/main"
        rows.append((i, f"{' '.join(r.choice(words) for _ in range(30))} token = {value} {r.choice(words)}", path))
        truth[i] = float(kind == 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = spark.createDataFrame([(i, y) for i, y in truth.items() if i % 2], "doc_id long, label double")
    got = secrets.findings(docs, F.col("source"), lambda found: found.where("before = '='").join(told, "doc_id").select("cid", "label")).where("before = '=' AND doc_id % 2 = 0").collect()
    rules = secrets.labelled_by_format(secrets.candidates(docs, F.col("source")))
    assert rules.where("label = 1").count() > 500
    right = np.mean([x.is_secret == bool(truth[x.doc_id]) for x in got])
    assert len(got) == 300 and right >= 0.97, right


# --- rows without an id --------------------------------------------------------------------------


def test_stages_work_on_rows_without_an_id(spark):
    r = random.Random(31)
    body = [" ".join(f"{r.choice(['the', 'of', 'water', 'house'])}{r.randrange(50)}" for _ in range(80)) for _ in range(12)]
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    secret = "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, body[i]) for i in range(6)] + [(None, body[i]) for i in (0, 7, 7, 8)] + [(None, body[9] + " " + bench), (None, f"{body[10]} token = {secret} end")]
    rows += [(100 + i, f"{body[11]} {i} token = {''.join(r.choice('0123456789abcdef') for _ in range(40))} x") for i in range(20)] + [(200 + i, f"mail a{i}@h.example.com or {10**15 + i} now") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row", F.lit("clash"))
    sf = "/root/testdata/sf0.001"
    kept = [x.text for x in simhash.simhash_stage(spark, docs, sf).where("doc_id IS NULL").collect()]
    assert body[0] not in kept and kept.count(body[7]) == 1 and kept.count(body[8]) == 1
    clean = decontaminate.decontamination_stage(spark, docs, sf).collect()
    assert not [x for x in clean if bench in x.text] and len(clean) == docs.count() - 1
    said = [x.text for x in secrets.secret_stage(spark, docs, sf).where("doc_id IS NULL").collect()]
    assert not [t for t in said if secret in t] and sum("[secret]" in t for t in said) == 1 and len(said) == 6
    rated = mixing.mixing_stage(spark, docs, sf)
    assert rated.columns == [*docs.columns, "rate"] and rated.where("doc_id IS NULL AND rate > 0").count() > 0


# --- op2: the whole score -------------------------------------------------------------------------


def test_scores_are_probabilities_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 6)
    r = random.Random(41)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("ing", "ed", "s", "")]
    rows = [(i, " ".join(r.choice(vocabulary[: 8 + i % 20]) for _ in range(r.randrange(12))), i % 4 != 0) for i in range(80)] + [(90, None, False), (91, "never seen Words", False), (None, "aing", True), (92, "ties ties", True), (92, "ties ties", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").withColumn("symbols", F.lit("clash"))
    got = {(x.doc_id, x.n_tokens): x for x in hmm.score(docs, "learn").collect()}
    counts = Counter(w for _, t, learn in rows if learn for w in hmm.words_of(t))
    lex = hmm.lexicon(hmm.count_words(docs.where("learn")))
    head = sorted(counts, key=lambda w: (-counts[w], w))[:6]
    assert lex.words[:6] == head
    mass = Counter()
    for w, c in counts.items():
        if w not in head:
            mass[hmm.word_class(w)] += c + 0.5
    coded = hmm.encode(docs.where("learn"), lex, {"doc_id": "long"})
    model = hmm.train(coded, lex.symbols)
    assert model.emits.sum(axis=0) == pytest.approx(1) and model.moves.sum(axis=1) == pytest.approx(1)
    for i, t, _ in rows:
        alpha, total, words = None, 0.0, hmm.words_of(t)
        for w in [*words, None]:
            symbol = lex.head if w is None else head.index(w) if w in head else lex.head + 1 + hmm.word_class(w)
            alpha = (model.start if alpha is None else alpha @ model.moves) * model.emits[symbol]
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if w is not None and w not in head:
                total += math.log10((counts[w] + 0.5) / (mass[hmm.word_class(w)] + 0.5))
        assert got[i, len(words) + 1].score == pytest.approx(total, abs=1e-6), (i, t)


# --- op3: the trees -------------------------------------------------------------------------------


def trees_by_hand(shapes: dict, depth: int, fan: int, apart: float) -> dict:
    """The nodes of each ``(host, parts)`` of ``shapes``, whose values are ``(n, labelled, blocked)``."""
    nodes = {k: [""] for k in shapes}
    kind = lambda parts, i: "$" if i >= len(parts) else parts[i] if parts[i].startswith("{") else "word"
    for level in range(depth):
        part = {}
        for k in shapes:
            host, parts = k
            part[k] = parts[level] if level < len(parts) else None
        words = {}
        for k, p in part.items():
            if p is not None and not p.startswith("{"):
                words.setdefault((k[0], nodes[k][-1]), set()).add(p)
        for k, p in part.items():
            if p is not None and not p.startswith("{") and len(words[k[0], nodes[k][-1]]) > fan:
                part[k] = "{word}"
        follow = {}
        for k, (n, _, _) in shapes.items():
            if part[k] is not None:
                own = follow.setdefault((k[0], nodes[k][-1]), {}).setdefault(part[k], Counter())
                own[kind(k[1], level + 1)] += n
        alike = set()
        for node, branches in follow.items():
            pool = sum(branches.values(), Counter())
            near = [p for p, c in branches.items() if sum(min(v / sum(c.values()), pool[x] / sum(pool.values())) for x, v in c.items()) >= 1 - apart - 1 / math.sqrt(sum(c.values()))]
            if len(near) > 1:
                alike |= {(*node, p) for p in near}
        for k in shapes:
            p = part[k]
            name = nodes[k][-1] if p is None else nodes[k][-1] + "/" + ("{any}" if (k[0], nodes[k][-1], p) in alike else p)
            nodes[k].append(name)
    return {k: (v, v[-1] + "/**" if len(k[1]) > depth else v[-1]) for k, v in nodes.items()}


def test_trees_and_purities_by_hand(spark):
    r = random.Random(51)
    hosts = ["a.com", "b.example.com", "c.net", "d.org", ""]
    segment = lambda: r.choice(["en", "de", "es", "7", "81", "2024-01-02", "blog", "tag", f"w{r.randrange(14)}", f"{r.randrange(10**9):09d}.html", "deadbeef01"])
    said = [f"http://{r.choice(hosts[:4])}/" + "/".join(segment() for _ in range(r.randrange(7))) for _ in range(500)] + ["no scheme", None, "http://a.com/" + "x" * 20_000, "http://a.com/en/7", "http://a.com/en/7"]
    rows = [(i if i % 50 else None, u) for i, u in enumerate(said)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("said", F.lit(3))
    got = urls.judged(pages).collect()
    assert len(got) == len(rows)
    fixed = lambda s: re.sub(r"^[0-9]+(?=$|\\.[A-Za-z0-9]+$)", "{n}", re.sub(r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F]{8,}(-[0-9a-fA-F]{4,})*$", "{hex}", re.sub(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}", s)))
    shapes = {}
    for x in got:
        rules = [(len(h + p), h, v) for v, h, p in urls.RULES if (x.host == h or x.host.endswith("." + h)) and x.path.startswith(p)]
        rule = max(rules, default=None)
        assert (x.rule is None) == (rule is None) and (rule is None or x.verdict == rule[2])
        k = (x.host, tuple(fixed(s) for s in x.path.split("/") if s))
        n, labelled, blocked = shapes.get(k, (0, 0, 0))
        shapes[k] = (n + 1, labelled + (rule is not None), blocked + (rule is not None and rule[2] == "block"))
    trees = trees_by_hand(shapes, urls.DEPTH, urls.FAN, urls.APART)
    smooth = lambda t, l, b, parent: (b + urls.PARENT * parent) / (l + urls.UNLABELLED * (t - l) + urls.PARENT)
    root = smooth(*(sum(v[i] for v in shapes.values()) for i in range(3)), 0.5)
    purity = dict.fromkeys(shapes, root)
    for level in range(urls.DEPTH + 2):
        sums, parent = {}, {}
        for k, v in shapes.items():
            node = (k[0], trees[k][0][level] if level <= urls.DEPTH else trees[k][1])
            sums[node] = tuple(a + b for a, b in zip(sums.get(node, (0, 0, 0)), v, strict=True))
            parent.setdefault(node, purity[k])
        purity = {k: smooth(*sums[n], parent[n]) for k in shapes for n in [(k[0], trees[k][0][level] if level <= urls.DEPTH else trees[k][1])]}
    for x in got:
        k = (x.host, tuple(fixed(s) for s in x.path.split("/") if s))
        assert x.template == trees[k][1] and x.purity == pytest.approx(purity[k])
        assert x.rule is not None or x.verdict == ("block" if purity[k] >= urls.REJECT else "allow")
