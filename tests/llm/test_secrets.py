"""Secret scans: values of any signs, and every feature against a plain loop."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import secrets


def test_assigned_values_of_any_signs_are_candidates(spark):
    said = {
        "password=pa$$w0rd!23x": "pa$$w0rd!23x", "token = Xy7!kQ#9z&Lm2*": "Xy7!kQ#9z&Lm2*", 'db_password: "p&ss!word#1",': "p&ss!word#1", "{'secret':'a*b$c!d#e'}": "a*b$c!d#e",
        "API_KEY='k(e)y!1234'; x": "k(e)y!1234", "pwd := ~q~w~e~r~t~y1": "~q~w~e~r~t~y1", "auth_token=é$ßülöx!1": "é$ßülöx!1",
    }
    rows = [(i, t, "src") for i, t in enumerate(said)] + [(50, "we paid $100,000,000 (net) for it! why? 50%-60% #hashtag_long", "src"), (51, "token = plainvalue123", "src"), (52, "password=a$b", "src")]
    found = secrets.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source")).collect()
    got = {i: [x.value for x in found if x.doc_id == i] for i, *_ in rows}
    assert all(v in got[i] for i, v in enumerate(said.values())), got
    assert not [v for v in got[50] if re.search(r"[$!?#(]", v)] and got[51] == ["plainvalue123"] and not got[52]


def kind(c: str) -> str:
    return "upper" if "A" <= c <= "Z" else "lower" if "a" <= c <= "z" else "digit" if "0" <= c <= "9" else "other"


def test_every_feature_is_that_of_a_plain_loop(spark):
    r = random.Random(12)
    plain = ["river", "winter", "letter", "password", "token", "house"]
    rows = []
    for i in range(80):
        value = "".join(r.choice("abXY019_-./%@" if i % 2 else "riverhouseAB12.") for _ in range(r.randrange(8, 30)))
        rows.append((i, " ".join([r.choice(plain), r.choice(["token", "house", "api_key:"]), r.choice(["=", "is", "secret="]), value, r.choice([*plain, "Zq9"]), "winter river"]), r.choice(["lib/tests/a.py", "src/main.py", None, "docs"])))
    rows += [(1000 + i, "river winter house letter", None) for i in range(secrets.WORD_COUNT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = {}
    for _, text, _ in rows:
        for w in text.lower().split():
            if re.fullmatch("[a-z]{3,}", w):
                counts[w] = counts.get(w, 0) + 1
    known = {w for w, n in counts.items() if n >= secrets.WORD_COUNT}
    found = secrets.candidates(docs, F.col("source")).cache()
    full, names = secrets.with_features(found, secrets.dictionary(docs))
    seen = full.collect()
    assert len(seen) == found.count() > 60
    for x in seen:
        v, n = x.value, len(x.value)
        wanted = {"length": n, "spread": len(set(v)) / n, "dots": v.count(".")}
        for a in secrets.CLASSES:
            for b in secrets.CLASSES:
                wanted[f"t_{a}_{b}"] = sum(kind(p) == a and kind(q) == b for p, q in zip(v, v[1:])) / max(1, n - 1)
        wanted["coverage"] = sum(len(w) for w in re.findall("[a-z]{3,}", v.lower()) if w in known) / n
        letters = lambda w: re.sub("[^a-z]", "", w.lower())
        wanted["before_known"], wanted["after_known"] = letters(x.before) in known, letters(x.after) in known
        is_key = lambda w: re.search(secrets.KEYS.removeprefix("(?i)"), w, re.I) is not None
        wanted["keyed"] = is_key(x.key) or is_key(x.before) or is_key(x.before2)
        wanted["assigned"] = x.key != "" or x.before[-1:] in ("=", ":")
        wanted["trial_path"] = x.path is not None and re.search(secrets.TRIAL_PATH.removeprefix("(?i)"), x.path, re.I) is not None
        assert set(names) == set(wanted)
        for name, value in wanted.items():
            assert x[name] == pytest.approx(float(value)), (name, v)
