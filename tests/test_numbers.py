"""Readings of numbers, units, and claims against evidence, by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestar.operators import numbers


def test_readings_of_written_numbers(spark):
    wanted = {
        "1234": {"1234"}, "1,234": {"1234", "1.234"}, "1.234": {"1234", "1.234"}, "12,5": {"12.5"}, "12.50": {"12.5"}, "0,125": {"0.125"}, "0.125": {"0.125"}, "1.234,5": {"1234.5"}, "1,234.5": {"1234.5"},
        "1,234,567": {"1234567"}, "1.234.567,8": {"1234567.8"}, "1,2,3": {"1,2,3"}, "-0,0": {"0"}, "+7": {"7"}, "-3,250": {"-3250", "-3.25"}, "007": {"7"}, "1234,567": {"1234.567"}, "100": {"100"}, "1.0": {"1"},
    }
    got = {r.x: set(r.y) for r in spark.createDataFrame([(x,) for x in wanted], "x string").select("x", numbers.number_readings(F.col("x")).alias("y")).collect()}
    assert got == wanted


def test_quantities_in_order(spark):
    said = "At ≥ 5 mg/L and 3–4 % (±), 12,5 ± 0,3 g L-1 for 2 days, 20 to 25 °C; grams 7 grams; x5 y"
    [row] = spark.createDataFrame([(said,)], "x string").select(numbers.quantities(F.col("x")).alias("q")).collect()
    got = [(q.operator, q.value, q.mark, q.other, q.unit) for q in row.q]
    assert got[:5] == [(">=", ["5"], "", [], "mg/l"), ("", ["3"], "-", ["4"], "%"), ("", ["12.5"], "±", ["0.3"], "g/l"), ("", ["2"], "", [], "day"), ("", ["20"], "-", ["25"], "°c")]
    assert got[5] == ("", ["7"], "", [], "")
    assert spark.createDataFrame([(None,), ("",)], "x string").select(F.size(numbers.quantities(F.col("x"))).alias("n")).distinct().collect()[0].n == 0


@pytest.mark.parametrize("convert", [False, True])
def test_issues_of_single_claims(spark, convert):
    cases = [
        ("dose of 1,500 mg", "a dose of 1500 mg", "none"), ("dose of 1.500 mg", "a dose of 1,5 mg", "none"), ("5 g/L", "5000 mg/L", "none" if convert else "unsupported_conversion"), ("2 h", "120 minutes", "none" if convert else "unsupported_conversion"),
        ("≥ 5 %", "5 %", "operator_or_range"), ("3-4 %", "3 %", "operator_or_range"), ("-5 °C", "5 °C", "sign_mismatch"), ("5 mg", "5 °C", "unit_mismatch"), ("6 mg", "5 mg", "value_missing"), ("6 mg", "no number", "value_missing"), ("5 percent", "5 %", "none"),
        ("5 g", "5 mg", "unsupported_conversion"), ("12 months", "1 year", "value_missing"),
    ]
    claims = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(cases)], "claim_id long, text string")
    evidence = spark.createDataFrame([(i, 1, e) for i, (_, e, _) in enumerate(cases)], "claim_id long, evidence_id long, text string")
    got = {r.claim_id: (r.issue, r.sources) for r in numbers.assessed(claims, evidence, convert).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: c[2] for i, c in enumerate(cases)}
    assert all(s == ([1] if x == "none" else []) for x, s in got.values())


def test_verdicts_of_claims(spark):
    claims = spark.createDataFrame([(1, "5 mg and 7 %"), (2, "5 mg and 7 %"), (3, "5 mg and 8 %"), (4, "nothing"), (5, None), (6, "5 mg")], "claim_id long, text string")
    evidence = spark.createDataFrame([(1, 1, "7 % of 5 mg"), (2, 1, "5 mg"), (2, 2, "7 %"), (3, 1, "5 mg"), (6, 1, None)], "claim_id long, evidence_id long, text string")
    got = {r.claim_id: (r.quantities, r.verdict) for r in numbers.verdicts(claims, evidence).collect()}
    assert got == {1: (2, "supported"), 2: (2, "ambiguous"), 3: (2, "unsupported"), 4: (0, "not_numeric"), 5: (0, "not_numeric"), 6: (1, "unsupported")}


def test_quantities_are_read_once_and_nothing_large_is_broadcast(spark):
    claims = spark.createDataFrame([(1, "5 mg and 7 %")], "claim_id long, text string")
    evidence = spark.createDataFrame([(1, 1, "7 % of 5 mg")], "claim_id long, evidence_id long, text string")
    plan = numbers.assessed(claims, evidence, True)._jdf.queryExecution().optimizedPlan().toString()
    assert "[+-]?[0-9]+" not in plan  # texts are taken apart before, into stored rows
    joins = [x for x in plan.splitlines() if "Join" in x and "claim_id" in x]
    assert len(joins) == 2 and all("strategy=merge" in x for x in joins)


def test_only_numbers_are_shuffled_once_on_each_side(spark):
    claims = spark.createDataFrame([(1, "5 mg and 7 %"), (1, "5 mg or 7 percent")], "claim_id long, text string")
    evidence = spark.createDataFrame([(1, "a", "7 % of 5 mg"), (1, "b", "7,0 percent")], "claim_id long, evidence_id string, text string")
    plan = numbers.assessed(claims, evidence).groupBy("issue").count()._jdf.queryExecution().optimizedPlan().toString()
    # claims' quantities, what was found, and the count; evidence is not made distinct before it meets, nor its ids read for nothing
    assert plan.count("Aggregate [") == 3 and "evidence_id" not in plan.replace("[claim_id#", "").split("Relation")[0]
    [facts] = spark.range(1).select(numbers.facts({numbers.WHOLE: F.array(F.lit("5 mg"))}).alias("x")).collect()
    assert isinstance(facts.x[0].key, int)
    got = {(r.claim_id, r.issue, tuple(r.sources)) for r in numbers.assessed(claims, evidence).collect()}
    assert got == {(1, "none", ("a",)), (1, "none", ("a", "b"))}
    assert [(r.quantities, r.verdict) for r in numbers.verdicts(claims, evidence).collect()] == [(2, "supported")]
