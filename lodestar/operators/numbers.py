"""Quantities of a text as columns: numbers with all their readings, units with their factors, claims against evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.registry import query
from lodestar.sources.tables import stored, table

# Each unit's dimension and factor to the dimension's base, and its spellings (folded, without blanks).
UNITS = {
    "%": ("ratio", "1", ["percent", "percents", "percentage", "percentages", "pourcent"]),
    "percentage_point": ("ratio", "1", ["percentagepoint", "percentagepoints", "pointdepourcentage", "pointsdepourcentage"]),
    "ng/l": ("mass per volume", "0.000000001", ["ngl-1", "ngl^-1"]),
    "ug/l": ("mass per volume", "0.000001", ["µg/l", "ugl-1", "µgl-1", "µgl^-1"]),
    "mg/l": ("mass per volume", "0.001", ["mgl-1", "mgl^-1"]),
    "g/l": ("mass per volume", "1", ["gl-1", "gl^-1"]),
    "kg/l": ("mass per volume", "1000", []),
    "ug": ("mass", "0.000001", ["µg"]),
    "mg": ("mass", "0.001", []),
    "g": ("mass", "1", []),
    "kg": ("mass", "1000", []),
    "ml": ("volume", "0.001", []),
    "l": ("volume", "1", []),
    "hl": ("volume", "100", []),
    "°c": ("temperature", "1", ["degreescelsius", "degrecelsius", "degréscelsius", "celsius"]),
    "second": ("time", "1", ["s", "seconds", "seconde", "secondes"]),
    "minute": ("time", "60", ["min", "minutes"]),
    "hour": ("time", "3600", ["h", "hours", "heure", "heures"]),
    "day": ("time", "86400", ["d", "days", "jour", "jours"]),
    "week": ("time", "604800", ["weeks", "semaine", "semaines"]),
    # months and years have no fixed number of days: a dimension each
    "month": ("month", "1", ["months", "mois"]),
    "year": ("year", "1", ["years", "an", "ans"]),
}
SPELLED = {name: unit for unit, (_, _, others) in UNITS.items() for name in (unit, *others)}
#: Signs that mean another: minus signs and dashes, the micro sign, blanks that do not break.
SIGNS = ("−–—μ  ", "---µ  ")
NUMBER = r"[+-]?[0-9]+(?:[.,][0-9]+)*"
UNIT = "|".join(sorted({*(u.replace("^", r"\^") for u in SPELLED), "mg L-1", "g L-1", "percentage points?", "degrees Celsius"}, key=lambda u: (-len(u), u)))
#: The sign ahead that a quantity can begin with is looked for first, so that the other places of a text cost little.
QUANTITY = rf"(?i)(?=[<>≤≥≈~\s+0-9-])(<=|>=|≤|≥|<|>|≈|~)?\s*({NUMBER})(?:\s*(±|\+/-|-|to|à)\s*({NUMBER}))?(?:\s*({UNIT}))?(?![\w])"
#: Stands between the groups of a found quantity; none of them can hold it.
CUT = "\x01"
# Spellings of one comparison and of one mark between two numbers.
OPERATORS, MARKS = {"≤": "<=", "≥": ">=", "≈": "~"}, {"+/-": "±", "to": "-", "à": "-"}


def lookup(values: dict[str, str], x: Column) -> Column:
    """``x`` by ``values``, itself where they have nothing."""
    return let(x, lambda v: F.coalesce(F.create_map(*(F.lit(y) for p in values.items() for y in p))[v], v))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``x`` worked out once and written once, however often ``body`` names it; so expressions of expressions stay small."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def plain(x: Column) -> Column:
    """A plain decimal without leading zeros and trailing decimal zeros; a minus only where the number is not zero."""
    bare = let(F.regexp_replace(x, "^[+-]?(?:0+(?=[0-9]))?", ""), lambda v: F.when(F.contains(v, F.lit(".")), F.regexp_replace(v, r"\.?0*$", "")).otherwise(v))
    return let(bare, lambda v: F.when(x.startswith("-") & (v != "0"), F.concat(F.lit("-"), v)).otherwise(v))


def number_readings(x: Column) -> Column:
    """All decimals that a written number can mean, in plain form: ``1,234`` is 1234 and 1.234.

    With both separators the last is the decimal one. One separator that occurs more than once, before groups of three, groups
    thousands; once, before three digits and behind one to three without a leading zero, it can be either; else it is a decimal one. What
    is written otherwise (``1,2,3``) has itself as its only reading.
    """
    return let(F.regexp_replace(x, "[^0-9.,+-]", ""), readings_of)


def readings_of(bare: Column) -> Column:
    joined, point = F.regexp_replace(bare, "[.,]", ""), F.translate(bare, ",", ".")
    last_point = F.length(bare) - F.locate(".", F.reverse(bare)) > F.length(bare) - F.locate(",", F.reverse(bare))
    mixed = F.when(last_point, F.replace(bare, F.lit(","), F.lit(""))).otherwise(F.translate(F.replace(bare, F.lit("."), F.lit("")), ",", "."))
    dots, commas = (F.length(bare) - F.length(F.replace(bare, F.lit(sign), F.lit(""))) for sign in ".,")
    found = (
        F.when((dots == 0) & (commas == 0), F.array(bare))
        .when((dots > 0) & (commas > 0), F.when(F.least(dots, commas) == 1, F.array(mixed)).otherwise(F.array(bare)))
        .when(dots + commas > 1, F.when(bare.rlike(r"^[+-]?[0-9]{1,3}(?:[.,][0-9]{3})+$"), F.array(joined)).otherwise(F.array(bare)))
        .when(bare.rlike(r"^[+-]?[1-9][0-9]{0,2}[.,][0-9]{3}$"), F.array(joined, point))
        .otherwise(F.array(point))
    )
    return F.array_distinct(F.transform(found, plain))


def canonical_unit(x: Column) -> Column:
    """The table's name of a unit; an empty string where there is none."""
    return lookup(SPELLED, F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", ""))


def of_unit(which: int) -> dict[str, str]:
    return {unit: parts[which] for unit, parts in UNITS.items()}


def quantities(text: Column) -> Column:
    """Every quantity of a text in order, as ``operator, value, mark, other, unit``; ``value`` and ``other`` are arrays of readings, ``other`` is empty without a second number."""
    return F.transform(mentions(text), quantity_of)


def mentions(text: Column) -> Column:
    """Every quantity of a text in order, as it is written; a text without a digit has none and is not searched."""
    found = F.regexp_extract_all(F.translate(text, *SIGNS), F.lit(QUANTITY), F.lit(0))
    return F.when(text.rlike("[0-9]"), found).otherwise(F.array().cast("array<string>"))


def quantity_of(m: Column) -> Column:
    """What one of :func:`mentions` says. It is cut into its five groups once: what the pattern found, it finds again as a whole."""

    def named(part: Column) -> Column:
        at = lambda i: F.get(part, F.lit(i - 1))
        other = F.when(at(4) != "", number_readings(at(4))).otherwise(F.array().cast("array<string>"))
        return F.struct(lookup(OPERATORS, at(1)).alias("operator"), number_readings(at(2)).alias("value"), lookup(MARKS, F.lower(at(3))).alias("mark"), other.alias("other"), canonical_unit(at(5)).alias("unit"))

    return let(F.split(F.regexp_replace(m, QUANTITY, CUT.join(f"${i}" for i in range(1, 6))), CUT), named)


def keys_of(q: Column, convert: bool) -> Column:
    """What a quantity can mean, one string a combination of readings; two quantities agree if they share one. Converted ones are in their dimension's base."""

    def scaled(v: Column) -> Column:
        factor = F.create_map(*(F.lit(x) for p in of_unit(1).items() for x in p))[q["unit"]]
        exact = F.try_multiply(v.try_cast("decimal(24,9)"), F.coalesce(factor, F.lit("1")).cast("decimal(14,9)"))
        return F.coalesce(let(exact.cast("decimal(38,18)").cast("string"), plain), v) if convert else v

    unit = lookup(of_unit(0), q["unit"]) if convert else q["unit"]
    other = F.when(F.size(q["other"]) == 0, F.array(F.lit(""))).otherwise(F.transform(q["other"], scaled))
    ends = F.transform(other, lambda o: F.concat_ws("|", q["mark"], o, unit))
    return F.flatten(F.transform(F.transform(q["value"], scaled), lambda v: F.transform(ends, lambda e: F.concat_ws("|", q["operator"], v, e))))


#: Ways of writing that may be broadcast (about 1 KB each), else they are joined. Joins of what claims and evidence say are merged: their files and
#: shuffles are packed many times, so Spark would take them for small and send them to the driver.
BROADCAST_MENTIONS = 20_000


def merged(df: DataFrame) -> DataFrame:
    return df.hint("merge")


#: Which of a quantity's keys a fact is: its whole meaning, one of its numbers, that number with the other sign, its meaning in the base of its dimension.
WHOLE, VALUE, TURNED, BASE = "w", "v", "t", "b"


def facts(kinds: dict[str, Column]) -> Column:
    """``kind, key`` of all keys of each kind, an array of structs. A key is a hash, of the kind that it meets as well: it is compared within one claim only, and far more of them are shuffled than are written."""
    of = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(VALUE if kind == TURNED else kind), k).alias("key")))
    return F.concat(*(of(kind, keys) for kind, keys in kinds.items()))


#: What a claim's quantity lacks in the evidence, the first that holds.
ISSUES = ["none", "operator_or_range", "unsupported_conversion", "unit_mismatch", "sign_mismatch", "value_missing"]


def assessed(claims: DataFrame, evidence: DataFrame, convert: bool = False, why: bool = True) -> DataFrame:
    """``claim_id, at, quantity, issue, sources`` of each distinct quantity of ``claims(claim_id, text)`` against ``evidence(claim_id, evidence_id, text)``.

    ``sources`` are the pieces of evidence that state the quantity: operator, numbers, mark and unit agree in one reading. Units are not
    converted unless ``convert`` says so; without it, the same dimension in another unit is ``unsupported_conversion``. Quantities meet by
    what they mean, in joins on it, never all with all. Unless ``why`` is asked, what is stated by no evidence is ``value_missing``, and only whole meanings are sought.

    Texts are kept with what they mention, a row each, and only keys are shuffled: once on either side, in numbers of fixed size.
    """
    turned = lambda v: F.when(v.startswith("-"), F.substring(v, 2, 1 << 20)).otherwise(F.concat(F.lit("-"), v))
    meant = lambda q, convert: F.array_distinct(keys_of(q, convert))
    q, kind_of = F.col("q"), lambda c: lookup(of_unit(0), F.col(c))
    told = stored(claims.select("claim_id", F.array_distinct(mentions(F.col("text"))).alias("ms")).where("size(ms) > 0"), "told")
    have = stored(evidence.select("claim_id", "evidence_id", F.array_distinct(mentions(F.col("text"))).alias("ms")).where("size(ms) > 0"), "have")
    # a way of writing is read once, however often it occurs
    read = told.select(F.explode("ms").alias("m")).unionByName(have.select(F.explode("ms").alias("m"))).distinct().withColumn("q", quantity_of(F.col("m")))
    kinds = {WHOLE: meant(q, convert)}
    if why:
        kinds |= {VALUE: q["value"]} | ({} if convert else {BASE: meant(q, True)})  # converted meanings are whole ones already
    asked = kinds | ({TURNED: F.transform(q["value"], turned)} if why else {})
    read = read.select("m", F.to_json("q").alias("quantity"), q["unit"].alias("unit"), facts(kinds).alias("have"), facts(asked).alias("told")).withColumn("at", F.xxhash64("quantity"))
    read = stored(read, "read")
    small = F.broadcast if read.count() <= BROADCAST_MENTIONS else merged
    told = told.select("claim_id", F.explode("ms").alias("m")).join(small(read.select("m", "at", "quantity", "unit", F.col("told").alias("f"))), "m")
    own = told.select("claim_id", "at", "unit", F.explode("f").alias("f")).select("claim_id", "at", "unit", "f.kind", "f.key")
    have = have.select("claim_id", "evidence_id", F.explode("ms").alias("m")).join(small(read.select("m", "unit", F.col("have").alias("f"))), "m").select("claim_id", "evidence_id", "unit", F.explode("f").alias("f"))
    only = lambda kind, c: F.when(F.col("f.kind") == kind, F.col(c))
    its = have.select("claim_id", "f.key", only(WHOLE, "evidence_id").alias("evidence_id"), only(VALUE, "unit").alias("u"))
    met = own.join(merged(its), ["claim_id", "key"])
    if_ = lambda kind, x: F.max(F.when(F.col("kind") == kind, x))
    found = met.groupBy("claim_id", "at").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == WHOLE, F.col("evidence_id")))).alias("sources"), if_(VALUE, F.col("unit") == F.col("u")).alias("same_unit"), if_(VALUE, kind_of("unit") == kind_of("u")).alias("same_kind"),
        if_(TURNED, F.lit(True)).alias("turned"), if_(BASE, F.lit(True)).alias("converts"), if_(WHOLE, F.lit(True)).alias("stated"),
    )
    joined = told.select("claim_id", "at", "quantity").dropDuplicates(["claim_id", "at"]).join(merged(found), ["claim_id", "at"], "left")
    issue = F.when(F.col("stated"), "none").when(F.col("converts") | (F.col("same_kind") & ~F.col("same_unit")), "unsupported_conversion").when(F.col("same_unit"), "operator_or_range")
    issue = issue.when(F.col("same_kind").isNotNull(), "unit_mismatch").when(F.col("turned"), "sign_mismatch").otherwise("value_missing")
    return joined.select("claim_id", "at", "quantity", issue.alias("issue"), F.coalesce("sources", F.array().cast(evidence.select(F.array("evidence_id")).schema[0].dataType)).alias("sources"))


def verdicts(claims: DataFrame, evidence: DataFrame, convert: bool = False) -> DataFrame:
    """``claim_id, quantities, verdict``: unsupported if a quantity is stated by no evidence, ambiguous if no one piece states all, else supported; not numeric without quantities."""
    found = assessed(claims, evidence, convert, why=False).select("claim_id", "issue", F.posexplode_outer("sources").alias("place", "s"))
    # each quantity has one row at place zero, or without a place if it has no source
    first = F.coalesce("place", F.lit(0)) == 0
    by_source = found.groupBy("claim_id", "s").agg(F.count("place").alias("k"), F.count_if(first).alias("n"), F.count_if(first & (F.col("issue") != "none")).alias("missing"))
    own = by_source.groupBy("claim_id").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.max(F.nullif("k", F.lit(0))).alias("most"))
    joined = claims.select("claim_id").distinct().join(merged(own), "claim_id", "left")
    verdict = F.when(F.col("n").isNull(), "not_numeric").when(F.col("missing") > 0, "unsupported").when(F.col("most") < F.col("n"), "ambiguous").otherwise("supported")
    return joined.select("claim_id", F.coalesce("n", F.lit(0)).cast("long").alias("quantities"), verdict.alias("verdict"))


def line_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evidence: what each order line weighs (in kg, written with a grouping comma) and its discount. Claims: an order's first line in grams with a grouping point or in kilograms, one in three its last too, one in five what no line says."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").cast("long").alias("n"), (F.col("l_quantity").cast("long") * 137 + F.col("l_linenumber")).alias("q"), F.round(F.col("l_discount") * 100).cast("long").alias("d"))
    line = line.withColumn("evidence_id", F.concat_ws("-", "n", "q", "d"))  # line numbers repeat
    told = lambda q, d: F.concat(F.lit("about the line: weighs "), F.format_number(q, 0), F.lit(" kg at "), d.cast("string"), F.lit(" %"))
    evidence = line.select("claim_id", "evidence_id", told(F.col("q"), F.col("d")).alias("text"))
    ends = line.groupBy("claim_id").agg(F.min(F.struct("n", "q", "d")).alias("a"), F.max(F.struct("n", "q", "d")).alias("b"))
    grams = F.concat(F.lit("it weighs "), F.translate(F.format_number(F.col("a.q") * 1000, 0), ",", "."), F.lit(" g and has "), F.col("a.d").cast("string"), F.lit(" percent"))
    i = F.col("claim_id")
    text = F.concat_ws("; ", F.when(i % 2 == 0, grams).otherwise(told(F.col("a.q"), F.col("a.d"))), F.when(i % 3 == 0, told(F.col("b.q"), F.col("b.d"))), F.when(i % 5 == 0, F.lit("77,5 mg/L")))
    return ends.select("claim_id", text.alias("text")), evidence


LINES = """l AS (SELECT l_orderkey AS claim_id, l_linenumber AS n, CAST(l_quantity AS BIGINT) * 137 + l_linenumber AS q, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem),
e AS (SELECT claim_id, arg_min(q, (n, q, d)) AS qa, arg_min(d, (n, q, d)) AS da, arg_max(q, (n, q, d)) AS qb, arg_max(d, (n, q, d)) AS db FROM l GROUP BY claim_id),
t AS (SELECT claim_id, list_distinct(list_concat([CASE WHEN claim_id % 2 = 0 THEN 'g' ELSE 'k' END || qa, 'd' || da], CASE WHEN claim_id % 3 = 0 THEN ['k' || qb, 'd' || db] ELSE [] END, CASE WHEN claim_id % 5 = 0 THEN ['x'] ELSE [] END)) AS need FROM e)"""


@query("converted_claims", f"""WITH {LINES}, s AS (SELECT t.claim_id, need, list_filter(need, lambda k: k IN ('g' || l.q, 'k' || l.q, 'd' || l.d)) AS got FROM t JOIN l ON l.claim_id = t.claim_id)
SELECT claim_id, len(any_value(need)) AS quantities, CASE WHEN len(list_distinct(flatten(list(got)))) < len(any_value(need)) THEN 'unsupported' WHEN max(len(got)) < len(any_value(need)) THEN 'ambiguous' ELSE 'supported' END AS verdict FROM s GROUP BY claim_id""")
def converted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about order lines in other units and ways of writing, with conversion."""
    return verdicts(*line_claims(spark, sf_dir), convert=True)


@query("quantity_issues", f"WITH {LINES} SELECT issue, count(*) AS n FROM (SELECT CASE k[1] WHEN 'x' THEN 'value_missing' WHEN 'g' THEN 'unsupported_conversion' ELSE 'none' END AS issue FROM (SELECT unnest(need) AS k FROM t)) GROUP BY issue")
def quantity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quantities of claims lack in their evidence, without conversion."""
    return assessed(*line_claims(spark, sf_dir)).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
