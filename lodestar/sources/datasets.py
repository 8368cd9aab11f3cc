"""Scans of measurement files, question sets and evaluation cases, and the sink for reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the four kinds of measurements.
MEASUREMENTS = {
    "fermentation": "sample_id string, replicate int, time_hours double, temperature_c double, density_g_ml double",
    "volatiles": "sample_id string, replicate int, compound string, concentration double, unit string",
    "polyphenols": "sample_id string, replicate int, analyte string, concentration_mg_l double",
    "sensory": "sample_id string, assessor_pseudonym string, replicate int, attribute string, score double, scale_min double, scale_max double",
}
QUESTIONS = "id string, family_id string, split string, language string, task string, question string, answerable boolean"
CASES = "case_id string, query string, expected array<string>, acceptable array<string>"
CONTROL = "control_"


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """``kind, controls`` (a map) and the measured columns of a CSV or JSON file of one kind of measurements.

    In CSV the columns ``control_*`` are controls, by their values in the first row; empty ones do not count. Values that cannot be read as their type end
    the scan with an error, and so does a kind that is not known.
    """
    if path.lower().endswith(".json"):
        whole = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
        kind = kind_of(whole)
        fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in MEASUREMENTS[kind].split(", "))
        strict = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"kind string, controls map<string,string>, records array<struct<{fields}>>").json(path)
        return strict.select("kind", "controls", F.explode("records").alias("r")).select("kind", "controls", "r.*")
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns})
    kind = kind_of(raw)
    named = [c for c in raw.columns if c.startswith(CONTROL)]
    first = raw.select(*named).first().asDict() if named else {}
    held = {c.removeprefix(CONTROL): v for c, v in first.items() if v}
    controls = F.create_map(*[F.lit(x) for kv in held.items() for x in kv]) if held else F.create_map().cast("map<string,string>")
    return raw.select(F.lit(kind).alias("kind"), controls.alias("controls"), *[F.col(x.split()[0]).cast(x.split()[1]).alias(x.split()[0]) for x in MEASUREMENTS[kind].split(", ")])


def kind_of(rows: DataFrame) -> str:
    first = rows.select("kind").first() if "kind" in rows.columns else None
    if first is None or first.kind not in MEASUREMENTS:
        raise ValueError("a file of measurements needs a known kind and at least one record")
    return first.kind


def question_splits(spark: SparkSession, folder: str, purpose: str) -> DataFrame:
    """The questions of all splits that ``manifest.json`` in ``folder`` lists: ``splits`` with ``split, path, sha256, question_count``.

    The files' contents must have the stated hashes and numbers of questions, no question may be in two splits, and no family either. The
    split ``final_test`` is opened for that purpose only.
    """
    listed = spark.read.option("multiLine", True).json(f"{folder}/manifest.json").select(F.explode("splits").alias("s")).select("s.*").collect()
    wanted = [s for s in listed if s.split != "final_test" or purpose == "final_test"]
    if any(".." in s.path.split("/") or s.path.startswith("/") for s in wanted):
        raise ValueError("a split's path leaves the folder of its manifest")
    found = None
    for s in wanted:
        seen = spark.read.format("binaryFile").load(f"{folder}/{s.path}").select(F.sha2("content", 256).alias("h")).first().h
        if seen != s.sha256:
            raise ValueError(f"the content of split {s.split} is not that of its manifest")
        fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in QUESTIONS.split(", "))
        own = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"split string, questions array<struct<{fields}>>").json(f"{folder}/{s.path}")
        own = own.select(F.explode("questions").alias("q")).select("q.*").withColumn("split", F.lit(s.split))
        if own.count() != s.question_count:
            raise ValueError(f"split {s.split} has another number of questions than its manifest says")
        found = own if found is None else found.unionByName(own)
    twice = found.groupBy("id").count().where("count > 1").limit(1).count() + found.groupBy("family_id").agg(F.countDistinct("split").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError("a question or a family is in several splits")
    return found


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """``CASES`` from a JSON array of cases, or from an object whose ``cases`` is one; a file without cases is an error."""
    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in CASES.split(", "))
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("j"))
    cases = F.when(F.col("j").startswith("["), F.from_json("j", f"array<struct<{fields}>>")).otherwise(F.from_json(F.get_json_object("j", "$.cases"), f"array<struct<{fields}>>"))
    found = text.select(F.explode(cases).alias("c")).select("c.*")
    if not found.head(1):
        raise ValueError("a set of evaluation cases cannot be empty")
    return found


def write_report(metrics: DataFrame, folder: str) -> None:
    """Write ``metrics(metric, value, ...)`` below ``folder`` as JSON lines and as one Markdown table.

    Both are written beside the folder and take its place when they are whole, so a run that fails leaves the old report.
    """
    place, folder = folder, f"{folder}-{uuid.uuid4().hex}"
    columns = metrics.columns
    ordered = metrics.orderBy(*columns[:1])
    ordered.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("value")
    head = metrics.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "n int, value string")
    body = ordered.select(F.lit(2).alias("n"), line)
    head.unionByName(body).coalesce(1).sortWithinPartitions("n", "value").select("value").write.mode("overwrite").text(f"{folder}/markdown")
    take_place(metrics.sparkSession, folder, place)


def take_place(spark: SparkSession, new: str, place: str) -> None:
    """Rename the folder ``new`` to ``place``; what was there is deleted once the new one stands, and comes back if it cannot."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there, aside = path(place), path(f"{place}-{uuid.uuid4().hex}")
    system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = system.exists(there) and system.rename(there, aside)
    if not system.rename(path(new), there):
        if had:
            system.rename(aside, there)
        raise OSError(f"{new} could not take the place of {place}")
    if had:
        system.delete(aside, True)
