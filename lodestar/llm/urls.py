"""URL filters: fixed host and path rules, and per-host trees of path templates for the urls that no rule fits.

Paths become templates level by level: number-like segments become wildcards by their form, the
words under a node become one wildcard if they are many, and sibling branches whose continuations
are distributed alike are merged. The rules' verdicts label pages; a template is rejected if the
labelled purity of its node, smoothed towards its parent's, is high.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import stored, table

#: Verdict, host and path of each rule.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Levels of a tree (what lies below is one wildcard), words under a node before they become a wildcard.
DEPTH, FAN = 4, 8
#: Merging: how much two distributions may differ, besides what chance explains. Purity: weight of the parent, of a page without label, and the purity that rejects.
APART, PARENT, UNLABELLED, REJECT = 0.25, 4.0, 0.5, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name, verdict = F.when(fits, own + start).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def segment_form(s: Column) -> Column:
    """A wildcard for number-like segments, with their extension; other segments as they are."""
    form = F.regexp_replace(s, r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$", "{date}")
    form = F.regexp_replace(form, r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F]{8,}(-[0-9a-fA-F]{4,})*$", "{hex}")
    return F.regexp_replace(form, r"^[0-9]+(?=$|\.[A-Za-z0-9]+$)", "{n}")


def kind_of(segment: Column) -> Column:
    """What a segment's place continues with: its wildcard, a word, or the end."""
    return F.when(segment.isNull(), "$").when(segment.startswith("{"), segment).otherwise("word")


def grown(shapes: DataFrame) -> DataFrame:
    """``shapes(host, shape, parts, n, ...)`` with ``nodes``, the template at every level from the root's empty one."""
    level = shapes.withColumn("node", F.lit("")).withColumn("nodes", F.array(F.lit("")))
    for depth in range(DEPTH):
        part = F.get("parts", F.lit(depth))
        level = level.withColumn("part", part).withColumn("next", kind_of(F.get("parts", F.lit(depth + 1))))
        words = level.where(part.isNotNull() & ~part.startswith("{")).groupBy("host", "node", "part").agg(F.lit(1).alias("one"))
        fans = words.groupBy("host", "node").agg(F.count("one").alias("fan"))
        level = level.join(fans, ["host", "node"], "left")
        level = level.withColumn("part", F.when((F.col("fan") > FAN) & ~F.col("part").startswith("{"), "{word}").otherwise(F.col("part"))).drop("fan")
        branch = level.where("part IS NOT NULL").groupBy("host", "node", "part", "next").agg(F.sum("n").alias("n"))
        pool = branch.groupBy("host", "node", "next").agg(F.sum("n").alias("pool"))
        whole = branch.groupBy("host", "node").agg(F.sum("n").alias("whole"))
        sizes = branch.groupBy("host", "node", "part").agg(F.sum("n").alias("size"))
        shared = branch.join(pool, ["host", "node", "next"]).join(whole, ["host", "node"]).join(sizes, ["host", "node", "part"])
        shared = shared.groupBy("host", "node", "part").agg(F.sum(F.least(F.col("n") / F.col("size"), F.col("pool") / F.col("whole"))).alias("common"), F.first("size").alias("size"))
        alike = shared.where(F.col("common") >= 1 - APART - 1 / F.sqrt("size")).select("host", "node", "part", F.lit(True).alias("alike"))
        several = alike.groupBy("host", "node").agg(F.count("alike").alias("merged")).where("merged > 1")
        alike = alike.join(several.select("host", "node"), ["host", "node"])
        level = level.join(alike, ["host", "node", "part"], "left")
        name = F.when(F.col("part").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.when(F.col("alike"), "{any}").otherwise(F.col("part"))))
        level = level.withColumn("node", name).withColumn("nodes", F.concat("nodes", F.array("node"))).drop("part", "next", "alike")
        level = stored(level, "templates")
    deeper = F.when(F.size("parts") > DEPTH, F.concat("node", F.lit("/**"))).otherwise(F.col("node"))
    return level.withColumn("template", deeper)


def purities(trees: DataFrame) -> DataFrame:
    """``trees(host, nodes, template, n, labelled, blocked)`` with ``purity``, smoothed from the root of all hosts down."""

    def smooth(parent: Column) -> Column:
        return (F.col("b") + PARENT * parent) / (F.col("l") + UNLABELLED * (F.col("t") - F.col("l")) + PARENT)

    sums = [F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), F.sum("n").alias("t")]
    top = trees.agg(*sums).select(smooth(F.lit(0.5)).alias("p")).first()
    rated = trees.withColumn("purity", F.lit(float(top.p) if top.p is not None else 0.0))
    for level in range(DEPTH + 2):
        node = F.get("nodes", F.lit(level)) if level <= DEPTH else F.col("template")
        rated = rated.withColumn("_node", node)
        own = rated.groupBy("host", "_node").agg(*sums, F.first("purity").alias("parent")).select("host", "_node", smooth(F.col("parent")).alias("_purity"))
        rated = rated.join(own, ["host", "_node"]).withColumn("purity", F.col("_purity")).drop("_purity", "_node")
    return rated


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages(page_id, url)``.

    A null url, and one without ``://``, has an empty host and path and stands at the root. Repeated
    rows are kept and count each; other columns are not read.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    own = own.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = fitting_rule(F.col("host"), F.col("path"), rules)
    parts = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), segment_form)
    own = own.withColumn("rule", rule).withColumn("said", said).withColumn("parts", parts).withColumn("shape", F.array_join("parts", "/"))
    own = stored(own, "urls")
    shapes = own.groupBy("host", "shape").agg(F.first("parts").alias("parts"), F.count(F.lit(1)).alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked"))
    rated = purities(grown(stored(shapes, "shapes"))).select("host", "shape", "template", "purity")
    verdict = F.coalesce("said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return own.join(rated, ["host", "shape"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judged(table(spark, sf_dir, "pages"))
