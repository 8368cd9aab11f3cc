"""Secret scans: candidate tokens judged by a random forest that labelled findings teach.

A candidate is a stretch of eight characters or more of a word, between quotes, brackets and other
delimiters, or the value of a ``key=value`` or ``key:value`` in it, that has a digit or mixes cases, is all in capitals, or
is the value of a key word; behind a key word and a sign of assignment also what stands up to the closing quote or white space,
if it has other signs. A word can have several. The forest sees its length, the rates of transitions between character classes, its spread
of characters, how much of it dictionary words cover, the path it stands in and the words next to
it. DataFrame functions and Spark ML only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.rows import named
from lodestar.sources.tables import stored, table

SPACE = r"[\x20\x09-\x0D]+"
LEAST_LENGTH = 8
#: A word counts as a dictionary word if it is of ASCII letters, this long, and this frequent in the corpus.
WORD_LETTERS, WORD_COUNT = 3, 20
#: Labelled findings that the forest is fitted on, about, drawn by class; trees, depth, and the vote that makes a secret.
MOST_LABELLED, TREES, DEPTH, VOTE = 20_000, 20, 6, 0.5
#: A value and the key before it, anywhere in a word; the password of a URL's ``user:password@``; and letters alone that make no plain or capitalised word.
PARTS = r"(?:([A-Za-z0-9_.-]+)[\x22'`]?[=:][\x22'`]?)?([A-Za-z0-9+/_.@%-]{8,}={0,2})"
USERINFO = r"://[^/:@]*:([^/@]{8,})@"
MIXED = "[A-Z]{16}|[a-z][A-Z]|[A-Z]{2}[a-z]"
CLASSES = {"upper": "[A-Z]", "lower": "[a-z]", "digit": "[0-9]", "other": "[^A-Za-z0-9]"}
KEY = "(?:pass|passwd|password|pwd|secret|token|apikey|api_key|api-key|access|auth|credential|bearer)[a-z0-9_-]*"
KEYS = rf"(?i)^[\x22'`(\[{{<,;]*[a-z0-9_.-]*{KEY}[\x22'`:=]*$"
#: A key word and what is assigned to it in the same word, signs that :data:`PARTS` leaves out, what stands in a word between quotes or brackets, and marks behind a value.
ASSIGNED = rf"(?i)([a-z0-9_.-]*{KEY})[\x22'`]?:?[=:][\x22'`]?([^\x22'`]{{8,}})"
SIGNS = r"[^A-Za-z0-9+/_.@%=,;:)\]}>\x22'`-]"
WITHIN = r"^[\x22'`(\[{<]*([^\x22'`]*)"
BEHIND = r"[,;.)\]}>]+$"
TRIAL_PATH = r"(?i)(?:^|[/_.-])(?:test|tests|example|examples|sample|mock|fixture|doc|docs)(?:[/_.-]|$)"


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """``cid, doc_id, pos, key, value, before2, before, after, path`` of every candidate of ``docs(doc_id, text)``; ``pos`` counts words from zero."""
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE), lambda w: w != "")
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.cast("string").alias("path"), words.alias("w"))
    placed = placed.select("doc_id", "path", "w", F.posexplode("w").alias("pos", "word"))
    near = {"before2": -2, "before": -1, "after": 1}
    placed = placed.where(F.length("word") >= LEAST_LENGTH).select("doc_id", "path", "pos", "word", *[F.coalesce(F.get("w", F.col("pos") + i), F.lit("")).alias(n) for n, i in near.items()])
    placed = placed.where(F.col("word").rlike(f"[0-9=:]|{MIXED}") | F.col("before").rlike("[=:]$"))
    pairs = F.transform(F.regexp_extract_all("word", F.lit(PARTS), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, PARTS, 1).alias("key"), F.regexp_extract(m, PARTS, 2).alias("value")))
    logins = F.transform(F.regexp_extract_all("word", F.lit(USERINFO), F.lit(1)), lambda v: F.struct(F.lit("password").alias("key"), v.alias("value")))
    trimmed = lambda v: F.regexp_replace(v, BEHIND, "")
    assigned = F.transform(F.regexp_extract_all("word", F.lit(ASSIGNED), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, ASSIGNED, 1).alias("key"), trimmed(F.regexp_extract(m, ASSIGNED, 2)).alias("value")))
    whole = F.array(F.struct(F.lit("").alias("key"), trimmed(F.regexp_extract("word", WITHIN, 1)).alias("value")))
    signed = F.filter(F.concat(assigned, F.when(announced(), whole).otherwise(F.array().cast("array<struct<key:string,value:string>>"))), lambda x: x["value"].rlike(SIGNS))
    found = placed.select("*", F.explode(F.concat(pairs, logins, signed)).alias("x")).select("doc_id", "path", "pos", *near, "x.key", "x.value")
    told = F.col("value").rlike(f"[0-9]|{MIXED}") | F.col("key").rlike(KEYS) | announced()
    return found.where((F.length("value") >= LEAST_LENGTH) & told).withColumn("cid", F.monotonically_increasing_id())


def announced() -> Column:
    """Whether the words before a value are a key word and a sign of assignment."""
    return (F.col("before").rlike("[=:]$") & F.col("before").rlike(KEYS)) | (F.col("before").isin("=", ":", ":=") & F.col("before2").rlike(KEYS))


def dictionary(docs: DataFrame) -> DataFrame:
    """``(entry)``: the frequent lower-case words of the whole corpus."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), SPACE)).alias("entry"))
    words = words.where((F.length("entry") >= WORD_LETTERS) & F.col("entry").rlike("^[a-z]+$"))
    return words.groupBy("entry").count().where(F.col("count") >= WORD_COUNT).select("entry")


def transitions(value: Column) -> dict[str, Column]:
    """For each ordered pair of character classes, the share of neighbours that change from one to the other."""
    pairs = F.greatest(F.length(value) - 1, F.lit(1))
    return {f"t_{a}_{b}": F.regexp_count(value, F.lit(f"{x}(?={y})")) / pairs for a, x in CLASSES.items() for b, y in CLASSES.items()}


def spread(value: Column) -> Column:
    """Distinct characters over length."""
    return F.size(F.array_distinct(F.split(value, ""))) / F.length(value)


def with_features(found: DataFrame, words: DataFrame) -> tuple[DataFrame, list[str]]:
    """``found`` with the columns that the forest sees, and their names."""
    letters = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    runs = F.transform(F.regexp_extract_all(F.lower("value"), F.lit(f"[a-z]{{{WORD_LETTERS},}}"), F.lit(0)), lambda r: F.struct(r.alias("entry"), F.lit("run").alias("of")))
    sides = F.array(F.struct(letters(F.col("before")).alias("entry"), F.lit("before").alias("of")), F.struct(letters(F.col("after")).alias("entry"), F.lit("after").alias("of")))
    said = found.select("cid", F.explode(F.concat(runs, sides)).alias("x")).select("cid", "x.entry", "x.of").where("entry <> ''").join(words, "entry")
    known = said.groupBy("cid").agg(
        F.sum(F.when(F.col("of") == "run", F.length("entry")).otherwise(0)).alias("covered"),
        F.max(F.when(F.col("of") == "before", 1).otherwise(0)).alias("known_before"),
        F.max(F.when(F.col("of") == "after", 1).otherwise(0)).alias("known_after"),
    )
    v, zero = F.col("value"), F.lit(0)
    more = {"length": F.length(v)} | transitions(v) | {
        "spread": spread(v),
        "coverage": F.coalesce("covered", zero) / F.length(v),
        "before_known": F.coalesce("known_before", zero),
        "after_known": F.coalesce("known_after", zero),
        "keyed": (F.col("key").rlike(KEYS) | F.col("before").rlike(KEYS) | F.col("before2").rlike(KEYS)).cast("int"),
        "assigned": ((F.col("key") != "") | F.col("before").rlike("[=:]$")).cast("int"),
        "dots": F.regexp_count(v, F.lit(r"\.")),
        "trial_path": F.coalesce(F.col("path").rlike(TRIAL_PATH), F.lit(False)).cast("int"),
    }
    full = found.join(known, "cid", "left").select(*found.columns, *[c.cast("double").alias(n) for n, c in more.items()])
    return full, list(more)


def labelled_by_format(found: DataFrame) -> DataFrame:
    """``(cid, label)`` of candidates whose own format settles what they are.

    Secrets: keys of a known provider's format, and assigned values of a key word that mix letters
    and digits. Not secrets: numbers, addresses and host names, and values named after placeholders.
    """
    v = F.col("value")
    placeholder = v.rlike(r"(?i)example|sample|dummy|changeme|xxxx|your[_-]")
    provider = v.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk-[A-Za-z0-9]{20,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$")
    login = (F.col("key") == "password") & ~v.rlike("[@/]")
    named = (F.col("key").rlike(KEYS) & ~v.rlike("[@.]") | login | announced() & v.rlike("[0-9]") & ~v.rlike("[@.]")) & v.rlike("[A-Za-z]")
    plain = v.rlike(r"^[0-9.%+/-]+$|@|\.[A-Za-z]{2,}$")
    label = F.when(placeholder | plain, 0.0).when(provider | named, 1.0)
    return found.select("cid", label.alias("label")).where("label IS NOT NULL")


def training_sample(marks: DataFrame, by_label: dict[float, int], most: int = MOST_LABELLED) -> DataFrame:
    """``(cid, label)`` of about ``most`` rows of ``marks(cid, value, label)``: half of each class, or all of a class that has fewer, whose rest the other takes.

    Rows are drawn by a hash of the row, so a value in many rows counts by its share of them.
    """
    size = dict.fromkeys(by_label, 0)
    for at, (label, n) in enumerate(sorted(by_label.items(), key=lambda x: x[1])):
        size[label] = min(n, (most - sum(size.values())) // (len(by_label) - at))
    unit = F.pmod(F.xxhash64("value", "cid"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for label, n in by_label.items():
        share = F.when(F.col("label") == label, size[label] / n).otherwise(share)
    return marks.where(unit < share).select("cid", "label")


def findings(docs: DataFrame, path: Column, labelled=labelled_by_format) -> DataFrame:
    """Every candidate of ``docs(doc_id, text)`` with ``p_secret`` and ``is_secret``.

    ``labelled`` maps candidates to ``(cid, label)``. If it knows one class only, all candidates are
    of it; if none, none is a secret. Null texts have no candidates; null paths are no trial paths.
    Repeated rows give repeated findings.
    """
    found = stored(candidates(docs, path), "candidates")
    full, names = with_features(found, dictionary(docs))
    full = stored(full, "features")
    marks = stored(labelled(found).join(found.select("cid", "value"), "cid"), "labelled")
    by_label = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    if len(by_label) < 2:
        judged = full.withColumn("p_secret", F.lit(max(by_label, default=0.0)))
    else:
        drawn = training_sample(marks, by_label)
        assembler = VectorAssembler(inputCols=names, outputCol="_features")
        training = assembler.transform(full.join(drawn, "cid")).select("_features", "label")
        forest = RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_p", numTrees=TREES, maxDepth=DEPTH, seed=11).fit(training)
        judged = forest.transform(assembler.transform(full)).withColumn("p_secret", F.coalesce(F.get(vector_to_array("_p"), F.lit(1)), F.lit(0.0)))
    return judged.select("doc_id", F.col("pos").cast("long").alias("pos"), "key", "value", "before", "after", "p_secret", (F.col("p_secret") >= VOTE).alias("is_secret"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of all documents, the value as its SHA-256, and whether it is a secret; ``source`` is the path."""
    found = findings(table(spark, sf_dir, "documents"), F.col("source"))
    return found.select("doc_id", "pos", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "p_secret", "is_secret")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, mark: str = "[secret]") -> DataFrame:
    """All documents, with each secret in ``text`` replaced by ``mark`` and ``n_chars`` counted anew; rows without an id are told apart by their texts."""
    own, row = named(docs)
    found = findings(own.select(F.col(row).alias("doc_id"), "text", "source"), F.col("source")).where("is_secret")
    values = found.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias("_values"))
    joined = own.join(values, own[row] == values["_id"], "left")
    said, clean = values["_values"], own["text"].cast("string")
    text = F.when(said.isNull(), own["text"]).otherwise(F.aggregate(said, clean, lambda t, v: F.replace(t, v, F.lit(mark))))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(said.isNull(), own["n_chars"]).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[new.get(c, own[c]).alias(c) for c in docs.columns])
