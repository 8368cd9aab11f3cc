"""Soft-membership mixing: document rates whose expected token totals by domain meet target weights.

A classifier, fitted on the table of labels, gives every document a posterior over the domains. The
rates are nonnegative and minimise the squared differences between the domains' expected totals,
the sums of ``rate * tokens * posterior``, and the targets. Projected gradients do it: rates start at one;
each step sums the totals over all documents in Spark, moves the rates against the gradient and cuts them off
at zero. A gradient is a weight for each domain times the document's posterior, so all steps together are
one weight for each domain, and a rate is ``max(0, 1 + weights . posterior)``. Steps are scaled by the
second moments of the documents whose rate is not zero, as these are at each step, and of several step lengths,
judged in one pass, the best is taken; a few passes meet the targets. DataFrame functions and Spark ML only.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.rows import named
from lodestar.sources.tables import stored, table

DOMAINS = ("good", "plain", "toxic")
#: The share of all expected tokens that each domain gets.
TARGETS = {"good": 0.8, "plain": 0.195, "toxic": 0.005}
#: Labelled documents that the classifier is fitted on, at most (drawn by a hash of the id); hashed word features.
MOST_LABELLED, FEATURES = 20_000, 1 << 15
#: The largest relative miss of a target that ends the steps, the step lengths tried, and passes in a row without a lesser miss after which targets count as out of reach.
MISS, LENGTHS, IDLE = 1e-5, (1.0, 0.5, 0.2, 0.05, 0.01), 8
SPACE = r"[\x20\x09-\x0D]+"


def domain_of(quality: Column, toxic: Column) -> Column:
    """The number of a label's domain: toxic, else good, else plain; null if both labels are null."""
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality.isNotNull() | toxic.isNotNull(), 1)


def word_features(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``features``, the normalised counts of hashed lower-case words; null texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), SPACE), lambda w: w != "")
    docs = docs.withColumn("_words", words).withColumn("n_tokens", F.size("_words").cast("long")).drop("text")
    docs = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=FEATURES).transform(docs).drop("_words")
    return Normalizer(inputCol="_tf", outputCol="features").transform(docs).drop("_tf")


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, p`` for every row of ``docs(doc_id, text)``; ``p`` holds a probability for each domain.

    If the labelled documents are of one domain only, or there are none, the posterior is that domain, or uniform.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    total = marks.count()
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = marks.where(unit < min(1.0, 0.95 * MOST_LABELLED / max(total, 1))).dropDuplicates().limit(MOST_LABELLED)
    training = stored(word_features(own.join(F.broadcast(drawn), "doc_id")), "labelled")
    known = sorted(int(r.label) for r in training.select("label").distinct().collect())
    ready = word_features(own)
    if len(known) < 2:
        share = [float(i in known) if known else 1 / len(DOMAINS) for i in range(len(DOMAINS))]
        return ready.select("doc_id", "n_tokens", F.array(*map(F.lit, share)).alias("p"))
    model = LogisticRegression(maxIter=30, regParam=1e-4, family="multinomial", probabilityCol="probability", featuresCol="features", labelCol="label").fit(training)
    p = vector_to_array("probability")
    return model.transform(ready).select("doc_id", "n_tokens", F.transform(F.sequence(F.lit(0), F.lit(len(DOMAINS) - 1)), lambda i: F.coalesce(F.get(p, i), F.lit(0.0))).alias("p"))


def rate_of(weights: np.ndarray) -> Column:
    return F.greatest(F.lit(0.0), sum((F.col(f"p{i}") * float(w) for i, w in enumerate(weights)), F.lit(1.0)))


def fitted_weights(soft: DataFrame, targets: dict[str, float]) -> tuple[np.ndarray, float]:
    """The domains' weights for ``soft(n_tokens, p0, p1, ...)``, and the largest relative miss of a target that is left.

    The weights minimise ``sum(tokens * rate ** 2) / 2 - wanted . weights``, whose gradient is the totals'
    difference from the targets; so they give the rates nearest to one that meet the targets. Targets that
    no rates meet (a domain without any posterior) end the search when no step makes the miss less.
    """
    k, t = len(DOMAINS), F.col("n_tokens").cast("double")
    total = soft.agg(F.sum(t)).first()[0] or 0.0
    weights = np.zeros(k)
    if not total:
        return weights, 0.0
    wanted = np.array([targets[d] for d in DOMAINS])
    wanted = wanted / wanted.sum()

    def judged(candidates: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        sums = []
        for c, w in enumerate(candidates):
            rate = rate_of(w)
            sums.append(F.sum(t * rate * rate).alias(f"v{c}"))
            sums += [F.sum(t * rate * F.col(f"p{i}")).alias(f"e{c}_{i}") for i in range(k)]
            sums += [F.sum(F.when(rate > 0, t * F.col(f"p{i}") * F.col(f"p{j}")).otherwise(0.0)).alias(f"m{c}_{i}_{j}") for i in range(k) for j in range(i, k)]
        row = soft.agg(*sums).first()
        out = []
        for c, w in enumerate(candidates):
            short = np.array([row[f"e{c}_{i}"] for i in range(k)]) / total - wanted
            second = np.array([[row[f"m{c}_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / total
            out.append((row[f"v{c}"] / total / 2 - float(wanted @ w), short, second))
        return out

    miss = lambda short: float(np.abs(short / np.maximum(wanted, 1e-9)).max())
    value, short, second = judged([weights])[0]
    best, idle = (miss(short), weights), 0
    while best[0] >= MISS and idle < IDLE:
        step = np.linalg.solve(second + 1e-9 * np.eye(k), short)
        tried = [weights - length * step for length in LENGTHS]
        found = judged(tried)
        at = min(range(len(found)), key=lambda i: found[i][0])
        if found[at][0] >= value - 1e-15:
            break
        weights, (value, short, second) = tried[at], found[at]
        idle = 0 if miss(short) < 0.99 * best[0] else idle + 1
        if miss(short) < best[0]:
            best = (miss(short), weights)
    return best[1], best[0]


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``doc_id, n_tokens, p_*, rate, miss`` for every row of ``docs(doc_id, text)``.

    ``rate`` is how many times the document is to be taken, in expectation; all rates together take
    as many tokens as the corpus has. ``miss`` is the largest relative difference of a domain's total from its
    target, the same in all rows: near zero, unless the corpus cannot meet the targets. Texts without words have a rate as
    well, which changes no total. An empty table gives an empty result. Repeated rows count each.
    """
    soft = posteriors(docs, labels)
    soft = stored(soft.select("doc_id", "n_tokens", *[F.get("p", i).alias(f"p{i}") for i in range(len(DOMAINS))]), "posteriors")
    weights, miss = fitted_weights(soft, targets)
    return soft.select("doc_id", "n_tokens", *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(DOMAINS)], rate_of(weights).alias("rate"), F.lit(miss).alias("miss"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors and rates of all documents."""
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a rate above zero, and that ``rate``; rows with equal ids, or without an id and with one text, get the mean of their rates; a column ``rate`` that is there already is replaced."""
    own, row = named(docs)
    rates = mixed(own.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "labels")).groupBy(F.col("doc_id").alias("_id")).agg(F.avg("rate").alias("_rate"))
    rated = own.join(rates, own[row] == rates["_id"]).where(rates["_rate"] > 0)
    return rated.select(*[own[c] for c in docs.columns if c != "rate"], rates["_rate"].alias("rate"))
