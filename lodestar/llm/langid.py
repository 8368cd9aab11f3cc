"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed to ``DIM`` buckets. Document frequencies count every
learning document. Weights come from follow-the-regularised-leader with an elastic-net penalty,
run over a bounded sample of labelled documents in parallel parts whose models are averaged, twice.
Parts are as many as the sample asks for. What training does not see of the sample sets the softmax temperature.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import stored, table

DIM_BITS = 15
DIM = 1 << DIM_BITS
#: Documents of one language, and of all, that training takes (about, and one of each language at least); documents in one of the parts it runs in; rounds of averaging.
PER_LANGUAGE, MOST_SAMPLED, PART_ROWS, ROUNDS = 5000, 1_000_000, 2000, 2
#: Parts at least; of five rows, how many teach (the others set the temperature and the bar).
LEAST_PARTS, TAUGHT = 8, 4
#: FTRL: step, step offset, L1 and L2 penalty.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
CHUNK = 1 << 18
UNKNOWN = "und"
#: The stage's bar: the part of a language's texts (one at least) that a trigram must be in to count as used, the share of the language's middle share, and the least share of all languages' middle one.
USED, BAR, LEAST_BAR = 0.01, 0.6, 0.3


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's n-grams, ascending, and how often each occurs."""
    counts = np.zeros(DIM, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), CHUNK):
        part, fresh = points[max(0, at - 2) : at + CHUNK], min(at, 2)
        one = part * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(0x85EBCA6B) + one[1:] + np.uint32(1)
        three = two[:-1] * np.uint32(0xC2B2AE35) + one[2:] + np.uint32(2)
        for n, codes in enumerate((one, two, three)):
            codes = codes[max(0, fresh - n) :]
            codes = (codes ^ (codes >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(codes >> np.uint32(32 - DIM_BITS), minlength=DIM)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weigh(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[found]
    return x / max(np.linalg.norm(x), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class Model:
    """Classes in order, inverse document frequencies, weights by class and bucket, and the temperature."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        found, counts = ngrams(text)
        return self.weights[:, found] @ weigh(found, counts, self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its probability; ``und`` and zero without a letter or a learnt language."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def ftrl(examples: list, start: np.ndarray, seed: int = 0) -> np.ndarray:
    """One pass of FTRL-proximal over ``(buckets, values, class)`` from the weights ``start``."""
    z, n = -start * (BETA / ALPHA + L2) - np.sign(start) * L1, np.zeros_like(start)
    for i in np.random.default_rng(seed).permutation(len(examples)):
        found, x, y = examples[i]
        zi, ni = z[:, found], n[:, found]
        w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
        p = softmax(w @ x)
        p[y] -= 1.0
        g = p[:, None] * x
        grown = ni + g * g
        z[:, found] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
        n[:, found] = grown
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """``ln((n + 1) / (df + 1)) + 1`` of every bucket over all rows of ``texts(text)``."""

    def count(batches):
        df, n = np.zeros(DIM + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[ngrams(text)[0]] += 1
                df[DIM] += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(df[found])], ["bucket", "df"])

    df = np.zeros(DIM + 1)
    for row in texts.mapInArrow(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[row.bucket] = row.df
    return np.log((df[DIM] + 1) / (df[:DIM] + 1)) + 1


def sampled(labelled: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The sample of ``labelled(text, lang)`` that training takes, with a ``part`` (-1 for held-out rows), and all languages.

    Rows are drawn by a hash of the text, each language by its own share; equal texts with one label count once.
    """
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = tuple(sorted(counts))
    wanted = max(1, min(PER_LANGUAGE, MOST_SAMPLED // max(1, len(counts))))
    shares = labelled.sparkSession.createDataFrame([(x, min(1.0, wanted / n)) for x, n in counts.items()], "lang string, share double")
    unit = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(shares), "lang").where(unit < F.col("share")).select("text", "lang").dropDuplicates(["text", "lang"])
    parts = max(LEAST_PARTS, sum(min(n, wanted) for n in counts.values()) // PART_ROWS)
    at = F.pmod(F.hash("text"), F.lit(5 * parts))
    return stored(sample.withColumn("part", F.when(at >= TAUGHT * parts, -1).otherwise(F.pmod(at, F.lit(parts)))), "labelled"), languages


def train(labelled: DataFrame) -> Model:
    """``trained`` without its sample."""
    return trained(labelled)[0]


def trained(labelled: DataFrame) -> tuple[Model, DataFrame]:
    """A model from ``labelled(text, lang)``; rows with a null or without a letter teach nothing.

    Statistics cover all rows. Weights are fitted on about ``PER_LANGUAGE`` rows of each language, and ``MOST_SAMPLED`` of all,
    at most. Every language is learnt, also one with a single row; the model takes 256 KB for each. The sample comes with it.
    """
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sample, languages = sampled(labelled)
    if not languages:
        return Model((), np.ones(DIM), np.zeros((0, DIM))), sample
    idf = inverse_frequencies(labelled.select("text"))
    number = {lang: i for i, lang in enumerate(languages)}
    weights = np.zeros((len(languages), DIM))
    learning = sample.where("part >= 0")

    def fit(weights: np.ndarray, turn: int):
        def run(part: pa.Table) -> pa.Table:
            examples = []
            for text, lang in zip(part["text"].to_pylist(), part["lang"].to_pylist(), strict=True):
                if has_letter(text):
                    found, n = ngrams(text)
                    examples.append((found, weigh(found, n, idf), number[lang]))
            w = ftrl(examples, weights, turn)
            k, b = np.nonzero(w)
            return pa.table({"k": k, "bucket": b, "w": w[k, b]})

        return run

    total = max(1, learning.select("part").distinct().count())
    for turn in range(ROUNDS):
        parts = learning.groupBy("part").applyInArrow(fit(weights, turn), "k long, bucket long, w double")
        weights = np.zeros_like(weights)
        for row in parts.groupBy("k", "bucket").agg((F.sum("w") / total).alias("w")).collect():
            weights[row.k, row.bucket] = row.w
    model = Model(languages, idf, weights)
    return replace(model, temperature=temperature(sample.where("part < 0"), model)), sample


def temperature(held: DataFrame, model: Model) -> float:
    """The temperature with the least negative log-likelihood of ``held(text, lang)``, by grids whose losses are summed over all rows; one without rows."""
    number = {lang: i for i, lang in enumerate(model.languages)}
    low, high = np.log(0.02), np.log(20.0)
    for _ in range(2):
        grid = np.exp(np.linspace(low, high, 25))

        def judge(batches, grid=grid):
            loss, n = np.zeros(len(grid)), 0
            for batch in batches:
                for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                    if has_letter(text):
                        loss -= np.log(softmax(model.logits(text)[None, :] / grid[:, None])[:, number[lang]] + 1e-12)
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid))), pa.array(loss), pa.array(np.full(len(grid), n))], ["at", "loss", "n"])

        sums = held.mapInArrow(judge, "at long, loss double, n long").groupBy("at").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).collect()
        if not sums or not sums[0].n:
            return 1.0
        best = min(sums, key=lambda r: (round(r.loss, 9), r["at"]))["at"]
        step = np.log(grid[1] / grid[0])
        low, high = np.log(grid[best]) - step, np.log(grid[best]) + step
    return float(grid[best])


def crc_remainder(column: str, of: int) -> Column:
    """CRC-32 of a column's text modulo ``of``; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % of, F.lit(-1))


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, with ``lang_pred`` and ``score``; only ``text`` is looked at."""
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            said = [model.predict(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in said], pa.string()), pa.array([p for _, p in said], pa.float64())], [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from those that are not held out.

    Null texts and texts without a letter are ``und`` with score zero. A null id is not held out.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_remainder("doc_id", 3) == 1).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def letter_trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's trigrams of letters, other characters counting as single blanks, ascending, and how often each occurs; those with one letter are left out."""
    counts = np.zeros(DIM, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), CHUNK):
        part = points[at : at + CHUNK + 2]
        letter = is_letter()[part]
        part = np.where(letter, part, np.uint32(32))
        kept = letter | np.concatenate([[True], letter[:-1]])
        part, letter = part[kept], letter[kept]
        sure = letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2
        codes = ((part[:-2] * np.uint32(0x9E3779B1) + part[1:-1]) * np.uint32(0x85EBCA6B) + part[2:])[sure]
        codes = (codes ^ (codes >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts += np.bincount(codes >> np.uint32(32 - DIM_BITS), minlength=DIM)
    found = np.flatnonzero(counts)
    return found, counts[found]


@cache
def is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@dataclass(frozen=True)
class Usage:
    """Which trigrams each language uses, which it would use without any one of its texts, and the share of a text's trigrams that must be used in its languages."""

    known: np.ndarray
    sure: np.ndarray
    bars: np.ndarray

    def share(self, text: str, language: int, own: bool = False) -> tuple[float, int]:
        """The share of a text's trigrams that ``language``, or the one other language that knows most of the rest, uses; and their number. ``own`` texts, which taught the language, do not count for themselves."""
        found, counts = letter_trigrams(text)
        rest = counts * ~(self.sure if own else self.known)[language, found]
        others = self.known[:, found] @ rest
        others[language] = 0
        return (1.0 - (rest.sum() - max(0, others.max())) / counts.sum() if len(found) else 1.0), int(counts.sum())

    def foreign(self, text: str, language: int) -> bool:
        """Whether the share is below the language's bar even if it is two standard deviations short by chance."""
        share, n = self.share(text, language)
        return share + 2 * np.sqrt(share * (1 - share) / max(n, 1)) < self.bars[language]


def usage(sample: DataFrame, model: Model) -> Usage:
    """The trigrams that ``USED`` of a language's texts in ``sample(text, lang, part)`` have, and the languages' bars.

    A bar is ``BAR`` of the middle share of the language's texts, each judged by the others and the other languages; so a language with few
    texts, which say less about each other, has a lower one, but not below ``LEAST_BAR`` of the middle share of all texts.
    """
    number = {lang: i for i, lang in enumerate(model.languages)}

    def count(batches):
        seen = np.zeros((len(number), DIM), np.int32)
        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                seen[number[lang], letter_trigrams(text)[0]] += 1
        k, b = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b), pa.array(seen[k, b].astype(np.int64))], ["k", "bucket", "n"])

    learnt = sample.where("part >= 0")
    sizes = {r.lang: r["count"] for r in learnt.groupBy("lang").count().collect()}
    known, sure = np.zeros((len(number), DIM), bool), np.zeros((len(number), DIM), bool)
    least = learnt.sparkSession.createDataFrame([(number[x], max(1, int(USED * n))) for x, n in sizes.items()], "k long, least long")
    uses = learnt.mapInArrow(count, "k long, bucket long, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).join(F.broadcast(least), "k").where("n >= least")
    for r in uses.groupBy("k", (F.col("n") > F.col("least")).alias("more")).agg(F.collect_list("bucket").alias("buckets")).collect():
        known[r.k, r.buckets] = True
        sure[r.k, r.buckets] = r.more
    found = Usage(known, sure, np.zeros(len(number)))

    def judge(batches):
        for batch in batches:
            rows = [(number[y], found.share(t, number[y], part >= 0)[0]) for t, y, part in zip(*(batch[c].to_pylist() for c in ("text", "lang", "part")), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.float64())], ["k", "share"])

    shares = stored(sample.mapInArrow(judge, "k long, share double"), "shares")
    middle = shares.agg(F.percentile_approx("share", 0.5)).first()[0]
    bars = np.full(len(number), LEAST_BAR * (middle or 0.0))
    for r in shares.groupBy("k").agg(F.percentile_approx("share", 0.5).alias("share")).collect():
        bars[r.k] = max(bars[r.k], BAR * r.share)
    return replace(found, bars=bars)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are in some learnt language, or in two; rows and columns as given.

    Rejected are texts without a letter, null and empty ones among them, and texts whose trigrams are too rarely used in the predicted
    language and in the one other that knows most of the rest: less than ``BAR`` of what is the middle among the predicted language's own
    texts, as :func:`usage` states. So the bar depends neither on how many languages there are nor on how rare another one is, and a short
    text has the benefit of the doubt. Where no row has a language nothing with a letter is rejected.
    """
    model, sample = trained(docs.where(crc_remainder("doc_id", 3) != 1))
    uses = usage(sample, model) if model.languages else None
    number = {lang: i for i, lang in enumerate(model.languages)}
    at = docs.columns.index("text")

    def keep(text: str | None) -> bool:
        if uses is None or not has_letter(text):
            return has_letter(text)
        return not uses.foreign(text, number[model.predict(text)[0]])

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([keep(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
