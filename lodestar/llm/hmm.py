"""A hidden Markov language model: Baum-Welch over all learning documents, exact likelihoods by the scaled forward recursion.

States emit symbols: one for each of the ``HEAD`` most frequent words, one for the end of a text,
and ``CLASSES`` for the other words, told by their last two bytes. A word of a class has the share
``(c + 0.5) / mass`` of it, where ``c`` is its count and the mass of a class leaves 0.5 to words
that learning never saw. So the model gives every text a probability, from counts of all words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.langid import crc_remainder
from lodestar.sources.tables import stored, table

STATES, HEAD, CLASSES, ROUNDS = 8, 8192, 64, 3
#: Words whose counts tasks hold in memory (the most frequent), at most; the others' counts are joined.
LOOKUP = 1 << 17
#: Distinct words that a counting task holds before it hands them on; tokens in a batch of the recursions.
HELD, BATCH = 300_000, 250_000


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased (A-Z) words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-2:]) % CLASSES


def count_words(docs: DataFrame) -> DataFrame:
    """``(word binary, c long)`` over all rows of ``docs(text)``; the empty word stands for the ends of texts."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                seen[b""] += 1
                if len(seen) > HELD:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass(frozen=True)
class Lexicon:
    """The most frequent words with their counts, in order, and the masses of the classes of the others."""

    words: list[bytes]
    counts: np.ndarray
    head: int
    masses: np.ndarray

    @property
    def symbols(self) -> int:
        return self.head + 1 + CLASSES


def most_frequent(held: DataFrame, most: int) -> list[tuple[int, bytes]]:
    """``(c, word)`` of the ``most`` most frequent words of ``held(word, c)``; those of equal counts are taken in the order of a hash.

    The cut is sought by sums: first by eighths of a power of two of the counts, then by the counts of the
    eighth that does not fit, then by ranges of the hash of the words with the count that does not fit.
    So about ``most`` rows reach the driver, and ties and words of one count only are cut like any others.
    """
    eighth, unit = F.floor(8 * F.log2("c")), F.pmod(F.xxhash64("word"), F.lit(1 << 40))

    def fitting(rows: DataFrame, by: Column, room: int, falling: bool) -> tuple[int | None, int]:
        """The first value that does not fit into ``room``, and the room left before it."""
        for r in sorted(rows.groupBy(by.alias("x")).count().collect(), key=lambda r: -r.x if falling else r.x):
            if r["count"] > room:
                return r.x, room
            room -= r["count"]
        return None, room

    band, room = fitting(held, eighth, most, True)
    wanted = eighth > band if band is not None else F.lit(True)
    if band is not None:
        last, room = fitting(held.where(eighth == band), F.col("c"), room, True)
        wanted = wanted | ((eighth == band) & (F.col("c") > last))
        edge, room = fitting(held.where(F.col("c") == last), F.floor(unit / (1 << 24)), room, False)
        wanted = wanted | ((F.col("c") == last) & (F.floor(unit / (1 << 24)) < edge))
        tied = held.where((F.col("c") == last) & (F.floor(unit / (1 << 24)) == edge)).orderBy(unit, "word").limit(room)
        rows = held.where(wanted).select("c", "word").unionByName(tied.select("c", "word"))
    else:
        rows = held.select("c", "word")
    return sorted(((r.c, bytes(r.word)) for r in rows.collect()), key=lambda r: (-r[0], r[1]))


def lexicon(counts: DataFrame, most: int = LOOKUP) -> Lexicon:
    """The lexicon of ``counts(word, c)``, its ``most`` most frequent words, and the sums of each class over all words."""
    top = most_frequent(counts.where(F.length("word") > 0), most)
    words, own = [w for _, w in top], np.array([c for c, _ in top], np.int64)
    head = min(HEAD, len(words))
    emitted = set(words[:head])

    def run(batches):
        mass = np.zeros(CLASSES)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word and word not in emitted:
                    mass[word_class(word)] += c + 0.5
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(mass)], ["k", "mass"])

    masses = np.full(CLASSES, 0.5)
    for r in counts.select("word", "c").mapInArrow(run, "k long, mass double").groupBy("k").agg(F.sum("mass").alias("mass")).collect():
        masses[r.k] += r.mass
    return Lexicon(words, own, head, masses)


def encode(docs: DataFrame, lex: Lexicon, keep: dict[str, str]) -> DataFrame:
    """``keep`` (column to type) and the symbols of each row of ``docs(text)``, as 16-bit numbers.

    ``logs`` and ``known`` sum ``log10(c + 0.5)`` and count the tokens with ``c > 0`` over the words of the lexicon, ``class_logs`` what
    the score needs for those outside the head, ``rest`` and ``times`` hold the words outside the lexicon.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    out = ["n_tokens long", "symbols binary", "logs double", "known long", "class_logs double", "rest array<binary>", "times array<long>"]

    def run(batches):
        lex = shared.value
        number = {w: i for i, w in enumerate(lex.words)}
        logs = np.log10(lex.counts + 0.5)
        symbol = np.array([i if i < lex.head else lex.head + 1 + word_class(w) for i, w in enumerate(lex.words)], np.uint16)
        mass = np.log10(lex.masses)
        for batch in batches:
            rows = []
            for text in batch.column(len(keep)).to_pylist():
                words = words_of(text)
                ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                known, coded = ids >= 0, np.empty(len(words) + 1, np.uint16)
                coded[:-1][known], coded[-1] = symbol[ids[known]], lex.head
                other = [words[i] for i in np.flatnonzero(~known)]
                coded[:-1][~known] = [lex.head + 1 + word_class(w) for w in other]
                tail, rest = coded[coded > lex.head] - (lex.head + 1), Counter(other)
                in_class = ids[known & (ids >= lex.head)]
                rows.append((len(words) + 1, coded.tobytes(), float(logs[ids[known]].sum()), int(known.sum()), float(logs[in_class].sum() - mass[tail].sum()), list(rest), list(rest.values())))
            kinds = [pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keep, *(x.split()[0] for x in out)])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, ", ".join([f"{c} {t}" for c, t in keep.items()] + out))


@dataclass(frozen=True)
class Hmm:
    """Start probabilities, transitions between states, and emissions by symbol and state."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


def batches_of(texts: list[np.ndarray]):
    """The indices of non-empty texts of like length, longest first, together."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    part, size = [], 0
    for i in order:
        if part and size + len(texts[i]) > BATCH:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield part


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, longest first, as one array ordered by place in the text; the offset and the width of each place."""
    lengths = np.array([len(t) for t in texts])
    width = len(texts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
    offset = np.concatenate([[0], np.cumsum(width)])
    flat = np.empty(offset[-1], np.int64)
    for i, t in enumerate(texts):
        flat[offset[: len(t)] + i] = t
    return flat, offset, width


def forward(model: Hmm, seen: np.ndarray, offset: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and the scales; the logarithms of a text's scales add up to its log-likelihood."""
    alpha, scale = np.empty_like(seen), np.empty(len(seen))
    for t in range(len(width)):
        at, n = offset[t], width[t]
        a = alpha[at : at + n]
        np.multiply(model.start if t == 0 else alpha[offset[t - 1] : offset[t - 1] + n] @ model.moves, seen[at : at + n], out=a)
        s = a.sum(axis=1)
        scale[at : at + n] = s
        a /= s[:, None]
    return alpha, scale


def expected_counts(model: Hmm, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of texts, by the scaled forward-backward recursion."""
    k = len(model.start)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emits)
    for part in batches_of(texts):
        flat, offset, width = laid_out([texts[i] for i in part])
        seen = model.emits[flat]
        alpha, scale = forward(model, seen, offset, width)
        beta = np.ones_like(alpha)
        for t in range(len(width) - 1, 0, -1):
            at, n, before = offset[t], width[t], offset[t - 1]
            x = seen[at : at + n] * beta[at : at + n]
            x /= scale[at : at + n, None]
            np.matmul(x, model.moves.T, out=beta[before : before + n])
            moves += alpha[before : before + n].T @ x
        alpha *= beta
        starts += alpha[: width[0]].sum(axis=0)
        for j in range(k):
            emits[:, j] += np.bincount(flat, alpha[:, j], len(emits))
    return starts, moves * model.moves, emits


def improved(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Hmm:
    """The model with the expected counts, smoothed so that everything stays possible."""
    share = emits.sum(axis=1, keepdims=True) + 0.5
    emits = emits + 0.01 * share / share.sum() * len(share)
    return Hmm((starts + 1) / (starts + 1).sum(), (moves + 1) / (moves + 1).sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def texts_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def train(coded: DataFrame, symbols: int, rounds: int = ROUNDS, states: int = STATES) -> Hmm:
    """Baum-Welch over all rows of ``coded(symbols)``; expected counts are added up across partitions."""
    draw = np.random.default_rng(5)
    model = improved(np.zeros(states), draw.random((states, states)) * 10, draw.random((symbols, states)) + 0.5)
    for _ in range(rounds):

        def run(batches, model=model):
            total = None
            for batch in batches:
                found = expected_counts(model, texts_of(batch.column(0)))
                total = found if total is None else [a + b for a, b in zip(total, found, strict=True)]
            if total is not None:
                flat = np.concatenate([x.ravel() for x in total])
                held = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(flat[held])], ["at", "x"])

        flat = np.zeros(states + states * states + symbols * states)
        for r in coded.select("symbols").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            flat[r["at"]] = r.x
        a, b = states, states + states * states
        model = improved(flat[:a], flat[a:b].reshape(states, states), flat[b:].reshape(symbols, states))
    return model


def likelihoods(coded: DataFrame, model: Hmm, keep: dict[str, str]) -> DataFrame:
    """``keep`` and ``log10_likelihood`` of the symbols of every row."""

    def run(batches):
        for batch in batches:
            texts, out = texts_of(batch.column(len(keep))), np.zeros(batch.num_rows)
            for part in batches_of(texts):
                flat, offset, width = laid_out([texts[i] for i in part])
                _, scale = forward(model, model.emits[flat], offset, width)
                place = np.arange(len(flat)) - np.repeat(offset[:-1], width)
                out[part] = np.bincount(place, np.log10(scale), len(part))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*keep, "log10_likelihood"])

    return coded.select(*keep, "symbols").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in keep.items()) + ", log10_likelihood double")


def score(docs: DataFrame, learning: str) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)``; rows where the boolean column ``learning`` is true teach the model.

    A null text is empty and has one token, its end. Repeated rows are scored one by one, null ids
    stay null. Without any learning row all counts are zero.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(learning).alias("learning"))
    counts = stored(count_words(docs.where("learning")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    ends = counts.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    lex = lexicon(counts)
    keep = {"rid": "long", "doc_id": "long", "learning": "boolean"}
    coded = stored(encode(docs.withColumn("rid", F.monotonically_increasing_id()), lex, keep), "coded")
    model = train(coded.where("learning"), lex.symbols)
    numbers = ["n_tokens", "logs", "known", "class_logs"]
    keep |= {"n_tokens": "long", "logs": "double", "known": "long", "class_logs": "double"}
    scored = likelihoods(coded, model, keep)
    rest = coded.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("rid", F.col("x.rest").alias("word"), F.col("x.times").alias("n"))
    c = F.coalesce("c", F.lit(0))
    sums = rest.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("rest_logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rest_known"))
    whole = float(np.log10(total + 0.5 * (distinct + 1)))
    rest_logs = F.coalesce("rest_logs", F.lit(0.0))
    return scored.join(sums, "rid", "left").select(
        "doc_id",
        "learning",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + rest_logs + float(np.log10(ends + 0.5)) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("log10_likelihood") + F.col("class_logs") + rest_logs).alias("score"),
    )


def op2_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model that those not held out teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_remainder("doc_id", 5) != 1).alias("learning"))
    return score(docs, "learning").withColumn("held_out", ~F.col("learning")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
