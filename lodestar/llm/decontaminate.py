"""Benchmark decontamination by spaced seeds: fixed masks that ignore some token positions.

Each mask hashes the tokens at its positions, from every place of every benchmark item and of every
document. A substituted token leaves those hashes alone whose mask ignores it. Hashes that meet give
an item, a document and a shift between them; at that shift the item is compared token by token,
and the overlap counts if enough of it agrees. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.rows import named
from lodestar.sources.tables import stored, table

#: Masks of weight six; each begins at its first token.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 2, 3, 5, 7, 8), (0, 1, 4, 6, 7, 9))
WEIGHT = 6
#: The least number of agreeing tokens, and the least share of the compared ones that agree.
LEAST_TOKENS, LEAST_SHARE = 10, 0.8
SPACE = r"[\x20\x09-\x0D]+"
#: Benchmark seeds that may be broadcast (24 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SEEDS = 2_000_000


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words; a null text has none."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, keep: list[str], tokens: str, at: str, masks: dict[int, tuple[int, ...]]) -> DataFrame:
    """``keep``, the place ``at``, ``mask`` and ``seed``, a row for every mask, by its number, that fits at every place of the array ``tokens``.

    A place takes with it the tokens that a mask can reach, not the whole array, so the work grows with a text's length and not with its square.
    """
    n = F.size(tokens)
    reach = max(m[-1] for m in masks.values()) + 1
    beside = F.arrays_zip(*[(F.col(tokens) if i == 0 else F.slice(F.col(tokens), F.lit(i + 1), F.greatest(n - i, F.lit(0)))).alias(f"t{i}") for i in range(reach)])
    placed = rows.select(*keep, F.posexplode(beside).alias(at, "_near"))
    hashes = [F.struct(F.lit(i).alias("mask"), F.when(F.col(f"_near.t{m[-1]}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"_near.t{p}") for p in m])).alias("seed")) for i, m in masks.items()]
    return placed.select(*keep, at, F.explode(F.array(*hashes)).alias("_s")).select(*keep, at, "_s.mask", "_s.seed").where("seed IS NOT NULL")


def shifts(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shifts at which seeds of ``docs(row, text)`` and of ``items(key, b)`` meet, ``row, key, shift, low, high``, stored, and the same rows with the text's token hashes ``d`` and the item's ``b``.

    ``low`` and ``high`` are where the first agreeing seed of the item begins and the last ends. Items shorter than ``WEIGHT`` tokens have one seed, all
    their tokens; items too short for ``LEAST_TOKENS`` at ``LEAST_SHARE`` also have every third place's three tokens, more disjoint pieces than may differ. Texts come back only for rows that met.
    """
    n = F.size("b")
    masks = dict(enumerate((*MASKS, *[tuple(range(k)) for k in range(1, WEIGHT)])))
    whole = (F.col("mask") == len(MASKS) + n - 1) & (F.col("at") == 0)
    piece = (F.col("mask") == len(MASKS) + 2) & (F.col("at") % 3 == 0) & (n * LEAST_SHARE <= LEAST_TOKENS)
    wanted = seeds(items, ["key", "b"], "b", "at", masks).where(F.when(n < WEIGHT, whole).otherwise((F.col("mask") < len(MASKS)) | piece)).select("key", "at", "mask", "seed")
    wanted = stored(wanted, "seeds")
    known = wanted.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()
    used = {i: m for i, m in masks.items() if i == 0 or i in {r["mask"] for r in known}}
    wanted = wanted.select("key", "at", F.element_at(F.array(*[F.lit(m[-1] + 1) for m in masks.values()]), F.col("mask") + 1).alias("span"), "seed")
    if sum(r.n for r in known) <= BROADCAST_SEEDS:
        wanted = F.broadcast(wanted)
    left = docs.withColumn("d", token_hashes(F.col("text").cast("string")))
    placed = seeds(left, ["row"], "d", "pos", used).drop("mask")
    met = placed.join(wanted, "seed").groupBy("row", "key", (F.col("pos") - F.col("at")).alias("shift")).agg(F.min("at").alias("low"), F.max(F.col("at") + F.col("span")).alias("high"))
    met = stored(met, "shifts")
    few = met.count() <= BROADCAST_SEEDS
    texts = docs.join(F.broadcast(met) if few else met, "row").withColumn("d", token_hashes(F.col("text").cast("string"))).drop("text")
    return met, texts.join(F.broadcast(items) if few else items, "key")


def agreeing(b: str = "b", d: str = "d") -> Column:
    """The places of the item whose token the text has at the shift, ascending."""
    return F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.get(F.col(b), i) == F.get(F.col(d), i + F.col("shift")))


def items_of(items: DataFrame) -> DataFrame:
    """``key, b`` of the distinct non-empty token sequences of ``items(text)``."""
    right = items.select(token_hashes(F.col("text").cast("string")).alias("b")).where(F.size("b") > 0)
    return right.withColumn("key", F.xxhash64("b")).dropDuplicates(["key"])


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, matched, compared, start, item_start`` for every document and item that overlap.

    At each shift at which seeds meet, the stretch of the item from the first to the last agreeing
    seed is compared token by token. It counts if ``LEAST_TOKENS`` of its tokens agree (or as many as
    the item has, if fewer) and ``LEAST_SHARE`` of them. The shift with the most agreeing tokens
    stands for the pair, then the shortest stretch, then the first place. Items of fewer tokens than
    a mask's must stand there in full. Null texts have no tokens, and items without a token are never found. Rows with equal ids,
    null or not, are one document, so repeated rows change nothing; other columns are not read.
    """
    own = rows_of(docs)
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(token_hashes(F.col("text").cast("string"))).alias("key")).distinct()
    _, met = shifts(own.dropDuplicates(["row"]).select("row", "text", "doc_id"), items_of(items))
    matched = F.size(F.filter(agreeing(), lambda i: (i >= F.col("low")) & (i < F.col("high"))))
    held = met.select("doc_id", "key", "shift", "low", F.size("b").alias("length"), matched.alias("matched"), (F.col("high") - F.col("low")).alias("compared"))
    held = held.where((F.col("matched") >= F.least(F.lit(LEAST_TOKENS), F.col("length"))) & (F.col("matched") >= F.col("compared") * LEAST_SHARE)).join(named, "key")
    best = held.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", -F.col("compared"), -(F.col("low") + F.col("shift")), -F.col("low"))).alias("x"))
    names = ["matched", "compared", "start", "item_start"]
    return best.select("doc_id", "item_id", *[(F.col(f"x.{f}") * (1 if n == "matched" else -1)).cast("long").alias(n) for n, f in zip(names, ["matched", "col2", "col3", "col4"], strict=True)])


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id)``: the documents with a stretch of some item in which enough tokens agree.

    Each stretch at a shift is judged by itself: it counts if ``LEAST_TOKENS`` of its tokens agree (or
    ``LEAST_SHARE`` of the item's, if that is fewer) and ``LEAST_SHARE`` of the stretch. Items with fewer
    tokens than a mask's weight must stand there in full. Items too short for ``LEAST_TOKENS`` are sought by
    more disjoint pieces of three tokens than may differ, so every such stretch of them is found.
    """
    own = rows_of(docs)
    _, met = shifts(own.select("row", "text", "doc_id"), items_of(items))
    n = F.size("b")
    least = F.when(n < WEIGHT, n).otherwise(F.least(F.lit(LEAST_TOKENS), F.ceil(n * LEAST_SHARE))).cast("int")
    met = met.withColumn("least", least).withColumn("agree", agreeing())
    agree, need = F.col("agree"), F.col("least")
    # a stretch of twice as many agreeing tokens halves into two, of which one agrees as well
    dense = lambda x, k: F.coalesce(k >= (F.get(agree, x + k - 1) - F.get(agree, x) + 1) * LEAST_SHARE, F.lit(False))
    held = F.exists(F.sequence(F.lit(0), F.size(agree) - need), lambda x: F.exists(F.sequence(need, 2 * need - 1), lambda k: dense(x, k)))
    return met.where(F.when(F.size(agree) >= need, held).otherwise(F.lit(False))).select("doc_id").distinct()


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap."""
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no stretch of a benchmark item; rows with one id, or without an id and with one text, go together."""
    own, row = named(docs)
    found = contaminated(own.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row))
    return own.join(found, row, "left_anti").select(*docs.columns)
