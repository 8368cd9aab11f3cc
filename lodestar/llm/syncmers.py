"""Closed syncmers over words: context-free anchors, chosen by looking inside a k-mer only, and matched by position.

A k-mer of ``K`` words is an anchor if the least hash among its inner ``S``-word substrings is that
of the first or of the last. The choice depends on the k-mer's own words alone, so an edit changes
only the anchors that overlap it. Two texts are compared by the anchors that they have at one
common shift. All anchors of a text count, however long it is. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lodestar.sources.tables import table

K, S = 6, 2
INNER = K - S + 1
SPACE = r"[\x20\x09-\x0D]+"
#: Documents wanted in one range of ids, and how many ranges there are at most.
RANGE_ROWS, MOST_RANGES = 2000, 1 << 16


def with_anchors(df: DataFrame, text: str, out: str, tag: str = "_sync") -> DataFrame:
    """Add ``out``: the anchors of ``text`` as ``array<struct<pos int, hash bigint>>`` in order of position.

    Positions count words from zero. A text of one word or more in which no k-mer is picked, or that
    is shorter than ``K`` words, has one anchor at zero, its whole word sequence. Null and empty texts
    have none. Hashes have 31 bits.
    """
    words, h, s, picked = f"{tag}_w", f"{tag}_h", f"{tag}_s", f"{tag}_p"
    n = F.size(F.col(h))
    df = df.withColumn(words, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != ""))
    df = df.withColumn(h, F.transform(F.col(words), lambda w: F.xxhash64(w)))
    df = df.withColumn(s, F.when(n >= K, F.zip_with(F.slice(F.col(h), 1, n - 1), F.slice(F.col(h), 2, n - 1), lambda a, b: F.xxhash64(a, b))))
    v = F.col(s)

    def at_edge(i: Column) -> Column:
        inner = [F.get(v, i + j) for j in range(1, INNER - 1)]
        return F.least(F.get(v, i), F.get(v, i + (INNER - 1))) <= F.least(*inner)

    def anchor(i: Column) -> Column:
        return F.struct(i.alias("pos"), F.shiftrightunsigned(F.xxhash64(F.get(v, i), F.get(v, i + 2), F.get(v, i + 4)), 33).alias("hash"))

    whole = F.array(F.struct(F.lit(0).alias("pos"), F.shiftrightunsigned(F.xxhash64(F.col(h)), 33).alias("hash")))
    none = F.filter(whole, lambda _: F.lit(False))
    df = df.withColumn(picked, F.when(n >= K, F.transform(F.filter(F.sequence(F.lit(0), n - K), at_edge), anchor)).otherwise(none))
    return df.withColumn(out, F.when(n == 0, none).when(F.size(F.col(picked)) == 0, whole).otherwise(F.col(picked))).drop(words, h, s, picked)


def with_places(df: DataFrame, anchors: str, out: str) -> DataFrame:
    """Add ``out``: the distinct hashes of ``anchors`` with their first positions, ``hash * 2**32 + pos`` each, ascending."""
    every = f"{out}_every"
    df = df.withColumn(every, F.sort_array(F.transform(F.col(anchors), lambda a: F.shiftleft(a["hash"], 32).bitwiseOR(a["pos"].cast("long")))))
    first = F.filter(F.col(every), lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get(F.col(every), i - 1), 32)))
    return df.withColumn(out, first).drop(every)


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``: of the distinct anchors of two texts (``with_places``), the share that both have at one common shift.

    An anchor that both have counts if its shift is zero, or that of another anchor, too; if one of the
    texts has a single anchor, any shift does. Two texts without anchors are alike, so equal texts have 1.
    """
    both, shifts = f"{out}_both", f"{out}_shifts"
    marked = F.concat(F.transform(F.col(a), lambda x: F.shiftleft(x, 1)), F.transform(F.col(b), lambda x: F.shiftleft(x, 1).bitwiseOR(F.lit(1).cast("long"))))
    df = df.withColumn(both, F.sort_array(marked))
    x, n = F.col(both), F.size(F.col(both))
    met = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.shiftright(F.get(x, i), 33) == F.shiftright(F.get(x, i - 1), 33))

    def place(v: Column) -> Column:
        return F.shiftright(v, 1).bitwiseAND(F.lit((1 << 32) - 1).cast("long"))

    def shift(i: Column) -> Column:
        apart = place(F.get(x, i)) - place(F.get(x, i - 1))
        return F.when(F.get(x, i).bitwiseAND(F.lit(1).cast("long")) == 1, apart).otherwise(-apart)

    df = df.withColumn(shifts, F.when(n >= 2, F.sort_array(F.transform(met, shift))))
    s = F.col(shifts)
    held = F.size(F.filter(s, lambda y, i: (y == 0) | F.coalesce(y == F.get(s, i - 1), F.lit(False)) | F.coalesce(y == F.get(s, i + 1), F.lit(False))))
    common = F.when(n < 2, 0).when(F.least(F.size(F.col(a)), F.size(F.col(b))) == 1, F.size(s)).otherwise(held)
    return df.withColumn(out, F.when(n == 0, 1.0).otherwise(common / (n - common))).drop(both, shifts)


def hex_of(anchors: Column) -> Column:
    return F.array_join(F.transform(anchors, lambda a: F.lpad(F.lower(F.hex(a["hash"])), 8, "0")), "")


def beside_next(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, WindowSpec]:
    """Deal rows into ranges of ``key`` so that each row and its successor meet, and the window in which ``lead`` finds it.

    Rows are ordered by ``key``, then by a hash of ``text``, then by ``text``. Ranges are cut at
    quantiles of the key; a key that spans several quantiles is cut by the hash, so that one key with
    many texts fills many ranges. The first row of a range is also put, marked ``_ghost``, behind the
    last of the range before it; behind the last range comes the first row of all.
    """
    docs = docs.withColumn("_h", F.shiftrightunsigned(F.xxhash64(text), 1))
    total = docs.agg(F.count(F.lit(1))).first()[0]
    ranges = max(1, min(MOST_RANGES, total // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], max(10_000, 4 * ranges))).first()[0] if ranges > 1 else []
    bounds, at = [(-(2**63), 0, 1)], 1
    for cut in sorted(set(cuts)):
        parts = cuts.count(cut) if len(cuts) < 1000 else sum(1 for c in cuts if c == cut)
        bounds.append((cut, at, parts))
        at += parts + (parts > 1)
    step = 256
    coarse = F.array(*[F.lit(b).cast("long") for b, _, _ in bounds[::step]])
    k = F.col(key)

    def of(i: int, kind: str) -> Column:
        return F.array(*[F.array(*[F.lit(b[i]).cast(kind) for b in bounds[j : j + step]]) for j in range(0, len(bounds), step)])

    docs = docs.withColumn("_coarse", F.size(F.filter(coarse, lambda b: b <= k)) - 1)
    docs = docs.withColumn("_fine", F.size(F.filter(F.get(of(0, "long"), F.col("_coarse")), lambda b: b <= k)) - 1)
    low, first, parts = (F.get(F.get(of(i, kind), F.col("_coarse")), F.col("_fine")) for i, kind in enumerate(("long", "int", "int")))
    within = F.when(parts == 1, 0).when(k > low, parts).otherwise((F.col("_h") / float(2**63) * parts).cast("int"))
    docs = docs.withColumn("_in", first + F.least(within, parts)).drop("_coarse", "_fine")
    firsts = sorted((r["_in"], r.x["_key"], r.x["_h"]) for r in docs.groupBy("_in").agg(F.min(F.struct(k.alias("_key"), "_h")).alias("x")).collect())
    ghosts = docs.sparkSession.createDataFrame([(r, least, h, firsts[i - 1][0]) for i, (r, least, h) in enumerate(firsts)], "_in int, _first long, _fh long, _to int")
    begin = docs.join(F.broadcast(ghosts), "_in").where((k == F.col("_first")) & (F.col("_h") == F.col("_fh")))
    begin = begin.groupBy("_to").agg(F.min(text).alias(text)).select(F.col("_to").alias("_in"), text, F.lit(True).alias("_ghost"))
    dealt = docs.withColumn("_ghost", F.lit(False)).unionByName(begin, allowMissingColumns=True)
    return dealt, Window.partitionBy("_in").orderBy("_ghost", key, "_h", text)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``anchors`` and ``fingerprint`` (hex of all anchors' hashes, in order) for every row of ``docs(doc_id, text)``.

    A null text is the empty text, whose fingerprint is empty. Equal texts have equal anchors.
    Repeated rows are kept, other columns not read.
    """
    own = with_anchors(docs.select("doc_id", "text"), "text", "anchors")
    return own.select("doc_id", "anchors", hex_of(F.col("anchors")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs(doc_id, text)`` and of its edited text, and likenesses.

    The edited text has its last half replaced by the beginning of the next document's text, by
    ascending ``doc_id``; rows without an id come first, equal ids are ordered by a hash of the text, and after
    the last row comes the first. A null text is empty.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("_key", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    own, following = beside_next(own, "_key", "text")
    own = own.withColumn("_next", F.lead("text").over(following))
    own = own.withColumn("n_chars", F.length("text").cast("long"))
    cut = (F.col("n_chars") / 2).cast("int")
    own = own.withColumn("_edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut)))
    own = with_places(with_anchors(own, "text", "_a", "_ta"), "_a", "_pa").drop("_next")
    own = own.withColumn("_pn", F.lead("_pa").over(following)).where(~F.col("_ghost"))
    own = with_places(with_anchors(own, "_edited", "_b", "_tb"), "_b", "_pb")
    own = with_likeness(with_likeness(own, "_pa", "_pb", "near_edited"), "_pa", "_pn", "near_next")
    return own.select(
        "doc_id",
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        hex_of(F.col("_a")).alias("fingerprint"),
        hex_of(F.col("_b")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
