"""SimHash near-duplicate groups, searched exactly with vantage-point trees.

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit of their
upper or of their lower 32 bits. So two trees, one on each half, with a search radius of one bit
find every link. The nodes of one level of a tree share a vantage point, and have a branch for every
distance from it. By the triangle inequality a partner within one bit is in the same branch or in one beside it,
at every level; a half-fingerprint is copied only to those leaves that a partner can really be in,
a dozen or so however deep the tree is, and the tree is as deep as the number of fingerprints asks for.
The leaves are the shards: each is searched on its own, comparing whole fingerprints. A leaf that
is too large for one task is dealt again by the bits of the other half.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.components import connected_components
from lodestar.llm.copies import first_copies, mark
from lodestar.llm.rows import named
from lodestar.sources.tables import stored, table

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints wanted in a leaf, bits that a level tells apart (about), rows of leaves that a task searches at once.
LEAF, LEVEL_BITS, GROUP_ROWS = 64, 3.0, 100_000
#: Rows from which a leaf is dealt again, and how often that is done.
HOT, ROUNDS = 20_000, 4
#: Vantage points, by side and level.
VANTAGE = np.random.default_rng(SEED).integers(0, 2**32, (2, 11), dtype=np.uint32)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text as a signed 64-bit integer; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
    else:
        words = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    n, votes = len(words), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every document, ``fp`` a signed long."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x, shingle) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def half(fps: np.ndarray, side: int) -> np.ndarray:
    return ((fps.view(np.uint64) >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def levels_for(total: int) -> int:
    """Levels at which leaves have about ``LEAF`` of ``total`` fingerprints; a level parts them some ten ways."""
    return int(np.clip(np.ceil(np.log2(max(total, 1) / LEAF) / LEVEL_BITS), 1, len(VANTAGE[0])))


def branch(parts: np.ndarray, side: int, levels: int) -> np.ndarray:
    """The leaf of each half-fingerprint: its distances to the vantage points of the levels, and the side."""
    key = np.zeros(len(parts), np.int64)
    for vantage in VANTAGE[side][:levels]:
        key = key * 33 + np.bitwise_count(parts ^ vantage)
    return key * 2 + side


def place(fps: np.ndarray, side: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which fingerprints go to which leaves, as ``(index, leaf, home)``; every one has one home leaf.

    A partner one bit away is one step nearer or farther at every level, so it is in one of few leaves. Of two
    partners the one that has a zero in that bit is copied to the other's leaf, if that is not its own.
    """
    parts = half(fps, side)
    home = branch(parts, side, levels)
    index, leaf = [], []
    for bit in range(32):
        own = np.flatnonzero((parts >> np.uint32(bit)) & np.uint32(1) == 0)
        to = branch(parts[own] | np.uint32(1 << bit), side, levels)
        other = to != home[own]
        index.append(own[other])
        leaf.append(to[other])
    copies = np.stack([np.concatenate(index), np.concatenate(leaf)])
    order = np.lexsort(copies)
    copies = copies[:, order]
    copies = copies[:, np.concatenate([[True], (np.diff(copies) != 0).any(axis=0)])[: copies.shape[1]]]
    index = np.concatenate([np.arange(len(fps)), copies[0]])
    return index, np.concatenate([home, copies[1]]), np.arange(len(index)) < len(fps)


def link_leaf(fps: np.ndarray, homes: int, bits: int = MAX_BITS, block: int = 512) -> np.ndarray:
    """For each fingerprint of a leaf, the least index that links reach; the first ``homes`` are at home, and pairs without such an end are left to other leaves."""
    own, root = fps.view(np.uint64), np.arange(len(fps))

    def top(x: np.ndarray) -> np.ndarray:
        while ((up := root[x]) != x).any():
            x = up
        return x

    for at in range(0, homes, block):
        for lo in range(at, len(own), 4096):
            a, b = np.nonzero(np.bitwise_count(own[at : min(at + block, homes), None] ^ own[None, lo : lo + 4096]) <= bits)
            a, b = top(a + at), top(b + lo)
            while (a != b).any():
                a, b = a[a != b], b[a != b]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                root = top(root)
                a, b = root[a], root[b]
    return top(root)


def links_of_leaves(leaf: np.ndarray, home: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every group of every leaf: each fingerprint of a leaf has one link at most there."""
    order = np.lexsort((~home, leaf))
    leaf, home, fps = leaf[order], home[order], fps[order]
    cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
    homes = np.add.reduceat(home.astype(np.int64), cuts[:-1]) if len(leaf) else np.zeros(0, np.int64)
    found = []
    for s, e, n in zip(cuts[:-1].tolist(), cuts[1:].tolist(), homes.tolist(), strict=True):
        if n and e - s > 1:
            root = link_leaf(fps[s:e], n)
            linked = np.flatnonzero(root != np.arange(e - s))
            if len(linked):
                found.append((fps[s + linked], fps[s + root[linked]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def narrowed(leaf: np.ndarray, left: np.ndarray, home: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, ...]:
    """Deal the fingerprints of too large leaves again: ``left`` masks those bits of the other half that they may still differ in.

    The bits go in ``MAX_BITS + 1`` groups, one of which two linked fingerprints have in common: each
    fingerprint goes to a leaf for every group.
    """
    out = []
    for side in (0, 1):
        for mask in np.unique(left[leaf & 1 == side]).tolist():
            own = np.flatnonzero((left == mask) & (leaf & 1 == side))
            rest = half(fps[own], 1 - side).astype(np.int64)
            for g, group in enumerate(np.array_split([b for b in range(32) if mask >> b & 1], MAX_BITS + 1)):
                bits = sum(1 << int(b) for b in group)
                key = (leaf[own].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((rest & bits) * 4 + g).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                key = ((key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(2)
                out.append((key.view(np.int64) * 2 + side, np.full(len(own), mask & ~bits), home[own], fps[own]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints ``fps(fp)`` that span every group of a leaf.

    Every fingerprint is placed in both trees, whose depth follows from the number of fingerprints. A
    leaf of more than ``hot`` rows is dealt again, up to ``ROUNDS`` times, by bits of the other half. A leaf gives
    each of its fingerprints one link at most, so that a dense group never becomes all its pairs.
    """
    spark, total = fps.sparkSession, fps.count()
    if total < 2:
        return spark.createDataFrame([], "a long, b long")
    levels, schema = levels_for(total), "leaf long, left long, home boolean, fp long"

    def deal(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for side in (0, 1):
                for at in range(0, len(own), 4096):
                    part = own[at : at + 4096]
                    index, leaf, home = place(part, side, levels)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (leaf, np.full(len(leaf), 0xFFFFFFFF), home, part[index])], ["leaf", "left", "home", "fp"])

    def again(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in narrowed(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))], ["leaf", "left", "home", "fp"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = links_of_leaves(pdf["leaf"].to_numpy(np.int64), pdf["home"].to_numpy(bool), pdf["fp"].to_numpy(np.int64))
        return pd.DataFrame({"a": a, "b": b})

    dealt, found = fps.mapInArrow(deal, schema), None
    for turn in range(ROUNDS + 1):
        large = None
        if turn < ROUNDS:
            large = stored(dealt.groupBy("leaf").count().where(F.col("count") > hot).select("leaf"), "large")
            large = large if large.head(1) else None
        small = dealt if large is None else dealt.join(large, "leaf", "left_anti")
        group = F.pmod(F.xxhash64("leaf"), F.lit(max(1, total * 16 // GROUP_ROWS)))
        own = small.withColumn("bucket", group).groupBy("bucket").applyInPandas(search, "a long, b long")
        found = own if found is None else found.unionByName(own)
        if large is None:
            return found
        dealt = stored(dealt.join(large, "leaf", "left_semi").select("leaf", "left", "home", "fp").mapInArrow(again, schema), "dealt")
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Null and empty texts have fingerprint zero and link to one another. Rows with equal texts have
    equal fingerprints. Rows without an id keep their fingerprint; the component's id is the least
    id that is not null. Repeated rows are kept. Other columns are not read.
    """
    own = stored(fingerprints(docs, shingle), "fingerprints")
    ids = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(ids.select("fp")))
    grouped = ids.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "root").join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least doc_id that links reach."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the row with the least id, and of rows that share it the one whose text has the least mark.

    An id is no proof of a text: rows with one id and different texts are judged each by its text, and of rows that are alike in id and text one stays. Rows without an
    id come after all others in a group.

    Sets of five-word shingles at a Jaccard similarity of 0.8 differ in about ten bits of 64: three
    bits, op8's contract, miss most of them, and a radius that holds them prunes nothing in a tree.
    So candidates come from least hashes here, and whole shingle sets decide.
    """
    own, row = named(docs)
    name = f"{row}_mark"
    while name in docs.columns:
        name += "_"
    kept = stored(first_copies(own.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("mark").alias(name)), "kept")
    return own.withColumn(name, mark(F.col("text"))).join(kept, [row, name], "left_semi").dropDuplicates([row, name]).select(*docs.columns)
