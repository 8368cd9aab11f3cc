"""Alignment of two tokenizers: tokens whose byte ranges fall in one group are linked, and pairs of ids are counted over the corpus.

Counting is external. Each task sorts its records (pair of ids, document, times) and deals them by the
radix of the first tokenizer's id to compressed runs, which are written to the shared folder. A bucket's runs are merged
``FAN`` at a time by a heap of their blocks, until every pair's count of documents is known; pairs come in order of the
first id, so each id's highest count is known when its last pair has passed. Then a bucket's runs, dealt in
parts of bounded size, are streamed by the bucket's counts, and what each document gains goes back to it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.units import Memory, Ragged, single_threaded, slices
from lodestar.sources.tables import stored, table

#: Buckets; runs merged together; records sorted together; pairs in a block of a run; bytes of runs that one part of a bucket has.
BUCKETS, FAN, RECORDS, PAIRS, PART_BYTES = 64, 256, 1 << 20, 1 << 14, 1 << 24
#: Distinct units that a worker remembers, and learns at once; texts, and units of them, that are looked at together.
REMEMBERED, TOGETHER, TEXTS, STEP = 200_000, 1 << 15, 1024, 1 << 19
#: How a piece writes a space.
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(SPACE, " ").encode()


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A token and of every B token: groups end where both end."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)


def links(b: np.ndarray, a_groups: np.ndarray, b_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All A-B pairs whose groups are equal: the place of the A token, and the B id."""
    low, high = np.searchsorted(b_groups, a_groups), np.searchsorted(b_groups, a_groups, "right")
    n = high - low
    ends = np.cumsum(n)
    return np.repeat(np.arange(len(n)), n), b[np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)]


def texts_of(strings: list[bytes]) -> np.ndarray:
    out = np.empty(len(strings), object)
    out[:] = strings
    return out


def lengths_of(rows: list) -> np.ndarray:
    return np.fromiter(map(len, rows), np.int64, len(rows))


def spells(table: Ragged, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """For each unit, of ``counts`` ids and ``sizes`` bytes of ``stream``, whether its ids' bytes are its own."""
    unit = np.repeat(np.arange(len(counts)), counts)
    same = np.bincount(unit, table.lengths(ids), len(counts)) == sizes
    got, own = table.take(ids[same[unit]]), np.repeat(same, sizes)
    wrong = np.flatnonzero(got != stream[own])
    same[np.repeat(np.flatnonzero(same), sizes[same])[wrong]] = False
    return same


class Aligner:
    """Two vocabularies and what they make of each distinct unit: ids, groups and links of a unit stay in it, as both end where it ends."""

    def __init__(self, a_path: str, b_path: str):
        single_threaded()
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        byte = byte_alphabet()
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [added[i] if i in added else bytes(byte[c] for c in self.a.id_to_token(i)) for i in range(self.n_a)]
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.n_b)]
        self.a_table, self.b_table = (Ragged.empty(np.uint8).grown(lengths_of(x), np.frombuffer(b"".join(x), np.uint8)) for x in (self.a_bytes, self.b_bytes))
        # ids as text with each mark that can follow them
        self.a_texts = {mark: texts_of([b"%d%s" % (i, mark) for i in range(self.n_a)]) for mark in (b",", b"|")}
        self.b_texts = {mark: texts_of([b"%d%s" % (i, mark) for i in range(self.n_b)]) for mark in (b",", b";", b"")}
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("a piece of the second vocabulary goes on over a space or line end")
        self.prefix = self.b.piece_to_id(SPACE)
        self.forget()

    def forget(self) -> None:
        self.memory = Memory(self.learn)
        self.sizes, self.whole, self.spelled = np.zeros((0, 4), np.int64), np.zeros(0, bool), []
        self.pairs, self.times = Ragged.empty(np.int64), Ragged.empty(np.int64)

    def learn(self, units: list[str]) -> None:
        for low in range(0, len(units), TOGETHER):
            self.learn_together(units[low : low + TOGETHER])

    def learn_together(self, units: list[str]) -> None:
        """Encode, compare, group and link ``units`` at once; a unit that begins with a line end has no space before it."""
        a_rows = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b_rows = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        b_rows = [y[1:] if u[0] == "\n" and y[0] == self.prefix else y for u, y in zip(units, b_rows, strict=True)]
        n_a, n_b, raw = lengths_of(a_rows), lengths_of(b_rows), [u.encode() for u in units]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a_rows, n_a), (b_rows, n_b)))
        sizes, stream = lengths_of(raw), np.frombuffer(b"".join(raw), np.uint8)
        whole = spells(self.a_table, a, n_a, sizes, stream) & spells(self.b_table, b, n_b, sizes, stream)
        a, b = a[np.repeat(whole, n_a)], b[np.repeat(whole, n_b)]
        n_a, n_b = n_a * whole, n_b * whole
        # both run over the same bytes, so their ends can be compared over all units at once
        a_groups, b_groups = groups(np.cumsum(self.a_table.lengths(a)), np.cumsum(self.b_table.lengths(b)))
        unit = np.repeat(np.arange(len(units)), n_a)
        at, y = links(b, a_groups, b_groups)
        pairs, times = np.unique(unit[at] * (self.n_a * self.n_b) + a[at] * self.n_b + y, return_counts=True)
        own = np.bincount(pairs // (self.n_a * self.n_b), minlength=len(units))
        last_a, last_b = np.diff(a_groups, append=-1) != 0, np.diff(b_groups, append=-1) != 0
        count = lambda x: np.bincount(x, minlength=len(units))
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, count(unit[last_a]), count(unit[at])], axis=1)])
        self.whole = np.concatenate([self.whole, whole])
        self.pairs, self.times = self.pairs.grown(own, pairs % (self.n_a * self.n_b)), self.times.grown(own, times)
        # the groups' ids in order: A's of a group, then B's
        said = np.empty(len(a) + len(b), object)
        said[np.arange(len(a)) + np.searchsorted(b_groups, a_groups)] = np.where(last_a, self.a_texts[b"|"][a], self.a_texts[b","][a])
        final = np.zeros(len(b), bool)
        final[np.cumsum(n_b)[n_b > 0] - 1] = True
        marked = np.where(final, self.b_texts[b""][b], np.where(last_b, self.b_texts[b";"][b], self.b_texts[b","][b]))
        said[np.arange(len(b)) + np.searchsorted(a_groups, b_groups, "right")] = marked
        said, ends = said.tolist(), np.cumsum(n_a + n_b).tolist()
        self.spelled += [b"".join(said[s:e]) for s, e in zip([0, *ends], ends)]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """A worker's vocabularies, kept between its tasks."""
    return Aligner(a_path, b_path)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` in order and the sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values, first)


def squeezed(numbers: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype(kind).tobytes())


def restored(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind).astype(np.int64)


def blocks(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run of pairs with their counts, in blocks that are compressed one by one."""
    out = []
    for at in range(0, len(keys), PAIRS):
        k = keys[at : at + PAIRS]
        block = squeezed(np.concatenate([np.diff(k, prepend=0), counts[at : at + PAIRS]]), "<i8")
        out.append(len(block).to_bytes(4, "little") + block)
    return b"".join(out)


def unblocked(data: memoryview | bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        both = restored(data[at + 4 : at + 4 + n], "<i8")
        yield np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]
        at += 4 + n


def merged(runs: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of sorted ``runs`` in order, each once with the sum of its counts; a block of each run is in memory.

    The heap holds the last pair of each run's block; up to the least of them all runs have shown what they hold.
    """
    live, heap = {}, []

    def load(r: int, run: Iterator) -> None:
        for keys, counts in run:
            live[r] = keys, counts, run
            heapq.heappush(heap, (int(keys[-1]), r))
            return
        live.pop(r, None)

    for r, data in enumerate(runs):
        load(r, unblocked(data))
    while heap:
        bound, parts = heap[0][0], []
        for r in list(live):
            keys, counts, run = live[r]
            n = int(np.searchsorted(keys, bound, "right"))
            parts.append((keys[:n], counts[:n]))
            live[r] = keys[n:], counts[n:], run
        while heap and heap[0][0] == bound:
            r = heapq.heappop(heap)[1]
            load(r, live[r][2])
        yield summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def with_best(counted: Iterator[tuple[np.ndarray, np.ndarray]], n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of pairs in order with their counts and whether a count is the highest of its first id; an id's pairs are held until its last has come."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def judged(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], np.diff(k // n_b) > 0]))
        most = np.maximum.reduceat(c, first)
        return k, c, c == np.repeat(most, np.diff(np.append(first, len(k))))

    for more, n in counted:
        keys, counts = np.concatenate([keys, more]), np.concatenate([counts, n])
        done = int(np.searchsorted(keys, keys[-1] // n_b * n_b))
        if done:
            yield judged(keys[:done], counts[:done])
            keys, counts = keys[done:], counts[done:]
    if len(keys):
        yield judged(keys, counts)


DOCUMENT = "doc_id long, base long, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
RUN = "bucket int, keys binary, counts binary, docs binary, times binary"


class Spill:
    """A task's records, sorted and dealt to runs when there are ``RECORDS`` of them."""

    def __init__(self, task: int, n_b: int):
        self.task, self.n_b, self.number = task, n_b, 0
        self.clear()

    def clear(self) -> None:
        self.keys, self.docs, self.times, self.rows, self.n = [], [], [], [], 0

    @property
    def base(self) -> int:
        """Names this task's current runs."""
        return (self.task << 32) + self.number

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        """The records of the next document."""
        self.keys.append(keys)
        self.times.append(times)
        self.docs.append(np.full(len(keys), len(self.rows), np.int64))
        self.n += len(keys)

    def runs(self) -> Iterator[tuple]:
        if not self.n:
            return
        keys, docs, times = np.concatenate(self.keys), np.concatenate(self.docs), np.concatenate(self.times)
        radix = keys // self.n_b % BUCKETS
        order = np.argsort(radix * np.int64(1 << 48) + keys, kind="stable")
        keys, docs, times, radix = keys[order], docs[order], times[order], radix[order]
        edges = np.searchsorted(radix, np.arange(BUCKETS + 1))
        for bucket, (low, high) in enumerate(zip(edges, edges[1:])):
            if low < high:
                pairs, n = np.unique(keys[low:high], return_counts=True)
                yield bucket, blocks(pairs, n), squeezed(n, "<i8"), squeezed(docs[low:high], "<i4"), squeezed(times[low:high], "<i8")

    def flushed(self) -> Iterator[pa.RecordBatch]:
        """Documents and runs as rows, and a fresh start."""
        names = [f.split()[0] for f in f"{DOCUMENT}, {RUN}".split(", ")]
        types = {"doc_id": pa.int64(), "base": pa.int64(), "place": pa.int32(), "bucket": pa.int32(), "groups_sha256": pa.string()}
        kinds = [types.get(n, pa.int64() if n.startswith("n_") else pa.binary()) for n in names]
        rows = [(doc, self.base, i, *sizes, None, None, None, None, None) for i, (doc, *sizes) in enumerate(self.rows)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)
        for run in self.runs():
            row = (None, self.base, None, None, None, None, None, None, *run)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)
        self.number += 1
        self.clear()


class Open:
    """The document that is being read: sums, digest and records so far; ``whole`` until a unit's bytes differ."""

    def __init__(self):
        self.sizes, self.digest, self.whole, self.units = np.zeros(4, np.int64), None, True, []

    def add(self, tokens: Aligner, numbers: np.ndarray) -> None:
        if not len(numbers) or not self.whole:
            return
        if not tokens.whole[numbers].all():
            self.sizes, self.digest, self.whole, self.units = np.zeros(4, np.int64), None, False, []
            return
        self.sizes = self.sizes + tokens.sizes[numbers].sum(axis=0)
        text = b";".join(map(tokens.spelled.__getitem__, numbers.tolist()))
        if self.digest is None:
            self.digest = hashlib.sha256(text)
        else:
            self.digest.update(b";" + text)
        units, n = np.unique(numbers, return_counts=True)
        pairs, times = tokens.pairs.take(units), tokens.times.take(units) * np.repeat(n, tokens.pairs.lengths(units))
        self.units = [summed(np.concatenate([pairs, *(u[0] for u in self.units)]), np.concatenate([times, *(u[1] for u in self.units)]))]

    def closed(self, doc: int | None, spill: Spill) -> None:
        if self.units:
            spill.add(*self.units[0])
        spill.rows.append((doc, *self.sizes.tolist(), self.digest.hexdigest() if self.digest else ""))


def spilled(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents and rows of runs, written to the shared folder: one pass over all texts."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = aligner(a_path, b_path)
        spill = Spill(TaskContext.get().partitionId(), tokens.n_b)
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            ids, now = batch.column(0).to_pylist(), Open()
            for part in slices(spaced(batch.column(1)), STEP):
                if tokens.memory.full(REMEMBERED):
                    tokens.forget()
                numbers = tokens.memory.numbers(part.units)
                edges = np.concatenate([[0], np.cumsum(part.counts)])
                for row, low, high, ended in zip(part.rows.tolist(), edges[:-1].tolist(), edges[1:].tolist(), part.ends.tolist(), strict=True):
                    now.add(tokens, numbers[low:high])
                    if ended:
                        now.closed(ids[row], spill)
                        now = Open()
                        if spill.n >= RECORDS:
                            yield from spill.flushed()
        yield from spill.flushed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, f"{DOCUMENT}, {RUN}"), "runs")


def spaced(texts: pa.Array) -> pa.Array:
    """A space before every text that is not null or empty."""
    import pyarrow.compute as pc

    texts = texts.cast(pa.string()).fill_null("")
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))


def pair_counts(runs: DataFrame, n_b: int, fan: int = FAN) -> DataFrame:
    """``(bucket, keys, best)``: for each bucket one sorted run of its pairs with their counts, and a bit for each whether it is its first id's highest.

    Runs are merged ``fan`` at a time, round by round; a run of a bucket never has more pairs than the two vocabularies allow.
    """

    def once(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        found = list(merged([x.as_buffer() for x in part.column("keys")]))
        data = b"".join(blocks(*f) for f in found)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "base": pa.array([key[1].as_py()], pa.int64()), "keys": pa.array([data], pa.binary())})

    def last(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        data, best = [], []
        for keys, counts, most in with_best(merged([x.as_buffer() for x in part.column("keys")]), n_b):
            data.append(blocks(keys, counts))
            best.append(most)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([b"".join(data)], pa.binary()), "best": pa.array([squeezed(np.packbits(np.concatenate(best)), "u1")], pa.binary())})

    # numbered from 0 within a bucket by (bucket, base): a count of a few rows a task, not of records
    live = runs.select("bucket", "base", "keys")
    most = most_runs(live)
    while most > fan:
        parts = -(-most // fan)
        live = stored(live.withColumn("base", F.pmod(F.xxhash64("base"), F.lit(parts))).groupBy("bucket", "base").applyInArrow(once, "bucket int, base long, keys binary"), "merged")
        most = most_runs(live)
    return stored(live.groupBy("bucket").applyInArrow(last, "bucket int, keys binary, best binary"), "counts")


def most_runs(runs: DataFrame) -> int:
    return runs.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0


def contributions(runs: DataFrame, counts: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(base, place, n_best, count_sum)`` by document and bucket: its links whose count is their first id's highest, and the sum of its links' counts.

    A bucket's runs are dealt to parts of about ``part_bytes``; each part gets the bucket's counts once.
    """

    def gains(runs: pa.Table, counts: pa.Table) -> pa.Table:
        out = {"base": [], "place": [], "n_best": [], "count_sum": []}
        if runs.num_rows:
            found = list(unblocked(counts.column("keys")[0].as_buffer()))
            keys, n = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            best = np.unpackbits(restored(counts.column("best")[0].as_buffer(), "u1").astype(np.uint8), count=len(keys)).astype(bool)
            for base, own, per, docs, times in zip(*(runs.column(c) for c in ("base", "keys", "counts", "docs", "times")), strict=True):
                at = np.concatenate([np.searchsorted(keys, k) for k, _ in unblocked(own.as_buffer())])
                at = np.repeat(at, restored(per.as_buffer(), "<i8"))
                docs, times = restored(docs.as_buffer(), "<i4"), restored(times.as_buffer(), "<i8")
                who = np.unique(docs)
                sums = np.zeros((2, int(who[-1]) + 1), np.int64)
                np.add.at(sums[0], docs, times * best[at])
                np.add.at(sums[1], docs, times * n[at])
                out["base"].append(np.full(len(who), base.as_py()))
                out["place"].append(who.astype(np.int32))
                out["n_best"].append(sums[0, who])
                out["count_sum"].append(sums[1, who])
        kinds = {"base": np.int64, "place": np.int32, "n_best": np.int64, "count_sum": np.int64}
        return pa.table({k: np.concatenate([np.zeros(0, kinds[k]), *v]) for k, v in out.items()})

    size = runs.groupBy("bucket").agg(F.ceil(F.sum(F.length("docs") + F.length("times") + F.length("keys")) / part_bytes).cast("int").alias("parts"))
    dealt = runs.join(F.broadcast(size), "bucket").withColumn("part", F.pmod(F.xxhash64("base"), "parts").cast("int"))
    spread = counts.join(F.broadcast(size), "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = dealt.select("bucket", "part", "base", "keys", "counts", "docs", "times").groupBy("bucket", "part")
    return left.cogroup(spread.select("bucket", "part", "keys", "best").groupBy("bucket", "part")).applyInArrow(gains, "base long, place int, n_best long, count_sum long")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row of ``docs(doc_id, text)``.

    Special tokens' strings are plain text. Texts that are null, empty or not given back by the tokens' bytes have zeros and an empty digest.
    Each row is a document, rows without an id and rows of one id too. An empty table gives no row.
    """
    rows = spilled(docs, a_path, b_path)
    runs = rows.where(F.col("bucket").isNotNull())
    n_b = aligner(a_path, b_path).n_b
    counts = pair_counts(runs, n_b)
    gained = contributions(runs, counts).groupBy("base", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    known = rows.where(F.col("bucket").isNull()).select("doc_id", "base", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(gained, ["base", "place"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    return known.withColumns(zero).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` in the byte-level (A) and the piece vocabulary (B); nulls, repeats and empty tables as :func:`aligned` states. Other columns are not read."""
    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
