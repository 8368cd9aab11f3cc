"""Substring dedup: suffix automata of the repeated passages, and matching statistics of the documents against them.

Which windows of ``WINDOW`` words repeat is settled by counting, so that no frequent passage needs
all its places in one task; the automata then find the repeated passages in the texts by their words.
Every window is named by the least hash among its inner k-grams; runs of windows with one name are
counted by name, and only runs whose name recurs are looked at further. Their words make regions;
equal regions are one piece, met once. Pieces lie in shards, by the block of the least document that
shares a window's name, so that equal windows are in one shard, and no long copied text makes a shard
large. The windows of a shard are counted by a hash of 128 bits; of each repeated one, one place enters
the shard's reference. A shard with more than ``PART_WORDS`` words, because many texts share a name, is dealt
to several parts: its windows are counted across them, and its reference goes to each part. Each part
streams its pieces through the reference's automaton: words under a match of ``WINDOW`` words or more are removed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import stored, table

WINDOW = 35
#: Words of the k-grams that name windows; words of the blocks that names are assigned to; repeated words wanted in a shard, and words in one part of it.
GRAM, BLOCK_WORDS, SHARD_WORDS, PART_WORDS = 6, 4096, 60_000, 120_000
#: Bytes, and words, that are hashed together; keys of regions that a task remembers.
CHUNK, SPAN, HELD = 1 << 18, 1 << 17, 300_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Two independent hashes: a random number for each byte, and an odd base with its inverse.
BYTES = np.random.default_rng(35).integers(0, 2**64, (2, 256), dtype=np.uint64)
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = [(powers(b, 2 * CHUNK), powers(pow(b, -1, 1 << 64), 2 * CHUNK)) for b in BASES]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and where each row begins and the last ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word of texts that begin ``at``, and the one after its last; ASCII white space parts words."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = inside[edges + 1]
    last[edges - 1] = inside[edges]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of each word, from prefix sums of its bytes' numbers times powers of the base."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        n = int(ends[to - 1] - low)
        power, inverse = POWERS[lane] if n < 2 * CHUNK else (powers(BASES[lane], n + 1), powers(pow(BASES[lane], -1, 1 << 64), n + 1))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTES[lane][data[low : low + n]] * power[:n], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mixed((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive items, by doubling."""
    out, have, piece, length, power = None, 0, h, 1, MULTIPLIER
    while True:
        if width & length:
            if out is None:
                out, have = piece, length
            else:
                n = len(h) - have - length + 1
                out, have = out[:n] * power + piece[have : have + n], have + length
        length *= 2
        if length > width:
            return mixed(out[: len(h) - width + 1])
        n = len(h) - length + 1
        piece = piece[:n] * power + piece[length // 2 : length // 2 + n]
        power = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)


def least(g: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive items, by doubling."""
    have, n = 1, len(g) - width + 1
    while 2 * have <= width:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    return np.minimum(g[:n], g[width - have : width - have + n])


def window_runs(h: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of one text with one name: the names, the texts, the first windows, the numbers of windows, and whether the named k-gram is in the run more than once.

    ``bounds`` says at which of the words ``h`` texts begin and the last ends. Words are taken in spans of
    ``SPAN`` that overlap by a window less a word; a run that goes on in the next span is two.
    """
    found, width = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))], window - gram + 1
    for at in range(0, max(0, len(h) - window + 1), SPAN):
        part = h[at : at + SPAN + window - 1]
        grams = rolled(part, gram)
        names = least(grams, width)
        places = np.arange(at, at + len(names))
        whole = places + window <= bounds[np.searchsorted(bounds, places, "right")]
        new = np.concatenate([[True], names[1:] != names[:-1]])
        first = np.flatnonzero(whole & (new | ~np.concatenate([[False], whole[:-1]])))
        last = np.flatnonzero(whole & (np.append(new[1:], True) | ~np.append(whole[1:], False)))
        view = np.lib.stride_tricks.sliding_window_view(grams, width)
        left, right = first + view[first].argmin(axis=1), last + width - 1 - view[last][:, ::-1].argmin(axis=1)
        found.append((names[first], first + at, last - first + 1, left != right))
    names, first, n, twice = (np.concatenate(x) for x in zip(*found, strict=True))
    text = np.searchsorted(bounds, first, "right") - 1
    return names.view(np.int64), text, first - bounds[text], n, twice


def spans_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals, as sorted disjoint ones; those that only touch are joined."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def consecutive(starts: np.ndarray, ends: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Runs of windows, given by their first and last words, joined where the next window follows at once, so that no other window arises."""
    return [(s, e + window - 1) for s, e in spans_of(starts, ends - window + 1)]


class SuffixAutomaton:
    """The suffix automaton of several word sequences; state zero is the root."""

    def __init__(self) -> None:
        self.moves: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[bytes]) -> None:
        """Take in one sequence; a sequence that is a factor already adds nothing."""
        moves, link, length, last = self.moves, self.link, self.length, 0
        for word in words:
            q = moves[last].get(word)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            at, p = len(moves), last
            if q is None:
                moves.append({})
                length.append(length[last] + 1)
                link.append(0)
                while p >= 0 and word not in moves[p]:
                    moves[p][word] = at
                    p = link[p]
                if p < 0:
                    last = at
                    continue
                q = moves[p][word]
                if length[q] == length[p] + 1:
                    link[at], last = q, at
                    continue
            copy = len(moves)
            moves.append(dict(moves[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = copy
            if at < copy:
                link[at], last = copy, at
            else:
                last = copy
            while p >= 0 and moves[p].get(word) == q:
                moves[p][word] = copy
                p = link[p]

    def matches(self, words: list[bytes], shortest: int) -> list[tuple[int, int]]:
        """The union of the spans of ``words`` that the automaton knows and that have ``shortest`` words or more."""
        moves, link, length = self.moves, self.link, self.length
        out: list[list[int]] = []
        state = matched = 0
        for i, word in enumerate(words):
            to = moves[state].get(word)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = moves[state].get(word)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= shortest:
                start = i + 1 - matched
                if out and start <= out[-1][1]:
                    out[-1] = [min(start, out[-1][0]), i + 1]
                else:
                    out.append([start, i + 1])
        return [(s, e) for s, e in out]


def identified(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``rid`` and ``tag`` (together a hash of the row of 96 bits) and ``text``, in which a null is empty."""
    own = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.select(*keep, F.xxhash64(*keep, "text").alias("rid"), F.hash(*keep, "text").alias("tag"), "text")


def packed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``rid``, ``tag`` and the compressed text ``z`` of every row."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, at = bytes_of(batch.column(len(keep) + 2))
            z = [press.compress(data[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z, pa.binary())], [*keep, "rid", "tag", "z"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, z binary")


def runs(rows: DataFrame, window: int) -> DataFrame:
    """``name, rid, tag, start, n, twice`` of all runs of all rows of ``rows(rid, tag, text)``."""

    def run(batches):
        for batch in batches:
            data, at = bytes_of(batch.column(2))
            starts, ends = word_bounds(data, at)
            names, text, start, n, twice = window_runs(word_hashes(data, starts, ends), np.searchsorted(starts, at), window, GRAM)
            own = [batch.column(i).to_numpy(zero_copy_only=False)[text] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, *own, start.astype(np.int32), n.astype(np.int32), twice)], ["name", "rid", "tag", "start", "n", "twice"])

    return rows.select("rid", "tag", "text").mapInArrow(run, "name long, rid long, tag int, start int, n int, twice boolean")


def regions(texts: DataFrame, window: int) -> DataFrame:
    """``rid, tag, start, k1, k2, shard, words`` from ``texts(rid, tag, z, places)``: the words of the windows at the places, joined by one space, by shard.

    ``k1`` and ``k2`` are a hash of the shard and the words. A task that has handed on a region's words leaves them null in equal ones.
    """

    def run(batches):
        press, known = zstandard.ZstdDecompressor(), set()
        for batch in batches:
            out = []
            for rid, tag, z, places in zip(*(batch[c].to_pylist() for c in ("rid", "tag", "z", "places")), strict=True):
                data = press.decompress(z)
                starts, ends = word_bounds(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                by: dict[int, list] = {}
                for p in places:
                    by.setdefault(p["shard"], []).append((p["start"], p["start"] + p["n"] - 1 + window))
                for shard, own in by.items():
                    own = np.array(own)
                    for s, e in consecutive(own[:, 0], own[:, 1], window):
                        words = b" ".join(data[starts[s] : ends[e - 1]].split())
                        key = xxhash.xxh3_128_digest(words, seed=shard)
                        k1, k2 = np.frombuffer(key, np.int64).tolist()
                        out.append((rid, tag, s, k1, k2, shard, None if key in known else words))
                        if len(known) > HELD:
                            known.clear()
                        known.add(key)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], ["rid", "tag", "start", "k1", "k2", "shard", "words"])

    return texts.select("rid", "tag", "z", "places").mapInArrow(run, "rid long, tag int, start int, k1 long, k2 long, shard long, words binary")


def counted(data: np.ndarray, at: np.ndarray, times: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The distinct windows of texts that begin ``at`` and stand for ``times`` places each: two hashes, numbers of places, and the text and the word of the first place."""
    starts, ends = word_bounds(data, at)
    bounds = np.searchsorted(starts, at)
    places = np.arange(max(0, len(starts) - window + 1))
    text = np.searchsorted(bounds, places, "right") - 1
    whole = places + window <= bounds[text + 1]
    places, text = places[whole], text[whole]
    if not len(places):
        return (np.zeros(0, np.int64),) * 5
    w1, w2 = (rolled(word_hashes(data, starts, ends, lane), window)[places].view(np.int64) for lane in (0, 1))
    order = np.lexsort((w2, w1))
    new = np.concatenate([[True], (np.diff(w1[order]) != 0) | (np.diff(w2[order]) != 0)])
    own = order[new]
    return w1[own], w2[own], np.add.reduceat(times[text[order]], np.flatnonzero(new)), text[own], (places - bounds[text])[own]


def windows(pieces: DataFrame, window: int) -> DataFrame:
    """``w1, w2, n, k1, k2, start`` of ``pieces(k1, k2, n, words)``: the hash of each window, how often a batch has it, and its first place there."""

    def run(batches):
        for batch in batches:
            w1, w2, n, text, start = counted(*bytes_of(batch["words"]), batch["n"].to_numpy(zero_copy_only=False), window)
            named = [batch[c].to_numpy(zero_copy_only=False)[text] for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, n, *named, start.astype(np.int32))], ["w1", "w2", "n", "k1", "k2", "start"])

    return pieces.select("k1", "k2", "n", "words").mapInArrow(run, "w1 long, w2 long, n long, k1 long, k2 long, start int")


def passages_of(words: bytes, starts: np.ndarray, window: int) -> list[bytes]:
    """The windows of ``words`` at the sorted ``starts``, runs of them in one."""
    said = words.split()
    return [b" ".join(said[s:e]) for s, e in consecutive(starts, starts + window, window)]


def own_passages(pieces: list[bytes], times: np.ndarray, window: int) -> list[bytes]:
    """Passages that hold each window once which has more than one place in ``pieces``, those standing for ``times`` places each."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
    _, _, n, text, start = counted(np.frombuffer(b"".join(pieces), np.uint8), at, times, window)
    text, start = text[n > 1], start[n > 1]
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    cuts = np.flatnonzero(np.diff(text)) + 1
    return [w for t, own in zip(np.split(text, cuts), np.split(start, cuts), strict=True) if len(own) for w in passages_of(pieces[t[0]], own, window)]


def passages(chosen: DataFrame, window: int) -> DataFrame:
    """``shard, words`` from ``chosen(shard, words, starts)``: the words of the windows that start there, runs of them in one."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("shard", "words", "starts")), strict=True)
            out = [(shard, w) for shard, words, starts in rows for w in passages_of(words, np.array(sorted(starts)), window)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([w for _, w in out], pa.binary())], ["shard", "words"])

    return chosen.select("shard", "words", "starts").mapInArrow(run, "shard long, words binary")


def repeated_spans_of(rows: DataFrame, pressed: DataFrame, window: int, part_words: int = PART_WORDS) -> DataFrame:
    """``rid, tag, start, spans`` of regions of ``rows(rid, tag, text)``: the words, from the region's start on, that windows cover which occur more than once; ``pressed(rid, tag, z)`` has the same texts."""
    found = stored(runs(rows, window), "runs")
    block = F.struct("rid", "tag", (F.col("start") / BLOCK_WORDS).cast("int").alias("block"))
    names = found.groupBy("name").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("places"), F.min(block).alias("least")).where("places > 1")
    names = stored(names, "names")
    total = names.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    shards = max(1, total * (window // 2) // SHARD_WORDS)
    names = names.select("name", F.pmod(F.xxhash64("least"), F.lit(shards)).alias("shard"))
    placed = found.join(names, "name").select("rid", "tag", F.struct("shard", "start", "n").alias("place"))
    texts = pressed.select("rid", "tag", "z").join(placed.groupBy("rid", "tag").agg(F.collect_set("place").alias("places")), ["rid", "tag"])
    parts = stored(regions(texts, window), "regions")
    pieces = parts.groupBy("k1", "k2").agg(F.max("shard").alias("shard"), F.count(F.lit(1)).alias("n"), F.first("words", ignorenulls=True).alias("words"))
    pieces = stored(pieces, "pieces")
    sizes = pieces.groupBy("shard").agg(F.ceil(F.sum(F.length("words")) / (6 * part_words)).alias("split"))
    dealt = pieces.join(sizes, "shard").select("shard", "split", F.pmod("k1", "split").alias("part"), "k1", "k2", "n", "words")
    wide = dealt.where("split > 1")
    seen = windows(wide, window).groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("at")).where("n > 1")
    chosen = seen.select("at.*").groupBy("k1", "k2").agg(F.collect_set("start").alias("starts")).join(wide.select("k1", "k2", "shard", "words"), ["k1", "k2"])
    reference = passages(chosen, window).groupBy("shard").agg(F.collect_list("words").alias("passages"))
    homes = sizes.where("split > 1").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("split") - 1)).alias("part"))
    reference = reference.join(homes, "shard").select(F.col("shard").alias("to_shard"), F.col("part").alias("to_part"), "passages")

    def stream(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        automaton, out = SuffixAutomaton(), []
        if len(own) and own["split"].iloc[0] == 1:
            found = own_passages(list(own["words"]), own["n"].to_numpy(), window)
        else:
            found = [w for passages in held["passages"] for w in passages]
        for words in found:
            automaton.add(words.split())
        for k1, k2, words in zip(own["k1"], own["k2"], own["words"], strict=True) if found else ():
            if spans := automaton.matches(words.split(), window):
                out.append((k1, k2, [{"s": s, "e": e} for s, e in spans]))
        return pd.DataFrame(out, columns=["k1", "k2", "spans"])

    matched = dealt.groupBy("shard", "part").cogroup(reference.groupBy("to_shard", "to_part")).applyInPandas(stream, "k1 long, k2 long, spans array<struct<s int, e int>>")
    return parts.select("rid", "tag", "start", "k1", "k2").join(matched, ["k1", "k2"]).select("rid", "tag", "start", "spans")


def deduplicated(docs: DataFrame, keep: list[str], window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """``keep``, ``n_words``, ``n_removed`` and the kept words, ``kept``, joined by one space, for every row of ``docs(text)``.

    Removed is every word that a window covers whose word sequence also starts elsewhere, in
    another row or in the same text; windows are judged on the texts as given, so all copies go.
    Words are what ASCII white space parts; a null text has none. A repeated row is elsewhere, too.
    """
    rows = identified(docs, keep)
    pressed = packed(rows, keep)
    spans = repeated_spans_of(rows, pressed, window, part_words)
    joined = pressed.join(spans.groupBy("rid", "tag").agg(F.collect_set(F.struct("start", "spans")).alias("regions")), ["rid", "tag"], "left")

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, regions in zip(batch["z"].to_pylist(), batch["regions"].to_pylist(), strict=True):
                words = press.decompress(z).split()
                n = len(words)
                if regions:
                    cut = np.array([(r["start"] + x["s"], r["start"] + x["e"]) for r in regions for x in r["spans"]])
                    kept, at = [], 0
                    for s, e in spans_of(cut[:, 0], cut[:, 1]):
                        kept += words[at:s]
                        at = e
                    words = kept + words[at:]
                out.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
            kinds = [pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *columns], [*keep, "n_words", "n_removed", "kept"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.select(*keep, "z", "regions").mapInArrow(run, f"{schema}, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, as a hash."""
    found = deduplicated(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
