"""Word units, packed id files, embedding whitening and tokenizer alignment against plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import alignment, packed, units, whitening

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACES = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0     　"
PARTS = [*"ab1.,'é日😀ß-▁<", *SPACES, "  ", " x", "\n\n", "'s", "<|endoftext|>", "</s>", "<0x41>"]
text_of = st.lists(st.sampled_from(PARTS) | st.characters(codec="utf-8"), max_size=30).map("".join)
AWKWARD = ["", None, " ", "  ", "\n", " a", "a ", "a  b", "a \n b", "a\nb", "a  b", "a 　b", "x<|endoftext|> y", "it's  we'll \n\n go", "日本語 テキスト\n中文", "😀 😀", "a\x00 b", "é è à", "  a", "a" * 300, "<s> </s>", "tab\t tab \t x"]


def plain_bytes() -> Tokenizer:
    return Tokenizer.from_file(BYTES)


@settings(max_examples=300, deadline=None)
@given(st.lists(text_of, max_size=5), st.integers(1, 7))
def test_units_are_the_texts_and_their_ids_are_the_texts_ids(texts, step):
    rows = [[] for _ in texts]
    for part in units.slices(pa.array(texts, pa.string()), step):
        own = iter(part.units.to_pylist())
        for row, n in zip(part.rows.tolist(), part.counts.tolist(), strict=True):
            rows[row] += [next(own) for _ in range(n)]
    assert ["".join(r) for r in rows] == texts
    got = [[] for _ in texts]
    for ended, ends, ids in packed.encoder(BYTES).encode(pa.array(texts, pa.string()), 2):
        for row, low, high in zip(ended.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            got[row] = ids[low:high].tolist()
    assert got == [[*plain_bytes_cached().encode(t, add_special_tokens=False).ids, 2] for t in texts]


CACHED = []


def plain_bytes_cached() -> Tokenizer:
    if not CACHED:
        CACHED.append(plain_bytes())
    return CACHED[0]


@pytest.mark.parametrize("width", [1, 5, 8, 15, 16, 17, 23, 32])
def test_bit_fields_round_trip_and_can_be_read_anywhere(tmp_path, width, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK", 64)
    r = np.random.default_rng(width)
    ids = r.integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
    raw = packed.pack(ids, width)
    assert len(raw) == -(-1000 * width // 8)
    assert raw == np.packbits([int(x) >> b & 1 for x in ids.tolist() for b in range(width)], bitorder="little").tobytes()
    ends = np.array(sorted(r.integers(0, 1001, 20).tolist()) + [1000])
    writer = packed.Writer(f"file://{tmp_path}/a.ids", width)
    for low in range(0, 1000, 77):
        writer.add(ids[low : low + 77])
    writer.end([None, *range(20)], ends)
    writer.close()
    file = packed.Reader(f"file://{tmp_path}/a.ids")
    assert (file.width, file.n, file.docs, file.ends.tolist()) == (width, 1000, [None, *range(20)], ends.tolist())
    for _ in range(40):
        a, b = sorted(r.integers(0, 1001, 2).tolist())
        assert file.ids(a, b).tolist() == ids[a:b].tolist()
    assert file.document(0).tolist() == ids[: ends[0]].tolist() and file.document(20).tolist() == ids[ends[19] :].tolist()
    with pytest.raises(ValueError):
        packed.Writer(f"file://{tmp_path}/b.ids", 3).add(np.array([9], np.uint32))
    empty = packed.Writer(f"file://{tmp_path}/c.ids", width)
    empty.close()
    assert packed.Reader(f"file://{tmp_path}/c.ids").ids(0, 0).tolist() == []


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("base", F.lit(1)).repartition(3)


def test_packed_files_of_a_table(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (None, None), (3, "again"), (3, "again"), (-5, "first")]
    rows += [(100 + i, " ".join(r.choice(["water", "house", "Fluß", "x1"]) for _ in range(r.randrange(200)))) for i in range(60)] + [(500, "long words here " * 30_000)]
    docs = documents(spark, rows)
    manifest = packed.write_packed(docs, BYTES)
    got = [tuple(x) for x in packed.read_packed(manifest).collect()]
    wanted = Counter()
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in ordered:
        ids = np.array([*plain_bytes_cached().encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        wanted[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((i, n, c) for i, _, n, c in got) == wanted
    got.sort(key=lambda x: x[1])
    assert [x[0] for x in got] == [i for i, _ in ordered]
    assert [x[1] for x in got] == np.cumsum([0, *(x[2] for x in got[:-1])]).tolist()
    total = got[-1][1] + got[-1][2]
    a, b = total // 7, total - total // 9
    span = sorted((x.at, x.ids) for x in packed.token_range(manifest, a, b).collect())
    assert span[0][0] == a and sum(len(x) for _, x in span) == b - a
    assert packed.read_packed(packed.write_packed(docs.limit(0), BYTES)).count() == 0


def test_bit_slices_give_exact_products():
    r = np.random.default_rng(1)
    for bits in ([1, 0, 5], [3, 11, 64, 7]):
        y = np.stack([r.integers(0, 1 << b, 150, dtype=np.uint64) if b else np.zeros(150, np.uint64) for b in bits], axis=1)
        common, ones = whitening.scatter(y, bits)
        exact = y.astype(object)
        assert whitening.products(common, bits) == [[sum(int(a) * int(b) for a, b in zip(exact[:, i], exact[:, j])) for j in range(len(bits))] for i in range(len(bits))]


def test_whitening_of_a_table(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=(300, 6)) @ r.normal(size=(6, 6))
    base[:100] = base[0]  # a third are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] + [0.0] * 5), (904, [1.0] * 5), (905, [])]
    more = [(None, base[5].tolist()), (7, base[7].tolist()), (800, [-0.0, 0.0, 1e3, -1e3, 0.5, 2.0])]
    table = spark.createDataFrame(rows + bad + more, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(0)).repartition(4)
    got = whitening.whitened(table).collect()
    kept = rows + more
    x = [[int(np.floor(256 * c)) for c in v] for _, v in kept]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    exact = [[Fraction(sum(v[i] * v[j] for v in fit), n) - Fraction(sums[i] * sums[j], n * n) for j in range(6)] for i in range(6)]
    values, vectors = np.linalg.eigh(np.array([[float(e) for e in row] for row in exact]))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(kept) and {g.n for g in got} == {n} and all(g.identity_error < 1e-9 for g in got)
    signs = {}
    wanted = Counter()
    for (i, _), v in zip(kept, x, strict=True):
        d = [n * c - s for c, s in zip(v, sums, strict=True)]
        for k in range(4):
            white = float(np.array([float(Fraction(c, n)) for c in d]) @ vectors[:, k] / np.sqrt(values[k]))
            wanted[i, k + 1, sum(c * c for c in d), round(abs(white), 9)] += 1
            mine = next(g.whitened for g in got if g.vec_id == i and g.component == k + 1 and g.deviation == sum(c * c for c in d))
            signs.setdefault(k, set()).add(bool(mine > 0) == bool(white > 0) if abs(white) > 1e-9 else next(iter(signs.get(k, {True}))))
    assert Counter((g.vec_id, g.component, g.deviation, round(abs(g.whitened), 9)) for g in got) == wanted
    assert all(len(s) == 1 for s in signs.values())
    assert all(g.explained == pytest.approx(values[g.component - 1] / values.sum(), rel=1e-9) for g in got)
    assert whitening.whitened(table.limit(0)).count() == 0
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(s.whitened, s.explained, s.deviation) for s in same] == [(0.0, 0.0, 0)] * 4
    huge = whitening.whitened(spark.createDataFrame([(1, [1e12, 2.0]), (2, [-1e12, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert {h.deviation for h in huge} == {None} and {round(abs(h.whitened), 9) for h in huge if h.component == 1} == {1.0}


def brute_alignment(rows):
    a_tok, b_tok = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_tok.encode_special_tokens = True
    byte = alignment.byte_alphabet()
    a_bytes = lambda i: bytes(byte[c] for c in a_tok.id_to_token(i)) if i != 50256 else b"<|endoftext|>"
    b_bytes = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    own, counts = [], Counter()
    for i, text in rows:
        raw = (" " + (text or "")).encode()
        a, b = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids, b_tok.encode(text or "")
        if not text or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            own.append((i, 0, 0, [], Counter()))
            continue
        ends = lambda ids, of: np.cumsum([len(of(x)) for x in ids]).tolist()
        ea, eb = ends(a, a_bytes), ends(b, b_bytes)
        parts, low = [], 0
        for end in sorted(set(ea) & set(eb)):
            parts.append(([x for x, e in zip(a, ea) if low < e <= end], [y for y, e in zip(b, eb) if low < e <= end]))
            low = end
        links = Counter((x, y) for g, h in parts for x in g for y in h)
        counts.update(links.keys())
        own.append((i, len(a), len(b), parts, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = Counter()
    for i, n_a, n_b, parts, links in own:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in parts)
        out[i, n_a, n_b, len(parts), sum(links.values()), sum(m for k, m in links.items() if counts[k] == best[k[0]]), sum(m * counts[k] for k, m in links.items()), hashlib.sha256(said.encode()).hexdigest() if parts else ""] += 1
    return out


def test_alignment_of_a_table(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (3, "again"), (3, "again")]
    rows += [(100 + i, "the same words here, and more.\nthe same") for i in range(60)]
    rows += [(300 + i, " ".join(r.choice(["Donaudampfschiff", "l'été", "x_y", "naïve", "日本", "1234567", "the", "of"]) for _ in range(r.randrange(120)))) for i in range(60)] + [(700, "word " * 5000 + "😀")]
    docs = documents(spark, rows)
    wanted = brute_alignment(rows)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for fan, size in ((alignment.FAN, alignment.PART_BYTES), (2, 40)):
        runs = alignment.spilled(docs, BYTES, PIECES)
        spills = runs.where("bucket IS NOT NULL")
        counts = alignment.pair_counts(spills, 32000, fan)
        gained = alignment.contributions(spills, counts, size).groupBy("base", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        found = runs.where("bucket IS NULL").join(gained, ["base", "place"], "left").fillna(0, ["n_best", "count_sum"])
        assert Counter(tuple(x) for x in found.select(*names).collect()) == wanted
    assert Counter(tuple(x) for x in alignment.aligned(docs, BYTES, PIECES).collect()) == wanted
    assert alignment.aligned(docs.limit(0), BYTES, PIECES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(text_of.filter(bool), min_size=1, max_size=4))
def test_units_of_two_tokenizers_are_their_ids(texts):
    tokens = alignment.aligner(BYTES, PIECES)
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in texts:
        spill, now = alignment.Spill(0, tokens.n_b), alignment.Open()
        for part in units.slices(alignment.spaced(pa.array([text])), 3):
            now.add(tokens, tokens.memory.numbers(part.units))
        now.closed(1, spill)
        whole = b"".join(tokens.b_bytes[i] for i in pieces.encode(text)) == (" " + text).encode()
        assert spill.rows[0][2] == (len(pieces.encode(text)) if whole else 0)


def test_runs_merge_like_one_count(monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS", 7)
    r = random.Random(9)
    for _ in range(40):
        counts, runs = Counter(), []
        for _ in range(r.randrange(1, 9)):
            own = Counter(r.randrange(90) for _ in range(r.randrange(1, 120)))
            counts.update(own)
            runs.append(alignment.blocks(np.array(sorted(own)), np.array([own[k] for k in sorted(own)])))
        got = list(alignment.with_best(alignment.merged(runs), 10))
        keys, n, best = (np.concatenate([g[i] for g in got]) for i in range(3))
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == counts and keys.tolist() == sorted(counts)
        assert best.tolist() == [counts[k] == max(v for j, v in counts.items() if j // 10 == k // 10) for k in sorted(counts)]
