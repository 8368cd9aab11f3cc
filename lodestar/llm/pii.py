"""Personal data in disguise: texts are normalised by transducers that keep offsets, and found spans are mapped back.

A transducer reads source characters and writes normalised ones, each with the source positions it
stands for. The first makes homoglyphs and full-width forms ASCII. On its output two read the stretches
that may hide something: written-out ``at`` and ``dot`` around names become signs; spelled digits,
and dots written out between digits, become digits and signs. All patterns are sought in what each
writes, and spans are mapped back to the source and added to those that the plain patterns find.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.tables import table

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Digits spelled out in the languages of the corpus, and letters of other scripts that look like ASCII ones.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".", " ": " ", " ": " ", " ": " ",
}
INVISIBLE = frozenset("​‌‍⁠﻿­")
AT_WORDS, DOT_WORDS = "at|arroba|arobase", "dot|point|punkt|punto"
#: A sign written out: in brackets, as a word or as itself, or as a word between blanks. The blanks around it belong to it.
AT_SIGN = re.compile(rf"[(\[{{<]\s*+(?:{AT_WORDS}|@)\s*+[)\]}}>]|(?<!\S)(?:{AT_WORDS})(?!\S)|@", re.IGNORECASE)
DOT_SIGN = re.compile(rf"[(\[{{<]\s*+(?:{DOT_WORDS}|\.)\s*+[)\]}}>]|(?<!\S)(?:{DOT_WORDS})(?!\S)", re.IGNORECASE)
DOT = rf"(?:\s*+[(\[{{<]\s*+(?:{DOT_WORDS}|\.)\s*+[)\]}}>]\s*+|\s++(?:{DOT_WORDS})\s++)"
DOMAIN = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{DOT})[A-Za-z0-9-]++)+", re.IGNORECASE)
NAME_CHARACTERS = LOCAL_CHARACTERS - {"."}
#: What may hold a written-out sign at all, and the last labels that an address all in bare words may end in.
SIGN_WORDS = re.compile(rf"(?<!\S)(?:{DOT_WORDS})(?!\S)|[(\[{{<]\s*+(?:{AT_WORDS}|{DOT_WORDS}|[.@])\s*+[)\]}}>]", re.IGNORECASE)
LAST_LABELS = frozenset("com org net edu gov info io co uk us eu de fr es".split())
DIGIT = re.compile("[0-9]")
PUNCTUATION = str.maketrans(dict.fromkeys(",.;:-()+", " "))
NUMERAL = "|".join(sorted(SPELLED, key=len, reverse=True))
#: The parts of a number that may be spelled: digits, a plus, spelled digits, written-out dots, and what stands between.
NUMBER_PART = re.compile(rf"(?P<digits>[0-9]++)|(?P<plus>\+|\bplus\b)|\b(?P<word>{NUMERAL})\b|(?P<dot>{DOT}|\.(?=[0-9]))|(?P<gap>[\s,()-]++)", re.IGNORECASE)
#: Spelled digits, or groups with written-out dots between, that make a run worth reading.
LEAST_PARTS = 4
MIXED_RUN = re.compile(r"\+?[0-9OoIl|][0-9OoIl| ().-]{8,}[0-9OoIl|]")
LETTER_DIGITS = str.maketrans("OoIl|", "00111")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the plain patterns: leftmost, not overlapping within a kind."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        if start < at and (m := EMAIL.match(text, at)):
            found.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if len(m[0]) <= 37 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((*m.span(), "phone"))
    return sorted(found, key=order)


def order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


@lru_cache(maxsize=4096)
def plain_character(c: str) -> str:
    """The ASCII form of a character that looks like ASCII; nothing for an invisible one; else itself."""
    if c < "\x80":
        return c
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKE:
        return LOOKALIKE[c]
    wide = unicodedata.normalize("NFKC", c)
    return wide if wide.isascii() and wide.isprintable() and len(wide) == 1 else c


def plain_letters(text: str) -> tuple[str, list[int]]:
    """The homoglyph transducer: the text in ASCII look-alikes, and the source position of each character and of the end."""
    out, source = [], []
    for i, c in enumerate(text):
        if p := plain_character(c):
            out.append(p)
            source.append(i)
    return "".join(out), [*source, len(text)]


Piece = tuple[str, int, int]


def as_written(text: str, start: int, end: int) -> list[Piece]:
    return [(text[i], i, i + 1) for i in range(start, end)]


def without_signs(text: str, start: int, end: int) -> list[Piece]:
    """``text[start:end]`` character by character with its span, each written-out dot as one sign."""
    out, at = [], start
    for m in re.compile(DOT, re.IGNORECASE).finditer(text, start, end):
        out += [*as_written(text, at, m.start()), (".", m.start(), m.end())]
        at = m.end()
    return out + as_written(text, at, end)


def with_blanks(text: str, start: int, end: int) -> tuple[int, int]:
    while start and text[start - 1].isspace():
        start -= 1
    while end < len(text) and text[end].isspace():
        end += 1
    return start, end


def written_addresses(text: str) -> list[list[Piece]]:
    """Stretches that are addresses with a sign written out, normalised; every character with its span.

    Around each at sign, names joined by dots are taken to the left and a domain to the right, which needs a
    dot of some form. An address whose ``at`` is a bare word needs a written-out dot, and one all in bare
    words a known last label. Each character is looked at a bounded number of times, however long a name is.
    """
    dots = {}
    for m in DOT_SIGN.finditer(text):
        start, end = with_blanks(text, *m.span())
        dots[end] = start
    out, free = [], 0
    for m in AT_SIGN.finditer(text):
        if m.start() < free:
            continue
        sign = m[0]
        low, high = m.span() if sign == "@" else with_blanks(text, *m.span())
        if sign != "@" and sign[0] not in "([{<" and (low == m.start() or high == m.end()):
            continue
        domain = DOMAIN.match(text, high)
        if not domain:
            continue
        at, name, written = low, low, False
        while True:
            start = at
            while start > free and text[start - 1] in NAME_CHARACTERS:
                start -= 1
            if start == at:
                break
            name = start
            if start - 1 > free and text[start - 1] == ".":
                at = start - 1
            elif dots.get(start, -1) > free:
                at, written = dots[start], True
            else:
                break
        if name == low:
            continue
        signs = [x[0] for x in re.finditer(DOT, domain[0], re.IGNORECASE)]
        bare_at = sign != "@" and sign[0] not in "([{<"
        bare = not any(re.search(r"[(\[{<]", x) for x in signs)
        known = re.split(r"[\s.]+", domain[0].lower())[-1] in LAST_LABELS
        if (sign == "@" and not signs and not written) or (bare_at and (not signs or (bare and not known))):
            continue
        out.append([*without_signs(text, name, low), ("@", low, high), *without_signs(text, high, domain.end())])
        free = domain.end()
    return out


def spelled_numbers(text: str) -> list[list[Piece]]:
    """Stretches of digits and spelled digits, with what stands between left out and written-out dots as signs, one piece a digit, plus or dot."""
    out: list[list[Piece]] = []
    own: list[Piece] = []
    words = end = 0

    def close() -> None:
        if words >= LEAST_PARTS or (words or any(c == "." and e - s > 1 for c, s, e in own)) and sum(c.isdigit() for c, _, _ in own) >= LEAST_PARTS:
            out.append(own)

    for m in NUMBER_PART.finditer(text):
        if m.start() != end:
            close()
            own, words = [], 0
        end = m.end()
        if m["digits"]:
            own += as_written(text, *m.span())
        elif m["word"]:
            own.append((SPELLED[m["word"].lower()], *m.span()))
            words += 1
        elif not m["gap"]:
            own.append(("+" if m["plus"] else ".", *m.span()))
    close()
    return out


def disguised_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` in the source of identifiers that only the normalised text shows."""
    found = []
    odd = not text.isascii() and any(plain_character(c) != c for c in set(text))
    flat, source = plain_letters(text) if odd else (text, range(len(text) + 1))

    def add(pieces: list[Piece]) -> None:
        for start, end, kind in plain_spans("".join(c for c, _, _ in pieces)):
            found.append((source[pieces[start][1]], source[pieces[end - 1][2] - 1] + 1, kind))

    if flat != text:
        for start, end, kind in plain_spans(flat):
            found.append((source[start], source[end - 1] + 1, kind))
    signs = SIGN_WORDS.search(flat)
    if signs:
        for pieces in written_addresses(flat):
            add(pieces)
    said = flat.lower().translate(PUNCTUATION).split()
    spelled = not SPELLED.keys().isdisjoint(said) and b"\1\1" in bytes(w in SPELLED or w[0].isdigit() for w in said)
    if spelled or signs and DIGIT.search(flat):
        for pieces in spelled_numbers(flat):
            add(pieces)
    for m in MIXED_RUN.finditer(flat) if DIGIT.search(flat) else ():
        run = m[0]
        if re.search("[OoIl|]", run) and sum(map(str.isdigit, run)) >= 6:
            add([(c.translate(LETTER_DIGITS), i, i + 1) for c, i in zip(run, range(*m.span()), strict=True)])
    return found


def all_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The plain spans, and all spans: the plain ones and those disguised ones that no span of their kind overlaps."""
    base = plain_spans(text)
    held = {kind: sorted((s, e) for s, e, k in base if k == kind) for kind in KINDS}
    added = []
    for start, end, kind in sorted(set(disguised_spans(text)), key=lambda s: (s[0], -s[1], s[2])):
        own = held[kind]
        at = bisect.bisect_left(own, (end, 0))
        if not at or own[at - 1][1] <= start:
            own.insert(at, (start, end))
            added.append((start, end, kind))
    return base, sorted(base + added, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every row of ``docs(doc_id, text)``; positions are code points, ends exclusive.

    The ``n_`` columns count the plain spans, ``base_sha256`` is the hash of their list, ``spans``
    lists all, ``n_added`` counts those found in disguise. A null text is empty: no spans, the hash
    of the empty string. Repeated rows are kept; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "")
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(table(spark, sf_dir, "documents"))
