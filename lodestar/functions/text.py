"""Text expressions: folding, tokens, keys, identifiers, markup."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the Latin blocks whose decomposition is one ASCII letter with marks, and those letters, position by position.
_PAIRS = [(c, p) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.lower() == c and len(p := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1 and p.isascii() and p != c]
MARKED, PLAIN = "".join(c for c, _ in _PAIRS), "".join(p for _, p in _PAIRS)
#: Marks that follow a letter; behind the letters, they have no counterpart and are dropped.
FOLLOWING = "".join(map(chr, range(0x300, 0x370)))
WORD = r"[\p{L}\p{N}]+"
DOI = r"10\.[0-9]{4,9}/[^\s\x22<>]+"
# Function words that carry no topic, for the corpus's four languages.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "der", "des", "die", "de", "el", "en", "et", "for", "from", "in", "is", "it", "la", "le", "les", "of", "on", "or", "que", "the", "to", "und", "was", "with", "y"]


def fold(x: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or follow it; sharp s becomes ``ss``. ASCII texts have nothing to replace."""
    low = F.lower(x)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.replace(F.translate(low, MARKED + FOLLOWING, PLAIN), F.lit("ß"), F.lit("ss")))


def ascii_words(x: Column) -> Column:
    """The folded text with every run of other characters than ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", " "))


def title_key(title: Column) -> Column:
    """The folded title without separators; the hash of the title if nothing is left."""
    key = F.regexp_replace(fold(title), "[^a-z0-9]+", "")
    return F.when(key == "", F.sha2(title, 256)).otherwise(key)


def tokens(x: Column) -> Column:
    """Folded letter and digit runs, in order."""
    return F.regexp_extract_all(fold(x), F.lit(WORD), F.lit(0))


def token_count(x: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_count(x, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def query_terms(x: Column, most: int = 24) -> Column:
    """Distinct tokens of two characters or more (digits of any length), in order, ``most`` at most."""
    return F.slice(F.array_distinct(F.filter(tokens(x), lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$"))), 1, most)


def content_terms(x: Column) -> Column:
    """Tokens that are not function words, repeats included."""
    return F.filter(tokens(x), lambda t: ~t.isin(STOP_WORDS))


def without_markup(x: Column) -> Column:
    """Text of a piece of HTML: scripts and styles dropped, entities read, tags as spaces, blanks squeezed; blank becomes null."""
    x = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", " "), r"\s+", " "))
    return F.when(x != "", x)


def doi_in(x: Column) -> Column:
    """The first DOI in a text, in lower case, without trailing punctuation; null if there is none."""
    found = F.lower(F.regexp_replace(F.regexp_extract(x, DOI, 0), r"[.,;:)\]}]+$", ""))
    return F.when(found != "", found)


def all_dois(x: Column) -> Column:
    """Distinct DOIs in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(DOI), F.lit(0)), lambda d: F.lower(F.regexp_replace(d, r"[.,;:)\]}]+$", ""))))


def verified_doi(x: Column) -> Column:
    """The value itself, trimmed and lower-cased, if it is nothing but a DOI."""
    value = F.lower(F.trim(x))
    return F.when(value == doi_in(value), value)


def canonical_key(doi: Column, title: Column, year: Column) -> Column:
    """``doi:...`` where there is one, else the title's key and year."""
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat_ws(":", F.lit("title"), title_key(title), F.coalesce(year.cast("string"), F.lit("unknown"))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; zero if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def coverage(terms: Column, words: Column) -> Column:
    """The share of distinct ``terms`` among ``words``; zero without terms."""
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.array_intersect(terms, words)) / F.size(F.array_distinct(terms)))


# The weights of the four signs of a readable text, the share of letters and the length from which they count in full.
READABLE = {"visible": 0.25, "letters": 0.30, "words": 0.25, "length": 0.20}
LETTERS_ENOUGH, LENGTH_ENOUGH = 0.7, 80


def readable_share(x: Column) -> Column:
    """How much a recognised text looks like text, from zero to one.

    Four signs count: characters that can be seen, letters and digits, words of letters only with a mark
    behind them at most, and enough length.
    """

    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace(x, pattern, "")) / F.greatest(F.lit(1), F.length(x))

    pieces = F.filter(F.split(x, r"\s+"), lambda p: p != "")
    plain = F.filter(pieces, lambda p: p.rlike(r"^[\p{L}]{2,}[.,;:!?]?$"))
    signs = {
        "visible": kept(r"[^\x20-\x7E\p{L}\p{N}\n]"),
        "letters": F.least(F.lit(1.0), kept(r"[^\p{L}\p{N}]") / LETTERS_ENOUGH),
        "words": F.size(plain) / F.greatest(F.lit(1), F.size(pieces)),
        "length": F.least(F.lit(1.0), F.length(x) / LENGTH_ENOUGH),
    }
    return F.round(sum((READABLE[k] * v for k, v in signs.items()), F.lit(0.0)), 6)
