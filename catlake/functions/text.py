"""Folding, cleaning and comparing texts, as column expressions."""

from __future__ import annotations

import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def _folding() -> tuple[str, str]:
    """Lower-case characters that decompose to one character and marks, what they fold to, and then the marks, which go."""
    letters, plain, marks = [], [], []
    for c in map(chr, [*range(0x80, 0x3000), *range(0xFB00, 0x10000)]):
        if unicodedata.combining(c):
            marks.append(c)
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and c.lower() == c and base.lower() == base and base.isalnum():
            letters.append(c)
            plain.append(base)
    return "".join(letters + marks), "".join(plain)


ACCENTED, PLAIN = _folding()
#: Entities by name, as HTML defines them.
_NAMED = "\x01".join(f"{name[:-1]}\x02{sign}" for name, sign in html5.items() if name.endswith(";") and "\x01" not in sign and "\x02" not in sign)
_ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unaccent_in_place(text: Column) -> Column:
    """Lower case without accents, character by character, so that offsets stay those of the text; marks of their own and the sharp s stay."""
    return F.translate(F.lower(text), ACCENTED[: len(PLAIN)], PLAIN)


def unaccent(text: Column) -> Column:
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN)


def fold(text: Column, variant: str = "match") -> Column:
    """A comparison key; variants: match, title, category, place, slug, sort.

    match: a-z and 0-9 with single spaces; title: any letter or digit; category and slug: with
    hyphens; place: keeps punctuation; sort: match without spaces. Null stays null.
    """
    plain = unaccent(text)
    if variant == "match":
        return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    if variant == "title":
        return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    if variant == "category":
        return F.regexp_replace(F.trim(plain), r"[\s_]+", "-")
    if variant == "place":
        return F.trim(F.regexp_replace(plain, r"\s+", " "))
    if variant == "slug":
        return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", "")
    if variant == "sort":
        return F.regexp_replace(plain, "[^a-z0-9]+", "")
    raise ValueError(f"unknown variant {variant!r}")


def decode_entities(text: Column, only: tuple[str, ...] | None = None) -> Column:
    """One round of decoding: entities by name, decimal and hexadecimal number, or those named in ``only``; what is none stays as it is."""
    if only is not None:
        # The ampersand comes last, so that what it makes isn't decoded again.
        for name in sorted(only, key=lambda n: html5[f"{n};"] == "&"):
            text = F.replace(text, F.lit(f"&{name};"), F.lit(html5[f"{name};"]))
        return text
    names = F.str_to_map(F.lit(_NAMED), F.lit("\x01"), F.lit("\x02"))

    def sign(entity: Column) -> Column:
        body = F.substring(entity, 2, F.char_length(entity) - 2)
        hexadecimal = F.lower(body).startswith("#x")
        number = F.when(hexadecimal, F.conv(F.substring(body, 3, 6), 16, 10).cast("int")).when(body.startswith("#"), F.substring(body, 2, 7).cast("int"))
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        by_number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.coalesce(by_number, F.when(~body.startswith("#"), F.try_element_at(names, body)), entity)

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x["parts"], lambda p, i: F.concat(p, F.when(i < F.size(x["found"]), sign(F.get(x["found"], i))).otherwise(""))), "")

    def decoded(t: Column) -> Column:
        cut = F.struct(F.split(t, _ENTITY, -1).alias("parts"), F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0)).alias("found"))
        return F.when(F.contains(t, F.lit("&")), let(cut, joined)).otherwise(t)

    return let(text, decoded)


def clean_text(text: Column, only: tuple[str, ...] | None = None) -> Column:
    """Up to three rounds of entity decoding, or one of the entities named in ``only``, odd spaces removed, white space collapsed; empty becomes null."""
    decoded = text
    for _ in range(3 if only is None else 1):
        decoded = decode_entities(decoded, only)
    # Most texts have no entity, and are not searched for any.
    text = F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)
    text = F.regexp_replace(text, "[​‌‍﻿]", "")
    return F.nullif(F.trim(F.regexp_replace(text, "[\\s ]+", " ")), F.lit(""))


def tokens(text: Column) -> Column:
    """The folded words of a text, in order."""
    return F.filter(F.split(fold(text), " "), lambda w: w != "")


#: Characters of folded texts, which letter counts tell apart; all others count together.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(text: Column) -> Column:
    """How often each of LETTERS, and any other character, is in a text."""
    size = F.char_length(text)
    each = F.transform(F.array(*map(F.lit, LETTERS)), lambda c: size - F.char_length(F.replace(text, c, F.lit(""))))
    return F.when(text.isNotNull(), let(each, lambda n: F.concat(n, F.array(size - F.aggregate(n, F.lit(0), lambda s, x: s + x)))))


def similarity_bound(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """No less than ``similarity`` of two texts, from their letter counts, lengths and first four letters.

    No more letters can match than both texts have of each, and order can only lower the
    result, so with the exact common prefix this is an upper bound; a little is added for
    the last digit.
    """
    m = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    la, lb = F.char_length(a), F.char_length(b)
    prefix = F.lit(0)
    for k in (1, 2, 3, 4):
        prefix = F.when((la >= k) & (lb >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)), k).otherwise(prefix)
    jaro = F.least(F.lit(1.0), (m / la + m / lb + 1) / 3)
    most = F.when((la == 0) | (lb == 0) | (m == 0), 0.0).otherwise(jaro + prefix * 0.1 * (1 - jaro) + 1e-9)
    return F.when(a.isNotNull() & b.isNotNull(), most)


def similarity(a: str | None, b: str | None) -> float | None:
    """Jaro-Winkler similarity of two folded texts, 0 to 1; each letter is found by one search in its window, which long texts need.

    Greedy matching in a window of half the longer length less one; half the mismatched
    order counts, not rounded down; the common prefix of up to four letters always adds.
    Equal texts give 1, empty ones 0, a null gives null.
    """
    if a is None or b is None:
        return None
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    try:
        x, y, none = a.encode("latin-1"), bytearray(b, "latin-1"), 0
        if 0 in x:
            raise UnicodeError
    except UnicodeError:
        x, y, none = a, list(b), ""
    z, reach, n, places, left = y[:], max(max(len(a), len(b)) // 2 - 1, 0), 0, [], []
    for i, c in enumerate(x):
        try:
            j = y.index(c, max(i - reach, 0), min(i + reach + 1, len(y)))
        except ValueError:
            continue
        y[j], n = none, n + 1
        places.append(j)
        left.append(c)
    if not n:
        return 0.0
    wrong = sum(c != z[j] for c, j in zip(left, sorted(places), strict=True)) / 2
    jaro = (n / len(a) + n / len(b) + (n - wrong) / n) / 3
    same = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 4)
    return jaro + same * 0.1 * (1 - jaro)


def similarity_of(a: Column, b: Column) -> Column:
    """``similarity`` as a column, in Arrow batches."""

    @F.pandas_udf("double")
    def similarities(left: pd.Series, right: pd.Series) -> pd.Series:
        # Records of one block share titles and venues, so a batch scores each different pair once.
        known: dict[tuple, float | None] = {}
        for pair in zip(left, right, strict=True):
            if pair not in known:
                known[pair] = similarity(*pair)
        return pd.Series([known[pair] for pair in zip(left, right, strict=True)], dtype="float64")

    return similarities(a, b)
