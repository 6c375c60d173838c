"""Prices in texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import clean_text, unaccent

#: Phrases of free entry and names of the currency, folded; fixed values.
FREE = ("zdarma", "vstup volny", "bez vstupneho")
CURRENCY = ("kc", "czk")


def _word(*phrases: str) -> str:
    return rf"\b(?:{'|'.join(p.replace(' ', r'\s+') for p in phrases)})\b"


def normalize_price(text: Column) -> Column:
    """struct(type, text, amount, currency, reason): free, paid or unknown.

    Free phrases beside the currency are a conflict. The text is cut at the currency's names,
    and each part but the last ends with an amount: its last number, in groups of three or
    not. There is an amount only if all parts agree on one; a number with a decimal part, or
    one that a dash or "az" or "do" joins to a number before it, leaves it open.
    """
    return let(clean_text(text), _priced)


def _priced(kept: Column) -> Column:
    plain = unaccent(kept)
    free, money = plain.rlike(_word(*FREE)), plain.rlike(_word(*CURRENCY))

    def amount_of(part: Column) -> Column:
        run = F.regexp_extract(part, r"[\d., ]*\d\s*$", 0)
        number = F.regexp_extract(F.rtrim(run), r"(?:^|[ ])((?:\d{1,3}(?:[ .]\d{3})+)|\d+)$", 1)
        joined = F.rtrim(part).rlike(r"\d[\d .]*(?:[-\u2013\u2014]|\baz\b|\bdo\b)\s*\d[\d .]*$")
        decimal = F.rtrim(part).rlike(r"\d[,.]\d{1,2}$")
        return F.struct(F.nullif(F.regexp_replace(number, "[ .]", ""), F.lit("")).cast("long").alias("n"), (joined | decimal).alias("open"))

    parts = F.split(plain, _word(*CURRENCY), -1)
    ends = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), amount_of)
    kind = F.when(free & ~money, "free").when(money & ~free, "paid").otherwise("unknown")

    def made(x: Column) -> Column:
        amounts = F.array_distinct(F.array_compact(F.transform(x["ends"], lambda e: e["n"])))
        sure = (F.size(amounts) == 1) & ~F.exists(x["ends"], lambda e: e["open"])
        return F.struct(
            x["kind"].alias("type"),
            kept.alias("text"),
            F.when(x["kind"] == "free", F.lit(0).cast("long")).when((x["kind"] == "paid") & sure, F.get(amounts, F.lit(0))).alias("amount"),
            F.when(x["kind"] != "unknown", "CZK").alias("currency"),
            F.when(x["both"], "conflicting-price").alias("reason"),
        )

    return let(F.struct(ends.alias("ends"), kind.alias("kind"), (free & money).alias("both")), made)
