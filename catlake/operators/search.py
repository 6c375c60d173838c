"""Filters and full-text search over a catalogue."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import tokens, unaccent


def token_table(records: DataFrame, key: str, *texts: str, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, token): the distinct folded words of each record's texts, as ``words`` cuts and folds them; written once, it serves every search."""
    found = F.array_distinct(F.flatten(F.array(*[F.coalesce(words(F.col(t)), F.array().cast("array<string>")) for t in texts])))
    return records.select(key, F.explode(found).alias("token"))


def write_index(records: DataFrame, key: str, folder: str, *texts: str, words: Callable[[Column], Column] = tokens) -> None:
    """The token table as a stored inverted index: files by ranges of (token, key), sorted, so that their statistics tell which hold a prefix.

    A word that very many records have is spread over several files, as the key is part of the ranges.
    """
    token_table(records, key, *texts, words=words).repartitionByRange("token", key).sortWithinPartitions("token", key).write.parquet(folder)


def search_index(index: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of the records in which every search word is the beginning of some word, from a stored index; none without a usable word.

    Each word is a range of tokens, which reaches the scan as a filter; of the postings read,
    a record has to have one for every word.
    """
    wanted = list(dict.fromkeys(query_tokens(text)))
    ranges = [(F.col("token") >= w) & (F.col("token") < w[:-1] + chr(ord(w[-1]) + 1)) for w in wanted]
    if not wanted:
        return index.select(key).filter(F.lit(False))
    met = F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, hit in enumerate(ranges)]))
    postings = index.filter(reduce(or_, ranges)).select(key, F.explode(met).alias("_word")).distinct()
    return postings.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(wanted)).select(key)


def query_tokens(text: str, most: int = 8) -> list[str]:
    """The first words of a search text, folded as the token table is."""
    import re
    import unicodedata

    plain = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("ł", "l"))
    return re.findall("[a-z0-9]+", "".join(c for c in plain if not unicodedata.combining(c)))[:most]


def _begins(words: Column, beginning: str) -> Column:
    return F.exists(words, lambda word: word.startswith(beginning))


def fulltext_prefix(records: DataFrame, key: str, text: str, *texts: str, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """The records in which every search word is the beginning of some word; none without a usable word."""
    wanted = list(dict.fromkeys(query_tokens(text)))
    if not wanted:
        return records.filter(F.lit(False))
    # A predicate of each record: no shuffle, and the other filters of a listing stay beside it.
    found = F.flatten(F.array(*[F.coalesce(words(F.col(t)), F.array().cast("array<string>")) for t in texts]))
    return records.filter(let(found, lambda have: reduce(and_, [_begins(have, w) for w in wanted])))


def fulltext_substring(records: DataFrame, text: str, *texts: str) -> DataFrame:
    """The records whose joined texts hold the search text, whatever its case; accents count."""
    return records.filter(F.contains(F.lower(F.concat_ws(" ", *texts)), F.lower(F.lit(text))))


def has_category(records: DataFrame, bridge: DataFrame, axis: str, category: str, key: str = "id") -> DataFrame:
    """Records in a category of an axis, one row each."""
    return records.join(bridge.filter((F.col("axis") == axis) & (F.col("category") == category)), key, "left_semi")


__all__ = ["fulltext_prefix", "fulltext_substring", "has_category", "query_tokens", "search_index", "token_table", "unaccent", "write_index"]
