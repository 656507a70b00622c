"""Lexemes as a search index writes them, and the numbers that stand for terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_lexemes(raw: Column) -> Column:
    """array<struct<lexeme, tf>> of a text like `'net':1,5 'sale''s':2A 'tax'`: as often as there are positions, once without any; doubled quotes are one."""
    items = F.regexp_extract_all(raw, F.lit(r"('(?:[^']|'')*'(?::[0-9A-D,]+)?)"), F.lit(1))
    word = lambda x: F.replace(F.regexp_extract(x, r"^'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'"))
    places = lambda x: F.regexp_extract(x, r"':([0-9A-D,]+)$", 1)
    return F.transform(items, lambda x: F.struct(word(x).alias("lexeme"), F.when(places(x) == "", 1).otherwise(F.size(F.split(places(x), ","))).alias("tf")))


def term_index(term: Column) -> Column:
    """A stable 32-bit number of a term, from its digest. Postings are keyed by the term itself, which can't collide."""
    return F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("long")
