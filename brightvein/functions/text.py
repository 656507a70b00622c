"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Characters read as a space, dropped, or read as a hyphen.
SPACES = "       "
INVISIBLE = "­​‌‍﻿"
HYPHENS = "‐‑"
#: Vocabularies of the table and figure predicates.
TOTALS = ("grand total", "sub-total", "sub total", "subtotal", "total", "aggregate")
SCALES = ("crore", "crores", "lakh", "lakhs", "million", "millions", "billion", "billions", "thousand", "thousands")
CURRENCIES = ("rs", "rs.", "inr", "usd", "eur", "gbp", "₹", "$", "€", "£")
ROMANS = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")


def normalise_glyphs(text: Column) -> Column:
    """Hyphens to `-`, a hyphen between letters at a line's end closed up (blanks around the line feed too), ligatures spelt out, space variants to a space, invisibles and controls dropped."""
    out = F.translate(text, HYPHENS, "--")
    out = F.regexp_replace(out, r"(?<=\p{L})-[ \t]*+\n[ \t]*+(?=\p{L})", "-")
    for glyph, letters in LIGATURES.items():
        out = F.replace(out, F.lit(glyph), F.lit(letters))
    out = F.translate(out, SPACES + INVISIBLE, " " * len(SPACES))
    return F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]", "")


def figures(text: Column) -> Column:
    """A text's numerals in order, as exact canonical texts: sign, digits without leading zeros, fraction without trailing ones.

    Commas may group digits in any way. A minus sign before the digits, or
    parentheses that touch the number on both sides, make it negative.
    """
    signed = r"[(]?[-−–]?[0-9][0-9,]*(?:[.][0-9]+)?[)]?"
    raw = F.regexp_extract_all(text, F.lit(f"({signed})"), F.lit(1))

    def canonical(r: Column) -> Column:
        plain = F.regexp_replace(r, r"[^0-9.]", "")
        whole = F.regexp_replace(F.substring_index(plain, ".", 1), "^0+(?=[0-9])", "")
        part = F.regexp_replace(F.when(F.contains(plain, F.lit(".")), F.substring_index(plain, ".", -1)).otherwise(F.lit("")), "0+$", "")
        value = F.concat(whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")))
        negative = (F.startswith(r, F.lit("(")) & F.endswith(r, F.lit(")"))) | r.rlike("^[(]?[-−–]")
        return F.when(negative & (value != "0"), F.concat(F.lit("-"), value)).otherwise(value)

    return F.transform(raw, canonical)


def numerals(text: Column) -> Column:
    """The values of `figures` as decimals; null in the place of one that 38 digits with ten decimals can't hold exactly."""
    fits = lambda f: f.rlike(r"^-?[0-9]{1,28}([.][0-9]{1,10})?$")
    return F.transform(figures(text), lambda f: F.when(fits(f), f.try_cast("decimal(38,10)")))


def unsupported(claim: Column, support: Column) -> Column:
    """The figures of a claim that its support lacks, one for each value, in the claim's order."""
    return F.array_except(figures(claim), figures(support))


def token_estimate(text: Column) -> Column:
    """A token count where no tokenizer is staged: a quarter of the characters, plus one."""
    return (F.floor(F.length(text) / 4) + 1).cast("int")


def looks_numeric(text: Column) -> Column:
    """Only digits remain when currencies (in any case), blanks, separators, parentheses, percent and signs are left out of account."""
    named = "|".join(sorted((c.replace(".", "[.]").replace("$", "[$]") for c in CURRENCIES), key=len, reverse=True))
    return text.rlike(f"(?i)^(?:{named}|[\\s\u00a0\u202f,.()%+−–-])*+(?:[0-9](?:{named}|[\\s\u00a0\u202f,.()%+−–-])*+)+$")


def states_units(text: Column) -> Column:
    """A scale or a currency named without any digit."""
    words = F.split(F.lower(text), "[\\s\u00a0()\\[\\],]+")
    return ~text.rlike("[0-9]") & F.arrays_overlap(words, F.array(*map(F.lit, SCALES + CURRENCIES)))


def is_marker(token: Column) -> Column:
    """A footnote marker: digits, one letter, or a small roman numeral."""
    return token.rlike("^([0-9]+|[A-Za-z])$") | F.lower(token).isin(*ROMANS)


def _last_mark(text: Column) -> Column:
    """What ends a trimmed cell and may be a marker: a short name in parentheses, or a run of reference signs; empty for neither."""
    return F.regexp_extract(F.trim(text), r"([(][0-9A-Za-z]{1,3}[)]|[*#\u2020\u2021]+)$", 1)


def without_marker(text: Column) -> Column:
    """A cell's body, trimmed, without the marker that ends it."""
    whole, mark = F.trim(text), _last_mark(text)
    body = F.rtrim(F.left(whole, F.length(whole) - F.length(mark)))
    counts = ~F.startswith(mark, F.lit("(")) | is_marker(F.btrim(mark, F.lit("()")))
    return F.when((mark != "") & (body != "") & counts, body).otherwise(whole)


def footnote_marker(text: Column) -> Column:
    """The marker that ends a cell after a body, as `a`, `2` or `*`; null if there is none, or if parentheses hold an abbreviation."""
    return F.when(F.length(without_marker(text)) < F.length(F.trim(text)), F.btrim(_last_mark(text), F.lit("()")))


def marker_key(token: Column) -> Column:
    """A marker without its parentheses, in lower case: what a cell's marker and its footnote are matched on."""
    return F.lower(F.btrim(F.trim(token), F.lit("()")))


def total_word(text: Column) -> Column:
    """The word that makes a row a total, longest first; null for others."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b(" + "|".join(TOTALS) + r")\b", 1)), F.lit(""))


def is_prose(text: Column, words: int = 12) -> Column:
    return F.size(F.array_remove(F.split(F.trim(text), r"\s+"), "")) >= words


def leader_share(text: Column) -> Column:
    """The share of dots and underscores among a line's characters other than spaces."""
    bare = F.regexp_replace(text, r"\s", "")
    return F.coalesce(F.try_divide(F.length(bare) - F.length(F.regexp_replace(bare, "[._]", "")), F.length(bare)), F.lit(0.0))


def is_retrievable(text: Column) -> Column:
    """Not blank, and not a contents line led by dots."""
    return (F.length(F.regexp_replace(text, r"\s", "")) > 0) & ~(text.rlike(r"[._]{10,}") & (leader_share(text) >= 0.30))


#: Words that name a part of a filing.
PARTS = ("item", "note", "notes", "annexure", "annex", "schedule", "section", "part", "chapter", "appendix")


def heading_level(text: Column, most: int = 120) -> Column:
    """The depth of a dotted number (1 to 4) before a title, 1 for a named part with its number, else null.

    White space is collapsed first. A title has three characters or more,
    begins with a capital and doesn't end a sentence. A number without a dot
    isn't one of a heading: tables are full of them.
    """
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    first, title = F.substring_index(line, " ", 1), F.regexp_extract(line, r"^\S+ (.*)$", 1)
    dotted = first.rlike(r"^[0-9]{1,2}[.]([0-9]{1,2})?([.][0-9]{1,2}){0,2}$")
    depth = F.size(F.array_remove(F.split(first, "[.]"), ""))
    titled = (F.length(title) >= 3) & title.rlike(r"^\p{Lu}") & ~title.rlike("[.!?]$")
    named = line.rlike(r"(?i)^(" + "|".join(PARTS) + r") [0-9IVXLC]{1,6}(?![0-9A-Za-z_])")
    return F.when((F.length(line) > 0) & (F.length(line) <= most), F.when(dotted, F.when(titled, depth)).when(named, F.lit(1)))


def sentences(text: Column) -> Column:
    """A text's sentences: cut at white space after a full stop, question or exclamation mark, before a capital, a bracket or a currency sign."""
    return F.split(text, r"(?<=[.!?])\s+(?=[A-Z(₹$])")


def sanitised_filename(raw: Column) -> Column:
    """The last path part, control characters dropped, dots and spaces trimmed, 255 characters at most; null if nothing is left."""
    base = F.regexp_extract(raw, r"([^/\\]*)$", 1)
    return F.nullif(F.substring(F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1F\x7F]", ""), r"^[. ]+|[. ]+$", ""), 1, 255), F.lit(""))


def object_key(digest: Column) -> Column:
    return F.concat_ws("/", F.lit("originals"), F.lit("sha256"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def neutralised(text: Column) -> Column:
    """Prompt delimiters inside evidence made harmless."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def delimiters_escaped(text: Column) -> Column:
    """The prompt's own tags inside evidence or a question made harmless; other angle brackets stay as written."""
    return F.regexp_replace(text, r"(?i)<(/?\s*(?:passages|passage|question)\b)", "&lt;$1")


def attribute_escaped(text: Column) -> Column:
    """A value that can stand in double quotes in a tag."""
    out = text
    for raw, safe in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def unit_vector(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
