"""Corpus sources: the manifest, and files with their digests and types."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = {".pdf": "application/pdf", ".html": "text/html", ".htm": "text/html", ".xml": "application/xml", ".txt": "text/plain", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}


def load_manifest(spark: SparkSession, path: str, schema, version: int = 1, choices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """A TOML manifest's entries as typed rows; another version, unknown or missing keys, and values that are none of a field's `choices` are refused by entry.

    A choice is taken in any case and with blanks around it, and comes out as it
    is listed.
    """
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    if raw.get("version") != version:
        raise ValueError("another manifest version")
    names, rows = schema.fieldNames(), []
    for i, entry in enumerate(raw.get("entries", [])):
        if set(entry) != set(names):
            raise ValueError(f"entry {i}: keys {sorted(set(entry) ^ set(names))}")
        entry = dict(entry)
        for field, known in (choices or {}).items():
            found = {k.lower(): k for k in known}.get(str(entry[field]).strip().lower())
            if found is None:
                raise ValueError(f"entry {i}: {field} is none of {', '.join(known)}")
            entry[field] = found
        rows.append(tuple(entry[n] for n in names))
    return spark.createDataFrame(rows, schema)


def sniffed(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "application/pdf").when(head.startswith("504B0304"), "application/zip").when(F.lower(F.decode(F.substring(content, 1, 14), "ISO-8859-1")).rlike(r"^\s*<(!doctype|html)"), "text/html").when(head.startswith("3C3F786D6C"), "application/xml")


def media_type(path: Column) -> Column:
    """The media type an extension stands for, or null."""
    pairs = [x for k, v in MEDIA.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"(\.[^.?#/]+)(?:[?#].*)?$", 1)))
