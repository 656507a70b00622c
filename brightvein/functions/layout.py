"""Geometry, locators and identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def displayed(box: Column, rotation: Column, width: Column, height: Column) -> Column:
    """A box of the unrotated page as displayed: `x0`, `y0`, `x1`, `y1` after a turn of 0, 90, 180 or 270 degrees."""
    x0, y0, x1, y1 = (box[n] for n in ("x0", "y0", "x1", "y1"))
    corners = lambda *v: F.struct(*(c.alias(n) for c, n in zip(v, ("x0", "y0", "x1", "y1"))))
    turned = {90: corners(height - y1, x0, height - y0, x1), 180: corners(width - x1, height - y1, width - x0, height - y0), 270: corners(y0, width - x1, y1, width - x0)}
    out = corners(x0, y0, x1, y1)
    for angle, c in turned.items():
        out = F.when(rotation == angle, c).otherwise(out)
    return out


def cell_locator(page: Column, table: Column, row: Column, column: Column) -> Column:
    """`p. 3, table 2, R1C2`; `row` and `column` count from 0, what is shown from 1."""
    return F.format_string("p. %d, table %d, R%dC%d", page, table, row + 1, column + 1)


def footnote_locator(locator: Column, marker: Column) -> Column:
    """`p. 3, table 2, footnote a`; without a marker just a footnote."""
    known = F.nullif(F.trim(F.coalesce(marker, F.lit(""))), F.lit(""))
    return F.concat_ws(" ", F.concat(locator, F.lit(", footnote")), known)


def page_label(pages: Column) -> Column:
    """`Page: 3` or `Pages: 3-5`; null for none."""
    low, high = F.array_min(pages), F.array_max(pages)
    return F.when(low == high, F.concat(F.lit("Page: "), low)).when(low < high, F.concat(F.lit("Pages: "), low, F.lit("-"), high))


def name_uuid(space: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name in a name space."""
    h = F.sha1(F.concat(F.lit(space.bytes), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
