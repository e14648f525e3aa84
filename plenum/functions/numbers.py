"""Column functions for Dutch number and money texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import let


def dutch_number(raw: Column) -> Column:
    """Text to double: blanks, €, $ and a last % are dropped; mln, mlj, miljoen, mrd and miljard scale what stands before them;
    a comma is decimal; dots group thousands beside a comma, before three last digits, or if there are several."""
    million, billion = r"(ml[nj]|miljoen).*$", r"(mrd|miljard).*$"
    scale = lambda x: F.when(x.rlike(million), 1e6).when(x.rlike(billion), 1e9).otherwise(1.0)
    unscaled = lambda x: F.when(x.rlike(million), F.regexp_replace(x, million, "")).otherwise(F.regexp_replace(x, billion, ""))
    grouped = lambda x: x.contains(",") | x.rlike(r"^[^.]*\.[^.]{3}$") | x.rlike(r"\..*\.")
    plain = lambda x: F.when(grouped(x), F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(x)
    value = lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), x.try_cast("double"))
    bare = F.lower(F.regexp_replace(F.regexp_replace(raw, r"[€$\s\u00a0]", ""), "%$", ""))
    return let(bare, lambda x: let(unscaled(x), lambda y: let(plain(y), value)) * scale(x))


def has_number(cell: Column) -> Column:
    """Whether a cell holds a digit."""
    return F.coalesce(cell.rlike(r"\d"), F.lit(False))


def euro_amount(raw: Column, multiplier: Column | None = None) -> Column:
    """Text to decimal(18,2), half-even: parentheses, a leading or trailing minus are negative; a hundred billion and more is no amount."""
    factor = (multiplier if multiplier is not None else F.lit(1)).cast("decimal(12,0)")
    in_full = lambda d: F.when(d.contains(","), F.regexp_replace(F.regexp_replace(d, r"\.", ""), ",", ".")).when(d.rlike(r"^\d{1,3}(\.\d{3})+$"), F.regexp_replace(d, r"\.", "")).otherwise(d)
    value = lambda p: F.when(p.rlike(r"^\d+(\.\d+)?$"), p.try_cast("decimal(30,6)")) * factor
    signed = lambda x, v: F.bround(F.when(x.rlike(r"^\(.*\)$") | x.startswith("-") | x.endswith("-"), -v).otherwise(v), 2)
    bounded = lambda a: F.when(F.abs(a) < F.lit("100000000000").cast("decimal(18,2)"), a).try_cast("decimal(18,2)")
    digits = lambda x: let(F.regexp_replace(x, r"[()\-]", ""), lambda d: let(in_full(d), value))
    return let(F.regexp_replace(raw, r"[€\s\u00a0]", ""), lambda x: let(digits(x), lambda v: let(signed(x, v), bounded)))


def multiplier(header: Column) -> Column:
    """'x 1.000' or 'x € 1.000' in a header to its factor, else 1."""
    found = F.regexp_replace(F.regexp_extract(F.lower(header), r"x\s*€?\s*(1(?:[.\s]?000)+)", 1), r"[.\s]", "")
    return F.coalesce(F.nullif(found, F.lit("")).cast("long"), F.lit(1))


def short_money(n: Column) -> Column:
    """€ 1.2 mrd, € 3.4 mln, or grouped thousands."""
    size = F.abs(n)
    return F.when(size >= 1e9, F.format_string("€ %.1f mrd", n / 1e9)).when(size >= 1e6, F.format_string("€ %.1f mln", n / 1e6)).otherwise(F.concat(F.lit("€ "), F.format_number(n, 0)))
