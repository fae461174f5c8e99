"""Three notions of blank text, as the event contract has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a character that is no white space in the sense of ``has_text``.
NON_SPACE = r"[^\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
#: The white space itself, and the characters up to U+0020.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000]))
CONTROL = "".join(map(chr, range(0x21)))


def trimmed(c: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.btrim(c, F.lit(CONTROL))


def lowered(c: Column) -> Column:
    return F.lower(trimmed(c))


def has_text(c: Column) -> Column:
    """Not null, and some character is no white space; never null."""
    return F.coalesce(F.btrim(c, F.lit(SPACE)) != "", F.lit(False))


def not_blank(c: Column) -> Column:
    """Not null, and something is left when trimmed; never null."""
    return F.coalesce(trimmed(c) != "", F.lit(False))


def trimmed_or_kept(c: Column) -> Column:
    """Trimmed if it has text; white space alone stays as it is."""
    return F.when(has_text(c), trimmed(c)).otherwise(c)


def or_default(c: Column, default: str) -> Column:
    return F.when(has_text(c), trimmed(c)).otherwise(F.lit(default))
