"""Column builders for text: all of them stay in the JVM, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: White space as Unicode has it; no-break spaces and the separators 1C to 1F count.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def blank(c: Column) -> Column:
    """True for null, empty and blank text; zero-width characters and no-break spaces count as blank."""
    return F.coalesce(F.length(F.regexp_replace(c, r"[\p{Z}\s\p{Cf}]+", "")) == 0, F.lit(True))


def plain(c: Column) -> Column:
    """The words (runs of letters or digits) in lower case, parted by single blanks; empty text if there are none."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def words(c: Column) -> Column:
    """Runs of letters or digits in lower case, in order; null stays null."""
    return F.filter(F.split(plain(c), " "), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower case split on Unicode white space without empty strings (the BM25 tokeniser)."""
    return F.filter(F.split(F.lower(c), SPACE), lambda x: x != "")


def source_key(c: Column) -> Column:
    """One spelling of a source: case, blanks, hyphens and underscores do not count; empty becomes null."""
    k = F.regexp_replace(F.lower(c), r"[\p{Z}\s\p{Cf}_\-]+", "")
    return F.when(k != "", k)


def strip_case(c: Column) -> Column:
    """Without a closing case number such as `` (Case 3)``."""
    return F.regexp_replace(c, r"\s*\(Case\s+\d+\)$", "")


def squeeze(c: Column) -> Column:
    """NUL to blank, runs of white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "\u0000", " "), r"\s+", " "))


def strip_quotes(c: Column) -> Column:
    """Surrounding double quotes go if the text starts with one."""
    return F.when(c.startswith('"'), F.regexp_replace(c, r'^"+|"+$', "")).otherwise(c)


def keywords(c: Column) -> Column:
    """Distinct keywords of a name: underscores are blanks, three letters at least, no filler words."""
    parts = F.split(F.lower(F.regexp_replace(c, "_", " ")), r"\s+")
    return F.filter(parts, lambda x: (F.length(x) > 2) & ~x.isin("the", "and", "for", "with"))


def safe_filename(c: Column) -> Column:
    """A name without characters that file systems refuse; blanks become underscores."""
    return F.translate(F.regexp_replace(c, r'[<>:"/\\|?*]', ""), " ", "_")
