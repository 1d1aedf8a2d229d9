"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taufold.functions.values import EXCLUDED_KEYWORDS, MISSING_MARK

# Unicode-aware classes; Java's \s and \d alone are ASCII.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
DIGIT = r"\p{Nd}"
LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]"


# Unicode white space and separators, one by one, for trimming from both ends.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim Unicode white space; looks at the ends only, unlike a regular expression."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def split_lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def strip_outline_number(c: Column) -> Column:
    """'1.2.3. Name' -> 'Name'."""
    return F.regexp_replace(c, rf"^{DIGIT}+(\.{DIGIT}+)*\.{SPACE}*", "")


def code_in_parentheses(c: Column) -> Column:
    """Text inside the first parentheses; NULL where there are none."""
    found = F.regexp_extract(c, r"\(([^)]+)\)", 1)
    return F.when(found != "", found)


def leading_integer(c: Column) -> Column:
    """'[3] text' or '3 text' -> 3, else NULL."""
    digits = F.regexp_extract(strip(c.cast("string")), rf"^\[?({DIGIT}+)\]?", 1)
    return F.when(digits != "", digits).try_cast("bigint")


def is_term_line(line: Column) -> Column:
    """True for page lines that are terms: no excluded keyword, not a page or section number."""
    lowered = F.lower(line)
    excluded = F.lit(False)
    for word in EXCLUDED_KEYWORDS:
        excluded = excluded | lowered.contains(word)
    page_number = line.rlike(f"^{DIGIT}+$")
    section_number = strip(F.substring(line, 1, 2)).rlike(f"^{DIGIT}+$")
    return ~excluded & ~page_number & ~section_number


def strip_page_number(line: Column) -> Column:
    """'Name 123' -> 'Name'; NULL where nothing is left."""
    name = strip(F.regexp_replace(line, rf"{SPACE}+{DIGIT}+$", ""))
    return F.when(name != "", name)


def split_terms(c: Column) -> Column:
    """Lower-cased terms between '|' and ',', without four-digit years and empty terms."""
    lowered = F.lower(strip(c))
    no_years = F.regexp_replace(lowered, rf"(?<!{WORD}){DIGIT}{{4}}(?!{WORD})", "")
    parts = F.transform(F.split(no_years, r"[|,]"), strip)
    return F.when(lowered == MISSING_MARK, F.array().cast("array<string>")).otherwise(F.filter(parts, lambda t: t != ""))


def bin_order_key(label: Column) -> Column:
    """Sort key of a bin label: '20-29' -> 20, '80+' -> 80, otherwise NULL (sort last)."""
    number = F.regexp_extract(label, rf"^{SPACE}*({DIGIT}+){SPACE}*[-+]", 1)
    return F.when(number != "", number).try_cast("bigint")
