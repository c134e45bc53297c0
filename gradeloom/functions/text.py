"""Text functions: trimming, entry cleaning, sort keys and file names."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's ``\s`` understands it. Java's ``(?U)\s`` lacks the
# four information separators.
BLANK = r"[\s\x1c-\x1f]"
_BLANKS = "".join(c for c in map(chr, range(0x10000)) if c.isspace())


def strip(value: Column) -> Column:
    """Remove all Unicode white space on both sides (``trim`` removes U+0020 only)."""
    return F.trim(value, F.lit(_BLANKS))


def is_blank(value: Column) -> Column:
    """True for null and for text of white space only."""
    return value.isNull() | value.rlike(rf"(?U)^{BLANK}*$")


def single_line(value: Column) -> Column:
    """Each line break becomes one space, with the blanks around it; ends are trimmed."""
    spaced = F.regexp_replace(value, rf"(?U){BLANK}*\n{BLANK}*", " ")
    return strip(F.when(F.contains(value, F.lit("\n")), spaced).otherwise(value))


def clean_entry(value: Column) -> Column:
    """Collapse white space, then glue a lone RA/EM to the code before it."""
    flat = F.trim(F.regexp_replace(value, rf"(?U){BLANK}+", " "))
    glued = F.regexp_replace(
        flat, rf"(?U)([A-Za-z0-9_]+){BLANK}+(RA|EM)(?={BLANK}*\(\d+\))", "$1$2"
    )
    # The cheap test spares most entries the slower replacement.
    return F.when(flat.rlike(rf"(?U){BLANK}(?:RA|EM){BLANK}*\("), glued).otherwise(flat)


def remove_blanks(value: Column) -> Column:
    return F.regexp_replace(value, rf"(?U){BLANK}+", "")


def blank_literal_na(value: Column) -> Column:
    """A cell holding only the marker ``NA`` becomes empty."""
    return F.when(value.rlike(rf"(?U)^{BLANK}*NA{BLANK}*$"), F.lit("")).otherwise(value)


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Per-character form of: casefold, ``ñ`` to ``nz``, decompose, drop combining marks.

    Returns the two arguments of ``translate`` and the characters that fold into several
    letters. Hangul syllables keep their composed form, whose order is the same among them.
    """
    single_from, single_to, deleted, several = [], [], [], {}
    for point in range(0x10000):
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue
        char = chr(point)
        folded = unicodedata.normalize("NFD", char.casefold().replace("ñ", "nz"))
        folded = "".join(c for c in folded if unicodedata.category(c) != "Mn")
        if folded == char:
            continue
        if len(folded) == 1:
            single_from.append(char)
            single_to.append(folded)
        elif not folded:
            deleted.append(char)
        else:
            several[char] = folded
    return "".join(single_from + deleted), "".join(single_to), several


def _ranges(chars) -> str:
    """A regular-expression class of these characters, neighbours joined to ranges."""
    points, parts = sorted(map(ord, chars)), []
    for point in points:
        if parts and parts[-1][1] == point - 1:
            parts[-1][1] = point
        else:
            parts.append([point, point])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in parts) + "]"


def spanish_key(value: Column) -> Column:
    """Sort key that ignores case and accents but puts ``ñ`` after ``n``."""
    matching, replacement, several = _folding()
    text = F.coalesce(value, F.lit(""))
    common = {c: several[c] for c in ("ñ", "Ñ", "ß")}
    rare = {c: s for c, s in several.items() if c not in common}
    full = text
    for char, letters in common.items():
        full = F.replace(full, F.lit(char), F.lit(letters))
    table = F.from_json(F.lit(json.dumps(rare)), "map<string,string>")
    spelled = F.array_join(
        F.transform(F.split(full, ""), lambda c: F.coalesce(F.element_at(table, c), c)), ""
    )
    full = F.when(full.rlike(_ranges(rare)), spelled).otherwise(full)
    # Most text is plain ASCII, where folding is lower case.
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(full, matching, replacement)).otherwise(
        F.lower(text)
    )


def file_name(path: Column) -> Column:
    """Last part of a path, without trailing slashes."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(name: Column) -> Column:
    """The last ``.ext`` of a file name; none for dot-files and for a final dot."""
    return F.regexp_extract(name, r"(?s)^.*[^/](\.[^./]+)$", 1)


def stem(name: Column) -> Column:
    """File name without its last suffix."""
    return F.left(name, F.length(name) - F.length(suffix(name)))


