"""Grade, code and header functions. A grade is a pair: ``num`` DOUBLE or ``text`` STRING."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_literal_na, remove_blanks, strip

# The three code/grade patterns of a report entry, the status markers and the
# pass marks.
RA_PATTERN = (
    r"(?iU)([A-Za-z0-9]{3,5}_[A-Za-z0-9 ]{4,5}\s*_\d(?:\s*\d)RA)"
    r"\s\(\d\)\s*-\s*(A\d{1,2}|PDT|EP|NA)?"
)
EM_PATTERN = (
    r"(?iU)([A-Za-z0-9]{3,5}_[A-Za-z0-9 ]{4,5}_\d(?:\s*\d)EM)"
    r"\s\(\d\)\s*-\s*(A\d{1,2}|PDT|EP|NA)?"
)
MP_PATTERN = (
    r"(?iU)(?<!\S)([A-Za-z0-9]{3,5}_[A-Za-z0-9 ]{4,5})"
    r"\s*\(\d\)\s*-\s*(A?\d{1,2}|PDT|EP|NA|PQ)?(?!\S)"
)
EM_CODE_PATTERN = r"(?iU)([A-Za-z0-9]{3,5}_[A-Za-z0-9 ]{4,5}_\d(?:\s*\d)EM)\s\(\d\)"
PATTERNS = {"RA": RA_PATTERN, "EM": EM_PATTERN, "MP": MP_PATTERN}
CODE_HEADER = r"(?i)^Codi \(Conv\) - Qual(?:\.\d+)?$"
NAME_KEYWORD = "nom i cognoms"
IRRELEVANT_HEADERS = ("MC", "H", "Pas de curs", "MH")
SUMMARY_HEADER = r"^([A-Za-z0-9]{3,5})(?:_.*RA| CENTRE| EMPRESA)?$"
PENDING_MARKERS = ("PDT", "EP", "NA", "PQ")
REVIEW_MARKERS = ("PDT", "EP", "PQ")
PASS_MARK, CENTRE_PASS_MARK = 5.0, 4.5
CENTRE_MAX, WHOLE_MAX = 9, 10


def grade_num(raw: Column) -> Column:
    """``A7`` and ``7`` are numbers; anything else (``a7`` too) is not."""
    return F.regexp_extract(raw, r"^A?(\d+)$", 1).try_cast("double")


def grade_text(raw: Column) -> Column:
    """The text part of a grade: null where :func:`grade_num` found a number."""
    return F.when(grade_num(raw).isNull(), raw)


def show_number(num: Column) -> Column:
    """Whole numbers without decimals."""
    whole = num.cast("long")
    return F.when(num == whole, whole.cast("string")).otherwise(num.cast("string"))


def display(num: Column, text: Column) -> Column:
    """One text per grade: number, else text, else empty. Literal ``nan`` counts as missing."""
    return F.coalesce(show_number(num), F.when(text != "nan", text), F.lit(""))


def sheet_text(num: Column, text: Column) -> Column:
    """What the detailed sheet shows: :func:`display` with ``NA`` blanked."""
    return blank_literal_na(display(num, text))


def number_from_text(text: Column) -> Column:
    """Number for plain decimal text only; Spark's cast alone would accept ``7d``."""
    plain = text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")
    return F.when(plain, text.try_cast("double"))


def is_pending(num: Column, text: Column) -> Column:
    """Below the pass mark, a status marker, or any other text that is not a pass."""
    shown = F.upper(strip(text))
    limit = (
        F.when(shown.rlike(r"^-INF(INITY)?$"), F.lit(True))
        .when(shown.rlike(r"^[+-]?NAN$|^\+?INF(INITY)?$"), F.lit(False))
        .when(number_from_text(shown).isNotNull(), number_from_text(shown) < PASS_MARK)
        .otherwise(shown != "")
    )
    return (
        F.when(num.isNotNull(), ~F.isnan(num) & (num < PASS_MARK))
        .when(text.isNull(), F.lit(False))
        .when(shown.isin(*PENDING_MARKERS), F.lit(True))
        .otherwise(limit)
    )


def _status(num: Column, marked: Column, pass_mark: Column) -> Column:
    return (
        F.when(marked, F.lit("marker"))
        .when(num.isNull(), F.lit("invalid"))
        .when(num < pass_mark, F.lit("failing"))
        .otherwise(F.lit("ok"))
    )


def review_status(num: Column, text: Column) -> Column:
    """Detailed sheet: a marker anywhere in the text wins, then not-a-number, then low."""
    found = F.coalesce(F.upper(text).rlike("|".join(REVIEW_MARKERS)), F.lit(False))
    return _status(num, num.isNull() & found, F.lit(PASS_MARK))


def summary_status(num: Column, text: Column, header: Column) -> Column:
    """Summary sheet: markers by equality, and a lower pass mark for CENTRE columns."""
    equal = F.coalesce(F.upper(text).isin(*REVIEW_MARKERS), F.lit(False))
    mark = F.when(header.endswith("CENTRE"), CENTRE_PASS_MARK).otherwise(PASS_MARK)
    return _status(num, num.isNull() & equal, mark)


def in_range(num: Column, text: Column, header: Column) -> Column:
    """CENTRE takes decimals 0-9, other columns whole numbers 0-10; blank is allowed."""
    blank = num.isNull() & (F.coalesce(text, F.lit("")) == "")
    centre = header.endswith("CENTRE") & num.between(0, CENTRE_MAX)
    whole = ~header.endswith("CENTRE") & num.between(0, WHOLE_MAX) & (num == F.floor(num))
    return blank | F.coalesce(centre | whole, F.lit(False))


def rounded_display(num: Column, text: Column, header: Column) -> Column:
    """Two decimals in CENTRE columns, none elsewhere; text as it is."""
    shown = F.when(header.endswith("CENTRE"), F.format_string("%.2f", num)).otherwise(
        F.round(num, 0).cast("long").cast("string")
    )
    return F.when(num.isNotNull(), shown).otherwise(F.coalesce(text, F.lit("")))


def column_kind(header: Column) -> Column:
    """RA / EM / CENTRE / EMPRESA / STUDENT by suffix (case-sensitive); the rest are MP."""
    return (
        F.when(header == "estudiant", "STUDENT")
        .when(header.endswith("RA"), "RA")
        .when(header.endswith("EM"), "EM")
        .when(header.endswith(" CENTRE"), "CENTRE")
        .when(header.endswith(" EMPRESA"), "EMPRESA")
        .otherwise("MP")
    )


def module_of(code: Column) -> Column:
    """Part of a code before the first ``_``."""
    return F.substring_index(code, "_", 1)


def renamed_header(header: Column) -> Column:
    """MP-grade columns shrink to their module code, the others keep their name."""
    return F.when(column_kind(header) == "MP", module_of(header)).otherwise(header)


def summary_module(header: Column) -> Column:
    """Module a sheet header belongs to, null if it is not a grade column."""
    code = F.regexp_extract(header, SUMMARY_HEADER, 1)
    return F.when((code != "") & (F.lower(code) != "estudiant"), code)


def outcome_of(code: Column) -> Column:
    """Part of a code after the last ``_``."""
    return F.substring_index(code, "_", -1)


def _digits(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(label, r"\D", ""), r"^0+(?=.)", "")


def outcome_label(label: Column) -> Column:
    """``01RA`` becomes ``RA1``; labels without digits stay."""
    digits = _digits(label)
    return F.when(digits != "", F.concat(F.lit("RA"), digits)).otherwise(label)


def outcome_order(label: Column) -> Column:
    """Natural order of outcome labels: by all their digits as a number, then by text."""
    digits = F.regexp_replace(_digits(label), "^0$", "")
    return F.struct(
        F.length(digits).alias("size"), digits.alias("digits"), label.alias("label")
    )


def two_line_header(header: Column) -> Column:
    """Line break after the second ``_``."""
    return F.regexp_replace(header, r"(?s)^([^_]*_[^_]*_)(.*)$", "$1\n$2")


def one_line_header(header: Column) -> Column:
    """Inverse of :func:`two_line_header`."""
    return strip(F.replace(header, F.lit("\n"), F.lit("")))


def clean_code(code: Column) -> Column:
    return remove_blanks(code)
