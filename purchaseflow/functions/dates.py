"""Date standardisation (FN3 ladder + FN4 regex fallback) to ``DD-MM-YYYY`` text.

Each format is a ``try_to_date`` call guarded by a regular expression that accepts exactly
what the matching ``strptime`` directive accepts (Spark's parser is more lenient: ``M``
takes ``012`` as December).  First success wins, so format order is part of the semantics.
Formats are dispatched by shape: what is left of a text without its digits (two separators,
or words), and where its year stands, leave two guarded formats at most to try.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field patterns of the strptime directives used by the ladder.
_M = r"(1[0-2]|0[1-9]|[1-9])"
_D = r"(3[01]|[12][0-9]|0[1-9]|[1-9])"
_Y4 = r"[0-9]{4}"
_Y2 = r"[0-9]{2}"
_NAME = r"[A-Za-z]+"

# The ladder of accepted date formats, in the order they are tried.
# (strptime form, guard regex, Spark pattern, needs two-digit-year expansion,
#  needs whitespace collapse)
LADDER = [
    ("%Y-%m-%d", f"^{_Y4}-{_M}-{_D}$", "yyyy-M-d", False, False),
    ("%m/%d/%Y", f"^{_M}/{_D}/{_Y4}$", "M/d/yyyy", False, False),
    ("%d/%m/%Y", f"^{_D}/{_M}/{_Y4}$", "d/M/yyyy", False, False),
    ("%m-%d-%Y", f"^{_M}-{_D}-{_Y4}$", "M-d-yyyy", False, False),
    ("%d-%m-%Y", f"^{_D}-{_M}-{_Y4}$", "d-M-yyyy", False, False),
    ("%B %d, %Y", rf"^{_NAME}\s+{_D},\s+{_Y4}$", "MMMM d, yyyy", False, True),
    ("%d %B %Y", rf"^{_D}\s+{_NAME}\s+{_Y4}$", "d MMMM yyyy", False, True),
    ("%m/%d/%y", f"^{_M}/{_D}/{_Y2}$", "M/d/yyyy", True, False),
    ("%d/%m/%y", f"^{_D}/{_M}/{_Y2}$", "d/M/yyyy", True, False),
    ("%Y/%m/%d", f"^{_Y4}/{_M}/{_D}$", "yyyy/M/d", False, False),
    ("%d.%m.%Y", rf"^{_D}\.{_M}\.{_Y4}$", "d.M.yyyy", False, False),
    ("%m.%d.%Y", rf"^{_M}\.{_D}\.{_Y4}$", "M.d.yyyy", False, False),
]

# Fixed value: the fallback search pattern (three digit groups split by - . or /).
FALLBACK_PATTERN = r"([0-9]{1,4})[-./]([0-9]{1,2})[-./]([0-9]{1,4})"

OUTPUT_FORMAT = "dd-MM-yyyy"


def _expand_two_digit_year(s: Column) -> Column:
    # strptime's %y pivot: 69-99 -> 19yy, 00-68 -> 20yy.
    yy = F.regexp_extract(s, r"([0-9]{2})$", 1)
    century = F.when(yy.cast("int") >= 69, F.lit("19")).otherwise(F.lit("20"))
    return F.concat(F.regexp_replace(s, r"[0-9]{2}$", ""), century, yy)


def parse_date_ladder(s: Column, day_first: bool = False) -> Column:
    """FN3: DATE of the first ladder format that parses ``s``; null when none does."""
    ladder = list(LADDER)
    if day_first:  # put d-M-yyyy ahead of M-d-yyyy (quirk K1 fix, opt-in)
        ladder[3], ladder[4] = ladder[4], ladder[3]
    def tried(*numbers: int) -> Column:
        """The first of some formats that parses."""
        found = []
        for _, guard, pattern, two_digit, collapse in (ladder[i] for i in numbers):
            text = s
            if two_digit:
                text = _expand_two_digit_year(s)
            if collapse:
                text = F.regexp_replace(s, r"\s+", " ")
            found.append(F.when(s.rlike(guard), F.try_to_date(text, pattern)))
        return F.coalesce(*found)

    # No two shapes share a format, so the order of the ladder holds within each.
    shape = F.translate(s, "0123456789", "")
    short_year = F.substring(s, -3, 1) == "/"
    return (F.when(shape == "--", F.when(F.instr(s, "-") == 5, tried(0)).otherwise(tried(3, 4)))
            .when(shape == "//", F.when(F.instr(s, "/") == 5, tried(9)).when(short_year, tried(7, 8)).otherwise(tried(1, 2)))
            .when(shape == "..", tried(10, 11))
            .otherwise(tried(5, 6)))


def _zfill2(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def fallback_date_text(s: Column) -> Column:
    """FN4: rebuild ``DD-MM-YYYY`` from the first three digit groups, with no calendar
    check; the original text when nothing matches."""
    p1 = F.regexp_extract(s, FALLBACK_PATTERN, 1)
    p2 = F.regexp_extract(s, FALLBACK_PATTERN, 2)
    p3 = F.regexp_extract(s, FALLBACK_PATTERN, 3)
    year_first = F.length(p1) == 4
    year_last = F.length(p3) == 4
    swap = p2.cast("int") > 12  # month-first guess, swapped when the "day" exceeds 12
    day = F.when(year_first, p3).when(year_last, p1).when(swap, p1).otherwise(p2)
    month = F.when(year_first, p2).when(year_last, p2).when(swap, p2).otherwise(p1)
    year = F.when(year_first, p1).otherwise(p3)
    year = F.when(F.length(year) == 2,
                  F.concat(F.when(year.cast("int") > 50, F.lit("19")).otherwise(F.lit("20")), year)
                  ).otherwise(year)
    rebuilt = F.concat_ws("-", _zfill2(day), _zfill2(month), year)
    return F.when(s.rlike(FALLBACK_PATTERN), rebuilt).otherwise(s)


def standardize_date(s: Column, day_first: bool = False) -> Column:
    """FN3 + FN4: ``DD-MM-YYYY`` text; blank stays blank, null stays null."""
    parsed = parse_date_ladder(s, day_first)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s == "", F.lit(""))
            .otherwise(F.coalesce(F.date_format(parsed, OUTPUT_FORMAT), fallback_date_text(s))))


def date_value(text: Column) -> Column:
    """Strict DATE of a standardised text; null for fallback output that is no real date."""
    return F.when(text.rlike(r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$"), F.try_to_date(text, OUTPUT_FORMAT))
