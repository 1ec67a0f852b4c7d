"""Format fixers and type coercions as Column expressions; a value that cannot be fixed stays as it is."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .exprs import matches, strip

# Accepted date and date-time patterns, the first that parses wins; currency signs; truth tokens.
DATE_PATTERNS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "yyyy.M.d", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy"]
DATETIME_PATTERNS = ["yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "d/M/yyyy H:m:s", "M/d/yyyy H:m:s"]
CURRENCY_SIGNS = r"[£€$¥₹₩฿,\s]"
TRUE_TOKENS = ["1", "true", "yes", "y", "t", "on"]
FALSE_TOKENS = ["0", "false", "no", "n", "f", "off"]

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?i:inf|infinity)"


def to_number(c: Column) -> Column:
    """A double, or NULL: hexadecimal, grouped and suffixed numbers are no numbers."""
    s = strip(c.cast("string"))
    return F.when(matches(s, NUMBER), F.regexp_replace(s, r"(?i)^([+-]?)inf(?:inity)?\z", "$1Infinity").try_cast("double"))


def to_integer(c: Column) -> Column:
    """A long, or NULL where the value is no number or has a fraction."""
    d = to_number(c)
    return F.when(d == F.floor(d), d.try_cast("long"))


def shape(pattern: str) -> str | None:
    """What any text that the date pattern parses looks like; None where the pattern holds more than numbers, months and literals."""
    out = []
    for m in re.finditer(r"'([^']+)'|([A-Za-z])\2*|(.)", pattern):
        quoted, letter, other = m.groups()
        if (letter and letter not in "yMdHms") or (other and other in "[]{}#'"):
            return None
        out.append((r"\D+" if m[0].startswith("MMM") else r"[+-]?\d+") if letter else f"(?i:{re.escape(quoted or other)})")
    return rf"\s*{''.join(out)}\s*"


def first_parsed(c: Column, patterns: list[str]) -> Column:
    """Only texts of a pattern's shape are parsed by it: a failed parse costs an exception, a failed match next to nothing."""
    tries = ((F.try_to_timestamp(c, F.lit(p)), shape(p)) for p in patterns)
    return F.coalesce(*(F.when(matches(c, s), t) if s else t for t, s in tries))


def to_timestamp(c: Column, pattern: str | None = None) -> Column:
    return first_parsed(strip(c.cast("string")), [pattern] if pattern else [*DATETIME_PATTERNS, *DATE_PATTERNS])


def to_boolean(c: Column) -> Column:
    s = F.lower(strip(c.cast("string")))
    return F.when(s.isin(TRUE_TOKENS), True).when(s.isin(FALSE_TOKENS), False)


def fix_email(c: Column) -> Column:
    return F.lower(strip(c))


def fix_phone(c: Column, form: str = "E164") -> Column:
    digits = F.regexp_replace(c, r"[^0-9]", "")
    if form != "E164":
        return digits
    return F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits)).otherwise(digits)


def fix_date(c: Column, pattern: str | None = None) -> Column:
    """ISO date. Ambiguous dates are day first, as the patterns stand in that order."""
    return F.coalesce(F.date_format(first_parsed(strip(c), [pattern] if pattern else DATE_PATTERNS), "yyyy-MM-dd"), c)


def fix_datetime(c: Column, pattern: str | None = None) -> Column:
    return F.coalesce(F.date_format(first_parsed(strip(c), [pattern] if pattern else [*DATETIME_PATTERNS, *DATE_PATTERNS]), "yyyy-MM-dd'T'HH:mm:ss"), c)


def fix_currency(c: Column) -> Column:
    return F.coalesce(to_number(F.regexp_replace(c, CURRENCY_SIGNS, "")).cast("string"), c)


def fix_percentage(c: Column) -> Column:
    return F.coalesce(to_number(strip(F.regexp_replace(strip(c), r"%+\z", ""))).cast("string"), c)


def fix_zipcode(c: Column) -> Column:
    """United States codes of three to five digits are padded to five."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(digits).between(3, 5), F.lpad(digits, 5, "0")).otherwise(c)


def fix_url(c: Column) -> Column:
    """Scheme and host in lower case; the host ends at the first slash."""
    s = strip(c)
    head = F.regexp_extract(s, r"^([^:/]*://[^/]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.substring(s, F.length(head) + 1, F.length(s)))).otherwise(s)


def title_case(c: Column) -> Column:
    """Each run of letters starts upper case, as in O'Neil; initcap() starts words at spaces alone."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 2**30))))


def normalise_category(c: Column, *, trim: bool = True, case: str | None = "lower", aliases: dict[str, str] | None = None, allowed: list[str] | None = None, unknown: str = "UNKNOWN") -> Column:
    """Strip, then case, then aliases (their keys are in the case asked for), then ``unknown`` for what is not allowed."""
    out = strip(c) if trim else c
    out = {"lower": F.lower, "upper": F.upper, "title": title_case}.get(case or "", lambda x: x)(out)
    if aliases:
        pairs = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
        out = F.coalesce(F.try_element_at(pairs, out), out)
    if allowed is not None:
        out = F.when(out.isNotNull() & ~out.isin(allowed), F.lit(unknown)).otherwise(out)
    return out


#: Semantic type to fixer; users may add their own.
FIXERS: dict[str, Callable[[Column], Column]] = {
    "email": fix_email, "phone": fix_phone, "date": fix_date, "datetime": fix_datetime, "currency": fix_currency,
    "percentage": fix_percentage, "zipcode": fix_zipcode, "url": fix_url,
}


def register_sql(spark: SparkSession) -> list[str]:
    """The expressible fixers as SQL functions, inlined by the optimiser: SELECT tm_fix_email(c)."""
    bodies = {
        "tm_fix_email": r"lower(regexp_replace(c, '^\\s+|\\s+$', ''))",
        "tm_fix_zipcode": "CASE WHEN length(regexp_replace(c, '[^0-9]', '')) BETWEEN 3 AND 5 THEN lpad(regexp_replace(c, '[^0-9]', ''), 5, '0') ELSE c END",
        "tm_digits": "regexp_replace(c, '[^0-9]', '')",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(c STRING) RETURNS STRING RETURN {body}")
    return list(bodies)
