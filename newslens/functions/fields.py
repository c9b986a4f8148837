"""Parsing and formatting of article fields."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

WHITESPACE = " \t\n\r\x0b\x0c"


def _div(a: Column, b: int) -> Column:
    """Integer division: SQL's ``div``, which never goes through a double."""
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: a one-element transform binds it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def packed_date(packed: Column) -> Column:
    """Integer ``YYYYMMDDHHMMSS`` (or ``YYYYMMDD``) to DATE, by arithmetic instead of text parsing.

    An impossible date raises under ANSI mode.
    """
    day = F.when(packed >= 10**13, _div(packed, 10**6)).otherwise(packed)
    year, month, dom = _div(day, 10000), _div(day, 100) % 100, day % 100
    return F.make_date(year.cast("int"), month.cast("int"), dom.cast("int"))


def packed_instant(packed: Column) -> Column:
    """Integer ``YYYYMMDDHHMMSS`` in UTC to TIMESTAMP, whatever the session time zone."""
    clock = packed % 10**6
    seconds = _div(clock, 10000) * 3600 + _div(clock, 100) % 100 * 60 + clock % 100
    days = F.unix_date(packed_date(packed)).cast("bigint")
    return F.timestamp_seconds(days * 86400 + seconds)


def first_tone(packed: Column, strict: bool = True) -> Column:
    """First number of the comma-packed tone. Strict raises on text that is no number, else NULL."""
    head = F.substring_index(packed, ",", 1)
    return head.cast("double") if strict else head.try_cast("double")


def trimmed(text: Column) -> Column:
    """Trim every kind of ASCII whitespace, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def domain_name(source: Column) -> Column:
    return F.lower(trimmed(source))


def domain_tld(source: Column) -> Column:
    """Last label of a domain; a name without a dot is its own TLD."""
    return F.substring_index(domain_name(source), ".", -1)


def slugify(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def js_round(x: Column) -> Column:
    """Half rounds up, toward positive infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def round2(x: Column) -> Column:
    return F.bround(x, 2)


def iso_date_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def valid_country(iso3: Column) -> Column:
    return iso3.isNotNull() & (F.char_length(iso3) == 3)


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))

    def capitalized(run):
        # The capital of one letter may be two letters long (ß), of which only one stays large.
        capital = F.upper(F.substring(run, 1, 1))
        return F.concat(
            F.substring(capital, 1, 1), F.lower(F.substr(capital, F.lit(2))), F.substr(run, F.lit(2))
        )

    return F.array_join(F.transform(runs, capitalized), "")
