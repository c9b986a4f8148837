"""Row filters and schema probes."""

import calendar
import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from newslens.dims import ERA_BOUNDARIES
from newslens.functions import eras, fields, tone

# A word boundary in the ASCII sense; the JVM's own \b also counts accented letters as words.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _keyword(keyword: str, regex: bool) -> Column:
    keyword = keyword.lower().strip()
    pattern = keyword if regex else re.escape(keyword).replace(r"\ ", " ")
    hits = []
    for column in ("Themes", "V2Persons"):
        text = F.lower(F.coalesce(F.col(column), F.lit("")))
        word = text.rlike(_EDGE + f"(?:{pattern})" + _EDGE)
        # A plain substring test is much cheaper than the regex and rules out most rows.
        hits.append(word if regex else F.contains(text, F.lit(keyword)) & word)
    url = F.lower(F.coalesce(F.col("DocumentIdentifier"), F.lit("")))
    if regex or " " in keyword:
        hits.append(url.rlike(pattern.replace(" ", "[- ]")))
    else:
        hits.append(F.contains(url, F.lit(keyword)))
    return reduce(Column.__or__, hits)


def keyword_match(df: DataFrame, keywords, regex: bool = False) -> DataFrame:
    """Rows that match every keyword; a keyword matches in the themes, the persons or the URL.

    Keywords are literal text; ``regex=True`` takes them as patterns. A space also matches a
    hyphen in the URL.
    """
    keywords = [k for k in keywords if k.strip()]
    if not keywords:
        raise ValueError("at least one keyword is needed")
    return df.filter(reduce(Column.__and__, [_keyword(k, regex) for k in keywords]))


def _automaton(words) -> str:
    """A pattern of all words as a prefix tree, so that a text is compared once and not once per word; the longest word wins."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(letter) + pattern(below) for letter, below in sorted(node.items()) if letter]
        if not branches:
            return ""
        one = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return one + ("?" if "" in node else "")

    return pattern(tree)


def topic_match(df: DataFrame, topics: dict[str, list[str]], column: str = "topic") -> DataFrame:
    """The rows of every topic, in one pass: a row comes once for each topic all of whose keywords it matches, named in ``column``.

    Gives, topic by topic, the rows of :func:`keyword_match`. All keywords are looked for at once, as one prefix tree in the
    joined text of themes, persons and URL; only topics whose keywords were all seen there are tested exactly. So the
    cost of a row grows with its text and its hits, and hardly with the number of topics.
    """
    wanted = {name: sorted({k.lower().strip() for k in keywords if k.strip()}) for name, keywords in topics.items()}
    if not wanted or not all(wanted.values()):
        raise ValueError("every topic needs at least one keyword")
    # In a URL a space of a keyword may be a hyphen; here both are spaces everywhere, which can only find more.
    plain = {k: k.replace("-", " ") for own in wanted.values() for k in own}
    words = sorted(set(plain.values()))
    text = F.translate(F.lower(F.concat_ws("\n", "Themes", "V2Persons", "DocumentIdentifier")), "-", " ")
    # Looking ahead finds words that overlap; of those that begin at one place the longest stands for its beginnings.
    longest = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_automaton(words)}))"), F.lit(1)))
    begins = {w: [v for v in words if w.startswith(v)] for w in words}
    implied = F.create_map(*[x for w in words for x in (F.lit(w), F.array(*[F.lit(v) for v in begins[w]]))])
    seen = F.array_distinct(F.flatten(F.transform(longest, lambda w: F.element_at(implied, w))))
    spotted = df.withColumn("_seen", seen).filter(F.size("_seen") > 0)

    def holds(name: str) -> Column:
        cheap = reduce(Column.__and__, [F.array_contains("_seen", plain[k]) for k in wanted[name]])
        return F.when(cheap & reduce(Column.__and__, [_keyword(k, False) for k in wanted[name]]), F.lit(name))

    found = F.array_compact(F.array(*[holds(name) for name in sorted(wanted)]))
    return spotted.select(*df.columns, F.explode(found).alias(column))


def month_bounds(start: str, end: str) -> tuple[dt.date, dt.date]:
    """First day of the first and last day of the last ``YYYY-MM`` month."""
    first = dt.datetime.strptime(start, "%Y-%m").date()
    last = dt.datetime.strptime(end, "%Y-%m").date()
    return first, last.replace(day=calendar.monthrange(last.year, last.month)[1])


def partition_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Whole months, both ends included: prunes partitions and bounds the packed time."""
    first, last = month_bounds(start, end)
    lo, hi = int(f"{first:%Y%m%d}000000"), int(f"{last:%Y%m%d}235959")
    return df.filter(
        F.col("partition_date").between(F.lit(first), F.lit(last)) & F.col("DATE").between(lo, hi)
    )


def valid_country(df: DataFrame) -> DataFrame:
    return df.filter(fields.valid_country(F.col("country_iso3")))


def covered_only(cube: DataFrame) -> DataFrame:
    return cube.filter(tone.covered())


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys))


def era_slice(df: DataFrame, era: int, boundaries=ERA_BOUNDARIES) -> DataFrame:
    return df.filter(eras.in_era(F.col("date"), era, boundaries))


def with_optional_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give the frame every column of the schema; absent ones become typed NULLs."""
    return df.select(*[
        F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema
    ])
