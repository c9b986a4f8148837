"""Headline text from an article URL."""

from pyspark.sql import Column, DataFrame, functions as F

from newslens.functions.fields import once, title_case

# What counts as a readable slug.
EXTENSION = r"(?i)\.(html?|php|aspx?|shtml|jsp)$"
HEX_ID = r"(?i)^[0-9a-f]{8,}$"
LETTER = "[A-Za-zÀ-ÿ]"
MAX_NUMBER_DIGITS = 4
MIN_ALPHA_WORDS = 4
TITLE_LENGTH = (14, 90)


def last_segment(url: Column) -> Column:
    """Last path segment of any string that looks like a URL, without ``;params`` and extension."""
    clean = F.translate(url, "\t\r\n", "")
    path = F.regexp_extract(
        clean, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )
    path = F.rtrim(F.regexp_replace(path, ";[^/]*$", ""), F.lit("/"))
    return F.regexp_replace(F.substring_index(path, "/", -1), EXTENSION, "")


def percent_decode(text: Column) -> Column:
    """Percent-decode; a plus sign and malformed escapes stay as they are."""
    def decoded(t):
        guarded = F.regexp_replace(F.replace(t, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
        return F.when(F.contains(t, F.lit("%")), F.try_url_decode(guarded)).otherwise(t)

    return once(text, decoded)


def url_title(url: Column) -> Column:
    """Readable headline of a URL, or NULL when its slug does not hold one."""
    tokens = F.split(F.translate(percent_decode(last_segment(url)), "_.", "--"), "-")

    def is_word(t):
        # A number holds no letter, and most tokens do.
        return F.when(t.rlike(LETTER), ~t.rlike(HEX_ID)).otherwise(
            t.rlike(r"^\d+$") & (F.char_length(t) <= MAX_NUMBER_DIGITS)
        )

    def headline(words):
        n_alpha = F.size(F.filter(words, lambda t: t.rlike(LETTER)))
        lo, hi = TITLE_LENGTH
        readable = once(
            F.trim(F.array_join(words, " ")),
            lambda title: F.when(F.char_length(title).between(lo, hi), title_case(title)),
        )
        return F.when(n_alpha >= MIN_ALPHA_WORDS, readable)

    return once(F.filter(tokens, is_word), headline)


def with_title(df: DataFrame, url: str, *carry: str) -> DataFrame:
    """The ``carry`` columns and the ``title`` of every row that has one.

    The title is generated, and so derived once: a filter on a computed column would repeat it below.
    """
    titled = F.inline(F.array(F.struct(url_title(F.col(url)).alias("title"))))
    return df.select(*carry, titled).filter(F.col("title").isNotNull())
