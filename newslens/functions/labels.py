"""Keys and readable names of topic entries. NULL marks an entry to drop."""

from pyspark.sql import Column, functions as F

from newslens import dims
from newslens.functions.fields import once, title_case, trimmed

MIN_THEME_LENGTH = 3
MAX_THEME_WORDS = 4
MIN_ORG_LENGTH = 2


def theme_family_kept(
    code: Column, drop_prefixes=dims.THEME_DROP_PREFIXES
) -> Column:
    """Plain prefix tests: cheap enough to run on every mention, before any aggregation."""
    keep = F.lit(True)
    for prefix in drop_prefixes:
        keep = keep & ~F.startswith(code, F.lit(prefix))
    return keep


def theme_key(
    code: Column,
    drop_prefixes=dims.THEME_DROP_PREFIXES,
    strip_prefixes=dims.THEME_STRIP_PREFIXES,
    stop_labels=dims.THEME_STOP_LABELS,
) -> Column:
    """Theme code to lower-case label: ``ECON_STOCKMARKET`` becomes ``stockmarket``."""
    stripped = code
    for prefix in reversed(strip_prefixes):
        rest = F.substr(code, F.lit(len(prefix) + 1))
        stripped = F.when(F.startswith(code, F.lit(prefix)), rest).otherwise(stripped)

    def usable(key):
        blanks = F.char_length(key) - F.char_length(F.replace(key, F.lit(" "), F.lit("")))
        return F.when(
            (F.char_length(key) >= MIN_THEME_LENGTH) & (blanks < MAX_THEME_WORDS) & ~key.isin(*stop_labels), key
        )

    return F.when(
        theme_family_kept(code, drop_prefixes) & (F.translate(code, "0123456789", "") == code),
        once(F.lower(trimmed(F.translate(stripped, "_", " "))), usable),
    )


def theme_label(code: Column, **rules) -> Column:
    """Readable theme: ``ECON_STOCKMARKET`` becomes ``Stockmarket``."""
    return title_case(theme_key(code, **rules))


def org_key(raw: Column, stops=dims.ORG_STOPS) -> Column:
    """Lower-case organisation, unless it is too short or on the stop list."""
    return once(
        F.lower(trimmed(raw)), lambda key: F.when((F.char_length(key) >= MIN_ORG_LENGTH) & ~key.isin(*stops), key)
    )
