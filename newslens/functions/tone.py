"""Tone weighting and the numeric part of the map scales."""

from pyspark.sql import Column, functions as F

# Fixed values of the intensity curve.
INNER_BAND = 1.0    # tones up to here use most of the scale
TAIL = 4.0          # further distance until full intensity
INNER_SHARE = 0.75
INNER_POWER = 0.7
TONE_CLAMP = 10.0


def covered(tone: Column | str = "avg_tone", n: Column | str = "article_count") -> Column:
    """A cube row with articles of its own, not a filled silent day."""
    tone, n = F.col(tone) if isinstance(tone, str) else tone, F.col(n) if isinstance(n, str) else n
    return tone.isNotNull() & (n > 0)


def weighted_tone(where: Column | None = None) -> Column:
    """Volume-weighted mean tone over covered rows; NULL when they carry no weight."""
    keep = covered() if where is None else covered() & where
    mass = F.sum(F.when(keep, F.col("avg_tone") * F.col("article_count")))
    return F.try_divide(mass, volume(where).cast("double"))


def volume(where: Column | None = None) -> Column:
    """Articles of the covered rows."""
    keep = covered() if where is None else covered() & where
    return F.sum(F.when(keep, F.col("article_count")))


def tone_intensity(tone: Column, n: Column) -> Column:
    """0..1 strength of a tone: steep within the inner band, slow in the tail, 0 without coverage."""
    mag = F.abs(F.greatest(F.lit(-TONE_CLAMP), F.least(F.lit(TONE_CLAMP), tone)))
    inner = F.pow(F.least(F.lit(1.0), mag / INNER_BAND), F.lit(INNER_POWER))
    outer = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mag - INNER_BAND) / TAIL))
    return F.when(
        tone.isNotNull() & (n != 0), INNER_SHARE * inner + (1 - INNER_SHARE) * outer
    ).otherwise(F.lit(0.0))


def volume_ratio(n: Column, largest: Column) -> Column:
    return F.when((n == 0) | (largest == 0), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), n / largest)
    )
