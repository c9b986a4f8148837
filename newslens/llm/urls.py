"""URL filter: rules for hosts and paths, and boosted trees for the URLs that no rule decides.

The trees see lexical features alone: lengths, depth, digit ratio, entropy, numbers of parameters, and how
often URLs of the same host suffix are blocked among the labelled ones. All features are column expressions, and Spark's own
trees are trained and applied in the JVM. Suffix statistics are hashed into a fixed number of buckets, so
the table that is joined to every URL does not grow with the number of domains.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from newslens.llm.stored import stored

BLOCK, ALLOW = "block", "allow"
SUFFIX_BUCKETS = 4096
SUFFIX_PRIOR = 100  # labelled URLs that the overall rate counts as in every suffix's own
# Words in the names of hosts that hold no prose; they label URLs where no labelled list is given.
SEED_WORDS = ("ad", "ads", "adult", "bet", "bets", "betting", "casino", "pill", "pills", "poker", "porn", "sex", "spam", "xxx")
_SYMBOLS = string.ascii_lowercase + string.digits + "-_.~%/+"
_DRAW = 1_000_000


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def located(urls: DataFrame) -> DataFrame:
    """Add ``host`` (A-Z in lower case) and ``path`` of ``url``; both are empty where it is null or has no ``://``."""
    url = F.coalesce("url", F.lit(""))
    at = F.locate("://", url)
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return urls.withColumns({
        "host": _lower(F.regexp_extract(after, r"^[^/?#]*", 0)),
        "path": F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1),
    })


def decided(rules: Sequence[tuple[str, str]]) -> Column:
    """``rule`` and ``verdict`` of the longest rule that fits ``host`` and ``path``, or null.

    A rule is a verdict and ``host/path``: it fits the host and its subdomains where the path starts with its own, from the slash on.
    Of rules of one length that with the longer host wins, then that which blocks. The rules are part of the plan, so this
    is for lists of hundreds.
    """
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    # The last one to be wrapped around the others is looked at first.
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), r[0] == BLOCK)):
        host, slash, rest = rule.partition("/")
        host = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _count(text: Column, symbol: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(symbol), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits per character over letters, digits and URL signs; everything else is one more symbol."""
    known = F.array(*[F.lit(s) for s in _SYMBOLS])
    counts = F.transform(known, lambda s: F.char_length(text) - F.char_length(F.replace(text, s, F.lit(""))))
    other = F.char_length(F.translate(text, _SYMBOLS, ""))
    n = F.char_length(text).cast("double")
    bits = F.aggregate(
        F.array_append(counts, other), F.lit(0.0),
        lambda total, k: total + F.when(k > 0, -(k / n) * F.log2(k / n)).otherwise(0.0),
    )
    return F.when(n > 0, bits).otherwise(0.0)


def lexical() -> dict[str, Column]:
    """Features of ``url``, ``host`` and ``path`` by name."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    size = F.char_length(url)
    return {
        "length": size,
        "host_length": F.char_length("host"),
        "host_labels": F.when(F.col("host") != "", _count(F.col("host"), ".") + 1).otherwise(0),
        "host_hyphens": _count(F.col("host"), "-"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")),
        "path_length": F.char_length("path"),
        "digit_ratio": (size - F.char_length(F.translate(url, string.digits, ""))) / F.greatest(size, F.lit(1)),
        "host_digits": F.char_length("host") - F.char_length(F.translate("host", string.digits, "")),
        "escapes": _count(url, "%"),
        "host_entropy": _entropy(F.col("host")),
        "path_entropy": _entropy(_lower(F.col("path"))),
        "parameters": F.when(query != "", _count(query, "&") + 1).otherwise(0),
    }


def _suffix(labels: int) -> Column:
    return F.pmod(F.xxhash64(F.substring_index("host", ".", -labels)), F.lit(SUFFIX_BUCKETS)).cast("int")


@dataclass
class UrlModel:
    """``trees`` is None where nothing was labelled. ``rates``: share of blocked URLs by suffix bucket; ``overall`` of all."""

    trees: GBTClassificationModel | None
    rates: dict[int, float]
    overall: float

    def featured(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with ``host`` and ``path``) and its column ``features``."""
        spark = urls.sparkSession
        rates = spark.createDataFrame(list(self.rates.items()) or [(-1, 0.0)], "_bucket int, _rate double")
        rows = urls.withColumns({name: f.cast("double") for name, f in lexical().items()})
        names = list(lexical())
        for labels in (1, 2):
            one = F.broadcast(rates.toDF("_bucket", "_rate"))  # SUFFIX_BUCKETS rows at most
            name = f"suffix_{labels}"
            rows = rows.withColumn("_at", _suffix(labels)).join(one, F.col("_at") == F.col("_bucket"), "left")
            rows = rows.withColumn(name, F.coalesce("_rate", F.lit(self.overall))).drop("_at", "_bucket", "_rate")
            names.append(name)
        return VectorAssembler(inputCols=names, outputCol="features").transform(rows).drop(*names)


def seeded(urls: DataFrame, words: Sequence[str] = SEED_WORDS) -> DataFrame:
    """``url, blocked``: URLs labelled by the words of their host's name, which are parted by dots, hyphens and the like."""
    listed = F.array(*[F.lit(w) for w in words])
    named = F.split("host", "[^a-z0-9]+")
    return located(urls.select("url")).select("url", F.arrays_overlap(named, listed).alias("blocked"))


def fit(
    labelled: DataFrame, sample_rows: int = 20_000, trees: int = 12, depth: int = 3, step: float = 0.4, seed: int = 0,
) -> UrlModel:
    """Train on ``url, blocked``; rows with a null in either are not labelled.

    Suffix statistics are of all rows. The trees see about ``sample_rows`` distinct URLs, half of them blocked if there are
    as many, drawn by a hash of the URL and weighted back to the classes' shares. Without labelled rows every URL is
    allowed. Brings ``SUFFIX_BUCKETS`` rates to the driver.
    """
    rows = located(labelled.select("url", F.col("blocked").cast("boolean").alias("blocked")).dropna())
    hit = F.col("blocked").cast("int")
    classes = {r["blocked"]: r for r in rows.groupBy("blocked").agg(
        F.count("*").alias("n"), F.approx_count_distinct("url", 0.02).alias("urls")
    ).collect()}
    if not classes:
        return UrlModel(None, {}, 0.0)
    n = sum(r["n"] for r in classes.values())
    overall = (classes[True]["n"] if True in classes else 0) / n
    buckets = rows.select(hit.alias("hit"), F.explode(F.array(_suffix(1), _suffix(2))).alias("bucket"))
    rate = (F.sum("hit") + F.lit(SUFFIX_PRIOR * overall)) / (F.count("*") + SUFFIX_PRIOR)
    rates = {r["bucket"]: r["rate"] for r in buckets.groupBy("bucket").agg(rate.alias("rate")).collect()}
    model = UrlModel(None, rates, overall)
    drawn = F.lit(0)
    weight = F.lit(0.0)
    for blocked, r in classes.items():
        share = min(1.0, sample_rows / 2 / max(1, r["urls"]))
        drawn = F.when(F.col("blocked") == blocked, int(share * _DRAW)).otherwise(drawn)
        weight = F.when(F.col("blocked") == blocked, 1 / share).otherwise(weight)
    sample = rows.filter(F.pmod(F.xxhash64("url"), F.lit(_DRAW)) < drawn).distinct()
    ready = stored(model.featured(sample).select("features", hit.cast("double").alias("label"), weight.alias("weight")), "urls")
    if len(classes) > 1:
        boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, weightCol="weight")
        model.trees = boosted.fit(ready)
    return model


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = (), key: str = "page_id") -> DataFrame:
    """``key, host, path, rule, verdict, p_block`` of every row: the longest rule's verdict, else that of the trees.

    ``p_block`` is what the trees say, whether or not a rule decides; a URL is blocked from one half on. If the labelled URLs were all of
    one kind, that is the verdict. Null URLs and those without ``://`` have an empty host and path; no rule fits, and the trees
    judge what features there are. Long URLs are read whole, repeated rows and null keys are rows like others, further
    columns are not read, and empty input gives no rows.
    """
    rows = located(pages.select(F.col(key).alias("key"), "url"))
    if model.trees is None:
        scored = rows.withColumn("p_block", F.lit(1.0 if model.overall == 1 else 0.0))
    else:
        trees = model.trees.setProbabilityCol("p").setRawPredictionCol("").setPredictionCol("")
        scored = trees.transform(model.featured(rows)).withColumn("p_block", F.get(vector_to_array("p"), F.lit(1)))
    found = scored.withColumn("found", decided(rules))
    return found.select(
        F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("p_block") >= 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "p_block",
    )
