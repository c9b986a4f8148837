"""Language identification by interpolated Kneser-Ney character language models.

A text is lower-cased, everything but letters becomes one space, and every position of it is a
four-letter gram. Grams are counted per language over all training rows; lower orders hold continuation
counts. A fitted model is a few sorted arrays: the grams' hashes and, for every language, the log
probability of the last letter, with back-off already worked in. So a text is scored with one binary
search per letter for a group of languages, and with more only for grams none of them has. A model that outgrows
one set of arrays is cut by groups of languages and by the grams' middle letters, and keeps every gram.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from newslens.llm.stored import stored

ORDER = 4
UNKNOWN = "und"
LETTERS_END = 0x32400  # no letters are assigned beyond
CHUNK = 1 << 20


def letter_table() -> np.ndarray:
    """For every code point its hash: the lower-case letter if 16 bits hold it, one of 2,048 others (which stand for
    nothing else) if they do not, and 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint16)
    for point in range(LETTERS_END):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            table[point] = short(ord(low) if len(low) == 1 else point)
        elif unicodedata.category(letter) in ("Mn", "Mc"):
            table[point] = short(point)  # marks are part of a letter
    return table


def short(point: int) -> int:
    return point if point < 0x10000 else 0xD800 + point * 40_503 % 2048


def letters(text: str, table: np.ndarray) -> np.ndarray:
    """Hashes of the letters with single zeros between words, or nothing if there is no letter."""
    codes = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not any(c.isalpha() for c in text):  # marks alone are none
        return codes[:0]
    keep = codes != 0
    keep[1:] |= keep[:-1]
    return codes[keep]


def grams(parts: list[np.ndarray], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams of all parts, each part led by spaces and closed by one; where each part starts."""
    lead = np.zeros(order - 1, np.uint16)
    pieces, starts, at = [], [], 0
    for p in parts:
        starts.append(at)
        closed = p if len(p) and p[-1] == 0 else np.append(p, np.uint16(0))
        pieces += [lead, closed]
        at += len(closed)
    flat = np.concatenate([np.zeros(0, np.uint16), *pieces]).astype(np.uint64)
    packed = flat.copy()
    for back in range(1, order):
        packed[back:] |= flat[:-back] << np.uint64(16 * back)
    # Positions within the leading spaces are no grams.
    keep = np.ones(len(flat), bool)
    for i, start in enumerate(starts):
        keep[start + i * (order - 1): start + (i + 1) * (order - 1)] = False
    return packed[keep], np.array(starts, np.int64)


def chunks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows in runs of about a million code points, so that memory does not follow the batch."""
    for batch in batches:
        start = size = 0
        texts: list[str] = []
        for i, value in enumerate(batch.column(at)):
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if size >= CHUNK:
                yield batch.slice(start, len(texts)), texts
                start, size, texts = i + 1, 0, []
        if texts:
            yield batch.slice(start, len(texts)), texts


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows; counts are added up in each task before they are shuffled."""

    def run(batches):
        table = letter_table()
        counts: dict[str, dict[int, int]] = {}

        def out(lang):
            found = counts.pop(lang)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())],
                names=["lang", "gram", "n"],
            )

        for batch, texts in chunks(batches, 1):
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                parts = [p for own, t in zip(langs, texts, strict=True) if own == lang and len(p := letters(t, table))]
                if not parts:
                    continue
                found, n = np.unique(grams(parts)[0].view(np.int64), return_counts=True)
                own = counts.setdefault(lang, {})
                for g, c in zip(found.tolist(), n.tolist(), strict=True):
                    own[g] = own.get(g, 0) + c
                if len(own) > 1_000_000:
                    yield out(lang)
        for lang in list(counts):
            yield out(lang)

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Part:
    """The grams of some languages within a range of middle pairs: sorted gram hashes by order, their log
    probabilities, and back-off weights by context."""

    hashes: list[np.ndarray] = field(default_factory=list)  # by order 1..ORDER
    logs: list[np.ndarray] = field(default_factory=list)  # grams x languages
    contexts: list[np.ndarray] = field(default_factory=list)  # by order 2..ORDER
    weights: list[np.ndarray] = field(default_factory=list)
    floor: float = 0.0

    def score(self, packed: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last letter in every language."""
        out = np.zeros((len(packed), self.logs[0].shape[1]), np.float32)
        rest, keys = np.arange(len(packed)), packed
        for order in range(ORDER, 0, -1):
            table, at, hit = find(self.hashes[order - 1], keys)
            out[rest[hit]] += self.logs[order - 1][at[hit]]
            rest, keys = rest[~hit], keys[~hit]
            if not len(rest):
                return out
            if order > 1:
                table, at, known = find(self.contexts[order - 2], keys >> np.uint64(16))
                out[rest[known]] += self.weights[order - 2][at[known]]
                keys = keys & np.uint64((1 << (16 * (order - 1))) - 1)
        out[rest] += np.float32(self.floor)
        return out


@dataclass
class Group:
    """Some languages, whose model is in ``parts`` (broadcast) that begin at the middle pairs ``bounds``."""

    langs: list[str]
    bounds: np.ndarray
    parts: list[Broadcast]

    def score(self, packed: np.ndarray, hold: bool) -> np.ndarray:
        """As ``Part.score``; unless ``hold``, a worker has one part in memory at a time."""
        key = middle(packed)
        which = np.searchsorted(self.bounds, key, "right") - 1
        out = np.zeros((len(packed), len(self.langs)), np.float32)
        for k in np.unique(which):
            rows = np.flatnonzero(which == k)
            out[rows] = Part(**self.parts[k].value).score(packed[rows])
            if not hold and self.parts[k]._path:
                del self.parts[k]._value  # read again from its file
        return out


@dataclass
class Model:
    """Groups of languages, and limits by language."""

    groups: list[Group] = field(default_factory=list)
    limits: dict[str, list[tuple[int, float]]] = field(default_factory=dict)

    @property
    def langs(self) -> list[str]:
        return [x for g in self.groups for x in g.langs]

    def read(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language, its probability and cross-entropy per letter, and the number of
        scored letters (0: no letter)."""
        parts = [letters(t, table) for t in texts]
        best, low, sizes = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        score = np.zeros(len(texts))
        some = [i for i, p in enumerate(parts) if len(p)]
        if some and self.groups:
            packed, starts = grams([parts[i] for i in some])
            n = np.diff(np.append(starts, len(packed)))
            owner = np.repeat(np.arange(len(some)), n)
            least, at, total = np.full(len(some), np.inf), np.zeros(len(some), np.int64), np.zeros(len(some))
            hold, begins = sum(len(g.parts) for g in self.groups) == 1, 0
            for group in self.groups:
                # Very long texts are scored in runs, each added to its text.
                sums = np.zeros((len(some), len(group.langs)))
                for a in range(0, len(packed), CHUNK):
                    scores, own = group.score(packed[a:a + CHUNK], hold), owner[a:a + CHUNK]
                    first = np.flatnonzero(np.diff(own, prepend=-1))
                    sums[own[first]] += np.add.reduceat(scores, first, axis=0, dtype=np.float64)
                entropy = -sums / n[:, None]
                found = entropy.argmin(axis=1)
                now = np.minimum(least, entropy.min(axis=1))
                at = np.where(entropy.min(axis=1) < least, begins + found, at)
                total = total * np.exp(np.maximum((now - least) * n, -700)) + np.exp(
                    np.maximum((now[:, None] - entropy) * n[:, None], -700)
                ).sum(axis=1)
                least, begins = now, begins + len(group.langs)
            best[some], low[some], sizes[some], score[some] = at, least, n, 1 / total
        return best, score, low, sizes

    def limit(self, lang: str, size: int) -> float:
        """The largest cross-entropy that texts of this length are accepted with."""
        found = np.inf
        for at_least, value in self.limits.get(lang, []):
            if size >= at_least:
                found = value
        return found


def middle(packed: np.ndarray) -> np.ndarray:
    """The third and second letter of a gram. All that a gram of order 3 or 4 is backed off to, or shares a context
    with, has the same two, and what it needs of order 2 has the same third letter."""
    return packed & np.uint64(0xFFFF0000) | packed >> np.uint64(32) & np.uint64(0xFFFF)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(table):
        return table, np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table, at, table[at] == keys


def kneser_ney(
    langs: list[str], counts: list[dict[str, tuple[np.ndarray, np.ndarray]]], discounts: dict[tuple[str, int], float], floor: float,
) -> Part:
    """The part from ``{language: (packed grams, counts)}`` by order, and the discounts of the whole language."""
    part = Part(floor=floor)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lower = None
    for order in range(1, ORDER + 1):
        own = [counts[order - 1].get(lang, none) for lang in langs]
        union = np.unique(np.concatenate([x[0] for x in own]))
        context = np.unique(union >> np.uint64(16))
        logs = np.zeros((len(union), len(langs)), np.float32)
        weights = np.zeros((len(context), len(langs)), np.float32)
        for column, (lang, (found, n)) in enumerate(zip(langs, own, strict=True)):
            discount = discounts.get((lang, order), 0.5)
            own_at = np.searchsorted(union, found)
            totals, kinds = np.zeros(len(context)), np.zeros(len(context))
            at = np.searchsorted(context, found >> np.uint64(16))
            np.add.at(totals, at, n)
            np.add.at(kinds, at, 1)
            share = np.where(totals > 0, discount * kinds / np.maximum(totals, 1), 1.0)
            full = np.zeros(len(union))
            full[own_at] = np.maximum(n - discount, 0) / totals[at]
            if order == 1:
                base = np.full(len(union), np.exp(floor))
            else:
                mask = np.uint64((1 << (16 * (order - 1))) - 1)
                base = np.exp(lower[1][np.searchsorted(lower[0], union & mask), column].astype(np.float64))
            of = np.searchsorted(context, union >> np.uint64(16))
            logs[:, column] = np.log(full + share[of] * base)
            weights[:, column] = np.log(np.maximum(share, 1e-12))
        part.hashes.append(union)
        part.logs.append(logs)
        if order > 1:
            part.contexts.append(context)
            part.weights.append(weights)
        lower = union, logs
    return part


def by_language(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """``{language: (sorted packed grams, counts)}`` of ``lang, gram, n``."""
    found, out = rows.select("lang", "gram", "n").toArrow().to_pandas(), {}
    for lang, own in found.groupby("lang"):
        keys = own["gram"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(keys)
        out[lang] = keys[by], own["n"].to_numpy(np.int64)[by]
    return out


def learn(counted: DataFrame, cells: int, together: int) -> Model:
    """The model of all grams and languages of ``lang, gram, n``.

    Statistics (continuation counts, discounts, the alphabet) are of all grams and computed in Spark. The driver
    then builds one part at a time: ``together`` languages at most and about ``cells`` grams times languages,
    more only where one pair of letters has more. So parts grow in number with the input, and not in size.
    """
    spark = counted.sparkSession
    levels = {ORDER: stored(counted, "grams")}
    for order in range(ORDER - 1, 0, -1):
        # How many letters a gram continues: types of the next order that end in it.
        ends = F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1)).alias("gram")
        lower = levels[order + 1].select("lang", ends).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        levels[order] = stored(lower, "grams")
    discounts, sizes = {}, {}
    for order, level in levels.items():
        kinds = level.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
        for r in kinds.collect():
            if r["once"] and r["twice"]:
                discounts[r["lang"], order] = r["once"] / (r["once"] + 2 * r["twice"])
            if order == ORDER:
                sizes[r["lang"]] = r["all"]
    floor = -float(np.log(levels[1].select("gram").distinct().count() + 1))
    third = F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(0xFFFF))
    pair = F.shiftleft(third, 16).bitwiseOR(F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(0xFFFF)))
    model, langs = Model(), sorted(sizes)
    for a in range(0, len(langs), together):
        group = langs[a:a + together]
        own = {order: level.filter(F.col("lang").isin(group)) for order, level in levels.items()}
        ranges = -(-sum(sizes[x] for x in group) * len(group) // cells)
        bounds = [0]
        if ranges > 1:
            cuts = [i / ranges for i in range(1, ranges)]
            bounds = sorted({0, *own[ORDER].agg(F.percentile_approx(pair, cuts, 100 * ranges).alias("at")).first()["at"]})
        ones, parts = by_language(own[1]), []
        for begin, end in zip(bounds, [*bounds[1:], 1 << 32], strict=True):
            fours = by_language(own[ORDER].filter((pair >= begin) & (pair < end)))
            threes = {
                x: np.unique(g & np.uint64((1 << 48) - 1), return_counts=True) for x, (g, _) in fours.items()
            }
            second = F.shiftrightunsigned("gram", 16)  # of a gram of two letters the first
            twos = by_language(own[2].filter((second >= begin >> 16) & (second <= (end - 1) >> 16)))
            parts.append(spark.sparkContext.broadcast(vars(kneser_ney(group, [ones, twos, threes, fours], discounts, floor))))
        model.groups.append(Group(group, np.array(bounds, np.uint64), parts))
    return model


def calibrated(rows: list[tuple[str, float, int]], langs: list[str], least: int = 40) -> dict[str, list[tuple[int, float]]]:
    """Limits by language and length from ``(language, cross-entropy, letters)`` of rows not counted.

    Texts are grouped by the power of two of their length, with ``least`` rows in a group at least. The
    limit lies beyond the 99th percentile by three times the way from the median to it, 0.9 at least:
    mixed and shouted texts pass, texts in letters or words of no learnt language do not. A language with
    fewer than ``least`` rows has the limits of all rows together where its own are not higher.
    """
    pooled = _steps(sorted((int(n), h) for _, h, n in rows), least)
    limits: dict[str, list[tuple[int, float]]] = {}
    by: dict[str, list[tuple[int, float]]] = {lang: [] for lang in langs}
    for lang, h, n in rows:
        by[lang].append((int(n), h))
    for lang, own in by.items():
        steps = _steps(sorted(own), least)
        if len(own) < least:
            begins = sorted({b for b, _ in steps + pooled})
            steps = [(b, max(v for some in (steps, pooled) for v in [x for at, x in some if at <= b][-1:])) for b in begins]
        limits[lang] = steps
    return limits


def _steps(own: list[tuple[int, float]], least: int) -> list[tuple[int, float]]:
    steps, group = [], []
    for i, (n, h) in enumerate(own):
        group.append((n, h))
        ends = i + 1 == len(own) or own[i + 1][0].bit_length() > n.bit_length()
        if ends and (len(group) >= least or i + 1 == len(own)):
            if len(group) < least and steps:
                break  # the last limit holds for longer texts
            values = np.array([x[1] for x in group])
            middle, high = np.median(values), np.quantile(values, 0.99)
            begins = 0 if not steps else 1 << (group[0][0].bit_length() - 1)
            steps.append((begins, float(high + 3 * max(high - middle, 0.3))))
            group = []
    return steps


def fit(
    docs: DataFrame, training: Column, calibration: Column,
    calibration_rows: int = 5_000, cells: int = 4_000_000, together: int = 16,
) -> Model:
    """Learn from the rows of ``docs`` with a language that meet ``training``; limits from ``calibration``.

    Every language and every gram of the training rows is learnt (``learn``; ``cells`` and ``together`` bound what is
    in memory at a time). Limits come from the entropies of ``calibration_rows`` texts of each language, chosen
    by a hash of the text; the other rows that meet ``calibration`` are learnt from too. No labelled rows give a
    model without languages.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.coalesce(training, F.lit(False)).alias("train"),
        F.when(calibration, F.xxhash64("text")).alias("h"),  # null: not for limits
    )
    # Hashes alone decide, so that no task gathers the texts; copies of a text count once.
    hashes = labelled.filter("h is not null").select("lang", "h").distinct()
    at = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    edges = hashes.withColumn("at", at).filter(F.col("at") <= calibration_rows).groupBy("lang").agg(F.max("h").alias("edge")).collect()
    # A row for each language.
    edges = docs.sparkSession.createDataFrame([(r["lang"], r["edge"]) for r in edges], "lang string, edge bigint")
    dealt = labelled.join(F.broadcast(edges), "lang", "left").withColumn("held", F.coalesce(F.col("h") <= F.col("edge"), F.lit(False)))
    model = learn(count_grams(dealt.filter(~F.col("held") & (F.col("train") | F.col("h").isNotNull()))), cells, together)
    sample = dealt.filter(F.col("held") & F.col("lang").isin(model.langs)) if model.groups else dealt.limit(0)
    scored = identify(sample.dropDuplicates(["lang", "h"]), model, keep=["lang"])
    model.limits = calibrated([
        (r["lang"], r["cross_entropy"], r["letters"]) for r in scored.collect() if r["lang_pred"] == r["lang"]
    ], model.langs)
    return model


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Predict the language of every whole text: ``keep`` columns and
    ``lang_pred, score, cross_entropy, letters, rejected``.

    The prediction is the language of the lowest cross-entropy per letter (ties: by name), ``und`` with
    score 0 if the text is null or has no letter or nothing was learnt. ``score`` is the probability of
    the predicted language among all, every one being as likely beforehand. ``rejected`` says that the
    cross-entropy is beyond the language's calibrated limit, or that the prediction is ``und``. Only the
    ``keep`` columns and the text are read, and rows are scored where they are. ``keep`` must not name a result.
    """
    clash = sorted({"lang_pred", "score", "cross_entropy", "letters", "rejected"} & set(keep))
    if clash:
        raise ValueError(f"columns to keep are named as results: {clash}")
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        table, langs = letter_table(), model.langs
        for batch, texts in chunks(batches, len(keep)):
            best, score, low, sizes = model.read(texts, table)
            none = (sizes == 0) | (not langs)
            names = [UNKNOWN if none[i] else langs[best[i]] for i in range(len(texts))]
            rejected = [bool(none[i] or low[i] > model.limit(names[i], sizes[i])) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [
                    pa.array(names), pa.array(np.where(none, 0.0, score)), pa.array(low), pa.array(sizes), pa.array(rejected),
                ],
                names=[*keep, "lang_pred", "score", "cross_entropy", "letters", "rejected"],
            )

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    return docs.select(*keep, text).mapInArrow(
        run, kept + "lang_pred string, score double, cross_entropy double, letters bigint, rejected boolean"
    )


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds
