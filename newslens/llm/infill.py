"""Fill-in-middle examples, cut at legal boundaries of the text.

The places where a UTF-8 text may be cut are a set of byte offsets, held as compressed bitmaps are: the
offsets fall into blocks of 65,536, and each block holds its offsets in the smallest of three containers, a sorted
array, a bitmap or a list of runs. Cumulative cardinalities over the containers turn "the k-th boundary" into
a search for the container and a select inside it, so a cut is found without decoding the text. Plain
ASCII is one run a block, however long it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_WORDS = BLOCK // 64
_BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@dataclass
class ArrayContainer:
    """Sorted offsets: two bytes each."""

    offsets: np.ndarray

    def select(self, k: int) -> int:
        return int(self.offsets[k])

    def size(self) -> int:
        return 2 * len(self.offsets)


@dataclass
class RunContainer:
    """First offset and length of every run of neighbours, and the offsets before each."""

    starts: np.ndarray
    before: np.ndarray

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])

    def size(self) -> int:
        return 4 * len(self.starts)


@dataclass
class BitmapContainer:
    """A bit for every offset of the block, and the set bits before each 64."""

    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, inside: np.ndarray) -> BitmapContainer:
        packed = np.packbits(inside, bitorder="little")
        packed = np.append(packed, np.zeros(BLOCK // 8 - len(packed), np.uint8))
        counts = _BITS[packed].reshape(_WORDS, 8).sum(axis=1)
        return cls(packed, np.cumsum(counts) - counts)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.unpackbits(self.bits[8 * word:8 * word + 8], bitorder="little")
        return 64 * word + int(np.flatnonzero(inside)[k - int(self.before[word])])

    def size(self) -> int:
        return BLOCK // 8


def container(inside: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest container of the set positions of a block."""
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = ends - starts
    n = int(lengths.sum())
    if 4 * len(starts) <= min(2 * n, BLOCK // 8):
        return RunContainer(starts, np.cumsum(lengths) - lengths)
    return ArrayContainer(np.flatnonzero(inside).astype(np.uint16)) if 2 * n < BLOCK // 8 else BitmapContainer.of(inside)


class Boundaries:
    """A set of byte offsets with ``select``; ``inside`` tells for every offset if it is in the set."""

    def __init__(self, inside: np.ndarray):
        blocks = [inside[a:a + BLOCK] for a in range(0, len(inside), BLOCK)]
        counts = [int(np.count_nonzero(b)) for b in blocks]
        self.keys = [i for i, n in enumerate(counts) if n]
        self.containers = [container(blocks[i]) for i in self.keys]
        self.upto = np.cumsum([counts[i] for i in self.keys])

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        at = int(np.searchsorted(self.upto, k, side="right"))
        local = k - (int(self.upto[at - 1]) if at else 0)
        return self.keys[at] * BLOCK + self.containers[at].select(local)


def boundaries(text: np.ndarray, unit: str = "codepoint") -> Boundaries:
    """Where a UTF-8 text may be cut: before every unit and at its end.

    Units are code points, ``word``: a word with the white space before it (what is left at the end belongs to the last one), or
    ``line``: a line with its break.
    """
    inside = np.zeros(len(text) + 1, bool)
    if unit == "codepoint":
        inside[:-1] = (text & 0xC0) != 0x80
    elif unit == "word":
        space = _SPACES[text]
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        inside[ends] = True
        if len(ends) and space[ends[-1]:].all():
            inside[ends[-1]] = False
        inside[0] = True
    elif unit == "line":
        inside[1:] = text == 0x0A
        inside[0] = True
    else:
        raise ValueError(f"unknown unit: {unit!r}")
    inside[-1] = True
    return Boundaries(inside)


def _quarter(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")


def cuts(docs: DataFrame, unit: str = "codepoint", seed: str = "1") -> DataFrame:
    """Add ``cut``: units ``n``, the units before each cut (``first``, ``second``) and its byte offset (``from``, ``to``)."""

    def run(texts: pa.Array, ones: pa.Array, twos: pa.Array) -> pa.Array:
        kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        ends = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else []
        found = []
        for i, (one, two) in enumerate(zip(ones.to_pylist(), twos.to_pylist(), strict=True)):
            places = boundaries(data[ends[i]:ends[i + 1]], unit)
            n = len(places) - 1
            low, high = sorted((one % (n + 1), two % (n + 1)))
            found.append((n, low, high, places.select(low), places.select(high)))
        columns = np.array(found, np.int64).reshape(-1, 5).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["n", "first", "second", "from", "to"])

    place = F.arrow_udf(run, "n bigint, first bigint, second bigint, from bigint, to bigint")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashed = docs.withColumn("digest", digest)
    return hashed.withColumn("cut", place(F.col("text").cast("binary"), _quarter(F.col("digest"), 0), _quarter(F.col("digest"), 1)))


def transform(docs: DataFrame, rate: int = 90, spm_rate: int = 20, unit: str = "codepoint", seed: str = "1") -> DataFrame:
    """One example per row: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``rate`` of 100 texts are cut into prefix, middle and suffix at two places drawn from the SHA-256 of ``seed`` and
    ``doc_id``; ``spm_rate`` of 100 of those begin with the suffix (``spm``), the others with the prefix (``psm``). The rest
    stay ``plain``, as do empty texts and those that hold a marker, so every output can be turned back. ``n`` counts
    units of the text; the two ``chars`` are code points of the cut parts, null if plain.

    Null texts count as empty; a null id is hashed as an empty one. Texts of any length are cut whole; beside one text a task holds
    a few bytes for each of its bytes while the set is built. Repeated rows give repeated rows, further columns are not read, whatever their names, and
    empty input gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cut = cuts(rows, unit, seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = (
        F.when((F.col("text") == "") | marked | (_quarter(F.col("digest"), 2) % 100 >= rate), "plain")
        .when(_quarter(F.col("digest"), 3) % 100 < spm_rate, "spm")
        .otherwise("psm")
    )
    raw = F.col("text").cast("binary")

    def part(start: Column, length: Column) -> Column:
        return F.substring(raw, start.cast("int"), length.cast("int")).cast("string")

    parts = cut.withColumns({
        "form": form,
        "prefix": part(F.lit(1), F.col("cut.from")),
        "middle": part(F.col("cut.from") + 1, F.col("cut.to") - F.col("cut.from")),
        "suffix": part(F.col("cut.to") + 1, F.octet_length("text") - F.col("cut.to")),
    })
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )

    def counted(name: str) -> Column:
        return F.when(F.col("form") != "plain", F.char_length(name).cast("bigint"))

    return parts.select(
        "doc_id", F.col("cut.n").alias("n"), "form", counted("prefix").alias("prefix_chars"),
        counted("middle").alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a marker, so the markers split it."""
    parts = F.split(output, "<[PSM]>", -1)

    def joined(*order: int) -> Column:
        return F.concat(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in order])

    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)
