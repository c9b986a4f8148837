"""BPE encoding and decoding with a public vocabulary, one segment tree per word.

The leaves of the tree hold the ranks of adjacent pairs; its root yields the leftmost pair of the lowest
rank. A merge changes three leaves, each in logarithmic time, until no mergeable pair remains. Words
are remembered by the worker, so each is merged once; the memory is emptied when it is full.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

NEVER = 1 << 50  # the rank of a pair that is not merged

# White space, ASCII and the letters of Latin-1 and Latin Extended, whose classes are plain ranges.
_LATIN = "\\t\\n\\r -~À-ÖØ-öø-ÿĀ-ɏ"
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿĀ-ɏ"


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """``symbols`` after all merges, lowest rank first and leftmost first.

    Leaf i of the tree is ``rank * size + i`` of the pair that begins at symbol i, so the smallest
    leaf is the leftmost pair of the lowest rank; inner nodes hold the smaller of their two.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    size, rank = 1 << (n - 2).bit_length(), ranks.get
    none = NEVER * size
    low = [none] * size + [rank(p, NEVER) * size + i for i, p in enumerate(zip(symbols, symbols[1:], strict=False))]
    low += [none] * (2 * size - len(low))
    for i in range(size - 1, 0, -1):
        a, b = low[2 * i], low[2 * i + 1]
        low[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while low[1] < none:
        i = low[1] & (size - 1)
        j = after[i]
        symbols[i] += symbols[j]
        symbols[j] = ""
        after[i] = k = after[j]
        leaves = [(i, rank((symbols[i], symbols[k]), NEVER) * size + i if k < n else none)]
        if k < n:
            before[k] = i
            leaves.append((j, none))
        if (h := before[i]) >= 0:
            leaves.append((h, rank((symbols[h], symbols[i]), NEVER) * size + h))
        for at, leaf in leaves:
            at += size
            low[at] = leaf
            while at > 1:
                a, b = low[at], low[at ^ 1]
                at >>= 1
                if a > b:
                    a = b
                if low[at] == a:
                    break
                low[at] = a
    return [s for s in symbols if s]


class Remembered(dict):
    """Values made when they are first looked up; emptied when it holds ``most``. Long keys are not kept."""

    def __init__(self, make, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 as it is, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [], 0x100
    for b in range(256):
        if b in shown:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class WordBpe:
    """A tokenizer file of the kind: NFC, white space, lower case; words; bytes; BPE with word ends."""

    def __init__(self, content: str, memory: int = 600_000):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(p): i for i, p in enumerate(pairs)}
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # The same pattern for texts whose letters are ranges that the standard library knows.
        self.latin = re.compile(f"[{_LATIN}]*")
        known = pattern.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", "0-9")
        self.latin_words = re.compile(known) if r"\p" not in known else None
        self.letters = byte_letters()
        self.ids = Remembered(self._ids, memory)

    def _ids(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers."""
        symbols = [self.letters[b] for b in word.encode()]
        symbols[-1] += self.end
        return np.array([self.vocab[t] for t in merge(symbols, self.ranks)], "<u4").tobytes()

    def pieces(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """Words of each stretch between special tokens, or such a token."""
        for part in self.marks.split(text):
            if part in self.special:
                yield [], part
            elif part:
                plain = normalise(part)
                words = self.latin_words if self.latin_words and self.latin.fullmatch(plain) else self.words
                yield words.findall(plain), None

    def encode(self, text: str) -> bytes:
        ids = []
        for words, token in self.pieces(text):
            ids.append(np.array([self.special[token]], "<u4").tobytes() if token else b"".join(map(self.ids.__getitem__, words)))
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, as this kind of file names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def normalise(text: str) -> str:
    """NFC and lower case, letter by letter; white space is dropped later with what is no word."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # Python alone lower-cases a final sigma by its place in the word.
    return text.replace("Σ", "σ").lower()


def encode(
    docs: DataFrame, tokenizer: str, ids: bool = True, text: str = "text", key: str = "doc_id", keep: Sequence[str] = (),
) -> DataFrame:
    """Tokens of every whole text: ``key, n_tokens, token_ids, ids_sha256, decoded_sha256`` and the ``keep`` columns.

    ``tokenizer`` is the content of a tokenizer file. ``token_ids`` holds little-endian unsigned 32-bit
    integers (left out with ``ids=False``). Null text counts as empty, which has no tokens. Rows are
    independent: repeated rows and null keys give a row each, other columns are not read, and nothing
    is shuffled. The digests are taken of the ids and of the text decoded from them.
    """
    spark: SparkSession = docs.sparkSession
    # A vocabulary file, a few MB whatever the input; a worker keeps the coder made of it, with its words.
    shared = spark.sparkContext.broadcast({"file": tokenizer})
    names = [key, "n_tokens", *(["token_ids"] if ids else []), "ids_sha256", "decoded_sha256", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        coder = held["coder"] = held.get("coder") or WordBpe(held["file"])
        for batch in batches:
            counts, encoded, digests, decoded = [], [], [], []
            for value in batch.column(1):
                joined = coder.encode(value.as_py() or "")
                counts.append(len(joined) // 4)
                encoded.append(joined if ids else b"")
                digests.append(hashlib.sha256(joined).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(joined).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), *([pa.array(encoded, pa.binary())] if ids else []), pa.array(digests), pa.array(decoded), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    binary = "token_ids binary, " if ids else ""
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(key, text, *keep).mapInArrow(
        run, f"`{key}` {kind}, n_tokens bigint, {binary}ids_sha256 string, decoded_sha256 string{kept}"
    )


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """``key, text`` from ``token_ids``; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordBpe(shared.value)
        for batch in batches:
            texts = [None if (v := x.as_py()) is None else coder.decode(v) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "token_ids").mapInArrow(run, f"`{key}` {kind}, text string")


def tokenizer_file(spark: SparkSession, path: str) -> str:
    """Content of a tokenizer file on the driver or, with a scheme, in storage that Spark reads."""
    if "://" in path:
        return spark.read.option("wholetext", True).text(path).first()[0]
    with open(path, encoding="utf-8") as file:
        return file.read()
