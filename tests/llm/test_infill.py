"""Fill-in-middle: the boundary set against plain lists, examples against plain string work."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.llm import infill

SCHEMA = "doc_id long, text string, digest string, cut string, prefix string"
pick = random.Random(4)
TEXTS = [
    None, "", "a", "é", "日本", "no <P> here", "or <S>", "or <M>", "almost <P <S <M", "<", "a\x00b", "tail <",
    "plain words and more of them " * 40, "日本語の文" * 30_000, "x" * 200_000, "aé" * 70_000,
    *["".join(pick.choices("ab é日\n<PSM>", k=pick.randint(0, 80))) for _ in range(150)],
]


def plain(doc_id, text, rate=90, spm=20, units=list):
    text = text or ""
    own = units(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(own) + 1), h[1] % (len(own) + 1)))
    p, m, s = "".join(own[:low]), "".join(own[low:high]), "".join(own[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(own), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(own), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[2], rows[2], (None, "null id", None, None, None)], SCHEMA)


@pytest.mark.parametrize("share", [0.0, 0.0001, 0.02, 0.3, 0.7, 0.999, 1.0])
def test_boundary_set_against_a_list(share):
    draw = np.random.default_rng(int(share * 1000))
    for size in (1, 100, 65_535, 65_536, 65_537, 300_000):
        inside = draw.random(size) < share
        places, held = np.flatnonzero(inside), infill.Boundaries(inside)
        assert len(held) == len(places)
        for k in sorted({0, len(places) - 1, len(places) // 2, *draw.integers(0, max(1, len(places)), 40).tolist()}):
            if 0 <= k < len(places):
                assert held.select(k) == places[k]


def test_every_container_is_used_where_it_is_smallest():
    block = infill.BLOCK
    sparse, dense, run = np.zeros(block, bool), np.zeros(block, bool), np.ones(block, bool)
    sparse[::100], dense[::2] = True, True
    kinds = [type(infill.container(b)) for b in (sparse, dense, run)]
    assert kinds == [infill.ArrayContainer, infill.BitmapContainer, infill.RunContainer]
    assert all(infill.container(b).size() <= block // 8 for b in (sparse, dense, run))
    # Text of three bytes a letter is a bitmap, ASCII one run for each block, whatever its length.
    asian = infill.boundaries(np.frombuffer(("日" * 60_000).encode(), np.uint8))
    ascii_ = infill.boundaries(np.frombuffer(b"x" * 500_000, np.uint8))
    assert isinstance(asian.containers[0], infill.BitmapContainer)
    assert sum(c.size() for c in ascii_.containers) == 4 * len(ascii_.containers)


def test_examples_against_plain_strings(docs):
    rows = infill.transform(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    texts = {**dict(enumerate(TEXTS)), None: "null id"}
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        assert tuple(r)[1:6] == plain(r.doc_id, texts[r.doc_id]), r.doc_id
        assert r.back == (texts[r.doc_id] or "")
    forms = {r.form for r in rows}
    assert forms == {"plain", "psm", "spm"}
    assert rows[0].asDict().keys() == {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "back"}


def words(text):
    """Words with the space before them; what is left belongs to the last one."""
    out, own = [], ""
    space = " \t\n\x0b\x0c\r"
    for i, c in enumerate(text):
        own += c
        if c not in space and (i + 1 == len(text) or text[i + 1] in space) and text[i + 1:].strip(space):
            out, own = [*out, own], ""
    return [*out, own] if own else out


@pytest.mark.parametrize(("unit", "units"), [("word", words), ("line", lambda t: t.splitlines(keepends=True))])
def test_other_units(docs, unit, units):
    short = docs.filter(F.length("text") < 1000).filter(~F.col("text").contains("\x00"))
    texts = {r.doc_id: r.text for r in short.collect()}
    for r in infill.transform(short, rate=100, unit=unit).collect():
        assert tuple(r)[1:6] == plain(r.doc_id, texts[r.doc_id], rate=100, units=units), (unit, texts[r.doc_id])
    with pytest.raises(ValueError):
        infill.boundaries(np.zeros(3, np.uint8), "page")


def test_empty_table(spark):
    assert infill.transform(spark.createDataFrame([], SCHEMA)).collect() == []
