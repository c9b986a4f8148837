"""The llm operators against brute force, on small tables with nulls, ties, repeated rows and long texts."""

import collections
import gzip
import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
import xxhash
import zstandard
import zlib
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from newslens.llm import bpe, chat, components, exact, langid, mixing, queries, sharding, simhash, substrings, vectors, warc
from newslens.sources import storage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _own string, digest string, slot int"
SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from every hound it meets on its long way home "
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft weit weg von jedem jäger den er unterwegs trifft "


def _rows():
    pick = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(pick.choices(words, k=60))
    rows = []
    for i in range(60):
        own = " ".join(pick.choices(words, k=pick.randint(1, 90)))
        rows.append(f"{own} {passage if i % 7 == 0 else ''} {own if i % 11 == 0 else ''}")
    rows += [rows[3], rows[3].upper(), rows[3], None, "", "   ", "x", "\t\n", "é" * 40, " ".join(pick.choices(words, k=6000))]
    rows += [SENTENCE * 3, SENTENCE * 3 + "now", "!!! ???", "日本語の文", GERMAN * 3]
    table = [(i, t, "de" if t and "fuchs" in t else "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "a", "b", 1) for i, t in enumerate(rows)]
    return table + [table[2], table[2], (None, rows[4], None, None, None, None, None, None), (None, rows[4], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return (text or "").encode().split()


# --- 1: chat ------------------------------------------------------------------------------------

def test_escape_is_reversible_and_complete(spark):
    pick = random.Random(1)
    parts = ["<", "[", "\\", "s>", "/s>", "|>", "INST]", "/INST]", "<s>", "</s>", "[INST]", "a", "\n", "$1"]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 9))) for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in frame.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert row.u == row.t
        assert not any(c in row.e for c in ("<s>", "</s>", "<|>", "[INST]", "[/INST]"))


def test_chat_examples(spark):
    turns = [
        (1, 1, "assistant", "b</s>", 9), (1, 0, "user", "a<s>", 9), (1, 2, "user", None, 9), (1, 3, "assistant", "[INST]\n", 9),
        (2, 0, "user", "only", 9), (None, 0, None, "x", 9), (3, 0, "assistant", "y", 9), (3, 0, "assistant", "y", 9),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example int")
    examples = chat.expand(frame).collect()
    replies = [r for r in examples if r.kind == "reply"]
    assert len(replies) == 4
    assert all(r.text[r.loss_end:] == "</s>" for r in replies)
    got = {r.conv_id: r for r in chat.digests(chat.expand(frame)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].n_examples) == (4, 12, 2)
    assert got[1].loss_sha256 == hashlib.sha256(b"b</s>[INST]\n").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na<s>\nassistant\nb</s>\nuser\n\nassistant\n[INST]\n\n").hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0)
    assert (got[3].n_turns, got[3].loss_chars) == (2, 2)
    assert got[None].turns_sha256 == hashlib.sha256(b"\nx\n").hexdigest()
    assert chat.digests(chat.expand(frame.limit(0))).count() == 0


# --- 2: mixing ----------------------------------------------------------------------------------

def _earliest_deadline_first(blocks, weights):
    """From the definition, slot by slot: block i of a source is released at i W / w and due by (i + 1) W / w, W being the
    weights of the sources that still have blocks when one that has none is due."""
    left, order = list(blocks), []
    while any(left):
        own = [s for s, n in enumerate(left) if n]
        total, done, slot = sum(Fraction(weights[s]) for s in own), dict.fromkeys(own, 0), 0
        rate = {s: Fraction(weights[s]) / total for s in own}
        while True:
            released = [s for s in own if math.floor(done[s] / rate[s]) <= slot]
            due = min(released, key=lambda s: (math.ceil((done[s] + 1) / rate[s]), s))
            if done[due] == left[due]:
                break
            done[due] += 1
            order.append(due)
            slot += 1
            assert all(abs(done[s] - rate[s] * slot) < 1 for s in own)
        for s in own:
            left[s] -= done[s]
    return order


def test_mix_keeps_every_row(spark, docs, none):
    placed = mixing.mix(docs, {"s0": 5, "s1": 1}, block_rows=2)
    rows = placed.select("row.doc_id", "row.slot", "stream", placed["slot"].alias("at"), "place").collect()
    assert len(rows) == docs.count()
    assert len({(r["at"], r["place"]) for r in rows}) == len(rows)
    assert sorted({r["at"] for r in rows}) == list(range(max(r["at"] for r in rows) + 1))
    assert {r.stream for r in rows} == {"s0", "s1", mixing.REST}
    streams = sorted({r.stream for r in rows})
    filled = collections.Counter(r.stream for r in rows)
    blocks = [-(-filled[s] // 2) for s in streams]
    weights = mixing.whole([{"s0": 5, "s1": 1}.get(s) or filled[s] ** 0.5 for s in streams], sum(blocks))
    plain = _earliest_deadline_first(blocks, weights)
    assert plain == [streams.index(s) for _, s in sorted({(r["at"], r.stream) for r in rows})]
    kept = mixing.mixed(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    assert mixing.mixed(none).count() == 0


def _slots(spark, blocks, weights, **options):
    names = [f"s{i:03}" for i in range(len(blocks))]
    planned = mixing.legs(blocks, mixing.whole(weights, sum(blocks)), 64, **options)
    rows = sorted(mixing._slots(spark, names, planned).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(sum(blocks)))
    assert {(r["of"], r["at_block"]) for r in rows} == {(s, i) for s, n in zip(names, blocks) for i in range(n)}
    return [names.index(r["of"]) for r in rows]


@pytest.mark.parametrize("blocks, weights, most", [
    ([2000, 4000], [1, 2], 1024), ([2000, 4000], [1, 2], 3), ([600, 2, 90], [1, 0.0001, 0.13], 5), ([300] * 4 + [9] * 20, [30] * 4 + [0.8] * 20, 9),
    ([900, 1100, 1300, 700, 1000], [0.9 ** 0.5, 1.1 ** 0.5, 1.3 ** 0.5, 0.7 ** 0.5, 1], 7),
    ([500, 500], [9, 1], 1024), ([100, 900], [1, 1], 1024), ([5000, 5000], [9, 1], 4), ([1], [3.5], 9), ([3, 1, 4], [0.1, 0.7, 0.2], 9), ([7, 0, 7], [1, 1, 1], 9),
])
def test_mixture_keeps_to_the_given_weights(spark, blocks, weights, most):
    """At every slot, small inputs and ends of sources included."""
    order = _slots(spark, blocks, weights, most=most)
    assert order == _earliest_deadline_first(blocks, mixing.whole(weights, sum(blocks)))
    total, seen = sum(w for w, n in zip(weights, blocks) if n), [0] * len(blocks)
    for t, s in enumerate(order, 1):
        if any(n == b > 0 for n, b in zip(seen, blocks)):
            break
        seen[s] += 1
        assert all(abs(n - w * t / total) < 1 + 1e-9 for n, w, b in zip(seen, weights, blocks) if b)


def test_weights_hold_over_many_blocks(spark):
    blocks, weights = [90_000, 60_000, 10_000], [0.9, 0.4, 0.033]
    order, seen = _slots(spark, blocks, weights, most=50), np.zeros(3)
    for t, s in enumerate(order, 1):
        if seen[s] == blocks[s] or seen.max() == 90_000:
            break
        seen[s] += 1
        assert (np.abs(seen - np.array(weights) * t / sum(weights)) < 1).all()
    assert t > 120_000


def test_every_source_is_a_stream(spark):
    rows = [(i, f"s{i % 150:03}") for i in range(6000)] + [(6000 + i, "s007") for i in range(900)] + [(7000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    for weights in (None, {f"s{k:03}": 1 + k % 3 for k in range(150)}):
        placed = mixing.mix(docs, weights, block_rows=2, max_period=256).select("row.doc_id", "row.source", "stream", "slot", "place").collect()
        assert sorted(r.doc_id for r in placed) == sorted(i for i, _ in rows)
        assert all(r.stream == (r.source or mixing.REST) for r in placed)
        assert sorted({r.slot for r in placed}) == list(range(len({r.slot for r in placed})))
        assert len({r.stream for r in placed if r.slot < 600}) >= 150


# --- 3: sharding --------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 1025])
def test_feistel_is_a_permutation(n):
    rows = np.arange(n)
    places = sharding.permuted(rows, n, 3)
    assert sorted(places) == rows.tolist()
    assert (sharding.origin(places, n, 3) == rows).all()


def test_shards(spark, docs, none):
    rows = sharding.shard(docs, 7).collect()
    assert len(rows) == docs.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert texts == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert sharding.shard(none, 7).count() == 0


# --- 4: SimHash ---------------------------------------------------------------------------------

def _fingerprint(text):
    words = (text or "").encode().translate(simhash._LOWER).split()
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, none):
    rows = simhash.near_duplicates(docs).collect()
    want = [(r.doc_id, _fingerprint(r.text)) for r in docs.collect()]
    assert collections.Counter(want) == collections.Counter((r.doc_id, r.fingerprint % (1 << 64)) for r in rows)
    reach = {f: {f} for _, f in want}
    for _ in range(8):
        reach = {f: {g for x in s for g in reach if (x ^ g).bit_count() <= 3} for f, s in reach.items()}
    for r in rows:
        ids = [i for i, f in want if f in reach[r.fingerprint % (1 << 64)] and i is not None]
        assert r.component_id == min(ids)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_hot_buckets_are_divided_exactly(spark):
    pick, base = random.Random(2), 0x123456789ABCDEF0
    values = {base ^ (1 << pick.randrange(64)) ^ (1 << pick.randrange(64)) for _ in range(400)} | {pick.getrandbits(64) for _ in range(300)}
    values = np.array(sorted(values), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = [(r.a, r.b) for r in simhash.near_links(frame, bucket_rows=20).collect()]
    labels, at = np.arange(len(values)), {int(v): i for i, v in enumerate(values.view(np.int64))}
    got = components.unite(labels.copy(), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    near = np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values[None]) <= 3, 1))
    assert (got == components.unite(labels.copy(), near[:, 0], near[:, 1])).all()


def test_division_to_the_last_bits(spark):
    pairs = [(base := 0x0F1E2D3C4B5A6978 * (i + 1) % (1 << 64), base ^ (1 << a) ^ (1 << b) ^ (1 << c))
             for i, (a, b, c) in enumerate([(0, 1, 2), (0, 31, 63), (15, 16, 17), (5, 5, 5), (60, 61, 5)])]
    values = np.unique(np.array(pairs, np.uint64).ravel()).view(np.int64)
    frame = spark.createDataFrame([(int(v),) for v in values], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.near_links(frame, bucket_rows=1).collect()}
    assert got == {frozenset(np.array(p, np.uint64).view(np.int64).tolist()) for p in pairs}


def test_one_of_a_group_is_kept(spark):
    text = SENTENCE * 4
    rows = [(5, text, "a"), (3, text, "b"), (None, text, "c"), (None, "other words here", "d"), (5, "a text of its own", "e"), (9, None, "f"), (8, "", "g")]
    frame = spark.createDataFrame(rows + [(5, "a text of its own", "h")], "doc_id long, text string, mark string")
    assert sorted(r.mark for r in simhash.keep_one(frame).collect()) == ["b", "d", "e", "g", "h"]
    assert simhash.keep_one(frame.limit(0)).count() == 0


def test_allocation_adds_up():
    assert sum(t + 1 for t in simhash.allocate([[0, 5, 9, 20, 50]] * 3, 3)) == 4
    assert simhash.allocate([[0, 1, 100, 1000, 10**4], [0, 90, 91, 92, 93]], 3) == [-1, 3]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (101, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


# --- 5: substrings ------------------------------------------------------------------------------

@pytest.mark.parametrize("length", [4, 35, 110])
def test_substrings(spark, docs, none, length):
    rows = docs.collect()
    counts = collections.Counter(tuple(w[i:i + length]) for r in rows for w in [_words(r.text)] for i in range(len(w) - length + 1))
    want = collections.Counter()
    for r in rows:
        w = _words(r.text)
        gone = {i + j for i in range(len(w) - length + 1) if counts[tuple(w[i:i + length])] > 1 for j in range(length)}
        want[r.doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    got = collections.Counter(tuple(r) for r in substrings.remove_repeats(docs, length).collect())
    assert got == want
    assert substrings.remove_repeats(none, length).count() == 0


def test_every_candidate_is_doubled(spark, docs):
    """Levels of 9, 18 and 35 words: what level 2 leaves and what is settled, against plain counts of words."""
    length = 35
    texts = substrings.distinct_texts(docs)
    found = substrings.find_anchors(texts, length)
    rows, kinds = substrings.repeated_anchors(found)
    kept = substrings.doubled(kinds)
    words = {r.tid: (zstandard.ZstdDecompressor().decompress(r.small).split(), r.weight) for r in texts.collect()}

    def parts(r):
        """The anchor's words, and those of it doubled to the right and to the left where its windows reach."""
        first, count = (r.spot & (1 << 64) - 1) >> 34, r.spot >> 26 & 255
        own = words[r.tid][0][first:first + count + length - 1]
        hashes = substrings.Hashes(own)
        at = next(i for i in range(len(own) - 8) if int(hashes.at(np.array([i]), np.array([i + 9]))[0]) == r.h & (1 << 64) - 1)
        return tuple(own[at:at + 9]), tuple(own[at:at + 18]) if at + 18 <= len(own) else None, tuple(own[at - 9:at + 9]) if at >= 9 else None

    all_, left = found.collect(), {(r.h, r.s) for r in kept.collect()}
    counts = collections.Counter()
    for r in all_:
        anchor, right, to_left = parts(r)
        counts[anchor, "a"] += r.weight
        counts[right, "r"] += r.weight
        counts[to_left, "l"] += r.weight
    levels = [len(all_), 0, 0]
    for r in all_:
        anchor, right, to_left = parts(r)
        levels[1] += counts[anchor, "a"] > 1
        again = right and counts[right, "r"] > 1 or to_left and counts[to_left, "l"] > 1
        if again:
            levels[2] += 1
            assert (r.h, r.s) in left
    settled, open_ = substrings.stretches(rows, kept)
    assert rows.count() == levels[1] and levels[0] > levels[1] >= levels[2] > 0
    of = {(r.tid, r.spot): (r.h, r.s) for r in rows.collect()}
    assert {of[r.tid, r.spot] for r in settled.collect()} | {of[r.tid, r.spot] for r in open_.collect()} <= left


# --- 6: exact -----------------------------------------------------------------------------------

def test_exact(spark, docs, none):
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    rows = exact.classify(docs, exact.open_index(spark)).collect()
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[hashlib.sha256(lower(r.text).encode()).hexdigest()].append(r.doc_id)
    assert len(rows) == docs.count()
    for r in rows:
        ids = [i for i in groups[r.digest] if i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), len(groups[r.digest]))
    assert collections.Counter(r.digest for r in rows if r.kept) == {d: 1 for d in groups}
    kept = exact.keep_first(docs, exact.open_index(spark))
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.classify(none, exact.open_index(spark)).count() == 0


def test_index_lasts(spark, docs):
    folder = storage.scratch_folder(spark, "digests")
    first = exact.classify(docs.filter("doc_id < 40"), exact.open_index(spark, folder)).filter("kept").count()
    again = exact.classify(docs.filter("doc_id < 50"), exact.open_index(spark, folder))
    assert first > 30
    assert {r.doc_id for r in again.filter("kept").collect()} == set(range(40, 50))
    assert exact.DigestIndex(spark, folder, buckets=3).buckets == exact.open_index(spark, folder).buckets != 3


def test_index_counts_later_copies(spark):
    folder = storage.scratch_folder(spark, "digests")
    batches = [[(5, "a"), (3, "A"), (None, "b")], [(9, "a"), (9, "a"), (1, "a"), (7, "b"), (2, "c")], [(4, "a"), (8, "c")]]
    want = [{("a", 5, 2), ("b", None, 1)}, {("a", 5, 5), ("b", None, 2), ("c", 2, 1)}, {("a", 5, 6), ("c", 2, 2)}]
    for batch, sizes in zip(batches, want):
        frame = spark.createDataFrame(batch, "doc_id long, text string")
        got = exact.classify(frame, exact.open_index(spark, folder)).collect()
        names = {hashlib.sha256(x.encode()).hexdigest(): x for x in "abc"}
        assert len(got) == len(batch) and {(names[r.digest], r.keep_id, r.group_size) for r in got} == sizes
    assert not any(r.kept for r in got)


def test_batches_can_be_repeated(spark, docs, plan):
    folder = storage.scratch_folder(spark, "digests")
    index = exact.open_index(spark, folder)

    def run(part, batch):
        return sorted(map(str, exact.classify(part, index, batch).collect()))

    one, two = docs.filter("doc_id < 40 or doc_id is null"), docs.filter("doc_id >= 30")
    first = run(one, "one")
    assert run(one, "one") == first and any("kept=True" in r for r in first)
    second = run(two, "two")
    assert run(two, "two") == second and run(two, "two") == second and run(one, "one") == first
    # As if each had been run once.
    other = exact.open_index(spark)
    assert sorted(map(str, exact.classify(one, other, "x").collect())) == first
    assert sorted(map(str, exact.classify(two, other, "y").collect())) == second
    assert sorted(index.entries().collect()) == sorted(other.entries().collect())
    small = index.compacted(storage.scratch_folder(spark, "digests"))
    assert sorted(small.entries().collect()) == sorted(index.entries().collect())
    assert spark.table(small.name).count() == small.entries().count()
    again = exact.classify(two, small, "three").collect()
    assert not any(r.kept for r in again) and len(again) == len(second)
    known = index.entries(without="two").select("digest").hint("merge")
    text = plan(exact.digested(two).groupBy("digest").agg(F.max("doc_id")).join(known, "digest", "left_anti"))
    assert "SortMergeJoin" in text and "LeftAnti" in text and text.count("Exchange hashpartitioning(digest") == 1
    for x in (index, other, small):
        x.close()  # the folders stay
    assert not spark.catalog.tableExists(index.name)


def test_many_copies_of_a_row(spark):
    frame = spark.range(10_001).select(F.lit(3).cast("long").alias("doc_id"), F.lit("A a").alias("text"))
    got = exact.classify(frame, exact.open_index(spark))
    assert got.count() == 10_001 and got.filter("kept").count() == 1 and {r.group_size for r in got.select("group_size").distinct().collect()} == {10_001}


# --- 7: BPE -------------------------------------------------------------------------------------

def test_bpe_is_the_library(spark, docs):
    library, content = Tokenizer.from_file(queries.TOKENIZER), bpe.tokenizer_file(spark, queries.TOKENIZER)
    coder, pick = bpe.WordBpe(content, memory=50), random.Random(3)
    odd = ["", "a" * 5000, "ΑΣ Σ", "İstanbul", "it's we'll", "1234²", "a<|endoftext|>b<|startoftext|>", "é", "\x1c\x85 x", "🙂🙂"]
    for text in odd + ["".join(pick.choices("abcdé '<|>\nΣ1x", k=30)) for _ in range(300)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids
        assert coder.decode(coder.encode(text)) == library.decode(ids, skip_special_tokens=False)
    encoded = bpe.encode(docs, content)
    want = collections.Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_tokens) for r in encoded.collect()) == want
    for r in bpe.decode(encoded, content).join(encoded, "doc_id").collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.decoded_sha256


# --- 8: languages -------------------------------------------------------------------------------

def test_language_id(spark, none):
    folder = "/root/testdata/sf0.01"
    rows = queries.op8_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)
    empty = langid.fit(none, F.lit(True), F.lit(True))
    assert empty.langs == [] and langid.identify(none, empty, ["doc_id"]).count() == 0


def test_language_edges(spark):
    rows = [(i, GERMAN * (1 + i % 3), "de") if i % 2 else (i, SENTENCE * (1 + i % 3), "en") for i in range(200)]
    frame = spark.createDataFrame(rows + [(900, None, "de"), (901, "", None), (902, "12 !?", "de"), (903, "слово " * 80, None), (904, GERMAN * 20000, None)], "doc_id long, text string, lang string")
    model = langid.fit(frame, F.col("doc_id") % 5 > 1, F.col("doc_id") % 5 == 1)
    got = {r.doc_id: r for r in langid.identify(frame, model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (0, 1, 904)] == ["en", "de", "de"]
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].rejected and got[903].lang_pred in ("de", "en") and not got[904].rejected


class PlainKneserNey:
    """Interpolated Kneser-Ney of letters by plain dictionaries, with the corpus' alphabet below it."""

    def __init__(self, texts, alphabet):
        self.counts = {4: collections.Counter(g for t in texts for g in self.grams(t))}
        for order in (3, 2, 1):
            self.counts[order] = collections.Counter(g[1:] for g in self.counts[order + 1])  # types that end in it
        self.discounts, self.totals, self.kinds = {}, {}, {}
        for order, held in self.counts.items():
            once, twice = (sum(n == k for n in held.values()) for k in (1, 2))
            self.discounts[order] = once / (once + 2 * twice) if once and twice else 0.5
            self.totals[order], self.kinds[order] = collections.Counter(), collections.Counter()
            for g, n in held.items():
                self.totals[order][g[:-1]] += n
                self.kinds[order][g[:-1]] += 1
        self.floor = 1 / (alphabet + 1)

    @staticmethod
    def grams(text):
        spaced = "".join(c if c.isalpha() else " " for c in text.lower())
        spaced = "   " + " ".join(spaced.split()) + " "
        return [spaced[i:i + 4] for i in range(len(spaced) - 3)]

    def p(self, gram):
        order, context = len(gram), gram[:-1]
        below = self.p(gram[1:]) if order > 1 else self.floor
        total = self.totals[order][context]
        if not total:
            return below
        d = self.discounts[order]
        return max(self.counts[order][gram] - d, 0) / total + d * self.kinds[order][context] / total * below

    def entropy(self, text):
        own = self.grams(text)
        return -sum(math.log(self.p(g)) for g in own) / len(own)


def test_kneser_ney_is_the_plain_one(spark):
    """Probabilities, discounts and continuation counts against dictionaries, by the cross-entropies they give."""
    pick = random.Random(3)
    syllables = {"aa": ["ka", "to", "mi", "ra", "é"], "bb": ["ka", "der", "sch", "ung", "to"], "cc": ["x", "yx", "日本", "z", "mi"]}

    def made(lang, n):
        return " ".join("".join(pick.choices(syllables[lang], k=pick.randint(1, 4))) for _ in range(n))

    rows = [(i, made(lang, pick.randint(3, 30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 12)]
    held = [(100 + i, made(lang, pick.randint(1, 12)).capitalize() + "!", None) for i, lang in enumerate(["aa", "bb", "cc"] * 10)]
    frame = spark.createDataFrame(rows + held, "doc_id long, text string, lang string")
    alphabet = len({c for _, t, _ in rows for c in t if c.isalpha()} | {" "})
    plain = {x: PlainKneserNey([t for _, t, lang in rows if lang == x], alphabet) for x in syllables}
    for options in ({}, {"cells": 300}, {"together": 1}):
        model = langid.fit(frame, F.col("doc_id") < 100, F.lit(False), **options)
        got = {r.doc_id: r for r in langid.identify(frame, model, keep=["doc_id"]).collect()}
        for i, text, _ in rows + held:
            entropies = {x: m.entropy(text) for x, m in plain.items()}
            best = min(entropies, key=lambda x: (entropies[x], x))
            n = len(PlainKneserNey.grams(text))
            assert got[i].lang_pred == best and got[i].letters == n
            assert got[i].cross_entropy == pytest.approx(entropies[best], abs=1e-5)
            assert got[i].score == pytest.approx(1 / sum(math.exp((entropies[best] - e) * n) for e in entropies.values()), abs=1e-3)


def test_texts_without_a_letter(spark):
    frame = spark.createDataFrame([(i, x, "en") for i, x in enumerate([SENTENCE, GERMAN, "\u0301\u0300", "12 \u0301", "", None, "é", "\U00020061"])], "doc_id long, text string, lang string")
    model = langid.fit(frame, F.col("doc_id") < 2, F.lit(False))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, model, keep=["doc_id"]).collect()}
    assert [got[i] for i in range(2, 6)] == [("und", 0.0)] * 4 and got[6][0] == got[7][0] == "en"
    table = langid.letter_table()
    assert table[0x20061] != table[ord("a")] and table[0x20061] not in table[:0x10000]
    with pytest.raises(ValueError):
        langid.identify(frame.withColumn("score", F.lit(1)), model, keep=["doc_id", "score"])


def test_language_model_holds_every_gram(spark):
    pick = random.Random(8)
    many = [chr(0x4E00 + i) for i in range(3000)]
    rows = [(i, "".join(pick.choices(many, k=300)) if i % 2 else SENTENCE * (1 + i % 3), "zh" if i % 2 else "en") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training, calibration = F.col("doc_id") >= 50, F.col("doc_id") < 50
    seen = {lang: set() for lang in ("en", "zh")}
    for i, text, lang in rows[50:]:
        letters = "   " + text.strip() + " "
        seen[lang] |= {letters[k:k + 4] for k in range(len(letters) - 3)}
    models = [langid.fit(frame, training, calibration, cells=cells) for cells in (10_000_000, 20_000)]
    assert len(seen["zh"]) > 60_000 and [len(m.groups[0].parts) > 5 for m in models] == [False, True]
    for m in models:
        parts = [p.value for p in m.groups[0].parts]
        assert len(np.unique(np.concatenate([p["hashes"][3] for p in parts]))) == len(seen["zh"] | seen["en"])
        assert sum(len(p["hashes"][3]) for p in parts) == len(seen["zh"] | seen["en"])
    whole, cut = (sorted(map(tuple, langid.identify(frame, m, ["doc_id"]).collect())) for m in models)
    assert whole == cut and [r[1] for r in whole] == ["zh" if i % 2 else "en" for i in range(500)]


def test_language_model_holds_every_language(spark):
    rows = []
    for k in range(40):
        own, pick = [chr(0x0100 + 3 * k + j) for j in range(3)], random.Random(k)
        rows += [(100 * k + i, " ".join("".join(pick.choices(own, k=5)) for _ in range(20)), f"l{k:02}") for i in range(20 if k else 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [langid.fit(frame, F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1, together=n) for n in (16, 64)]
    some, one = ({r.doc_id: r for r in langid.identify(frame, m, ["doc_id"]).collect()} for m in models)
    assert models[0].langs == models[1].langs == sorted({r[2] for r in rows}) and len(models[0].groups) == 3
    # Neighbours of a Latin range are upper and lower case of one letter, so some languages share letters.
    assert sum(some[i].lang_pred == lang for i, _, lang in rows) >= 0.95 * len(rows)
    assert all(some[i].lang_pred == one[i].lang_pred and some[i].score == pytest.approx(one[i].score) for i in some)


def test_language_limits_of_rare_languages(spark):
    pick = random.Random(4)
    rows = [(i, " ".join(pick.choices((GERMAN if i % 50 == 0 else SENTENCE).split(), k=40)) + f" {chr(0x4E00 + i)}", "de" if i % 50 == 0 else "en") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame, F.col("doc_id") % 4 > 0, F.col("doc_id") % 4 == 0, calibration_rows=3)
    assert sorted(model.limits) == ["de", "en"] and all(np.isfinite(model.limit(x, 200)) for x in model.limits)
    # All rows but three of a language are learnt from: each has a letter of its own.
    letters = {int(g) for p in model.groups[0].parts for g in p.value["hashes"][0]}
    assert sum(0x4E00 + i in letters for i in range(600)) == 600 - 6
    none = langid.calibrated([("en", 2.0, 100)] * 50, ["en", "xx"])
    assert none["xx"] == none["en"]


# --- 9: WARC ------------------------------------------------------------------------------------

def test_warc(spark):
    long = "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    pages = [
        (5, "http://www.b.org/x#y", long), (3, "https://a.com/p?q", long), (9, None, long), (None, "http://a.com", long),
        (4, "bad url\r\nX: y", "short"), (6, "http://a.com/", "short"), (7, "http://a.com/", None), (3, "https://a.com/p?q", long),
    ]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, offset int")
    rows = warc.archive(frame, storage.scratch_folder(spark, "warc"), records=2).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == 8
    assert {i: (by[i].record_type, by[i].refers_to) for i in by} == {
        3: ("response", None), 5: ("revisit", 3), 9: ("revisit", 3), None: ("revisit", 3),
        4: ("response", None), 6: ("response", None), 7: ("response", None),
    }
    assert all(by[i].payload_bytes == len(long.encode()) and by[i].payload_digest == hashlib.sha256(long.encode()).hexdigest() for i in (3, 5, 9, None))
    assert by[7].payload_bytes == 0
    order = [(r.url_key, r.captured) for r in rows]
    assert order == sorted(order)
    assert warc.archive(frame.limit(0), storage.scratch_folder(spark, "warc")).count() == 0


def test_records_are_fetched_by_their_index(spark):
    """Every entry's file, offset and length lead to its record alone, in archives capped by records and by bytes."""
    pick = random.Random(3)
    texts = ["".join(chr(pick.randrange(32, 0x3000)) for _ in range(pick.choice([0, 40, 900]))) for _ in range(40)]
    texts += [texts[2] + "\0\x1f\x8b\r\n\r\n" * 30] * 3 + ["z" * (17 << 20), None, ""]
    pages = [(i, f"http://h{i % 7}.org/{i}", t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = storage.scratch_folder(spark, "warc")
    rows = warc.archive(frame, folder, records=5, size=2000).collect()
    files, times = {}, collections.Counter()
    assert sorted(r.page_id for r in rows) == list(range(len(texts)))
    for r in rows:
        content = files.setdefault(r.file, open(r.file.removeprefix("file:").replace("//", "/"), "rb").read())
        times[r.file] += 1
        part = content[r.offset:r.offset + r.length]
        [(start, length, head, block)] = warc.parse(part)
        assert (start, length, head["WARC-Record-ID"]) == (0, r.length, f"<urn:page:{r.page_id}>")
        assert gzip.decompress(part).endswith(block + b"\r\n\r\n")
        payload = (texts[r.page_id] or "").encode()
        if r.record_type == "response":
            assert block.endswith(b"\r\n\r\n" + payload) and head.get("WARC-Refers-To-Target-URI") is None
        else:
            first = r.refers_to
            assert block == b"" and texts[first] == texts[r.page_id] and head["WARC-Refers-To-Target-URI"] == pages[first][1]
            assert head["WARC-Refers-To-Date"] == next(x.captured for x in rows if x.page_id == first)
    assert max(times.values()) <= 5 and len(files) > 10
    for name, content in files.items():
        own = sorted((r.offset, r.length) for r in rows if r.file == name)
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(own[-1]) == len(content)
        assert sum(n for _, n in own[:-1]) < 2000
    with pytest.raises(ValueError):
        list(warc.parse(content[:-1]))


@pytest.mark.parametrize("sizes", [[], [0], [3], [2, 0, 5], [1] * 9, [7, 7, 7, 1]])
def test_loser_tree(sizes):
    pick = random.Random(4)
    runs = [sorted((pick.randrange(5), i) for i in range(n)) for n in sizes]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


# --- 10: embeddings -----------------------------------------------------------------------------

def test_probes_reach_every_partner():
    rng = np.random.default_rng(8)
    units = rng.normal(size=(400, 12)) + 2 * rng.normal(size=(20, 12)).repeat(20, axis=0)
    units /= np.sqrt((units**2).sum(axis=1))[:, None]
    model, reach = vectors.fit(units, 12, 4, 8), 0.6
    asked = set(zip(*(x.tolist() for x in model.probes(units, reach))))
    own = vectors.nearest(units, model.coarse)
    near = np.argwhere(np.sqrt(((units[:, None] - units[None]) ** 2).sum(axis=2)) <= reach)
    assert len(near) > 400 and all((a, own[b]) in asked for a, b in near.tolist())
    gaps = np.sqrt(((model.coarse[:, None] - model.coarse[None]) ** 2).sum(axis=2))
    assert np.abs(model.between - gaps).max() < 1e-7


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(scale=0.05, size=16)).tolist(), i % 2) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], None), (303, None, 0), (304, [0.0] * 16, 0)]
    rows += [(305, [float("nan")] + [1.0] * 15, 0), (306, [None] + [1.0] * 15, 0), (307, [1.0] * 3, 0), (308, [float("inf")] * 16, 0)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, cid int")
    got = vectors.near_duplicates(frame, list_rows=20).collect()
    good = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if l is not None and i < 302]
    links = [{j for j, (_, w, m) in enumerate(good) if j != k and l == m and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98} for k, (_, v, l) in enumerate(good)]
    labels = np.arange(len(good))
    for k, own in enumerate(links):
        labels = components.unite(labels, np.full(len(own), k), np.array(sorted(own), int))
    want = collections.Counter((good[k][0], len(own), min(good[j][0] for j in np.flatnonzero(labels == labels[k]))) for k, own in enumerate(links))
    want.update((i, 0, i) for i in range(302, 309))
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embeddings_of_any_width_and_size(spark, kind):
    big, small = (1e200, 1e-200) if kind == "double" else (1e30, 1e-30)
    rows = [
        (1, [1.0, 0, 0, 0], 0), (2, [1.0, 0, 0, 0], 0), (3, [1.0, 0.01, 0, 0], 0), (4, [0.0, 1, 0], 0), (5, [0.0, 1, 0], 0), (6, [0.0, 1, 0, 0], 0),
        (7, [big, 0.0], 1), (8, [big, 0.0], 1), (9, [small, small / 100], 1), (10, [0.0, small], 1), (11, [big, big, 0.0], 1), (12, [0.0, big, big], 1),
        (13, [], 1), (14, [0.0, 0.0], 1),
    ]
    frame = spark.createDataFrame([(i, [float(x) for x in v], l) for i, v, l in rows], f"vec_id long, embedding array<{kind}>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(frame).collect()}
    assert got == {
        1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (2, 7), 8: (2, 7), 9: (2, 7),
        10: (0, 10), 11: (0, 11), 12: (0, 12), 13: (0, 13), 14: (0, 14),
    }
    nothing_sound = vectors.near_duplicates(frame.filter("vec_id > 12")).collect()
    assert sorted((r.vec_id, r.n_links, r.kept) for r in nothing_sound) == [(13, 0, True), (14, 0, True)]


# --- Pipeline -----------------------------------------------------------------------------------

def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, folder).collect()
    library = Tokenizer.from_file(queries.TOKENIZER)
    exact_kept = {}
    for i, r in docs.items():
        if r.text and any(c.isalpha() for c in r.text):
            key = r.text.translate({c: c + 32 for c in range(65, 91)})
            exact_kept[key] = max(i, exact_kept.get(key, -1))
    prints = {i: _fingerprint(docs[i].text) for i in exact_kept.values()}
    near = {i for i in prints if not any(j < i and (prints[i] ^ prints[j]).bit_count() <= 3 for j in prints)}
    ids = {r.doc_id for r in rows}
    assert len(ids) == len(rows) and ids <= near and len(ids) >= 0.98 * len(near)
    for r in rows:
        assert r.n_tokens == len(library.encode(docs[r.doc_id].text, add_special_tokens=False).ids)


def test_pipeline_has_the_mixture(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows)))
    filled = collections.Counter(docs[r.doc_id].source or mixing.REST for r in rows)
    streams = sorted(filled)
    blocks = [-(-filled[s] // 8) for s in streams]
    plain = _earliest_deadline_first(blocks, mixing.whole([filled[s] ** 0.5 for s in streams], sum(blocks)))
    want, left = [], dict(filled)
    for s in plain:
        n = min(8, left[streams[s]])
        want += [streams[s]] * n
        left[streams[s]] -= n
    assert [docs[r.doc_id].source or mixing.REST for r in rows] == want


def _stage(spark, stage, docs, tmp_path, name):
    path = str(tmp_path / name)
    stage(spark, docs, "").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_stages_take_any_rows(spark, tmp_path, case):
    """Null ids and texts, repeated rows, texts without letters, clashing columns, no rows at all."""
    rows = _rows() if case == "odd" else []
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for name, stage in corpus_pipeline.STAGES:
        docs = _stage(spark, stage, docs, tmp_path, name)
    got = docs.collect()
    assert [r.position for r in sorted(got, key=lambda r: r.position)] == list(range(len(got)))
    assert bool(got) == bool(rows)
    texts = [r[1] for r in rows]
    library = Tokenizer.from_file(queries.TOKENIZER)
    for r in got:
        if r.doc_id is not None:
            ids = library.encode(texts[[x[0] for x in rows].index(r.doc_id)], add_special_tokens=False).ids
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
