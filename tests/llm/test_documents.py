"""Fingerprints, mixing, shards and packing against straightforward versions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mailrisk.llm import mixing, packing, shards, simhash
from mailrisk.llm.components import components

DOCS = "doc_id long, text string, source string, lang string, row string, fp int, size string, shard int, root int, key string"


def rows_of(texts, sources=None):
    """Documents with further columns whose names operators use themselves."""
    return [(i, t, (sources or [None])[i % len(sources or [None])], "en", "r", 1, "s", 7, 3, "k") for i, t in enumerate(texts)]


def sample_texts(seed, n, base=60):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = [None, "", " \n ", "one", "one two", "ÄÖ ß x y", "A b C d E", "a b c d e"]
    while len(texts) < n:
        words = [draw.choice(vocabulary) for _ in range(base)]
        texts.append(" ".join(words))
        for _ in range(draw.choice((0, 0, 1, 4))):
            copy = list(words)
            copy[draw.randrange(base)] = draw.choice(vocabulary)
            texts.append("\n".join(copy) if draw.random() < 0.2 else " ".join(copy))
    return texts[:n]


def brute_components(nodes, edges):
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 540)]
    want = brute_components({x for e in edges for x in e}, edges)
    table = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a long, b long").repartition(5)
    got = {r.node: r.component for r in components(table).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: want[n] for n in linked}
    assert components(table.limit(0)).count() == 0


def brute_fingerprint(text, words):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_near_duplicates(spark, block):
    texts = sample_texts(1, 150)
    prints = [brute_fingerprint(t, 4) for t in texts]
    edges = [(i, j) for i in range(150) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    want = brute_components(range(150), edges)
    docs = spark.createDataFrame(rows_of(texts), DOCS)
    got = simhash.near_duplicates(docs, words=4, block=block).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (prints[i], want[i]) for i in range(150)}
    assert len(got) == 150 and len(edges) > 20


def test_very_long_texts_have_the_fingerprint_of_a_plain_count():
    """Megabytes of words, counted block by block, against one count of all shingles."""
    draw = np.random.default_rng(7)
    text = " ".join(f"w{i}" for i in draw.integers(0, 5000, 300_000).tolist())
    every = simhash.shingles(text, 4)
    bits = [2 * int(((every >> np.uint64(b)) & np.uint64(1)).sum()) > len(every) for b in range(64)]
    assert simhash.fingerprint(text, 4) == sum(1 << b for b, one in enumerate(bits) if one) == simhash.fingerprint(text, 4, block=977)


def test_near_finds_what_all_pairs_connect():
    draw = np.random.default_rng(0)
    centres = draw.integers(-(1 << 63), (1 << 63) - 1, 4)
    fps = np.array([c ^ sum(1 << int(b) for b in draw.choice(62, draw.integers(0, 4), False)) for c in centres for _ in range(60)])
    a, b = simhash.near(fps)
    edges = [(x, y) for x in fps for y in fps if bin(int(x ^ y) % (1 << 64)).count("1") <= 4]
    assert brute_components(set(fps), zip(a, b)) == brute_components(set(fps), edges)
    assert len(a) < len(fps)


def test_without_copies(spark):
    texts = sample_texts(2, 90)
    rows = rows_of(texts)
    rows += [rows[20], rows[20], (None, texts[20], None, None, None, None, None, None, None, None), (None, "alone in the world of words here", *[None] * 8)]
    rows += [(30, "same id but quite another text than the others have", *[None] * 8)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    groups = {r.root for r in simhash.near_duplicates(docs).select("root").collect()}
    found = kept.collect()
    assert len(found) == len(groups)
    assert sum(r.text == texts[20] for r in found) <= 1 and sum(r.doc_id is None for r in found) == 1
    assert simhash.without_copies(docs.limit(0)).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    whole, done = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in done]
        level = (whole - sum(done.values())) / max(1e-9, sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] >= most * sizes[s]]
        if not over:
            return done | {s: level * weight[s] for s in rest}
        done |= {s: most * sizes[s] for s in over}
        if len(done) == len(order):
            return done


@pytest.mark.parametrize("group_rows", [mixing.GROUP_ROWS, 2])
def test_mix(spark, group_rows):
    draw = random.Random(8)
    sources = ["b", "a", None, "é", "Z", "a", "a", "zz"]
    texts = [None, "", *(" ".join(["w"] * draw.choice((1, 2, 2, 2, 9, 40))) for _ in range(400))]
    rows = rows_of(texts, sources)
    rows += [rows[50]] * 3 + [(None, "x y", "a", *[None] * 7)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(docs, group_rows=group_rows).collect()
    assert len(found) == len(rows)
    size, source = Counter(), defaultdict(int)
    for r in rows:
        size[r[2]] += len((r[1] or "").split())
    want = brute_targets(size)
    for r in found:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source] and 0 <= r.copies <= 2
        source[r.source] += r.taken
        assert r.taken == r.copies * r["size"]
    for s in size:
        assert abs(source[s] - want[s]) <= 45, (s, source[s], want[s])
    again = mixing.mix(docs.repartition(7), group_rows=group_rows)
    assert sorted((str(r.doc_id), r.taken) for r in again.collect()) == sorted((str(r.doc_id), r.taken) for r in found)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("doc_id < 2")).collect()} == {0}


@pytest.mark.parametrize("part_bytes, part_rows", [(shards.PART_BYTES, shards.PART_ROWS), (4000, 60)])
def test_shard(spark, part_bytes, part_rows):
    draw = random.Random(3)
    texts = [None, "", *("x" * draw.randint(1, 60) + str(i // 3) for i in range(900)), *["hot"] * 120]
    docs = spark.createDataFrame(rows_of(texts) + rows_of(["again"])[:1] * 2, DOCS)
    key, size = F.xxhash64(F.coalesce("text", F.lit(""))), F.octet_length(F.coalesce("text", F.lit(""))) + 1
    out = shards.shard(docs, key, size, part_bytes=part_bytes, part_rows=part_rows)
    assert set(out.columns) == {*docs.columns, "slot"}
    found = out.collect()
    assert len(found) == len(texts) + 2
    weight, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in found:
        weight[r.shard] += len(r.text or "") + 1
        slots[r.shard].append(r.slot)
        places[r.text or ""].add(r.shard)
    assert set(weight) == set(range(8)) and max(weight.values()) - min(weight.values()) <= 2 * 4 * 120
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, places.values())) == 1
    assert shards.shard(docs.limit(0), key, size).count() == 0
    assert shards.shard(docs.limit(1), key, size).select("slot").collect()[0].slot == 0
    one = shards.shard(docs, F.lit(None), size, part_rows=50).collect()
    assert len({r.shard for r in one}) == 1 and sorted(r.slot for r in one) == list(range(len(found)))


def test_pieces_and_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    draw = random.Random(6)
    texts = [None, "", "a", "  two  blanks \n\n x", "<|endoftext|>", "don't\tstop\r\n.", "long words " * 3000, "日本語 テスト。\nabc", "x" * 20000]
    texts += [" ".join("".join(draw.choice("abcé.,\n") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(1, 300))) for _ in range(200)]
    rows = rows_of(texts) + rows_of(["twice"])[:1] * 2
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    packed = packing.pack(packing.pieces(docs, with_ids=True), group=64)
    found = packed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for i, text in enumerate(texts[1:], 1):
        ids = whole.encode(text, add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == ids and [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert len(own) == -(-len(ids) // 2048) and all(r.length == 2048 for r in own[1:])
    assert len(by_doc[0]) == 3
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 2048
    total = sum(r.length for r in found)
    assert len(by_sequence) <= total / 2048 * 1.1 + 1
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0


def test_sum_of_squares_takes_the_smallest_sum():
    draw = np.random.default_rng(2)
    lengths = draw.integers(1, 40, 300)
    bins, offsets = packing.sum_of_squares(lengths, 40)
    gaps = Counter()
    for i in np.argsort(-lengths, kind="stable"):
        s, best = int(lengths[i]), None
        for gap in [g for g in gaps if g >= s and gaps[g]] + [40]:
            after = gaps.copy()
            if gap < 40:
                after[gap] -= 1
            if gap > s:
                after[gap - s] += 1
            cost = sum(n * n for n in after.values())
            if best is None or cost < best[0]:
                best = cost, after
        after = gaps.copy()
        gap = 40 - int(offsets[i])
        if gap < 40:
            after[gap] -= 1
        if gap > s:
            after[gap - s] += 1
        assert sum(n * n for n in after.values()) == best[0]
        gaps = after
    assert np.bincount(bins, weights=lengths).max() <= 40
