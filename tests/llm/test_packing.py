"""Packing: pieces against the tokenizers library, places without gaps, counts of sequences against plain packers."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from sieveline.llm import packing
from sieveline.llm.bpe import vocabulary_path


def plain(lengths, capacity):
    """Pieces one by one: large ones matched with the longest that fits, small ones into the smallest gap."""
    large = sorted((x for x in lengths if 3 * x > capacity), reverse=True)
    bins = []
    while large:
        a = large.pop(0)
        b = next((x for x in large if a + x <= capacity), None)
        if b is not None:
            large.remove(b)
        bins.append(a + (b or 0))
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        best = max((i for i, used in enumerate(bins) if used + x <= capacity), key=lambda i: bins[i], default=None)
        if best is None:
            bins.append(x)
        else:
            bins[best] += x
    return bins


def test_the_plan_packs_as_pieces_one_by_one():
    rng = random.Random(5)
    for _ in range(300):
        capacity = rng.choice([7, 20, 64])
        lengths = [min(capacity, 1 + int(rng.expovariate(rng.choice([1, 4]) / capacity * 2))) for _ in range(rng.randrange(60))]
        groups = packing.packed_groups(Counter(lengths), capacity)
        content = Counter()
        for times, parts in groups:
            assert times > 0 and sum(a * b for a, b in parts) <= capacity
            assert sum(b for a, b in parts if 3 * a > capacity) <= 2
            for a, b in parts:
                content[a] += times * b
        assert content == Counter(lengths)
        ours = sorted(sum(a * b for a, b in parts) for times, parts in groups for _ in range(times))
        assert ours == sorted(plain(lengths, capacity))


def test_a_plan_does_not_grow_with_the_corpus():
    rng = random.Random(6)
    counts = {x: rng.randrange(1, 10**9) for x in range(1, 2049)}
    places = packing.places(counts)
    assert len(places) < 4 * 2048
    total = sum(k * x for x, k in counts.items())
    made = max(p[3] + -(-(p[2] - p[1]) // p[4]) for p in places)
    assert made <= math.ceil(total / 2048) * 1.2
    assert packing.places({}) == []


def check(df, docs, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    library.no_padding()
    library.no_truncation()
    expected = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[r["doc_id"], i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = df.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(x[1] for x in parts[:i]) for i in range(len(parts))]
        assert sum(p[1] for p in parts) <= capacity
    assert len(by) == len(plain([r["length"] for r in rows], capacity))


def test_documents_are_packed_whole(docs, empty):
    for capacity in (16, 2048):
        check(packing.pack_documents(docs, capacity=capacity), docs, capacity)
    assert packing.pack_documents(empty).count() == 0


def test_a_length_of_many_pieces_is_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3)
    many = spark.createDataFrame([(i % 40, "one two three") for i in range(90)] + [(None, None)] * 20, "doc_id long, text string").repartition(5)
    check(packing.pack_documents(many, capacity=9), many, 9)


def test_sequences_hold_the_ids(docs):
    packed = packing.pack_documents(docs, capacity=64, with_ids=True).cache()
    crc = {(r["sequence_id"], r["offset"]): (r["ids_crc32"], r["length"]) for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        for a, b in zip(r["starts"], [*r["starts"][1:], len(r["ids"])], strict=True):
            assert crc.pop((r["sequence_id"], a)) == (zlib.crc32(np.array(r["ids"][a:b], "<u4").tobytes()), b - a)
    assert not crc
