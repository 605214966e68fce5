"""Scores, mixes and packs against plain Python, row by row."""

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from brute import WORD, mix_targets
from tokenizers import Tokenizer

from peakloom.llm import mixing, packing, quality_classifier, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def plain_rows(text, buckets):
    """The table's rows of a text, one by one."""
    words, rows = (text or "").encode().split(), Counter()
    for w in words:
        rows[zlib.crc32(w) % buckets] += 1
        marked = (b"<" + w + b">").decode()
        for n in (3, 4):
            for i in range(len(marked) - n + 1):
                rows[zlib.crc32(marked[i : i + n].encode(), n) % buckets] += 1
    for a, b in zip(words, words[1:]):
        x = (zlib.crc32(a) * 0x9E3779B97F4A7C15 + zlib.crc32(b)) % 2**64
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 % 2**64
        rows[(x >> 33) % buckets] += 1
        rows[zlib.crc32(b"\x00ditto") % buckets] += a == b
    return +rows


def test_scores(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows, found = quality_classifier.training_sample(docs, labels)
    model = quality_classifier.fit(rows, found)
    texts = {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    learnt = sorted(d for d in quality if d in texts and zlib.crc32(str(d).encode()) % 4 != 2)
    assert found == [quality[d] for d in learnt]
    for d, (at, counts) in zip(learnt, rows):
        assert dict(zip(at.tolist(), counts.tolist())) == plain_rows(texts[d], quality_classifier.BUCKETS)
    for r in quality_classifier.classify(docs, labels).collect():
        mine = plain_rows(texts[r.doc_id], quality_classifier.BUCKETS)
        z = model.bias + sum(float(model.weight[k]) * n for k, n in mine.items()) / (sum(mine.values()) + quality_classifier.REST)
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def place(share, knots):
    """The time at which a schedule has met a share of its demand, on a fine grid."""
    grid = np.linspace(0, 1, 40001)
    weight = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
    done = np.r_[0, np.cumsum((weight[1:] + weight[:-1]) / 2)]
    return float(np.interp(share, done / done[-1], grid))


def plain_mix(rows):
    """size, source_size, target, taken and position by doc_id of rows (doc_id, text, source)."""
    by_source, sizes = defaultdict(list), Counter()
    for d, text, source in rows:
        n = len(WORD.findall(text or ""))
        h = xxhash.xxh64_intdigest(n.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42))
        by_source[source].append((h >> 1, d, n))
        sizes[source] += n
    goals = mix_targets(dict(sizes))
    want = {}
    for k, source in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        start, goal = 0, int(goals[source] + 0.5)
        for _, d, n in sorted(by_source[source]):
            taken = sum(max(0, min(n, goal - sizes[source] * lap - start)) for lap in range(2))
            want[d] = (n, sizes[source], round(goals[source], 6), taken, place(start / goals[source], mixing.SCHEDULES[k % 3]) if taken else None)
            start += n
    return want


def test_mix(docs):
    want = plain_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
    found = mixing.mix_plan(docs).collect()
    assert len(found) == len(want)
    for r in found:
        size, whole, target, taken, at = want[r.doc_id]
        assert (r["size"], r.source_size, r.taken) == (size, whole, taken) and r.target == pytest.approx(target, abs=1e-5)
        assert (r.position is None) == (at is None) and (at is None or r.position == pytest.approx(at, abs=1e-6))


def test_mixed_documents_follow_the_plan(spark, docs):
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    order = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    seen, last = set(), 0.0
    for d in order:
        if d not in seen:  # first takes stand in the order of their positions
            assert plan[d].position >= last - 1e-12
            seen.add(d)
            last = plan[d].position
    assert Counter(order) == Counter({d: int(r.taken / max(1, r["size"]) + 0.5) for d, r in plan.items() if int(r.taken / max(1, r["size"]) + 0.5)})


def plain_pack(lengths, capacity):
    """The rule of packing with lists: (document, start, length, sequence)."""
    pieces, cost, room, rests, over = [], [], [], [], []
    number = 0
    for d, n in enumerate(lengths):
        for k in range(n // capacity):
            pieces.append((d, k * capacity, capacity, number))
            number += 1
        rests.append(n % capacity)
    for _ in range(-(-sum(rests) // capacity)):
        cost.append(0.0)
        room.append(capacity)
    for d in sorted(range(len(lengths)), key=lambda d: (-rests[d], d)):
        n = rests[d]
        fits = [s for s in range(len(room)) if room[s] >= n]
        if n and fits:
            s = min(fits, key=lambda s: (cost[s], s))
            pieces.append((d, lengths[d] - n, n, number + s))
            room[s] -= n
            cost[s] += n + n * n / 2048
        elif n:
            over.append(d)
    left = [s for s in sorted(range(len(room)), key=lambda s: (-room[s], s)) for _ in range(room[s])]
    for d in over:
        slots = [left.pop(0) for _ in range(rests[d])]
        begin = lengths[d] - rests[d]
        for s in dict.fromkeys(slots):
            pieces.append((d, begin, slots.count(s), number + s))
            begin += slots.count(s)
    return sorted(pieces)


def test_packs(docs):
    tokenizer = Tokenizer.from_file(registry.public_vocabulary())
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    groups = defaultdict(list)
    for p in packing.pack_documents(docs, registry.public_vocabulary(), group_sequences=6).collect():
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        groups[p.sequence_id >> 32].append(p)
    assert {p.doc_id for ps in groups.values() for p in ps} == set(ids) and len(groups) > 3
    for ps in groups.values():
        mine = sorted({p.doc_id for p in ps})
        found = sorted((bisect_left(mine, p.doc_id), p.start, p.length, p.sequence_id & 0xFFFFFFFF) for p in ps)
        assert found == plain_pack([len(ids[d]) for d in mine], 4096)
