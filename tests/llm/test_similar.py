import random
from collections import defaultdict

import pytest
from brute import LOWER, WORD

import corpus_pipeline
from peakloom.llm import simhash

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {" ".join(words)} - {""} if len(words) < 5 else {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def survivors(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(sets[i], sets[j]) >= least:
                root = [root[j] if r == root[i] else r for r in root]
    best = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        best[root[i]].append(d)
    return sorted(min(ds) for ds in best.values())


def planted():
    r = random.Random(5)
    rows = []
    for k in range(30):
        words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(r.choice((60, 200, 700)))]
        changed = list(words)
        for i in range(10, len(words), 50 if k % 3 else 20):  # about 0.82, or 0.6
            changed[i] = "other"
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(changed).upper())]
    return rows + [(1000, ""), (1001, " \n"), (1002, "one two"), (1003, "One two"), (1004, "two one")]


@pytest.mark.parametrize("hot", [2, 4096])
def test_pipeline_stage_catches_jaccard(spark, hot):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = survivors(rows)
    sets = [(shingles(a[1]), shingles(b[1])) for a, b in zip(rows[:60:2], rows[1:60:2])]
    assert sum(jaccard(*p) >= 0.8 for p in sets) >= 15 and sum(jaccard(*p) < 0.8 for p in sets) >= 5
    assert sorted(x.doc_id for x in simhash.drop_similar(docs, hot=hot, split=1 if hot == 2 else 512).collect()) == want
    assert sorted(x.doc_id for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == want
    assert simhash.drop_similar(docs.limit(0)).count() == 0


def test_pipeline_stage_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = survivors([(x.doc_id, x.text) for x in docs.collect()])
    assert sorted(x.doc_id for x in simhash.drop_similar(docs).collect()) == want


def test_large_group_makes_few_rows(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    rows = [(i, " ".join([*words[:180], *(f"{w}{i}" for w in words[180:188])])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = simhash.set_prints(docs, "doc_id", "text", 5)
    assert simhash.candidates(prints, hot=64).count() < 20 * len(rows)
    assert [x.doc_id for x in simhash.drop_similar(docs, split=64).collect()] == [0]
