"""The pipeline as a whole against plain Python, and its stages on odd rows."""

from collections import Counter, defaultdict

import pytest
from brute import LOWER, measures
from test_operators import DOCS, odd_rows
from test_plain import plain_mix
from test_similar import survivors
from tokenizers import Tokenizer

import corpus_pipeline
from peakloom.llm import registry

DATA = "/root/testdata/sf0.001"


def passes(rows):
    """Rows that the base rules and their host's shrunk rate keep."""
    kept, hosts = [], defaultdict(list)
    for d, text, source in rows:
        n, chars, symbols, dup, again = measures(text)
        base = n < 20 or 100 * again > 30 * n
        hosts[source].append(base or symbols * 10 > chars or dup * 20 > n or chars < n * 2 or chars > n * 15)
        if not base:
            kept.append((d, text, source))
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean, inverse = sum(rates) / len(rates), sum(1 / len(x) for x in hosts.values()) / len(rates)
    noise = mean * (1 - mean)
    excess = (sum((r - mean) ** 2 for r in rates) / len(rates) - noise * inverse) / (1 - inverse)
    weight = min(max(noise / excess - 1, 1.0), 1e9) if excess > 0 else 1e9
    bad = {h for h, x in hosts.items() if (sum(x) + mean * weight) / (len(x) + weight) > 0.5}
    return [x for x in kept if x[2] not in bad]


def test_run_against_plain_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows = passes([(r.doc_id, r.text, r.source) for r in docs])
    last = {}
    for d, text, _ in rows:
        last[text.translate(LOWER)] = max(d, last.get(text.translate(LOWER), d))
    rows = [x for x in rows if last[x[1].translate(LOWER)] == x[0]]
    stay = set(survivors([(d, t) for d, t, _ in rows]))
    rows = [x for x in rows if x[0] in stay]
    copies = {d: int(taken / max(1, n) + 0.5) for d, (n, _, _, taken, _) in plain_mix(rows).items()}
    tokenizer = Tokenizer.from_file(registry.public_vocabulary())
    tokens = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t, _ in rows}
    pieces = corpus_pipeline.run(spark, DATA).collect()
    cover, filled = defaultdict(Counter), Counter()
    for p in pieces:
        cover[p.doc_id].update(range(p.start, p.start + p.length))
        filled[p.sequence_id] += p.length
    assert {d for d, k in copies.items() if k} == set(cover) and max(filled.values()) <= 4096
    for d, found in cover.items():
        assert len(found) == tokens[d] and set(found.values()) == {copies[d]}


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, empty):
    docs = spark.createDataFrame([] if empty else odd_rows(), DOCS)
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == columns, name  # each takes the odd rows themselves, too
        now = stage(spark, now, DATA)
        assert now.columns == columns and now.count() <= 2 * max(1, docs.count())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ({r[0] for r in odd_rows()} if not empty else set())
