import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from peakloom.llm import licenses as L

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_notices(text, model):
    """Every paragraph scored, without the pattern of cues."""
    out = []
    for i, line in enumerate((text or "").split("\n")):
        words = [w for w in regex.sub(r"[^\p{L}0]+", " ", regex.sub(r"[0-9]+(\.[0-9]+)*", "0", line.lower())).split(" ") if w]
        gs = L.grams(words)
        z = np.array(model.bias) + sum((np.array(model.weights[g]) for g in gs if g in model.weights), np.zeros(len(model.bias)))
        e = np.exp(np.r_[0, z] - max(0, z.max()))
        p, k = e[1:].max() / e.sum(), int(z.argmax())
        if p >= model.least:
            family = L.FAMILIES[1 + k]
            alike = max(len(t & gs) / min(len(t), max(1, len(gs))) for t in (L.grams(L.normal_words(x)) for x in L.TEMPLATES[family]))
            out.append((i, family, round(float(p), 6), bool(alike >= L.LEAST_OVERLAP)))
    return out


def cases():
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (4, "word " * 30000 + "\nLicensed under CC BY-NC 4.0.\nmore\nLicensed under the GPLv3.")]
    rows += [(10 + i, t) for i, t in enumerate(t for ts in L.TEMPLATES.values() for t in ts)]
    rows += [(100 + i, t) for i, t in enumerate(L.PROSE)]
    rows += [(200, "É licensed, the work: apache License version 9.1 ünder"), (201, "licence license LICENSE"), (202, "mit\nMIT License\nlicensed under the mit license")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in cases()], DOCS).withColumns({"family": F.lit("extra"), "NOTICES": F.lit(1)}).repartition(3)


def as_rows(df):
    return sorted(((r.doc_id, r.n_paragraphs, [(n.paragraph, n.family, round(n.probability, 6), n.confirmed) for n in r.notices]) for r in df.collect()), key=repr)


def test_scan_equals_plain_scoring(spark, table):
    model = L.train()
    want = sorted(((i, (t or "").count("\n") + 1, plain_notices(t, model)) for i, t in cases()), key=repr)
    assert as_rows(L.scan_documents(table)) == want
    assert L.license_verdicts(table.limit(0)).count() == 0


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train()
    want = sorted(((r.doc_id, r.text.count("\n") + 1, plain_notices(r.text, model)) for r in docs.collect()), key=repr)
    assert as_rows(L.scan_documents(docs)) == want
    assert sum(bool(w[2]) for w in want) > 10
    told = {r.doc_id: r for r in L.license_verdicts(docs).collect()}
    assert all((told[d].family != L.UNKNOWN) == bool(n) and told[d].n_notices == len(n) for d, _, n in want)


def test_notices_and_prose_are_told_apart():
    model = L.train()
    for family, templates in L.TEMPLATES.items():
        for t in templates:
            assert [(f, sure) for _, f, _, sure in plain_notices(t, model)] == [(family, True)], t
    assert not any(plain_notices(p, model) for p in L.PROSE)
    fresh = L.examples(99)
    right = sum((plain_notices(" ".join(w), model) or [(0, L.UNKNOWN)])[0][1] == L.FAMILIES[k] for w, k in fresh)
    assert right / len(fresh) > 0.97
