from test_licenses import plain_notices

from peakloom.llm import licenses as L

LINES = ["My scripts are under the GPLv3", "under the GPLv2", "GPLv3", "the GPLv2.1, see there", "GPLv3x", "cc0", "CC1", "under the LGPLv3", "see page 3"]


def test_cues_with_numbers(spark):
    model = L.train()
    text = "\n".join(LINES)
    want = plain_notices(text, model)
    assert {0, 1} <= {n[0] for n in want}
    found = L.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(n.paragraph, n.family, round(n.probability, 6), n.confirmed) for n in found.notices] == want
