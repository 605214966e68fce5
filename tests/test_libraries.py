"""Library text that is parsed to columns."""

import time

from peakloom.sources import libraries


def test_odd_peaks():
    text = "NAME: a\r\nPRECURSORMZ: 5\r\nComment: x\r\nNum Peaks: 3\r\n1 2; 3\t4 5;x 1;6\r\n7 8\r\n \r\nNAME: none\nNum Peaks: 0\n\nNAME: b\nNum Peaks: 1\n9 nan"
    one, two = libraries.parse_msp(text)
    assert one["peaks"] == [{"mz": 1.0, "intensity": 2.0}, {"mz": 3.0, "intensity": 4.0}, {"mz": 7.0, "intensity": 8.0}]
    assert (one["name"], one["precursor_mz"], one["metadata"]) == ("a", 5.0, {"comment": "x"})
    assert two["name"] == "b" and len(two["peaks"]) == 1
    (only,) = libraries.parse_mgf("x\nBEGIN IONS\nTITLE=c=d\nx 1; 3 4; 5 6\n7 8\nEND IONS\nBEGIN IONS\nTITLE=e\nEND IONS")
    assert only["name"] == "c=d" and only["peaks"] == [{"mz": 3.0, "intensity": 4.0}, {"mz": 7.0, "intensity": 8.0}]


def test_records_come_as_columns(spark, tmp_path):
    records = [f"NAME: n{i}\nPRECURSORMZ: 100.5\nOther: {i}\nNum Peaks: 4\n" + "".join(f"{50 + k}.25\t{k}\n" for k in range(4)) for i in range(25_000)]
    (tmp_path / "x.msp").write_text("\n".join(records))
    begin = time.monotonic()
    sum(1 for _ in libraries._msp("\n".join(records)))
    assert time.monotonic() - begin < 5
    rows = libraries.read_msp(spark, str(tmp_path / "x.msp"))
    assert rows.count() == 25_000
    last = rows.where("name = 'n24999'").first()
    assert (last.precursor_mz, last.metadata, [tuple(p) for p in last.peaks]) == (100.5, {"other": "24999"}, [(50.25 + k, float(k)) for k in range(4)])


def test_peaks_are_printed_by_batch(spark):
    from peakloom.operators.spectra import joined

    lists = [[(100.123456, 12.25), (0.5, -0.0)], [], None, [(None, 1.0), (2.0, 3.0)], [(1.0, float("inf"))]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, peaks array<struct<mz:double,intensity:double>>")
    told = rows.select("i", joined(rows.peaks, "%.5f %.1f", "|").alias("t"))
    assert "ArrowEvalPython" in told._jdf.queryExecution().optimizedPlan().toString()  # number by number in lambdas before
    assert [r.t for r in told.orderBy("i").collect()] == ["100.12346 12.2|0.50000 0.0", "", None, "2.00000 3.0", "1.00000 Infinity"]
