"""Readers, writers, checkpoints and stages on files made here."""

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom import stages
from peakloom.sinks import export
from peakloom.sources import checkpoints, libraries, mzml
from peakloom.streaming import arrivals


def array_xml(values, kind, packed, single):
    data = np.asarray(values, "<f4" if single else "<f8").tobytes()
    data = zlib.compress(data) if packed else data
    return f'<binaryDataArray><cvParam accession="{"MS:1000521" if single else "MS:1000523"}"/><cvParam accession="{"MS:1000574" if packed else "MS:1000576"}"/><cvParam accession="{kind}"/><binary>{base64.b64encode(data).decode()}</binary></binaryDataArray>'


def scan_xml(level, rt, mz, intensity, target=None, seconds=False, packed=True, single=False):
    unit = "UO:0000010" if seconds else "UO:0000031"
    precursor = "" if target is None else (
        f'<precursorList><precursor><isolationWindow><cvParam accession="MS:1000827" value="{target}"/><cvParam accession="MS:1000828" value="0.5"/><cvParam accession="MS:1000829" value="0.5"/></isolationWindow>'
        f'<selectedIonList><selectedIon><cvParam accession="MS:1000744" value="{target}"/></selectedIon></selectedIonList><activation><cvParam accession="MS:1000045" value="30"/></activation></precursor></precursorList>'
    )
    return f'<spectrum><cvParam accession="MS:1000511" value="{level}"/><scanList><scan><cvParam accession="MS:1000016" value="{rt * 60 if seconds else rt}" unitAccession="{unit}"/></scan></scanList>{precursor}<binaryDataArrayList>{array_xml(mz, "MS:1000514", packed, False)}{array_xml(intensity, "MS:1000515", packed, single)}</binaryDataArrayList></spectrum>'


def write_mzml(path, scans):
    path.write_text('<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>' + "".join(scans) + "</spectrumList></run></mzML>")


def segment(shift=0.0, n=80):
    """Cycles of one survey and two windows (100, 101); two compounds at 1.0 and 2.0 minutes."""
    out = []
    for k in range(n):
        rt = k * 0.04
        a, b = (h * np.exp(-0.5 * ((rt - c - shift) / 0.15) ** 2) for h, c in ((9000, 1.0), (6000, 2.0)))
        out.append(scan_xml(1, rt, [100.2, 101.3], [a + 1, b + 1], packed=k % 2 == 0))
        out += [scan_xml(2, rt, [50.0, 60.0], [a / 2, a / 3], target=100.5, single=True), scan_xml(2, rt, [70.0], [b / 2], target=101.5, seconds=True)]
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("mzml")
    write_mzml(at / "MIX_100-101_1.mzML", segment())
    write_mzml(at / "MIX_100-101_2.mzML", segment(0.03))
    return at


def test_scans(spark, folder):
    scans = mzml.read_mzml(spark, str(folder))
    assert scans.count() == 480 and mzml.read_mzml(spark, str(folder), 1).count() == 160
    r = scans.where("ordinal = 5 AND path LIKE '%_1.mzML'").first()
    assert (r.ms_level, round(r.rt, 6), r.target, r.iso_lo, r.iso_hi, r.collision_energy) == (2, 0.04, 101.5, 101.0, 102.0, 30.0)
    assert scans.where("ordinal = 4").first().mz == [50.0, 60.0]
    cycles = mzml.load_cycles(scans)
    assert cycles.count() == 480 and cycles.where("window = 100").count() == 160 and cycles.agg(F.max("cycle")).first()[0] == 79
    assert mzml.long_points(cycles).count() == 160 * 5


def test_damaged_files(spark, tmp_path):
    (tmp_path / "X_1-2_1.mzML").write_text("<mzML><spectrum>")
    assert mzml.read_mzml(spark, str(tmp_path), skip_damaged=True).count() == 0
    with pytest.raises(Exception, match="ParseError|unclosed"):
        mzml.read_mzml(spark, str(tmp_path)).count()


def test_file_names(spark):
    names = ["MIX_100-129_1_30_2.mzML", "/a/CK1_075-110_1.mzML", "s3://b/S_100-129.mzML", "x 5-9 run7.mzML", "100-129.mzML", "none.mzML"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    found = {r.path: r.p and tuple(r.p) for r in df.select("path", mzml.file_parts(F.col("path")).alias("p")).collect()}
    assert list(found.values()) == [("MIX", 100, 129, 30, 2), ("CK1", 75, 110, 0, 1), ("S", 100, 129, 0, 1), ("x", 5, 9, 0, 7), ("Sample", 100, 129, 0, 1), None]
    assert sorted(r.sample for r in mzml.group_files(df.where("path != 'none.mzML'")).collect()) == ["1", "1", "1", "2", "7"]
    with pytest.raises(Exception, match="no segment range"):
        mzml.group_files(df).collect()
    groups = spark.createDataFrame([("none.mzML", "1")], "path string, sample string")
    told = {r.path: r.sample for r in mzml.group_files(df, groups).collect()}
    assert told["none.mzML"] == "1" and told["/a/CK1_075-110_1.mzML"] == "ungrouped_CK1_075-110_1"


MSP = "Name: A\nPRECURSORMZ: 100.5\nPrecursor_type: [M+H]+\nOdd: x: y\nNum Peaks: 2\n50 1\n60.5\t2\n\n\n\nNAME: B\nRT: 3.5\nNum Peaks: 3\n14 3; 15 21; 17 2;\n\nNAME: none\nNum Peaks: 0\n"


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_libraries(spark, tmp_path, ends):
    (tmp_path / "l.msp").write_bytes(MSP.replace("\n", ends).encode())
    rows = {r.name: r for r in libraries.read_library(spark, str(tmp_path / "l.msp")).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].precursor_mz == 100.5 and rows["A"].adduct == "[M+H]+" and rows["A"].metadata == {"odd": "x: y"}
    assert [tuple(p) for p in rows["B"].peaks] == [(14.0, 3.0), (15.0, 21.0), (17.0, 2.0)] and rows["B"].rt == 3.5
    mgf = "BEGIN IONS\nTITLE=T\nPEPMASS=200.1 55\nRTINSECONDS=90\nCHARGE=1+\n50 1\n60 2\nEND IONS\n\nBEGIN IONS\nTITLE=none\nEND IONS\n"
    (tmp_path / "l.mgf").write_bytes(mgf.replace("\n", ends).encode())
    r = libraries.read_library(spark, str(tmp_path / "l.mgf")).collect()
    assert len(r) == 1 and (r[0].name, r[0].precursor_mz, r[0].rt, r[0].metadata) == ("T", 200.1, 90.0, {"charge": "1+"})
    assert libraries.read_library(spark, "x.txt") is None
    assert libraries.lean(libraries.read_msp(spark, str(tmp_path / "l.msp")), ("odd",)).where("name = 'A'").first().metadata == {"odd": "x: y"}


def test_spectra_round_trip(spark, tmp_path):
    rows = [("F1", "N", 100.5, 1.5, [(50.0, 10.0), (60.25, 7.0)]), ("F2", "", 200.5, 2.5, [(70.0, 3.0)]), ("F3", "", 300.5, 2.5, [])]
    df = spark.createDataFrame(rows, "feature_id string, name string, mz double, rt double, peaks array<struct<mz:double,intensity:double>>")
    for form, reader in (("msp", libraries.read_msp), ("mgf", libraries.read_mgf)):
        export.write_spectra(df, str(tmp_path / form), form)
        back = {r.name: [tuple(p) for p in r.peaks] for r in reader(spark, str(tmp_path / form)).collect()}
        assert back == {"N": rows[0][4], "F2": rows[1][4]}


def test_matrix(spark, tmp_path):
    features = spark.createDataFrame([("F1", 100.123456, 1.23456), ("F2", 5.0, 6.0)], "feature_id string, mz double, rt double")
    cells = spark.createDataFrame([("F1", "1", 10.26, 5.0, "detected"), ("F1", "2", 3.0, 4.0, "filled"), ("F2", "2", 1.0, 1.0, "detected")], "feature_id string, sample string, height double, area double, status string")
    matrix = export.feature_matrix(features, cells)
    rows = {r.feature_id: r for r in matrix.collect()}
    assert rows["F1"].mz == 100.12346 and rows["F1"].height_rep1 == 10.3 and rows["F2"].height_rep1 == 0.0 and rows["F2"].gap_fill_status_rep1 == ""
    export.write_table(matrix, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2
    assert export.report({"s": cells.agg(F.count("*").alias("n"))}).collect()[0].value == 3


def test_checkpoints(spark, tmp_path):
    files = spark.createDataFrame([("1", "/a/x", 5, 7), ("2", "/a/y", 5, 7)], "sample string, path string, length long, modificationTime long")
    prints = checkpoints.fingerprint({"a": 1, "late": 2}, files, frozenset({"late"}))
    same = checkpoints.fingerprint({"a": 1, "late": 3}, files, frozenset({"late"}))
    other = checkpoints.fingerprint({"a": 2}, files, frozenset({"late"}))
    assert prints.exceptAll(same).count() == 0 and prints.exceptAll(other).count() == 2
    folder = str(tmp_path / "c")
    rows = spark.createDataFrame([("1", 5), ("1", 6)], "sample string, v long")
    assert checkpoints.pending(prints, checkpoints.manifest(spark, folder), "features").count() == 2
    checkpoints.save(rows, prints.where("sample = '1'"), folder, "features")
    left = checkpoints.pending(prints, checkpoints.manifest(spark, folder), "features").collect()
    assert [r.sample for r in left] == ["2"] and checkpoints.load(spark, folder, "features", "1").count() == 2
    checkpoints.save_chromatograms(spark.range(100).select(F.col("id").alias("spot_id")), str(tmp_path / "e"))
    assert checkpoints.load_chromatograms(spark, str(tmp_path / "e"), 7).count() == 1


def test_arriving_files(spark, folder, tmp_path):
    for _ in range(2):  # the second run finds nothing new
        arrivals.ingest(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 480


def test_stages(spark, folder):
    cycles = mzml.load_cycles(mzml.read_mzml(spark, str(folder)))
    points = mzml.long_points(cycles.where("ms_level = 1")).select(F.col("path").alias("run"), F.col("cycle").alias("scan"), "rt", "mz", "intensity")
    axis = points.select("run", "scan", "rt").distinct()
    features = stages.find_features(points, axis)
    rows = sorted((round(r.mz, 1), round(r.rt, 1)) for r in features.collect())
    assert rows == [(100.2, 1.0), (100.2, 1.0), (101.3, 2.0), (101.3, 2.0)]
    marked = stages.mark_relations(features)
    assert marked.count() == 4 and not marked.where("is_duplicate").count()
    spots, members = stages.build_spots(features)
    assert [(r.feature_id, r.n_detected) for r in spots.orderBy("feature_id").collect()] == [("F00000", 2), ("F00001", 2)] and members.count() == 4


def test_detection_from_products_and_masses(spark, folder):
    cycles = mzml.load_cycles(mzml.read_mzml(spark, str(folder)))
    points = mzml.long_points(cycles).select(F.regexp_extract("path", r"_(\d)\.mzML", 1).alias("sample"), F.col("cycle").alias("scan"), "rt", "ms_level", "window", "mz", "intensity")
    products = points.where("ms_level = 2").withColumnRenamed("window", "channel")
    features, ions = stages.detect_from_products(products)
    rows = [(r.sample, r.channel, round(r.rt, 1), r.n_fragments) for r in features.collect()]
    assert sorted(rows) == [("1", 100, 1.0, 2), ("2", 100, 1.0, 2)]  # the other channel has one fragment only
    assert sorted({round(r.mz) for r in ions.collect()}) == [50, 60]
    survey = points.where("ms_level = 1")
    peak = features.select("sample", "channel", F.col("id").alias("id"), F.lit(100.2).alias("mz"), "rt", "left", "right", F.lit(9000.0).alias("height"))
    none = peak.where("false")
    both = [stages.assign_survey(features, a, b, survey).collect() for a, b in ((peak, none), (none, peak), (none, none))]
    assert [{r.mz_source for r in x} for x in both] == [{"ms1"}, {"ms1_relaxed"}, {"ms1_lowres"}]
    assert all(abs(r.survey_mz - 100.2) < 1e-6 for x in both for r in x) and {r.signal_type for r in both[2]} == {"ms2_only"}


def test_inference(spark):
    features = spark.createDataFrame([(1, 180, "ms2_only", "", "", 3), (2, 180, "ms2_only", "", "", 1), (3, 180, "ms1_detected", "ms1", "high", 1), (4, 180, "ms2_only", "", "", 5)], "id long, channel long, signal_type string, mz_source string, mz_confidence string, n_fragments long")
    ions = spark.createDataFrame([(1, 180.06 - 18.01056, 50.0), (1, 180.06 - 36.02113, 30.0), (1, 180.06 - 43.98983, 20.0), (4, 33.0, 1.0)], "id long, mz double, intensity double")
    found = {r.id: r for r in stages.infer_masses(features, ions).collect()}
    assert set(found) == {1, 3, 4} and abs(found[1].inferred_mz - 180.06) < 1e-6 and (found[1].mz_source, found[1].mz_confidence) == ("nl_consensus", "high")
    assert found[3].mz_source == "ms1" and found[4].inferred_mz is None
    hits = spark.createDataFrame([(4, 180.5)], "id long, precursor double")
    assert {r.id: r.mz_source for r in stages.infer_masses(features, ions, hits).collect()}[4] == "library"


def test_running_mean_bins(spark):
    from peakloom.operators import separation

    rows = [("r", 100, s, m, 100.0 + s) for s in range(4) for m in (50.0, 50.015, 50.4)] + [("r", 100, 9, 70.0, 500.0), ("r", 100, 0, 50.03, 5.0)]
    points = spark.createDataFrame(rows, "run string, channel long, scan long, mz double, intensity double")
    found = separation.running_mean_eics(points, ["run", "channel"], "channel").collect()
    bins = sorted({round(r.mz, 4) for r in found})
    assert bins == [50.0075, 50.4] and len(found) == 8
    assert {r.scan: r.intensity for r in found if r.mz < 50.1} == {s: 100.0 + s for s in range(4)}


def test_recall(spark):
    from peakloom.operators import separation

    bell = lambda s, c: 1000 * float(np.exp(-0.5 * ((s - c) / 2) ** 2))
    rows = [("r", 100, m, s, s * 0.01, bell(s, c)) for m, c in ((50.0, 20), (60.0, 20), (70.0, 40), (99.5, 20)) for s in range(60)]
    series = spark.createDataFrame(rows, "run string, channel long, ion double, scan long, rt double, intensity double")
    clusters = spark.createDataFrame([("r", 100, 1, 0.2, [50.0]), ("r", 100, 2, 0.4, [])], "run string, channel long, id long, rt double, mzs array<double>")
    found = sorted((r.id, r.mz) for r in separation.recall_ions(series, clusters, ["run", "channel"], "channel").collect())
    assert found == [(1, 60.0), (2, 70.0)]  # 50 is taken, 99.5 is the precursor's


def test_projects(spark, tmp_path):
    from peakloom.sources import projects

    folder = str(tmp_path / "p")
    notes = spark.createDataFrame([(1, "good")], "id long, tag string")
    with pytest.raises(FileNotFoundError):
        projects.load_project(spark, folder)
    assert projects.load_notes(spark, folder) is None
    projects.save_project({"notes": notes, "spots": notes}, folder)
    assert projects.load_notes(spark, folder).collect() == notes.collect() and set(projects.load_project(spark, folder)) == {"notes", "spots"}
    projects.save_project({"notes": notes}, folder, version=projects.VERSION + 1)
    assert projects.load_notes(spark, folder) is None
    with pytest.warns(UserWarning):
        assert set(projects.load_project(spark, folder)) == {"notes"}


def test_whole_run(spark, folder, tmp_path):
    from peakloom import engine

    work, heard = str(tmp_path / "w"), []
    library = spark.createDataFrame([(1, 100.21, [(50.0, 100.0), (60.0, 66.0)]), (2, 100.2, [(20.0, 5.0)])], "spec_id long, precursor double, peaks array<struct<mz:double,intensity:double>>")
    out = engine.run(spark, str(folder), work, library=library, progress=heard.append)
    spots = out["spots"].collect()
    assert heard == ["detect", "align", "export"] and [r.n_detected for r in spots] == [2] * len(spots) and len(spots) == 2
    assert sorted(round(r.mz, 1) for r in spots) == [100.2, 101.3] and out["cells"].count() == 4
    assert spark.read.option("header", True).csv(f"{work}/features.csv").count() == 2
    stored = spark.read.parquet(f"{work}/_manifest").count()
    with pytest.raises(engine.Cancelled):
        engine.run(spark, str(folder), work, progress=lambda s: s != "align")
    assert spark.read.parquet(f"{work}/_manifest").count() == stored == 2  # nothing was made anew
    assert engine.reannotate(spark, work, library).count() == 2
