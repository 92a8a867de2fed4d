"""Files: XYZ, records, feature tables, specs, streams."""

import json

import numpy as np
import pandas as pd

from orbitable.plans import extraction as pe
from orbitable.sources import records, tables, xyz
from orbitable.streaming import ingest

WATER = "3\nwater\nO 0.0 0.0 0.0\nH 0.96 0.0 0.0\nH -0.24 0.93 0.0\n"


def test_xyz_files_and_rejects(spark, tmp_path):
    (tmp_path / "water.xyz").write_text(WATER)
    (tmp_path / "short.xyz").write_text("3\nx\nO 0 0 0\n")
    (tmp_path / "odd.xyz").write_text("hello\n")
    (tmp_path / "word.xyz").write_text("1\n\nO 0 zero 0\n")
    atoms, bad = xyz.parse_xyz(xyz.read_texts(spark, str(tmp_path)))
    assert [(r["mol_id"], r["element"]) for r in atoms.orderBy("atom_idx").collect()] == [("water", "O"), ("water", "H"), ("water", "H")]
    assert {r["mol_id"]: r["error"] for r in bad.collect()} == {
        "short": "atom count differs", "odd": "no atom count", "word": "bad coordinate"}
    xyz.write_xyz(atoms, str(tmp_path / "out"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "out" / "mol_id=water")).collect())
    assert text.startswith("3\n\nO 0.000000")


def test_stream_appends_new_files(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    source.mkdir()
    (source / "one.xyz").write_text(WATER)
    ingest.append_stream(ingest.stream_atoms(spark, str(source)), out, state).awaitTermination()
    (source / "two.xyz").write_text(WATER)
    ingest.append_stream(ingest.stream_atoms(spark, str(source)), out, state).awaitTermination()
    assert {r["mol_id"]: r["count"] for r in spark.read.parquet(out).groupBy("mol_id").count().collect()} == {"one": 3, "two": 3}


def test_record_files(spark, tmp_path):
    nan = np.nan
    pd.DataFrame({
        "atom": ["O", "H", None], "x": [0.0, 1.0, nan], "y": [0.0, 0.0, nan], "z": [0.0, 0.5, nan],
        "dip_x": [1.0, nan, nan], "dip_y": [0.0, nan, nan], "dip_z": [0.0, nan, nan], "total_dipole": [1.0, nan, nan],
        "nbo_charge": [-0.4, 0.4, nan], "Frequency": [1000.0, 1600.0, 3400.0], "IR": [1.0, 2.0, 3.0],
        "mode_1_x": [0.1, 0.2, 0.3], "mode_1_y": [0.0, 0.0, 0.0], "mode_1_z": [0.0, 0.0, 0.0],
    }).to_feather(tmp_path / "m1.feather")
    (tmp_path / "bad.feather").write_text("nothing")
    t = records.read_records(spark, str(tmp_path))
    assert [(r["element"], r["x"]) for r in t["atoms"].orderBy("atom_idx").collect()] == [("O", 0.0), ("H", 1.0)]
    assert [r["frequency"] for r in t["modes"].orderBy("mode_idx").collect()] == [1000.0, 1600.0, 3400.0]
    assert [(r["mode_idx"], r["atom_idx"], r["dx"]) for r in t["displacements"].orderBy("mode_idx").collect()] == [(1, 1, 0.1), (2, 1, 0.2), (3, 1, 0.3)]
    assert t["mol_scalars"].first()["dip_x"] == 1.0 and t["charges"].count() == 2
    assert [r["mol_id"] for r in t["rejected"].collect()] == ["bad"]
    records.write_tables({"atoms": t["atoms"]}, str(tmp_path / "store"), 4)
    assert spark.read.parquet(str(tmp_path / "store" / "atoms")).count() == 2
    records.dump_csv({"atoms": t["atoms"]}, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv" / "atoms"), header=True).count() == 2


def test_feature_csv(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(",f1,f2,smiles,text,output\nm1,1,2.5,C,x,0.5\nm1,,3,CC,y,0.7\nm3,4,n/a,C,z,\n")
    rows = tables.read_features(spark, str(path), "Output").orderBy("seq").collect()
    assert [(r["id"], r["y"], r["f1"], r["f2"]) for r in rows] == [("m1", 0.5, 1.0, 2.5), ("m1#2", 0.7, None, 3.0)]
    ids = tmp_path / "ids.csv"
    ids.write_text("a,X1\nb,X2\n")
    assert tables.read_identifiers(spark, str(ids)).count() == 2


def test_spec(spark, tmp_path):
    entries = {"Bond length - pairs": "1,2 4,7", "Dipole atoms": [[[1, 2], 3, 4]], "Stretch Threshold": 1400, "Sub-Atoms": "1,3", "Ring x": ""}
    (tmp_path / "s.json").write_text(json.dumps(entries))
    assert tables.spec_key("Sub-Atoms") == "sub_atoms"
    spec = tables.read_spec(spark, str(tmp_path / "s.json"))
    assert spec == {"bond": [[1, 2], [4, 7]], "dipole": [[1, 2, 3, 4]], "stretch": [[1400]], "sub_atoms": [[1, 3]], "ring": []}
    assert pe.frame_of(spec["dipole"][0]) == {"origin": [1, 2], "y": 3, "plane": 4}
    assert tables.spec_table(spark, {"bond_length": [[1, 2]]}).count() == 1
    tables.save_spec(spark, entries, str(tmp_path / "saved"))
    assert tables.read_spec(spark, str(tmp_path / "saved")) == spec


def test_matrix_order(spark, tmp_path):
    df = spark.createDataFrame([("m10", 1.0), ("x", 2.0), ("m2", 3.0)], "mol_id string, f double")
    tables.write_matrix(df, str(tmp_path / "m"))
    files = sorted((tmp_path / "m").glob("part-*.csv"))
    names = [line.split(",")[0] for f in files for line in f.read_text().splitlines()[1:]]
    assert names == ["m2", "m10", "x"]


def test_xyz_text_reads_the_atoms_once(spark):
    rows = [(m, i, "C", float(i), 0.5, -1.0) for m in (1, 2, 3) for i in range(1, 4)]
    atoms = spark.createDataFrame(rows, "mol_id long, atom_idx int, element string, x double, y double, z double")
    texts = xyz.xyz_text(atoms, "note")
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    found = {r["mol_id"]: r["text"] for r in texts.collect()}
    assert found[2] == "3\nnote\nC 1.000000 0.500000 -1.000000\nC 2.000000 0.500000 -1.000000\nC 3.000000 0.500000 -1.000000"
    # Texts of one molecule are counted together; a bad number rejects.
    table = spark.createDataFrame([(1, found[1]), (1, found[1]), (2, found[2]), (3, found[3].replace("0.5", "x")), (4, None)], "mol_id long, text string")
    good, bad = xyz.parse_xyz(table)
    assert {r["mol_id"] for r in good.collect()} == {2} and good.count() == 3
    assert sorted((r["mol_id"], r["error"]) for r in bad.collect()) == [
        (1, "atom count differs"), (1, "atom count differs"), (3, "bad coordinate"), (4, "no atom count")]
