"""Hospital tables from source rows to the training table."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortry.operators import contracts, evaluate, vectors
from cohortry.plans import clinical
from cohortry.sources.tables import SCHEMAS, panel_table, write_table

T0 = datetime(2020, 1, 1)
H = lambda h: T0 + timedelta(hours=h)


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda name, rows: spark.createDataFrame(rows, SCHEMAS[name])
    return {
        "admissions": make("admissions", [
            (1, 10, T0, H(96), "EW", 0), (1, 11, H(240), H(300), "EW", 0), (2, 20, T0, H(48), "EW", 1), (3, 30, T0, H(60), "EW", 0),
        ]),
        "patients": make("patients", [(1, "F", 50, 2018), (2, "M", 70, 2020), (3, "U", 40, 2020)]),
        "omr": make("omr", [
            (1, date(2019, 12, 1), 1, "Height (Inches)", "65"), (1, date(2019, 12, 1), 2, "Height (Inches)", "70"),
            (1, date(2019, 12, 30), 1, "Weight (Lbs)", "150"), (1, date(2020, 1, 5), 1, "BMI (kg/m2)", "24.5"), (2, date(2019, 1, 1), 1, "Height", "tall"),
        ]),
        "chartevents": make("chartevents", [
            (2, 20, 226730, H(1), None, 180.0), (2, 20, 226531, H(1), None, 200.0), (2, 20, 226512, H(5), None, 90.0),
            (2, None, 226512, H(0), None, 50.0), (1, 10, 223112, H(0), "chest pain", None), (1, 10, 223112, H(1), "other", None),
        ]),
        "d_labitems": make("d_labitems", [(5, "Sodium", "Blood", "Chemistry"), (6, "Noise", "I", "Chemistry")]),
        "labevents": make("labevents", [
            (1, 1, 10, 5, H(6), None, 135.0, "mEq/L", 135.0, 145.0, None, None), (2, 1, 10, 5, H(24), None, 150.0, "mEq/L", 135.0, 145.0, None, None),
            (3, 1, 10, 5, H(25), None, 140.0, None, None, None, None, None), (4, 1, 10, 6, H(3), None, 1.0, None, None, None, None, None),
            (5, 1, None, 5, H(-1), None, 139.0, None, None, None, None, None), (6, 1, 10, 5, H(2), None, None, None, None, None, None, None),
        ]),
        "microbiologyevents": make("microbiologyevents", [
            (1, 1, 10, H(10), "URINE", "URINE CULTURE", "E COLI", "CIPRO", "R", None), (2, 1, 10, H(108), "URINE", "URINE CULTURE", None, None, None, "LATE"),
            (3, 2, 20, H(2), "POSTMORTEM CULTURE", "URINE CULTURE", None, None, None, "x"), (4, 2, 20, H(2), "STOOL", "UNKNOWN TEST", None, None, None, "x"),
        ]),
        "diagnoses_icd": make("diagnoses_icd", [(1, 10, 1, "N18", 10), (1, 10, 2, "I10", 10), (1, 11, 1, "I10", 10)]),
        "d_icd_diagnoses": make("d_icd_diagnoses", [("N18", 10, "Kidney disease"), ("I10", 10, "Hypertension"), ("I10", 9, "Wrong version")]),
        "discharge": make("discharge", [("n1", 1, 10, H(90), "Name: x\nAllergies: none")]),
        "radiology": make("radiology", [("r1", 1, 10, H(5), "HEADER\nEXAMINATION: first"), ("r2", 1, 10, H(9), "EXAMINATION: second"), ("r3", 1, 10, H(500), "after")]),
        "edstays": make("edstays", [(1, 10, 100, H(-2), H(0)), (3, None, 300, H(-5), H(-1))]),
        "triage": make("triage", [(1, 100, "37", "80", "18", "98", "120", "80", "3", 2, "pain"), (3, 300, None, "80", None, None, None, None, None, None, None)]),
    }


def by_visit(df, column):
    return {r["hadm_id"]: r[column] for r in df.collect()}


def test_demographics(tables):
    t = tables
    split_table = t["admissions"].select("subject_id", "hadm_id", F.when(F.col("hadm_id") == 30, "dev").otherwise("train").alias("split"))
    vec = by_visit(clinical.demographics(t["admissions"], t["patients"], t["omr"], t["chartevents"], split_table), "demographic_vec")
    assert vec[10] == pytest.approx([52.0, 0.0, 65 * 2.54, 150 * 0.453592, 24.5, 0.0, 0.0, 0.0])
    assert vec[20] == pytest.approx([70.0, 1.0, 180.0, 90.0, 90 / 1.8**2, 0.0, 0.0, 1.0])
    # its stratum is not among the train rows, so it draws from the overall statistics
    assert vec[30][1] is None and vec[30][5:] == [1.0, 1.0, 1.0] and 45 <= vec[30][2] <= 230


def test_texts(tables):
    t, adm = tables, tables["admissions"]
    history = by_visit(clinical.diagnosis_history(adm, t["diagnoses_icd"], t["d_icd_diagnoses"]), "diag_history_text")
    assert history == {10: "", 20: "", 30: "", 11: "Past Diagnoses:\n\nVisit (2020-01-01):\nKidney disease\nHypertension"}
    notes = by_visit(clinical.discharge_history(adm, t["discharge"]), "discharge_history_text")
    assert notes[11] == "Prior Discharge Summary (2020-01-01):\nAllergies: none" and notes[10] == ""
    assert by_visit(clinical.radiology(adm, t["radiology"]), "radiology_text") == {10: "EXAMINATION: second", 11: "", 20: "", 30: ""}
    ed = clinical.triage_and_complaint(adm, t["edstays"], t["triage"], t["chartevents"])
    assert by_visit(ed, "chief_complaint_text") == {10: "pain", 30: ""}
    assert "heart rate 80 bpm" in by_visit(ed, "triage_text")[10] and "temperature N/A°C" in by_visit(ed, "triage_text")[30]


@pytest.mark.parametrize(("window", "strategy", "n"), [(24, "drop", 2), ("full", "drop", 3), (6, "drop", 1), (24, "link", 3)])
def test_labs(tables, window, strategy, n):
    lines = clinical.lab_lines(tables["admissions"], tables["labevents"], tables["d_labitems"], window, strategy=strategy)
    assert lines.count() == n
    first = clinical.lab_texts(lines).first()
    assert first["lab_group"] == "blood_chemistry" and "[06:00] Sodium: 135 mEq/L (ref: 135-145)" in first["text"]


def test_cultures(tables, spark):
    pairs = panel_table(spark, {"urine_culture": [("URINE CULTURE", "URINE")]})
    rows = clinical.culture_texts(tables["admissions"], tables["microbiologyevents"], pairs).collect()
    assert [(r["hadm_id"], r["panel"], r["text"]) for r in rows] == [(10, "urine_culture", "URINE CULTURE [URINE]: E COLI | CIPRO:R")]


def test_training_table_meets_its_contract(tables, spark, tmp_path):
    land = lambda df, name: spark.read.parquet(write_table(df, str(tmp_path / name)))
    t, adm = tables, tables["admissions"]
    split_table, label_table = land(clinical.splits(adm), "splits"), land(clinical.labels(adm), "labels")
    demographic = land(clinical.demographics(adm, t["patients"], t["omr"], t["chartevents"], split_table), "demographics")
    pairs = panel_table(spark, {"urine_culture": [("URINE CULTURE", "URINE")]})
    texts = clinical.feature_texts(
        clinical.diagnosis_history(adm, t["diagnoses_icd"], t["d_icd_diagnoses"]), clinical.discharge_history(adm, t["discharge"]),
        clinical.triage_and_complaint(adm, t["edstays"], t["triage"], t["chartevents"]), clinical.radiology(adm, t["radiology"]),
        clinical.lab_texts(clinical.lab_lines(adm, t["labevents"], t["d_labitems"])),
        clinical.culture_texts(adm, t["microbiologyevents"], pairs),
    )
    embedded = land(vectors.embed_many(land(texts, "texts"), ["hadm_id", "feature"], "text", 8), "embeddings")
    table = land(clinical.training_table(split_table, label_table, demographic, embedded, 8), "table")
    assert len(clinical.COLUMNS) == 61 and table.count() == 4
    report = contracts.check_contract(
        table, clinical.COLUMNS, {"demographic_vec": ["array<double>"], "triage_embedding": ["array<float>"]}, ["y1_mortality"],
        {"demographic_vec": 8, **{f"{f}_embedding": 8 for f in clinical.FEATURES}},
    )
    assert {r["status"] for r in report.collect()} == {"PASS"}
    assert {r["status"] for r in contracts.check_labels(table, "y1_mortality", "y2_readmission", "split").collect()} == {"PASS"}
    filled = {r["hadm_id"]: any(r["micro_urine_culture_embedding"]) for r in table.collect()}
    assert filled == {10: True, 11: False, 20: False, 30: False}
    assert by_visit(label_table, "y2_readmission") == {10: 1.0, 11: 0.0, 20: None, 30: 0.0}
    assert evaluate.confusion(table, "y1_mortality", "y1_mortality").first()["accuracy"] == 1.0
