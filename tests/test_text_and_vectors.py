"""Text, vectors, masks, models and contracts on small fixtures."""

from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions import numbers as num
from cohortry.functions import text as tx
from cohortry.operators import contracts, evaluate, numeric, panels, profile, retrieval, text, vectors
from cohortry.sources import tables as src


@pytest.mark.parametrize("value", [
    135.0, 1.5, 0.1, 1234567.0, 1e-5, 120.0, 100000.0, 999999.5, 999999.4, 0.0001234567, 0.001, 123456.5, 123457.5, 635.9725,
    -3.25, 0.0, 1e300, 2.5e-300, 99999.95, 0.00099999995, 4.35, 1e15, 0.1 + 0.2, 112946.26, 1234565.0, 1234575.0, 1234565.5, 99999950.0, 8999995.0, 9999995.0, 2.0**52 + 1,
])
def test_general_format(spark, value):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(num.fmt_g("x")).first()[0] == f"{value:g}"


def test_general_format_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(num.fmt_g("x")).collect()] == [None, "nan", "inf"]


LAB = "t timestamp_ntz, a timestamp_ntz, label string, value string, number double, unit string, lo double, hi double, flag string"


@pytest.mark.parametrize(("value", "number", "unit", "lo", "hi", "flag", "want"), [
    (None, 135.0, "mEq/L", 135.0, 145.0, None, "[02:14] Sodium: 135 mEq/L (ref: 135-145)"),
    (None, 135.0, "mEq/L", 135.0, 145.0, " Abnormal", "[02:14] Sodium: 135 mEq/L (ref: 135-145) [ABNORMAL]"),
    (None, 130.5, "mEq/L", 135.0, 145.0, None, "[02:14] Sodium: 130.5 mEq/L (ref: 135-145) [ABNORMAL]"),
    (None, 150.0, "", 135.0, 145.0, "", "[02:14] Sodium: 150 (ref: 135-145) [ABNORMAL]"),
    (None, 150.0, None, None, 145.0, None, "[02:14] Sodium: 150"),
    (" POSITIVE ", None, None, None, None, None, "[02:14] Sodium: POSITIVE"),
])
def test_lab_line(spark, value, number, unit, lo, hi, flag, want):
    row = (datetime(2020, 1, 1, 2, 14, 30), datetime(2020, 1, 1), "Sodium", value, number, unit, lo, hi, flag)
    df = spark.createDataFrame([row], LAB)
    assert df.select(tx.lab_line("t", "a", "label", "value", "number", "unit", "lo", "hi", "flag")).first()[0] == want


def test_triage_text(spark):
    df = spark.createDataFrame([(37.0, 80, None)], "temperature double, heartrate int, pain string")
    cols = {c: F.lit(None) for c in ("resprate", "o2sat", "sbp", "dbp", "acuity")} | {c: c for c in ("temperature", "heartrate", "pain")}
    out = df.select(tx.fill_template(tx.TRIAGE_TEMPLATE, cols)).first()[0]
    assert "temperature 37.0°C" in out and "heart rate 80 bpm" in out and "pain score N/A/10" in out


@pytest.mark.parametrize(("raw", "want"), [
    (None, None), ("", None), ("  ", None), ("___", None), ("---", None), (" --- ", None), ("_-_", "_-_"),
    ("TEST CANCELLED, PATIENT CREDITED.", None), ("  Test cancelled by lab", None),
    ("NEGATIVE.  Reference Range: negative.", "NEGATIVE"), ("Reference Range only", "Reference Range only"),
    ("First part.  Second part.  Third part.", "First part.  Second part"), ("One.\nTwo.\nThree", "One.  Two"),
    ("NEGATIVE (Performed by the lab", "NEGATIVE"), ("NEGATIVE.  (Performed by", "NEGATIVE"), ("value..", "value"),
    ("x" * 300, "x" * 200), ("(", None), ("This test is new", "This test is new"),
])
def test_clean_comment(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "c string")
    assert df.select(tx.clean_comment("c")).first()[0] == want


@pytest.mark.parametrize(("org", "sus", "note", "want"), [
    ("STAPHYLOCOCCUS AUREUS", "OXACILLIN:R", None, "BLOOD CULTURE [BLOOD]: STAPHYLOCOCCUS AUREUS | OXACILLIN:R"),
    ("E COLI", "", "seen", "BLOOD CULTURE [BLOOD]: E COLI | seen"), (None, "", "NEGATIVE", "BLOOD CULTURE [BLOOD]: NEGATIVE"),
    (" ", None, None, "BLOOD CULTURE [BLOOD]: pending"),
])
def test_event_text(spark, org, sus, note, want):
    df = spark.createDataFrame([("BLOOD CULTURE", "BLOOD", org, sus, note)], "t string, s string, o string, u string, n string")
    assert df.select(tx.event_text("t", "s", "o", "u", "n")).first()[0] == want


CULTURE = "s long, v long, t timestamp_ntz, test string, spec string, org string, ab string, i string, c string, ord int"


def test_panel_text(spark):
    d1, d2 = datetime(2020, 1, 2), datetime(2020, 1, 1)
    data = [
        (1, 10, d1, "URINE", "U", "E COLI", "CIPRO", "S", None, 1), (1, 10, d1, "URINE", "U", "E COLI", "AMPI", "I", "note", 2),
        (1, 10, d1, "URINE", "U", "E COLI", "CIPRO", "R", None, 3), (1, 10, d2, "URINE", "U", None, None, None, "NEGATIVE", 4),
        (1, 10, datetime(2020, 1, 3), "URINE", "U", None, None, None, "NEGATIVE", 5), (1, 11, d1, "URINE", "U", None, None, None, None, 6),
        (1, 11, None, "STOOL", "S", None, None, None, None, 7),
    ]
    args = (["s", "v"], "t", "test", "spec", "org", "ab", "i", "c", "ord", tx.COMMENT_RULES)
    got = {r["v"]: r["text"] for r in text.panel_text(spark.createDataFrame(data, CULTURE), *args).collect()}
    assert got == {
        10: "URINE [U]: NEGATIVE | URINE [U]: E COLI | CIPRO:R, AMPI:I | note", 11: "URINE [U]: pending | STOOL [S]: pending",
    }
    empty = text.panel_text(spark.createDataFrame([], CULTURE), *args)
    assert empty.columns == ["s", "v", "text"] and empty.count() == 0


def test_markers_and_sanitize(spark):
    df = spark.createDataFrame([("HEADER\nEXAMINATION: chest",), ("plain",), (None,)], "x string")
    assert [r[0] for r in df.select(tx.from_marker("x", "EXAMINATION:")).collect()] == ["EXAMINATION: chest", "plain", ""]
    one = spark.createDataFrame([(" a\x00b\x85c ", "7", "ctx")], "x string, n string, c string")
    assert one.select(tx.sanitize("x", 5), num.clamp_int("n", 1, 10, 5), num.clamp_int("x", 1, 10, 5)).first()[:] == ("abc", 7, 5)


def test_prompt(spark):
    df = spark.createDataFrame([("ask", ""), ("ask", None), ("ask", "facts")], "p string, c string")
    got = [r[0] for r in df.select(tx.augment_prompt("p", "c")).collect()]
    assert got[:2] == ["ask", "ask"] and got[2] == tx.PROMPT_TEMPLATE.format(context="facts", original_prompt="ask")


def test_lab_groups(spark):
    items = [(3, "Blood", "Chemistry"), (1, "Blood", "Chemistry"), (2, "Blood", "Blood Gas"), (4, "Blood", "Hematology"),
             (5, "Urine", "Chemistry"), (6, "Ascites", "Hematology"), (7, "I", "Chemistry"), (8, "Hair ", "Odd Kind")]
    df = spark.createDataFrame(items, "item long, fluid string, category string")
    got = {r["lab_group"]: r["items"] for r in panels.lab_groups(df, "item", "fluid", "category").collect()}
    assert got == {"blood_chemistry": [1, 3], "blood_gas": [2], "blood_hematology": [4], "urine_chemistry": [5], "ascites": [6], "hair_odd_kind": [8]}


def test_imputation_of_unknown_and_flat_strata(spark):
    train = [(1, "a", 10.0), (2, "a", 10.0), (3, "b", 20.0), (4, "b", None)]
    df = spark.createDataFrame(train + [(5, "a", None), (6, "c", None), (7, "b", None)], "id long, stratum string, x double")
    splits = spark.createDataFrame([(i, "train" if i < 5 else "test") for i in range(1, 8)], "id long, split string")
    stats = numeric.fit_strata_stats(df, splits, "id", "stratum", ["x"])
    table = {r["stratum"]: (r["x_mean"], r["x_std"]) for r in stats.collect()}
    assert table["a"] == (10.0, 0.0) and table["b"] == (20.0, None) and table["__global__"][0] == pytest.approx(40 / 3)
    out = {r["id"]: r["x"] for r in numeric.impute_normal(df, stats, "stratum", ["x"], "id", 1).collect()}
    assert out[5] == 10.0 and out[7] == 20.0 and out[4] == 20.0 and out[6] not in (10.0, 20.0, None)


def test_standardize_like_mean_imputer_then_scaler(spark):
    x = np.array([1.0, 2.0, np.nan, 5.0])
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v), 3.0) for i, v in enumerate(x)], "i int, x double, c double")
    filled = np.where(np.isnan(x), np.nanmean(x), x)
    got = [r["x"] for r in numeric.standardize(df, df, ["x", "c"]).orderBy("i").collect()]
    assert got == pytest.approx(list((filled - filled.mean()) / filled.std()))


def _reduce_fixture(spark, n=60, dim=8):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(n, 3)) @ rng.normal(size=(3, dim)) + 0.01 * rng.normal(size=(n, dim)) + 1.0).astype(np.float32)
    x[[1, 40]] = 0
    rows = [(i, "train" if i < 30 else "test", x[i].tolist()) for i in range(n)]
    return x, spark.createDataFrame(rows, "id long, split string, e array<float>")


@pytest.mark.parametrize("method", ["svd", "pca"])
def test_reduction(spark, method):
    x, df = _reduce_fixture(spark)
    out, stats = vectors.reduce_vectors(df, "e", "split", 4, method)
    got = np.array([r["e"] for r in out.orderBy("id").collect()])
    assert got.shape == (60, 4) and not got[[1, 40]].any() and (np.abs(got).sum(axis=1) > 0).sum() == 58
    fit = np.delete(x[:30].astype(float), 1, axis=0)
    centre = fit.mean(axis=0) if method == "pca" else 0.0
    _, _, vt = np.linalg.svd(fit - centre, full_matrices=False)
    want = (x.astype(float) - centre) @ vt[:4].T
    keep = [i for i in range(60) if i not in (1, 40)]
    # the leading three directions carry the signal and are unique up to sign
    assert np.allclose(np.abs(got[keep][:, :3]), np.abs(want[keep][:, :3]), atol=1e-3)
    row = stats.first()
    share = ((fit - centre) @ vt[:4].T).var(axis=0).sum() / fit.var(axis=0).sum()
    assert row["rows"] == 29 and row["components"] == 4 and row["variance"] == pytest.approx(share, abs=1e-6)


def test_reduction_pads_and_survives_no_train_rows(spark):
    _, df = _reduce_fixture(spark)
    wide, stats = vectors.reduce_vectors(df, "e", "split", 12, "svd")
    assert {len(r["e"]) for r in wide.collect()} == {12} and stats.first()["components"] == 7
    none, stats = vectors.reduce_vectors(df.withColumn("split", F.lit("test")), "e", "split", 4)
    assert all(r["e"] == [0.0] * 4 for r in none.collect()) and stats.first()["variance"] == 0.0


def test_reduction_of_several_columns(spark):
    _, df = _reduce_fixture(spark)
    two = df.withColumn("f", F.when(F.col("id") % 7 != 3, F.transform(F.slice("e", 1, 6), lambda x: x * x)))
    out, stats = vectors.reduce_table(two, ["e", "f"], k=3, method="pca")
    for c in ("e", "f"):
        alone, row = vectors.reduce_vectors(two, c, k=3, method="pca")
        assert {(r["id"], tuple(r[c])) for r in out.collect()} == {(r["id"], tuple(r[c])) for r in alone.collect()}
        assert row.first() == stats.where(F.col("vector") == c).first()
    assert all(r["f"] == [0.0] * 3 for r in out.where("id % 7 = 3").collect())


def test_masks_leave_visible_slots_alone(spark):
    slots = [(f"s{i}", 2 * i, 2) for i in range(12)]
    df = spark.range(200).select("id", F.array_repeat(F.lit(1.0), 24).alias("v"), F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: i.cast("double")).alias("imp"))
    low, high = vectors.mask_bounds(0.1, 0.5, 7)
    for out in (vectors.mask_random(df, "id", "v", slots, 5, 0.1, 0.5, 1), vectors.mask_top_k(df, "id", "v", "imp", slots, 5, 0.1, 0.5, 1)):
        rows = out.collect()
        for r in rows:
            zero = {i // 2 for i, x in enumerate(r["v"]) if x == 0.0}
            assert zero == set(r["masked"]) and min(zero) >= 5 and low <= len(zero) <= high
        assert {len(r["masked"]) for r in rows} == set(range(low, high + 1))
    assert all(sorted(r["masked"]) == list(range(12 - len(r["masked"]), 12)) for r in rows)


def test_feature_maps():
    slots = vectors.feature_index_map({f"t{i}": 42 for i in range(17)})
    assert [(s, w) for _, s, w in slots] == [(42 * i, 42) for i in range(17)]
    schema = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("x", T.StringType())])
    assert vectors.feature_index_map(vectors.mixed_dims(schema)) == [("n", 0, 1), ("x", 1, 20)]


def test_model_hook(spark):
    def make():
        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([(1, "abc"), (2, " "), (3, None)], "id long, t string")
    got = {r["id"]: r["embedding"] for r in vectors.embed_with_model(df, "id", "t", make, 2).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


@pytest.mark.parametrize("chunk", [4096, 8])
def test_top_k_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(retrieval, "CHUNK", chunk)
    monkeypatch.setattr(retrieval, "BLOCK", 3 * chunk)
    rng = np.random.default_rng(4)
    docs, asked = rng.normal(size=(300, 5)), rng.normal(size=(17, 5))
    docs[10] = docs[200]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "d long, v array<double>").repartition(6)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "q long, v array<double>")
    got = sorted((r["q"], r["rank"], r["d"]) for r in vectors.top_k_similar(q, d, "q", "d", "v", 4).collect())
    want = []
    for i, v in enumerate(asked):
        order = sorted(range(300), key=lambda j: (((docs[j] - v) ** 2).sum(), j))[:4]
        want += [(i, r + 1, j) for r, j in enumerate(order)]
    assert got == want


def test_combine_contract(spark):
    cohort = spark.createDataFrame([(1, 10, "train"), (2, 20, "dev")], "subject_id long, hadm_id long, split string")
    part = spark.createDataFrame([(10, [0.5] * 8)], "hadm_id long, demographic_vec array<double>")
    wide = vectors.combine(cohort, {"demographic_vec": part, "extra": part.withColumnRenamed("demographic_vec", "extra")}, "hadm_id",
                           ["subject_id", "hadm_id", "split", "demographic_vec"])
    assert wide.columns == ["subject_id", "hadm_id", "split", "demographic_vec"] and wide.count() == 2
    with pytest.raises(ValueError):
        vectors.combine(cohort, {}, "hadm_id", ["hadm_id", "triage_embedding"])


def test_contract_of_the_wide_table(spark):
    embeddings = [f"e{i}_embedding" for i in range(55)]
    names = ["subject_id", "hadm_id", "split", "y1", "y2", "demographic_vec", *embeddings]
    schema = "subject_id long, hadm_id long, split string, y1 long, y2 float, demographic_vec array<double>, " + ", ".join(f"{e} array<float>" for e in embeddings)
    rows = [(i, i, "train" if i < 5 else ("dev" if i < 8 else "test"), i % 2, None if i % 2 else 1.0, [0.0] * 8, *[[0.0] * 4] * 55) for i in range(10)]
    df = spark.createDataFrame(rows, schema)
    report = contracts.check_contract(df, names, {"y1": ["bigint"], "e0_embedding": ["array<float>"]}, ["y1"], {"demographic_vec": 8, **{e: 4 for e in embeddings}})
    assert len(names) == 61 and {r["status"] for r in report.collect()} == {"PASS"}
    assert {r["status"] for r in contracts.check_labels(df, "y1", "y2", "split").collect()} == {"PASS"}
    flat = vectors.flatten(df, ["demographic_vec", *embeddings])
    assert flat.select(F.size("features")).first()[0] == 228
    with pytest.raises(ValueError):
        contracts.require_columns(df, ["reward"])


def test_temperature_and_calibration(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000) * 2
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(int)
    df = spark.createDataFrame([(int(a), float(b * 3)) for a, b in zip(y, z)], "y int, logit double")
    t = evaluate.fit_temperature(df, "y", "logit")
    grid = np.exp(np.linspace(math.log(1.5), math.log(6), 4001))
    loss = [np.mean(np.logaddexp(0, 3 * z / g) - y * 3 * z / g) for g in grid]
    assert t == pytest.approx(grid[int(np.argmin(loss))], rel=2e-3)
    before = evaluate.ece(df.withColumn("p", evaluate.calibrated("logit", 1.0)), "y", "p").first()[0]
    after = evaluate.ece(df.withColumn("p", evaluate.calibrated("logit", t)), "y", "p").first()[0]
    assert after < before / 2


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7), (None, 0.1)], "y int, p double")
    assert evaluate.auroc(df, "y", "p").first()[0] is None and evaluate.auprc(df, "y", "p").first()[0] is None


def test_audit_and_manifest(spark, tmp_path):
    cohort = spark.range(3).withColumnRenamed("id", "k")
    good = cohort.withColumn("e", F.lit(1.0))
    outputs = {"good": good, "short": good.limit(2), "holes": good.withColumn("e", F.when(F.col("k") > 0, 1.0)), "gone": None}
    got = {r["output"]: r["status"] for r in contracts.audit_outputs(outputs, cohort, "k", "e").collect()}
    assert got == {"good": "complete", "short": "partial", "holes": "partial", "gone": "missing"}
    (tmp_path / "a.csv").write_text("1"), (tmp_path / "b.csv").write_text("2")
    before = spark.createDataFrame(contracts.source_manifest(spark, str(tmp_path)).collect())
    (tmp_path / "b.csv").write_text("3"), (tmp_path / "c.csv").write_text("4")
    now = contracts.source_manifest(spark, str(tmp_path))
    assert {r["file"][-5:]: r["state"] for r in contracts.changed(now, before).collect()} == {"b.csv": "changed", "c.csv": "new"}


def test_csv_source(spark, tmp_path):
    import gzip

    base, extra = tmp_path / "base", tmp_path / "extra"
    base.mkdir(), extra.mkdir()
    with gzip.open(base / "discharge.csv.gz", "wt") as f:
        f.write('note_id,subject_id,hadm_id,charttime,text,unused\nn1,1,,2020-01-01 00:00:00,"two\nlines, ""quoted""",x\n')
    roots = [str(extra), str(base)]
    df = src.read_table(spark, "discharge", roots, src.SCHEMAS["discharge"], ["subject_id", "hadm_id", "text"])
    assert df.dtypes == [("subject_id", "bigint"), ("hadm_id", "bigint"), ("text", "string")]
    assert df.collect()[0][:] == (1, None, 'two\nlines, "quoted"')
    with pytest.raises(FileNotFoundError):
        src.read_table(spark, "radiology", roots, src.SCHEMAS["radiology"])
    assert src.read_table(spark, "radiology", roots, src.SCHEMAS["radiology"], optional=True).count() == 0
    with pytest.raises(ValueError):
        src.read_table(spark, "discharge", roots, "nothing string")


def test_partitioned_sink_and_tables_of_config(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, "big").otherwise("small").alias("panel"))
    path = src.write_by(df, str(tmp_path / "out"), "panel")
    assert spark.read.parquet(path).groupBy("panel").count().count() == 2
    table = src.panel_table(spark, {"p": [("A ", "B"), ("A", "B")]})
    assert [tuple(r) for r in table.collect()] == [("A", "B", "p")]


def test_profile_helpers(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "b"), (2, "c"), (3, None)], "u int, i string")
    got = {(r["a"], r["b"]): r["units"] for r in profile.cooccurrence(df, "u", "i", 2).collect()}
    assert got == {("a", "b"): 1}
    wide = profile.to_matrix(profile.rate_matrix(df, "u", "i", F.col("i") == "a", 5, 1), "u", "i", "pct", ["a", "b"])
    assert {r["u"]: (r["a"], r["b"]) for r in wide.collect()} == {1: (100.0, 0.0), 2: (None, 0.0)}


def test_csv_is_cut(spark, tmp_path):
    (tmp_path / "labevents.csv").write_text("subject_id,hadm_id\n" + "".join(f"{i},{i}\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        read = lambda **more: src.read_table(spark, "labevents", str(tmp_path), "subject_id long, hadm_id long", **more)
        assert read().rdd.getNumPartitions() > 3 and read().count() == 20000
        assert read(multi_line=True).rdd.getNumPartitions() > 3 and read(multi_line=True).count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_embedding_sends_one_row_a_text(spark):
    """Rows of one key are added up, null and blank texts are zeros, and long texts are cut only at white space."""
    import hashlib

    words = [f"w{i % 97}é" for i in range(200_000)]
    rows = [(1, "a", "x y\tx"), (1, "a", "z"), (None, "a", None), (2, "b", " \n"), (3, "a", "  ".join(words))]
    df = spark.createDataFrame(rows, "k int, f string, t string")
    made = vectors.embed_many(df, ["k", "f"], "t", 4)
    got = {(r.k, r.f): list(r.embedding) for r in made.collect()}

    def plain(tokens):
        out = [0.0] * 4
        for t in tokens:
            h = hashlib.md5(t.encode()).hexdigest()
            out[int(h[:8], 16) % 4] += 1 if int(h[8], 16) % 2 == 0 else -1
        return [x / max(1, len(tokens)) for x in out]

    want = {(1, "a"): plain(["x", "y", "x", "z"]), (None, "a"): plain([]), (2, "b"): plain([]), (3, "a"): plain(words)}
    assert {k: pytest.approx(v, abs=1e-6) for k, v in want.items()} == got
    assert "explode" not in made._jdf.queryExecution().optimizedPlan().toString().lower()


def test_group_text_meets_its_cohort_before_groups_are_spread(spark):
    cohort = spark.createDataFrame([(1,), (1,), (None,), (2,)], "k int")
    lines = spark.createDataFrame([(1, "a", 2, "second"), (1, "a", 1, "first"), (1, "c", 1, "no"), (1, None, 1, "no"), (None, "a", 1, "no")], "k int, g string, at int, t string")
    made = text.group_text(cohort, lines, ["k"], "g", ["a", "b"], "t", ["at"])
    got = sorted(map(tuple, made.collect()), key=str)
    assert got == sorted([(1, "a", "first\nsecond")] * 2 + [(1, "b", "")] * 2 + [(None, "a", ""), (None, "b", ""), (2, "a", ""), (2, "b", "")], key=str)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_baseline_sql_asks_for_more_than_chance():
    from cohortry.plans.registry import oracle_sql

    assert oracle_sql()["baseline_model"].count("better_than_chance") == 1
