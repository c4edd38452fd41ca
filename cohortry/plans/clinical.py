"""The operators put together for hospital tables.

Each function takes the source tables (see ``cohortry.sources.tables.SCHEMAS``) and returns one feature
table keyed by (subject_id, hadm_id).  They are plain lazy compositions: the caller decides what to
write and when.  Panel pairs are a parameter (``panel_table``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions import numbers as num
from cohortry.functions import text as tx
from cohortry.functions.times import age_at
from cohortry.operators import linkage, numeric, panels, pick, sampling, text, vectors, windows

KEY = ["subject_id", "hadm_id"]

#: Steps that several branches share, or that shuffle much, go through ``land``.
Land, _as_is = text.Land, text.as_is

# Chart items for height and weight, in order of priority.
CHART_HEIGHT_UNITS = {226707: "inch", 226730: "cm"}
CHART_WEIGHT_UNITS = {226512: "kg", 224639: "kg", 226531: "lbs", 226846: "kg"}
CHIEF_COMPLAINT_ITEM = 223112

# Tests and specimens that are no patient cultures.
EXCLUDED_TESTS = [
    "ADDITIONAL CELLS COUNTED",
    "Additional Cells and Karyotype",
    "Blood Culture, Post Mortem",
    "CHROMOSOME ANALYSIS - ADDITIONAL KARYOTYPE",
    "CHROMOSOME ANALYSIS-AMNIOTIC FLUID",
    "CHROMOSOME ANALYSIS-BLOOD",
    "CHROMOSOME ANALYSIS-BONE MARROW",
    "CHROMOSOME ANALYSIS-CVS",
    "CHROMOSOME ANALYSIS-FLUID",
    "CHROMOSOME ANALYSIS-NEOPLASTIC BLOOD",
    "CHROMOSOME ANALYSIS-TISSUE",
    "CVS NEEDLE ASPIRATION EVALUATION",
    "Cryopreservation - Cells",
    "Deparaffinization, Lysis of Cells",
    "FISH ANALYSIS, 10-30 CELLS",
    "FISH ANALYSIS, 3-5 CELLS",
    "FOCUSED ANALYSIS",
    "INTERPHASE FISH ANALYSIS, 100-300 CELLS",
    "INTERPHASE FISH ANALYSIS, 25-99 CELLS",
    "MOLECULAR CYTOGENETICS - DNA PROBE",
    "MOLECULAR CYTOGENETICS-DNA Probe",
    "POST MORTEM MYCOLOGY CULTURE",
    "POST-MORTEM ACID-FAST CULTURE",
    "POST-MORTEM DIRECT ACID-FAST STAIN",
    "POST-MORTEM VIRAL CULTURE",
    "POSTMORTEM CULTURE",
    "Problem",
    "Stool Hold Request",
    "TISSUE CULTURE-AMNIOTIC FLUID",
    "TISSUE CULTURE-CVS",
    "TISSUE CULTURE-FLUID",
    "TISSUE CULTURE-LYMPHOCYTE",
    "Tissue Culture - Neoplastic Blood",
    "Tissue Culture-Bone Marrow",
    "Tissue culture for additional cells",
    "voided",
]
EXCLUDED_SPECIMENS = [
    "POSTMORTEM CULTURE",
    "BLOOD CULTURE (POST-MORTEM)",
    "BONE MARROW - CYTOGENETICS",
    "AMNIOTIC FLUID",
    "CHORIONIC VILLUS SAMPLE",
    "NEOPLASTIC BLOOD",
    "MICRO PROBLEM PATIENT",
    "Touch Prep/Sections",
]

# Features of the training table, in contract order.
TEXT_FEATURES = ["diag_history", "discharge_history", "triage", "chief_complaint"]
LAB_FEATURES = [
    "blood_gas", "blood_chemistry", "blood_hematology", "urine_chemistry", "urine_hematology", "other_body_fluid_chemistry",
    "other_body_fluid_hematology", "ascites", "pleural", "csf", "bone_marrow", "joint_fluid", "stool",
]
MICRO_PANELS = [
    "blood_culture_routine", "blood_bottle_gram_stain", "urine_culture", "urine_viral", "urinary_antigens",
    "respiratory_non_invasive", "respiratory_invasive", "respiratory_afb", "respiratory_viral", "respiratory_pcp_legionella",
    "gram_stain_respiratory", "gram_stain_wound_tissue", "gram_stain_csf", "wound_culture", "hardware_and_lines_culture",
    "pleural_culture", "peritoneal_culture", "joint_fluid_culture", "fluid_culture", "bone_marrow_culture", "csf_culture",
    "fungal_tissue_wound", "fungal_respiratory", "fungal_fluid", "mrsa_staph_screen", "resistance_screen", "cdiff",
    "stool_bacterial", "stool_parasitology", "herpesvirus_serology", "hepatitis_hiv", "syphilis_serology", "misc_serology",
    "herpesvirus_culture_antigen", "gc_chlamydia_sti", "vaginal_genital_flora", "throat_strep",
]
FEATURES = TEXT_FEATURES + [f"lab_{g}" for g in LAB_FEATURES] + ["radiology"] + [f"micro_{p}" for p in MICRO_PANELS]
COLUMNS = [*KEY, "split", "y1_mortality", "y2_readmission", "demographic_vec", *[f"{f}_embedding" for f in FEATURES]]


def with_visit(events: DataFrame, admissions: DataFrame, ts: str, strategy: str = "drop", asof: bool = False, tol_hours: float = 2) -> DataFrame:
    """Events with a visit key: null keys are dropped, or linked by time."""
    if strategy == "drop":
        return linkage.drop_null_key(events, "hadm_id")
    if strategy != "link":
        raise ValueError(f"strategy must be 'drop' or 'link', got {strategy!r}")
    args = (events, admissions, "subject_id", "hadm_id", ts, "admittime")
    return linkage.link_asof_forward(*args, tol_hours) if asof else linkage.link_by_window(*args, "dischtime", tol_hours)


def splits(admissions: DataFrame, fractions: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Subject-level split of every visit, stratified by whether the subject ever died."""
    people = sampling.outcome_rate(admissions, "subject_id", "hospital_expire_flag")
    chosen = sampling.stratified_split(people, "subject_id", "ever", fractions, seed)
    return sampling.attach_split(admissions.select(*KEY), chosen, "subject_id")


def labels(admissions: DataFrame, days: int = 30) -> DataFrame:
    out = sampling.outcome_labels(admissions, "subject_id", "hadm_id", "admittime", "dischtime", "hospital_expire_flag", days)
    return out.select(*KEY, F.col("y1").alias("y1_mortality"), F.col("y2").alias("y2_readmission"))


# part of the measurement name, unit mark in the name, factor of that unit, plausible range
_OMR_KINDS = {
    "height": ("inches", num.UNIT_FACTORS["inch"], num.PLAUSIBLE["height_cm"]),
    "weight": ("lbs", num.UNIT_FACTORS["lbs"], num.PLAUSIBLE["weight_kg"]),
    "bmi": (None, 1.0, num.PLAUSIBLE["bmi"]),
}


def _omr_values(admissions: DataFrame, omr: DataFrame, land: Land = _as_is) -> DataFrame:
    """Per visit the outpatient height, weight and BMI nearest to it: one as-of pass over (subject, kind)."""
    found = []
    for kind, (unit, factor, bounds) in _OMR_KINDS.items():
        value = num.to_number("result_value")
        if unit is not None:
            value = F.when(num.name_contains("result_name", unit), value * F.lit(factor)).otherwise(value)
        entry = F.struct(F.lit(kind).alias("kind"), num.plausible(value, *bounds).alias("x"))
        found.append(F.when(num.name_contains("result_name", kind), entry))
    measured = pick.dedup(omr, ["subject_id", "chartdate", "result_name"], ["seq_num"])
    rows = measured.withColumn("e", F.explode(F.filter(F.array(*found), lambda e: e.isNotNull()))).select(
        F.struct("subject_id", F.col("e.kind").alias("kind")).alias("line"), "chartdate", F.col("e.x").alias("x"),
        F.struct("seq_num", "result_name").alias("tie"),
    )
    rows = land(rows, "omr_values")
    kinds = F.explode(F.array(*[F.lit(k) for k in _OMR_KINDS]))
    wanted = admissions.select("subject_id", "hadm_id", "admittime", kinds.alias("kind")).select(
        F.struct("subject_id", "kind").alias("line"), "hadm_id", "admittime"
    )
    near = pick.closest_to_anchor(wanted, rows, "line", "hadm_id", "admittime", "chartdate", "x", "tie")
    wide = near.groupBy("hadm_id").agg(*[F.max(F.when(F.col("line.kind") == k, F.col("x"))).alias(f"omr_{k}") for k in _OMR_KINDS])
    return land(wide, "omr_nearest")


def _chart_units(units: Mapping[int, str]) -> Column:
    item = F.col("itemid")
    value = F.col("valuenum")
    for code, unit in units.items():
        if unit in num.UNIT_FACTORS:
            value = F.when(item == code, F.col("valuenum") * F.lit(num.UNIT_FACTORS[unit])).otherwise(value)
    return value


def demographics(
    admissions: DataFrame, patients: DataFrame, omr: DataFrame, chartevents: DataFrame, split_table: DataFrame,
    strategy: str = "drop", seed: int = 42, land: Land = _as_is,
) -> DataFrame:
    """``demographic_vec``: age, sex, height, weight, BMI and three missing flags, imputed from train strata.

    The outpatient values and the measured rows are read twice each, so a caller with large tables lands them.
    """
    items = [*CHART_HEIGHT_UNITS, *CHART_WEIGHT_UNITS]
    charted = with_visit(chartevents.where(F.col("itemid").isin(items)), admissions, "charttime", strategy, tol_hours=1)
    tall = charted.where(F.col("itemid").isin(list(CHART_HEIGHT_UNITS))).withColumn(
        "chart_height", num.plausible(_chart_units(CHART_HEIGHT_UNITS), *num.PLAUSIBLE["chart_height_cm"])
    )
    heavy = _chart_units(CHART_WEIGHT_UNITS)
    heavy = charted.where(F.col("itemid").isin(list(CHART_WEIGHT_UNITS))).withColumn("chart_weight", F.when(heavy > 0, heavy))
    rank = F.array_position(F.array(*[F.lit(i) for i in CHART_WEIGHT_UNITS]), F.col("itemid").cast("int"))
    tall = pick.earliest(tall, "hadm_id", "chart_height", "charttime", "valuenum")
    heavy = pick.by_priority_then_time(heavy, "hadm_id", "chart_weight", rank, "charttime", "valuenum")

    rows = admissions.join(patients, "subject_id", "left").select(
        *KEY, age_at("anchor_age", "anchor_year", "admittime").cast("double").alias("age"), num.encode("gender", num.SEX_CODES).alias("sex")
    )
    for part in (_omr_values(admissions, omr, land), tall, heavy):
        rows = rows.join(part, "hadm_id", "left")
    rows = rows.select(
        *KEY, "age", "sex", num.prefer("omr_height", "chart_height").alias("height"),
        num.prefer("omr_weight", "chart_weight").alias("weight"), F.col("omr_bmi").alias("bmi"),
    )
    rows = numeric.missing_flags(land(rows, "measured"), ["height", "weight", "bmi"]).withColumn(
        "stratum", numeric.stratum_of(num.bin_left("age", num.AGE_BOUNDS, num.AGE_LABELS), "sex")
    )
    stats = numeric.fit_strata_stats(rows, split_table, "hadm_id", "stratum", ["height", "weight"])
    full = numeric.impute_normal(rows, stats, "stratum", ["height", "weight"], "hadm_id", seed)
    full = full.withColumn("bmi", num.derive_bmi("height", "weight", "bmi"))
    full = full.withColumn("height", num.clip(F.col("height"), *num.PLAUSIBLE["height_cm"]))
    full = full.withColumn("weight", num.clip(F.col("weight"), *num.PLAUSIBLE["weight_kg"]))
    vec = num.assemble_vector("age", "sex", "height", "weight", "bmi", "height_missing", "weight_missing", "bmi_missing")
    return full.select(*KEY, vec.alias("demographic_vec"))


def diagnosis_history(admissions: DataFrame, diagnoses: DataFrame, titles: DataFrame, land: Land = _as_is) -> DataFrame:
    facts = linkage.drop_null_key(diagnoses, "hadm_id").select("hadm_id", "seq_num", "icd_code", "icd_version")
    facts = panels.lookup(facts, titles.select("icd_code", "icd_version", "long_title"), ["icd_code", "icd_version"])
    return text.history_block(admissions, facts, "subject_id", "hadm_id", "admittime", "long_title", "seq_num", land=land).select(
        *KEY, F.col("history").alias("diag_history_text")
    )


def discharge_history(admissions: DataFrame, notes: DataFrame, strategy: str = "drop", land: Land = _as_is) -> DataFrame:
    kept = with_visit(notes, admissions, "charttime", strategy).select(
        "hadm_id", "note_id", tx.from_marker("text", "Allergies:").alias("text")
    )
    return text.notes_block(admissions, kept, "subject_id", "hadm_id", "admittime", "text", "note_id", land=land).select(
        *KEY, F.col("notes").alias("discharge_history_text")
    )


def radiology(admissions: DataFrame, notes: DataFrame, strategy: str = "drop") -> DataFrame:
    """Last report inside the stay from its examination on, ``""`` without one."""
    kept = with_visit(notes, admissions, "charttime", strategy)
    inside = windows.within_stay(kept, admissions, KEY, "charttime", "admittime", "dischtime")
    inside = inside.withColumn("text", tx.from_marker("text", "EXAMINATION:"))
    last = pick.latest(inside, KEY, "text", "charttime", "note_id")
    return admissions.select(*KEY).join(last, KEY, "left").select(*KEY, F.coalesce("text", F.lit("")).alias("radiology_text"))


def triage_and_complaint(
    admissions: DataFrame, edstays: DataFrame, triage: DataFrame, chartevents: DataFrame, land: Land = _as_is
) -> DataFrame:
    """Triage sentence and chief complaint per visit that came through the emergency department."""
    bridge = edstays.select("stay_id", "hadm_id", "intime")
    linked = linkage.link_via_bridge(triage, bridge, "stay_id", "hadm_id")
    linked = linkage.link_next_after(linked, admissions, "subject_id", "hadm_id", "intime", "admittime")
    first = pick.dedup(linked, KEY, ["stay_id"])
    names = ["temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp", "pain", "acuity"]
    told = F.col("chiefcomplaint") if "chiefcomplaint" in first.columns else F.lit(None).cast("string")
    text = tx.fill_template(tx.TRIAGE_TEMPLATE, {n: n for n in names}).alias("triage_text")
    said = land(first.select(*KEY, text, F.nullif(F.trim(told), F.lit("")).alias("__told")), "triage")
    asked = chartevents.where(F.col("itemid") == CHIEF_COMPLAINT_ITEM).withColumnRenamed("value", "chief_complaint_text")
    complaint = pick.first_value_text(said, linkage.drop_null_key(asked, "hadm_id"), KEY, "chief_complaint_text", ["charttime", "chief_complaint_text"])
    # what triage took down counts; the chart serves where it has nothing
    found = said.join(complaint, KEY)
    return found.withColumn("chief_complaint_text", F.coalesce("__told", "chief_complaint_text")).drop("__told")


def lab_lines(
    admissions: DataFrame, labevents: DataFrame, d_labitems: DataFrame, window: int | str = 24, lookback_hours: float = 24,
    strategy: str = "drop", tol_hours: float = 2, land: Land = _as_is,
) -> DataFrame:
    """One text line per lab event inside the window, with its lab group."""
    items = d_labitems.where(~F.coalesce(F.trim("fluid").isin(panels.ARTEFACT_FLUIDS), F.lit(False))).select(
        "itemid", "label", panels.lab_group_of("fluid", "category").alias("lab_group")
    ).where(F.col("label").isNotNull())
    events = with_visit(panels.drop_empty(labevents, ["value", "valuenum"]), admissions, "charttime", strategy, asof=True, tol_hours=tol_hours)
    events = panels.lookup(land(events, "linked_labs"), items, ["itemid"], how="inner")
    inside = windows.anchor_window(events, admissions, KEY, "charttime", "admittime", window, "dischtime", lookback_hours)
    starts = inside if "admittime" in inside.columns else inside.join(admissions.select(*KEY, "admittime"), KEY)
    line = tx.lab_line("charttime", "admittime", "label", "value", "valuenum", "valueuom", "ref_range_lower", "ref_range_upper", "flag")
    return starts.select(*KEY, "labevent_id", "charttime", "itemid", "lab_group", line.alias("text"))


def lab_texts(lines: DataFrame) -> DataFrame:
    """Long form: the lines of each visit and lab group in time order."""
    return text.ordered_text(lines, [*KEY, "lab_group"], "text", ["charttime", "labevent_id"], "\n")


def culture_texts(
    admissions: DataFrame, events: DataFrame, panel_pairs: DataFrame, window: int | str = 72, lookback_hours: float = 24,
    strategy: str = "drop", tol_hours: float = 2, rules: Mapping = tx.COMMENT_RULES,
) -> DataFrame:
    """Long form: one text per visit and panel, all panels in one pass."""
    kept = panels.exclude(events, {"test_name": EXCLUDED_TESTS, "spec_type_desc": EXCLUDED_SPECIMENS})
    kept = with_visit(kept, admissions, "charttime", strategy, tol_hours=tol_hours)
    inside = windows.anchor_window(kept, admissions, KEY, "charttime", "admittime", window, "dischtime", lookback_hours)
    placed = panels.assign_panel(inside, panel_pairs, ["test_name", "spec_type_desc"])
    return text.panel_text(
        placed, [*KEY, "panel"], "charttime", "test_name", "spec_type_desc", "org_name", "ab_name", "interpretation", "comments",
        "microevent_id", rules,
    )


def feature_texts(
    history: DataFrame, discharge: DataFrame, emergency: DataFrame, reports: DataFrame, labs: DataFrame, cultures: DataFrame
) -> DataFrame:
    """All texts in long form: ``hadm_id, feature, text`` (blank ones left out)."""
    def named(df: DataFrame, feature: Column | str, column: str) -> DataFrame:
        name = F.lit(feature) if isinstance(feature, str) else feature
        return df.select("hadm_id", name.alias("feature"), F.col(column).alias("text"))

    # both texts of a visit's triage in one pass
    told = [F.struct(F.lit(f).alias("feature"), F.col(f"{f}_text").alias("text")) for f in ("triage", "chief_complaint")]
    frames = [
        named(history, "diag_history", "diag_history_text"), named(discharge, "discharge_history", "discharge_history_text"),
        emergency.select("hadm_id", F.inline(F.array(*told))),
        named(labs, F.concat(F.lit("lab_"), "lab_group"), "text"), named(reports, "radiology", "radiology_text"),
        named(cultures, F.concat(F.lit("micro_"), "panel"), "text"),
    ]
    return sampling.union_splits(*frames).where(~tx.is_blank("text"))


def training_table(
    split_table: DataFrame, label_table: DataFrame, demographic: DataFrame, embeddings: DataFrame, dim: int
) -> DataFrame:
    """The 61 contract columns: one row per visit; a feature without text is a zero vector.

    ``embeddings`` is long (``hadm_id, feature, embedding``), so all features take one aggregation.
    """
    wide = split_table.join(label_table, KEY, "left").join(demographic, KEY, "left")
    wide = vectors.combine_long(wide, embeddings, "hadm_id", "feature", "embedding", FEATURES)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    fixed = [c for c in COLUMNS if not c.endswith("_embedding")]
    return wide.select(*fixed, *[F.coalesce(F.col(f), zeros).alias(f"{f}_embedding") for f in FEATURES])
