"""Categories, panels and dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.text import first_rule
from cohortry.functions.times import micros
from cohortry.operators.skew import prefix_sums

# Lab groups.
ARTEFACT_FLUIDS = ["I", "Q", "fluid"]
SINGLE_GROUP_FLUIDS = ["Ascites", "Pleural", "Cerebrospinal Fluid", "Bone Marrow", "Joint Fluid", "Stool"]
FLUID_CATEGORY_GROUPS = {
    ("blood", "blood gas"): "blood_gas",
    ("blood", "chemistry"): "blood_chemistry",
    ("blood", "hematology"): "blood_hematology",
    ("urine", "chemistry"): "urine_chemistry",
    ("urine", "hematology"): "urine_hematology",
    ("other body fluid", "chemistry"): "other_body_fluid_chemistry",
    ("other body fluid", "hematology"): "other_body_fluid_hematology",
    ("urine", "blood gas"): "urine_hematology",
    ("other body fluid", "blood gas"): "other_body_fluid_hematology",
    ("fluid", "blood gas"): "blood_gas",
}
SINGLE_GROUP_NAMES = {"cerebrospinal_fluid": "csf"}

# Clinical groups of blood tests, first match wins.
BLOOD_CHEMISTRY_GROUPS = [
    ("Blood - Chemistry (BMP/Electrolytes)", ["sodium", "potassium", "chloride", "bicarbonate", "anion gap", "urea nitrogen", "creatinine", "glucose", "calcium"]),
    ("Blood - Chemistry (LFT)", ["albumin", "bilirubin", "alkaline phosphatase", "alt", "ast", "ggt", "protein, total"]),
    ("Blood - Chemistry (Cardiac Markers)", ["troponin", "ck-mb", "creatine kinase", "bnp", "myoglobin"]),
    ("Blood - Chemistry (Lipid Panel)", ["cholesterol", "hdl", "ldl", "triglyceride"]),
    ("Blood - Chemistry (Blood Gas)", ["pco2", "po2", "ph", "base excess", "lactate"]),
    ("Blood - Chemistry (Inflammatory)", ["c-reactive protein", "sedimentation rate"]),
    ("Blood - Chemistry (Endocrine)", ["tsh", "thyroxine", "cortisol", "insulin", "a1c"]),
    ("Blood - Chemistry (Other)", [""]),
]
BLOOD_HEMATOLOGY_GROUPS = [
    ("Blood - Hematology (CBC)", ["hemoglobin", "hematocrit", "wbc", "platelet", "rbc", "mcv", "mch", "rdw", "neutrophil", "lymphocyte", "monocyte", "eosinophil", "basophil"]),
    ("Blood - Hematology (Coagulation)", ["pt", "inr", "ptt", "fibrinogen", "d-dimer"]),
    ("Blood - Hematology (Other)", [""]),
]


def lab_group_of(fluid: Column | str, category: Column | str) -> Column:
    """Group name of a dictionary row from its fluid and category."""
    fluid = F.trim(F.col(fluid) if isinstance(fluid, str) else fluid)
    category = F.trim(F.col(category) if isinstance(category, str) else category)
    low_fluid, low_category = F.lower(fluid), F.lower(category)
    named = [(name, name.lower().replace(" ", "_")) for name in SINGLE_GROUP_FLUIDS]
    single = [(fluid == name, SINGLE_GROUP_NAMES.get(group, group)) for name, group in named]
    pairs = [((low_fluid == f) & (low_category == c), group) for (f, c), group in FLUID_CATEGORY_GROUPS.items()]
    snake = F.replace(F.concat_ws("_", low_fluid, low_category), F.lit(" "), F.lit("_"))
    return first_rule(single + pairs, snake)


def lab_groups(dictionary: DataFrame, item: str, fluid: str, category: str) -> DataFrame:
    """Per lab group its sorted item ids; artefact fluids left out."""
    return (
        dictionary.where(~F.coalesce(F.trim(fluid).isin(ARTEFACT_FLUIDS), F.lit(False)))
        .groupBy(lab_group_of(fluid, category).alias("lab_group"))
        .agg(F.sort_array(F.collect_set(item)).alias("items"))
    )


def assign_panel(df: DataFrame, panels: DataFrame, on: Sequence[str], panel: str = "panel") -> DataFrame:
    """Rows whose trimmed key columns are listed in the panel table; the rest is dropped."""
    on = list(on)
    side = panels.select(*[F.col(c).alias(f"__{c}") for c in on], panel).dropDuplicates([f"__{c}" for c in on])
    same = None
    for c in on:
        same = (F.trim(F.col(c)) == F.col(f"__{c}")) if same is None else same & (F.trim(F.col(c)) == F.col(f"__{c}"))
    return df.join(side, same).drop(*[f"__{c}" for c in on])


def unassigned(df: DataFrame, panels: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct trimmed keys without a panel, with their row counts."""
    trimmed = df.select(*[F.trim(F.col(c)).alias(c) for c in on]).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return trimmed.join(panels.select(*on).distinct(), list(on), "left_anti")


def exclude(df: DataFrame, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """Drop rows whose column holds an excluded value (as written, not trimmed); NULL is kept."""
    keep = F.lit(True)
    for c, values in rules.items():
        keep = keep & ~F.coalesce(F.col(c).isin(list(values)), F.lit(False))
    return df.where(keep)


def clinical_group(label: str, fluid: str, category: str) -> Column:
    """Clinical group of a test: keyword rules for blood chemistry and hematology, else ``Fluid - Category``."""
    text = F.lower(F.coalesce(F.col(label), F.lit("")))
    f, c = F.lower(F.coalesce(F.col(fluid), F.lit(""))), F.lower(F.coalesce(F.col(category), F.lit("")))
    rules = []
    for kind, groups in (("chemistry", BLOOD_CHEMISTRY_GROUPS), ("hematology", BLOOD_HEMATOLOGY_GROUPS)):
        for name, words in groups:
            hit = F.lit(False)
            for word in words:
                hit = hit | text.contains(word)
            rules.append(((f == "blood") & (c == kind) & hit, name))
    return first_rule(rules, F.concat(F.initcap(f), F.lit(" - "), F.initcap(c)))


def map_values(df: DataFrame, c: str, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Replace values by a mapping table; unmapped values stay."""
    side = mapping.select(F.col(source).alias("__from"), F.col(target).alias("__to")).dropDuplicates(["__from"])
    joined = df.join(side, F.col(c) == F.col("__from"), "left")
    return joined.withColumn(c, F.coalesce("__to", c)).drop("__from", "__to")


def fold_rare(df: DataFrame, c: str, min_count: int = 100, other: str = "Other") -> DataFrame:
    """Values seen fewer than ``min_count`` times become ``other``; NULL stays."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    frequent = counts.where(F.col("__n") >= min_count).select("__v")
    joined = df.join(frequent, F.col(c) == F.col("__v"), "left")
    folded = F.when(F.col(c).isNotNull(), F.coalesce(F.col("__v"), F.lit(other)))
    return joined.withColumn(c, folded).drop("__v")


def levels_of(df: DataFrame, c: str, max_levels: int = 1000) -> list:
    """Sorted distinct values for columns-to-be; more than ``max_levels`` columns is an error, not a cut."""
    rows = df.where(F.col(c).isNotNull()).select(c).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{c} has more than {max_levels} values: too many for one column each")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, c: str, levels: Sequence | None = None, prefix: str | None = None) -> DataFrame:
    """One 0/1 column per level in place of the column."""
    levels = levels_of(df, c) if levels is None else list(levels)
    rest = [x for x in df.columns if x != c]
    flags = [F.coalesce(F.col(c) == v, F.lit(False)).cast("int").alias(f"{prefix or c}_{v}") for v in levels]
    return df.select(*rest, *flags)


def dense_codes(values: DataFrame, c: str, order: str, code: str) -> DataFrame:
    """0-based position of each distinct value in the given order, without one task over all values."""
    return prefix_sums(values.withColumn("__one", F.lit(1)), [], order, {code: "__one"}).drop("__one")


def category_codes(df: DataFrame, c: str, code: str = "code") -> DataFrame:
    """Integer codes in sorted order of the values; NULL gives -1."""
    values = df.where(F.col(c).isNotNull()).select(F.col(c).alias("__v")).distinct()
    codes = dense_codes(values, "__v", "__v", code)
    joined = df.join(codes, F.col(c) == F.col("__v"), "left").drop("__v")
    return joined.withColumn(code, F.coalesce(F.col(code), F.lit(-1)).cast("long"))


def action_index(df: DataFrame, c: str, order: str, index: str = "action") -> DataFrame:
    """Dense index of each item in first-seen order.

    Items first seen at the same moment are ordered by the item itself.
    """
    first = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias("first_seen"))
    placed = first.withColumn("__at", F.struct("first_seen", c))
    return dense_codes(placed, c, "__at", index).select(c, "first_seen", index)


def lookup(df: DataFrame, dictionary: DataFrame, on: Sequence[str], how: str = "left", fill: str | None = "") -> DataFrame:
    """Dictionary columns by key: ``left`` fills missing text with ``fill``, ``inner`` drops the row."""
    joined = df.join(dictionary, list(on), how)
    if how == "left" and fill is not None:
        text = [c for c, t in dictionary.dtypes if t == "string" and c not in on]
        joined = joined.fillna(fill, subset=text)
    return joined


def valid_dictionary(dictionary: DataFrame, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Dictionary rows whose key occurs in the facts (the facts' keys are folded first)."""
    return dictionary.join(facts.select(*on).distinct(), list(on), "left_semi")


def enrich_catalogue(facts: DataFrame, dictionary: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Distinct fact keys with their dictionary columns, sorted."""
    return facts.select(*on).distinct().join(dictionary, list(on)).select(*on, *cols).orderBy(*on)


def drop_empty(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows where every listed column is NULL."""
    return df.dropna(how="all", subset=list(cols))
