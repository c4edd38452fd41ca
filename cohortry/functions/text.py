"""Text construction and cleaning expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortry.functions.hashing import as_col
from cohortry.functions.numbers import fmt_g
from cohortry.functions.times import elapsed_hhmm

# Comment cleaning rules.
COMMENT_RULES = {
    "max_sentences": 2,
    "max_chars": 200,
    "discard_prefixes": [
        "TEST CANCELLED",
        "PATIENT CREDITED",
        "Patient credited",
        "Test cancelled",
        "test cancelled",
        "TEST NOT PERFORMED",
        "DUPLICATE ORDER",
        "GRAM STAIN OF THIS SPECIMEN INDICATES CONTAMINATION",
    ],
    "strip_triggers": [
        "Reference Range",
        "Reference range",
        "Detection Range",
        "Detection range",
        "Linear range",
        "Performed by",
        "performed by",
        "Performed using",
        "performed using",
        "Validated for use",
        "validated for use",
        "Performance characteristics",
        "performance characteristics",
        "A positive IgG result",
        "A positive IgM result",
        "This test",
        "this test",
        "In most population",
        "The FDA",
        "the FDA",
        "screened for",
        "Detection of viruses",
        "PLEASE SUBMIT ANOTHER",
        "rule out",
        "approved",
        "Patients",
        "patients",
    ],
}

# Fixed value: sentence break of comments (full stop and two blanks, or full stop at a line end).
SENTENCE_BREAK = r"\.\s{2,}|\.\n"

# Fixed value: triage sentence.
TRIAGE_TEMPLATE = (
    "Triage assessment: temperature {temperature}°C, "
    "heart rate {heartrate} bpm, respiratory rate {resprate} breaths/min, "
    "O2 saturation {o2sat}%, blood pressure {sbp}/{dbp} mmHg, "
    "pain score {pain}/10, acuity level {acuity}."
)

# Fixed value: retrieval prompt.
PROMPT_TEMPLATE = (
    "Use the following medical knowledge as reference to provide accurate recommendations:\n\n"
    "MEDICAL REFERENCE INFORMATION:\n{context}\n\n---\n\n{original_prompt}\n\n"
    "Please provide recommendations based on both the medical reference information above and your medical knowledge."
)


WHITE = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Drop white space (also tabs and line ends) on both sides."""
    return F.trim(c, F.lit(WHITE))


def is_blank(c: Column | str) -> Column:
    """True for NULL and for text of white space only."""
    return F.coalesce(F.length(strip(as_col(c).cast("string"))) == 0, F.lit(True))


def lab_line(
    ts: Column | str,
    start: Column | str,
    label: Column | str,
    value: Column | str,
    number: Column | str,
    unit: Column | str,
    low: Column | str,
    high: Column | str,
    flag: Column | str,
) -> Column:
    """``[HH:MM] label: value unit (ref: lo-hi) [ABNORMAL]`` for one measurement."""
    number, low, high = (as_col(c).cast("double") for c in (number, low, high))
    unit_text = F.coalesce(strip(as_col(unit)), F.lit(""))
    has_range = low.isNotNull() & high.isNotNull()
    outside = number.isNotNull() & has_range & ((number < low) | (number > high))
    flagged = F.coalesce(F.lower(strip(as_col(flag))) == "abnormal", F.lit(False))
    return F.concat(
        F.lit("["),
        elapsed_hhmm(ts, start),
        F.lit("] "),
        as_col(label),
        F.lit(": "),
        F.coalesce(fmt_g(number), strip(as_col(value)), F.lit("")),
        F.when(unit_text != "", F.concat(F.lit(" "), unit_text)).otherwise(""),
        F.when(has_range, F.concat(F.lit(" (ref: "), fmt_g(low), F.lit("-"), fmt_g(high), F.lit(")"))).otherwise(""),
        F.when(flagged | F.coalesce(outside, F.lit(False)), F.lit(" [ABNORMAL]")).otherwise(""),
    )


def fill_template(template: str, values: Mapping[str, Column | str], na: str = "N/A") -> Column:
    """Replace ``{name}`` by the column as text; NULL becomes ``na``."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), F.coalesce(as_col(values[name]).cast("string"), F.lit(na))]
    return F.concat(*pieces, F.lit(rest))


def from_marker(c: Column | str, marker: str) -> Column:
    """Text from the first ``marker`` on; without a marker unchanged; NULL gives ``""``."""
    text = F.coalesce(as_col(c), F.lit(""))
    at = F.instr(text, marker)
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def clean_comment(c: Column | str, rules: Mapping = COMMENT_RULES) -> Column:
    """Cleaned comment, or NULL where nothing worth keeping is left."""
    text = F.ltrim(as_col(c), F.lit(WHITE))
    discard = is_blank(text) | strip(text).rlike(r"^(_+|-+)$")
    for prefix in rules["discard_prefixes"]:
        discard = discard | text.startswith(prefix)
    cut = F.coalesce(
        *[F.when(F.instr(text, t) > 1, F.substr(text, F.lit(1), F.instr(text, t) - 1)) for t in rules["strip_triggers"]],
        text,
    )
    kept = F.array_join(F.slice(F.split(cut, SENTENCE_BREAK), 1, rules["max_sentences"]), ".  ")
    kept = F.rtrim(kept, F.lit(WHITE))
    for pattern in (r"\.\s+\($", r"\s+\($", r"\(+$", r"\.+$"):
        kept = F.regexp_replace(kept, pattern, "")
    # trimmed text is blank only if it is empty
    return F.when(~discard, F.nullif(F.substring(strip(kept), 1, rules["max_chars"]), F.lit("")))


def event_text(
    test: Column | str,
    specimen: Column | str,
    organism: Column | str,
    susceptibility: Column | str,
    comment: Column | str,
) -> Column:
    """One culture event: organism with susceptibilities and comment, else comment, else ``pending``."""
    head = F.concat(
        F.coalesce(as_col(test), F.lit("")), F.lit(" ["), F.coalesce(as_col(specimen), F.lit("")), F.lit("]: ")
    )
    sus, note = as_col(susceptibility), as_col(comment)
    with_organism = F.concat(
        as_col(organism),
        F.when(~is_blank(sus), F.concat(F.lit(" | "), sus)).otherwise(""),
        F.when(note.isNotNull(), F.concat(F.lit(" | "), note)).otherwise(""),
    )
    return F.concat(head, F.when(~is_blank(organism), with_organism).otherwise(F.coalesce(note, F.lit("pending"))))


def normalize_note(c: Column | str) -> Column:
    """One-line ASCII note for a CSV cell: breaks and commas to blanks, quotes doubled; NULL gives ``NA``."""
    text = F.regexp_replace(as_col(c), r"\r\n|\n|\r|,|\t", " ")
    text = F.trim(F.replace(text, F.lit('"'), F.lit('""')))
    text = F.regexp_replace(text, r"[^\x20-\x7E]", "")
    return F.coalesce(text, F.lit("NA"))


def sanitize(c: Column | str, max_length: int = 1000) -> Column:
    """Without control characters, cut, trimmed; NULL gives ``""``."""
    text = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"[\x00-\x1f\x7f-\x9f]", "")
    return F.trim(F.substring(text, 1, max_length))


def augment_prompt(prompt: Column | str, context: Column | str, template: str = PROMPT_TEMPLATE) -> Column:
    """Prompt wrapped with its context; without context the prompt as it is."""
    filled = fill_template(template, {"context": context, "original_prompt": prompt}, na="")
    return F.when(F.coalesce(as_col(context), F.lit("")) == "", as_col(prompt)).otherwise(filled)


def word_count(c: Column | str) -> Column:
    """White-space separated words."""
    text = strip(F.coalesce(as_col(c), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, r"\s+")))


def sentences(c: Column | str) -> Column:
    """Non-blank trimmed sentences."""
    parts = F.transform(F.split(as_col(c), SENTENCE_BREAK), strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def combined_label(a: Column | str, b: Column | str, sep: str = " - ", default: str = "Unknown") -> Column:
    """``a - b``, or ``a`` where ``b`` is missing, or the default."""
    return F.when(is_blank(a), F.lit(default)).when(is_blank(b), as_col(a)).otherwise(
        F.concat(as_col(a), F.lit(sep), as_col(b))
    )


def first_rule(rules: Sequence[tuple[Column, str]], default: Column | str) -> Column:
    """Label of the first rule whose condition holds, else the default."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(*[F.when(condition, F.lit(label)) for condition, label in rules], fallback)
