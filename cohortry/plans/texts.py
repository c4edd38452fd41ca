"""Queries of text construction, cleaning and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions import text as tx
from cohortry.functions.numbers import clamp_int
from cohortry.operators import text as top
from cohortry.plans.registry import VISIT_LABS, VISITS, Tables, big, query, rnd, visit_labs, visits
from cohortry.sources.tables import spread


def measurements(t: Tables) -> DataFrame:
    """Line items as lab rows with label, unit, reference range and flag."""
    items = t.part.select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("label"), F.col("p_type").alias("unit"),
        F.col("p_size").cast("double").alias("size"), F.col("p_type").alias("lab_group"),
    )
    starts = visits(t).select("visit_id", "start_ts")
    return spread(visit_labs(t)).join(items, "item").join(starts, "visit_id").select(
        "visit_id", "line", "item", "ts", "start_ts", "label",
        F.when(F.col("line") != 5, F.col("value") / 8).alias("number"),
        F.when(F.col("line") == 5, F.lit(" see note ")).alias("text_value"),
        F.when(F.col("unit") != "PROMO", F.col("unit")).alias("unit"),
        F.when(F.col("line") != 2, F.col("size") / 16).alias("low"),
        (F.col("size") / 16 + 3).alias("high"),
        F.when(F.col("flag") == "R", F.lit(" Abnormal ")).alias("flag"),
        F.col("lab_group"),
    )


def lined(t: Tables) -> DataFrame:
    line = tx.lab_line("ts", "start_ts", "label", "text_value", "number", "unit", "low", "high", "flag")
    return measurements(t).withColumn("text", line)


LINED = f"""{VISITS}, {VISIT_LABS},
m AS (SELECT visit_id, line, item, ts, start_ts, p_name AS label, p_type AS lab_group, CASE WHEN line <> 5 THEN value / 8 END AS number,
        CASE WHEN line = 5 THEN 'see note' ELSE '' END AS text_value, CASE WHEN p_type <> 'PROMO' THEN ' ' || p_type ELSE '' END AS unit,
        CASE WHEN line <> 2 THEN p_size::DOUBLE / 16 END AS low, p_size::DOUBLE / 16 + 3 AS high, flag = 'R' AS flagged,
        greatest(0, epoch_us(ts) - epoch_us(start_ts)) // 60000000 AS mins
      FROM visit_labs JOIN part ON p_partkey = item JOIN visits USING (visit_id)),
lined AS (SELECT visit_id, line, item, ts, lab_group,
  '[' || CASE WHEN mins // 60 < 10 THEN '0' ELSE '' END || (mins // 60) || ':' || lpad((mins % 60)::VARCHAR, 2, '0') || '] ' || label || ': '
  || coalesce(format('{{:g}}', number), text_value) || unit
  || CASE WHEN low IS NOT NULL THEN ' (ref: ' || format('{{:g}}', low) || '-' || format('{{:g}}', high) || ')' ELSE '' END
  || CASE WHEN flagged OR coalesce(number < low OR number > high, false) AND low IS NOT NULL THEN ' [ABNORMAL]' ELSE '' END AS text FROM m)"""
LINED = LINED.replace("{{", "{").replace("}}", "}")


@query("lab_line", f"WITH {LINED} SELECT visit_id, line, item, text FROM lined")
def _(t: Tables) -> DataFrame:
    return lined(t).select("visit_id", "line", "item", "text")


@query(
    "triage_text",
    """SELECT event_id, 'Triage assessment: temperature ' || coalesce(value::VARCHAR, 'N/A') || '°C, heart rate ' || user_id
  || ' bpm, respiratory rate ' || CASE WHEN event_type = 'error' THEN 'N/A' ELSE (user_id % 40)::VARCHAR END
  || ' breaths/min, O2 saturation ' || (event_id % 100) || '%, blood pressure ' || (event_id % 180) || '/' || (event_id % 110)
  || ' mmHg, pain score ' || event_type || '/10, acuity level ' || (user_id % 5) || '.' AS text FROM events""",
)
def _(t: Tables) -> DataFrame:
    values = {
        "temperature": F.col("value"), "heartrate": F.col("user_id"),
        "resprate": F.when(F.col("event_type") != "error", F.col("user_id") % 40), "o2sat": F.col("event_id") % 100,
        "sbp": F.col("event_id") % 180, "dbp": F.col("event_id") % 110, "pain": F.col("event_type"), "acuity": F.col("user_id") % 5,
    }
    return t.events.select("event_id", tx.fill_template(tx.TRIAGE_TEMPLATE, values).alias("text"))


@query(
    "from_marker",
    """SELECT doc_id, CASE WHEN instr(text, '. ') > 0 THEN substr(text, instr(text, '. ')) ELSE text END AS text FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.from_marker("text", ". ").alias("text"))


_HISTORY_FACTS = """facts AS (SELECT l_orderkey AS visit_id, l_linenumber AS ord, CASE WHEN l_returnflag = 'R' THEN '' ELSE p_name END AS title
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(
    "history_block",
    f"""WITH {VISITS}, {_HISTORY_FACTS},
b AS (SELECT visit_id, string_agg(title, chr(10) ORDER BY ord, title) FILTER (title <> '') AS lines FROM facts GROUP BY 1),
p AS (SELECT v.visit_id, string_agg(chr(10) || 'Visit (' || strftime(q.start_ts, '%Y-%m-%d') || '):' || coalesce(chr(10) || b.lines, ''),
             chr(10) ORDER BY q.start_ts, q.visit_id) AS t
      FROM visits v JOIN visits q ON q.subject_id = v.subject_id AND q.start_ts < v.start_ts JOIN b ON b.visit_id = q.visit_id GROUP BY 1)
SELECT visit_id, coalesce('Past Diagnoses:' || chr(10) || t, '') AS history FROM visits LEFT JOIN p USING (visit_id)""",
)
def _(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name")
    facts = t.lineitem.join(names, "l_partkey").select(
        F.col("l_orderkey").alias("visit_id"), F.col("l_linenumber").alias("ord"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("p_name")).alias("title"),
    )
    return top.history_block(visits(t), facts, "subject_id", "visit_id", "start_ts", "title", "ord").select("visit_id", "history")


@query(
    "notes_block",
    f"""WITH {VISITS}, n AS (SELECT doc_id AS visit_id, text FROM documents),
p AS (SELECT v.visit_id, string_agg('Prior Discharge Summary (' || strftime(q.start_ts, '%Y-%m-%d') || '):' || chr(10) || n.text,
             chr(10) || chr(10) ORDER BY q.start_ts, q.visit_id) AS t
      FROM visits v JOIN visits q ON q.subject_id = v.subject_id AND q.start_ts < v.start_ts JOIN n ON n.visit_id = q.visit_id GROUP BY 1)
SELECT visit_id, coalesce(t, '') AS notes FROM visits LEFT JOIN p USING (visit_id)""",
)
def _(t: Tables) -> DataFrame:
    notes = t.documents.select(F.col("doc_id").alias("visit_id"), "doc_id", "text")
    return top.notes_block(visits(t), notes, "subject_id", "visit_id", "start_ts", "text", "doc_id").select("visit_id", "notes")


RULES = {
    "max_sentences": 2,
    "max_chars": 200,
    "discard_prefixes": ["Le ", "Der ", "The "],
    "strip_triggers": ["tion ", "the ", "sch"],
}

def clean_sql(c: str) -> str:
    text = rf"regexp_replace({c}, '^\s+', '')"
    cut = "coalesce(" + ", ".join(
        f"CASE WHEN instr(x, '{w}') > 1 THEN substr(x, 1, instr(x, '{w}') - 1) END" for w in RULES["strip_triggers"]
    ) + ", x)"
    kept = rf"array_to_string(regexp_split_to_array({cut}, '\.\s{{2,}}|\.\n')[1:2], '.  ')"
    for pattern in (r"\s+$", r"\.\s+\($", r"\s+\($", r"\(+$", r"\.+$", r"^\s+", r"\s+$"):
        kept = f"regexp_replace({kept}, '{pattern}', '')"
    drop = " OR ".join(f"starts_with(x, '{p}')" for p in RULES["discard_prefixes"])
    return rf"""(SELECT CASE WHEN x = '' OR regexp_full_match(trim(x), '_+|-+') OR {drop} THEN NULL
      ELSE CASE WHEN trim(substr(y, 1, 200)) <> '' THEN substr(y, 1, 200) END END FROM (SELECT x, {kept} AS y FROM (SELECT {text} AS x)))"""


@query("clean_comment", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def _(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text")).select("doc_id", tx.clean_comment("text", RULES).alias("cleaned"))


@query("clean_comment_turns", f"SELECT conv_id, turn, {clean_sql('text')} AS cleaned FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.clean_comment("text", RULES).alias("cleaned"))


@query(
    "event_text",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, p_type || ' [' || p_brand || ']: ' || CASE WHEN l_returnflag <> 'N'
      THEN p_name || CASE WHEN l_linestatus = 'F' THEN ' | ' || l_returnflag || ':' || l_linestatus ELSE '' END
           || CASE WHEN l_linenumber = 1 THEN ' | first line' ELSE '' END
      WHEN l_linenumber = 1 THEN 'first line' ELSE 'pending' END AS text
    FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def _(t: Tables) -> DataFrame:
    parts = t.part.withColumnRenamed("p_partkey", "l_partkey")
    text = tx.event_text(
        "p_type", "p_brand", F.when(F.col("l_returnflag") != "N", F.col("p_name")),
        F.when(F.col("l_linestatus") == "F", F.concat_ws(":", "l_returnflag", "l_linestatus")),
        F.when(F.col("l_linenumber") == 1, F.lit("first line")),
    )
    return t.lineitem.join(parts, "l_partkey").select("l_orderkey", big("l_linenumber").alias("line"), "l_partkey", text.alias("text"))


CULTURES = """cultures AS (SELECT l_orderkey AS visit_id, date_trunc('month', l_shipdate) AS ts, p_type AS test, p_brand AS specimen,
  CASE WHEN l_returnflag <> 'N' THEN split_part(p_name, ' ', 2) END AS organism, CASE WHEN l_returnflag <> 'N' THEN split_part(p_name, ' ', 1) END AS drug,
  CASE l_linenumber % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'R' WHEN 2 THEN 'I' END AS grade,
  CASE WHEN l_linenumber < 3 THEN 'line ' || l_linenumber ELSE '---' END AS comments,
  l_partkey * 100 + l_linenumber * 10 AS ord
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def cultures(t: Tables) -> DataFrame:
    """Line items as culture rows: test, specimen, organism, antibiotic, grade, comment."""
    parts = t.part.withColumnRenamed("p_partkey", "l_partkey")
    found = F.col("l_returnflag") != "N"
    words = F.split("p_name", " ")
    four = F.col("l_linenumber") % 4
    items = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return spread(items).join(parts, "l_partkey").select(
        F.col("l_orderkey").alias("visit_id"),
        F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.col("p_type").alias("test"), F.col("p_brand").alias("specimen"),
        F.when(found, words[1]).alias("organism"), F.when(found, words[0]).alias("drug"),
        F.when(four == 0, "S").when(four == 1, "R").when(four == 2, "I").alias("grade"),
        F.when(F.col("l_linenumber") < 3, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).otherwise("---").alias("comments"),
        (F.col("l_partkey") * 100 + F.col("l_linenumber") * 10).alias("ord"),
    )


_RANK = "CASE grade WHEN 'R' THEN 0 WHEN 'S' THEN 1 WHEN 'I' THEN 2 ELSE 99 END"


@query(
    "susceptibility",
    f"""WITH {CULTURES}, d AS (SELECT visit_id, organism, drug, grade, ord, min(ord) OVER (PARTITION BY visit_id, organism, drug) AS first,
   row_number() OVER (PARTITION BY visit_id, organism, drug ORDER BY {_RANK}, ord) AS r FROM cultures WHERE drug IS NOT NULL)
SELECT visit_id, organism, string_agg(drug || ':' || coalesce(grade, ''), ', ' ORDER BY first, drug || ':' || coalesce(grade, '')) AS susceptibility
FROM d WHERE r = 1 GROUP BY 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return top.susceptibility(cultures(t), ["visit_id", "organism"], "drug", "grade", "ord")


@query(
    "panel_text",
    f"""WITH {CULTURES}, c AS (SELECT *, CASE WHEN comments <> '---' THEN comments END AS note FROM cultures),
d AS (SELECT visit_id, ts, test, specimen, organism, drug,
             arg_min(coalesce(grade, ''), {_RANK} * 1000000000000::BIGINT + ord) AS g, min(ord) AS first FROM c GROUP BY ALL),
e AS (SELECT visit_id, ts, test, specimen, organism, min(ord) AS first, arg_min(note, ord) FILTER (note IS NOT NULL) AS note FROM c GROUP BY ALL),
s AS (SELECT visit_id, ts, test, specimen, organism, string_agg(drug || ':' || g, ', ' ORDER BY first) FILTER (drug IS NOT NULL) AS sus FROM d GROUP BY ALL),
x AS (SELECT e.visit_id, e.ts, e.first, e.test || ' [' || e.specimen || ']: ' || CASE WHEN e.organism IS NOT NULL
        THEN e.organism || coalesce(' | ' || sus, '') || coalesce(' | ' || note, '') ELSE coalesce(note, 'pending') END AS text
      FROM e JOIN s ON e.visit_id = s.visit_id AND e.ts = s.ts AND e.test = s.test AND e.specimen = s.specimen AND e.organism IS NOT DISTINCT FROM s.organism),
o AS (SELECT visit_id, text, ts, first FROM x QUALIFY row_number() OVER (PARTITION BY visit_id, text ORDER BY ts, first) = 1)
SELECT visit_id, string_agg(text, ' | ' ORDER BY ts, first, text) AS text FROM o GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return top.panel_text(
        cultures(t), ["visit_id"], "ts", "test", "specimen", "organism", "drug", "grade", "comments", "ord", tx.COMMENT_RULES
    )


@query("ordered_text", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def _(t: Tables) -> DataFrame:
    said = t.conversations.withColumn("text", F.concat_ws(": ", "role", "text"))
    return top.ordered_text(said, ["conv_id"], "text", ["turn"], "\n")


_LAB_GROUPS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(
    "lab_group_text",
    f"""WITH {LINED}, g AS (SELECT visit_id, lab_group, string_agg(text, chr(10) ORDER BY ts, item, line, text) AS text FROM lined
        GROUP BY 1, 2)
SELECT visit_id, lab_group, coalesce(text, '') AS text
FROM (SELECT visit_id, unnest({_LAB_GROUPS!r}) AS lab_group FROM visits) LEFT JOIN g USING (visit_id, lab_group)""",
)
def _(t: Tables) -> DataFrame:
    return top.group_text(visits(t), lined(t), ["visit_id"], "lab_group", _LAB_GROUPS, "text", ["ts", "item", "line"])


@query(
    "normalize_note",
    r"""SELECT page_id, regexp_replace(trim(replace(regexp_replace(html, '\r\n|\n|\r|,|\t', ' ', 'g'), '"', '""')), '[^\x20-\x7E]', '', 'g') AS note FROM pages""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.normalize_note("html").alias("note"))


@query(
    "sanitize_input",
    r"""SELECT conv_id, turn, trim(substr(regexp_replace(text, '[\x{00}-\x{1f}\x{7f}-\x{9f}]', '', 'g'), 1, 1000)) AS text FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", tx.sanitize("text").alias("text"))


@query(
    "clamp_severity",
    "SELECT event_id, CASE WHEN value::BIGINT % 14 BETWEEN 1 AND 10 AND event_type <> 'error' THEN value::BIGINT % 14 ELSE 5 END::BIGINT AS severity FROM (SELECT event_id, event_type, floor(value) AS value FROM events)",
)
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("event_type") == "error", F.lit("severe")).otherwise((F.floor("value") % 14).cast("string"))
    return t.events.select("event_id", big(clamp_int(text, 1, 10, 5)).alias("severity"))


_PROMPT = (
    tx.PROMPT_TEMPLATE.replace("'", "''").replace("{context}", "' || context || '").replace("{original_prompt}", "' || prompt || '")
)


@query(
    "augment_prompt",
    f"""WITH p AS (SELECT c.conv_id, c.turn, c.text AS prompt, coalesce(d.text, '') AS context FROM conversations c LEFT JOIN benchmark d ON d.item_id = c.conv_id)
SELECT conv_id, turn, CASE WHEN context = '' THEN prompt ELSE '{_PROMPT}' END AS prompt FROM p""",
)
def _(t: Tables) -> DataFrame:
    known = t.benchmark.select(F.col("item_id").alias("conv_id"), F.col("text").alias("context"))
    asked = t.conversations.join(known, "conv_id", "left")
    return asked.select("conv_id", "turn", tx.augment_prompt("text", "context").alias("prompt"))


_WORDS = r"CASE WHEN regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\s+')) END"


@query("word_count", f"SELECT doc_id, ({_WORDS})::BIGINT AS words FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", big(tx.word_count("text")).alias("words"))


@query(
    "text_length_stats",
    f"""WITH w AS (SELECT ({_WORDS})::DOUBLE AS w, length(text) / 4.0::DOUBLE AS t FROM documents)
SELECT count(*)::BIGINT AS texts, round(avg(w), 6) AS mean_words, max(w) AS max_words, round(avg(t), 6) AS mean_tokens,
       round(avg(CASE WHEN t > 512 THEN 1.0 ELSE 0.0 END), 6) AS share_over_limit, round(quantile_cont(w, 0.5), 6) AS median_words,
       round(quantile_cont(w, 0.95), 6) AS p95_words FROM w""",
)
def _(t: Tables) -> DataFrame:
    stats = top.text_length_stats(t.documents, "text", 512)
    exact = ["texts", "max_words"]
    return stats.select(*exact, *[rnd(c).alias(c) for c in stats.columns if c not in exact])


@query(
    "marker_rate",
    """SELECT count(*)::BIGINT AS texts, count(*) FILTER (contains(text, 'tion'))::BIGINT AS with_marker,
       round(avg(CASE WHEN contains(text, 'tion') THEN 1.0 ELSE 0.0 END), 6) AS share FROM documents""",
)
def _(t: Tables) -> DataFrame:
    return top.marker_rate(t.documents, "text", "tion").select("texts", "with_marker", rnd("share").alias("share"))


_SENT = r"list_filter(list_transform(regexp_split_to_array(text, '\.\s{2,}|\.\n'), lambda s: regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')), lambda s: length(s) > 0)"


@query(
    "sentence_openers",
    rf"""WITH s AS (SELECT ({_SENT})[2] AS sent FROM documents)
SELECT array_to_string(regexp_split_to_array(sent, '\s+')[1:6], ' ') AS opener, count(*)::BIGINT AS n FROM s WHERE sent IS NOT NULL GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return top.sentence_openers(t.documents, "text", 2)


_PHRASES = ["tion", "Le ", "the ", "sch", "qzx", "(c)"]


@query(
    "trigger_report",
    f"""WITH s AS (SELECT doc_id, text, {_SENT} AS sents FROM documents), p AS (SELECT unnest({_PHRASES!r}) AS phrase),
h AS (SELECT doc_id, phrase, list_position(list_transform(sents, lambda x: contains(lower(x), lower(phrase))), true) - 1 AS pos FROM s JOIN p ON contains(text, phrase)),
c AS (SELECT phrase, pos, count(*) AS n, row_number() OVER (PARTITION BY phrase ORDER BY count(*) DESC, pos) AS r FROM h WHERE pos >= 0 GROUP BY 1, 2)
SELECT h.phrase, count(*)::BIGINT AS texts, any_value(c.pos)::BIGINT AS usual_position, min(doc_id) AS example,
  array_to_string(list(doc_id ORDER BY md5(concat_ws('|', doc_id, '5')), doc_id)[1:3], ',') AS examples
FROM h LEFT JOIN c ON c.phrase = h.phrase AND c.r = 1 GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    report = top.trigger_report(t.documents, "text", _PHRASES, "doc_id", examples=3, seed=5)
    return report.withColumns({"usual_position": big("usual_position"), "examples": F.array_join("examples", ",")})


@query(
    "before_after",
    f"""WITH b AS (SELECT text AS a, {clean_sql('text')} AS b FROM documents)
SELECT count(*)::BIGINT AS rows, count(*) FILTER (a IS DISTINCT FROM b)::BIGINT AS changed, count(*) FILTER (a IS NOT NULL AND b IS NULL)::BIGINT AS emptied,
       round(avg(length(a)), 6) AS mean_before, round(avg(length(b)), 6) AS mean_after FROM b""",
)
def _(t: Tables) -> DataFrame:
    both = t.documents.select("text", tx.clean_comment("text", RULES).alias("cleaned"))
    report = top.before_after(both, "text", "cleaned")
    return report.select("rows", "changed", "emptied", rnd("mean_before").alias("mean_before"), rnd("mean_after").alias("mean_after"))


@query(
    "cleaned_lengths",
    f"""WITH b AS (SELECT length({clean_sql('text')})::DOUBLE AS n FROM documents), q AS (SELECT n FROM b WHERE n IS NOT NULL)
SELECT count(*)::BIGINT AS texts, min(n) AS least, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.75), 6) AS p75,
       round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS greatest FROM q""",
)
def _(t: Tables) -> DataFrame:
    report = top.length_distribution(t.documents.select(tx.clean_comment("text", RULES).alias("cleaned")), "cleaned")
    return report.withColumns({c: rnd(c) for c in ("mean", "p75", "p90", "p95")})


@query(
    "discard_report",
    f"""WITH h AS (SELECT doc_id, text, phrase FROM documents JOIN (SELECT unnest({_PHRASES!r}) AS phrase) p ON contains(text, phrase))
SELECT phrase, count(*)::BIGINT AS texts, replace(left(arg_min(text, doc_id), 80), chr(10), ' ') AS example FROM h GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return top.phrase_report(t.documents, "text", _PHRASES, "doc_id")
