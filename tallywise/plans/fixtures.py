"""Input tables of the registered queries, derived from the driver tables by SQL that both engines run.

Only the inputs are shared. What a query computes over them is written once as a Spark plan (``catalog``) and once, on
its own, as SQL (``oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUNS = 10


class Dialect:
    """The few spots where the SQL of the two engines differs."""

    def __init__(self, sf_dir: str | None = None):
        self.sf_dir = sf_dir

    @property
    def spark(self) -> bool:
        return self.sf_dir is not None

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`" if self.spark else name

    def h(self, key: str) -> str:
        """28-bit hash of a string expression."""
        if self.spark:
            return f"cast(conv(substr(md5({key}), 1, 7), 16, 10) as bigint)"
        return f"('0x' || substr(md5({key}), 1, 7))::bigint"

    def each(self, n: int, alias: str) -> str:
        """FROM-clause suffix: one row per integer 0..n-1."""
        if self.spark:
            return f"LATERAL VIEW explode(sequence(0, {n - 1})) {alias}_view AS {alias}"
        return f", (SELECT unnest(range({n}))::int AS {alias}) {alias}_view"

    @property
    def newline(self) -> str:
        return "char(10)" if self.spark else "chr(10)"

    @property
    def backslash(self) -> str:
        return "char(92)" if self.spark else "chr(92)"


def clamp(expr: str) -> str:
    return f"cast(least(6, greatest(0, {expr})) as int)"


def letters(d: Dialect) -> str:
    label = f"CASE WHEN l.doc_id IS NOT NULL THEN cast({d.h(chr(39) + 'lab-' + chr(39) + ' || cast(t.doc_id as string)')} % 7 as int) END"
    return f"""
    SELECT t.doc_id AS row_id, t.text AS input_text, concat('P', cast(t.doc_id % 97 as string)) AS patient_id,
           t.lang, t.source, {label} AS label
    FROM {d.table("documents")} t LEFT JOIN {d.table("labels")} l ON t.doc_id = l.doc_id"""


def raw_letters(d: Dialect) -> str:
    return f"""
    SELECT row_id, patient_id AS PatID, input_text AS lettre,
           coalesce(cast(label as string), CASE WHEN row_id % 2 = 0 THEN 'No FU' ELSE 'No FU yet' END) AS mrs_label
    FROM ({letters(d)}) x"""


def votes(d: Dialect) -> str:
    key = "cast(row_id as string) || '-' || cast(run_idx as string)"
    spread = f"{d.h(chr(39) + 'v-' + chr(39) + ' || ' + key)} % 5"
    missing = f"{d.h(chr(39) + 'm-' + chr(39) + ' || ' + key)} % 50 = 0"
    return f"""
    SELECT row_id, run_idx, label,
           CASE WHEN {missing} THEN -1 ELSE {clamp(f"coalesce(label, 3) + {spread} - 2")} END AS pred
    FROM ({letters(d)}) x {d.each(RUNS, "run_idx")}"""


# How a generation shows its prediction, by shape number; None marks the shapes without one.
SHAPES = (
    '{"mRS": #}',
    '  \\n{"mRS": #}  \\n',
    'Result:\\n```json\\n{"mRS": #}\\n```\\n',
    '```\\n{"mRS": #}\\n``` done',
    'The score is {"mRS": #} as stated.',
    "{'mRS': #}",
    "{mRS: #}",
    '{"mRS": #,}',
    '{"mRS": #',
    '{"mRS": "#"}',
    '{"mRS": #.0}',
    '{"mRS": 2.5}',
    '{"mRS": 9}',
    '{"mRS": null}',
    '<think>weighing {note} first</think>\\n{"mRS": #}',
    "no score given",
)


def _rendered(d: Dialect, shape_text: str) -> str:
    """SQL for a shape's text with the prediction in it."""
    pieces = []
    for i, line in enumerate(shape_text.split("\\n")):
        if i:
            pieces.append(d.newline)
        for k, part in enumerate(line.split("#")):
            if k:
                pieces.append("cast(pred as string)")
            for b, plain in enumerate(part.split("\\")):
                if b:
                    pieces.append(d.backslash)
                if plain:
                    pieces.append("'" + plain.replace("'", "''" if not d.spark else "\\'") + "'")
    return "concat(" + ", ".join(pieces) + ")"


def generations(d: Dialect) -> str:
    key = "cast(row_id as string) || '-' || cast(run_idx as string)"
    shape = f"{d.h(chr(39) + 's-' + chr(39) + ' || ' + key)} % 16"
    cases = " ".join(f"WHEN {i} THEN {_rendered(d, s)}" for i, s in enumerate(SHAPES))
    return f"""
    SELECT row_id, run_idx, label, pred, shape, CASE shape {cases} END AS output_text
    FROM (SELECT *, cast({shape} as int) AS shape FROM ({votes(d)}) v) s"""


# Hostile answers: text, expected value (None: the prediction) and deciding stage, for predictions 0 to 6.
HOSTILE_SHAPES = (
    ("{mRS: 0x" + "0" * 48 + "#}", None, "lenient"),
    ("{mRS: 0xFFFFFFFFFFFFFFFFFFFFFFF#}", -1, "default"),
    ('{"mRS": 1#.0e400}', -1, "default"),
    ('{"mRS":\u00a0#}', None, "field_regex"),
    ('{"other": {"mRS": true}, "mRS": "true"}', -1, "default"),
    ('{"mRS": {"a": #, "a": 2}}', -1, "default"),
    ('{"x": {"a": 1, "a": 2}, "mRS": #}', None, "direct"),
    ("{'note': 'see: +3, } at: 0x1F', 'mRS': #,}", None, "lenient"),
    ('{mRS: +#, note: "a, ]"}', None, "lenient"),
    ('{"mRS": 9, "mRS": #}', None, "direct"),
    ('{"mRS": "#e0"}', -1, "default"),
    ('{"mRS": 99999999999999999999#}', -1, "field_regex"),
    ("{mRS: .#e1}", None, "lenient"),
)


def hostile(d: Dialect) -> str:
    """Answers that break careless parsing, one shape per vote."""
    key = "cast(row_id as string) || '-' || cast(run_idx as string)"
    shape = f"{d.h(chr(39) + 'h-' + chr(39) + ' || ' + key)} % {len(HOSTILE_SHAPES)}"
    cases = " ".join(f"WHEN {i} THEN {_rendered(d, s[0])}" for i, s in enumerate(HOSTILE_SHAPES))
    return f"""
    SELECT row_id, run_idx, pred, shape, CASE shape {cases} END AS output_text
    FROM (SELECT *, cast({shape} as int) AS shape FROM ({votes(d)}) v WHERE pred >= 0) s"""


# The forms of JSON5: text (``\n`` is a line break), then score (None: the prediction), ratio and note, as SQL.
JSON5_SHAPES = (
    ("{mRS: #, ratio: Infinity}", None, "'inf'", "''"),
    ("{mRS: #, ratio: -Infinity, note: 'Infinity'}", None, "'-inf'", "'Infinity'"),
    ("{mRS: Infinity, ratio: 1}", "-1", "0", "''"),
    ("{mRS: #, note: '\\x41\\u0042\\'s \\a'}", None, "0", "'AB''s a'"),
    ("{mRS: #, note: 'two\\\\nlines'}", None, "0", "'twolines'"),
    ("{mRS: #, note: \"a\\vb\\\\x41\"}", None, "0", "'a' || chr(11) || 'b' || chr(92) || 'x41'"),
    ("{mRS: #, n\u00f6te: 1, \u00f1and\u00fa: 2, $_: 3, \\u006eote: 'k'}", None, "0", "'k'"),
    ("{// first\\n mRS: /* one, } two */ #, note: 'a // b',}", None, "0", "'a // b'"),
    ("{mRS: +#, ratio: .5}", None, "0.5", "''"),
    ("{'mRS': #., ratio: -.25e1}", None, "-2.5", "''"),
    ("{mRS: 0x#, ratio: -0xA}", None, "-10", "''"),
    ("{$a: [1, 2,], _b: {c: 'd',},\\n mRS: #,}", None, "0", "''"),
    ("{mRS: #, note: 'say \"hi\", ok'}", None, "0", "'say \"hi\", ok'"),
    ("{mRS: #, Infinity: 1, NaN: 2, true: 3, note: '\u00e9\\\u00e9'}", None, "0", "'\u00e9\u00e9'"),
    ("{mRS: #, note: 'open}", None, None, None),
    ("{mRS: # 1, note: 'x'}", None, None, None),
)


def json5(d: Dialect) -> str:
    """Answers in every form of JSON5, and two that are none, one shape per vote."""
    key = "cast(row_id as string) || '-' || cast(run_idx as string)"
    shape = f"{d.h(chr(39) + 'j-' + chr(39) + ' || ' + key)} % {len(JSON5_SHAPES)}"
    cases = " ".join(f"WHEN {i} THEN {_rendered(d, s[0])}" for i, s in enumerate(JSON5_SHAPES))
    return f"""
    SELECT row_id, run_idx, pred, shape, CASE shape {cases} END AS output_text
    FROM (SELECT *, cast({shape} as int) AS shape FROM ({votes(d)}) v WHERE pred >= 0) s"""


def null_votes(d: Dialect) -> str:
    """Votes of which some are missing."""
    key = "cast(row_id as string) || '-' || cast(run_idx as string)"
    gone = f"{d.h(chr(39) + 'n-' + chr(39) + ' || ' + key)} % 4 = 0"
    return f"SELECT row_id, run_idx, label, CASE WHEN {gone} THEN NULL ELSE pred END AS pred FROM ({votes(d)}) v"


def _item() -> str:
    parts = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return " || '-' || ".join(f"cast({p} as string)" for p in parts)


def _score(d: Dialect, tag: str, spread: int, base: str = "expert") -> str:
    noise = f"{d.h(f'{chr(39)}{tag}-{chr(39)} || item_id')} % {spread} - {spread // 2}"
    return f"CASE WHEN {d.h(f'{chr(39)}{tag}n-{chr(39)} || item_id')} % 200 <> 0 THEN {clamp(f'{base} + {noise}')} END"


def ratings(d: Dialect) -> str:
    """Wide table: one row per rated item, the expert column and one column per rater."""
    return f"""
    SELECT item_id, expert, {_score(d, "st", 7)} AS students, {_score(d, "re", 5)} AS residents,
           {_score(d, "mo", 3)} AS model
    FROM (SELECT {_item()} AS item_id, cast(l_linenumber - 1 as int) AS expert FROM {d.table("lineitem")}) x"""


def ratings_gap(d: Dialect) -> str:
    """The ratings with label 3 merged into 2: a scale with an unused label."""
    merged = ", ".join(f"CASE WHEN {c} = 3 THEN 2 ELSE {c} END AS {c}" for c in ("expert", "students", "residents", "model"))
    return f"SELECT item_id, {merged} FROM ({ratings(d)}) r"


def rater_pairs(d: Dialect) -> str:
    """Wide table of the two single raters behind each consensus."""
    return f"""
    SELECT item_id, {_score(d, "s1", 5)} AS students1, {_score(d, "s2", 5)} AS students2,
           {_score(d, "r1", 3)} AS residents1, {_score(d, "r2", 3)} AS residents2,
           {_score(d, "e1", 3)} AS experts1, expert AS experts2
    FROM (SELECT {_item()} AS item_id, cast(l_linenumber - 1 as int) AS expert FROM {d.table("lineitem")}) x"""


def scored_runs(d: Dialect) -> str:
    """One row per scored run of a model: the input of the mixed-effects regression."""
    size = d.h("'n-' || p_brand")
    return f"""
    SELECT p_partkey AS run_id, p_brand AS model, cast(p_size % 7 + 2 as double) AS nbits,
           0.6e0 + ({size} % 700) / 10.0e0 AS nparams,
           ({d.h("'t-' || cast(p_partkey as string)")} % 1000) / 1000.0e0
             + ({d.h("'g-' || p_brand")} % 100) / 50.0e0 AS target
    FROM {d.table("part")}"""


def model_ids(d: Dialect) -> str:
    """Model identifiers in the spellings found in the wild, one per part."""
    pick = d.h("'id-' || cast(p_partkey as string)")
    scheme = d.h("'sc-' || cast(p_partkey as string)")
    size = "cast(p_size as string)"
    return f"""
    SELECT p_partkey AS run_id,
      CASE cast({pick} % 11 as int)
        WHEN 0 THEN concat('lab/Alpha-', {size}, 'B-GGUF') WHEN 1 THEN concat('lab/Alpha-0.', {size}, 'B-AWQ')
        WHEN 2 THEN concat('lab/Beta_', {size}, 'B_gptq') WHEN 3 THEN concat('lab/Beta-', {size}, 'B-A3B-FP8')
        WHEN 4 THEN concat('lab/Gamma-', {size}, '50M-Instruct') WHEN 5 THEN concat('lab/Gamma-', {size}, ' b-NVFP4')
        WHEN 6 THEN concat('lab/delta-bnb-', {size}, 'bit') WHEN 7 THEN 'lab/delta-awq/large-GGUF'
        WHEN 8 THEN concat('lab/Echo-', {size}, '.5B') WHEN 9 THEN concat('lab/hqq-echo-', {size}, 'm')
        ELSE 'lab/Foxtrot-chat' END AS model_id,
      CASE cast({scheme} % 8 as int)
        WHEN 0 THEN 'Q2_K_XL' WHEN 1 THEN 'Q4_K_XL' WHEN 2 THEN 'IQ3_XS' WHEN 3 THEN 'Q8_0'
        WHEN 4 THEN 'F16' WHEN 5 THEN 'fp16' WHEN 6 THEN 'BF16' ELSE 'q8_0' END AS scheme,
      CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 1000003 END AS known_params
    FROM {d.table("part")}"""


# The models whose runs are pooled: path, scheme, size, spread of the answers.
MODELS = (
    ("lab/Alpha-4B-GGUF", "Q2_K_XL", 7),
    ("lab/Alpha-4B-GGUF", "Q4_K_XL", 5),
    ("lab/Alpha-32B-GGUF", "Q4_K_XL", 3),
    ("lab/Beta-8B-FP8", "no_quant_scheme", 5),
)


def model_votes(d: Dialect) -> str:
    """Votes of several models on the same letters."""
    key = "cast(m as string) || '-' || cast(row_id as string) || '-' || cast(run_idx as string)"
    noise = d.h(f"'mv-' || {key}")
    spread = " ".join(f"WHEN {i} THEN {noise} % {s} - {s // 2}" for i, (_, _, s) in enumerate(MODELS))
    name = " ".join(f"WHEN {i} THEN '{m}'" for i, (m, _, _) in enumerate(MODELS))
    scheme = " ".join(f"WHEN {i} THEN '{q}'" for i, (_, q, _) in enumerate(MODELS))
    return f"""
    SELECT CASE m {name} END AS model, CASE m {scheme} END AS quant_scheme, row_id, run_idx, label,
           {clamp(f"coalesce(label, 3) + CASE m {spread} END")} AS pred
    FROM ({letters(d)}) x {d.each(len(MODELS), "m")} {d.each(RUNS, "run_idx")}"""


def csv_records(d: Dialect) -> str:
    """Conversation turns as CSV records with damage, grouped into files by conversation.

    File number modulo 4: 0 is clean, 1 ends in a record cut off inside its quotes, 2 has a record with too many fields,
    3 has both.
    """
    row = "concat(cast(conv_id as string), ',', cast(turn as string), ',', role, ',\"', text, '\"')"
    surplus = "file_no % 4 IN (2, 3) AND conv_id % 40 = 21 AND turn = 1"
    number = "conv_id div 40" if d.spark else "conv_id // 40"
    torn = f"concat('9,0,user,\"torn', {d.newline}, 'off', {d.newline}, 'here')"
    return f"""
    SELECT file_no, conv_id, turn, CASE WHEN {surplus} THEN concat({row}, ',surplus') ELSE {row} END AS record
    FROM (SELECT *, {number} AS file_no FROM {d.table("conversations")}) c
    UNION ALL
    SELECT DISTINCT {number}, cast(1000000000 as bigint), cast(0 as bigint), {torn}
    FROM {d.table("conversations")} WHERE {number} % 4 IN (1, 3)"""


def chunk_log(d: Dialect) -> str:
    """Cost of each processed chunk of a run: size, seconds per sample, memory."""
    return f"""
    SELECT event_type AS run, event_id % 1000 AS chunk, count(*) AS n_samples, avg(value) AS time_per_sample,
           cast(max(user_id) as double) AS memory_gb
    FROM {d.table("events")} GROUP BY event_type, event_id % 1000"""


def truncated(d: Dialect) -> str:
    """Nested JSON answers cut off at a hashed position."""
    key = "cast(row_id as string) || '-' || cast(run_idx as string)"
    full = (
        """concat('{"events": [{"run": ', cast(run_idx as string), ', "tags": ["a", "b]"]}, [1, 2]], "mRS": ', """
        """cast(pred as string), '}')"""
    )
    return f"""
    SELECT row_id, run_idx, substr(body, 1, cast({d.h("'cut-' || " + key)} % length(body) as int) + 1) AS output_text
    FROM (SELECT row_id, run_idx, {full} AS body FROM ({votes(d)}) v) x"""


def listings(d: Dialect) -> str:
    """Answers with text, number, flag and list fields. Three of four are not JSON any more."""
    shape = d.h("'li-' || cast(p_partkey as string)")
    name = "replace(p_name, ' ', '\", \"')"
    fields = (
        f"""concat('"name": "', p_brand, ' \\\\"', p_type, '\\\\"", "tags": ["', {name}, '"], "sizes": [', """
        """cast(p_size as string), ', ', cast(p_size + 1 as string), '.5], "price": ', cast(p_size as string), '.25, """
        """"stock": ', cast(p_size % 2 = 0 as string))"""
    )
    if not d.spark:
        fields = fields.replace("\\\\", "\\")
    return f"""
    SELECT p_partkey AS row_id, cast({shape} % 4 as int) AS shape,
      CASE cast({shape} % 4 as int)
        WHEN 0 THEN concat('{{', fields, '}}') WHEN 1 THEN concat('found {{', fields, ' approx.}} and that is all')
        WHEN 2 THEN concat('{{', fields, ', "name": null, oops') ELSE 'nothing listed' END AS output_text
    FROM (SELECT *, {fields} AS fields FROM {d.table("part")}) x"""


def event_records(d: Dialect) -> str:
    """Dated events, some with an impossible month or an unknown type."""
    return f"""
    SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE
             concat('2024-', CASE WHEN event_id % 20 < 13 THEN lpad(cast(event_id % 20 as string), 2, '0')
                                  ELSE cast(event_id % 20 as string) END,
                    '-', lpad(cast(event_id % 34 as string), 2, '0')) END AS event_date,
           CASE event_type WHEN 'click' THEN 'Admission' WHEN 'view' THEN 'Discharge' WHEN 'error' THEN 'Transfer'
                ELSE 'Procedure' END AS event_type,
           cast(user_id % 9 - 1 as bigint) AS score
    FROM {d.table("events")}"""


TABLES = {
    f.__name__: f
    for f in (
        letters, raw_letters, votes, null_votes, generations, hostile, json5, ratings, ratings_gap, rater_pairs, scored_runs, model_ids, model_votes,
        csv_records, chunk_log, truncated, listings, event_records,
    )
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table as a Spark DataFrame."""
    return spark.sql(TABLES[name](Dialect(sf_dir)))


def ctes(*names: str) -> str:
    """The same tables as the head of a DuckDB statement."""
    d = Dialect()
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n](d)})" for n in names)
