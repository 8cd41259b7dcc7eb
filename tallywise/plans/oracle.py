"""The registered queries as DuckDB SQL over the driver tables, written apart from the Spark plans.

Only the input tables are shared (``fixtures``). Where a query has a closed form in Spark, its twin uses another
definition where there is one: kappa from the weight matrix, ranks from sorted rows, modes by counting.
"""

from __future__ import annotations

from tallywise.plans import catalog
from tallywise.plans.fixtures import HOSTILE_SHAPES, JSON5_SHAPES, MODELS, RUNS, ctes

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def stack(table: str, columns: list[str], name: str, rest: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS {name}, {rest.format(c=c)} FROM {table}" for c in columns)


# Extraction: the stages for one integer field, on text column ``t``


def _json_int(j: str, name: str, low: int, high: int, default: str) -> str:
    """Value of an integer field of JSON text, null where the stage fails."""
    kind, raw = f"json_type({j}, '$.{name}')", f"json_extract_string({j}, '$.{name}')"
    number = f"try_cast(trim({raw}, {SPACE}) AS DOUBLE)"
    value = f"""CASE
        WHEN {kind} = 'BOOLEAN' THEN CASE WHEN {raw} = 'true' THEN 1 ELSE 0 END
        WHEN {kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') AND {number} = floor({number}) THEN {number} END"""
    return f"""CASE WHEN json_valid({j}) AND NOT regexp_matches({j}, ',\\s*[}}\\]]') AND json_type({j}) = 'OBJECT' THEN
        CASE WHEN {kind} IS NULL THEN {default} WHEN ({value}) BETWEEN {low} AND {high} THEN ({value})::BIGINT END END"""


def _extraction(source: str, text: str, name: str, low: int, high: int, default: str, tail: str) -> str:
    """CTEs ending in ``extracted``: the columns of ``source`` with ``value, status, valid``."""
    lenient = (
        "regexp_replace(regexp_replace(replace(block, chr(39), '\"'), '([{,]\\s*)([A-Za-z_]\\w*)\\s*:', '\\1\"\\2\":', 'g'),"
        " ',\\s*([}\\]])', '\\1', 'g')"
    )
    default_json = _json_int("{j}", name, low, high, default)
    direct, isolated = default_json.replace("{j}", "t"), default_json.replace("{j}", "block")
    relaxed, repaired = default_json.replace("{j}", "soft"), default_json.replace("{j}", "fixed")
    return f""",
    e0 AS (SELECT *, trim({text}, {SPACE}) AS t FROM {source}),
    e1 AS (SELECT *, {direct} AS v1,
      CASE WHEN regexp_matches({text}, '(?s)```(?:json)?\\s*(\\{{.*\\}}|\\[.*\\])\\s*```')
             THEN regexp_extract({text}, '(?s)```(?:json)?\\s*(\\{{.*\\}}|\\[.*\\])\\s*```', 1)
           WHEN instr({text}, '{{') > 0 AND (instr({text}, '[') = 0 OR instr({text}, '{{') < instr({text}, '['))
             THEN CASE WHEN instr({text}, '}}') = 0 THEN {text} ELSE regexp_extract({text}, '(?s)\\{{.*\\}}') END
           WHEN instr({text}, '[') > 0
             THEN CASE WHEN instr({text}, ']') = 0 THEN {text} ELSE regexp_extract({text}, '(?s)\\[.*\\]') END
           ELSE {text} END AS block FROM e0),
    e2 AS (SELECT *, {isolated} AS v2, {lenient} AS soft,
      trim(block, {SPACE}) || repeat('}}', greatest(0, length(block) - length(replace(block, '{{', ''))
        - length(block) + length(replace(block, '}}', '')))) AS fixed FROM e1),
    e3 AS (SELECT *, {relaxed} AS v3, {repaired} AS v4,
      CASE WHEN NOT regexp_matches(block, '"{name}"\\s*:\\s*null')
             AND regexp_matches(block, '"{name}"\\s*:\\s*-?\\d+(\\.\\d+)?')
             AND NOT regexp_matches(regexp_extract(block, '"{name}"\\s*:\\s*-?\\d+(\\.\\d+)?'), '\\.')
           THEN coalesce(try_cast(regexp_extract(block, '"{name}"\\s*:\\s*(-?\\d+)', 1) AS BIGINT), -1) END AS v5 FROM e2),
    extracted AS (SELECT *, coalesce(v1, v2, v3, v4, v5, {default}) AS value,
      CASE WHEN t IS NULL OR t = '' THEN 'empty' WHEN v1 IS NOT NULL THEN 'direct' WHEN v2 IS NOT NULL THEN 'isolated'
           WHEN v3 IS NOT NULL THEN 'lenient' WHEN v4 IS NOT NULL THEN 'repaired'
           WHEN v5 IS NOT NULL THEN 'field_regex' ELSE 'default' END AS status,
      coalesce(coalesce(v1, v2, v3, v4) IS NOT NULL OR v5 BETWEEN {low} AND {high}, false) AS valid FROM e3)
    {tail}"""


def _extract_mrs(tail: str) -> str:
    return ctes("generations") + _extraction("generations", "output_text", "mRS", 0, 6, "-1", tail)


# Conversations: the prompt of each is cut by running lengths


def _turns(no_thinking: str) -> str:
    return f"""WITH said AS (
      SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS ends FROM conversations),
    pieces AS (
      SELECT conv_id, turn, coalesce(sum(length(piece)) OVER (
          PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
        piece || CASE WHEN ends THEN '<|im_start|>assistant' || chr(10) || replace('{no_thinking}', '\\n', chr(10)) ELSE '' END AS piece
      FROM said)"""


# Pooling: votes are counted one by one in run order


def _majority(source: str, by: str, k: int, out: str) -> str:
    return f"""SELECT {by}, label, pred AS {out} FROM (
        SELECT {by}, max(label) AS label, pred, row_number() OVER (
          PARTITION BY {by} ORDER BY count(*) DESC, min(run_idx)) AS place
        FROM {source} WHERE run_idx < {k} GROUP BY {by}, pred) ranked WHERE place = 1"""


def _pooled_rows(source: str, by: str) -> str:
    """(mode, mode_label, by, label, pred) for every mode."""
    parts = [
        f"SELECT 'all' AS mode, 'all {RUNS} models' AS mode_label, {by}, label, pred FROM {source}",
        f"SELECT 'single', 'single model', {by}, label, pred FROM {source} WHERE run_idx = 0",
    ]
    for k in (3, 5, 10):
        parts.append(f"SELECT 'maj_{k}', 'maj-pooling-{k}', {by}, label, pred FROM ({_majority(source, by, k, 'pred')}) m{k}")
    return " UNION ALL ".join(parts)


def _scores(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, count(pred) AS n_distance,
        round(avg(CASE WHEN label IS DISTINCT FROM pred THEN 1 ELSE 0 END), 6) AS error_rate,
        round(avg(abs(label - pred)), 6) AS distance FROM ({source}) p WHERE label IS NOT NULL GROUP BY {keys}"""


def _mode_scores(source: str, keys: str = "") -> str:
    by = f"{keys}, row_id" if keys else "row_id"
    return _scores(_pooled_rows(source, by), (keys + ", " if keys else "") + "mode, mode_label")


# Ratings in rows and in cells

LONG = ", long AS (" + stack("ratings", catalog.RATERS, "rater", "expert AS y, {c} AS p") + ")"
COUNTED = LONG + ", cells AS (SELECT rater, y, p, count(*) AS n FROM long WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL)"


def _kappa(cells: str, by: str) -> str:
    """Quadratic kappa from observed and expected weight matrices."""
    return f"""
    SELECT {by}, round(1 - sum(CASE WHEN NOT grid THEN w * n END) / nullif(sum(CASE WHEN grid THEN w * n END), 0), 6) AS qwk
    FROM (
      SELECT {by}, false AS grid, power(a.pos - b.pos, 2) AS w, n::DOUBLE AS n
      FROM {cells} JOIN places a USING ({by}) JOIN places b USING ({by}) WHERE a.label = y AND b.label = p
      UNION ALL
      SELECT {by}, true, power(a.pos - b.pos, 2), rows_y.n::DOUBLE * rows_p.n / total.n
      FROM (SELECT {by}, y, sum(n) AS n FROM {cells} GROUP BY ALL) rows_y
      JOIN (SELECT {by}, p, sum(n) AS n FROM {cells} GROUP BY ALL) rows_p USING ({by})
      JOIN (SELECT {by}, sum(n) AS n FROM {cells} GROUP BY ALL) total USING ({by})
      JOIN places a USING ({by}) JOIN places b USING ({by}) WHERE a.label = y AND b.label = p) matrix
    GROUP BY {by}"""


def _places(cells: str, by: str) -> str:
    return f""", places AS (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY label) AS pos
      FROM (SELECT {by}, y AS label FROM {cells} UNION SELECT {by}, p FROM {cells}) u)"""


def _agreement(cells: str, by: str) -> str:
    return f"""SELECT {by}, sum(n)::BIGINT AS n, round(sum(n * abs(y - p)) / sum(n), 6) AS mae,
      round(sum(CASE WHEN y = p THEN n ELSE 0 END) / sum(n), 6) AS exact_acc,
      any_value(qwk) AS qwk FROM {cells} JOIN ({_kappa(cells, by)}) k USING ({by}) GROUP BY {by}"""


DIFFERENCES = ", diffs AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS comparison, abs({a} - expert) - abs({b} - expert) AS d FROM ratings"
    for name, (a, b) in catalog.COMPARISONS.items()
) + ")"

# average ranks of single rows
WILCOXON = """, ranked AS (
      SELECT comparison, d, rank() OVER (PARTITION BY comparison ORDER BY abs(d))
        + (count(*) OVER (PARTITION BY comparison, abs(d)) - 1) / 2.0::DOUBLE AS r,
        count(*) OVER (PARTITION BY comparison, abs(d)) AS t
      FROM diffs WHERE d <> 0),
    sums AS (SELECT comparison, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus,
        sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(t::DOUBLE * t - 1) AS ties FROM ranked GROUP BY comparison),
    tested AS (SELECT *, least(w_plus, w_minus) AS w, n * (n + 1) / 4.0::DOUBLE AS m,
        sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS sd FROM sums),
    zs AS (SELECT *, (w - m - 0.5 * sign(w - m)) / sd AS z, (w_plus - w_minus) / (w_plus + w_minus) AS rbc FROM tested),
    normal AS (SELECT comparison, 2 * sum(exp(-power(abs(z) + (i + 0.5) * 0.002, 2) / 2)) * 0.002 / sqrt(2 * pi()) AS p_value
      FROM zs, range(6000) g(i) GROUP BY comparison, z)"""

PAIRED_T = """, moments AS (SELECT comparison, count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd_diff
      FROM diffs WHERE d IS NOT NULL GROUP BY comparison),
    ts AS (SELECT *, mean_diff / (sd_diff / sqrt(n)) AS t FROM moments),
    tail AS (SELECT comparison, 2 * sum(exp(lgamma(n / 2.0::DOUBLE) - lgamma((n - 1) / 2.0::DOUBLE)
        - 0.5 * ln((n - 1) * pi()) - n / 2.0::DOUBLE * ln(1 + power(abs(t) + (i + 0.5) * 0.005, 2) / (n - 1)))) * 0.005 AS p_value
      FROM ts, range(8000) g(i) GROUP BY comparison, n, t),
    marginal AS (SELECT comparison, u,
        -0.5 * ln(1 + n * exp(u) * 0.707 * 0.707)
        - n / 2.0::DOUBLE * ln(1 + t * t / ((1 + n * exp(u) * 0.707 * 0.707) * (n - 1))) + n / 2.0::DOUBLE * ln(1 + t * t / (n - 1))
        - 0.5 * ln(2 * pi()) - 0.5 * u - 0.5 * exp(-u) AS f
      FROM ts, (SELECT -9 + (i + 0.5) * 0.002::DOUBLE AS u FROM range(30000) r(i)) g),
    bayes AS (SELECT comparison, top + ln(sum(exp(f - top)) * 0.002) AS log_bf10
      FROM marginal JOIN (SELECT comparison, max(f) AS top FROM marginal GROUP BY comparison) x USING (comparison)
      GROUP BY comparison, top)"""


def _lme() -> str:
    terms = ["1.0::DOUBLE", "log10(nparams)", "nbits", "log10(nparams) * nbits", "target"]
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    rows = ", ".join(f"{t} AS v{i}" for i, t in enumerate(terms))
    sums = ", ".join(f"sum(v{i}) AS t{i}" for i in range(5))
    cross = ", ".join(f"sum(v{i} * v{j}) AS c_{i}_{j}" for i, j in pairs)
    last = ", ".join(f"round(sum(c_{i}_{j}), 6) AS c_{i}_{j}, round(sum(t{i} * t{j}), 6) AS s_{i}_{j}" for i, j in pairs)
    return f"""{ctes("scored_runs")}
    SELECT n, count(*) AS groups, {last} FROM (
      SELECT model, count(*) AS n, {sums}, {cross} FROM (SELECT model, {rows} FROM scored_runs) r GROUP BY model) g
    GROUP BY n"""


def _model_values() -> str:
    """Size, bits and GiB of the pooled models, from their identifiers."""
    params = """(CASE WHEN regexp_matches(model, '(?i)\\d+(\\.\\d+)?[ ]?B')
      THEN regexp_extract(model, '(?i)(\\d+(?:\\.\\d+)?)[ ]?B', 1)::DOUBLE END)"""
    bits = """(CASE WHEN lower(model) LIKE '%fp8%' THEN 8
      ELSE coalesce(try_cast(regexp_extract(quant_scheme, '^I?Q(\\d+)', 1) AS INTEGER), 0) END)::DOUBLE"""
    return f"""SELECT DISTINCT model, quant_scheme, {params} AS nparams, {bits} AS nbits,
      {params} * 1e9 * {bits} / (8 * 1024.0::DOUBLE * 1024 * 1024) AS vram FROM model_votes"""


def statements() -> dict[str, str]:
    out = {}
    label_mask = "label IS NOT NULL"

    out["scan_letters"] = f"""{ctes("letters")}
    SELECT row_id, md5(input_text) AS digest, patient_id, lang, source, label FROM letters"""
    out["encrypt_roundtrip"] = f"""{ctes("letters")}
    SELECT row_id, md5(input_text) AS digest, label, true AS locked FROM letters"""
    out["sealed_letters"] = f"""{ctes("letters")}, n AS (SELECT count(*) AS n FROM letters),
    moved AS (SELECT count(p.input_text) AS k FROM letters l JOIN letters p ON p.row_id = xor(l.row_id, 1::BIGINT))
    SELECT 'untouched' AS variant, n AS rows, true AS whole, 0 AS damaged FROM n
    UNION ALL SELECT 'moved cells', n, k = 0, k FROM n, moved
    UNION ALL SELECT 'lost row', n - 1, false, 0 FROM n
    UNION ALL SELECT 'row twice', n + 1, false, 0 FROM n"""
    out["shuffled_letters"] = f"""{ctes("letters")}
    SELECT row_id, row_number() OVER (ORDER BY md5('0-' || row_id::VARCHAR), row_id) - 1 AS place FROM letters"""
    out["write_read_results"] = f"""{ctes("model_votes")}
    SELECT 'stub' AS backend, 'guided' AS guided, model,
      CASE WHEN lower(model) LIKE '%gguf%' THEN quant_scheme ELSE 'no_quant_scheme' END AS quant_scheme,
      count(label) AS n, count(label + pred) AS n_distance, round(avg(CASE WHEN label <> pred THEN 1 WHEN label = pred THEN 0 END), 6) AS error_rate,
      round(avg(abs(label - pred)), 6) AS distance FROM model_votes GROUP BY 1, 2, 3, 4"""
    mode_scores = _mode_scores("model_votes", "model, quant_scheme")
    out["metrics_json_roundtrip"] = f"""{ctes("model_votes")}, scored AS ({mode_scores}), sizes AS ({_model_values()})
    SELECT model, quant_scheme, 'Error Rate' || chr(10) || '(' || mode_label || ')' AS metric, error_rate AS value,
      '%' AS unit FROM scored
    UNION ALL SELECT model, quant_scheme, 'Distance' || chr(10) || '(' || mode_label || ')', distance, 'mRS' FROM scored
    UNION ALL SELECT model, quant_scheme, 'Number of params', round(nparams, 6), 'Billions' FROM sizes
    UNION ALL SELECT model, quant_scheme, 'Bits/param', nbits, 'Bits' FROM sizes
    UNION ALL SELECT model, quant_scheme, 'VRAM param usage', round(vram, 6), 'GB' FROM sizes"""
    twice = "CASE WHEN lower(model) LIKE '%fp8%' THEN 2 ELSE 1 END"
    picks = ", ".join(
        f"max(CASE WHEN mode = '{m}' THEN {c} END) AS {short}_{m}"
        for m in ("single", "maj_5", "maj_10", "all")
        for short, c in (("error", "error_rate"), ("distance", "distance"))
    )
    out["pool_run_files"] = f"""{ctes("model_votes")}, scored AS ({mode_scores}), sizes AS ({_model_values()})
    SELECT split_part(substr(model, 5), '-', 1) AS model, round(vram * {twice}, 6) AS vram, round(nparams, 6) AS nparams,
      nbits * {twice} AS nbits, {picks}, 200 * (nbits * {twice}) / 16 AS marker_size
    FROM scored JOIN sizes USING (model, quant_scheme) GROUP BY model, vram, nparams, nbits
    UNION ALL SELECT DISTINCT split_part(substr(model, 5), '-', 1), 1.5 * {twice}, 9.5, 4.0 * {twice}, 0.5, 0.75,
      NULL, NULL, NULL, NULL, NULL, NULL, 200 * 4.0 * {twice} / 16 FROM sizes"""
    out["pool_run_intervals"] = f"""{ctes("model_votes")}, scored AS ({mode_scores}), sizes AS ({_model_values()})
    SELECT split_part(substr(model, 5), '-', 1) AS model, round(vram * {twice}, 6) AS vram, mode AS "case", error_rate AS error,
      true AS low_near, true AS high_near
    FROM scored JOIN sizes USING (model, quant_scheme) WHERE mode IN ('single', 'maj_5', 'maj_10', 'all')"""
    states = f"""{ctes("csv_records")}, text_lines AS (
      SELECT file_no, conv_id, turn, record, unnest(string_split(record, chr(10))) AS line,
        unnest(range(len(string_split(record, chr(10))))) AS i FROM csv_records
      UNION ALL SELECT DISTINCT file_no, -1, 0, 'conv_id,turn,role,text', 'conv_id,turn,role,text', 0 FROM csv_records),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY conv_id, turn, i) AS no,
      length(line) - length(replace(line, '"', '')) AS quotes FROM text_lines),
    states AS (SELECT *, sum(quotes) OVER (PARTITION BY file_no ORDER BY no) % 2 = 1 AS open_after,
      (sum(quotes) OVER (PARTITION BY file_no ORDER BY no) - quotes) % 2 = 1 AS open_before FROM numbered),
    cuts AS (SELECT file_no, max(no) AS cut FROM states s WHERE NOT open_after AND no < coalesce(
        (SELECT min(no) FROM states b WHERE b.file_no = s.file_no AND b.record LIKE '%,surplus' AND b.i = 0
           AND NOT b.open_before), 1e9) GROUP BY file_no)"""
    out["salvage_csv"] = f"""{states}
    SELECT file_no, count(*) FILTER (no <= cut AND NOT open_before AND line <> '') - 1 AS rows_kept,
      count(*) FILTER (no > cut) AS lines_removed, false AS aborted
    FROM states JOIN cuts USING (file_no) GROUP BY file_no"""
    out["salvaged_lines"] = f"{states} SELECT file_no, line FROM states JOIN cuts USING (file_no) WHERE no <= cut"

    out["prepare_letters"] = f"""{ctes("letters")}
    SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS document_id,
      dense_rank() OVER (ORDER BY patient_id) - 1 AS patient_id, md5(input_text) AS digest, label FROM letters"""
    out["drop_incomplete"] = f"""{ctes("ratings")} SELECT * FROM ratings
    WHERE expert IS NOT NULL AND students IS NOT NULL AND residents IS NOT NULL AND model IS NOT NULL"""
    out["balanced_sample"] = f"""{ctes("letters")} SELECT row_id, patient_id, label FROM (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7-' || row_id::VARCHAR), row_id) AS place
      FROM letters WHERE {label_mask}) r WHERE place <= {catalog.ONE_LABEL_SAMPLE}"""
    out["union_curated"] = f"""{ctes("letters")}
    SELECT row_id, md5(input_text) AS digest, patient_id, lang, label FROM letters
    UNION ALL SELECT item_id, md5(text), NULL, NULL, NULL FROM benchmark"""

    system = catalog.PROMPTS.system_text().replace("'", "''").replace("\n", "' || chr(10) || '")
    user = "'Text to read:' || chr(10) || 'BEGIN' || chr(10) || input_text || chr(10) || 'END'"
    out["build_messages"] = f"""{ctes("letters")}
    SELECT row_id, 0 AS pos, 'system' AS role, md5('{system}') AS digest FROM letters
    UNION ALL SELECT row_id, 1, 'user', md5({user}) FROM letters"""
    prompt = (
        f"'<|im_start|>system' || chr(10) || '{system}' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {user}"
        " || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || repeat(chr(10), 2)"
        " || '</think>' || repeat(chr(10), 2)"
    )
    out["render_prompt"] = f"""{ctes("letters")}
    SELECT row_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM (SELECT row_id, {prompt} AS prompt FROM letters) p"""
    limit = catalog.PROMPT_LIMIT["max_context"] - catalog.PROMPT_LIMIT["max_new_tokens"] - 100
    out["prompt_budget"] = f"""{ctes("letters")}, tokens AS (
      SELECT row_id, input_text, regexp_extract_all(input_text, '\\S+') AS w FROM letters)
    SELECT row_id, len(w) AS n_tokens, len(w) > {limit} AS truncated,
      md5(CASE WHEN len(w) > {limit} THEN
        regexp_replace(array_to_string(regexp_extract_all(input_text, '\\s*\\S+')[-{limit}:], ''), '^\\s+', '')
        ELSE input_text END) AS digest FROM tokens"""
    out["reasoning_audit"] = f"""{ctes("generations")}, split AS (
      SELECT row_id, run_idx, CASE WHEN instr(output_text, '</think>') > 0
          THEN trim(regexp_replace(string_split(output_text, '</think>')[1], '^\\s*<think>', ''), {SPACE}) END AS reasoning,
        trim(regexp_replace(output_text, '(?s)^.*?</think>', ''), {SPACE}) AS content FROM generations)
    SELECT row_id, run_idx, reasoning, content, coalesce(content, reasoning, '') AS answer,
      coalesce(len(regexp_extract_all(reasoning, '\\S+')), 0) AS reasoning_tokens,
      coalesce(len(regexp_extract_all(reasoning, '\\S+')), 0) > {catalog.REASONING_BUDGET} AS over_budget FROM split"""
    keywords = "'awq', 'gptq', 'gguf', 'fp8', 'eetq', 'aqlm', 'hqq'"
    out["model_metadata"] = f"""{ctes("model_ids")}, parsed AS (
      SELECT *, list_filter(list_reverse(string_split_regex(lower(model_id), '[/_-]')), lambda x: x IN ({keywords}))[1] AS quant_method,
        coalesce(known_params,
          CASE WHEN regexp_matches(lower(model_id), '\\d ?b') THEN
                 (regexp_extract(lower(model_id), '(\\d+(?:\\.\\d+)?) ?b', 1)::DOUBLE * 1e9)::BIGINT
               WHEN regexp_matches(lower(model_id), '\\d ?m') THEN
                 (regexp_extract(lower(model_id), '(\\d+(?:\\.\\d+)?) ?m', 1)::DOUBLE * 1e6)::BIGINT ELSE 1 END) AS n_params,
        CASE WHEN regexp_matches(lower(model_id), 'gptq|awq|fp4') THEN 4 WHEN lower(model_id) LIKE '%fp8%' THEN 8
          WHEN regexp_matches(scheme, '^I?Q\\d') THEN regexp_extract(scheme, '\\d+')::INTEGER
          WHEN lower(scheme) IN ('f16', 'fp16') THEN 16 WHEN lower(scheme) = 'q8_0' THEN 8 ELSE 0 END AS nbits FROM model_ids)
    SELECT run_id, quant_method, CASE WHEN quant_method = 'gguf' THEN scheme ELSE 'no_quant_scheme' END AS result_scheme,
      n_params, nbits, round(n_params * nbits / 8589934592.0::DOUBLE, 6) AS vram,
      round(CASE WHEN lower(model_id) LIKE '%fp8%' THEN 2 ELSE 1 END * (n_params * nbits / 8589934592.0::DOUBLE), 6)
        AS vram_corrected FROM parsed"""
    out["render_conversations"] = _turns("<think>\\n\\n</think>\\n\\n") + """
    SELECT conv_id, turn, start::BIGINT AS start, length(piece) AS n_chars, md5(piece) AS digest FROM pieces"""
    out["conversation_prompts"] = _turns("") + f""", sizes AS (
      SELECT *, max(start + length(piece)) OVER (PARTITION BY conv_id) AS size FROM pieces)
    SELECT conv_id, count(*) FILTER (fits) AS n_turns, coalesce(sum(length(piece)) FILTER (fits), 0)::BIGINT AS n_chars,
      md5(coalesce(string_agg(piece, '' ORDER BY start) FILTER (fits), '')) AS digest
    FROM (SELECT *, start >= size - {catalog.CONVERSATION_LIMIT} AS fits FROM sizes) s GROUP BY conv_id"""
    out["generate_stub"] = f"""{ctes("letters")}
    SELECT row_id, run_idx::INTEGER AS run_idx, '{{"mRS": ' ||
      (('0x' || substr(md5(run_idx::VARCHAR || '-' || input_text), 1, 7))::BIGINT % 7)::VARCHAR || '}}' AS output_text,
      NULL::VARCHAR AS error FROM letters, range(3) r(run_idx)"""

    out["resume_batches"] = f"""SELECT row_id, run_idx, output_text, 1::BIGINT AS times_written, error FROM ({out["generate_stub"]}) g"""
    out["resume_attempts"] = """
    SELECT doc_id AS row_id, run_idx::INTEGER AS run_idx, CASE WHEN doc_id % 3 = 2 THEN 'first' ELSE 'third' END AS attempt,
      NULL::VARCHAR AS error FROM documents, range(2) r(run_idx)"""

    out["extract_structured"] = _extract_mrs("SELECT row_id, run_idx, value::BIGINT AS \"mRS\", status, valid FROM extracted")
    out["extraction_status"] = _extract_mrs("SELECT status, count(*) AS n FROM extracted GROUP BY status")
    wide = ", ".join(f"max(CASE WHEN run_idx = {i} THEN value END)::BIGINT AS \"mRS_{i:03d}\"" for i in range(RUNS))
    out["predictions_wide"] = _extract_mrs(f"SELECT row_id, {wide} FROM extracted GROUP BY row_id")
    out["stream_extract"] = out["extract_structured"]
    predicted = ", predicted AS (SELECT row_id, run_idx, label, value::INTEGER AS pred FROM extracted)"
    out["score_generations"] = _extract_mrs(predicted + _mode_scores("predicted"))
    out["resumable_run"] = out["score_generations"]
    out["rescore_results"] = out["score_generations"]
    out["event_props"] = "WITH src AS (SELECT event_id, props FROM events)" + _extraction(
        "src", "props", "k", 0, 80, "NULL", "SELECT event_id, value::BIGINT AS k, status, valid FROM extracted"
    )
    out["extract_repair"] = f"""{ctes("truncated")}
    SELECT row_id, run_idx, trim(output_text, {SPACE}) || list_reduce(
      list_filter(string_split(output_text, ''), lambda c: c IN ('{{', '}}', '[', ']')),
      lambda acc, c: CASE WHEN c = '{{' THEN '}}' || acc WHEN c = '[' THEN ']' || acc
        WHEN c = left(acc, 1) THEN substr(acc, 2) ELSE acc END, '') AS repaired FROM truncated"""
    first = "regexp_extract(output_text, '{}', 1)"
    name, tags = first.format('"name": "((?:\\\\"|[^"])*)"'), first.format('"tags": \\[([^\\]]*)\\]')
    sizes, price = first.format('"sizes": \\[([^\\]]*)\\]'), first.format('"price": (-?\\d+\\.\\d+)')
    out["extract_list_fields"] = f"""{ctes("listings")}
    SELECT row_id, CASE WHEN shape IN (0, 1) THEN replace({name}, '\\"', '"') END AS name,
      CASE WHEN shape < 3 THEN replace(replace({tags}, '", "', '|'), '"', '') ELSE '' END AS tags,
      CASE WHEN shape < 3 THEN split_part({sizes}, ', ', 1) || '.0|' || split_part({sizes}, ', ', 2) ELSE '' END AS sizes,
      CASE WHEN shape < 3 THEN {price}::DOUBLE ELSE 0 END AS price,
      shape < 3 AND output_text LIKE '%"stock": true%' AS stock,
      CASE WHEN shape = 0 THEN 'direct' WHEN shape < 3 THEN 'field_regex' ELSE 'default' END AS status,
      shape < 2 AS valid FROM listings"""
    out["validate_records"] = f"""{ctes("event_records")}, checked AS (SELECT event_id, list_filter([
      CASE WHEN event_date IS NULL THEN 'event_date:missing'
           WHEN NOT (event_date[6:7]::INT BETWEEN 1 AND 12 AND event_date[9:10]::INT BETWEEN 1 AND 31) THEN 'event_date:pattern' END,
      CASE WHEN event_type NOT IN ('Admission', 'Discharge', 'Procedure') THEN 'event_type:not_allowed' END,
      CASE WHEN score < 0 THEN 'score:below_minimum' WHEN score > 6 THEN 'score:above_maximum' END], lambda x: x IS NOT NULL) AS v
      FROM event_records)
    SELECT event_id, array_to_string(v, '|') AS violations, len(v) = 0 AS valid FROM checked"""

    out["votes_long"] = f"{ctes('votes')} SELECT row_id, run_idx, pred FROM votes"
    out["pool_single"] = f"{ctes('votes')} SELECT row_id, label, pred FROM votes WHERE run_idx = 0"
    out["pool_all"] = f"{ctes('votes')} SELECT row_id, run_idx, label, pred FROM votes"
    for k in (3, 5, 10):
        out[f"pool_majority_{k}"] = f"{ctes('votes')} {_majority('votes', 'row_id', k, 'pred')}"
    out["consensus_table"] = f"""{ctes("votes")} SELECT row_id, s.label, s.pred AS pred_1, pred_maj_3, pred_maj_5, pred_maj_10
    FROM (SELECT row_id, label, pred FROM votes WHERE run_idx = 0) s
    """ + " ".join(
        f"JOIN (SELECT row_id, pred_maj_{k} FROM ({_majority('votes', 'row_id', k, f'pred_maj_{k}')}) x{k}) m{k} USING (row_id)"
        for k in (3, 5, 10)
    )
    columns = []
    for model, quant, _ in MODELS:
        for mode in ("single", "maj_3", "maj_5", "maj_10"):
            plain = catalog._plain(f"{model}-{quant}-{mode}")
            same = f"model = '{model}' AND quant_scheme = '{quant}' AND mode = '{mode}'"
            columns.append(f"max(CASE WHEN {same} THEN pred END) AS {plain}")
    out["attach_predictions"] = f"""{ctes("model_votes")}
    SELECT row_id, max(label) AS label, {", ".join(columns)}
    FROM ({_pooled_rows("model_votes", "model, quant_scheme, row_id")}) p GROUP BY row_id"""

    out["error_distance"] = f"{ctes('votes')} {_scores('SELECT * FROM votes', 'run_idx')}"
    out["metrics_by_mode"] = f"{ctes('votes')} {_mode_scores('votes')}"
    out["report_file"] = f"{ctes('votes')} SELECT *, 1 AS n_files FROM ({_mode_scores('votes')}) s"
    out["consensus_file"] = out["consensus_table"]
    stub = "(('0x' || substr(md5(run_idx::VARCHAR || '-' || prompt), 1, 7))::BIGINT % 7)::INTEGER"
    five = [
        ("all", "all 5 models", "SELECT row_id, label, pred FROM v"),
        ("single", "single model", "SELECT row_id, label, pred FROM v WHERE run_idx = 0"),
        ("maj_3", "maj-pooling-3", f"SELECT row_id, label, pred FROM ({_majority('v', 'row_id', 3, 'pred')}) a"),
        ("maj_5", "maj-pooling-5", f"SELECT row_id, label, pred FROM ({_majority('v', 'row_id', 5, 'pred')}) b"),
    ]
    pooled = " UNION ALL ".join(f"SELECT '{m}' AS mode, '{lab}' AS mode_label, * FROM ({q}) q_{m}" for m, lab, q in five)
    out["benchmark_run"] = f"""{ctes("letters")}, v AS (SELECT row_id, label, run_idx, {stub} AS pred
      FROM (SELECT row_id, label, {prompt} AS prompt FROM letters) p, range(5) r(run_idx))
    {_scores(pooled, "mode, mode_label")}"""
    out["benchmark_resumed"] = out["benchmark_run"]
    out["benchmark_log"] = f"{ctes('letters')} SELECT 'stub' AS run, count(*) AS n_samples, true AS timed FROM letters"
    for name, table in (("confusion_matrix", "votes"), ("confusion_null_votes", "null_votes")):
        out[name] = f"""{ctes(table)}, pooled AS (
      {_pooled_rows(f"(SELECT row_id, run_idx, coalesce(label, -1) AS label, pred FROM {table}) v", "row_id")}),
    grid AS (SELECT DISTINCT mode, y::INTEGER AS y, p::INTEGER AS p FROM pooled, range(-1, 7) a(y), range(-1, 7) b(p))
    SELECT g.mode, y, p, count(pooled.mode) AS n FROM grid g
    LEFT JOIN pooled ON pooled.mode = g.mode AND label = y AND coalesce(pred, -1) = p GROUP BY g.mode, y, p"""
    out["error_distance_null_votes"] = f"{ctes('null_votes')} {_scores('SELECT * FROM null_votes', 'run_idx')}"
    out["metrics_null_votes"] = f"{ctes('null_votes')} {_mode_scores('null_votes')}"
    value = " ".join(f"WHEN {i} THEN {'pred' if v is None else v}" for i, (_, v, _) in enumerate(HOSTILE_SHAPES))
    status = " ".join(f"WHEN {i} THEN '{s}'" for i, (_, _, s) in enumerate(HOSTILE_SHAPES))
    out["extract_hostile"] = f"""{ctes("hostile")}
    SELECT row_id, run_idx, (CASE shape {value} END)::BIGINT AS "mRS", CASE shape {status} END AS status FROM hostile"""

    score = " ".join(f"WHEN {i} THEN {v or 'pred'}" for i, (_, v, r, _) in enumerate(JSON5_SHAPES) if r)
    ratio = " ".join(f"WHEN {i} THEN {r}::DOUBLE" for i, (_, _, r, _) in enumerate(JSON5_SHAPES) if r)
    note = " ".join(f"WHEN {i} THEN {n}" for i, (_, _, _, n) in enumerate(JSON5_SHAPES) if n)
    loose = [str(i) for i, (_, v, r, _) in enumerate(JSON5_SHAPES) if v or not r]
    out["extract_json5"] = f"""{ctes("json5")}
    SELECT row_id, run_idx, (CASE shape {score} ELSE -1 END)::BIGINT AS "mRS", CASE shape {ratio} ELSE 0.0::DOUBLE END AS ratio,
      CASE shape {note} ELSE '' END AS note, CASE WHEN shape IN ({", ".join(loose)}) THEN 'default' ELSE 'lenient' END AS status FROM json5"""

    out["rater_metrics"] = f"""{ctes("ratings")} {COUNTED} {_places("cells", "rater")}
    SELECT rater, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(avg((y = p)::INT), 6) AS exact_acc,
      round(avg((abs(y - p) <= 1)::INT), 6) AS tol1_acc, any_value(qwk) AS qwk
    FROM long JOIN ({_kappa("cells", "rater")}) k USING (rater) WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY rater"""
    gap_cells = COUNTED.replace("FROM ratings", "FROM ratings_gap")
    out["qwk_gap"] = f"{ctes('ratings_gap')} {gap_cells} {_places('cells', 'rater')} {_kappa('cells', 'rater')}"
    broad = "CASE WHEN {0} <= 1 THEN '(0-1)' WHEN {0} <= 5 THEN '(2-5)' WHEN {0} = 6 THEN '(6)' END"
    complete = "ratings WHERE students + residents + model + expert IS NOT NULL"
    rows = " UNION ALL ".join(
        f"SELECT '{r}' AS rater, {broad.format('expert')} AS y, {broad.format(r)} AS p FROM {complete}" for r in catalog.RATERS
    )
    out["broad_class_metrics"] = f"""{ctes("ratings")}, b AS ({rows}), classes AS (
      SELECT rater, label, count(*) FILTER (y = label) AS support,
        2.0::DOUBLE * count(*) FILTER (y = label AND p = label) / (count(*) FILTER (y = label) + count(*) FILTER (p = label)) AS f1
      FROM b, (VALUES ('(0-1)'), ('(2-5)'), ('(6)')) c(label) GROUP BY rater, label)
    SELECT rater, sum(support)::BIGINT AS n, any_value(accuracy) AS accuracy, round(avg(f1), 6) AS f1_macro,
      round(sum(f1 * support) / sum(support), 6) AS f1_weighted
    FROM classes JOIN (SELECT rater, round(avg((y = p)::INT), 6) AS accuracy FROM b GROUP BY rater) a USING (rater) GROUP BY rater"""
    out["mae_by_class"] = f"""{ctes("ratings")} {LONG}
    SELECT rater, y AS label, count(*) AS n, round(avg(abs(y - p)), 6) AS mae FROM long WHERE p IS NOT NULL GROUP BY rater, y"""
    out["error_histogram"] = f"""{ctes("ratings")} {LONG}
    SELECT g.rater, g.error::INTEGER AS error, count(p) AS n,
      round(count(p) / sum(count(p)) OVER (PARTITION BY g.rater), 6) AS density
    FROM (SELECT DISTINCT rater, error FROM long, range(-6, 7) e(error)) g
    LEFT JOIN (SELECT * FROM long WHERE p IS NOT NULL) l ON l.rater = g.rater AND p - y = error GROUP BY g.rater, g.error"""
    out["bland_altman"] = f"""{ctes("ratings")} {LONG}
    SELECT rater, count(*) AS n, round(avg(y - p), 6) AS bias, round(stddev_pop(y - p), 6) AS sd,
      round(avg(y - p) - 1.96 * stddev_pop(y - p), 6) AS lower, round(avg(y - p) + 1.96 * stddev_pop(y - p), 6) AS upper
    FROM long WHERE p IS NOT NULL GROUP BY rater"""
    out["bland_altman_points"] = f"""{ctes("ratings")}
    SELECT item_id, (expert + model) / 2.0::DOUBLE AS mean, expert - model AS diff FROM ratings"""
    out["metric_sem"] = f"""{ctes("votes")}, per_run AS (
      SELECT run_idx, avg(abs(label - pred)) AS distance FROM votes WHERE {label_mask} GROUP BY run_idx)
    SELECT count(*) AS n, round(avg(distance), 6) AS mean, round(stddev_samp(distance) / sqrt(count(*)), 6) AS sem FROM per_run"""
    out["run_cost"] = f"""{ctes("chunk_log")}
    SELECT run, sum(n_samples)::BIGINT AS n_samples, round(sum(time_per_sample * n_samples) / sum(n_samples), 6) AS time_per_sample,
      max(memory_gb) AS memory_gb FROM chunk_log GROUP BY run"""
    out["custom_metric"] = f"""{ctes("ratings")} {LONG}
    SELECT rater, round(1 - avg(abs(y - p)) / 6, 6) AS linear_agreement FROM long WHERE p IS NOT NULL GROUP BY rater"""

    lengths = f"{ctes('letters')}, l AS (SELECT lang, len(regexp_extract_all(input_text, '\\S+')) AS length FROM letters)"
    out["length_stats"] = f"""{lengths}
    SELECT lang, count(*) AS n, round(avg(length), 6) AS mean, round(median(length), 6) AS median,
      round(stddev_samp(length), 6) AS sd, min(length) AS min, max(length) AS max FROM l GROUP BY lang"""
    out["length_histogram"] = f"""{lengths}, s AS (SELECT min(length)::DOUBLE AS lo, max(length)::DOUBLE AS hi, count(*) AS total FROM l),
    placed AS (SELECT least(49, floor((length - lo) / ((hi - lo) / 50)))::INTEGER AS bin FROM l, s)
    SELECT b.bin::INTEGER AS bin, round(lo + b.bin * ((hi - lo) / 50), 6) AS low,
      round(lo + (b.bin + 1) * ((hi - lo) / 50), 6) AS high, count(placed.bin) AS n,
      round(count(placed.bin) / (total * ((hi - lo) / 50)), 6) AS density
    FROM range(50) b(bin) CROSS JOIN s LEFT JOIN placed ON placed.bin = b.bin GROUP BY b.bin, lo, hi, total"""
    out["length_kde"] = f"""{lengths}, s AS (SELECT count(*) AS n, stddev_samp(length) * power(count(*), -0.2) AS bw,
      min(length) - 0.5 * (max(length) - min(length)) AS lo, 2.0 * (max(length) - min(length)) / 199 AS step FROM l)
    SELECT point::INTEGER AS point, round(lo + point * step, 6) AS x,
      round(sum(exp(-0.5 * power((lo + point * step - length) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density
    FROM l, s, range(200) g(point) GROUP BY point, lo, step, n, bw"""

    out["icc3"] = f"""{ctes("ratings")} {LONG}, mean_squares AS (
      SELECT rater, count(*) AS n, var_samp((y + p) / sqrt(2)) AS msr, var_samp((y - p) / sqrt(2)) AS mse
      FROM long WHERE p IS NOT NULL GROUP BY rater)
    SELECT rater, n, round((msr - mse) / (msr + mse), 6) AS icc, round(msr / mse, 6) AS f_value FROM mean_squares"""
    out["wilcoxon"] = f"""{ctes("ratings")} {DIFFERENCES} {WILCOXON}
    SELECT comparison, n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(w, 6) AS w, round(rbc, 6) AS rbc,
      round(z, 6) AS z, round(p_value, 6) AS p_value FROM zs JOIN normal USING (comparison)"""
    out["wilcoxon_exact"] = f"""
    WITH RECURSIVE {ctes("ratings")[5:]}, diffs AS (
      SELECT split_part(item_id, '-', 3)::BIGINT AS part, abs(model - expert) - abs(students - expert) AS d FROM ratings),
    pairs AS (
      SELECT part, d, row_number() OVER (PARTITION BY part) AS k, count(*) OVER (PARTITION BY part) AS n,
        2 * rank() OVER (PARTITION BY part ORDER BY abs(d)) + count(*) OVER (PARTITION BY part, abs(d)) - 1 AS twice
      FROM diffs WHERE d <> 0),
    totals AS (SELECT part, n, sum(twice) AS total,
      least(sum(CASE WHEN d > 0 THEN twice ELSE 0 END), sum(CASE WHEN d < 0 THEN twice ELSE 0 END)) AS w2 FROM pairs GROUP BY part, n),
    walk AS (
      SELECT part, 0::BIGINT AS k, list_transform(range(total::BIGINT + 1), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ways
      FROM totals
      UNION ALL
      SELECT part, p.k, list_transform(range(len(ways)), lambda s: ways[s + 1] + CASE WHEN s >= twice THEN ways[s - twice + 1] ELSE 0 END)
      FROM walk w JOIN pairs p USING (part) WHERE p.k = w.k + 1)
    SELECT part, n, w2 / 2 AS w, round(least(1, 2 * list_sum(ways[1:w2::BIGINT + 1]) / list_sum(ways)), 6) AS p_value, 'exact' AS method
    FROM walk JOIN totals USING (part) WHERE k = n"""
    out["paired_t"] = f"""{ctes("ratings")} {DIFFERENCES} {PAIRED_T}
    SELECT comparison, n, round(mean_diff, 6) AS mean_diff, round(sd_diff, 6) AS sd_diff, round(t, 6) AS t,
      round(p_value, 6) AS p_value, round(log_bf10, 3) AS log_bf10
    FROM ts JOIN tail USING (comparison) JOIN bayes USING (comparison)"""
    sides = " ".join(f"WHEN '{name}' THEN '{a}'" for name, (a, _) in catalog.COMPARISONS.items())
    others = " ".join(f"WHEN '{name}' THEN '{b}'" for name, (_, b) in catalog.COMPARISONS.items())
    out["verdicts"] = f"""{ctes("ratings")} {LONG} {DIFFERENCES} {WILCOXON} {PAIRED_T},
    errors AS (SELECT rater, avg(abs(y - p)) AS mae FROM long WHERE p IS NOT NULL GROUP BY rater),
    named AS (SELECT *, CASE comparison {sides} END AS a, CASE comparison {others} END AS b FROM zs)
    SELECT comparison, CASE WHEN normal.p_value < 0.05 THEN '**Significant**' ELSE 'Not sig' END AS significance,
      round(rbc, 6) AS rbc, CASE WHEN log_bf10 > ln(3) THEN 'Favors difference'
        WHEN log_bf10 < ln(0.333) THEN 'Favors equivalence' ELSE 'Inconclusive' END AS bayes_interpretation,
      CASE WHEN ea.mae < eb.mae THEN a || ' better' WHEN eb.mae < ea.mae THEN b || ' better' ELSE 'TIE' END AS winner
    FROM named JOIN normal USING (comparison) JOIN bayes USING (comparison)
    JOIN errors ea ON ea.rater = a JOIN errors eb ON eb.rater = b"""
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {a} - expert AS u, {b} - expert AS v FROM ratings"
        for a in catalog.RATERS
        for b in catalog.RATERS
    )
    out["spearman_errors"] = f"""{ctes("ratings")}, pairs AS (SELECT * FROM ({pairs}) x WHERE u IS NOT NULL AND v IS NOT NULL),
    ranked AS (SELECT a, b,
      rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2.0::DOUBLE AS x,
      rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0::DOUBLE AS z FROM pairs)
    SELECT a, b, count(*) AS n, round(corr(x, z), 6) AS rho FROM ranked GROUP BY a, b"""
    rated = " UNION ALL ".join(
        f"SELECT '{name}' AS category, {a} AS y, {b} AS p FROM rater_pairs" for name, (a, b) in catalog.RATER_PAIRS.items()
    )
    out["inter_rater"] = f"""{ctes("rater_pairs")}, cells AS (SELECT category, y, p, count(*) AS n FROM ({rated}) r
      WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ALL) {_places("cells", "category")} {_agreement("cells", "category")}"""
    out["self_agreement"] = f"""{ctes("model_votes")}, cells AS (
      SELECT model, quant_scheme, a.pred AS y, b.pred AS p, count(*) AS n
      FROM (SELECT * FROM model_votes WHERE run_idx = 0) a JOIN (SELECT * FROM model_votes WHERE run_idx = 9) b
      USING (model, quant_scheme, row_id) GROUP BY ALL)
    {_places("cells", "model, quant_scheme")} {_agreement("cells", "model, quant_scheme")}"""
    out["lme_suffstats"] = _lme()

    out["prediction_arrays"] = f"""{ctes("votes")}
    SELECT row_id, mode, pred::INTEGER AS pred FROM ({_pooled_rows("votes", "row_id")}) p WHERE mode <> 'all'"""
    out["resume_pending"] = f"""{ctes("letters")} SELECT row_id, patient_id, md5(input_text) AS digest FROM letters
    WHERE input_text NOT IN (SELECT input_text FROM letters WHERE {label_mask})"""
    four = ("qwk", "mae", "exact_acc", "tol1_acc")
    for name, source, by, metrics in (
        ("bootstrap_cells_estimates", "rater_metrics", "rater", four),
        ("bootstrap_inter_rater_estimates", "inter_rater", "category", four[:3]),
    ):
        out[name] = f"""SELECT {by}, unnest([{", ".join(f"'{m}'" for m in metrics)}]) AS metric, n,
          unnest([{", ".join(metrics)}]) AS estimate, 1000 AS used FROM ({out[source]}) r"""
    out["rater_report_estimates"] = f"""SELECT rater, r.n, {", ".join(four)}, icc
      FROM ({out["rater_metrics"]}) r JOIN ({out["icc3"]}) i USING (rater)"""
    return out
