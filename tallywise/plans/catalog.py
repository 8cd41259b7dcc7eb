"""Registered queries: every operator over the whole driver tables, as ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import hashlib
import time

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywise.functions import model_ids as ids
from tallywise.functions.extraction import extract_structured, predictions_wide, repair_truncated, status_counts
from tallywise.functions.prompts import PromptConfig, build_messages, fit_prompt, render_prompt, split_reasoning
from tallywise.functions.schemas import Field, get_schema, violations
from tallywise.operators import agreement, bootstrap, conversations, lengths, mixed, pooling, prepare, scoring, significance
from tallywise.operators.generate import backend, generate
from tallywise.operators.indexing import dense_index
from tallywise.operators.scratch import durable, scratch_path
from tallywise.plans import benchmark
from tallywise.plans.fixtures import MODELS, RUNS, load
from tallywise.sources import letters as letter_files
from tallywise.sources import runs as run_files
from tallywise.sources.arrays import read_arrays, write_arrays
from tallywise.sources.salvage import salvage_report, write_salvaged
from tallywise.sources.sealed import CELL_CODEC, damaged_cells, verify_sealed, write_sealed
from tallywise.streaming.resume import finished_rows, pending, run_resumable, stream_extract

RATERS = ["students", "residents", "model"]
COMPARISONS = {
    "model vs students": ("model", "students"),
    "model vs residents": ("model", "residents"),
    "students vs residents": ("students", "residents"),
}
RATER_PAIRS = {
    "students": ("students1", "students2"),
    "residents": ("residents1", "residents2"),
    "experts": ("experts1", "experts2"),
}
# Column names of letter tables and the words that mark a missing label.
RECODED = {"PatID": "patient_id", "lettre": "input_text", "mrs_label": "label"}
NO_LABEL = ["No FU", "No FU yet"]
PROMPTS = PromptConfig(
    system_template="{task}\n{knowledge}\n{output}\n",
    user_template="Text to read:\nBEGIN\n{input_text}\nEND\n",
    context={
        "task": "Find the score of the patient in the text.",
        "knowledge": "The score runs from 0 to 6.",
        "output": "Think between <think> and </think>, then answer with a JSON object.",
    },
    context_no_thinking={"output": "Answer with a JSON object."},
    enable_thinking=False,
)
LIST_FIELDS = (
    Field("name", "string"),
    Field("tags", "list[string]"),
    Field("sizes", "list[float]"),
    Field("price", "float", default=0.0),
    Field("stock", "bool", default=False),
)
JSON5_FIELDS = (
    Field("mRS", "int", default=-1, ge=0, le=6),
    Field("ratio", "float", default=0.0),
    Field("note", "string", default=""),
)
EVENT_FIELDS = (*get_schema("ClinicalEventDate"), Field("score", "int", ge=0, le=6))
ONE_LABEL_SAMPLE = 20
PROMPT_LIMIT = {"max_new_tokens": 1024, "max_context": 1400}
REASONING_BUDGET = 1
CONVERSATION_LIMIT = 2000


def _metric_file(error: str, distance: str) -> str:
    sizes = '"VRAM param usage": {"values": [1.5]}, "Number of params": {"values": [9.5]}, "Bits/param": {"values": [4]}'
    scores = f'"Error Rate\\n(single model)": {{"values": [{error}]}}, "Distance\\n(single model)": {{"values": [{distance}]}}'
    return f"{{{sizes}, {scores}}}"


# Files beside the written ones: cut off, with something after the object, with NaN, and three runs of equal keys.
ODD_METRIC_FILES = (
    ("damaged", '{"Error Rate'),
    ("tail", _metric_file("0.9", "0.9") + " and more"),
    ("twin", _metric_file("0.9", "0.9") * 2),
    ("odd-0", _metric_file("NaN", "0.9")),
    ("odd-1", _metric_file("0.5", "NaN")),
    ("odd-2", _metric_file("0.4", "0.75")),
)


def r6(column: Column | str) -> Column:
    """Doubles are compared at six decimals."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Sources and sinks


def scan_letters(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "letters-csv")
    letter_files.write_csv(load(spark, sf, "letters"), path)
    letters = letter_files.read_letters(spark, path)
    return letters.select("row_id", F.md5("input_text").alias("digest"), "patient_id", "lang", "source", "label")


def encrypt_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path, key = scratch_path(spark, "encrypted"), "000102030405060708090a0b0c0d0e0f"
    wrong = "ff" + key[2:]
    columns = {"input_text": "string", "label": "int"}
    letter_files.write_encrypted(load(spark, sf, "letters"), path, key, list(columns))
    plain = letter_files.read_encrypted(spark, path, key, columns)
    locked = letter_files.decrypt(F.col("input_text"), wrong).isNull()
    wrong_key = spark.read.parquet(path).select("row_id", locked.alias("locked"))
    return plain.join(wrong_key, "row_id").select(
        "row_id", F.md5("input_text").alias("digest"), "label", "locked"
    )


def sealed_letters(spark: SparkSession, sf: str) -> DataFrame:
    """What seal and cells say of a table as written, and of copies with moved cells, a lost row and a row twice."""
    key, locked = "000102030405060708090a0b0c0d0e0f", ["input_text", "label"]
    path = scratch_path(spark, "sealed")
    letter_files.hide_keys(spark)
    write_sealed(load(spark, sf, "letters"), path, key, locked)
    stored, seal = spark.read.parquet(path), spark.read.parquet(f"{path}/_seal")
    first = stored.agg(F.min("row_id").alias("row_id"))
    changed = {
        "moved cells": traded_texts(stored),
        "lost row": stored.join(first, "row_id", "left_anti"),
        "row twice": stored.union(stored.join(first, "row_id", "left_semi")),
    }
    out = None
    for name, table in {"untouched": None, **changed}.items():
        where = path
        if table is not None:
            where = scratch_path(spark, "sealed")
            table.write.parquet(where, compression=CELL_CODEC)
            seal.write.parquet(f"{where}/_seal")
        cells = damaged_cells(spark, where, key, locked).groupBy().agg(F.count("column").alias("damaged"))
        found = verify_sealed(spark, where, key).select(F.lit(name).alias("variant"), "rows", "whole").join(
            cells.withColumn("variant", F.lit(name)), "variant"
        )
        out = found if out is None else out.union(found)
    return out


def traded_texts(stored: DataFrame) -> DataFrame:
    """Each row with the text of the row whose id differs in the last bit, or its own where that has none.

    Only texts that are given away are shuffled: most rows need no text of their own. The ids of those that do are told
    from ids alone, and are few where ids are dense, so that they are broadcast.
    """
    given = stored.select(F.col("row_id").bitwiseXOR(F.lit(1)).alias("row_id"), F.col("input_text").alias("moved"))
    sure = given.groupBy("row_id").agg(F.bool_and(F.col("moved").isNotNull()).alias("sure")).where("sure")
    own = durable(stored.select("row_id").distinct().join(sure, "row_id", "left_anti"), "own-texts").toDF("own_id")
    known = F.col("row_id").eqNullSafe(F.col("own_id"))
    traded = stored.drop("input_text").join(own, known, "left_anti").join(given, "row_id")
    kept = stored.join(own, known, "left_semi").join(given.join(own, known, "left_semi"), "row_id", "left")
    kept = kept.withColumn("input_text", F.coalesce("moved", "input_text"))
    return traded.withColumnRenamed("moved", "input_text").select(stored.columns).union(kept.select(stored.columns))


def consensus_file(spark: SparkSession, sf: str) -> DataFrame:
    table = pooling.consensus_table(load(spark, sf, "votes"), RUNS)
    path = run_files.write_consensus(table, scratch_path(spark, "results") + ".csv")
    return spark.read.schema(table.schema).option("header", True).csv(path)


def report_file(spark: SparkSession, sf: str) -> DataFrame:
    """A report written as one file, read back with the number of files."""
    report, path = metrics_by_mode(spark, sf), scratch_path(spark, "report")
    letter_files.write_report(report, path)
    back = spark.read.schema(report.schema).options(header=True, escape='"', multiLine=True).csv(path)
    files = spark.read.text(path).select(F.col("_metadata.file_name").alias("f")).agg(F.countDistinct("f")).first()[0]
    return back.withColumn("n_files", F.lit(files))


def shuffled_letters(spark: SparkSession, sf: str) -> DataFrame:
    """The seeded order of all letters, as the places of the rows in the files they are written to."""
    path = scratch_path(spark, "shuffled")
    prepare.shuffle_rows(load(spark, sf, "letters")).select("row_id").write.parquet(path)
    placed = spark.read.parquet(path).select("row_id", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    files = placed.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.join(files, "f").select("row_id", (F.col("start") + F.col("i")).alias("place"))


def write_read_results(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "results")
    run_files.write_results(load(spark, sf, "model_votes"), path, "stub", guided=True)
    return rounded(scoring.error_distance(run_files.read_results(spark, path), run_files.RUN_COLUMNS))


def _run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    votes = load(spark, sf, "model_votes")
    by_mode = scoring.metrics_by_mode(votes, RUNS, ["model", "quant_scheme"])
    sizes = benchmark.run_characteristics(F.col("model"), F.col("quant_scheme"))
    values = by_mode.select("model", "quant_scheme").distinct().withColumns(sizes)
    return run_files.metric_entries(by_mode, values, ["model", "quant_scheme"])


def metrics_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path, keys = scratch_path(spark, "metrics"), ["model", "quant_scheme"]
    run_files.write_metrics(_run_metrics(spark, sf), path, keys)
    return rounded(run_files.flatten_metrics(run_files.read_metric_files(spark, path), keys))


def pool_run_files(spark: SparkSession, sf: str) -> DataFrame:
    path, keys = scratch_path(spark, "metrics"), ["model", "quant_scheme"]
    entries = durable(_run_metrics(spark, sf), "entries")
    run_files.write_metrics(entries, path, keys)
    extra = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in ODD_METRIC_FILES])))
    odd = entries.select("model").distinct().select("model", extra.alias("quant_scheme", "value"))
    odd.write.mode("append").partitionBy(*keys).text(path)
    files = run_files.read_metric_files(spark, path)
    family = F.regexp_extract("model", r"lab/(\w+)-", 1)
    return rounded(run_files.pooled_results(files, family))


def pool_run_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled runs with the half-widths of their errors, which must be near those of a proportion and inside its range."""
    path, keys = scratch_path(spark, "metrics"), ["model", "quant_scheme"]
    counted = benchmark.pooled_cells(load(spark, sf, "model_votes"), RUNS, keys)
    labels = F.create_map(*[F.lit(x) for pair in pooling.modes_for(RUNS) for x in pair])
    cells = durable(counted.withColumn("mode_label", F.element_at(labels, F.col("mode"))).drop("mode"), "cells")
    run_files.write_metrics(_run_metrics(spark, sf), path, keys, cells=cells)
    files = run_files.read_metric_files(spark, path)
    family = F.regexp_extract("model", r"lab/(\w+)-", 1)
    pooled = run_files.pooled_results(files, family, intervals=True)
    labelled = run_files.metric_cells(files, ["path"]).where("mode_label = 'single model' AND y >= 0")
    n = labelled.groupBy("path").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]  # all runs are on the same letters
    rows = []
    for case in run_files.POOLED_CASES:
        e, sides = F.col(f"error_{case}"), [F.col(f"error_{case}_err_{s}") for s in ("low", "high")]
        draws = n * (RUNS if case == "all" else 1)
        wide = 1.96 * F.sqrt(e * (1 - e) / draws)
        near = [F.abs(s - wide) < 0.25 * wide + 1 / draws for s in sides]
        rows.append(F.struct(F.lit(case).alias("case"), e.alias("error"), near[0].alias("low_near"), near[1].alias("high_near")))
    found = pooled.select("model", "vram", F.inline(F.array(*rows)))
    return rounded(found.where("error is not null"))


def _damaged_csv(spark: SparkSession, sf: str) -> str:
    """Folders with one damaged file each; a task gives its files equal names."""
    path = scratch_path(spark, "damaged-csv")
    records = load(spark, sf, "csv_records")
    head = records.select("file_no").distinct().select(
        "file_no", F.lit(-1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("conv_id,turn,role,text").alias("record")
    )
    lines = records.unionByName(head).repartition("file_no").sortWithinPartitions("file_no", "conv_id", "turn")
    lines.select("file_no", F.col("record").alias("value")).write.partitionBy("file_no").text(path)
    return path


def _file_number(column: str) -> Column:
    return F.regexp_extract(column, r"file_no=(\d+)", 1).cast("bigint").alias("file_no")


def salvage_csv(spark: SparkSession, sf: str) -> DataFrame:
    report = salvage_report(spark, _damaged_csv(spark, sf))
    return report.select(_file_number("file"), "rows_kept", "lines_removed", "aborted")


def salvaged_lines(spark: SparkSession, sf: str) -> DataFrame:
    target = scratch_path(spark, "salvaged")
    write_salvaged(spark, _damaged_csv(spark, sf), target)
    return spark.read.text(target).select(_file_number("name"), F.col("value").alias("line"))


# Preparation


def prepare_letters(spark: SparkSession, sf: str) -> DataFrame:
    raw = load(spark, sf, "raw_letters")
    out = prepare.prepare_letters(raw, RECODED, NO_LABEL, order_by="row_id")
    return out.select("row_id", "document_id", "patient_id", F.md5("input_text").alias("digest"), "label")


def drop_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.drop_incomplete(load(spark, sf, "ratings"), ["expert", *RATERS])


def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    letters = load(spark, sf, "letters").select("row_id", "patient_id", "label")
    return prepare.balanced_sample(letters, ONE_LABEL_SAMPLE, seed=7)


def union_curated(spark: SparkSession, sf: str) -> DataFrame:
    curated = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("row_id"), F.col("text").alias("input_text")
    )
    every = prepare.load_for_benchmark(load(spark, sf, "letters"), curated, add_curated=True)
    return every.select("row_id", F.md5("input_text").alias("digest"), "patient_id", "lang", "label")


# Prompts


def build_messages_query(spark: SparkSession, sf: str) -> DataFrame:
    built = build_messages(load(spark, sf, "letters"), PROMPTS)
    return built.select("row_id", F.posexplode("messages").alias("pos", "m")).select(
        "row_id", "pos", "m.role", F.md5("m.content").alias("digest")
    )


def render_prompt_query(spark: SparkSession, sf: str) -> DataFrame:
    built = build_messages(load(spark, sf, "letters"), PROMPTS)
    rendered = render_prompt(built, enable_thinking=PROMPTS.enable_thinking)
    return rendered.select("row_id", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("digest"))


def prompt_budget(spark: SparkSession, sf: str) -> DataFrame:
    fitted = fit_prompt(load(spark, sf, "letters"), **PROMPT_LIMIT, text_col="input_text")
    return fitted.select("row_id", "n_tokens", "truncated", F.md5("fitted").alias("digest"))


def reasoning_audit(spark: SparkSession, sf: str) -> DataFrame:
    split = split_reasoning(load(spark, sf, "generations"), budget=REASONING_BUDGET)
    return split.select("row_id", "run_idx", "reasoning", "content", "answer", "reasoning_tokens", "over_budget")


def render_conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    pieces = conversations.render_conversations(turns, enable_thinking=PROMPTS.enable_thinking)
    return pieces.select("conv_id", "turn", "start", "n_chars", F.md5("piece").alias("digest"))


def conversation_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Of every conversation the last turns that fit a budget of characters."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    prompts = conversations.recent_prompts(conversations.render_conversations(turns), CONVERSATION_LIMIT)
    return prompts.select("conv_id", "n_turns", "n_chars", F.md5("prompt").alias("digest"))


def model_metadata(spark: SparkSession, sf: str) -> DataFrame:
    model, scheme, known = F.col("model_id"), F.col("scheme"), F.col("known_params")
    params, bits = ids.n_params(model, known), ids.bits_per_param(model, scheme)
    return load(spark, sf, "model_ids").select(
        "run_id",
        ids.quant_method(model).alias("quant_method"),
        ids.result_scheme(model, scheme).alias("result_scheme"),
        params.alias("n_params"),
        bits.alias("nbits"),
        r6(ids.vram_gb(params, bits)).alias("vram"),
        r6(ids.correct_fp8(ids.vram_gb(params, bits), model)).alias("vram_corrected"),
    )


def generate_stub(spark: SparkSession, sf: str) -> DataFrame:
    letters = load(spark, sf, "letters").withColumnRenamed("input_text", "prompt")
    answers = generate(letters, backend("stub"), 3)
    return answers.select("row_id", "run_idx", "output_text", "error")


# Extraction


def extract_query(spark: SparkSession, sf: str) -> DataFrame:
    extracted = extract_structured(load(spark, sf, "generations"))
    return extracted.select("row_id", "run_idx", F.col("record.mRS").alias("mRS"), "status", "valid")


def extract_hostile(spark: SparkSession, sf: str) -> DataFrame:
    extracted = extract_structured(load(spark, sf, "hostile"))
    return extracted.select("row_id", "run_idx", F.col("record.mRS").alias("mRS"), "status")


def extract_json5(spark: SparkSession, sf: str) -> DataFrame:
    extracted = extract_structured(load(spark, sf, "json5"), schema=JSON5_FIELDS)
    r = F.col("record")
    return extracted.select("row_id", "run_idx", r["mRS"].alias("mRS"), r["ratio"].alias("ratio"), r["note"].alias("note"), "status")


def extract_repair(spark: SparkSession, sf: str) -> DataFrame:
    cut = load(spark, sf, "truncated")
    return cut.select("row_id", "run_idx", repair_truncated(F.col("output_text")).alias("repaired"))


def extract_list_fields(spark: SparkSession, sf: str) -> DataFrame:
    extracted = extract_structured(load(spark, sf, "listings"), schema=LIST_FIELDS)
    r = F.col("record")
    return extracted.select(
        "row_id",
        r["name"].alias("name"),
        F.array_join(r["tags"], "|").alias("tags"),
        F.array_join(F.transform(r["sizes"], lambda x: x.cast("string")), "|").alias("sizes"),
        r["price"].alias("price"),
        r["stock"].alias("stock"),
        "status",
        "valid",
    )


def extraction_status(spark: SparkSession, sf: str) -> DataFrame:
    return status_counts(extract_structured(load(spark, sf, "generations")))


def event_props(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props")
    extracted = extract_structured(events, "props", (Field("k", "int", ge=0, le=80),))
    return extracted.select("event_id", F.col("record.k").alias("k"), "status", "valid")


def predictions_wide_query(spark: SparkSession, sf: str) -> DataFrame:
    return predictions_wide(extract_structured(load(spark, sf, "generations")), ["row_id"], ["mRS"], RUNS)


def validate_records(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "event_records")
    record = F.struct("event_date", "event_type", "score")
    found = violations(EVENT_FIELDS, record)
    return events.select("event_id", F.array_join(found, "|").alias("violations"), (F.size(found) == 0).alias("valid"))


# Pooling


def votes_long(spark: SparkSession, sf: str) -> DataFrame:
    votes = load(spark, sf, "votes")
    picks = [F.max(F.when(F.col("run_idx") == i, F.col("pred"))).alias(f"mRS_{i:03d}") for i in range(RUNS)]
    return pooling.wide_to_votes(votes.groupBy("row_id").agg(*picks), ["row_id"])


def pool_query(mode: str, k: int | None = None):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return pooling.pool(load(spark, sf, "votes"), mode, k)

    return query


def consensus_table(spark: SparkSession, sf: str) -> DataFrame:
    return pooling.consensus_table(load(spark, sf, "votes"), RUNS)


def attach_predictions(spark: SparkSession, sf: str) -> DataFrame:
    votes = load(spark, sf, "model_votes").withColumn("run", F.concat_ws("-", "model", "quant_scheme"))
    names = [f"{m}-{q}-{mode}" for m, q, _ in MODELS for mode in ("single", "maj_3", "maj_5", "maj_10")]
    pooled = pooling.pooled_long(votes, RUNS, ["run", "row_id"])
    table = load(spark, sf, "letters").select("row_id", "label")
    out = run_files.attach_predictions(table, pooled, "row_id", names, F.col("run"))
    return out.select("row_id", "label", *[F.col(f"`{n}`").alias(_plain(n)) for n in names])


def _plain(name: str) -> str:
    return name.replace("lab/", "").replace("-", "_").lower()


def prediction_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled predictions as arrays of one document, by position in the order of the letters, and back to rows."""
    path = scratch_path(spark, "arrays")
    places = dense_index(load(spark, sf, "letters").select("row_id"), ["row_id"], "position")
    pooled = pooling.pooled_long(load(spark, sf, "votes"), RUNS, ["row_id"]).where(F.col("mode") != "all")
    write_arrays(pooled.join(places, "row_id"), path, "y_pred", "mode", "position", "pred")
    back = read_arrays(spark, path, "y_pred").join(places, "position")
    return back.select("row_id", F.col("array").alias("mode"), F.col("value").cast("int").alias("pred"))


# Scores


def error_distance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.error_distance(load(spark, sf, "votes"), ["run_idx"]))


def metrics_by_mode(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.metrics_by_mode(load(spark, sf, "votes"), RUNS))


def error_distance_null_votes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.error_distance(load(spark, sf, "null_votes"), ["run_idx"]))


def metrics_null_votes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.metrics_by_mode(load(spark, sf, "null_votes"), RUNS))


def confusion_null_votes(spark: SparkSession, sf: str) -> DataFrame:
    counted = benchmark.pooled_cells(load(spark, sf, "null_votes"), RUNS)
    return scoring.confusion_matrix(counted, by=["mode"])


def score_generations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(benchmark.score_generations(load(spark, sf, "generations"), RUNS))


def rescore_results(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "wide-results")
    extracted = extract_structured(load(spark, sf, "generations"))
    letter_files.write_csv(predictions_wide(extracted, ["row_id", "label"], ["mRS"], RUNS), path)
    schema = ", ".join(["row_id bigint", "label int", *[f"mRS_{i:03d} int" for i in range(RUNS)]])
    return rounded(benchmark.rescore_results(letter_files.read_letters(spark, path, schema)))


def benchmark_run(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(benchmark.run_benchmark(load(spark, sf, "letters"), PROMPTS, "stub", 5))


def _stopped_run(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """Letters, and the folder of a run over them that stopped with one chunk done and another half on disk."""
    letters, path = load(spark, sf, "letters"), scratch_path(spark, "stopped")
    some = letters.where(F.col("row_id") % 3 == 0)
    done = benchmark.benchmark_answers(some, PROMPTS, "stub", 5, f"{path}/answers")
    half = done.where(F.col("run_idx") < 2).withColumn("output_text", F.lit("torn"))
    half.write.parquet(f"{path}/answers/part-lost-1")
    return letters, path


def benchmark_resumed(spark: SparkSession, sf: str) -> DataFrame:
    letters, path = _stopped_run(spark, sf)
    return rounded(benchmark.run_benchmark(letters, PROMPTS, "stub", 5, path, chunks=2))


def benchmark_log(spark: SparkSession, sf: str) -> DataFrame:
    letters, path = _stopped_run(spark, sf)
    answers = benchmark.benchmark_answers(letters, PROMPTS, "stub", 5, f"{path}/answers", chunks=2)
    cost = scoring.run_cost(benchmark.run_log(answers, "stub"))
    return cost.select("run", "n_samples", (F.col("time_per_sample") > 0).alias("timed"))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    counted = benchmark.pooled_cells(load(spark, sf, "votes"), RUNS)
    return scoring.confusion_matrix(counted, by=["mode"])


def _rater_cells(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.rater_cells(load(spark, sf, "ratings"), "expert", RATERS)


def rater_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.rater_metrics(_rater_cells(spark, sf)))


def qwk_gap(spark: SparkSession, sf: str) -> DataFrame:
    counted = agreement.rater_cells(load(spark, sf, "ratings_gap"), "expert", RATERS)
    return rounded(scoring.quadratic_kappa(counted, ["rater"]))


def broad_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.broad_class_metrics(load(spark, sf, "ratings"), "expert", RATERS))


def mae_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.mae_by_class(_rater_cells(spark, sf)))


def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.error_histogram(_rater_cells(spark, sf)))


def bland_altman(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.bland_altman(_rater_cells(spark, sf)))


def bland_altman_points(spark: SparkSession, sf: str) -> DataFrame:
    points = scoring.bland_altman_points(load(spark, sf, "ratings"), "expert", "model")
    return points.select("item_id", "mean", "diff")


def metric_sem(spark: SparkSession, sf: str) -> DataFrame:
    per_run = scoring.error_distance(load(spark, sf, "votes"), ["run_idx"])
    return rounded(scoring.mean_sem(per_run, "distance"))


def run_cost(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.run_cost(load(spark, sf, "chunk_log")))


def _linear_agreement(y, p, n) -> float:
    return float(1 - (n * abs(y - p)).sum() / (6 * n.sum()))


def custom_metric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scoring.cell_metric(_rater_cells(spark, sf), {"linear_agreement": _linear_agreement}))


# Text lengths


def _lengths(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    return lengths.length_counts(load(spark, sf, "letters"), by=by)


def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lengths.length_stats(_lengths(spark, sf, "lang"), ["lang"]))


def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lengths.length_histogram(_lengths(spark, sf)))


def length_kde(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lengths.length_kde(_lengths(spark, sf), points=200))


# Statistics


def icc3(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(significance.icc_consistency(_rater_cells(spark, sf)))


def _differences(spark: SparkSession, sf: str) -> DataFrame:
    return significance.error_differences(load(spark, sf, "ratings"), "expert", COMPARISONS)


def wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(significance.wilcoxon(_differences(spark, sf)))


def wilcoxon_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The test within each part of the catalogue: few pairs each."""
    rated = load(spark, sf, "ratings").withColumn("part", F.element_at(F.split("item_id", "-"), 3).cast("bigint"))
    differences = significance.error_differences(rated, "expert", COMPARISONS, by=["part"])
    tests = significance.wilcoxon(differences, by=["part", "comparison"], exact_upto=significance.EXACT_PAIRS)
    return rounded(tests.where("comparison = 'model vs students'").select("part", "n", "w", "p_value", "method"))


def paired_t(spark: SparkSession, sf: str) -> DataFrame:
    tests = significance.paired_t(_differences(spark, sf)).drop("bf10")
    return rounded(tests).withColumn("log_bf10", F.round("log_bf10", 3))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    report = benchmark.significance_report(load(spark, sf, "ratings"), "expert", "model", ["students", "residents"])
    return report.select(
        "comparison", "significance", r6("rbc").alias("rbc"), "bayes_interpretation", "winner"
    )


def spearman_errors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(significance.spearman_errors(load(spark, sf, "ratings"), "expert", RATERS))


def inter_rater(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.inter_rater(agreement.pair_cells(load(spark, sf, "rater_pairs"), RATER_PAIRS)))


def self_agreement(spark: SparkSession, sf: str) -> DataFrame:
    counted = agreement.self_cells(load(spark, sf, "model_votes"), (0, 9), by=["model", "quant_scheme"])
    return rounded(agreement.inter_rater(counted, ["model", "quant_scheme"]))


def bootstrap_cells(spark: SparkSession, sf: str) -> DataFrame:
    return bootstrap.bootstrap_ci(_rater_cells(spark, sf), ["qwk", "mae", "exact_acc", "tol1_acc"])


def bootstrap_broad_classes(spark: SparkSession, sf: str) -> DataFrame:
    counted = agreement.broad_class_cells(load(spark, sf, "ratings"), "expert", RATERS)
    return bootstrap.bootstrap_ci(counted, ["accuracy", "f1_macro", "f1_weighted"])


def bootstrap_halfwidth(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.run_intervals(load(spark, sf, "model_votes"), RUNS, ["model", "quant_scheme"])


def bootstrap_inter_rater(spark: SparkSession, sf: str) -> DataFrame:
    counted = agreement.pair_cells(load(spark, sf, "rater_pairs"), RATER_PAIRS)
    return bootstrap.bootstrap_ci(counted, ["qwk", "mae", "exact_acc"], ["category"])


def rater_report(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark.rater_report(load(spark, sf, "ratings"), "expert", RATERS)


def bootstrap_cells_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """What the seeded draws don't touch: estimate, size and the number of usable replicates."""
    return bootstrap_cells(spark, sf).select("rater", "metric", "n", r6("estimate").alias("estimate"), "used")


def bootstrap_inter_rater_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return bootstrap_inter_rater(spark, sf).select("category", "metric", "n", r6("estimate").alias("estimate"), "used")


def rater_report_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rater_report(spark, sf).select("rater", "n", "qwk", "mae", "exact_acc", "tol1_acc", "icc"))


def lme_suffstats(spark: SparkSession, sf: str) -> DataFrame:
    runs = load(spark, sf, "scored_runs")
    return rounded(mixed.group_size_sums(runs, "target", mixed.size_and_bits_design(), "model"))


def lme_fit(spark: SparkSession, sf: str) -> DataFrame:
    return mixed.random_intercept_fit(load(spark, sf, "scored_runs"))


# Incremental work


def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    letters = load(spark, sf, "letters")
    done = letters.where(F.col("label").isNotNull())
    return pending(letters, done).select("row_id", "patient_id", F.md5("input_text").alias("digest"))


def resumable_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run over the labelled letters, then the same run resumed over all of them."""
    path, generations = scratch_path(spark, "run"), load(spark, sf, "generations")

    def process(part: DataFrame) -> DataFrame:
        return extract_structured(part).select("row_id", "run_idx", "label", F.col("record.mRS").alias("pred"))

    key = ("row_id", "run_idx")
    run_resumable(generations.where(F.col("label").isNotNull()), process, path, key, chunks=2)
    finished = run_resumable(generations, process, path, key, chunks=2)
    return rounded(scoring.metrics_by_mode(finished, RUNS))


ATTEMPTS = ("first", "second", "third")


def resume_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Three attempts at two rows a letter. The first misses a row of every third letter and fails in one of another
    third; while the second is at work, the third starts on the same folder and ends before it."""
    letters, path, begun = load(spark, sf, "letters").select("row_id"), scratch_path(spark, "attempts"), []

    def process(part: DataFrame) -> DataFrame:
        name = ATTEMPTS[len(begun)]
        begun.append(name)
        if name == "second":
            run_resumable(letters, process, path, **two_rows)
        rows = part.select("row_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("run_idx"), F.lit(name).alias("attempt"))
        third, last = F.col("row_id") % 3, F.lit(name == "first") & (F.col("run_idx") == 1)
        return rows.where(~((third == 0) & last)).withColumn("error", F.when((third == 1) & last, "down"))

    two_rows = {"identity": ("row_id", "run_idx"), "rows_per_key": 2}
    run_resumable(letters, process, path, **two_rows)
    return run_resumable(letters, process, path, **two_rows)


def _breaks_down(prompts: list, n_repeats: int, options: dict) -> list:
    """The stub, until it is asked for a text whose digest ends in two zeros."""
    for prompt in prompts:
        if hashlib.md5(prompt.encode()).hexdigest().endswith("00"):
            time.sleep(1)
            raise RuntimeError("the generator broke down")
    return backend("stub")(prompts, n_repeats, options)


def resume_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A run whose generator breaks down, and the run that goes on: no letter is asked again whose batch was finished."""
    path = scratch_path(spark, "batches")
    letters = load(spark, sf, "letters").select("row_id", F.col("input_text").alias("prompt"))

    def asked(generator):
        return lambda part: generate(part, generator, 3).drop("seconds")

    again = {"identity": ("row_id", "run_idx"), "rows_per_key": 3, "batch_rows": 64}
    try:
        run_resumable(letters, asked(_breaks_down), path, **again)
    except PySparkException as failure:
        if "broke down" not in str(failure):
            raise
    whole = run_resumable(letters, asked(backend("stub")), path, **again)
    written = finished_rows(spark, path)[1].groupBy("row_id", "run_idx").agg(F.count(F.lit(1)).alias("times_written"))
    return whole.join(written, ["row_id", "run_idx"]).select("row_id", "run_idx", "output_text", "times_written", "error")


def stream_extract_query(spark: SparkSession, sf: str) -> DataFrame:
    source, target = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    arriving = load(spark, sf, "generations").select("row_id", "run_idx", "label", "output_text")
    arriving.repartition(4, "row_id").write.parquet(source)
    query = stream_extract(spark, source, arriving.schema, target, scratch_path(spark, "stream-state"), max_files=2)
    query.awaitTermination()
    out = spark.read.parquet(target)
    return out.select("row_id", "run_idx", F.col("record.mRS").alias("mRS"), "status", "valid")


QUERIES = {
    "scan_letters": scan_letters,
    "encrypt_roundtrip": encrypt_roundtrip,
    "sealed_letters": sealed_letters,
    "consensus_file": consensus_file,
    "report_file": report_file,
    "shuffled_letters": shuffled_letters,
    "write_read_results": write_read_results,
    "metrics_json_roundtrip": metrics_json_roundtrip,
    "pool_run_files": pool_run_files,
    "pool_run_intervals": pool_run_intervals,
    "salvage_csv": salvage_csv,
    "salvaged_lines": salvaged_lines,
    "prepare_letters": prepare_letters,
    "drop_incomplete": drop_incomplete,
    "balanced_sample": balanced_sample,
    "union_curated": union_curated,
    "build_messages": build_messages_query,
    "render_prompt": render_prompt_query,
    "prompt_budget": prompt_budget,
    "render_conversations": render_conversations,
    "conversation_prompts": conversation_prompts,
    "reasoning_audit": reasoning_audit,
    "model_metadata": model_metadata,
    "generate_stub": generate_stub,
    "extract_structured": extract_query,
    "extract_hostile": extract_hostile,
    "extract_json5": extract_json5,
    "extract_repair": extract_repair,
    "extract_list_fields": extract_list_fields,
    "extraction_status": extraction_status,
    "event_props": event_props,
    "predictions_wide": predictions_wide_query,
    "validate_records": validate_records,
    "votes_long": votes_long,
    "pool_single": pool_query("single"),
    "pool_all": pool_query("concatenation"),
    "pool_majority_3": pool_query("majority", 3),
    "pool_majority_5": pool_query("majority", 5),
    "pool_majority_10": pool_query("majority", 10),
    "consensus_table": consensus_table,
    "attach_predictions": attach_predictions,
    "prediction_arrays": prediction_arrays,
    "error_distance": error_distance,
    "metrics_by_mode": metrics_by_mode,
    "error_distance_null_votes": error_distance_null_votes,
    "metrics_null_votes": metrics_null_votes,
    "confusion_null_votes": confusion_null_votes,
    "score_generations": score_generations,
    "rescore_results": rescore_results,
    "benchmark_run": benchmark_run,
    "benchmark_resumed": benchmark_resumed,
    "benchmark_log": benchmark_log,
    "confusion_matrix": confusion_matrix,
    "rater_metrics": rater_metrics,
    "qwk_gap": qwk_gap,
    "broad_class_metrics": broad_class_metrics,
    "mae_by_class": mae_by_class,
    "error_histogram": error_histogram,
    "bland_altman": bland_altman,
    "bland_altman_points": bland_altman_points,
    "metric_sem": metric_sem,
    "run_cost": run_cost,
    "custom_metric": custom_metric,
    "length_stats": length_stats,
    "length_histogram": length_histogram,
    "length_kde": length_kde,
    "icc3": icc3,
    "wilcoxon": wilcoxon,
    "wilcoxon_exact": wilcoxon_exact,
    "paired_t": paired_t,
    "verdicts": verdicts,
    "spearman_errors": spearman_errors,
    "inter_rater": inter_rater,
    "self_agreement": self_agreement,
    "bootstrap_cells": bootstrap_cells,
    "bootstrap_broad_classes": bootstrap_broad_classes,
    "bootstrap_halfwidth": bootstrap_halfwidth,
    "bootstrap_inter_rater": bootstrap_inter_rater,
    "rater_report": rater_report,
    "bootstrap_cells_estimates": bootstrap_cells_estimates,
    "bootstrap_inter_rater_estimates": bootstrap_inter_rater_estimates,
    "rater_report_estimates": rater_report_estimates,
    "lme_suffstats": lme_suffstats,
    "lme_fit": lme_fit,
    "resume_pending": resume_pending,
    "resumable_run": resumable_run,
    "resume_attempts": resume_attempts,
    "resume_batches": resume_batches,
    "stream_extract": stream_extract_query,
}
