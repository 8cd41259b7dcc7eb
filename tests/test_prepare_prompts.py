"""Preparation, prompts and model identifiers."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallywise.functions import model_ids as ids
from tallywise.functions.prompts import (
    ChatTemplate,
    PromptConfig,
    build_messages,
    fit_prompt,
    prompt_token_limit,
    render_prompt,
    split_reasoning,
)
from tallywise.operators import prepare
from tallywise.operators.indexing import attach_dense_id, dense_index


def test_required_columns(spark):
    df = spark.createDataFrame([("t",)], "input_text string")
    with pytest.raises(KeyError, match="label"):
        prepare.require_columns(df)
    assert prepare.require_columns(df.withColumn("label", F.lit(1))).columns == ["input_text", "label"]


def test_prepare_letters(spark):
    raw = spark.createDataFrame(
        [(10, "Z", "t0", "3", "x"), (11, "A", "t1", "No FU", "x"), (12, None, "t2", "No FU yet", "x"), (13, "Z", "t3", "2", "x")],
        "no int, PatID string, lettre string, mrs string, other string",
    )
    names = {"PatID": "patient_id", "lettre": "input_text", "mrs": "label"}
    out = prepare.prepare_letters(raw, names, ["No FU", "No FU yet"], order_by="no").orderBy("no").collect()
    assert [(r.document_id, r.patient_id, r.input_text, r.label) for r in out] == [
        (0, 1, "t0", 3), (1, 0, "t1", None), (2, None, "t2", None), (3, 1, "t3", 2),
    ]
    assert set(prepare.prepare_letters(raw, names).columns) == {"patient_id", "input_text", "label"}


def test_recode_leaves_other_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    assert [r[0] for r in df.select(prepare.recode(F.col("v"), {"a": "x"})).collect()] == ["x", "b", None]


def test_dense_index_over_partitions(spark):
    keys = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(13)
    rows = dense_index(keys, ["k"], "i").collect()
    assert [r.i for r in sorted(rows, key=lambda r: r.k)] == list(range(1000))
    hot = spark.range(900).select(F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("p"))
    got = attach_dense_id(hot, "p", "n").groupBy("p").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c"))
    by_key = {r.p: r for r in got.collect()}
    assert [k for k, _ in sorted(((r.p, r.a) for r in by_key.values()), key=lambda x: x[1])] == sorted(by_key)
    assert by_key["hot"].c == 600 and all(r.a == r.b for r in by_key.values())


def test_drop_incomplete_reports(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (None, None), (3, 4)], "a int, b int")
    seen = Observation()
    assert prepare.drop_incomplete(df, ["a", "b"], seen).count() == 2
    assert seen.get == {"rows": 4, "dropped": 2}


def test_balanced_sample(spark):
    df = spark.range(500).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 50 == 0, None).when(F.col("id") < 400, 1).otherwise(F.col("id") % 7).alias("label")
    )
    counts = {r.label: r.n for r in prepare.balanced_sample(df, 5, seed=1).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == set(range(7)) and set(counts.values()) == {5}
    ids_of = lambda seed, parts: {r.row_id for r in prepare.balanced_sample(df.repartition(parts), 5, seed=seed).collect()}
    assert ids_of(1, 2) == ids_of(1, 9) != ids_of(2, 2)
    assert prepare.balanced_sample(df, 10_000).count() == 490
    shuffled = [r.row_id for r in prepare.shuffle_rows(df, seed=3).collect()]
    assert sorted(shuffled) == list(range(500)) and shuffled != sorted(shuffled)


def test_load_options(spark):
    base = spark.createDataFrame([(1, "t", 2, "e"), (2, "u", None, "e")], "row_id int, input_text string, label int, lang string")
    curated = spark.createDataFrame([(3, "v", 4), (4, "t", 2)], "row_id int, input_text string, label int")
    with pytest.raises(ValueError):
        prepare.load_for_benchmark(base, curated, use_curated=True, add_curated=True)
    assert prepare.load_for_benchmark(base, curated, use_curated=True).count() == 2
    both = prepare.load_for_benchmark(base, curated, add_curated=True, drop_unlabelled=True)
    assert sorted((r.row_id, r.lang) for r in both.collect()) == [(1, "e"), (3, None), (4, None)]
    assert prepare.load_for_benchmark(base, curated, add_curated=True, sample_per_label=1).count() == 2


CONFIG = PromptConfig(" {a} and {{b}}\n", "<{input_text}>\n", {"a": "thinking"}, {"a": "plain"})


def test_messages(spark):
    df = spark.createDataFrame([(" {input_text} {x} ",)], "input_text string")
    messages = build_messages(df, CONFIG).first().messages
    assert [tuple(m) for m in messages] == [("system", "thinking and {b}"), ("user", "< {input_text} {x} >")]
    quiet = PromptConfig(CONFIG.system_template, CONFIG.user_template, CONFIG.context, CONFIG.context_no_thinking, False)
    assert build_messages(df, quiet).first().messages[0].content == "plain and {b}"
    assert CONFIG.context == {"a": "thinking"}
    with pytest.raises(KeyError):
        build_messages(df, PromptConfig("s", "{nope}", {}))


def test_render(spark):
    df = build_messages(spark.createDataFrame([("t",)], "input_text string"), CONFIG)
    template = ChatTemplate("[{role}]", "[/]", "[go]", "[quiet]")
    assert render_prompt(df, template).first().prompt == "[system]thinking and {b}[/][user]<t>[/][go]"
    assert render_prompt(df, template, enable_thinking=False).first().prompt.endswith("[go][quiet]")
    assert render_prompt(df, template, add_generation_prompt=False).first().prompt.endswith("<t>[/]")


def test_budget(spark):
    assert prompt_token_limit(1024) == 18_876 and prompt_token_limit(50_000) == 1
    df = spark.createDataFrame([(" a  b c ",), ("a b c d",), ("",)], "prompt string")
    tail = fit_prompt(df, 0, 103).collect()
    assert [(r.n_tokens, r.truncated, r.fitted) for r in tail] == [(3, False, " a  b c "), (4, True, "b c d"), (0, False, "")]
    assert fit_prompt(df, 0, 102, keep="start").collect()[1].fitted == "a b"
    commas = fit_prompt(spark.createDataFrame([("p,q,r",)], "prompt string"), 0, 102, tokenize=lambda c: F.split(c, ","))
    assert commas.first().fitted == "q r"
    with pytest.raises(ValueError):
        fit_prompt(df, 0, keep="middle")


def test_reasoning(spark):
    rows = [
        ("<think>a b c</think>\n x ", "a b c", "x", "x", 3, True),
        ("a b</think>x</think>y", "a b", "x</think>y", "x</think>y", 2, False),
        ("<think>never closed", "never closed", None, "never closed", 2, False),
        (" x ", None, "x", "x", 0, False),
        (None, None, None, "", 0, False),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, output_text string")
    got = split_reasoning(df, budget=2).orderBy("i").collect()
    assert [(r.output_text, r.reasoning, r.content, r.answer, r.reasoning_tokens, r.over_budget) for r in got] == rows


MODELS = [
    ("org/Some-0.6B-GGUF", "Q4_K_XL", "gguf", 600_000_000, 4),
    ("org/Some-30B-A3B-GGUF", "Q8_0", "gguf", 30_000_000_000, 8),
    ("org/some-awq/large-GGUF", "IQ3_XS", "gguf", 1, 4),
    ("org/Some_7b_gptq", "F16", "gptq", 7_000_000_000, 4),
    ("org/Some-FP8", "no_quant_scheme", "fp8", 1, 8),
    ("org/Some-350M", "F16", None, 350_000_000, 16),
    ("org/Some-8 B", "BF16", None, 8_000_000_000, 0),
    ("org/Some-bnb-4bit", "fp16", None, 4_000_000_000, 16),
    ("org/Some-NVFP4", "q8_0", None, 1, 4),
    ("org/chat", "q8_0", None, 1, 8),
]


def test_model_identifiers(spark):
    df = spark.createDataFrame([(i, m[0], m[1]) for i, m in enumerate(MODELS)], "i int, id string, scheme string")
    m, s = F.col("id"), F.col("scheme")
    got = df.orderBy("i").select("id", "scheme", ids.quant_method(m), ids.n_params(m), ids.bits_per_param(m, s)).collect()
    assert [tuple(r) for r in got] == MODELS
    known = df.limit(1).select(ids.n_params(m, F.lit(None), F.lit(5)), ids.vram_gb(F.lit(8 * 1024**3), F.lit(4)))
    assert tuple(known.first()) == (5, 4.0)
