"""Conversation prompts against the rendering of whole message arrays, and a conversation of a million turns."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywise.functions.prompts import MESSAGES_TYPE, ChatTemplate, render_prompt
from tallywise.operators.conversations import recent_prompts, render_conversations

SCHEMA = "conv_id long, turn int, role string, text string"


@pytest.fixture(scope="module")
def turns(spark):
    draw = random.Random(2)
    rows = [(c, t, draw.choice(["user", "assistant"]), "wörd 😀 " * draw.randint(0, 9)) for c in range(40) for t in range(draw.randint(1, 30))]
    rows += [(None, t, "user", "x") for t in range(5)] + [(99, 0, None, None), (99, 1, "user", ""), (98, None, "user", "b"), (98, 0, "user", "a")]
    rows += [(97, 1, "user", "same")] * 3
    return spark.createDataFrame(rows, SCHEMA)


def put_together(pieces):
    by_conv = {}
    for r in sorted(pieces.collect(), key=lambda r: r.start):
        text = by_conv.setdefault(r.conv_id, "")
        assert (r.start, r.n_chars) == (len(text), len(r.piece))
        by_conv[r.conv_id] = text + r.piece
    return by_conv


@pytest.mark.parametrize("tasks, thinking, opening", [(1, True, True), (7, False, True), (23, True, False)])
def test_pieces_make_the_prompt(spark, turns, tasks, thinking, opening):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        other = turns.withColumns({c: F.lit("z") for c in ("conv", "piece", "_slot", "c", "s")})
        got = put_together(render_conversations(other, ChatTemplate(), opening, thinking))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    arrays = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("m"))
    arrays = arrays.withColumn("messages", F.transform("m", lambda x: F.struct(x["role"], x["content"])).cast(MESSAGES_TYPE))
    arrays = arrays.where("conv_id is null or conv_id <> 98")
    whole = {r.conv_id: r.prompt for r in render_prompt(arrays, ChatTemplate(), opening, thinking).collect()}
    first_null = got.pop(98)
    assert got == whole and first_null.index("b<") < first_null.index("a<")


def test_no_turns(spark, turns):
    assert render_conversations(turns.limit(0)).count() == 0


def test_recent_prompts(spark, turns):
    pieces = render_conversations(turns)
    whole = put_together(pieces)
    for limit in (0, 90, 400, 10**6):
        for r in recent_prompts(pieces, limit).collect():
            assert r.n_chars == len(r.prompt) <= limit and whole[r.conv_id].endswith(r.prompt)
            assert limit < 10**6 or r.prompt == whole[r.conv_id]
    assert recent_prompts(pieces, 90).count() == len(whole)


def test_a_million_turns(spark):
    """One conversation holds nearly all rows; it is rendered by several tasks."""
    long = spark.range(1_000_000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"))
    short = spark.range(3000).select((F.col("id") % 300 + 8).alias("conv_id"), (F.col("id") / 300).cast("int").alias("turn"))
    turns = long.union(short).withColumn("role", F.lit("user")).withColumn("text", F.repeat(F.lit("x"), F.col("turn") % 10))
    pieces = render_conversations(turns, add_generation_prompt=False)
    running = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    checked = pieces.withColumn("expected", F.coalesce(F.sum("n_chars").over(running), F.lit(0)))
    assert checked.agg(F.count(F.lit(1)), F.count_if(F.col("start") != F.col("expected"))).first()[:] == (1_003_000, 0)
    tagged = pieces.inputFiles()
    assert len(tagged) > 1
