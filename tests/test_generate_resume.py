"""Generation, retries, resumable runs and the stream."""

import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallywise.functions.extraction import extract_structured
from tallywise.operators import generate as g
from tallywise.operators.scratch import scratch_path
from tallywise.plans import benchmark, catalog
from tallywise.streaming.journal import Journal, put_if_absent
from tallywise.streaming.resume import finished_rows, pending, run_resumable, stream_extract


@pytest.fixture
def echo():
    return lambda prompts, n, options: [[f" {p}-{i}\n" for i in range(n)] for p in prompts]


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.range(25).select(F.col("id").alias("row_id"), F.concat(F.lit("p"), "id").alias("prompt")).repartition(3)


def test_answers_in_order_and_stripped(prompts, echo):
    rows = g.generate(prompts, echo, 3, batch_size=4, threads=3, partitions=2).collect()
    assert sorted((r.row_id, r.run_idx, r.output_text) for r in rows) == [
        (i, k, f"p{i}-{k}") for i in range(25) for k in range(3)
    ]


def test_null_answers_are_empty(prompts):
    rows = g.generate(prompts, lambda p, n, o: [[None] * n for _ in p], 1).collect()
    assert {(r.output_text, r.error) for r in rows} == {("", None)}


def test_retry_waits_and_gives_up(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(g.time, "sleep", waits.append)

    def flaky(fail_times):
        calls.append(1)
        if len(calls) <= fail_times:
            raise ConnectionError("down")
        return "ok"

    assert g.Retry().call(flaky, 4) == "ok" and waits == [1, 2, 4, 8]
    calls.clear()
    with pytest.raises(ConnectionError):
        g.Retry().call(flaky, 9)
    assert len(calls) == 5
    calls.clear()
    with pytest.raises(KeyError):
        g.Retry().call(lambda: calls.append(1) or {}["x"])
    assert len(calls) == 1
    assert max(g.Retry(attempts=9).longest_wait for _ in [0]) == 16


def test_errors_can_become_rows(prompts, echo):
    def broken(p, n, o):
        raise ConnectionError("down")

    quick = g.Retry(attempts=2, first_wait=0.0, longest_wait=0.0)
    rows = g.generate(prompts, broken, 2, retry=quick, on_error="null").collect()
    assert len(rows) == 50 and {(r.output_text, r.error) for r in rows} == {(None, "ConnectionError: down")}
    with pytest.raises(Exception, match="down"):
        g.generate(prompts, broken, 2, retry=quick).collect()
    with pytest.raises(Exception, match="must return 2 answers"):
        g.generate(prompts, lambda p, n, o: [["x"]] * len(p), 2).collect()
    with pytest.raises(ValueError):
        g.generate(prompts, echo, 1, on_error="ignore")


def test_options_and_backends(prompts):
    assert g.request_options() == {}
    options = g.request_options("PatientInfoSchema", enable_thinking=False, max_thinking_tokens=7)
    assert options["enable_thinking"] is False and options["max_thinking_tokens"] == 7 and '"mRS"' in options["json_schema"]
    with pytest.raises(ValueError, match="no backend is registered as 'nope'"):
        g.backend("nope")
    with pytest.raises(ValueError, match="no schema is registered as 'nope'"):
        g.request_options("nope")
    g.register_backend("options", lambda p, n, o: [[str(sorted(o))] * n for _ in p])
    row = g.generate_table(prompts, "options", 1, "PatientInfoSchema", enable_thinking=False).first()
    assert (row.output_text, row.schema_name, row.thinking) == ("['enable_thinking', 'json_schema']", "PatientInfoSchema", False)


def test_benchmark_from_letters_to_scores(spark):
    letters = spark.createDataFrame([(i, f"text {i}", i % 7) for i in range(30)], "row_id int, input_text string, label int")
    g.register_backend("oracle", lambda p, n, o: [['{"mRS": %d}' % (int(x.split("text ")[1].split("\n")[0]) % 7)] * n for x in p])
    rows = benchmark.run_benchmark(letters, catalog.PROMPTS, "oracle", 3).collect()
    assert {r.mode for r in rows} == {"all", "single", "maj_3"} and {r.error_rate for r in rows} == {0.0}


def test_pending(spark):
    letters = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "row_id int, input_text string")
    done = spark.createDataFrame([("a",), ("a",), (None,)], "input_text string")
    assert sorted(r.row_id for r in pending(letters, done).collect()) == [2, 4, 5]
    assert sorted(r.row_id for r in pending(letters, letters.where("row_id < 3"), "row_id").collect()) == [3, 4, 5]


def test_resume_processes_each_row_once(spark):
    path = scratch_path(spark, "t")
    seen = spark.sparkContext.accumulator(0)

    def process(part):
        def count(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame

        return part.mapInPandas(count, part.schema)

    letters = spark.range(60).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), "id").alias("input_text"))
    assert run_resumable(letters.where("row_id < 20"), process, path, chunks=3).count() == 20
    assert run_resumable(letters, process, path, chunks=4).count() == 60
    assert run_resumable(letters, process, path).count() == 60
    assert seen.value == 60
    assert run_resumable(letters.where("row_id < 5"), process, path, resume=False, chunks=2).count() == 5


def test_a_crash_keeps_finished_chunks(spark):
    path = scratch_path(spark, "t")
    letters = spark.range(40).select(F.col("id").alias("row_id"), F.concat(F.lit("t"), "id").alias("input_text"))
    calls = []

    def process(part):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return part

    with pytest.raises(RuntimeError):
        run_resumable(letters, process, path, chunks=4)
    _, kept = finished_rows(spark, path)
    assert 0 < kept.count() < 40
    letters.limit(7).write.parquet(f"{path}/part-lost-9")
    calls.extend([1, 1, 1])
    assert run_resumable(letters, process, path, chunks=4).select("row_id").distinct().count() == 40
    assert finished_rows(spark, path)[1].count() == 40


def test_half_a_key_and_errors_stay_pending(spark):
    path, asked = scratch_path(spark, "t"), []
    letters = spark.range(6).select(F.col("id").alias("row_id"))

    def process(part):
        asked.append(sorted(r.row_id for r in part.collect()))
        runs = part.select("row_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("run_idx"))
        lost = (F.col("row_id") == 2) & (F.col("run_idx") == 1) & F.lit(len(asked) == 1)
        return runs.withColumn("error", F.when(lost, "down")).withColumn("attempt", F.lit(len(asked)))

    again = dict(identity=("row_id", "run_idx"), rows_per_key=2)
    first = run_resumable(letters.where("row_id < 4"), process, path, **again)
    assert (first.count(), first.where("error is not null").count()) == (8, 1)
    last = run_resumable(letters, process, path, **again)
    assert asked == [[0, 1, 2, 3], [2, 4, 5]]
    assert sorted((r.row_id, r.run_idx) for r in last.where("error is null").collect()) == [(i, k) for i in range(6) for k in (0, 1)]
    assert last.count() == 12


def test_attempts_never_mix(spark):
    """A whole later attempt takes the place of a broken one, row by row and with rows that no error marks."""
    path, letters = scratch_path(spark, "t"), spark.range(3).select(F.col("id").alias("row_id"))
    names = iter(["old", "new"])

    def process(part):
        name = next(names)
        runs = part.select("row_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("run_idx"), F.lit(name).alias("by"))
        return runs.where(~((F.col("row_id") == 1) & (F.col("run_idx") == 1) & F.lit(name == "old")))

    again = dict(identity=("row_id", "run_idx"), rows_per_key=2)
    assert run_resumable(letters, process, path, **again).count() == 5
    rows = sorted(tuple(r) for r in run_resumable(letters, process, path, **again).collect())
    assert rows == [(i, k, "new" if i == 1 else "old") for i in range(3) for k in (0, 1)]


def test_repeated_and_null_keys_over_attempts(spark):
    path = scratch_path(spark, "t")
    letters = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "row_id int, text string")
    assert run_resumable(letters, lambda part: part, path).count() == 5
    more = letters.union(spark.createDataFrame([(3, "f")], letters.schema))
    rows = run_resumable(more, lambda part: part, path, chunks=2).collect()
    assert sorted(map(str, rows)) == sorted(map(str, more.collect()))
    assert run_resumable(letters.limit(0), lambda part: part, scratch_path(spark, "t"), batch_rows=3).count() == 0


def test_two_runs_on_one_folder(spark):
    path, letters = scratch_path(spark, "t"), spark.range(30).select(F.col("id").alias("row_id"))

    def run(name):
        return run_resumable(letters, lambda part: part.withColumn("by", F.lit(name)), path, chunks=2).count()

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(run, "abcd"))
    rows = run_resumable(letters, lambda part: part.withColumn("by", F.lit("e")), path).collect()
    assert sorted(r.row_id for r in rows) == list(range(30)) and all(r.by != "e" for r in rows)
    entries = Journal(spark, path).entries()
    assert sorted(e.attempt for e in entries if e.state == "begun") == [1, 2, 3, 4, 5]
    assert sum(e.state == "finished" for e in entries) == 9


def test_put_if_absent_lets_one_in(spark):
    path = scratch_path(spark, "t") + "/entry.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: (put_if_absent(spark, path, f"by {i}"), i), range(16)))
    assert [f"by {i}" for first, i in won if first] == [spark.read.text(path).first().value]


def test_put_if_absent_on_other_file_systems(spark):
    """The way by renames, through a scheme of its own."""
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.t.link./x", "file:" + scratch_path(spark, "t"))
    assert put_if_absent(spark, "viewfs://t/x/journal/0.json", "one")
    assert not put_if_absent(spark, "viewfs://t/x/journal/0.json", "two")
    files = spark.read.text("viewfs://t/x/journal").collect()
    assert [r.value for r in files] == ["one"]


def test_finished_batches_outlive_a_crash(spark):
    path, asked = scratch_path(spark, "t"), spark.sparkContext.accumulator(0)
    letters = spark.range(200).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("prompt"))

    def dies(prompts, n, options):
        if "199" in prompts:
            time.sleep(2)
            raise RuntimeError("broke down")
        return [[p] * n for p in prompts]

    def counted(prompts, n, options):
        asked.add(len(prompts))
        return [[p] * n for p in prompts]

    def run(generator):
        ask = lambda part: g.generate(part, generator, 2)
        return run_resumable(letters, ask, path, identity=("row_id", "run_idx"), rows_per_key=2, batch_rows=10)

    with pytest.raises(PySparkException, match="broke down"):
        run(dies)
    kept = finished_rows(spark, path)[1].select("row_id").distinct().count()
    assert 0 < kept < 200
    whole = run(counted)
    assert asked.value == 200 - kept
    assert sorted((r.row_id, r.run_idx, r.output_text) for r in whole.collect()) == [(i, k, str(i)) for i in range(200) for k in (0, 1)]
    assert run(dies).count() == 400  # nothing is left to ask


def test_one_bad_prompt_spoils_no_other(spark):
    def picky(prompts, n, options):
        if any(p.endswith("3") for p in prompts):
            raise ConnectionError("no")
        return [[p] * n for p in prompts]

    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(8)], "row_id int, prompt string").coalesce(1)
    quick = g.Retry(attempts=1)
    rows = g.generate(prompts, picky, 2, retry=quick, on_error="null").collect()
    assert {r.row_id for r in rows if r.error} == {3} and all(r.seconds >= 0 for r in rows)
    assert sorted(r.output_text for r in rows if not r.error) == sorted(f"p{i}" for i in range(8) for _ in (0, 1) if i != 3)


def test_stopped_benchmark_goes_on(spark):
    path, calls = scratch_path(spark, "t"), spark.sparkContext.accumulator(0)
    letters = spark.createDataFrame([(i, f"text {i}", i % 7) for i in range(20)], "row_id int, input_text string, label int")

    def counted(prompts, n, options):
        calls.add(len(prompts))
        return [['{"mRS": 1}'] * n for _ in prompts]

    g.register_backend("counted", counted)
    benchmark.run_benchmark(letters.where("row_id < 12"), catalog.PROMPTS, "counted", 3, path)
    scores = benchmark.run_benchmark(letters, catalog.PROMPTS, "counted", 3, path, chunks=2, partitions=2)
    assert calls.value == 20 and {r.n for r in scores.collect()} == {20, 60}
    assert spark.read.parquet(f"{path}/scores").count() == 3


def test_stream_equals_batch_and_continues(spark):
    source, target, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    schema = "row_id int, run_idx int, label int, output_text string"
    answers = [(i, r, i % 7, '{"mRS": %d' % (r % 7)) for i in range(40) for r in range(3)]
    df = spark.createDataFrame(answers, schema)
    df.where("row_id < 25").repartition(5).write.parquet(source)
    stream_extract(spark, source, schema, target, state, max_files=2).awaitTermination()
    assert spark.read.parquet(target).count() == 75
    df.where("row_id >= 25").write.mode("append").parquet(source)
    stream_extract(spark, source, schema, target, state, max_files=2).awaitTermination()
    streamed = spark.read.parquet(target).select("row_id", "run_idx", "record", "status", "valid")
    batch = extract_structured(df).select("row_id", "run_idx", "record", "status", "valid")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
    assert spark.read.parquet(target).select("batch_id").distinct().count() >= 3
