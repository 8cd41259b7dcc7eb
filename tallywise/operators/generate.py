"""Distributed generation: a user's callable over prompt batches, with retries and a long output table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.functions.schemas import json_schema
from tallywise.operators.scratch import durable

# (prompts, number of answers per prompt, options) -> one list of answers per prompt
Generator = Callable[[Sequence, int, Mapping], Sequence[Sequence[str | None]]]


class Mismatch(ValueError):
    """A generator gave another number of answers than was asked for; trying again won't help."""


@dataclass(frozen=True)
class Retry:
    """Attempts with exponentially growing pauses for the error types that may pass."""

    attempts: int = 5
    first_wait: float = 1.0
    longest_wait: float = 16.0
    errors: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)

    def call(self, function: Callable, *args):
        for attempt in range(1, self.attempts + 1):
            try:
                return function(*args)
            except self.errors:
                if attempt == self.attempts:
                    raise
                time.sleep(min(self.longest_wait, max(self.first_wait, 2.0 ** (attempt - 1))))


def request_options(
    schema_name: str | None = None, enable_thinking: bool = True, max_thinking_tokens: int | None = None
) -> dict:
    """Options that go with each request; entries without effect are left out."""
    options: dict = {}
    if not enable_thinking:
        options["enable_thinking"] = False
    if max_thinking_tokens is not None:
        options["max_thinking_tokens"] = max_thinking_tokens
    if schema_name is not None:
        options["json_schema"] = json_schema(schema_name)
    return options


def generate(
    df: DataFrame,
    generator: Generator,
    n_repeats: int,
    id_cols: Sequence[str] = ("row_id",),
    prompt_col: str = "prompt",
    batch_size: int = 64,
    options: Mapping | None = None,
    retry: Retry = Retry(),
    on_error: str = "raise",
    threads: int = 1,
    partitions: int | None = None,
) -> DataFrame:
    """``(id…, run_idx, output_text, error, seconds)``: ``n_repeats`` stripped answers per prompt, in order.

    Tasks call the generator on batches of prompts; ``threads`` calls run at a time in a task, and ``partitions`` bounds
    the number of tasks, so their product bounds the requests in flight. With ``on_error="null"`` the prompts of a batch that
    fails after all retries are tried one by one, and one that fails alone yields null answers and the error text.
    ``seconds`` is the wall time of the call, shared among its prompts. The callable is costly: materialise the result once.
    """
    if on_error not in ("raise", "null"):
        raise ValueError("on_error must be 'raise' or 'null'")
    ids, opts = list(id_cols), dict(options or {})

    def asked(prompts: list) -> Sequence[Sequence[str | None]]:
        result = retry.call(generator, prompts, n_repeats, opts)
        if len(result) != len(prompts) or any(len(r) != n_repeats for r in result):
            raise Mismatch(f"the generator must return {n_repeats} answers for each of {len(prompts)} prompts")
        return result

    def answers(prompts: list) -> list[tuple[Sequence[str | None], str | None, float]]:
        """Answers, error and seconds of each prompt."""
        start = time.perf_counter()
        try:
            result = asked(prompts)
        except Mismatch:
            raise
        except Exception as failure:
            if on_error == "raise":
                raise
            if len(prompts) > 1:
                return [one for p in prompts for one in answers([p])]
            return [([None] * n_repeats, f"{type(failure).__name__}: {failure}", time.perf_counter() - start)]
        spent = (time.perf_counter() - start) / max(1, len(prompts))
        return [(texts, None, spent) for texts in result]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max_workers=threads) as pool:
            for frame in frames:
                pieces = [frame.iloc[i : i + batch_size] for i in range(0, len(frame), batch_size)]
                for piece, found in zip(pieces, pool.map(answers, [p[prompt_col].tolist() for p in pieces])):
                    out = piece[ids].loc[piece.index.repeat(n_repeats)].reset_index(drop=True)
                    out["run_idx"] = list(range(n_repeats)) * len(piece)
                    out["output_text"] = [None if error else (t or "").strip() for texts, error, _ in found for t in texts]
                    out["error"] = [error for _, error, _ in found for _ in range(n_repeats)]
                    out["seconds"] = [spent for _, _, spent in found for _ in range(n_repeats)]
                    yield out

    source = df.select(*ids, prompt_col)
    if partitions is not None:
        source = source.repartition(partitions)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*ids).schema)
    return source.mapInPandas(run, f"{keys}, run_idx int, output_text string, error string, seconds double")


BACKENDS: dict[str, Generator] = {}


def register_backend(name: str, generator: Generator) -> None:
    BACKENDS[name] = generator


def backend(name: str) -> Generator:
    if name not in BACKENDS:
        raise ValueError(f"no backend is registered as {name!r}")
    return BACKENDS[name]


def backend_answers(
    df: DataFrame,
    backend_name: str,
    n_repeats: int,
    schema_name: str | None = None,
    enable_thinking: bool = True,
    max_thinking_tokens: int | None = None,
    **settings,
) -> DataFrame:
    """Answers of a registered backend with the request settings as columns, not yet materialised."""
    options = request_options(schema_name, enable_thinking, max_thinking_tokens)
    answers = generate(df, backend(backend_name), n_repeats, options=options, **settings)
    return answers.withColumn("schema_name", F.lit(schema_name)).withColumn("thinking", F.lit(enable_thinking))


def generate_table(df: DataFrame, backend_name: str, n_repeats: int, *request, **settings) -> DataFrame:
    """``backend_answers``, written once and read back."""
    return durable(backend_answers(df, backend_name, n_repeats, *request, **settings), "generations")


def hashed_answers(prompts: Sequence[str], n_repeats: int, options: Mapping) -> list[list[str]]:
    """Deterministic stand-in for a model: answers come from a hash of the prompt and the run number."""
    import hashlib

    def one(prompt: str, run: int) -> str:
        digest = hashlib.md5(f"{run}-{prompt}".encode()).hexdigest()
        return ' {"mRS": %d}\n' % (int(digest[:7], 16) % 7)

    return [[one(p, r) for r in range(n_repeats)] for p in prompts]


register_backend("stub", hashed_answers)
