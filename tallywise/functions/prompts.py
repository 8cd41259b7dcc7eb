"""Prompt tables: messages, rendered prompts, token budget and the split of reasoning from the answer."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.functions.text import NO_SPACE, SPACE, strip, word_count, words

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class PromptConfig:
    """Templates with ``{name}`` slots. ``context_no_thinking`` replaces context entries when thinking is off."""

    system_template: str
    user_template: str
    context: Mapping[str, str]
    context_no_thinking: Mapping[str, str] = field(default_factory=dict)
    enable_thinking: bool = True

    def system_text(self) -> str:
        context = dict(self.context)
        if not self.enable_thinking:
            context |= self.context_no_thinking
        return self.system_template.format(**context).strip()


def fill_template(template: str, slots: Mapping[str, Column]) -> Column:
    """Template with its slots replaced by columns. Braces inside the data stay as they are."""
    parts = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{") and piece.endswith("}"):
            if piece[1:-1] not in slots:
                raise KeyError(piece[1:-1])
            parts.append(slots[piece[1:-1]])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def build_messages(df: DataFrame, config: PromptConfig, text_col: str = "input_text") -> DataFrame:
    """Add ``messages``: the system message, equal for all rows, and the user message of the row."""
    user = strip(fill_template(config.user_template, {"input_text": F.col(text_col)}))
    pair = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(config.system_text()).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
    return df.withColumn("messages", pair.cast(MESSAGES_TYPE))


@dataclass(frozen=True)
class ChatTemplate:
    """Markers around each message. ``{role}`` in ``opening`` becomes the role of the message."""

    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    generation: str = "<|im_start|>assistant\n"
    no_thinking: str = "<think>\n\n</think>\n\n"


def render_prompt(
    df: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    add_generation_prompt: bool = True,
    enable_thinking: bool = True,
) -> DataFrame:
    """Add ``prompt``: the messages as one string."""

    def one(message: Column) -> Column:
        head = fill_template(template.opening, {"role": message["role"]})
        return F.concat(head, message["content"], F.lit(template.closing))

    tail = ""
    if add_generation_prompt:
        tail = template.generation + ("" if enable_thinking else template.no_thinking)
    body = F.array_join(F.transform(F.col("messages"), one), "")
    return df.withColumn("prompt", F.concat(body, F.lit(tail)))


def prompt_token_limit(max_new_tokens: int, max_context: int = 20_000, reserve: int = 100) -> int:
    return max(1, max_context - max_new_tokens - reserve)


def fit_prompt(
    df: DataFrame,
    max_new_tokens: int,
    max_context: int = 20_000,
    text_col: str = "prompt",
    keep: str = "end",
    tokenize: Callable[[Column], Column] = words,
) -> DataFrame:
    """Cut prompts to the token budget. Adds ``n_tokens``, ``truncated`` and ``fitted``.

    ``keep`` names the side that survives; a prompt within the budget is left untouched. ``tokenize`` turns text into
    an array of tokens, white space separated words by default. Words keep the white space between them; tokens of another
    function are put together with blanks.
    """
    if keep not in ("start", "end"):
        raise ValueError("keep must be 'start' or 'end'")
    limit = prompt_token_limit(max_new_tokens, max_context)
    tokens, by_words = F.col("_tokens"), tokenize is words
    # a word and the white space before it make one part, so joined parts are the text itself
    parts = F.regexp_extract_all(F.col(text_col), F.lit(f"{SPACE}*{NO_SPACE}+"), F.lit(0)) if by_words else tokens
    kept = F.slice(parts, 1, limit) if keep == "start" else F.slice(parts, -limit, limit)
    joined = F.array_join(kept, "" if by_words else " ")
    if by_words and keep == "end":
        joined = F.regexp_replace(joined, f"^{SPACE}+", "")
    # words are only counted; the text is cut up where a prompt is too long
    out = df if by_words else df.withColumn("_tokens", tokenize(F.col(text_col)))
    n_tokens = word_count(F.col(text_col)) if by_words else F.size(tokens).cast("bigint")
    out = out.withColumn("n_tokens", n_tokens).withColumn("truncated", F.col("n_tokens") > limit)
    fitted = F.when(F.col("truncated"), joined).otherwise(F.col(text_col))
    return out.withColumn("fitted", fitted).drop("_tokens")


def split_reasoning(
    df: DataFrame,
    text_col: str = "output_text",
    budget: int | None = None,
    count_tokens: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """Add ``reasoning``, ``content``, ``answer``, ``reasoning_tokens`` and ``over_budget``.

    The answer is the content, else the reasoning, else an empty string. A reasoning block that never closes leaves the
    content null.
    """
    text = F.col(text_col)
    closed = text.contains("</think>")
    opened = strip(text).startswith("<think>")
    before = F.when(closed, F.substring_index(text, "</think>", 1)).when(opened, text)
    reasoning = strip(F.regexp_replace(before, r"^\s*<think>", ""))
    after = F.substr(text, F.instr(text, "</think>") + F.lit(len("</think>")))
    out = df.withColumn("reasoning", reasoning)
    out = out.withColumn("content", F.when(closed, strip(after)).when(~opened, strip(text)))
    out = out.withColumn("answer", F.coalesce("content", "reasoning", F.lit("")))
    out = out.withColumn("reasoning_tokens", F.coalesce(count_tokens(F.col("reasoning")), F.lit(0).cast("bigint")))
    over = F.col("reasoning_tokens") > budget if budget is not None else F.lit(False)
    return out.withColumn("over_budget", over)
