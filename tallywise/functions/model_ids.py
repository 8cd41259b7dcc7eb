"""What a model identifier says about the model: quantisation, size, bits per parameter, memory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The quantisation keywords looked for in a model identifier. The patterns for sizes and schemes below are
# fixed too: they are the grammar of such identifiers.
QUANT_METHODS = ("awq", "gptq", "gguf", "fp8", "eetq", "aqlm", "hqq")


def quant_method(model_id: Column) -> Column:
    """Right-most known keyword among the parts of the identifier, or null."""
    parts = F.reverse(F.split(F.lower(model_id), "[/_-]"))
    return F.get(F.filter(parts, lambda p: p.isin(*QUANT_METHODS)), F.lit(0))


def n_params(model_id: Column, *known: Column) -> Column:
    """Parameter count: the first known value, else the first number before B, else before M, else 1.

    A number that is too large for a count is passed over.
    """
    billions = F.regexp_extract(model_id, r"(?i)(\d+(?:\.\d+)?)[ ]?B", 1).try_cast("double")
    millions = F.regexp_extract(model_id, r"(?i)(\d+(?:\.\d+)?)[ ]?M", 1).try_cast("double")
    guessed = F.coalesce((billions * 1e9).try_cast("bigint"), (millions * 1e6).try_cast("bigint"), F.lit(1).cast("bigint"))
    return F.coalesce(*[k.try_cast("bigint") for k in known], guessed)


def bits_per_param(model_id: Column, scheme: Column) -> Column:
    """Bits per parameter from the identifier, else from the quantisation scheme, else 0."""
    lowered, kind = F.lower(model_id), F.lower(scheme)
    digits = F.regexp_extract(scheme, r"^(?:I?Q)(\d+)", 1).try_cast("int")
    return (
        F.when(lowered.rlike("gptq|awq|fp4"), 4)
        .when(lowered.contains("fp8"), 8)
        .when(digits.isNotNull(), digits)
        .when(kind.isin("f16", "fp16"), 16)
        .when(kind == "q8_0", 8)
        .otherwise(0)
        .cast("int")
    )


def vram_gb(params: Column, bits: Column) -> Column:
    """Memory of the weights in GiB."""
    return params.cast("double") * bits / F.lit(8.0 * 1024**3)


def result_scheme(model_id: Column, scheme: Column) -> Column:
    """Scheme part of a result path: the given scheme for gguf models, a fixed word for all others."""
    return F.when(quant_method(model_id) == "gguf", scheme).otherwise(F.lit("no_quant_scheme"))


def correct_fp8(value: Column, path: Column) -> Column:
    """Runs whose path names fp8 recorded half of their bits and memory."""
    return F.when(F.lower(path).contains("fp8"), value * 2).otherwise(value)
