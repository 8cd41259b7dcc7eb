"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.batches import quoted, with_computed
from tallywise.llm.components import connected
from tallywise.llm.membership import maybe_among
from tallywise.operators.scratch import durable

_BITS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 14  # shingles that are summed at a time


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """64 bits, each set if it is set in over half of the XXH64 hashes of the text's word shingles, repeats included.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A text of fewer words is one shingle, a text
    without words has fingerprint zero.
    """
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, hashed = len(words) - width + 1, xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[width - 1 :].tolist())
    hashes = np.fromiter((hashed(joined[a:b], seed) for a, b in spans), np.uint64, n).astype(">u8")
    counts = np.zeros(_BITS, np.int64)
    for low in range(0, n, _BLOCK):
        block = hashes[low : low + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with ``simhash``, the fingerprint of the whole text as a signed long. A null text counts as empty."""

    def start():
        def compute(b: pa.RecordBatch) -> list:
            found = [fingerprint(t.as_py() or "", shingle, seed) for t in b.column(text_col)]
            return [pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())]

        return compute

    return with_computed(docs, "simhash long", start)


def segments_and_balls(distance: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """(shift, bits, masks) of the segments to look at.

    Two fingerprints within ``distance`` = segments * base + extra differ by at most ``base`` bits in one of the first
    extra + 1 segments, or by at most base - 1 bits in one of the others. The masks turn a segment's value into every
    value of that ball.
    """
    base, extra = divmod(distance, segments)
    found, shift = [], 0
    for s in range(segments):
        bits = _BITS // segments + (s < _BITS % segments)
        radius = base if s <= extra else base - 1
        if radius >= 0:
            masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
            found.append((shift, bits, masks))
        shift += bits
    return found


def links_within(prints: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """``a`` > ``b``: ids of all pairs of ``prints`` (distinct ``simhash``, ``id``) at most ``distance`` bits apart.

    Every fingerprint stands in one table under each of its segments and looks there for all values in the small Hamming
    ball around its own; the whole distance is part of the join condition, so false candidates leave no row. A pair that
    meets in several segments appears more than once.
    """
    parts = segments_and_balls(distance, segments)

    def key(s: int, mask=None):
        shift, bits, _ = parts[s]
        value = F.shiftrightunsigned("simhash", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        value = value if mask is None else value.bitwiseXOR(mask)
        return F.struct(F.lit(s).cast("byte").alias("segment"), value.alias("value"))

    table = F.array(*(key(s) for s in range(len(parts))))

    def ball(s: int):
        masks = F.split(F.lit(",".join(map(str, parts[s][2]))), ",").cast("array<bigint>")
        return F.transform(masks, lambda mask: key(s, mask))

    balls = [ball(s) for s in range(len(parts))]
    stored = prints.select(F.explode(table).alias("k"), F.col("simhash").alias("y"), F.col("id").alias("iy"))
    asked = prints.select(F.explode(F.concat(*balls)).alias("k"), F.col("simhash").alias("x"), F.col("id").alias("ix"))
    stored, asked = (d.select("k.segment", "k.value", *d.columns[1:]) for d in (stored, asked))
    near = (F.col("x") > F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance)
    met = asked.alias("l").join(
        stored.alias("r"), (F.col("l.segment") == F.col("r.segment")) & (F.col("l.value") == F.col("r.value")) & near
    )
    return met.select(F.greatest("ix", "iy").alias("a"), F.least("ix", "iy").alias("b"))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    distance: int = 4,
    seed: int = 42,
    segments: int = 3,
) -> DataFrame:
    """``id_col``, ``simhash`` and ``component_id``, the smallest id reachable over links of at most ``distance`` bits.

    Documents with equal fingerprints are one node before any pair is looked for, so groups of copies cost one row each.
    Three segments suit up to some hundred million different fingerprints; two cost more probes and suit more.

    One row per row of ``docs``; rows with equal ids each have their own fingerprint and link through it. A null text
    counts as empty. Rows with a null id are members of the component of their fingerprint (null if no other row has it)
    and link nothing themselves. An empty table gives an empty result. Other columns are not read and do not pass.
    """
    narrow = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    hashed = durable(fingerprints(narrow, "text", shingle, seed).drop("text"), "simhash")
    prints = durable(hashed.groupBy("simhash").agg(F.min(id_col).alias("id")), "prints")
    nodes = prints.where(F.col("id").isNotNull())
    # an id that has several fingerprints is one node through each of them
    shared = hashed.where(F.col(id_col).isNotNull()).join(nodes, "simhash")
    own = shared.where(F.col(id_col) != F.col("id")).select(F.col(id_col).alias("a"), F.col("id").alias("b"))
    several = hashed.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("simhash").alias("s"), F.max("simhash").alias("t"))
    several = several.where(F.col("s") != F.col("t")).select(F.col(id_col).alias("a"))
    links = links_within(nodes, distance, segments).union(own.join(several, "a", "left_semi"))
    roots = connected(links)
    named = prints.join(roots, prints["id"] == roots["node"], "left")
    named = named.select("simhash", F.coalesce("root", "id").alias("component_id"))
    return hashed.join(named, "simhash").select(id_col, "simhash", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of ``near_groups``: the one with the smallest id, once.

    Rows with a null id all stay. Only documents that may go, or whose id stands in several rows, are shuffled. All columns
    pass, whatever their names.
    """
    groups = durable(near_groups(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull()), "groups")
    odd = groups.groupBy(F.col(id_col).alias("_id")).agg(
        F.min("component_id").alias("_component"), F.count(F.lit(1)).alias("_rows")
    )
    odd = durable(odd.where((F.col("_component") != F.col("_id")) | (F.col("_rows") > 1)), "odd")
    # the row travels as one struct, so that its columns may have any names
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*map(quoted, docs.columns)).alias("row"))
    marked = maybe_among(rows, "id", odd.select("_id"))
    looked_up = marked.where("hit").join(odd, marked["id"] == odd["_id"], "left")
    stays = F.coalesce(F.col("_component") == F.col("_id"), F.lit(True))
    several = F.coalesce(F.col("_rows") > 1, F.lit(False))
    once = looked_up.where(stays & ~several).select("row")
    repeated = looked_up.where(stays & several).dropDuplicates(["id"]).select("row")
    return marked.where(~F.col("hit")).select("row").union(once).union(repeated).select("row.*")
