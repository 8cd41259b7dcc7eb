"""Removal of repeated byte strings, with sparse suffix arrays sorted deep-shallow."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.batches import kept_by_worker, quoted
from tallywise.llm.membership import maybe_among
from tallywise.operators.scratch import durable

_BASE, _MIX, _SPREAD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK = 1 << 19  # bytes of text that a task works on at a time (or one longer document)
_BUCKET = 12 << 20  # bytes of text for each bucket of seeds
_FLUSH = 1 << 19  # runs that a task packs at a time
_EDGES = 20000  # open runs for each bucket of the suffix sort, on average
_CROWD = 50000  # open runs of one seed that one task sorts
_CROWDS = 1_000_000  # seeds with more than that, at most
_SEED_FIELDS = (("h_high", "<u4"), ("h_low", "<u2"), ("c_high", "<u4"), ("c_low", "<u2"), ("at_low", "<u2"), ("at_high", "<u2"))


_ANSWER = ("home", "ids", "tags", "n_all", "n_open", "at")

# --- runs: windows with a common seed ---------------------------------------------------------------------------------


@dataclass
class Runs:
    """Runs of neighbouring windows that share their seed, the window's ``seed``-byte string of least hash.

    Two equal windows have equal seeds at equal places, wherever they stand. ``doc``: index of the text, ``first``: start
    of the first window, ``windows``: how many, ``anchor``: where the seed starts, ``h`` and ``c``: hashes of the seed and
    of all bytes of the run with the seed's place.
    """

    doc: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    h: np.ndarray
    c: np.ndarray


def runs_of(texts: list[bytes], length: int, seed: int) -> Runs:
    joined = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    n = len(joined)
    if n < length:
        empty = np.zeros(0, np.int64)
        return Runs(empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    powers, inverses = _powers("powers", _BASE, n + 1), _powers("inverses", _INVERSE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    spread = (np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)) * _SPREAD
    np.cumsum(spread * powers[:n], out=sums[1:])
    h = (sums[seed:] - sums[:-seed]) * inverses[: n - seed + 1]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    best = (h & np.uint64(0xFFFFFFFF << 32)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
    width, span = length - seed + 1, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)  # one for each window
    doc = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    inside = np.arange(length, len(anchor) + length) <= ends[doc]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(anchor)))
    first, windows = first[inside[first]], windows[inside[first]]
    anchor = anchor[first]
    c = (sums[first + windows - 1 + length] - sums[first]) * inverses[first]
    c = (c ^ (c >> np.uint64(31)) ^ (anchor - first).astype(np.uint64)) * _MIX
    doc = doc[first]
    begin = (ends - sizes)[doc]
    return Runs(doc, first - begin, windows, anchor - begin, h[anchor], c)


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    size = max(_BLOCK * 2, 1 << (n - 1).bit_length())

    def make() -> np.ndarray:
        out, done = np.ones(size, np.uint64), 1
        while done < size:
            out[done : 2 * done] = out[:done] * (out[done - 1 : done] * base)
            done *= 2
        return out

    return kept_by_worker((name, size), make)[:n]


def _text_blocks(b: pa.RecordBatch, *columns: str) -> Iterator[tuple[list[bytes], list[list]]]:
    """Texts of a batch in blocks, with the values of other columns."""
    rows = zip(b.column("text"), *(b.column(c) for c in columns))
    texts, values, size = [], [], 0
    for row in rows:
        texts.append(row[0].as_py())
        values.append([x.as_py() for x in row[1:]])
        size += len(texts[-1])
        if size >= _BLOCK:
            yield texts, values
            texts, values, size = [], [], 0
    if texts:
        yield texts, values


# --- which runs stand in several documents ----------------------------------------------------------------------------


def _packed_seeds(texts: DataFrame, buckets: int, length: int, seed: int) -> DataFrame:
    """All runs' hashes, dealt into buckets by the seed's hash: one row a task and bucket, numbers side by side."""
    names = ["bucket", "ids", "tags", "counts", *(f for f, _ in _SEED_FIELDS)]

    def pack(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, tags, h, c, at = (np.concatenate(x) for x in zip(*parts))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for i in range(buckets):
            at_i = order[cuts[i] : cuts[i + 1]]
            if len(at_i):
                own_ids, own_tags = ids[at_i], tags[at_i]
                new = np.flatnonzero(np.concatenate([[True], (own_ids[1:] != own_ids[:-1]) | (own_tags[1:] != own_tags[:-1])]))
                values = {"h": h[at_i] >> np.uint64(16), "c": c[at_i] >> np.uint64(16), "at": at[at_i].astype(np.uint64)}
                cells = [own_ids[new], own_tags[new], np.diff(np.append(new, len(at_i))).astype(np.int32)]
                for name, kind in _SEED_FIELDS:
                    what, part = name.split("_")
                    shift = np.uint64(16 if part == "high" else 0)
                    cells.append((values[what] >> shift).astype(kind))
                arrays = [pa.array([i], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in cells)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for found, keys in _text_blocks(b, "id", "tag"):
                runs = runs_of(found, length, seed)
                ids, tags = (np.array([k[i] for k in keys], t) for i, t in ((0, np.int64), (1, np.int32)))
                parts.append((ids[runs.doc], tags[runs.doc], runs.h, runs.c, runs.first))
                held += len(runs.doc)
                if held >= _FLUSH:
                    yield from pack(parts)
                    parts, held = [], 0
        if held:
            yield from pack(parts)

    return texts.mapInArrow(seeds, "bucket int, " + ", ".join(f"{n} binary" for n in names[1:]))


def _judge(homes: int):
    def judge(bucket: pa.Table) -> pa.Table:
        """Of one bucket's runs: those that equal a run of a smaller document, and those that others may share in part.

        The answers go to the documents' homes, one row a home.
        """
        rows = bucket.to_pylist()
        counts = _joined(rows, "counts", np.int32)
        ids, tags = np.repeat(_joined(rows, "ids", np.int64), counts), np.repeat(_joined(rows, "tags", np.int32), counts)
        fields = {name: _joined(rows, name, kind).astype(np.int64) for name, kind in _SEED_FIELDS}
        h, c, at = (fields[f"{x}_high"] << 16 | fields[f"{x}_low"] for x in ("h", "c", "at"))
        order = np.lexsort((c, h))
        h, c, own = h[order], c[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        several = np.repeat(np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts), sizes)
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        inner = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(own, inner), np.diff(np.append(inner, len(h))))
        mixed = np.repeat(np.add.reduceat(new.astype(np.int64), starts) > 1, sizes)
        again = several & (own > least)
        chosen = np.flatnonzero(again | (several & mixed))
        is_open, chosen = ~again[chosen], order[chosen]
        ids, tags, at = ids[chosen], tags[chosen], at[chosen].astype(np.int32)
        home = _home(ids, homes)
        order = np.lexsort((is_open, tags, ids, home))
        home, ids, tags, at, is_open = (x[order] for x in (home, ids, tags, at, is_open))
        cuts = np.searchsorted(home, np.arange(homes + 1))
        packed = []
        for i in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[i], cuts[i + 1])
            i_ids, i_tags, i_open = ids[own], tags[own], is_open[own]
            first = np.flatnonzero(np.concatenate([[True], (i_ids[1:] != i_ids[:-1]) | (i_tags[1:] != i_tags[:-1])]))
            n_all = np.diff(np.append(first, len(i_ids))).astype(np.int32)
            n_open = np.add.reduceat(i_open, first, dtype=np.int32)
            packed.append((int(i), *(x.tobytes() for x in (i_ids[first], i_tags[first], n_all, n_open, at[own]))))
        columns = list(zip(*packed)) or [[]] * len(_ANSWER)
        kinds = [pa.int32()] + [pa.binary()] * (len(_ANSWER) - 1)
        return pa.table({n: pa.array(x, t) for n, x, t in zip(_ANSWER, columns, kinds)})

    return judge


def _merge(home: pa.Table) -> pa.Table:
    """One row for each document of a home, with the starts of its settled and open runs from all buckets."""
    rows = home.to_pylist()
    n_all, n_open = _joined(rows, "n_all", np.int32), _joined(rows, "n_open", np.int32)
    ids, tags = np.repeat(_joined(rows, "ids", np.int64), n_all), np.repeat(_joined(rows, "tags", np.int32), n_all)
    at = _joined(rows, "at", np.int32)
    place = np.arange(len(at)) - np.repeat(np.cumsum(n_all) - n_all, n_all)
    is_open = place >= np.repeat(n_all - n_open, n_all)  # settled runs come first
    return _by_document(ids, tags, np.flatnonzero(~is_open), np.flatnonzero(is_open), at)


def _joined(rows: list[dict], name: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[name], kind) for r in rows])


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    mixed = ids.view(np.uint64) * _MIX
    return ((mixed >> np.uint64(32)) % np.uint64(homes)).astype(np.int64)


def _by_document(ids, tags, again: np.ndarray, open_: np.ndarray, at: np.ndarray) -> pa.Table:
    chosen = np.concatenate([again, open_])
    is_open = np.concatenate([np.zeros(len(again), bool), np.ones(len(open_), bool)])
    order = np.lexsort((at[chosen], is_open, tags[chosen], ids[chosen]))
    chosen, is_open = chosen[order], is_open[order]
    i, t, a = ids[chosen], tags[chosen], at[chosen].astype(np.int32)
    new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])) if len(i) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(i))
    split = [n + int(np.searchsorted(is_open[n:e], True)) for n, e in zip(new, ends)]
    return pa.table(
        {
            "id": pa.array(i[new], pa.int64()),
            "tag": pa.array(t[new], pa.int32()),
            "again": pa.array([a[n:s].tobytes() for n, s in zip(new, split)], pa.binary()),
            "open": pa.array([a[s:e].tobytes() for s, e in zip(split, ends)], pa.binary()),
        }
    )


# --- deep-shallow sorting ---------------------------------------------------------------------------------------------


def sort_suffixes(strings: list[bytes], shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and the length each shares with the one before it in that order.

    Shallow: a lexicographic sort by words of eight bytes, down to ``shallow`` bytes. Deep: what is still equal there and
    goes on is ordered by a blind trie for each group.
    """
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(n, -1).astype(np.uint64)
    lengths = np.minimum(np.fromiter(map(len, strings), np.int64, n), shallow)
    order = np.lexsort((lengths, *heads.T[::-1]))
    heads, lengths = heads[order], lengths[order]
    same = np.concatenate([[False], (heads[1:] == heads[:-1]).all(axis=1) & (lengths[1:] == lengths[:-1])])
    shared = np.zeros(n, np.int64)
    for i in np.flatnonzero(~same[1:]) + 1:
        shared[i] = _lcp(strings[order[i - 1]][:shallow], strings[order[i]][:shallow])
    begins = np.flatnonzero(~same)
    for b, e in zip(begins.tolist(), np.append(begins[1:], n).tolist()):
        if e - b > 1:
            members = order[b:e].tolist()
            placed, lcps = _blind_trie([strings[m] for m in members])
            order[b:e] = [members[p] for p in placed]
            shared[b + 1 : e] = lcps[1:]
    return order, shared


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order and shared lengths of strings by a trie whose inner nodes know only where their strings first differ.

    A string walks down by the bytes at those places alone, is compared once with the string it meets, and then branches
    off above, at the place where the two differ. Inner node: (place, byte to child); leaf: equal strings.
    """
    root: tuple | list = [0]
    for s in range(1, len(strings)):
        text = strings[s]
        path, node = [], root
        while isinstance(node, tuple):
            byte = text[node[0]] if node[0] < len(text) else -1
            path.append((node, byte))
            node = node[1].get(byte)
            if node is None:
                node = next(iter(path[-1][0][1].values()))
        met = strings[node[0]]
        if met == text:
            node.append(s)
            continue
        place = _lcp(text, met)
        level = 0
        while level < len(path) and path[level][0][0] < place:
            level += 1
        byte = text[place] if place < len(text) else -1
        if level < len(path) and path[level][0][0] == place:
            path[level][0][1][byte] = [s]
            continue
        below = path[level][0] if level < len(path) else node
        branch = (place, {met[place] if place < len(met) else -1: below, byte: [s]})
        if level:
            path[level - 1][0][1][path[level - 1][1]] = branch
        else:
            root = branch
    order, lcps, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, tuple):
            children = [node[1][b] for b in sorted(node[1])]
            stack += [(child, node[0]) for child in reversed(children[1:])] + [(children[0], shared)]
        else:
            order += node
            lcps += [shared] + [len(strings[node[0]])] * (len(node) - 1)
    return order, lcps


def _resolve(length: int):
    def resolve(bucket: pa.Table) -> pa.Table:
        """Windows of the bucket's open runs that also start in a smaller document.

        Seeds are suffixes of the runs, so two windows at the same place before their seeds are equal if the suffixes from
        there and the reversed bytes before share enough; both follow from the shared lengths in sorted order.
        """
        ids, tags, first, place = (bucket.column(c).to_numpy() for c in ("id", "tag", "first", "place"))
        contents = bucket.column("content").to_pylist()
        places, n = place.tolist(), len(ids)
        windows = np.fromiter(map(len, contents), np.int64, n) - length + 1
        after = _groups([c[p:] for c, p in zip(contents, places)])
        before = _groups([c[:p][::-1] for c, p in zip(contents, places)])
        found = []
        for offset in range(int(place.max()) + 1):  # of the window's start before the seed
            at = np.flatnonzero((place >= offset) & (place - offset < windows))
            if len(at) < 2:
                continue
            key = after(length - offset)[at] * n + before(offset)[at]
            order = np.lexsort((ids[at], key))
            key, at = key[order], at[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            least = np.repeat(ids[at][starts], np.diff(np.append(starts, len(at))))
            hit = at[ids[at] > least]
            found.append((hit, first[hit] + place[hit] - offset))
        hits, starts = (np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        nothing = np.zeros(0, np.int64)
        return _by_document(ids[hits], tags[hits], np.arange(len(hits)), nothing, starts).select(["id", "tag", "again"])

    return resolve


def _groups(strings: list[bytes]):
    """For a depth: a number for each string, equal for strings that share so many bytes (or all, if they are shorter)."""
    order, shared = sort_suffixes(strings)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return lambda depth: np.cumsum(shared < depth)[place] if depth else np.zeros(len(order), np.int64)


# --- the operator -----------------------------------------------------------------------------------------------------


def _numbers(blobs: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(blobs or []), np.int32).astype(np.int64)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, seed: int = 16, crowd: int = _CROWD
) -> DataFrame:
    """``docs`` with ``kept`` (binary, the bytes that stay) and ``removed`` (array of start and end of the cut runs).

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
    id, judged on the input. Matches never cross documents.

    Every text is cut into runs of windows that share a seed. Runs of equal bytes are settled by their hashes, a few bytes
    a run, packed by bucket of the seed. Only runs that share a seed but not all bytes (where repeats begin and end) move
    with their bytes: the suffixes at their seeds and the reversed bytes before them are sorted deep-shallow, and shared
    lengths tell which windows are equal. Seeds with more than ``crowd`` open runs are settled window by window instead, so
    that no task holds all surroundings of one string. Texts are shuffled only for documents that may lose something, once for each of
    the two steps.

    Ids are integers; rows with equal ids are one document as far as order goes, each with its own text. A null id orders
    nothing: such rows stay whole. A null text counts as empty. Texts shorter than ``length`` bytes stay whole. Columns
    named ``kept`` or ``removed`` are replaced, others pass.
    """
    docs = docs.drop("kept", "removed")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    tag = F.xxhash64(text_col).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), tag.alias("tag"), raw.alias("text"))
    texts = texts.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // _BUCKET))
    seeds = _packed_seeds(texts, buckets, length, seed)
    answers = "home int, ids binary, tags binary, n_all binary, n_open binary, at binary"
    answered = seeds.groupBy("bucket").applyInArrow(_judge(buckets), answers)
    judged = answered.groupBy("home").applyInArrow(_merge, "id long, tag int, again binary, open binary")
    judged = durable(judged, "runs")
    resolved = _settle_open(texts, judged.where(F.octet_length("open") > 0), length, seed, crowd)

    cut = judged.where(F.octet_length("again") > 0).select("id", "tag", F.col("again").alias("runs"), F.lit(None).cast("binary").alias("windows"))
    cut = cut.union(resolved.select("id", "tag", F.lit(None).cast("binary"), "again"))
    cut = durable(cut.groupBy("id", "tag").agg(F.collect_list("runs").alias("runs"), F.collect_list("windows").alias("windows")), "cuts")
    # the row travels as one struct, so that its columns may have any names
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), tag.alias("mark"), F.struct(*map(quoted, docs.columns)).alias("row"))
    raw = F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary")
    marked = maybe_among(rows, "doc", cut.select("id"))
    spans = "array<struct<start: int, end: int>>"
    whole = marked.where(~F.col("hit")).select("row", raw.alias("kept"), F.array().cast(spans).alias("removed"))
    some = marked.where(F.col("hit")).join(cut, (F.col("doc") == cut["id"]) & (F.col("mark") == cut["tag"]), "left")
    some = some.select("row", raw.alias("text"), "runs", "windows")
    schema = whole.schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, removed = [], []
            for found, values in _text_blocks(b.select(["text", "runs", "windows"]), "runs", "windows"):
                for text, (again, windows) in zip(found, values):
                    k, r = _cut(text, _numbers(again), _numbers(windows), length, seed)
                    kept.append(k)
                    removed.append(r)
            arrays = [b.column("row"), pa.array(kept, pa.binary()), pa.array(removed, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return whole.union(some.mapInArrow(finish, schema)).select("row.*", "kept", "removed")


def _settle_open(texts: DataFrame, open_runs: DataFrame, length: int, seed: int, crowd: int) -> DataFrame:
    """``id``, ``tag`` and ``again``: starts of single windows of open runs that a smaller document has too."""
    buckets = max(1, (open_runs.agg(F.coalesce(F.sum(F.octet_length("open")), F.lit(0))).first()[0] // 4) // _EDGES)
    wanted = open_runs.groupBy("id", "tag").agg(F.collect_list("open").alias("open"))
    some = maybe_among(texts, "id", open_runs.select("id")).where("hit").drop("hit").join(wanted, ["id", "tag"])
    fields = "h long, bucket int, id long, tag int, first int, place int, content binary"

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found, values in _text_blocks(b, "id", "tag", "open"):
                runs = runs_of(found, length, seed)
                # a run is known by its document and start
                keys = [np.unique(_numbers(v[2])) + (i << 40) for i, v in enumerate(values)]
                at = np.flatnonzero(np.isin(runs.first + (runs.doc << 40), np.concatenate(keys)))
                doc, first = runs.doc[at], runs.first[at]
                ends = first + runs.windows[at] - 1 + length
                columns = [
                    pa.array(runs.h[at].view(np.int64)),
                    pa.array((runs.h[at] % np.uint64(buckets)).astype(np.int32)),
                    pa.array([values[d][0] for d in doc], pa.int64()),
                    pa.array([values[d][1] for d in doc], pa.int32()),
                    pa.array(first.astype(np.int32)),
                    pa.array((runs.anchor[at] - first).astype(np.int32)),
                    pa.array([found[d][f:e] for d, f, e in zip(doc.tolist(), first.tolist(), ends.tolist())], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "bucket", "id", "tag", "first", "place", "content"])

    edges = durable(some.mapInArrow(cut_out, fields), "edges")
    # a larger limit where there are many open runs keeps the table of crowded seeds small enough to broadcast
    limit = max(crowd, edges.count() // _CROWDS)
    crowded = F.broadcast(edges.groupBy("h").count().where(F.col("count") > limit).select("h"))
    sorted_ = edges.join(crowded, "h", "left_anti").drop("h").groupBy("bucket")
    settled = sorted_.applyInArrow(_resolve(length), "id long, tag int, again binary")
    return settled.union(_settle_crowds(edges.join(crowded, "h", "left_semi"), length))


def _settle_crowds(edges: DataFrame, length: int) -> DataFrame:
    """The same for seeds that too many open runs share: window by window, with map-side minima."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            contents = b.column("content").to_pylist()
            n = np.array([len(c) - length + 1 for c in contents], np.int64)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows = pa.array(np.repeat(np.arange(len(n)), n))
            columns = [
                pa.array([c[i : i + length] for c, k in zip(contents, n.tolist()) for i in range(k)], pa.binary()),
                b.column("id").take(rows),
                b.column("tag").take(rows),
                pa.array((b.column("first").to_numpy()[rows.to_numpy()] + offset).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["window", "id", "tag", "start"])

    windows = edges.mapInArrow(spread, "window binary, id long, tag int, start int")
    least = windows.groupBy("window").agg(F.min("id").alias("least"))
    hits = windows.join(least, "window").where(F.col("id") > F.col("least"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = [np.array(x.as_py(), np.int32).tobytes() for x in b.column("starts")]
            columns = [b.column("id"), b.column("tag"), pa.array(starts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "tag", "again"])

    gathered = hits.groupBy("id", "tag").agg(F.collect_list("start").alias("starts"))
    return gathered.mapInArrow(pack, "id long, tag int, again binary")


def _cut(text: bytes, again: np.ndarray, windows: np.ndarray, length: int, seed: int) -> tuple[bytes, list[dict]]:
    """What is left of a text without the windows of some runs and some single windows, and the spans that went."""
    if not len(again) and not len(windows):
        return text, []
    change = np.zeros(len(text) + 1, np.int64)
    if len(again):
        runs = runs_of([text], length, seed)
        at = np.flatnonzero(np.isin(runs.first, again))
        np.add.at(change, runs.first[at], 1)
        np.add.at(change, runs.first[at] + runs.windows[at] - 1 + length, -1)
    np.add.at(change, windows, 1)
    np.add.at(change, windows + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, [{"start": int(a), "end": int(e)} for a, e in zip(edges[::2], edges[1::2])]
