"""Near-duplicate lines: segment-partition edit join, and documents without repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywise.llm.batches import drop_kept, quoted
from tallywise.llm.components import connected
from tallywise.llm.membership import maybe_among
from tallywise.operators.scratch import durable

_SEED = 42  # of Spark's xxhash64, so that both sides name a line alike
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLOCK_CHARS = 1 << 19  # that a task works on at a time
_FILTER_WORDS = 1 << 17  # of 64 bits: which lines' texts are worth fetching
_STRIPPED = " \t\r"
_GRAM = 10  # characters of a piece that least hashes are taken of
_BANDS, _DEEP = 16, 2  # lines that agree in all the least hashes of one band meet
_BUCKET = 24 << 20  # bytes of text whose keys a task compares
_PACK = 1 << 20  # keys that a task sorts into buckets at a time
_CROWD = 32  # lines of one key that are paired on the spot
_CLASSES = 32  # of characters, for counts
_SIDE = 1 << 19  # characters of lines that are compared at a time
_NOWHERE = np.int32(-(1 << 30))
_SEGMENT, _PROBE, _BAND = 0, 1, 2  # kinds of keys
_FACTORS = np.random.default_rng(7).integers(0, 1 << 31, _BANDS * _DEEP, np.uint32) * np.uint32(2) + np.uint32(1)


def allowed(length: int, most: int, share: float) -> int:
    """Edits between two lines of which the longer has ``length`` characters."""
    return max(most, int(length * share))


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: bit-parallel over a column of the distance matrix.

    Bit i of ``up`` (``down``): the column grows (falls) by one from row i to the next. Now and then the column's least
    value in the band of ``most`` cells around the diagonal is taken: where that is too large already, the rest is not
    looked at.
    """
    if abs(len(a) - len(b)) > most:
        return False
    low = _common(a, b, min(len(a), len(b)), lambda text, n, step: text[n : n + step])
    a, b = a[low:], b[low:]
    high = _common(a, b, min(len(a), len(b)), lambda text, n, step: text[len(text) - n - step : len(text) - n])
    a, b = a[: len(a) - high], b[: len(b) - high]
    if not a or not b:
        return len(a) + len(b) <= most
    full, last = (1 << len(a)) - 1, len(a) - 1
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    up, down, distance, rest = full, 0, len(a), len(b)
    check = every = max(16, 2 * most)
    for j, ch in enumerate(b, 1):
        match = places.get(ch, 0)
        across = (((match & up) + up) ^ up) | match
        grows, falls = (down | ~(across | up)) & full, up & across
        distance += (grows >> last & 1) - (falls >> last & 1)
        rest -= 1
        if distance - rest > most:
            return False
        grows, match = grows << 1 | 1, match | down
        up, down = (falls << 1 | ~(match | grows)) & full, grows & match
        if j == check:
            check += every
            if _least_in_band(up, down, j, len(a), most) > most:
                return False
    return distance <= most


def all_within(pairs: list[tuple[str, str]], limits: np.ndarray) -> np.ndarray:
    """Whether each pair's edit distance is at most its limit: ``within`` for many pairs at once, in blocks of like limits."""
    found = np.zeros(len(pairs), bool)
    order = np.argsort(limits, kind="stable").tolist()
    low = 0
    while low < len(order):
        high, chars, widest = low, 0, 2 * int(limits[order[low]]) + 8
        while high < len(order) and limits[order[high]] <= widest and (chars < _SIDE or high == low):
            chars += max(map(len, pairs[order[high]]))
            high += 1
        block = order[low:high]
        found[block] = _all_within([min(pairs[i], key=len) for i in block], [max(pairs[i][::-1], key=len) for i in block], limits[block])
        low = high
    return found


def _all_within(a: list[str], b: list[str], limits: np.ndarray) -> np.ndarray:
    """``all_within`` for lines ``a`` no longer than ``b``, by furthest reaching points on the diagonals of the distance matrix.

    After e edits a point on each diagonal is as far as e edits and then equal characters can lead; equal characters are
    counted a word at a time. Diagonals from which the end can't be reached with the edits left are given up.
    """
    words_a, words_b, starts_a, starts_b, bits = _words(a, b)
    size = np.fromiter(map(len, a), np.int64, len(a))
    gap = np.fromiter(map(len, b), np.int64, len(b)) - size

    def slide(row: np.ndarray, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How far points go on along their diagonals without an edit."""
        i, at_a, at_b, live = i.copy(), starts_a[row] + i, starts_b[row] + i + d, np.arange(len(i))
        while len(live):
            apart = words_a[at_a] ^ words_b[at_b]
            same = (np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) // bits).astype(np.int64)
            i[live] += same
            on = same == 64 // bits
            live, at_a, at_b = live[on], at_a[on] + 64 // bits, at_b[on] + 64 // bits
        return i

    near, most = np.zeros(len(a), bool), int(limits.max(initial=0))
    rows = np.flatnonzero(gap <= limits)
    reach = np.full((len(rows), 2 * most + 3), _NOWHERE, np.int32)
    zero = most + 1  # the column of the diagonal through the beginning
    reach[:, zero] = slide(rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64))
    for e in range(most + 1):
        if e:
            left, n, far = (limits[rows] - e)[:, None], size[rows][:, None], gap[rows][:, None]
            low, high = max(-e, int((far - left).min())), min(e, int((far + left).max()))
            d = np.arange(low, high + 1)
            at = slice(zero + low, zero + high + 1)
            shift = lambda x: reach[:, zero + low + x : zero + high + 1 + x]
            point = np.maximum(np.maximum(shift(-1), shift(0) + 1), shift(1) + 1)
            point = np.minimum(np.minimum(point, n), n + far - d)
            r, c = np.nonzero((point >= 0) & (np.abs(far - d) <= left))
            reach[:, at] = _NOWHERE
            reach[r, c + zero + low] = slide(rows[r], point[r, c].astype(np.int64), d[c])
        ended = reach[np.arange(len(rows)), zero + gap[rows]] >= size[rows]
        near[rows[ended]] = True
        on = ~ended & (limits[rows] > e)
        if not on.all():
            rows, reach = rows[on], reach[on]
        if not len(rows):
            break
    return near


def _words(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The 64 bits that begin at each character, where each line begins, and the bits of a character.

    Characters are numbered as they occur, with as few bits as that takes. Lines of ``a`` are followed by zeros and lines of
    ``b`` by ones, which equal nothing.
    """
    sides = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b)]
    number = np.zeros(0x110000, np.uint32)
    for side in sides:
        number[side] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(2, len(used) + 2)
    kind = np.uint8 if len(used) < 254 else np.uint16 if len(used) < 65534 else np.uint32
    bits, words, starts = 8 * np.dtype(kind).itemsize, [], []
    for end, (lines, side) in enumerate(zip((a, b), sides)):
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        place = np.arange(len(lines)) * (64 // bits)  # of sentinels before each line
        buffer = np.full(len(side) + len(lines) * (64 // bits) + 64 // bits, end, kind)
        buffer[np.arange(len(side)) + np.repeat(place, lengths)] = number[side]
        many = len(buffer) - 64 // bits + 1
        words.append(np.ndarray((many,), np.uint64, buffer.tobytes(), 0, (bits // 8,)).copy())
        starts.append(np.cumsum(lengths) - lengths + place)
    return *words, *starts, bits


def _least_in_band(up: int, down: int, j: int, rows: int, most: int) -> int:
    """The least distance in rows j - most to j + most of column j."""
    low, high = max(0, j - most), min(rows, j + most)
    if low > high:
        return most + 1
    below = (1 << low) - 1
    value = least = j + (up & below).bit_count() - (down & below).bit_count()
    up, down = up >> low, down >> low
    for i in range(high - low):
        value += (up >> i & 1) - (down >> i & 1)
        least = min(least, value)
    return least


def _common(a: str, b: str, most: int, cut) -> int:
    """How many characters both have in common at the end that ``cut`` takes pieces from."""
    low, step = 0, most
    while step:
        while low + step <= most and cut(a, low, step) == cut(b, low, step):
            low += step
        step //= 2
    return low


def segment(length: np.ndarray | int, i: int, most: int):
    """Start and length of segment ``i`` of most + 1 nearly equal ones; the longer ones come last."""
    short = length // (most + 1)
    longer = length % (most + 1)
    extra = i - (most + 1 - longer)
    return i * short + np.maximum(extra, 0), short + (extra >= 0)


def probes(most: int) -> Iterator[tuple[int, int, int]]:
    """(difference in length, segment, shift of the start) of the substrings a line must look up to meet shorter or equal ones.

    If the segments before the i-th hold all they can of the edits, the i-th is shifted by i at most; seen from the end,
    by most - i at most around the difference in length.
    """
    for delta in range(most + 1):
        for i in range(most + 1):
            for shift in range(max(-i, delta - (most - i)), min(i, delta + most - i) + 1):
                yield delta, i, shift


class Block:
    """Lines side by side, with prefix sums from which the hash of any substring follows."""

    def __init__(self, lines: list[str], names: list[int]):
        chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.names = np.array(names, np.uint64).view(np.int64)
        self.lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.powers, self.inverses = _powers(_BASE, len(chars) + 1), _powers(_INVERSE, len(chars) + 1)
        spread = (chars + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread * self.powers[:-1], dtype=np.uint64)])
        self.chars = chars

    def sketch(self) -> np.ndarray:
        """16 bits with the parity of how often characters of a class occur. One edit flips at most two."""
        one = np.left_shift(np.uint16(1), ((self.chars * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)).astype(np.uint16))
        return np.bitwise_xor.reduceat(one, self.starts)

    def keys(self, member: np.ndarray, start: np.ndarray, size: np.ndarray, i: int, length: np.ndarray) -> np.ndarray:
        """Hashes of the lines' substrings, mixed with segment and line length."""
        at = self.starts[member] + start
        raw = (self.sums[at + size] - self.sums[at]) * self.inverses[at]
        mixed = (raw ^ (length.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(i))) * np.uint64(0xFF51AFD7ED558CCD)
        return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)

    def stored(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        member = np.arange(len(self.lengths))
        for i in range(most + 1):
            yield member, self.keys(member, *segment(self.lengths, i, most), i, self.lengths)

    def asked(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for delta, i, shift in probes(most):
            if not delta and not shift:  # that is the line's own segment, under which it is stored
                continue
            length = self.lengths - delta
            start, size = segment(length, i, most)
            start = start + shift
            member = np.flatnonzero((start >= 0) & (start + size <= self.lengths) & (length > most))
            yield member, self.keys(member, start[member], size[member], i, length[member])

    def alike(self, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys that lines with most of their pieces in common are likely to share: bands of least hashes (MinHash)."""
        member = np.flatnonzero(self.lengths >= shortest)
        size = np.repeat(np.minimum(self.lengths, _GRAM), self.lengths)
        at = np.minimum(np.arange(len(size)), np.repeat(self.starts + self.lengths, self.lengths) - size)
        raw = (self.sums[at + size] - self.sums[at]) * self.inverses[at] * np.uint64(0xFF51AFD7ED558CCD)
        pieces = ((raw ^ (raw >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(32)).astype(np.uint32)
        for band in range(_BANDS):
            key = np.full(len(self.lengths), band, np.uint64)
            for factor in _FACTORS[band * _DEEP : (band + 1) * _DEEP]:
                key = (key ^ np.minimum.reduceat(pieces * factor, self.starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            yield member, key[member].view(np.int64)

    def packed(self, most: int, shortest: int | None) -> list[np.ndarray]:
        """Keys of all kinds, with kind, the line's name and what tells pairs apart at once: sketch, or length for bands."""
        kinds = [(_SEGMENT, *x) for x in self.stored(most)] + [(_PROBE, *x) for x in self.asked(most)]
        if shortest is not None:
            kinds += [(_BAND, *x) for x in self.alike(shortest)]
        sketch, length = self.sketch(), np.minimum(self.lengths, 0xFFFF).astype(np.uint16)
        found = [
            (key.view(np.uint64), np.full(len(key), kind, np.uint8), self.names[member], (length if kind == _BAND else sketch)[member])
            for kind, member, key in kinds
        ]
        return [np.concatenate(x) for x in zip(*found)]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * (out[done - 1 : done] * base)
        done += more
    return out


def _name(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), _SEED)


def _blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[str], list[int]]]:
    """Different stripped lines of at least ``least`` characters, with their names, in blocks."""
    for b in batches:
        seen: set[int] = set()
        lines, names, chars = [], [], 0
        for text in b.column(0):
            for line in (text.as_py() or "").split("\n"):
                line = line.strip(_STRIPPED)
                if len(line) >= least and (name := _name(line)) not in seen:
                    seen.add(name)
                    lines.append(line)
                    names.append(name)
                    chars += len(line)
                    if chars >= _BLOCK_CHARS:
                        yield lines, names
                        lines, names, chars = [], [], 0
        if lines:
            yield lines, names


def _packed_keys(texts: DataFrame, least: int, most: int, shortest: int | None, buckets: int) -> DataFrame:
    """Keys of all different lines, packed by bucket of the key: 15 bytes each, in one row a bucket and stretch of text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        kept, n = [], 0
        for lines, names in _blocks(batches, least):
            kept.append(Block(lines, names).packed(most, shortest))
            n += len(kept[-1][0])
            if n >= _PACK:
                yield sorted_out(kept)
                kept, n = [], 0
        if kept:
            yield sorted_out(kept)

    def sorted_out(kept: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, kind, line, hint = (np.concatenate(x) for x in zip(*kept))
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        low = key.astype(np.uint32)[order]
        high = ((key >> np.uint64(32)).astype(np.uint8) << np.uint8(2) | kind)[order]
        line, hint, bucket = line[order], hint[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*cuts[1:].tolist(), len(bucket)]
        columns = [pa.array([x[a:b].tobytes() for a, b in zip(cuts.tolist(), ends)], pa.binary()) for x in (low, high, line, hint)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *columns], names=["bucket", "low", "high", "line", "hint"])

    return texts.mapInArrow(pack, "bucket int, low binary, high binary, line binary, hint binary")


def _meet(most: int, share: float):
    """The function of a bucket: pairs of lines that share a key, and the lines of crowded keys.

    Up to ``_CROWD`` lines of a key are paired at once, ``key`` being null. The lines of larger groups, in order of their
    lengths or sketches, are rows ``key``, ``kind``, ``hint``, ``a``, ``b``: each with the one stored under the key before
    it, if they fit.
    """

    def fits(kind_a, hint_a, kind_b, hint_b):
        la, lb = hint_a.astype(np.int64), hint_b.astype(np.int64)
        longer = np.maximum(la, lb)
        near = (longer == 0xFFFF) | (np.abs(la - lb) <= np.maximum(most, (longer * share).astype(np.int64)))
        good = np.where(kind_a == _BAND, near, np.bitwise_count(hint_a ^ hint_b) <= 2 * most)
        return good & ((kind_a == _BAND) == (kind_b == _BAND)) & ((kind_a != _PROBE) | (kind_b != _PROBE))

    def column(t: pa.Table, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)

    def meet(t: pa.Table) -> pa.Table:
        high = column(t, "high", np.uint8)
        key = (high >> np.uint8(2)).astype(np.uint64) << np.uint64(32) | column(t, "low", np.uint32)
        order = np.argsort(key)
        again = np.diff(key[order]) == 0
        order = order[np.append(again, False) | np.append(False, again)]
        key, kind = key[order], (high & np.uint8(3))[order]
        line, hint = column(t, "line", np.int64)[order], column(t, "hint", np.uint16)[order]
        order = np.lexsort((kind, line, key))
        key, kind, line, hint = key[order], kind[order], line[order], hint[order]
        other = np.append(True, (np.diff(key) != 0) | (np.diff(line) != 0))[: len(key)]  # a line counts once a key
        key, kind, line, hint = key[other], kind[other], line[other], hint[other]
        first = np.append(True, np.diff(key) != 0)[: len(key)]
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        crowded = size[group] > _CROWD if len(key) else np.zeros(0, bool)

        few = np.flatnonzero(~crowded)
        pairs = []
        for step in range(1, _CROWD):
            a, b = few[:-step], few[step:]
            a, b = a[(same := group[a] == group[b])], b[same]
            if not len(a):
                break
            good = fits(kind[a], hint[a], kind[b], hint[b])
            pairs.append((line[a[good]], line[b[good]]))
        a = np.concatenate([x for x, _ in pairs] or [np.zeros(0, np.int64)])
        b = np.concatenate([x for _, x in pairs] or [np.zeros(0, np.int64)])

        many = np.flatnonzero(crowded)
        many = many[np.lexsort((hint[many], group[many]))]
        stored = kind[many] != _PROBE
        last = np.maximum.accumulate(np.where(stored, np.arange(len(many)), 0))
        before = np.append(0, last)[: len(many)]
        ahead = (group[many[before]] == group[many]) & stored[before]
        ahead &= fits(kind[many], hint[many], kind[many[before]], hint[many[before]])
        met = np.where(ahead, line[many[before]], line[many])
        bucket = t.column("bucket")[0].as_py() << 38
        return pa.table(
            {
                "key": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(key[many].view(np.int64) | bucket)]),
                "kind": pa.array(np.concatenate([np.zeros(len(a), np.int32), kind[many].astype(np.int32)])),
                "hint": pa.array(np.concatenate([np.zeros(len(a), np.int32), hint[many].astype(np.int32)])),
                "a": pa.array(np.concatenate([a, line[many]])),
                "b": pa.array(np.concatenate([b, met])),
            }
        )

    return meet


def near_lines(texts: DataFrame, most: int, least: int, share: float = 0.0, spanning: bool = False) -> DataFrame:
    """``a``, ``b``: names of different lines (of ``least`` characters or more) at most ``most`` edits apart, or at most
    ``share`` of the longer one's characters if that is more. ``spanning``: pairs that connect the same lines in place of
    all links, so that a group of copies need not be compared each with each.

    Each line is cut into most + 1 segments, one of which survives ``most`` edits. Lines are stored under their segments
    and look up those substrings that a line of equal or smaller length could have as a segment. This finds all pairs within
    ``most``. The number of probes grows with the square of the edits, so pairs further apart are met by an index of least
    hashes instead, whose recall was measured (README); every pair met is compared in full.

    Keys travel packed, by bucket, and most of them meet nobody. Parity sketches, lengths and counts of characters drop
    false candidates before texts are fetched. Where more than ``_CROWD`` lines share a key, neighbours in order of length
    are compared first; what is linked by then is not compared again if ``spanning``, the rest is joined by key.
    """
    size = texts.agg(F.coalesce(F.sum(F.octet_length(texts.columns[0])), F.lit(0))).first()[0]
    # the shorter line of a pair that only ``share`` allows
    shortest = max(least, int((1 - share) * (most + 1) / share)) if share else None
    keys = _packed_keys(texts, least, most, shortest, max(1, -(-size // _BUCKET)))
    met = keys.groupBy("bucket").applyInArrow(_meet(most, share), "key long, kind int, hint int, a long, b long")
    met = durable(met, "line-keys")
    pairs = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    pairs = durable(pairs.distinct(), "line-pairs")
    wanted = pairs.select(F.col("a").alias("line")).union(pairs.select("b"))
    spelled = durable(_texts_of(texts, wanted, least), "line-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(x.as_py(), y.as_py()) for x, y in zip(b.column("text_a"), b.column("text_b"))]
            limits = np.array([allowed(max(len(x), len(y)), most, share) for x, y in pairs], np.int64)
            yield b.select(["a", "b"]).filter(pa.array(all_within(pairs, limits), pa.bool_()))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, _CLASSES) for c in ("counts_a", "counts_b")]
            apart = counts[0] - counts[1]  # counts wrap around, so this bounds the difference from below
            apart = np.minimum(apart, np.uint8(0) - apart).sum(axis=1, dtype=np.int64)
            longer = np.maximum(b.column("length_a").to_numpy(), b.column("length_b").to_numpy())
            limit = np.array([allowed(n, most, share) for n in longer.tolist()], np.int64)
            yield b.select(["a", "b"]).filter(pa.array(apart <= 2 * limit))

    counted = spelled.select("line", F.length("text").alias("length"), "counts")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(counted.toDF("a", "length_a", "counts_a"), "a").join(counted.toDF("b", "length_b", "counts_b"), "b")
        left = both.mapInArrow(possible, "a long, b long")
        text = spelled.select("line", "text")
        compared = left.join(text.toDF("a", "text_a"), "a").join(text.toDF("b", "text_b"), "b")
        return durable(compared.mapInArrow(verify, "a long, b long"), "line-links")

    links = verified(pairs)
    crowd = met.where(F.col("key").isNotNull()).select("key", "kind", "hint", F.col("a").alias("line"))
    if crowd.isEmpty():
        return links
    if spanning:
        links = durable(connected(links), "line-roots").toDF("a", "b")
        crowd = crowd.join(links, F.col("line") == F.col("a"), "left")
        crowd = crowd.select("key", "kind", "hint", "line", F.coalesce("b", "line").alias("root"))
    else:
        crowd = crowd.withColumn("root", F.col("line"))
    longer = F.greatest("l.hint", "r.hint")
    near = (longer == 0xFFFF) | (F.abs(F.col("l.hint") - F.col("r.hint")) <= F.greatest(F.lit(most), F.floor(longer * F.lit(share))))
    alike = F.bit_count(F.col("l.hint").bitwiseXOR(F.col("r.hint"))) <= 2 * most
    bands = F.col("l.kind") == _BAND
    apart = (F.col("l.line") > F.col("r.line")) & (F.col("l.root") != F.col("r.root")) & (bands == (F.col("r.kind") == _BAND))
    apart &= ((F.col("l.kind") != _PROBE) | (F.col("r.kind") != _PROBE)) & F.when(bands, near).otherwise(alike)
    rest = crowd.alias("l").join(crowd.alias("r"), (F.col("l.key") == F.col("r.key")) & apart)
    rest = rest.select(F.col("l.line").alias("a"), F.col("r.line").alias("b")).distinct()
    return links.union(verified(rest.join(pairs, ["a", "b"], "left_anti")))


def _texts_of(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """``line``, ``text`` and ``counts`` (of characters of 32 classes, modulo 256) of the wanted names.

    The texts that are moved are picked by a filter. It has a fixed size; where a corpus fills it, more texts than needed move, and the join drops them.
    """
    bit = F.shiftrightunsigned("line", 64 - (_FILTER_WORDS * 64).bit_length() + 1)
    words = wanted.select(F.shiftright(bit, 6).alias("word"), F.pmod(bit, F.lit(64)).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    table = np.zeros(_FILTER_WORDS, np.int64)
    for r in words.collect():
        table[r["word"]] = r["bits"]
    shared, shift = texts.sparkSession.sparkContext.broadcast(table.view(np.uint64)), 64 - (_FILTER_WORDS * 64).bit_length() + 1

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for lines, names in _blocks(batches, least):
            at = np.array(names, np.uint64) >> np.uint64(shift)
            kept = np.flatnonzero(table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
            found = [names[i] for i in kept], [lines[i] for i in kept]
            counts = [_counts(t) for t in found[1]]
            arrays = [pa.array(np.array(found[0], np.uint64).view(np.int64)), pa.array(found[1], pa.string()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["line", "text", "counts"])

    picked = texts.mapInArrow(pick, "line long, text string, counts binary")
    return picked.join(wanted.distinct(), "line", "left_semi").dropDuplicates(["line"])


def _counts(text: str) -> bytes:
    classes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % _CLASSES
    return np.bincount(classes, minlength=_CLASSES).astype(np.uint8).tobytes()


def dedupe_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = 2,
    least: int = 20,
    least_near: int = 48,
    share: float = 0.0,
) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` and the text without lines that repeat an earlier one.

    Lines end at line feeds and are compared without white space at their ends. Lines of ``least`` characters or more
    repeat each other if they are equal, or if they have ``least_near`` characters or more and at most ``most`` edits (or
    ``share`` of the longer one's characters, if that is more) turn one into the other; classes are the components of these
    links. Of each class the line with the smallest id, then the first in that document, stays; shorter lines all stay. Kept lines stand as they were, joined by line feeds.

    Rows with equal ids count as the same document: equal texts lose the same lines. Rows with a null id are left as they
    are and count for no other. A null text stays null and has no line; an empty one has one empty line. Columns named
    ``n_lines`` or ``n_removed`` are replaced, others pass.
    """
    docs = docs.drop("n_lines", "n_removed")
    known = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    split = known.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    split = split.withColumn("line", F.btrim("line", F.lit(_STRIPPED))).where(F.length("line") >= least)
    seen = split.select("doc", "pos", F.xxhash64("line").alias("line"), F.xxhash64(F.lit(1), "line").alias("check"))
    seen = durable(seen, "lines")
    lines = seen.groupBy("line", "check").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    texts = known.select(F.col(text_col).alias("text"))
    classes = connected(near_lines(texts, most, max(least, least_near, 2 * most + 2), share, spanning=True))
    lines = lines.join(classes, lines["line"] == classes["node"], "left").drop("node")
    alone = lines.where(F.col("root").isNull() & (F.col("n") > 1)).select("line", "check", "first")
    linked = lines.where(F.col("root").isNotNull())
    firsts = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(firsts, "root").select("line", "check", F.col("least").alias("first"))
    repeated = seen.join(alone.union(linked), ["line", "check"]).where(F.struct("doc", "pos") != F.col("first"))
    removed = durable(repeated.groupBy("doc").agg(F.collect_set("pos").alias("gone")), "line-places")
    # the row travels as one struct, so that its columns may have any names
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*map(quoted, docs.columns)).alias("row"))
    marked = maybe_among(rows, "id", removed.select("doc"))
    some = marked.where("hit").join(removed, marked["id"] == removed["doc"], "left").select("row", "gone")
    whole = marked.where(~F.col("hit")).select("row", F.lit(None).cast("array<int>").alias("gone"))
    return _without(whole.union(some), docs.columns, text_col)


def _without(joined: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    whole = F.col("row")[text_col]
    every = F.split(whole, "\n")
    left = F.filter(every, lambda _, i: ~F.array_contains("gone", i))
    text: Column = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(whole.isNull(), 0).otherwise(F.size(every))
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return joined.select(
        *(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns),
        n_lines.cast("int").alias("n_lines"),
        n_removed.cast("int").alias("n_removed"),
    )
