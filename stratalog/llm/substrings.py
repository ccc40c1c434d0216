"""Repeated-substring removal by bucket-pointer refinement of sampled suffixes.

A byte goes if a 50-byte string over it also starts in a document of smaller id.  Suffixes are ranked
only as deep as 50 bytes, and refined from buckets, never sorted whole:

1. Initial buckets.  Of the 20-byte grams inside a 50-byte string the one of least hash is its
   anchor.  Equal strings have equal anchors at equal places, so suffixes fall into the bucket of their anchor
   and only about one place in sixteen is filed.  Buckets seen in one document alone are dropped; what is exchanged for this are packed
   key sets of batches of documents, and bits that come back.
2. Refinement.  The suffixes of a shared anchor are a context: the bytes that all strings of the anchor cover.  Equal contexts
   are one row with the least document id.  Buckets with unequal contexts are refined by bucket pointers: suffixes get ranks of 8 bytes, then
   ranks of 24 and 50 bytes by sorting on the bucket's own number and the bucket numbers at two later
   offsets, each round reusing the numbers of the one before.  The least id of each rank comes back to the batches.
   An anchor in more places than `hot` (a short phrase whose surroundings all differ) is no bucket of its own: each of its strings
   is filed by its own hash, so equal strings still meet, over all ranges, and one row a batch and string is the most that does.
3. Each batch marks what its documents share with smaller ids.

Documents are exchanged once, by batch; the three passes read the same exchange.

Key sets and contexts go from the batches to ranges of keys by levels of a fixed fan-out, whatever the size of the input: a batch sends a
row to each of FAN ranges; with more than FAN batches, every FAN batches' rows of a range meet in a unit, which merges equal keys (and equal
contexts, with the least id) and sends a row to each of FAN narrower ranges, and so on, until a range has one unit.  Answers go back the same
way.  So rows grow as the input does, times the number of levels (its logarithm to base FAN: one up to 1 GB, two to 256 GB, four at 100 TB); a unit
takes at most FAN rows, with as many keys as a batch has; and a passage in every batch is one row in FAN of them.

Defined results: a null text is empty; a text under 50 bytes loses nothing.  Rows with a null id lose nothing and
take nothing away.  Rows of equal id take nothing from each other.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import blocks_for, read_table, text_bytes
from stratalog.llm.textvec import U64, mix

SPAN, GRAM = 50, 20
STEPS = SPAN - GRAM + 1
SLICE, BATCH, FAN, REFINE = 1 << 20, 4 << 20, 256, 1 << 20
PLACE = U64((1 << 24) - 1)
#: Places of an anchor from which it is hot, and those in one batch that are counted out.
HOT, OFTEN = 1 << 15, 8


def _eights(buffer: bytes) -> np.ndarray:
    """The 8 bytes from each place on, as a number."""
    n = len(buffer) - 7
    return np.ndarray((n,), "<u8", buffer, strides=(1,)).copy()


class Anchors:
    """Anchors of texts: text, place of the anchor, first and last place whose string has it, and a 64-bit key of its gram."""

    def __init__(self, texts: list[bytes]):
        parts = [self._of(group) for group in self._slices(texts)]
        self.text, self.first, self.last, self.key = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(4))
        self.key = self.key.astype(U64)

    @staticmethod
    def _slices(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Groups of (text, offset, bytes): whole texts, or of very long ones slices that overlap by a string less a byte."""
        group, size = [], 0
        for k, t in enumerate(texts):
            for a in range(0, max(0, len(t) - SPAN + 1), SLICE):
                part = t if a == 0 and len(t) <= SLICE + SPAN - 1 else t[a : a + SLICE + SPAN - 1]
                group.append((k, a, part))
                size += len(part)
                if size >= SLICE:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    @staticmethod
    def _of(group):
        buffer = b"".join(p for _, _, p in group) + bytes(8)
        sizes = np.array([len(p) for _, _, p in group])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        e = _eights(buffer)
        n = int(begin[-1]) - GRAM + 1
        h = e[:n] * U64(0x9E3779B97F4A7C15) + e[8 : n + 8] * U64(0xC2B2AE3D27D4EB4F) + e[12 : n + 12] * U64(0x165667B19E3779F9)
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(32)
        v = (h & ~PLACE) | np.arange(n, dtype=U64)
        w = v
        for step in (1, 2, 4, 8, STEPS - 16):  # minima over 2, 4, 8, 16, then STEPS places
            w = np.minimum(w[: len(w) - step], w[step:])
        valid = np.concatenate([np.arange(b, b + s - SPAN + 1) for b, s in zip(begin, sizes, strict=False)])
        place = (w[valid] & PLACE).astype(np.int64)
        edge = np.flatnonzero(np.diff(place)) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(place)]]) - 1
        part = np.searchsorted(begin, valid[first], "right") - 1
        shift = np.array([a for _, a, _ in group])[part] - begin[part]
        return np.array([k for k, _, _ in group])[part], valid[first] + shift, valid[last] + shift, mix(h[place[first]])


class Levels:
    """The ranges of keys: a prefix of n digits to base fan at level n, and as many units of batches as are left to merge there.

    A unit of level n is (prefix, unit): unit is the batch's number divided by fan^n.  A batch is a unit of level 0.  The first digit is of a key's
    upper half; the others are of the code that stands for it in its range, the lower half or, from three levels on, all of it.
    """

    def __init__(self, batches: int, fan: int):
        self.fan, self.depth = fan, 1
        while fan**self.depth < batches:
            self.depth += 1
        self.wide = self.depth > 2
        self.code = "<u8" if self.wide else "<u4"

    def digit(self, code, level: int):
        """The digit that follows a prefix of level digits (1 or more), of codes in an array or of one number."""
        base = self.fan ** (level - 1)
        return (code // type(code)(base) if isinstance(code, int) else code // code.dtype.type(base)) % self.fan

    def parent(self, prefix: int, level: int) -> int:
        """The prefix less its last digit, of a prefix of level digits."""
        return prefix % self.fan ** (level - 1)


class Batch:
    """The documents of a batch, its distinct keys by range, and the contexts of the shared ones."""

    def __init__(self, table: pa.Table, shape: "Levels"):
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids = [i for i, _ in rows]
        self.texts = [t for _, t in rows]
        self.anchors = Anchors([t if i is not None else b"" for i, t in rows])
        a = self.anchors
        order = np.lexsort((a.text, a.key))
        key, text = a.key[order], a.text[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        start = np.flatnonzero(new)
        ends = np.concatenate([start[1:], [len(key)]]) - 1 if len(key) else start
        self.many = text[start] != text[ends]
        self.count = ends - start + 1
        distinct = key[start]
        self.range = ((distinct >> U64(32)) % U64(shape.fan)).astype(np.int64)
        by_range = np.lexsort((distinct, self.range))
        self.many, self.count, self.range, distinct = self.many[by_range], self.count[by_range], self.range[by_range], distinct[by_range]
        self.fan = shape.fan
        self.codes = (distinct if shape.wide else distinct & U64(0xFFFFFFFF)).astype(shape.code)
        rank = np.empty(len(by_range), np.int64)
        rank[by_range] = np.arange(len(by_range))
        self.number = np.empty(len(key), np.int64)  # of each anchor: its key's place in codes
        self.number[order] = rank[np.cumsum(new) - 1]
        self.edges = np.flatnonzero(np.diff(self.range, prepend=-1))

    def spans(self) -> Iterator[tuple[int, int, int]]:
        for a, b in zip(self.edges, [*self.edges[1:], len(self.range)], strict=True):
            yield int(self.range[a]), int(a), int(b)

    def contexts(self, shared: np.ndarray, hot: np.ndarray) -> dict[int, dict[tuple[int, bytes], list[tuple[int, int, int]]]]:
        """By range: (key, context) -> (text, first, last) of the anchors that have it, smallest id first.

        Of hot anchors each string is a context, and its hash the key.
        """
        a, out, texts = self.anchors, defaultdict(dict), self.texts
        k = np.flatnonzero(shared[self.number]) if len(self.number) else np.empty(0, np.int64)
        keys = (a.key[k] ^ U64(1 << 63)).view(np.int64)
        for r, key, t, first, last, apart in zip(*(x.tolist() for x in (self.range[self.number[k]], keys, a.text[k], a.first[k], a.last[k], hot[self.number[k]])), strict=True):
            if not apart:
                out[r].setdefault((key, texts[t][first : last + SPAN]), []).append((t, first, last))
                continue
            for at in range(first, last + 1):
                string = texts[t][at : at + SPAN]
                h = xxhash.xxh64_intdigest(string)
                out[(h >> 32) % self.fan].setdefault((h - (1 << 63), string), []).append((t, at, at))
        return out


def _bits(table: pa.Table, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Of the batch's keys which are shared, and which of those hot."""
    shared, hot = np.zeros(len(batch.codes), bool), np.zeros(len(batch.codes), bool)
    of = {r: (x, y) for r, x, y in zip(*(table.column(c).to_pylist() for c in ("part", "bits", "hot")), strict=True) if x is not None}
    for r, a, b in batch.spans():
        for out, bits in zip((shared, hot), of.get(r, ()), strict=False):
            if bits:
                out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return shared, hot


def refined(contexts: list[bytes], ids: list[int]) -> list[np.ndarray]:
    """For each context the least id among all contexts, by 50-byte string: bucket-pointer refinement to that depth."""
    buffer = b"".join(contexts) + bytes(8)
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(sizes - SPAN + 1)[:-1]]), sizes - SPAN + 1) + np.arange((sizes - SPAN + 1).sum())
    bucket = np.unique(_eights(buffer), return_inverse=True)[1]  # of 8 bytes, at every place
    # of 24 bytes, where a string has its first, its second and its last such stretch
    needed = np.zeros(len(bucket), bool)
    for offset in STRETCHES:
        needed[starts + offset] = True
    places = np.flatnonzero(needed)
    bucket[places] = _renumbered(bucket, places, (0, 8, 16))
    bucket = _renumbered(bucket, starts, STRETCHES)  # of SPAN bytes
    least = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, bucket, np.repeat(np.asarray(ids, np.int64), sizes - SPAN + 1))
    return np.split(least[bucket], np.cumsum(sizes - SPAN + 1)[:-1])


STRETCHES = (0, 24, SPAN - 24)


def _renumbered(bucket: np.ndarray, places: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """New bucket numbers of places: by sorting on the bucket numbers at three later offsets."""
    bits = int(bucket.max()).bit_length()
    if 3 * bits > 63:  # too many buckets for one number: two of the offsets first
        pair = np.unique(bucket[places + offsets[0]] << bits | bucket[places + offsets[1]], return_inverse=True)[1]
        return np.unique(pair << bits | bucket[places + offsets[2]], return_inverse=True)[1]
    joint = (bucket[places + offsets[0]] << bits | bucket[places + offsets[1]]) << bits | bucket[places + offsets[2]]
    return np.unique(joint, return_inverse=True)[1]


UP = "prefix long, unit long, child long"
DOWN = "prefix long, unit long, part long"
KEY_ROW, BITS_ROW = "codes binary, many binary, often binary", "bits binary, hot binary"
CONTEXT_ROW, LEAST_ROW = "keys array<long>, contexts array<binary>, ids array<long>", "least array<long>, context array<long>, string array<long>, then array<long>"
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "string": pa.string()}


def _rows(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [part.split(" ") for part in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({n: pa.array(c, _TYPES[t]) for (n, t), c in zip(fields, columns, strict=True)})


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _counted(counts: np.ndarray, least: int) -> bytes:
    often = np.flatnonzero(counts >= least)
    return np.stack([often, counts[often]], axis=1).astype("<u4").tobytes()


def _keys(shape: Levels):
    def run(group: pa.Table) -> pa.Table:
        b, batch = Batch(group, shape), group.column("batch")[0].as_py()
        rows = [(r, batch // shape.fan, batch, b.codes[x:y].tobytes(), _packed(b.many[x:y]), _counted(b.count[x:y], OFTEN)) for r, x, y in b.spans()]
        return _rows(rows, f"{UP}, {KEY_ROW}")

    return run


class Merged:
    """The key sets of a unit's children, merged: codes, whether each is in several documents, and in how many places (about)."""

    def __init__(self, group: pa.Table, shape: Levels):
        group = group.sort_by("child")
        self.prefix, self.unit = group.column("prefix")[0].as_py(), group.column("unit")[0].as_py()
        self.children = group.column("child").to_pylist()
        codes = [np.frombuffer(x, shape.code) for x in group.column("codes").to_pylist()]
        self.codes, inverse, self.counts = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        self.own = np.split(inverse, np.cumsum([len(c) for c in codes])[:-1])
        self.many = self.counts > 1
        for own, many, often in zip(self.own, group.column("many").to_pylist(), group.column("often").to_pylist(), strict=True):
            self.many[own[_unpacked(many, len(own))]] = True
            pairs = np.frombuffer(often, "<u4").reshape(-1, 2).astype(np.int64)
            self.counts[own[pairs[:, 0]]] += pairs[:, 1] - 1
        self.counts = np.minimum(self.counts, 1 << 31)

    def answers(self, shared: np.ndarray, hot: np.ndarray, shape: Levels, level: int) -> pa.Table:
        """To each child which of its codes are shared, and which of those hot."""
        rows = []
        for child, own in zip(self.children, self.own, strict=True):
            if shared[own].any():
                rows.append((shape.parent(self.prefix, level), child, self.prefix, _packed(shared[own]), _packed(hot[own]) if hot[own].any() else b""))
        return _rows(rows, f"{DOWN}, {BITS_ROW}")


def _keys_up(shape: Levels, level: int):
    def run(group: pa.Table) -> pa.Table:
        m = Merged(group, shape)
        digit = shape.digit(m.codes, level)
        rows = []
        for d in np.unique(digit).tolist():
            at = np.flatnonzero(digit == d)
            rows.append((m.prefix + d * shape.fan**level, m.unit // shape.fan, m.unit, m.codes[at].tobytes(), _packed(m.many[at]), _counted(m.counts[at], 2)))
        return _rows(rows, f"{UP}, {KEY_ROW}")

    return run


def _shared(shape: Levels, hot: int):
    def run(group: pa.Table) -> pa.Table:
        m = Merged(group, shape)
        return m.answers(m.many, m.many & (m.counts > hot), shape, shape.depth)

    return run


def _bits_down(shape: Levels, level: int):
    def run(group: pa.Table, bits: pa.Table) -> pa.Table:
        if not group.num_rows or not bits.num_rows:
            return _rows([], f"{DOWN}, {BITS_ROW}")
        m = Merged(group, shape)
        digit = shape.digit(m.codes, level)
        shared, hot = np.zeros(len(m.codes), bool), np.zeros(len(m.codes), bool)
        for part, x, y in zip(*(bits.column(c).to_pylist() for c in ("part", "bits", "hot")), strict=True):
            at = np.flatnonzero(digit == part // shape.fan**level)
            shared[at] = _unpacked(x, len(at))
            if y:
                hot[at] = _unpacked(y, len(at))
        return m.answers(shared, hot, shape, level)

    return run


def _contexts(shape: Levels):
    def run(group: pa.Table, bits: pa.Table) -> pa.Table:
        rows = []
        if group.num_rows and bits.num_rows:
            b, batch = Batch(group, shape), group.column("batch")[0].as_py()
            for r, found in b.contexts(*_bits(bits, b)).items():
                rows.append((r, batch // shape.fan, batch, [k for k, _ in found], [c for _, c in found], [b.ids[at[0][0]] for at in found.values()]))
        return _rows(rows, f"{UP}, {CONTEXT_ROW}")

    return run


class MergedContexts:
    """The contexts of a unit's children, equal ones once with the least id, by the digit that follows."""

    def __init__(self, group: pa.Table, shape: Levels, level: int):
        group = group.sort_by("child")
        self.prefix, self.unit = group.column("prefix")[0].as_py(), group.column("unit")[0].as_py()
        self.least: dict[tuple[int, bytes], int] = {}
        self.own: list[tuple[int, list[tuple[int, bytes]]]] = []
        for child, keys, contexts, ids in zip(*(group.column(c).to_pylist() for c in ("child", "keys", "contexts", "ids")), strict=True):
            pairs = list(zip(keys, contexts, strict=True))
            self.own.append((child, pairs))
            for pair, i in zip(pairs, ids, strict=True):
                self.least[pair] = min(self.least.get(pair, i), i)
        self.parts: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for pair in self.least:
            code = (pair[0] + (1 << 63)) & (-1 if shape.wide else 0xFFFFFFFF)
            self.parts[self.prefix + shape.digit(code, level) * shape.fan**level].append(pair)


def _contexts_up(shape: Levels, level: int):
    def run(group: pa.Table) -> pa.Table:
        m = MergedContexts(group, shape, level)
        rows = [(part, m.unit // shape.fan, m.unit, [k for k, _ in pairs], [c for _, c in pairs], [m.least[p] for p in pairs]) for part, pairs in m.parts.items()]
        return _rows(rows, f"{UP}, {CONTEXT_ROW}")

    return run


def _changes(context: list[int], string: list[int], then: list[int]) -> dict[int, list[tuple[int, int]]]:
    out = defaultdict(list)
    for j, s, d in zip(context, string, then, strict=True):
        out[j].append((s, d))
    return out


def _answer(head: tuple, least: list[int], runs: list[list[tuple[int, int]]]) -> tuple:
    """A row of answers: for each context its first least id, and where in it that changes to which."""
    flat = [(j, s, d) for j, run in enumerate(runs) for s, d in run]
    return (*head, least, [j for j, _, _ in flat], [s for _, s, _ in flat], [d for _, _, d in flat])


def _least_down(shape: Levels, level: int):
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows or not answers.num_rows:
            return _rows([], f"{DOWN}, {LEAST_ROW}")
        m = MergedContexts(group, shape, level)
        of: dict[tuple[int, bytes], tuple[int, list]] = {}
        for part, least, *runs in zip(*(answers.column(c).to_pylist() for c in ("part", "least", "context", "string", "then")), strict=True):
            changes = _changes(*runs)
            for j, (pair, low) in enumerate(zip(m.parts[part], least, strict=True)):
                of[pair] = low, changes.get(j, [])
        parent = shape.parent(m.prefix, level)
        rows = [_answer((parent, child, m.prefix), [of[p][0] for p in pairs], [of[p][1] for p in pairs]) for child, pairs in m.own]
        return _rows(rows, f"{DOWN}, {LEAST_ROW}")

    return run


def _least(shape: Levels):
    """To each child of a range's unit the least id of each context, or of each string of a context that some others resemble."""
    return lambda group: _least_of(group, shape)


def _least_of(group: pa.Table, shape: Levels) -> pa.Table:
    keys, contexts, ids = (group.column(c).to_pylist() for c in ("keys", "contexts", "ids"))
    by_key: dict[int, dict[bytes, int]] = defaultdict(dict)
    for ks, cs, ds in zip(keys, contexts, ids, strict=True):
        for k, c, d in zip(ks, cs, ds, strict=True):
            own = by_key[k]
            own[c] = min(own.get(c, d), d)
    finer: dict[tuple[int, bytes], np.ndarray] = {}
    waiting: list[tuple[int, bytes, int]] = []
    size = 0

    def refine() -> None:
        if waiting:
            for (k, c, _), least in zip(waiting, refined([c for _, c, _ in waiting], [d for _, _, d in waiting]), strict=True):
                finer[k, c] = least
            waiting.clear()

    for k, own in by_key.items():
        if len(own) > 1:
            waiting += [(k, c, d) for c, d in own.items()]
            size += sum(map(len, own))
            if size > REFINE:
                refine()
                size = 0
    refine()
    rows = []
    for prefix, child, ks, cs in zip(*(group.column(c).to_pylist() for c in ("prefix", "child")), keys, contexts, strict=True):
        low, runs = [], []
        for k, c in zip(ks, cs, strict=True):
            strings = finer.get((k, c))
            low.append(by_key[k][c] if strings is None else int(strings[0]))
            changed = [] if strings is None else np.flatnonzero(np.diff(strings)).tolist()
            runs.append([(e + 1, int(strings[e + 1])) for e in changed])  # where the least id changes, from string e + 1 on
        rows.append(_answer((shape.parent(prefix, shape.depth), child, prefix), low, runs))
    return _rows(rows, f"{DOWN}, {LEAST_ROW}")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>"


def _removed(shape: Levels):
    def run(group: pa.Table, least: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _rows([], RESULT)
        strings: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of each text: runs of strings to remove
        texts, ids = group.column("text").to_pylist(), group.column("doc_id").to_pylist()
        if least.num_rows:
            b = Batch(group, shape)
            texts, ids = b.texts, b.ids
            # the same keys are shared as in the pass before: those of the contexts that came back
            for r, lows, context, string, then in zip(*(least.column(c).to_pylist() for c in ("part", "least", "context", "string", "then")), strict=True):
                if lows is None:  # a row of bits
                    continue
                changes = _changes(context, string, then)
                for j, at in enumerate(self_contexts(b, least)[r].values()):
                    if j not in changes:
                        low = lows[j]
                        for t, first, last in at:
                            if low < ids[t]:
                                strings[t].append((first, last))
                        continue
                    steps = [(0, lows[j]), *changes[j]]
                    for t, first, last in at:
                        for (s, d), (e, _) in zip(steps, [*steps[1:], (last - first + 1, 0)], strict=True):
                            if d < ids[t]:
                                strings[t].append((first + s, first + e - 1))
        rows = []
        for t, (i, text) in enumerate(zip(ids, texts, strict=True)):
            spans: list[list[int]] = []
            for first, last in sorted(strings.get(t, ())):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last + SPAN)
                else:
                    spans.append([first, last + SPAN])
            sha, at = hashlib.sha256(), 0
            for x, y in spans:
                sha.update(text[at:x])
                at = y
            sha.update(text[at:])
            rows.append((i, len(text), sum(y - x for x, y in spans), len(spans), sha.hexdigest(), [v for s in spans for v in s]))
        return _rows(rows, RESULT)

    return run


def self_contexts(b: Batch, least: pa.Table):
    """The contexts in the order in which they were sent; kept with the batch."""
    if not hasattr(b, "sent"):
        b.sent = b.contexts(*_bits(least, b))
    return b.sent


def repeated_substrings(documents: DataFrame, batch_bytes: int = BATCH, fan: int = FAN, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed (starts and ends of the removed runs, in bytes), a row a document.

    fan: a power of two."""
    batches = blocks_for(text_bytes(documents), batch_bytes)
    shape = Levels(batches, fan)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    unit = ["prefix", "unit"]

    def to_batches(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("unit").alias("batch"), *(c for c in rows.columns if c not in unit))

    def meet(sent: DataFrame, up, final, down, up_row: str, down_row: str) -> DataFrame:
        """Rows of the batches through all levels to the ranges, and their answers back to the batches."""
        levels = [sent]
        for n in range(1, shape.depth):
            levels.append(levels[-1].groupBy(*unit).applyInArrow(up(shape, n), f"{UP}, {up_row}"))
        answers = levels[-1].groupBy(*unit).applyInArrow(final, f"{DOWN}, {down_row}")
        for n in range(shape.depth - 1, 0, -1):
            answers = levels[n - 1].groupBy(*unit).cogroup(answers.groupBy(*unit)).applyInArrow(down(shape, n), f"{DOWN}, {down_row}")
        return to_batches(answers)

    keys = docs.groupBy("batch").applyInArrow(_keys(shape), f"{UP}, {KEY_ROW}")
    bits = meet(keys, _keys_up, _shared(shape, hot), _bits_down, KEY_ROW, BITS_ROW)
    contexts = docs.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(_contexts(shape), f"{UP}, {CONTEXT_ROW}")
    least = meet(contexts, _contexts_up, _least(shape), _least_down, CONTEXT_ROW, LEAST_ROW)
    answers = least.unionByName(bits, allowMissingColumns=True)  # both kinds of rows go to their batch
    return docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_removed(shape), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(read_table(spark, sf_dir, "documents")).drop("removed")
