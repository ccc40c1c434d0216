"""Benchmark decontamination by a prefix-filtered join of exact windows.

A window is ten consecutive words of a benchmark item; an item of fewer words, but not none, is one
window.  A window is the set of its five-word shingles (all of its words, if it has fewer).  As
every shingle must occur where the window occurs, the necessary prefix of a window in an order
by rarity is one shingle: the one in the fewest documents, counted over all of them.  Documents
meet the windows on those tokens alone; the token's place in the window bounds where an
occurrence can begin and end (position and length), and the words are then compared one by one.

Windows, their tokens and the choice of the necessary ones are made on the executors, as tables.  The join is a lookup in an index that is
broadcast: its size is counted first, and beyond block_bytes it goes out in that many blocks, with a pass over the documents for each.
The driver holds one block at a time, as Arrow columns.  A lookup costs the same however many windows share a token: the whole window's hash is
looked up at each place in a window that tokens of its kind have, and the words are compared where it is found.

Defined results: null and empty texts have no words and no hits; items without words have no
windows; repeated items count once by item_id, and a null item_id counts as the id ''.
Repeated document rows are judged each on its own.  Other columns are ignored, or kept by mark().  Of a window that stands in many items all
their ids are one row of the index, as they are in the result of a document that holds it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import blocks_for, dropped, read_table, shielded, stored
from stratalog.llm.textvec import ALNUM, U64, Words, chunks, window_hashes

WINDOW, SHINGLE, BLOCK_BYTES = 10, 5, 64 << 20


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [t or b"" for t in batch.column(name).to_pylist()]


WINDOWS = "body binary, n int, whole long, tokens array<long>, item string"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each item its windows: the words, their number and hash, and the hashes of their shingles, at each place in the window."""
    for batch in batches:
        names = batch.column("item").to_pylist()
        for base, part in chunks(_texts(batch, "text")):
            w = Words(part, ALNUM)
            hashes = {n: w.shingles(n)[0].view(np.int64) for n in {*np.minimum(w.n_words, WINDOW).tolist(), SHINGLE} if n}
            rows = []
            for d in range(len(part)):
                first, last = int(w.first[d]), int(w.first[d + 1])
                n = min(WINDOW, last - first)
                width = min(SHINGLE, n)
                for a in range(first, last - n + 1 if n else first):
                    tokens = hashes[width][a : a + n - width + 1].tolist()
                    rows.append((b" ".join(map(w.word, range(a, a + n))), n, int(hashes[n][a]), tokens, names[base + d]))
                if len(rows) >= 1 << 15 or d + 1 == len(part):
                    columns = list(zip(*rows, strict=True)) or [()] * 5
                    types = (pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["body", "n", "whole", "tokens", "item"])
                    rows = []


def windows(benchmark: DataFrame) -> DataFrame:
    """body, n, whole, tokens and items (the ids, sorted) of each different window."""
    item, text = F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = benchmark.select(item.alias("item"), text.alias("text")).mapInArrow(_windows, WINDOWS)
    same = rows.groupBy("body", "item").agg(*(F.first(c).alias(c) for c in ("n", "whole", "tokens")))
    return same.groupBy("body").agg(*(F.first(c).alias(c) for c in ("n", "whole", "tokens")), F.sort_array(F.collect_list("item")).alias("items"))


class Vocabulary:
    """Sorted hashes of shingles by their width; a bitmap of their leading bits turns away most others."""

    def __init__(self, widths: np.ndarray, hashes: np.ndarray):
        self.by_width = {}
        for width in np.unique(widths).tolist():
            own = np.unique(hashes[widths == width].view(U64))
            bitmap = np.zeros(1 << 20, bool)
            bitmap[own >> U64(44)] = True
            self.by_width[width] = own, bitmap

    def find(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Width, places in words, and which hash of that width is there."""
        for width, (own, bitmap) in self.by_width.items():
            sh, ok = words.shingles(width)
            at = np.flatnonzero(bitmap[sh >> U64(44)] & ok)
            k = np.minimum(np.searchsorted(own, sh[at]), len(own) - 1)
            same = own[k] == sh[at]
            yield width, at[same], k[same]


class Index:
    """Windows by their necessary token: what a pass over the documents needs."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows.column(c).to_numpy()
        self.bodies, self.items = rows.column("body"), rows.column("items")
        n, offset, whole = column("n"), column("offset"), column("whole").view(U64)
        width = np.minimum(n, SHINGLE)
        self.vocabulary = Vocabulary(width, column("token"))
        #: of each width: length, place of the token, and the windows of these, in order of their hashes
        self.kinds: dict[int, list[tuple[int, int, np.ndarray, np.ndarray]]] = defaultdict(list)
        for size, place in sorted(set(zip(n.tolist(), offset.tolist(), strict=True))):
            own = np.flatnonzero((n == size) & (offset == place))
            own = own[np.argsort(whole[own])]
            self.kinds[min(size, SHINGLE)].append((size, place, whole[own], own))

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """First word, length and row of each occurrence of a window."""
        for width, places, _ in self.vocabulary.find(words):
            doc = words.doc[places]
            for size, offset, whole, rows in self.kinds[width]:
                a = places - offset
                a = a[(a >= words.first[doc]) & (a + size <= words.first[doc + 1])]
                h = window_hashes(words, a, size)
                for side in range(2):  # equal hashes of different windows, if ever, are next to each other
                    k = np.searchsorted(whole, h) + side
                    found = np.flatnonzero((k < len(whole)) & (whole[np.minimum(k, len(whole) - 1)] == h))
                    for p, row in zip(a[found].tolist(), rows[k[found]].tolist(), strict=True):
                        if b" ".join(map(words.word, range(p, p + size))) == self.bodies[row].as_py():
                            yield p, size, row


def chosen(documents: DataFrame, block: DataFrame) -> pa.Table:
    """The windows of a block, each with its necessary token: the shingle that stands in the fewest documents, and its place in the window."""
    tokens = block.select(F.least("n", F.lit(SHINGLE)).alias("width"), F.explode("tokens").alias("token")).distinct().toArrow()  # at most a block
    vocabulary = Vocabulary(tokens.column("width").to_numpy(), tokens.column("token").to_numpy())
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        totals = {width: np.zeros(len(own), np.int64) for width, (own, _) in sent.value.by_width.items()}
        for batch in batches:
            for _, part in chunks(_texts(batch, "text")):
                w = Words(part, ALNUM)
                for width, at, k in sent.value.find(w):
                    n = len(totals[width])
                    totals[width] += np.bincount(np.unique(w.doc[at] * n + k) % n, minlength=n)
        for width, total in totals.items():
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), width)), pa.array(k), pa.array(total[k])], ["width", "k", "n"])

    totals = {width: np.zeros(len(own), np.int64) for width, (own, _) in vocabulary.by_width.items()}
    if totals:
        counts = documents.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "width long, k long, n long")
        found = counts.groupBy("width", "k").agg(F.sum("n").alias("n")).toArrow()  # at most the tokens of a block
        widths, ks, ns = (found.column(c).to_numpy() for c in ("width", "k", "n"))
        for width, total in totals.items():
            total[ks[widths == width]] = ns[widths == width]
    sent_counts = documents.sparkSession.sparkContext.broadcast(totals)

    def choose(batches):
        for batch in batches:
            places, picked = [], []
            for n, tokens in zip(batch.column("n").to_pylist(), batch.column("tokens"), strict=True):
                width = min(n, SHINGLE)
                own = tokens.values.to_numpy().view(U64)
                counts = sent_counts.value[width][np.searchsorted(sent.value.by_width[width][0], own)]
                k = int(np.lexsort((own, counts))[0])
                places.append(k)
                picked.append(int(own[k].view(np.int64)))
            arrays = [batch.column(c) for c in ("body", "n", "whole", "items")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(places, pa.int32()), pa.array(picked, pa.int64())], ["body", "n", "whole", "items", "offset", "token"])

    out = block.mapInArrow(choose, "body binary, n int, whole long, items array<string>, offset int, token long").toArrow().combine_chunks()
    sent.unpersist()
    sent_counts.unpersist()
    return out


def mark(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The kept columns (all, unless given) of each document, then n_words, spans (merged word spans that are hit, as
    start and end pairs) and items (ids with occurring windows, sorted as strings).  block_bytes: of the index, at a time."""
    keep = [c for c in (keep or documents.columns) if c not in ("n_words", "spans", "items")]
    context = documents.sparkSession.sparkContext
    table = stored(windows(benchmark), "windows")
    size = F.octet_length("body") + 8 * F.size("tokens") + 64 + F.aggregate("items", F.lit(0), lambda n, i: n + 16 + F.octet_length(i))
    n_blocks = blocks_for(table.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"], block_bytes)
    empty = {"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<long>"), "items": F.array().cast("array<string>")}
    source = documents.select(*keep, F.col("text").cast("binary").alias("_text")).withColumns(empty)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    for k in range(n_blocks):
        block = table if n_blocks == 1 else table.where(F.pmod(F.xxhash64("body"), F.lit(n_blocks)) == k)
        source = source.mapInArrow(_marker(context.broadcast(chosen(documents, block)), keep), types)
        if k + 1 < n_blocks:
            source = stored(source, "decontaminate")
    dropped(table)
    return source.drop("_text")


def _marker(sent, keep: list[str]):
    def run(batches):
        index = Index(sent.value)
        for batch in batches:
            texts = _texts(batch, "_text")
            n_words, spans, items = np.zeros(len(texts), np.int64), batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for base, part in chunks(texts):
                w = Words(part, ALNUM)
                n_words[base : base + len(part)] = w.n_words
                found: dict[int, list] = defaultdict(list)
                for a, size, row in index.hits(w):
                    found[int(w.doc[a])].append((a - int(w.first[w.doc[a]]), size, row))
                for d, hits in found.items():
                    old = spans[base + d]
                    spans[base + d] = merged([(a, a + n) for a, n, _ in hits] + list(zip(old[::2], old[1::2], strict=True)))
                    items[base + d] = sorted({*items[base + d], *(i for row in {row for _, _, row in hits} for i in index.items[row].as_py())})
            arrays = [*(batch.column(c) for c in [*keep, "_text"]), pa.array(n_words), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "_text", "n_words", "spans", "items"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.expr("aggregate(spans, 0L, (s, x) -> x - s) ")  # ends less starts: the alternating sum
    return marked.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline stage: documents without a word inside a benchmark window."""
    inside, back = shielded(docs, ("n_words", "spans", "items", "_text"))
    return back(mark(inside, read_table(spark, sf_dir, "benchmark")).where(F.size("spans") == 0))
