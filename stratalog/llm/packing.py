"""Order-preserving packing of token streams into windows of bounded length.

Documents keep the order in which they are read.  A dynamic program chooses the window cuts among
document ends (free), sentence ends (a small truncation penalty) and, where neither is within reach,
places inside a sentence.  Its cost is padding plus penalties.  As padding is linear in the
window's start, the best predecessor is a sliding minimum, kept in a monotone queue: every cut enters and leaves
it once.  A window of a power of two tokens needs no padding: those few predecessors are tried too.

The stream is packed in stretches of about half a million tokens, so memory is bounded by a stretch
or by one document, and every partition on its own, so nothing is shuffled.  Sequences never span stretches.

Defined results: a null text is an empty one, and an empty document is one piece, the closing
id 0.  Repeated rows are packed each on its own.  Sequence ids are unique, not dense.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import read_table

LENGTH, STRETCH = 1024, 1 << 19
SENTENCE_COST, INSIDE_COST = 3, 48
END = 0
TOKENIZER = "byte_bpe_50k.json"
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The byte-level vocabulary of a tokenizer file as a fast encoder, and which ids end a sentence.

    The same ids as the file gives by the tokenizers library (a test holds them against each other); the file's added tokens, such as
    <|endoftext|>, are one id each wherever they stand in a text.  In such a file a byte stands as the character of that code if it prints,
    else as the next character from U+0100 on.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary, added = content["model"]["vocab"], {t["content"]: t["id"] for t in content.get("added_tokens") or ()}
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in added and all(c in byte_of for c in token)}
    ends = np.zeros(max(*ranks.values(), *added.values()) + 1, bool)
    for token, i in ranks.items():
        ends[i] = token.rstrip(b"\"')")[-1:] in (b".", b"!", b"?") or b"\n" in token
    return tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=added), ends


def cuts(bounds: np.ndarray, costs: np.ndarray, length: int = LENGTH) -> list[int]:
    """Ends of the windows, as indices into bounds, at least cost.

    bounds: places where a window may end, ascending, none further than length from the one before;
    the first is 0 and the last is the end of the stream.  costs: the penalty of a cut at each.
    """
    powers = [1 << k for k in range(length.bit_length()) if 1 << k < length]
    at = bounds.tolist()
    cost = costs.tolist()
    best, back = [0.0] * len(at), [0] * len(at)
    place = {b: k for k, b in enumerate(at)}
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # best + bound of predecessors, ascending
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - length:
            queue.popleft()
        low, i = queue[0]
        low += length - here
        for p in powers:
            k = place.get(here - p)
            if k is not None and best[k] < low:
                low, i = best[k], k
        best[j], back[j] = low + cost[j], i
        value = best[j] + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], len(at) - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def places(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and at what cost."""
    soft = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gaps = np.diff(soft)
    wide = np.flatnonzero(gaps > length)
    inside = [np.arange(soft[k] + length, soft[k + 1], length) for k in wide]
    bounds = np.unique(np.concatenate([soft, *inside]))
    costs = np.full(len(bounds), float(INSIDE_COST))
    costs[np.searchsorted(bounds, sentence_ends)] = SENTENCE_COST
    costs[np.searchsorted(bounds, doc_ends)] = 0
    return bounds, costs


def pack(stream: list[np.ndarray], sentence_end: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document index, start, length, sequence, offset) of a stretch of documents."""
    sizes = np.array([len(x) for x in stream])
    ends = np.cumsum(sizes)
    bounds, costs = places(ends, np.flatnonzero(sentence_end) + 1, length)
    edges = [0, *(int(bounds[k]) for k in cuts(bounds, costs, length))]
    d, done = 0, 0
    for sequence, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        at = a
        while at < b:
            begin = int(ends[d] - sizes[d])
            stop = min(b, int(ends[d]))
            yield d, at - begin, stop - at, sequence, at - a
            at = stop
            if at == ends[d]:
                d += 1


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(documents: DataFrame, path: str | None = None, length: int = LENGTH, stretch: int = STRETCH, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    path = path or public_tokenizers.path(TOKENIZER)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, ends = encoder(path)
        task, base = TaskContext.get().partitionId() << 40, 0
        ids: list = []
        stream: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            closing = np.concatenate([ends[x] for x in stream])
            rows = []
            for d, start, n, sequence, offset in pack(stream, closing, length):
                piece = stream[d][start : start + n]
                rows.append((ids[d], start, n, zlib.crc32(piece.tobytes()), len(stream[d]), task + base + sequence, offset, *([piece.tolist()] if with_ids else [])))
            base += rows[-1][5] - task - base + 1
            types = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                stream.append(np.array([*encoding.encode(text or "", allowed_special="all"), END], "<u4"))
                size += len(stream[-1])
                if size >= stretch:
                    yield flush()
                    ids, stream, size = [], [], 0
        if stream:
            yield flush()

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, f"doc_id long, {PIECES}" + ", ids array<int>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the pieces of all documents left."""
    return packed(docs)
