"""MinHash near-duplicates by a multi-index Hamming join.

1. Every document gets a class (a 128-bit hash of its words) and a signature of 64 MinHash
   values, 16 bits each.  Documents of one class are copies; from here on a class is one row, its least doc_id.
2. The signature is cut into 16 chunks of 4 values.  Two signatures that differ in at most 31 of
   64 values have, by the pigeonhole principle, a chunk with at most one error.  Each chunk is
   therefore filed four times, each time with another value masked: equal keys enumerate just the chunks within one error,
   so every pair within the distance meets.  Texts at a similarity of 0.8 differ in 12.8 values
   on average, 31 is 5.7 standard deviations beyond (a chance below 1e-7 to miss a pair).
3. Of buckets with the same members one is kept.  In each bucket all members are compared with
   the least; the links that hold are joined into components.  Before full shingle sets are compared, an odd sketch (parities of shingles in 2048
   cells) rules out pairs that differ in too many shingles; it never rules out a pair by less than that.
4. Buckets that still hold several components are searched further.  First members are dealt to blocks, and
   in each a least spanning forest by signature distance is compared, which joins what hangs together.  Then every pair left of
   different components within the signature distance is, each pair in one bucket alone: the members of the bucket's largest component
   against the others, and these against each other, a pair of blocks at a time (all at once in a bucket of up to a block).  Where the others are many, the bucket is first
   split by a second chunk: beside the shared one 15 are left for 31 errors, so one of them has at most two, and members go to a
   sub-bucket for each two values of each chunk.  A few of these, fixed ones, tell beforehand whether all would cost less than the pairs of blocks.
   So a bucket of any size is neither cut nor held by one task, no link between components is lost, and copies are never
   expanded into all pairs.  Joins by pivot, class or key spread a hot key's rows over many tasks.

Of a bucket of M members of its largest component and m others, M ceil(m / BLOCK) + m ceil(M / BLOCK) + m ceil(m / BLOCK) rows are
dealt; of one that is split, 90 m small ones and those of its sub-buckets.  Long texts are compared by their hashed shingles, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import dropped, read_table, salted_join, stored
from stratalog.llm.components import components
from stratalog.llm.textvec import SPACES, U64, Words, chunks, fingerprint, whole

VALUES, CHUNK, MOST_APART, BLOCK = 64, 4, 31, 768
SIMILARITY = 80  # per cent
BROADCAST_ROWS = 1 << 20
PLAIN = "uncompressed"
_rng = np.random.default_rng(20240229)
FACTORS = _rng.integers(1, 1 << 63, VALUES, dtype=np.int64).astype(U64) * U64(2) + U64(1)
ODD_BITS = 2048
MASKS = [[j for j in range(CHUNK) if j != out] for out in range(CHUNK)]
#: A second chunk: how far it is from the first, and which two of its values are equal; the few that tell the cost beforehand.
SECOND = [(step, x, y) for step in range(1, VALUES // CHUNK) for x in range(CHUNK) for y in range(x + 1, CHUNK)]
PROBES = SECOND[:: len(SECOND) // 4]


def odd_sketches(sets: list[np.ndarray], sizes: np.ndarray) -> list[bytes]:
    """For each set the parity of its members' number in each of ODD_BITS cells."""
    x = np.concatenate([*sets, np.empty(0, U64)])
    cell = np.repeat(np.arange(len(sets)), sizes) * ODD_BITS + (x >> U64(17)).astype(np.int64) % ODD_BITS
    bits = (np.bincount(cell, minlength=len(sets) * ODD_BITS) & 1).astype(bool).reshape(len(sets), ODD_BITS)
    return [row.tobytes() for row in np.packbits(bits, axis=1)]


def may_link(n_a, odd_a: np.ndarray, n_b, odd_b: np.ndarray) -> np.ndarray:
    """False only for pairs that cannot be similar enough.

    A pair at the similarity differs in at most m = (n_a + n_b) (100 - s) / (100 + s) shingles.  Each toggles one cell, so the sketches
    differ in at most m cells; with cells hit twice, in n / 2 (1 - (1 - 2 / n)^m) on average, here with six standard deviations of room.
    """
    m = (n_a + n_b) * (100 - SIMILARITY) // (100 + SIMILARITY)
    apart = np.bitwise_count(odd_a ^ odd_b).sum(-1)
    likely = ODD_BITS / 2 * (1 - (1 - 2 / ODD_BITS) ** m) + 3 * ODD_BITS**0.5
    return (100 * np.minimum(n_a, n_b) >= SIMILARITY * np.maximum(n_a, n_b)) & (apart <= np.minimum(m, likely))


def _odd(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, ODD_BITS // 64)


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, cls (of the words), sig (VALUES 16-bit values; empty without words), odd (the odd sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            n_shingles, classes, sigs, odds = [], [], [], []
            for _, part in chunks(texts):
                w = Words(part, SPACES)
                sh, _ = w.shingles(width)
                sets = []
                for d in range(len(part)):
                    a, b = w.first[d], w.first[d + 1]
                    sets.append(np.unique(sh[a : b - width + 1]) if b - a >= width else whole(w, a, b) if b > a else np.empty(0, U64))
                    classes.append(xxhash.xxh3_128_digest(w.hash[a:b].tobytes()))
                sizes = np.array([len(s) for s in sets])
                odds += odd_sketches(sets, sizes)
                n_shingles += sizes.tolist()
                full = np.flatnonzero(sizes)
                if len(full):
                    x = np.concatenate([sets[d] for d in full])
                    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    out = np.empty((len(full), VALUES), "<u2")
                    for k, f in enumerate(FACTORS):
                        y = x * f
                        y ^= y >> U64(32)
                        out[:, k] = (np.minimum.reduceat(y, at) * FACTORS[0]) >> U64(48)
                    of = {d: out[j].tobytes() for j, d in enumerate(full.tolist())}
                else:
                    of = {}
                sigs += [of.get(d, b"") for d in range(len(part))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_shingles, pa.int64()), pa.array(classes, pa.binary()), pa.array(sigs, pa.binary()), pa.array(odds, pa.binary())], ["doc_id", "n_shingles", "cls", "sig", "odd"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, cls binary, sig binary, odd binary")


def keys(classes: DataFrame) -> DataFrame:
    """(key, node): the chunks of each signature, filed once for each value that may be wrong."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, VALUES // CHUNK, CHUNK).astype(U64)
            out = np.empty((len(sig), VALUES // CHUNK, CHUNK), U64)
            for m, rest in enumerate(MASKS):
                packed = sig[:, :, rest[0]] << U64(32) | sig[:, :, rest[1]] << U64(16) | sig[:, :, rest[2]]
                out[:, :, m] = packed | U64(m) << U64(48) | (np.arange(VALUES // CHUNK, dtype=U64) << U64(50))
            rows = out.reshape(len(sig), -1).view(np.int64)
            offsets = np.arange(0, rows.size + 1, rows.shape[1] if len(sig) else 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], ["node", "keys"])

    return classes.select("node", "sig").mapInArrow(run, "node long, keys array<long>").select(F.explode("keys").alias("key"), "node")


def plausible(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that their sketches do not rule out."""
    side = lambda x: signed.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))

    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            ok = may_link(n_a, _odd(batch.column("odd_a")), n_b, _odd(batch.column("odd_b")))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    rows = pairs.count()
    sides = salted_join(salted_join(pairs, side("b"), "b", ["a"], rows=rows), side("a"), "a", ["b"], rows=rows, counts=pairs.groupBy("a").agg(F.count("*").alias("n_rows")))
    return sides.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(run, "a long, b long")


def compared(pairs: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """Of pairs (a, b) of ids those whose full shingle sets are similar enough."""
    ids = stored(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), "ids")
    few = ids.count() <= BROADCAST_ROWS  # 8 bytes each; beyond, both sides are exchanged
    found = documents.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("binary").alias("text")).join(F.broadcast(ids) if few else ids, "node", "left_semi")
    texts = stored(found.where(F.length("text") > 0).dropDuplicates(["node", "text"]), "texts")
    rows = pairs.count()
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    sides = salted_join(salted_join(pairs, side("b"), "b", ["a"], rows=rows), side("a"), "a", ["b"], rows=rows, counts=pairs.groupBy("a").agg(F.count("*").alias("n_rows")))

    def run(batches):
        for batch in batches:
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            known = dict(zip(distinct := list({*a, *b}), fingerprint(distinct, SPACES, width), strict=True))
            good = []
            for x, y in zip(a, b, strict=True):
                s, t = known[x], known[y]
                common = len(s) + len(t) - len(np.union1d(s, t))
                good.append(100 * common >= SIMILARITY * (len(s) + len(t) - common) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _members(group: pa.Table):
    node, label, n = (group.column(c).to_numpy() for c in ("node", "label", "n_shingles"))
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(-1, VALUES)
    return node, label, n, sig, _odd(group.column("odd"))


def _pairs(a, b) -> pa.Table:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def tree_pairs(group: pa.Table) -> pa.Table:
    """Of the members of two blocks of a bucket a least spanning forest by signature distance (Prim): the pairs in it
    of different components.  There are fewer than members."""
    node, label, n, sig, odd = _members(group)
    far = VALUES + 1
    away, parent, open_ = np.full(len(node), far), np.zeros(len(node), np.int64), np.ones(len(node), bool)
    a, b = [], []
    for _ in range(len(node)):
        u = int(np.where(open_, away, far + 1).argmin())
        if away[u] <= MOST_APART and label[u] != label[parent[u]]:
            a.append(node[parent[u]])
            b.append(node[u])
        open_[u] = False
        apart = (sig != sig[u]).sum(1)
        apart[~may_link(n, odd, n[u], odd[u])] = far
        apart[label == label[u]] = -1
        closer = open_ & (apart < away)
        away[closer], parent[closer] = apart[closer], u
    return _pairs(a, b)


def near_pairs(group: pa.Table) -> pa.Table:
    """Of the members of two blocks of a bucket the pairs of different components within the distance, each in one bucket only:
    that of the least key which both have."""
    node, label, n, sig, odd = _members(group)
    side, key = group.column("side").to_numpy(), group.column("key")[0].as_py()
    chunk, mask = key >> 50, key >> 48 & 3
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    a, b = [], []
    for i in left:
        equal = sig[right] == sig[i]
        ok = (equal.sum(1) >= VALUES - MOST_APART) & (label[right] != label[i]) & ((side[right] > 0) | (right > i))
        ok[ok] = may_link(n[right[ok]], odd[right[ok]], n[i], odd[i])
        if ok.any():
            parts = equal[ok].reshape(-1, VALUES // CHUNK, CHUNK)
            first = (parts.sum(2) >= CHUNK - 1).argmax(1)
            wrong = (~parts[np.arange(len(first)), first]).argmax(1)  # 0 if none is
            own = right[ok][(first == chunk) & (wrong == mask)]
            a += [node[i]] * len(own)
            b += node[own].tolist()
    return _pairs(a, b)


def blocks(n):
    return F.ceil(n / F.lit(BLOCK)).cast("int")


def block_of(n):
    return F.pmod(F.xxhash64("node", F.lit(1)), blocks(n)).cast("int")


def opened(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node, label), and of the keys with several components: key, most (the largest component), n_most, n_others."""
    labelled = stored(members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")), "labelled", PLAIN)
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    of_key = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    return labelled, stored(of_key.select("key", F.col("m.label").alias("most"), F.col("m.n").alias("n_most"), (F.col("n") - F.col("m.n")).alias("n_others")), "open")


GROUP = ["key", "sub", "i", "j"]
DEALT = [*GROUP, "side", "node", "label", "n_shingles", "sig", "odd"]


def of_open(labelled: DataFrame, open_keys: DataFrame, members: DataFrame, signed: DataFrame) -> DataFrame:
    counts = open_keys.select("key", (F.col("n_most") + F.col("n_others")).alias("n_rows"))
    return salted_join(labelled, open_keys, "key", ["node"], rows=members.count(), counts=counts).join(signed, "node")


def dealt_for_trees(members: DataFrame, labels: DataFrame, signed: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, each in one block of its bucket."""
    labelled, open_keys = opened(members, labels)
    own = block_of(F.col("n_most") + F.col("n_others"))
    rest = of_open(labelled, open_keys, members, signed)
    return rest.withColumns({"sub": F.lit(0).cast("long"), "i": own, "j": own, "side": F.lit(0)}).select(*DEALT)


def dealt_for_pairs(members: DataFrame, labels: DataFrame, signed: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, for each pair of blocks that they are to be compared in."""
    labelled, open_keys = opened(members, labels)
    rest = of_open(labelled, open_keys, members, signed).withColumn("is_most", F.col("label") == F.col("most")).withColumn("sub", F.lit(0).cast("long"))
    narrow = F.col("n_most") + F.col("n_others") <= BLOCK
    small, rest = rest.where(narrow).withColumns({x: F.lit(0) for x in ("i", "j", "side")}), rest.where(~narrow)
    others = rest.where("not is_most")
    split = None
    if not open_keys.where(F.col("n_others") > BLOCK).isEmpty():
        split = stored(cheaper_split(others.where(F.col("n_others") > BLOCK), open_keys), "split")
    n_most, n_others = F.col("n_most"), F.col("n_others")
    span = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    # blocks of the largest component come first, those of the others behind them
    most = rest.where("is_most").withColumns({"i": block_of(n_most), "j": F.explode(span(n_others)), "side": F.lit(-1)}).withColumn("j", F.col("j") + blocks(n_most))
    against = others.withColumns({"j": block_of(n_others) + blocks(n_most), "i": F.explode(span(n_most)), "side": F.lit(1)})
    whole = others if split is None else others.join(F.broadcast(split) if split.count() <= BROADCAST_ROWS else split, "key", "left_anti")
    out = small.select(*DEALT).unionByName(most.select(*DEALT)).unionByName(against.select(*DEALT)).unionByName(paired(whole, n_others, blocks(n_most)))
    if split is None:
        return out
    rows = others.join(split, "key", "left_semi")
    subs = sub_buckets(rows, SECOND)
    h = F.xxhash64("node")
    found = subs.groupBy("key", "sub").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_003).alias("y"), F.min("label").alias("l"), F.max("label").alias("m"))
    found = found.where("l <> m").groupBy("key", "n", "x", "y").agg(F.min("sub").alias("sub")).select("key", "sub", "n")
    inside = subs.join(found, ["key", "sub"]).drop("label").join(rows.drop("sub"), ["key", "node"])
    return out.unionByName(paired(inside, F.col("n"), F.lit(0)))


def paired(rows: DataFrame, n, first) -> DataFrame:
    """rows for each pair of the blocks of their bucket, which are numbered from first on."""
    out = rows.withColumn("own", block_of(n)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks(n) - 1)))
    at = {"i": F.least("own", "other") + first, "j": F.greatest("own", "other") + first, "side": F.signum(F.col("own") - F.col("other")).cast("int")}
    return out.withColumns(at).select(*DEALT)


def sub_buckets(rows: DataFrame, combinations: list[tuple[int, int, int]]) -> DataFrame:
    """(key, sub, node, label): for each combination two equal values of another chunk than the key's."""

    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, VALUES // CHUNK, CHUNK).astype(np.int64)
            chunk = batch.column("key").to_numpy() >> 50
            out = np.empty((len(sig), len(combinations)), np.int64)
            for k, (step, x, y) in enumerate(combinations):
                other = (chunk + step) % (VALUES // CHUNK)
                two = sig[np.arange(len(sig)), other]
                out[:, k] = (other << 4 | x << 2 | y) << 32 | two[:, x] << 16 | two[:, y]
            offsets = np.arange(0, out.size + 1, len(combinations), dtype=np.int32)
            subs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), subs, batch.column("node"), batch.column("label")], ["key", "subs", "node", "label"])

    out = rows.select("key", "sig", "node", "label").mapInArrow(run, "key long, subs array<long>, node long, label long")
    return out.select("key", F.explode("subs").alias("sub"), "node", "label")


def cheaper_split(others: DataFrame, open_keys: DataFrame) -> DataFrame:
    """The keys that are cheaper searched by sub-buckets than as they are, by the sizes of a few sub-buckets."""
    sizes = sub_buckets(others, PROBES).groupBy("key", "sub").agg(F.count("*").alias("n")).where("n > 1")
    cost = sizes.groupBy("key").agg((F.sum(F.col("n") * blocks(F.col("n"))) * (len(SECOND) / len(PROBES))).alias("cost"))
    direct = F.col("n_others") * blocks(F.col("n_others"))
    wide = open_keys.where(F.col("n_others") > BLOCK)
    return wide.join(cost, "key", "left").where(F.coalesce("cost", F.lit(0.0)) < direct / 2).select("key")


def near_duplicates(documents: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of documents.

    Documents without words are linked with nothing; rows with a null doc_id are linked with nothing,
    have a null component and are kept.  Rows that share a doc_id are one document.  Equal rows
    are kept or not together.  Other columns are not read.
    """
    S = stored(signatures(documents, width), "signatures", PLAIN)
    with_words = S.where("n_shingles > 0 and doc_id is not null")
    classes = with_words.groupBy("cls").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("odd").alias("odd"))
    classes = stored(classes, "classes", PLAIN)
    # documents that share a doc_id but not a class are linked through it
    twice = with_words.groupBy("doc_id").agg(F.min("cls").alias("l"), F.max("cls").alias("m")).where("l <> m").select("doc_id")
    same_id = salted_join(with_words.select("doc_id", "cls").distinct(), twice, "doc_id", ["cls"], rows=S.count())
    same_id = same_id.join(classes.select("cls", "node"), "cls").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    K = keys(classes)
    h = F.xxhash64("node")
    buckets = K.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_003).alias("y")).where("n > 1")
    distinct = stored(buckets.groupBy("pivot", "n", "x", "y").agg(F.min("key").alias("key")).select("key", "pivot", F.col("n").alias("n_rows")), "buckets")
    n_keys = classes.count() * VALUES // CHUNK * len(MASKS)
    members = salted_join(K, distinct.drop("n_rows"), "key", ["node"], rows=n_keys, counts=distinct.select("key", "n_rows"))
    members = stored(members.distinct(), "members", PLAIN)  # key, node, pivot

    pairs = stored(members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    signed = classes.groupBy("node").agg(*(F.first(c).alias(c) for c in ("sig", "odd", "n_shingles")))
    likely = stored(plausible(pairs, signed), "plausible")
    first = stored(compared(likely, documents, width).unionByName(same_id), "links")
    dropped(likely, distinct)
    labels = components(first)

    known, held = pairs, first
    for step, deal, search in (("tree", dealt_for_trees, tree_pairs), ("rest", dealt_for_pairs, near_pairs)):
        found = deal(members, labels, signed).groupBy(*GROUP).applyInArrow(search, "a long, b long").distinct()
        more = stored(found.join(known, ["a", "b"], "left_anti"), step)
        held = stored(held.unionByName(compared(more, documents, width)), "links")
        known = known.unionByName(more)
        labels = components(held)

    of_class = classes.join(labels, "node", "left").select("cls", F.coalesce("component", "node").alias("component_id"))
    joined = salted_join(S, of_class, "cls", ["doc_id"], "left", rows=S.count())
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: sets of four-word shingles."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=4)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline stage: one document of each group of near copies (five-word shingles), the least doc_id; rows without an id stay."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
