"""Toxicity scores from a counterfactually regularised linear classifier.

Features are the words of a text and the prefixes and suffixes of those words, so inflected
forms of a stem share a weight.  The training loss has three parts: the logistic loss of the labelled texts,
an L2 penalty, and a counterfactual penalty.  For the last, identity terms in labelled
sentences are swapped for other terms of the same family, and every squared change of the
score is added: a bare group mention can therefore not move the score.

Families are a fixed list of neutral terms for groups of people, and, for what that list doesn't know (other languages, other
groups), families that are learned from the labelled sentences: words that are common in texts labelled clean, about as
common in the others, and interchangeable, as they stand next to the same words.  An insult is not common in clean texts, so it is in no family.
The members of learned families are features of the model, however weak, so that the penalty acts on them.
Swaps along learned families are a sample: a few sentences of a text, one swap for each; their penalty is a mean of its own.

Null and empty texts have no words and score the bias alone.  Labels that are null, or whose
document is missing, are not used.  Repeated rows are scored each on its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import read_table, shielded, stored

#: Neutral terms for groups of people, by family; terms of one family are swapped for each other.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "elderly", "young"),
)

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class ToxicityParams:
    """max_train_rows and max_changes (counterfactuals) bound the labelled sample that is fitted; every text is scored."""

    max_train_rows: int = 6000
    max_changes: int = 20_000
    #: learned families: how many words may be in them, how common one is in clean texts, how much more in toxic ones, the likeness of
    #: contexts, the most members; and the sentences of a text that are swapped, and how strongly a change counts
    family_terms: int = 300
    family_df: float = 0.02
    family_ratio: float = 2.0
    likeness: float = 0.8
    family_size: int = 12
    swaps_per_text: int = 4
    learned: float = 5.0
    min_df: int = 4
    min_z: float = 5.0
    max_features: int = 3000
    prefix_lengths: tuple[int, ...] = (4, 5, 6, 7)
    l2: float = 0.2
    counterfactual: float = 5.0
    steps: int = 300
    families: tuple[tuple[str, ...], ...] = IDENTITY_TERMS


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    prefix_lengths: tuple[int, ...]
    #: counterfactuals that the fit used, of given and of learned families
    changes: tuple[int, int] = (0, 0)
    memo: dict[str, tuple] = field(default_factory=dict, repr=False, compare=False)

    def score(self, text: str | None) -> float:
        z = self.bias + sum(v * self.weights[f] for f, v in values(Counter(WORD.findall((text or "").lower())), self._of).items())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def _of(self, word: str) -> tuple:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            got = self.memo[word] = tuple(f for f in features(word, self.prefix_lengths) if f in self.weights)
        return got


def features(word: str, lengths: tuple[int, ...]) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in lengths if len(word) > n), *(f"*{word[-n:]}" for n in lengths if len(word) > n)]


def values(words: Counter, of) -> dict[str, float]:
    """Feature values of a bag of words: how often a feature occurs, damped, against the text's length."""
    counts: Counter = Counter()
    for word, n in words.items():
        for f in of(word):
            counts[f] += n
    # a long clean text meets more features by chance than a short one
    scale = 1.5 * math.sqrt(200 / (200 + sum(words.values())))
    return {f: scale * (1 + math.log(n)) for f, n in counts.items()}


def swapped(sentence: list[str], families: tuple[tuple[str, ...], ...]) -> Iterator[list[str]]:
    """The counterfactuals of a sentence: its identity terms moved along their family, once for each shift."""
    place = {term: (family, k) for family in families for k, term in enumerate(family)}
    hits = [w for w in sentence if w in place]
    for shift in range(1, max((len(place[w][0]) for w in hits), default=0)):
        yield [place[w][0][(place[w][1] + shift) % len(place[w][0])] if w in place else w for w in sentence]


def contexts(text: str | None, terms: set[str]) -> Counter:
    """How often each term stands before and after each other, within sentences."""
    out: Counter = Counter()
    for sentence in SENTENCE.split((text or "").lower()):
        words = WORD.findall(sentence)
        for a, b in zip(words, words[1:], strict=False):
            if a in terms and b in terms:
                out[a, f">{b}"] += 1
                out[b, f"<{a}"] += 1
    return out


def families_of(terms: list[str], counts: Counter, params: ToxicityParams) -> tuple[tuple[str, ...], ...]:
    """Families of interchangeable terms (given in falling order of frequency): each joins the family whose first member's contexts are most like its own."""
    column = {c: k for k, c in enumerate(sorted({c for _, c in counts}))}
    row = {t: k for k, t in enumerate(terms)}
    table = np.zeros((len(terms), max(1, len(column))))
    for (t, c), n in counts.items():
        table[row[t], column[c]] = math.sqrt(n)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    found: list[list[str]] = []
    for t in terms:
        like = [(float(table[row[t]] @ table[row[f[0]]]), -k) for k, f in enumerate(found) if len(f) < params.family_size]
        best = max(like, default=(0.0, 0))
        if best[0] >= params.likeness:
            found[-best[1]].append(t)
        else:
            found.append([t])
    known = {t for family in params.families for t in family}
    return tuple(kept for f in found if len(kept := tuple(t for t in f if t not in known)) > 1)


def common_terms(counts, n1: int, n0: int, params: ToxicityParams) -> list[str]:
    """Of (word, rows labelled toxic, rows labelled clean) the words that may be in a learned family, the most frequent first."""
    least = max(params.min_df, params.family_df * n0)
    kept = [(-clean, w) for w, toxic, clean in counts if clean >= least and toxic * n0 <= params.family_ratio * clean * max(1, n1)]
    return [w for _, w in sorted(kept)[: params.family_terms]]


def learned_swaps(text: str | None, place: dict[str, tuple[tuple[str, ...], int]], most: int) -> Iterator[tuple[list[str], list[str]]]:
    """Sentences with terms of learned families, those of least hash, and each with its terms moved along their families."""
    hits = []
    for sentence in {*SENTENCE.split((text or "").lower())}:
        words = WORD.findall(sentence)
        if any(w in place for w in words):
            hits.append((zlib.crc32(sentence.encode()), words))
    for h, words in sorted(hits)[:most]:
        moved = lambda w: (f := place[w][0])[(place[w][1] + 1 + h % (len(f) - 1)) % len(f)]
        yield words, [moved(w) if w in place else w for w in words]


def strength(positive: int, negative: int, n1: int, n0: int) -> float:
    """Two-proportion z of a feature's document frequency between the labels."""
    p = (positive + negative + 1) / (n0 + n1 + 2)
    return abs(positive / max(1, n1) - negative / max(1, n0)) / math.sqrt(p * (1 - p) * (1 / max(1, n0) + 1 / max(1, n1)))


def present(text: str | None, lengths: tuple[int, ...]) -> set[str]:
    return {f for w in set(WORD.findall((text or "").lower())) for f in features(w, lengths)}


def design(text: str | None, index: dict[str, int], params: ToxicityParams, learned: tuple[tuple[str, ...], ...] = ()) -> tuple[dict, list[dict], list[dict]]:
    """A text's values of the indexed features, and how each counterfactual of its sentences changes them: along given and along learned families."""
    of = lambda w: [f for f in features(w, params.prefix_lengths) if f in index]
    lowered = (text or "").lower()
    row = {index[f]: v for f, v in values(Counter(WORD.findall(lowered)), of).items()}
    def change(words: list[str], other: list[str]) -> dict[int, float]:
        x, y = values(Counter(words), of), values(Counter(other), of)
        return {index[f]: x.get(f, 0) - y.get(f, 0) for f in {*x, *y} if x.get(f, 0) != y.get(f, 0)}

    changes = []
    if any(t in lowered for family in params.families for t in family):
        for sentence in SENTENCE.split(lowered):
            words = WORD.findall(sentence)
            changes += [change(words, other) for other in swapped(words, params.families)]
    place = {t: (family, k) for family in learned for k, t in enumerate(family)}
    more = [change(*pair) for pair in learned_swaps(text, place, params.swaps_per_text)] if place else []
    return row, [c for c in changes if c], [c for c in more if c]


#: a labelled text's rows of the design, and the columns of each: how many, and the bytes of Sparse.packed()
KINDS = ("row", "changes", "more")
PARTS = ("n", "sizes", "cols", "vals")


class Sparse:
    """Rows of numbered values as arrays: how many each row has, their columns (int32) and the values, end to end."""

    def __init__(self, sizes: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        self.sizes, self.cols, self.vals = sizes, cols, vals
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    @classmethod
    def of(cls, rows: list[dict[int, float]]) -> Sparse:
        sizes = np.fromiter(map(len, rows), np.int32, len(rows))
        return cls(sizes, np.fromiter((c for r in rows for c in r), np.int32), np.fromiter((v for r in rows for v in r.values()), np.float64))

    @classmethod
    def unpacked(cls, parts: list[tuple[bytes, bytes, bytes]]) -> Sparse:
        """The rows of several packed() one after the other."""
        joined = (np.frombuffer(b"".join(p[k] for p in parts), kind) for k, kind in enumerate((np.int32, np.int32, np.float64)))
        return cls(*joined)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.sizes.tobytes(), self.cols.tobytes(), self.vals.tobytes()

    def first(self, most: int) -> Sparse:
        kept = self.sizes[:most]
        n = int(kept.sum())
        return Sparse(kept, self.cols[:n], self.vals[:n])

    def __len__(self) -> int:
        return len(self.sizes)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.vals * w[self.cols], len(self))

    def back(self, r: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.cols, self.vals * r[self.row], n)


def solve(rows: list[dict], changes: list[dict], labels: list[int], n: int, params: ToxicityParams, more: list[dict] = ()) -> tuple[np.ndarray, float]:
    """descend(), for rows as dictionaries."""
    return descend(Sparse.of(rows), Sparse.of(changes), labels, n, params, Sparse.of(list(more)))


def descend(main: Sparse, changes: Sparse, labels: list[int], n: int, params: ToxicityParams, more: Sparse) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the regularised loss; deterministic for the same rows in the same order.

    The loss: mean logistic loss + l2 / rows * |w|^2 + counterfactual * mean (c w)^2 of changes + learned * mean (c w)^2 of more.
    """
    penalties = [(c, weight / len(c)) for c, weight in ((changes, params.counterfactual), (more, params.learned)) if len(c)]
    y = np.asarray(labels, float)
    w, b = np.zeros(n), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    m1, m2, mb1, mb2 = np.zeros(n), np.zeros(n), 0.0, 0.0
    rate = 0.05
    for step in range(1, params.steps + 1):
        z = np.clip(main.times(w) + b, -40, 40)
        r = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = main.back(r, n) + params.l2 * w / len(y) * 2
        for swaps, weight in penalties:
            g += 2 * weight * swaps.back(swaps.times(w), n)
        gb = r.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.999 * mb2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        b -= rate * (mb1 / c1) / (math.sqrt(mb2 / c2) + 1e-8)
    return w, float(b)


def modelled(index: dict[str, int], rows: Sparse, changes: Sparse, more: Sparse, labels: list[int], params: ToxicityParams) -> ToxicityModel:
    if not index or len(set(labels)) < 2:
        rate = (sum(labels) + 0.5) / (len(labels) + 1)
        return ToxicityModel({}, math.log(rate / (1 - rate)), params.prefix_lengths)
    changes, more = changes.first(params.max_changes), more.first(params.max_changes)
    w, b = descend(rows, changes, labels, len(index), params, more)
    return ToxicityModel({f: float(w[k]) for f, k in index.items() if abs(w[k]) > 1e-3}, b, params.prefix_lengths, (len(changes), len(more)))


def indexed(strong: list[str], learned: tuple[tuple[str, ...], ...]) -> dict[str, int]:
    """Numbers of the features: the strong ones, and the members of learned families, for a swap to act on them."""
    return {f: k for k, f in enumerate(sorted({*strong, *(t for family in learned for t in family)}))}


def fit(texts: list[str | None], labels: list[int], params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """The same as train(), for lists."""
    n1, n0 = sum(labels), len(labels) - sum(labels)
    seen: dict[str, list[int]] = {}
    for text, y in zip(texts, labels, strict=True):
        for f in present(text, params.prefix_lengths):
            seen.setdefault(f, [0, 0])[y] += 1
    strong = sorted((-strength(p, q, n1, n0), f) for f, (q, p) in seen.items() if p + q >= params.min_df and strength(p, q, n1, n0) >= params.min_z)
    terms = common_terms(((f, p, q) for f, (q, p) in seen.items() if "*" not in f), n1, n0, params)
    counts: Counter = Counter()
    for t in texts:
        counts.update(contexts(t, set(terms)))
    learned = families_of(terms, counts, params)
    index = indexed([f for _, f in strong[: params.max_features]], learned)
    parts = [design(t, index, params, learned) for t in texts]
    changes, more = (Sparse.of([c for part in parts for c in part[k]]) for k in (1, 2))
    return modelled(index, Sparse.of([row for row, *_ in parts]), changes, more, labels, params)


def held_out(doc_id):
    """True for the fifth of ids on which nothing may be learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fits on at most max_train_rows labelled rows that aren't held out: those with the least hash of their id."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_train_rows)
    ids = {r["doc_id"]: int(r["toxic"]) for r in chosen.collect()}  # at most max_train_rows pairs
    keys = documents.sparkSession.createDataFrame([(k, v) for k, v in sorted(ids.items())], "doc_id long, toxic int")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(keys), "doc_id")
    found = stored(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for f in present(text, params.prefix_lengths):
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([p for _, p in seen.values()], pa.int64()), pa.array([q for q, _ in seen.values()], pa.int64())], ["feature", "positive", "negative"])

    sizes = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counted = found.mapInArrow(count, "feature string, positive long, negative long").groupBy("feature").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    p = (F.col("positive") + F.col("negative") + 1) / (n0 + n1 + 2)
    z = F.abs(F.col("positive") / max(1, n1) - F.col("negative") / max(1, n0)) / F.sqrt(p * (1 - p) * (1 / max(1, n0) + 1 / max(1, n1)))
    strong = counted.where(F.col("positive") + F.col("negative") >= params.min_df).withColumn("z", z).where(F.col("z") >= params.min_z)
    chosen = strong.orderBy(F.desc("z"), "feature").limit(params.max_features).select("feature").collect()
    learned = train_families(found, counted.where(~F.col("feature").contains("*")), n1, n0, params)
    index = indexed([r["feature"] for r in chosen], learned)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [design(t, index, params, learned) for t in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id"), batch.column("toxic")]
            for rows in ([[row] for row, *_ in parts], *([part[k][: params.max_changes] for part in parts] for k in (1, 2))):
                packed = [Sparse.of(r).packed() for r in rows]
                arrays += [pa.array([len(r) for r in rows], pa.int32()), *(pa.array([p[k] for p in packed], pa.binary()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "toxic", *(f"{kind}_{part}" for kind in KINDS for part in PARTS)])

    columns = ", ".join(f"{kind}_{part} {'int' if part == 'n' else 'binary'}" for kind in KINDS for part in PARTS)
    laid = stored(found.mapInArrow(lay_out, f"doc_id {dict(found.dtypes)['doc_id']}, toxic int, {columns}"), "toxicity-design")
    name = F.col("doc_id").cast("string")
    place = F.struct(F.crc32(name.cast("binary")).alias("hash"), name.alias("name"))

    def sent(kind: str, rows: DataFrame) -> Sparse:
        got = rows.select(place.alias("place"), *(f"{kind}_{part}" for part in PARTS[1:])).collect()
        return Sparse.unpacked([tuple(r)[1:] for r in sorted(got, key=lambda r: tuple(r["place"]))])

    def sampled(kind: str) -> Sparse:
        """The counterfactuals of texts in order of place, of as many as give max_changes."""
        rows, total = laid.where(F.col(f"{kind}_n") > 0), 0
        for r in order:
            total += r[f"{kind}_n"]
            if total >= params.max_changes:
                return sent(kind, rows.where(place <= F.struct(F.lit(r["place"]["hash"]).alias("hash"), F.lit(r["place"]["name"]).alias("name"))))
        return sent(kind, rows)

    # at most max_train_rows rows of chosen features
    order = sorted(laid.select(place.alias("place"), "toxic", "changes_n", "more_n").collect(), key=lambda r: tuple(r["place"]))
    return modelled(index, sent("row", laid), sampled("changes"), sampled("more"), [r["toxic"] for r in order], params)


def train_families(found: DataFrame, counted: DataFrame, n1: int, n0: int, params: ToxicityParams) -> tuple[tuple[str, ...], ...]:
    """families_of, with frequencies and contexts counted on the executors: at most family_terms words and the pairs of them are collected."""
    least = max(params.min_df, params.family_df * n0)
    neutral = F.col("positive") * n0 <= params.family_ratio * F.col("negative") * max(1, n1)
    common = counted.where((F.col("negative") >= least) & neutral).orderBy(F.desc("negative"), "feature").limit(params.family_terms)
    terms = common_terms(((r["feature"], r["positive"], r["negative"]) for r in common.collect()), n1, n0, params)
    known = set(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(contexts(text, known))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([c for _, c in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "context", "n"])

    pairs = found.select("text").mapInArrow(near, "term string, context string, n long").groupBy("term", "context").agg(F.sum("n").alias("n"))
    return families_of(terms, Counter({(r["term"], r["context"]): r["n"] for r in pairs.collect()}), params) if terms else ()


def score(documents: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """documents with a column score: one pass over whole texts, no shuffle."""
    spark = documents.sparkSession
    keep = [c for c in (keep or documents.columns) if c != "score"]
    sent = spark.sparkContext.broadcast(model)  # bounded: features with min_df among max_train_rows rows
    source = documents.select(*keep, *([] if "text" in keep else ["text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            scores = pa.array([m.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), scores], [*keep, "score"])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = train(documents, read_table(spark, sf_dir, "labels"))
    out = score(documents, model, ["doc_id"])
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """The pipeline stage: documents scored under the threshold, with their columns as they came."""
    model = train(docs, read_table(spark, sf_dir, "labels"))
    inside, back = shielded(docs, ("score",))
    return back(score(inside, model).where(F.col("score") < threshold))
