"""Decontamination, licences, packing and near duplicates against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import cases
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratalog.llm import decontaminate, licenses, neardup, packing
from stratalog.llm.components import components
from stratalog.llm.textvec import SPACES, fingerprint

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(LOWER))


def leaks(texts, items):
    for doc_id, text in texts:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            b = words(body)
            for k in range(max(1, len(b) - 9) if b else 0):
                window = b[k : k + 10]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        found.add(str(item if item is not None else ""))
        ids = ",".join(sorted(found))
        yield (doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))


ITEMS = [(1, "the quick brown fox jumps over the lazy dog while seven wise owls"), (2, "owls watch from tall"), (10, "one"), (3, None), (4, ""), (None, "TWO,three"), (1, "the quick brown fox jumps over the lazy dog while seven wise owls"), (7, "it has two sentences and a line")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_decontaminate_small(spark, block_bytes):
    docs, items = cases.documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.mark(docs, items, ["doc_id"], block_bytes).collect()
    rows = sorted(((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), len(r["items"]), decontaminate.digest(r["items"]), bool(r.spans)) for r in got), key=str)
    assert rows == sorted(leaks([t for t in cases.TEXTS], ITEMS), key=str)


def test_decontaminate_real(spark, sf):
    texts = [(r.doc_id, r.text) for r in cases.real(spark, sf).collect()]
    items = [(r.item_id, r.text) for r in cases.real(spark, sf, "benchmark").collect()]
    got = sorted(tuple(r) for r in decontaminate.query(spark, sf).collect())
    short = [(i, t) for i, t in texts if len(t) < 20_000]
    keep = {i for i, _ in short}
    assert [r for r in got if r[0] in keep] == sorted(leaks(short, items))
    assert len(got) == len(texts) and any(r[5] for r in got)


def test_windows_of_one_token(spark):
    """Many windows that share their rarest shingle, in documents that hold it often; equal windows of several items."""
    phrase = "p q r s t"
    items = [(k, f"a{k} b c d e {phrase}") for k in range(300)] + [(1000, f"a5 b c d e {phrase}"), (1001, phrase)]
    texts = [(1, f"a{7} b c d e {phrase} " * 50), (2, f"a5 b c d e {phrase}"), (3, f"b c d e {phrase}"), (4, f"a999 b c d e {phrase}")]
    got = decontaminate.mark(cases.documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    rows = sorted((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), len(r["items"]), decontaminate.digest(r["items"]), bool(r.spans)) for r in got)
    assert rows == sorted(leaks(texts, items))


def test_decontaminate_empty(spark):
    docs, items = cases.documents(spark), spark.createDataFrame([], "item_id long, text string")
    assert not any(r.spans for r in decontaminate.mark(docs, items).collect())
    assert decontaminate.mark(docs.limit(0), items).columns == [c for c in docs.columns if c != "spans"] + ["n_words", "spans", "items"]


def test_licenses_in_long_texts():
    """Time grows with the text, not with its square: notices, a chain of operands, nested brackets."""
    import time

    chain = " or ".join(f"a{k} and b" for k in range(20_000))
    nested = "(a or " * 3000 + "b" + ")" * 3000
    for text in ("mit license " * 200_000, f"SPDX-License-Identifier: {chain}", f"SPDX-License-Identifier: {nested}", "SPDX-License-Identifier: " + "x and (y or z) or " * 20_000 + "w"):
        began = time.perf_counter()
        found = licenses.scan(text.encode())
        assert time.perf_counter() - began < 4
    assert licenses.scan(b"x mit license " * 50_000)["last_word"] == 149_998
    assert licenses.infix(licenses.postfix("a and (b or c with d) or e")) == "a and (b or c with d) or e" and found["labels"]


def places(text):
    w = words(text)
    got = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    return len(w), got


def test_licenses(spark, sf):
    extra = [(20, "MIT license MIT License, apache/license"), (21, "GNU general public license general public license"), (22, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nx"), (23, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */"), (24, "spdx-license-identifier: (MIT OR")]
    texts = cases.TEXTS + extra + [(r.doc_id + 1000, r.text) for r in cases.real(spark, sf).collect()]
    rows = licenses.licenses(cases.documents(spark, texts), ["doc_id", "source", "score"]).collect()
    assert len(rows) == len(texts)
    for (_, text), r in zip(sorted(texts, key=str), sorted(rows, key=lambda r: str((r.doc_id,))), strict=True):
        pass
    of = {r.doc_id: r for r in rows}
    for i, text in texts:
        if i is None or i == 2:
            continue
        n, got = places(text)
        r = of[i]
        assert (r.n_words, r.n_base) == (n, len(got))
        assert (r.first_word, r.last_word) == (min((k for k, _ in got), default=None), max((k for k, _ in got), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in got}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert of[22].labels == "apache,bsd,mit" and of[23].labels == "gpl" and of[24].labels == "mit"
    assert of[22].alternatives == ["apache-2.0 and bsd-3-clause", "bsd-3-clause and mit"]


def test_shunting_yard():
    assert licenses.postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.postfix("(a or b) and c") == ["a", "b", "or", "c", "and"]
    assert licenses.postfix("a or") is None and licenses.postfix("(a") is None and licenses.postfix("and a") is None
    assert licenses.alternatives("mit or (apache-2.0 and bsd)") == [frozenset({"apache-2.0", "bsd"}), frozenset({"mit"})]


def test_expression_of_many_ways():
    """13 pairs are 8192 ways: labels are all of the operands, the expression stays as it is; equal sets count once."""
    text = " and ".join(f"(0bsd-{k} or ms-pl-{k})" for k in range(13))
    found = licenses.scan(f"SPDX-License-Identifier: {text} and postgresql with some-exception".encode())
    assert set(found["labels"].split(",")) == {f"{x}-{k}" for x in ("0bsd", "ms-pl") for k in range(13)} | {"postgresql"}
    assert found["alternatives"] == [text + " and postgresql with some-exception"]
    assert licenses.alternatives(" and ".join(["(mit or isc)"] * 20)) == [frozenset({"isc"}), frozenset({"isc", "mit"}), frozenset({"mit"})]


def check_packing(rows, texts):
    t = tokenizer_as_is()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[i][r.start : r.start + r.length]
            assert r.start == at and r.length == len(part) > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / sum(map(len, ids.values()))


def test_packing(spark, sf):
    real = [(r.doc_id, r.text) for r in cases.real(spark, sf).collect()]
    assert check_packing(packing.query(spark, sf).collect(), real) < 0.02
    small = [(i, t) for i, t in cases.TEXTS if i not in (None, 2)]
    check_packing(packing.packed(cases.documents(spark, small), stretch=5000).collect(), small)
    assert packing.packed(cases.documents(spark, [])).collect() == []
    assert packing.packed(cases.documents(spark)).groupBy().sum("length").collect()


SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|><|endoftext|>\n", "<|endoftext|", "<|ENDOFTEXT|>", "One. <|endoftext|>Two!"]


def test_same_ids_with_added_tokens(spark):
    """The tokenizer file as it is: its added token is one id."""
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: [*own.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(SPECIAL)}
    assert want[1] == [64, 50256, 65, 0]
    rows = packing.packed(cases.documents(spark, list(enumerate(SPECIAL))), with_ids=True).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        got[r.doc_id] += r["ids"]
    assert got == want and all(r.doc_tokens == len(want[r.doc_id]) for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.one_of(st.text(max_size=12), st.just("<|endoftext|>")), max_size=6).map("".join)))
def test_same_ids_as_the_file_gives(text):
    fast, _ = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    own = tokenizer_as_is()
    assert fast.encode(text, allowed_special="all") == own.encode(text, add_special_tokens=False).ids


def tokenizer_as_is(kept=[]):  # noqa: B006
    """The library with the file as it loads it."""
    if not kept:
        kept.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return kept[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=14), st.data())
def test_cuts_are_optimal(gaps, data):
    import numpy as np

    length = 16
    bounds = np.cumsum([0, *gaps])
    costs = np.array([float(data.draw(st.sampled_from([0, 2, 7]))) for _ in bounds])
    best = [0.0] + [float("inf")] * (len(bounds) - 1)
    for j in range(1, len(bounds)):
        for i in range(j):
            n = int(bounds[j] - bounds[i])
            if n <= length:
                best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else length - n) + costs[j])
    got = [0, *packing.cuts(bounds, costs, length)]
    total = sum((0 if (n := int(bounds[j] - bounds[i])) & (n - 1) == 0 else length - n) + costs[j] for i, j in zip(got, got[1:], strict=False))
    assert total == best[-1] and got[-1] == len(bounds) - 1


def groups(texts, width):
    sets = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            s, u = sets[a][1], sets[b][1]
            if s and u and min(len(s), len(u)) * 100 >= 80 * max(len(s), len(u)) and 100 * len(s & u) >= 80 * len(s | u):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted({(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)})


def test_near_duplicates(spark, sf):
    texts = [(r.doc_id, r.text) for r in cases.real(spark, sf).collect()] + [(i + 10_000, t) for i, t in cases.TEXTS if i]
    got = neardup.near_duplicates(cases.documents(spark, texts), 4).collect()
    assert len(got) == len(texts)
    assert sorted({(r.doc_id, r.n_shingles, r.component_id) for r in got}) == groups(texts, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    odd = {(r.component_id, r.kept) for r in neardup.near_duplicates(cases.documents(spark)).collect() if r.doc_id is None}
    assert odd == {(None, True)}
    assert neardup.near_duplicates(cases.documents(spark, [])).collect() == []


def test_near_duplicates_across_a_chain(spark):
    """Links that the least member of a bucket does not have are found too."""
    import random

    rng = random.Random(5)
    texts, w = [], [f"w{rng.randrange(10**6)}" for _ in range(200)]
    for k in range(40):
        texts.append((100 - k, " ".join(w)))
        for _ in range(4):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
    got = neardup.near_duplicates(cases.documents(spark, texts), 4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == groups(texts, 4)


def signature_rows(sigs, n=100):
    odd = bytes(neardup.ODD_BITS // 8)
    return [(k, n, s, odd) for k, s in enumerate(sigs)]


def test_wide_buckets_are_split(spark, monkeypatch):
    """Members of one bucket that nothing links: dealt rows stay a small multiple of the members; all pairs within the distance are found.

    One bucket holds 20,000 members that share a chunk alone (split), another 900 whose values mostly agree (too much alike to split).
    """
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    far = rng.integers(0, 1 << 16, (20_000, 64))
    far[:, 8:12] = 7
    for k in range(0, 60, 2):  # pairs with 31 errors, all outside of the shared chunk
        far[k + 1] = far[k]
        far[k + 1, rng.choice([c for c in range(64) if not 8 <= c < 12], 31, replace=False)] ^= 1 << 5
    near = np.tile(rng.integers(0, 1 << 16, 64), (900, 1))
    for row in near:
        row[rng.choice(np.r_[0:40, 44:64], 24, replace=False)] = rng.integers(0, 1 << 16, 24)
    sigs = np.concatenate([far, near]).astype("<u2")
    signed = spark.createDataFrame(signature_rows([s.tobytes() for s in sigs]), "node long, n_shingles long, sig binary, odd binary")
    both = neardup.keys(signed)
    key = {10: 2 << 50, 20_100: 10 << 50}  # no value of the chunk wrong, as the first mask has it
    first = lambda node: both.where(f"node = {node} and (key >> 50) = {key[node] >> 50} and ((key >> 48) & 3) = 0").select("key")
    members = both.join(first(10).union(first(20_100)), "key").cache()
    assert members.count() == 20_900
    labels = spark.createDataFrame([], "node long, component long")
    monkeypatch.setattr(neardup, "BLOCK", 300)
    dealt = neardup.dealt_for_pairs(members, labels, signed).cache()
    n = {r.key >> 50: (r.n, r.subs) for r in dealt.groupBy("key").agg(F.count("*").alias("n"), F.max("sub").alias("subs")).collect()}
    assert n[2][0] < 5 * 20_000 and n[2][1] > 0 and n[10][1] == 0 and n[10][0] <= 900 * 4 + 3
    monkeypatch.setattr(neardup, "may_link", lambda a, x, b, y: np.ones(np.broadcast(a, b).shape, bool))
    rows = neardup.near_pairs
    got = set()
    for r in dealt.where("key >> 50 = 2").toPandas().groupby(["key", "sub", "i", "j"]):
        import pyarrow as pa

        found = rows(pa.Table.from_pandas(r[1][["key", "side", "node", "label", "n_shingles", "sig", "odd"]], preserve_index=False))
        got |= set(zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True))
    least_key = lambda a, b: next(c for c in range(16) if (sigs[a, 4 * c : 4 * c + 4] == sigs[b, 4 * c : 4 * c + 4]).sum() >= 3)
    want = {(k, k + 1) for k in range(0, 60, 2) if least_key(k, k + 1) == 2}
    assert got == want and len(want) > 3


def test_hot_pivots_are_spread(spark, monkeypatch):
    """A joined key of many rows goes to several tasks; the join is the same."""
    from pyspark.sql import functions as F

    from stratalog.llm import common

    monkeypatch.setattr(common, "SALT_ROWS", 50)
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 1).when(F.col("id") < 2900, F.col("id") % 90).cast("long").alias("k"), "id")
    table = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = common.salted_join(df, table, "k", ["id"], how)
        assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(map(str, df.join(table, "k", how).select("k", "id", "v").collect()))
    anti = common.salted_join(df, table, "k", ["id"], "left_anti")
    assert sorted(map(str, anti.select("id").collect())) == sorted(map(str, df.join(table, "k", "left_anti").select("id").collect()))


def test_pigeonhole_keys(spark):
    """Signatures within the distance always share a key."""
    import random

    rng = random.Random(3)
    rows = []
    for k in range(60):
        sig = [rng.randrange(65536) for _ in range(64)]
        other = list(sig)
        for at in rng.sample(range(64), 31):
            other[at] ^= rng.randrange(1, 65536)
        rows += [(2 * k, b"".join(x.to_bytes(2, "little") for x in sig)), (2 * k + 1, b"".join(x.to_bytes(2, "little") for x in other))]
    keys = neardup.keys(spark.createDataFrame(rows, "node long, sig binary")).collect()
    of = defaultdict(set)
    for r in keys:
        of[r.node].add(r.key)
    assert all(of[2 * k] & of[2 * k + 1] for k in range(60)) and all(len(s) == 64 for s in of.values())


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 30)] + [(50, 40), (40, 50), (60, 60), (70, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 70: 0, 40: 40, 50: 40}


def test_few_words(spark):
    """A batch of fewer words than a shingle has."""
    one = spark.createDataFrame([(1, "two words")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(5, "two words")], "item_id long, text string").coalesce(1)
    assert [tuple(r) for r in neardup.near_duplicates(one).collect()] == [(1, 1, 1, True)]
    assert [(r.n_words, r.spans, r["items"]) for r in decontaminate.mark(one, items).collect()] == [(2, [0, 2], ["5"])]
    assert decontaminate.mark(one, items.limit(0)).first().spans == []


def test_fingerprint_is_exact():
    a, b = fingerprint([b"a b c d e", b"A b  c\td e"], SPACES, 4)
    assert (a == b).all() and len(a) == 2
