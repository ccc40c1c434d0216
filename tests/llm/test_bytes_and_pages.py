"""Fingerprints, repeated substrings, WARC archives and HTML extraction against brute force."""

import gzip
import hashlib
import random
import re
from html import unescape

import cases
import pytest

from stratalog.llm import common, fingerprints, substrings, warc, wrapper


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---- repeated substrings


def removed(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                s = b[p : p + 50]
                first[s] = min(first.get(s, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        yield (i, len(b), sum(gone), spans, sha(kept))


def mixed(n=120, seed=4):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcde é\n") for _ in range(rng.randint(30, 160))) for _ in range(12)]
    out = []
    for k in range(n):
        text = ""
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, max(0, len(p) - 20))
            text += p[a : a + rng.randint(10, 120)] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        out.append((k, text))
    return out + [(None, passages[0]), (500, None), (501, "a" * 3000), (502, "a" * 120), (503, "ab" * 90), (7, passages[1] * 2), (7, passages[1] * 2)]


@pytest.mark.parametrize("batch_bytes,fan,hot", [(4 << 20, 256, 1 << 15), (2000, 256, 1 << 15), (2000, 8, 10), (2000, 8, 0), (2000, 4, 1 << 15), (4000, 2, 3)])
def test_substrings_mixed(spark, batch_bytes, fan, hot):
    """One level, two of short codes, and three and more of whole keys."""
    rows = mixed()
    got = substrings.repeated_substrings(cases.documents(spark, rows), batch_bytes, fan, hot).drop("removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(removed(rows), key=str)


def test_substrings_hot_phrase(spark):
    """A phrase of 30 bytes in every text, between words of the text's own; some texts share those too."""
    rng = random.Random(8)
    phrase = "all rights reserved worldwide!"
    rows = [(k, f"{rng.randrange(150):040d}{phrase}{rng.randrange(150):040d}") for k in range(600)]
    for hot in (1 << 15, 300):
        got = substrings.repeated_substrings(cases.documents(spark, rows), 9000, 4, hot).drop("removed").collect()
        assert sorted(map(tuple, got)) == sorted(removed(rows))


def test_substrings_levels():
    """Rows a batch sends do not grow with the number of batches; a passage of every batch is one row in the fan-out a level up."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    passage = "a passage that stands in each and every document of the corpus, as it is"
    for batches, depth in ((3, 1), (4, 1), (16, 2), (60, 3)):
        shape = substrings.Levels(batches, 4)
        assert shape.depth == depth
        table = lambda k: pa.table({"batch": [k] * 2, "doc_id": [2 * k, 2 * k + 1], "text": [f"{k:060d}{passage}{-k:060d}".encode(), passage.encode()]})
        level = pa.concat_tables([substrings._keys(shape)(table(k)) for k in range(batches)])
        whole = np.unique(np.concatenate([substrings.Batch(table(k), shape).codes for k in range(batches)]))
        for n in range(1, depth):
            assert level.num_rows <= 4 * batches
            units = level.group_by(["prefix", "unit"]).aggregate([("child", "count")])
            assert max(units.column("child_count").to_pylist()) <= 4
            parts = [level.filter(pc.and_(pc.equal(level["prefix"], p), pc.equal(level["unit"], u))) for p, u in zip(units["prefix"].to_pylist(), units["unit"].to_pylist(), strict=True)]
            level = pa.concat_tables([substrings._keys_up(shape, n)(x) for x in parts])
        assert set(level.column("unit").to_pylist()) == {0}
        codes = np.concatenate([np.frombuffer(x, shape.code) for x in level.column("codes").to_pylist()])
        assert set(codes.tolist()) == set(whole.tolist())


def test_substrings_passage_in_every_batch(spark):
    passage = "a passage that stands in each and every document of the corpus, as it is"
    rows = [(k, f"{k:07d} {passage} {k * 7919:012d}") for k in range(400)]
    got = substrings.repeated_substrings(cases.documents(spark, rows), 600, 4).drop("removed").collect()
    assert sorted(map(tuple, got)) == sorted(removed(rows))


def test_substrings_slices(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 100)
    texts = [(t or "").encode() for _, t in mixed()]
    small = substrings.Anchors(texts)
    monkeypatch.undo()
    large = substrings.Anchors(texts)
    places = lambda a: sorted((int(t), p) for t, f, e in zip(a.text, a.first, a.last) for p in range(f, e + 1))
    assert places(small) == places(large) == sorted((k, p) for k, t in enumerate(texts) for p in range(len(t) - 49))


def test_substrings_real(spark, sf):
    rows = [(r.doc_id, r.text) for r in cases.real(spark, sf).collect()]
    assert sorted(map(tuple, substrings.query(spark, sf).collect())) == sorted(removed(rows))
    assert substrings.repeated_substrings(cases.documents(spark, [])).collect() == []
    got = substrings.repeated_substrings(cases.documents(spark)).drop("removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(removed(cases.TEXTS), key=str)


# ---- fingerprints


def shingles(text):
    w = re.split(r"[ \t\n\x0b\f\r]+", text.strip(" \t\n\x0b\f\r"))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def jaccard(a, b):
    s, t = shingles(a), shingles(b)
    return len(s & t) / len(s | t)


def test_fingerprints(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in cases.real(spark, "/root/testdata/sf0.001").collect()]
    odd = [(i + 5000, t) for i, t in cases.TEXTS if i and i != 2]
    both = rows + odd
    cases.documents(spark, both).select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(both)
    order = sorted((i, t or "") for i, t in both)
    errors, by_text = [], {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == sha(edited.encode())
        assert len(r.fingerprint) == 128 and by_text.setdefault(t, r.fingerprint) == r.fingerprint
        errors += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, after)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1
    assert sum(abs(e) for e in errors) / len(errors) < 0.05 and max(map(abs, errors)) < 0.3


def test_next_over_many_buckets(spark):
    rng = random.Random(1)
    keys = rng.sample(range(-(10**9), 10**9), 300)
    docs = spark.createDataFrame([(k, f"text {k}") for k in keys], "k long, text string")
    got = {r.k: r.next_text for r in fingerprints.with_next(docs, bucket_bytes=40).collect()}
    order = sorted(keys)
    assert got == {k: f"text {order[(i + 1) % 300]}" for i, k in enumerate(order)}
    one = fingerprints.with_next(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].next_text == one[0].text
    assert fingerprints.with_next(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_likeness_is_unbiased(spark, bits):
    from pyspark.sql import functions as F

    p = fingerprints.FingerprintParams(bits=bits)
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        a = [str(rng.random()) for _ in range(400)]
        rows.append((" ".join(a), " ".join(a[:200] + [str(rng.random()) for _ in range(200)])))
    df = spark.createDataFrame(rows, "a string, b string").select(fingerprints.likeness(fingerprints.fingerprint(F.col("a"), p), fingerprints.fingerprint(F.col("b"), p), p).alias("j"))
    got = [r.j for r in df.collect()]
    assert abs(sum(got) / len(got) - sum(jaccard(a, b) for a, b in rows) / len(rows)) < 0.03


# ---- archives


def expected(rows):
    groups = {}
    for i, u, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            groups.setdefault(b, []).append((i is None, i or 0, u or "", i, u))
    for i, u, h in rows:
        b = (h or "").encode()
        own = min(groups[b]) if len(b) >= 100 else None
        if own is None or own[3:] == (i, u):
            yield (i, len(b), sha(b), "response", None)
        else:
            yield (i, len(b), sha(b), "revisit", own[3])


PAGES = [
    (1, "http://a.example/x?y=1#z", "<p>" + "é" * 60), (2, "http://b.example/", "<p>" + "é" * 60), (2, "http://b.example/", "<p>" + "é" * 60), (3, None, None), (4, "http://c", ""), (5, "junk\r\nline", "WARC/1.1\r\n\r\nWARC-Type: x\r\n" * 9),
    (6, "http://d", "WARC/1.1\r\n\r\nWARC-Type: x\r\n" * 9), (7, "u", "short"), (8, "u", "short"), (None, "u", "<p>" + "é" * 60), (None, None, "z" * 200), (9, "http://e/\t", "z" * 200), (10, "http://f", "x\r\n\r\n" * 40), (3, None, None),
]


@pytest.mark.parametrize("most,hot_keys", [(16 << 20, 256), (-1, 256), (-1, 2), (-1, 1)])
def test_archives_small(spark, tmp_path, monkeypatch, most, hot_keys):
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    monkeypatch.setattr(common, "HOT_KEYS", hot_keys)
    pages = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, type string")
    got = warc.captured(spark, pages, f"file://{tmp_path}/w").drop("uri").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(PAGES), key=str)
    assert warc.captured(spark, pages.limit(0), f"file://{tmp_path}/none").collect() == []
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.gz")))
    assert len(list(warc.parsed(data))) == 3 * (len(PAGES))
    assert "é".encode() * 60 in data


def test_archives_real(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in cases.real(spark, sf, "pages").collect()]
    assert sorted(map(tuple, warc.query(spark, sf).collect())) == sorted(expected(rows))


def test_assembly_over_two_hops(spark):
    blank = lambda i, kind, to=(), **x: {
        "record_id": i, "type": kind, "date": None, "uri": None, "concurrent_to": list(to), "refers_to": None, "declared_digest": None,
        "block": (i or "").encode(), "payload_bytes": 1, "payload_digest": "d", "skipped": 0,
    } | x
    rows = [blank("r1", "response"), blank("q1", "request", ["r1"]), blank("m1", "metadata", ["q1"]), blank("m2", "metadata", ["r1", "q1"]), blank("r2", "response", ["q2"]), blank("q2", "request"), blank("lost", "metadata", ["nowhere"]), blank("r3", "revisit"), blank(None, "skipped")]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert set(got) == {"r1", "r2", "r3"}
    assert got["r1"].request.record_id == "q1" and [m.record_id for m in got["r1"].metadata] == ["m1", "m2"]
    assert got["r2"].request.record_id == "q2" and got["r2"].metadata is None and got["r3"].request is None


def test_members_and_cuts():
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    data = warc.inflated(gzip.compress(one) + gzip.compress(one))
    assert [r["block"] for r in warc.parsed(data)] == [b"abc", b"abc"]
    cut = one[:-6]
    assert [(r["type"], r["skipped"]) for r in warc.parsed(cut)] == [("skipped", len(cut))] and list(warc.parsed(b"")) == []


GOOD = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


@pytest.mark.parametrize("bad", [GOOD.replace(b": 3", b": x"), GOOD.replace(b": 3", b": -3"), GOOD.replace(b"Content-Length: 3\r\n", b""), b"\0" * 40, b"no record at all"])
def test_unreadable_records(bad):
    """What is no record is skipped and counted; the records around it are read."""
    rows = list(warc.parsed(GOOD + bad + GOOD))
    assert [(r["block"], r["skipped"]) for r in rows] == [(b"abc", 0), (b"abc", len(bad.strip(b"\r\n")))]
    assert [r["skipped"] for r in warc.parsed(GOOD + bad)] == [0, len(bad.strip(b"\r\n"))]


def test_odd_headers_and_members():
    rows = list(warc.parsed(GOOD.replace(b"WARC-Type", b"X-\xff\xfe: 1\r\nWARC-Type")))
    assert [r["block"] for r in rows] == [b"abc"]
    member = gzip.compress(GOOD)
    broken = bytearray(gzip.compress(GOOD + bytes(range(256)) * 900))
    broken[len(broken) // 2 : len(broken) // 2 + 9] = b"\xff" * 9
    for data, n in ((member + bytes(512) + member, 2), (member + bytes(512), 1), (member + b"junk" + member, 2), (member + member[:20], 1), (bytes(broken) + member, 1), (member[:15] + b"\x00", 0)):
        found = [r for r in warc.parsed(warc.inflated(data)) if r["type"] != "skipped"]
        assert len(found) >= n and all(r["block"] == b"abc" for r in found)


# ---- pages


def plain(html):
    m = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)
    body = re.sub(r"<[a-z/!][^>]*$", "", m[1] if m else "")
    parts = [" ".join(unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in parts if x)


def test_pages_real(spark):
    sf = "/root/testdata/sf0.01"
    of = {r.page_id: r.html for r in cases.real(spark, sf, "pages").collect()}
    got = wrapper.query(spark, sf).collect()
    assert len(got) == len(of)
    for r in got:
        assert r.text == plain(of[r.page_id]) and r.n_chars == len(r.text)


def test_parts_left_out():
    html = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><div id=cookie-notice>We use <b>cookies</b></div>
    <nav><ul><li>a<li>b</ul></nav><main><article><header><h1>The &eacute;nd &amp; more</h1></header><p>One <i>two</i>
    three<p>Four<br>five<ul><li>six<li>seven</ul><script>var a = "<p>no</p>"</script><form><label>Mail</label><input></form><aside>side</aside>
    <div class="comments"><p>reader</p></div><table><tr><td>x<td>y</table></article></main><footer>foot</footer><!-- <p>c</p> --></body></html>"""
    assert wrapper.main_text(html) == "The énd & more\nOne two three\nFour five\nsix\nseven\nx\ny"
    assert wrapper.main_text(None) == wrapper.main_text("") == wrapper.main_text("<div><p") == ""
    assert wrapper.main_text("<p>a < b <p title='x>y'>c &am") == "a < b\nc &am"
    assert wrapper.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.mark.parametrize("most,hot_hosts", [(16 << 20, 256), (-1, 256), (-1, 2), (-1, 1)])  # broadcast; all hot; one hot, one not; none hot
def test_template_is_induced(spark, monkeypatch, most, hot_hosts):
    """Without any telling markup, what is constant on a host goes and what varies stays; copies do not vote for their own text."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    monkeypatch.setattr(common, "HOT_KEYS", hot_hosts)
    page = lambda k: f"<html><body><div>Our site since 1999</div><div><h1>Title {k}</h1><p>Story {k} text.</p><p>More of {k}.</p></div><div>Call us now</div></body></html>"
    rows = [(k, f"http://host.example/{k}", page(k)) for k in range(8)] + [(100 + k, "http://copies.example/x", page(1)) for k in range(8)] + [(200 + k, f"http://other.example/{k}", page(k).replace("Our", "Their")) for k in range(5)] + [(300, None, None), (301, "http://host.example/9", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.extracted(pages).collect()}
    assert got[3] == got[203] == "Title 3\nStory 3 text.\nMore of 3."
    assert "Story 1 text." in got[100] and got[300] == got[301] == "" and len(got) == len(rows)
    assert wrapper.extracted(pages.limit(0)).collect() == []


@pytest.mark.parametrize("html,want", [
    ('<div class="layout no-sidebar"><article><p>Story.</p></article></div><div>Other</div>', "Story."),
    ('<div class="sidebar"><div id="header"><article><h1>T</h1><p>Story.</p></article></div></div><p>Out</p>', "T\nStory."),
    ('<div class="search widget"><main><p>Story.</p></main></div><p>Elsewhere there is more</p>', "Story."),
    ('<article><h2 id="related-work">Related work</h2><p id="side-effects">Effects.</p><section id="search-results"><p>Found.</p></section><h3 id="search">Search</h3></article>', "Related work\nEffects.\nFound.\nSearch"),
    ('<article class="post comments-open"><p data-id="search">Story.</p></article>', "Story."),
    ('<article><p>A story of some length.</p></article><section class="related-posts"><article><p>Teaser</p></article></section><section class="comments"><article class="comment"><p>A reader has much to say of this.</p></article></section>', "A story of some length."),
    ('<article><p>Story.</p><div class="ad-slot"><p>Buy</p></div><div class="share-buttons">Share</div><section id="comments"><p>Reader</p></section><div class="left-sidebar">Side</div><ul class="related-links"><li>x</ul></article>', "Story."),
])
def test_names_of_parts(html, want):
    """Containers of the article, ids that only links use and words inside a name do not leave text out; names of parts still do."""
    assert wrapper.main_text(html) == want


HOSTS = {
    "masthead": lambda k: f"<header><h1>Site</h1></header><div>Our site since 1999</div><div><h2>Title {k}</h2><p>Story {k} text.</p></div><div>Call us now</div>",
    "unnamed": lambda k: f"<div><h1>Site</h1></div><div>Our site since 1999</div><div><h2>Title {k}</h2><p>Story {k} text.</p></div><div>Call us now</div>",
    "no-h1": lambda k: f"<nav><p>Menu</p></nav><div>Our site since 1999</div><div><h2>Title {k}</h2><p>Story {k} text.</p></div><div>Call us now</div>",
    "own": lambda k: f"<div>Our site since 1999</div><div><h1>Title {k}</h1><p>Story {k} text.</p></div><div>Call us now</div>",
}


def test_template_without_titles(spark):
    """Hosts of one h1, of none, and of two or three pages; copies still vote once, also where a counter tells them apart."""
    rows = [(f"{name}{n}/{k}", f"http://{name}{n}.example/{k}", page(k)) for name, page in HOSTS.items() for n in (2, 3, 9) for k in range(n)]
    same = "<article><h1>One</h1><p>The only story.</p><p>Read {k} times</p></article>"
    rows += [(f"near/{k}", f"http://near.example/{k}", same.format(k=k)) for k in range(9)] + [(f"copies/{k}", "http://copies.example/", HOSTS["no-h1"](1)) for k in range(9)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: r.text for r in wrapper.extracted(pages).collect()}
    want = {f"{name}{n}/{k}": f"Title {k}\nStory {k} text." for name in HOSTS for n in (2, 3, 9) for k in range(n)}
    assert {k: got[k] for k in want} == want
    assert got["near/3"] == "One\nThe only story.\nRead 3 times" and "Story 1 text." in got["copies/4"] and len(got) == len(rows)


def largest(a, b):
    """Simple tree matching as it is defined: (label, children) pairs, all pairs of children."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + largest(x, y))
    return best[-1][-1] + 1


def lines(tree, depth=0):
    return [f"{depth} {tree[0]}", *(x for c in tree[1] for x in lines(c, depth + 1))]


def test_tree_matching():
    rng = random.Random(4)

    def tree(label="html", depth=0):
        names = rng.sample(["div", "p", "ul", "div.a", "h2", "section", "table"], rng.randint(0, 5 if depth < 3 else 0))
        return (label, [tree(n, depth + 1) for n in names])

    for _ in range(150):
        a, b = tree(), tree()
        size, of = wrapper.matched("\n".join(lines(a)), "\n".join(lines(b)))
        assert size == largest(a, b) == len(of)
    assert wrapper.matched("0 html", "0 body") == (0, {})


@pytest.mark.parametrize("html,want", [
    ('<article><div class="article-header"><h1>Title</h1></div><p class="header">Head.</p><div class="ad-hoc">Ad hoc.</div><div class="social-history">History.</div><p class="side-note">Note.</p><p>Story.</p></article>', "Title\nHead.\nAd hoc.\nHistory.\nNote.\nStory."),
    ('<div class="post-header"><h1>Title</h1></div><p>Story.</p><div class="site-header">Site</div>', "Title\nStory."),
    ('<main><h1>Title</h1><p>The story of this page.</p></main><article class="card"><p>A teaser of quite another and longer story.</p></article>', "Title\nThe story of this page."),
    ('<main><div><article><p>Story.</p></article></div><p>More</p></main><article><p>Teaser</p></article>', "Story."),
    ('<main></main><article><p>Story.</p></article><p>Else</p>', "Story."),
])
def test_parts_of_articles(html, want):
    assert wrapper.main_text(html) == want


def test_pages_of_any_shape_in_linear_time():
    """Alternating and differing siblings, deep and unclosed elements; a page against its reference."""
    import time
    import tracemalloc

    siblings = "".join(f"<h2>H {k}</h2><p class=c{k}>text {k}</p>" for k in range(3000))
    pages = [
        "<h2>H</h2><p>x</p>" * 3000, siblings, "<i>" * 20_000 + "</b><p>x</p>" * 20_000, "<div>" * 20_000 + "deep", "<article>" * 20_000 + "deep", "<p>" * 20_000, "<td><tr>" * 10_000, "<a <b <c" * 20_000, "<li><ul>" * 10_000,
        "<div>" + "<p>a</p><div><p>b</p></div>" * 5000 + "</div>",
    ]
    for html in pages:
        began = time.perf_counter()
        tree = wrapper.skeleton(wrapper.parse(html))
        wrapper.main_text(html, tree, frozenset([(1, 1)]))
        assert time.perf_counter() - began < 3, html[:30]
    backwards = wrapper.skeleton(wrapper.parse("".join(f"<h2>H {k}</h2><p class=c{k}>text {k}</p>" for k in reversed(range(3000)))))
    tracemalloc.start()
    began = time.perf_counter()
    wrapper.main_text(siblings, backwards, frozenset([(1, 1)]))
    assert time.perf_counter() - began < 3 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_wrapper_over_deep_pages(spark):
    """Template text below any depth is told."""
    page = lambda k: "<div>" * 60 + f"<p>Our site</p><section><h1>Title {k}</h1><p>Story {k}.</p></section>" + "</div>" * 60
    pages = spark.createDataFrame([(k, "http://deep.example/", page(k)) for k in range(6)], "page_id long, url string, html string")
    assert {r.text for r in wrapper.extracted(pages).collect()} == {f"Title {k}\nStory {k}." for k in range(6)}
