"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are runs of key characters that hold a digit and a letter (an unquoted name=value is split at the
'=', trailing base64 padding stays), what is assigned to a name of a secret from 6 characters on, with or without a digit, and
whole PEM and PGP private-key blocks, encrypted ones and cut ones too.  For each, features are taken of its length, its character transitions (how well a
bigram model of words explains it, how often the character class changes), its dictionary coverage,
the path it stands under (the document's source) and the words around it.  A forest trained on
labelled findings gives the probability that it is a secret; 0.5 or more makes a finding.

Labelled findings may be given as a table; without one they are generated by a seeded rule: keys and
tokens in assignments, against hashes, identifiers, placeholders, paths and versions as they
stand in prose and code.

Defined results: null and empty texts have no candidates.  A document's candidates come in
order of place.  Repeated rows are scanned each on its own; a null source is an empty path.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import read_table, shielded

#: A block: its header, then header lines and base64 to its end; of a cut block as far as header lines and long base64 runs go.
BLOCK = re.compile(r"-----BEGIN (?P<kind>[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----(?:(?:[\s\\]*+(?:[A-Za-z][A-Za-z0-9-]*+: [^\n]*+|[A-Za-z0-9+/=\\]++))*+[\s\\]*+-----END (?P=kind)-----|(?:[\s\\]*+(?:[A-Za-z][A-Za-z0-9]*-[A-Za-z0-9-]*+: [^\n]*+|(?:Version|Comment|Hash|Charset): [^\n]*+|[A-Za-z0-9+/=]{16,}+))*+)")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_\-.])(?=[A-Za-z_\-+/.]*\d)[A-Za-z0-9+/_\-.]{16,}+(?:={1,2}(?![A-Za-z0-9+/_\-.=\"'$]))?")
ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|passphrase|pwd|key|auth|bearer|credentials?|private|access)(?:[_\-][A-Za-z0-9_\-]{1,24})?[\"']?[ \t]{0,4}(?:=>|:=|[=:])[ \t]{0,4}(?:\"(?P<double>[^\"\s]{6,200})\"|'(?P<single>[^'\s]{6,200})'|(?P<bare>(?:[^\s\"'<>&,;(){}\[\]]|&(?![A-Za-z_][\w\-]*=)){6,200}))", re.I)
LETTER = re.compile(r"[A-Za-z]")
NAME = re.compile(r"([A-Za-z0-9_.\-]+)[\"']?\s{0,4}(?:=>|:=|[=:])\s{0,4}[\"']?$")
NEIGHBOURS = 40
#: Words that stand by secrets, and words that stand by other long strings.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "auth", "bearer", "credential", "private", "access")
OTHER_WORDS = ("commit", "sha", "md5", "hash", "checksum", "digest", "uuid", "guid", "id", "version", "http", "https", "www", "example", "sample", "test", "phone", "order", "isbn", "card")
#: How known keys begin.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xapp-", "sk_live_", "rk_live_", "sk-", "AIza", "ya29.", "eyJ", "npm_", "pypi-", "SG.", "-----BEGIN")
PLACEHOLDER = ("example", "sample", "your", "changeme", "placeholder", "xxxx", "dummy", "redacted", "0000000", "1234567")
#: A small dictionary of words as they stand inside identifiers.
WORDS = ("the and for with from this that token secret password key user name file path data test example sample value config class function method index table column order report "
         "version release update build main home work local server client service account access public private default system process message number string error event source target list item "
         "image photo album page post blog article news archive category product price cart shop store login logout register profile settings admin dashboard static assets script style").split()  # fmt: skip
FEATURES = ("length", "entropy", "bigram", "changes", "digits", "upper", "hexadecimal", "words", "prefix", "placeholder", "secret_near", "other_near", "assigned", "quoted", "path_code", "path_test", "repeats", "dots", "slashes", "uuid", "named")


@cache
def bigrams() -> dict[str, float]:
    """Log probability of a letter after a letter in the dictionary, by rule of succession."""
    pairs = Counter(a + b for w in WORDS for a, b in zip(w, w[1:], strict=False))
    singles = Counter(a for w in WORDS for a in w[:-1])
    return {a + b: math.log((pairs[a + b] + 0.5) / (singles[a] + 13)) for a in string.ascii_lowercase for b in string.ascii_lowercase}


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def features(value: str, before: str, after: str, path: str) -> list[float]:
    low, n = value.lower(), len(value)
    counts = Counter(value)
    letters = [p for p in zip(low, low[1:], strict=False) if p[0] + p[1] in bigrams()]
    near = re.findall(r"[a-z_]+", (before[-NEIGHBOURS:] + " " + after[:NEIGHBOURS]).lower())
    parts = {x for w in near for x in (w, *w.split("_"))}
    covered = 0
    for w in WORDS:
        if len(w) > 3 and w in low:
            covered += len(w) * low.count(w)
    kinds = [kind(c) for c in value]
    name = NAME.search(before[-NEIGHBOURS:])
    return [
        min(n, 400), -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(bigrams()[a + b] for a, b in letters) / max(1, len(letters)), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        kinds.count(0) / n, kinds.count(2) / n, sum(c in "0123456789abcdef" for c in low) / n, min(1.0, covered / n),
        float(value.startswith(PREFIXES)), float(any(x in low for x in PLACEHOLDER)),
        float(sum(x in parts for x in SECRET_WORDS)), float(sum(x in parts for x in OTHER_WORDS)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before[-4:]))), float(before[-1:] in "\"'" and after[:1] in "\"'" and before != "" and after != ""),
        float(bool(re.search(r"\.(py|js|ts|go|rs|java|env|ya?ml|json|ini|conf|sh)$", path))), float(bool(re.search(r"test|example|sample|fixture|doc", path))),
        max(counts.values()) / n, value.count("."), value.count("/"), float(bool(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float(bool(name) and any(x in SECRET_WORDS for x in re.split(r"[_.\-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name[1]).lower()))),
    ]


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and value, in order of place; none overlap: blocks go first, then assigned values, then runs."""
    taken = [m.span() for m in BLOCK.finditer(text)] if "-----BEGIN " in text else []
    taken = merged(taken, assigned(text))
    runs = []
    for m in CANDIDATE.finditer(text):
        value = m[0].rstrip(".-")
        if len(value) >= 16 and LETTER.search(value):
            runs.append((m.start(), m.start() + len(value)))
    for a, b in merged(taken, runs):
        yield a, b, text[a:b]


def assigned(text: str) -> Iterator[tuple[int, int]]:
    """Places of the values that are assigned to a name of a secret."""
    for m in ASSIGNED.finditer(text) if "=" in text or ":" in text else ():
        a, b = m.span(m.lastgroup)
        if m.lastgroup == "bare":
            b = a + len(text[a:b].rstrip(".:!?"))
        if b - a >= 6 and LETTER.search(text, a, b):
            # of name=value after a name of a secret (access: token=...) the value
            inner = re.match(r"[A-Za-z][A-Za-z0-9_]*=(?=[^=])", text[a:b])
            a += inner.end() if inner and b - a - inner.end() >= 6 else 0
            yield a, b


def merged(first: list[tuple[int, int]], second) -> list[tuple[int, int]]:
    """The spans of first, and those of second that overlap none of them, in order."""
    out, k = [], 0
    for a, b in second:
        while k < len(first) and first[k][1] <= a:
            k += 1
        if k == len(first) or b <= first[k][0]:
            out.append((a, b))
    return sorted(first + out) if out else first


def generated(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings by rule: value, text before, text after, path, label. They are the candidates of n generated texts, as a scan yields them."""
    out = []
    for value, before, after, path, label in _generated(n, seed):
        text, start = before + value + after, len(before)
        for a, b, own in candidates(text):
            hit = a < start + len(value) and start < b
            out.append((own, text[max(0, a - NEIGHBOURS) : a], text[b : b + NEIGHBOURS], path, label if hit else 0))
    return out


def _generated(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    rng = random.Random(seed)
    pick, some = rng.choice, lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    syllables = lambda k: "".join(pick("bcdfghklmnprstvw") + pick("aeiou") + pick(["", "", "r", "n", "t", "s"]) for _ in range(k))
    prose = lambda: " ".join(pick(WORDS) for _ in range(rng.randint(0, 5)))
    out = []
    for _ in range(n):
        label = rng.random() < 0.5
        before, after = prose() + " ", " " + prose()
        path = pick(["web", "forum", "src/app.py", "config/prod.env", "deploy/values.yaml", "", "blog", "news"])
        if label:
            value = pick([
                lambda: some(hexa, pick([32, 40, 48, 64])), lambda: some(alnum, rng.randint(20, 64)), lambda: pick(["ghp_", "gho_", "npm_"]) + some(alnum, 36), lambda: "AKIA" + some(string.ascii_uppercase + "234567", 16),
                lambda: pick(["sk_live_", "sk-", "xoxb-", "glpat-"]) + some(alnum, rng.randint(20, 48)), lambda: "eyJ" + some(alnum + "_-", 30) + "." + some(alnum + "_-", 60) + "." + some(alnum + "_-", 43), lambda: some(alnum + "+/", rng.randint(28, 88)) + pick(["", "=", "=="]),
                lambda: (lambda k: f"-----BEGIN {k}PRIVATE KEY-----\n{some(alnum + '+/', rng.randint(6, 600))}\n-----END {k}PRIVATE KEY-----")(pick(["", "RSA ", "EC ", "OPENSSH "])),
                lambda: (lambda k, h: f"-----BEGIN {k}-----\n{h}{''.join(some(alnum + '+/', 64) + chr(10) for _ in range(rng.randint(0, 6)))}{some(alnum + '+/', rng.randint(4, 64))}{pick(['', '=', '=='])}\n-----END {k}-----")(
                    *pick([("RSA PRIVATE KEY", ""), ("PRIVATE KEY", ""), ("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + some("0123456789ABCDEF", 32) + "\n\n"), ("ENCRYPTED PRIVATE KEY", ""), ("PGP PRIVATE KEY BLOCK", "Version: GnuPG v2\n\n"), ("PGP PRIVATE KEY BLOCK", "\n")])),
                lambda: some(alnum, rng.randint(7, 15)), lambda: some(alnum + "!@#%^*+?", rng.randint(8, 18)) + pick("!@#%7"), lambda: some(string.ascii_letters, rng.randint(10, 32)), lambda: pick(WORDS) + pick("-_.!@") + pick(WORDS).title() + str(rng.randint(1, 9999)),
                lambda: syllables(rng.randint(2, 4)) + some(string.ascii_lowercase, rng.randint(1, 2)) + str(rng.randint(1, 9999)) + some(string.ascii_lowercase, rng.randint(0, 2)), lambda: syllables(rng.randint(6, 11)), lambda: "-".join(syllables(rng.randint(2, 3)) for _ in range(rng.randint(3, 4))),
            ])()
            form = rng.random()
            if form < 0.25 and not value.startswith("-----"):
                name = pick(["API", "DB", "AWS", "APP", "SERVICE", "CLIENT"]) + "_" + pick(["TOKEN", "SECRET", "PASSWORD", "KEY", "ACCESS_KEY", "AUTH_TOKEN", "PRIVATE_KEY"])
                before = (prose() + " " if rng.random() < 0.3 else "") + pick(["", "export ", "\n", "ENV "]) + (name if rng.random() < 0.7 else pick(["api_key", "client_secret", "password", "auth_token"])) + "="
                after = pick(["\n", " ", "\nNAME=main\n", ""])
            elif form < 0.4 and not value.startswith("-----") and value.isalnum():
                before += pick(["https://", "http://www."]) + pick(WORDS) + ".example.com/" + pick(WORDS) + pick(["?", "?page=2&", "?id=7&"]) + pick(["access_token", "token", "api_key", "key", "auth", "secret"]) + "="
                after = pick(["", "&page=2", "&v=1"]) + after
            elif not (known := value.startswith(PREFIXES)) or rng.random() < 0.7:
                quote = pick(['"', "'", "", '"'])
                before += pick(SECRET_WORDS) + pick([" = ", "=", ": ", ":", " "] if known else [" = ", "=", ": ", ":"]) + quote
                after = quote + after
        else:
            value = pick([
                lambda: some(hexa, pick([32, 40, 64])), lambda: "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "-".join(pick(WORDS) for _ in range(4)) + f"-{rng.randint(1, 99)}", lambda: "/".join(pick(WORDS) for _ in range(4)) + f"/{rng.randint(1, 2030)}",
                lambda: "_".join(pick(WORDS) for _ in range(3)) + f"_{rng.randint(1, 9)}", lambda: f"{pick(WORDS)}.{pick(WORDS)}{rng.randint(1, 99)}.example.com", lambda: pick(["your", "example", "changeme"]) + "_" + pick(SECRET_WORDS) + "_" + some("x1", 8) + "1", lambda: f"{pick(WORDS)}-{rng.randint(0, 9)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}-{pick(WORDS)}",
                lambda: "".join(pick(WORDS).title() for _ in range(4)) + str(rng.randint(1, 9)), lambda: f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}:00".replace(":", "-") + "Z",
            ])()
            style = rng.random()
            if rng.random() < 0.2:
                # what is written after a secret's name without being one
                value = pick([lambda: pick(WORDS), lambda: pick(["required", "optional", "missing", "invalid", "string", "undefined", "expired", "public", "enabled", "disabled", "primary", "foreign", "granted", "denied"]), lambda: f"{pick(WORDS)}.{pick(WORDS)}", lambda: f"{pick(WORDS)}_{pick(WORDS)}", lambda: "${" + pick(WORDS).upper() + "}", lambda: "*" * 8 + "x", lambda: f"os.environ.{pick(WORDS)}", lambda: pick(["your", "example", "changeme"]) + "_" + pick(WORDS)])()
                before += pick(SECRET_WORDS) + pick([" = ", "=", ": ", ":", '="'])
                after = ('"' if before.endswith('"') else "") + after
            elif style < 0.2 and re.fullmatch("[0-9a-f-]+", value):
                before += pick(["https://", "http://www."]) + pick(WORDS) + ".example.com/" + pick(WORDS) + pick(["?id=", "?commit=", "?v=", "?hash=", "?page=2&sha="])
            elif style < 0.45:
                before += pick(OTHER_WORDS) + pick([" = ", ": ", " ", "=", ":", "/"])
            elif style < 0.6:
                before += pick(["name", "path", "file", "url", "slug"]) + pick([' = "', ': "'])
                after = '"' + after
            elif any(x in value for x in PLACEHOLDER):
                before += pick(SECRET_WORDS) + pick([" = ", ": "])
        if value.startswith("-----") and rng.random() < 0.4:
            before, after = "", pick(["", "\n"])
        out.append((value, before, after, path, int(label)))
    return out


# ---- the forest ------------------------------------------------------------------------------------------


class Forest:
    """Trees on bootstrap samples, split by Gini impurity at quantile thresholds of random features."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 5):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.roots: list = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Forest":
        rng = np.random.default_rng(self.seed)
        per = max(1, int(math.sqrt(x.shape[1])) + 1)
        self.roots = []
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            self.roots.append(self._grow(x[rows], y[rows], self.depth, per, rng))
        return self

    def _grow(self, x, y, depth, per, rng):
        rate = float(y.mean())
        if depth == 0 or len(y) < 2 * self.least or rate in (0.0, 1.0):
            return rate
        best = (2 * rate * (1 - rate) * len(y) - 1e-9, None, None)
        for f in rng.choice(x.shape[1], per, replace=False):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 15))):
                low = x[:, f] <= cut
                n = int(low.sum())
                if n < self.least or len(y) - n < self.least:
                    continue
                p, q = y[low].mean(), y[~low].mean()
                impurity = 2 * p * (1 - p) * n + 2 * q * (1 - q) * (len(y) - n)
                if impurity < best[0]:
                    best = (impurity, int(f), float(cut))
        if best[1] is None:
            return rate
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[low], y[low], depth - 1, per, rng), self._grow(x[~low], y[~low], depth - 1, per, rng)

    def score(self, row: list[float]) -> float:
        total = 0.0
        for node in self.roots:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.roots)


def trained(labelled: DataFrame | None = None, max_rows: int = 20_000) -> Forest:
    """A forest from labelled findings (value, before, after, path, label; at most max_rows by hash), or from generated ones.

    A table without a usable row is as none: the generated findings are taken.  With one label alone every value gets it.
    """
    if labelled is None:
        return _generated_forest()
    rows = labelled.where("value is not null and label in (0, 1)").orderBy(F.xxhash64("value", "before", "after", "path")).limit(max_rows).collect()
    if not rows:
        return _generated_forest()
    return _fit([(r["value"], r["before"] or "", r["after"] or "", r["path"] or "", int(r["label"])) for r in rows])


@cache
def _generated_forest() -> Forest:
    return _fit(generated())


def _fit(findings) -> Forest:
    x = np.array([features(*f[:4]) for f in findings], float)
    return Forest().fit(x, np.array([f[4] for f in findings], float))


FINDING = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())])


def found(text: str, path: str, forest: Forest, threshold: float = 0.5) -> list[dict]:
    out = []
    for a, b, value in candidates(text):
        p = forest.score(features(value, text[max(0, a - NEIGHBOURS) : a], text[b : b + NEIGHBOURS], path))
        if p >= threshold:
            out.append({"start": a, "end": b, "value": value, "score": p})
    return out


def _paths(documents: DataFrame, path: str):
    return F.coalesce(F.col(path).cast("string"), F.lit("")) if path in documents.columns else F.lit("")


def scanned(documents: DataFrame, forest: Forest, keep: list[str] | None = None, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """The kept columns (all, unless given) and findings: an array of start, end (in characters), value and score."""
    keep = [c for c in (keep or documents.columns) if c != "findings"]
    sent = documents.sparkSession.sparkContext.broadcast(forest)  # bounded by the number and depth of its trees
    source = documents.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"), _paths(documents, path).alias("_path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [found(t, where, sent.value, threshold) for t, where in zip(batch.column("_text").to_pylist(), batch.column("_path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.list_(FINDING))], [*keep, "findings"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep)
    return source.mapInArrow(run, f"{types}, findings array<struct<start: long, `end`: long, value: string, score: double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a finding: doc_id, start, end (in characters), value_sha256 (the value itself is not repeated) and score."""
    rows = scanned(read_table(spark, sf_dir, "documents"), trained(), ["doc_id"]).select("doc_id", F.explode("findings").alias("f"))
    return rows.select("doc_id", "f.start", "f.end", F.sha2(F.col("f.value").cast("binary"), 256).alias("value_sha256"), "f.score")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str, mark: str = "[SECRET]") -> DataFrame:
    """The pipeline stage: every document stays; each finding in its text is replaced by a mark, and n_chars follows."""
    forest = spark.sparkContext.broadcast(trained())
    inside, back = shielded(docs, ("_path",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names if c != "_path"}
            texts = columns["text"].to_pylist()
            sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else [None] * len(texts)
            for k, where in enumerate(batch.column("_path").to_pylist()):
                own = found(texts[k] or "", where, forest.value)
                for f in reversed(own):
                    texts[k] = texts[k][: f["start"]] + mark + texts[k][f["end"] :]
                if own:
                    sizes[k] = len(texts[k])
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return back(inside.withColumn("_path", _paths(inside, "source")).mapInArrow(run, inside.schema))
