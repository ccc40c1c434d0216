"""Licence scans: Aho-Corasick over normalised words, and a shunting-yard parser for licence expressions.

A text is lower-cased (A-Z) and its words are set one space apart; one automaton then finds notice phrases and
identifier tags at once, overlapping ones too.  What follows a tag on its line is a licence
expression: operators in falling precedence are with, and, or; parentheses group.  An expression is
evaluated to its alternatives, each a set of licences that must all be met.

Every step is linear in the text, but for a logarithm, however many hits or operands it has.

Defined results: null and empty texts have no words, no places and no labels, score 0.  An
expression that doesn't parse gives the labels of the identifiers in it and no alternatives.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import read_table
from stratalog.llm.textvec import ALNUM

#: The phrases of the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases.
NOTICES = {
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "cc by": "cc",
    "cc by sa": "cc",
    "cc by nc": "cc-nc",
    "cc by nc sa": "cc-nc",
    "cc by nd": "cc-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "proprietary",
    "permission is hereby granted free of charge": "mit",
}
#: First words of licence identifiers.
FAMILIES = ("agpl", "lgpl", "gpl", "mit", "apache", "bsd", "mpl", "epl", "isc", "bsl", "cc0", "cc", "unlicense", "zlib", "artistic", "proprietary")
TAG = "spdx license identifier"
EXPRESSION = re.compile(rb"spdx-license-identifier\s*:[ \t]*([^\r\n]*)")
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:_-]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    name = identifier.rstrip("+")
    if name.startswith("cc-by-nc"):
        return "cc-nc"
    if name.startswith("cc-by-nd"):
        return "cc-nd"
    return next((f for f in FAMILIES if name == f or name.startswith(f + "-")), name)


def postfix(text: str) -> list[str] | None:
    """Shunting-yard: operands and operators of an expression in postfix order; None if it isn't one."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True  # whether one is due
    for token in TOKEN.findall(text.lower()):
        if token in PRECEDENCE:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        elif token == "(":
            if not operand:
                return None
            waiting.append(token)
        elif token == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif operand:
            out.append(token)
            operand = False
        else:
            break  # the expression is over; a comment follows
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def alternatives(text: str, most: int = 4096) -> list[frozenset[str]] | None:
    """Ways to meet an expression, each the licences (an exception stays with its own) that hold together.

    None if it doesn't parse. An expression of more than most ways is one way, itself: it is not written out.
    """
    order = postfix(text)
    if order is None:
        return None
    stack: list[set[frozenset[str]]] = []
    for token in order:
        if token not in PRECEDENCE:
            stack.append({frozenset([token])})
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append(left | right)
        elif token == "and":
            ways: set[frozenset[str]] = set()
            for a in left:
                ways |= {a | b for b in right}  # equal sets count once
                if len(ways) > most:
                    return [frozenset([infix(order)])]
            stack.append(ways)
        else:
            stack.append({frozenset(f"{x} with {'+'.join(sorted(b))}" for x in a) for a in left for b in right})
        if len(stack[-1]) > most:
            return [frozenset([infix(order)])]
    return sorted(stack.pop(), key=sorted)


def infix(order: list[str]) -> str:
    """A postfix expression as it is written, with brackets where they are needed."""
    strength = lambda node: PRECEDENCE[node[1]] if isinstance(node, tuple) else 9
    stack: list = []
    for token in order:
        if token in PRECEDENCE:
            right, left = stack.pop(), stack.pop()
            stack.append((left, token, right))
        else:
            stack.append((token,))
    out: list[str] = []
    todo: list = [stack.pop()]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif len(node) == 1:
            out.append(node[0])
        else:
            left, token, right = node
            for side, gap in ((right, ""), (left, f" {token} ")):
                own = 9 if len(side) == 1 else strength(side)
                todo += [gap, side] if own >= PRECEDENCE[token] else [f"){gap}", side, "("]
    return "".join(out)


def licences_of(order: list[str]) -> set[str]:
    """The licences of a postfix expression: its operands but for exceptions, the right sides of a 'with'."""
    stack: list[set[str]] = []
    for token in order:
        if token not in PRECEDENCE:
            stack.append({token})
        else:
            right, left = stack.pop(), stack.pop()
            if token != "with":
                if len(left) < len(right):
                    left, right = right, left
                left |= right
            stack.append(left)
    return stack.pop()


@cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        out.add_word(f" {phrase} ", (phrase, len(phrase) + 2))
    out.make_automaton()
    return out


def scan(text: bytes | None) -> dict:
    """All that this module finds in one text."""
    raw = text or b""
    words = raw.translate(ALNUM).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    starts, labels, base, evidence, ways = [], set(), set(), 0, []
    gaps: list[int] = []  # the place before each word
    for end, (phrase, size) in automaton().iter(line):
        if phrase == TAG:
            continue
        evidence += 1
        if phrase in BASE:
            base.add(BASE[phrase])
            gaps = gaps or [0, *accumulate(len(w) + 1 for w in words)]
            starts.append(bisect_left(gaps, end + 1 - size))
        else:
            labels.add(NOTICES[phrase])
    if f" {TAG} " in line:
        for m in EXPRESSION.finditer(raw.lower()):
            expression = m[1].decode("utf-8", "replace")
            found = alternatives(expression)
            names = licences_of(postfix(expression)) if found else set(TOKEN.findall(expression)) - {*PRECEDENCE, "(", ")"}
            labels |= {family(x) for x in names} if found else {f for x in names if (f := family(x)) in FAMILIES}
            ways += [" and ".join(sorted(way)) for way in found or ()]
            evidence += 2
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "alternatives": ways, "score": 1 - 0.5**evidence,
    }


SCHEMA = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("alternatives", pa.list_(pa.string())), ("score", pa.float64())])
DDL = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, alternatives array<string>, score double"


def licenses(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and what scan() finds, in one pass over whole texts."""
    keep = [c for c in keep if c not in SCHEMA.names]
    source = documents.select(*keep, F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_pylist([scan(t) for t in batch.column("_text").to_pylist()], SCHEMA)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *rows.columns], [*keep, *SCHEMA.names])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep)
    return source.mapInArrow(run, f"{types}, {DDL}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read_table(spark, sf_dir, "documents"), ["doc_id"])
