"""Automata of groups: exactly their strings, least in size, and the same however they are merged."""

import random
import re

from pyspark.sql import functions as F

from quillshift.operators import automata as A


def language(states):
    def walk(n):
        final, edges = states[n]
        return ({""} if final else set()) | {c + rest for c, m in edges for rest in walk(m)}

    return walk(len(states) - 1)


def test_automata_are_their_strings_and_least():
    rng = random.Random(1)
    for _ in range(60):
        words = {"".join(rng.choices("ab-", k=rng.randint(0, 6))) for _ in range(rng.randint(1, 25))}
        whole = A.minimal(words)
        assert language(whole) == words
        assert len(set(whole)) == len(whole)
        cut = sorted(words)
        parts = [A.minimal(cut[i::3]) for i in range(3) if cut[i::3]]
        merged = A.union(parts)
        assert language(merged) == words and len(merged) == len(whole)
        rx = re.compile(A.expression(whole))
        for s in words | {"".join(rng.choices("ab-", k=rng.randint(0, 7))) for _ in range(40)}:
            assert (rx.fullmatch(s) is not None) == (s in words), (s, words, rx.pattern)


def test_long_strings_and_special_characters():
    texts = ["x" * 3000, "a.b*c", "a+b?c", "[x]", "(y)|z", "", "tab\tend", "ü-1", "^$\\"]
    symbols = ["".join(A.WORD if c.isalpha() else A.DIGIT if c.isdigit() else A.SPACE if c.isspace() else c for c in t) for t in texts]
    rx = re.compile(A.expression(A.minimal(symbols)))
    assert all(rx.fullmatch(t) for t in texts) and not rx.fullmatch("a-b*c") and not rx.fullmatch("x" * 2999)


def test_groups(spark):
    rows = [("p", "12-ab"), ("p", "34-cd"), ("p", "5-e"), ("p", None), ("q", "x@y"), ("q", ""), (None, "z z")] + [("r", f"{'a' * (i % 9)}{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("form", F.lit(1))
    for share in (20_000, 3):
        got = {r["k"]: (r["states"], r["regex"]) for r in A.group_expressions(df, "k", "t", share).collect()}
        assert got.keys() == {"p", "q", "r", None}
        for k, t in rows:
            for g, (_, rx) in got.items():
                if t is not None and (g == k or g in ("p", "q")):
                    assert (re.fullmatch(rx, t) is not None) == (g == k or (t, g) == ("", "q")), (k, t, g, rx)
    assert A.group_expressions(df.limit(0), "k", "t").count() == 0
