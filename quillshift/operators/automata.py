"""Expressions of groups of strings, by minimal acyclic automata that partial aggregates merge.

Characters are read as digits, word characters and white space, all others as themselves.  Each share of
a group's distinct strings becomes a minimal automaton; automata of a group are merged by fours until one is left, and
its states are eliminated into a regular expression that matches the strings' forms and nothing else.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillshift.functions.text import regex_run_lengths
from quillshift.sources.shared import checkpointed

#: Stand-ins for classes of characters; strings that hold them are read as word characters there.
DIGIT, WORD, SPACE = "", "", ""
_ATOMS = {DIGIT: r"\d", WORD: r"\w", SPACE: r"\s"}
#: Distinct forms that one task turns into an automaton.
SHARE = 20_000

#: A state is (whether strings end there, its (symbol, state) in order); children come before parents, the last is the start.
Automaton = list[tuple[bool, tuple[tuple[str, int], ...]]]


def forms(text: Column) -> Column:
    """The string with its digits, word characters and white space replaced by their classes."""
    out = F.regexp_replace(text, f"[{DIGIT}-{SPACE}]", WORD)
    for pattern, sign in ((r"[0-9]", DIGIT), (r"(?U)[\p{IsAlphabetic}\p{M}\p{Nd}\p{Pc}]", WORD), (r"[\s\x0B]", SPACE)):
        out = F.regexp_replace(out, pattern, sign)
    return out


def minimal(strings: Iterable[str]) -> Automaton:
    """The least acyclic automaton of the strings."""
    trie: list[dict[str, int]] = [{}]
    ends = {}
    for s in strings:
        at = 0
        for c in s:
            if c not in trie[at]:
                trie[at][c] = len(trie)
                trie.append({})
            at = trie[at][c]
        ends[at] = True
    # later nodes are deeper or elsewhere, so children have higher numbers
    known: dict[tuple, int] = {}
    out: Automaton = []
    name = [0] * len(trie)
    for n in range(len(trie) - 1, -1, -1):
        state = (n in ends, tuple(sorted((c, name[m]) for c, m in trie[n].items())))
        name[n] = known.setdefault(state, len(known))
        if name[n] == len(out):
            out.append(state)
    return _last(out, name[0])


def _last(states: Automaton, start: int) -> Automaton:
    """The states that the start reaches, it being the last."""
    used, todo = {start}, [start]
    while todo:
        for _, m in states[todo.pop()][1]:
            if m not in used:
                used.add(m)
                todo.append(m)
    order = {old: new for new, old in enumerate([*(n for n in sorted(used) if n != start), start])}
    return [(states[n][0], tuple((c, order[m]) for c, m in states[n][1])) for n in order]


def union(automata: list[Automaton]) -> Automaton:
    """The least automaton of all strings of several, by sets of states that are reached together."""
    first = frozenset((i, len(a) - 1) for i, a in enumerate(automata))
    known: dict[tuple, int] = {}
    out: Automaton = []
    name: dict[frozenset, int] = {}
    stack = [(first, None)]
    while stack:
        held, after = stack.pop()
        if held in name:
            continue
        if after is None:
            to: dict[str, set] = {}
            for i, n in held:
                for c, m in automata[i][n][1]:
                    to.setdefault(c, set()).add((i, m))
            after = {c: frozenset(s) for c, s in to.items()}
            stack.append((held, after))
            stack += [(s, None) for s in after.values() if s not in name]
            continue
        state = (any(automata[i][n][0] for i, n in held), tuple(sorted((c, name[s]) for c, s in after.items())))
        name[held] = known.setdefault(state, len(known))
        if name[held] == len(out):
            out.append(state)
    return _last(out, name[first])


def _atom(c: str) -> str:
    return _ATOMS.get(c) or (f"\\{c}" if not c.isalnum() and c.isascii() else c)


def _either(parts: set[str]) -> str:
    """Alternatives as one unit; the empty one makes it optional."""
    some = sorted(p for p in parts if p)
    single = re.compile(r"(?s)\\?.")
    if len(some) > 1 and all(single.fullmatch(p) for p in some):
        whole = f"[{''.join(some)}]"
    elif len(some) == 1 and ("" not in parts or single.fullmatch(some[0])):
        # alternatives are always in brackets, so one alone needs none
        whole = some[0]
    else:
        whole = f"(?:{'|'.join(some)})" if some else ""
    return f"{whole}?" if some and "" in parts else whole


def expression(states: Automaton) -> str:
    """States eliminated one by one, those with the fewest paths through them first."""
    start, end = len(states) - 1, len(states)
    to: dict[int, dict[int, set[str]]] = {n: {} for n in range(end + 1)}
    come: dict[int, set[int]] = {n: set() for n in range(end + 1)}
    for n, (final, edges) in enumerate(states):
        for c, m in edges:
            to[n].setdefault(m, set()).add(_atom(c))
            come[m].add(n)
        if final:
            to[n].setdefault(end, set()).add("")
            come[end].add(n)
    left = set(range(end)) - {start}
    while left:
        n = min(left, key=lambda x: ((len(come[x]) - 1) * (len(to[x]) - 1) if come[x] else -1, x))
        for before in come[n]:
            way = _either(to[before].pop(n))
            for after, parts in to[n].items():
                to[before].setdefault(after, set()).add(way + _either(parts))
                come[after].add(before)
        for after in to[n]:
            come[after].discard(n)
        left.discard(n)
        to[n], come[n] = {}, set()
    return f"^{regex_run_lengths(_either(to[start].get(end, {''})))}$"


def group_expressions(df: DataFrame, key: str, text: str = "text", share: int = SHARE) -> DataFrame:
    """(key, states, regex): a regular expression that matches exactly the forms of each group's strings.

    Only distinct forms are gathered, ``share`` of them in a task; automata are merged by fours, so a task holds four.  Null
    keys are a group, null strings are left out; an empty string makes the expression optional.
    """
    each = checkpointed(df.select(F.col(key).alias("key"), forms(F.col(text)).alias("form")).filter("form is not null").distinct())
    sized = each.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("parts")).withColumnRenamed("key", "own")
    parts = each.join(sized, each["key"].eqNullSafe(sized["own"])).withColumn("part", F.pmod(F.xxhash64("form"), F.col("parts")).cast("int")).select("key", "part", "form")
    kind = df.schema[key].dataType.simpleString()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "part": pdf["part"].iloc[:1], "said": [json.dumps(minimal(pdf["form"]))]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        read = [[(f, tuple((c, m) for c, m in es)) for f, es in json.loads(s)] for s in pdf["said"]]
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "part": pdf["part"].iloc[:1], "said": [json.dumps(union(read))]})

    schema = f"key {kind}, part int, said string"
    held = checkpointed(parts.groupBy("key", "part").applyInPandas(build, schema))
    while (held.agg(F.max("part")).first()[0] or 0) > 0:
        held = checkpointed(held.withColumn("part", F.floor(F.col("part") / 4).cast("int")).groupBy("key", "part").applyInPandas(merge, schema))

    def spell(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [[(f, tuple((c, m) for c, m in es)) for f, es in json.loads(s)] for s in pdf["said"]]
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "states": [len(s) for s in states], "regex": [expression(s) for s in states]})

    made = held.mapInPandas(lambda batches: map(spell, batches), f"key {kind}, states int, regex string")
    return made.withColumnRenamed("key", key)
