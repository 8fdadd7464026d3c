"""Text functions as Column builders.  All compile to built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _fold_rule() -> tuple[str, str]:
    """Letters and digits of the Latin and full-width blocks whose decomposition starts with an ASCII one."""
    blocks = [(0xC0, 0x250), (0x1E00, 0x1F00), (0xFF10, 0xFF5B)]
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for lo, hi in blocks for c in range(lo, hi)]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalnum()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _fold_rule()
#: Letters that fold to two.
FOLD_WIDE = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L"}


def ascii_fold(c: Column) -> Column:
    """Latin letters without their marks, full-width ones plain; other characters, and plain texts, stay."""
    out = F.translate(c, FOLD_FROM, FOLD_TO)
    for wide, plain in FOLD_WIDE.items():
        out = F.replace(out, F.lit(wide), F.lit(plain))
    return F.when(c.rlike(r"[^\x00-\x7F]"), out).otherwise(c)


#: As the fold, but one letter for one, so that offsets stay.
PLAIN_FROM, PLAIN_TO = FOLD_FROM + "".join(FOLD_WIDE), FOLD_TO + "".join(p[0] for p in FOLD_WIDE.values())
_PLAIN = str.maketrans(PLAIN_FROM, PLAIN_TO)


def plain_letters(v: str) -> str:
    """``v`` with the letters that surface formats see, each in its place."""
    return v if v.isascii() else v.translate(_PLAIN)


def plain_letters_column(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, PLAIN_FROM, PLAIN_TO)).otherwise(c)


def squeeze(c: Column) -> Column:
    """Trim and turn each run of white space into one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def collapse(c: Column, fold: bool = True) -> Column:
    """Surface format: runs of upper case, lower case and digits become ``A``, ``a`` and ``0``."""
    out = squeeze(ascii_fold(c) if fold else c)
    for pattern, sign in (("[A-Z]+", "A"), ("[a-z]+", "a"), ("[0-9]+", "0")):
        out = F.regexp_replace(out, pattern, sign)
    return out


def relax(c: Column, rare: Sequence[str]) -> Column:
    """A collapse pattern without ``rare`` symbols, capitals inside words lowered, runs squeezed again."""
    out = c
    for symbol in rare:
        out = F.replace(out, F.lit(symbol), F.lit(""))
    out = squeeze(F.regexp_replace(out, "(?<=[a-zA-Z0-9])A", "a"))
    for sign in "Aa0":
        out = F.regexp_replace(out, f"{sign}+", sign)
    return out


def symbols(c: Column) -> Column:
    """All characters that are neither word characters nor white space, in order."""
    return F.regexp_extract_all(c, F.lit(r"([^\w\s])"), F.lit(1))


def type_normalize(c: Column) -> Column:
    """A semantic type without its trailing number, lower case, without trailing underscores."""
    return F.rtrim(F.trim(F.lower(F.regexp_replace(c, "[0-9]+$", ""))), F.lit("_"))


def key_normalize(c: Column) -> Column:
    """Alphanumeric words in lower case; a trailing number goes unless it is all there is."""
    plain = F.trim(F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", " ")))
    short = F.when(plain.rlike("^[0-9]+$"), plain).otherwise(F.regexp_replace(plain, "[0-9]+$", ""))
    return squeeze(F.regexp_replace(short, r"[(\s]s[)\s]$", ""))


def number_free_key(c: Column) -> Column:
    """As ``key_normalize``, but an all-digit key loses its digits too."""
    plain = F.trim(F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", " ")))
    return squeeze(F.regexp_replace(F.trim(F.regexp_replace(plain, "[0-9]+$", "")), r"[(\s]s[)\s]$", ""))


def unwrap(value: Column, origin: Column) -> Column:
    """Drop matching quotes if only the unwrapped text occurs in ``origin``."""
    inner = F.substring(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))
    quoted = (value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'"))
    return F.when(quoted & (F.length(value) >= 2) & ~F.contains(origin, value) & F.contains(origin, inner), inner).otherwise(value)


def components(c: Column, clean: bool = True) -> Column:
    """``key: value`` lines as array<struct<ord,key,value>>; of equal keys the last value counts."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")

    def one(line: Column, i: Column) -> Column:
        cut = F.instr(line, ":")
        key = F.when(cut > 0, F.substring(line, F.lit(1), cut - 1)).otherwise(line)
        value = F.when(cut > 0, F.substring(line, cut + 1, F.length(line))).otherwise(F.lit(""))
        if clean:
            key, value = F.lower(F.regexp_replace(key, "[^a-zA-Z0-9]", " ")), F.regexp_replace(value, "[^a-zA-Z0-9]", " ")
        return F.struct(i.alias("ord"), squeeze(key).alias("key"), squeeze(value).alias("value"))

    found = F.transform(lines, one)
    later = lambda x: F.exists(found, lambda y: (y["key"] == x["key"]) & (y["ord"] > x["ord"]))
    return F.filter(found, lambda x: ~later(x))


def braced_components(c: Column) -> Column:
    """``{key: value, key: value}`` as a map, blanks trimmed."""
    return F.str_to_map(F.regexp_replace(F.regexp_replace(c, r"^\s*\{\s*|\s*\}\s*$", ""), r"\s*([,:])\s*", "$1"), F.lit(","), F.lit(":"))


def longest_map(c: Column) -> Column:
    """Of an array of maps the first with most keys; an empty array gives null."""
    sizes = F.transform(c, lambda m: F.size(m))
    return F.get(c, F.array_position(sizes, F.array_max(sizes)).cast("int") - 1)


def response_types(c: Column) -> Column:
    """Distinct keys of the ``key: value`` lines of a response with [ITEM] separators, first seen first."""
    lines = F.split(F.regexp_replace(c, r"(?i)\[ITEM\]", "\n"), "\n")
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.trim(F.substring_index(x, ":", 1))))


def spoken_list(c: Column) -> Column:
    """``a``; ``a and b``; ``a, b, and c``."""
    n = F.size(c)
    many = F.concat(F.array_join(F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(c, -1))
    return F.when(n == 0, "").when(n == 1, F.get(c, F.lit(0))).when(n == 2, F.concat_ws(" and ", c)).otherwise(many)


def bracket_labels(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]"), F.lit(1))


def composition(labels: Column) -> Column:
    """Labels as ``[a_b][c]``."""
    return F.array_join(F.transform(labels, lambda x: F.concat(F.lit("["), F.regexp_replace(F.btrim(x, F.lit(" \t\r\n")), r"\s+", "_"), F.lit("]"))), "")


def composition_of_text(c: Column) -> Column:
    """Free text as composition: its alphanumeric segments."""
    found = F.regexp_extract_all(c, F.lit(r"([a-zA-Z0-9_\s]+)"), F.lit(1))
    return composition(F.filter(found, lambda x: x.rlike(r"\S")))


def all_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "").rlike("^[0-9]+$")


def length_feature(c: Column) -> Column:
    return F.length(c).cast("double")


def num_tokens_feature(c: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    return F.size(F.filter(words, lambda w: w.rlike(r"^[\p{L}\p{N}]+$") | (F.length(w) == 1))).cast("double")


def _count(c: Column, kind: str) -> Column:
    return F.regexp_count(c, F.lit(kind))


def _share(n: Column, c: Column) -> Column:
    return F.try_divide(n.cast("double"), F.length(c))


def ratio_alpha_feature(c: Column) -> Column:
    return _share(_count(c, r"\p{L}"), c)


def ratio_numeric_feature(c: Column) -> Column:
    return _share(_count(c, r"\p{N}"), c)


def ratio_alnum_feature(c: Column) -> Column:
    return _share(_count(c, r"\p{L}") + _count(c, r"\p{N}"), c)


def ratio_nonalnum_feature(c: Column) -> Column:
    return _share(F.length(c) - _count(c, r"\p{L}") - _count(c, r"\p{N}"), c)


def symbol_set_feature(c: Column) -> Column:
    """Sorted distinct symbols, the double quote as ``d``; an empty string if there are none."""
    found = F.regexp_extract_all(c, F.lit(r"([^\p{L}\p{N}\s])"), F.lit(1))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.when(x == '"', "d").otherwise(x)))), " ")


def _signed_min_max(values: list[float]) -> list[float]:
    sizes = [abs(v) for v in values]
    if len(values) < 2 or max(sizes) == min(sizes):
        return [0.0]
    low, span = min(sizes), max(sizes) - min(sizes)
    return [(abs(v) - low) * (1 if v > 0 else -1) / span for v in values]


def symbol_offset_dispersion(text: str) -> float:
    """Sample deviation of signed run offsets at symbols, normalised again at every symbol."""
    held: list[float] = []
    plain = [ch.isalnum() for ch in text]
    end = len(text) - 1
    for i, word in enumerate(plain):
        if word:
            continue
        after = next((j - i for j in range(i + 1, len(text)) if plain[j]), len(text) - i) - 1
        before = next((i - j for j in range(i - 1, -1, -1) if plain[j]), i + 1) - 1
        offset = after + 1 if i == 0 else -(before + 1) if i == end else after - before
        held = _signed_min_max([*held, float(offset)])
    if len(held) < 2:
        return 0.0
    mean = sum(held) / len(held)
    return (sum((v - mean) ** 2 for v in held) / (len(held) - 1)) ** 0.5


@F.pandas_udf(DoubleType())
def symbol_offset_feature(c: pd.Series) -> pd.Series:
    """The one feature that depends on a running renormalisation, so it is an Arrow function."""
    return c.map(lambda t: symbol_offset_dispersion(t or ""))


#: Features by name, in their usual order.
FEATURES = {
    "LengthFeature": length_feature,
    "NumTokensFeature": num_tokens_feature,
    "RatioAlphaFeature": ratio_alpha_feature,
    "RatioNumericFeature": ratio_numeric_feature,
    "RatioAlphanumericFeature": ratio_alnum_feature,
    "RatioNonAlnumFeature": ratio_nonalnum_feature,
    "NonAlnumOffsetFeature": symbol_offset_feature,
    "TypeNonAlnumCharFeature": symbol_set_feature,
}


def with_features(df: DataFrame, text: str = "text", names: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """Add a column for each known feature name; unknown names are an error."""
    if unknown := [n for n in names if n not in FEATURES]:
        raise ValueError(f"unknown features: {unknown}")
    return df.withColumns({n: FEATURES[n](F.col(text)) for n in names})


def _whole(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))


def normalized(df: DataFrame, c: str, out: str, how: str = "min_max", keys: Sequence[str] = ()) -> DataFrame:
    """Add ``out``: ``c`` divided by its sum, min-max scaled, or scaled by size with its sign kept.

    A constant column gives 0.0 for every row.  Bounds are aggregated first and joined back by a
    one-row (or small) broadcast-able side, so no window gathers the table.
    """
    v, size = F.col(c).cast("double"), F.abs(F.col(c).cast("double"))
    bounds = df.groupBy(*keys).agg(
        F.sum(v).alias("_sum"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.min(size).alias("_alo"), F.max(size).alias("_ahi")
    )
    both = df.join(bounds, list(keys)) if keys else df.join(F.broadcast(bounds))
    made = {
        "sum": F.try_divide(v, F.col("_sum")),
        "min_max": F.coalesce(F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)),
        "signed": F.coalesce(F.try_divide((size - F.col("_alo")) * F.when(v > 0, 1).otherwise(-1), F.col("_ahi") - F.col("_alo")), F.lit(0.0)),
    }[how]
    return both.withColumn(out, made).select(*df.columns, out)


def regex_run_lengths(pattern: str) -> str:
    """``aaa`` as ``a{3}`` in a pattern; brackets and what has a quantifier stay."""
    units: list[str] = []
    i = 0
    while i < len(pattern):
        step = 2 if pattern[i] == "\\" and i + 1 < len(pattern) else 1
        units.append(pattern[i : i + step])
        i += step
    out: list[str] = []
    i = 0
    while i < len(units):
        j = i + 1
        while units[i] not in "()[]{}" and j < len(units) and units[j] == units[i]:
            j += 1
        # the last of a run keeps its own quantifier
        n = j - i - (j - i > 1 and j < len(units) and units[j] in ("{", "?", "*", "+"))
        out.append(units[i] if n == 1 else f"{units[i]}{{{n}}}")
        i += n
    return "".join(out)


def regex_alternatives(pattern: str) -> list[str]:
    """The alternation-free patterns of a pattern; groups without ``|`` stay groups."""

    def branches(s: str) -> list[str]:
        parts, depth, last = [], 0, 0
        for i, ch in enumerate(s):
            depth += (ch == "(") - (ch == ")")
            if ch == "|" and depth == 0:
                parts.append(s[last:i])
                last = i + 1
        return [*parts, s[last:]]

    def expand(s: str) -> list[str]:
        made = [""]
        i = 0
        while i < len(s):
            if s[i] != "(":
                made = [m + s[i] for m in made]
                i += 1
                continue
            depth, j = 1, i + 1
            while j < len(s) and depth:
                depth += (s[j] == "(") - (s[j] == ")")
                j += 1
            inner = s[i + 1 : j - 1]
            options = [x for b in branches(inner) for x in expand(b)] if "|" in inner else [f"({inner})"]
            made = [m + o for m in made for o in options]
            i = j
        return made

    return [x for b in branches(pattern) for x in expand(b)]


def pattern_to_regex(c: Column) -> Column:
    """A collapse pattern as a regular expression that matches its strings."""
    quoted = F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    for sign, rx in (("A", "[A-Z]+"), ("0", "[0-9]+"), (" ", r"\\s+")):
        quoted = F.regexp_replace(quoted, sign, rx if sign != "A" else "\u0001")
    return F.replace(F.regexp_replace(quoted, "a", "[a-z]+"), F.lit("\u0001"), F.lit("[A-Z]+"))


def induced_regexes(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, regex): an expression that matches all strings of a group, an alternative for each of its formats."""
    each = df.select(key, pattern_to_regex(collapse(F.col(text))).alias("_r")).distinct()
    return each.groupBy(key).agg(F.concat(F.lit("^(?:"), F.array_join(F.array_sort(F.collect_set("_r")), "|"), F.lit(")$")).alias("regex"))


def hashed_vector(c: Column, dims: int = 64, n: int = 3) -> Column:
    """Counts of character n-grams by hash, scaled to length 1: an embedding that needs no model.

    A text of fewer than n characters is one gram; a null or empty one gives zeros.
    """
    padded = F.coalesce(c, F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(padded, i, F.lit(n))), F.lit(dims)).cast("int"))
    counts = lambda g: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(g, lambda x: x == d)).cast("double"))
    held = F.get(F.transform(F.array(grams), counts), F.lit(0))
    scaled = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))
    return F.when(padded == "", F.array_repeat(F.lit(0.0), dims)).otherwise(F.get(F.transform(F.array(held), scaled), F.lit(0)))


def nested_lines(value, depth: int = 0, step: str = "  ") -> list[str]:
    """A nested value as indented lines: keys and indices, with what they hold below them."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in ([f"{step * depth}{k}:", *nested_lines(v, depth + 1, step)] if isinstance(v, dict | list | tuple | set) else [f"{step * depth}{k}: {v}"])]
    if isinstance(value, list | tuple | set):
        return [x for v in value for x in nested_lines(v, depth + isinstance(v, list | tuple | set), step)]
    return [f"{step * depth}{value}"]
