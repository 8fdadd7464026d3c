import itertools

import pytest
from pyspark.sql import functions as F

from quillshift.functions import text as T


def column(spark, values, make, extra=()):
    df = spark.createDataFrame([(i, v, *extra) for i, v in enumerate(values)], "i int, v string" + ", e string" * bool(extra))
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_collapse(spark):
    assert column(spark, ["20.07.1944", "Steve Jobs", "  ABCdef 12x ", "", None, "Élan Œuvre"], T.collapse) == ["0.0.0", "Aa Aa", "Aa 0a", "", None, "Aa Aa"]


def test_collapse_of_a_collapse_has_no_longer_runs(spark):
    once = column(spark, ["".join(x) for x in itertools.product("Aa0 .", repeat=3)], T.collapse)
    assert once == column(spark, once, T.collapse)


def test_relax(spark):
    assert column(spark, ["Aa-Aa.0", "aA A"], lambda c: T.relax(c, ["-"])) == ["Aa.0", "a A"]


@pytest.mark.parametrize(("k", "want"), [("Name 12", "name"), ("42", "42"), ("item (s) ", "item s"), ("a_b-C", "a b c"), ("", "")])
def test_key_normalize(spark, k, want):
    assert column(spark, [k], T.key_normalize) == [want]


def test_type_and_number_free_keys(spark):
    assert column(spark, ["Year_12", "City_"], T.type_normalize) == ["year", "city"]
    assert column(spark, ["42", "name 1"], T.number_free_key) == ["", "name"]


def test_unwrap(spark):
    df = spark.createDataFrame([('"ab"', "x ab y"), ('"ab"', 'x "ab" y'), ("'a", "a"), ('"', '"')], "v string, o string")
    assert [r[0] for r in df.select(T.unwrap(F.col("v"), F.col("o"))).collect()] == ["ab", '"ab"', "'a", '"']


def test_components(spark):
    got = column(spark, ["First Name: Ada!\n\nborn: 18:15\nborn: 1815\nloose"], T.components)[0]
    assert [(r["key"], r["value"]) for r in got] == [("first name", "Ada"), ("born", "1815"), ("loose", "")]
    assert column(spark, ["{a: 1, b: x y}"], T.braced_components) == [{"a": "1", "b": "x y"}]
    assert column(spark, ["day: 1\n[item]\nday: 2\nyear: 3"], T.response_types) == [["day", "year"]]


def test_lists_and_labels(spark):
    spoken = lambda *x: spark.range(1).select(T.spoken_list(F.array(*map(F.lit, x)).cast("array<string>"))).first()[0]
    assert [spoken(), spoken("a"), spoken("a", "b"), spoken("a", "b", "c")] == ["", "a", "a and b", "a, b, and c"]
    assert column(spark, ["[a b][c]x"], T.bracket_labels) == [["a b", "c"]]
    assert column(spark, ["given name, (family)"], T.composition_of_text) == ["[given_name][family]"]
    maps = spark.sql("select array(map('a', 1), map('b', 1, 'c', 2)) m, cast(array() as array<map<string,int>>) e")
    assert maps.select(T.longest_map(F.col("m"))).first()[0] == {"b": 1, "c": 2}
    assert maps.select(T.longest_map(F.col("e"))).first()[0] is None


def test_features(spark):
    df = T.with_features(spark.createDataFrame([("ab 1, c!",), ("",), ("--a-",)], "text string"))
    one, empty, marks = df.collect()
    assert (one["LengthFeature"], one["NumTokensFeature"], one["TypeNonAlnumCharFeature"]) == (8.0, 1.0, "! ,")
    assert one["RatioAlphaFeature"] == pytest.approx(3 / 8) and one["RatioNonAlnumFeature"] == pytest.approx(4 / 8)
    assert empty["RatioAlphaFeature"] is None and empty["NonAlnumOffsetFeature"] == 0.0
    assert marks["NonAlnumOffsetFeature"] >= 0
    with pytest.raises(ValueError, match="unknown"):
        T.with_features(df, names=["Nope"])


def test_normalized(spark):
    df = spark.createDataFrame([(1, -2.0), (2, 4.0), (3, 1.0)], "i int, v double")
    at = lambda how: [r[0] for r in T.normalized(df, "v", "o", how).orderBy("i").select("o").collect()]
    assert at("min_max") == pytest.approx([0, 1, 0.5])
    assert at("signed") == pytest.approx([-1 / 3, 1, 0])
    assert at("sum") == pytest.approx([-2 / 3, 4 / 3, 1 / 3])
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, v double")
    assert [r["o"] for r in T.normalized(flat, "v", "o").collect()] == [0.0, 0.0]


def test_regex_tools(spark):
    assert T.regex_run_lengths(r"\d\d\daab{2}(cc)") == r"\d{3}a{2}b{2}(c{2})"
    assert T.regex_run_lengths("aaa{2}") == "a{2}a{2}"
    assert T.regex_alternatives("a(b|c)d|(e)") == ["abd", "acd", "(e)"]
    assert column(spark, ["A a.0"], T.pattern_to_regex) == [r"[A-Z]+\s+[a-z]+\.[0-9]+"]
