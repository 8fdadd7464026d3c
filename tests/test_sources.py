import sys
import types

import pytest



from quillshift import cli
from quillshift.functions.positions import Abs, Edge
from quillshift.sources import datasets, sinks, truth


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_pairs(spark, tmp_path):
    path = write(tmp_path / "d" / "one.csv", '﻿"a, ""b""",x\nNA,1\n,y\n"q\nr",z\n')
    rows = datasets.read_pairs(spark, path).orderBy("row_id").collect()
    assert [(r["row_id"], r["input"], r["output"]) for r in rows] == [(0, 'a, "b"', "x"), (1, "NA", "1"), (2, "", "y"), (3, "q\nr", "z")]
    assert {r["dataset"] for r in rows} == {"one"}


def test_roles_and_ids(spark):
    rows = datasets.mock_rows(spark)
    assert datasets.with_roles(rows, 2).filter("role = 'example'").count() == 2 == datasets.examples(rows, 2).count()
    assert datasets.cluster_input(rows, 3).count() == 7 and datasets.truth(rows, 3).count() == 1
    clusters = spark.createDataFrame([(0, 1), (0, 2)], "cluster_id int, row_id long")
    assert datasets.cluster_strings(clusters, rows).count() == 2


def test_truth_files(spark, tmp_path):
    path = write(tmp_path / "c.txt", "0,2,2\n1\n\n3,4\n")
    got = {(r["cluster_id"], r["row_id"]) for r in truth.read_clusters(spark, path).collect()}
    assert got == {(0, 0), (0, 2), (1, 1), (2, 3), (2, 4)}
    split = write(tmp_path / "s.txt", "day: 1\nyear:2\n[ITEM]\nday:3\n[ITEM]\n")
    parts = truth.read_split(spark, split)
    assert parts == {0: {"day": "1", "year": "2"}, 1: {"day": "3"}} and truth.read_split(spark, split, [1, 9]) == {1: {"day": "3"}}
    assert truth.component_rows(parts, 1)[-1] == (0, "out", 0, "day", "3")
    ops = write(tmp_path / "o.txt", "4\nday:AbsPos(0)[PARAMSPLIT]AbsPos(-1)\nx:RegPos([ESCAPECOMMA],0,R)[PARAMSPLIT]RegPos([ESCAPENUMBER],-1,L)\n[ITEM]\n5\ny:AbsPos(1)[PARAMSPLIT]AbsPos(-3)\n")
    assert truth.read_programs(spark, ops) == {4: {"day": [(Abs(0), Abs(None))], "x": [(Edge(",", 0, "R"), Edge(r"\d+", -1, "L"))]}, 5: {"y": [(Abs(1), Abs(-2))]}}
    assert truth.read_types(spark, write(tmp_path / "t.txt", "a\nb\na\n")) == ["a", "b"]
    comps = spark.createDataFrame([("[Year1][city_]",)], "composition string")
    assert {r[0] for r in truth.types_of_compositions(comps).collect()} == {"year", "city"}
    rows = datasets.mock_rows(spark)
    labelled = write(tmp_path / "l.csv", "07.04.2001,3\nzz,4\n")
    assert [tuple(r) for r in truth.read_labelled(spark, labelled, rows).collect()] == [(1, 3)]
    assert truth.feature_subsets(["a", "b"]) == [("a",), ("b",), ("a", "b")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("f", "m", 1.0)], "file string, model string, accuracy double")
    sinks.append_text(df, str(tmp_path / "log"), "concat(file, ' ', accuracy)")
    sinks.append_text(df, str(tmp_path / "log"), "concat(file, ' ', accuracy)")
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    sinks.write_matrix(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 2
    clusters = spark.createDataFrame([(0, 2), (0, 1), (1, 3)], "cluster_id int, row_id long")
    sinks.write_clusters(clusters, str(tmp_path / "c"))
    assert truth.read_clusters(spark, str(tmp_path / "c")).count() == 3
    assert sinks.feature_table(df, str(tmp_path / "f")).count() == 1


def test_memo(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or {"a": 1}
    memo = sinks.Memo(spark, str(tmp_path / "memo"))
    assert memo("f", [1], make) == memo("f", [1], make) == {"a": 1} and len(calls) == 1
    assert sinks.Memo(spark, str(tmp_path / "memo"))("f", [1], make) == {"a": 1} and len(calls) == 1
    memo.clear("f")
    memo("f", [1], make)
    assert len(calls) == 2


def test_cli(spark, tmp_path):
    lines = "".join(f"{a} {b},{b} {a}\n" for a, b in [("ab", "cd"), ("ef", "gh"), ("ij", "kl"), ("mn", "op"), ("qr", "st"), ("uv", "wx"), ("yz", "aa")])
    data = write(tmp_path / "d" / "Swap.csv", lines)
    got = cli.main([data, "-k", "3", "-o", str(tmp_path / "out")], lambda: spark)
    assert got[0][0] == "Swap" and got[0][2] == "ok" and got[0][1] == 1.0
    assert spark.read.parquet(str(tmp_path / "out" / "transformations")).count() == 7


@pytest.mark.parametrize("strategy", ["collapse_embedding"])
def test_cli_with_strategies(spark, tmp_path, strategy):
    (tmp_path / "pets.csv").write_text("".join(f"{a} {n},{n}\n" for n, a in enumerate(["cat", "dog", "owl", "emu", "ant", "bee", "cod", "eel"], 10)))
    got = cli.main([str(tmp_path / "pets.csv"), "-k", "3", "--strategy", strategy], lambda: spark)
    assert [(name, status) for name, _, status in got] == [("pets", "ok")] and got[0][1] == 1.0


def test_cli_with_given_clusters_and_programs(spark, tmp_path):
    pairs = [("ab-1", "1 ab"), ("cd-2", "2 cd"), ("ef-3", "3 ef"), ("gh-44", "44 gh"), ("ij-5", "5 ij"), ("kl-6", "6 kl"), ("mn-77", "77 mn")]
    data = write(tmp_path / "d" / "Flip.csv", "".join(f"{a},{b}\n" for a, b in pairs))
    write(tmp_path / "c" / "Flip_cluster.txt", "0,1,2,3,4,5,6\n")
    split = lambda a: dict(zip(("word", "number"), a.split("-"), strict=True))
    items = [f"word:{split(a)['word']}\nnumber:{split(a)['number']}" for a, _ in pairs]
    items += [f"number:{split(a)['number']}\nword:{split(a)['word']}" for a, _ in pairs]
    write(tmp_path / "s" / "Flip_split.txt", "\n[ITEM]\n".join(items) + "\n")
    write(tmp_path / "o" / "Flip_op.txt", "0\nword:AbsPos(0)[PARAMSPLIT]RegPos(-,0,L)\nnumber:RegPos(-,0,R)[PARAMSPLIT]AbsPos(-1)\n")
    common = [data, "-k", "3", "-s", str(tmp_path / "s"), "--clusters", str(tmp_path / "c"), "-o", str(tmp_path / "out")]
    for more in ([], ["--operators", str(tmp_path / "o")], ["--order", "most", "--further"]):
        assert cli.main([*common, *more], lambda: spark)[0][1:] == (1.0, "ok"), more
    seconds = spark.read.option("header", True).csv(str(tmp_path / "out" / "seconds")).collect()
    assert {r["file"] for r in seconds} == {"Flip", "mean"} and all(float(r["k3"]) > 0 for r in seconds)


def test_the_rest_works_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "quillshift.llm", None)
    monkeypatch.setitem(sys.modules, "quillshift.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as entry

    assert isinstance(entry, types.ModuleType) and "url_to_host_e2e" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
