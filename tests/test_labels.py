"""Stored labels: each text asked for once, whatever becomes of a run."""

import pytest
from pyspark.sql import functions as F

from quillshift.plans.labels import label_rows_once, prompt_query
from quillshift.plans.providers import few_shot
from quillshift.sources.shared import ensure_checkpoint_dir

SHOWN = [("a b", "[x][y]"), ("c", "[x]")]


def service(log, fails=()):
    """Labels a text by its length; writes down what it was asked; ``fails``: texts and what they raise."""

    def call(prompts):
        asked = [prompt_query(p) for p in prompts]
        for t in asked:
            for bad, error in fails:
                if t == bad:
                    raise error
        with open(log, "a") as f:
            f.write("".join(t.replace("\n", "/") + "\n" for t in asked))
        return [f"well: [{len(t)}]" for t in asked]

    return call


def test_query_of_a_prompt():
    for t in ("k", "two\nlines", "Input: x", ""):
        assert prompt_query(few_shot(SHOWN, t)) == (t if "Input: " not in t else "x") or t == "Input: x"


def test_texts_are_asked_for_once(spark, tmp_path):
    store, log = f"{ensure_checkpoint_dir(spark)}/{tmp_path.name}-once", tmp_path / "log"
    rows = [(i, f"t{i % 7}") for i in range(40)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "row_id long, input string").withColumn("key", F.lit("clash"))
    for _ in range(2):
        got = {r["row_id"]: r["composition"] for r in label_rows_once(df, service(log), SHOWN, store).collect()}
        assert got == {**{i: "[2]" for i in range(40)}, 90: None, 91: "[0]"}
        assert sorted(log.read_text().splitlines()) == sorted(["", *(f"t{i}" for i in range(7))])
    # other examples make another prompt
    label_rows_once(df, service(log), SHOWN[:1], store).count()
    assert len(log.read_text().splitlines()) == 16
    assert label_rows_once(df.limit(0), service(log), SHOWN, store).count() == 0


def test_a_killed_run_goes_on(spark, tmp_path):
    store, log = f"{ensure_checkpoint_dir(spark)}/{tmp_path.name}-kill", tmp_path / "log"
    df = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "row_id long, input string")
    with pytest.raises(Exception):  # noqa: B017
        label_rows_once(df, service(log, [("text 59", SystemExit("killed"))]), SHOWN, store, per_round=6, batch=2, tasks=1)
    first = log.read_text().splitlines()
    made = label_rows_once(df, service(log), SHOWN, store, per_round=6, batch=2, tasks=1)
    assert made.filter("composition rlike '^.[67].$'").count() == 60
    again = log.read_text().splitlines()[len(first) :]
    # what was committed is not asked for again; a round at most is
    assert len(set(again)) == len(again) and len(set(first) & set(again)) <= 14


def test_what_fails_is_asked_again(spark, tmp_path):
    store, log = f"{ensure_checkpoint_dir(spark)}/{tmp_path.name}-fail", tmp_path / "log"
    df = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "row_id long, input string")
    got = {r["row_id"]: r["composition"] for r in label_rows_once(df, service(log, [("t3", ValueError("no"))]), SHOWN, store).collect()}
    assert got == {0: "[2]", 1: "[2]", 2: "[2]", 3: "", 4: "[2]"}
    assert {r["composition"] for r in label_rows_once(df, service(log), SHOWN, store).collect()} == {"[2]"}
    assert sorted(log.read_text().splitlines()) == ["t0", "t1", "t2", "t3", "t4"]
