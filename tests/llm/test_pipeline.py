"""Each stage of the pipeline against a plain version, and all of them on odd and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_documents import WORDS, brute_classes, brute_lines

import corpus_pipeline
from quillshift.llm import queries
from quillshift.llm.common import compacted, connected_components
from quillshift.llm.mixing import mix_sources
from quillshift.llm.quality import score_quality
from quillshift.llm.word_cache import WordEncoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    """Prose, near and exact copies, repeated lines, junk, empty and null texts, a repeated row."""
    rng = random.Random(21)
    made = []
    for i in range(36):
        lines = [" ".join(rng.choices(WORDS, k=rng.randint(15, 40))) + "." for _ in range(rng.randint(1, 3))]
        made.append((i, "\n".join([*lines, "a line that all of these documents share"][: rng.randint(1, 4)]), "abc"[i % 3]))
    made += [(100 + i, made[i][1] + " more", "a") for i in range(6)] + [(120 + i, made[i][1], "b") for i in range(4)]
    return [*made, (200, "", "a"), (201, None, "b"), (202, "", None), (203, "!!! ### BUY BUY BUY " * 30, "c"), (3, made[3][1], "a")]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def kept(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect() if r["text"] is not None)


def test_quality_keeps_what_scores_enough(spark, rows):
    docs = frame(spark, rows)
    out = stage("quality")(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    scores = {r["doc_id"]: r["predicted"] for r in score_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(i for i, p in scores.items() if p)
    assert stage("quality")(spark, docs, SF).columns == docs.columns


def test_lines_go_as_by_brute_force(spark, rows):
    once = list(dict.fromkeys(rows))
    docs = frame(spark, once)
    stays = brute_lines([(i, t) for i, t, _ in once])
    want = {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if stays.get((i, n), True)) for i, t, _ in once}
    out = stage("lines")(spark, docs, SF)
    assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())


def test_one_document_of_each_class_stays(spark, rows):
    once = list(dict.fromkeys((i, t) for i, t, _ in rows))
    docs = frame(spark, [(i, t, "a") for i, t in once])
    want = sorted({c for _, c, _ in brute_classes(once)})
    assert sorted(r["doc_id"] for r in stage("near_duplicates")(spark, docs, SF).collect()) == want


def test_the_mixture_is_what_the_mix_takes(spark, rows):
    docs = frame(spark, rows)
    taken = Counter()
    for r in mix_sources(docs).collect():
        taken[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 1
    assert Counter(r["doc_id"] for r in stage("mixture")(spark, docs, SF).collect()) == +taken


def test_sequences_hold_every_token_once(spark, rows):
    once = list({i: (i, t, s) for i, t, s in rows}.values())
    got = stage("sequences")(spark, frame(spark, once), SF).collect()
    whole = WordEncoder(corpus_pipeline.TOKENIZER)
    ends = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == ends.get(r["doc_id"], 0)
        ends[r["doc_id"]] = r["start"] + r["length"]
    assert ends == {i: len(whole.whole(t or "")) // 4 + 1 for i, t, _ in once}
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in s) <= 2048 and [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] for s in spans.values())


def test_stages_feed_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, one) in enumerate(corpus_pipeline.STAGES):
        out = one(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0, name
    assert docs.count() == corpus_pipeline.run(spark, SF).count()


def test_stages_take_odd_and_empty_tables(spark, rows):
    odd = frame(spark, [*rows, (None, None, None), (None, "a b c", None), (None, "a b c", None)])
    for name, one in corpus_pipeline.STAGES:
        assert one(spark, odd, SF).count() > 0, name
        assert one(spark, odd.limit(0), SF).filter(F.lit(True)).count() == 0, name


def test_every_operator_has_a_query():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(queries.oracle_sql()) <= set(names)


def test_small_rounds_leave_few_files(spark):
    """A loop keeps a small round in one partition, and more rows in more."""
    pieces = spark.range(1000).repartition(50, "id")
    assert compacted(pieces).rdd.getNumPartitions() == 1 and compacted(pieces, rows=100).rdd.getNumPartitions() == 10
    assert compacted(pieces, rows=30).rdd.getNumPartitions() == 50
    assert sorted(r["id"] for r in compacted(pieces, rows=100).collect()) == list(range(1000))
    assert compacted(pieces.limit(0)).count() == 0
    edges = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 4).alias("b")).repartition(40, "a")
    roots = connected_components(edges)
    assert roots.groupBy("comp").count().count() == 100
