"""Operators over documents: edge rows, exactness against brute force, held-out accuracy."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillshift.llm import line_dedup
from quillshift.llm.common import connected_components
from quillshift.llm.exact_dedup import exact_dedup
from quillshift.llm.jaccard_join import intersections, jaccard_classes, keep_one_of_each_class, shingles, sketch
from quillshift.llm.line_dedup import drop_repeated_lines, line_classes
from quillshift.llm.mixing import expand_mix, fit_budget, fit_targets, mix_sources
from quillshift.llm.packing import best_fit, pack_documents, token_pieces
from quillshift.llm.quality import FEATURES, keep_quality, score_quality, statistics
from quillshift.llm.token_counts import TokenTree, apply_edits, build_trees, counter
from quillshift.llm.word_cache import WordEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")
RANKS_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string"
WORDS = [f"w{i}" for i in range(300)]


def docs(spark, rows):
    """Documents with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, long, repeated and tied rows."""
    long = " ".join(random.Random(1).choices(WORDS, k=30_000))
    rows = [(1, None, None), (2, "", "a"), (3, "x y z", "a"), (4, "x y z", "b"), (5, long, "b"), (6, long, None), (7, "x  y z", "a"), (7, "x  y z", "a"), (None, "x y z", "a"), (None, None, None), (8, "ünï\r\n\n ß", "c")]
    return docs(spark, rows)


def test_components(spark):
    random.seed(2)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(230)] + [(500 + i, 501 + i) for i in range(120)] + [(900, 900)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- exact dedup


def test_exact_dedup_of_odd_rows(odd):
    got = exact_dedup(odd).collect()
    assert len(got) == 11
    for r in got:
        assert len(r["text_sha256"]) == 64
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    for group in by.values():
        ids = [r["doc_id"] for r in group if r["doc_id"] is not None]
        assert {r["keep_id"] for r in group} == {max(ids, default=None)}
        assert {r["group_size"] for r in group} == {len(group)} and sum(r["kept"] for r in group) == 1
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert sorted(str(r["doc_id"]) for r in empty) == ["1", "2", "None"]


def test_texts_that_share_a_digest_stay_apart(spark):
    df = docs(spark, [(1, "a", "s"), (2, "b", "s"), (3, "a", "s"), (4, "c", "s")])
    got = {r["doc_id"]: (r["keep_id"], r["kept"], r["group_size"]) for r in exact_dedup(df, digest=lambda c: F.lit("same")).collect()}
    assert got == {1: (3, False, 2), 2: (2, True, 1), 3: (3, True, 2), 4: (4, True, 1)}


# ---- mixing


def test_targets():
    assert fit_targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert fit_targets([10, 1000], [5, 2]) == pytest.approx([30, 980])
    assert fit_targets([], []) == [] and fit_targets([0, 5], [5, 2]) == [0.0, 5.0]


def test_budget_is_met_as_near_as_can_be():
    rng = random.Random(4)
    for _ in range(150):
        lengths = np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 6))))
        counts = np.array([rng.randint(1, 3) for _ in lengths])
        budget = rng.uniform(0, float((lengths * counts).sum()))
        sums = {sum(a * b for a, b in zip(lengths, x, strict=True)) for x in itertools.product(*[range(c + 1) for c in counts])}
        take = fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert abs(int((take * lengths).sum()) - budget) <= min(abs(s - budget) for s in sums) + 1e-6
    big = np.arange(1, 4000)
    take = fit_budget(big, np.full(3999, 50), 123_456_789.4)
    assert abs(int((take * big).sum()) - 123_456_789.4) < 1


def test_budget_with_empty_texts():
    for lengths, counts, budget in (([0, 5, 7], [1, 1, 1], 6.0), ([0], [4], 3.0), ([0, 9], [2, 1], 2.0), ([0, 100_000], [3, 2], 150_000.0), ([], [], 5.0), ([0, 3], [1, 2], 1e9)):
        take = fit_budget(np.array(lengths), np.array(counts), budget)
        assert len(take) == len(lengths) and all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and not any(t for t, n in zip(take, lengths, strict=True) if not n)


def test_mix_with_empty_texts_in_every_source(spark):
    rng = random.Random(14)
    rows = [(i, rng.choice(["", None, " ", "a b", "c " * rng.randint(3, 9), "w " * 50]), s) for i, s in enumerate(["a", "b", "c", None] * 40)]
    rows += [(1000 + i, "", "d") for i in range(5)] + [(3, "a b", "a"), (3, "x y", "b"), (3, "x y", "b"), (None, "a b", "a"), (None, "a b", "a")]
    df = docs(spark, rows)
    mix = mix_sources(df)
    assert mix.count() == len(rows) and mix.filter("size = 0 and taken <> 0 or taken > 3 * size").isEmpty()
    out = expand_mix(df, mix)
    # what the mix takes is what comes out, repeated ids included
    assert out.count() == mix.selectExpr("sum(if(size > 0, taken div size, 1))").first()[0]
    assert expand_mix(df.limit(0), mix_sources(df.limit(0))).count() == 0


def test_mix_of_odd_rows(odd):
    first, again = (sorted(map(str, mix_sources(odd).collect())) for _ in range(2))
    assert first == again and len(first) == 11
    for r in mix_sources(odd).collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert mix_sources(odd.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    df = docs(spark, [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 40))), rng.choice(["a", "b", "é", None])) for i in range(600)])
    mix = mix_sources(df, rows_per_salt=50)
    for r in mix.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).collect():
        assert abs(r["t"] - r["target"]) <= 1 and r["s"] == r["source_size"]
    out = expand_mix(df, mix)
    assert out.columns == df.columns
    assert out.count() == mix.selectExpr("sum(if(size > 0, taken div size, 1))").first()[0]


# ---- quality


def labelled(spark, n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = rng.choices(WORDS, k=rng.randint(20, 200))
        text = " ".join(words) + "." if good else rng.choice([" ".join(w + "###" for w in words), " ".join(w for w in words[:9] for _ in range(12)), " | ".join(words).upper()])
        rows.append((i, text, "s"))
        labels.append((i, int(good), 0, "clash"))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_quality_on_held_out_rows(spark):
    df, labels = labelled(spark)
    got = score_quality(df, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in score_quality(df, flipped).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in got)
    kept = keep_quality(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)


def test_scores_are_those_of_the_densities(spark):
    """The discriminant against its definition: log-densities with explicit inverses and determinants."""
    df, labels = labelled(spark, 300)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    x = {i: np.array(statistics(t)) for i, t in texts.items()}
    seen = [i for i in sorted(known) if zlib.crc32(str(i).encode()) % 5]
    rows, y = np.array([x[i] for i in seen]), np.array([known[i] for i in seen])
    centre, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-6)
    z = lambda v: np.clip((v - centre) / scale, -12, 12)
    d, groups = len(FEATURES), [z(rows[y == c]) for c in (0, 1)]
    pooled = sum(len(g) / len(rows) * np.cov(g.T, bias=True) for g in groups) + 1e-3 * np.eye(d)
    log = {}
    for c, g in enumerate(groups):
        s = 0.8 * np.cov(g.T, bias=True) + 0.2 * pooled
        s = 0.95 * s + 0.05 * np.diag(np.diag(s)) + 1e-3 * np.eye(d)
        inverse, (_, size) = np.linalg.inv(s), np.linalg.slogdet(s)
        prior = np.log((len(g) + 1) / (len(rows) + 2))
        log[c] = {i: prior - 0.5 * size - 0.5 * (z(v) - g.mean(axis=0)) @ inverse @ (z(v) - g.mean(axis=0)) for i, v in x.items()}
    for r in score_quality(df, labels).collect():
        i = r["doc_id"]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(np.clip(0.5 * (log[0][i] - log[1][i]), -700, 700))), abs=1e-6)


def test_quality_of_odd_rows(spark, odd):
    _, labels = labelled(spark, 50)
    assert score_quality(odd, labels).filter("score between 0 and 1").count() == 11
    assert {r["score"] for r in score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert score_quality(odd.limit(0), labels).count() == 0
    only = labels.withColumn("quality", F.lit(1)).unionByName(labels.withColumn("quality", F.lit(None).cast("int")))
    assert score_quality(odd, only).count() == 11


# ---- packing and token counts


def test_words_encode_as_the_tokenizer_does():
    enc = WordEncoder(WORDS_FILE, max_words=50)
    rng = random.Random(7)
    texts = ["", " ", "it's I'LL 3.14 ñandú", "''s 'D d'accord", "a\tb\n\nc!!'S'", "ÿÞßÐ÷×", "<|endoftext|>x", "“q” 字 Σς", "x" * 500]
    texts += ["".join(rng.choices("aBé'sd l1!?_-\n|<>", k=60)) for _ in range(200)]
    assert all(enc.encode(t) == enc.whole(t) for t in texts * 2)


def test_pieces_rebuild_documents(spark, odd):
    whole = WordEncoder(WORDS_FILE)
    rows = token_pieces(odd, WORDS_FILE, window=64, with_ids=True).filter("doc_id in (3, 5)").collect()
    for doc, text in ((3, "x y z"), (5, odd.filter("doc_id = 5").first()["text"])):
        parts = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"])
        ids = np.frombuffer(whole.whole(text), dtype="<u4").tolist() + [1]
        assert [x for r in parts for x in r["ids"]] == ids and {r["doc_tokens"] for r in parts} == {len(ids)}
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and r["length"] <= 64 for r in parts)


def test_packing(odd):
    got = pack_documents(odd, WORDS_FILE).collect()
    assert {r["doc_id"] for r in got} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert pack_documents(odd.limit(0), WORDS_FILE).count() == 0


def test_best_fit_is_best_fit_decreasing():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 100, 300)
    where, offset = best_fit(lengths, 100)
    free: dict[int, int] = {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [c for c in free.values() if c >= lengths[i]]
        if fits:
            assert free[where[i]] == min(fits) and offset[i] == 100 - free[where[i]]
            free[where[i]] -= lengths[i]
        else:
            assert where[i] not in free and offset[i] == 0
            free[where[i]] = 100 - lengths[i]


def test_edited_trees_count_as_the_tokenizer_does():
    known = counter(RANKS_FILE)
    rng = random.Random(9)
    signs = ["a", "b", " ", "  ", "\n", "'", "s", "ll", "1", "é", "!", "…", "　", "字", "don't ", "'re", "\t"]
    for _ in range(400):
        tree = TokenTree("".join(rng.choices(signs, k=rng.randint(0, 60))), known, leaf_pieces=rng.choice([1, 2, 3, 8]))
        for _ in range(4):
            tree.edit(rng.randint(-2, len(tree.text) + 3), rng.randint(-1, 10), "".join(rng.choices(signs, k=rng.randint(0, 5))))
            assert tree.total == len(known.coding.encode_ordinary(tree.text)) and sum(tree.chars) == len(tree.text)


def test_edits_repair_paths():
    known = counter(RANKS_FILE)
    rng = random.Random(15)
    rebuilt = edits = 0
    for _ in range(40):
        tree = TokenTree(" ".join(rng.choices(WORDS, k=rng.randint(300, 3000))), known)
        for _ in range(10):
            tree.edit(rng.randrange(len(tree.text)), rng.choice([0, 5, 12]), rng.choice(["", "rewritten", "a title of five words\n"]))
            edits += 1
        assert tree.total == len(known.coding.encode_ordinary(tree.text)) and tree.sum_tokens[1] == sum(tree.tokens)
        rebuilt += tree.rebuilt
    assert rebuilt <= 0.01 * edits


def test_edits_touch_little(spark, odd):
    trees = build_trees(odd, RANKS_FILE)
    assert trees.filter("n_tokens = 0").count() == 3
    edits = F.expr("array(named_struct('start', 5000, 'length', 3, 'replacement', 'new words'), cast(null as struct<start:int,length:int,replacement:string>))")
    got = apply_edits(trees.withColumn("edits", F.when(F.length("text") > 9, edits)), RANKS_FILE).filter("doc_id = 5").first()
    assert got["n_tokens"] == len(counter(RANKS_FILE).coding.encode_ordinary(got["text"])) and 0 < got["encoded_chars"] < 2_000
    assert apply_edits(build_trees(odd.limit(0), RANKS_FILE).withColumn("edits", edits), RANKS_FILE).count() == 0


# ---- near duplicates


def brute_classes(rows, threshold=0.8):
    sets = [set(shingles(t).tolist()) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or (a | b and len(a & b) >= threshold * len(a | b) - 1e-9):
            links[i] += 1
            links[j] += 1
            parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, least[root(i)], links[i]) for i, (d, _) in enumerate(rows))


def near_rows(rng, groups=12, chain=True):
    rows = []
    for _ in range(groups):
        base = rng.choices(WORDS, k=rng.randint(1, 120))
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append(words)
            if chain and rng.random() < 0.4:
                base = words
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_jaccard_classes_equal_brute_force(spark):
    rows = [*near_rows(random.Random(10)), (900, ""), (901, "  "), (902, "w1"), (903, "W1")]
    df = docs(spark, [(i, t, "s") for i, t in rows])
    # small buckets and blocks, so that every path is taken
    got = sorted(tuple(r) for r in jaccard_classes(df, bucket=4, block=4).collect())
    assert got == brute_classes(rows)


def test_large_components_are_dealt_into_parts(spark):
    rows = [*near_rows(random.Random(16), groups=3), *[(2000 + i, " ".join([*WORDS[:60], f"x{i}"])) for i in range(40)]]
    df = docs(spark, [(i, t, "s") for i, t in rows])
    want = brute_classes(rows)
    assert sorted(tuple(r) for r in jaccard_classes(df, bucket=8, block=8, depth=2).collect()) == want
    assert sorted(tuple(r) for r in jaccard_classes(df, bucket=2, block_bytes=4096).collect()) == want


def test_no_link_is_lost_on_the_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_classes([(r["doc_id"], r["text"]) for r in df.collect()])
    got = sorted(tuple(r) for r in jaccard_classes(df).collect())
    recall = sum(min(a[2], b[2]) for a, b in zip(got, want, strict=True)) / max(1, sum(b[2] for b in want))
    print(f"recall of links: {recall:.4f}")
    assert got == want


def test_jaccard_of_odd_rows(odd):
    got = jaccard_classes(odd).collect()
    assert len(got) == 11 and jaccard_classes(odd.limit(0)).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["class_id"] == by[2]["class_id"] == 1 and by[3]["class_id"] == by[7]["class_id"] == 3 and by[6]["class_id"] == 5 and by[6]["n_links"] == 1
    kept = keep_one_of_each_class(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 3, 5, 8]


def test_intersections_and_sketches():
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 200))).astype(np.uint64) for _ in range(9)]
    got = intersections(sets, rare=3, cells=128)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)
    a = shingles(" ".join(WORDS[:200]))
    b = shingles(" ".join(WORDS[:190] + ["other"] * 3))
    real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sketch(a) == sketch(b)).mean() - real) < 0.25


# ---- lines


def brute_lines(rows, threshold=0.8):
    """Which lines stay, from the definition: sets of every 8 characters in a row."""
    places = [(d, i, x.strip(" \t\r\x0b\x0c").lower()) for d, t in rows for i, x in enumerate((t or "").split("\n"))]
    sets = {x: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for _, _, x in places if x}
    parent = {x: x for x in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(sets, 2):
        if len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]) - 1e-9:
            parent[root(y)] = root(x)
    heads = {}
    for d, i, x in places:
        if x:
            heads[root(x)] = min(heads.get(root(x), (d, i)), (d, i))
    return {(d, i): heads[root(x)] == (d, i) for d, i, x in places if x}


def test_lines_equal_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(12, 40))) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(base).split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(rng.choice(["", " "]) + " ".join(words))
        rows.append((d, "\n".join([*lines, "", "Same Line."])))
    df = docs(spark, [(i, t, "s") for i, t in rows])
    want = brute_lines(rows)
    marks = line_classes(df)
    got = {(r["doc_id"], r["line_no"]): r["kept"] for r in marks.collect()}
    assert got.keys() == want.keys()
    # banding may miss a link at the threshold; it never makes one
    assert not any(want[p] and not got[p] for p in want)
    assert sum(want[p] != got[p] for p in want) <= 0.02 * len(want)
    out = drop_repeated_lines(df)
    assert out.columns == df.columns and out.count() == 60
    for r in out.collect():
        text = dict(rows)[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for i, x in enumerate(text) if got.get((r["doc_id"], i), True)) and r["n_chars"] == len(r["text"])


def test_lines_of_odd_rows(odd):
    marks = line_classes(odd)
    assert marks.filter("kept").count() < marks.count() and line_classes(odd.limit(0)).count() == 0
    out = drop_repeated_lines(odd)
    assert out.count() == 11 and out.filter("text is null").count() == 2
    assert out.filter("doc_id = 4").first()["text"] == "" and drop_repeated_lines(odd.limit(0)).count() == 0


def test_lines_count_all_shingles(spark):
    rng = random.Random(5)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120))
    digits = ["".join(rng.choices("0123456789abcdef", k=16)) for _ in range(6)]
    texts = [
        "Verantwortlich", "Verantwortung", "order 1234567812345678 shipped", "order 1234567899999999 shipped",
        *[digits[0][:8] + d[8:] + d for d in digits], han, han[:3] + "一" + han[3:], "abc", "abcd", "ABC ", "12345678", "123456789",
        "x" * 40, "x" * 41, "one line; with marks!!! and more of them...", "one line; with marks??? and more of them...",
    ]
    rows = list(enumerate(texts))
    want = brute_lines(rows)
    assert {(r["doc_id"], r["line_no"]): r["kept"] for r in line_classes(docs(spark, [(i, t, "s") for i, t in rows])).collect()} == want
    assert want[0, 0] and want[1, 0] and want[3, 0] and not want[11, 0]


def test_top_word_is_that_of_the_whole_text():
    at = FEATURES.index("top_word")
    first = [f"w{i}" for i in range(40)]
    assert statistics(" ".join([*first, *["spam"] * 60]))[at] == statistics(" ".join([*["spam"] * 60, *first]))[at]
    assert statistics(" ".join([*first, *["spam"] * 60]))[at] == pytest.approx(np.log((60 + 0.02 * 60) / (100 + 60)))


def near_line(rng, line, alphabet, size, places):
    """The line with characters exchanged in a few places, while it stays at 0.8."""
    grams = lambda t: {t[i : i + 8] for i in range(max(1, len(t) - 7))}
    made = line
    for _ in range(places):
        at = rng.randrange(len(line))
        trial = made[:at] + rng.choice(alphabet) + made[at + 1 :]
        a, b = grams(line), grams(trial)
        if len(a & b) < 0.8 * len(a | b):
            break
        made = trial
    return made


@pytest.mark.parametrize("size", [60, 150, 600])
def test_near_lines_are_linked_in_any_script(spark, size):
    """Recall of pairs at 0.8 or more by script and length, lines without the commonest letters among them."""
    rng = random.Random(size)
    scripts = {
        "few letters": "bcdfghijklmnopqrstuvwxyz", "digits": "0123456789", "latin": "abcdefghijklmnopqrstuvwxyz      äöü", "cyrillic": "".join(map(chr, range(0x430, 0x450))) + "   ",
        "greek": "".join(map(chr, range(0x3B1, 0x3C9))) + "  ", "han": "".join(map(chr, range(0x4E00, 0x5200))), "mixed": "abc 中文字🙂🙃 0123",
    }
    rows, kinds = [], {}
    for kind, alphabet in scripts.items():
        for _ in range(40):
            line = "".join(rng.choices(alphabet, k=size)).strip() + "z"
            kinds[len(rows) // 2] = kind
            rows += [(len(rows), line), (len(rows) + 1, near_line(rng, line, alphabet, size, max(1, size // 60)))]
    classes = {r["doc_id"]: r["class_id"] for r in line_classes(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    missed = {k: sum(classes[2 * i] != classes[2 * i + 1] for i, kind in kinds.items() if kind == k) for k in scripts}
    assert sum(missed.values()) <= 0.01 * len(kinds), missed
    assert len(set(classes.values())) >= len(kinds)


def test_lines_that_differ_in_digits_alone(spark):
    """600 letters without e and a, and 40 digits of their own: 0.88 or more."""
    rng = random.Random(9)
    rows = []
    for n in range(30):
        base = "".join(rng.choices("bcdfghijklmnopqrstuvwxyz", k=600))
        rows += [(2 * n + j, base + "".join(rng.choices("0123456789", k=40))) for j in (0, 1)]
    classes = {r["doc_id"]: r["class_id"] for r in line_classes(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert sum(classes[2 * n] == classes[2 * n + 1] for n in range(30)) >= 30


def test_no_link_is_missed_in_large_buckets(spark):
    """300 pairs of lines in one boilerplate: most of what bands bring together is the boilerplate's, and other lines' pivots tell nothing."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 7))) for _ in range(4000)]
    common, rows = " ".join(rng.choices(words, k=42)), []
    for n in range(300):
        tail = rng.choices(words, k=20)
        for _ in (0, 1):
            own = list(tail)
            own[rng.randrange(20)] = rng.choice(words)
            own[rng.randrange(20)] = rng.choice(words)
            rows.append((len(rows), f"{common} {' '.join(own)}"))
    grams = [{t[i : i + 8] for i in range(len(t) - 7)} for _, t in rows]
    linked = [n for n in range(300) if len(grams[2 * n] & grams[2 * n + 1]) >= 0.8 * len(grams[2 * n] | grams[2 * n + 1])]
    assert len(linked) > 100
    classes = {r["doc_id"]: r["class_id"] for r in line_classes(docs(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert [n for n in linked if classes[2 * n] != classes[2 * n + 1]] == []
    assert len(set(classes.values())) >= 300


def test_large_buckets_compare_few_pairs(spark):
    """82 lines about one text: two are linked, 80 lack a part each; their shingles are frequent, and compared pairs were 3,321."""
    rng = random.Random(13)
    random_text = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    base = random_text(600)
    lines = [base[:at] + random_text(n) + base[at + n :] for at, n in [(100, 12), (400, 12)] + [(rng.randrange(510), 90) for _ in range(80)]]
    grams = [{t[i : i + 8] for i in range(len(t) - 7)} for t in lines]
    near = {(i, j) for i, j in itertools.combinations(range(82), 2) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    texts = spark.createDataFrame([(i, t, len(g)) for i, (t, g) in enumerate(zip(lines, grams))], "lid long, line string, size int")
    crowd = texts.select(F.lit(1).alias("key"), "lid")
    alone = texts.select("lid", F.col("lid").alias("comp"))
    rarest = line_dedup._rarest(texts, 0.8).cache()
    postings = rarest.select("lid", "size", F.explode("rarest").alias("r")).select("lid", "size", "r.n", "r.token")
    pairs = line_dedup._by_rare(line_dedup._apart(postings, alone), 0.8).unionByName(line_dedup._by_bucket(crowd, rarest, alone, 0.8))
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    assert (0, 1) in near and near <= got and len(got) < len(near) + 300


def test_counts_by_sectors_never_exceed_the_difference(spark):
    rng = random.Random(17)
    sets = [[rng.randrange(-(2**63), 2**63) for _ in range(300)] for _ in range(4)]
    rows = [(sets[i], sets[i][: 300 - n] + sets[j][:n], 2 * n) for i, j in itertools.permutations(range(4), 2) for n in (0, 10, 100, 300)]
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, differ int")
    for c in ("x", "y"):
        df = line_dedup.with_sectors(df, f"s{c}", F.col(c))
    got = df.select("differ", line_dedup._differing("sx", "sy").alias("least"), F.aggregate("sx", F.lit(0), lambda s, x: s + x).alias("n")).collect()
    assert all(r["least"] <= r["differ"] and r["n"] == 300 for r in got) and any(r["least"] > 100 for r in got)


def test_lines_under_other_names(spark):
    df = spark.createDataFrame([(1, "a line of some length\nanother one", "x"), (2, "A line of some length", "y")], "key long, body string, text string")
    out = {r["key"]: (r["body"], r["text"]) for r in drop_repeated_lines(df, id_col="key", text_col="body").collect()}
    assert out == {1: ("a line of some length\nanother one", "x"), 2: ("", "y")}
