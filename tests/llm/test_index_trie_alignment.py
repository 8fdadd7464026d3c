"""Token alignment, decontamination and the prefix trie against plain versions."""

import bisect
import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers as public
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillshift.llm import decontamination as deco
from quillshift.llm import prefix_trie as trie
from quillshift.llm import token_alignment as align
from quillshift.llm.common import scratch, slices

DOCS = "doc_id long, text string"


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["aa", None, "b" * 50, "", "cc"])], names=["i", "t"])
    parts = list(slices(batch, 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(5)) and len(parts) == 3


# ---- token alignment


def plain_alignment(docs):
    a, b = align.ByteLevel(public.path("byte_bpe_50k.json")), align.Pieces(public.path("piece_bpe_32k.model"))
    made, links = [], Counter()
    for doc_id, text in docs:
        raw = (" " + text).encode() if text else b""
        ids = [t.encode([text])[0] if text else [] for t in (a, b)]
        parts = [[t.parts[i] for i in own] for t, own in zip((a, b), ids, strict=True)]
        if not text or any(b"".join(p) != raw for p in parts):
            made.append((doc_id, [], [], [], ""))
            continue
        ends = [list(itertools.accumulate(map(len, p))) for p in parts]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k in (0, 1):
            for i, e in zip(ids[k], ends[k], strict=True):
                groups[bisect.bisect_left(cuts, e)][k].append(str(i))
        groups = ["|".join(",".join(half) for half in g) for g in groups]
        at = defaultdict(list)
        for j, f in zip(ids[1], ends[1], strict=True):
            at[f].append(j)
        own = [(i, j) for i, e in zip(ids[0], ends[0], strict=True) for j in at[e]]
        links.update(own)
        made.append((doc_id, ids[0], ids[1], own, hashlib.sha256(";".join(groups).encode()).hexdigest(), len(groups)))
    top = defaultdict(int)
    for (_, j), n in links.items():
        top[j] = max(top[j], n)
    return sorted(
        (str(m[0]), len(m[1]), len(m[2]), m[5] if len(m) > 5 else 0, len(m[3]), sum(links[p] == top[p[1]] for p in m[3]), sum(links[p] for p in m[3]), m[4]) for m in made
    )


ODD = [(1, "Hello world, hello <|endoftext|> </s> world"), (2, None), (3, ""), (4, "tab\tand  spaces \n\n new ▁ line"), (5, "naïve 中文 🙂👍🏽 é"), (6, "Hello world, hello"), (6, "Hello world, hello"), (None, " lead and trail "), (8, "x" * 3000 + " end"), (9, " 　 wide"), (10, "\x00\x01 <0x41>")]


@pytest.mark.parametrize("held", [align.HELD_PAIRS, 0])
def test_alignment_equals_plain(spark, held):
    docs = spark.createDataFrame(ODD, DOCS).withColumn("pairs", F.lit(1)).withColumn("_row", F.lit("x")).repartition(3)
    got = align.align_tokens(docs, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), scratch(spark, "t"), held_pairs=held, fast=public.path("byte_bpe_50k.tiktoken"), pattern=public.PATTERN)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_alignment(ODD)


def test_alignment_of_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert align.align_tokens(docs, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"), scratch(spark, "t")).count() == 0


def test_op11_on_whole_tables(spark):
    from quillshift.llm.token_alignment import op11_token_alignment

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = op11_token_alignment(spark, "/root/testdata/sf0.001")
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_alignment([tuple(r) for r in docs])


def test_fast_merges_have_the_files_ids():
    rng = random.Random(3)
    letters = "ab é\n\t  　'sé<|endoftext|>🙂́ 中文 123 \x85 re ll_"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    plain, fast = (align.ByteLevel(public.path("byte_bpe_50k.json"), f, public.PATTERN) for f in (None, public.path("byte_bpe_50k.tiktoken")))
    assert fast.ranks is not None and plain.encode(texts) == fast.encode(texts)


def test_tokens_without_bytes_link_to_all_at_their_end():
    # ids are lengths here: A ends at 2, 2, 3; B at 2, 3, 3
    m = align.aligned([[2, 0, 1]], [[2, 1, 0]], *[__import__("numpy").arange(4)] * 2)
    assert m["n_groups"].tolist() == [2] and m["n_links"].tolist() == [4]
    assert sorted(zip(m["link_a"].tolist(), m["link_b"].tolist(), strict=True)) == [(0, 2), (1, 0), (1, 1), (2, 2)]


# ---- decontamination


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(docs, items, window=10, slop=0):
    out = []
    for doc_id, text in docs:
        w = plain_words(text)
        hit, exact, near = set(), set(), set()
        for item, t in items:
            v = plain_words(t)
            for at in range(max(0, len(v) - window) + 1 if v else 0):
                own = v[at : at + window]
                for p in range(-slop, len(w)):
                    if w[max(p, 0) : p + len(own)] == own and p >= 0:
                        exact.add(str(item) if item is not None else "")
                        hit.update(range(p, p + len(own)))
                    if all(own[k] in w[max(0, p + k) : max(0, p + k + slop + 1)] for k in range(len(own))):
                        near.add(str(item) if item is not None else "")
        out.append((str(doc_id), len(w), len(hit), sorted(exact), sorted(near)))
    return sorted(out)


@pytest.mark.parametrize(("slop", "shard", "window"), [(0, 8192, 10), (2, 8192, 10), (3, 2, 4), (0, 1, 1)])
def test_decontamination_equals_plain(spark, monkeypatch, slop, shard, window):
    monkeypatch.setattr(deco, "SHARD", shard)
    rng = random.Random(slop)
    vocab = ["a", "b", "the", "É", "x1", "wort", "中", "THE"]
    long = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, long(rng.randint(1, 14))) for i in range(12)] + [(90, None), (91, ""), (92, "a a a a a a a a a a a"), (93, "a"), (3, "the Wort"), (None, "b, 中"), (94, "unseen word here")]
    docs = [(i, long(rng.randint(0, 40))) for i in range(25)] + [(50, None), (51, ""), (52, "--- !"), (53, (items[2][1] or "") + ". " + (items[5][1] or "")), (53, items[0][1]), (None, "x " + items[4][1] + " y"), (54, "a " * 3000), (55, "Words BETWEEN items[4]")]
    index = deco.build_index(spark.createDataFrame(docs, DOCS).withColumn("block", F.lit("clash")).repartition(3), scratch(spark, "i"), block_bytes=300)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("wid", F.lit(0))
    got = deco.contamination(index, asked, window=window, slop=slop).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["near_items"]) for r in got) == plain_hits(docs, items, window, slop)


def test_windows_of_a_block_are_met_together(monkeypatch):
    """As many searches as a window has words, however many windows: found where a plain search finds them."""
    texts = [None, "b a b c", "", "a b c a b x c", "c b a", "a b c"]
    index = deco.postings(3, pa.array(range(len(texts)), pa.int64()), [t and t.encode() for t in texts]).to_pandas()
    windows = [tuple(w) for n in (1, 2, 3) for w in itertools.product("abc", repeat=n)]
    lists = dict(zip(index["term"], map(deco.places_of, index["positions"]), strict=True))
    asks = pd.DataFrame([
        {"block": 3, "item": " ".join(w), "length": len(w), "names": list(w), "places": list(range(len(w))), "bases": np.unique(lists[w[0]][:, None] - np.arange(3))} for w in [*windows, ("a", "z")]
    ])
    calls, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: calls.append(1) or search(*a, **k))
    found = deco.windows_in_block(asks, index, 2)
    assert len(calls) <= 4
    made = {(r.row, r.item): (r.exact.tolist(), r.near.tolist()) for r in found.itertuples()}
    want = {}
    for row, text in enumerate(texts):
        have = (text or "").split()
        for w in windows:
            at = lambda p, far: [any(have[q : q + 1] == [x] for q in range(max(0, p + k), p + k + far + 1)) for k, x in enumerate(w)]  # noqa: B023, E731
            near = [p for p in range(-9, len(have)) if all(at(p, 2)) and any(at(p, 0))]
            if near:
                want[row, " ".join(w)] = ([p for p in near if all(at(p, 0))], near)
    assert made == want and len(found) == len(made)
    assert not len(deco.windows_in_block(asks.tail(1), index, 2))


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = deco.build_index(docs, scratch(spark, "i"))
    assert [(r["n_words"], r["n_hit"]) for r in deco.contamination(some, items.limit(0)).collect()] == [(2, 0)]
    assert deco.contamination(deco.build_index(docs.limit(0), scratch(spark, "i")), items).count() == 0


def test_matches_name_their_places(spark):
    index = deco.build_index(spark.createDataFrame([(1, "x one two three y one so two three")], DOCS), scratch(spark, "i"))
    row = deco.find_matches(index, spark.createDataFrame([("q", "one two three")], "item_id string, text string"), slop=1).collect()
    assert [(r["item"], r["exact"], r["near"]) for r in row] == [("q", [1], [1, 5])]


# ---- prefix trie


def plain_trie(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).digest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(ms) - 1) * words
    return sorted(
        (min(ms), len(p), min(members[p[:-1]]) if p else -1, len(ms), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in ms if len(rebuilt[c]) == len(p)))).encode()).hexdigest())
        for p, ms in members.items()
    )


def trie_rows(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash"))
    got = trie.prefix_trie(trie.turn_arrays(turns.repartition(3)), scratch(spark, "trie")).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


@pytest.mark.parametrize(("parts", "run"), [(1, 1 << 16), (5, 3), (23, 2)])
def test_trie_equals_plain(spark, monkeypatch, parts, run):
    monkeypatch.setattr(trie, "RUN_IDS", run)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rng = random.Random(parts)
        texts = ["hi there", "", None, "a b c", "so\nwhat"]
        rows = [(c, t, rng.choice(["user", None, "bot"]) if rng.random() < 0.2 else "user", rng.choice(texts)) for c in range(120) if c % 7 for t in range(rng.randint(1, 5))]
        # a third are alike, and so spread over partitions; a conversation with null and repeated turns; a null id
        rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(4)]
        rows += [(7, None, "user", "x"), (7, 1, "user", "y"), (7, 1, "user", "y"), (7, 1, "bot", "y"), (None, 0, "user", "lost"), (2000, 0, None, "w " * 5000)]
        rows += [(14, t, "user", f"deep {t}") for t in range(200)] + [(21, t, "user", f"deep {t}") for t in range(150)]
        assert trie_rows(spark, rows) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_no_rows_and_of_one(spark):
    assert trie_rows(spark, [(None, 0, "user", "x")]) == []
    # 5 turns into nothing: its base is absent and its own turns are fewer than the depth it branches at
    c = next(c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    assert trie_rows(spark, [(c, 0, "user", "x")]) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_long_runs_hash_as_one_text(spark):
    turns = spark.range(3000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    arrays = trie.turn_arrays(turns).select("conv_id", F.array(F.lit(b"k")).alias("path"), F.array(F.lit(2).cast("long")).alias("words"))
    got = trie.prefix_trie(arrays, scratch(spark, "trie")).filter("depth = 1").first()
    assert got["ends_sha256"] == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest() and got["saved_tokens"] == 2 * 2999


def test_stacks_are_one_row_a_partition():
    sweep = trie.Sweep(4)
    for c, p in ((3, [b"a"]), (9, [b"a"]), (1, [b"a", b"b"]), (2, [b"c"])):
        sweep.add(c, p, [1] * len(p))
    sweep.finish()
    kinds = Counter(r["kind"] for r in sweep.out)
    assert kinds[trie.STACKS] == 1 and kinds[trie.OPEN_PARENT] == 1 and kinds[trie.RUN] == 2
    assert [n[:4] for n in json.loads(next(r["said"] for r in sweep.out if r["kind"] == trie.STACKS))["nodes"]] == [[0, 1, 1, 3], [1, 1, 2, 1], [0, 0, 1, 4]]
