import base64
import hashlib
import heapq
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillshift.llm import warc
from quillshift.llm.html_extract import Rules, blocks, classify, extract_pages, main_text
from quillshift.llm.topk_search import LEVELS, block_topk, exact_topk, segment_cuts, segment_stats

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar">
<nav><ul><li><a href=/x>Home</a></li></ul></nav><header>Site</header><!-- <p>gone</p> --><div class="ad">Buy   now</div>
<article><h1>Title</h1><p>One &lt;b&gt;  two&nbsp;<b>three<br>four</p><p>short<p class="cookie-notice">We use cookies</p><form><p>mail</p></form>
<ul><li>item</li></ul><div id="comments"><p>first!</p></div></article><aside>more</aside><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Title One <b> two three four short item"
    assert main_text(None) == main_text("") == "" and main_text("<p") == "" and main_text("<script>x") == ""
    assert main_text("<article>a &am b &amp</article>") == "a &am b &"


def test_rules_find_the_article_without_its_tags(spark):
    """All pages, with every container a plain div: the rules alone keep most of the article and little else."""
    shares = []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        plain = re.sub(r"<(/?)(article|nav|footer|header|main|aside)\b[^>]*>", r"<\1div>", r["html"]).replace('<div class="ad">', "<div>")
        want, got = main_text(r["html"]).split(), main_text(plain).split()
        both = sum((Counter(want) & Counter(got)).values())
        shares.append((both / max(1, len(got)), both / max(1, len(want))))
    precision, recall = (sum(x) / len(shares) for x in zip(*shares, strict=True))
    assert precision > 0.95 and recall > 0.9


PROSE = "The river was high in the spring of that year, and it was not until the end of May that the farmers of the valley could go back to their fields. "


@pytest.mark.parametrize(("inside", "want"), [
    ('<p class="share-price">The share price rose by a tenth in the week.</p>', "The share price rose by a tenth in the week."),
    ('<section class="alert-levels"><p>There are four levels of alert, and they are set by the state.</p></section>', "There are four levels of alert, and they are set by the state."),
    ('<p><a href="/x">The report of the committee in full</a></p>', "The report of the committee in full"),
    ('<div class="share-buttons"><a href=a>Mail</a> <a href=b>Print</a></div>', ""),
    ('<div class="share">Tell the others of it on all of the networks.</div>', ""),
    ('<ul><li><a href=a>One more of the same</a></li><li><a href=b>And this is another</a></li></ul>', ""),
    ('<div class="comment-list"><p>I was there and it is not at all as you say it was.</p></div>', ""),
    ('<div class="ad-slot"><p>This is the best of all the offers that there are in the shop.</p></div>', ""),
    ("<h2>Flood</h2>", "Flood"), ("<p>Kwx zzyk qqrt vvnm.</p>", "Kwx zzyk qqrt vvnm."), ("<p>12.5</p>", "12.5"),
])
def test_the_rules_decide_inside_an_article(inside, want):
    page = f"<html><body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>{PROSE}</p>{inside}<p>{PROSE}</p></article><footer>&copy; of us</footer></body></html>"
    assert main_text(page) == " ".join(x for x in ["Title of it", PROSE.strip(), want, PROSE.strip()] if x)


def test_whole_pages_against_hand_made_truth():
    """Title and paragraphs of an article with notices, forms, comments and adverts about and in it."""
    page = f"""<!doctype html><body class="no-sidebar"><div id="cookie-notice">We use the cookies of all of our partners.</div><header><h1>The Paper</h1></header>
    <main><div class="banner">Buy the new one.</div><article class="post with-sidebar"><h1>Flood &amp; field</h1><p>{PROSE}<p>Short one.<p class="pull-quote">It was not to be.</p>
    <aside>See also the rest.</aside><div class="newsletter-signup"><p>Get all of the news in your mail.</p><form><input name=q> Search</form></div><table><tr><td>1901</td><td>2.5 m</td></tr></table>
    <p>{PROSE}</p><section id="comments"><p>{PROSE}</p></section></article><div class="related"><p>{PROSE}</p></div></main><footer>&copy; {PROSE}</footer></body>"""
    assert main_text(page) == f"Flood & field {PROSE}Short one. It was not to be. 1901 2.5 m {PROSE}".strip()


def test_rules_decide_most_blocks(spark):
    """On the given pages no block of an article is good but for its words or its neighbours."""
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    live = [b for h in rows for b in blocks(h) if not b.boiler and b.depth_article]
    dense = sum(len(b.text) >= Rules().short and b.stop_density >= Rules().stop_low for b in live)
    assert 0.1 * len(live) < dense < len(live)


def test_pages_without_an_article_go_by_the_rules():
    good = "the cat and the dog are in the house and it was for the best that they have come to this " * 4
    html = f"<div><a href=x>one link here</a></div><p>{good}</p><p>near it</p><p>{good}</p><div><a>a</a> <a>b</a></div>"
    assert main_text(html) == " ".join([good.strip(), "near it", good.strip()])
    labels = [b.label for b in classify(blocks(html), Rules())]
    assert labels == ["bad", "good", "good", "good", "bad"]


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y"), (None, "u", "<main>" + "a b " * 50_000 + "</main>", "z")], "page_id long, url string, html string, text string")
    got = extract_pages(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, len(main_text(PAGE)), 199_999] and extract_pages(df.limit(0)).count() == 0


def read_back(spark, tmp_path, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    path = str(tmp_path / "warc")
    warc.write_warc(df, path, **options)
    return warc.merge_index(warc.read_warc(spark, path)).collect()


def test_warc_round_trip(spark, tmp_path):
    odd = "a\r\n\r\nWARC/1.1\r\nünï"
    rows = [(5, "http://b.com/x", odd, "f"), (3, "http://a.com/?b&a", odd, "f"), (4, None, None, "f"), (9, "http://a.com/\r\nX: y", "", "f"), (7, "http://www.a.com", "z" * 300_000, "f"), (7, "http://www.a.com", "z" * 300_000, "f"), (None, "u", odd, "f")]
    got = read_back(spark, tmp_path, rows, records_per_file=2)
    assert len(got) == 7
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert by[3][0]["record_type"] == "response" and (by[5][0]["record_type"], by[5][0]["refers_to"]) == ("revisit", 3) == (by[None][0]["record_type"], by[None][0]["refers_to"])
    assert by[4][0]["record_type"] == "response" and by[9][0]["refers_to"] == 4
    assert sorted(r["record_type"] for r in by[7]) == ["response", "revisit"]
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        for r in by[page]:
            assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    keys = [(r["url_key"], r["captured_at"]) for r in got]
    assert keys == sorted(keys)


def test_revisits_name_a_record_that_is_there(spark, tmp_path):
    rows = [(1, "u", "same", "f"), (2, "v", "same", "f"), (2, "v", "same", "f"), (3, "w", "same", "f"), (3, "w", "other\r\n\r\nWARC/1.1", "f"), (None, None, "same", "f")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    warc.write_warc(df, str(tmp_path / "w"))
    heads = [dict(x.split(": ", 1) for x in r.split("\r\n") if ": " in x) for f in (tmp_path / "w").glob("*.txt") for r in f.read_bytes().decode().split("WARC/1.1\r\n")[1:]]
    named = {h["WARC-Record-ID"]: h["WARC-Type"] for h in heads if "WARC-Record-ID" in h}
    assert len(named) == len(rows)
    refers = [h["WARC-Refers-To"] for h in heads if h.get("WARC-Type") == "revisit"]
    assert len(refers) == 4 and {named[x] for x in refers} == {"response"}
    assert all(h["Content-Type"].startswith(("application/http", "text/html")) for h in heads if "Content-Type" in h)


def test_small_payloads_are_responses(spark, tmp_path):
    got = read_back(spark, tmp_path, [(1, "u", "ab", "f"), (2, "u", "ab", "f")], min_revisit_bytes=3)
    assert {r["record_type"] for r in got} == {"response"}


def test_no_pages(spark, tmp_path):
    assert read_back(spark, tmp_path, []) == []


@pytest.mark.parametrize(("url", "key"), [("http://www.A.com:80/B?z=1&a=2#f", "com,a)/b?a=2&z=1"), ("https://a.b.c", "c,b,a)/"), (None, ""), ("x", "x)/"), ("http://a:8080/", "a:8080)/")])
def test_url_key(url, key):
    assert warc.url_key(url) == key


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == list(heapq.merge(*runs))


def brute_topk(vectors, k):
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors.items()}
    out = set()
    for q in [i for i in whole if i % 20 == 0]:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = {i: (rng.normal(size=24) * (1 + i % 5)).tolist() for i in range(300)} | {i: [0.5] * 24 for i in range(300, 330)}
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors.items()] + [(1000, None, 1), (1020, [1.0, None], 1), (1040, [float("nan")], 1), (1060, [float("inf")], 1), (None, [1.0], 1)], "vec_id long, embedding array<double>, rank int")
    got = exact_topk(df, df.filter("vec_id % 20 = 0"), k=7, query_block=5, candidate_block=40)
    assert {tuple(r) for r in got.collect()} == brute_topk(vectors, 7)
    few = df.filter("vec_id < 3")
    assert exact_topk(few, few.filter("vec_id % 20 = 0")).count() == 2
    assert exact_topk(df.limit(0), df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 30)), rng.normal(size=(50, 30))
    tight = []
    for share in LEVELS:
        cuts = segment_cuts(30, share)
        assert cuts[0] == 0 and cuts[-1] == 30 and cuts == sorted(set(cuts))
        bound = segment_stats(a, cuts) @ segment_stats(b, cuts).T
        assert (bound >= a @ b.T - 1e-9).all()
        tight.append(float((bound - a @ b.T).mean()))
    assert tight == sorted(tight, reverse=True)
    big = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**20, 2.0]])
    zero = np.zeros(1, dtype=np.int64)
    _, ids, scores = block_topk(zero, zero, big[0], np.array([1, 2]), np.array([1, 2]), big[1], 2)
    assert scores.tolist() == [2**60 + 3, 2**60 + 2] and ids.tolist() == [1, 2]


def share_of_exact_pairs(x, start=None):
    ids, seen = np.arange(len(x)), {}
    q = ids % 20 == 0
    r, i, s = block_topk(ids[q], ids[q], x[q], ids, ids, x, 20, start, seen=seen)
    full = x[q] @ x.T
    full[np.arange(q.sum()), np.flatnonzero(q)] = -np.inf
    best = np.sort(full, axis=1)[:, ::-1][:, :20]
    assert all(sorted(s[r == n].tolist(), reverse=True) == best[n].astype(int).tolist() for n in range(int(q.sum())))
    return seen["exact"] / seen["pairs"], best[:, -1]


def test_bounds_prune():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 64)) * 3
    clustered = np.floor(64 * (centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 64))))
    assert share_of_exact_pairs(clustered)[0] < 0.25
    # with the bar that another block set, nearly none is left
    assert share_of_exact_pairs(clustered, share_of_exact_pairs(clustered)[1])[0] < 0.1
    # vectors without any structure are the worst case
    assert share_of_exact_pairs(np.floor(64 * rng.normal(size=(4000, 64))))[0] < 0.5


def test_repeated_vectors_count_once(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert exact_topk(df, df.filter(F.col("vec_id") == 0)).count() == 1
    other = df.unionByName(spark.createDataFrame([(0, [3.0])], "vec_id long, embedding array<double>"))
    got = [tuple(r) for r in exact_topk(other, other.filter(F.col("vec_id") == 0)).collect()]
    # either vector of id 0 is a candidate of the other
    assert sorted(got) == sorted([(0, 1, 0, 64 * 192), (0, 2, 1, 64 * 128), (0, 1, 1, 192 * 128), (0, 2, 0, 192 * 64)])
