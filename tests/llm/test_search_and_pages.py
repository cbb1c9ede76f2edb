import random

import numpy as np
import pytest

from dialogmeter.llm import html_sst, topk


def brute(rows, every, k):
    fine = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for _, v in fine]
    out = []
    for q, (qid, _) in enumerate(fine):
        if qid is None or qid % every:
            continue
        scores = []
        for c, (cid, _) in enumerate(fine):
            if c != q:
                s = sum(a * b for a, b in zip(whole[q], whole[c], strict=False))
                scores.append((-s, cid is None, cid or 0, cid))
        scores.sort(key=lambda s: s[:3])
        out += [(qid, r, s[3], -s[0]) for r, s in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bins", [2048, 16])
def test_top_k_equals_all_scores(spark, monkeypatch, bins):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "BINS", bins)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # many ties
    rows += [(40, rows[5][1]), (7, None), (8, [1.0, None]), (9, [float("nan")] * 8), (11, [float("inf")] * 8), (12, []), (13, [0.5] * 3), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as row", "2 as v")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, every=20, k=20).collect()]
    assert sorted(got, key=str) == brute(rows, 20, 20)


def test_few_candidates_huge_values_and_empty_tables(spark):
    rows = [(0, [1e30, -1.0]), (20, [2e30, 3.0]), (21, [0.25, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 20), (0, 2, 21), (20, 1, 0), (20, 2, 21)]
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 0")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home {i}</a></li></ul></nav><div class="ad">Buy {i}</div><div id="cookie-notice">We use</div>
<article><header><h1>Title {i}</h1></header><p><b>First&nbsp;  line<br>second</b> part &amp; more &lt;{i}&gt;<p>Next<i>word</i> &#x41;
<aside>Also read</aside><form>Name <input></form><section class="comments"><p>Nice!</p></section></article>
<aside>Side</aside><footer>&copy; {i}</footer></body></html>"""


def test_article_of_marked_pages(spark):
    rows = [(i, f"http://h{i % 2}.example/x", PAGE.format(i=i)) for i in range(30)]
    rows += [(100, None, None), (101, "odd url", ""), (102, "http://h0.example", "plain &amp; text\n\nmore"), (103, None, "<p>unclosed <b>bold"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host")
    got = html_sst.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in range(30):
        want = f"Title {i} First line second part & more <{i}> Nextword A"
        assert by[i].text == want and by[i].n_chars == len(want)
    assert (by[100].text, by[101].text, by[102].text, by[103].text) == ("", "", "plain & text more", "unclosed bold")
    assert html_sst.main_text(df.limit(0)).count() == 0


def test_repeated_branches_of_a_host_are_removed(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    rows, want = [], {}
    for i in range(40):
        body = " ".join(word() for _ in range(20))
        rows.append((i, "https://one.example/a", f"<body><div class=top><p>Welcome to us</p></div><div class=text><p>{body}</p></div><div class=end><p>Call now</p></div></body>"))
        want[i] = body
    rows.append((99, "https://two.example/", "<body><div class=top><p>Welcome to us</p></div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_sst.main_text(df).collect()}
    assert all(got[i] == want[i] for i in want) and got[99] == "Welcome to us"


def test_copied_articles_stay(spark):
    rows = [(i, "http://h.example/", "<article><p>The same article</p></article><footer>f</footer>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html_sst.main_text(df).collect()} == {"The same article"}


def test_branches_in_and_beside_articles_are_judged(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        teaser, body = words(8), words(30)
        rows.append((i, "https://one.example/a", f"<body><div class=top><p>Welcome to us</p></div><article><p>{teaser}</p><div class=tail><p>Like us</p></div></article><div class=text><p>{body}</p></div></body>"))
        want[i] = f"{teaser} {body}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_sst.main_text(df).collect()} == want
