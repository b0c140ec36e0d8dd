import numpy as np
import pyarrow as pa

from reelgraph.llm import ann, htmltext
from reelgraph.llm.common import stored, table

from ..conftest import DATA


def brute(rows, every, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % every == 0:
            near = {}
            for j, v in rows:
                if j != i:
                    near[j] = min(near.get(j, np.inf), float(np.sqrt(((v - q) ** 2).sum())))
            out[i] = sorted((d, j) for j, d in near.items())[:k]
    return out


def test_small_tables_are_exact(spark):
    bad = [(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf"), 1.0]), (None, [1.0, 1.0]), (105, [1.0, 2.0, 3.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (10, [1.0, 0.5]), (4, [5.0, 5.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<float>, list int, bin int")
    got = {}
    for r in sorted(ann.nearest(df, every=10, k=10).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got == brute(good, 10, 10)
    assert ann.nearest(df.limit(0)).count() == 0


def test_recall_with_a_hot_vector(spark):
    random = np.random.default_rng(4)
    vectors = random.normal(size=(3000, 16)).astype(np.float32)
    vectors[1000:2000] = vectors[7]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], set()).add((round(r["score"], 9), r["vec_id"]))
    want = brute(rows, 100, 10)
    hits = [len(got[q] & {(round(d, 9), j) for d, j in near}) / 10 for q, near in want.items()]
    assert set(got) == set(want) and np.mean(hits) >= 0.9


def test_few_lists_hold_the_nearest(spark, monkeypatch):
    """50,000 vectors without structure: each goes to several lists, and a tenth of the entries holds nine in ten."""
    tables = []
    monkeypatch.setattr(ann, "stored", lambda df: tables.append(stored(df)) or tables[-1])
    x = np.random.default_rng(6).normal(size=(50_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = {}
    for r in ann.nearest(df, every=500).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for q in range(0, len(x), 500):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits.append(len(got[q] & set(np.argpartition(d, 10)[:10].tolist())) / 10)
    postings, probes = (next(t for t in tables if c in t.columns and "bin" in t.columns) for c in ("list", "lists"))
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}
    copies, read = sum(sizes.values()) / len(x), sum(sizes.get(c, 0) for r in probes.collect() for c in r["lists"]) / sum(sizes.values()) / len(hits)
    print(f"recall {np.mean(hits):.3f}, share of entries read {read:.3f}, lists a vector {copies:.2f}, lists {len(sizes)}")
    assert np.mean(hits) >= 0.9 and read < 0.1 and copies > 1.2


def test_all_lists_are_exact(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(6).normal(size=(3000, 16)))]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), reach=np.inf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got == {q: {j for _, j in near} for q, near in brute(rows, 100, 10).items()}


def test_centroids_are_balanced():
    random = np.random.default_rng(8)
    sample = np.concatenate([random.normal(size=(9000, 8)) * 0.01, random.normal(size=(1000, 8)) * 5])
    own = ann.distances(sample, ann.fit(sample, 100)).argmin(axis=1)
    assert np.bincount(own).max() < 5 * len(sample) / 100


def test_centroid_graph_finds_the_nearest():
    random = np.random.default_rng(5)
    centroids = random.normal(size=(400, 8))
    ids, dist = ann.Graph.of(centroids).search(centroids[:50] + 0.01, 8)
    assert (ids[:, 0] == np.arange(50)).mean() > 0.95 and (np.diff(dist, axis=1) >= 0).all()


def text(source, template=()):
    return htmltext.Page(source).text(set(template))


def test_page_text():
    assert text(None) == text("") == text("<nav>m</nav>") == ""
    assert text("<p>a &amp; <b>b</b>c</p><p>d<br>e&nbsp;f") == "a & bc d e f"
    assert text("<article><h1>T</h1><p>x<p>y</article><footer>f</footer>") == "T x y"
    assert text('<body><div class="ad">a</div><header>h</header><form>f</form><aside>s</aside><div id="comments">c</div><script>var t="</p>";</script><style>p{}</style><p>main</body>') == "main"
    assert text("a < b <c") == "a < b <c" and text("<p>5 &lt; 6 &#233;") == "5 < 6 é"
    assert text("<p>x" * 3000) == " ".join(["x"] * 3000)
    assert text('<p>q</p><div title="a>b">r</div>') == "q r"


def test_raw_and_named_elements():
    assert text('<p>a<script src="a.js"/>var x = "<p>code";</script>b<svg/>c</p>') == "abc"
    assert text('<article class="post has-sidebar"><h2 id="comments">Comments on law</h2><section id="social-history"><p>x</p></section><div id="comments"><p>reader</p></div></article>') == "Comments on law x"
    for name in ("user-comments", "commentlist", "comment-section", "social-share", "subscribe-box", "related-posts"):
        assert text(f'<article><p>x</p><div class="block {name}"><p>reader</p></div><section id="{name}"><b>y</b></section><div class="{name}ish">z</div></article>') == "x z"
    assert text("<div></p>a</div></article>b<a <b") == "a b<a <b"
    assert text('<article><p class="ad">a</p><ul><li id="sidebar">b<li>c</ul><p>d') == "c d"


def test_time_is_linear_in_nesting():
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        source = "".join(f"<div><p><b>t{k % 7}" for k in range(n))
        assert text(source).count("t") == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]


def test_template_of_a_site(spark):
    page = lambda i: f"<body><div><span>Our site</span></div><div>Text of page {i}.</div><div>Imprint</div></body>"
    rows = [(i, f"http://a.example/{i}", page(i), 1, 2) for i in range(6)] + [(9, "http://b.example/", page(9), 1, 2), (10, None, None, 1, 2), (None, "http://a.example/x", "", 1, 2), (0, "http://a.example/0", page(0), 1, 2)]
    rows += [(20 + i, f"no host {i}", page(i), 1, 2) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, site int, h int")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()}
    want = {(i, f"Text of page {i}.", 15) for i in range(6)} | {(9, "Our site Text of page 9. Imprint", 32), (10, "", 0), (None, "", 0)} | {(20 + i, f"Our site Text of page {i}. Imprint", 32) for i in range(6)}
    assert got == want and htmltext.extract(df).count() == len(rows)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_template_inside_articles(spark):
    """Boilerplate that no tag or class tells, in and outside of articles; copies of one article are no template."""
    page = lambda i: f"<div>Top of site</div><article><h1>Title {i}</h1><div>Tell <b>your</b> friends</div><p>Same opening.</p><p>Body {i}.</p><div>Own block {i // 2}</div></article><div>Bottom</div>"
    bare = lambda i: f"<div>Top of site</div><div>Body {i} without an article.</div><div>Bottom</div>"
    rows = [(i, f"http://A.example/{i}", page(i)) for i in range(10)] + [(100 + i, f"http://a.example/b{i}", bare(i)) for i in range(4)] + [(200 + i, f"http://a.example/c?{i}", page(77)) for i in range(9)]
    rows += [(300 + i, f"http://b.example/{i}", f"<article><div>Said {i % 9} times</div><p>Body {i}.</p></article>") for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()}
    assert all(got[i] == f"Title {i} Same opening. Body {i}. Own block {i // 2}" for i in range(10))
    assert all(got[100 + i] == f"Body {i} without an article." for i in range(4))
    assert all(got[200 + i] == "Title 77 Same opening. Body 77. Own block 38" for i in range(9))
    # Eleven or twelve of a hundred pages are a tenth or more.
    assert all(got[300 + i] == f"Body {i}." for i in range(100))
    assert htmltext.extract(df, share=0.2).where("page_id >= 300 AND text LIKE 'Said%'").count() == 100


def test_copies_of_an_article_keep_it(spark):
    rows = [(i, "http://a.example/", "<nav>m</nav><article><p>Same text.</p></article>") for i in range(8)] + [(20 + i, f"http://a.example/{i}", "<div>Same body.</div>") for i in range(8)]
    got = [r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == ["Same body."] * 8 + ["Same text."] * 8


def test_synthetic_pages(spark):
    import html
    import re

    for p, r in zip(*(x.orderBy("page_id").collect() for x in (table(spark, DATA, "pages"), htmltext.extract(table(spark, DATA, "pages")))), strict=True):
        inside = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?(b|i|a|em|strong|span)\b[^>]*>", "", inside))).split())
