"""Vectors, URLs, pages and archives against brute force, and the pipeline."""

import io
import itertools
import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import embedding_dedup, html_wrappers, url_rules, warc
from foliospark.llm.common import stored

NAN = float("nan")


@pytest.mark.parametrize("chunk", [256, 8])
def test_near_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(120):
        centre = np.random.default_rng(i % 7).standard_normal(16)
        v = centre + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.2])
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, [2 * x for x in rows[0][1]], 0), (203, None, 0), (204, [], 0), (205, [0.0] * 16, 0), (206, [NAN] * 16, 0), (207, [1.0, None], 0), (208, rows[0][1], None), (209, rows[0][1][:8], 0), (None, rows[0][1], 0), (210, [float("inf")] * 16, 0)]
    good = {i: (np.array(v, np.float32).astype(float), g) for i, v, g in rows if i is not None and g is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i, _, _ in rows}
    for a, (x, g) in good.items():
        for b, (y, h) in good.items():
            if a != b and g == h and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a].add(b)
    label = {i: i for i in links}
    for _ in links:
        label = {i: min([label[i], *(label[j] for j in links[i])]) if i is not None else None for i in label}
    df = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, embedding array<float>, label int, bucket string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {i: (len(links[i]), label[i], i is None or label[i] == i) for i in links}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_tables_for_any_size():
    assert embedding_dedup.tables_for(0) == embedding_dedup.tables_for(2000) == (16, 36)
    for n in (10**5, 10**6, 10**9):
        projections, tables = embedding_dedup.tables_for(n)
        assert n * embedding_dedup.meeting(0.7) ** projections <= embedding_dedup.CROWD
        assert (1 - embedding_dedup.meeting(0.98) ** projections) ** tables <= embedding_dedup.MISS
    assert embedding_dedup.tables_for(10**6, 0.6)[0] == 16


def test_meeting_is_what_projections_do():
    rng = np.random.default_rng(5)
    for cosine in (0.98, 0.7):
        x = rng.standard_normal((400, 32))
        x /= np.sqrt((x * x).sum(1))[:, None]
        y = rng.standard_normal((400, 32))
        y -= (x * y).sum(1)[:, None] * x
        y = cosine * x + np.sqrt(1 - cosine**2) * y / np.sqrt((y * y).sum(1))[:, None]
        one = np.zeros(400, np.uint64)
        met = embedding_dedup.buckets(x, one, 1, 200) == embedding_dedup.buckets(y, one, 1, 200)
        assert abs(met.mean() - embedding_dedup.meeting(cosine)) < 0.01


def test_buckets_of_any_batch():
    x = np.random.default_rng(6).standard_normal((257, 48))
    x /= np.sqrt((x * x).sum(1))[:, None]
    labels = np.arange(257, dtype=np.uint64) % np.uint64(3)
    whole = embedding_dedup.buckets(x, labels, 18, 40)
    for some in ([5], [256, 0], range(100, 163)):
        assert (embedding_dedup.buckets(x[list(some)], labels[list(some)], 18, 40) == whole[list(some)]).all()


def test_links_with_more_projections(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CROWD", 0.01)  # as in a label some thousand times larger
    monkeypatch.setattr(embedding_dedup, "CELLS", 10_000)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((6, 24))
    x = (centre[np.arange(90) % 6] + rng.standard_normal((90, 24)) * rng.choice([0.05, 0.2], (90, 1))).astype(np.float32)
    assert embedding_dedup.tables_for(90)[0] > 16
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    u = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    assert got == dict(enumerate(((u @ u.T >= 0.98).sum(1) - 1).tolist()))


@pytest.mark.parametrize("kind,labels", [("long", [5, 5 + (1 << 32), -1, (1 << 32) - 1]), ("string", ["a", "A", "", "é"]), ("double", [0.5, 0.25, -1.0, 1e300])])
def test_labels_and_doubles(spark, kind, labels):
    """Labels are compared whole, in any type; vectors keep the precision and range of doubles."""
    a, b = [1e39, 2e39, -1e39], [1e-50, 2e-50, -1e-50]
    rows = [(i, a, g) for i, g in enumerate(labels)] + [(10 + i, b, g) for i, g in enumerate(labels)] + [(30, [1e200, 2e200, -1e200], labels[0]), (31, [1e-200, 2e-200, -1e-200], labels[0]), (32, [1.0, -2.0, 1.0], labels[0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    assert got[0] == got[10] == got[30] == got[31] == (3, 0) and got[32] == (0, 32)
    assert all(got[i] == got[10 + i] == (1, i) for i in range(1, len(labels)))


def test_many_dense_groups(spark):
    """Clusters of more vectors than FEW, whose members meet in most tables, against all pairs."""
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.standard_normal(24) + rng.standard_normal((90, 24)) * s for s in (0.005, 0.05, 0.12)]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), "g") for i, x in enumerate(v)], "vec_id long, embedding array<float>, label string").repartition(3)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    links = (u @ u.T >= 0.98) & ~np.eye(len(u), dtype=bool)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    assert got == {i: int(n) for i, n in enumerate(links.sum(1))}


URLS = [("https://a.example.org/es/1", "block", "example.org/es/"), ("https://EXAMPLE.org/en/12?x#y", "block", "example.org/en/1"), ("http://x.org", "allow", None), ("http://x.org/", "allow", "org/"), ("https://b.com/fr/", "allow", "com/fr/"), ("https://b.com/de/", "block", "com/de/"), ("https://notexample.org/es/", "allow", "org/"), ("nothing", "allow", None), (None, "allow", None), ("", "allow", None), ("a://b://c/d", "allow", None)]


def test_given_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "v") for i, (u, _, _) in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    none = spark.createDataFrame([], "key string, items array<string>, confidence double, freq long")
    got = {r.page_id: (r.verdict, r.rule) for r in url_rules.judge(df, none).collect()}
    assert got == {i: w for i, (_, *w) in enumerate(map(lambda x: (x[0], x[1], x[2]), URLS)) for w in [tuple(w)]}
    parts = {r.page_id: (r.host, r.path) for r in url_rules.judge(df, none).collect()}
    assert parts[1] == ("example.org", "/en/12") and parts[2] == ("x.org", "") and parts[7] == ("", "") and parts[10] == ("b:", "//c/d")


def test_mined_rules(spark):
    """Rules block what counting all subsets of tokens blocks, of any size and on any host suffix."""
    from itertools import combinations

    rng = random.Random(1)
    pages, labels = [], []
    for i in range(400):
        host, part = rng.choice(["www.good"] * 4 + ["a.spam", "b.spam", "x.mixed"]) + ".net", rng.choice(["win/big", "news"])
        flags = [x for x in "abc" if rng.random() < 0.7]
        pages.append((i, f"http://{host}/{part}/{i}" + ("?" + "&".join(flags) if flags else "")))
        bad = ".spam." in host or ".mixed." in host and part == "win/big" or ".good." in host and part == "news" and flags == ["a", "b", "c"]
        labels.append((i, 0 if bad and rng.random() < 0.95 else 1, 0))
    labels += [(None, 0, 1), (5000, None, None)]
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mined = stored(url_rules.mine(p, lab, support=0.02))
    got = {frozenset(r["items"]): (r.confidence, r.freq, r.key) for r in mined.collect()}
    assert frozenset(["host:spam.net", "host:net"]) in got
    assert frozenset(["host:x.mixed.net", "host:mixed.net", "host:net", "path:win", "path:big"]) not in got  # its shorter suffix implies it
    assert frozenset(["host:mixed.net", "host:net", "path:win", "path:big"]) in got
    assert frozenset(["host:good.net", "host:net", "path:news", "query:a", "query:b", "query:c"]) in got
    tokens = {r.page_id: set(r.t) for r in p.select("page_id", url_rules.tokens_of(p.url).alias("t")).collect()}
    bad = {i for i, q, t in labels if i is not None and (q == 0 or t == 1)}
    share = len(bad & set(tokens)) / len(tokens)
    sure = lambda n, m: m >= 8 and m / n >= max(0.6, 1.5 * share)
    for rule, (confidence, freq, key) in got.items():
        there = {i for i, t in tokens.items() if rule <= t}
        assert (freq, confidence) == (len(there), pytest.approx(len(there & bad) / len(there))) and sure(len(there), len(there & bad))
        assert len({i for i, t in tokens.items() if key in t}) == min(len({i for i, t in tokens.items() if x in t}) for x in rule)
        assert not any(got.get(rule - {x}, (0,))[0] >= confidence for x in rule)
    count, with_bad = {}, {}
    for i, t in tokens.items():
        for n in range(1, len(t) + 1):
            for c in map(frozenset, combinations(sorted(t), n)):
                count[c] = count.get(c, 0) + 1
                with_bad[c] = with_bad.get(c, 0) + (i in bad)
    want = {c for c, n in count.items() if sure(n, with_bad[c])}
    verdicts = {r.page_id: r.verdict for r in url_rules.judge(p, mined).collect()}
    assert verdicts == {i: "block" if any(c <= t for c in want) else "allow" for i, t in tokens.items()}
    assert url_rules.mine(p, lab.limit(0)).count() == 0
    assert url_rules.judge(p.limit(0), mined).count() == 0 and url_rules.mine(p.limit(0), lab).count() == 0
    assert url_rules.mine(p.where("page_id < 8"), lab).count() == 0  # fewer bad pages than LEAST


def test_long_and_repeated_urls(spark):
    long = "http://" + "a." * 3000 + "example.org/es/" + "x/" * 20_000 + "?" + "&".join(map(str, range(5000)))
    rows = [(1, long, 7), (1, long, 7), (2, "https://b.example.org/es/", 7), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, key int")
    mined = url_rules.mine(df, spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"), least=1)
    got = sorted(((r.page_id or 0, r.verdict, r.rule, len(r.path)) for r in url_rules.judge(df, mined).collect()))
    assert got == [(0, "allow", None, 0), (1, "block", "example.org/es/", 40_004), (1, "block", "example.org/es/", 40_004), (2, "block", "example.org/es/", 4)]



PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <p>no</p> --><div class="cookie notice">We use cookies</div><aside class="sidebar">side</aside>%s<section class="comments"><p>nice!</p></section><form><p>mail</p><input></form><footer>&copy; foot</footer></body></html>'
ARTICLES = [
    ("<article><h1>Head &amp; more</h1><p><b>One<br><p>two\n  three</p><ul><li>a<li>b</ul></article>", "Head & more\n\nOne\n\ntwo three\n\na\n\nb"),
    ("<article><h1>H</h1><p>1</p><p>2</p><div class=ad>buy</div><p>3 &lt;x&gt;", "H\n\n1\n\n2\n\n3 <x>"),
    ("<article></article>", ""),
]


def test_wrappers(spark):
    rows = [(i, f"http://{'a' if i % 2 else 'b'}.net/{i}", PAGE % ARTICLES[i % 3][0]) for i in range(12)]
    rows += [(20, None, PAGE % ARTICLES[0][0]), (21, "http://a.net/", None), (22, "http://a.net/", ""), (23, "http://c.net/", "plain <b>text</b> &amp"), (24, "http://d.net/", "<p>cut off <a hre")]
    df = spark.createDataFrame([r + ("t",) for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = {r.page_id: r for r in html_wrappers.extract(df, stored(html_wrappers.infer_wrappers(df))).collect()}
    # the second article is never closed, so what follows stands in it, but in places of its own
    for i in range(12):
        assert got[i].text == ARTICLES[i % 3][1] and got[i].n_chars == len(got[i].text)
    assert got[20].text == ARTICLES[0][1] and got[21].text == got[22].text == ""
    assert got[23].text == "plain text &" and got[24].text == "cut off"
    joined = html_wrappers.BROADCAST_BYTES
    try:
        html_wrappers.BROADCAST_BYTES = -1
        again = {r.page_id: r.text for r in html_wrappers.extract(df, stored(html_wrappers.infer_wrappers(df))).collect()}
    finally:
        html_wrappers.BROADCAST_BYTES = joined
    assert again == {i: r.text for i, r in got.items()}
    assert html_wrappers.extract(df.limit(0), stored(html_wrappers.infer_wrappers(df.limit(0)))).count() == 0


@pytest.mark.parametrize("slot,out", [("html/body/article/p", False), ("html/body.with.sidebar/article/p", False), ("html/body/div.layout.has.sidebar/article/p", False), ("html/body/div.related/article/p", True), ("html/body/div.sidebar/p", True), ("html/body/article/header/h1", False), ("html/body/header/h1", True), ("html/body/article/div.ad/p", True), ("html/body/section.comments/article.comment/p", True), ("html/body/aside/article/p", True)])
def test_boilerplate(slot, out):
    around = html_wrappers.Around()
    for element in slot.split("/"):
        around = around.entered(element.split(".")[0], element.split(".")[1:])
    assert around.boilerplate is out



def test_passages_of_short_words(spark, tmp_path):
    """A passage of over 50 words goes with fewer than 250 bytes too; one of 50 words stays."""
    import corpus_pipeline

    rng = random.Random(8)
    long, short = (" ".join(rng.choices("abcdefghijé", k=n)) for n in (51, 50))
    texts = [f"one\u00a0{long} two", f"three\t{long}", f"four {short} five", f"{short} six", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert [got[i] for i in range(4)] == ["one\u00a0 two", "three\t", texts[2], texts[3]]


def test_template_strings_of_an_article(spark):
    """Strings that different pages share at a slot go, in an article too; copies are no proof, and
    what moves between slots of an article (the last line, for page 4's list) stays."""
    page = "<html><body><article><h1>%s</h1><p>Read this on our site</p><p>%s</p>%s<p>Thanks for reading</p></article></body></html>"
    rows = [(i, f"http://a.net/{i}", page % (f"Head {i}", f"Body of page {i} " * 3, "<ul><li>x</li></ul>" if i == 4 else "")) for i in range(6)]
    rows += [(10 + i, f"http://b.net/{i}", page % ("Head", "One body ", "")) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_wrappers.extract(df, stored(html_wrappers.infer_wrappers(df))).collect()}
    for i in range(6):
        assert got[i] == "\n\n".join([f"Head {i}", " ".join([f"Body of page {i}"] * 3), *["x"] * (i == 4), "Thanks for reading"])
        assert got[10 + i] == "Head\n\nRead this on our site\n\nOne body\n\nThanks for reading"


def test_long_and_deep_pages(spark):
    """Time grows with the length of a page, not with its depth or its stray tags."""
    deep = "<html><body>" + "<div class=x>" * 30_000 + "<article><p>in the middle</p></article>" + "</div>" * 30_000
    stray = "<body>" + "<span>" * 20_000 + "</b>" * 20_000 + "<article><p>after all</p></article>"
    long = "<body><article>" + "".join(f"<p>block {i} has words</p><hr>" for i in range(20_000)) + "</article></body>"
    rows = [(1, "http://a/1", deep), (2, "http://a/2", stray), (3, "http://b/3", long), (3, "http://b/3", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    began = time.time()
    got = sorted((r.page_id, r.text) for r in html_wrappers.extract(df, stored(html_wrappers.infer_wrappers(df))).collect())
    assert got[:2] == [(1, "in the middle"), (2, "after all")] and got[2] == got[3]
    assert got[2][1].count("\n\n") == 19_999 and time.time() - began < 60


def test_more_tokens_than_characters(spark):
    """A page of very many different tokens."""
    page = "<body><article>" + "".join(f"<div class={'abcdefghij'[i % 10]}{''.join('klmnopqrst'[int(d)] for d in str(i))}>x</div>" for i in range(140_000)) + "</article></body>"
    df = spark.createDataFrame([(1, "http://a/1", page)], "page_id long, url string, html string")
    began = time.time()
    (got,) = html_wrappers.extract(df, stored(html_wrappers.infer_wrappers(df))).collect()
    assert got.text.count("x") == 140_000 and time.time() - began < 90


def test_heading_of_an_article_stays(spark):
    """Two of a host's three pages share their article's heading, which the third has in an advert."""
    page = lambda head, ad, body: f"<body><nav>menu</nav><article><h1>{head}</h1><p>{body}</p></article><div class=promo><p>{ad}</p></div><div><p>tail</p></div></body>"
    rows = [(1, page("Same head", "Buy", "first")), (2, page("Same head", "Buy this", "second")), (3, page("Own head", "Same head", "third"))]
    df = spark.createDataFrame([(i, "http://a/" + str(i), p) for i, p in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrappers.extract(df, stored(html_wrappers.infer_wrappers(df))).collect()}
    assert got == {1: "Same head\n\nfirst", 2: "Same head\n\nsecond", 3: "Own head\n\nthird"}


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("letters", [0, 120_000])
def test_fold_against_patterns(monkeypatch, letters, seed):
    """Folding by numbers as by regular expressions over characters."""
    monkeypatch.setattr(html_wrappers, "LETTERS", letters)
    rng = random.Random(seed)
    shape = [rng.choice("abc") for _ in range(rng.randrange(200))] + list("abcabcabab") * 3
    names, nodes = {}, {}

    def char(node):
        c = names.setdefault(json.dumps(node), chr(0x4E00 + len(names)))
        nodes[c] = node
        return c

    text = "".join(map(char, shape))
    for width in range(1, 9):
        text = re.sub(rf"(.{{{width}}})\1+", lambda m: char(["+", [nodes[c] for c in m[1]]]), text)
        text = re.sub(r"(.)\1+", r"\1", text)
    assert html_wrappers.fold(shape) == [nodes[c] for c in text]


def expansions(wrapper, most=2):
    """All shapes of a small wrapper with at most `most` repeats, each as [(token, its leaf)]."""
    out = [[]]
    for i, n in enumerate(wrapper):
        if isinstance(n, str):
            mine = [[(n, (i,))]]
        else:
            inner = [[(t, (i, *at)) for t, at in e] for e in expansions(n[1], most)]
            mine = [[], *inner] if n[0] == "?" else [sum(c, []) for r in range(1, most + 1) for c in itertools.product(inner, repeat=r)]
        out = [a + b for a in out for b in mine]
    return out


@pytest.mark.parametrize("seed", range(12))
def test_places_against_all_expansions(seed):
    """A shape matches if and only if it is an expansion, and its texts stand where one puts them."""
    rng = random.Random(seed)

    def wrapper(depth):
        return [rng.choice(["#", "<p>", "</p>", "<b>"]) if depth == 0 or rng.random() < 0.6 else [rng.choice("?+"), wrapper(depth - 1)] for _ in range(rng.randint(1, 3))]

    w = wrapper(2)
    m = html_wrappers.Matcher(w)
    known = {}
    for e in expansions(w):
        known.setdefault(tuple(t for t, _ in e), []).append([at for t, at in e if t == "#"])
    state = {}
    for shape, parses in known.items():
        places = m.places(list(shape))
        assert places is not None and len(places) == len(parses[0])
        assert any(all(state.setdefault(p, at) == at for p, at in zip(places, parse)) for parse in parses) or len(parses) > 1
    longest = max(map(len, known))
    for _ in range(200):
        shape = tuple(rng.choices(["#", "<p>", "</p>", "<b>"], k=rng.randint(0, min(4, longest))))
        if shape not in known and len(shape) <= 2:
            assert m.places(list(shape)) is None


@pytest.mark.parametrize("fan", [2, 64])
def test_shapes_of_a_large_host(spark, monkeypatch, fan):
    """Merged as a tree, a wrapper still matches every page of its host."""
    monkeypatch.setattr(html_wrappers, "FAN", fan)
    rng = random.Random(4)
    pages = ["<html><body><article>" + "".join(rng.choice(["<p>a</p>", "<ul><li>x</li><li>y</li></ul>", "<h2>t</h2>", "<p>b<br>c</p><hr>"]) for _ in range(rng.randint(0, 5))) + "</article></body></html>" for _ in range(60)]
    df = spark.createDataFrame([(f"http://h/{i}", p) for i, p in enumerate(pages)], "url string, html string").repartition(3)
    (row,) = html_wrappers.infer_wrappers(df).select("host", "wrapper").collect()
    m = html_wrappers.Matcher(json.loads(row.wrapper))
    for p in pages:
        r = html_wrappers.Reader(p)
        assert len(m.places(r.shape)) == len(r.blocks)


def test_wrappers_match_their_pages():
    rng = random.Random(5)
    tokens = ["<p>", "#", "</p>", "<b>", "</b>", "<br>"]
    for _ in range(200):
        shapes = [[rng.choice(tokens[: rng.randint(2, 6)]) for _ in range(rng.randint(0, 12))] for _ in range(4)]
        wrapper = html_wrappers.fold(shapes[0])
        for s in shapes[1:]:
            wrapper = html_wrappers.align(wrapper, html_wrappers.fold(s))
        m = html_wrappers.Matcher(wrapper)
        for s in shapes:
            places = m.places(s)
            assert places is not None and len(places) == s.count("#") and all(m.token[k] == "#" for k in places)


def test_alignment():
    fold, align = html_wrappers.fold, html_wrappers.align
    li = ["<li>", "#", "</li>"]
    assert fold(["<ul>", *li, *li, *li, "</ul>"]) == ["<ul>", ["+", li], "</ul>"]
    assert align(fold(["<ul>", *li, *li, "</ul>"]), ["<ul>", *li, "</ul>"]) == ["<ul>", ["+", li], "</ul>"]
    assert align(["<p>", "#", "</p>"], ["<p>", "<b>", "#", "</b>", "</p>"]) == ["<p>", ["?", ["<b>"]], "#", ["?", ["</b>"]], "</p>"]


def pages(n):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        html = rng.choice([None, "", "short", "x" * 99, "y" * 100, "z" * 3000, "é" * 60, "".join(rng.choices("abc<>&\r\n", k=500))])
        rows.append((i if i % 11 else None, rng.choice([None, "http://h/ä b", "u\r\nv%"]), html))
    return rows


def test_warc_round_trip(spark, tmp_path):
    rows = pages(120)
    df = spark.createDataFrame([r + ("response",) for r in rows], "page_id long, url string, html string, record_type string").repartition(4)
    archives = stored(warc.write_warc(df, f"file://{tmp_path}/w", archive_bytes=4000))
    assert archives.count() > 4
    import hashlib

    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        ref = first.get(h) if first.get(h) != i else None
        want.append((i, u, len(data), hashlib.sha256(data).hexdigest(), "response" if ref is None else "revisit", ref, data if ref is None else None))
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_warc(archives).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_warc(stored(warc.write_warc(df.limit(0), f"file://{tmp_path}/none"))).count() == 0


def test_warc_reader_refuses_broken_archives():
    data = warc.record_bytes(1, "u", b"payload", "0" * 64, "response", None)
    assert [b for _, b in warc.read_records(io.BytesIO(data * 3))] == [b"payload"] * 3
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-5])))


def test_pipeline(spark, docs, corpus, tmp_path):
    """Each stage on what the one before it kept, held against the operators' brute force."""
    import corpus_pipeline
    from test_text_operators import contaminated, links, removed

    bench = spark.createDataFrame([(1, " ".join((corpus[11][1] or "").split()[:40]))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicate", "repeated_passages", "decontaminated", "packed"]
    now = docs
    kept = stored(stages["language"](spark, now, str(tmp_path)))
    assert kept.columns == docs.columns
    assert not {0, 1, 2, 3} & {r.doc_id for r in kept.collect()}
    # the row without an id stands behind the others
    texts = {10_000 if r.doc_id is None else r.doc_id: r.text for r in kept.collect()}
    _, label = links(texts)
    one = stored(stages["near_duplicate"](spark, kept, str(tmp_path)))
    assert sorted(10_000 if r.doc_id is None else r.doc_id for r in one.collect()) == sorted(i for i in texts if label[i] == i)
    rows = one.collect()
    short = [r for r in rows if len(r.text) < 6000]
    some = spark.createDataFrame(short, one.schema)
    clean = stored(stages["repeated_passages"](spark, some, str(tmp_path)))
    want = {r.doc_id: w for r, w in zip(short, removed([r.text for r in short], corpus_pipeline.PASSAGE_BYTES))}
    assert {r.doc_id: len(r.text.encode()) for r in clean.collect()} == {i: w[0] - w[1] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    good = stored(stages["decontaminated"](spark, one, str(tmp_path)))
    bad = contaminated([(r.doc_id, r.text) for r in rows], [(1, bench.first().text)])
    assert sorted(str(r.doc_id) for r in good.collect()) == sorted(str(r.doc_id) for i, r in enumerate(rows) if not bad[i][4])
    out = stages["packed"](spark, good, str(tmp_path)).toPandas()
    assert set(out.doc_id) == {r.doc_id for r in good.collect()} and out.groupby("sequence_id").length.sum().max() <= 2048


CLASHING = {"key": "key", "id": "7", "node": "n", "lang_pred": "x", "__text": "t", "piece": "p", "rep": "r", "group": "g", "rejected": "no"}


def test_run_on_odd_rows(spark, docs, corpus, tmp_path):
    """The whole pipeline over nulls, empty and long texts, repeated rows and columns of any name."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    import public_tokenizers
    from foliospark.llm import packing

    odd = docs.union(docs.where("doc_id = 11")).union(docs.where("doc_id = 17"))
    for name, value in CLASHING.items():
        odd = odd.withColumn(name, F.lit(value))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no document has these words " * 4), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, str(tmp_path)))
        assert now.columns == odd.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = sorted(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in now.collect())
    ids = got.assign(doc=got.doc_id.fillna(-1))
    assert sorted(ids.groupby("doc").length.sum()) == want  # one row of each id is left
    assert set(ids.doc) == {-1 if r.doc_id is None else r.doc_id for r in now.collect()} and not {0, 1, 2, 3} & set(ids.doc)
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_run_on_empty_tables(spark, no_docs, tmp_path):
    import corpus_pipeline

    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, no_docs, str(tmp_path))
        assert got.count() == 0 and (name == "packed" or got.columns == no_docs.columns)


def test_odd_archives(spark, tmp_path):
    """A payload of many megabytes, and none at all."""
    long = "<p>" + "".join(random.Random(1).choices("abcdefgh <>", k=3_000_000)) + "é" * 1_000_000
    rows = [(1, "http://a/", long), (2, None, long), (3, "http://a/", None), (4, "http://a/", ""), (4, "http://a/", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = stored(warc.write_warc(df, f"file://{tmp_path}/w", archive_bytes=1000))
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(archives).collect())
    n = len(long.encode())
    assert got == [(1, n, "response", None), (2, n, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None), (4, 0, "response", None)]
