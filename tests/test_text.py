"""Text functions against loops and literal cases."""

import html
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.functions import json_values as J
from foliospark.functions import text as X
from foliospark.operators import table_markup as M
from foliospark.plans.texts import ORACLES


DIGITS = "0123456789"
REPEATED = [
    ("head " + DIGITS * 30, "head "),  # one unit ends the line
    ("ab" * 200, ""),  # eight units or more of a longer one are all of the line
    ("0123456" * 12, "0123456"),  # up to 100 characters: ten times the line's unit
    ("x" * 60, "x"),
    ("x" * 70 + DIGITS * 6, "x" * 70 + DIGITS * 6),  # less than half
    ("  " + "head " + DIGITS * 30 + " \n", "head "),  # what stays comes from the stripped line
    ("one line " * 9 + "end", "one line " * 9 + "end"),
    (" " * 120, " " * 120),
    ("a\n" * 30, "a"),
    ("\n".join(["keep"] * 16 + ["other"] * 4), "keep"),  # 80 % of twenty lines
    ("\n".join(["keep"] * 15 + ["other"] * 5), "\n".join(["keep"] * 15 + ["other"] * 5)),
    ("\n\n".join(["nine times"] * 9), "\n\n".join(["nine times"] * 9)),
    ("short", "short"),
    ("", ""),
]


def test_repetition(spark):
    cases = REPEATED
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.truncated for r in X.truncate_repetition(df, min_count=50).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]
    long = spark.createDataFrame([(1, "tail " + "ab" * 500_000), (2, "".join(random.Random(1).choices("ab", k=1_000_000)))], "doc_id long, text string")
    sizes = {r.doc_id: len(r.truncated) for r in X.truncate_repetition(long).collect()}
    assert sizes[2] == 1_000_000 and sizes[1] < 500_000  # in seconds


@pytest.mark.parametrize("seed", range(8))
def test_repeated_endings(seed):
    """What is found ends the text, often enough, and no longer unit does."""
    rng = random.Random(seed)
    for _ in range(60):
        unit = "".join(rng.choices("ab c", k=rng.randint(1, 25)))
        t = "".join(rng.choices("abc", k=rng.randint(0, 40))) + unit * rng.randint(1, 14)
        n, k = X._ends_in_repeats(t)
        fits = {m for m in range(8, len(t) // 5 + 1) if re.search(f"(?s)(.{{{m}}})\\1{{4}}$", t)}
        assert n == max(fits, default=0)
        if n:
            assert t.endswith(t[-n:] * k) and not t.endswith(t[-n:] * (k + 1))
        whole = X._whole_unit(t)
        assert whole * (len(t) // len(whole)) == t and not any(t[:m] * (len(t) // m) == t for m in range(1, len(whole)))


def test_null_texts(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert X.truncate_repetition(df).first().truncated is None
    assert X.dominant_lines(df).count() == 0


def grid(text):
    """Cells of token markup, squared, with spans, as HTML; a plain loop."""
    tags = "fcel ecel lcel ucel xcel".split()
    lines = [re.findall(r"<(fcel|ecel|lcel|ucel|xcel)>((?:(?!<(?:fcel|ecel|lcel|ucel|xcel)>).)*)", x, re.S) for x in text.strip().split("<nl>")]
    rows = [x for x in lines if x]
    if not rows:
        return ""
    if "<nl>" in text:
        low = max(max((i + 1 for i, c in enumerate(r) if c[0] == "fcel"), default=0) for r in rows)
        width = min(range(low, max(low, max(map(len, rows))) + 1), key=lambda w: (sum(abs(len(r) - w) for r in rows), w))
        rows = [(r + [("ecel", "")] * width)[:width] for r in rows]
    owner = {}
    for r, row in enumerate(rows):
        for c, (tag, value) in enumerate(row):
            if tag not in ("fcel", "ecel"):
                continue
            w = h = 1
            while c + w < len(row) and row[c + w][0] in ("lcel", "xcel"):
                w += 1
            while r + h < len(rows) and c < len(rows[r + h]) and rows[r + h][c][0] in ("ucel", "xcel"):
                h += 1
            for y in range(r, r + h):
                for x in range(c, c + w):
                    owner[y, x] = (r, c, w, h, value.strip() if tag == "fcel" else "")
    out = ""
    for r, row in enumerate(rows):
        out += "<tr>"
        for c in range(len(row)):
            y, x, w, h, value = owner.get((r, c), (r, c, 1, 1, ""))
            if (y, x) == (r, c):
                out += "<td" + (f' rowspan="{h}"' if h > 1 else "") + (f' colspan="{w}"' if w > 1 else "") + f">{html.escape(value)}</td>"
        out += "</tr>"
    return f"<table>{out}</table>"


def test_tables(spark):
    rng = random.Random(4)
    texts = ["<fcel>A<ecel><nl><fcel>B<fcel>C<nl>", "<fcel>a<lcel><nl><ucel><xcel><nl>", "<fcel>x", "<fcel>a&<fcel>\"b\"<lcel><nl><ecel><nl>", "<lcel><fcel>z<nl>"]
    for _ in range(60):
        texts.append("".join("".join(rng.choice(["<fcel>t", "<fcel>u<", "<ecel>", "<lcel>", "<ucel>", "<xcel>"]) for _ in range(rng.randint(1, 5))) + "<nl>" for _ in range(rng.randint(1, 5))))
    df = spark.createDataFrame(list(enumerate(texts)), "table_id long, text string")
    got = {r.table_id: r.html for r in M.html_tables(M.cells(df)).collect()}
    assert [got.get(i, "") for i in range(len(texts))] == [grid(t) for t in texts]


def test_json(spark):
    df = spark.createDataFrame([('{"b":1,"a":[true]}',), ('{"a":1,"a":2}',), ("NaN",), (None,)], "j string")
    assert [r[0] for r in df.select(J.canonical_json(F.col("j"))).collect()] == ['{"a":[true],"b":1}', None, None, None]
    df = spark.createDataFrame([('{"a":{"b":true}}',), ('{"a":{"b":1.5}}',), ('{"a":1}',)], "j string")
    assert [r[0] for r in df.select(J.number_at(F.col("j"), "$.a.b")).collect()] == [None, 1.5, None]


@pytest.mark.parametrize(
    "text,want",
    [
        ("<p>as it is</p>", "<p>as it is</p>"),
        ("a<div align='x' STYLE='text-align:center'> <IMG src=\"p.png?a=1&amp;b=2\" /> </div>b", "a![](p.png?a=1&b=2)b"),
        ('<div style="text-align: center;">caf&eacute; &copy; &#8364; &lt;b&gt;</div>', "café © € <b>"),
        ('<div style="text-align:left">l &amp; m</div>', '<div style="text-align:left">l &amp; m</div>'),
        ('<div><div style="text-align:center"><span class=x>in</span></div></div>', "<div>in</div>"),
        ('<div style="text-align:center">open', '<div style="text-align:center">open'),
        ("a\n\n\n\nb", "a\n\nb"),
        (None, None),
    ],
)
def test_centred(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(X.flatten_centred(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("title,want", [("1.2 Scope.", "### 1.2 Scope"), ("3.Results", "### 3. Results"), ("十二、 方法", "## 十二、 方法"), ("  4 Four\n", "## 4 Four"), ("No number", "## No number"), ("7", "## 7"), ("1..2 x", "#### 1. .2 x"), ("2\nTwo-\nlines", "## 2 Twolines"), ("", "## ")])
def test_headings(spark, title, want):
    from foliospark.operators.blocks import heading

    assert spark.createDataFrame([(title,)], "t string").select(heading(F.col("t"))).first()[0] == want


def test_edit_scores(spark):
    """Distances of real text against a table of all prefixes; missing predictions are empty."""
    from foliospark.operators.paired import edit_scores

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
        return row[-1]

    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("aé漢😀b ", k=n))
    rows = [("p", "", ""), ("p", "", None), ("q", "straße", "strasse")] + [("pqr"[i % 3], word(rng.randint(0, 90)), rng.choice([None, word(rng.randint(0, 200))])) for i in range(40)]
    rows += rows[5:9] + [(p, t, t[:7] + "x" + t[8:]) for p, t, _ in rows[5:30]]
    sums = {}
    for page, gt, pred in rows:
        d, n = distance(gt, pred or ""), max(len(gt), len(pred or ""), 1)
        sums.setdefault(page, []).append((d, n))
    got = edit_scores(spark.createDataFrame(rows, "page string, gt string, pred string")).first()
    flat = [x for v in sums.values() for x in v]
    assert got.page_avg == pytest.approx(sum(sum(d for d, _ in v) / sum(n for _, n in v) for v in sums.values()) / len(sums))
    assert got.whole == pytest.approx(sum(d for d, _ in flat) / sum(n for _, n in flat))
    assert got.sample_avg == pytest.approx(sum(d / n for d, n in flat) / len(flat))


def test_latencies(spark):
    """Nearest ranks of groups of any kind, null groups and values among them."""
    from foliospark.operators.runs import latency_summary

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(5) / 4, rng.random()])) for _ in range(500)] + [("one", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r for r in latency_summary(df, "v", "g").collect()}
    got["all"] = latency_summary(df, "v").first()
    for g in ("a", "b", None, "one", "all"):
        v = sorted(x for k, x in rows if x is not None and (g == "all" or k == g))
        rank = lambda p: v[max(0, -int(-p * len(v) // 1) - 1)]
        assert (got[g]["count"], got[g].p50, got[g].p95, got[g].p99, got[g].max) == (len(v), rank(0.5), rank(0.95), rank(0.99), v[-1])
        assert got[g]["mean"] == pytest.approx(sum(v) / len(v))
    assert latency_summary(df.limit(0), "v", "g").count() == 0


@pytest.mark.parametrize("parts", [4096, 3])
def test_latencies_of_odd_values(spark, monkeypatch, parts):
    """Outliers, infinities, equal values and whole numbers; nothing is left in the shared folder."""
    import os

    from foliospark.operators import runs

    monkeypatch.setattr(runs, "PARTS", parts)
    rng = random.Random(parts)
    inf = float("inf")
    groups = {"tail": [10.0**k for k in range(-9, 12)] * 3, "inf": [1.0, 2.0, inf, -inf, inf, 5.0], "same": [0.1] * 7, "near": [1 + rng.random() * 1e-12 for _ in range(200)], "one": [3.0], "nan": [1.0, float("nan"), 2.0]}
    df = spark.createDataFrame([(g, v) for g, own in groups.items() for v in own], "g string, v double").repartition(3)
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    for r in runs.latency_summary(df, "v", "g").collect():
        own = sorted(groups[r.g], key=lambda x: (x != x, x))
        rank = lambda p: own[max(0, -int(-p * len(own) // 1) - 1)]
        assert (r.g, *(str(x) for x in (r.p50, r.p95, r.p99))) == (r.g, *(str(rank(p)) for p in (0.5, 0.95, 0.99)))
    whole = spark.createDataFrame([(i * i % 1009,) for i in range(1000)], "v long")
    own = sorted(i * i % 1009 for i in range(1000))
    got = runs.latency_summary(whole, "v").first()
    assert (got.p50, got.p95, got.p99, got.max) == (own[499], own[949], own[989], own[-1])
    assert set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == before


def test_readers(spark, tmp_path):
    """Prediction texts and traces: what is refused, and what isn't."""
    from foliospark.sources import files as S

    (tmp_path / "a").mkdir()
    for name, text in (("p1.md", "one\n\ntwo"), ("p2.md", ""), ("a/p3.md", "x"), ("note.txt", "no")):
        (tmp_path / name).write_text(text)
    got = {r.stem: r.text for r in S.prediction_texts(spark, str(tmp_path), "p3").collect()}
    assert got == {"p1": "one\n\ntwo", "p2": ""}
    (tmp_path / "a/p1.md").write_text("again")
    with pytest.raises(ValueError, match="p1"):
        S.prediction_texts(spark, str(tmp_path))
    assert S.prediction_texts(spark, str(tmp_path), "p1").count() == 2
    (tmp_path / "t").mkdir()
    for name, text in (("t1.jsonl", '{"page":"t1"}\n\n  \n{"page":"t1","n":2}\n'), ("t2.jsonl", "\n"), ("t3.jsonl", ""), ("t4.jsonl", '[]\n{"page":"t1"}\n{"n":1}')):
        (tmp_path / "t" / name).write_text(text)
    rows = S.trace_events(spark, str(tmp_path / "t")).select("page", "problem").collect()
    assert sorted((r.page, r.problem or "") for r in rows) == [("t1", ""), ("t1", ""), ("t4", "another page"), ("t4", "another page"), ("t4", "not a JSON object")]
    assert sorted(r.page for r in S.empty_traces(spark, str(tmp_path / "t")).collect()) == ["t2", "t3"]
    with pytest.raises(Exception, match="trace of page t4"):
        S.trace_events(spark, str(tmp_path / "t"), strict=True).select("problem").collect()


def test_centred_divs(spark):
    text = 'a<div align="x" style=\'text-align:center\'> <img src="p.png"> </div>b<div style="x; text-align: center;"><b>T</b> &amp; <em>u</em></div>c<div style="text-align: center;">v</div>'
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.flatten_centred(F.col("t"))).first()[0] == "a![](p.png)bT & ucv"


@pytest.mark.parametrize("pred,gt,score,edit,want", [("", "x", 0.0, 1.0, "EMPTY_PRED"), ("$$$$", "x", 0.0, 1.0, "EMPTY_PRED"), ("ab", "abcdefghij", 0.0, 1.0, "MISSING_CONTENT"), ("The a", "a b", 0.0, 1.0, "EXTRA_TEXT"), ("a b", "a b", 0.0, 0.0, "ZERO_TOKENS"), ("a" + "\\\\" * 3, "a b c", 0.5, 0.0, "FULL_STRUCTURE_MISMATCH"), ("a c", "a b", 0.5, 0.3, "CONTENT_DIFF"), ("a b", "a b", 0.5, 0.0, "NOTATION_STYLE")])
def test_categories(spark, pred, gt, score, edit, want):
    df = spark.createDataFrame([(pred, gt, score, 1.0, edit)], "p string, g string, s double, r double, e double")
    assert df.select(X.pair_category(*map(F.col, "pgsre"))).first()[0] == want


def test_repetition_sql_on_texts_that_repeat():
    rng = random.Random(4)
    texts = []
    for _ in range(400):
        unit = "".join(rng.choice("ab é") for _ in range(rng.choice([1, 2, 3, 8, 9, 12, 20])))
        head = "".join(rng.choice("abxy") for _ in range(rng.choice([0, 0, 3, 30, 200])))
        texts.append(head + unit * rng.choice([1, 4, 5, 6, 10, 30]) + rng.choice(["", "", "z"]))
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    got = dict(duckdb.sql(ORACLES["f1_repetition_truncation"]).fetchall())
    cut = X._cut_repeats(pd.Series([t.strip() if len(t) >= 50 else None for t in texts])).tolist()
    assert sum(isinstance(c, str) for c in cut) > 20
    assert [got[i] for i in range(len(texts))] == [c if isinstance(c, str) else t for c, t in zip(cut, texts)]
