"""Steps of groups and files against loops: digests, calls in flight, edit distances, tables, readers."""

import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.functions.edit import distance, distances, edit_distance
from foliospark.operators import runner, runs, table_markup
from foliospark.sources import files


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_listed_digest(spark, monkeypatch, piece):
    """Any number of rows and groups, in any order, against sorting the lines."""
    monkeypatch.setattr(runs, "PIECE", piece)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), f"n{rng.randrange(900)}é", f"d{rng.randrange(3)}") for _ in range(3000)]
    rows += [("a", 1, None, "d"), ("b", 2, "n", None), ("only", 9, None, None)]
    df = spark.createDataFrame(rows, "g string, k int, name string, h string").repartition(7)
    lines = lambda own: [f"{n}\t{h}" for n, h in sorted((n, h) for *_, n, h in own if n is not None and h is not None)]
    got = {(r.g, r.k): r.digest for r in runs.listed_digest(df, "name", "h", "g", "k").collect()}
    assert got == {key: sha(lines([r for r in rows if r[:2] == key])) for key in {r[:2] for r in rows}}
    assert [r.digest for r in runs.listed_digest(df, "name", "h").collect()] == [sha(lines(rows))]
    assert [r.digest for r in runs.listed_digest(df.limit(0), "name", "h").collect()] == [sha([])]
    assert runs.listed_digest(df.limit(0), "name", "h", "g").count() == 0


def test_digest_of_more_than_a_million_rows(spark):
    n = 1_200_000
    df = spark.range(n).select(F.format_string("%07d", (F.col("id") * 7919) % n).alias("name"), (F.col("id") % 10).cast("string").alias("h"))
    want = hashlib.sha256()
    back = pow(7919, -1, n)
    for i in range(n):
        want.update(f"{chr(10) if i else ''}{i:07d}\t{i * back % n % 10}".encode())
    assert [r.digest for r in runs.listed_digest(df, "name", "h").collect()] == [want.hexdigest()]


def test_calls_in_flight(spark):
    """Ten slow calls at width 5 take the time of two; order, statuses and tries as one by one."""

    def slow(x):
        time.sleep(0.5)
        if x % 4 == 3:
            raise ValueError(f"no {x}")
        return f"a{x}" if x % 4 else ""

    class Flaky:
        """Fails the first call of each value."""

        def open(self):
            import threading

            seen, lock = set(), threading.Lock()

            def call(v):
                with lock:
                    new = v not in seen
                    seen.add(v)
                if new:
                    raise OSError("busy")
                return "x"

            return call

    df = spark.range(10).coalesce(1).select(F.col("id").alias("k"), F.col("id").alias("v"))
    runner.run_function(df.limit(1), "k", "v", str).collect()
    outs, took = [], []
    for width in (5, 1):
        began = time.time()
        rows = runner.run_function(df, "k", "v", slow, attempts=1, width=width).collect()
        took.append(time.time() - began)
        outs.append([(r.k, r.answer, r.status, r.attempts) for r in rows])
    assert outs[0] == outs[1] and [r[0] for r in outs[0]] == list(range(10))
    assert {r[2] for r in outs[0]} >= {"ok", "failed: empty answer", "failed: ValueError: no 3"} and took[1] - took[0] > 2.5
    again = runner.run_function(df, "k", "v", Flaky(), attempts=3, width=4).collect()
    assert [(r.k, r.attempts, r.status) for r in again] == [(i, 2, "ok") for i in range(10)]


def slowly(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("abé𝔘 ", k=n))
    pairs = [(text(rng.randrange(40)), text(rng.randrange(40))) for _ in range(300)]
    pairs += [(a, a[:5] + "x" + a[7:]) for a, _ in pairs[:50]] + [("", ""), ("", "abc"), ("kitten", "sitting"), (text(200), text(90))]
    assert all(distance(a, b) == distance(b, a) == slowly(a, b) for a, b in pairs)
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None), (None, None)], "a string, b string").withColumn("d", edit_distance(F.col("a"), F.col("b")))
    assert all(r.d == (None if r.a is None or r.b is None else slowly(r.a, r.b)) for r in df.collect())


def test_edit_distances_of_many_pairs():
    """Pairs of all lengths about the edges of words, whole batches at once; 20,000 pairs of 150
    characters take a second or two."""
    rng = random.Random(7)
    text = lambda n: "".join(rng.choices(rng.choice(("ab", "abcdefgh ", "aé漢𝄞")), k=n))
    a = [text(rng.choice((0, 1, 63, 64, 65, 127, 128, 129, 150, 400))) for _ in range(1500)]
    b = [x.replace("a", "", rng.randrange(9)) + rng.choice(("", "x")) if rng.random() < 0.6 else text(rng.randrange(140)) for x in a]
    assert distances(pa.array(a), pa.array(b)).tolist() == [distance(x, y) for x, y in zip(a, b)]
    a = ["".join(rng.choices("abcdefgh ", k=150)) for _ in range(20_000)]
    began = time.time()
    got = distances(pa.array(a), pa.array([x.replace("a", "") for x in a]))
    assert got.tolist() == [x.count("a") for x in a] and time.time() - began < 6


def test_long_edit_distance():
    rng = random.Random(3)
    a, b = ("".join(rng.choices("abcdefgh ", k=20_000)) for _ in "ab")
    began = time.time()
    assert 0 < distance(a, b) < 20_000 and distance(a, a[:100] + a[200:] + "!") == 101 and time.time() - began < 10


def test_large_span(spark):
    """One cell of a long text that spans 300 by 300 places, and cells in the shadow of others."""
    first = "<fcel>" + "long " * 2000 + "<lcel>" * 299
    df = spark.createDataFrame([(1, "<nl>".join([first] + ["<ucel>" + "<xcel>" * 299] * 299))], "table_id long, text string")
    began = time.time()
    (got,) = table_markup.html_tables(table_markup.cells(df)).collect()
    assert got.html == f'<table><tr><td rowspan="300" colspan="300">{("long " * 2000).strip()}</td></tr>' + "<tr></tr>" * 299 + "</table>" and time.time() - began < 60


def test_readers_leave_no_views(spark):
    before = {t.name for t in spark.catalog.listTables()}
    texts = ['[{"img_id": "p1", "metric": {"CDM": 0.5}}, {"img_id": "p2", "score": true}]', '{"p3_[7]": 0.25, "p4": [{"CDM": 1}, {"x": 2}, 3], "p5": {"score": 0.75}}', "[]", "7", "broken"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = sorted((r.page, r.id, r.score) for r in files.sample_scores(df).collect())
    assert got == [("p1", "", 0.5), ("p3", "7", 0.25), ("p4", "", 1.0), ("p4", "", 3.0), ("p5", "", 0.75)]
    cache = spark.createDataFrame([('{"entries": {"a": "x", "b": ""}}',), ('{"c": "y"}',), ("{}",)], "value string")
    assert sorted(map(tuple, files.response_cache(cache).collect())) == [("a", "x"), ("b", ""), ("c", "y")]
    with pytest.raises(Exception, match="must be texts"):
        files.response_cache(spark.createDataFrame([('{"a": 1}',)], "value string")).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_listing_in_tasks(spark, tmp_path):
    """Empty files, nested folders, odd names; hidden ones and other kinds are left out."""
    for name in ("a.md", "empty.md", "x y+z%20é.md", "b.txt", ".hidden.md", "_skip.md", "one/c.md", "one/two/d.md", "one/two/.e.md", "_temporary/f.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else "text")
    got = sorted(r.stem for r in files.listed(spark, str(tmp_path), "*.md").collect())
    assert got == sorted(["a", "empty", "x y+z%20é", "c", "d"])
    assert files.listed(spark, f"file://{tmp_path}/one/two", "*.txt").count() == 0
    texts = {r.stem: r.text for r in files.prediction_texts(spark, str(tmp_path), "a").collect()}
    assert texts == {"empty": "", "x y+z%20é": "text", "c": "text", "d": "text"}


def test_html_of_random_tables(spark, monkeypatch):
    """All tables of a batch at once against cells painted one by one; cells are worked out once."""
    rng = random.Random(5)
    tags = ("fcel", "fcel", "ecel", "lcel", "ucel", "xcel")
    rows = [(k, r, c, rng.choice(tags), f"<{k}.{r}.{c}>") for k in range(300) for h, w in [(rng.randrange(1, 7), rng.randrange(1, 7))] for r in range(h) for c in range(w) if rng.random() < 0.95 or (k % 2)]
    df = spark.createDataFrame(rows, "table_id int, r int, c int, tag string, text string").withColumn("text", F.when(F.col("tag") == "fcel", F.col("text")).otherwise(""))

    def slowly(cells):
        cells = sorted(cells)
        spans, owner = {}, {}
        for k, r, c, tag, text in cells:
            right = [x for x in cells if x[1] == r and x[2] > c]
            down = [x for x in cells if x[2] == c and x[1] > r]
            end_c = min([x[2] for x in right if x[3] not in ("lcel", "xcel")] or [max([x[2] for x in right], default=c) + 1])
            end_r = min([x[1] for x in down if x[3] not in ("ucel", "xcel")] or [max([x[1] for x in down], default=r) + 1])
            spans[r, c] = end_r - r, end_c - c
            if tag in ("fcel", "ecel"):
                owner |= {(y, x): (r, c) for y in range(r, end_r) for x in range(c, end_c)}
        out = ""
        for r in sorted({x[1] for x in cells}):
            out += "<tr>"
            for _, _, c, tag, text in [x for x in cells if x[1] == r]:
                if (r, c) not in owner:
                    out += "<td></td>"
                elif owner[r, c] == (r, c):
                    y, x = spans[r, c]
                    shown = text.replace("<", "&lt;").replace(">", "&gt;") if tag == "fcel" else ""
                    out += "<td" + (f' rowspan="{y}"' if y > 1 else "") + (f' colspan="{x}"' if x > 1 else "") + f">{shown}</td>"
            out += "</tr>"
        return f"<table>{out}</table>"

    want = {k: slowly([x for x in rows if x[0] == k]) for k in {x[0] for x in rows}}
    for much in (8, -1000):
        monkeypatch.setattr(table_markup, "_MUCH", much)
        got = table_markup.html_tables(df)
        assert {r.table_id: r.html for r in got.collect()} == want
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ExistingRDD") == 1


def test_texts_are_written_as_they_are(spark, tmp_path):
    """Bytes of a batch go to the files one text at a time and are not decoded: bytes that are no
    UTF-8, empty texts and null."""
    rows = spark.sql("SELECT concat('n', id) AS name, CASE WHEN id = 0 THEN NULL WHEN id = 1 THEN '' WHEN id = 2 THEN CAST(X'61FF62' AS STRING) ELSE 'é漢𝄞' END AS text FROM range(4)")
    got = {r.name: r.bytes for r in files.write_named_texts(rows, str(tmp_path / "out"), "name", "text").collect()}
    read = {n: (tmp_path / "out" / n).read_bytes() for n in got}
    assert read == {"n0": b"", "n1": b"", "n2": b"a\xffb", "n3": "é漢𝄞".encode()} and got == {n: len(b) for n, b in read.items()}
