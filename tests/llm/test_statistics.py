"""Whitening, toxicity and divergences against brute force."""

import random
import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from oracle import DATA  # noqa: E402

from foliospark.llm import divergence, toxicity, whitening  # noqa: E402
from foliospark.llm.common import table  # noqa: E402

NAN, INF = float("nan"), float("inf")


def by_hand(vectors, weights, most=4):
    """{id: (n, deviation, whitened, explained)} with exact sums and numpy's SVD-free eigenvectors."""
    x = {i: tuple(int(np.floor(256 * float(c))) for c in v) for i, v in vectors}
    counts = Counter(x.values())
    fit = [(v, counts[v] if weights == "counts" else 1) for v in counts]
    n = sum(w for _, w in fit)
    dim = len(fit[0][0])
    sums = [sum(v[k] * w for v, w in fit) for k in range(dim)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    c = np.array([v for v, _ in fit], float) - mean
    cov = (c * np.array([w for _, w in fit])[:, None]).T @ c / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), (np.array(v) - mean) @ u / np.sqrt(e), e / np.trace(cov)) for i, v in x.items()}


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whiten(spark, weights):
    rng = np.random.default_rng(4)
    base = [(i, (rng.standard_normal(6) * [3, 2, 1, 0.5, 0.2, 0.1]).tolist()) for i in range(60)]
    rows = base + [(100 + i, base[0][1]) for i in range(40)] + [(200, [c + 1e-9 if c * 256 % 1 < 0.9 else c for c in base[1][1]])]
    odd = [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [NAN] + [0.0] * 5), (303, [INF] + [0.0] * 5), (304, []), (305, [1e300] + [0.0] * 5)]
    df = spark.createDataFrame([r + (7, "x") for r in rows + odd], "vec_id long, embedding array<double>, dim int, w string").repartition(3)
    got = defaultdict(dict)
    for r in whitening.whiten(df, weights=weights).collect():
        got[r.vec_id][r.component] = r
    want = by_hand(rows, weights)
    assert set(got) == set(want) and all(set(v) == {1, 2, 3, 4} for v in got.values())
    signs = {k: np.sign(got[0][k].whitened * want[0][2][k - 1]) for k in range(1, 5)}
    for i, (n, deviation, white, share) in want.items():
        for k, r in got[i].items():
            assert r.n == n and int(r.deviation) == deviation
            assert r.whitened * signs[k] == pytest.approx(white[k - 1], abs=1e-9) and r.explained == pytest.approx(share[k - 1])
            assert r.identity_error < 1e-9
    # repeated rows, and a null id
    again = whitening.whiten(df.union(df).union(df.limit(1).withColumn("vec_id", df.vec_id * None)), weights="one").where("vec_id = 5 OR vec_id IS NULL")
    assert again.count() == 2 * 4 + (4 if df.first().embedding and df.first().vec_id < 300 else 0)


def test_whiten_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)).collect()
    assert len(one) == 4 and all(r.n == 1 and r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in one)
    # vectors on a line have one component; two lengths are two fits
    rows = [(i, [float(i), 2.0 * i]) for i in range(5)] + [(10 + i, [float(i % 3)]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 * 2 + 6 and all((r.whitened is None) == (r.component == 2) for r in got)
    assert {r.n for r in got if r.vec_id < 10} == {5} and {r.n for r in got if r.vec_id >= 10} == {3}
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame(rows, schema), weights="two")


def test_exact_deviations():
    m = np.array([[1 << 40, -(1 << 41)], [3, 4]])
    assert whitening._deviation(m, 10**9, [5, 6]) == [((10**9) * a - 5) ** 2 + ((10**9) * b - 6) ** 2 for a, b in m.tolist()]


def test_whitening_of_all_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, DATA, "embeddings").collect()]
    want = by_hand(rows, "one")
    for r in whitening.op11_embedding_whitening(spark, DATA).where("vec_id % 50 = 0").collect():
        n, deviation, white, share = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened) == pytest.approx(abs(white[r.component - 1]), abs=1e-8)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9) and r.identity_error < 1e-9


def audited(rows, support, ranks):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)), g or "", s or "") for t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in docs}:
        own = [d for d in docs if d[1] == lang]
        df = Counter(t for words, _, _ in own for t in set(words))
        kept = [t for t, n in df.items() if n >= support]
        counts = {s: Counter(t for words, _, x in own if x == s for t in words if df[t] >= support) for s in {s for _, _, s in own}}
        counts[None] = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            if s is None:
                continue
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in counts if o is not None and o != s]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(items)[:most], 1)]
    return sorted(out)


def corpus(seed=2, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "THE,", "a-a", "b-c-b", "été", "Été", "x1y", "--", "café.", "wörter", " odd", "tab\tted", "nul\x00l", "wide　blank", "𝔘nicode"] + [f"w{chr(97 + k)}" for k in range(12)]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(0, 25))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "Z", "é", None])) for _ in range(n)]
    return rows + [(None, "en", "s1"), ("", "fr", "empty"), ("...", "de", "only"), (None, None, None), ("the " * 5000, "en", "s2")] + rows[:5]


@pytest.mark.parametrize("unit,sources,terms", [(16_000_000, 256, 2048), (200, 2, 3)])
def test_audit(spark, monkeypatch, unit, sources, terms):
    for name, value in (("UNIT", unit), ("SOURCES", sources), ("TERMS", terms)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    df = spark.createDataFrame([r + ("k", 1, "x") for r in rows], "text string, lang string, source string, key string, n int, term string").repartition(5)
    for support, ranks in ((10, 10), (4, 3), (1000, 10)):
        got = divergence.audit(df, support=support, ranks=ranks).collect()
        assert sorted(map(tuple, got)) == audited(rows, support, ranks)


def test_terms_in_few_documents_of_many_chunks(spark):
    """A document with several chunks of one term counts once, in whatever batches they come."""
    rows = [(f"word word, (word) word{i % 3}. x{'abcdefghijkl'[i % 12]}", "en", "s") for i in range(9)] + [("Word! word? word", "fr", "s")] * 10
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(rows, "text string, lang string, source string")
        assert {(r.lang, r.term) for r in divergence.vocabulary(df.selectExpr("text", "lang", "1L AS source")).collect()} == {("fr", "word")}
        assert divergence.audit(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_two_sources_with_one_number(spark, monkeypatch):
    """Another seed is taken where two sources have one hash."""
    real, seeds = divergence.F.xxhash64, []

    def clash(*cols):
        if len(cols) == 2 and cols[0] == "name":
            seeds.append(1)
            if len(seeds) == 1:
                return divergence.F.lit(1).cast("long")
        return real(*cols)

    monkeypatch.setattr(divergence.F, "xxhash64", clash)
    rows = corpus()
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert sorted(map(tuple, got)) == audited(rows, 10, 10) and len(seeds) > 2


def texts_of(lexicon, texts):
    import pyarrow as pa

    return toxicity.Lexicon(tuple(lexicon)).features(pa.array(texts, pa.string()))


def test_features():
    f = dict(zip(toxicity.FEATURES, range(len(toxicity.FEATURES))))
    words = ["moron", "scum", "été"]
    got = texts_of(words, ["You are a moron, SCUM!", "m0ron sc*m scuuuum s-c-u-m", "a m o r o n here", "été ÉTÉ", "", None, "nothing to see", "you a b c d e f g scum", "$cum! m.o.r.o.n"])
    hits = np.round(np.expm1(got[:, f["hits"]])).astype(int).tolist()
    hidden = np.round(np.expm1(got[:, f["hidden_hits"]])).astype(int).tolist()
    assert hits == [2, 4, 1, 2, 0, 0, 0, 1, 2] and hidden == [0, 4, 1, 0, 0, 0, 0, 0, 2]
    near = np.round(np.expm1(got[:, f["near_hits"]])).astype(int).tolist()
    assert near == [2, 0, 0, 0, 0, 0, 0, 0, 0]
    assert not got[4].any() and not got[5].any()
    assert got[0, f["capitals"]] == 0.2 and got[3, f["capitals"]] == 0.5 and got[0, f["second_person"]] == 20
    # clean look-alikes
    assert not texts_of(words, ["mail a@b.c 2023-11 co-worker!!! x*y word### of%%% the&&& sc***", "m o r e n"])[:, f["hits"]].any()


def test_slices_give_equal_features(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(rng.choices(["you", "scum", "m0ron", "fine", "x", "y", "DAY!", "s c u m"], k=rng.randrange(30))) for _ in range(200)]
    whole = texts_of(["scum", "moron"], texts)
    assert np.array_equal(whole, np.concatenate([texts_of(["scum", "moron"], [t]) for t in texts]))
    monkeypatch.setattr(toxicity, "UNIT", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    assert pa.concat_arrays([s.column(0) for s in toxicity.slices(batch, 0)]).to_pylist() == texts


def labelled(spark, n=600, seed=3):
    """Toxic documents of words that no list has, clean ones, and copies of a toxic one."""
    rng = random.Random(seed)
    clean = ["".join(rng.choices("aeioubcdfg", k=rng.randint(2, 6))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        words, toxic = rng.choices(clean, k=rng.randint(5, 60)), int(i % 5 == 0)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgle", "quaxx"]))
        rows.append((i, " ".join(words)))
        marks.append((i, toxic))
    copy = " ".join(f"rare{'abcdefghij'[k]}" for k in range(10)) + " zorgle quaxx"
    rows += [(n + i, copy) for i in range(60)]
    marks += [(n + i, 1) for i in range(60)]
    docs = spark.createDataFrame([r + ("x",) for r in rows], "doc_id long, text string, score string").repartition(3)
    return docs, spark.createDataFrame(marks, "doc_id long, toxic int")


def test_toxicity_is_learned(spark):
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(None, 1), (5000, None), (3, 0), (3, None)], labels.schema)
    model = toxicity.train(docs, labels.union(odd))
    learned = set(model.lexicon.terms) - set(toxicity.INSULTS)
    assert learned == {"zorgle", "quaxx"}  # words of the copies say nothing: all stand in one place
    more = spark.createDataFrame([(9000, None, ""), (9001, "", ""), (9002, " \t", ""), (None, "a zorgle", ""), (9003, "fine " * 50_000 + "zorgle quaxx zorgle", "")], docs.schema)
    got = {r.doc_id: r for r in toxicity.toxicity(docs.union(more), model, keep=("doc_id",)).collect()}
    truth = dict(map(tuple, labels.collect()))
    fold = {r.doc_id: r.f for r in docs.select("doc_id", toxicity.fold("doc_id").alias("f")).collect()}
    held = [i for i in truth if fold[i] == 0]
    assert len(held) > 80 and sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[9000].score == got[9001].score == got[9002].score < 0.5 and len(got) == len(truth) + 5
    assert toxicity.toxicity(docs.limit(0), model, keep=("doc_id",)).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    for few in (labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.train(docs, few)
        assert model.trees is None
        got = toxicity.toxicity(spark.createDataFrame([(1, "what a moron"), (2, "fine"), (3, None)], "doc_id long, text string"), model, keep=("doc_id",)).collect()
        assert [(r.score, r.predicted) for r in sorted(got)] == [(1.0, 1), (0.0, 0), (0.0, 0)]


def test_held_out_labels_are_not_read(spark):
    """Other labels of documents that are held out change nothing."""
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.fold("doc_id") == 0, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    got = [sorted(map(tuple, toxicity.toxicity(docs, toxicity.train(docs, x), keep=("doc_id",)).collect())) for x in (labels, turned)]
    assert got[0] == got[1]
