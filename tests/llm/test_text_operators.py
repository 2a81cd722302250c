"""Operators on documents against brute force on a small corpus with every kind of odd row."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import prose
from pyspark.sql import functions as F

from foliospark.llm import common, decontamination, jaccard, language_id, packing, suffix_array, token_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


# --- token counts


def test_token_counts(docs, corpus):
    """Every stored prefix against the library's encoding of that prefix."""
    library = token_counts.model_at(public_tokenizers.path(token_counts.MODEL)).library
    got = {r.source_id: r for r in token_counts.prefix_counts(docs.withColumnRenamed("doc_id", "source_id").fillna(6, ["source_id"]), keep=("source_id",)).collect()}
    for i, (_, text, *_) in enumerate(corpus):
        r, text = got[i], text or ""
        assert (r.n_bytes, r.n_tokens, len(r.prefix_steps)) == (len(text.encode()), len(library.encode(text)), len(text))
        rng = random.Random(i)
        places = range(len(text) + 1) if len(text) < 700 else sorted(rng.sample(range(len(text) + 1), 12))
        counts = {at: len(library.encode(text[:at])) for at in places}
        assert {at: token_counts.tokens_at(r.prefix_steps, at) for at in places} == counts
        if len(text) < 700:
            for budget in (0, 1, 5, 40, 10_000):
                assert token_counts.fitting_prefix(r.prefix_steps, budget) == max(at for at in places if counts[at] <= budget)


@pytest.mark.parametrize("text", [" a", "a ", "a  b", "   ", "▁", "x▁ y", "　x", "<s>hi</s>", "a\n\nb \n c", "é ü 漢字 😀😀", "\r\n\x00 \x01", "a" * 300, " " * 40, "\t\t  \t", "the theatre"])
def test_prefixes_of_odd_texts(text):
    model = token_counts.model_at(public_tokenizers.path(token_counts.MODEL))
    steps = model.prefix_steps([None, text, ""])[1]
    assert [token_counts.tokens_at(steps, k) for k in range(len(text) + 1)] == [len(model.library.encode(text[:k])) for k in range(len(text) + 1)]


def test_models_that_cannot_be_cut_at_blanks():
    """Without cuts a text is one chunk with the same counts."""
    model = token_counts.Model(public_tokenizers.path(token_counts.MODEL))
    text = "two words,  and more of them"
    want = model.prefix_steps([text])
    model.steps.clear()
    model.chunk = re.compile("(?s:.+)")
    assert model.prefix_steps([text]) == want


# --- decontamination


def contaminated(corpus, items, window=13):
    runs = defaultdict(set)
    for item, text in items:
        for run in decontamination.windows_of(words(text), window):
            if item is not None:
                runs[run].add(item)
    out = {}
    for i, (_, text, *_) in enumerate(corpus):
        w, hit, found = words(text), set(), set()
        for n in {len(r) for r in runs}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in runs:
                    hit |= set(range(k, k + n))
                    found |= runs[tuple(w[k : k + n])]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark, docs, corpus):
    bits = corpus[4][1].split()
    items = [(1, " ".join(bits[:20])), (2, "One TWO"), (3, " ".join(corpus[18][1].split()[100:140])), (10, " ".join(bits[10:30])), (4, None), (5, ""), (None, " ".join(bits[:14])), (2, "漢字" * 300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(corpus, items)
    mine = docs.withColumnRenamed("doc_id", "row").fillna(6, ["row"])
    one = decontamination.contamination(mine, bench, keep=("row",))
    many = decontamination.contamination(mine, bench, keep=("row",), max_words=150)
    assert one.schema == many.schema
    for run in (one, many):
        rows = {r.row: r for r in run.collect()}
        assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in rows.items()} == want
        assert [corpus[12][1][s.start : s.end] for s in rows[12].hit_spans] == ["one two"]
        for i, r in rows.items():
            assert sum(len(words((corpus[i][1] or "")[s.start : s.end])) for s in r.hit_spans) == want[i][1]
            assert all(a.end < b.start for a, b in zip(r.hit_spans, r.hit_spans[1:]))
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.contamination(mine, none, keep=("row",)).collect()} == {0}


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_slices_have_each_window_once(size):
    text = " ".join(map(str, range(40)))
    got = [w for _, part in decontamination.slices([(1, text), (2, "a b"), (3, ""), (4, None)], 13, size) for w in decontamination.windows_of(part)]
    assert got == [w for t in (text, "a b") for w in decontamination.windows_of(decontamination.words_of(t))]


# --- packing


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    mine = docs.withColumnRenamed("doc_id", "row").fillna(6, ["row"])
    got = packing.pack(mine, keep=("row",)).toPandas()
    for i, (_, text, *_) in enumerate(corpus):
        ids, at = t.encode(text or "", add_special_tokens=False).ids + [0], 0
        mine_ = got[got.row == i].sort_values("piece")
        assert list(mine_.piece) == list(range(len(mine_)))
        for r in mine_.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == 2048 or r.piece == 0
            at += r.length
        assert at == len(ids)
    ends = got.sort_values(["sequence_id", "offset"])
    for _, s in ends.groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece(seed):
    rng = random.Random(seed)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(3000))
    counts[2048] += 5
    plan, used = packing.plan(counts), Counter()
    for times, parts in plan:
        assert sum(parts) <= 2048 and times > 0
        for p in parts:
            used[p] += times
    assert used == counts
    least = -(-sum(k * n for k, n in counts.items()) // 2048)
    assert sum(n for n, _ in plan) <= 1.02 * least + 1
    starts = packing.slots(plan)
    assert set(starts) == set(counts)


def test_plan_finds_exact_complements():
    assert packing.plan({1000: 1, 1048: 1}) == [(1, (1048, 1000))]
    assert packing.plan({1000: 2, 500: 2, 548: 2}) == [(2, (1000, 548, 500))]
    assert packing.plan({1000: 1, 500: 1, 300: 1, 248: 1})[0][0] == 1 and len(packing.plan({1000: 1, 500: 1, 300: 1, 248: 1})) == 1
    assert packing.plan({}) == []


# --- language


def test_language_id(spark):
    rng = random.Random(5)
    sounds = {"aa": ["la", "mi", "ro"], "bb": ["tek", "grud", "zot"]}
    text = lambda g, n: " ".join("".join(rng.choices(sounds[g], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(g, rng.randint(1, 60)), g) for i, g in enumerate(["aa", "bb"] * 150)]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ---", "aa"), (None, text("aa", 9), "aa"), (1003, text("bb", 9), None), (1004, "qxjwv " * 60, "aa"), (1005, "lami " * 20_000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").repartition(3)
    models = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, models, keep=("doc_id",)).collect()}
    assert all(got[i].lang_pred == g and not got[i].rejected for i, _, g in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected and got[i].cross_entropy is None for i in (1000, 1001, 1002))
    assert got[None].lang_pred == "aa" and got[1003].lang_pred == "bb" and got[1005].lang_pred == "aa"
    assert got[1004].rejected and got[1004].lang_pred in sounds
    assert all(0 <= r.score <= 1 for r in got.values())


def test_kneser_ney_sums_to_one():
    """Over all characters the probabilities of a known context and of an unknown one sum to one."""
    words_ = pa.array(["abra", "abraca", "cab", "bad", "dab"])
    points, at, _ = language_id.grams(words_)
    rows = np.stack([points[at - 4 + j] for j in range(5)], 1)
    kinds, n = np.unique(rows, axis=0, return_counts=True)
    m = language_id.fit({"x": (kinds, n)})
    letters = sorted({chr(c) for c in points} | {"\u4e00"})  # one stands for all that are unseen
    assert len(letters) == m.letters[0] + (0 if " " in "abcd" else 1)
    for context in ("    ", "   a", " abr", "zzzz"):
        text = np.frombuffer("".join(context + c for c in letters).encode("utf-32-le"), "<u4")
        p = np.exp(-m.log_loss(text, np.arange(4, len(text), 5)))[:, 0]
        assert p.sum() == pytest.approx(1, abs=2e-2)


def kneser_ney(words_, alphabet, order=5):
    """Interpolated Kneser-Ney with dictionaries: p(context, letter) from all words of one language."""
    grams = Counter()
    for w in words_:
        padded = " " * (order - 1) + w + " "
        for i in range(order, len(padded) + 1):
            grams[padded[i - order : i]] += 1
    levels = {order: dict(grams)}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])  # different characters before
    discount = {}
    for k, held in levels.items():
        n1, n2 = (sum(c == n for c in held.values()) for n in (1, 2))
        discount[k] = n1 / (n1 + 2 * n2) if n1 else 0.5

    def p(context, letter):
        k = len(context) + 1
        mine = levels[k]
        if k == 1:
            total = sum(mine.values())
            return max(mine.get(letter, 0) - discount[1], 0) / total + discount[1] * len(mine) / total / alphabet
        after = {g: c for g, c in mine.items() if g[:-1] == context}
        total = sum(after.values())
        if not total:
            return p(context[1:], letter)
        return max(mine.get(context + letter, 0) - discount[k], 0) / total + discount[k] * len(after) / total * p(context[1:], letter)

    return p


@pytest.mark.parametrize("seed", range(4))
def test_entropies_against_dictionaries(seed):
    """Two languages in shared hash arrays, each against its own Kneser-Ney with dictionaries."""
    rng = random.Random(seed)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 7)))
    known = {"x": [word("abcd") for _ in range(60)], "y": [word("cdefé") for _ in range(40)]}
    counts = {}
    for g, ws in known.items():
        points, at, _ = language_id.grams(pa.array(ws))
        counts[g] = np.unique(np.stack([points[at - 4 + j] for j in range(5)], 1), axis=0, return_counts=True)
    m = language_id.fit(counts)
    texts = [" ".join(word("abcdeé漢") for _ in range(rng.randint(1, 6))) for _ in range(12)] + [known["x"][0]]
    entropy, n, best = m.judge(pa.array(texts))
    alphabet = len({c for ws in known.values() for w in ws for c in w} | {" "}) + 1
    for i, text in enumerate(texts):
        for j, g in enumerate(m.langs):
            p, losses = kneser_ney(known[g], alphabet), []
            for w in text.split(" "):
                padded = "    " + w + " "
                losses += [-np.log(p(padded[k - 4 : k], padded[k])) for k in range(4, len(padded))]
            assert n[i] == len(losses) and entropy[i, j] == pytest.approx(np.mean(losses), rel=1e-4)
        assert best[i] == entropy[i].argmin()


def test_limits_cover_all_calibration_documents(spark):
    """A document that the sample for the models doesn't draw counts for its language's limit."""
    rng = random.Random(3)
    words = ["abcd", "efgh", "abij", "cdgh"]
    rows = [(i, " ".join(rng.choices(words, k=30)), "en") for i in range(600)]
    odd = spark.createDataFrame([("".join(rng.choices("abcdefghij ", k=120)),) for _ in range(20)], "text string").where("pmod(xxhash64(text), 1 << 30) > (1 << 29)").first().text
    at = next(i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 3)
    rows[at] = (at, odd, "en")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.train(docs, sample=60), keep=("doc_id",))
    assert not got.where(f"doc_id = {at}").first().rejected


def test_language_id_without_training(spark, no_docs):
    assert language_id.train(no_docs) is None
    one = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    r = language_id.identify(one, language_id.train(one), keep=("doc_id",)).first()
    assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)


# --- near duplicates


def links(texts, least=0.8, n=5):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    found = {i: set() for i in texts}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= least:
                    found[a].add(b)
                    found[b].add(a)
    label = {i: i for i in texts}
    while True:
        new = {i: min([label[i], *(label[j] for j in found[i])]) for i in texts}
        if new == label:
            return found, label
        label = new


def near_corpus(n, seed):
    rng = random.Random(seed)
    out, base = {}, ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(200)]
    for i in range(n):
        w = list(base if i % 3 else base[:120])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(50)}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("chunks", [(256, 128), (8, 8)])
def test_near_duplicates(spark, monkeypatch, chunks):
    monkeypatch.setattr(jaccard, "NODE_CHUNK", chunks[0])
    monkeypatch.setattr(jaccard, "BLOCK_CHUNK", chunks[1])
    texts = near_corpus(70, 3) | {100: None, 101: "", 102: "...", 103: "two words", 104: "TWO, words", 105: "alone here"}
    found, label = links(texts)
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert {i: (len(found[i]), label[i], label[i] == i) for i in texts} == {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()}


def test_near_duplicates_odd_rows(spark, no_docs):
    assert jaccard.near_duplicates(no_docs).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (None, "q r s t u"), (5, None), (5, None), (6, "x y z"), (6, "x y z")]
    got = sorted(((r.doc_id, r.n_links, r.component_id, r.kept) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 1, 3, False), (3, 1, 3, True), (None, 0, None, True), (5, 0, 5, True), (5, 0, 5, True), (6, 1, 6, True), (6, 1, 6, True)], key=str)


def test_prefixes_shorten_with_the_similarity():
    assert [jaccard.prefix_depth(s) for s in (0.95, 0.8, 0.5, 0.2)] == sorted([jaccard.prefix_depth(s) for s in (0.95, 0.8, 0.5, 0.2)], reverse=True)
    assert jaccard.prefix_depth(0.8) == 4


def test_texts_of_nameless_rows_meet_near_copies(spark):
    """A text that only rows without an id have is linked as any other."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (9, long + " more"), (None, long + " else"), (None, "q r s t u v"), (None, "q r s t u v")]
    got = sorted(((r.doc_id, r.n_links, r.component_id, r.kept) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, 9, False), (9, 2, 9, True), (None, 2, 9, False), (None, 1, None, True), (None, 1, None, True)], key=str)


def test_near_duplicates_of_a_whole_table(spark):
    """All links of the documents of sf0.001, by their sets of n-grams."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found, label = links({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (len(found[i]), label[i]) for i in found} and sum(map(len, found.values())) > 0


def test_matched_prefixes_are_shortened():
    """Members of a node are joined by longer prefixes first; others by the node's own prefix."""
    bits = np.zeros((5, 8), np.uint8)
    bits[4] = 9
    rest = np.array([[1, 1], [1, 1], [1, 2], [7, 7], [7, 8]], ">u4")
    cols = [pa.array([3] * 5), pa.array([0] * 5), pa.array([0] * 5), pa.array([r.tobytes() for r in rest], pa.binary()), pa.array([10, 11, 12, 13, 14]), pa.array([b.tobytes() for b in bits], pa.binary())]
    batch = pa.RecordBatch.from_arrays(cols, names=["node", "x", "y", "rest", "id", "bits"])
    (told,) = jaccard._meet(0.5)([batch])
    assert sorted(zip(told["a"].to_pylist(), told["b"].to_pylist())) == [(10, 11), (10, 12), (10, 13)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}


# --- suffix array


def removed(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = set()
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone |= set(range(i, i + size))
        left = bytes(x for i, x in enumerate(b) if i not in gone)
        out.append((len(b), len(gone), sum(1 for i in gone if i - 1 not in gone), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("size,segment", [(400, 1 << 20), (40, 1 << 20), (40, 500)])
def test_repeats(spark, corpus, monkeypatch, size, segment):
    monkeypatch.setattr(suffix_array, "SEGMENT", segment)
    rng = random.Random(8)
    texts = [t for _, t, *_ in corpus if len(t or "") < 6000]
    for _ in range(12):  # pieces of each other, with single bytes changed
        a = rng.choice([t for t in texts if t and len(t) > 60])
        k, n = rng.randrange(len(a) // 2), rng.randrange(30, 900)
        texts.append("<" + a[k : k + n] + rng.choice("!?é") + a[k + n : k + 2 * n])
    monkeypatch.setattr(suffix_array, "BUCKET", 500)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.remove_repeats(df, size=size, keep=("doc_id",)).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, size)


def test_repeats_odd_tables(spark, no_docs):
    assert suffix_array.remove_repeats(no_docs, keep=("doc_id",)).count() == 0
    rows = [(None, "a" * 400), (None, "a" * 400), (1, "b" * 399), (1, "b" * 399), (2, "ab" * 201)]
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_array.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=("doc_id",)).collect())
    # a text of 402 bytes of one pair holds its own first 400 again, two bytes on
    assert got == [("1", 0), ("1", 0), ("2", 402), ("None", 400), ("None", 400)]


def test_planted_passages(spark):
    """Passages of over 50 words in two documents go from both if they have 400 bytes, and stay if
    they have fewer; documents without a repeat keep their text. n_bytes tells nothing of that."""
    rng = random.Random(12)
    clean = [prose(rng, 200) for _ in range(20)]
    passages = ["".join(" " + "".join(rng.choices("klmnop", k=k)) for _ in range(51))[1:] for k in (9, 8, 7, 6, 4, 2)]
    assert sorted(map(len, passages)) == [152, 254, 356, 407, 458, 509]
    texts = clean + [prose(rng, 40) + " " + p + " " + prose(rng, 30) for p in passages for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_array.remove_repeats(df, keep=("doc_id",)).collect()}
    assert [got[i].kept_text for i in range(len(clean))] == clean
    for i, p in enumerate(p for p in passages for _ in range(2)):
        r = got[len(clean) + i]
        assert (p in r.kept_text, r.n_removed > 0) == ((True, False) if len(f" {p} ") < 400 else (False, True))
    assert [got[i].n_bytes for i in range(len(texts))] == [len(t) for t in texts]


def test_passages_under_400_bytes(spark, tmp_path):
    """The query tells of repeated passages of 51 words of any length beside its repeats of 400 bytes:
    bytes of those against counting, the other columns as they are by 400 bytes alone."""
    rng = random.Random(21)
    word = lambda k: "".join(rng.choices("klmnopé", k=k))
    clean = [prose(rng, 150) for _ in range(10)]
    passages = [" ".join(word(k) for _ in range(n)) for k, n in ((1, 51), (2, 60), (4, 55), (5, 51), (9, 51), (4, 50))]
    texts = clean + [prose(rng, 40) + " " + p + " " + prose(rng, 30) for p in passages for _ in range(2)]
    texts += [passages[1] + "\n" + passages[1], passages[0], passages[2].replace(" ", "  "), None, "", clean[0] + " " + passages[3]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_array.op9_suffix_array(spark, str(tmp_path)).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == removed(texts, 400)
    places = [suffix_array.word_places(t or "") for t in texts]
    windows = [[(int(a), int(b)) for a, b in zip(s, e[50:])] for _, s, e in places]
    seen = Counter(places[i][0][a:b] for i, w in enumerate(windows) for a, b in w)
    strings = Counter(d[k : k + 400] for d, *_ in places for k in range(len(d) - 399))
    for i, (d, *_) in enumerate(places):
        gone = {x for a, b in windows[i] if seen[d[a:b]] > 1 for x in range(a, b)}
        gone |= {x for k in range(len(d) - 399) if strings[d[k : k + 400]] > 1 for x in range(k, k + 400)}
        assert got[i].n_passage_bytes == len(gone)
    assert [got[i].n_passage_bytes > 0 for i in range(10, 22)] == [True] * 10 + [False] * 2
    assert sum(got[i].n_removed == 0 < got[i].n_passage_bytes for i in got) > 6


@pytest.mark.parametrize("copies,words", [(50, 0), (50, 12)])
def test_rows_repeated_in_full(spark, copies, words):
    """Any number of equal rows beside rows that share parts with them, against counting."""
    rng = random.Random(6)
    body = lambda n: "".join(rng.choices("abcdefgh    ", k=n))
    one, two = body(1500), body(900)
    texts = [one] * copies + [two] * 2 + [one[200:700] + body(300) + two[:450], body(700), one[:399], "short"] + ["same " * 3] * 5
    df = spark.createDataFrame([(7 if t in (one, two) else i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array.remove_repeats(df, size=400, keep=("doc_id",), words=words).collect())
    if not words:
        assert got == sorted(removed(texts, 400))
    else:
        assert len(got) == len(texts) and sum(r[:2] == (1500, 1500) for r in got) == copies


def test_thousands_of_equal_rows(spark):
    text = prose(random.Random(1), 1100)
    assert len(text) > 5000
    df = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    began = time.time()
    (got,) = suffix_array.remove_repeats(df, keep=("doc_id",)).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert tuple(got) == (len(text), len(text), 1, 5000) and time.time() - began < 120


@pytest.mark.parametrize("stretch", [40, 4000])
def test_repeated_words(spark, monkeypatch, stretch):
    """Windows of short words in all their places, against counting them, in many contexts."""
    monkeypatch.setattr(suffix_array, "STRETCH", stretch)
    rng = random.Random(stretch)
    pool = ["a", "bé", "c d", "e", "ff", "g\u00a0h", "i"]
    passage = [rng.choice("abcdefgh") for _ in range(60)]
    texts = []
    for i in range(30):
        w = [rng.choice(pool) for _ in range(rng.randint(0, 50))]
        k, n = rng.randrange(40), rng.randrange(5, 60)
        w[len(w) // 2 : len(w) // 2] = passage[k : k + n]
        texts.append(rng.choice([" ", "\t"]).join(w) + rng.choice(["", " " * 90 + "x" * 70 + " y"]))
    texts += [" ".join(passage), " ".join(passage), None, "", "z " * 45, " ".join(passage) + "  " + " ".join(passage), " ".join(passage) + " " + "q" * 300_000, "q" * 300_000 + " " + " ".join(passage)]
    words_, size = 12, 60
    places = [suffix_array.word_places(t or "") for t in texts]
    wanted = lambda i: [(int(a), int(b)) for a, b in zip(places[i][1], places[i][2][words_ - 1 :]) if b - a < size]
    seen = Counter(places[i][0][a:b] for i in range(len(texts)) for a, b in wanted(i))
    want = {i: suffix_array.merged([{"s": a, "n": b - a} for a, b in wanted(i) if seen[places[i][0][a:b]] > 1]) for i in range(len(texts))}
    df = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3)
    got = {}
    for r in suffix_array.repeated_words(df, words_, size).collect():
        got.setdefault(r.key, []).append(r.span.asDict())
    assert {i: suffix_array.merged(got.get(i, [])) for i in want} == want and any(want.values())


@pytest.mark.parametrize("small", [1, 8, 5000])
def test_multikey_quicksort(small):
    rng = np.random.default_rng(small)
    for high in (2, 5, 1 << 40):
        tokens = [rng.integers(0, high, 3000) for _ in range(3)]
        got = suffix_array.multikey_quicksort(tokens, max(small, 31))
        rows = list(zip(*(t.tolist() for t in tokens)))
        assert [rows[i] for i in got] == sorted(rows)


def test_long_groups_of_equal_suffixes():
    """A group that fills a bucket is told whole; its first row stands for it at the edge."""
    n = 10_000
    t1, t2s = np.array([5] * n + [9, 1], np.uint64), np.concatenate([np.arange(n), [0, 0]]).astype(np.uint64)
    whole = pa.RecordBatch.from_arrays([pa.array(t1.view(np.int64)), pa.array(t2s.view(np.int64)), pa.array(np.zeros(n + 2, np.int64))], names=["t1", "t2s", "key"])
    told = pa.Table.from_batches(list(suffix_array._sort_and_compare(whole.slice(k, 3000) for k in range(0, n + 2, 3000))))
    rows = list(zip(told["t1"].to_pylist(), told["s"].to_pylist(), told["edge"].to_pylist()))
    assert sorted(s for t, s, e in rows if t == 5) == list(range(n)) and {t for t, _, e in rows if e} == {1, 9}
    alone = pa.Table.from_batches(list(suffix_array._sort_and_compare([whole.slice(0, n)])))
    assert alone["edge"].to_pylist() == [True] + [False] * (n - 1) and alone["n"].to_pylist()[0] == 2


# --- empty tables and repeated rows of the others


def test_empty_tables(no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert token_counts.prefix_counts(no_docs, keep=("doc_id",)).count() == 0
    assert decontamination.contamination(no_docs, none, keep=("doc_id",)).count() == 0
    assert packing.pack(no_docs, keep=("doc_id",)).count() == 0
