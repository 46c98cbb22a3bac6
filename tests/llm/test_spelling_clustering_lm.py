"""Spelling variants, centroid clustering and LM scoring against brute force, on fixtures with nulls, empty
and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docmetrics.llm import attention_lm, clustering, spelling

DOCS = "doc_id long, text string, word string, n long, id long, key long, row long, learn string"


# --- spelling variants ---

def damaged(rows):
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants(words, ratio=10):
    by = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, some in by.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(by[w]), words[form[w]] if form[w] else None)
    return out


def vocabulary(rng, n, letters="abcdefé", sizes=(7, 8, 9, 10, 14)):
    some = ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(n)]
    for w in some[:n // 2]:  # variants of variants, and words of one letter only
        i = rng.randrange(len(w))
        some += [w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]]
    return some + ["a" * k for k in range(7, 13)] + ["ab" * k for k in range(4, 8)] + ["ÿ" * 7, "×÷×÷×÷×", "ÀÀÀÀÀÀÀ"]


def test_spelling_variants_equal_all_pairs(spark):
    rng = random.Random(4)
    words = vocabulary(rng, 300)
    weight = [rng.choice((1, 1, 1, 3, 30, 400)) for _ in words]
    texts = [", ".join(rng.choices(words, weight, k=rng.randrange(200))) + " Tail" for _ in range(120)]
    texts += ["chainaaa chainaaa " + "chainaab " * 30 + "chainabb " * 900] * 2  # forms of forms
    texts += [None, "", "short one 1234567", "x" * 300_000 + " " + "x" * 300_000, ("Abcdefgh " * 150_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, None)]
    docs = spark.createDataFrame([(i, t, "w", 1, 2, 3, 4, "l") for i, t in rows], DOCS).repartition(4)
    want = variants(damaged(rows))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs).collect()}
    assert got == want
    assert any(f and r != f for f, r, *_ in want.values()), "no chain of forms in the fixture"


def test_spelling_of_empty_tables_and_ties(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).collect() == []
    words = spark.createDataFrame([("abcdefg", 1), ("abcdefh", 10), ("abcdefi", 10), ("abcdefgé", 10)], "word string, n long")
    got = {r["word"]: r for r in spelling.group_variants(words).collect()}
    assert (got["abcdefg"]["form"], got["abcdefg"]["n_near"]) == ("abcdefgé", 3)  # ties: the first in code-point order
    assert got["abcdefh"]["form"] is None and got["abcdefh"]["n_near"] == 2


@pytest.mark.parametrize("least", [0, 2, 8, 10**9])
def test_no_near_pair_is_lost_whatever_the_dictionary(least):
    """The bound on touched grams holds for dictionaries of any depth: every near pair shares a list."""
    rng = random.Random(least % 97)
    words = [w for w in dict.fromkeys(vocabulary(rng, 250, letters="abc", sizes=(1, 2, 3, 5, 7, 9))) if w]
    parts = [spelling._codes(x, n).ravel() for _, x in spelling._by_length(words) for n in range(spelling.QMIN, spelling.QMAX + 1) if x.shape[1] >= n]
    gram, n = np.unique(np.concatenate(parts), return_counts=True)
    grams = spelling.GramDictionary(gram[n > least], n[n > least])
    lists, asked = {}, {}
    for own, x in spelling._by_length(words):
        row, key, probe = grams.keys(x)
        for i, k, p in zip(own[row].tolist(), key.tolist(), probe.tolist()):
            asked.setdefault(i, set()).add(k)
            if not p:
                lists.setdefault(i, set()).add(k)
    for i, a in enumerate(words):
        for j, b in enumerate(words[:i]):
            if near(a, b):
                assert asked[i] & lists[j] or asked[j] & lists[i], (a, b)


# --- centroid clustering ---

VECTORS = "vec_id long, embedding array<float>, id long, v string, cluster string"


def lloyd(rows, k, rounds, width, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b)**2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = [c for _, c in assign()]
        centroids = [[sum(x) // own.count(c) for x in zip(*(v for (_, v), o in zip(kept, own) if o == c))] if c in own else centroids[c]
                     for c in range(len(centroids))]
    last = assign()
    total = Counter()
    for d, c in last:
        total[c] += d
    return sorted(((-1 if i is None else i), c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
                  for (i, _), (d, c) in zip(kept, last))


def clustered(df):
    return sorted((-1 if r["id"] is None else r["id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


@pytest.mark.parametrize("k,rounds", [(4, 3), (16, 3), (5, 0), (200, 2)])
def test_clustering_equals_lloyd_from_scratch(spark, k, rounds):
    rng = random.Random(k)
    rows = [(i, [rng.choice((-1.5, 0.0, 2.25)) + rng.gauss(0, 0.3) for _ in range(6)]) for i in range(90)]
    rows += [(100 + i, [0.5] * 6) for i in range(40)]  # a third of all rows
    rows += [(7, rows[7][1]), (8, [9.0] * 6), (None, [1.0] * 6), (200, None), (201, []), (202, [1.0] * 5), (203, [None] + [1.0] * 5),
             (204, [float("nan")] * 6), (205, [float("inf")] + [1.0] * 5), (206, [-1e-9] * 6)]
    df = spark.createDataFrame([(i, v, 5, "v", "c") for i, v in rows], VECTORS).repartition(5)
    assert clustered(clustering.cluster_vectors(df, k=k, rounds=rounds, width=6)) == lloyd(rows, k, rounds, 6)


def test_clustering_updates_products_where_components_changed(spark):
    """The products after a step equal those computed from scratch, and a centroid that stays costs nothing."""
    rng = np.random.default_rng(1)
    v = rng.integers(-500, 500, (50, 8))
    old, new = rng.integers(-500, 500, (3, 8)), None
    new = old.copy()
    new[1, 2] += 5
    new[2] -= 7
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<int>")
    state = clustering.advance(clustering.start(df, old), old, new)
    scratch = {r["id"]: r for r in clustering.start(df, new).collect()}
    for r in state.collect():
        assert (r["dots"], r["cluster"], r["distance"]) == tuple(scratch[r["id"]][c] for c in ("dots", "cluster", "distance"))


def test_clustering_of_empty_and_unfit_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    out = clustering.cluster_vectors(empty)
    assert out.collect() == [] and out.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    unfit = spark.createDataFrame([(1, [1e30] * 64, 1, "", ""), (2, None, 1, "", "")], VECTORS)
    assert clustering.cluster_vectors(unfit).collect() == []


# --- LM scoring ---

def tokens(text):
    return (text or "").encode().lower().split() + [None]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def lm_rows():
    rng = random.Random(2)
    pairs = [("alpha", "beta"), ("gamma", "delta"), ("one", "two"), ("Füße", "straße"), ("naïve", "café")]
    texts = [" ".join(w for _ in range(rng.choice([2, 30, 90])) for w in rng.choice(pairs)) for _ in range(150)]
    texts += [None, "", " \n\t ", "ALPHA Beta", "rare1 rare2 rare1", "a b   c", "y" * 3_000 + " alpha", "<|endoftext|> |!|", "."]
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (None, "alpha beta unseen"), (None, None)]
    return rows + [(1000 + i, "hot word") for i in range(60)]


@pytest.fixture(scope="module")
def lm_docs(spark):
    return spark.createDataFrame([(i, t, "w", 1, 2, 3, 4, "l") for i, t in lm_rows()], DOCS).repartition(3)


@pytest.mark.parametrize("heavy", [0, 3, 1 << 17])
def test_lm_base_equals_counts_over_all_learning_documents(lm_docs, heavy):
    rows = lm_rows()
    seen = Counter(t for i, x in rows if i is not None and not held(i) for t in tokens(x))
    n, v = sum(seen.values()), len(seen)
    want = Counter((i, held(i), len(tokens(x)), sum(t in seen for t in tokens(x)), n, round(sum(math.log10((seen[t] + 1) / (n + v + 1)) for t in tokens(x)), 6))
                   for i, x in rows)
    got = attention_lm.score_texts(lm_docs, heavy=heavy, most_windows=200).collect()
    assert Counter((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_lm_learns_the_order_of_words(spark, lm_docs):
    """Held-out texts are likelier than the same words in another order, and than an untrained model finds them."""
    rows = [(i, t) for i, t in lm_rows()] + [(5_000, "alpha beta " * 40), (5_001, "alpha alpha beta beta " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["score"] for r in attention_lm.score_texts(docs).collect()}
    blind = {r["id"]: r["score"] for r in attention_lm.score_texts(docs, most_windows=0).collect()}
    assert got[5_000] > got[5_001] + 10
    assert sum(got[i] for i, _ in rows if held(i)) > sum(blind[i] for i, _ in rows if held(i)) + 100


@pytest.fixture(scope="module")
def words():
    with open(attention_lm.default_vocabulary()) as f:
        return attention_lm.Subwords(f.read(), attention_lm.default_pattern())


def test_lm_probabilities_sum_to_one_and_windows_score_each_token_once(words):
    counts = np.random.default_rng(0).integers(0, 50, words.size)
    classes = attention_lm.Classes(counts, words.starts)
    share = 10**classes.share
    assert np.allclose(np.bincount(classes.of, share, minlength=attention_lm.CLASSES)[np.unique(classes.of)], 1)
    ids = np.arange(100, 200, dtype=np.int32)
    bounds = np.array([0, 0, 15, 16, 32, 33, 100])
    x, target, doc = attention_lm.windows(ids, bounds, classes)
    for d in range(6):
        own = target[doc == d].ravel()
        assert own[own >= 0].tolist() == [*ids[bounds[d]:bounds[d + 1]].tolist(), words.size]
    model = attention_lm.Attention()
    rng = np.random.default_rng(1)
    for name in ("group", "group_bias", "member", "member_bias", "b"):
        model.p[name] = rng.normal(0, 0.3, model.p[name].shape).astype(np.float32)
    model.fold()
    every = np.arange(words.size + 1)
    h = np.repeat(model.attend(x[:1])[4][:, :1], len(every), axis=0)
    ln = model.outcome(h, classes.of[every], classes)[0]
    assert abs((np.exp(ln.astype(float)) * share).sum() - 1) < 1e-4


def test_lm_classes_of_small_and_one_sided_vocabularies():
    """Classes without a subword get no probability, so it still sums to one."""
    for size, starts in ((5, np.zeros(5, bool)), (700, np.ones(700, bool)), (3, np.array([True, False, True]))):
        classes = attention_lm.Classes(np.arange(size), starts)
        model = attention_lm.Attention()
        every = np.arange(size + 1)
        ln = model.outcome(np.ones((len(every), 1, attention_lm.HIDDEN), np.float32), classes.of[every], classes)[0]
        assert abs((np.exp(ln.astype(float)) * 10**classes.share).sum() - 1) < 1e-4


def test_lm_attention_is_causal_and_equals_a_plain_loop(words):
    """One place at a time, by the definition, equals the batched masked windows; later subwords change nothing."""
    classes = attention_lm.Classes(np.random.default_rng(0).integers(0, 50, words.size), words.starts)
    model = attention_lm.Attention()
    rng = np.random.default_rng(3)
    for name, w in model.p.items():
        model.p[name] = (w + rng.normal(0, 0.2, w.shape)).astype(np.float32)
    model.fold()
    ids = rng.integers(0, 3_000, 45).astype(np.int32)
    x, target, _ = attention_lm.windows(ids, np.array([0, 45]), classes)
    got = model.log_probabilities(x, target, classes).sum()
    p = {n: w.astype(float) for n, w in model.p.items()}
    given = [words.size, *ids.tolist()]
    total, step = 0.0, attention_lm.STEP
    for t, aim in enumerate([*ids.tolist(), words.size]):
        block = t // step
        at = [(j, j - (block - 1) * step) for j in range(max(0, (block - 1) * step), t + 1)]
        e = np.array([p["emb"][classes.input[given[j]]] for j, _ in at])
        pos = np.array([p["pos"][slot] for _, slot in at])
        q = (e[-1] + pos[-1]) @ p["q"] / attention_lm.KEY**0.5
        a = np.exp((e + pos) @ p["k"] @ q)
        h = np.maximum((a / a.sum()) @ (e @ p["v"]) + (e[-1] + pos[-1]) @ p["r"] + p["b"], 0)
        group, member = divmod(int(classes.of[aim]), attention_lm.MEMBERS)
        for out, hit in ((h @ p["group"] + p["group_bias"], group), (h @ p["member"][group] + p["member_bias"][group], member)):
            total += (out[hit] - np.log(np.exp(out).sum())) / np.log(10)
        total += classes.share[aim]
    assert abs(got - total) < 1e-2
    changed = ids.copy()
    changed[40:] = 7
    y, aims, _ = attention_lm.windows(changed, np.array([0, 45]), classes)
    assert np.allclose(model.log_probabilities(x[:2], target[:2], classes), model.log_probabilities(y[:2], aims[:2], classes))


def test_lm_gradients_equal_differences(words, monkeypatch):
    classes = attention_lm.Classes(np.random.default_rng(0).integers(0, 50, words.size), words.starts)
    model = attention_lm.Attention()
    rng = np.random.default_rng(5)
    for n, w in model.p.items():
        model.p[n] = (w + rng.normal(0, 0.2, w.shape)).astype(np.float64)
    model.later, = (model.later.astype(np.float64),)
    model.fold()
    x, target, _ = attention_lm.windows(rng.integers(0, 3_000, 60).astype(np.int32), np.array([0, 25, 60]), classes)

    def loss():
        model.fold()
        aim = target.ravel()
        return -model.outcome(model.attend(x)[4], classes.of[aim], classes)[0][aim >= 0].mean()
    g = model.gradients(x, target, classes)
    for n, w in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w.shape) if n != "emb" else (int(x[0, -1]), int(rng.integers(0, w.shape[1])))
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - g[n][at]) < 2e-4, n


def test_lm_long_texts_are_scored_whole(spark, words, monkeypatch):
    """A text taken in pieces and slices has the same subwords as the whole text."""
    rng = random.Random(8)
    long = " ".join(rng.choice(["alpha", "beta", "straße", "x" * 40, "q"]) for _ in range(4_000)) + "\n" + "z" * 9_000 + " end"
    column = pa.array(["short one", long, None, "", "tail"])
    want = [(r, ids[a:b].tolist()) for rows, ids, bounds, _ in attention_lm._texts(column, words) for r, a, b in zip(rows, bounds, bounds[1:])]
    monkeypatch.setattr(attention_lm, "PIECE", 1_000)
    monkeypatch.setattr(attention_lm, "SLICE", 2_500)
    words._forget()
    got = [(r, ids[a:b].tolist()) for rows, ids, bounds, _ in attention_lm._texts(column, words) for r, a, b in zip(rows, bounds, bounds[1:])]
    assert got == want and [r for r, _ in got] == [0, 1, 2, 3, 4]
    assert got[0][1] == words.encoding.encode_ordinary(" short one") and got[2][1] == []


def test_lm_of_empty_tables_and_tables_without_learning_documents(spark):
    out = attention_lm.score_texts(spark.createDataFrame([], DOCS))
    assert out.collect() == [] and out.columns == ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    alone = next(i for i in range(100) if held(i))
    got = attention_lm.score_texts(spark.createDataFrame([(alone, "one two")], "doc_id long, text string")).first()
    assert (got["n_tokens"], got["n_known"], got["train_tokens"], got["base_score"]) == (3, 0, 0, 0.0) and got["score"] < 0


def test_lm_learns_from_every_window_of_a_document(spark, words):
    """No window is left out: another word anywhere in a long text, or in a document more, gives other weights."""
    with open(attention_lm.default_vocabulary()) as f:
        definition = spark.sparkContext.broadcast((f.read(), attention_lm.default_pattern(), 11))
    classes = spark.sparkContext.broadcast(attention_lm.Classes(np.zeros(words.size, np.int64), words.starts))

    def fitted(*texts):
        docs = spark.createDataFrame([(1, t, True) for t in texts] + [(2, "never learned", False)], "id long, text string, learn boolean").coalesce(1)
        return attention_lm.fit_corpus(docs, np.zeros(attention_lm.CLASSES), classes, definition).flat()

    text = ["alpha", "beta"] * 3_000
    whole = fitted(" ".join(text))
    assert (whole == fitted(" ".join(text))).all()
    for at in (0, 3_111, 5_999):
        assert (whole != fitted(" ".join([*text[:at], "gamma", *text[at + 1:]]))).any()
    assert (whole != fitted(" ".join(text), None)).any()


def test_lm_texts_are_encoded_once(spark, lm_docs, monkeypatch):
    """Counting, the rounds of learning and scoring read the subwords that one pass over the texts has written."""
    read, fit, count = [], attention_lm.fit_corpus, attention_lm.count_corpus
    encode = attention_lm.encode_texts
    monkeypatch.setattr(attention_lm, "encode_texts", lambda docs, *a: read.append("texts") or encode(docs, *a))
    monkeypatch.setattr(attention_lm, "count_corpus", lambda docs, *a: read.append(docs.columns) or count(docs, *a))
    monkeypatch.setattr(attention_lm, "fit_corpus", lambda docs, *a: read.append(docs.columns) or fit(docs, *a))
    out = attention_lm.score_texts(lm_docs, most_windows=20)
    assert read == ["texts", ["learn", "ids"], ["learn", "deal", "ids"]] and out.count() == len(lm_rows())


def test_lm_stored_subwords_are_those_of_the_texts_and_words_have_one_key(spark, words, monkeypatch):
    """Runs of any length hold all subwords, also of a slice of a batch; a word has the same key wherever it is, and no other word has it."""
    texts = ["one two one", None, "", "TWO zwei\u00a0drei " + "y" * 2_500 + " two", "zwei\u00a0drei\tzwei", " " + "two\n" * 300]
    with open(attention_lm.default_vocabulary()) as f:
        definition = spark.sparkContext.broadcast((f.read(), attention_lm.default_pattern(), 12))
    docs = spark.createDataFrame([(i, i != 4, t) for i, t in enumerate(texts)], "id long, learn boolean, text string").coalesce(1)
    stored = attention_lm.encode_texts(docs, definition).orderBy("id").toArrow()
    assert stored.column_names == ["id", "learn", "deal", "ids"] and stored["learn"].to_pylist() == [True] * 4 + [False, True]
    column = stored["ids"].combine_chunks()
    want = [[i for t in tokens(x)[:-1] for i in words._one(t.decode())] for x in texts]
    for run in (1, 100, 1 << 19):
        monkeypatch.setattr(attention_lm, "RUN", run)
        for part in (0, 2, 5):
            got = [(part + r, ids[a:b].tolist()) for rows, ids, bounds in attention_lm._runs(column.slice(part), words.size) for r, a, b in zip(rows, bounds, bounds[1:])]
            assert got == [*enumerate(want)][part:]
        seen = {}
        for rows, ids, bounds in attention_lm._runs(column, words.size):
            of, keys = attention_lm.word_keys(ids, bounds, words.starts)
            for r, key in zip(rows[of].tolist(), keys.tolist()):
                seen.setdefault(r, []).append(key)
        pairs = {(k, t) for r, x in enumerate(texts) for k, t in zip(seen.get(r, []), tokens(x)[:-1], strict=True)}
        assert len(pairs) == len({k for k, _ in pairs}) == len({t for _, t in pairs}) == 5


def test_lm_steps_of_one_window_and_of_many_equal_sums_of_their_parts(words):
    """The gradient of some windows is the mean of that of each, weighted by its targets, also where an embedding comes once or in all."""
    classes = attention_lm.Classes(np.random.default_rng(0).integers(0, 50, words.size), words.starts)
    model = attention_lm.Attention()
    rng = np.random.default_rng(7)
    x, target, _ = attention_lm.windows(np.append(rng.integers(0, 3_000, 80), [5] * 20).astype(np.int32), np.array([0, 25, 60, 60, 100]), classes)
    whole, n = model.gradients(x, target, classes), (target >= 0).sum(axis=1)
    each = [model.gradients(x[i:i + 1], target[i:i + 1], classes) for i in range(len(x))]
    for name, g in whole.items():
        assert np.allclose(g, sum(m * e[name] for m, e in zip(n, each)) / n.sum(), atol=1e-5), name
