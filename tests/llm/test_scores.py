import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import ann, langid, lm_scoring, packing, quality_classifier, quality_rules, queries
from plumbline.llm.kernel import Texts


def base_of(t):
    t = t or ""
    w = t.encode().split()
    full = [x for x in t.split("\n") if x.encode().split()]
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if win[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    rep = sum(hit)
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), rep, len(w) < 10 or 100 * rep > 20 * len(w))


@pytest.mark.parametrize("table", ["edge", "docs"])
def test_base_counts(spark, sf, table, request):
    df = request.getfixturevalue(table)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Counter(tuple(r)[:7] for r in quality_rules.judge(df, labels).collect())
    assert got == Counter((r.doc_id, *base_of(r.text)) for r in df.collect())


def test_rules_and_classifier_tell_labels_apart(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    y = {r.doc_id: r.quality for r in labels.collect()}
    for found in (quality_rules.judge(docs, labels), quality_classifier.report(docs, labels, *queries.site())):
        rows = [(y[r.doc_id], r.kept) for r in found.collect() if r.doc_id in y]
        assert np.mean([bool(a) == b for a, b in rows]) > 0.9
        assert np.mean([b for a, b in rows if a]) > 0.93


def test_classifiers_without_labels_and_documents(spark, edge, none):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    rows = quality_classifier.report(edge, labels, *queries.site()).collect()
    assert len(rows) == edge.count()
    assert {r.kept for r in rows if r.doc_id in (3, 4, 5)} == {False}
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_classifier.report(none, labels, *queries.site()).count() == 0
    kept = quality_classifier.kept_documents(edge, labels, *queries.site())
    assert kept.columns == edge.columns


def test_priors_shrink_sparse_paths(spark):
    rows = [("a", "x", 1)] * 60 + [("a", "y", 0)] + [("b", "x", 0)] * 40 + [("b", "z", 1)] * 20
    p = quality_classifier.priors(spark.createDataFrame(rows, "host string, path string, y int"))
    ask = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("a", "new"), ("b", "new"), ("new", "x")], "_host string, _path string").withColumn("_y", F.lit(None).cast("int")).withColumn("bins", F.array(F.lit(0)))
    odds = {(r._host, r._path): r.prior_odds for r in quality_classifier.Model(p, [[(0, 0)]]).score(ask).collect()}
    assert odds["a", "new"] > odds["new", "x"] > odds["b", "new"]
    assert odds["b", "x"] < odds["a", "y"] < odds["a", "new"]
    assert odds["a", "x"] > odds["a", "new"]


def brute_classifier(rows, y):
    """doc_id, p_good of rows (doc_id, text, host, path) with labels y, in plain Python; a label never counts for its own row."""
    shapes = [None if not (t or "").encode().split() else [int(np.digitize(v, quality_classifier.EDGES[f])) for f, v in zip(quality_classifier.FEATURES, brute_shape(t))] for _, t, _, _ in rows]
    held = lambda p: min(1 - 1e-4, max(1e-4, p))

    def weight(groups, mean_of):
        few = {k: v for k, v in groups.items() if len(v) > 1}
        if not few:
            return 1.0
        share = np.array([np.mean(v) for v in few.values()])
        mean = np.array([mean_of(k) for k in few])
        inner = mean * (1 - mean)
        between = np.var(share) - np.mean(inner / [len(v) for v in few.values()])
        return min(1000.0, max(1.0, np.mean(inner) / max(between, 1e-6) - 1))

    known = [(i, y[r[0]]) for i, r in enumerate(rows) if r[0] in y]
    hosts, paths = {}, {}
    for i, v in known:
        hosts.setdefault(rows[i][2], []).append(v)
        paths.setdefault(rows[i][2:], []).append(v)
    mean = (sum(v for _, v in known) + 1) / (len(known) + 2)
    m = weight(hosts, lambda k: mean)
    under = {h: held((sum(v) + m * mean) / (len(v) + m)) for h, v in hosts.items()}
    m2 = weight(paths, lambda k: under[k[0]])
    seen = [{s[k] for i, _ in known if (s := shapes[i])} for k in range(len(quality_classifier.FEATURES))]
    out = []
    for i, (doc, _, host, path) in enumerate(rows):
        others = [(j, v) for j, v in known if j != i]
        mine = sum(v for j, v in known if j == i)
        n = len(known) - len(others)
        root = (sum(v for _, v in known) - mine + 1) / (len(known) - n + 2)
        p = root if host not in hosts else held((sum(hosts[host]) - mine + m * root) / (len(hosts[host]) - n + m))
        p = held(p)
        if (host, path) in paths:
            p = held((sum(paths[host, path]) - mine + m2 * p) / (len(paths[host, path]) - n + m2))
        if shapes[i] is None:
            out.append((doc, 0.0))
            continue
        odds = math.log(p / (1 - p))
        for k, b in enumerate(shapes[i]):
            good = sum(v for j, v in others if shapes[j] and shapes[j][k] == b)
            bad = sum(1 - v for j, v in others if shapes[j] and shapes[j][k] == b)
            all_good = sum(v for j, v in others if shapes[j])
            all_bad = sum(1 - v for j, v in others if shapes[j])
            if good + bad:
                odds += quality_classifier.TEMPER * math.log((good + 1) / (all_good + len(seen[k]) + 1) / ((bad + 1) / (all_bad + len(seen[k]) + 1)))
        out.append((doc, 1 / (1 + math.exp(-odds))))
    return out


def brute_shape(t):
    b = t.encode()
    w = b.split()
    chars = sum(len(x.decode()) for x in w)
    n = len(w)
    natural = math.sqrt(400 / n) if n > 400 else 1
    same = sum(x == z for x, z in zip(w, w[1:]))
    return [sum(65 <= c < 91 for c in b) / chars, sum(c in b"#*$%&<>!@^~{}[]\\" for c in b) / chars, b.count(b"|") / chars, min(1, len(set(w)) / n / natural), same / n, chars / n]


@pytest.mark.parametrize("table", ["edge", "docs"])
def test_classifier_equals_brute_force(spark, sf, table, request):
    df = request.getfixturevalue(table)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    y = {r.doc_id: r.y for r in quality_rules.labelled(labels).collect()}
    if table == "edge":  # rows that share an id would each take out one label only
        df = df.where("doc_id is null or doc_id not in (9, 18)")
    got = sorted(((r.doc_id, round(r.p_good, 9)) for r in quality_classifier.report(df, labels, *queries.site()).collect()), key=str)
    want = sorted(((i, round(p, 9)) for i, p in brute_classifier([(r.doc_id, r.text, r.source, r.lang) for r in df.collect()], y)), key=str)
    assert len(got) == len(want)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-8 for a, b in zip(got, want))


def test_kept_documents_are_those_reported(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    want = {r.doc_id for r in quality_classifier.report(docs, labels, *queries.site()).collect() if r.kept}
    assert {r.doc_id for r in quality_classifier.kept_documents(docs, labels, *queries.site()).collect()} == want


def brute_margin(t, weights, bias):
    """The rules' margin of one text alone: shares of words, word pairs and code point trigrams."""
    w = [pa.array([x.decode()]) for x in (t or "").encode().split()]
    one = lambda column: Texts(column)
    texts = one(pa.array([t], pa.string()))
    words = texts.hashes(0)
    assert len(words) == len(w)
    out = bias
    kinds = quality_rules.ngrams(texts, words)
    assert len(kinds[2][0]) == max(0, len(t or "") - 2)
    for kind, (bucket, _) in enumerate(kinds):
        out += quality_rules.SCALE * sum(float(weights[kind][b]) for b in bucket) / max(1, len(bucket))
    return out


def test_margins_alone_and_together(edge):
    texts = [r.text for r in edge.collect()] + ["a bc", "zz top", "qq", "日本"]
    weights = np.random.default_rng(4).normal(size=(quality_rules.KINDS, 1 << quality_rules.BITS)).astype(np.float32)
    t = Texts(pa.array(texts, pa.string()))
    together = quality_rules.margins(t, t.hashes(0), weights, 0.5)
    for text, z in zip(texts, together):
        alone = Texts(pa.array([text], pa.string()))
        assert quality_rules.margins(alone, alone.hashes(0), weights, 0.5)[0] == z
        assert abs(brute_margin(text, weights, 0.5) - z) < 1e-6


def test_verdicts_follow_the_fitted_model(spark, edge, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_rules.train(docs, labels)
    for r in quality_rules.judge(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        p = 1 / (1 + math.exp(-max(-50, min(50, model["a"] * brute_margin(r.text, model["weights"], model["bias"]) + model["b"]))))
        assert abs(p - r.p_good) < 1e-6
        assert r.kept == (not r.base_failed and r.p_good >= quality_rules.KEEP)


TOKENS = queries.tokenizer_path("byte_bpe_50k.tiktoken")


def pattern():
    import public_tokenizers

    return public_tokenizers.PATTERN


@pytest.mark.parametrize("table", ["edge", "docs"])
def test_base_scores(table, request):
    df = request.getfixturevalue(table)
    learn = queries.remainder("doc_id", 10) != 0
    rows = df.select("doc_id", "text").collect()
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    split = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for r in rows if train(r.doc_id) for w in split(r.text))
    n, v = sum(c.values()), len(c)
    want = sorted((r.doc_id or -1, len(split(r.text)), sum(c[w] > 0 for w in split(r.text)), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(r.text)), 5)) for r in rows)
    got = lm_scoring.score(df, learn, TOKENS, pattern()).collect()
    assert {r.train_tokens for r in got} == {n}
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_nothing_to_score(none):
    assert lm_scoring.score(none, F.lit(True), TOKENS, pattern()).count() == 0


def small_model():
    rng = np.random.default_rng(0)
    texts = [np.append(rng.choice([1, 2, 3] if k % 2 else [4, 5, 6], 90), 9).astype(np.int32) for k in range(60)]
    return lm_scoring.fit(texts, 10), texts


def test_model_is_a_distribution_and_learns():
    m, texts = small_model()
    stream = texts[0][:5]
    total = sum(10 ** m.scores(np.append(stream, i).astype(np.int32), np.array([0, 6]))[0] for i in range(10))
    assert abs(total - 10 ** m.scores(stream, np.array([0, 5]))[0]) < 1e-4 * total
    s = m.scores(texts[1], np.array([0, len(texts[1])]))[0]
    assert s / len(texts[1]) > math.log10(1 / 6)  # context tells the group


def test_windows_score_each_token_once_and_causally():
    m, texts = small_model()
    a = np.concatenate(texts[:4])
    edge = np.append(0, np.cumsum([len(t) for t in texts[:4]]))
    apart = [m.scores(t, np.array([0, len(t)]))[0] for t in texts[:4]]
    assert np.allclose(m.scores(a, edge), apart, atol=1e-4)
    first, behind, ahead = lm_scoring.windows(edge)
    at = np.concatenate([np.arange(f, f + n) for f, n in zip(first, ahead)])
    assert (np.sort(at) == np.arange(len(a))).all()
    short, longer = texts[0][:30], texts[0][:40]
    assert m.scores(longer, np.array([0, 40]))[0] <= m.scores(short, np.array([0, 30]))[0] + 1e-6


def test_held_out_score_beats_uniform(docs):
    got = lm_scoring.score(docs, queries.remainder("doc_id", 10) != 0, TOKENS, pattern()).where(queries.remainder("doc_id", 10) == 0).collect()
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > -8


def test_scores_do_not_depend_on_tasks(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").union(spark.createDataFrame([(7, "words again", "en", "s", 1), (7, "words again", "en", "s", 1), (None, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    of = lambda n: sorted((r.doc_id or -1, r.n_tokens, r.score, round(r.base_score, 6)) for r in lm_scoring.score(df.repartition(n), queries.remainder("doc_id", 10) != 0, TOKENS, pattern()).collect())
    one = of(1)
    assert len(one) == df.count() and one == of(4) == of(16)


def test_query_equals_fit_in_memory(spark, docs):
    """The Spark job gives what the same steps in memory give: scores of score() against fit() on the same texts."""
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    words, train = lm_scoring.subwords(TOKENS, pattern()), lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    t = Texts(pa.array([x for _, x in rows], pa.string()), lower=True)
    out, n, *_ = words.of(t)
    stream, edge = lm_scoring.id_stream(out, n, t.ptr, words.size)
    row = [r[0] for r in docs.select(lm_scoring.row_hash(F.col("text"))).collect()]
    turn = lm_scoring.mix(np.array([i for i, _ in rows], np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.array(row, np.int64).astype(np.uint64)) % np.uint64(lm_scoring.TURNS)
    few = [k for k, (i, _) in enumerate(rows) if train(i)]
    model = lm_scoring.fit([stream[edge[k] : edge[k + 1]] for k in few], words.size + 1, turn[few].tolist())
    want = {i: x for (i, _), x in zip(rows, model.scores(stream, edge).tolist())}
    got = {r.doc_id: r.score for r in lm_scoring.score(docs, queries.remainder("doc_id", 10) != 0, TOKENS, pattern()).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * abs(want[i]) for i in want)


def test_gradient_is_that_of_the_likelihood():
    """Against differences of the log likelihood that scores() gives."""
    m, texts = small_model()
    names = list(lm_scoring.WEIGHTS)
    rng = np.random.default_rng(4)
    p = {name: getattr(m, name).astype(np.float32) for name in names}
    stream, edge = lm_scoring.joined(texts[:6])
    target = m.symbol[stream]
    sums, at = lm_scoring.gradients(target, edge, p, m.pairs), 0
    flat = sums[:-1] / lm_scoring.GRAIN
    assert sums[-1] == len(stream)
    for name in names:
        shape = lm_scoring.WEIGHTS[name]
        g = flat[at : at + int(np.prod(shape))].reshape(shape)
        at += g.size
        way = np.where(np.abs(g) > 0, rng.choice([-1.0, 1.0], shape), 0)
        loss = lambda d: -lm_scoring.Model(**{**vars(m), name: (p[name] + d * way).astype(np.float32)}).scores(stream, edge).sum() * np.log(10)  # noqa: E731, B023
        assert abs((loss(0.01) - loss(-0.01)) / 0.02 - (g * way).sum()) < 0.05 * max(1.0, abs((g * way).sum()))


def plain_attention(p, pairs, target, edge, text, at):
    """Of one token, in 64-bit floats: the symbol before it, the places seen (their symbols and how far back), their weights, the gate, and what follows by expert."""
    a = edge[text]
    before = lambda i: lm_scoring.SYMBOLS if i == a else target[i - 1]
    first = a + (at - a) // lm_scoring.STRIDE * lm_scoring.STRIDE - (lm_scoring.CONTEXT - lm_scoring.STRIDE)
    places = range(max(a, first), at + 1)
    x, gap = np.array([before(i) for i in places]), np.array([at - i for i in places])
    own = before(at)
    w = np.exp(p["k"][x].astype(float) @ p["q"][own] + p["distance"][gap])
    w /= w.sum()
    z = w @ p["v"][x] + p["prior"][own]
    gate = np.exp(z - z.max())
    gate /= gate.sum()
    return own, x, gap, w, gate, gate * pairs[own, target[at]]


def test_scores_and_gradients_equal_plain_attention():
    """Texts of one token, shorter than, as long as and longer than a window, with weights that differ by symbol."""
    m, _ = small_model()
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 10, n).astype(np.int32) for n in (1, 2, 11, 12, 13, 28, 29, 40, 41, 57, 130)]
    stream, edge = lm_scoring.joined(texts)
    target = m.symbol[stream]
    p = {name: rng.normal(0, 0.7, shape).astype(np.float32) for name, shape in lm_scoring.WEIGHTS.items()}
    model = lm_scoring.Model(m.symbol, m.inner, m.pairs, **p)
    g, scores = {name: np.zeros(shape) for name, shape in lm_scoring.WEIGHTS.items()}, []
    for text in range(len(texts)):
        scores.append(0.0)
        for at in range(edge[text], edge[text + 1]):
            own, x, gap, w, gate, follows = plain_attention(p, m.pairs, target, edge, text, at)
            scores[-1] += (np.log(follows.sum()) + m.inner[stream[at]]) / np.log(10)
            dz = gate - follows / follows.sum()
            val = p["v"][x].astype(float)
            dw = w * (val @ dz - w @ val @ dz)
            g["prior"][own] += dz
            g["q"][own] += dw @ p["k"][x]
            np.add.at(g["k"], x, np.outer(dw, p["q"][own]))
            np.add.at(g["v"], x, np.outer(w, dz))
            np.add.at(g["distance"], gap, dw)
    assert np.allclose(model.scores(stream, edge), scores, rtol=1e-5, atol=1e-4)
    got = lm_scoring.gradients(target, edge, p, m.pairs)
    assert got[-1] == len(stream)
    assert np.allclose(got[:-1] / lm_scoring.GRAIN, np.concatenate([g[name].ravel() for name in lm_scoring.WEIGHTS]), atol=2e-3)


def test_texts_are_cut_into_windows_once(monkeypatch):
    """Not once for every batch, whose work would grow as the square of a block's windows; and batches of any size give the same."""
    m, texts = small_model()
    stream, edge = lm_scoring.joined(texts)
    p, calls, cut = {name: getattr(m, name) for name in lm_scoring.WEIGHTS}, [], lm_scoring.windows
    want = lm_scoring.gradients(m.symbol[stream], edge, p, m.pairs)
    monkeypatch.setattr(lm_scoring, "BATCH", 7)
    monkeypatch.setattr(lm_scoring, "windows", lambda edge: calls.append(1) or cut(edge))
    assert (lm_scoring.gradients(m.symbol[stream], edge, p, m.pairs) == want).all()
    assert len(calls) == 1


def test_distinct_hashes_are_those_of_unique():
    rng = np.random.default_rng(1)
    for h in (np.zeros(0, np.uint64), np.full(5, 2**64 - 1, np.uint64), rng.integers(0, 2**64, 900, np.uint64)[rng.integers(0, 900, 4000)]):
        for a, b in zip(lm_scoring.distinct_of(h), np.unique(h, return_index=True, return_inverse=True), strict=True):
            assert a.tolist() == b.tolist()


def test_sums_of_directions_are_those_of_their_groups():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, lm_scoring.SYMBOLS, n) for n in (0, 1, 5, 700, 3000)] * 3
    stream, edge = lm_scoring.joined(texts)
    x, own = lm_scoring.directions(stream.astype(np.int64), edge), np.arange(15) % 4
    want = np.zeros((6, lm_scoring.SYMBOLS), np.int64)
    np.add.at(want, own, np.rint(x * np.float32(lm_scoring.FINE)).astype(np.int64))
    assert (lm_scoring.fixed(x, own, 6) == want).all()


def test_gathered_equals_counts_in_memory(spark):
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(0, 9, rng.integers(0, 50)), 9).astype(np.uint16) for _ in range(150)]
    block = lambda x: (bytearray(np.concatenate(x).tobytes()), bytearray(np.array([len(t) for t in x], np.int32).tobytes()))
    df = spark.createDataFrame([block(texts[i : i + 7]) for i in range(0, 150, 7)], lm_scoring.BLOCK_OF_IDS).repartition(5)
    symbol, inner, counts = lm_scoring.gathered(df, np.uint16, 10)
    stream, _ = lm_scoring.joined(texts)
    want = lm_scoring.symbols_of(np.bincount(stream, minlength=10))
    assert (symbol == want[0]).all() and np.allclose(inner, want[1])
    pairs = Counter((int(symbol[a]) if k else lm_scoring.SYMBOLS, int(symbol[b])) for t in texts for k, (a, b) in enumerate(zip(np.append(0, t), t)))
    got = counts.reshape(lm_scoring.SYMBOLS + 1, lm_scoring.SYMBOLS, lm_scoring.EXPERTS).sum(axis=2)
    assert {(a, b): int(got[a, b]) for a, b in zip(*np.nonzero(got))} == pairs


def test_parts_of_many_tasks_are_added_up_in_steps(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FAN", 3)
    rows = [(bytearray(np.full(k % 5, k % 7, np.uint16).tobytes()), bytearray(np.array([k % 5], np.int32).tobytes())) for k in range(40)]
    df = spark.createDataFrame(rows, lm_scoring.BLOCK_OF_IDS).repartition(20)
    got = lm_scoring.summed_over(df, np.uint16, 10, lambda stream, edge: np.bincount(stream, minlength=10))
    assert got.tolist() == [sum(k % 5 for k in range(40) if k % 7 == i) for i in range(10)]


def test_attention_beats_its_tables_and_the_base(docs):
    held = queries.remainder("doc_id", 10) == 0
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    words = lm_scoring.subwords(TOKENS, pattern())
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0

    def ids(texts):
        t = Texts(pa.array(texts, pa.string()), lower=True)
        out, n, *_ = words.of(t)
        return lm_scoring.id_stream(out, n, t.ptr, words.size)

    stream, edge = ids([t for i, t in rows if train(i)])
    model = lm_scoring.fit([stream[a:b] for a, b in zip(edge[:-1], edge[1:])], words.size + 1)
    stream, edge = ids([t for i, t in rows if not train(i)])
    alone = lm_scoring.Model(**{**vars(model), "v": np.zeros_like(model.v)})
    attended = model.scores(stream, edge).sum()
    assert attended > alone.scores(stream, edge).sum()
    larger = docs.sparkSession.read.parquet("/root/testdata/sf0.1/documents.parquet")  # of few texts the word counts are better
    got = lm_scoring.score(larger, ~held, TOKENS, pattern()).where(held).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


# -- search ----------------------------------------------------------------------------------


def vectors(spark, n=600):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 16)) + rng.integers(0, 3, (n, 1))
    rows = [(int(i), [float(v) for v in x[i]], 1) for i in range(n)]
    rows += [(1000, None, 1), (1100, [0.0] * 16, 1), (1200, [1.0] * 15 + [None], 1), (1300, [1.0] * 15 + [float("nan")], 1), (1400, [1.0] * 15 + [float("inf")], 1), (1500, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]
    rows += [(5, rows[5][1], 1)] + [(2000 + k, rows[7][1], 1) for k in range(30)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int"), rows


def test_search_recall_and_ties(spark):
    df, rows = vectors(spark)
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    good = [(i, np.array(v)) for i, v, _ in rows if i is not None and v is not None and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    hit = total = 0
    for q, x in {i: x for i, x in good if i % 100 == 0}.items():
        want = sorted((math.sqrt(((y - x) ** 2).sum()), i) for i, y in good if i != q)[:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
        hit += sum(any(abs(s - d) < 1e-12 and i == v for d, i in want) for _, v, s in mine)
        total += 10
    assert hit / total >= 0.9


def test_search_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id, r["rank"]) for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1)]
    assert ann.nearest(df.where("vec_id > 5"), F.lit(True)).count() == 0


# -- language --------------------------------------------------------------------------------


def test_language_held_out(docs):
    held = queries.remainder("doc_id", 3) == 1
    model = langid.train(docs, ~held)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    rows = [r for r in docs.where(held).collect()]
    assert np.mean([got[r.doc_id] == r.lang for r in rows]) > 0.95


def test_language_of_odd_texts(edge, none, docs):
    model = langid.train(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.identify(edge, model).collect()}
    assert {got[i].lang_pred for i in (3, 4, 5)} == {"und"} and got[3].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = langid.train(none, F.lit(True))
    assert {r.lang_pred for r in langid.identify(edge, empty).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_mixed_text_has_spans(spark, docs):
    model = langid.train(docs, F.lit(True))
    pick = {r.lang: r.text for r in docs.where("length(text) between 800 and 4000").collect()}
    a, b = pick["en"], pick["fr"]
    r = langid.identify(spark.createDataFrame([(1, a + " " + b)], "doc_id int, text string"), model).first()
    assert r.n_spans >= 2 and r.score < 0.95


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    score = rng.integers(-50, 50, (11, 3))
    ptr = np.array([0, 6, 6, 11])
    got = langid.viterbi(score, ptr, 30)
    for a, b in zip(ptr[:-1], ptr[1:]):
        if b > a:
            value = lambda p: sum(score[a + i, k] for i, k in enumerate(p)) - 30 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731, B023
            assert value(got[a:b]) == max(value(p) for p in product(range(3), repeat=b - a))


@pytest.mark.parametrize("span", [1, 2, 7, 64])
def test_stretches_give_the_labels_of_one_pass(span):
    rng = np.random.default_rng(span)
    for _ in range(30):
        ptr = np.append(0, np.cumsum(rng.integers(0, 40, 4)))
        score = rng.integers(-4, 5, (ptr[-1], 3))  # many ties
        assert np.array_equal(langid.viterbi(score, ptr, 2, span), langid.viterbi(score, ptr, 2, 1 << 30))


def test_long_texts_with_weak_evidence():
    rng = np.random.default_rng(0)
    score = rng.integers(-30, 30, (9000, 4))
    ptr = np.array([0, 3000, 9000])
    switch = int(langid.SWITCH * langid.UNIT) // 100
    assert np.array_equal(langid.viterbi(score, ptr, switch), langid.viterbi(score, ptr, switch, 1 << 30))


def test_unknown_scripts_score_zero(spark, docs):
    model = langid.train(docs, F.lit(True))
    r = langid.identify(spark.createDataFrame([(1, "Ελληνικά μόνο γράμματα"), (2, "12 34")], "doc_id int, text string"), model).orderBy("doc_id").collect()
    assert (r[0].lang_pred in model.names, r[0].score) == (True, 0.0)
    assert (r[1].lang_pred, r[1].score) == ("und", 0.0)


def test_scripts_narrow():
    m = langid.Model(["el", "en"], np.zeros((1 << langid.BITS, 2), np.float32), np.zeros((langid.KINDS, 2), bool))
    m.uses[list(langid.SCRIPTS).index("Greek") + 1, 0] = m.uses[list(langid.SCRIPTS).index("Latin") + 1, 1] = True
    t = Texts(pa.array(["λόγος word 12"]))
    w = langid.distinct_words(t)
    label = langid.viterbi(m.emissions(w)[w.inverse], t.ptr)
    assert label[:2].tolist() == [0, 1]


# -- packing ---------------------------------------------------------------------------------


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    want = Counter()
    for x in ids:
        for p, a in enumerate(range(0, len(x), 2048)):
            part = np.array(x[a : a + 2048], "<u4")
            want[p, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= 2048
    return len(by), sum(r.length for r in rows)


@pytest.mark.parametrize("table", ["edge", "docs"])
def test_packing_round_trip(table, request):
    df = request.getfixturevalue(table)
    bins, tokens = check_packing(packing.pack(df, queries.tokenizer_path()).collect(), [r.text for r in df.collect()])
    assert bins <= tokens / 2048 * 1.1 + 2


def test_packing_of_nothing(none):
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_best_fit_bounds():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 100, 3000).tolist()
    to, at = packing.best_fit(lengths, 100, 8)
    used = Counter()
    for n, b, o in zip(lengths, to, at):
        assert used[b] == o
        used[b] += n
    assert max(used.values()) <= 100
    assert len(used) <= 1.15 * sum(lengths) / 100
    assert packing.best_fit([60, 50, 40, 50], 100, 8)[0] == [0, 1, 0, 1]
