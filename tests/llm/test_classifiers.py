import random
import zlib

import numpy as np
import pandas as pd
import pytest

from textloom.llm import quality_cnn as cnn, toxicity as fm


def auc(y, s):
    order, y = pd.Series(np.asarray(s)).rank().to_numpy(), np.asarray(y)
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(1)
    words = ["".join(r.choice("abcdeghi") for _ in range(r.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(700):
        w = [r.choice(words) for _ in range(r.randint(20, 120))]
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["idiotic", "idiots", "moron"]))
        docs.append((i, " ".join(f"{x}%%%" if bad else x for x in w), "text"))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(9000, None, "x"), (9001, "", "x"), (None, "idiots", "x"), (3, "a moron", "x"), (9002, "word " * 200_000, "x")]
    labels += [(9100, 1, 1), (None, 0, 0), (5, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label"), [(fm, "toxic"), (cnn, "quality")])
def test_held_out_accuracy(tables, module, label):
    docs, labels = tables
    out = module.scores(docs, labels, label).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32((str(int(i)) if i == i else "").encode()) % 5 == 0)).all()
    known = labels.where("doc_id < 700").toPandas().dropna().drop_duplicates("doc_id")
    held = out[out["held_out"]].drop_duplicates("doc_id").merge(known, on="doc_id")
    assert auc(held[label].astype(int), held["score"]) > 0.97
    limit = 0.5 if label == "toxic" else 0.3
    assert (out["predicted"] == (out["score"] >= limit)).all()
    assert module.scores(docs.limit(0), labels, label).count() == 0


@pytest.mark.parametrize(("module", "label"), [(fm, "toxic"), (cnn, "quality")])
def test_without_labels(tables, module, label):
    docs, labels = tables
    assert {r["score"] for r in module.scores(docs, labels.limit(0), label).collect()} == {0.5}


def test_gradients_are_those_of_the_loss():
    w = {k: v.astype(np.float64) for k, v in cnn.start(3).items()}
    raws, y = [b"hello world " * 30, b"%%% $$$", b"x" * 200], np.array([1.0, 0.0, 1.0])
    b, chunks = cnn.padded(raws)
    loss = lambda v: float(-np.mean(y * np.log(p := cnn.probability(v, cnn.features(cnn.chunk_maxima(v, b, chunks), chunks))) + (1 - y) * np.log(1 - p)))
    g = cnn._gradients(w, b, chunks, y)
    rng = np.random.default_rng(0)
    for name, value in w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "embed":
                at = (ord("o"), at[1])
            v = {k: a.copy() for k, a in w.items()}
            v[name][at] += 1e-5
            up = loss(v)
            v[name][at] -= 2e-5
            assert abs((up - loss(v)) / 2e-5 - g[name][at]) < 1e-3


def test_long_texts_are_scored_as_if_in_one_piece(monkeypatch):
    w = cnn.start(5)
    rng = np.random.default_rng(2)
    raws = [bytes(rng.integers(32, 120, n).astype(np.uint8)) for n in (5, 1000, 40_000, 65_536, 70_001)]
    whole = cnn.predict(w, raws)
    monkeypatch.setattr(cnn, "BLOCK", 4096)
    assert np.allclose(cnn.predict(w, raws), whole, atol=1e-5)


def test_scores_depend_on_the_text_alone(monkeypatch):
    w = cnn.start(5)
    r = random.Random(4)
    raws = [bytes(r.choices(range(1, 256), k=n)) for n in [0, 1, 5, 122, 123, 126, 127, 128, 129, 256, 1000, 70_000] * 8]
    whole = cnn.predict(w, raws)
    alone = np.concatenate([cnn.predict(w, [x]) for x in raws])
    assert (whole == alone).all()
    order = r.sample(range(len(raws)), len(raws))
    assert (cnn.predict(w, [raws[i] for i in order]) == whole[order]).all()
    for block in (1 << 12, 1 << 15):
        monkeypatch.setattr(cnn, "BLOCK", block)
        assert (cnn.predict(w, raws) == whole).all()


def brute_score(w, raw):
    """The network for one text, window by window in plain loops."""
    n = max(1, -(-len(raw) // cnn.CHUNK)) * cnn.CHUNK
    b = np.frombuffer(raw.ljust(n, b"\0"), np.uint8)
    best = np.full((n // cnn.CHUNK, cnn.FILTERS), -np.inf)
    for at in range(0, n - cnn.WIDTH + 1, cnn.STRIDE):
        x = np.concatenate([w["embed"][c] for c in b[at : at + cnn.WIDTH]])
        best[at // cnn.CHUNK] = np.maximum(best[at // cnn.CHUNK], x @ w["filters"])
    best = np.maximum(best + w["filter_bias"], 0)
    pairs = [np.maximum(best[k], best[min(k + 1, len(best) - 1)]) for k in range(len(best))]
    h = np.maximum(np.concatenate([np.max(pairs, 0), np.mean(pairs, 0)]) @ w["hidden"] + w["hidden_bias"], 0)
    return 1 / (1 + np.exp(-(h @ w["out"] + w["out_bias"][0])))


def test_scores_equal_brute_force():
    w = cnn.start(9)
    r = random.Random(6)
    raws = [bytes(r.choices(range(256), k=n)) for n in (0, 1, 7, 127, 128, 130, 600)]
    assert np.allclose(cnn.predict(w, raws), [brute_score(w, x) for x in raws], atol=1e-5)


def test_rows_and_columns_beside_do_not_matter(spark, tables):
    docs, labels = tables
    docs = docs.select("doc_id", "text")
    a = {(r["doc_id"], r["score"]) for r in cnn.scores(docs.repartition(7, "text"), labels).collect()}
    b = {(r["doc_id"], r["score"]) for r in cnn.scores(docs.orderBy("text").coalesce(1), labels).collect()}
    assert a == b
    named = docs.withColumn("__score", docs.doc_id)
    assert cnn.apply(named, labels).columns == named.columns


def test_pairs_of_terms_are_learned():
    r = random.Random(0)
    filler = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(1200):
        a, b = i % 2, (i // 2) % 2
        rows.append((" ".join([*r.sample(filler, 12), *["insult"] * a, *["group"] * b]), int(a and b)))
    machine = fm.train(rows[:900], steps=400)
    active = fm._Active(machine)
    right = [(machine.score(active.of(t)) >= 0.5) == bool(y) for t, y in rows[900:]]
    assert np.mean(right) > 0.98


def test_pairs_that_tell_nothing_alone_are_learned():
    r = random.Random(0)
    filler = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(1500):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [*r.sample(filler, 12), *["insult"] * a, *["group"] * b]
        r.shuffle(words)
        rows.append((" ".join(words), int(a == b)))
    machine = fm.train(rows[:1100])
    active = fm._Active(machine)
    assert {fm.slots(w)[0] for w in (b"insult", b"group")} <= set(machine.features)
    right = [(machine.score(active.of(t)) >= 0.5) == bool(y) for t, y in rows[1100:]]
    assert np.mean(right) > 0.95


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    machine = fm.Machine({i: i for i in range(9)}, 0.3, rng.normal(size=9), rng.normal(size=(9, fm.RANK)))
    for active in ([], [4], [0, 3, 8], list(range(9))):
        z = 0.3 + sum(machine.weights[i] for i in active) + sum(machine.factors[i] @ machine.factors[j] for i in active for j in active if i < j)
        assert abs(machine.score(active) - 1 / (1 + np.exp(-z))) < 1e-9


def test_bad_documents_are_rejected_on_a_small_table():
    """A thousand documents, some forty of them bad and labelled: enough to reject the held-out bad ones and keep the good ones."""
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    known = docs.merge(pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas(), on="doc_id").sort_values("doc_id")
    held = known["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    fit = known[~held & (known["text"].fillna("").str.len() <= cnn.LONGEST)]
    w = cnn.learned([(t or "", int(q)) for t, q in zip(fit["text"], fit["quality"], strict=True)])
    score, y = cnn.predict(w, [(t or "").encode() for t in known[held]["text"]]), known[held]["quality"].to_numpy()
    assert (score[y == 0] < 0.3).mean() >= 0.8 and (score[y == 1] >= 0.3).mean() >= 0.95


def test_calibration():
    rng = np.random.default_rng(1)
    r = random.Random(3)
    rows = [("".join(r.choices("abcd ", k=80)) + ("%%%%" * 3 if y == 0 else ""), int(y)) for y in rng.random(300) < 0.85]
    w = cnn.train(rows[:200], steps=120)
    again = cnn.calibrated(w, rows[200:])
    p, q = (cnn.predict(v, [t.encode() for t, _ in rows]) for v in (w, again))
    # the order stays, and both classes weigh the same
    assert auc(np.array([y for _, y in rows]), q) == auc(np.array([y for _, y in rows]), p)
    assert cnn.calibrated(w, [(t, 1) for t, _ in rows[:9]]) is w and cnn.calibrated(w, []) is w
    turned = {**w, "out_bias": w["out_bias"] + 40}
    assert (cnn.predict(cnn.calibrated(turned, rows[200:]), [t.encode() for t, y in rows if y == 0]) < 0.5).mean() > 0.9


def test_calibration_is_the_same_wherever_the_log_odds_lie():
    r = random.Random(5)
    rows = [("".join(r.choices("abcd ", k=80)) + "%%%%" * (3 * (k % 6 == 0)), int(k % 6 != 0)) for k in range(120)]
    w, raws = cnn.train(rows, steps=60), [t.encode() for t, _ in rows]
    want = cnn.predict(cnn.calibrated(w, rows), raws)
    assert want.max() - want.min() > 0.2
    for shift in (-40, 40):
        assert np.allclose(cnn.predict(cnn.calibrated({**w, "out_bias": w["out_bias"] + shift}, rows), raws), want, atol=1e-3)


def test_pairs_among_thousands_of_commoner_terms():
    """Two terms at the same rate in both classes, together in one and apart in the other, among 6,000 terms that vary more."""
    r = random.Random(2)
    filler = [f"w{i}" for i in range(6_000)]
    rows = []
    for k in range(1_600):
        words, y = [w for w in filler if r.random() < 0.25], k % 2
        a = r.random() < 0.15
        b = a if y else r.random() < 0.15 and not a
        if not y and a:
            b = False
        elif not y:
            b = r.random() < 0.15 / 0.85
        words += ["zinsult"] * a + ["qgroup"] * b
        r.shuffle(words)
        rows.append((" ".join(words), y))
    machine = fm.train(rows[:1_200])
    assert {fm.slots(w)[0] for w in (b"zinsult", b"qgroup")} <= set(machine.features)
    active = fm._Active(machine)
    told = [(machine.score(active.of(t)) >= 0.5) == bool(y) for t, y in rows[1_200:] if "zinsult" in t or "qgroup" in t]
    assert len(told) > 50 and np.mean(told) > 0.9


def test_all_pairs_are_tested():
    rng = np.random.default_rng(6)
    share = rng.random(70) * 0.6
    # neither of the two says anything alone
    share[[3, 40]] = 0.5
    x = (rng.random((400, 70)) < share).astype(np.uint8)
    y = (x[:, 3] == x[:, 40]).astype(float)
    p = np.full(400, y.mean())
    for block in (16, 70, 512):
        assert set(fm.telling_pairs(x, y, p, block)[:2].tolist()) == {3, 40}
    assert len(fm.telling_pairs(x, rng.random(400).round(), np.full(400, 0.5))) == 0
