"""Language, quality and language-model scores: held-out accuracy, exact counts, gradients."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_samples import EMPTY, evidence, sentence, texts

from linkstrata.llm import gru, scoring
from linkstrata.llm.ftrl import Settings, learn, probabilities, weights
from linkstrata.llm.language import gram_counts, predict_language, temperature
from linkstrata.llm.quality import score_quality, word_grams
from linkstrata.llm.scoring import Lexicon, encode_snippets, score_snippets, spelling_class, training_rounds


def prose(n, seed=8):
    rng = random.Random(seed)
    return [(1000 + i, sentence(rng, lang := rng.choice(["en", "de", "fr"]), rng.randint(8, 60)), lang) for i in range(n)]


def test_language(spark):
    rows = [*EMPTY, *prose(300), (None, "no id here", "en"), (5000, "the ing tion", None)]
    found = predict_language(evidence(spark, rows))
    assert found.columns == ["evidence_id", "held_out", "lang_pred", "score"]
    got = found.collect()
    assert len(got) == len(rows) + 1
    truth = {r[0]: r[2] for r in prose(300)}
    held = [r for r in got if r["held_out"] and r["evidence_id"] in truth]
    assert len(held) > 60 and np.mean([truth[r["evidence_id"]] == r["lang_pred"] for r in held]) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["evidence_id"] if r["evidence_id"] is not None else "").encode()) % 3 == 1)
        if r["evidence_id"] in (1, 2, 3, 4):
            assert (r["lang_pred"], r["score"]) == ("und", 0)


def test_language_without_examples(spark):
    rows = evidence(spark, [(i, "some text") for i in range(6)])
    assert {(r["lang_pred"], r["score"]) for r in predict_language(rows).collect()} == {("und", 0.0)}
    assert predict_language(evidence(spark, [])).collect() == []
    one = {(r["lang_pred"], r["score"]) for r in predict_language(evidence(spark, [(i, f"some text {i}", "en") for i in range(9)])).collect()}
    assert one == {("en", 1.0)}


def test_gram_counts():
    ids, counts = gram_counts("Abab")
    assert counts.sum() == 4 + 3 + 2 and sorted(counts) == [1, 1, 1, 2, 2, 2]
    assert np.array_equal(gram_counts("aBAB")[0], ids) and all(len(a) == 0 for a in gram_counts(""))


def test_temperature():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 4000)
    logits = rng.standard_normal((3, 4000))
    logits[labels, np.arange(4000)] += 1.0
    best = temperature(logits * 4, labels)
    assert 2.5 < best / temperature(logits, labels) < 6
    assert temperature(np.zeros((3, 0)), np.zeros(0, dtype=int)) == 1.0


def test_ftrl_single_update():
    s = Settings(alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros((1, 3), dtype=np.float32), np.zeros((1, 3), dtype=np.float32)
    learn(z, n, [(1, np.array([0, 2]), np.array([1.0, 2.0], dtype=np.float32))], s)
    assert np.allclose(z, [[-0.5, 0, -1.0]]) and np.allclose(n, [[0.25, 0, 1.0]])
    assert np.allclose(weights(z, n, s), [[0.4 / (3.0 + 0.2), 0, 0.9 / (4.0 + 0.2)]])
    assert np.allclose(probabilities(np.array([[1.0], [1.0]])), 0.5)


def test_quality(spark):
    rng = random.Random(4)
    rows, labels = [*EMPTY], []
    for i in range(1000, 1400):
        good = rng.random() < 0.7
        text = sentence(rng, "en", rng.randint(20, 60))
        rows.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        labels.append((i, int(good), None))
    labels += [(None, 1, None), (1, None, None), (9999, 0, None), labels[-1]]
    opinions = spark.createDataFrame(labels, "evidence_id long, status int, snippet string")
    got = score_quality(evidence(spark, rows), opinions).collect()
    truth = {i: s for i, s, _ in labels}
    held = [r for r in got if r["held_out"] and (r["evidence_id"] or 0) >= 1000]
    assert len(got) == len(rows) + 1 and len(held) > 50
    assert np.mean([truth[r["evidence_id"]] == r["predicted"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["evidence_id"] in (1, 2, 3)}) == 1
    assert {r["score"] for r in score_quality(evidence(spark, rows[:6]), opinions.limit(0)).collect()} == {0.5}
    assert score_quality(evidence(spark, []), opinions).collect() == []


def test_word_grams():
    assert word_grams("a b")[1].sum() == 2 + 1 + 2 + 1 and word_grams("a a a")[1].sum() == 3 + 2 + 3 + 2 + 1 + 2 and len(word_grams("")[0]) == 0


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_language_model(spark):
    rows = [*EMPTY, *[(i, t) for i, t, _ in texts(n=30)], (78, "No id"), (77, "Entirely Unseen words\x0bhere")]
    found = score_snippets(evidence(spark, rows, twice=False))
    got = {r["evidence_id"]: r for r in found.collect()}
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i, _ in rows}
    tokens = {i: [*lowered(t).encode().split(), None] for i, t in rows}
    train = Counter(w for i, _ in rows if fold[i] != 2 for w in tokens[i])
    total, distinct = sum(train.values()), len(train)
    assert len(got) == len(rows)
    for i, _ in rows:
        r = got[i]
        assert r["held_out"] == (fold[i] == 2) and r["n_tokens"] == len(tokens[i]) and r["train_tokens"] == total
        assert r["n_known"] == sum(train[w] > 0 for w in tokens[i])
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in tokens[i]), rel_tol=1e-9)
        assert r["score"] < 0
    assert got[1]["score"] == got[2]["score"] == got[3]["score"]
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_language_model_of_nothing(spark):
    assert score_snippets(evidence(spark, [])).collect() == []
    alone = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in score_snippets(evidence(spark, [(i, "a b") for i in alone])).collect())


def test_every_row_is_learned_from_once(spark):
    rows = [(i, f"text {i}") for i in range(500)] + [(None, "no id"), (7, "text 7")]
    table = evidence(spark, rows, twice=False).selectExpr("*", "coalesce(evidence_id, 0) % 5 = 1 AS held_out")
    lexicon = spark.sparkContext.broadcast(Lexicon([(b"", 0, 502), (b"text", 1, 501)], {spelling_class(b"%d" % i): (20, 20) for i in range(500)}, 1500))
    encoded = encode_snippets(table, lexicon).cache()
    assert encoded.select("row").distinct().count() == len(rows) == encoded.count()
    parts = [part.count() for part in training_rounds(encoded)]
    assert sum(parts) == encoded.filter("NOT held_out").count() == 402 and min(parts) > 80


def slow_score(p, lexicon, text):
    """The model's natural log probability, token by token in 64 bits."""
    layout, total, h = lexicon.layout, 0.0, np.zeros(p["candidate"].shape[0])
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    p = {k: v.astype(np.float64) for k, v in p.items()}
    class_of = layout.class_of()
    for token in lexicon.read(text)[0]:
        scores = h @ p["classes"] + p["class_bias"]
        total += scores[class_of[token]] - np.log(np.exp(scores).sum())
        if token < layout.frequent:
            low, high = layout.bounds[class_of[token]], layout.bounds[class_of[token] + 1]
            scores = p["words"][low:high] @ h + p["word_bias"][low:high]
            total += scores[token - low] - np.log(np.exp(scores).sum())
        x, k = p["x"][token] @ p["input"], len(h)
        z, r = sigmoid(x[:k] + h @ p["gates"][:, :k]), sigmoid(x[k:2 * k] + h @ p["gates"][:, k:])
        h = (1 - z) * h + z * np.tanh(x[2 * k:] + (r * h) @ p["candidate"])
    return total


def test_scores_token_by_token(spark):
    rows = [*EMPTY, *[(i, t) for i, t, _ in texts(n=24)][:-1], (301, "one long text " * 700)]
    kept = {}

    def keep(encoded, lexicon, settings):
        kept["lexicon"] = lexicon.value
        kept["p"] = train(encoded, lexicon, settings)
        return kept["p"]

    train, scoring.train_model = scoring.train_model, keep
    try:
        found = scoring.score_snippets(evidence(spark, rows, twice=False), known_share=400)
        got = {r["evidence_id"]: r for r in found.collect()}
    finally:
        scoring.train_model = train
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts = Counter(w for i, t in rows if fold(i) != 2 for w in lowered(t).encode().split())
    lexicon = kept["lexicon"]
    for i, t in rows:
        words = [w for w in lowered(t).encode().split() if w not in lexicon.place]
        _, _, _, fixed, others = lexicon.read(t or "")
        assert sorted(words) == sorted(others)
        want = (slow_score(kept["p"], lexicon, t or "") + fixed) / math.log(10) + sum(math.log10(counts[w] + 1) for w in others)
        assert math.isclose(got[i]["score"], want, rel_tol=1e-4), i


def test_every_known_word_has_a_learned_place():
    words = [(b"w%d" % i, spelling_class(b"w%d" % i), 2 + 3000 // (i + 1)) for i in range(3000)]
    lexicon = Lexicon([(b"", 0, 500), *words, (b"once", 3, 1)], {3: (1, 1)}, 1 << 19)
    assert lexicon.layout.frequent == 3001 and 20 < len(lexicon.layout.bounds) < 60
    numbers, _, _, fixed, others = lexicon.read(" ".join(w.decode() for w, _, _ in words))
    assert sorted(numbers) == list(range(3001)) and fixed == 0 and others == []
    assert lexicon.read("once")[3] < 0


LAYOUT = gru.Layout((0, 1, 3, 6), 4)


@pytest.fixture(scope="module")
def params():
    rng = np.random.default_rng(0)
    p = gru.start(LAYOUT, rng.standard_normal(LAYOUT.classes), rng.standard_normal(LAYOUT.frequent), gru.Settings(hidden=5))
    return {k: v.astype(np.float64) + 0.1 * rng.standard_normal(v.shape) for k, v in p.items()}


def test_probabilities_add_up(params):
    tokens = np.arange(LAYOUT.frequent + LAYOUT.spelling)
    state = np.random.default_rng(3).standard_normal((1, 5))
    logs = gru.log_probabilities(params, LAYOUT, np.repeat(state, len(tokens), axis=0), tokens, LAYOUT.class_of())
    assert np.isclose(np.exp(logs).sum(), 1)


def test_gradients(params):
    rng = np.random.default_rng(5)
    part = rng.integers(0, 10, (6, 3))
    part[4:, 1] = -1
    h = rng.standard_normal((3, 5))

    def loss(p):
        before, _, _ = gru._steps(p, h, part)
        real = part.ravel() >= 0
        return -gru.log_probabilities(p, LAYOUT, before.reshape(-1, 5)[real].astype(np.float64), part.ravel()[real], LAYOUT.class_of()).mean()

    g, _ = gru._gradients(params, LAYOUT, h, part, LAYOUT.class_of())
    for key, value in params.items():
        for place in list(np.ndindex(value.shape))[::7]:
            moved = {k: v.copy() for k, v in params.items()}
            moved[key][place] += 1e-2
            up = loss(moved)
            moved[key][place] -= 2e-2
            assert abs((up - loss(moved)) / 2e-2 - g[key][place]) < 2e-3, (key, place)


def test_state_is_carried_over_windows(params):
    p = {k: v.astype(np.float32) for k, v in params.items()}
    rng = np.random.default_rng(6)
    docs = [np.append(rng.integers(1, 10, n), 0) for n in (50, 3, 0, 17, 200, 8)]
    whole = gru.score_texts(p, LAYOUT, docs, batch=100_000)
    for lanes, batch in ((1, 7), (3, 48), (512, 64)):
        assert np.allclose(gru.score_texts(p, LAYOUT, docs, lanes, batch), whole, rtol=1e-4)
    assert np.allclose([gru.score_texts(p, LAYOUT, [d])[0] for d in docs], whole, rtol=1e-4)


def test_training_lowers_the_loss_of_long_and_short_texts():
    rng = np.random.default_rng(8)
    docs = [np.append(np.tile([1, 2, 3, 4, 5], n)[:n], 0) for n in (*rng.integers(1, 40, 200), 9000)]
    s = gru.Settings(hidden=6, lanes=16, window=8, segment=64)
    p = gru.start(LAYOUT, np.zeros(LAYOUT.classes), np.zeros(LAYOUT.frequent), s)
    trainer = gru.Trainer(p, LAYOUT, s)
    trainer.learn(docs)
    trainer.learn([])
    assert trainer.tokens == sum(map(len, docs)) and trainer.steps > 60
    before, after = (gru.score_texts(q, LAYOUT, docs).sum() for q in (p, trainer.p))
    assert after > 0.6 * before and np.array_equal(gru.fit(p, LAYOUT, docs, s)["words"], trainer.p["words"])
