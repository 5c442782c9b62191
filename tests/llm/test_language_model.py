"""Kernels of the language model against plain formulas, and which words tasks know."""

import numpy as np
import pytest

from linkstrata.llm import gru
from linkstrata.llm.scoring import Lexicon, spelling_class

LAYOUT = gru.Layout((0, 1, 4, 9), 3)


@pytest.mark.parametrize("size", (0.3, 4000.0))
def test_scores_of_any_size(size):
    rng = np.random.default_rng(5)
    p = gru.start(LAYOUT, rng.standard_normal(LAYOUT.classes), rng.standard_normal(LAYOUT.frequent), gru.Settings(hidden=6))
    p = {k: v.astype(np.float64) * (size if k in ("classes", "words", "class_bias", "word_bias") else 1) for k, v in p.items()}
    states, tokens, class_of = rng.uniform(-1, 1, (1300, 6)), rng.integers(0, LAYOUT.frequent + LAYOUT.spelling, 1300), LAYOUT.class_of()
    assert gru._small(p["words"], states) == (size < 1)
    got = gru.log_probabilities(p, LAYOUT, states, tokens, class_of)
    for state, token, log in zip(states, tokens, got):
        logits = state @ p["classes"] + p["class_bias"]
        want = logits[class_of[token]] - np.logaddexp.reduce(logits)
        words = np.flatnonzero(class_of[:LAYOUT.frequent] == class_of[token])
        if token < LAYOUT.frequent:
            scores = p["words"][words] @ state + p["word_bias"][words]
            want += scores[token - words[0]] - np.logaddexp.reduce(scores)
        assert np.isclose(log, want, rtol=1e-9, atol=1e-9)


def test_words_without_a_place_are_carried():
    a, b, c = b"aa", b"bb", b"cc"
    classes = {spelling_class(b): (3, 1), spelling_class(c): (1, 1)}
    lexicon = Lexicon([(b"", 0, 5), (a, spelling_class(a), 8), (b, spelling_class(b), 3)], classes, 17, least=4)
    numbers, seen, logs, fixed, others = lexicon.read("AA bb cc")
    assert lexicon.layout.frequent == 2 and others == [c] and seen == 3
    assert numbers.tolist() == [1, 2 + spelling_class(b), 2 + spelling_class(c), 0]
    assert np.isclose(logs, np.log10([9, 4, 6]).sum()) and np.isclose(fixed, np.log(4 / 5) - np.log(3))
