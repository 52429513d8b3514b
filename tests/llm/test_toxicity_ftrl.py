"""op9: the weights against FTRL-proximal by its definition, coordinate by coordinate, and the features against words."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import _text, toxicity


def by_definition(texts, labels, passes):
    """Weights by dictionaries, as in the published algorithm; the bias has no penalty."""
    z, n = defaultdict(float), defaultdict(float)
    l1 = lambda i: 0.0 if i == "bias" else toxicity.L1
    l2 = lambda i: 0.0 if i == "bias" else toxicity.L2

    def weight(i):
        if abs(z[i]) <= l1(i):
            return 0.0
        return -(z[i] - math.copysign(l1(i), z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + l2(i)) if i != "bias" else -z[i] / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA)

    for _ in range(passes):
        for x, y in zip(texts, labels, strict=True):
            own = [*x, "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z) if weight(i) != 0}


def test_weights_equal_definition():
    rng = random.Random(7)
    texts = [np.unique([rng.randrange(30) for _ in range(rng.randrange(1, 12))]) for _ in range(300)]
    labels = np.array([int(3 in t or rng.random() < 0.1) for t in texts])
    cut = len(texts) - int(len(texts) * toxicity.HELD_OUT)
    model = toxicity.fit_arrays(texts, labels, 5, 2)
    want = by_definition([t.tolist() for t in texts[:cut]], labels[:cut].tolist(), 2)
    assert model.bias == pytest.approx(want.pop("bias"))
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(want)
    assert 0 < len(want) < 30


def test_features_are_words_pairs_and_skip_pairs():
    w = _text.words(pa.array(["a b c d", "c", None, "a b"]))
    doc, f = toxicity.features(w.hashes, w.first, 20)
    assert np.bincount(doc, minlength=4).tolist() == [4 + 3 + 2, 1, 0, 2 + 1]
    first, last = set(f[doc == 0].tolist()), set(f[doc == 3].tolist())
    assert last < first and set(f[doc == 1].tolist()) < first
