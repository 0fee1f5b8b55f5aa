"""The learning and decoding parts against plain loops and enumeration."""

import itertools
import math

import numpy as np

from pelagia.llm import linear, toxicity


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(1)
    model = linear.Ftrl(buckets=32, alpha=0.3, beta=1.5, l1=0.1, l2=0.2, epochs=3)
    examples = []
    for _ in range(60):
        at = np.sort(rng.choice(32, 5, replace=False))
        examples.append((np.append(at, 32), np.append(rng.random(5), 1.0), float(rng.integers(2)), float(rng.choice([0.5, 1.0, 2.0]))))
    z, n = [0.0] * 33, [0.0] * 33

    def weight(i):
        if abs(z[i]) <= model.l1:
            return 0.0
        return (math.copysign(model.l1, z[i]) - z[i]) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(model.epochs):
        for at, value, label, importance in examples:
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, value, strict=True))))
            for i, x, wi in zip(at, value, w, strict=True):
                g = (p - label) * importance * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / model.alpha * wi
                n[i] += g * g
    assert np.allclose(model.fit(examples), [weight(i) for i in range(33)], atol=1e-12)


def test_viterbi_against_every_path():
    rng = np.random.default_rng(2)
    costs = rng.random((toxicity.SYMBOLS,) * 3) * 5
    for stretch in ("m0r0n", "1d1ot", "st0p", "aaa1", "h3lloo", "a.b", "$h1t", "x"):
        places = toxicity._lattice(stretch)
        cost, text = toxicity._viterbi(places, costs)

        def total(path):
            letters, spent = "".join(r for r, _ in path) + " ", sum(c for _, c in path)
            a = b = 0
            for ch in letters:
                spent += costs[a, b, toxicity._symbol(ch)]
                a, b = b, toxicity._symbol(ch)
            return spent

        best = min(itertools.product(*places), key=total)
        assert abs(cost - total(best)) < 1e-9
        assert abs(total([(text, sum(c for _, c in best))]) - cost) < 1e-9


def test_character_model_is_a_distribution(spark):
    costs = toxicity.character_model(spark.createDataFrame([("the cat",), ("",), ("a 1!é",)], "text string"))
    assert np.allclose(np.exp(-costs).sum(axis=2), 1.0)
    assert costs[0, 0, toxicity._symbol("t")] < costs[0, 0, toxicity._symbol("z")]
