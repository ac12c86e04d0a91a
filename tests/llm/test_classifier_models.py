"""The two classifiers against versions in plain Python that go from texts to scores by their formulas."""

import math
import random
from collections import Counter

import numpy as np
import odd
import pytest
from quaywise.llm import quality, toxicity

M = (1 << 64) - 1
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x):
    x = (x ^ x >> 30) * MIX1 & M
    x = (x ^ x >> 27) * MIX2 & M
    return x ^ x >> 31


def gram(points, bits):
    h = 0
    for c in points:
        h = (h * BASE + c + 1) & M
    x = (h + len(points)) * MIX1 & M
    return ((x ^ x >> 29) * MIX2 & M) >> (64 - bits)


def grams(text, orders, bits):
    points = [ord(c) for c in text] + [0] * (max(orders) - 1)
    return [gram(points[i : i + n], bits) for n in orders for i in range(len(text))]


def word_hash(word):
    h = mix((len(word) + 1) * BASE & M)
    for at in range(0, len(word), 8):
        h = mix(((h ^ int.from_bytes(word[at : at + 8], "little")) * MIX1 + BASE) & M)
    return mix(h)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def corpus():
    rng = random.Random(1)
    good = [" ".join(odd.words(i, rng.randrange(5, 30), of=60)) for i in range(20)]
    bad = [" ".join(w.upper() + "!" for w in odd.words(100 + i, rng.randrange(5, 30), of=60)) for i in range(16)]
    texts = good + bad + ["", "Ä ö", "a a a a"]
    return texts, [0] * 20 + [1] * 16 + [0, 1, 1], [*good[:3], bad[1], "", "É a a\tb", "new words here!"]


def plain_quality(texts, labels, p):
    def features(t):
        ws = [word_hash(w) for w in t.encode().split()]
        pairs = [0 if a == b else mix((a * 3 + b) & M) >> (64 - p.bits) for a, b in zip(ws, ws[1:], strict=False)]
        return Counter(grams(t, p.orders, p.bits) + [w >> (64 - p.bits) for w in ws] + pairs)

    rng = np.random.default_rng(p.seed)
    v = rng.uniform(-1 / p.dim, 1 / p.dim, (1 << p.bits, p.dim)).tolist()
    out, bias, t = [[0.0] * p.dim for _ in range(2)], [0.0, 0.0], 0
    bags = [features(x) for x in texts]
    for _ in range(p.epochs):
        for i in rng.permutation(len(texts)):
            rate = p.rate * (1 - t / (p.epochs * len(texts)))
            t += 1
            total = max(sum(bags[i].values()), 1)
            hidden = [sum(c / total * v[k][d] for k, c in bags[i].items()) for d in range(p.dim)]
            z = [sum(o * h for o, h in zip(out[c], hidden, strict=True)) + bias[c] for c in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            err = [x / sum(e) - (c == labels[i]) for c, x in enumerate(e)]
            back = [sum(out[c][d] * err[c] for c in (0, 1)) for d in range(p.dim)]
            for c in (0, 1):
                out[c] = [o - rate * err[c] * h for o, h in zip(out[c], hidden, strict=True)]
                bias[c] -= rate * err[c]
            for k, n in bags[i].items():
                v[k] = [x - rate * p.boost * n / total * b for x, b in zip(v[k], back, strict=True)]

    def score(text):
        bag = features(text)
        total = max(sum(bag.values()), 1)
        hidden = [sum(c / total * v[k][d] for k, c in bag.items()) for d in range(p.dim)]
        return sigmoid(sum((out[1][d] - out[0][d]) * hidden[d] for d in range(p.dim)) + bias[1] - bias[0])

    return score


@pytest.mark.parametrize("p", [quality.QualityParams(bits=10, dim=3, epochs=4, boost=20.0), quality.QualityParams(bits=7, dim=2, epochs=2, orders=(3,))])
def test_quality_matches_plain_python(p):
    texts, labels, asked = corpus()
    line, bias = quality.fit(texts, np.array(labels), p)
    score = plain_quality(texts, labels, p)
    assert quality.scores(asked, line, bias, p) == pytest.approx([score(t) for t in asked], abs=2e-4)


def plain_toxicity(texts, labels, p):
    def strengths(text):
        text = text.lower()
        return {f: math.log2(1 + c * p.per_chars / max(len(text), p.per_chars)) for f, c in Counter(grams(text, p.orders, p.bits)).items()}

    bags, size, n = [strengths(t) for t in texts], 1 << p.bits, [labels.count(0), labels.count(1)]
    counts = [Counter(f for b, y in zip(bags, labels, strict=True) if y == c for f in b) for c in (0, 1)]
    total = [sum(counts[c].values()) + size / 2 for c in (0, 1)]
    ratio = {f: math.log((counts[1][f] + 0.5) / total[1]) - math.log((counts[0][f] + 0.5) / total[0]) for f in range(size)}
    kept = []
    for f in range(size):
        have, g = counts[0][f] + counts[1][f], 0.0
        for c in (0, 1):
            for seen, all_of in ((counts[c][f], have), (n[c] - counts[c][f], sum(n) - have)):
                if seen:
                    g += seen * math.log(seen / (all_of * n[c] / sum(n)))
        if have >= p.min_docs and math.sqrt(max(2 * g, 0)) >= p.z:
            kept.append(f)
    rows = [{f: ratio[f] * s for f, s in b.items() if f in set(kept)} for b in bags]
    names = [*kept, "bias"]
    w, m1, m2 = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    w["bias"] = math.log(n[1] / n[0])
    for step in range(1, p.steps + 1):
        err = [sigmoid(sum(w[f] * x for f, x in r.items()) + w["bias"]) - y for r, y in zip(rows, labels, strict=True)]
        grad = {f: sum(e * r.get(f, 0.0) for e, r in zip(err, rows, strict=True)) / len(rows) + p.l2 * w[f] for f in kept} | {"bias": sum(err) / len(err)}
        for f in names:
            m1[f], m2[f] = 0.9 * m1[f] + 0.1 * grad[f], 0.999 * m2[f] + 0.001 * grad[f] ** 2
            w[f] -= 0.05 * m1[f] / (1 - 0.9**step) / (math.sqrt(m2[f] / (1 - 0.999**step)) + 1e-8)
    return lambda text: sigmoid(sum(s * ratio[f] * w[f] for f, s in strengths(text).items() if f in w) + w["bias"])


@pytest.mark.parametrize("p", [toxicity.ToxicityParams(bits=9, orders=(3, 4), min_docs=2, z=1.0, steps=25), toxicity.ToxicityParams(bits=6, orders=(2,), min_docs=3, z=2.0, steps=60)])
def test_toxicity_matches_plain_python(p):
    texts, labels, asked = corpus()
    weights, bias = toxicity.fit(texts, np.array(labels), p)
    score = plain_toxicity(texts, labels, p)
    assert toxicity.scores(asked, weights, bias, p) == pytest.approx([score(t) for t in asked], abs=1e-4)
