"""The learnt operators against plain one-text, one-number-at-a-time versions."""

import math
import zlib

import numpy as np
import pytest

from scorespark.llm import quality, registry, toxicity
from scorespark.llm.common import table


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


# --- 1: the ordinal model ---------------------------------------------------------------


def brute_slots(text):
    """Shares of hashed byte n-grams by dictionary, and the shape slots."""
    b, counts = text.encode("utf-8", "replace"), {}
    for at in range(len(b)):
        for n in range(1, 5):
            if at + n <= len(b):
                h = 0
                for k in range(1, n + 1):
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ (b[at + k - 1] + (k << 9))
                slot = (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality.BITS)
                counts[slot] = counts.get(slot, 0) + 1
    whole = sum(counts.values())
    return {s: math.sqrt(c / whole) for s, c in counts.items()}


def test_quality_scores_by_hand(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train_on_labels(spark, docs, sf_dir)
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_quality_ordinal"](spark, sf_dir).collect()}
    for r in docs.where("n_chars < 1500").orderBy("doc_id").limit(25).collect():
        text = r["text"] or ""
        s = sum(model.weights[k] * v for k, v in brute_slots(text).items()) + sum(0.5 * model.weights[k] for k in quality.shape_features(text))
        tails = [sigmoid(s - t) for t in model.thresholds]
        assert got[r["doc_id"]]["p_tail"] == pytest.approx(tails[0], abs=1e-6)
        assert got[r["doc_id"]]["expected_grade"] == pytest.approx(sum(tails), abs=1e-6)


def log_likelihood(w, theta, x, y):
    edges, out = [-math.inf, *theta, math.inf], 0.0
    for row, k in zip(x, y):
        s = float(row @ w)
        hi = 1.0 if edges[k + 1] == math.inf else sigmoid(edges[k + 1] - s)
        lo = 0.0 if edges[k] == -math.inf else sigmoid(edges[k] - s)
        out += math.log(max(hi - lo, 1e-12))
    return out / len(y)


def test_ordinal_fit_is_a_maximum():
    """Finite differences of a plain log likelihood vanish at the fit, in weights and thresholds."""
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = np.digitize(4 * x[:, 0] - 2 * x[:, 1] + rng.logistic(size=500), [0.0, 1.5])
    m = quality.fit_ordinal([(np.arange(3), r) for r in x], y, np.ones(500), epochs=150)
    w, theta = m.weights[:3], m.thresholds

    def slope(i, at_w, at_theta):
        a, b = [at_w.copy(), at_theta.copy()], [at_w.copy(), at_theta.copy()]
        which, k = (0, i) if i < 3 else (1, i - 3)
        a[which][k] += 1e-4
        b[which][k] -= 1e-4
        return (log_likelihood(*a, x, y) - log_likelihood(*b, x, y)) / 2e-4

    start = max(abs(slope(i, np.zeros(3), np.array([-1.0, 0.0]))) for i in range(5))
    assert max(abs(slope(i, w, theta)) for i in range(5)) < 0.1 * start
    assert theta[0] < theta[1]


# --- 2: the subword bag -----------------------------------------------------------------


def brute_value(model, word):
    core = word.strip("".join(c for c in map(chr, range(33, 127)) if not c.isalnum())) or word
    marked, grams = f"<{core}>", set()
    for n in (3, 4, 5):
        for at in range(len(marked) - n + 1):
            grams.add(marked[at : at + n])
    grams.add(f"={core}")
    found = [model.slope[zlib.crc32(g.encode("utf-8", "replace")) % toxicity.BUCKETS] for g in grams]
    return sum(found) / len(found)


def test_toxicity_scores_by_hand(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    for r in docs.where("n_chars < 1500").orderBy("doc_id").limit(40).collect():
        values = [brute_value(model, w) for w in toxicity.words_of(r["text"] or "")]
        spans = [sum(values[i : i + 2]) / 2 for i in range(len(values) - 1)] if len(values) > 2 else [sum(values) / len(values)] if values else [0.0]
        z = model.scale * (max(spans) + model.bias) + model.length * math.log1p(len(values)) + model.shift
        assert got[r["doc_id"]] == pytest.approx(sigmoid(z), abs=1e-6)
