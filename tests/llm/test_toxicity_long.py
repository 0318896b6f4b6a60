"""All of a text without white space is read."""

import numpy as np

from scorespark.llm import toxicity


def test_term_far_into_a_run():
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(200)]
    texts, y = [], []
    for i in range(400):
        t = list(rng.choice(plain, 60))
        if i % 2:
            t.insert(int(rng.integers(60)), "worthless")
        texts.append(t)
        y.append(i % 2)
    m = toxicity.fit(texts, np.array(y), 0.5)
    score = lambda t: m.score(np.array([m.slope[toxicity.subwords(x)].mean() for x in toxicity.words_of(t)]))
    for sep in ("", ".", "_", "-"):
        clean = plain[:40]
        bad = clean[:30] + ["worthless"] + clean[30:]
        assert score(sep.join(bad)) > 0.5 > score(sep.join(clean)), sep


def test_every_ngram_of_a_run_counts():
    for n in (60, 61, 72, 73, 84, 85, 200, 5000):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        words = toxicity.words_of(run)
        assert {run[i : i + 5] for i in range(n - 4)} == {w[i : i + 5] for w in words for i in range(len(w) - 4)}
        assert n <= toxicity.LONG or max(map(len, words)) <= toxicity.STRETCH
