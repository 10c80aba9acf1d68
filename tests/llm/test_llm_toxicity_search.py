"""The nearest examples against dense cosines, with frequent and rare terms, few and many examples, and copies left out."""

import random

import numpy as np
import pytest

from linkloom.llm import toxicity


@pytest.mark.parametrize("n", [1, 20, 64, 65, 400])
@pytest.mark.parametrize("k", [25, 100])
@pytest.mark.parametrize("leave_out", [False, True])
def test_nearest_is_exact(n, k, leave_out):
    rng = random.Random(n)
    words, often = [f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)]

    def counts():
        out: dict[str, int] = {}
        for w in rng.choices(words, often, k=rng.choice([1, 5, 30, 200])):
            out[w] = out.get(w, 0) + 1
        return out

    texts = [counts() for _ in range(n)]
    texts = [rng.choice(texts) if rng.random() < 0.2 else t for t in texts]
    index = toxicity.Index((i, int(i % 3 == 0), repr(sorted(t.items())).encode(), sorted(t), [t[w] for w in sorted(t)]) for i, t in enumerate(texts))
    full = np.zeros((n, len(index.term)))
    for row, i in zip(full, index.ids):
        for w, c in texts[i].items():
            row[index.term[w]] = (1 + np.log(c)) * index.idf[index.term[w]]
        row /= np.linalg.norm(row)
    who, term, x = index.passages(rng.choices(words + ["unknown"], k=300))
    queries = np.zeros((who.max() + 1, len(index.term)))
    queries[who, term] = x
    cosines = queries @ full.T
    but = np.array([rng.randrange(-1, len(index.copies)) for _ in queries]) if leave_out else None
    if leave_out:
        cosines[index.copy_of[None, :] == but[:, None]] = 0
    q, number, cos = index.nearest(who, term, x, len(queries), k=k, but=but)
    for j, row in enumerate(cosines):
        best = np.sort(row[row > 1e-12])[::-1][:k]
        np.testing.assert_allclose(cos[q == j], best, atol=1e-9)
        np.testing.assert_allclose(row[number[q == j]], best, atol=1e-9)


def test_rows_of_weights_are_not_sparse():
    """A term is a row of weights only where that takes no more than a few times its postings: sparse rows were most of the work."""
    rng = random.Random(3)
    texts = [sorted(rng.sample(range(400), 20)) + [1000] * (i % 2) for i in range(400)]
    index = toxicity.Index((i, i % 2, bytes([i % 256, i // 256]), [f"w{w}" for w in t], [1] * len(t)) for i, t in enumerate(texts))
    assert index.rows.size <= 5 * index.weight.size
    assert index.row[index.term["w1000"]] == 0 and len(index.rows) == 1
