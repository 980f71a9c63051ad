"""The factorization machine against loops over single documents and columns, and pairs of rare terms."""

import numpy as np
import pytest

from contextquarry.llm import toxicity
from contextquarry.llm.toxicity import COLUMNS, FACTORS


def slow_fit(columns, labels, first, joint, rate=1.0, pair_rate=1.0, absent=12.0, apart=0.001, decay=0.001, batch=128, least=4, gate=4.0):
    """What fit does, a document and a column at a time."""
    n, rng = len(labels), np.random.default_rng(7)
    seen = {c: sum(c in set(d.tolist()) for d in columns) for d in columns for c in d.tolist()}
    scale = {c: min(1.0, max(0.0, np.log(n / k) / np.log(4))) if k >= least else 0.0 for c, k in seen.items()}
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias, lin, v = np.log(share / (1 - share)), dict.fromkeys(seen, 0.0), {c: np.zeros(FACTORS) for c in seen}
    lead, sq, vsq, bsq = dict.fromkeys(seen, 0.0), dict.fromkeys(seen, 0.0), {c: np.zeros(FACTORS) for c in seen}, 1.0
    docs = [[c for c in d.tolist() if scale[c] > 0] for d in columns]
    sigmoid = lambda z: 1 / (1 + np.exp(-min(max(z, -30), 30)))

    def margin(d, pairs):
        z = bias + sum(lin[c] * scale[c] for c in d)
        if pairs:
            own = [c for c in d if c in paired]
            z += sum(scale[a] * scale[b] * (v[a] @ v[b]) for i, a in enumerate(own) for b in own[:i])
        return z

    paired = set()
    for epoch in range(first + joint):
        pairs = epoch >= first
        if epoch == first:
            r2 = np.array([(sigmoid(margin(d, False)) - y) ** 2 for d, y in zip(docs, labels, strict=True)])
            for c in sorted(seen):
                if scale[c] > 0:
                    own = sum(r2[i] for i, d in enumerate(docs) if c in d)
                    if (own - seen[c] * r2.mean()) / (np.sqrt(seen[c]) * r2.std()) > gate:
                        paired.add(c)
            for c, x in zip(sorted(paired), rng.normal(0, 0.05, (len(paired), FACTORS)), strict=True):
                v[c] = x
            if not paired:
                break
        order = rng.permutation(n)
        for at in range(0, n, batch):
            own = order[at : at + batch]
            error = {i: sigmoid(margin(docs[i], pairs)) - labels[i] for i in own}
            total = sum(error.values())
            bsq += total**2
            bias -= rate * total / np.sqrt(bsq)
            grad, vgrad = {}, {}
            for i in own:
                sums = sum((v[c] * scale[c] for c in docs[i] if c in paired), np.zeros(FACTORS))
                for c in docs[i]:
                    if not pairs or c in paired:
                        grad[c] = grad.get(c, 0) + error[i] * scale[c]
                    if pairs and c in paired:
                        vgrad[c] = vgrad.get(c, 0) + error[i] * scale[c] * (sums - v[c] * scale[c])
            for c, g in grad.items():
                step = (np.sqrt(sq[c] + g**2) - np.sqrt(sq[c])) / rate
                lead[c] += g - step * lin[c]
                sq[c] += g**2
                lin[c] = -np.sign(lead[c]) * max(abs(lead[c]) - absent, 0) / ((1 + np.sqrt(sq[c])) / rate + decay)
            for c, g in vgrad.items():
                g = g + decay * v[c]
                vsq[c] += g**2
                step = pair_rate / np.sqrt(1 + vsq[c])
                new = v[c] - step * g
                v[c] = new * max(0, 1 - apart * step.mean() / max(np.sqrt((new**2).sum()), 1e-12))
    return bias, lin, v, paired


@pytest.mark.parametrize(("first", "joint"), [(1, 0), (1, 1), (2, 2)])
def test_epochs_of_fit_by_single_steps(first, joint):
    rng = np.random.default_rng(5)
    columns = [np.unique(rng.integers(0, 25, rng.integers(0, 9))) for _ in range(120)]
    labels = np.array([float((3 in c) != (4 in c)) for c in columns])
    options = dict(absent=0.5, batch=16, gate=0.2)
    fm = toxicity.fit(columns, labels, first, joint, pair_gate=1e9, **options)
    bias, lin, v, paired = slow_fit(columns, labels, first, joint, **options)
    assert fm.bias == pytest.approx(bias)
    assert fm.linear[:25] == pytest.approx([lin.get(c, 0.0) for c in range(25)])
    assert fm.factors[:25] == pytest.approx(np.array([v.get(c, np.zeros(FACTORS)) for c in range(25)]))
    assert bool(paired) == bool(joint) == bool(np.abs(fm.factors).any())


def test_pairs_of_rare_terms_are_learnt():
    """Two terms in 180 of 15,000 documents each; those with one of them are toxic, those with both are not."""
    rng = np.random.default_rng(3)
    columns, labels = [], []
    for i in range(15_000):
        own, kind = set((1000 + rng.integers(0, 3000, 30)).tolist()), 0 if i >= 270 else 1 + i % 3
        own |= {100} if kind in (1, 3) else set()
        own |= {200} if kind in (2, 3) else set()
        columns.append(np.array(sorted(own)))
        labels.append(float(kind in (1, 2) or (kind == 0 and rng.random() < 0.01)))
    fm = toxicity.fit(columns, np.array(labels))
    margin = lambda *c: float(fm.margin(np.array(c), np.array([0, len(c)]))[0])
    assert margin(100) > 0 and margin(200) > 0 and margin(100, 200) < 0
    linear = toxicity.fit(columns, np.array(labels), joint=0)
    assert float(linear.margin(np.array([100, 200]), np.array([0, 2]))[0]) > 0
    assert int((np.abs(fm.factors).sum(1) > 0).sum()) < COLUMNS // 100
