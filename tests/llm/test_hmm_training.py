"""Training of the language model: every pass reads all training documents."""

import numpy as np
from pyspark.sql import functions as F

from footage_lake.llm import hmm


def _documents(n: int, classes: int):
    rng = np.random.default_rng(5)
    return [rng.integers(0, classes, rng.integers(1, 30)).astype("<u2") for _ in range(n)]


def test_every_pass_reads_all_training_documents(spark, monkeypatch):
    """4,000 documents, of which a third is held out; the model is that of plain passes over the others."""
    docs, share = _documents(4000, 12), np.full(12, 1 / 12)
    rows = spark.createDataFrame([(k, k % 3 == 1, bytearray(d.tobytes())) for k, d in enumerate(docs)], "doc_id bigint, held_out boolean, classes binary")
    read, summed = [], hmm._summed

    def counted(training, model):
        read.append(training.count())
        return summed(training, model)

    monkeypatch.setattr(hmm, "_summed", counted)
    model = hmm.train(rows, share)
    assert set(read) == {rows.where(~F.col("held_out")).count()} and len(read) == hmm.PASSES
    want = hmm.started(share)
    for _ in range(hmm.PASSES):
        sums = hmm._zeros(want)
        hmm.expected(want, [d for k, d in enumerate(docs) if k % 3 != 1], sums)
        want = hmm.remade(sums, share)
    for a, b in ((model.start, want.start), (model.move, want.move), (model.emit, want.emit)):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-5)


def test_expected_counts_by_plain_recursion(monkeypatch):
    """Blocks of several sizes and rare emissions; counts of starts, moves and emissions token by token."""
    rng = np.random.default_rng(1)
    model = hmm.Hmm(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.full(12, 0.5), 4).T + 1e-9)
    docs = _documents(60, 12) + [np.array([], "<u2"), rng.integers(0, 12, 400).astype("<u2")]
    want = hmm._zeros(model)
    for d in docs:
        if not len(d):
            continue
        a, b = [], [np.ones(4)]
        for t, c in enumerate(d):
            row = (model.start if t == 0 else a[-1] @ model.move) * model.emit[c]
            a.append(row / row.sum())
        for c in d[:0:-1]:
            row = model.move @ (model.emit[c] * b[0])
            b.insert(0, row / row.sum())
        for t, c in enumerate(d):
            g = a[t] * b[t] / (a[t] * b[t]).sum()
            want[2][c] += g
            if t == 0:
                want[0] += g
            if t + 1 < len(d):
                x = a[t][:, None] * model.move * (model.emit[d[t + 1]] * b[t + 1])
                want[1] += x / x.sum()
    for size in (50, 400_000):
        monkeypatch.setattr(hmm, "TRAINED", size)
        got = hmm._zeros(model)
        hmm.expected(model, docs, got)
        assert all(np.allclose(x, y, rtol=1e-4, atol=1e-4) for x, y in zip(got, want, strict=True))
