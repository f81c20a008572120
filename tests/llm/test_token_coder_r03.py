"""The token coder's lanes and its search, against plain loops."""

import numpy as np

from tessera.llm import token_coder


def test_blocks_of_a_task_run_side_by_side(monkeypatch):
    """Segments end at documents, so a task's eight have a few blocks over 2,048; these take no run of their own."""
    monkeypatch.setattr(token_coder, "BLOCK", 8)
    runs, models = [], token_coder._Models
    monkeypatch.setattr(token_coder, "_Models", lambda *a: runs.append(1) or models(*a))
    segments = [np.random.RandomState(i).zipf(1.4, 8 * 257 - i) % 5000 for i in range(8)]
    data = b"".join(token_coder.encode_segments(segments))
    assert (token_coder.decode_blocks(data) == np.concatenate(segments)).all()
    assert len(runs) == 2  # one to encode, one to decode


def test_every_target_finds_its_rank():
    """Dictionaries of unequal lengths in one run, before and after ids have been counted."""
    rng = np.random.RandomState(1)
    tables = [token_coder._prior(np.sort(rng.randint(0, 90, n).astype(np.uint8))[::-1]) for n in (1, 40, 3000)]
    m = token_coder._Models(tables, np.array([2, 0, 1, 2]), True)
    for _ in range(2):
        for lane, table in enumerate(m.whose):
            n = len(tables[table][0])
            edges = m.sums[lane, : n + 1].astype(np.int64)
            targets = np.arange(edges[-1])
            counts = m.counts.copy()
            ranks, before, own = m.find(np.full(len(targets), lane), targets)
            want = np.searchsorted(edges, targets, "right") - 1
            assert (ranks == want).all() and (before == edges[want]).all() and (own == np.diff(edges)[want]).all()
            m.counts[:] = counts
            m.counts[lane, :n] += rng.randint(0, 3, n).astype(np.uint16) if n < 100 else np.uint16(rng.rand(n) < 0.2)
        m.renew(4)
