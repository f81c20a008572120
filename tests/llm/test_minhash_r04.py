"""What near-duplicates take of the disk, each one wrong before its change."""

import numpy as np
import pyarrow as pa

from tessera.llm import minhash_join


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_texts_that_share_a_phrase_alone_are_no_family(spark, monkeypatch):
    # forty texts of one phrase and words of their own, and three near copies of another
    phrase = " ".join(f"p{i}" for i in range(30))
    texts = [phrase + " " + " ".join(f"t{k}w{i}" for i in range(60)) for k in range(40)]
    base = [f"b{i}" for i in range(200)]
    texts += [" ".join(base), " ".join([*base[:199], "x"]), " ".join(["y", *base[1:]])]
    rows, keep = {}, minhash_join.written

    def counted(df, name):
        table = keep(df, name)
        rows.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(minhash_join, "written", counted)
    monkeypatch.setattr(minhash_join, "SHORT", 2)  # as if all lists were long
    done = minhash_join.near_duplicates(docs_of(spark, texts), 3, 85)
    assert sorted((r.doc_id, r.component_id) for r in done.collect()) == [*((k, k) for k in range(40)), (40, 40), (41, 40), (42, 40)]
    assert max(rows["near-listed"]) > 40 and rows["near-families"] == [0]  # before, all that share a list
    assert sum(rows["near-asked"]) <= 6  # texts are read for pairs that may be linked alone


def test_marks_agree_wherever_signatures_do():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 32, (50, minhash_join.COORDINATES)).astype("<u4")
    b = np.where(rng.random(a.shape) < np.linspace(0, 1, 50)[:, None], a, rng.integers(0, 1 << 32, a.shape).astype("<u4")).astype("<u4")
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([9] * 100), pa.array([x.tobytes() for x in (*a, *b)], pa.binary())], ["uid", "n", "signature"])
    out = next(minhash_join.marked(iter([batch])))
    lo, hi = out.column("lo").to_numpy(), out.column("hi").to_numpy()
    same = minhash_join.alike(lo, hi, np.arange(50), np.arange(50, 100))
    assert (same >= (a == b).sum(1)).all() and (same == ((a & 3) == (b & 3)).sum(1)).all()


def test_blocks_of_lists_connect_what_may_be_linked(spark, monkeypatch):
    # sets of 100 shingles; 0 to 5 are alike and 6 is not, 3 is of 2's part; blocks of a list give links, not pairs
    mark = [0, 0, 1, 1, 0, 2, 0x0F0F0F0F0F0F0F0F]
    rows = [(7, 0, 0, k, 2 if k == 3 else k, 100, m, m) for k, m in enumerate(mark)] + [(8, 0, 0, 9, 9, 100, 0, 0), (8, 0, 0, 10, 10, 119, 0, 0)]
    table = pa.Table.from_pylist([dict(zip(("token", "i", "j", "uid", "part", "n", "lo", "hi"), r)) for r in rows])
    for size in (1, 4, 100):
        monkeypatch.setattr(minhash_join, "PAIRS", size)
        got = [tuple(r.values()) for b in minhash_join.connecting(85, 39)(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert got == [(0, k) for k in range(1, 6)]
