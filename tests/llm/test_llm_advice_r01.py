"""Cases of the review's first round, each one wrong before its change."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import config_packing, exact_topk, minhash_join, token_files


def test_added_tokens_are_one_id_in_queries(spark, tmp_path):
    import corpus_pipeline

    texts = ["a <|endoftext|> b", "x<|endoftext|>Y <|ENDOFTEXT|> z\n<|startoftext|><|endoftext|>", "<|endo\nftext|> don't é<|endoftext|>é", "<|endoftext|>", "Plain text.", "", None, "e<|startoftext|>́ a.<|endoftext |>"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at, pieces = Counter(), 0, Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        want[i, at, len(ids), crc] += 1
        pieces[i, 0, 0, len(ids), crc] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in token_files.op5_token_files(spark, str(tmp_path)).collect()) == want
    assert Counter(tuple(r)[:5] for r in config_packing.op7_config_packing(spark, str(tmp_path)).collect()) == pieces
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(tuple(r)[:5] for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()) == pieces


def test_pipeline_drops_identical_short_and_digit_lines(spark, tmp_path):
    import corpus_pipeline

    lines = ["Page 3 of 10", "Read more", "日本語の文章です", "2024-01-02 10:11:12 99.5 ok"]
    rows = [(i, "\n".join([f"own{i}", *lines, "Yes.", " \t       ", f"Page {i} of {i}7"])) for i in range(4)] + [(9, lines[0] + "\n" + lines[0]), (None, lines[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert done[0] == "\n".join(["own0", *lines, "Yes.", " \t       "])
    for i in (1, 2, 3):
        assert done[i] == "\n".join([f"own{i}", "Yes.", " \t       "])
    assert set(done) == {0, 1, 2, 3}


def test_pipeline_drops_templates_of_numbers(spark, tmp_path):
    import corpus_pipeline

    # the words that differ in the last two kinds of line are no fields of a log, and one constant field is too few
    rows = [(i, f"{w} begins\nPage {i} of {i}7\nIn the year {w} {w}1 {w}\n{w}\nat {i}:0{i} {i}.5") for i, w in enumerate("one two three four".split())]
    docs = spark.createDataFrame([*rows, (8, "Page 1 of 2"), (9, None), (10, "")], "doc_id long, text string")
    done = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert done == {0: rows[0][1], 9: None, 10: "", **{i: t.replace(f"Page {i} of {i}7\n", "") for i, t in rows[1:]}}


def test_pipeline_keeps_documents_that_share_half_of_their_key(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    whole = minhash_join.row_id

    def half():
        first, second = whole()
        return [F.when(F.col("doc_id") < 3, F.lit(7).cast("long")).otherwise(first), second]

    monkeypatch.setattr(minhash_join, "row_id", half)
    monkeypatch.setattr(corpus_pipeline, "row_id", half)
    said = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)]
    rows = [(1, said[0], "u"), (2, said[1], "v"), (2, said[1], "v"), (3, said[2], "u"), (4, said[2], "u"), (5, None, "v"), (None, said[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __uid string")
    got = Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect())
    assert got == Counter([rows[0], rows[1], rows[3], rows[5], rows[6]])


def test_top_k_meets_candidates_of_its_own_width(spark):
    rng = np.random.RandomState(1)
    rows = [(i, [float(x) for x in rng.randn(2 + (i >= 40))]) for i in range(60)] + [(99, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = {i: np.floor(64 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows}
    want = set()
    for i in v:
        best = sorted((-int(v[i] @ v[j]), j) for j in v if j != i and len(v[j]) == len(v[i]))[:5]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert {tuple(r) for r in exact_topk.top_k(df, df, 5).collect()} == want
