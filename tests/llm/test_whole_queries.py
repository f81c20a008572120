"""The registered queries with their own parameters, on whole small tables, against brute force and the libraries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe_transducer, config_packing, crf_quality, language_id, maxent_lm, minhash_join, suffix_levels, token_files

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{SF}/documents.parquet")
    return {int(i): t if isinstance(t, str) else "" for i, t in zip(d.doc_id, d.text)}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOW))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    posts = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            posts[x].add(i)
    near = {(i, j) for p in posts.values() for i in p for j in p if i < j}
    for i, j in near:
        both = len(sets[i] & sets[j])
        if 100 * both >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            least[b] = a
    want = {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert {tuple(r) for r in minhash_join.op3_minhash_join(spark, SF).select("doc_id", "n_shingles", "component_id", "kept").collect()} == want


def test_op4_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    done = language_id.op4_language_id(spark, sf).where("held_out").join(truth, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = done.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 200 and right >= 0.98


def test_op5_and_op7(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want, pieces = 0, set(), set()
    for i in sorted(texts):
        ids = library.encode(texts[i], add_special_tokens=False).ids + [1]
        want.add((i, at, len(ids), crc(ids)))
        pieces |= {(i, k, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))}
        at += len(ids)
    assert {tuple(r) for r in token_files.op5_token_files(spark, SF).collect()} == want
    rows = config_packing.op7_config_packing(spark, SF).collect()
    assert {tuple(r)[:5] for r in rows} == pieces and len(rows) == len(pieces)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 4096
    assert len(held) <= -(-at // 4096) + 2


def test_op6_at_its_length(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    n = Counter()
    for b in raw.values():
        n.update(hashlib.blake2b(b[k : k + 200], digest_size=16).digest() for k in range(len(b) - 199))
    want = set()
    for i, b in raw.items():
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if n[hashlib.blake2b(b[k : k + 200], digest_size=16).digest()] > 1:
                hit[k : k + 200] = True
        runs = int(np.sum(hit & ~np.r_[False, hit[:-1]])) if len(hit) else 0
        want.add((i, len(b), int(hit.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()))
    assert {tuple(r) for r in suffix_levels.op6_suffix_levels(spark, SF).collect()} == want


def test_op8(spark, texts):
    ranks = bpe_transducer.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, t in texts.items():
        ids = np.array(enc.encode_ordinary(t), "<u4")
        want.add((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r) for r in bpe_transducer.op8_bpe_transducer(spark, SF).collect()} == want


def test_op9_base(spark, texts):
    tokens = {i: WORD.findall(t.translate(LOW)) + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in maxent_lm.op9_maxent_lm(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 * max(1, len(t)) and r.score < 0


def test_op10_counts(spark, texts):
    for r in crf_quality.op10_crf_quality(spark, SF).collect():
        t = texts[r.doc_id]
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.base_failed and r.kept)


CLASHES = ["uid", "uid2", "key", "key2", "spans", "__uid", "__spans", "__n_lines", "block", "bucket", "batch", "held_out", "line", "token", "n", "lo", "digest"]


def test_clashing_names_in_every_operator_and_stage(spark, tmp_path):
    import corpus_pipeline

    plain = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    wide = plain.withColumns({c: F.lit("mine") for c in CLASHES})
    bag = lambda df: Counter(tuple(map(str, r)) for r in df.collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    runs = {
        "op3": lambda d: minhash_join.near_duplicates(d).drop("uid"),
        "op4": language_id.identify,
        "op6": lambda d: (lambda done: done[0].select("doc_id", F.array_sort(done[1]).alias("s")))(suffix_levels.with_spans(d)),
        "op7": lambda d: config_packing.pack(d).select("doc_id", "piece", "ids_crc32"),
        "op8": bpe_transducer.bpe_round_trip,
        "op9": lambda d: maxent_lm.score(d).select("doc_id", "n_tokens", "n_known"),
        "op10": lambda d: crf_quality.quality(d, labels),
    }
    for name, run in runs.items():
        assert bag(run(plain)) == bag(run(wide)), name
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    a, b = plain, wide
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        a, b = stage(spark, a, str(tmp_path)), stage(spark, b, str(tmp_path))
        if k < 4:
            assert b.columns == wide.columns and bag(a.select("doc_id", "text")) == bag(b.select("doc_id", "text")), name
            for tag, df in (("a", a), ("b", b)):
                df.write.parquet(str(tmp_path / f"{tag}{k}"))
            a, b = (spark.read.parquet(str(tmp_path / f"{t}{k}")) for t in "ab")


def test_pipeline_of_empty_documents(spark, tmp_path):
    import corpus_pipeline

    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
