"""Filter audit, WARC archives and fill-in-the-middle: literal rows, brute force, damaged input and the queries' SQL."""

import base64
import hashlib
import io
import itertools
import re
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
import zstandard

from tessera.llm import filter_audit, queries, rank_index, warc

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\f\r"
ODD = [
    (1, "a b  c\n", "x"),
    (2, None, None),
    (3, "", "x"),
    (4, "\t \n", None),
    (None, "<P>in it", "x"),
    (None, None, "x"),
    (7, "Ärger über  Öl und 漢字 ", "y"),
    (7, "Ärger über  Öl und 漢字 ", "y"),
    (8, "w" * 70000 + " " + "x y " * 9000, "y"),
    (9, "UPPER Words AND more", "y"),
    (10, "a < S > b <S", "x"),
]
DOCS = "doc_id long, text string, source string"


def sorted_rows(df: pd.DataFrame) -> list[tuple]:
    clean = lambda v: None if v is None or v is pd.NA or v != v else v
    return sorted((tuple(clean(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_warc", "op13_fill_in_middle"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert sorted_rows(got) == sorted_rows(want)


def audited(docs, labels):
    rows = []
    for i, (doc_id, text, source) in enumerate(docs):
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * any(doc_id is not None and d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)
        rows.append((source or "", fails, any(d == doc_id and d is not None and q == 1 for d, q, _ in labels), any(d == doc_id and d is not None and x == 1 for d, _, x in labels)))
    out, taken = [], {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                gone = [r for r in mine if f in r[1] and not before & set(r[1])]
                taken[part, f] = taken.get((part, f), 0) + len(gone)
                kept = sum(not (before | {f}) & set(r[1]) for r in mine)
                out.append([part, "".join(order), step + 1, kept, len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
    return sorted((*r[:9], taken[r[0], r[9]]) for r in out)


def test_audit_of_odd_rows(spark):
    docs = [*ODD, (20, "many " * 300 + "$", "x"), (21, "many " * 300 + "$", "y"), (19, "many " * 300 + "$", None), (None, "many " * 300 + "$", None), (30, " ".join(f"w{i}" for i in range(250)), "x")]
    labels = [(20, 1, None), (20, 0, 1), (7, 1, 1), (None, 1, 1), (30, None, 0), (99, 1, 1)]
    found = filter_audit.audit(*filter_audit.failing_tables(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS uid", "2 AS part", "3 AS h1", "4 AS good", "5 AS A"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good", "2 AS text")))
    assert sorted(map(tuple, found.collect())) == audited(docs, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(*filter_audit.failing_tables(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
    clean = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(250)), "s")], DOCS)
    found = filter_audit.audit(*filter_audit.failing_tables(clean, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).toPandas()
    assert len(found) == 600 and set(found.kept) == {1} and set(found.shapley) == {0}


PAGES = [(5, "http://a/ b\r\nX: y", "<p>same</p>"), (3, None, "<p>same</p>"), (None, "u", "<p>same</p>"), (9, "u", None), (10, "u", ""), (11, "ü", "é" * 5000), (12, "z", "alone"), (12, "z", "alone"), (-4, "n", "<p>same</p>" * 20000)]


def test_archives_of_odd_pages(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS sha", "2 AS first", "3 AS n", "4 AS payload").repartition(3)
    found = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).toPandas()
    assert found.error.isnull().all()
    records = found[found.type != "warcinfo"]
    number = lambda s: None if s is None or s.split(":")[2] == "" else int(s.split(":")[2])
    got = sorted(((number(r.record_id), r.type, number(r.refers_to), r.payload_digest, r.payload_bytes, r.payload) for r in records.itertuples()), key=str)
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        again = first != page_id
        want.append((page_id, "revisit" if again else "response", first if again else None, base64.b32encode(hashlib.sha1(data).digest()).decode(), len(data), None if again else data))
    assert got == sorted(want, key=str)
    assert "http://a/%20b%0D%0AX:%20y" in set(records.target)


def test_small_payloads_are_no_revisits(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    found = warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w", min_revisit=12)).toPandas()
    assert set(found.type) == {"warcinfo", "response"}


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none, f"file://{tmp_path}/w")).count() == 0


def frame(data: bytes, **k) -> bytes:
    return zstandard.ZstdCompressor(**k).compress(data)


def rows_of(data: bytes) -> list[tuple]:
    return [(r[2], r[7], r[9], r[10]) for r in warc.records_of(io.BytesIO(data), len(data), "f", True)]


def test_dictionaries_plain_and_compressed():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, 8, dtype=np.uint8)) for _ in range(200)]
    sample = [b" ".join(words[i] for i in rng.integers(0, 200, 60)) for _ in range(400)]
    held = zstandard.train_dictionary(4096, sample)
    one = warc.page_record(1, "u", sample[0], base64.b32encode(hashlib.sha1(sample[0]).digest()).decode(), None)
    skip = lambda magic, x: struct.pack("<II", magic, len(x)) + x
    body = frame(one, dict_data=held) + skip(0x184D2A51, b"between") + frame(one, dict_data=held, write_checksum=True)
    for dictionary in (held.as_bytes(), frame(held.as_bytes())):
        assert rows_of(skip(warc.DICTIONARY_FRAME, dictionary) + body) == [("response", len(sample[0]), sample[0], None)] * 2
    assert "decoded" in rows_of(body)[-1][3] and "dictionary" in rows_of(skip(warc.DICTIONARY_FRAME, b"no such") + body)[0][3]


def test_damaged_records():
    digest = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    good = warc.page_record(1, "u", b"hello", digest, None)
    assert rows_of(frame(good)) == [("response", 5, b"hello", None)]
    for old, new, said in [
        (b"WARC/1.1", b"WARC/9.9", "begins"),
        (b"WARC-Date", b"WARC-Data", "warc-date is missing"),
        (b"\r\n\r\nHTTP", b"\r\n\r\nHTTPS", "stated"),
        (b"sha1:", b"sha1:A", "digest"),
        (b"WARC-Type: response", b"WARC-Type response", "no field"),
        (b"Content-Type: app", b"WARC-Date: 1\r\nContent-Type: app", "twice"),
        (b"Content-Length: 5", b"Content-Length: 4", "4 bytes are stated"),
    ]:
        assert said in rows_of(frame(good.replace(old, new, 1)) + frame(good))[0][3]
        # a damaged record doesn't keep the next from being read
        assert rows_of(frame(good.replace(old, new, 1)) + frame(good))[1][3] is None
    assert rows_of(frame(good + good))[0][3] is not None and rows_of(frame(good[:-2]))[0][3] is not None
    cut = frame(good) + frame(good)[:-3]
    assert [r[3] is None for r in rows_of(cut)] == [True, False]
    # frames of many blocks and of blocks of one repeated byte
    long = warc.page_record(2, "u", b"x" * 3_000_000, base64.b32encode(hashlib.sha1(b"x" * 3_000_000).digest()).decode(), None)
    noise = np.random.default_rng(2).bytes(6_000_000)
    wild = warc.page_record(3, "u", noise, base64.b32encode(hashlib.sha1(noise).digest()).decode(), None)
    assert [r[1] for r in rows_of(frame(long) + frame(wild) + frame(good))] == [3_000_000, 6_000_000, 5]


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(tokens), form, len(p), len(m), out


def test_middle_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab<SPM>ö漢 \n\t\x0b ")) for _ in range(rng.integers(0, 60))) for _ in range(400)]
    docs = [*ODD, *((100 + i, t, "r") for i, t in enumerate(texts)), (1000, "word " * 300_000, "long")]
    table = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS n", "2 AS form", "3 AS h1", "4 AS cut1", "5 AS sha")
    done = rank_index.fill_in_middle(table)
    got = done.withColumn("back", rank_index.restored(done["output"], done["form"])).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((middle(d, t) for d, t, _ in docs), key=str)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t, _ in docs)
    assert rank_index.fill_in_middle(table.limit(0)).count() == 0


def test_marks_that_cannot_be_found_again(spark):
    table = spark.createDataFrame(ODD, DOCS)
    for marks in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<<", "<S>", "<M>"), ("<P>", "[S]", "<M>")):
        with pytest.raises(ValueError):
            rank_index.fill_in_middle(table, marks=marks)


@pytest.mark.parametrize("bound", [1, 5, 127])
def test_index_is_exact_and_bounded(bound):
    rng = np.random.default_rng(bound)
    for sizes in (rng.integers(1, 9, 20_000), rng.geometric(0.001, 3000), np.ones(9000, int), np.r_[np.ones(5000, int), 10**9, np.ones(5000, int)]):
        offsets = np.cumsum(sizes)
        borders = np.unique(np.r_[0, rng.integers(0, len(offsets), 7), len(offsets)])
        index = rank_index.fitted(offsets, borders, bound)
        ranks = np.arange(len(offsets))
        assert (index.offsets(ranks) == offsets).all()
        assert np.abs(index.predicted(ranks) - offsets).max() <= bound
        assert set(borders[:-1]) <= set(index.first) and len(index.first) < len(offsets)


def test_stored_index(spark):
    table = spark.createDataFrame(ODD, DOCS)
    rows = rank_index.boundary_index(table).selectExpr("*", "explode(sequence(0L, n - 1)) AS k").where("n > 0")
    got = rows.select("doc_id", "k", rank_index.stored_offset(rows["k"]).alias("end")).collect()
    want = [(d, k, len("".join(TOKEN.findall(t or "")[: k + 1]).encode())) for d, t, _ in ODD for k in range(len(TOKEN.findall(t or "")))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
