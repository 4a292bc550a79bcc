"""The registered corpus queries: against their SQL, or against brute force where SQL cannot say the same."""

import glob
import hashlib
import os

import brute
import duckdb
import numpy as np
import pytest

from check import table_of
from tabwright.llm import pii
from tabwright.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_matches_sql(name, spark, sf, con):
    df = QUERIES[name].run(spark, sf)
    res = con.execute(QUERIES[name].sql)
    want = table_of([d[0] for d in res.description], res.fetchall())
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_language_model(spark, sf, texts):
    want, n = brute.language_model(list(texts.items()))
    rows = QUERIES["op2_language_model"].run(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = want[r.doc_id, texts[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (w[0], w[1], n, brute.held_out(r.doc_id))
        assert (r.base_score, r.score) == (pytest.approx(w[2], rel=1e-9), pytest.approx(w[3], rel=1e-5))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_personal_data(spark, sf, texts):
    for r in QUERIES["op3_personal_data"].run(spark, sf).collect():
        want = brute.personal_data(texts[r.doc_id])
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert set(filter(None, named.split(","))) <= set(r.spans.split(","))


def test_bpe_round_trip_and_counts(spark, sf, texts, library):
    counts = {r.doc_id: r for r in QUERIES["op9_token_counts"].run(spark, sf).collect()}
    for r in QUERIES["op5_bpe_round_trip"].run(spark, sf).collect():
        text = texts[r.doc_id]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        c = counts[r.doc_id]
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len(text.encode()), len(ids), len(ids) > 512)


def test_main_text(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op7_main_text"].run(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == (pages[r.page_id].url, brute.article(pages[r.page_id].html))
        assert r.n_chars == len(r.text)


def test_pipeline(spark, sf, texts, library):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in QUERIES["op10_quality_rules"].run(spark, sf).collect() if r.kept}
    assert out and {r.doc_id for r in out} <= kept
    assert all(r.round_trip for r in out)
    similar = brute.components({i: brute.shingles(texts[i], 4) for i in kept}, 85)
    assert all(similar[r.doc_id] == r.doc_id for r in out)
    # What comes out is the masked text, cut for one copy of a source at most.
    cut = 0
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.n_tokens == len(ids)
        text = library.decode(ids, skip_special_tokens=False)
        masked = brute.mask(texts[r.doc_id])
        if text != masked:
            cut += 1
            n = len(brute.WORD.findall(text))
            assert text == " ".join(brute.WORD.findall(masked)[:n])
    assert cut <= len({r.source for r in out})
