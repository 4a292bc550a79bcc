"""Stages of the pipeline on nulls, empty and long texts, repeated ids and rows, empty tables and further columns; word hashes that hold."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tabwright.llm import words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string"
WORDY = " ".join(f"w{k}" for k in range(60))
OTHER = " ".join(f"x{k}" for k in range(60))
LONG = " ".join(f"y{k % 5000}z{k % 7}" for k in range(30_000))
ROWS = [
    (1, WORDY, "en", "a"),
    (2, WORDY + " more", "en", "a"),
    (3, OTHER, "en", None),
    (3, WORDY.upper(), "de", "a"),  # one id, one text that is a copy and one that is not
    (4, OTHER + " end", None, "b"),
    (4, LONG, "en", "b"),
    (5, LONG + " end", "en", "b"),
    (5, LONG + " end", "en", "b"),
    (None, OTHER, "en", "b"),
    (None, " ".join(f"q{k}" for k in range(40)), "en", "b"),
    (6, None, "en", "c"),
    (7, "", "en", "c"),
    (7, "", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in ROWS], DOCS).repartition(3)


def test_copies_are_removed_by_row(spark, docs):
    out = corpus_pipeline.dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()))
    want = [(1, WORDY), (3, OTHER), (4, LONG), (6, ""), (7, ""), (7, ""), (None, " ".join(f"q{k}" for k in range(40)))]
    assert got == sorted((i is None, i or 0, t) for i, t in want)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_every_stage_takes_any_table(spark, docs, name, stage):
    for some in (docs, docs.limit(0)):
        out = stage(spark, some, "")
        rows = out.collect()
        assert name == "BPE round trip" or out.columns == docs.columns
        assert len(rows) <= 3 * len(ROWS) and (some is docs) == bool(rows)


def test_words_of_structure_do_not_collide():
    for n in (256, 512, 1024, 4096):
        bits = np.array([bin(k).count("1") % 2 for k in range(n)], np.uint8)
        pair = [bytes(np.where(b, 97, 98).astype(np.uint8)).decode() for b in (bits, 1 - bits)]
        data, offsets = np.frombuffer("".join(pair).encode(), np.uint8), np.array([0, n, 2 * n])
        h, _ = words.words(data, offsets)
        assert len(set(h.tolist())) == 2
        assert len(set(words.hash_texts(pa.array(pair)).tolist())) == 2
    texts = [c * k for c in "ab" for k in (7, 8, 9, 255, 256, 257)] + ["\x00", "\x00\x00", "a\x00", ""]
    assert len(set(words.hash_texts(pa.array(texts)).tolist())) == len(texts)


def test_bpe_worker_holds_little_beside_the_heap():
    """The workers of an executor's cores share what its heap leaves, after the stages before them."""
    import sys

    from tabwright.llm import bpe
    from tabwright.llm.queries import tokenizer_path

    tokenizer = bpe.ByteBPE(tokenizer_path())
    digits = str.maketrans("0123456789", "abcdefghij")
    for at in range(0, 500_000, 20_000):
        text = " ".join(str(k * 7919 + 10**8).translate(digits) for k in range(at, at + 20_000))
        assert tokenizer.decode(tokenizer.encode([text])) == [text]
    held, seen = 0, set()
    for memory in (tokenizer.words, tokenizer.tokens, tokenizer.pieces):
        for d in (memory.young, memory.old):
            held += sys.getsizeof(d)
            for o in (*d.keys(), *d.values()):
                held += 0 if id(o) in seen else sys.getsizeof(o)
                seen.add(id(o))
    assert held < 80 << 20
    assert bpe.BATCH <= 1 << 19


def test_bpe_workers_keep_no_tokenizer_after_their_tasks(spark):
    """An idle worker's memory stands beside the heap of the stages that follow."""
    from tabwright.llm import bpe
    from tabwright.llm.queries import tokenizer_path

    def kept(batches):
        from tabwright.llm import bpe

        for _ in batches:
            yield pa.record_batch([pa.array([bpe.load.cache_info().currsize])], names=["kept"])

    df = spark.createDataFrame([(k, f"text number {k}") for k in range(40)], "doc_id long, text string").repartition(4)
    assert bpe.encode_and_decode(df, tokenizer_path()).where("decoded = text").count() == 40
    assert [r.kept for r in spark.range(0, 8, 1, 8).mapInArrow(kept, "kept long").collect()] == [0] * 8


def test_packing_counts_holds_few_copies_of_a_block():
    import tracemalloc

    from tabwright.llm import jaccard_join

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, 700, dtype=np.uint64)) for _ in range(2000)]
    sets += [s.copy() for s in sets[:50]]
    keys, counts = np.unique(jaccard_join.cut_hash(np.concatenate(sets), 8), return_counts=True)
    size = sum(s.nbytes for s in sets)
    tracemalloc.start()
    held = [s.copy() for s in sets]
    rows = jaccard_join.pack_counts(held, 8).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not held and peak < 4.5 * size
    got, many = [], []
    for r in rows:
        gaps = np.frombuffer(r["gaps"], np.uint16).astype(np.uint64)
        gaps[gaps == 65535] = np.frombuffer(r["wide"], np.uint32)
        got.append(np.cumsum(gaps) + (np.uint64(r["shard"]) << np.uint64(31)))
        c = np.ones(len(gaps), np.int64)
        c[np.frombuffer(r["at"], np.uint32)] = np.frombuffer(r["counts"], np.uint32)
        many.append(c)
    assert np.array_equal(np.concatenate(got), keys) and np.array_equal(np.concatenate(many), counts)
