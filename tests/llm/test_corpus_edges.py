"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for every operator."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import bpe, components, embedding_dedup, html_extract, jaccard_join, mixing, ngram_lm, pii, preference_format, quality, token_counts, words
from tabwright.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
ODD = "A b\u0085c​ d\x1ce\t　f \U0001f600 <|endoftext|> x"
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, LONG, "en", None, 1),
    (5, LONG, "en", "b", 1),
    (6, ODD, None, "b", 1),
    (None, "some words without any id here", "en", "b", 1),
    (7, "one two", "en", "c", 7),
    (7, "one two", "en", "c", 7),
    (8, "ONE two", "en", "c", 7),
    (9, "y" * 200_000, "en", "c", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def test_words_and_hashes_at_chunk_borders(monkeypatch):
    import pyarrow as pa

    random.seed(1)
    texts = ["".join(random.choice("aB \né") for _ in range(random.randint(0, 40))) for _ in range(300)] + ["q" * 500, ""]
    seen = {}
    for chunk in (7, 64, 1 << 21):
        monkeypatch.setattr(words, "CHUNK", chunk)
        for first, stop, data, offsets in words.slices(pa.array(texts), 100):
            h, bounds = words.words(data, offsets)
            for i, t in enumerate(texts[first:stop]):
                own = brute.words(t)
                assert bounds[i + 1] - bounds[i] == len(own)
                for w, x in zip(own, h[bounds[i] : bounds[i + 1]].tolist()):
                    assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_embeddings(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, [2.0, 4.0, 6.0], 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [1.0, float("nan"), 3.0], 0), (9, [float("inf"), 1.0, 1.0], 0), (10, [], 0), (11, [1.0, 2.0], 0), (None, v, 0), (2, [2.0, 4.0, 6.0], 0), (12, [1e300, 2e300, 3e300], 0)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links string, node int")
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(out) == 13
    for i, (n, c) in {1: (2, 1), 2: (2, 1), 12: (2, 1), **{k: (0, k) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)}}.items():
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (n, c, i == c)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_against_all_pairs_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 24))
    x = np.concatenate([c + 0.3 * rng.standard_normal((40, 24)) for c in centre] + [rng.standard_normal((60, 24))])
    rows = [(i, r.tolist(), i % 2) for i, r in enumerate(x)]
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T >= 0.93 * np.outer(n, n)) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(near, False)
    assert near.sum() > 500
    assert [out[i].n_links for i in range(len(x))] == near.sum(1).tolist()


def _walk(rng, start, steps, degrees):
    """Vectors of which each stands at an angle to the one before."""
    out = [start / np.linalg.norm(start)]
    for _ in range(steps):
        side = rng.standard_normal(len(start))
        side -= (side @ out[-1]) * out[-1]
        out.append(np.cos(np.radians(degrees)) * out[-1] + np.sin(np.radians(degrees)) * side / np.linalg.norm(side))
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_embedding_components_of_chains_and_bridged_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(7)
    rows = []
    for label in range(3):
        x = [v for degrees in (15, 9, 4) for v in _walk(rng, rng.standard_normal(24), 100, degrees)]
        bridge = _walk(rng, rng.standard_normal(24), 6, 19)
        x += bridge + [e + 0.03 * rng.standard_normal(24) for e in (bridge[0], bridge[-1]) for _ in range(30)]
        rows += [(v, label) for v in x]
    order = rng.permutation(len(rows))
    x, label = np.stack([rows[k][0] for k in order]), np.array([rows[k][1] for k in order])
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T >= 0.93 * np.outer(n, n)) & (label[:, None] == label)
    want, before = np.arange(len(x)), None
    while before is None or (want != before).any():
        before, want = want, np.where(near, want, len(x)).min(1)
    schema = "vec_id long, embedding array<double>, label int"
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label))], schema)).collect()}
    assert [out[k].n_links for k in range(len(x))] == (near.sum(1) - 1).tolist()
    assert [out[k].component_id for k in range(len(x))] == want.tolist()
    assert [out[k].kept for k in range(len(x))] == (want == np.arange(len(x))).tolist()


def test_links_of_a_group_stay_connected():
    above = embedding_dedup.forest(6, np.array([1, 3, 4]), np.array([3, 4, 2]))
    assert sorted(tuple(sorted((k, a))) for k, a in enumerate(above.tolist()) if a >= 0) == [(1, 3), (2, 4), (3, 4)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(None, 3), (5, 5)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert {out[k] for k in range(31)} == {0} and {out[k] for k in range(100, 160)} == {100}


def test_language_model(spark, docs, empty):
    rows = [(i, t) for i, t, *_ in ROWS]
    want, n = brute.language_model(rows)
    model = ngram_lm.fit(docs.where(ngram_lm.learned("doc_id")))
    got = ngram_lm.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert model.tokens == n and len(got) == len(ROWS)
    for r in got:
        w = want[r.doc_id, r.text]
        assert (r.n_tokens, r.n_known) == w[:2]
        assert (r.base_score, r.score) == (pytest.approx(w[2], rel=1e-9), pytest.approx(w[3], rel=1e-5))
    nothing = ngram_lm.fit(empty)
    assert ngram_lm.score(empty, nothing).count() == 0
    assert all(r.score == 0 for r in ngram_lm.score(docs, nothing).collect())


def test_language_model_spreads_frequent_words(spark, docs, monkeypatch):
    plain = ngram_lm.fit(docs)
    before = sorted((str(r.doc_id), r.score) for r in ngram_lm.score(docs, plain, keep=["doc_id"]).collect())
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 5000)
    spread = ngram_lm.fit(docs)
    assert spread.pair_shards > 10
    assert sorted((str(r.doc_id), pytest.approx(r.score)) for r in ngram_lm.score(docs, spread, keep=["doc_id"]).collect()) == before


def test_language_model_sums_to_one(spark):
    import pyarrow as pa

    model = ngram_lm.fit(spark.createDataFrame([("a b a c",), ("a b b",), ("c a b a",)], "text string"))

    def logs(text):
        ((_, _, data, offsets),) = words.slices(pa.array([text]))
        return ngram_lm.log_probabilities(model, ngram_lm.tokens(model, *words.words(data, offsets)))

    for context in ("a", "c", "unseen"):
        after = [logs(f"{context} {last}")[1] for last in ("a", "b", "c", "unknown")] + [logs(context)[1]]
        assert sum(10**x for x in after) == pytest.approx(1, rel=1e-5)


def test_personal_data(spark, docs, empty):
    extra = spark.createDataFrame([(20, "tel (427) 555-5262, mail a@b.com.", "en", "s", 1), (21, "x" * 50_000 + "@", "en", "s", 1)], DOCS)
    df = docs.unionAll(extra).withColumn("spans", F.lit(1))
    classifier = pii.fit(df)
    out = by_id(pii.find_spans(df, classifier))
    assert len(out) == len(ROWS) + 2
    assert [r.spans for r in out if r.doc_id == 20][0].split(",")[0] == "email:25:32"
    assert all(r.spans == "" for r in out if r.doc_id in (1, 2, 3))
    masked = {r.doc_id: r.text for r in pii.redact(df, classifier).collect()}
    assert masked[1] is None and masked[2] == "" and "[EMAIL]" in masked[20] and masked[4] == LONG
    assert pii.find_spans(empty, pii.fit(empty)).count() == 0


WIDE_SPANS = [
    ("email", "write to jane AT x DOT org now", "jane AT x DOT org"),
    ("email", "mail joe.b [at] mail (dot) example (dot) com.", "joe.b [at] mail (dot) example (dot) com"),
    ("email", "a_b (at) example.com, please", "a_b (at) example.com"),
    ("ip", "host 2001:db8::1 is up", "2001:db8::1"),
    ("ip", "server fe80::1", "fe80::1"),
    ("ip", "[::1]", "::1"),
    ("ip", "at 2001:0db8:0000:0000:0000:ff00:0042:8329.", "2001:0db8:0000:0000:0000:ff00:0042:8329"),
    ("phone", "call (555) 123-4567 today", "(555) 123-4567"),
    ("phone", "tel 0044 20 7946 0958", "0044 20 7946 0958"),
    ("card", "visa 4111/1111/1111/1111", "4111/1111/1111/1111"),
]


def test_personal_data_wider_spans():
    for kind, text, want in WIDE_SPANS:
        found = {k: [text[a:b] for a, b in v] for k, v in pii.wide_spans(text, pii.base_spans(text)).items()}
        assert found == {k: [want] if k == kind else [] for k in pii.KINDS}, text
    for clean in ("look at example.com", "we met at noon on a dot", "std::string and a::b::c", "ratio 3:4 at 12:30:45", "x::y", "join us at the dot"):
        assert not any(pii.wide_spans(clean, pii.base_spans(clean)).values()), clean


def test_personal_data_wider_spans_are_reported(spark):
    """Trained on a corpus of plain spans and wider ones, the classifier reports each wider one where it stands."""
    plain = ["mail ann@example.com or call +44 20 7946 0958", "server 10.1.2.3 is up", "card 4111 1111 1111 1111 please", "nothing to see at all"]
    rows = [(k, t) for k, t in enumerate(plain * 40 + [t for _, t, _ in WIDE_SPANS] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_spans(df, pii.fit(df)).collect()}
    for k, t in rows[160:]:
        kind, _, want = next(w for w in WIDE_SPANS if w[1] == t)
        a = t.index(want)
        assert got[k].spans == f"{kind}:{a}:{a + len(want)}" and got[k].base_spans == "", t
    assert all(got[k].spans == got[k].base_spans and bool(got[k].spans) == (k % 4 < 3) for k in range(160))


def test_personal_data_overlaps_as_by_comparing_all():
    rng = random.Random(8)
    parts = ["10.1.2.3", "+44 20 7946 0958", "(555) 123-4567", "a@b.com", "x [at] y [dot] org", "4111/1111/1111/1111", "2001:db8::1", "4111 1111 1111 1111", "7", " ", ", ", "-"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        base = pii.base_spans(text)
        taken = [s for v in base.values() for s in v]
        want = {k: [m.span() for m in p.finditer(text) if not any(a < m.end() and m.start() < b for a, b in taken)] for k, p in pii.WIDE.items()}
        assert pii.wide_spans(text, base) == {k: want[k] for k in pii.KINDS}
    long = " ".join(f"u{k}@example.com (555) 123-{k % 10000:04d}" for k in range(20_000))
    assert len(pii.wide_spans(long, pii.base_spans(long))["phone"]) == 20_000  # minutes where all spans are compared


def test_personal_data_labelers_are_weighed():
    v = np.array([(1, 1, 1, 0, 1), (0, 1, 1, 1, 1), (0, -1, -1, -1, 1), (0, 1, -1, 0, -1)])
    real, reliable = pii.expectation_maximisation(v, np.array([500.0, 40.0, 60.0, 5.0]))
    assert real[0] > 0.95 and real[1] > 0.9 and real[2] < 0.1
    assert ((reliable > 0) & (reliable < 1)).all()


def test_mixing(spark, docs, empty):
    out = mixing.mix(docs.withColumn("taken", F.lit("clash"))).collect()
    assert len(out) == len(ROWS)
    sizes, taken, target = {}, {}, {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"] and r["size"] == len(brute.WORD.findall(r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 and target[s] <= 3 * sizes[s]
    written = mixing.write_out(mixing.mix(docs)).collect()
    assert sum(len(brute.WORD.findall(r.text)) for r in written) == sum(taken.values())
    assert mixing.mix(empty).count() == 0


def test_bpe(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    back = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("clash")), tokenizer_path()), tokenizer_path(), text_col="again").collect()
    assert len(back) == len(ROWS)
    for r in back:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.again == (r.text or "")
    assert bpe.encode(empty, tokenizer_path()).count() == 0
    broken = spark.createDataFrame([(np.array([50255, 999_999, 447, 50256], "<u4").tobytes(),), (None,)], "ids binary")
    assert [r.text for r in bpe.decode(broken, tokenizer_path()).collect()] == [library.decode([50255, 447, 50256], skip_special_tokens=False), ""]


def test_bpe_like_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    random.seed(4)
    own, library = bpe.load(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    some = list(" \n\t\x0b\x1c\x85 　abcXYZ019'sdtmre.,!éß中\U0001f642́‍½²") + ["<|endoftext|>", "'ll", "  ", "\n\n"]
    texts = ["".join(random.choice(some) for _ in range(random.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(chr(random.choice([random.randint(0, 0x2FF), random.randint(0x300, 0xD7FF), random.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(2000)]
    for e, want in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(e, "<u4").tolist() == want.ids


def test_bpe_cuts_batches_like_the_library():
    from tokenizers import Tokenizer

    random.seed(5)
    own, library = bpe.load(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    some = list(" '' strevmldS\n\t1!\x00\x01é\u3000\u00a0中\U0001f642") + ["'ll", "'re", "<|endoftext|>", "  ", "", "\U0001fae8"]
    texts = ["".join(random.choices(some, k=random.randint(0, 14))) for _ in range(8000)]
    at = 0
    while at < len(texts):
        part = texts[at : at + random.choice([1, 2, 7, 2000])]
        packed = own.encode(part)
        assert [np.frombuffer(e, "<u4").tolist() for e in packed] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert own.decode(packed) == part
        at += len(part)
    assert own.encode([]) == own.decode([]) == [] and own.decode(own.encode(["", ""])) == ["", ""]
    long = " ".join(random.choices(["word", "don't", "a\n", " ", "né", "12"], k=300_000))
    assert len(own.parts(long)) > 1 and np.frombuffer(own.encode([long])[0], "<u4").tolist() == library.encode(long, add_special_tokens=False).ids
    halves = [np.array([i], "<u4").tobytes() for i in library.encode("\x80", add_special_tokens=False).ids]
    assert own.decode([b"".join(halves)]) == ["\x80"]
    if len(halves) > 1:
        assert own.decode(halves) == ["\ufffd"] * len(halves)


def test_bpe_needs_few_calls_for_new_words():
    """Pre-tokens, cuts and merges of words not met before are found for a whole batch, not word by word."""
    import sys

    own, n, calls = bpe.ByteBPE(tokenizer_path()), 20_000, 0
    digits = str.maketrans("0123456789", "abcdefghij")
    text = " ".join(str(k * 7919 + 10**8).translate(digits) for k in range(n))
    own.encode([text[:100]])

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        packed = own.encode([text])
    finally:
        sys.setprofile(None)
    assert own.decode(packed) == [text]
    assert calls < 2 * n


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    out = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), tokenizer_path()).collect()
    assert [r.n_tokens for r in out] == [len(library.encode(r.text or "", add_special_tokens=False).ids) for r in out] and len(out) == len(ROWS)
    assert token_counts.count_tokens(empty, tokenizer_path()).count() == 0


PAGE = """<html><body class="has-sidebar"><header class="site-header"><p>My site.</p></header><nav><a href=/>Home</a></nav><div id="main"><article><header><h1>Title &amp; more</h1></header>
<p>First paragraph of some length, with a <a href=x>link</a>
  and   spaces.<p>Second &lt;b&gt; one,<br>after a break. It is long enough to be read.</p><script>var a = "<p>no</p>";</script><aside>See also this.</aside>
<form><p>Subscribe to us.</p></form><div class="comments"><article><p>I liked this text a lot, thank you for it.</p></article></div></article></div>
<div class="cookie-notice">We use cookies, as everyone does.</div><footer>&copy; us</footer></body></html>"""


def test_html(spark, empty):
    pages = [(1, PAGE), (2, PAGE), (3, None), (4, ""), (5, "No markup at all, but a text of some length, which is worth reading. " * 6), (6, "<p>" * 3000 + "x"), (7, PAGE[:400]), (8, "<<<>>&&#x41;&nope; <a <b")]
    df = spark.createDataFrame(pages * 3, "page_id long, html string").withColumn("text", F.lit(5))
    out = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    want = "Title & more\n\nFirst paragraph of some length, with a link and spaces.\n\nSecond <b> one, after a break. It is long enough to be read."
    assert out[1] == out[2] == want
    assert out[3] == out[4] == "" and out[5] == pages[4][1].strip() and out[7].startswith("Title & more")
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<head><title>T</title><body><article><p>One.</p></article>", ["One."]),
        ("<html><head><meta charset=x><title>T</title><link href=y><script>'</head>'</script><p>One.<p>Two.", ["One.", "Two."]),
        ("<head><title>T</title><noscript><style>x</style><img src=p></noscript>One.", ["One."]),
        ("<head><title>T</title></head><body>One.", ["One."]),
        ("<p>One.</p><datalist><option>A<option>B</datalist><p>Two.</p><select><option>C</option></select>", ["One.", "Two."]),
        ("<div><select><option>A<option>B</select>One.</div><p>Two.", ["One.", "Two."]),
        ("<div><select><option>A<option>B</div><p>Two.", ["Two."]),
        *((f"<div><p>One.<{t} id=x></p><p>Two.</p></div><p>Three.</p>", ["One.", "Two.", "Three."]) for t in ("object", "iframe", "canvas", "svg", "noscript", "template")),
        *((f"<body><{t} id=x>gone<p>One.<p>Two.", ["One.", "Two."]) for t in ("object", "iframe", "canvas")),
        *((f"<div><p>One.<{t} id=x></p><p>Two.</p></div><div><{t}><p>gone</p></{t}>Three.</div>", ["One.", "Two.", "Three."]) for t in ("object", "iframe", "canvas")),
        ("<p>One.</p><object><object><p>gone</p></object>gone</object><p>Two.", ["One.", "Two."]),
        ("<p><a><svg><path></a>One.</p><a><svg><path/></svg></a>Two.", ["One.", "Two."]),
        ("<p>One.</p><script>if (a < b) '<p>gone</p>'", ["One."]),
    ],
)
def test_html_invisible_elements_without_an_end(page, want):
    assert [b.text for b in html_extract.blocks_of(page)] == want


def test_html_main_text_behind_a_head_without_an_end():
    page = "<head><title>T</title><body><article><p>A paragraph of some length, which is worth reading.</p></article>"
    assert html_extract.main_text(page, html_extract.train([])) == "A paragraph of some length, which is worth reading."


@pytest.mark.parametrize("page", ["<canvas><p>x" * 20_000, "<canvas><p>x" * 20_000 + "</canvas>", "<div><canvas>" * 5000 + "x" + "</div>" * 5000, "<iframe>" * 50_000 + "x", "<option>a" * 50_000])
def test_html_many_elements_without_an_end_are_read_once(page, monkeypatch):
    class Counted:
        seen = 0

        def search(self, *args):
            Counted.seen += 1
            return pattern.search(*args)

    pattern = html_extract.TOKEN
    monkeypatch.setattr(html_extract, "TOKEN", Counted())
    html_extract.blocks_of(page)
    assert Counted.seen <= 5 * page.count("<") + 5


def test_minimum_cut_against_all_labellings():
    random.seed(2)
    for _ in range(60):
        n, extra = random.randint(1, 6), random.randint(0, 2)
        costs = [random.uniform(-3, 3) for _ in range(n)]
        edges = [(random.randrange(n + extra), random.randrange(n + extra), random.uniform(0, 2)) for _ in range(8)]
        edges = [e for e in edges if e[0] != e[1]]

        def price(side):
            return sum(c if c > 0 and not s else -c if c < 0 and s else 0 for c, s in zip(costs, side)) + sum(w for a, b, w in edges if side[a] != side[b])

        every = [[bool(k >> i & 1) for i in range(n + extra)] for k in range(1 << (n + extra))]
        chosen = html_extract.minimum_cut(costs, edges, n + extra)
        assert min(price(s) for s in every if s[:n] == chosen) == pytest.approx(min(map(price, every)))


def test_jaccard(spark, docs, empty):
    out = by_id(jaccard_join.join_similar(docs.withColumn("component_id", F.lit("clash")).withColumn("node", F.lit(1))))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in out]
    n = len(brute.shingles(LONG, 4))
    assert got[:6] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, n, 4), (5, n, 4), (6, len(brute.shingles(ODD, 4)), 6)]
    assert got[6:9] == [(7, 1, 7), (7, 1, 7), (8, 1, 7)] and got[-1] == (None, 3, None)
    assert jaccard_join.join_similar(empty).count() == 0


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", block)
    random.seed(6)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for g in range(12):
        base = [f"g{g}w{random.randint(0, 400)}" for _ in range(150)]
        for _ in range(random.choice([1, 2, 25])):
            text = list(base)
            for _ in range(random.randint(0, 6)):
                text[random.randrange(len(text))] = f"edit{random.randint(0, 10**9)}"
            if random.random() < 0.5:
                text = text + passage
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, " ".join(passage[: 40 + k])) for k in range(15)]
    want = brute.components({i: brute.shingles(t, 4) for i, t in rows}, 85)
    got = {r.doc_id: r.component_id for r in jaccard_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and len(set(want.values())) < len(rows)


def test_quality(docs, empty):
    out = by_id(quality.judge(docs.withColumn("n_words", F.lit("clash"))))
    assert len(out) == len(ROWS)
    for r in out:
        text = [t for i, t, *_ in ROWS if i == r.doc_id][0] or ""
        assert r.n_words == len(brute.WORD.findall(text))
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality.judge(empty).count() == 0


def test_quality_counts(spark):
    w = [f"w{k}" for k in range(40)]
    text = " ".join(w[:10] + w[20:30] + w[:10]) + "\n# a\n\n# a\n \n# a\nb"
    r = quality.measure(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_lines, r.n_repeat_words) == (37, 3, 2, 5, 20)
    same = quality.measure(spark.createDataFrame([("a " * 30,)], "text string")).first()
    assert same.n_repeat_words == 30


def test_quality_sketches_merge(spark):
    rows = [("en", k % 3, k, k % 7) for k in range(3000)]
    df = spark.createDataFrame(rows, "lang string, source long, v long, x long")
    df = df.select("*", *[F.col("v").alias(m) for m in quality.SLACK], F.lit(False).alias("base_failed"))
    whole = quality.sketches(df, ["lang", "source"])
    parts = quality.sketches(df.where("x < 3"), ["lang", "source"]).unionAll(quality.sketches(df.where("x >= 3"), ["lang", "source"]))
    assert sorted(map(tuple, quality.merge(parts, ["lang", "source"]).collect())) == sorted(map(tuple, whole.collect()))
    for r in quality.thresholds(whole, ["lang", "source"]).collect():
        q1 = (r.low_symbol_permille * 7 + r.high_symbol_permille * 6) / 13  # low = q1 - 6 iqr, high = q3 + 6 iqr
        assert abs(q1 - 750) <= 750 / 32 + 3


def _rendered(turns):
    """A completion and its spans, turn by turn."""
    text, spans = "", []
    for _, role, t in turns:
        text += f"<|{role}|>\n"
        begin = len(text)
        text += t + "\n<|end|>"
        if role == "assistant":
            spans.append((begin, len(text)))
        text += "\n"
    return text, spans


def _pair(a, b, piece):
    """The rows of a pair of {turn: (role, text)} by a plain walk over its turns."""
    every = sorted(set(a) | set(b))
    fork = next((t for t in every if a.get(t) != b.get(t)), None)
    out = {}
    for n in {t // piece for t in every}:
        own = [t for t in every if t // piece == n]
        shared = [t for t in own if fork is None or t < fork]
        later = [t for t in own if fork is not None and t >= fork]
        c, r = (_rendered([(t, *s[t]) for t in later if t in s]) for s in (a, b))
        out[n - every[0] // piece] = (_rendered([(t, *a[t]) for t in shared])[0], c[0], r[0], len(shared), c[1], r[1])
    return out


def _formatted(spark, a, b, **more):
    schema = "conv_id long, turn long, role string, text string, part string, piece long"
    a, b = ([(*r, "x", 7) for r in side] for side in (a, b))
    out = preference_format.format_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), **more).collect()
    got = {}
    for r in out:
        spans = [[(s.begin, s.end) for s in c] for c in (r.chosen_spans, r.rejected_spans)]
        got.setdefault(r.conv_id, {})[r.piece] = (r.prompt, r.chosen, r.rejected, r.prompt_turns, *spans)
    assert sum(map(len, got.values())) == len(out)
    return got


def test_preference_pairs(spark):
    a = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", None), (2, 0, None, "same"), (2, 0, None, "same"), (None, 0, "user", "q"), (3, None, "user", "q"), (4, 0, "user", "q"), (5, 0, "user", "only here")]
    b = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (2, 0, None, "same"), (4, 0, "user", "q"), (4, 1, "assistant", "more"), (6, 0, "user", "z"), (6, 0, "user", "a")]
    got = _formatted(spark, a, b)
    user = "<|user|>\nq\n<|end|>\n"
    good = "<|assistant|>\ngood\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert got[1] == {0: (user, good, "<|assistant|>\nbad\n<|end|>\n", 1, [(14, 26)], [(14, 25)])}
    assert good[14:26] == "good\n<|end|>"
    assert got[2] == {0: ("<||>\nsame\n<|end|>\n", "", "", 1, [], [])}
    assert got[4] == {0: (user, "", "<|assistant|>\nmore\n<|end|>\n", 1, [], [(14, 26)])}
    assert got[5][0][:3] == ("", "<|user|>\nonly here\n<|end|>\n", "")
    assert got[6][0][:3] == ("", "", "<|user|>\na\n<|end|>\n")  # two rows for one turn: the least counts
    assert set(got) == {1, 2, 4, 5, 6}
    assert _formatted(spark, [], []) == {}


def test_preference_pairs_in_pieces(spark):
    rng = random.Random(3)
    sides = {"a": {}, "b": {}}
    for conv in range(40):
        start, n, fork = rng.randrange(-9, 9), rng.randrange(1, 30), rng.randrange(0, 32)
        for t in range(n):
            turn = (rng.choice(["user", "assistant", "tool"]), rng.choice(["", "x", "longer \U0001f600 text", "y" * 500]))
            sides["a"].setdefault(conv, {})[start + t] = turn
            if t < fork:
                sides["b"].setdefault(conv, {})[start + t] = turn
            elif rng.random() < 0.6:  # rejected sides with gaps
                sides["b"].setdefault(conv, {})[start + t] = ("assistant", rng.choice(["x", "worse"]))
    rows = {s: [(c, t, *x) for c, turns in of.items() for t, x in turns.items()] for s, of in sides.items()}
    got = _formatted(spark, rows["a"], rows["b"], piece=4)
    assert got == {c: _pair(sides["a"][c], sides["b"].get(c, {}), 4) for c in sides["a"]}
    assert max(len(p) for p in got.values()) > 4
