"""Filter audit, phrase collocations and URL templates on small tables, against brute force or by hand."""

import random

import brute
import numpy as np
import pytest

from tabwright.llm import collocations, filter_audit, url_templates

LONG = " ".join(f"w{k}" for k in range(20_000))
AUDITED = [
    (1, None, None),
    (2, "", "en"),
    (3, "same text", "en"),
    (4, "same text", "de"),
    (4, "same text", "de"),
    (5, "same text", None),
    (None, "same text", "en"),
    (6, LONG, "en"),
    (7, LONG, "en"),
    (8, "SHOUT " * 150, "en"),
    (9, " ".join(f"v{k}" for k in range(99)), "en"),
    (10, " ".join(f"v{k}" for k in range(100)), "en"),
    (11, " ".join(f"v{k % 80}" for k in range(100)), "de"),
    (12, " ".join(f"v{k % 79}" for k in range(100)), "de"),
    (13, "A" + "b" * 9, ""),
    (14, "AA" + "b" * 8, ""),
    (15, "5% | 6\u00e9", "fr"),
    (0, "", "fr"),
]
LABELS = [(3, 1, 0), (4, 0, 1), (4, 1, 0), (8, None, 1), (None, 1, 1), (7, 1, None), (99, 1, 1), (2, 0, 0)]


def test_filter_audit(spark):
    docs = spark.createDataFrame([(*r, "x", 0) for r in AUDITED], "doc_id long, text string, lang string, part string, n int").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit_documents(docs, labels).collect()}
    assert out == brute.audit(AUDITED, LABELS)
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_documents(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_filter_audit_of_any_number_of_filters(spark):
    sets = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 0, 0), ("p", 3, 2, 2, 1), ("p", 2, 4, 0, 0)], "part string, failed int, n long, good long, toxic long")
    out = {(r.filter_order, r.step): r for r in filter_audit.audit(sets, "XY").collect()}
    assert [(out[o, s].removed, out[o, s].kept, out[o, s].redundant) for o, s in (("XY", 1), ("XY", 2), ("YX", 1), ("YX", 2))] == [(5, 9, 0), (4, 5, 2), (6, 8, 0), (3, 5, 2)]
    assert (out["XY", 1].shapley, out["XY", 2].shapley) == (8, 10)


def _babble(seed, n):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    fixed = ["alpha beta gamma delta epsilon", "alpha beta", "New York", "x y z"]
    out = []
    for _ in range(n):
        words = [random.choice(fixed) if random.random() < 0.3 else random.choice(vocabulary) for _ in range(random.randint(0, 25))]
        out.append("".join(w + random.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for w in words))
    return out


COLLOCATED = [(None, None), ("", "en"), (" .;! ", "en"), ("\u00c9t\u00e9\u00a0x A-B", "fr"), ("one", None)]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    if small:  # many partitions, merges and shards
        for name, value in (("SHARD_KEYS", 16), ("HELD", 100), ("HELD_TEXTS", 40), ("LEAST_CAPACITY", 16)):
            monkeypatch.setattr(collocations, name, value)
    rows = COLLOCATED + [(t, ("en", "und", None)[k % 3]) for k, t in enumerate(_babble(3, 120))] + [(_babble(4, 1)[0] * 400, "en")]
    docs = spark.createDataFrame([(t, lg, "x") for t, lg in rows], "text string, lang string, phrase string").repartition(4)
    out = {}
    for r in collocations.collocations(docs, threshold=5, top=60).orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    want = brute.collocations(rows, 5, 5, 60)
    assert want and out == want
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs, threshold=10**6).count() == 0


def test_summaries_merge_and_lose_no_frequent_key(monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_CAPACITY", 64)
    rng = np.random.default_rng(5)
    keys = np.minimum(rng.zipf(1.3, 40_000), 30_000)
    keys, threshold = np.r_[keys, rng.integers(10**6, 10**7, 20_000)].astype(np.uint64), 40
    k, n = np.unique(keys, return_counts=True)
    whole = collocations.Summary(threshold)
    for piece in np.array_split(rng.permutation(keys), 23):
        whole.merge(*collocations.combine(piece, np.ones(len(piece), np.int64)))
        assert len(whole.keys) <= whole.capacity or whole.lost < threshold
    assert whole.mass == len(keys) and whole.capacity > len(keys) / threshold and 0 < whole.lost < threshold and len(whole.keys) < len(k)
    assert set(k[n >= threshold].tolist()) <= set(whole.may_reach().tolist())
    halves = [collocations.Summary(threshold) for _ in range(2)]
    for s, part in zip(halves, np.array_split(rng.permutation(keys), 2)):
        s.capacity = len(keys) // 10  # loses little
        s.merge(*collocations.combine(part, np.ones(len(part), np.int64)))
    halves[0].merge(halves[1].keys, halves[1].counts, halves[1].lost)
    assert set(k[n >= threshold].tolist()) <= set(halves[0].may_reach().tolist())


def test_packed_counts():
    rng = np.random.default_rng(6)
    for k, c in (([], []), ([5], [1]), ([0, 1, 2**48 - 1], [255, 254, 10**12]), (np.unique(rng.integers(0, 2**48, 5000)), None)):
        k = np.array(k, np.uint64)
        c = rng.integers(1, 600, len(k)) if c is None else np.array(c, np.int64)
        a, b = collocations.unpack_counts(collocations.pack_counts(k, c))
        assert a.tolist() == k.tolist() and b.tolist() == c.tolist()


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    phrases = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 7), ("en", "b", 1, big + 1)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 10**16)], "lang string, n long")
    assert collocations.scored(phrases, totals).first().score == 1000 * big * 10**16 // ((big + 7) * (big + 1))


def _urls(spark, urls):
    return spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)], "page_id long, url string, host string, verdict string")


def test_urls_by_rules_and_odd_ones(spark):
    urls = [None, "", "no scheme.net/", "http://", "HTTP://A.Example.NET/en/1?x=/de/", "x://example.net#/en/", "x://net", "x://net/", "x://a.net?q/", "x://notnet/", "x://example.com/de", "x://www.example.com/de/x", "x://\u00c4.ORG/fr/#", "x://a.org/fr", "x://a\nb.org/fr/\n", "x://a.b.example.net/en", "x://h.net/" + "a/" * 3000]
    rows = {r.page_id: r for r in url_templates.judge_urls(_urls(spark, urls), keep=["page_id", "host"]).collect()}
    want = {4: ("a.example.net", "/en/1", "example.net/en/"), 5: ("example.net", "", None), 6: ("net", "", None), 7: ("net", "/", "net/"), 8: ("a.net", "", None), 9: ("notnet", "/", None), 10: ("example.com", "/de", None), 11: ("www.example.com", "/de/x", "example.com/de/"), 12: ("\u00c4.org", "/fr/", "org/fr/"), 13: ("a.org", "/fr", None), 14: ("a\nb.org", "/fr/\n", "org/fr/"), 15: ("a.b.example.net", "/en", "net/")}
    assert len(rows) == len(urls)
    for k in range(4):
        assert (rows[k].host, rows[k].path, rows[k].rule, rows[k].verdict) == ("", "", None, "allow")
    for k, w in want.items():
        assert (rows[k].host, rows[k].path, rows[k].rule) == w
    assert (rows[16].path, rows[16].verdict) == ("/" + "a/" * 3000, "block")
    assert url_templates.judge_urls(_urls(spark, ["x"]).limit(0)).count() == 0


def test_urls_of_rejected_templates(spark):
    rules = [("h.com", "/shop/", "block"), ("h.com", "/news/1", "allow")]
    # Half of the shop's pages are named otherwise than the rules know, but have the template of the blocked ones.
    urls = [f"x://h.com/shop/{k}" for k in range(60)] + [f"x://h.com//shop/{k}/" for k in range(5)] + [f"x://h.com//shop/{k}" for k in range(20)] + [f"x://h.com/news/{k}" for k in range(100, 200)] + ["x://h.com/news/21", "x://other.com/shop/3"]
    rows = url_templates.judge_urls(_urls(spark, urls), rules, keep=["url"]).collect()
    got = {r.url: r.verdict for r in rows}
    assert {got[f"x://h.com//shop/{k}"] for k in range(20)} == {"block"}
    assert got["x://h.com/news/21"] == got["x://other.com/shop/3"] == "allow"


def test_branches_that_are_variable_or_alike(spark):
    rows = [("h", [f"user{chr(97 + k // 26)}{chr(97 + k % 26)}", "profile"], 3, 0, 0) for k in range(80)] + [("h", ["about"], 400, 0, 0)]
    rows += [("g", [lang, "page"], 100, 0, 0) for lang in ("de", "en", "fr")] + [("g", ["ads", "page"], 100, 100, 0)]
    shapes = spark.createDataFrame([(f"{h}{k}", h, s, n, b, a) for k, (h, s, n, b, a) in enumerate(rows)], "key string, host string, shape array<string>, n long, blocked long, allowed long")
    out = {}
    for r in url_templates.templates(shapes).collect():
        out.setdefault((r.host, tuple(r.template)), []).append(r.key)
    assert sorted((k, len(v)) for k, v in out.items()) == [(("g", ("ads", "page")), 1), (("g", ("~0", "page")), 3), (("h", ("*", "profile")), 80), (("h", ("about",)), 1)]
