"""Plain Python versions of the operators that SQL cannot express, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def _discounts(counts):
    c = [sum(1 for v in counts if v == k) for k in (1, 2, 3, 4)]
    y = c[0] / (c[0] + 2 * c[1]) if c[0] and c[1] else 0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * c[k] / c[k - 1] if y and c[k - 1] else 0
        out.append(d if 0 < d < k else k / 2)
    return out


def language_model(rows):
    """{(id, text): (n_tokens, n_known, base, score)} and the number of training tokens."""
    train = [words(t) + ["</s>"] for i, t in rows if not held_out(i)]
    one, two = Counter(w for d in train for w in d), Counter()
    for d in train:
        two.update(zip(["<s>"] + d[:-1], d))
    n, v = sum(one.values()), len(one)
    context, after, follows = Counter(), defaultdict(list), Counter()
    for (a, b), c in two.items():
        context[a] += c
        after[a].append(c)
        follows[b] += 1
    d2, d1 = _discounts(two.values()), _discounts(follows.values())
    cut = lambda c, d: d[min(c, 3) - 1]
    total = sum(follows.values())
    left1 = sum(cut(c, d1) for c in follows.values()) / total if total else 1
    out = {}
    for i, t in rows:
        d = words(t) + ["</s>"]
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in d)
        score = 0.0
        for a, b in zip(["<s>"] + d[:-1], d):
            if not total:
                continue
            p = (max(follows[b] - cut(follows[b], d1), 0) / total if follows[b] else 0) + left1 / (v + 1)
            if context[a]:
                c = two[a, b]
                p = ((max(c - cut(c, d2), 0) if c else 0) + sum(cut(x, d2) for x in after[a]) * p) / context[a]
            score += math.log10(p)
        out[i, t] = (len(d), sum(one[w] > 0 for w in d), base, score)
    return out, n


def luhn(d):
    s = 0
    for k, c in enumerate(d[::-1]):
        v = int(c) * (2 if k % 2 else 1)
        s += v // 10 + v % 10
    return s % 10 == 0


def personal_data(text):
    """[(kind, start, end)] of the base patterns, straight from their definition."""
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def mask(text):
    """Base spans replaced; overlapping ones become one, named after the first."""
    merged = []
    for k, a, b in sorted(personal_data(text), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in reversed(merged):
        text = text[:a] + f"[{k.upper()}]" + text[b:]
    return text


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def components(sets, percent):
    """{id: least id reachable} over links of similar sets."""
    ids = sorted(sets)
    least = {i: i for i in ids}
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    return least


def audit(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)} for docs (id, text, lang) and labels (id, quality, toxic)."""
    from itertools import permutations

    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {k for k, f in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t))) if f}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            fails.add("E")
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [(r, bool(r[0] & set(order[:k]))) for r in rows]
                here = [r for r, earlier in gone if f in r[0] and not earlier]
                total[f] += len(here)
                kept = sum(not r[0] & set(order[: k + 1]) for r in rows)
                out[part, "".join(order), k + 1] = [kept, len(here), sum(f in r[0] and earlier for r, earlier in gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
        for key in out:
            if key[0] == part:
                out[key] = (*out[key], total[key[1][key[2] - 1]])
    return out


def collocations(docs, longest, threshold, top):
    """{lang: [(rank, phrase, a, l, r, n, score)]} for docs (text, lang)."""
    n, f = Counter(), defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= threshold}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out[lang] = [(i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return {k: v for k, v in out.items() if v}


def article(page):
    """Headings and paragraphs of the article of a page of the test tables."""
    import html

    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", m.group(1)) if m else []
    out = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
    return "\n\n".join(x for x in out if x)
