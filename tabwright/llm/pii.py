"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

1. Candidates: spans of the base patterns (with their checks), which are always reported, and spans of wider
   patterns: addresses with a bracketed or spelled-out "at" and "dot", local and 00 phone numbers (at most four groups
   behind the calling code), cards grouped by fours, and long ip addresses, written in full or compressed.
2. Labelers vote for, against or not at all on each candidate: strict pattern, check digits and ranges,
   gazetteers (endings of domains, calling codes, issuers, address ranges), words before it, and its borders.
3. Tasks count the distinct combinations of votes and form, of which there are at most some thousand for
   any input; only these counts reach the driver. Expectation-maximisation over them estimates how reliable
   each labeler is and how likely each combination is real (votes not given count as missing).
4. A logistic regression over form and votes is trained on these probabilities, over all candidates of all
   texts. A second pass reports the base spans and the candidates that it accepts and that overlap no base
   span of their kind.

A kind with few candidates in the whole corpus (a handful) is decided by the priors: labelers count as better than
chance and the weights of the regression stay near zero, so such a span is accepted when more labelers are for it than
against it.

Texts without digits, '@', '::', '(at)' or 'dot' cost one search. All patterns take linear time, and overlaps are looked up in
sorted spans, so very long texts and texts full of spans cost no more for each span than short ones. Offsets are code
points, ends exclusive.

Defined cases: a null text counts as empty and has no spans; repeated rows are handled one by one; an empty
table gives an empty result (and a classifier that accepts nothing); input columns named like an output are
replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from ipaddress import AddressValueError, IPv6Address
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .arrowmap import add_columns

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "border")
ACCEPT = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|::|dot|[\[(] ?at ?[\])]", re.I)
_AT, _DOT = r" ?[\[(] ?at ?[\])] ?", r"(?: ?[\[(] ?dot ?[\])] ?| ++dot ++)"
_LABEL, _GROUP = r"[A-Za-z0-9-]++", r"[0-9A-Fa-f]{1,4}"
WIDE = {
    # A plain dot may follow a bracketed "at" only: "look at example.com" is prose.
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_AT}{_LABEL}(?:(?:{_DOT}|\.){_LABEL})++| ++at ++{_LABEL}(?:{_DOT}{_LABEL})++)", re.I),
    "ip": re.compile(rf"(?<![0-9A-Za-z:])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,6}})?::(?:{_GROUP}(?::{_GROUP}){{0,6}})?)(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9./_])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])00[1-9][0-9]{0,2}(?:[ ().-]{1,2}[0-9]{2,6}){2,4}(?![0-9])"),
}
#: Gazetteers and words of the context labeler: own choices, extend as needed. Every ending of two letters is a country's.
ENDINGS = frozenset("com org net edu gov mil int info biz name pro coop aero museum jobs mobi travel app dev online site shop blog cloud tech store xyz".split())
#: Starts of calling codes of the public numbering plan: one and two digits, and the tens that hold codes of three digits.
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()) + tuple(
    "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
)
ISSUERS = ("30", "34", "35", "36", "37", "38", "39", "4", "50", "51", "52", "53", "54", "55", "56", "57", "58", "60", "62", "63", "64", "65", "67", *(str(k) for k in range(22, 28)))
BEFORE = {
    "email": re.compile(r"e-?mail|contact|write|correo|courriel|adresse|mailto", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|client|login", re.I),
    "card": re.compile(r"card|visa|master|amex|carte|tarjeta|karte|payment", re.I),
    "phone": re.compile(r"phone|\btel\b|call|fax|mobile|cell|tél|teléfono|telefon|whatsapp", re.I),
}
AGAINST = re.compile(r"version|isbn|order|invoice|serial|token|commit|chapter|figure|\bno\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))
    return out


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the four base patterns that pass their checks, in order."""
    out = {k: [] for k in KINDS}
    if not ANY.search(text):
        return out
    out["email"] = _emails(text)
    out["ip"] = [m.span() for m in IP.finditer(text) if _octets(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def wide_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans of the wider patterns that overlap no base span of any kind."""
    out = {k: [] for k in KINDS}
    if not ANY.search(text):
        return out
    taken = sorted(s for spans in base.values() for s in spans)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for kind, pattern in WIDE.items():
        for m in pattern.finditer(text):
            before = bisect_left(starts, m.end())  # spans that begin before the match ends; reach: how far they go
            if not before or reach[before - 1] <= m.start():
                out[kind].append(m.span())
    return out


def _long_address(s: str) -> bool:
    try:
        return IPv6Address(s) is not None
    except AddressValueError:
        return False


def votes(text: str, kind: str, a: int, b: int, base: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 none."""
    s, d = text[a:b], digits_of(text[a:b])
    if kind == "email":
        ending = re.split(r"[^A-Za-z0-9]+", s.strip("[]() "))[-1].lower()
        check, known = 1 if ending.isalpha() and len(ending) > 1 else -1, 1 if ending in ENDINGS or (ending.isalpha() and len(ending) == 2) else 0
    elif kind == "ip":
        long = ":" in s
        check = 1 if not long or _long_address(s) else -1
        known = 0 if long else (1 if 1 <= int(s.split(".")[0].lstrip("0")[:3] or "0") <= 223 else -1)
    elif kind == "card":
        check, known = 1 if 13 <= len(d) <= 19 and luhn(d) else -1, 1 if d.startswith(ISSUERS) else -1
    else:
        number = d[2:] if d.startswith("00") else d
        check = 1 if 9 <= len(number) <= 15 else -1
        known = 1 if number.startswith(CALLING) else 0
    before = text[max(0, a - 40) : a]
    context = 1 if BEFORE[kind].search(before) else (-1 if AGAINST.search(before) else 0)
    sides = (text[a - 1] if a else " ") + (text[b] if b < len(text) else " ")
    border = -1 if sides[0].isalnum() or sides[1].isalnum() or sides[0] in "=/_" else 1
    return (1 if base else 0, check, known, context, border)


def candidates(text: str):
    """(kind, start, end, base, votes) of a text, by kind, then start."""
    base = base_spans(text)
    wide = wide_spans(text, base)
    for kind in KINDS:
        own = sorted([(a, b, True) for a, b in base[kind]] + [(a, b, False) for a, b in wide[kind]])
        for a, b, is_base in own:
            yield kind, a, b, is_base, votes(text, kind, a, b, is_base)


def count_votes(df: DataFrame, text_col: str = "text") -> list[tuple[str, bool, tuple[int, ...], int]]:
    """(kind, base, votes, n) over all texts: at most kinds x 2 x 3^labelers rows."""
    ship_package(df.sparkSession)

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update((k, base, v) for k, _, _, base, v in candidates(t))
        rows = [{"kind": k, "base": base, "votes": ",".join(map(str, v)), "n": n} for (k, base, v), n in seen.items()]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("base", pa.bool_()), ("votes", pa.string()), ("n", pa.int64())]))

    counted = df.select(text_col).mapInArrow(run, "kind string, base boolean, votes string, n long").groupBy("kind", "base", "votes").agg(F.sum("n").alias("n"))
    return [(r["kind"], r["base"], tuple(map(int, r["votes"].split(","))), r["n"]) for r in counted.orderBy("kind", "base", "votes").collect()]


def expectation_maximisation(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each vote combination is real, reliabilities[class, labeler]): P(vote = 1 | class, voted)."""
    voted, yes = v != 0, v > 0
    real = 1 / (1 + np.exp(-v.sum(1).astype(float)))  # begins with the majority
    for _ in range(rounds):
        w = np.stack([n * (1 - real), n * real])
        share = (w.sum(1) + 1) / (n.sum() + 2)
        reliable = (w @ (yes & voted) + [[1.0], [3.0]]) / (w @ voted + 4.0)  # prior: labelers are better than chance
        log = np.log(share)[:, None] + np.where(voted, np.where(yes, np.log(reliable)[:, None, :], np.log(1 - reliable)[:, None, :]), 0).sum(2)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - real).max() < 1e-9:
            break
        real = new
    return real, reliable


def features(base: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Constant, form, and for each labeler but the strict pattern its votes for and against."""
    return np.column_stack([np.ones(len(v)), base, *(x for k in range(1, v.shape[1]) for x in (v[:, k] > 0, v[:, k] < 0))]).astype(float)


def logistic_regression(x: np.ndarray, real: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights for rows that are real with a probability, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (real - p)) - ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, tuple[float, ...]]
    reliabilities: dict[str, tuple[tuple[float, ...], ...]]

    def accepts(self, kind: str, base: bool, v: tuple[int, ...]) -> bool:
        if kind not in self.weights:
            return False
        return float(features(np.array([base]), np.array([v]))[0] @ np.array(self.weights[kind])) >= np.log(ACCEPT / (1 - ACCEPT))


def fit(df: DataFrame, text_col: str = "text") -> Classifier:
    counted = count_votes(df, text_col)
    weights, reliabilities = {}, {}
    for kind in KINDS:
        rows = [r for r in counted if r[0] == kind]
        if rows:
            v, n, base = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], float), np.array([r[1] for r in rows])
            real, reliable = expectation_maximisation(v, n)
            weights[kind] = tuple(logistic_regression(features(base, v), real, n).tolist())
            reliabilities[kind] = tuple(map(tuple, reliable.tolist()))
    return Classifier(weights, reliabilities)


def spans_of(text: str, classifier: Classifier) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of everything reported, by kind, then start."""
    return [(k, a, b, base) for k, a, b, base, v in candidates(text) if base or classifier.accepts(k, base, v)]


def find_spans(df: DataFrame, classifier: Classifier, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the number of base spans of each kind, base_spans and spans (``kind:start:end``, comma-joined)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [spans_of(t, classifier) if t else [] for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        counts = [pa.array([sum(1 for s in f if s[3] and s[0] == k) for f in found], pa.int64()) for k in KINDS]
        join = lambda f: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in f)
        return [*counts, pa.array([join([s for s in f if s[3]]) for f in found], pa.string()), pa.array([join(f) for f in found], pa.string())]

    return add_columns(df, {**{f"n_{k}": "long" for k in KINDS}, "base_spans": "string", "spans": "string"}, run, text_col, keep)


def mask(text: str, classifier: Classifier) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, done = [], 0
    merged: list[list] = []
    for k, a, b, _ in sorted(spans_of(text, classifier), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[done:a], f"[{k.upper()}]"]
        done = b
    return "".join(out) + text[done:] if merged else text


def redact(df: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """``df`` with its texts masked; null texts stay null."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([t and mask(t, classifier) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()], pa.string())]

    order = df.columns
    return add_columns(df, {text_col: "string"}, run, text_col, [c for c in order if c != text_col]).select(*order)
