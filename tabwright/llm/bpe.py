"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands inside no vocabulary token can never be merged: every token that covers both
would contain it. Each such pair is a certain cut. A text is split into pre-tokens, each pre-token at its
certain cuts, every fragment is encoded on its own and the ids are concatenated; this gives exactly the
ids of the whole text.

All texts of a batch are cut at once, with numpy: where pre-tokens begin follows from the classes of neighbouring
characters, certain cuts from neighbouring bytes. Only texts with special strings, or with characters that libraries
may class differently, have their pre-tokens sought one by one. Arrow finds the distinct fragments of a batch and
puts their ids, and the bytes of tokens when decoding, in the places of the text. Fragments repeat far more than
texts do: a worker remembers them in two generations, of which the older is forgotten when the younger is full, and
what is used again moves to the younger. This bounds memory and never changes ids; it lasts for a task. The library
merges many new fragments in one string, with a byte between them that stands in no token of several bytes. A
text longer than a batch is taken in parts that begin with a space behind a letter or digit.

Ids travel as packed little-endian unsigned 32-bit integers in a binary column.

Defined cases: a null text is encoded as empty (no ids); null or empty ids decode to an empty text; ids
outside the vocabulary are left out when decoding; bytes that are no UTF-8 become U+FFFD. Repeated rows
stay, an empty table stays empty, and an input column named like an output is replaced. Tokenizers with a
normalizer or another pre-tokenizer are refused, as their boundaries are not byte pairs of the raw text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .arrowmap import add_columns

#: Fixed value: how byte-level pre-tokenization splits a text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries in a generation of what a worker remembers; bounds memory, not results. Beside the executor's heap stand the workers
#: of all its cores, which earlier stages may have used before.
REMEMBERED = 100_000
#: Bytes of text (or ids) that a task handles at once.
BATCH = 1 << 19
#: Fragments that the library merges in one string, and strings that it is given at once: its results are large for a while.
JOINED, STRINGS = 64, 64


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else the next one above 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    spare = {b: 256 + k for k, b in enumerate(rest)}
    return [chr(spare.get(b, b)) for b in range(256)]


AT_SPACE = re.compile("[A-Za-z0-9](?= )")
BEYOND_LATIN = re.compile("[\u0220-\U0010ffff]")  # Unicode 3.2 has all characters before it


@lru_cache(maxsize=1)
def later_characters() -> regex.Pattern:
    """Characters that Unicode 3.2 does not have: libraries may class them differently, by their version of Unicode."""
    old, ranges, first = unicodedata.ucd_3_2_0.category, [], None
    for c in range(0x110000):
        odd = not 0xD800 <= c < 0xE000 and old(chr(c)) == "Cn"
        if odd and first is None:
            first = c
        elif not odd and first is not None:
            ranges.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return regex.compile("[" + "".join(ranges) + f"\\U{first:08x}-\\U0010ffff]")


SPACE, LETTER, DIGIT, OTHER, UNSURE = range(5)


@lru_cache(maxsize=2)
def classes(stop: int) -> np.ndarray:
    """How ``PRETOKEN`` classes each character below ``stop``, with those that libraries may class differently as UNSURE."""
    every = "".join(map(chr, range(stop)))
    out = np.full(stop, OTHER, np.uint8)
    found = [(SPACE, regex.compile(r"\s+")), (LETTER, regex.compile(r"\p{L}+")), (DIGIT, regex.compile(r"\p{N}+"))]
    if BEYOND_LATIN.search(every):
        found.append((UNSURE, later_characters()))
    for kind, pattern in found:
        for m in pattern.finditer(every):
            out[m.start() : m.end()] = kind
    return out


class Memory:
    """What was computed for keys, in two generations of bounded size."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def make_room(self) -> None:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}

    def missing(self, keys: set) -> list:
        """The keys that are not known; all others are in the young generation afterwards."""
        out = []
        for k in keys - self.young.keys():
            v = self.old.get(k)
            if v is None:
                out.append(k)
            else:
                self.young[k] = v
        return out

    def find(self, keys: list) -> list:
        """What is known for each key, or None; it is in the young generation afterwards."""
        out = list(map(self.young.get, keys))
        unmet = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(unmet, map(self.old.get, map(keys.__getitem__, unmet))):
            if v is not None:
                out[i] = self.young[keys[i]] = v
        return out


def spans(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a binary column without nulls begin and end in its bytes, and these bytes."""
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return edges - edges[0], data[edges[0] : edges[-1]]


class ByteBPE:
    """A vocabulary file of the tokenizers library, ready to split, encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        chars = byte_characters()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.to_chars = dict(enumerate(chars))
        self.bytes_of: dict[int, bytes] = {}
        joined = np.zeros(1 << 16, bool)
        for token, i in spec["model"]["vocab"].items():
            raw = bytes(byte_of[c] for c in token)
            self.bytes_of[i] = raw
            for a, b in zip(raw, raw[1:]):
                joined[a << 8 | b] = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.joined = joined
        self.pretoken = regex.compile(PRETOKEN)
        self.at_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.path = path
        #: Fragments of whole texts; pre-tokens given by themselves, and their fragments.
        self.words, self.tokens, self.pieces = Memory(), Memory(), Memory()
        top = max(self.bytes_of, default=-1) + 2  # one more, for ids outside the vocabulary
        self.vocabulary = pa.array([self.bytes_of.get(i, b"") for i in range(top)], pa.binary())
        square = joined.reshape(256, 256)
        alone = np.flatnonzero(~square.any(0) & ~square.any(1)).tolist()
        plain = not any(spec["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        #: (byte, id) of a byte that is never merged, if there is one.
        self.between = next(((bytes([b]), spec["model"]["vocab"][chars[b]]) for b in alone if plain and chars[b] in spec["model"]["vocab"]), None)

    @cached_property
    def model(self):
        """The library's merges without its pre-tokenizer; only workers that encode load it."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        return Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}))

    @cached_property
    def library(self):
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not BEYOND_LATIN.search(text) or not later_characters().search(text):
            return self.pretoken.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text in order; special strings stand as pieces of their own."""
        if self.at_special is None or not self.at_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def fragments(self, tokens: list[str]) -> tuple[list[bytes], list[int]]:
        """The fragments of all pre-tokens, and where those of each one begin."""
        raw = [t.encode() for t in tokens]
        whole = b"".join(raw)
        begins = np.cumsum([0, *map(len, raw)])
        cut = self.certain_cuts(np.frombuffer(whole, np.uint8))
        cut[begins] = True
        at = np.flatnonzero(cut)
        edges = at.tolist()
        return [whole[a:b] for a, b in zip(edges, edges[1:])], np.searchsorted(at, begins).tolist()

    def certain_cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether there is a cut before each byte and at the end."""
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = ~self.joined[data[:-1].astype(np.uint16) << 8 | data[1:]]
        return cut

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of fragments."""
        chars = lambda raw: raw.decode("latin-1").translate(self.to_chars)
        if self.between is None:
            some = (pieces[at : at + 4096] for at in range(0, len(pieces), 4096))
            return [np.array(e.ids, "<u4").tobytes() for s in some for e in self.model.encode_batch_fast(list(map(chars, s)), add_special_tokens=False)]
        byte, own = self.between
        out = []
        others = [p for p in pieces if p != byte]
        for at in range(0, len(others), JOINED * STRINGS):
            groups = [others[k : k + JOINED] for k in range(at, min(at + JOINED * STRINGS, len(others)), JOINED)]
            strings = [chars(byte.join(g) + byte) for g in groups]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(strings, add_special_tokens=False)])
            packed, ends = ids.astype("<u4").tobytes(), (np.flatnonzero(ids == own) * 4).tolist()
            out += [packed[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]
        if len(others) < len(pieces):
            of, single = iter(out), np.array([own], "<u4").tobytes()
            out = [single if p == byte else next(of) for p in pieces]
        return out

    def learn(self, tokens: set[str]) -> None:
        """Encode the fragments of pre-tokens not met before, each once."""
        known = self.tokens.young
        new = [t for t in self.tokens.missing(tokens) if t not in self.special]
        for t in tokens & self.special.keys():
            known[t] = np.array([self.special[t]], "<u4").tobytes()
        if not new:
            return
        pieces, first = self.fragments(new)
        unmet = self.pieces.missing(set(pieces))
        encoded = self.pieces.young
        encoded.update(zip(unmet, self.merged(unmet)))
        ids = list(map(encoded.__getitem__, pieces))
        for t, a, b in zip(new, first, first[1:]):
            known[t] = ids[a] if b == a + 1 else b"".join(ids[a:b])

    def ids_of(self, tokens: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens."""
        self.make_room()
        self.learn(set(tokens))
        return list(map(self.tokens.young.__getitem__, tokens))

    def make_room(self) -> None:
        for memory in (self.words, self.tokens, self.pieces):
            memory.make_room()

    def begins(self, texts: list[str], whole: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Whether a pre-token begins at each character of all texts in a row, and the first and last place of special strings."""
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = classes(0x110000 if BEYOND_LATIN.search(whole) else 0x220)[chars]
        edges = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(chars) + 2, bool)  # of a text; nothing reaches beyond the last one
        first[edges] = first[-1] = True
        space = kind == SPACE
        at = np.ones(len(chars), bool)
        at[1:] = (kind[1:] != kind[:-1]) & (chars[:-1] != 32)
        at[1:] |= space[1:] & ~space[:-1]
        at |= first[:-2]
        # the last of some white space stands by itself or with what follows, unless the text ends there
        at[:-1] |= space[:-1] & ~space[1:] & ~first[1:-2]
        sign = np.flatnonzero(at & (chars == 39))
        sign = sign[~first[sign + 1]]
        follow = np.append(chars, [0, 0])
        one, two = follow[sign + 1], np.where(first[sign + 2], 0, follow[sign + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.any([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")], axis=0)
        at[sign[short | long] + 1] = False
        ends = np.r_[sign[short] + 2, sign[long] + 3]
        at[ends[ends < len(at)]] = True
        odd = set((np.searchsorted(edges, np.flatnonzero(kind == UNSURE), "right") - 1).tolist())
        if any(x in whole for x in self.special):
            odd.update(i for i, t in enumerate(texts) if any(x in t for x in self.special))
        special = []
        for i in odd:
            tokens = self.pretokens(texts[i])
            places = int(edges[i]) + np.cumsum([0, *map(len, tokens)])
            at[places[0] : places[-1]] = False
            at[places[:-1]] = True
            special += [(a, b) for t, a, b in zip(tokens, places.tolist(), places[1:].tolist()) if t in self.special]
        return at, special

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes of all texts in a row, the edges of their fragments, and how many fragments stand before each text and at the end."""
        whole = "".join(texts)
        raw = whole.encode()
        if not raw:
            return raw, np.zeros(1, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(raw, np.uint8)
        at, special = self.begins(texts, whole)
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of each character
        cut = self.certain_cuts(data)
        cut[place[:-1][at]] = True
        for a, b in special:
            cut[place[a] + 1 : place[b]] = False
        edges = np.flatnonzero(cut)
        return raw, edges.astype(np.int32), np.searchsorted(edges, place[np.cumsum([0, *map(len, texts)])])

    def parts(self, text: str) -> list[str]:
        """A long text in parts that begin with a space behind a letter or digit, where a pre-token begins in any case."""
        if len(text) <= BATCH or any(x in text for x in self.special):
            return [text]
        out, at = [], 0
        while at < len(text):
            m = AT_SPACE.search(text, at + BATCH)
            stop = m.end() if m else len(text)
            out.append(text[at:stop])
            at = stop
        return out

    def encode_array(self, texts: list[str]) -> pa.BinaryArray:
        """Packed ids of each whole text."""
        if len(texts) == 1 and len(parts := self.parts(texts[0])) > 1:
            return pa.array([b"".join(self.encode([p])[0] for p in parts)], pa.binary())
        self.make_room()
        raw, edges, before = self.cut(texts)
        rows = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        at, data = spans(rows.dictionary)
        data, at = data.tobytes(), at.tolist()
        keys = [data[a:b] for a, b in zip(at, at[1:])]
        ids = self.words.find(keys)
        new = [k for k, v in zip(keys, ids) if v is None]
        if new:
            known = self.words.young
            own = {x.encode(): np.array([i], "<u4").tobytes() for x, i in self.special.items()}
            known.update((k, own[k]) for k in new if k in own)
            new = [k for k in new if k not in own]
            known.update(zip(new, self.merged(new)))
            ids = list(map(known.__getitem__, keys))
        at, data = spans(pa.array(ids, pa.binary()).take(rows.indices))
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at[before]), pa.py_buffer(data)])

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(texts).to_pylist()

    def decode_array(self, packed: pa.BinaryArray) -> pa.StringArray:
        """The text of each array of packed ids; the bytes of all are gathered from the vocabulary at once."""
        at, data = spans(packed)
        ids = np.minimum(data.view("<u4"), len(self.vocabulary) - 1)
        edges = np.cumsum(np.append(0, np.diff(at) // 4))
        at, data = spans(self.vocabulary.take(pa.array(ids)))
        at = at[edges]
        try:
            str(data, "utf-8")
            whole = not ((data[at[at < len(data)]] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:
            return pa.array([str(data[a:b], "utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist())], pa.string())
        return pa.StringArray.from_buffers(len(packed), pa.py_buffer(at), pa.py_buffer(data))

    def decode(self, packed: list[bytes]) -> list[str]:
        return self.decode_array(pa.array(packed, pa.binary())).to_pylist()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The tokenizer of this worker; the file must be at the same place on every worker, as an installed package is."""
    return ByteBPE(path)


def forget() -> None:
    """Let go of the tokenizer and of what it remembers. Loading it again costs a task a quarter of a second; an idle worker would keep it all."""
    load.cache_clear()


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the packed ids of each whole text; ``keep`` names the input columns to pass on (all if None)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        return [load(path).encode_array(texts)]

    return add_columns(df, {ids_col: "binary"}, run, text_col, keep, BATCH, forget)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the text of packed ids, special tokens included."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [load(path).decode_array(pc.fill_null(batch.column(batch.schema.get_field_index(ids_col)).cast(pa.binary()), b""))]

    return add_columns(df, {text_col: "string"}, run, ids_col, keep, BATCH, forget)


def encode_and_decode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass: one worker for each task instead of two."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        tokenizer = load(path)
        ids = tokenizer.encode_array([t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()])
        return [ids, tokenizer.decode_array(ids)]

    return add_columns(df, {ids_col: "binary", decoded_col: "string"}, run, text_col, keep, BATCH, forget)
