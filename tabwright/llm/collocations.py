"""Phrases that occur often and belong together, for each language, with exact counts.

Texts are split into pieces at ``BREAKS`` and pieces into words at spaces and tabs; A-Z count as a-z. A phrase lies in
one piece. Phrases are counted level by level, by their number of words:

1. Tasks hash the phrases of some megabytes of text and pass on packed sorted (key, count), dealt over hash partitions.
   Each partition merges them into one Misra-Gries summary. Its capacity exceeds the mass so far divided by the
   threshold several times, and it is raised rather than let what was subtracted in all reach the threshold: so every
   frequent phrase survives, in memory that follows the number of frequent phrases. Summaries merge in any order. A
   key whose counter plus all that was subtracted is below the threshold is left out. Keys have 48 bits here; keys that
   meet by chance only let more survive.
2. The survivors become sorted arrays in the shared folder (see ``hashstore``). A second pass over the same texts counts
   them exactly, by their words and not by their hashes, and drops those below the threshold. Tasks pack their counts
   into one row for each of a number of parts, so that a phrase that stands everywhere is no row for each text.
3. That pass also writes the texts of the next level: only runs of words in which every phrase of this level survived.
   A longer phrase cannot be frequent elsewhere, so each level reads far less than the one before.

Scores are DataFrame work on the frequent phrases alone: every cut of a candidate looks up the exact counts of its two
parts (both are frequent, as the candidate is), in decimals of 38 digits. A candidate contained in a longer one that
occurs (nearly) as often is dropped.

Defined cases: a null text is empty; a null language is ``und``, like the language of that name; empty pieces hold no
phrase; repeated rows count as often as they are there; a very long text is handled whole, as one slice; ties go by
score, count and the bytes of the phrase; an empty table, or one without frequent phrases, gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize, shared_dir, ship_package
from . import hashstore
from .words import LOWER, hash_spans, hash_texts, mix, slices

BREAKS = ".,;:!?\n\x0b\x0c\r"
SPACES = " \t"
UNKNOWN = "und"
THRESHOLD, LONGEST, TOP, COVERED_PCT = 100, 5, 2000, 100
#: Keys that go to one shard of survivors.
SHARD_KEYS = 1 << 20
#: Phrases whose counts a task combines before it passes them on, counting and counting exactly.
HELD, HELD_TEXTS = 1 << 21, 1 << 19
#: Entries of a summary below which nothing is subtracted, and how many times mass / threshold it holds above.
LEAST_CAPACITY, CAPACITY = 1 << 16, 4
#: Parts for each shuffle partition, so that each gets several.
PARTS = 8
BITS = np.uint64(48)

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in BREAKS]] = True
_GAP = _BREAK.copy()
_GAP[[ord(c) for c in SPACES]] = True


class Words:
    """The words of a slice of texts: where each begins and ends, its piece, its text and its hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        inside = ~_GAP[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.s, self.e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offsets, self.s, "right") - 1
        self.piece = np.cumsum(_BREAK[data], dtype=np.int64)[self.s] + self.text  # grows at each break and each new text
        self.hash = hash_spans(self.data, self.s, self.e)

    def phrases(self, n: int) -> np.ndarray:
        """First words of all phrases of ``n`` words."""
        return np.flatnonzero(self.piece[: max(len(self.s) - n + 1, 0)] == self.piece[n - 1 :])

    def keys(self, first: np.ndarray, n: int, lang: np.ndarray) -> np.ndarray:
        """64-bit keys of the phrases of ``n`` words that begin at ``first``; ``lang`` has a hash for each text."""
        out = lang[self.text[first]]
        for k in range(n):
            out = mix(out ^ self.hash[first + k])
        return out

    def texts_of(self, first: np.ndarray, n: int) -> pa.Array:
        """The phrases as strings. Words stand one byte apart where n > 1, as ``runs`` has written them."""
        s, e = self.s[first], self.e[first + n - 1]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.r_[0, np.cumsum(e - s)]), pa.py_buffer(self.data[_ranges(s, e - s)]))

    def runs(self, first: np.ndarray, n: int, n_texts: int) -> pa.Array:
        """For each text, the words of phrases of ``n`` words that begin at ``first``; a line break wherever two neighbours share none."""
        opened = np.bincount(first, minlength=len(self.s)) - np.bincount(first + n - 1, minlength=len(self.s))
        with_next = np.cumsum(opened) > 0  # a word and the next lie in one phrase
        kept = with_next.copy()
        kept[1:] |= with_next[:-1]
        w = np.flatnonzero(kept)
        length = self.e[w] - self.s[w] + 1
        out = self.data[np.minimum(_ranges(self.s[w], length), max(len(self.data) - 1, 0))]
        out[np.cumsum(length) - 1] = np.where(with_next[w], ord(" "), ord("\n"))
        return pa.LargeStringArray.from_buffers(n_texts, pa.py_buffer(np.r_[0, np.cumsum(np.bincount(self.text[w], length, n_texts).astype(np.int64))]), pa.py_buffer(out))


def _ranges(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All positions s[i] .. s[i] + n[i] - 1, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(s - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, Words]]:
    """(languages, their hashes, words) of some megabytes of (lang, text) at a time."""
    for batch in batches:
        for first, stop, data, offsets in slices(batch.column(1)):
            lang = batch.column(0).slice(first, stop - first)
            yield lang, hash_texts(lang), Words(data, offsets)


def combine(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    k = keys[order]
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[edge], np.add.reduceat(counts[order], edge)


def parts_of(spark) -> int:
    return PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct keys as gaps of four bytes (eight if there is a larger one), counts as bytes and those of 255 and more behind."""
    gaps = np.diff(keys, prepend=keys[:1])
    wide = bool(len(gaps) and gaps.max() >= 1 << 32)
    head = np.array([len(keys), wide], np.int64).tobytes() + keys[:1].tobytes()
    return head + gaps.astype("<u8" if wide else "<u4").tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide = np.frombuffer(data, np.int64, 2).tolist()
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gaps = np.frombuffer(data, "<u8" if wide else "<u4", n, 24).astype(np.uint64)
    keys = np.cumsum(gaps) + np.frombuffer(data, np.uint64, 1, 16)
    at = 24 + n * (8 if wide else 4)
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data[at + n :], np.int64)
    return keys, counts


def phrase_counts(texts: DataFrame, n: int) -> DataFrame:
    """(part, data): packed counts of the phrases of ``n`` words in (lang, text), combined for some million at a time."""
    spark = texts.sparkSession
    ship_package(spark)
    parts = parts_of(spark)

    def packed(held: list) -> pa.RecordBatch:
        k, c = combine(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        part = ((k >> (BITS - np.uint64(32))) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        split = [(p, pack_counts(x, y)) for p, (x, y) in hashstore.split(part, k, c)]
        return pa.record_batch([pa.array([p for p, _ in split], pa.int64()), pa.array([d for _, d in split], pa.binary())], names=["part", "data"])

    def run(batches):
        held, size = [], 0
        for _, codes, words in _slices(batches):
            keys = words.keys(words.phrases(n), n, codes) >> (np.uint64(64) - BITS)
            held.append(combine(keys, np.ones(len(keys), np.int64)))
            size += len(held[-1][0])
            if size >= HELD:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return texts.select("lang", "text").mapInArrow(run, "part long, data binary")


class Summary:
    """A Misra-Gries summary of counts for one threshold; ``lost`` is what has been subtracted from every key at most, always below the threshold."""

    def __init__(self, threshold: int):
        self.threshold, self.lost, self.mass = threshold, 0, 0
        self.capacity = LEAST_CAPACITY
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, lost: int = 0) -> None:
        """Take in counts of any keys, or those of another summary with what it has lost."""
        if self.lost + lost >= self.threshold:
            raise ValueError("these summaries have lost too much to be merged")
        self.keys, self.counts = combine(np.r_[self.keys, keys], np.r_[self.counts, counts])
        self.lost += lost
        self.mass += int(counts.sum())
        self.capacity = max(self.capacity, CAPACITY * (self.mass // self.threshold + 1))
        over = len(self.keys) - self.capacity
        if over > 0:
            # The capacity + 1 largest counters lose the least of them, so capacity + 1 times that leaves the mass.
            cut = int(np.partition(self.counts, over - 1)[over - 1])
            if self.lost + cut >= self.threshold:
                self.capacity *= 2
                return
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut
            self.lost += cut

    def may_reach(self) -> np.ndarray:
        """Keys that may occur as often as the threshold; all that do are among them."""
        return self.keys[self.counts + self.lost >= self.threshold]


def survivors(counts: DataFrame, threshold: int) -> DataFrame:
    """(key) of all phrases that may occur ``threshold`` times or more, by one summary for each hash partition of (part, data)."""

    def run(batches):
        summary = Summary(threshold)
        for batch in batches:
            some = [unpack_counts(d) for d in batch.column(1).to_pylist()]
            if some:
                summary.merge(np.concatenate([k for k, _ in some]), np.concatenate([c for _, c in some]))
        yield pa.record_batch([pa.array(summary.may_reach().view(np.int64))], names=["key"])

    return counts.repartition("part").mapInArrow(run, "key long")


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return hashstore.by_range(keys << (np.uint64(64) - BITS), shards)


def write_store(keys: DataFrame, store: str) -> int:
    """Write distinct keys as sorted arrays; the number of shards."""
    shards = max(1, keys.count() // SHARD_KEYS)

    def place(batches):
        for batch in batches:
            k = batch.column(0).to_numpy().view(np.uint64)
            yield pa.record_batch([pa.array(_shard(k, shards)), batch.column(0)], names=["shard", "key"])

    def run(table: pa.Table) -> pa.Table:
        k = np.sort(table.column("key").combine_chunks().to_numpy().view(np.uint64))
        hashstore.write_shard(store, "phrases", table.column("shard")[0].as_py(), k)
        return pa.table({"n": [len(k)]})

    keys.mapInArrow(place, "shard long, key long").groupBy("shard").applyInArrow(run, "n long").agg(F.sum("n")).collect()
    return shards


def count_exactly(texts: DataFrame, n: int, store: str, shards: int) -> DataFrame:
    """Rows (kind, lang, text, n, part, data) of three kinds from one pass: ``count``, packed (lang, text, n) of surviving
    phrases of a part; ``text``, what may hold frequent phrases of one word more; and on level one ``all``, the words of a language."""
    parts = parts_of(texts.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])

    def rows(kind: str, **columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        given = {"kind": pa.array([kind] * size, pa.string())} | columns
        return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema)

    def packed(held: list) -> pa.RecordBatch:
        keys, first, inverse = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        count = np.bincount(inverse, np.concatenate([h[1] for h in held])).astype(np.int64)
        table = pa.table({"lang": pa.concat_arrays([h[2] for h in held]).take(pa.array(first)), "text": pa.concat_arrays([h[3] for h in held]).take(pa.array(first)), "n": count})
        data, numbers = [], []
        for p, (at,) in hashstore.split(hashstore.by_range(keys, parts), np.arange(len(keys))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table.slice(int(at[0]), len(at)).combine_chunks())
            numbers.append(p)
            data.append(sink.getvalue().to_pybytes())
        return rows("count", part=pa.array(numbers, pa.int64()), data=pa.array(data, pa.binary()))

    def run(batches):
        held, size = [], 0
        for lang, codes, words in _slices(batches):
            first = words.phrases(n)
            keys, at, inverse, count = np.unique(words.keys(first, n, codes), return_index=True, return_inverse=True, return_counts=True)
            short = keys >> (np.uint64(64) - BITS)
            place, _ = hashstore.find(store, "phrases", _shard(short, shards), short, (np.uint64,))
            frequent = place >= 0
            one = first[at[frequent]]
            held.append((keys[frequent], count[frequent], lang.take(pa.array(words.text[one])).cast(pa.string()), words.texts_of(one, n)))
            size += len(one)
            if size >= HELD_TEXTS:
                yield packed(held)
                held, size = [], 0
            if n == 1:
                names, of = np.unique(codes, return_inverse=True)
                total = np.bincount(of[words.text], minlength=len(names))
                some = [int(np.flatnonzero(of == k)[0]) for k in range(len(names))]
                yield rows("all", lang=lang.take(pa.array(some, pa.int64())), n=pa.array(total, pa.int64()))
            hit = np.zeros(len(words.s) + 1, bool)
            hit[first] = frequent[inverse]
            longer = words.phrases(n + 1)
            longer = longer[hit[longer] & hit[longer + 1]]
            if len(longer):
                run_texts = words.runs(longer, n + 1, len(lang))
                kept = pa.array(np.diff(np.frombuffer(run_texts.buffers()[1], np.int64)) > 0)
                yield rows("text", lang=lang.filter(kept), text=run_texts.filter(kept))
        if held:
            yield packed(held)

    return texts.select("lang", "text").mapInArrow(run, "kind string, lang string, text string, n long, part long, data binary")


def add_up(counts: DataFrame, threshold: int) -> DataFrame:
    """(lang, phrase, f) of the phrases in packed (part, data) that reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        some = [pa.ipc.open_stream(d).read_all() for d in table.column("data").to_pylist()]
        total = pa.concat_tables(some).group_by(["lang", "text"]).aggregate([("n", "sum")])
        total = total.filter(pc.greater_equal(total.column("n_sum"), threshold))
        return pa.table({"lang": total.column("lang"), "phrase": total.column("text").cast(pa.string()), "f": total.column("n_sum")})

    return counts.groupBy("part").applyInArrow(run, "lang string, phrase string, f long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to ``longest`` words that occur ``threshold`` times or more in a language, and (lang, n) with all its words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found, totals = [], None
    for n in range(1, longest + 1):
        store = hashstore.new_store(spark, f"phrases{n}")
        shards = write_store(materialize(survivors(phrase_counts(texts, n), threshold), "phrase-survivors"), store)
        path = f"{shared_dir(spark)}/{store.rpartition('/')[2]}-passed"
        count_exactly(texts, n, store, shards).write.partitionBy("kind").option("compression", "zstd").parquet(path)
        passed = spark.read.schema("lang string, text string, n long, part long, data binary, kind string").parquet(path)
        exact = add_up(passed.where("kind = 'count'").select("part", "data"), threshold)
        found.append(exact.select("lang", "phrase", F.lit(n).alias("words"), "f"))
        if n == 1:
            totals = passed.where("kind = 'all'").groupBy("lang").agg(F.sum("n").alias("n"))
        texts = passed.where("kind = 'text'").select("lang", "text")
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionAll(more)
    return materialize(phrases, "phrases"), materialize(totals, "words-by-language")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score): each phrase of two words or more at the cut with the lowest score."""
    word = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), cut).join(totals, "lang")
    left, right = F.array_join(F.slice(word, F.lit(1), F.col("k")), " "), F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ")
    cuts = cuts.withColumns({"left": left, "right": right})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    cuts = cuts.withColumn("score", F.expr(f"({wide('1000 * a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "words", "a", "b.l", "b.r", "n", "b.score")


def outermost(candidates: DataFrame, percent: int = COVERED_PCT) -> DataFrame:
    """The candidates that lie in no longer one with ``percent`` % of their occurrences or more; dropped ones count as longer ones too."""
    word = F.split("phrase", " ")
    inner = F.explode(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda at: F.array_join(F.slice(word, at, k), " "))))
    )
    inside = candidates.where("words > 2").select("lang", F.col("a").alias("longer"), inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    joined = candidates.join(inside, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, threshold: int = THRESHOLD, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, count and phrase."""
    phrases, totals = frequent_phrases(docs, text_col, lang_col, longest, threshold)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = outermost(scored(phrases, totals)).withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
