"""Op 13: phrases of two to four words whose words keep together, counted in a HAT-trie.

Words are numbered by 64-bit hashes of (language, word); the count of words tells words that share a number
apart by a second one, and takes another seed if any do, so phrases, which are tuples of numbers, stay exact.

Three passes count words, pairs, and phrases of three and four.  A phrase can only be frequent if its parts
are, so a pass skips what a bit map of fixed size (2**BITS bits, filled from the frequent parts found before)
rules out; a map that fills up costs time and changes no result.  A last pass spells the words of the phrases that are returned.

Inside a task a :class:`HatTrie` counts: a shallow trie over the leading bits of a phrase's first two words, with hash
containers as leaves.  A container that outgrows ``BURST`` phrases bursts into ``2**FAN_BITS`` containers one level
down.  A trie of more than ``HELD`` phrases spills its largest subtrees as sorted runs; Spark deals the runs out by their
first two words and sums them there.  Memory is bounded by ``HELD`` whatever a task reads.

Defined cases: a null text has no words; a null language is ``und``; phrases don't cross pieces; repeated rows
count again; ties of cuts go to the shortest first part, ties of phrases to byte order; an empty table gives no
rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import saved

LONGEST = 4
LEAST = 30
COVER = 80
TOP = 2000
SCALE = 2_000_000
BITS = 25
BURST = 1 << 16
FAN_BITS = 4
HELD = 1 << 20
CHUNK = 2 << 20
#: Levels of the trie, and the leading bits of a phrase's number that its first two words decide.
DEPTH = 3
PREFIX_BITS = DEPTH * FAN_BITS

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_BREAKS
_INSIDE[[0x20, 0x09]] = False
_TWO = np.uint64(0x9FB21C651E98DF25)
_SAME = np.arange(256, dtype=np.uint8)
_OTHER = np.random.default_rng(7).permutation(_SAME)


def _tuple_hash(ids: np.ndarray) -> np.ndarray:
    """A number of every row of ``ids``; its leading PREFIX_BITS depend on the first two words alone."""
    head = ids[:, 0].copy()
    if ids.shape[1] > 1:
        head += ids[:, 1] * _TWO
    head = B.mixed(head)
    if ids.shape[1] <= 2:
        return head
    rest = np.zeros(len(ids), np.uint64)
    for j in range(2, ids.shape[1]):
        rest = rest * _TWO + ids[:, j]
    low = np.uint64((1 << (64 - PREFIX_BITS)) - 1)
    return (head & ~low) | ((B.mixed(rest) ^ head) & low)


def _summed(keys: np.ndarray, ids: np.ndarray, n: np.ndarray):
    """The phrases in key order, equal ones summed.  Phrases that differ under one key stay apart."""
    order = np.argsort(keys, kind="stable")
    keys, ids, n = keys[order], ids[order], n[order]
    new = np.ones(len(keys), bool)
    new[1:] = (ids[1:] != ids[:-1]).any(1)
    at = np.flatnonzero(new)
    return keys[at], ids[at], np.add.reduceat(n, at) if len(at) else n


class Container:
    """A leaf: the phrases under one prefix, with counts; what is added waits until it outweighs what is held."""

    def __init__(self, width: int):
        self.held = (np.zeros(0, np.uint64), np.zeros((0, width), np.uint64), np.zeros(0, np.int64))
        self.fresh: list = []
        self.waiting = 0

    def add(self, keys, ids, n):
        self.fresh.append((keys, ids, n))
        self.waiting += len(keys)
        if self.waiting > max(BURST, len(self.held[0])):
            self.settle()

    def settle(self):
        if self.fresh:
            self.held = _summed(*(np.concatenate(c) for c in zip(self.held, *self.fresh, strict=True)))
            self.fresh, self.waiting = [], 0
        return self.held

    def size(self) -> int:
        return len(self.held[0]) + self.waiting


class HatTrie:
    """Counts of phrases of up to ``width`` words (unused places are 0); spills sorted runs of (prefix, ids, n)."""

    def __init__(self, width: int, held: int = HELD, burst: int = BURST):
        self.width, self.limit, self.burst = width, held, burst
        self.leaves: dict[tuple[int, int], Container] = {(0, 0): Container(width)}  # (depth, prefix)
        self.inner: set[tuple[int, int]] = set()
        self.count = 0

    def add(self, ids: np.ndarray, n: np.ndarray | None = None) -> Iterator[tuple]:
        """Counts the rows of ``ids``; yields the runs that had to be spilled."""
        if len(ids):
            self._put(0, 0, *_summed(_tuple_hash(ids), ids, np.ones(len(ids), np.int64) if n is None else n))
            self.count = sum(c.size() for c in self.leaves.values())
            while self.count > self.limit:
                yield self._spill(max(self.leaves, key=lambda k: self.leaves[k].size()))

    def _put(self, depth: int, prefix: int, keys, ids, n):
        if (depth, prefix) in self.inner:
            child = (keys >> np.uint64(64 - (depth + 1) * FAN_BITS)).astype(np.int64)  # ascending, as keys are
            first = np.flatnonzero(np.concatenate(([True], child[1:] != child[:-1])))
            for lo, hi in zip(first, [*first[1:], len(child)], strict=True):
                self._put(depth + 1, int(child[lo]), keys[lo:hi], ids[lo:hi], n[lo:hi])
            return
        leaf = self.leaves.setdefault((depth, prefix), Container(self.width))
        leaf.add(keys, ids, n)
        if leaf.size() > self.burst and depth < DEPTH:
            held = leaf.settle()
            if len(held[0]) > self.burst:
                del self.leaves[depth, prefix]
                self.inner.add((depth, prefix))
                self._put(depth, prefix, *held)

    def _spill(self, which: tuple[int, int]):
        leaf = self.leaves.pop(which)
        run = leaf.settle()
        self.count = sum(c.size() for c in self.leaves.values())
        return run

    def rest(self) -> Iterator[tuple]:
        """All that is left, subtree by subtree."""
        for which in sorted(self.leaves):
            yield self._spill(which)


def _split(batch: pa.RecordBatch):
    """(lower-case bytes, starts, ends, text number) of the words."""
    data, bounds = B.texts(batch.column("text"))
    data = B.LOWER[data]
    return data, *B.word_spans(data, bounds, _INSIDE)


def _lang_numbers(langs: pa.Array, seed: int, other: bool = False) -> np.ndarray:
    names, bounds = B.texts(langs)
    return B.mixed(B.span_hashes(B.prefix_sums((_OTHER if other else _SAME)[names]), bounds[:-1], bounds[1:]) + np.uint64(seed * 2 + 1) * _TWO)


def _numbers(batch: pa.RecordBatch, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, seed: int, other: bool = False) -> np.ndarray:
    """A number of each (language, word), never 0; ``other``: one that is independent of it."""
    langs = batch.column("lang").dictionary_encode()
    salts = _lang_numbers(langs.dictionary, seed, other)
    ids = B.mixed(B.span_hashes(B.prefix_sums((_OTHER if other else _SAME)[data]), starts, ends) ^ salts[langs.indices.to_numpy()][text])
    ids[ids == 0] = np.uint64(1)
    return ids


def _words(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, whether the next one goes on in the same piece)."""
    data, starts, ends, text = _split(batch)
    breaks = np.concatenate(([0], np.cumsum(_BREAKS[data])))[starts]
    return _numbers(batch, data, starts, ends, text, seed), (text[1:] == text[:-1]) & (breaks[1:] == breaks[:-1])


def _batch(rows: np.ndarray, n: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(c) for c in np.ascontiguousarray(rows.T).view(np.int64)], pa.array(n, pa.int64())], names=[*names, "n"])


_WORD = ["id", "other", "lang"]


def _count_words(seed: int, held: int):
    """(id, other, lang number, n) of words; id 0 counts all words of a language."""
    def run(batches):
        trie = HatTrie(3, held)
        for piece in B.chunks(batches, "text", CHUNK):
            data, starts, ends, text = _split(piece)
            langs = _lang_numbers(piece.column("lang"), seed)
            rows = np.stack([*(_numbers(piece, data, starts, ends, text, seed, other) for other in (False, True)), langs[text]], 1)
            every = np.stack([np.zeros_like(langs), langs, langs], 1)
            yield from (_batch(ids, n, _WORD) for _, ids, n in trie.add(rows))
            yield from (_batch(ids, n, _WORD) for _, ids, n in trie.add(every, np.bincount(text, minlength=len(langs))))
        yield from (_batch(ids, n, _WORD) for _, ids, n in trie.rest())

    return run


def _spell(seed: int, wanted: np.ndarray):
    """(id, word) of words that the bit map may want, once per chunk."""
    def run(batches):
        for piece in B.chunks(batches, "text", CHUNK):
            data, starts, ends, text = _split(piece)
            ids = _numbers(piece, data, starts, ends, text, seed)
            at = np.flatnonzero(_has(wanted, ids))
            once, first = np.unique(ids[at], return_index=True)
            words = [data[starts[i]:ends[i]].tobytes().decode("utf-8", "replace") for i in at[first]]
            yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(words, pa.string())], ["id", "word"])

    return run


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    probe = keys >> np.uint64(64 - BITS)
    return bits[(probe >> np.uint64(6)).astype(np.int64)] >> (probe & np.uint64(63)) & np.uint64(1) == 1


def bit_map(keys: DataFrame) -> np.ndarray:
    """2**BITS bits with those set that the leading bits of a long column ``key`` name: a table of fixed size."""
    probe = F.shiftrightunsigned("key", 64 - BITS)
    rows = (keys.select(F.shiftright(probe, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITS}) & 63 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[rows["w"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return bits


def _ids(width: int) -> list[str]:
    return [f"id{j}" for j in range(width)]


def _with_key(batches):
    for batch in batches:
        key = _tuple_hash(np.stack([batch.column(c).to_numpy().view(np.uint64) for c in _ids(2)], 1))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])


def _count_pairs(seed: int, held: int, frequent: np.ndarray):
    def run(batches):
        trie = HatTrie(2, held)
        for piece in B.chunks(batches, "text", CHUNK):
            ids, joined = _words(piece, seed)
            ok = _has(frequent, ids)
            at = np.flatnonzero(joined & ok[1:] & ok[:-1]) if len(ids) > 1 else np.zeros(0, np.int64)
            yield from (_batch(rows, n, _ids(2)) for _, rows, n in trie.add(np.stack([ids[at], ids[at + 1]], 1)))
        yield from (_batch(rows, n, _ids(2)) for _, rows, n in trie.rest())
    return run


def _count_longer(seed: int, held: int, frequent: np.ndarray):
    def run(batches):
        trie = HatTrie(LONGEST, held)
        for piece in B.chunks(batches, "text", CHUNK):
            ids, joined = _words(piece, seed)
            if len(ids) < 3:
                continue
            pair = np.zeros(len(ids), bool)
            at = np.flatnonzero(joined)
            pair[at] = _has(frequent, _tuple_hash(np.stack([ids[at], ids[at + 1]], 1)))
            going = pair
            for m in range(3, LONGEST + 1):
                going = going[:-1] & pair[m - 2: m - 2 + len(going) - 1]
                at = np.flatnonzero(going)
                rows = np.zeros((len(at), LONGEST), np.uint64)
                for j in range(m):
                    rows[:, j] = ids[at + j]
                yield from (_batch(r, n, _ids(LONGEST)) for _, r, n in trie.add(rows))
        yield from (_batch(r, n, _ids(LONGEST)) for _, r, n in trie.rest())
    return run


def _frequent(texts: DataFrame, count, width: int, least: int, name: str) -> DataFrame:
    """Sorted runs, merged in the partition of their first two words; frequent phrases stay."""
    runs = texts.mapInArrow(count, ", ".join(f"{c} long" for c in [*_ids(width), "n"])).repartition(*_ids(2))
    return saved(runs.groupBy(*_ids(width)).agg(F.sum("n").alias("f")).where(F.col("f") >= least), name)


@dataclass(frozen=True)
class Phrases:
    """phrases: ids, f (two words and more); words: id, lang_id, f; totals: lang, lang_id, n.  All with f >= least."""

    texts: DataFrame
    seed: int
    phrases: DataFrame
    words: DataFrame
    totals: DataFrame

    def spelled(self, ids: DataFrame) -> DataFrame:
        """id, word for a column ``id`` of word numbers."""
        found = self.texts.mapInArrow(_spell(self.seed, bit_map(ids.select(F.col("id").alias("key")))), "id long, word string")
        return found.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("word").alias("word"))


def _languages(texts: DataFrame, seed: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            number = pa.array(_lang_numbers(batch.column("lang"), seed).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), number], ["lang", "lang_id"])

    return texts.select("lang").distinct().mapInArrow(run, "lang string, lang_id long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, held: int = HELD, seed: int = 0) -> Phrases:
    """All phrases of one to four words that occur ``least`` times in their language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    while True:
        counted = texts.mapInArrow(_count_words(seed, held), "id long, other long, lang long, n long")
        per = counted.groupBy("id", F.when(F.col("id") == 0, F.col("lang")).alias("of")).agg(
            F.sum("n").alias("f"), F.min("lang").alias("lang_id"), F.min("other").alias("other"), F.max("other").alias("another"))
        clash = (F.col("id") != 0) & (F.col("other") != F.col("another"))
        rows = saved(per.withColumn("clash", clash).where((F.col("id") == 0) | clash | (F.col("f") >= least)).drop("of", "other", "another"), "phrase-words")
        langs = saved(_languages(texts, seed), "phrase-langs")
        if not rows.where("clash").limit(1).count() and not langs.groupBy("lang_id").count().where("count > 1").limit(1).count():
            break
        seed += 1
    totals = rows.where("id = 0 and f > 0").select("lang_id", F.col("f").alias("n")).join(langs, "lang_id")
    words = rows.where("id <> 0").select("id", "lang_id", "f")
    pairs = _frequent(texts, _count_pairs(seed, held, bit_map(words.select(F.col("id").alias("key")))), 2, least, "phrase-pairs")
    longer = _frequent(texts, _count_longer(seed, held, bit_map(pairs.mapInArrow(_with_key, "key long"))), LONGEST, least, "phrase-longer")

    def ids(df, width):
        return df.select(F.filter(F.array(*_ids(width)), lambda x: x != 0).alias("ids"), "f")

    return Phrases(texts, seed, ids(pairs, 2).unionByName(ids(longer, LONGEST)), words, totals)


def _score(a: Column, parts: Column) -> Column:
    """floor(2000000 * a / (l + r)), in decimals."""
    return F.call_function("div", a.cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), parts.cast("decimal(20,0)"))


def scored_cuts(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """ids, a, l, r, score: each candidate with its lowest-scoring cut."""
    known = words.select(F.array("id").alias("ids"), "f").unionByName(phrases)
    n = F.size("ids")
    cut = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    for side, part in (("l", F.slice("ids", F.lit(1), F.col("k"))), ("r", F.slice("ids", F.col("k") + 1, n - F.col("k")))):
        cut = cut.withColumn("part", part).join(known.select(F.col("ids").alias("part"), F.col("f").alias(side)), "part").drop("part")
    cut = cut.withColumn("score", _score(F.col("a"), F.col("l") + F.col("r")))
    return cut.groupBy("ids").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("ids", "c.a", "c.l", "c.r", "c.score")


def not_covered(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """ids of the phrases that no longer phrase holds in ``cover`` percent of their occurrences or more."""
    n = F.size("ids")
    inside = phrases.where(n > 2).select("f", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(
        F.sequence(F.lit(1), n - m + 1), lambda i: F.slice("ids", i, m))))).alias("ids"))
    longest = inside.groupBy("ids").agg(F.max("f").alias("longer"))
    wide = "decimal(25,0)"
    return (phrases.join(longest, "ids", "left")
            .where(F.col("longer").isNull() | (F.col("longer").cast(wide) * 100 < F.col("f").cast(wide) * cover)).select("ids"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = COVER, held: int = HELD, seed: int = 0) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of every language."""
    found = frequent_phrases(docs, least, held, seed)
    kept = scored_cuts(found.phrases, found.words).join(not_covered(found.phrases, cover), "ids")
    lang = found.words.select(F.col("id").alias("first"), "lang_id")
    kept = kept.withColumn("first", F.col("ids")[0]).join(lang, "first").drop("first")
    # Words are spelled for those alone that may be among the first; ties at the end stay in.
    near = kept.withColumn("place", F.rank().over(Window.partitionBy("lang_id").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top).drop("place")
    near = saved(near, "phrase-near")
    places = near.select("ids", F.posexplode("ids").alias("at", "id"))
    spelled = (places.join(found.spelled(places), "id").groupBy("ids")
               .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase")))
    rank = F.row_number().over(Window.partitionBy("lang_id").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return (near.join(spelled, "ids").withColumn("rank", rank).where(F.col("rank") <= top).join(found.totals, "lang_id")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
