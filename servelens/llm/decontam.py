"""Op 6: benchmark decontamination by winnowing.

Of the k-gram hashes of a text, the least in every sliding window of w is kept,
on both sides alike, so any shared span of k + w - 1 words shares a fingerprint.
Fingerprints are joined; each hit is extended word by word over at most
``SPAN`` words, which decides exactly which windows occur.

Documents send only fingerprints that may occur in the benchmark: a bit map of fixed size (2**21 bits),
filled from the benchmark's fingerprints, goes to all tasks.  A benchmark that fills it makes it
useless but changes no result.  Items of fewer than ten words are one window of
their own length; documents are looked up at each such length that occurs.

Defined cases: a null text has no words and hits nothing; a null item id stands in
lists as an empty text; items equal in text hit alike; rows equal in
all columns stay separate rows; an empty benchmark leaves every document clean;
other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import saved, text_or_empty

SPAN, K = 10, 5
W = SPAN - K + 1
BITS = 21
_CTX = SPAN - K  # words kept on either side of a k-gram
_CTX_LEN = 2 * _CTX + K
_NONE = np.uint64(0)  # no word hashes to it


def _words(column: pa.Array):
    data, bounds = B.texts(column)
    data = B.LOWER[data]
    starts, ends, text = B.word_spans(data, bounds, B.LETTERS)
    hashes = B.span_hashes(B.prefix_sums(data), starts, ends)
    hashes[hashes == _NONE] = np.uint64(1)
    return hashes, text, np.bincount(text, minlength=len(column))


def fingerprints(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the selected k-grams; leftmost of equal ones, judged by content alone."""
    grams = B.window_hashes(words, K)
    n = len(grams)
    if n < W:
        return np.zeros(0, np.int64), grams[:0]
    low = np.uint64((1 << 24) - 1)
    keys = (grams & ~low) | (np.arange(n, dtype=np.uint64) & low)
    least = B.sliding_min(keys, W)
    whole = text[: len(least)] == text[SPAN - 1: SPAN - 1 + len(least)]
    first = np.arange(len(least))
    # The kept key holds the low bits of its place, which is at most W away.
    at = first + ((least & low).astype(np.int64) - first & int(low))
    at = np.unique(at[whole])
    return at, grams[at]


def short_windows(words: np.ndarray, text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all windows of ``length`` words inside a text."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text[:n] == text[length - 1:])
    value = B.window_hashes(words, length)[at] + np.uint64(length * 0xA24BAED4963EE407 & (1 << 64) - 1)
    return at, B.mixed(value)


def _context(words: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Word hashes from _CTX before to _CTX after each k-gram; _NONE outside the text."""
    place = at[:, None] + np.arange(-_CTX, K + _CTX)[None, :]
    inside = (place >= 0) & (place < len(words))
    place = np.clip(place, 0, max(0, len(words) - 1))
    inside &= text[place] == text[at][:, None]
    return np.where(inside, words[place], _NONE)


_HIT = pa.struct([("fp", pa.int64()), ("pos", pa.int32()), ("len", pa.int32()), ("ctx", pa.list_(pa.int64()))])
_HIT_SQL = "array<struct<fp:bigint,pos:int,len:int,ctx:array<bigint>>>"


def _emit(batch: pa.RecordBatch, lengths: list[int] | None, bits: np.ndarray | None):
    """Number of words and fingerprints of each text.  Without ``lengths``: of items, whose short ones are whole windows."""
    words, text, counts = _words(batch.column("text"))
    first = np.concatenate(([0], np.cumsum(counts)))
    parts = []
    at, value = fingerprints(words, text)
    parts.append((at, value, np.full(len(at), K)))
    for n in range(1, SPAN) if lengths is None else lengths:
        at, value = short_windows(words, text, n)
        if lengths is None:
            whole = counts[text[at]] == n if len(at) else np.zeros(0, bool)
            at, value = at[whole], value[whole]
        parts.append((at, value, np.full(len(at), n + 100)))  # 100 more: a whole short window, no k-gram
    at, value, length = (np.concatenate([p[i] for p in parts]) for i in range(3))
    if bits is not None and len(at):
        probe = value >> np.uint64(64 - BITS)
        maybe = (bits[(probe >> np.uint64(3)).astype(np.int64)] >> (probe & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at, value, length = at[maybe], value[maybe], length[maybe]
    order = np.argsort(at, kind="stable")
    at, value, length = at[order], value[order], length[order]
    ctx = np.where((length == K)[:, None], _context(words, text, at), _NONE) if len(at) else np.zeros((0, _CTX_LEN), np.uint64)
    owner = text[at] if len(at) else np.zeros(0, np.int64)
    ctx_len = np.where(length == K, _CTX_LEN, 0)
    hits = pa.StructArray.from_arrays([
        pa.array(value.astype(np.int64)), pa.array((at - first[owner]).astype(np.int32)), pa.array(length.astype(np.int32)),
        B.list_array(ctx[length == K].ravel().astype(np.int64), ctx_len, pa.int64())], fields=list(_HIT))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=batch.num_rows)))).astype(np.int32)
    return pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), hits)


def _scan(key: str, lengths=None, bits=None):
    def run(batches):
        for batch in B.chunks(batches, "text"):
            n, hits = _emit(batch, lengths, bits)
            yield pa.RecordBatch.from_arrays([batch.column(key), n, hits], [key, "n_words", "hits"])
    return run


def _extend(batches):
    """Covered words [lo, hi) of every hit that a window of the item confirms."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = batch.column("len").to_numpy()
        pos = batch.column("pos").to_numpy().astype(np.int64)
        lo, hi, ok = pos.copy(), pos + length - 100, length > 100
        grams = np.flatnonzero(~ok)
        if len(grams):
            take = pa.array(grams)
            a = batch.column("dctx").take(take).flatten().to_numpy().reshape(-1, _CTX_LEN)
            b = batch.column("ictx").take(take).flatten().to_numpy().reshape(-1, _CTX_LEN)
            same = (a == b) & (a != 0)
            left = np.logical_and.accumulate(same[:, :_CTX][:, ::-1], axis=1).sum(1)
            right = np.logical_and.accumulate(same[:, _CTX + K:], axis=1).sum(1)
            ok[grams] = same[:, _CTX:_CTX + K].all(1) & (left + right + K >= SPAN)
            lo[grams], hi[grams] = pos[grams] - left, pos[grams] + K + right
        yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("item"), pa.array(lo), pa.array(hi)], ["rid", "item", "lo", "hi"]).filter(pa.array(ok))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: rid, doc_id, n_words, n_hit, spans (covered word runs), items (sorted ids as text)."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty().alias("text"))
    grams = saved(named.mapInArrow(_scan("item"), f"item string, n_words long, hits {_HIT_SQL}").select("item", F.explode("hits").alias("h"))
                  .select("item", "h.fp", "h.len", "h.ctx").distinct(), "item-prints")
    lengths = [r[0] - 100 for r in grams.where("len > 100").select("len").distinct().collect()]
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    probes = np.array([r[0] for r in grams.select(F.shiftrightunsigned("fp", 64 - BITS)).distinct().collect()], np.int64)  # at most 2**BITS
    np.bitwise_or.at(bits, probes >> 3, (1 << (probes & 7)).astype(np.uint8))
    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    rows = saved(slim.mapInArrow(_scan("doc_id", sorted(lengths), bits), f"doc_id {kind}, n_words long, hits {_HIT_SQL}")
                 .withColumn("rid", F.monotonically_increasing_id()), "doc-prints")
    asked = rows.where(F.size("hits") > 0).select("rid", F.explode("hits").alias("h")).select("rid", "h.*").withColumnRenamed("ctx", "dctx")
    met = asked.join(grams.withColumnRenamed("ctx", "ictx"), ["fp", "len"])
    found = met.select("rid", "item", "pos", "len", "dctx", "ictx").mapInArrow(_extend, "rid long, item string, lo long, hi long").distinct()
    # Runs of one document, merged: bounded by its length.
    spans = F.aggregate(
        F.array_sort("runs"), F.array().cast("array<struct<lo:bigint,hi:bigint>>"),
        lambda acc, r: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["hi"] >= r["lo"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), F.greatest(F.element_at(acc, -1)["hi"], r["hi"]).alias("hi")))))
        .otherwise(F.concat(acc, F.array(r))))
    per = found.groupBy("rid").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"), F.array_sort(F.collect_set("item")).alias("items")).withColumn("spans", spans)
    out = rows.select("rid", "doc_id", "n_words").join(per.select("rid", "spans", "items"), "rid", "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]), F.lit(0).cast("long"))
    return out.select("rid", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<lo:bigint,hi:bigint>>")).alias("spans"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a word of the benchmark's windows, columns as given."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.xxhash64(text_or_empty()).alias("doc_id"), F.col("text").alias("text"))
    bad = contamination(keyed.select("doc_id", "text"), items).where("n_hit > 0").select("doc_id").distinct()
    return keyed.join(bad, "doc_id", "left_anti").select("_row.*")
