"""Op 3: exact repeated byte strings through run-compressed Burrows-Wheeler indexes.

A string of ``LENGTH`` bytes that starts at two places of the corpus is removed at both.

1. Every window of LENGTH bytes has an anchor: the least hash of its K-byte strings, leftmost first.
   Equal windows have equal anchors at equal distance, wherever they stand, so windows that share an anchor
   place form one context (up to 2 * LENGTH - K bytes) and only contexts of equal anchors can hold equal windows.
2. Anchors are counted over the whole corpus; a bit map of fixed size lets through all repeated ones
   (and some others, which changes nothing).
3. A context that occurs twice as a whole is repeated as a whole.  What is left are the
   contexts of repeated anchors that differ somewhere.
4. Those are put, anchor by anchor, into indexes of about a megabyte: the transform
   is kept as runs, with the places and common prefixes of suffixes at run ends alone.  The
   longest match of every position with any other place follows from the nearest sample before it.
   Positions with a match of LENGTH bytes or more start repeated windows.
5. An anchor with more than ``MOST`` different contexts would make an index of unbounded size; its windows
   are counted by hash instead, as any grouped count, with the same result.

Defined cases: a null text is empty; texts of fewer than LENGTH bytes keep all; equal
rows remove each other's bytes; texts are found again by id and hash, so null and
repeated ids are in order; matches never cross texts; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import saved, text_or_empty

LENGTH, K = 200, 40
W = LENGTH - K + 1
BITS = 25
MOST = 8000
TILE = 1 << 22
INDEX_BYTES = 1 << 20


def contexts(data: np.ndarray, bounds: np.ndarray):
    """(anchor hash, context hash, text number, first start, last start) of the windows of all texts; starts are places in ``data``."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    sums = B.prefix_sums(data)
    at = np.arange(len(data) - K + 1)
    grams = B.span_hashes(sums, at, at + K)
    low = np.uint64((1 << 24) - 1)
    least = B.sliding_min((grams & ~low) | (at.astype(np.uint64) & low), W)
    owner = np.searchsorted(bounds, at[:n], side="right") - 1
    inside = bounds[owner + 1] - at[:n] >= LENGTH
    start = at[:n][inside]
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    anchor = (least[inside] & low).astype(np.int64)  # data is a chunk or a tile: shorter than 2**24
    owner = owner[inside]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(start)) - 1
    lo, hi = start[head], start[last]
    return grams[anchor[head]], B.span_hashes(sums, lo, hi + LENGTH), owner[head], lo, hi


def _pieces(batch: pa.RecordBatch):
    """Contexts of a batch, with starts counted from each text's begin; a very long text goes tile by tile."""
    data, bounds = B.texts(batch.column("text"))
    if len(data) <= TILE + LENGTH:
        h, c, owner, lo, hi = contexts(data, bounds)
        yield h, c, owner, lo - bounds[owner], hi - bounds[owner]
        return
    for t in range(batch.num_rows):
        text = data[bounds[t]: bounds[t + 1]]
        for at in range(0, max(1, len(text)), TILE):
            tile = text[at: at + TILE + LENGTH - 1]
            h, c, owner, lo, hi = contexts(tile, np.array([0, len(tile)]))
            yield h, c, owner + t, lo + at, hi + at


def _anchor_counts(batches):
    for batch in B.chunks(batches, "text"):
        for h, *_ in _pieces(batch):
            value, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n)], ["h", "n"])


def _repeated_contexts(bits_ref):
    def run(batches):
        bits = bits_ref.value
        for batch in B.chunks(batches, "text"):
            for h, c, owner, lo, hi in _pieces(batch):
                probe = (h >> np.uint64(64 - BITS)).astype(np.int64)
                maybe = np.flatnonzero((bits[probe >> 6] >> (probe & 63).astype(np.uint64)) & np.uint64(1))
                rows = pa.array(owner[maybe])
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[maybe].astype(np.int64)), pa.array(c[maybe].astype(np.int64)), batch.column("doc_id").take(rows), batch.column("th").take(rows),
                    pa.array(lo[maybe]), pa.array(hi[maybe])], ["h", "c", "doc_id", "th", "lo", "hi"])
    return run


class RunIndex:
    """Runs of the Burrows-Wheeler transform of many strings, with samples at run ends.

    ``first``/``last`` say, for sampled places, how far the suffix there agrees with its neighbour before/after in suffix order.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        count, n = len(bounds) - 1, len(data) + len(bounds) - 1
        self.bounds = bounds + np.arange(count + 1)  # a mark of its own ends every string
        symbols = np.empty(n, np.int64)
        ends = self.bounds[1:] - 1
        is_end = np.zeros(n, bool)
        is_end[ends] = True
        symbols[~is_end] = data
        symbols[ends] = 256 + np.arange(count)
        order = _suffixes(symbols, 256 + count)
        before = symbols[order - 1]  # the transform; place 0 follows the last mark
        cut = np.flatnonzero(before[1:] != before[:-1])
        self.runs = len(cut) + 1
        # Bytes until the end of the string, for every place.
        remain = np.repeat(ends, np.diff(self.bounds)) - np.arange(n)
        filled = np.zeros(n, np.uint8)
        filled[~is_end] = data
        sums = B.prefix_sums(filled)
        self.length = n
        self.first = self._sampled(order[cut + 1], order[cut], sums, remain)
        self.last = self._sampled(order[cut], order[cut + 1], sums, remain)

    @staticmethod
    def _sampled(at, other, sums, remain):
        """(places, agreement) sorted by place; agreement by bisection over hashes of spans."""
        at_most = np.minimum(remain[at], remain[other])
        lo, hi = np.zeros(len(at), np.int64), at_most.copy()
        for _ in range(int(at_most.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = B.span_hashes(sums, at, at + mid) == B.span_hashes(sums, other, other + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        by = np.argsort(at)
        return at[by], lo[by]

    def matches(self) -> np.ndarray:
        """The longest match of every place with another place, streamed from the samples before it."""
        out = np.zeros(self.length, np.int64)
        for at, agree in (self.first, self.last):
            if len(at):
                value = np.full(self.length, -1, np.int64)
                value[at] = at + agree  # the match ends here for all places until the next sample
                place = np.zeros(self.length, np.int64)
                place[at] = at
                place = np.maximum.accumulate(place)
                out = np.maximum(out, value[place] - np.arange(self.length))
        return out


def _suffixes(symbols: np.ndarray, top: int) -> np.ndarray:
    """Suffix order by doubling, up to where all differ: marks differ, so comparing ends with a string."""
    n, width = len(symbols), int(top).bit_length()
    per = max(1, 62 // width)
    key, padded = np.zeros(n, np.int64), np.concatenate((symbols, np.zeros(per, np.int64)))
    for j in range(per):
        key = (key << width) | padded[j: j + n]
    known = per
    while True:
        order = np.argsort(key)
        ranked = key[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        np.cumsum(ranked[1:] != ranked[:-1], out=step[1:])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - known)] = rank[known:] + 1
        key = rank * (n + 1) + ahead
        known *= 2


def _repeats(group: pa.Table):
    """(row, lo, hi) byte spans, from the context's begin, that repeat; rows with n > 1 are targets alone."""
    column = group.column("bytes").combine_chunks()
    data, bounds = B.texts(column)
    index = RunIndex(data, bounds)
    hit = index.matches() >= LENGTH
    place = np.flatnonzero(hit)
    row = np.searchsorted(index.bounds, place, side="right") - 1
    once = group.column("n").to_numpy()[row] == 1
    return _runs(row[once], (place - index.bounds[row])[once])


def _runs(row: np.ndarray, start: np.ndarray):
    """Runs of consecutive starts as spans of bytes."""
    if not len(row):
        return row, start, start
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    return row[head], start[head], start[last] + LENGTH


def _marked(table: pa.Table, row, lo, hi) -> pa.RecordBatch:
    rows = pa.array(row)
    base = table.column("lo").to_numpy()[row]
    return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(rows), table.column("th").combine_chunks().take(rows),
                                       pa.array(base + lo), pa.array(base + hi)], ["doc_id", "th", "lo", "hi"])


def _indexed(batches):
    """Rows come sorted by anchor; whole anchors are indexed together, about INDEX_BYTES at a time."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("bytes").nbytes
        if size > INDEX_BYTES:
            table = pa.Table.from_batches(held)
            anchor = table.column("h").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))
            if cut:
                yield from _index_all(table.slice(0, cut))
                table = table.slice(cut).combine_chunks()
                held = table.to_batches()
                size = table.nbytes
    if held:
        yield from _index_all(pa.Table.from_batches(held))


def _index_all(table: pa.Table):
    anchor = table.column("h").to_numpy()
    edges = np.append(np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1]))), len(anchor))
    size = np.concatenate(([0], np.cumsum(np.diff(edges) * 300)))
    at = 0
    while at < len(edges) - 1:
        end = max(at + 1, int(np.searchsorted(size, size[at] + INDEX_BYTES, side="right")) - 1)
        part = table.slice(edges[at], edges[end] - edges[at]).combine_chunks()
        yield _marked(part, *_repeats(part))
        at = end


def _window_hashes(batches):
    for batch in B.chunks(batches, "bytes"):
        data, bounds = B.texts(batch.column("bytes"))
        sums = B.prefix_sums(data)
        n = np.diff(bounds) - LENGTH + 1
        row = np.repeat(np.arange(len(n)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        value = B.span_hashes(sums, bounds[row] + start, bounds[row] + start + LENGTH)
        rows = pa.array(row)
        base = batch.column("lo").to_numpy()[row]
        yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), *[batch.column(c).take(rows) for c in ("doc_id", "th", "n")],
                                          pa.array(base + start), pa.array(base + start + LENGTH)], ["wh", "doc_id", "th", "n", "lo", "hi"])


def repeated_spans(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, th, lo, hi): byte spans of texts that repeat; spans of a text may overlap."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    texts = _texts(docs)
    counted = texts.select("text").mapInArrow(_anchor_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    probe = F.shiftrightunsigned("h", 64 - BITS)
    words = counted.select((probe.bitwiseAND(63)).alias("b"), F.shiftright(probe, 6).alias("w")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, int(b))")).alias("v")).toPandas()
    bits = np.zeros(1 << (BITS - 6), np.uint64)  # at most so many rows
    bits[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).astype(np.uint64)
    ref = spark.sparkContext.broadcast(bits)
    found = saved(texts.mapInArrow(_repeated_contexts(ref), f"h long, c long, doc_id {kind}, th long, lo long, hi long"), "contexts")
    kinds = saved(found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "lo", "hi")).alias("one")), "context-kinds")
    whole = found.join(kinds.where("n > 1").select("h", "c"), ["h", "c"]).select("doc_id", "th", "lo", (F.col("hi") + LENGTH).alias("hi"))
    mixed = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("int")).alias("once")).where("kinds > 1 AND once > 0")
    test = kinds.join(mixed.select("h", "kinds"), "h").select("h", "c", "n", "kinds", "one.*").withColumnsRenamed({"doc_id": "i", "th": "t"})
    held = test.join(texts, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))).select(
        "h", "c", "n", "kinds", "doc_id", "th", "lo", F.substring(F.col("text").cast("binary"), F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int") + LENGTH).alias("bytes"))
    held = saved(held.dropDuplicates(["h", "c"]), "context-bytes")
    spans = f"doc_id {kind}, th long, lo long, hi long"
    small = held.where(F.col("kinds") <= most).select("h", "doc_id", "th", "lo", "n", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(_indexed, spans)
    large = held.where(F.col("kinds") > most)
    out = whole.unionByName(small)
    if not large.isEmpty():
        windows = saved(large.select("doc_id", "th", "lo", "n", "bytes").mapInArrow(_window_hashes, f"wh long, doc_id {kind}, th long, n long, lo long, hi long"), "windows")
        twice = windows.groupBy("wh").agg(F.count("*").alias("k")).where("k > 1").select("wh")
        out = out.unionByName(windows.where("n = 1").join(twice, "wh").select("doc_id", "th", "lo", "hi"))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))


def _cut(batches):
    for batch in batches:
        n_bytes, removed, spans, sha = [], [], [], []
        runs = batch.column("runs").to_pylist()
        for text, marks in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), runs, strict=True):
            kept, at, gone, number, end = hashlib.sha256(), 0, 0, 0, -1
            for m in sorted(marks or [], key=lambda m: m["lo"]):
                if m["lo"] > end:
                    kept.update(text[at: m["lo"]])
                    number += 1
                    gone += m["hi"] - m["lo"]
                elif m["hi"] > end:
                    gone += m["hi"] - end
                end = at = max(end, m["hi"])
            kept.update(text[at:])
            n_bytes.append(len(text))
            removed.append(gone)
            spans.append(number)
            sha.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)], pa.array(sha, pa.string())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicated(docs: DataFrame, most: int = MOST) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the hash of what is kept."""
    spans = repeated_spans(docs, most)
    per = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")).withColumnsRenamed({"doc_id": "i", "th": "t"})
    texts = _texts(docs)
    joined = texts.join(per, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
