"""Op 4: near-duplicates by min-max hashing.

A text's signature keeps both the least and the greatest value under each
permutation, so half the hash evaluations give as many values to band.  Texts
with equal shingle sets are one node; nodes that share a band are
candidates, and a link counts only after comparing the full sets.

With 80 permutations (160 values in 32 bands of 5) two sets of similarity 0.85 miss each other in
all bands with a probability of 7e-9, of 0.8 with 4e-6.

Pairs that are left after the comparisons with leaders are searched by their differences from the
leader, see :func:`_differences`: two sets that are alike, one of which isn't alike the leader, must share
some of their differences from it.

Defined cases: a text with fewer words than a shingle is one shingle; without
words it has no shingle and no link; a null text is empty; the smallest id ignores nulls, and
a group of null ids only has a null one; equal rows stay separate rows of one group;
other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import saved, text_or_empty
from .linking import linked, rooted

PERMUTATIONS, ROWS = 80, 5
_MULTIPLY = np.random.default_rng(4).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(5).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text number), distinct and sorted within each text."""
    data, bounds = B.texts(column)
    data = B.LOWER[data]
    starts, ends, text = B.word_spans(data, bounds, B.NOT_SPACE)
    words = B.span_hashes(B.prefix_sums(data), starts, ends)
    counts = np.bincount(text, minlength=len(column))
    hashes, owner = B.window_hashes(words, k), text[: max(0, len(text) - k + 1)]
    same = owner == text[k - 1:] if len(owner) else np.zeros(0, bool)
    hashes, owner = [hashes[same]], [owner[same]]
    first = np.concatenate(([0], np.cumsum(counts)))
    for n in range(1, k):
        few = np.flatnonzero(counts == n)
        if len(few):
            value = np.full(len(few), n, np.uint64)
            for j in range(n):
                value = value * np.uint64(0xFF51AFD7ED558CCD) + words[first[few] + j]
            hashes.append(B.mixed(value))
            owner.append(few)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def min_max(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signatures (one row per set): minimum and maximum under each permutation."""
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    for i in range(PERMUTATIONS):
        x = (hashes ^ _ADD[i]) * _MULTIPLY[i]
        x ^= x >> np.uint64(29)
        out[:, 2 * i] = np.minimum.reduceat(x, starts)
        out[:, 2 * i + 1] = np.maximum.reduceat(x, starts)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """A hash for each band of ROWS values; the band's number is part of it."""
    n = signatures.shape[1] // ROWS
    out = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(signatures), 1))
    for j in range(ROWS):
        out = out * np.uint64(0x9FB21C651E98DF25) + signatures[:, j::ROWS][:, :n]
    return B.mixed(out)


def _sign(k: int):
    def run(batches):
        for batch in B.chunks(batches, "text"):
            hashes, owner = shingles(batch.column("text"), k)
            n = np.bincount(owner, minlength=batch.num_rows)
            some = np.flatnonzero(n)
            key = np.zeros((batch.num_rows, 2), np.uint64)
            band = np.zeros((0, 0), np.uint64)
            if len(some):
                starts = (np.cumsum(n) - n)[some]
                band = bands(min_max(hashes, starts))
                # The sum of two independent hashes of its members stands for a set.
                for j, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    key[some, j] = B.mixed(np.add.reduceat(B.mixed(hashes ^ np.uint64(salt)), starts) + n[some].astype(np.uint64))
            per = np.where(n > 0, band.shape[1], 0)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(key[:, 0].astype(np.int64)), pa.array(key[:, 1].astype(np.int64)),
                B.list_array(band.ravel().astype(np.int64), per, pa.int64())], ["doc_id", "th", "n_shingles", "k1", "k2", "bands"])
    return run


def _confirm(k: int, percent: int):
    def run(batches):
        for batch in batches:
            pieces = B.chunks([batch], "ta")
            for part in pieces:
                ha, oa = shingles(part.column("ta"), k)
                hb, ob = shingles(part.column("tb"), k)
                na, nb = np.bincount(oa, minlength=part.num_rows), np.bincount(ob, minlength=part.num_rows)
                # Per pair both sets are sorted and distinct: what stands twice after a merge is common.
                h, o = np.concatenate((ha, hb)), np.concatenate((oa, ob))
                order = np.lexsort((h, o))
                h, o = h[order], o[order]
                both = np.bincount(o[1:][(h[1:] == h[:-1]) & (o[1:] == o[:-1])], minlength=part.num_rows)
                ok = (100 * both >= percent * (na + nb - both)) & (both > 0)
                yield part.filter(pa.array(ok)).select(["a", "b"])
    return run


def _differences(k: int, percent: int):
    """Rows (leader, node, e, n, f, g, long_x, long_y): every difference e of each node from its leader.

    Of a node's set x and its leader's set b let A be what x lacks and B what it adds, and f = (1 - s) |A| + s |B|
    with s = p / (1 + p) for the similarity p.  x and b are alike exactly if f(x) <= g = (1 - 2 s) |b|.  Two
    sets x and y are alike exactly if they share at least f(x) + f(y) - g differences.  If x isn't alike b, that is
    more than f(y), and at least f(x) - g: so in any common order of differences, x among its first
    long_x = n - (f(x) - g) + 1 and y among its first long_y = n - f(y) must have one in common, n being its number of differences.
    """
    p = percent / 100
    s = p / (1 + p)

    def run(batches):
        for batch in batches:
            for part in B.chunks([batch], "ta"):
                hx, ox = shingles(part.column("ta"), k)
                hb, ob = shingles(part.column("tb"), k)
                h, o = np.concatenate((hx, hb)), np.concatenate((ox, ob))
                lacks = np.concatenate((np.zeros(len(hx), bool), np.ones(len(hb), bool)))
                order = np.lexsort((h, o))
                h, o, lacks = h[order], o[order], lacks[order]
                twin = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
                alone = ~(np.append(twin, False) | np.insert(twin, 0, False)) if len(h) else np.zeros(0, bool)
                h, o, lacks = h[alone], o[alone], lacks[alone]
                n = np.bincount(o, minlength=part.num_rows)
                na = np.bincount(o[lacks], minlength=part.num_rows)
                f = (1 - s) * na + s * (n - na)
                g = (1 - 2 * s) * np.bincount(ob, minlength=part.num_rows)
                long_x = np.clip(n - np.maximum(1, np.ceil(f - g - 1e-6)) + 1, 0, n).astype(np.int64)
                long_y = np.clip(n - np.floor(f - 1e-6), 0, n).astype(np.int64)
                rows = pa.array(o)
                e = h ^ np.where(lacks, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
                yield pa.RecordBatch.from_arrays([
                    part.column("leader").take(rows), part.column("node").take(rows), pa.array(e.astype(np.int64)), pa.array(n[o]),
                    pa.array(f[o]), pa.array(g[o]), pa.array(long_x[o]), pa.array(long_y[o])], ["leader", "node", "e", "n", "f", "g", "long_x", "long_y"])
    return run


def _left_over(k: int, percent: int):
    """Pairs of one leader's nodes that share as many differences from it as likeness demands.

    Differences are ordered by how many of the leader's nodes have them, rarest first; those that one node
    alone has come before all others and can't be shared.  So edits that most variants of a text
    have in common stand last, where only nodes with hardly any differences of their own look.
    """
    def within(asked: DataFrame, payload: DataFrame, roots: DataFrame | None) -> DataFrame:
        placed = rooted(rooted(asked, roots, "node", "root"), roots, "leader", "lead_root")
        placed = saved(placed.withColumn("open", F.col("root") != F.col("lead_root")), "asked")
        leaders = placed.where("open").select("leader").distinct()
        texts = payload.select(F.col("node").alias("n"), F.col("payload.text").alias("text"))
        both = (placed.join(leaders, "leader").join(texts.withColumnRenamed("text", "ta"), F.col("node") == F.col("n")).drop("n")
                .join(texts.withColumnRenamed("text", "tb"), F.col("leader") == F.col("n")).drop("n"))
        rows = saved(both.select("leader", "node", "ta", "tb").mapInArrow(
            _differences(k, percent), "leader long, node long, e long, n long, f double, g double, long_x long, long_y long"), "differences")
        common = rows.groupBy("leader", "e").agg(F.count("*").alias("c")).where("c > 1")
        mine = Window.partitionBy("leader", "node")
        rows = rows.join(common, ["leader", "e"])
        rows = rows.withColumns({"held": F.count("*").over(mine), "pos": F.row_number().over(mine.orderBy("c", "e"))})
        nth = F.col("n") - F.col("held") + F.col("pos")
        rows = rows.withColumns({"as_x": nth <= F.col("long_x"), "as_y": nth <= F.col("long_y"), "after": F.col("held") - F.col("pos")})
        # Where a beginning ends, and how many come after it.
        ends = {f"{c}_{v}": f.over(mine) for v in "xy" for c, f in (("end", F.max(F.when(F.col(f"as_{v}"), F.struct("c", "e")))), ("rest", F.count_if(~F.col(f"as_{v}"))))}
        rows = rows.withColumns(ends).where("as_x OR as_y").join(placed.select("leader", "node", "root", "open"), ["leader", "node"])
        names = ("node", "root", "f", "pos", "after")
        x = rows.where("as_x AND open").select("leader", "e", "g", "end_x", "rest_x", *[F.col(c).alias(f"x_{c}") for c in names])
        y = rows.where("as_y").select("leader", "e", "end_y", "rest_y", *[F.col(c).alias(f"y_{c}") for c in names])
        # What can be shared: as many as stand up to this one on either side, and as many as come after.
        met = x.join(y, ["leader", "e"]).where(
            "x_root <> y_root AND x_f + y_f - g <= least(x_pos, y_pos) + least(x_after, y_after) + 1e-6")
        # What both beginnings share is counted; beyond the end of the one that ends first only the rest of that node can be shared.
        rest = F.when(F.col("end_x") < F.col("end_y"), F.col("rest_x")).when(F.col("end_x") > F.col("end_y"), F.col("rest_y")).otherwise(F.greatest("rest_x", "rest_y"))
        met = (met.withColumn("short", F.col("x_f") + F.col("y_f") - F.col("g") - rest).groupBy("leader", "x_node", "y_node")
               .agg(F.count("*").alias("met"), F.first("short").alias("short")).where("met >= short - 1e-6"))
        return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    return within


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, first (is its text the one that stands for the group) for every row."""
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = saved(texts.mapInArrow(_sign(k), f"doc_id {kind}, th long, n_shingles long, k1 long, k2 long, bands array<long>"), "signatures")
    some = rows.where("n_shingles > 0")
    sets = some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.min("doc_id").alias("low"), F.first("bands").alias("bands"))
    nodes = saved(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node")

    def fetch(ends: DataFrame) -> DataFrame:
        """One text per node; a text is found by its document."""
        wanted = nodes.join(ends, "node").select("node", F.col("least.doc_id").alias("i"), F.col("least.th").alias("t"))
        found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
        return found.select("node", F.struct("text").alias("payload")).dropDuplicates(["node"])

    def confirm(pairs: DataFrame) -> DataFrame:
        return pairs.select("a", "b", F.col("pa.text").alias("ta"), F.col("pb.text").alias("tb")).mapInArrow(_confirm(k, percent), "a long, b long")

    roots = linked(buckets, fetch, confirm, _left_over(k, percent))
    named = nodes.select("k1", "k2", "node", "least", "low")
    if roots is None:
        named = named.withColumns({"component_id": F.col("low"), "stands": F.col("least")})
    else:
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        whole = named.groupBy("root").agg(F.min("low").alias("component_id"), F.min("least").alias("stands"))
        named = named.join(whole, "root")
    named = named.select("k1", "k2", "component_id", "stands")
    alone = rows.where("n_shingles = 0").select("doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    grouped = some.join(named, ["k1", "k2"]).select("doc_id", "th", "n_shingles", "component_id", F.struct("doc_id", "th").eqNullSafe(F.col("stands")).alias("first"))
    return grouped.unionByName(alone)


def one_of_each(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """The documents without all but one of each group, columns as given; texts without words stay."""
    judged = near_duplicates(docs, k, percent).where("first").groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.max("n_shingles").alias("_n"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_i"), F.xxhash64(text_or_empty()).alias("_h"))
    kept = keyed.join(judged, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t")))
    # Rows that repeat id and text are told apart only by number.
    numbered = kept.withColumn("_k", F.row_number().over(Window.partitionBy("_i", "_h").orderBy("_n")))
    return numbered.where("_k = 1 OR _n = 0").select("_row.*")
