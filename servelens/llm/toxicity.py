"""Op 9: toxicity by nearest labelled examples.

Texts are TF-IDF vectors over words and word beginnings (``PREFIXES`` bytes and a
mark) that the labels show to matter; document
frequencies come from all documents.  A text's neighbours are the examples with
the greatest exact cosine, found in a block-max inverted index: postings are
cut into blocks of examples, each term keeps its greatest weight per block, and blocks are
visited by falling bound until no bound can reach the neighbours found.
Votes weighted by the cosine's square, smoothed by the share of toxic examples, give
the score; the neighbours are its evidence.

Every labelled row that may teach is an example, and every term that matters counts.  Examples with equal vectors are one point with
counts.  Points lie in order of their heaviest terms in shards of about ``SHARD``, each with an index of its own; a text's vector is asked of all
shards, once for all texts that share it, and the nearest of what the shards find are its neighbours.  The driver
holds the terms that matter and how many documents have each, nothing that grows with the rows.

Defined cases: a text without any of the words (empty or null too) has no neighbour and gets
the toxic share of such examples; labels that are null or belong to no document teach
nothing; several labels of one id count each; equal cosines go by the point's place in that order, then by its least id; without
examples every score is 0; equal rows are scored each; other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .common import bucket_of_id, saved, text_or_empty

NEIGHBOURS, BLOCK = 15, 64
#: Points of a shard, vectors asked of a shard in one task, counted words that a task holds.
SHARD, ASKED, HELD = 8_192, 4_096, 300_000
#: A term matters if its log odds, less two standard errors, exceed this, and in at least so many toxic examples.
CLEAR, LEAST = 1.5, 3
PREFIXES = (4, 5)
#: Votes that the toxic share of all examples has.
PRIOR = 0.5

_TABLE = bytes(b if B.LETTERS[b] else 32 for b in B.LOWER.tolist())


def _words(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [t.translate(_TABLE).split() for t in pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").to_pylist()]


def _terms(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


class _Numbered(dict):
    """Word -> numbers of its terms, worked out once for each word; forgets when large."""

    def __init__(self, numbers: dict[bytes, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = tuple(self.numbers[t] for t in _terms(word) if t in self.numbers)
        return got

    def vector(self, words: list[bytes]) -> str:
        found = Counter(t for w in words for t in self[w])
        return ",".join(f"{t}:{n}" for t, n in sorted(found.items()))


def _example_terms(batches):
    found = Counter()

    def told():
        words, ys = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(ys, pa.int32()), pa.array(list(found.values()), pa.int64())], ["word", "toxic", "n"])

    for batch in B.chunks(batches, "text"):
        for y, words in zip(batch.column("toxic").to_pylist(), _words(batch), strict=True):
            found.update((t, y) for t in {t for w in set(words) for t in _terms(w)})
        if len(found) > HELD:
            yield told()
            found.clear()
    if found:
        yield told()


def _vectors(numbers: dict[bytes, int]):
    def run(batches):
        known = _Numbered(numbers)
        for batch in B.chunks(batches, "text"):
            out = [known.vector(words) for words in _words(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.string())], ["doc_id", "held_out", "vector"])
    return run


def parsed(vector: str) -> dict[int, int]:
    return {int(t): int(n) for t, n in (x.split(":") for x in vector.split(",") if x)}


def weighed(vector: dict[int, int], idf: np.ndarray) -> dict[int, float]:
    """Unit length; terms of no document weigh nothing."""
    raw = {t: (1 + math.log(n)) * idf[t] for t, n in vector.items() if idf[t] > 0}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / norm for t, x in raw.items()} if norm else {}


class BlockMaxIndex:
    """Inverted index over weighted points with the greatest weight of each term and block."""

    def __init__(self, points: list[dict[int, float]], terms: int, block: int = BLOCK):
        self.block, self.points = block, len(points)
        blocks = max(1, -(-len(points) // block))
        postings = defaultdict(list)
        for p, v in enumerate(points):
            for t, x in v.items():
                postings[t].append((p, x))
        self.row = np.full(terms, -1)
        self.row[list(postings)] = np.arange(len(postings))
        self.peak = np.zeros((len(postings), blocks))
        self.postings = {}
        for t, rows in postings.items():
            ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            np.maximum.at(self.peak[self.row[t]], ids // block, x)
            self.postings[t] = (ids, x, np.searchsorted(ids, np.arange(blocks + 1) * block))

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """The k greatest cosines above 0 with their points; ties by the lower point."""
        terms = [t for t in query if t in self.postings]
        if not terms:
            return []
        bound = sum(query[t] * self.peak[self.row[t]] for t in terms)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best) == k and bound[b] < -best[-1][0] - 1e-12:
                break
            scores = np.zeros(self.block)
            for t in terms:
                ids, x, at = self.postings[t]
                lo, hi = at[b], at[b + 1]
                scores[ids[lo:hi] - b * self.block] += query[t] * x[lo:hi]
            found = np.flatnonzero(scores > 0)
            best = sorted(best + [(-round(float(scores[i]), 12), int(i + b * self.block)) for i in found])[:k]
        return [(-s, p) for s, p in best]


def _order(idf: np.ndarray):
    """Adds a point's place: its terms, the heaviest first.  Alike points stand together, so that a block's bounds are tight."""
    def run(batches):
        for batch in batches:
            weights = (weighed(parsed(v), idf) for v in batch.column("vector").to_pylist())
            place = [",".join(f"{t:08d}" for t in sorted(w, key=lambda t: (-w[t], t))) for w in weights]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.string())], [*batch.schema.names, "place"])
    return run


def _terms_of(batches):
    """(vector, term) with the other columns, a row per term of the vector."""
    for batch in batches:
        terms = [list(parsed(v)) for v in batch.column("vector").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms]))
        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array([t for x in terms for t in x], pa.int64())], [*batch.schema.names, "term"])


def _nearest(idf: np.ndarray):
    def run(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values(["place", "who", "vector"], kind="stable")
        index = BlockMaxIndex([weighed(parsed(v), idf) for v in points["vector"]], len(idf))
        n, y, who = (points[c].tolist() for c in ("n", "y", "who"))
        shard = int(points["shard"].iloc[0]) if len(points) else 0
        rows = [(v, -s, shard, p, n[p], y[p], who[p]) for v in asked["vector"] for s, p in index.nearest(weighed(parsed(v), idf), NEIGHBOURS)]
        return pd.DataFrame(rows, columns=["vector", "far", "shard", "point", "n", "y", "who"])
    return run


def marks(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1) of the labels that may teach."""
    return labels.where("doc_id is not null and toxic is not null").where(bucket_of_id() != 0).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame) -> dict[bytes, int]:
    """Number of each term that matters, by all examples."""
    taught = marks(labels)
    n = dict.fromkeys((0, 1), 0) | {r[0]: r[1] for r in docs.select("doc_id").join(taught, "doc_id").groupBy("toxic").count().collect()}
    # Merged at every size: labels are many, and a broadcast of them would have to fit each executor.
    texts = docs.where(bucket_of_id() != 0).select("doc_id", text_or_empty().alias("text")).join(taught.hint("merge"), "doc_id").select("toxic", "text")
    found = texts.mapInArrow(_example_terms, "word binary, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    c, d = n[1] - F.col("a") + 0.5, n[0] - F.col("b") + 0.5
    clear = F.log(a * d / (b * c)) - 2 * F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    best = found.withColumn("z", clear).where((F.col("z") >= CLEAR) & (F.col("a") >= LEAST)).select("word", "z").collect()
    return {bytes(r["word"]): i for i, r in enumerate(sorted(best, key=lambda r: (-r["z"], bytes(r["word"]))))}


def neighbours(points: DataFrame, kinds: DataFrame, idf: np.ndarray) -> DataFrame:
    """vector, near (the nearest points, structs of far, shard, point, n, y, who) for every vector of ``kinds`` with any."""
    have, ask = points.count(), kinds.count()
    columns = ", ".join(f"{c} {t}" for c, t in points.dtypes)
    placed = points.mapInArrow(_order(idf), f"{columns}, place string")
    placed = saved(placed.repartitionByRange(max(1, -(-have // SHARD)), "place", "who", "vector").withColumn("shard", F.spark_partition_id()), "points")
    shards = F.sequence(F.lit(0), F.lit(max(1, -(-have // SHARD)) - 1))
    asked = kinds.select("vector", F.explode(shards).alias("shard"))
    parts = max(1, -(-ask // ASKED))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vector"), F.lit(parts)))
    copies = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = copies.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(
        _nearest(idf), "vector string, far double, shard int, point int, n long, y long, who string")
    rows = F.sort_array(F.collect_list(F.struct("far", "shard", "point", "n", "y", "who")))  # NEIGHBOURS of each shard at most
    return found.groupBy("vector").agg(F.slice(rows, 1, NEIGHBOURS).alias("near"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples) for every row of ``docs``."""
    numbers = learn(docs, labels)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", (bucket_of_id() == 0).alias("held_out"), text_or_empty().alias("text"))
    vectors = saved(rows.mapInArrow(_vectors(numbers), f"doc_id {kind}, held_out boolean, vector string"), "vectors")
    kinds = saved(vectors.groupBy("vector").agg(F.count("*").alias("docs")), "vector-kinds")
    idf, total = np.zeros(len(numbers)), kinds.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    for r in kinds.mapInArrow(_terms_of, "vector string, docs long, term long").groupBy("term").agg(F.sum("docs").alias("df")).collect():
        idf[r["term"]] = np.log((total + 1) / r["df"])
    points = saved(vectors.join(marks(labels), "doc_id").groupBy("vector").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("y"), F.min("doc_id").cast("string").alias("who")), "examples")
    blank = F.col("vector") == ""
    taught = points.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "y", F.when(blank, F.col("n")), F.when(blank, F.col("y")))]).first()
    prior = (taught[1] + 0.5) / (taught[0] + 1) if taught[0] else 0.0
    plain = (taught[3] + 0.5 * prior) / (taught[2] + 0.5) if taught[0] else 0.0

    def votes(of: str):
        return F.aggregate("near", F.lit(0.0), lambda acc, p: acc + p["far"] * p["far"] * p[of])

    near = neighbours(points.where(~blank), kinds.where(~blank), idf)
    told = saved(near.select("vector", ((votes("y") + PRIOR * prior) / (votes("n") + PRIOR)).alias("score"),
                             F.array_join(F.slice(F.transform("near", lambda p: p["who"]), 1, 3), ",").alias("evidence")), "vector-scores")
    known = vectors.where(~blank).join(told, "vector", "left").select("doc_id", "held_out", F.coalesce("score", F.lit(plain)).alias("score"), F.coalesce("evidence", F.lit("")).alias("evidence"))
    got = known.unionByName(vectors.where(blank).select("doc_id", "held_out", F.lit(plain).alias("score"), F.lit("").alias("evidence")))
    return got.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
