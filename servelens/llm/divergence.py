"""Op 12: audit of how the sources of a language differ in their words.

An Arrow pipeline inside ``mapInArrow`` counts: texts go through ``ascii_lower``, ``split_pattern_regex``
and ``dictionary_encode``, and a hash ``group_by`` reduces terms per document and then per
(language, source).  A task keeps one partial table, merges into it and sends it on when it passes
``PARTIAL`` rows, so its memory is bounded whatever it reads.  One shuffle by (language, term)
merges the partial counts; document frequency decides there which terms a language keeps.

Divergences come from columnar shards: the kept terms of a language are dealt into as many shards as
keep (sources x terms) below ``CELLS``.  A shard is a dense matrix of smoothed shares, its rows are
compared source by source, and the shards' sums add up to the whole.

Shares are integers, ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``, computed in decimals; all else is
integer arithmetic, so every figure is exact.

Defined cases: null text, language or source count as empty; a source without kept terms has count 0
throughout; a language that keeps no term has V = 0 and pair values of 0; a language of one source
has no pairs; repeated rows count again; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .common import saved

#: What lies between terms: everything in ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
PARTIAL = 1 << 19
CELLS = 1 << 15

_KEYS = ["lang", "source", "term"]
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_PARTIAL_SQL = "lang string, source string, term string, n long, docs long"


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of every term of every (lang, source) of the batch.

    A group's row with a null term says that the group occurs.
    """
    column = {c: pc.fill_null(batch.column(c), "") for c in ("lang", "source", "text")}
    split = pc.split_pattern_regex(pc.ascii_lower(column["text"]), pattern=BETWEEN)
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.not_equal(words, "")
    words, owner = words.filter(real).dictionary_encode(), owner.filter(real)
    names = {c: column[c].dictionary_encode() for c in ("lang", "source")}
    per_doc = pa.table({"doc": owner, "term": words.indices}).group_by(["doc", "term"], use_threads=False).aggregate([([], "count_all")])
    doc = per_doc["doc"].combine_chunks()
    coded = pa.table({"lang": names["lang"].indices.take(doc), "source": names["source"].indices.take(doc),
                      "term": per_doc["term"], "n": per_doc["count_all"]})
    per = coded.group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    terms = pa.table([names["lang"].dictionary.take(per["lang"]), names["source"].dictionary.take(per["source"]),
                      words.dictionary.take(per["term"]), per["n_sum"], per["n_count"]], schema=_PARTIAL)
    groups = pa.table([column["lang"], column["source"]], names=["lang", "source"]).group_by(["lang", "source"], use_threads=False).aggregate([])
    zero = pa.array(np.zeros(groups.num_rows, np.int64))
    return pa.concat_tables([terms, pa.table([groups["lang"], groups["source"], pa.nulls(groups.num_rows, pa.string()), zero, zero], schema=_PARTIAL)])


def _merged(tables: list[pa.Table]) -> pa.Table:
    per = pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([per["lang"], per["source"], per["term"], per["n_sum"], per["docs_sum"]], schema=_PARTIAL)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, fresh, rows = [], [], 0
    for batch in batches:
        for piece in B.chunks([batch], "text", 4 << 20):
            if not piece.num_rows:
                continue
            fresh.append(_counted(piece))
            rows += fresh[-1].num_rows
            if rows > PARTIAL:
                held, fresh, rows = [_merged(held + fresh)], [], 0
                if held[0].num_rows > PARTIAL:
                    yield from held.pop().to_batches(max_chunksize=1 << 16)
    if held or fresh:
        yield from _merged(held + fresh).to_batches(max_chunksize=1 << 16)


def share(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """Smoothed share of a count, in parts of 10**9; products may pass 64 bits, so they are decimals."""
    count, total, kept = (F.col(c) if isinstance(c, str) else c for c in (count, total, kept))
    above = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = total.cast("decimal(25,0)") + kept.cast("decimal(19,0)") * F.lit(SMOOTH).cast("decimal(2,0)")
    return F.when(kept > 0, F.call_function("div", above, below) + 1)


def term_counts(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(kept terms: lang, source, term, n, in_lang; groups: lang, source, total, kept, lang_total).

    ``kept`` is the number of terms of the language, ``total`` the group's occurrences of them.
    """
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text"))
    partial = texts.mapInArrow(_partials, _PARTIAL_SQL).repartition("lang", "term")
    alike = Window.partitionBy("lang", "term")
    merged = (partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
              .withColumns({"in_docs": F.sum("docs").over(alike), "in_lang": F.sum("n").over(alike)}))
    rows = saved(merged.where((F.col("in_docs") >= least) | F.col("term").isNull()).drop("docs", "in_docs"), "audit-counts")
    kept = rows.where("term is not null")
    in_lang = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = (rows.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(in_lang, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")]))
    return kept, saved(groups, "audit-groups")


def _distances(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over the shard's terms of abs(p - q) for every two sources, as (lang, a, b, f) with a before b."""
    names = groups["source"].combine_chunks()
    found = terms["term"].combine_chunks().dictionary_encode()
    shares = np.repeat(groups["none"].to_numpy()[:, None], len(found.dictionary), axis=1)
    shares[pc.index_in(terms["source"].combine_chunks(), names).to_numpy(), found.indices.to_numpy()] = terms["p"].to_numpy()
    a, b = np.triu_indices(len(names), 1)
    f = np.concatenate([np.abs(shares[i + 1:] - shares[i]).sum(1) for i in range(len(names))]) if len(names) else np.zeros(0, np.int64)
    return pa.table([pa.repeat(key[0], len(a)).cast(pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(f, pa.int64())], names=["lang", "a", "b", "f"])


def source_distances(kept: DataFrame, groups: DataFrame, cells: int = CELLS) -> DataFrame:
    """lang, source, item, value: every two sources of a language and the sum of abs(p - q) over its kept terms."""
    size = Window.partitionBy("lang")
    dealt = groups.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(size) * F.col("kept") / cells)).cast("long"))
    terms = (kept.join(dealt, ["lang", "source"])
             .select("lang", F.pmod(F.xxhash64("term"), "shards").alias("shard"), "source", "term", share("n", "total", "kept").alias("p")))
    base = (dealt.where("kept > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
            .select("lang", "shard", "source", share(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("none")))
    sums = (terms.groupBy("lang", "shard").cogroup(base.groupBy("lang", "shard")).applyInArrow(_distances, "lang string, a string, b string, f long")
            .groupBy("lang", "a", "b").agg(F.sum("f").alias("f")))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                 F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "f").select("lang", "s.*", "f")
    names = groups.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "item"), "lang").where("source <> item")
    return pairs.join(both, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("f", F.lit(0).cast("long")).alias("value"))


def telling_terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: kept terms that a source has and uses more than its language does."""
    p, q = share("n", "total", "kept"), share("in_lang", "lang_total", "kept")
    rows = kept.where("n > 0").join(groups, ["lang", "source"]).withColumns({"p": p, "q": q})
    return rows.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: distances to all other sources, and the ``top`` telling terms."""
    kept, groups = term_counts(docs, least)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked(source_distances(kept, groups), "pair").unionByName(ranked(telling_terms(kept, groups), "term").where(F.col("rank") <= top))
