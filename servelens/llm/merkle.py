"""Op 11: document fingerprints as Merkle trees over sections, paragraphs and sentences.

A text is cut without loss: paragraphs are lines with their line break; a section ends after a blank line, before a
heading, or after a paragraph whose own digest says so (about one in ``SECTION``), so an edit moves no boundary
but its own.  Leaves are sentences of a paragraph; one of more than ``LONG`` characters is cut after words picked by
their checksum (about one in ``CLAUSE``).  A node's digest is BLAKE2 of its kind and its children's digests, so equal roots mean equal texts.

The fingerprint spells the tree: root digest, then sections, paragraphs and leaves with digest and length.  Two
fingerprints alone give the likeness of their texts (shared leaves by characters, as Dice) and the spans that differ:
equal roots end the comparison, equal sections and paragraphs are passed over whole.

Next documents: rows are dealt out by range of (id, text), sorted inside partitions and read as a stream; the
last row of each partition waits for the first of the next one, a join of as many rows as there are partitions.  Texts are shuffled
once, each packed by itself, and no task holds more than a batch.

Defined cases: a null text is empty; an empty text's tree has no leaves, is equal to another empty one and unlike all else; null
ids come last; rows equal in id follow in the order of their texts' hashes, equal rows after one another; the only row
is its own next; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SECTION = 4
LONG = 80
CLAUSE = 8
#: A leaf's digest in the fingerprint, in bytes; the root has 16.
LEAF_BYTES = 4
_SENTENCE = re.compile(r"[^.!?\n]*[.!?]+[ \t\n]*|[^.!?]+")
_HEADING = re.compile(r"#{1,6}[ \t]")
_WORD = re.compile(r"\S+\s*|\s+")


def _digest(kind: bytes, parts, size: int = 16) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=size, person=kind).digest()


def _leaves(paragraph: str) -> Iterator[str]:
    for sentence in _SENTENCE.findall(paragraph):
        if len(sentence) <= LONG:
            yield sentence
            continue
        held = ""
        for word in _WORD.findall(sentence):
            held += word
            if zlib.crc32(word.encode("utf-8", "surrogatepass")) % CLAUSE == 0:
                yield held
                held = ""
        if held:
            yield held


def fingerprint(text: str | None) -> str:
    """``root|section;section``, a section being ``paragraph/paragraph``, a paragraph ``digest.length,digest.length``."""
    sections, nodes, paragraphs, spelled = [], [], [], []

    def close():
        if paragraphs:
            nodes.append(_digest(b"section", paragraphs))
            sections.append("/".join(spelled))
            paragraphs.clear()
            spelled.clear()

    for line in (text or "").splitlines(keepends=True) if text else ():
        if _HEADING.match(line):
            close()
        digests, names = [], []
        for leaf in _leaves(line):
            d = hashlib.blake2b(leaf.encode("utf-8", "surrogatepass"), digest_size=16, person=b"leaf").digest()
            digests.append(d)
            names.append(f"{d[:LEAF_BYTES].hex()}.{len(leaf):x}")
        paragraphs.append(_digest(b"paragraph", digests))
        spelled.append(",".join(names))
        if paragraphs[-1][0] % SECTION == 0 or not line.strip():
            close()
    close()
    return f"{_digest(b'root', nodes).hex()}|{';'.join(sections)}"


def _length(leaf: str) -> int:
    return int(leaf.partition(".")[2], 16)


def _split(branch: str, *marks: str) -> list[str]:
    """The leaves under a branch."""
    for mark in marks:
        branch = branch.replace(mark, ",")
    return [x for x in branch.split(",") if x]


def likeness(a: str, b: str) -> float:
    """2 * characters in shared leaves / characters of both texts, by the fingerprints; 1 for equal roots."""
    (root_a, _, body_a), (root_b, _, body_b) = a.partition("|"), b.partition("|")
    if root_a == root_b:
        return 1.0
    sections_a, sections_b = Counter(body_a.split(";")), Counter(body_b.split(";"))
    same = sections_a & sections_b
    shared = sum(n * sum(map(_length, _split(s, "/"))) for s, n in same.items())
    rest = [Counter(x for s, n in (c - same).items() for x in _split(s, "/") * n) for c in (sections_a, sections_b)]
    met = sum(n * _length(x) for x, n in (rest[0] & rest[1]).items())
    total = 2 * shared + sum(n * _length(x) for c in rest for x, n in c.items())
    # Texts that share all leaves in another order are alike, not equal.
    return min(2 * (shared + met) / total, 1 - 1e-9) if total else 0.0


def differing(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans (start, length) in characters of either text whose leaves the other has not, branch by branch."""
    (root_a, _, body_a), (root_b, _, body_b) = a.partition("|"), b.partition("|")
    if root_a == root_b:
        return [], []
    sides = [body.split(";") if body else [] for body in (body_a, body_b)]
    for mark in (";", "/", ","):  # at each level, equal branches drop out on both sides, the rest goes one level down
        found = [Counter(x for x in side if isinstance(x, str)) for side in sides]
        same = found[0] & found[1]
        for k in (0, 1):
            left, out = Counter(same), []
            for x in sides[k]:
                if isinstance(x, int):
                    out.append(x)
                elif left[x] > 0:
                    left[x] -= 1
                    out.append(sum(map(_length, _split(x, "/"))))  # passed over: its length alone
                else:
                    out.extend(x.split("/") if mark == ";" else x.split(",") if mark == "/" else [x])
            sides[k] = out
    return tuple(_spans(side) for side in sides)


def _spans(pieces: list) -> list[tuple[int, int]]:
    out, at = [], 0
    for x in pieces:
        n = x if isinstance(x, int) else _length(x) if x else 0
        if not isinstance(x, int) and n:
            if out and sum(out[-1]) == at:
                out[-1] = (out[-1][0], out[-1][1] + n)
            else:
                out.append((at, n))
        at += n
    return out


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with a column ``fingerprint``; columns that are there stay (one of that name is replaced)."""
    made = F.pandas_udf(lambda s: s.map(fingerprint), "string")
    return docs.withColumn("fingerprint", made(F.coalesce(F.col(text), F.lit(""))))


def changes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, likeness, removed, added (spans in characters) of rows whose fingerprints' roots differ; a missing side counts as an empty text."""
    kind = "struct<likeness:double,removed:array<struct<start:int,length:int>>,added:array<struct<start:int,length:int>>>"

    @F.udf(kind)
    def compared(a, b):
        removed, added = differing(a, b)
        return likeness(a, b), removed, added

    sides = [df.select(F.struct(key).alias("k"), F.col("fingerprint").alias(n)) for df, n in ((old, "a"), (new, "b"))]
    both = sides[0].join(sides[1], "k", "full").fillna(fingerprint(""), ["a", "b"])
    differ = both.where(F.substring_index("a", "|", 1) != F.substring_index("b", "|", 1))
    return differ.select("k", compared("a", "b").alias("c")).select(f"k.{key}", "c.*")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text: str, print_: str, following: str, next_print: str) -> tuple:
    edited = _edited(text, following)
    edited_print = fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_, edited_print,
            likeness(print_, edited_print), likeness(print_, next_print))


_RESULT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
           ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT_SQL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, which halves what is shuffled."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = pa.array([press.compress(t.as_buffer() or b"") for t in batch.column("text").cast(pa.large_binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), batch.column("nth"), texts], ["doc_id", "h", "nth", "text"])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with its next one; a partition's first text and last row come with it, for :func:`_completed`."""
    names, part, first, last = [c for c, _ in _RESULT], None, None, None
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        texts, ids, part = batch.column("text"), batch.column("doc_id"), batch.column("part")[0] if batch.num_rows else part
        taken = []
        for i in range(batch.num_rows):
            text = unpack.decompress(texts[i].as_py()).decode("utf-8", "surrogatepass")
            print_ = fingerprint(text) if last is None or text != last[1] else last[2]
            if last is None:
                first = text
            else:
                rows.append(_row(None, last[1], last[2], text, print_)[1:])
                taken.append(last[0])
            last = (ids.slice(i, 1), text, print_)
        if rows:
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(taken), *[pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _RESULT, strict=True)],
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], ["doc_id", *names, "part", "first", "last"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([last[0], *[pa.nulls(1, t) for _, t in _RESULT], pa.array([part.as_py()], pa.int32()),
                                          pa.array([first]), pa.array([last[1]])], ["doc_id", *names, "part", "first", "last"])


def _completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(None, a, fingerprint(a), b, fingerprint(b))[1:] for a, b in zip(batch.column("last").to_pylist(), batch.column("following").to_pylist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _RESULT, strict=True)]],
                                             ["doc_id", *[c for c, _ in _RESULT]])


def edit_audit(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document: its fingerprint, that of its text with the second half taken from the next document, and how alike they are."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text"), F.lit(""))
    # Equal rows are interchangeable: a number spreads a large group of them over partitions.
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("nth")]
    keyed = docs.select("doc_id", text.alias("text")).withColumns({"h": F.xxhash64("text"), "nth": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16))})
    dealt = (keyed.mapInArrow(_packed, f"doc_id {kind}, h long, nth long, text binary")
             .repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part")))
    rows = saved(dealt.mapInArrow(_paired, f"doc_id {kind}, {_RESULT_SQL}, part int, first string, last string"), "merkle-rows")
    # A row per partition: its last document takes the first one of the next partition that has any, the last of all the first of all.
    edges = rows.where("part is not null")
    seq = Window.partitionBy().orderBy("part")
    places = edges.select("part").withColumn("next", F.coalesce(F.lead("part").over(seq), F.min("part").over(Window.partitionBy())))
    firsts = edges.select(F.col("part").alias("next"), F.col("first").alias("following"))
    ends = edges.select("part", "doc_id", "last").join(places, "part").join(firsts, "next").select("doc_id", "last", "following")
    done = ends.mapInArrow(_completed, f"doc_id {kind}, {_RESULT_SQL}")
    return rows.where("part is null").drop("part", "first", "last").unionByName(done)
