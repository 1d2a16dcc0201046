"""Operators with one right answer, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from .conftest import made_rows, rows_of
from pyspark.sql import functions as F

from servelens.llm import bytesops, decontam, linededup, neardup, sharding, substrings
from servelens.llm.linking import components


def words(text):
    return (text or "").encode().lower().split()


# ---- op 3


def brute_repeats(texts, length):
    seen = Counter(t[s:s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s:s + length]] > 1:
                cover[s:s + length] = b"\1" * length
        kept = bytes(c for c, x in zip(t, cover, strict=True) if not x)
        runs = sum(1 for i, x in enumerate(cover) if x and not (i and cover[i - 1]))
        out.append((len(t), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [substrings.MOST, 1])
def test_repeated_bytes(docs, most):
    rows = made_rows()
    want = brute_repeats([(r[1] or "").encode() for r in rows], substrings.LENGTH)
    got = rows_of(substrings.deduplicated(docs, most))
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=lambda t: [(x is not None, x) for x in t])


def test_repeated_bytes_of_nothing(none):
    assert substrings.deduplicated(none).collect() == []


def test_tiles_change_nothing(monkeypatch):
    import pyarrow as pa
    rng = random.Random(5)
    text = "".join(rng.choice("ab") for _ in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])

    def starts():
        return sorted(s for *_, lo, hi in substrings._pieces(batch) for a, b in zip(lo, hi, strict=True) for s in range(a, b + 1))

    whole = starts()
    monkeypatch.setattr(substrings, "TILE", 700)
    assert starts() == whole == list(range(3000 - substrings.LENGTH + 1))


def test_run_index_finds_the_longest_matches():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(12)] + [b"abab" * 10, b"a" * 30, b"a" * 30]
    data = np.frombuffer(b"".join(strings), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    index = substrings.RunIndex(data, bounds)
    got = index.matches()
    places = [(i, j) for i, s in enumerate(strings) for j in range(len(s))]

    def agree(a, b):
        x, y = strings[a[0]][a[1]:], strings[b[0]][b[1]:]
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        return n

    for p in places:
        assert got[index.bounds[p[0]] + p[1]] == max(agree(p, q) for q in places if q != p)
    assert index.runs < index.length


# ---- op 4


def brute_components(rows, k, percent):
    sets, parent = [], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))], {find(i) for i, s in enumerate(sets) if s}


def test_near_duplicates(docs):
    want, groups = brute_components(made_rows(), 3, 85)
    want.sort(key=lambda t: [(x is not None, x) for x in t])
    got = neardup.near_duplicates(docs)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    kept = [r for r in neardup.one_of_each(docs, 3, 85).collect()]
    assert len(kept) == len(groups) + sum(1 for _, n, _ in want if not n)
    assert kept[0].__fields__ == docs.columns


def test_left_over_links_are_found(spark):
    """Variants far from their common base are linked to each other, as brute force says."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.sample(range(150), rng.choice((1, 2, 4, 5, 6, 9))):
            w[j] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
        if rng.random() < 0.4:
            w[rng.randrange(150)] = "y"
            rows.append((1000 + i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, 3, 85)[0])


def test_near_duplicates_of_nothing(none):
    assert neardup.near_duplicates(none).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (103, 101), (200, 200)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# ---- op 6


def brute_contamination(rows, items):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = defaultdict(set)
    for item, t in items:
        w = cut(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add("" if item is None else str(item))
    out = []
    for r in rows:
        w, hit, names = cut(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i:i + n])]
        out.append((r[0], len(w), len(hit), sorted(names)))
    return out


def test_contamination(spark, docs):
    rows = made_rows()
    long = re.split(r"\s+", rows[4][1])
    items = [(1, " ".join(long[3:30])), (2, " ".join(long[10:21]).upper()), (3, "one two"), (4, None), (5, ""), (None, " ".join(long[40:52])),
             (1, " ".join(long[3:30])), (7, "never seen words here at all in any of the many texts"), (8, "ab ab ab ab ab ab ab ab ab ab ab")]
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items") == sorted(brute_contamination(rows, items), key=lambda t: [(x is not None, x) for x in t])
    clean = decontam.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns
    assert clean.count() == sum(1 for x in brute_contamination(rows, items) if not x[2])


def test_contamination_by_nothing(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs, empty).where("n_hit > 0").count() == 0
    assert decontam.contamination(none, empty).collect() == []


# ---- op 1


def brute_lines(rows):
    norm = lambda s: regex.sub(r"\p{N}+", "0", regex.sub(r"[^\p{L}\p{N}]+", " ", s.lower())).strip(" ")

    def simhash(n):
        h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in n.split(" ")]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) // 2)

    def distance(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    texts = sorted({(r[0], r[1] or "") for r in rows}, key=lambda t: (t[0] is not None, t[0], _signed(t[1])))
    seen = [(k, p, norm(line)) for k, (_, t) in enumerate(texts) for p, line in enumerate(t.split("\n"))]
    sims = {n: simhash(n) for *_, n in seen if n}
    names, parent = list(sims), {n: n for n in sims}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(names):
        for b in names[:i]:
            if (sims[a] ^ sims[b]).bit_count() <= 2:
                x, y = a.split(" "), b.split(" ")
                if 5 * distance(x, y) <= max(len(x), len(y)):
                    parent[find(a)] = find(b)
    first, gone = {}, defaultdict(list)
    for k, p, n in seen:
        if n and first.setdefault(find(n), (k, p)) != (k, p):
            gone[k].append(p)
    out = {}
    for k, t in enumerate(texts):
        out[t] = (gone[k], "\n".join(x for p, x in enumerate(t[1].split("\n")) if p not in gone[k]))
    return out


def _signed(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def test_lines(docs):
    want = brute_lines(made_rows())
    got = linededup.deduplicated(docs).collect()
    assert len(got) == len(made_rows())
    assert sorted((str(r.doc_id), r.removed, r.text or "") for r in got) == sorted((str(r[0]), *want[(r[0], r[1] or "")]) for r in made_rows())


def test_near_lines(spark):
    words_ = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    other = list(words_)
    other[77] = "changed"
    rows = [(1, " ".join(words_)), (2, "intro\n" + " ".join(other)), (3, "x\n" + " ".join(reversed(words_)))]
    want = brute_lines(rows)
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "removed", "text") == [(i, *want[(i, t)]) for i, t in rows]


def test_long_lines_count_like_short_ones(spark):
    many = [f"v{i}" for i in range(300)]
    df = spark.createDataFrame([(" ".join(many),), ("a b c",), ("solo",)], "t string")
    got = [r[0] for r in df.select(linededup.simhash(F.col("t"))).collect()]
    for t, g in zip((many, ["a", "b", "c"], ["solo"]), got, strict=True):
        h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in t]
        assert g % (1 << 64) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) // 2)


def test_lines_of_nothing(none):
    assert linededup.deduplicated(none).collect() == []


# ---- op 5


def test_shards(docs, none):
    got = sharding.shard_documents(docs).collect()
    rows = made_rows()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    slots = defaultdict(int)
    for r in got:
        slots[r.virtual_slot] += r.size
    loads = [0] * 16
    for v in sorted(slots, key=lambda v: (-slots[v], v)):  # the map's rule
        at = loads.index(min(loads))
        assert all(r.shard == at for r in got if r.virtual_slot == v)
        loads[at] += slots[v]
    assert sharding.shard_documents(none).collect() == []


def test_rebalancing_moves_little(spark, tmp_path):
    stats = spark.createDataFrame([(i, 100 + i % 7, 1) for i in range(160)], "virtual_slot int, bytes long, n long")
    one = sharding.first_map(stats, 8)
    sharding.store_map(one, str(tmp_path / "map"))
    two = sharding.rebalanced(sharding.load_map(spark, str(tmp_path / "map")), stats, 9)
    sharding.store_map(two, str(tmp_path / "map"))
    a, b = (dict(rows_of(sharding.load_map(spark, str(tmp_path / "map"), v), "virtual_slot", "shard")) for v in (1, 2))
    moved = [v for v in a if a[v] != b[v]]
    assert len(b) == 160 and set(b.values()) == set(range(9))
    assert len(moved) <= 160 / 9 + 9
    assert rows_of(sharding.load_map(spark, str(tmp_path / "map")), "version")[0] == (2,)


def test_span_hashes_know_only_content():
    data = np.frombuffer(b"xxabcdyyabcdz", np.uint8)
    sums = bytesops.prefix_sums(data)
    a, b, c = bytesops.span_hashes(sums, np.array([2, 8, 3]), np.array([6, 12, 7]))
    assert a == b != c
    keys = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    for w in (1, 2, 7, 300):
        assert bytesops.sliding_min(keys, w).tolist() == [keys[i:i + w].min() for i in range(301 - w)]


def test_lines_lose_no_link(spark):
    """Short lines whose SimHashes lie far apart, at the least similarity that counts, and runs of one word."""
    rng = random.Random(5)
    lexicon = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    made = []
    for _ in range(60):
        w = rng.choices(lexicon, k=rng.choice([3, 4, 5, 9, 10, 11, 14, 24, 40]))
        made.append(w)
        for _ in range(2):
            v = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 4))):
                at, how = rng.randrange(len(v)), rng.random()
                v[at:at + 1] = [rng.choice(lexicon)] if how < 0.5 else [] if how < 0.75 and len(v) > 1 else [v[at], rng.choice(lexicon)]
            made.append(v)
    made += [["ab"] * k for k in (4, 5, 6, 8, 10, 12, 15)] + [["a", "b", "c", "d"], ["a", "b", "x", "c", "d"]]
    rng.shuffle(made)
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    parent = list(range(len(made)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def distance(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1]

    for i, a in enumerate(made):
        for j in range(i):
            if 5 * distance(a, made[j]) <= max(len(a), len(made[j])):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.removed for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), every_link=True).collect()}
    assert got == {i: [0] if find(i) != i else [] for i in range(len(made))}
    assert sum(map(len, got.values())) > 60


def test_bucket_rows_of_lines_that_share_nothing_are_not_written(spark, monkeypatch):
    rng, rows = random.Random(31), Counter()
    texts = [" ".join(f"v{a}x{b}".translate(str.maketrans("0123456789", "abcdefghij")) for b in range(rng.randint(20, 40))) for a in range(40)]
    write = linededup.saved

    def counted(df, name, **options):
        out = write(df, name, **options)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(linededup, "saved", counted)
    got = linededup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), every_link=True)
    assert all(not r.removed for r in got.collect())
    assert max(rows.values()) <= len(texts)  # of about 20 buckets a line


def test_signatures_of_short_and_long_lines(spark):
    rng = random.Random(37)
    made = [[rng.choice("abcdefghijklmnopq") + str(rng.randrange(k)) for _ in range(n)] for n, k in ((1, 5), (4, 9), (127, 3), (128, 50), (129, 2), (700, 400))]
    df = spark.createDataFrame([(i, len(w), " ".join(w)) for i, w in enumerate(made)], "node long, n int, t string")
    kinds = df.select("node", "n", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("w"))
    want = {r[0]: r[1] for r in df.select("node", linededup.simhash(F.col("t"))).collect()}
    signed = linededup.signatures(kinds)
    assert {r.node: r.sim for r in signed.collect()} == want
    for r in signed.collect():
        assert r.marks.n == len(made[r.node])
        odd = {w for w, c in Counter(made[r.node]).items() if c % 2}
        assert sum((m % (1 << 64)).bit_count() for m in r.marks[1:]) <= len(odd)


def test_links_of_long_lines_that_repeat_few_words(spark):
    rng = random.Random(41)
    made = []
    for n in (linededup.LONG - 1, linededup.LONG, 200, 240):
        for base in ([["x", "y", "z"][i % 3] for i in range(n)], [rng.choice(["x", "y", "p", "q"]) for _ in range(n)], [f"w{chr(97 + rng.randrange(26))}" for _ in range(n)]):
            made.append(base)
            for edits in (n // 5 - 1, n // 5, n // 5 + 2):
                w = list(base)
                for at in rng.sample(range(n), edits):
                    w[at] = "new" + chr(97 + rng.randrange(26))
                made.append(w)

    def distance(a, b):
        prev = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            step = np.minimum(prev[1:] + 1, prev[:-1] + np.array([x != y for y in b]))
            prev = np.minimum.accumulate(np.concatenate([[i], step]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
        return int(prev[-1])

    root = list(range(len(made)))
    for i, a in enumerate(made):
        for j in range(i):
            if 5 * distance(a, made[j]) <= max(len(a), len(made[j])):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    got = {r.doc_id: r.removed for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), every_link=True).collect()}
    assert got == {i: [0] if root[i] != i else [] for i in range(len(made))}
    assert 8 < sum(map(len, got.values())) < len(made) - 8
