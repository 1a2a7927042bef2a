"""Near duplicates: SimHash fingerprints, Golay-code fuzzy keys, verified pairs and their groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlane.llm import golay
from postlane.llm.common import blocks, drop_table, kept, mix, settle, spare, texts_of
from postlane.llm.words import ALNUM, Hasher, lower, spans

#: Segments of 23 bits that are indexed, the indices that one has, and the words of 64 bits of the whole fingerprint.
SEGMENTS, INDICES, WORDS = 11, 1 << golay.DATA, 4
#: Most differing bits of all 256.
NEAR_WIDE = 52
#: Fingerprints of a bucket above which it is split, fingerprints that a task deals or searches at once, pairs that it compares at once, bytes that it is sent.
GROUP, DEAL, CHUNK, PAIRS, TASK_BYTES = 1 << 17, 1 << 14, 1 << 16, 1 << 17, 64 << 20
#: The least ratio between the numbers of different words of two near duplicates. The votes of long words outweigh the
#: others, so a text stripped of its short words would pass for a copy.
NEAR_SIZE = 0.8

#: Bytes of text, and words of it, whose votes are counted at a time.
_PIECE, _VOTES = 256 << 10, 1 << 13
#: A fingerprint on its way to a bucket; the number of words also says, in its upper bit, on which side of a cell it is.
_ROW = np.dtype([("w", "<u8", (WORDS,)), ("doc", "<i8"), ("n", "<u4")])
_SCHEMA = "doc_id bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint, n bigint"


def signatures(text: pa.Array, hasher: Hasher | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n x WORDS fingerprints, different words of each text).

    Each different word, in lower case and without punctuation, votes on every bit with the square of its length, ten
    letters at most: long words tell texts apart, and short ones occur everywhere.
    """
    hasher = hasher or Hasher()
    out, size_of = np.zeros((len(text), WORDS), np.uint64), np.zeros(len(text), np.int64)
    for first, _, raw, offsets in blocks(text, _PIECE):
        low = lower(raw)
        starts, ends, of = spans(low, offsets, ALNUM)
        if not len(starts):
            continue
        h = hasher(low, starts, ends)
        _, at = np.unique(h ^ mix(of), return_index=True)
        at.sort()
        h, of, size = h[at], of[at], np.minimum(ends[at] - starts[at], 10)
        weight = (size * size).astype(np.float32)
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        votes = np.zeros((len(cut), WORDS * 64))
        for part in range(0, len(h), _VOTES):
            bits = np.unpackbits(np.stack([mix(h[part : part + _VOTES] + np.uint64(k + 1)) for k in range(WORDS)], axis=1).view(np.uint8), axis=1, bitorder="little")
            for row in range(np.searchsorted(cut, part, "right") - 1, np.searchsorted(cut, part + len(bits))):
                a, b = max(cut[row], part), min(cut[row + 1] if row + 1 < len(cut) else len(h), part + len(bits))
                votes[row] += (2 * (weight[a:b] @ bits[a - part : b - part].astype(np.float32))) - weight[a:b].sum()
        rows = of[cut]
        out[first + rows] = np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64)
        size_of[first + rows] = np.diff(np.r_[cut, len(of)])
    return out, size_of


def segments(words: np.ndarray) -> np.ndarray:
    """SEGMENTS pieces of 23 bits, 253 of the 256: two from the low end of each word, three from the 18 bits left of each."""
    low = np.uint64((1 << golay.BITS) - 1)
    w = words.astype(np.uint64)
    out = [(w[:, k] >> np.uint64(golay.BITS * s)) & low for k in range(WORDS) for s in range(2)]
    a, b, c, d = (w[:, k] >> np.uint64(2 * golay.BITS) for k in range(WORDS))
    out += [(a | (b << np.uint64(18))) & low, ((b >> np.uint64(5)) | (c << np.uint64(13))) & low, ((c >> np.uint64(10)) | (d << np.uint64(8))) & low]
    return np.stack(out, axis=1).astype(np.int64)


def _apart(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(w[k, x] ^ w[k, y]).astype(np.int64) for k in range(len(w)))


def buckets(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): each index of each segment but the last, as segment * INDICES + index."""
    rows, out = [], []
    for s, piece in enumerate(segments(words).T[:-1]):
        index, use = golay.indices(piece)
        row, k = np.nonzero(use)
        rows.append(row)
        out.append(s * INDICES + index[row, k])
    return np.concatenate(rows), np.concatenate(out)


def _shared(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least index that x[k] and y[k], words of 23 bits, have in common, or INDICES. Within two bits there is one, beyond eight there is none."""
    out = np.full(len(x), INDICES)
    near = np.flatnonzero(np.bitwise_count(words[x] ^ words[y]) <= 8)
    for part in range(0, len(near), 1 << 15):
        at = near[part : part + (1 << 15)]
        (a, use_a), (b, use_b) = golay.indices(words[x[at]]), golay.indices(words[y[at]])
        a, b = np.where(use_a, a, INDICES), np.where(use_b, b, -1)
        out[at] = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, INDICES).min(axis=1)
    return out


def _runs(first: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, q) for each p and each q from first[p] to after[p] - 1, about PAIRS at a time; one p's stay together."""
    n = np.maximum(after - first, 0)
    ends = np.cumsum(n)
    part = 0
    while part < len(n):
        last = max(part + 1, int(np.searchsorted(ends, (ends[part - 1] if part else 0) + PAIRS, "right")))
        m = n[part:last]
        p = np.repeat(np.arange(part, last), m)
        yield p, np.arange(len(p)) - np.repeat(np.cumsum(m) - m, m) + first[p]
        part = last


def close_pairs(words: np.ndarray, cell: np.ndarray, bucket: np.ndarray, after: np.ndarray, near_wide: int, wanted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (x, y), x < y: rows of one cell that share the index of a segment beyond their bucket's, differ in at most near_wide bits and are wanted(x, y).

    Rows are in order of their cells, and x has partners before after[x] alone. Rows with equal keys of a segment are
    compared; those of a cell where that makes more comparisons than it has pairs, as a family of near copies does,
    are compared with all others at once. A pair counts in the first bucket and there under the first key that it
    shares alone, so that it is found once, whatever cells it meets in, and nothing is held but a block of pairs.
    """
    segment = bucket // INDICES
    pieces = segments(words).T.astype(np.int32)
    w = np.ascontiguousarray(words.T)

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = _apart(w[:2], x, y) <= near_wide
        x, y = x[ok], y[ok]
        for s in range(SEGMENTS - 2):  # most pairs of a family met in an earlier bucket
            ok = (segment[x] <= s) | (np.bitwise_count(pieces[s, x] ^ pieces[s, y]) > 2)
            if not ok.all():
                x, y = x[ok], y[ok]
        ok = _apart(w, x, y) <= near_wide
        x, y = x[ok], y[ok]
        ok = wanted(x, y)
        x, y = x[ok], y[ok]
        for s in range(SEGMENTS - 1):
            at = np.flatnonzero(segment[x] >= s)
            if len(at):
                first = _shared(pieces[s], x[at], y[at])
                ok = np.ones(len(x), bool)
                ok[at] = first == np.where(segment[x[at]] == s, bucket[x[at]] % INDICES, INDICES)
                x, y = x[ok], y[ok]
        return x, y

    def keys(b: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, row, the place after the last partner) of each index of segment b of the rows, in order of key and row."""
        packed = []
        for part in range(0, len(rows), 1 << 14):
            r = rows[part : part + (1 << 14)]
            index, use = golay.indices(pieces[b, r])
            k, i = np.nonzero(use)
            packed.append((cell[r[k]] * INDICES + index[k, i]) << 32 | r[k])
        packed = np.sort(np.concatenate(packed)) if packed else np.zeros(0, np.int64)
        key, row = packed >> 32, packed & 0xFFFFFFFF
        return key, row, np.searchsorted(packed, key << 32 | after[row])

    ways, whole = np.zeros(int(cell[-1]) + 1, np.int64), np.bincount(cell, after - np.arange(len(cell)) - 1).astype(np.int64)
    for b in range(1, SEGMENTS):
        key, row, end = keys(b, np.flatnonzero(segment < b))
        ways += np.bincount(key // INDICES, end - np.arange(len(key)) - 1, len(ways)).astype(np.int64)
    dense = (ways > whole)[cell]
    for b in range(1, SEGMENTS):
        key, row, end = keys(b, np.flatnonzero((segment < b) & ~dense))
        for p, q in _runs(np.arange(len(key)) + 1, end):
            index = key[p] % INDICES
            x, y = row[p], row[q]
            ok = _apart(w[:2], x, y) <= near_wide
            x, y, index = x[ok], y[ok], index[ok]
            for s in range(1, b):  # another key of theirs came before this one
                ok = (segment[x] >= s) | (np.bitwise_count(pieces[s, x] ^ pieces[s, y]) > 2)
                if not ok.all():
                    x, y, index = x[ok], y[ok], index[ok]
            ok = _apart(w, x, y) <= near_wide
            x, y, index = x[ok], y[ok], index[ok]
            ok = _shared(pieces[b], x, y) == index
            x, y = x[ok], y[ok]
            for s in range(1, b):
                at = np.flatnonzero(segment[x] < s)
                if len(at):
                    ok = np.ones(len(x), bool)
                    ok[at] = _shared(pieces[s], x[at], y[at]) == INDICES
                    x, y = x[ok], y[ok]
            x, y = near(x, y)
            if len(x):
                yield x, y
    rows = np.flatnonzero(dense)
    for p, y in _runs(rows + 1, after[rows]):
        x, y = near(rows[p], y)
        found = np.zeros(len(x), bool)
        for s in range(1, SEGMENTS):
            at = np.flatnonzero(~found & (segment[x] < s))
            found[at] = np.bitwise_count(pieces[s, x[at]] ^ pieces[s, y[at]]) <= 2
        for s in range(1, SEGMENTS):
            at = np.flatnonzero(~found & (segment[x] < s))
            found[at] = _shared(pieces[s], x[at], y[at]) < INDICES
        if found.any():
            yield x[found], y[found]


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for b in batches:
        sig, n = signatures(b.column(1), hasher)
        has = n > 0
        ids = b.column(0).filter(pa.array(has))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(sig[has, k].view(np.int64)) for k in range(WORDS)), pa.array(n[has])], ["doc_id", "w0", "w1", "w2", "w3", "n"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, four words of 64 bits and the number of different words of each document that has a word and a doc_id."""
    return texts_of(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_fingerprint, _SCHEMA)


def _bits(k: int, a: str, b: str) -> str:
    return f"bit_count({a}.w{k} ^ {b}.w{k})"


def _words(b: pa.RecordBatch) -> np.ndarray:
    return np.stack([b.column(f"w{k}").to_numpy() for k in range(WORDS)], axis=1).view(np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros((SEGMENTS - 1) * INDICES, np.int64)
    for b in batches:
        if b.num_rows:
            n += np.bincount(buckets(_words(b))[1], minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])


def _deal(split: np.ndarray):
    """Rows (cell, fingerprints): each fingerprint goes to the cell of each of its buckets, or to as many as the bucket is split into groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            found = np.concatenate(held)
            held.clear()
            row, bucket = buckets(found["w"])
            groups = split[bucket]
            own = (mix(found["doc"]) >> np.uint64(1)).astype(np.int64)[row] % groups
            row, bucket, own = (np.repeat(v, groups) for v in (row, bucket, own))
            other = np.arange(len(row)) - np.repeat(np.cumsum(groups) - groups, groups)
            low, high = np.minimum(own, other), np.maximum(own, other)
            cell = bucket << 40 | low << 20 | high
            order = np.argsort(cell, kind="stable")
            cell, rows = cell[order], found[row[order]]
            rows["n"] |= ((low != high) & (own == high))[order].astype(np.uint32) << np.uint32(31)
            cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            for part in range(0, len(cut), 1 << 12):
                at = np.r_[cut, len(cell)][part : part + (1 << 12) + 1]
                sent = rows[at[0] : at[-1]]
                blob = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(((at - at[0]) * _ROW.itemsize).astype(np.int32)), pa.py_buffer(sent.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(cell[at[:-1]]), blob], ["cell", "rows"])

        held: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                found = np.empty(b.num_rows, _ROW)
                found["w"], found["doc"], found["n"] = _words(b), b.column("doc_id").to_numpy(), b.column("n").to_numpy()
                held.append(found)
                if sum(map(len, held)) * int(split.max()) >= DEAL:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Make root[k] the least of what k is connected to, once x[k] and y[k] are connected as well; roots are their own roots."""
    while True:
        a, b = root[x], root[y]
        open = a != b
        if not open.any():
            return
        x, y, a, b = x[open], y[open], a[open], b[open]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root[:] = up


def _search(near_wide: int, near_size: float, links: bool = False):
    """The pairs of cells (a, b, bits), or for each fingerprint that has any (a, b, links): the least that it is connected to in them, and their number."""

    def pairs(found: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(x for _, x in found), _ROW)
        size = np.array([len(x) // _ROW.itemsize for _, x in found])
        cell = np.repeat(np.array([c for c, _ in found]), size)
        no = np.cumsum(np.r_[False, cell[1:] != cell[:-1]])
        n = (rows["n"] & np.uint32(0x7FFFFFFF)).astype(np.int64)
        order = np.argsort(no << 32 | n, kind="stable")
        rows, cell, n = rows[order], cell[order], n[order]
        most = np.minimum(n / max(near_size, 1e-9), (1 << 31) - 2).astype(np.int64) + 1  # wanted() is exact
        after = np.searchsorted(no << 32 | n, no << 32 | most, "right")
        side, doc = rows["n"] >> np.uint32(31), rows["doc"]
        within = (cell >> 20 & 0xFFFFF) == (cell & 0xFFFFF)
        wanted = lambda x, y: (within[x] | (side[x] != side[y])) & (n[x] >= near_size * n[y])
        words = np.ascontiguousarray(rows["w"])
        blocks = close_pairs(words, no, cell >> 40, after, near_wide, wanted)
        if not links:
            w = np.ascontiguousarray(words.T)
            for x, y in blocks:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[x], doc[y])), pa.array(np.maximum(doc[x], doc[y])), pa.array(_apart(w, x, y).astype(np.int32))], ["a", "b", "bits"])
            return
        ids, of = np.unique(doc, return_inverse=True)
        root, count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for x, y in blocks:
            count += np.bincount(of[x], minlength=len(ids)) + np.bincount(of[y], minlength=len(ids))
            _joined(root, of[x], of[y])
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(count[at])], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        size = 0
        for b in batches:
            for cell, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if size >= CHUNK * _ROW.itemsize and held[-1][0] != cell:
                    yield from pairs(held)
                    held, size = [], 0
                held.append((cell, rows))
                size += len(rows)
        if held:
            yield from pairs(held)

    return run


def _searched(prints: DataFrame, near_wide: int, near_size: float, group: int, links: bool) -> DataFrame:
    counted = prints.mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 40,960 rows at most
    split = np.ones((SEGMENTS - 1) * INDICES, np.int64)
    for r in counted:
        split[r["bucket"]] = -(-r["n"] // group)
    sent = sum(r["n"] * int(split[r["bucket"]]) for r in counted) * _ROW.itemsize
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sent // TASK_BYTES))
    dealt = prints.mapInArrow(_deal(split), "cell bigint, rows binary").repartition(tasks, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_search(near_wide, near_size, links), "a bigint, b bigint, links bigint" if links else "a bigint, b bigint, bits int")


def wide_pairs(prints: DataFrame, near_wide: int = NEAR_WIDE, near_size: float = NEAR_SIZE, group: int = GROUP) -> DataFrame:
    """(a, b, bits), a < b: fingerprints that differ in at most near_wide of 256 bits, of texts with like numbers of words, given one row for each; each pair once.

    Compared are those that share the Golay indices of two of SEGMENTS segments, 253 bits of the 256: certain up to 29
    differing bits, as ten segments with three or more make 30, and a matter of chance beyond; README has the recall
    by distance. A fingerprint is sent to the bucket of each index of its first ten segments, about 53 of 40,960; the
    second index's keys are made and sorted inside the bucket's task and go through no shuffle, which so grows with
    the fingerprints alone. Buckets are counted first: one of more than `group` fingerprints, as a large family of
    near copies makes, is split into groups, and every two groups have a cell, so that no task holds more than two.
    """
    return _searched(prints, near_wide, near_size, group, False)


def wide_links(prints: DataFrame, near_wide: int = NEAR_WIDE, near_size: float = NEAR_SIZE, group: int = GROUP) -> DataFrame:
    """(a, b, links): what the pairs of wide_pairs() come to, in rows that grow with the fingerprints and not with the pairs.

    Connected components of the edges (a, b) are those of the pairs, and the sum of a's links is the number of its pairs.
    """
    return _searched(prints, near_wide, near_size, group, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the least node that it is connected to.

    Alternates large-star and small-star, each round a table in the shared folder, until no edge changes; the number
    of rounds grows with the logarithm of the longest path.
    """
    edges = settle(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        m = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", m).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        small = down.withColumn("m", low).select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = settle(small, "edges")
        same = lambda d: tuple(d.agg(F.count("*"), F.expr("bit_xor(xxhash64(least(a, b), greatest(a, b)))")).first())
        done = same(new) == same(edges)
        drop_table(edges)
        edges = new
        if done:
            return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))


def near_duplicates(docs: DataFrame, near_wide: int = NEAR_WIDE, near_size: float = NEAR_SIZE) -> DataFrame:
    """(doc_id, duplicate_of, bits, links): each document but the first of its group, the group's least doc_id, the bits between them, the other texts near it.

    Groups are the connected components of pairs of fingerprints that differ in at most near_wide of 256 bits, of
    texts whose numbers of different words are near_size of each other or nearer. Texts equal in both are one node, so
    thousands of exact copies cost one search; links counts the nodes that a document's own is paired with. A row that
    repeats a doc_id counts once, with the most links; rows without a doc_id, and texts that are null or have no word,
    are in no group. Texts are used whole. No documents, no rows.
    """
    every = settle(fingerprints(docs), "prints")
    words = ["n", *(f"w{k}" for k in range(WORDS))]
    node = settle(every.groupBy(*words).agg(F.min("doc_id").alias("doc_id")), "nodes")
    linked = settle(wide_links(node, near_wide, near_size), "links")
    root = components(linked)
    degree = linked.groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("links"))
    to = node.alias("n").join(root.alias("r"), F.expr("n.doc_id = r.node"), "left").join(degree.alias("d"), F.expr("n.doc_id = d.linked"), "left")
    to = to.select(F.col("n.doc_id").alias("node"), F.coalesce("r.root", "n.doc_id").alias("root"), F.coalesce("d.links", F.lit(0)).alias("links"), *(f"n.{w}" for w in words))
    member = every.alias("e").join(to.alias("t"), F.expr(" AND ".join(f"e.{w} = t.{w}" for w in words))).where("e.doc_id <> t.root")
    bits = " + ".join(_bits(k, "m", "h") for k in range(WORDS))
    head = node.alias("h")
    met = member.select("e.doc_id", "t.root", "t.links", *(f"e.{w}" for w in words)).distinct().alias("m").join(head, F.expr("m.root = h.doc_id"), "left")
    found = met.groupBy("m.doc_id").agg(F.min("m.root").alias("duplicate_of"), F.min(F.expr(bits)).alias("bits"), F.max("m.links").alias("links"))
    return kept(found, "duplicates", every, node, linked, root)


def keep_first(docs: DataFrame, **parameters: float) -> DataFrame:
    """The documents without those that near_duplicates() finds, one row for each doc_id, with docs' columns.

    A document without words has no copies and stays. Of rows that repeat a doc_id the one with the least text stays;
    rows without a doc_id stay.
    """
    gone_id, turn = spare(docs, "gone", "turn")
    gone = near_duplicates(docs, **parameters).select(F.col("doc_id").alias(gone_id))
    rest = docs.join(gone, docs["doc_id"] == gone[gone_id], "left_anti")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = rest.where(docs["doc_id"].isNotNull()).withColumn(turn, order).where(F.col(turn) == 1).drop(turn)
    return one.unionByName(docs.where("doc_id IS NULL"))


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
