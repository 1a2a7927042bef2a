"""Passages that repeat across documents, through a logarithmic family of suffix arrays."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlane.llm.common import blocks, file_system, mix, settle, texts_of
from postlane.llm.words import NOT_SPACE, Hasher, grams, lower, sliding_min, spans

#: Words that a passage has at least, and words of the k-mer that decides which shard a suffix goes to.
MIN_WORDS, ANCHOR = 50, 8
#: Suffixes of a batch: what is sorted at once, and the size of the least level. Suffixes whose words are laid out at once.
BATCH, CHUNK = 1 << 18, 1 << 16

_NONE = np.iinfo(np.int64).min
_ARRAYS = ("pool", "at", "doc", "place", "second", "head")
_RECORD = "anchor bigint, doc_id bigint, start int, n int, words binary"


def _starts(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where runs begin, how long they are) of marks of their first places."""
    start = np.flatnonzero(head)
    return start, np.diff(np.r_[start, len(head)])


class Level:
    """A suffix array: places of words in `pool` in the order of the first `width` words from there, with document, place and a second document that has them.

    Words are 32-bit codes, the more significant byte first, so that their order is that of their bytes. head marks
    the first of the suffixes that agree in all `width` words. Of suffixes that two documents have, the first alone is
    held, which is the least document's; `second` is the next document, or none.
    """

    def __init__(self, width: int, pool: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, second: np.ndarray, head: np.ndarray) -> None:
        self.width, self.pool, self.at, self.doc, self.place, self.second, self.head = width, pool, at, doc, place, second, head
        self.file: str | None = None  # where it is saved as it is

    @classmethod
    def of(cls, width: int, pool: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, second: np.ndarray, head: np.ndarray) -> Level:
        """A level of sorted suffixes, less those that aren't held and the words that none held needs."""
        start, size = _starts(head)
        keep = np.ones(len(at), bool)
        if len(start):
            # a later document of a run: the first row whose document isn't the first one's
            first = np.repeat(doc[start], size)
            other = np.flatnonzero(doc != first)
            run = np.repeat(np.arange(len(start)), size)
            late, by = np.unique(run[other], return_index=True)
            lacks = second[start[late]] == _NONE
            second = second.copy()
            second[start[late[lacks]]] = doc[other[by[lacks]]]
            keep = np.repeat(second[start] == _NONE, size)
            keep[start] = True
        at = at[keep]
        used = np.cumsum(np.bincount(at, minlength=len(pool) + 1) - np.bincount(at + width, minlength=len(pool) + 1))[:-1] > 0
        return cls(width, pool[used], (np.cumsum(used) - 1)[at], doc[keep], place[keep], second[keep], head[keep])

    def save(self, path: str) -> None:
        """Write the level; a file gets its name once it is whole, so a task that runs again leaves the same."""
        system, inner = file_system(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        held = io.BytesIO()
        np.savez(held, **{k: getattr(self, k) for k in _ARRAYS})
        part = f"{inner}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(held.getbuffer())
        system.move(part, inner)
        self.file = path

    @classmethod
    def load(cls, path: str, width: int) -> Level:
        system, inner = file_system(path)
        with system.open_input_file(inner) as f, np.load(io.BytesIO(f.read())) as z:
            level = cls(width, *(z[k] for k in _ARRAYS))
        level.file = path
        return level

    def __len__(self) -> int:
        return len(self.at)

    def keys(self, rows: slice | np.ndarray) -> np.ndarray:
        return laid_out(self.pool, self.at[rows], self.width)

    def find(self, keys: np.ndarray, begin: int = 0, after: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Scan from row `begin` for sorted keys: (rows before which each belongs, or after equal ones, and whether one is equal)."""
        at, same = np.full(len(keys), len(self)), np.zeros(len(keys), bool)
        done, before = 0, None
        for first in range(begin, len(self), CHUNK):
            if done == len(keys):
                break
            chunk = self.keys(slice(first, first + CHUNK))
            last = int(np.searchsorted(keys, chunk[-1], "left" if after else "right"))
            if first + CHUNK >= len(self):
                last = len(keys)
            mine = keys[done:last]
            row = np.searchsorted(chunk, mine, "right" if after else "left")
            at[done:last] = first + row
            if after:
                same[done:last] = np.where(row > 0, equal(chunk, np.maximum(row - 1, 0), mine), False if before is None else before == mine)
            else:
                same[done:last] = (row < len(chunk)) & equal(chunk, np.minimum(row, len(chunk) - 1), mine)
            done, before = last, chunk[-1]
        return at, same

    def merge(self, other: Level) -> Level:
        """One level of both, by a scan of both; equal suffixes of this one come first."""
        into, same, begin = [], [], 0
        for first in range(0, len(other), CHUNK):
            at, eq = self.find(other.keys(slice(first, first + CHUNK)), max(begin - 1, 0), after=True)
            into.append(at)
            same.append(eq)
            begin = int(at[-1])
        to = np.concatenate([*into, np.zeros(0, np.int64)]) + np.arange(len(other))
        own = np.ones(len(self) + len(other), bool)
        own[to] = False

        def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.empty(len(own), x.dtype)
            out[own], out[to] = x, y
            return out

        head = both(self.head, other.head & ~np.concatenate([*same, np.zeros(0, bool)]))
        return Level.of(self.width, joined([self.pool, other.pool]), both(self.at, other.at + len(self.pool)), both(self.doc, other.doc), both(self.place, other.place), both(self.second, other.second), head)


def joined(pools: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(pools).astype(">u4", copy=False)  # numpy turns bytes round as it joins


def laid_out(pool: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The bytes of `width` words from each place of the pool."""
    if not len(at):
        return np.zeros(0, f"S{4 * width}")
    return np.ndarray((len(pool) - width + 1,), f"S{4 * width}", buffer=np.ascontiguousarray(pool), strides=(4,))[at]


def equal(keys: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """keys[at] == other; the last word is compared first, and all of them only where that is the same."""
    last = lambda x: x.view(">u4").reshape(len(x), x.dtype.itemsize // 4)[:, -1]
    out = last(keys)[at] == last(other)
    some = np.flatnonzero(out)
    out[some] = keys[at[some]] == other[some]
    return out


def group_of(keys: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit number of each suffix's words."""
    words = keys.view(">u4").reshape(-1, width)
    out = np.zeros(len(keys), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0xD6E8FEB86659FD93) + words[:, k].astype(np.uint64) + np.uint64(1)
    return mix(out)


class SuffixFamily:
    """Suffix arrays of geometrically growing size.

    add() sorts a batch's suffixes, scans each level for those that agree in `width` words, stacks the batch as a new
    level and merges levels while the last is no smaller than the one before: n batches cost n log n. Documents must
    come in order, so that a suffix's least documents are known from the first batches that have it.
    """

    def __init__(self, width: int, levels: list[Level] | None = None) -> None:
        self.width, self.levels = width, levels or []

    def add(self, pool: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, place, least other document, number of the words) of the suffixes of this batch, and of earlier ones first matched by it, that another document has too."""
        order = np.lexsort((place, doc))
        at, doc, place = at[order], doc[order], place[order]
        keys = laid_out(pool, at, self.width)
        order = np.argsort(keys, kind="stable")
        keys, at, doc, place = keys[order], at[order], doc[order], place[order]
        partner = np.full(len(keys), _NONE)
        late: list[tuple[np.ndarray, ...]] = []
        for level in self.levels:
            to, same = level.find(keys)
            hit = np.flatnonzero(same)
            to = to[hit]
            other = np.where(level.doc[to] != doc[hit], level.doc[to], level.second[to])
            partner[hit] = np.where(partner[hit] == _NONE, other, partner[hit])
            fresh = np.flatnonzero((level.second[to] == _NONE) & (level.doc[to] != doc[hit]))
            once, back = np.unique(to[fresh], return_index=True)
            start, size = _starts(level.head)
            size = size[np.searchsorted(start, once)] if len(once) else once
            rows = np.repeat(once, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            if len(rows):
                level.file = None
            level.second[rows] = np.repeat(doc[hit[fresh[back]]], size)
            late.append((level.doc[rows], level.place[rows], level.second[rows], group_of(level.keys(rows), self.width)))
        head = np.r_[True, ~equal(keys, np.arange(len(keys) - 1), keys[1:])] if len(keys) else np.zeros(0, bool)
        start, size = _starts(head)
        first = np.repeat(doc[start], size)
        run = np.repeat(np.arange(len(start)), size)
        others = np.flatnonzero(doc != first)
        some, by = np.unique(run[others], return_index=True)
        next_ = np.full(len(start), _NONE)
        next_[some] = doc[others[by]]
        lone = partner == _NONE
        partner[lone] = np.where(doc[lone] == first[lone], next_[run[lone]], first[lone])
        self.levels.append(Level.of(self.width, pool, at, doc, place, partner, head))
        while len(self.levels) > 1 and len(self.levels[-1]) >= len(self.levels[-2]):
            newer = self.levels.pop()
            self.levels.append(self.levels.pop().merge(newer))
        found = np.flatnonzero(partner != _NONE)
        out = [(doc[found], place[found], partner[found], group_of(keys[found], self.width)), *late]
        return tuple(np.concatenate(x) for x in zip(*out))


def suffix_records(text: pa.Array, min_words: int, anchor: int, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (row, anchor hash, first place, suffixes, words of each record, concatenated).

    The suffixes whose first min_words words have the same least k-mer at the same place lie in a row and make one
    record, with the words that they need: wherever those words occur again, they have the same anchor, so its hash
    serves as the shard. A word is 32 bits of its hash.
    """
    for first, _, raw, offsets in blocks(text):
        low = lower(raw)
        starts, ends, of = spans(low, offsets, NOT_SPACE)
        if len(starts) < min_words:
            continue
        h = hasher(low, starts, ends)
        place = np.arange(len(of)) - np.searchsorted(of, of)
        inner = grams(h, anchor)
        bits = np.uint64(max(1, int(len(inner)).bit_length()))
        at = sliding_min((inner >> bits << bits) | np.arange(len(inner), dtype=np.uint64), min_words - anchor + 1)
        m = len(at)
        ok = np.flatnonzero(of[:m] == of[min_words - 1 : min_words - 1 + m])
        if not len(ok):
            continue
        at = (at[ok] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (ok[1:] != ok[:-1] + 1)])
        n = np.diff(np.r_[cut, len(ok)])
        size = n + min_words - 1
        words = (h >> np.uint64(32)).astype(">u4")[np.repeat(ok[cut], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        yield first + of[ok[cut]], inner[at[cut]], place[ok[cut]], n, words


def _records(min_words: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for row, key, place, n, words in suffix_records(b.column(1), min_words, anchor, hasher):
                end = np.cumsum((n + min_words - 1) * 4)
                for a in range(0, len(n), 10000):
                    part = slice(a, a + 10000)
                    at = np.r_[end[a - 1] if a else 0, end[part]]
                    blob = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(words[at[0] // 4 : at[-1] // 4])])
                    arrays = [pa.array(key[part].view(np.int64)), b.column(0).take(pa.array(row[part])), pa.array(place[part].astype(np.int32)), pa.array(n[part].astype(np.int32)), blob]
                    yield pa.RecordBatch.from_arrays(arrays, ["anchor", "doc_id", "start", "n", "words"])

    return run


def _runs(doc: np.ndarray, place: np.ndarray, partner: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """Neighbouring suffixes of a document as one row each: first and last place, the least of the documents met, the numbers of the suffixes' words."""
    order = np.lexsort((place, doc))
    doc, place, partner, key = doc[order], place[order], partner[order], key[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)][: len(doc)])
    last = np.r_[cut[1:], len(doc)][: len(cut)] - 1
    groups = pa.ListArray.from_arrays(pa.array(np.r_[cut, len(doc)].astype(np.int32)), pa.array(key.view(np.int64)))
    arrays = [pa.array(doc[cut]), pa.array(place[cut].astype(np.int32)), pa.array(place[last].astype(np.int32)), pa.array(np.minimum.reduceat(partner, cut) if len(cut) else partner), groups]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "first", "last", "partner", "groups"])


class _Batches:
    """Records gathered into batches, which go into the family; add() and flush() give rows of runs."""

    def __init__(self, family: SuffixFamily) -> None:
        self.family, self.held, self.count = family, [], 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            shift = np.cumsum([0, *(len(x[0]) for x in self.held)])
            at = np.concatenate([x[1] + k for x, k in zip(self.held, shift)])
            pool = joined([x[0] for x in self.held])
            doc, place = (np.concatenate([x[k] for x in self.held]) for k in (2, 3))
            self.held, self.count = [], 0
            yield _runs(*self.family.add(pool, at, doc, place))

    def add(self, doc: np.ndarray, start: np.ndarray, n: np.ndarray, blob: pa.Array) -> Iterator[pa.RecordBatch]:
        ends = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
        for part in range(0, len(n), 4096):
            m = n[part : part + 4096].astype(np.int64)
            a = ends[part : part + len(m) + 1]
            pool = np.frombuffer(blob.buffers()[2], ">u4", (a[-1] - a[0]) // 4, a[0])
            row = np.repeat(np.arange(len(m)), m)
            step = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
            self.held.append((pool, (a[row] - a[0]) // 4 + step, doc[part : part + len(m)][row], start[part : part + len(m)][row].astype(np.int64) + step))
            self.count += len(row)
            if self.count >= BATCH:
                yield from self.flush()


def _scan(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Batches(SuffixFamily(min_words))
        for b in batches:
            yield from held.add(*(b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 4)), b.column(4))
        yield from held.flush()

    return run


_RUN = "doc_id bigint, first int, last int, partner bigint, groups array<bigint>"


def _stretches(found: DataFrame, min_words: int) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("first") > before + min_words, 1).when(before.isNull(), 1).otherwise(0)
    marked = found.withColumn("new", new).withColumn("stretch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = (F.max("last") - F.min("first") + min_words).cast("int")
    return marked.groupBy("doc_id", "stretch").agg(F.min("first").alias("start_word"), size.alias("n_words"), F.min("partner").alias("partner"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("groups")).drop("stretch")


def _records_of(docs: DataFrame, min_words: int, anchor: int) -> DataFrame:
    if not 0 < anchor <= min_words:
        raise ValueError("0 < anchor <= min_words is needed")
    return texts_of(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_records(min_words, anchor), _RECORD)


def shared_passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, start_word, n_words, partner, groups): the stretches of each document whose every word lies in min_words words that another document has too.

    partner is the least other document that has min_words words of the stretch. groups has the number of every
    min_words words in the stretch that another document has, in order and each once: the documents that share words
    with a stretch are exactly those with a stretch that has one of its groups. Words lie between white space and are
    compared in lower case, as 32 bits of a hash each: stretches count as equal where all min_words of these are.
    Repeats inside one document alone don't count. Rows that repeat a doc_id are one document. Rows without a doc_id
    and texts that are null, empty or shorter than min_words have no passages. Texts are used whole; no documents, no
    rows. Every suffix is a query and every suffix is indexed: nothing is sampled.

    One shuffle, by anchor, of about 13 bytes a word; a shard streams through its family in batches and holds each
    distinct suffix once, so a passage that a million documents share takes the room of one.
    """
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records = _records_of(docs, min_words, anchor)
    found = records.repartition(shards, "anchor").sortWithinPartitions("doc_id", "start").mapInArrow(_scan(min_words), _RUN)
    return _stretches(found, min_words)


def _extend(min_words: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        names = ["shard", "level", "file", "doc_id", "first", "last", "partner", "groups"]

        def runs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in found:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(b.num_rows, k) for k in kinds[:3]), *b.columns], names)

        def close() -> Iterator[pa.RecordBatch]:
            if held is not None:
                yield from runs(held.flush())
                for k, level in enumerate(held.family.levels):
                    if level.file is None:
                        level.save(f"{folder}/{shard}-{k}.npz")
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip((shard, k, level.file), kinds)), *(pa.nulls(1, t) for t in kinds[3:])], names)

        for b in batches:
            of = b.column(0).to_numpy()
            cut = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)]
            for a, z in zip(cut[:-1], cut[1:]):
                part = b.slice(a, z - a)
                if shard != of[a]:
                    yield from close()
                    shard, held = int(of[a]), _Batches(SuffixFamily(min_words))
                files = part.column(2).drop_null().to_pylist()
                held.family.levels += [Level.load(f, min_words) for f in files]
                rows = part.slice(len(files))
                if rows.num_rows:
                    yield from runs(held.add(*(rows.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5)), rows.column(6)))
        yield from close()

    return run


def extend(docs: DataFrame, folder: str, family: DataFrame | None = None, shards: int | None = None, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(passages, family): a batch of documents matched with each other and with those of the batches that family is of.

    family is a table (shards, shard, level, file) of the levels of every shard; None begins one, of `shards` shards.
    The levels are files in folder, which executors share: a task reads those of its shard, so that nothing of them
    is shuffled, and writes the ones that the batch made, merged or marked; what family names stays as it was, so a
    batch that fails can be run again from it. passages are as shared_passages() gives them for the documents of the
    batch, and for the stretches of earlier ones that no document had before. Where a passage comes from an earlier
    batch, partner is its first document there. A doc_id that an earlier batch had is the same document. An empty
    batch changes nothing.
    """
    spark = docs.sparkSession
    if family is not None:
        shards = (family.agg(F.max("shards")).first()[0]) or shards
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = _records_of(docs, min_words, anchor).select(F.pmod("anchor", F.lit(shards)).cast("int").alias("shard"), F.lit(-1).alias("level"), F.lit(None).cast("string").alias("file"), "doc_id", "start", "n", "words")
    rows = records
    if family is not None:
        rows = rows.unionByName(family.select("shard", "level", "file"), allowMissingColumns=True)
    ordered = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.col("file").isNull(), "level", "doc_id", "start")
    schema = f"shard int, level int, file string, {_RUN}"
    both = settle(ordered.mapInArrow(_extend(min_words, f"{folder}/levels-{uuid.uuid4().hex}"), schema), "family")
    passages = _stretches(both.where("doc_id IS NOT NULL").select("doc_id", "first", "last", "partner", "groups"), min_words)
    return passages, both.where("file IS NOT NULL").select(F.lit(shards).alias("shards"), "shard", "level", "file")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """shared_passages() without the groups: every stretch, with the least partner of those it may have."""
    return shared_passages(docs, min_words, anchor).drop("groups")


def op2_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
