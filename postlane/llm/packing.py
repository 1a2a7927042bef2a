"""Best-fit packing of documents into bins of fixed size, by a grouping genetic algorithm on islands."""

from __future__ import annotations

import math
import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlane.llm.common import blocks, drop_table, kept, numbers, settle, texts_of
from postlane.llm.words import spans

#: Words in a bin, pieces that are packed together, islands for each such shard, solutions on an island, epochs between
#: which elites migrate, children in an epoch, the seed.
CAPACITY, SHARD, ISLANDS, POPULATION, EPOCHS, CHILDREN, SEED = 2048, 512, 4, 6, 3, 24, 23


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.zeros(b.num_rows, np.int64)
        for first, last, raw, offsets in blocks(b.column(1)):
            n[first:last] = np.bincount(spans(raw, offsets)[2], minlength=last - first)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "words"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, words): words between white space of each row's text; a null has none."""
    return texts_of(docs).mapInArrow(_count, "doc_id bigint, words bigint")


Bins = list[list[int]]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Bins, loads: list[int]) -> None:
    """Put each item, in the order given, into the bin that it leaves least room in, or a new one."""
    room = sorted((capacity - x, k) for k, x in enumerate(loads))
    for i in items:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
            loads.append(0)
        loads[k] += sizes[i]
        insort(room, (left - sizes[i], k))


def fitness(loads: list[int], capacity: int) -> float:
    """The mean of the squared fill: fewer and fuller bins are better, and filling one at another's cost pays."""
    return sum((x / capacity) ** 2 for x in loads) / len(loads) if loads else 1.0


class _Solution:
    __slots__ = ("bins", "loads", "fit")

    def __init__(self, bins: Bins, loads: list[int], capacity: int) -> None:
        self.bins, self.loads, self.fit = bins, loads, fitness(loads, capacity)

    @classmethod
    def of(cls, where: np.ndarray, sizes: list[int], capacity: int) -> _Solution:
        bins: Bins = [[] for _ in range(int(where.max()) + 1 if len(where) else 0)]
        for i, k in enumerate(where.tolist()):
            bins[k].append(i)
        return cls(bins, [sum(sizes[i] for i in b) for b in bins], capacity)

    def where(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for k, b in enumerate(self.bins):
            out[b] = k
        return out


def crossover(a: _Solution, b: _Solution, sizes: list[int], capacity: int, r: random.Random) -> _Solution:
    """Whole well-filled bins of b go into a; a's bins that hold any of their items go, and what they held besides is best-fitted, largest first."""
    order = sorted(range(len(b.bins)), key=lambda k: (-b.loads[k], k))
    take = [k for k in order[: max(1, len(order) // 2)] if r.random() < 0.4] or order[:1]
    injected = {i for k in take for i in b.bins[k]}
    bins, loads, displaced = [list(b.bins[k]) for k in take], [b.loads[k] for k in take], []
    for k, held in enumerate(a.bins):
        if injected.isdisjoint(held):
            bins.append(list(held))
            loads.append(a.loads[k])
        else:
            displaced += [i for i in held if i not in injected]
    displaced.sort(key=lambda i: (-sizes[i], i))
    best_fit(displaced, sizes, capacity, bins, loads)
    return _Solution(bins, loads, capacity)


def mutate(a: _Solution, sizes: list[int], capacity: int, r: random.Random) -> _Solution:
    """The emptiest bins and a few others are dissolved and their items best-fitted, largest first."""
    order = sorted(range(len(a.bins)), key=lambda k: (a.loads[k], k))
    gone = set(order[:2]) | {k for k in order if r.random() < 0.05}
    bins = [list(a.bins[k]) for k in range(len(a.bins)) if k not in gone]
    loads = [a.loads[k] for k in range(len(a.bins)) if k not in gone]
    free = sorted((i for k in gone for i in a.bins[k]), key=lambda i: (-sizes[i], i))
    best_fit(free, sizes, capacity, bins, loads)
    return _Solution(bins, loads, capacity)


def evolve(sizes: list[int], start: list[np.ndarray], capacity: int, r: random.Random, population: int, children: int) -> list[_Solution]:
    """An island's solutions after an epoch, best first; the best is never lost. It stops where no fewer bins can do."""
    n = len(sizes)
    found = [_Solution.of(w, sizes, capacity) for w in start]
    if not found:
        bins, loads = [], []
        best_fit(sorted(range(n), key=lambda i: (-sizes[i], i)), sizes, capacity, bins, loads)
        found = [_Solution(bins, loads, capacity)]
    least = math.ceil(sum(sizes) / capacity)
    if len(found[0].bins) <= least:
        return found[:1]
    while len(found) < population:
        bins, loads = [], []
        noisy = sorted(range(n), key=lambda i: -sizes[i] * (0.75 + 0.5 * r.random()))
        best_fit(noisy, sizes, capacity, bins, loads)
        found.append(_Solution(bins, loads, capacity))
    rank = lambda s: (len(s.bins), -s.fit)
    found.sort(key=rank)
    for _ in range(children):
        a, b = sorted(r.sample(range(len(found)), 2)) if len(found) > 1 else (0, 0)
        child = crossover(found[a], found[b], sizes, capacity, r)
        if r.random() < 0.5:
            child = mutate(child, sizes, capacity, r)
        if rank(child) < rank(found[-1]) and all(rank(child) != rank(s) for s in found):
            found[-1] = child
            found.sort(key=rank)
        if len(found[0].bins) <= least:
            break
    return found


_STATE = "shard bigint, island int, sizes array<int>, population array<binary>, elite binary, n_bins int, fit double"


def _epoch(capacity: int, population: int, children: int, seed: int, epoch: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                sizes = [int(x) for x in row.sizes]
                start = [np.frombuffer(x, np.int32) for x in row.population]
                if row.migrant is not None:
                    start = [*start[: max(1, population - 1)], np.frombuffer(row.migrant, np.int32)]
                    start.sort(key=lambda w: int(w.max()) + 1 if len(w) else 0)
                r = random.Random(f"{seed} {epoch} {row.shard} {row.island}")
                found = evolve(sizes, start, capacity, r, population, children)
                packed = [s.where(len(sizes)).tobytes() for s in found]
                out.append((row.shard, row.island, row.sizes, packed, packed[0], len(found[0].bins), found[0].fit))
            yield pd.DataFrame(out, columns=["shard", "island", "sizes", "population", "elite", "n_bins", "fit"])

    return run


def _assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"shard": pdf["shard"], "bins": [np.frombuffer(x, np.int32).tolist() for x in pdf["elite"]]})


def pack(counts: DataFrame, capacity: int = CAPACITY, *, shard: int = SHARD, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, children: int = CHILDREN, seed: int = SEED) -> DataFrame:
    """(bin_id, doc_id, turn, piece, begin, words): where each piece of each document of counts (doc_id, words) goes.

    A document of more than `capacity` words is cut into full pieces and a rest; begin is a piece's first word.
    Pieces are spread by hash over shards of about `shard` of them. Each shard evolves on `islands`, of which each is
    a row that a task works on; after each epoch the elite of an island moves to the next of its shard, and the best
    of all islands is the result: never more bins than best-fit decreasing, with which they start. A full piece has a
    bin of its own. turn tells rows that repeat (doc_id, words) apart, from 1. Texts without words are in no bin; a
    null doc_id is packed as such; null or negative words count as none. Nothing to pack, no rows. Seeds depend on the shard and
    island alone, so a task that runs again gives the same.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = counts.sparkSession
    one = counts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("words").cast("bigint").alias("words")).where("words > 0")
    part, rest = numbers(F.col("count"), "turn")
    rows = rest(one.groupBy("doc_id", "words").count().withColumn("turn", F.explode(part))).select("doc_id", "words", F.col("turn").cast("int").alias("turn"))
    begin = F.explode(F.expr(f"sequence(0L, words - 1, {capacity}L)"))
    pieces = rows.withColumn("begin", begin).withColumn("piece", (F.col("begin") / capacity).cast("int")).withColumn("size", F.least(F.lit(capacity).cast("bigint"), F.col("words") - F.col("begin")).cast("int"))
    pieces = settle(pieces, "pieces")
    n = pieces.where(F.col("size") < capacity).count()
    shards = max(1, math.ceil(n / shard))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(shards * islands / 2000))
    fields = ["size", "doc_id", "words", "turn", "piece", "begin"]
    key = F.pmod(F.xxhash64("doc_id", "words", "turn", "piece", F.lit(seed)), F.lit(shards)).alias("shard")
    grouped = settle(pieces.where(F.col("size") < capacity).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("items")), "shards")
    state = grouped.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.size").alias("sizes"), F.array().cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("migrant"))
    before = None
    for epoch in range(epochs):
        state = settle(state.repartition(tasks, "shard", "island").mapInPandas(_epoch(capacity, population, children, seed, epoch), _STATE), "islands")
        if before is not None:
            drop_table(before)
        before = state
        if epoch + 1 < epochs:
            w = Window.partitionBy("shard").orderBy("island")
            ring = F.coalesce(F.lag("elite").over(w), F.last("elite").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            state = state.select("shard", "island", "sizes", "population", (ring if islands > 1 else F.lit(None).cast("binary")).alias("migrant"))
    best = state.groupBy("shard").agg(F.max_by("elite", F.struct(-F.col("n_bins"), F.col("fit"), -F.col("island"))).alias("elite"))
    bins = best.mapInPandas(_assign, "shard bigint, bins array<int>")
    both = grouped.join(bins, "shard").select("shard", F.explode(F.arrays_zip("items", "bins")).alias("z"))
    inside = both.select((F.col("shard") * (1 << 24) + F.col("z.bins")).alias("bin_id"), *(F.col(f"z.items.{x}").alias(x) for x in ("doc_id", "turn", "piece", "begin")), F.col("z.items.size").alias("words"))
    full = pieces.where(F.col("size") == capacity)
    alone = full.select((-1 - F.monotonically_increasing_id()).alias("bin_id"), "doc_id", "turn", "piece", "begin", F.col("size").alias("words"))
    return kept(inside.unionByName(alone), "packed", pieces, grouped, *([] if before is None else [before]))


def op6_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
