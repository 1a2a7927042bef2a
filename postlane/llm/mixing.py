"""Mixing sources to target weights: copies of each document by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlane.llm.common import drop_table, kept, numbers, settle, spare, uniform

#: Documents of a leaf, residuals that an inner node combines, the exponent that flattens the sources' shares, the seed.
LEAF, FAN_IN, POWER, SEED = 20_000, 16, 0.7, 17
#: Sources that are broadcast at most.
FEW = 50_000
#: A probability this near to 0 or 1 is 0 or 1.
_EPS = 1e-9


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, total: float | None = None) -> DataFrame:
    """(source, rate): the expected copies of each document of a source, as a table in the shared folder.

    A source's share of the characters after mixing is its target weight. Without weights they are its share before
    to the power `power`, which raises small sources. Without a total (in characters) it is the least that keeps every
    document at least once. Sources without a weight get 0; a null source is a source; sources of empty texts only
    have rate 1. Weights are summed as decimals, so the rates are the same whatever the order; no source goes to the
    driver.
    """
    size = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("bigint")
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weighted = sizes.withColumn("want", F.pow(F.col("size").cast("double"), F.lit(float(power))))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        given = docs.sparkSession.createDataFrame([(k, float(w)) for k, w in weights.items()], "name string, want double")
        weighted = sizes.join(given, F.expr("source <=> name"), "left").select("source", "size", F.coalesce("want", F.lit(0.0)).alias("want"))
    weighted = weighted.withColumn("want", F.when(F.col("size") > 0, F.round("want", 9).cast("decimal(38,9)")).otherwise(F.lit(0)))
    most = F.max(F.when(F.col("want") > 0, F.col("size") / F.col("want").cast("double")))
    whole = F.sum("want").cast("double")
    scale = (F.coalesce(most, F.lit(0.0)) if total is None else F.when(whole > 0, F.lit(float(total)) / whole).otherwise(F.lit(0.0))).alias("scale")
    rate = F.when(F.col("size") > 0, F.round(F.col("want").cast("double") * F.col("scale") / F.col("size"), 9)).otherwise(F.lit(1.0))
    return settle(weighted.crossJoin(F.broadcast(weighted.agg(scale))).select("source", rate.alias("rate")), "rates")  # scale: one row


def pivotal(p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int, float]:
    """(0, 1 or -1 for each unit, the unit left over, its probability): one pass in the units' order.

    Two fractional units meet; mass passes from one to the other, to either side with the odds that keep each one's
    expectation, until one of them is 0 or 1; the other meets the next. At most one stays fractional, marked -1.
    """
    out = np.where(p >= 1 - _EPS, 1, 0).astype(np.int8)
    held, a = -1, 0.0
    for k in np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist():
        b = float(p[k])
        if held < 0:
            held, a = k, b
            continue
        s = a + b
        if s < 1:
            if draws[k] * s < b:
                out[held], held = 0, k
            else:
                out[k] = 0
            a = s
        else:
            if draws[k] * (2 - s) < 1 - b:
                out[held] = 1
                held = k
            else:
                out[k] = 1
            a = s - 1
        if a <= _EPS or a >= 1 - _EPS:
            out[held], held = (1 if a > 0.5 else 0), -1
    if held >= 0:
        out[held] = -1
    return out, held, a


def _pass(seed: int, level: int):
    """Each node's units, which lie in a row in order, rounded but for one. A node is a leaf's documents, or fan_in residuals."""

    def rounded(table: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
        doc = pc.fill_null(table.column("doc_id"), 0).to_numpy()
        draws, p = uniform(seed, level, doc, table.column("turn").to_numpy()), table.column("p").to_numpy().copy()
        up, done, first = np.zeros(len(p), np.int32), np.ones(len(p), bool), 0
        for last in ends:
            out, held, a = pivotal(p[first:last], draws[first:last])
            up[first:last] = np.maximum(out, 0)
            if held >= 0:
                done[first + held], p[first + held] = False, a
            first = last
        for b in table.slice(0, first).combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p[:first]), pa.array(up[:first]), pa.array(done[:first])], [*b.schema.names[:5], "p", "up", "done"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            node = list(zip(table.column("node").to_pylist(), table.column("leaf").to_pylist()))
            ends = [k for k in range(1, len(node)) if node[k] != node[k - 1]]  # the last node may go on in the next batch
            if ends:
                yield from rounded(table, ends)
                table = table.slice(ends[-1])
            held = table
        if held is not None and held.num_rows:
            yield from rounded(held, [held.num_rows])

    return run


_STATE = "source string, doc_id bigint, turn int, node string, leaf bigint, p double, up int, done boolean"
_UNIT = ["source", "doc_id", "turn", "node", "leaf", "p"]


def copies(docs: DataFrame, rates: DataFrame, seed: int = SEED, leaf: int = LEAF, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, source, turn, copies), a row for each of docs; turn tells rows that repeat a doc_id apart, from 1.

    A document of rate r gets floor(r) or ceil(r) copies, r on average. Each source's copies sum to the floor or the
    ceiling of its expected number, and so do all together: leaves of a source, as many as it needs, round their
    documents but one, nodes round the left-over ones of fan_in children but one, up to one for each source, then
    sources' left-over ones are rounded in such a tree, and the last is drawn. Draws depend on seed, doc_id and turn
    alone, so a task that runs again, or another partitioning, gives the same copies. Only ids, sources and
    probabilities are shuffled. Sources that rates doesn't list get 0. A null source is one of its own; null doc_ids
    count as rows of one id; no documents, no rows.
    """
    units = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("bigint").alias("doc_id")).groupBy("source", "doc_id").count()
    few = rates.select(F.col("source").alias("name"), F.col("rate").alias("rate"))
    per = units.groupBy("source").agg(F.ceil(F.sum("count") / leaf).cast("bigint").alias("leaves"))
    sources = settle(per.join(few, F.expr("source <=> name"), "left").select(F.col("source").alias("name"), "leaves", F.coalesce("rate", F.lit(0.0)).alias("rate")), "sources")
    count, width = sources.agg(F.count("*"), F.coalesce(F.max("leaves"), F.lit(1))).first()
    rated = units.join(F.broadcast(sources) if count <= FEW else sources, F.expr("source <=> name"))
    part, rest = numbers(F.col("count"), "turn")
    rated = rest(rated.withColumn("turn", F.explode(part))).withColumn("turn", F.col("turn").cast("int"))
    whole = F.floor(F.col("rate") + _EPS)
    spread = F.pmod(F.xxhash64("doc_id", "turn", F.lit(seed)), "leaves").alias("leaf")
    start = settle(rated.select("source", "doc_id", "turn", spread, F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"), whole.cast("bigint").alias("floor")), "units")
    open_ = start.where(F.col("p") > _EPS).withColumn("node", F.col("source")).select(*_UNIT)
    done, passes, level, across = [], [], 0, False
    while True:
        nodes = open_.repartition("node", "leaf").sortWithinPartitions("node", "leaf", "source", "doc_id", "turn")
        state = settle(nodes.mapInArrow(_pass(seed, level), _STATE), "pivotal")
        passes.append(state)
        done.append(state.where("done"))
        open_ = state.where("NOT done").select(*_UNIT)
        level += 1
        if width > 1:
            width = math.ceil(width / fan_in)
            open_ = open_.withColumn("leaf", F.floor(F.col("leaf") / fan_in))
        elif not across:
            across, width = True, max(1, math.ceil(count / leaf))  # one for each source is left: now across sources
            open_ = open_.withColumns({"node": F.lit(None).cast("string"), "leaf": F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(width))})
        else:
            break
    last = open_.collect()  # one at most
    if last:
        up = int(uniform(seed, -1, last[0]["doc_id"] or 0, last[0]["turn"]) < last[0]["p"])
        done.append(open_.withColumns({"up": F.lit(up), "done": F.lit(True)}))
    rounded = reduce(DataFrame.unionByName, done).select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("turn").alias("t"), "up")
    both = start.join(rounded, F.expr("source <=> s AND doc_id <=> d AND turn = t"), "left")
    return kept(both.select("doc_id", "source", "turn", (F.col("floor") + F.coalesce("up", F.lit(0))).alias("copies")), "copies", sources, start, *passes)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, seed: int = SEED) -> DataFrame:
    """(doc_id, source, turn, copies) at the target weights; see source_rates() and copies()."""
    rates = source_rates(docs, weights, power)
    out = copies(docs, rates, seed)
    drop_table(rates)
    return out


def repeat(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """Each row of docs as many times as it has copies, with docs' columns. Texts are shuffled once.

    counted is what copies() gives: rows that repeat a doc_id and source have one rate, so their copies differ by one
    at most; those whose text comes last in order have the greater number.
    """
    names = docs.columns
    d, s, low, more, rows, turn, copy = spare(docs, "d", "s", "low", "more", "rows", "turn", "copy")
    key = lambda: [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias(d), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias(s)]
    per_id = counted.groupBy(*key()).agg(F.min("copies").alias(low), F.sum("copies").alias(more), F.count("*").alias(rows))
    both = docs.select("*", *key()).join(per_id, [d, s])
    place = F.row_number().over(Window.partitionBy(d, s).orderBy(F.col("text")))
    both = both.withColumn(turn, F.when(F.col(rows) > 1, place).otherwise(1))
    extra = F.when(F.col(turn) > F.col(rows) * (1 + F.col(low)) - F.col(more), 1).otherwise(0)
    both = both.withColumn(low, F.col(low) + extra).where(F.col(low) > 0)
    part, rest = numbers(F.col(low), copy)
    return rest(both.withColumn(copy, F.explode(part))).select(*names)


def op5_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
