"""Best documents of one query, and the results of many."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from postlane.operators.index import SearchIndex


def top(scores: DataFrame, n: int, only_matches: bool = False) -> DataFrame:
    """The n best of (doc_id, score), ties by doc_id: each task keeps n, and n of those are merged."""
    rows = scores.where("score > 0") if only_matches else scores
    return rows.orderBy(F.desc("score"), "doc_id").limit(n)


@dataclass
class Results:
    """The best documents of many queries, with columns of another table beside them."""

    n: int
    metadata: DataFrame | None = None
    columns: Sequence[str] = ()
    parts: list[DataFrame] = field(default_factory=list)

    def insert(self, scores: DataFrame, query: str, extra: Mapping[str, str] | None = None) -> None:
        """Add the best documents of a query."""
        more = [F.lit(v).alias(k) for k, v in (extra or {}).items()]
        self.parts.append(top(scores, self.n).select(F.lit(query).alias("query"), "doc_id", "score", *more))

    def search(self, index: SearchIndex, token: str | Sequence[str], query: str, extra: Mapping[str, str] | None = None, **how: object) -> None:
        """Add the best documents of a term or phrase: only its matches are scored, see SearchIndex.top()."""
        self.insert(index.top(token, self.n, **how), query, extra)

    def all(self) -> DataFrame:
        """(query, rank, doc_id, score, ...), by query, then score from the highest, ties by doc_id."""
        if not self.parts:
            raise ValueError("no results were inserted")
        rows = reduce(DataFrame.unionByName, self.parts)
        if self.metadata is not None:
            few = rows.select("doc_id").distinct()  # n for each query: the table is filtered by them before anything moves
            beside = self.metadata.select("doc_id", *self.columns).join(F.broadcast(few) if self.n * len(self.parts) <= 1 << 16 else few, "doc_id", "left_semi")
            rows = rows.join(beside, "doc_id", "left")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
        return rows.select("query", rank.alias("rank"), *(c for c in rows.columns if c != "query")).orderBy("query", "rank")
