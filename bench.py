"""Time the headline queries: python bench.py prints one line of JSON. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlane.operators.index import SearchIndex
from postlane.plans import corpora
from postlane.plans.queries import QUERIES

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "phrase_2", "phrase_3", "phrase_5", "phrase_same_term", "phrase_missing", "phrase_slop", "termfreqs_term", "positions", "docfreq", "and_query", "or_query_mm",
    "score_bm25_term", "score_bm25_phrase", "score_classic", "topk_bm25", "topk_multi_query", "slice_then_score",
    "edismax_term_centric", "edismax_field_centric", "edismax_pf", "edismax_full",
]


def timed(run: Callable[[], DataFrame | None]) -> float:
    began = time.time()
    df = run()
    if df is not None:
        df.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed(lambda: spark.range(1000).repartition(4).groupBy("id").count())
    seconds: dict[str, float] = {}
    path = f"{corpora.folder(spark)}/bench-index"
    seconds["index_build_and_save"] = timed(lambda: SearchIndex.build(corpora.documents(spark, SF_DIR)).save(path))
    seconds["index_build_and_save_again"] = timed(lambda: SearchIndex.build(corpora.documents(spark, SF_DIR)).save(path))
    for field in ("body", "title", "exact_title"):
        corpora.index(spark, SF_DIR, field)
    for name in HEADLINE:
        runs = [timed(lambda: QUERIES[name](spark, SF_DIR)) for _ in range(3)]  # noqa: B023
        seconds[name] = min(runs)
        print(name, runs, file=sys.stderr)
    queries = [v for k, v in seconds.items() if k in HEADLINE]
    print(json.dumps({"metric": "sum of the best of three runs of each search query", "value": round(sum(queries), 3), "unit": "sec", "queries": seconds, "sf": SF_DIR.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
