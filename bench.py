"""Times the headline queries in a warm session and prints one JSON line.

`BENCH_SF_DIR` names the tables, `BENCH_CPUS` the local cores, `BENCH_RUNS` the timed
runs per query. A query's time is the median of its runs and covers everything from
reading the files: building the index, searching it and computing every result row.
`stored_index_search` alone searches an index written beforehand; writing it is
timed as `index_save`.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES, index, text_queries  # noqa: E402
from lexivec.functions.prep import WORDS  # noqa: E402
from lexivec.operators.bm25 import search  # noqa: E402
from lexivec.session import local_session, new_folder  # noqa: E402
from lexivec.sources.index_store import load_index, save_index  # noqa: E402

HEADLINES = [
    "bm25_weights", "bm25_search", "vector_topk_batch", "rerank_two_stage", "compare_rankings", "full_ranking", "vector_topk_grid",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session(cpus, shuffle_partitions=8)
    times: dict[str, float] = {}

    def timed(name, job, repeats=runs):
        job()
        seconds = []
        for _ in range(repeats):
            start = time.perf_counter()
            job()
            seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds), 3)

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    for name in HEADLINES:
        timed(name, lambda name=name: run(QUERIES[name](spark, folder)))
    stored = new_folder(spark, "bench-index")
    timed("index_save", lambda: save_index(index(spark, folder), stored, mode="overwrite"), repeats=1)
    timed("stored_index_search", lambda: run(search(load_index(spark, stored, WORDS), text_queries(spark, folder))))
    sf = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum of median seconds per headline query, warm session",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
