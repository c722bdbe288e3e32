"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query first runs on the
smallest tables beside them, to warm up, then once for the clock; every row and
column is produced and thrown away. Fitting and other eager steps are part of the time.
"""

from __future__ import annotations

import json
import os
import time

from penprint.catalog import QUERIES
from penprint.session import local_session

HEADLINE = (
    "clean_text", "writers_by_language", "mask_handles", "min_documents", "balanced_month_sample", "random_split", "author_disjoint_split",
    "author_attribution_split", "merge_by_author", "docs_per_author_month", "label_distribution", "describe_numeric", "categorical_profile",
    "vote_by_author", "classification_report", "ensemble_weighted", "vote_probabilities", "word_tfidf", "fit_vocabulary", "to_sequences",
    "anova_scores", "mutual_information", "robust_scaling",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "penprint-bench")
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    small = small if os.path.isdir(small) else folder
    seconds = {}
    for name in HEADLINE:
        for tables in (small, folder):
            begin = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "headline queries, warm, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
