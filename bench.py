"""Headline timings: prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotweave.operators.dom import with_dom
from lotweave.plans import generic, mapping, site
from lotweave.registry import QUERIES, corpus
from lotweave.session import checkpoint_dir, local_session
from lotweave.sources.rules import built_in_configs, rule_rows, rule_sets

HEADLINE = [
    "dom_nodes", "page_text", "select_descendant", "page_report", "map_fields", "map_goal", "preview_summary",
    "generic_extract", "site_extract", "response_clean", "overall_similarity", "suggest_rank",
    "vin_pages", "search_rank", "parse_pipeline", "pipeline_vin", "corpus_yield",
]


def timed(df: DataFrame) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    saved = f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    corpus.listing_pages(spark, sf_dir).write.mode("overwrite").parquet(f"{saved}/pages")
    pages = spark.read.parquet(f"{saved}/pages")
    n_pages = pages.count()

    # page work alone, from stored pages: the figures comparable to a per-page baseline
    rules = rule_sets(rule_rows(built_in_configs(spark)))
    ruled = mapping.with_rules(with_dom(pages).withColumn("site_id", F.expr(corpus.SITE_OF_PAGE)), rules)
    routes = {
        "dom": with_dom(pages), "mapping": mapping.map_fields(ruled),
        "generic": generic.parse_generic(with_dom(pages)), "site": site.parse_site(with_dom(pages)),
    }
    timed(routes["dom"])  # start the Python workers
    rates = {f"{name}_pages_per_sec": round(n_pages / min(timed(df), timed(df)), 1) for name, df in routes.items()}

    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        timed(QUERIES[name](spark, sf_dir))
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cores": int(cpus), "pages": n_pages, **rates,
        "baseline_pages_per_sec": 20.0,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
