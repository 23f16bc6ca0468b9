"""Headline timings: one JSON line with seconds per query. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from passagework.registry import QUERIES  # noqa: E402
from passagework.session import build_session  # noqa: E402

HEADLINE = (
    "file_facts", "format_routing", "markup_events", "page_assembly", "flat_content",
    "chunk_recursive", "chunk_recursive_small", "chunk_sentence_pack", "chunk_ordinals", "chunk_config_matrix", "token_count_bpe",
    "hash_embedding", "config_fingerprint", "document_upsert", "chunk_insert_only", "stale_chunks", "config_inventory",
    "cosine_topk", "l2_topk", "batch_topk", "sparse_topk", "per_request_topk", "lsh_topk", "best_match",
    "context_block", "conversation_history", "request_messages", "command_segments", "running_counter",
    "context_recall", "answer_correctness", "eval_report", "stream_ingest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    spark = build_session(
        f"local[{cpus}]", int(cpus), **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
                                      "spark.sql.files.maxPartitionBytes": str(1 << 20), "spark.sql.files.openCostInBytes": "0"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    result = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
