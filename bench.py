"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores (default 8). Each query runs
once to warm up and BENCH_RUNS more times (default 2); the median counts. Results go to a sink
that reads every column of every row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from grantlens.queries import QUERIES  # noqa: E402
from grantlens.session import local_session  # noqa: E402


HEADLINE = (
    "current_version_orders", "current_version_lineitem", "recipient_totals", "findings_feed", "clean_payments",
    "comparable_grants", "description_gaps", "or_key_join", "entity_dossier", "seed_dossiers", "postal_rollup",
    "amendment_profile", "calibration_sweep", "validate_briefs", "quote_discipline_turns", "citation_completeness",
    "dead_links", "secret_scan", "token_completeness", "issue_tokens", "chain_tokens", "chain_audit", "find_tokens",
    "resolve_permalinks",
)


def cpu_seconds(pid: int) -> float:
    """CPU time that a process has used so far."""
    fields = Path(f"/proc/{pid}/stat").read_text().rsplit(")", 1)[1].split()
    return (int(fields[11]) + int(fields[12])) / os.sysconf("SC_CLK_TCK")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8,
                          shared_dir=os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="spark-"))
    spark.sparkContext.setLogLevel("ERROR")
    session = spark._jvm.java.lang.ProcessHandle.current().pid()
    seconds, cpu = {}, {}
    for name in only or HEADLINE:
        laps, used = [], []
        for _ in range(runs + 1):
            start, before = time.perf_counter(), cpu_seconds(session)
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
            used.append(cpu_seconds(session) - before)
        seconds[name] = round(statistics.median(laps[1:]), 3)
        cpu[name] = round(statistics.median(used[1:]), 2)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "cpu": cpu,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
