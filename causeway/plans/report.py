"""A run's report, the fingerprint of its result and the manifest of what it was made from."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import platform
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from causeway.operators import simulation
from causeway.plans import documents
from causeway.sources import market

#: The order of each kind's rows, and the columns that are taken.
ORDER = {"equity": ("run_id", "ts"), "fills": ("run_id", "bar_index", "symbol", "side", "price", "quantity"), "trades": ("run_id", "closed_bar", "symbol", "opened_bar"), "counts": ("run_id", "name")}


def _exact(v) -> str:
    """Floats by their bits, so that a change of one bit shows."""
    return v.hex() if isinstance(v, float) else "" if v is None else str(v)


def fingerprint(outputs: dict[str, DataFrame]) -> str:
    """SHA-256 over all rows of equity, fills, trades and counts in a fixed order.

    Rows stream through the driver one after another; none is kept.
    """
    whole = hashlib.sha256()
    for kind, order in ORDER.items():
        whole.update(kind.encode())
        names = [c.split()[0] for c in simulation.OUTPUTS[kind].split(", ")]
        for row in outputs[kind].select(*names).orderBy(*order).toLocalIterator(prefetchPartitions=True):
            whole.update(("|".join(map(_exact, row)) + "\n").encode())
    return whole.hexdigest()


def _git() -> dict:
    def said(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", *args], capture_output=True, text=True, timeout=20, cwd=Path(__file__).parent, check=False)
        except OSError:
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    return {"commit": said("rev-parse", "HEAD"), "clean": said("status", "--porcelain") == ""}


def manifest(spark: SparkSession, document: dict) -> dict:
    """Hashes of the document and of its files, the code's commit, and versions; ``replayable`` if all of them are known."""
    doc, git = documents.check(document), _git()
    files = {d["path"]: market.path_sha256(market.data_path(d["path"])) for d in (*doc["data"], *doc["events"], *doc["exogenous"])}
    versions = {"python": platform.python_version(), "spark": spark.version} | {n: importlib.metadata.version(n) for n in ("numpy", "pyarrow")}
    return {"config": documents.config_hash(document), "data": files, "code": git, "versions": versions, "seed": doc["seed"], "replayable": bool(git["commit"] and git["clean"] and all(files.values()))}


def report(spark: SparkSession, document: dict) -> dict:
    """What a run tells: manifest, fingerprint, performance, activity and counts of each run."""
    outputs = documents.run(spark, document)
    rows = lambda k: [r.asDict() for r in outputs[k].orderBy("run_id").limit(10_000).collect()]
    return {"name": document.get("name", "run"), "manifest": manifest(spark, document), "fingerprint": fingerprint(outputs), "performance": rows("performance"), "activity": rows("activity"), "counts": rows("counts")}


def write(told: dict, path: str) -> None:
    Path(path).write_text(json.dumps(told, indent=2, sort_keys=True, default=str))
