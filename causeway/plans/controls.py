"""What can be said of a run document before it runs: it is valid, but may not measure what it seems to."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from causeway.operators import metrics

ERROR, WARNING, INFO = "error", "warning", "info"


@dataclass(frozen=True)
class Finding:
    severity: str
    code: str
    message: str
    remedy: str


def _inside(spec) -> Iterator[dict]:
    """All nodes of an expression, deep first."""
    if isinstance(spec, dict):
        if isinstance(spec.get("type"), str):
            yield spec
        for v in spec.values():
            yield from _inside(v)
    elif isinstance(spec, list):
        for v in spec:
            yield from _inside(v)


def _is(x: dict, kind: str, **fields) -> bool:
    return x["type"].partition("@")[0] == kind and all(x.get(k) == v for k, v in fields.items())


def findings(doc: dict, indexed: DataFrame | None = None) -> list[Finding]:
    """Findings on a checked document; ``indexed``: its bars with their sessions, if they have any."""
    rules = doc["strategy"]["params"].get("rules", {})
    naming = {name: list(_inside(rule)) for name, rule in rules.items()}
    at_close = sorted(n for n, xs in naming.items() if any(_is(x, "session", field="is_last") for x in xs))
    out = []
    if at_close and indexed is not None:
        found = metrics.sessions_without_close(indexed).first()
        if found["without"]:
            out.append(Finding(ERROR, "no_last_bar", f"{', '.join(at_close)} reads is_last, which no bar of {found['without']} of {found['sessions']} sessions has", "leave on minutes_from_open, or note that such sessions are accepted"))
    compared = [x for xs in naming.values() for x in xs if _is(x, "compare", op="==")]
    if any(_is(a, "session", field="minutes_from_open") and _is(b, "constant") and b.get("value") == 0 for x in compared for a, b in ((x["left"], x["right"]), (x["right"], x["left"]))):
        out.append(Finding(ERROR, "never_minute_zero", "minutes_from_open is that of a bar's close, so it is never 0", "compare with the minutes of one bar, or use is_first"))
    leaving = [n for n in at_close if n.startswith("exit")]
    if leaving and doc["execution"]["max_fill_gap_seconds"] is None:
        out.append(Finding(WARNING, "fill_overnight", f"{', '.join(leaving)} leaves on the last bar; the order fills on the first bar of the next session", "set max_fill_gap_seconds, or leave one bar earlier"))
    if doc["risk"].get("sizing", {}).get("kind") == "vol_target":
        out.append(Finding(WARNING, "volatility_per_bar", "vol_target measures over bars, not sessions", "give the target for one bar, or resample"))
    if any(d["session"] and not d["session_only"] for d in doc["data"]):
        out.append(Finding(WARNING, "session_runs_on", "a session without session_only lasts until the next one opens", "set session_only, or mean it"))
    if any(_is(x, "rolling", stat="rank") for xs in naming.values() for x in xs):
        out.append(Finding(INFO, "rank_in_time", "rolling rank compares with the past of the same instrument, not with other instruments", "use ranking@1 to compare instruments"))
    return out
