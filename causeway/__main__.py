"""``python -m causeway COMMAND``.

catalogue, schema, instruments and example describe; skeleton writes a document
to fill in; validate judges a file, check a document; run, walkforward and pbo
compute; verify runs a report's document again; trials lists an archive. Exit
code 0: done, 1: a usage or run error, 2: something was found wanting.
"""

from __future__ import annotations

import argparse
import inspect
import json
import sys

from causeway.functions import registry
from causeway.operators import nodes


def catalogue() -> dict:
    """Primitives with their parameters and node types with their fields."""
    plain = lambda v: "required" if v is inspect.Parameter.empty or v is nodes.REQUIRED else v
    return {
        "primitives": {k: {"summary": p.summary, "family": p.family, "parameters": {n: plain(d) for n, d in p.defaults.items()}} for k, p in registry.everything().items()},
        "nodes": {k: {n: plain(d) for n, d in nodes._NODES[k][1].items()} for k in nodes.kinds()},
    }


def schema() -> dict:
    """A JSON schema of the expression language."""
    options = []
    for kind in nodes.kinds():
        fields = nodes._NODES[kind][1]
        options.append({"type": "object", "required": ["type", *(n for n, d in fields.items() if d is nodes.REQUIRED)], "additionalProperties": False, "properties": {"type": {"enum": [kind, f"{kind}@1"]}, "version": {"const": 1}, "note": {}, **{n: {"$ref": "#/$defs/node"} if n in ("inner", "left", "right", "fast", "slow", "condition", "then", "otherwise", "when", "mask") else {} for n in fields}}})
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$ref": "#/$defs/node", "$defs": {"node": {"oneOf": options}}}


def example() -> dict:
    """A whole document: crossings of two means on one instrument."""
    mean = lambda n: {"type": "primitive", "ref": "sma@1", "params": {"window": n}}
    sides = {"fast": mean(20), "slow": mean(50)}
    return skeleton("crossings") | {"strategy": {"ref": "rules@1", "params": {"quantity": 1, "rules": {"entry_long": {"type": "crosses_above", **sides}, "exit_long": {"type": "crosses_below", **sides}}}}}


def skeleton(name: str) -> dict:
    """A document without rules, which is valid as soon as its file exists."""
    return {"name": name, "initial_cash": 100_000.0, "data": [{"root": "ES", "path": "bars.parquet"}], "execution": {"fees": {"kind": "per_contract"}, "slippage": {"kind": "tick", "ticks": 1.0}}, "strategy": {"ref": "rules@1", "params": {"quantity": 1, "rules": {}}}}


def _printed(df, *order: str) -> None:
    for r in df.orderBy(*order).limit(1000).collect():
        print(json.dumps(r.asDict(), default=str))


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("causeway").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="causeway", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("catalogue", "schema", "instruments", "example"):
        commands.add_parser(name)
    commands.add_parser("skeleton").add_argument("name")
    for name in ("check", "run"):
        one = commands.add_parser(name)
        one.add_argument("documents", nargs="+")
        if name == "check":
            one.add_argument("--with-data", action="store_true")
        else:
            one.add_argument("--report")
    one = commands.add_parser("validate")
    one.add_argument("path")
    one.add_argument("--timestamp")
    one = commands.add_parser("walkforward")
    one.add_argument("documents", nargs="+")
    for name in ("--train", "--test"):
        one.add_argument(name, type=int, required=True)
    one = commands.add_parser("pbo")
    one.add_argument("documents", nargs="+")
    one.add_argument("--grid", required=True, help='JSON: {"parameter": [values]}')
    one.add_argument("--blocks", type=int, default=16)
    one.add_argument("--ignore-inactive", action="store_true")
    one = commands.add_parser("verify")
    one.add_argument("report")
    one.add_argument("documents", nargs="+")
    commands.add_parser("trials").add_argument("archive")
    given = parser.parse_args(args)
    from causeway.operators import metrics, validation
    from causeway.plans import controls, documents, report
    from causeway.sources import market

    try:
        if given.command in ("catalogue", "schema"):
            print(json.dumps(catalogue() if given.command == "catalogue" else schema(), indent=2, sort_keys=True))
        elif given.command in ("example", "skeleton"):
            print(json.dumps(example() if given.command == "example" else skeleton(given.name), indent=2))
        elif given.command == "instruments":
            print(json.dumps(market.INSTRUMENTS, indent=2))
        elif given.command == "check":
            doc = documents.check(document := documents.read(*given.documents))
            print(documents.config_hash(document))
            indexed = documents.sources(_session(), doc) if given.with_data and all(d["session"] for d in doc["data"]) else None
            found = controls.findings(doc, indexed)
            for x in found:
                print(f"{x.severity:8} {x.code}: {x.message}; {x.remedy}")
            return 2 if any(x.severity == controls.ERROR for x in found) else 0
        elif given.command == "run":
            document = documents.read(*given.documents)
            if given.report:
                report.write(report.report(_session(), document), given.report)
            else:
                for name, df in documents.run(_session(), document).items():
                    if name in ("performance", "activity", "exposure", "counts", "picks"):
                        print(name)
                        _printed(df, df.columns[0])
        elif given.command == "verify":
            with open(given.report) as f:
                told = json.load(f)
            again = report.fingerprint(documents.run(_session(), documents.read(*given.documents)))
            print(f"{told['fingerprint']}\n{again}")
            return 0 if again == told["fingerprint"] else 2
        elif given.command == "walkforward":
            found = documents.walk_forward(_session(), documents.read(*given.documents), given.train, given.test)
            _printed(found["folds"], "run_id")
            _printed(found["summary"], "symbol")
        elif given.command == "pbo":
            splits = documents.overfitting(_session(), documents.variants(documents.read(*given.documents), json.loads(given.grid)), given.blocks, given.ignore_inactive)
            print(json.dumps(splits.selectExpr("count(*) AS splits", "avg(CASE WHEN logit <= 0 THEN 1D ELSE 0D END) AS probability").first().asDict()))
        elif given.command == "trials":
            archive = _session().read.parquet(given.archive)
            _printed(archive, "config", "result")
            return 2 if metrics.repeated_trials(archive).limit(1).count() else 0
        else:
            found = validation.check(market.read_ohlcv(_session(), given.path, given.timestamp)).collect()
            for r in found:
                print(f"{r['severity']:8} {r['rule']:32} {r['violations']}")
            return 2 if any(r["severity"] == "error" and r["violations"] for r in found) else 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
