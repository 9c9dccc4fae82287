"""python -m kosha build|run|retrieve: indexes from a configuration, JSON or YAML.

{"docs": "resolutions.parquet", "root": "indexes", "chunkers": [{"type": "fixed_size", "size": 512}], "embedders": [{"type": "hashing", "dim": 64}], "mode": "cartesian"}
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from kosha.plans.experiment import Experiment, Strategy
from kosha.session import local_session
from kosha.sources import indexes


def read_config(path: str) -> dict:
    """A configuration; YAML where its reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def build(spark: SparkSession, config: dict) -> Experiment:
    """Builds every combination of the configuration; what fails is noted in the experiment's errors."""
    docs = spark.read.parquet(config["docs"])
    roles = {r: [Strategy(s["type"], tuple(sorted((k, v) for k, v in s.items() if k != "type"))) for s in config[f"{r}s"]] for r in ("chunker", "embedder")}
    made = Experiment(config.get("name", "index"), roles, config.get("mode", "cartesian"))
    plain = lambda s: {"type": s.type, **dict(s.params)}
    made.run(lambda _, c: indexes.build(docs, config["root"], plain(c["chunker"]), plain(c["embedder"])), lambda *_: None)
    return made


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kosha")
    p.add_argument("command", choices=("build", "run", "retrieve"))
    p.add_argument("config")
    p.add_argument("--query", action="append", default=[])
    p.add_argument("--retriever", default="hybrid")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--out")
    args = p.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    config = read_config(args.config)
    if args.command in ("build", "run"):
        made = build(spark, config)
        for name, why in made.errors.items():
            print(f"failed: {name}: {why}")
        if made.errors:
            return 1
    known = indexes.catalogue(spark, config["root"])
    if args.command == "build":
        for path, m in known:
            print(json.dumps({"path": path, **m}, ensure_ascii=False))
        return 0
    queries = spark.read.parquet(config["queries"]).select("query_id", "query") if config.get("queries") and not args.query else spark.createDataFrame(list(enumerate(args.query)), "query_id int, query string")
    got = indexes.compare({path: indexes.load(spark, path) for path, _ in known}, queries, args.retriever, args.k)
    if args.out:
        got.write.mode("overwrite").partitionBy("index_name").parquet(args.out)
    else:
        for r in got.orderBy("index_name", "query_id", "rank").toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
