"""``python -m tessera COMMAND``: evaluate, profile, retrieval, ranker, ablation, trace, index, vectors, demo."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession

from .sources.reports import report, write_json, write_markdown

DEMO = [
    "I'm looking for women's running shoes, but I'm still exploring.",
    "Lightweight and breathable would be good, cotton if possible.",
    "Actually, I changed my mind. What I need is a black waterproof winter boot.",
]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: str, samples: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.add_argument("--catalog", required=True)
        if samples:
            c.add_argument("--dataset", required=True)
        c.add_argument("--output")
        if "mode" in options:
            c.add_argument("--mode", choices=["safe", "shadow", "dynamic"], default="safe")
            c.add_argument("--profile", choices=["on", "off"], default="on")
        return c

    add("evaluate", "mode").add_argument("--baseline")
    add("profile").add_argument("--markdown")
    add("retrieval").add_argument("--mode", choices=["initial", "full"], default="full")
    add("ranker")
    add("ablation")
    add("trace", "mode").add_argument("--sample-id", action="append", default=[])
    add("index", samples=False)
    c = add("vectors", samples=False)
    for name in ("--embeddings", "--model-id", "--model-revision"):
        c.add_argument(name, required=True)
    add("demo", samples=False)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    from . import benchmarks as B
    from .engine import Agent, Engine
    from .evaluation import evaluate, read_samples
    from .evaluation import report as metrics
    from .operators import index as I
    from .sources.catalog import read_catalog
    from .sources.vectors import write_vectors
    from .storage import read_file

    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    began = time.perf_counter()
    if a.command == "index":
        I.build(read_catalog(spark, a.catalog), a.output or "index")
        out = json.loads(read_file(spark, f"{a.output or 'index'}/manifest.json"))
    elif a.command == "vectors":
        write_vectors(spark.read.parquet(a.embeddings), a.output or "vectors", model_id=a.model_id, model_revision=a.model_revision, catalog_sha256=B.catalog_sha256(spark, a.catalog))
        out = {"output": a.output or "vectors"}
    elif a.command == "demo":
        agent = Agent(Engine(spark, a.catalog))
        agent.reset("demo", {"preference_tags": ["comfort", "outdoor"]})
        out = {"turns": [{"turn": t, "user": m, **agent.respond("demo", m, t), "fallbacks": list(agent.fallbacks("demo"))} for t, m in enumerate(DEMO, 1)]}
    else:
        samples = read_samples(spark, a.dataset)
        if a.command == "profile":
            text, out = report("Catalog profile", B.profile(spark, read_catalog(spark, a.catalog), samples))
            if a.markdown:
                write_markdown(spark, a.markdown, text)
        else:
            if a.command == "trace" and a.sample_id:
                samples = samples.filter(samples["sample_id"].isin(a.sample_id))
            how = {"questions": a.mode, "hints": a.profile == "on"} if a.command in ("evaluate", "trace") else {}
            engine = Engine(spark, a.catalog, **how)
            ready = time.perf_counter() - began
            if a.command == "evaluate":
                out = metrics(evaluate(engine, samples))
                if a.baseline:
                    from .operators.profiles import compared

                    out["baseline_comparison"] = compared(out, json.loads(read_file(spark, a.baseline)))
            elif a.command == "retrieval":
                out = B.retrieval(engine, samples, a.mode)
            elif a.command == "ranker":
                out = B.ranker(engine, samples)
            elif a.command == "ablation":
                out = B.ablation(engine, samples)
            else:
                out = {"mode": a.mode, "sessions": B.trace(engine, samples)}
            out["initialization_ms"] = round(ready * 1000, 3)
    if a.output and a.command not in ("index", "vectors"):
        write_json(spark, a.output, out)
    print(json.dumps({k: v for k, v in out.items() if k != "sessions"}, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
