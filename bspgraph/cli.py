"""Command line: ``python -m bspgraph.cli`` with start, list, job and load."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from bspgraph.jobs import JobRequest, JobService, RequestError, status_name
from bspgraph.sources.dimacs import edge_reader, vertex_reader
from bspgraph.sources.store import open_store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bspgraph")
    top.add_argument("--root", default="bspgraph-data", help="folder of job records")
    commands = top.add_subparsers(dest="command", required=True)
    start = commands.add_parser("start").add_subparsers(dest="program", required=True)
    for name in ("count", "shortestPath"):
        p = start.add_parser(name)
        p.add_argument("--label", default=name)
        p.add_argument("--store", default="Parquet")
        p.add_argument("--directory", required=True)
        p.add_argument("--vertices", default="vertices")
        p.add_argument("--edges", default="edges")
        p.add_argument("--cpu", type=float, default=0.25)
        p.add_argument("--mem", type=float, default=64.0)
        p.add_argument("--task-vertices", type=int, default=10_000)
        p.add_argument("--timeout", type=int, default=30)
        if name == "shortestPath":
            p.add_argument("--from", dest="source", required=True)
            p.add_argument("--to", dest="target", required=True)
    commands.add_parser("list")
    job = commands.add_parser("job").add_subparsers(dest="action", required=True)
    for name in ("stats", "result", "cancel"):
        job.add_parser(name).add_argument("id")
    load = commands.add_parser("load")
    load.add_argument("--directory", required=True)
    load.add_argument("--format", default="dimacs")
    load.add_argument("--vertices-file")
    load.add_argument("--edges-file")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None, say=print) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("bspgraph").getOrCreate()
    try:
        if a.command == "load":
            store = open_store(spark, "Parquet", {"directory": a.directory})
            if a.vertices_file:
                store.save_vertices(vertex_reader(a.format)(spark, a.vertices_file))
                say(f"vertices: {store.row_count('vertices')}")
            if a.edges_file:
                store.save_edges(edge_reader(a.format)(spark, a.edges_file))
                say(f"edges: {store.row_count('edges')}")
            return 0
        service = JobService(spark, a.root, workers=1 if a.command == "start" else 0)
        if a.command == "start":
            params = {"from": a.source, "to": a.target} if a.program == "shortestPath" else {}
            request = JobRequest(a.label, a.store, {"directory": a.directory, "vertices": a.vertices, "edges": a.edges}, {"count": "Count", "shortestPath": "ShortestPath"}[a.program], params, a.cpu, a.mem, a.task_vertices, a.timeout)
            id = service.create(request)
            say(id)
            job = service.wait(id)
            say(job.display or f"{status_name(job.status)} {job.error}".strip())
            return 0 if job.display else 1
        if a.command == "list":
            jobs = service.list()
            for j in jobs:
                say(f"{j.id}\t{j.label}\t{time.strftime('%Y-%m-%d %H:%M:%S', time.gmtime(j.creation_time))}\t{status_name(j.status)}")
            if not jobs:
                say("no jobs; start one with: start count --directory DIR")
            return 0
        if a.action == "stats":
            job, step, current, total = service.stats(a.id)
            say(f"{job.label} {status_name(job.status)} superstep={step}")
            for name, s in (("current", current), ("total", total)):
                say(f"{name}: computed={s.computed} sent={s.sent} halted={s.halted} inactive={s.inactive} time={s.total_ns / 1e9:.3f}s")
        elif a.action == "result":
            say(service.result(a.id)[1])
        else:
            service.cancel(a.id)
            say("cancelled")
        return 0
    except (RequestError, ValueError) as e:
        say(str(e))
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
