"""The job layer: create, list, stats, result and cancel, over a job table in the store's folder.

Jobs run first in, first out on worker threads, each under a Spark job tag, so that cancelling interrupts its tasks. A job's record
is a one-row JSON table, replaced as a whole at each change of status; on start-up created jobs are queued again and running ones
are taken up from their last recorded superstep.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bspgraph.model import JobStatus, PropertyGraph
from bspgraph.operators.partitioning import partition_count
from bspgraph.plans import algorithms
from bspgraph.plans.program import has_program, program
from bspgraph.plans.superstep import Cancelled, Stats, SuperstepLoop
from bspgraph.sources.store import has_store, open_store
from bspgraph.storage import Workspace, path_exists

MIN_CPU, MIN_MEM, MIN_VERTICES, TIMEOUTS = 0.05, 32.0, 1000, (10, 600)


class RequestError(Exception):
    """``status`` is INVALID_REQUEST, INVALID_JOB or INTERNAL."""

    def __init__(self, status: str, text: str = ""):
        super().__init__(f"{status}: {text}" if text else status)
        self.status = status


@dataclass
class JobRequest:
    label: str
    store: str
    store_params: Mapping[str, Any]
    algorithm: str
    algorithm_params: Mapping[str, Any] = field(default_factory=dict)
    task_cpu: float = 0.25
    task_mem: float = 64.0
    task_vertices: int = 10_000
    task_timeout_sec: int = 30


@dataclass
class Job:
    id: str
    label: str
    creation_time: float
    status: int
    store: str
    store_params: dict
    algorithm: str
    algorithm_params: dict
    task_cpu: float
    task_mem: float
    task_vertices: int
    task_timeout: int
    result: dict | None = None
    display: str = ""
    error: str = ""


def is_valid(r: JobRequest) -> bool:
    """The request's rules; unknown stores and programs are rejected here rather than failing later."""
    return bool(
        r.label and r.store and r.store_params and r.algorithm and r.task_cpu >= MIN_CPU and r.task_mem >= MIN_MEM and r.task_vertices >= MIN_VERTICES
        and TIMEOUTS[0] <= r.task_timeout_sec <= TIMEOUTS[1] and has_store(r.store) and has_program(r.algorithm)
    )


def can_cancel(status: int) -> bool:
    return status in (JobStatus.CREATED, JobStatus.RUNNING)


def status_name(status: int) -> str:
    """Lower-case name of a status, ``unknown`` for any other number."""
    return JobStatus(status).name.lower() if status in set(JobStatus) else "unknown"


def validity(requests: DataFrame) -> DataFrame:
    """``is_valid``'s numeric and emptiness rules over a table of requests, as a column ``valid``."""
    filled = [F.coalesce(F.length(c), F.lit(0)) > 0 for c in ("label", "store", "store_params", "algorithm")]
    rules = [*filled, F.col("task_cpu") >= MIN_CPU, F.col("task_mem") >= MIN_MEM, F.col("task_vertices") >= MIN_VERTICES, F.col("task_timeout").between(*TIMEOUTS)]
    valid = rules[0]
    for r in rules[1:]:
        valid = valid & r
    return requests.withColumn("valid", F.coalesce(valid, F.lit(False)))


def listed(jobs: DataFrame) -> DataFrame:
    """(position, id, label, created, status) by creation time, then id.

    Positions come from a stored range sort and the row counts of its partitions, so no task sees all jobs.
    """
    name = F.coalesce(*[F.when(F.col("status") == int(s), F.lit(s.name.lower())) for s in JobStatus], F.lit("unknown"))
    rows = jobs.select("creation_time", "id", "label", F.unix_timestamp("creation_time").alias("created"), name.alias("status"))
    ordered = rows.repartitionByRange("creation_time", "id").sortWithinPartitions("creation_time", "id")
    space = Workspace(jobs.sparkSession, "listed")
    rows, _ = space.save(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.call_function("shiftright", F.col("at"), F.lit(33))
    # Rows before each partition: as many numbers as there are partitions.
    before, total = [], 0
    for p, n in sorted(rows.groupBy(part.alias("p")).count().collect()):
        before.append((p, total))
        total += n
    offsets = F.broadcast(jobs.sparkSession.createDataFrame(before, "p long, before long"))
    position = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(offsets, part == offsets["p"]).select(position.alias("position"), "id", "label", "created", "status")


class JobStore:
    """Job records as JSON under ``<root>/jobs/<id>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, f"{root.rstrip('/')}/jobs"
        self.lock = threading.Lock()

    def save(self, job: Job) -> None:
        with self.lock:
            self.spark.createDataFrame([(json.dumps(asdict(job)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{job.id}")

    def load(self, id: str) -> Job | None:
        path = f"{self.root}/{id}"
        if not id or "/" in id or not path_exists(self.spark, path):
            return None
        return Job(**json.loads(self.spark.read.text(path).first()[0]))

    def load_all(self) -> list[Job]:
        if not path_exists(self.spark, self.root):
            return []
        return [Job(**json.loads(r[0])) for r in self.spark.read.option("recursiveFileLookup", "true").text(self.root).collect()]


class JobService:
    def __init__(self, spark: SparkSession, root: str, workers: int = 1):
        self.spark, self.root, self.store = spark, root.rstrip("/"), JobStore(spark, root)
        self.jobs = {j.id: j for j in self.store.load_all()}
        self.running: dict[str, tuple[Stats, Stats]] = {}
        self.cancelled: set[str] = set()
        self.lock = threading.RLock()
        self.waiting: queue.Queue[str] = queue.Queue()
        for job in sorted(self.jobs.values(), key=lambda j: (j.creation_time, j.id)):
            if job.status in (JobStatus.CREATED, JobStatus.RUNNING):
                self.waiting.put(job.id)
        for _ in range(workers):
            threading.Thread(target=self._work, daemon=True).start()

    # -- the five calls --------------------------------------------------------------------------------------------------------
    def create(self, request: JobRequest) -> str:
        if not is_valid(request):
            raise RequestError("INVALID_REQUEST")
        r = request
        job = Job(uuid.uuid4().hex, r.label, time.time(), int(JobStatus.CREATED), r.store, dict(r.store_params), r.algorithm, dict(r.algorithm_params), r.task_cpu, r.task_mem, r.task_vertices, r.task_timeout_sec)
        self._save(job)
        with self.lock:
            self.jobs[job.id] = job
        self.waiting.put(job.id)
        return job.id

    def list(self) -> list[Job]:
        with self.lock:
            return sorted(self.jobs.values(), key=lambda j: (j.creation_time, j.id))

    def stats(self, id: str) -> tuple[Job, int, Stats, Stats]:
        """(job, superstep, current, total); the numbers are 0 unless the job is running."""
        job = self._job(id)
        current, total = self.running.get(id, (Stats(), Stats()))
        return job, current.superstep, current, total

    def result(self, id: str) -> tuple[dict, str]:
        job = self._job(id)
        if job.status != JobStatus.COMPLETED:
            raise RequestError("INVALID_JOB", f"it is {status_name(job.status)}")
        return job.result, job.display

    def cancel(self, id: str) -> None:
        with self.lock:
            job = self._job(id)
            if not can_cancel(job.status):
                raise RequestError("INVALID_JOB", f"it is {status_name(job.status)}")
            self.cancelled.add(id)
            self._save(replace(job, status=int(JobStatus.CANCELLED)))
            job.status = int(JobStatus.CANCELLED)
        self.spark.interruptTag(f"bsp-{id}")

    def wait(self, id: str, seconds: float = 600) -> Job:
        until = time.time() + seconds
        while can_cancel(self._job(id).status) and time.time() < until:
            time.sleep(0.05)
        return self._job(id)

    # -- running ---------------------------------------------------------------------------------------------------------------
    def _job(self, id: str) -> Job:
        with self.lock:
            if id not in self.jobs:
                raise RequestError("INVALID_JOB", "unknown")
            return self.jobs[id]

    def _save(self, job: Job) -> None:
        try:
            self.store.save(job)
        except Exception as e:
            raise RequestError("INTERNAL", str(e)) from e

    def _settle(self, job: Job, status: JobStatus, **changes) -> bool:
        """Change a job's status unless it was cancelled meanwhile."""
        with self.lock:
            if job.id in self.cancelled:
                return False
            changes = {"status": int(status), **changes}
            self._save(replace(job, **changes))  # seen only once it is stored
            for k, v in changes.items():
                setattr(job, k, v)
        return True

    def _work(self) -> None:
        while True:
            job = self._job(self.waiting.get())
            if job.id in self.cancelled or not self._settle(job, JobStatus.RUNNING):
                continue
            tag = f"bsp-{job.id}"
            self.spark.addTag(tag)
            try:
                run = self._run(job)
                self._settle(job, JobStatus.COMPLETED, result=run.result, display=run.display)
            except Cancelled:
                pass
            except Exception as e:
                self._settle(job, JobStatus.FAILED, error=str(e)[:2000])
            finally:
                self.spark.removeTag(tag)
                self.running.pop(job.id, None)

    def _run(self, job: Job):
        store = open_store(self.spark, job.store, job.store_params)
        graph = PropertyGraph.of(store.load_vertices(), store.load_edges())
        n = partition_count(graph.vertices.count(), job.task_vertices)
        graph = PropertyGraph(graph.vertices.repartition(n, "id"), graph.edges)
        if job.algorithm == algorithms.COUNT:
            graph = algorithms.with_out_degree(graph)
        total = Stats()

        def seen(s: Stats) -> None:
            total.add(s)
            self.running[job.id] = (s, Stats(**asdict(total)))

        loop = SuperstepLoop(self.spark, graph, program(job.algorithm, job.algorithm_params), root=f"{self.root}/runs/{job.id}", cancelled=lambda: job.id in self.cancelled, on_stats=seen)
        loop.resume()
        return loop.run(record=True)
