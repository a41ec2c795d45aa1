import time

import pytest

from bspgraph import cli
from bspgraph.jobs import JobRequest, JobService, RequestError, can_cancel, is_valid, status_name
from bspgraph.plans.program import Effects, VertexProgram, register_program
from bspgraph.sources.store import open_store


@pytest.fixture(scope="module")
def directory(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("graph"))
    store = open_store(spark, "Parquet", {"directory": d})
    store.save_vertices(spark.createDataFrame([("a", None), ("b", None), ("c", None)], "id string, value bigint"))
    store.save_edges(spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], "src string, dst string, value bigint"))
    return d


def request_of(directory, **changes):
    return JobRequest(**({"label": "l", "store": "Parquet", "store_params": {"directory": directory}, "algorithm": "Count"} | changes))


@pytest.mark.parametrize(
    "changes, valid",
    [
        ({}, True), ({"label": ""}, False), ({"store": "x"}, False), ({"store_params": {}}, False), ({"algorithm": "x"}, False), ({"task_cpu": 0.05}, True), ({"task_cpu": 0.049}, False),
        ({"task_mem": 32}, True), ({"task_mem": 31}, False), ({"task_vertices": 1000}, True), ({"task_vertices": 999}, False), ({"task_timeout_sec": 10}, True),
        ({"task_timeout_sec": 9}, False), ({"task_timeout_sec": 600}, True), ({"task_timeout_sec": 601}, False),
    ],
)
def test_validation(changes, valid):
    assert is_valid(request_of("d", **changes)) == valid


def test_status_names():
    assert [status_name(k) for k in range(7)] == ["unknown", "created", "running", "completed", "cancelled", "failed", "unknown"]
    assert [k for k in range(7) if can_cancel(k)] == [1, 2]


def test_life_of_jobs(spark, directory, tmp_path):
    service = JobService(spark, str(tmp_path))
    with pytest.raises(RequestError, match="INVALID_REQUEST"):
        service.create(request_of(directory, label=""))
    count = service.create(request_of(directory))
    path = service.create(request_of(directory, algorithm="ShortestPath", algorithm_params={"from": "a", "to": "c"}))
    bad = service.create(request_of(directory + "/none"))
    assert status_name(service.wait(count).status) == "completed" and service.result(count)[1] == "vertices count=3; edges count=2"
    service.wait(path)
    assert service.result(path) == ({"pathLength": 3}, "path length from 'a' to 'c'=3")
    assert status_name(service.wait(bad).status) == "failed"
    for call in (service.result, service.cancel):
        with pytest.raises(RequestError, match="INVALID_JOB"):
            call(bad)
    with pytest.raises(RequestError, match="INVALID_JOB"):
        service.stats("unknown")
    assert [j.id for j in service.list()] == [count, path, bad] and service.stats(count)[1] == 0
    assert JobService(spark, str(tmp_path), workers=0).result(path)[0] == {"pathLength": 3}


def test_cancel_and_recovery(spark, directory, tmp_path):
    from pyspark.sql import functions as F

    register_program("Endless", lambda params: VertexProgram("Endless", lambda c: Effects(halt=F.lit(False)), dict, lambda r, p: ""))
    idle = JobService(spark, str(tmp_path), workers=0)
    waiting = idle.create(request_of(directory))
    service = JobService(spark, str(tmp_path))  # takes up the job that the other left
    assert service.wait(waiting).display == "vertices count=3; edges count=2"
    endless = service.create(request_of(directory, algorithm="Endless"))
    until = time.time() + 60
    while service.stats(endless)[1] < 1 and time.time() < until:
        time.sleep(0.05)
    assert service.stats(endless)[3].computed >= 3
    service.cancel(endless)
    assert status_name(service.wait(endless).status) == "cancelled"
    with pytest.raises(RequestError, match="INVALID_JOB"):
        service.result(endless)
    after = service.create(request_of(directory))
    assert service.wait(after).display


def test_command_line(spark, tmp_path):
    (tmp_path / "v.txt").write_text("v a 1 2\nv b 3 4\n")
    (tmp_path / "e.txt").write_text("a a b 7\n")
    said = []
    run = lambda *a: cli.main(["--root", f"{tmp_path}/jobs", *a], spark, said.append)
    assert run("list") == 0 and "no jobs" in said[-1]
    assert run("load", "--directory", f"{tmp_path}/g", "--vertices-file", f"{tmp_path}/v.txt") == 0 and said[-1] == "vertices: 2"
    assert run("load", "--directory", f"{tmp_path}/g", "--edges-file", f"{tmp_path}/e.txt") == 0 and said[-1] == "edges: 1"
    assert run("start", "count", "--directory", f"{tmp_path}/g") == 0 and said[-1] == "vertices count=2; edges count=1"
    assert run("start", "shortestPath", "--directory", f"{tmp_path}/g", "--from", "a", "--to", "b") == 0
    id = said[-2]
    assert run("job", "result", id) == 0 and said[-1] == "path length from 'a' to 'b'=7"
    assert run("job", "stats", id) == 0 and run("list") == 0 and "completed" in said[-1]
    assert run("job", "cancel", id) == 1 and run("job", "result", "x") == 1
    assert run("start", "count", "--directory", f"{tmp_path}/g", "--timeout", "5") == 1 and "INVALID_REQUEST" in said[-1]
