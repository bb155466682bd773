"""Revisions: one writer wins, and what isn't committed isn't there."""

import threading

import pytest

from weftlink.plans.model import Invalid
from weftlink.sources.revisions import Repository, RevisionConflict


@pytest.fixture
def repository(spark, tmp_path):
    return Repository(spark, tmp_path.as_uri())


def values(df):
    return sorted(r.v for r in df.collect())


def table(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "v long")


def test_revisions_follow_each_other(spark, repository):
    assert repository.load("run-1") == (0, None, {}) and repository.runs() == []
    assert repository.save("run-1", 0, {"stage": "review"}, {"links": table(spark, 1, 2), "items": table(spark, 9)}) == 1
    assert repository.save("run-1", 1, {"stage": "done"}, {"links": table(spark, 3)}) == 2
    revision, state, tables = repository.load("run-1")
    assert (revision, state, values(tables["links"]), values(tables["items"])) == (2, {"stage": "done"}, [3], [9])
    assert values(repository.load("run-1", 1)[2]["links"]) == [1, 2]
    assert repository.runs() == ["run-1"] and repository.revisions("run-1") == [1, 2]
    with pytest.raises(Invalid):
        repository.load("run-1", 7)
    with pytest.raises(Invalid):
        repository.save("../elsewhere", 0, {})


def test_a_late_writer_is_refused(spark, repository):
    repository.save("run-2", 0, 1)
    with pytest.raises(RevisionConflict):
        repository.save("run-2", 0, 2, {"links": table(spark, 5)})
    assert repository.load("run-2")[:2] == (1, 1)


def test_one_of_many_writers_wins(spark, repository):
    repository.save("run-3", 0, "start")
    ready, results = threading.Barrier(8), []

    def write(i):
        entry = {"snapshotVersion": "run-state-snapshot-v1", "runId": "run-3", "revision": 2, "state": i, "tables": {}}
        ready.wait()
        import json

        results.append((repository._create(json.dumps(entry), "run-3", "revisions", "2.json"), i))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [i for won, i in results if won]
    assert len(winners) == 1 and repository.load("run-3")[:2] == (2, winners[0])


def test_a_crash_before_the_commit_leaves_the_old_revision(spark, repository, monkeypatch):
    repository.save("run-4", 0, "old", {"links": table(spark, 1)})

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(repository, "_create", crash)
    with pytest.raises(OSError):
        repository.save("run-4", 1, "new", {"links": table(spark, 2)})
    monkeypatch.undo()
    revision, state, tables = repository.load("run-4")
    assert (revision, state, values(tables["links"])) == (1, "old", [1])
    assert len(repository.orphans("run-4")) == 1
    assert repository.save("run-4", 1, "new", {"links": table(spark, 2)}) == 2 and len(repository.orphans("run-4")) == 1


def test_sources_never_change(spark, repository):
    repository.save_source("run-5", "A", table(spark, 1, 2))
    with pytest.raises(Invalid):
        repository.save_source("run-5", "A", table(spark, 3))
    assert values(repository.source("run-5", "A")) == [1, 2] and len(repository.orphans("run-5")) == 1
    with pytest.raises(Invalid):
        repository.save_source("run-5", "C", table(spark, 3))
