"""The ingestion stream: stages, replaced versions, retries, dead letters, and the same end after a kill between any two stages."""

import os
import time

import pytest

from corvex.streaming.ingestion import STAGES, Ingestion


def put(folder, name, content, at):
    folder.mkdir(exist_ok=True, parents=True)
    path = folder / name
    path.write_bytes(content)
    os.utime(path, (at, at))


def run(ingestion, tmp_path):
    q = ingestion.start(str(tmp_path / "in"), str(tmp_path / "cp"))
    assert q.awaitTermination(200)


def state(ingestion):
    chunks = sorted((r.document_id, r.chunk_index, r.section_path, r.content) for r in ingestion.chunks().collect())
    return chunks, sorted((r.document_id, r.status, r.attempt, r.n_chunks) for r in ingestion.statuses().collect())


def feed(tmp_path, step, at):
    put(tmp_path / "in" / f"s{step}", f"a{step}.md", f"# Head\n\nbody {step}\n\n## Sub\n\nmore".encode(), at)
    if step == 0:
        put(tmp_path / "in" / "s0", "bad.docx", b"no zip file", at)
        put(tmp_path / "in" / "s0", "page.html", b"<h1>T</h1><p>one</p><p>two</p>", at)
    if step == 1:
        put(tmp_path / "in" / "s1", "page.html", b"<h1>T</h1><p>three</p>", at)
        put(tmp_path / "in" / "s1", "empty.md", b"\n", at)


def test_ingestion_and_kills(spark, tmp_path):
    at = time.time() - 1000
    plain = Ingestion(spark, str(tmp_path / "plain" / "out"))
    for step in range(5):
        feed(tmp_path / "plain", step, at + step)
        run(plain, tmp_path / "plain")
    chunks, statuses = state(plain)
    # the bad file is tried in batches 0, 1 and 3, and then given up
    assert ("bad", "dead", 3, 0) in statuses and ("page", "ready", 1, 1) in statuses and ("empty", "ready", 1, 0) in statuses and len(statuses) == 8
    assert [c[3] for c in chunks if c[0] == "page"] == ["three"] and ("a3", 2, "Head > Sub", "more") in chunks
    assert [(r.document_id, r.attempt) for r in plain.dead_letters().collect()] == [("bad", 3)] and "Error" in plain.dead_letters().head().error or "BadZip" in plain.dead_letters().head().error

    killed = set()

    def kill(stage, batch):
        if (stage, batch) not in killed and len(killed) < len(STAGES) * 2 and batch in (0, 1):
            killed.add((stage, batch))
            raise RuntimeError("killed")

    hurt = Ingestion(spark, str(tmp_path / "hurt" / "out"), after=kill)
    for step in range(5):
        feed(tmp_path / "hurt", step, at + step)
        for _ in range(len(STAGES) + 1):
            q = hurt.start(str(tmp_path / "hurt" / "in"), str(tmp_path / "hurt" / "cp"))
            try:
                q.awaitTermination(200)
                break
            except Exception as error:
                assert "killed" in str(error)
        else:
            pytest.fail("did not end")
    assert len(killed) == 2 * len(STAGES) and state(hurt) == (chunks, statuses)


def test_a_new_version_ends_the_wait(spark, tmp_path):
    at = time.time() - 1000
    ingestion = Ingestion(spark, str(tmp_path / "out"))
    put(tmp_path / "in", "x.docx", b"broken", at)
    run(ingestion, tmp_path)
    assert state(ingestion)[1] == [("x", "retrying", 1, 0)]
    put(tmp_path / "in" / "later", "x.md", b"fine now", at + 5)
    run(ingestion, tmp_path)
    assert state(ingestion) == ([("x", 1, "", "fine now")], [("x", "ready", 1, 1)])
