"""Every stage of the pipeline on nulls, empty and long texts, ties, repeats, an empty table and clashing columns."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep boolean, component_id long, n_dropped string, ids string, score string"
WORDS = [f"w{i}ord" for i in range(400)]


def passage(start, n=60):
    return " ".join(WORDS[(start * 7 + i * (start + 1)) % 400] for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("cases")
    long_text = " ".join(f"{WORDS[i % 400]}{i // 400}" for i in range(120_000))
    bench = passage(3, 40)
    texts = [(1, passage(1)), (2, passage(1)), (3, None), (4, ""), (5, None), (6, passage(2) + "\nA shared line of the corpus"), (7, passage(4) + "\na SHARED line of the corpus  "), (7, passage(4) + "\na SHARED line of the corpus  "),
             (None, passage(5) + "\nA shared line of the corpus"), (None, None), (10, long_text), (11, passage(6) + " " + bench + " " + passage(7)), (12, passage(8) + "\n\n\t\n"), (13, "one two"), (14, "one two"), (15, "𝒳 é \x00   end")]
    rows = [(i, t, None, "s", None if t is None else len(t), True, 99, "x", "y", "z") for i, t in texts]
    for name, data in (("full", rows), ("none", [])):
        spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(str(out / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (2, 1, 0), (12, 1, 0), (None, 0, 1), (4, None, None)] if data else [], "doc_id long, quality int, toxic int").write.parquet(str(out / name / "labels.parquet"))
        spark.createDataFrame([(1, bench), (2, None), (3, ""), (None, "nothing of the kind stands anywhere in here at all")] if data else [], "item_id long, text string").write.parquet(str(out / name / "benchmark.parquet"))
    return out


def stages(spark, folder):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES:
        yield name, docs, stage(spark, docs, str(folder))


def test_each_stage_on_hard_rows(spark, folder):
    for name, docs, out in stages(spark, folder / "full"):
        rows = out.collect()
        if name == "tokens":
            assert out.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "round_trip"] and len(rows) == 16 and all(r.round_trip for r in rows)
            assert sorted(r.n_tokens for r in rows)[:4] == [0, 0, 0, 0]
            continue
        assert out.schema.names == docs.schema.names
        ids = sorted((r.doc_id for r in rows if r.doc_id is not None))
        assert sum(r.doc_id is None for r in rows) == 2  # rows without an id stay
        assert all((r.keep, r.component_id, r.n_dropped, r.ids, r.score) == (True, 99, "x", "y", "z") for r in rows)  # columns that only look like results
        assert ids.count(7) in (0, 2)
        by = {r.doc_id: r.text for r in rows}
        if name == "line_dedup":
            assert ids == [1, 2, 3, 4, 5, 6, 7, 7, 10, 11, 12, 13, 14, 15] and by[7] == passage(4) and by[6].endswith("corpus") and by[2] == "" and by[12] == passage(8) + "\n\n\t\n"
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "near_dedup":
            assert ids == [1, 3, 6, 7, 7, 10, 11, 12, 13, 15]  # of copies, empty texts among them, the smallest id
        elif name == "decontamination":
            assert ids == [1, 2, 3, 4, 5, 6, 7, 7, 10, 12, 13, 14, 15]
        else:
            assert {1, 12} <= set(ids)


def test_each_stage_on_an_empty_table(spark, folder):
    for _, _, out in stages(spark, folder / "none"):
        assert out.count() == 0


def test_the_whole_run(spark, folder):
    import corpus_pipeline as pipeline

    assert pipeline.run(spark, str(folder / "none")).count() == 0
    got = pipeline.run(spark, str(folder / "full"))
    assert got.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "round_trip"] and {r.doc_id for r in got.collect()} >= {1, 12, None}
