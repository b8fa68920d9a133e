"""The stages of the pipeline among themselves."""

import pandas as pd
import pytest

import corpus_pipeline
from quercus.llm import common

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def _batches(session) -> list[tuple[int, int]]:
    """Rows and bytes of the batches in which 24 texts of 1 MB each reach a worker."""

    def told(it):
        for b in it:
            yield pd.DataFrame({"n": [len(b)], "size": [int(b["text"].str.len().sum())]})

    texts = session.range(0, 24, 1, 1).selectExpr("id AS doc_id", "repeat(chr(97 + id), 1 << 20) AS text")
    return [tuple(r) for r in texts.mapInPandas(told, "n long, size long").collect()]


@pytest.mark.parametrize("name, stage", [s for s in corpus_pipeline.STAGES if s[0] in ("toxicity", "packing")])
def test_batches_for_python_are_bounded(spark, data, name, stage):
    own = spark.newSession()
    stage(own, own.read.parquet(f"{data}/documents.parquet"), data)
    got = _batches(own)
    assert sum(n for n, _ in got) == 24 and sum(size for _, size in got) == 24 << 20
    assert max(size for _, size in got) <= common.BATCH_BYTES + (1 << 20)
    kept = spark.newSession()
    kept.conf.set(NAME, 1 << 21)
    stage(kept, kept.read.parquet(f"{data}/documents.parquet"), data)
    assert int(kept.conf.get(NAME)) == 1 << 21


def test_results_do_not_depend_on_batches(spark, data):
    rows = []
    for size in (2000, 1 << 30):
        own = spark.newSession()
        own.conf.set(NAME, size)
        docs = own.read.parquet(f"{data}/documents.parquet")
        out = [stage(own, docs, data).collect() for name, stage in corpus_pipeline.STAGES if name in ("toxicity", "packing")]
        rows.append([sorted(map(tuple, x), key=repr) for x in out])
    assert all(rows[0]) and rows[0] == rows[1]
