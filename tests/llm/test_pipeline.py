"""The pipeline's stages on the smallest tables, each against plain code over its own input."""

import plain
import pytest

import corpus_pipeline
from evidence_engine.llm import line_chunks, queries
from evidence_engine.llm.common import documents, materialize

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, SF_DIR), {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF_DIR), name)
        out[name] = docs, after
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert name == "pack" or after.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_rules(stages):
    before, after = map(texts, stages["quality_rules"])
    assert after.items() <= before.items()
    assert not any(plain.base_quality(t)[-1] for t in after.values())
    assert len(after) > 0.7 * len(before)


def test_line_dedup(stages):
    before, after = map(texts, stages["line_dedup"])
    seen, wanted = set(), {}
    for i, t in sorted(before.items()):
        kept = []
        for _, _, chunk in line_chunks.chunks(t.encode()):
            if not (line_chunks.compared(chunk) and chunk in seen):
                kept.append(chunk)
            seen.add(chunk)
        if kept or not t:
            wanted[i] = b"\n".join(kept).decode()
    assert after == {i: t for i, t in wanted.items() if t or not before[i]}


def test_near_dedup(stages):
    before, after = map(texts, stages["near_dedup"])
    assert set(after) == {i for i, _, _, kept in plain.near_duplicates(list(before.items()), 5, 80) if kept}


def test_decontaminate(spark, stages):
    before, after = map(texts, stages["decontaminate"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, *_ in plain.overlaps(list(before.items()), items)}
    assert bad and set(after) == set(before) - bad


def test_pack(stages):
    before, after = stages["pack"]
    assert {r[0] for r in after.select("doc_id").collect()} == set(texts(before))


def test_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
