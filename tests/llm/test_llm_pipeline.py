"""The pipeline and the registered queries."""

import collections

import duckdb
import numpy as np
import pytest
from test_llm_exact import as_rows, brute_join, checked, overlaps

import corpus_pipeline
from marketday.llm import line_dedup, quality, stages
from marketday.llm.common import components, Scratch, gapless
from marketday.llm.queries import QUERIES, SQL


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "decontamination", "packing"]


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name != "packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            scores = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
            assert set(after) == {r["doc_id"] for r in scores if r["score"] >= 0.3}
        elif name == "lines":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/quality/*.parquet'")
            assert as_rows(line_dedup.digest(docs)) == collections.Counter(con.execute(line_dedup.SQL).fetchall())
            assert set(after) == set(before)
        elif name == "near_copies":
            component = {i: c for i, _, c in brute_join(list(before.items()), 5, 80)}
            assert set(after) == {i for i, c in component.items() if i == c} and all(before[i] == t for i, t in after.items())
        elif name == "decontamination":
            assert set(after) == {i for i, t in before.items() if not any(overlaps(t, b) for _, b in bench)}
        else:
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(before)
            checked([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
        docs = out


def test_stages_take_odd_rows(spark, docs, rows, nothing, sf_dir):
    lines = stages.lines(spark, docs, sf_dir)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    near = stages.near_copies(spark, docs, sf_dir).collect()
    distinct = set(rows)
    component = brute_join(sorted(distinct, key=str), 5, 80)
    groups = {(c if n and c is not None else ("own", k)) for k, ((i, n, c), m) in enumerate(component.items())}
    kept = [(r["doc_id"], r["text"]) for r in near]
    assert len(kept) == len(set(kept)) and set(kept) <= distinct and len(kept) >= len(groups)
    assert stages.quality(spark, docs, sf_dir).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t"), "c").collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, find(x)) for e in edges for x in e if e[0] != e[1]}


def test_gapless_numbers(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS x", "id % 7 AS y")
    got = collections.defaultdict(list)
    for r in gapless(df, ["g"], ["x", "y"], "at", 10**6).collect():
        got[r["g"]].append(r["at"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and len(got) == 3
