import json
import random

import pytest

from marketday.operators import objects
from marketday.operators.graph import induced_edges, khop, khop_many, nearest_nodes
from marketday.plans import glossary, inventory, lineage
from pyspark.sql import functions as F


# ---- lineage ----------------------------------------------------------------------------------------


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "JOIN") for a, b in pairs], "src string, dst string, op string")


CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]


def hops(df):
    return sorted((r["direction"], r["node"], r["hop"]) for r in df.collect())


def test_one_hop_on_a_cycle(spark):
    assert hops(khop(edges(spark, CYCLE), "a", 1)) == [("down", "b", 1), ("target", "a", 0), ("up", "c", 1)]


@pytest.mark.parametrize("n", [3, 5])
def test_a_cycle_ends_and_keeps_the_least_hop(spark, n):
    got = hops(khop(edges(spark, CYCLE), "a", n))
    assert got == [("down", "b", 1), ("down", "c", 2), ("down", "d", 3), ("target", "a", 0), ("up", "b", 2), ("up", "c", 1)]


def test_unknown_target_is_alone(spark):
    assert hops(khop(edges(spark, CYCLE), "zzz", 2)) == [("target", "zzz", 0)]


def test_many_targets_are_as_one_by_one(spark):
    """All 64 bits, the sign bit among them; cycles, loops, double edges, a hub and a target without edges."""
    rng = random.Random(4)
    pairs = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(45)] + [("n1", "n1"), ("n2", "n3"), ("n2", "n3")]
    pairs += [("hub", f"n{i}") for i in range(40)]
    graph = edges(spark, pairs)
    targets = [f"n{i}" for i in range(41)] + ["hub", "unknown"] + [f"zz{i}" for i in range(21)]
    assert len(targets) == 64
    steps = {"down": {}, "up": {}}
    for a, b in pairs:
        steps["down"].setdefault(a, set()).add(b)
        steps["up"].setdefault(b, set()).add(a)
    want = []
    for t in targets:
        want.append((t, "target", t, 0))
        for direction, nexts in steps.items():
            seen, front = {t}, {t}
            for hop in range(1, 4):
                front = {b for a in front for b in nexts.get(a, ())} - seen
                seen |= front
                want += [(t, direction, n, hop) for n in front]
    got = [(r["target"], r["direction"], r["node"], r["hop"]) for r in khop_many(graph, [*targets, "n1"], 3).collect()]
    assert sorted(got) == sorted(want)
    assert hops(khop_many(graph, ["zz1"], 2).drop("target")) == [("target", "zz1", 0)]
    with pytest.raises(ValueError):
        khop_many(graph, [*targets, "one more"], 2)


@pytest.mark.parametrize("n", [0, 6])
def test_hops_out_of_range(spark, n):
    with pytest.raises(ValueError):
        khop(edges(spark, CYCLE), "a", n)


def test_a_hub_with_most_edges(spark):
    pairs = [("t", "hub")] + [("hub", f"n{i}") for i in range(500)] + [(f"n{i}", "end") for i in range(500)]
    got = hops(khop(edges(spark, pairs), "t", 3))
    assert len(got) == 1 + 1 + 500 + 1 and ("down", "end", 3) in got


def test_nearest_nodes_are_capped_by_hop_then_degree_then_name(spark):
    graph = edges(spark, [("t", "x"), ("t", "y"), ("t", "z"), ("z", "w"), ("x", "y")])
    picked = [tuple(r) for r in nearest_nodes(graph, khop(graph, "t", 2), 3).collect()]
    assert picked == [("t", 0, 3), ("x", 1, 2), ("y", 1, 2)]
    kept = induced_edges(graph, nearest_nodes(graph, khop(graph, "t", 2), 3))
    assert sorted((r["src"], r["dst"]) for r in kept.collect()) == [("t", "x"), ("t", "y"), ("x", "y")]


@pytest.mark.parametrize("theme,fill", [("vibrant", "#FFCDD2"), ("MUTED", "#FFEBEE"), ("monochrome", "#FFFFFF"), (None, "#FFCDD2")])
def test_target_style(spark, theme, fill):
    nodes, links = lineage.subgraph(edges(spark, CYCLE), F.lit("table"), "a", 1, theme)
    style = {r["node"]: r for r in nodes.collect()}
    assert (style["a"]["fillcolor"], style["a"]["penwidth"], style["a"]["is_target"]) == (fill, 3, True)
    assert style["b"]["shape"] == "box" and style["b"]["penwidth"] == 1
    assert links.count() == 3  # a-b, b-c and c-a: both ends within one hop


# ---- glossary -----------------------------------------------------------------------------------------


def docs(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc_id int, body string")


ODD = (
    '{"columns":[1,{"table":"t","column":"c","definition":"","description":"d","synonyms":["a","a","b"]},'
    '{"table":"u","synonyms":"x"}]}'
)


def columns(df):
    return [tuple(r) for r in df.orderBy("table").collect()]


def test_columns_with_odd_entries(spark):
    assert columns(glossary.glossary_columns(docs(spark, ODD))) == [(0, "t", "c", "d", "a, a, b"), (0, "u", "", "", "x")]
    capped = glossary.glossary_columns(docs(spark, ODD), cap_synonyms=True)
    assert columns(capped)[0][-1] == "a, b"


def test_cap_keeps_five_different_synonyms(spark):
    body = json.dumps({"columns": [{"table": "t", "synonyms": ["a", "b", "a", "c", "d", "e", "f"]}]})
    assert columns(glossary.glossary_columns(docs(spark, body), cap_synonyms=True))[0][-1] == "a, b, c, d, e"


def test_fallback_only_when_columns_is_absent_or_null(spark):
    nested = {"business_glossary": {"columns": [{"table": "n"}]}}
    bodies = [
        json.dumps(nested), json.dumps({**nested, "columns": None}),
        json.dumps({**nested, "columns": []}), json.dumps({**nested, "columns": "none"}),
        json.dumps({"columns": {"table": "x"}}), json.dumps({"business_glossary": [1]}),
    ]
    assert [r[:2] for r in columns(glossary.glossary_columns(docs(spark, *bodies)))] == [(0, "n"), (1, "n")]


def test_text_documents(spark):
    bodies = ["{bad", '{"text":"hi"}', ODD, "[1, 2]", '"quoted"', '{"text":null,"columns":[{"table":"t"}]}']
    got = {r["doc_id"]: r["text"] for r in glossary.glossary_texts(docs(spark, *bodies)).collect()}
    assert set(got) == {0, 1, 3, 4, 5}
    assert (got[0], got[1], got[3]) == ("{bad", "hi", "[1, 2]")
    assert {r["doc_id"] for r in glossary.glossary_columns(docs(spark, *bodies)).collect()} == {2}


def test_terms(spark):
    body = json.dumps({"terms": [{"term": "", "name": "n", "definition": "d"}, 7, {"term": "t", "description": "e"}]})
    got = sorted(tuple(r) for r in glossary.glossary_terms(docs(spark, body, "{}", '{"terms":{"term":"x"}}')).collect())
    assert got == [(0, "n", "d"), (0, "t", "e")]


def test_null_document_is_no_glossary(spark):
    assert glossary.glossary_columns(docs(spark, None, "")).count() == 0


# ---- objects --------------------------------------------------------------------------------------------


def test_only_even_ids_with_the_wrong_make_are_repaired(spark):
    trucks = spark.createDataFrame(
        [(1, 2001, "Ford_", "m"), (2, 2002, "Ford_", "m"), (3, 2003, "Ford_", None), (4, 2004, "Kia", "m"), (6, 2006, None, "m")],
        "truck_id bigint, year bigint, make string, model string",
    )
    got = objects.truck_details(trucks)
    assert got.columns == ["truck_id", "truck_build"]
    made = {r["truck_id"]: r["truck_build"] for r in got.collect()}
    assert {k: v["make"] for k, v in made.items()} == {1: "Ford_", 2: "Ford", 3: "Ford_", 4: "Kia", 6: None}
    text = {r[0]: json.loads(r[1]) for r in got.select("truck_id", objects.object_text("truck_build")).collect()}
    assert text[6] == {"year": 2006, "model": "m"} and text[3] == {"year": 2003, "make": "Ford_"}


# ---- inventories ------------------------------------------------------------------------------------------


def test_column_dictionary(spark):
    long = "x" * 70
    df = spark.createDataFrame(
        [(1, "a", [1]), (2, None, [1]), (None, long + "1", None), (2, long + "2", [1, 2])], "i int, s string, a array<int>"
    )
    got = {r["column_name"]: r for r in inventory.column_dictionary("t", df).collect()}
    assert {k: (r["position"], r["data_type"], r["row_count"], r["null_count"], r["distinct_count"]) for k, r in got.items()} == {
        "i": (1, "int", 4, 1, 2), "s": (2, "string", 4, 1, 3), "a": (3, "array<int>", 4, 1, 2)
    }


def test_corpus_inventory(spark):
    files = spark.createDataFrame([("A.SQL", "select 1"), ("n.txt", "")], "name string, content string")
    got = sorted(tuple(r) for r in inventory.corpus_inventory(files).collect())
    assert got == [("A.SQL", "SQL", 8, "FILE: A.SQL (language: SQL)"), ("n.txt", "", 0, "FILE: n.txt (language: )")]


def test_column_dictionary_of_odd_columns(spark):
    df = spark.createDataFrame(
        [(0.0, [1, 2], {"a": 1}, "x" * 500, None), (-0.0, [1, 2], {"a": 1}, "x" * 499 + "y", None), (float("nan"), None, None, "", None)],
        "d double, a array<int>, m map<string,int>, `s.t` string, nothing date",
    )
    got = {r["column_name"]: (r["row_count"], r["null_count"], r["distinct_count"]) for r in inventory.column_dictionary("t", df).collect()}
    assert got == {"d": (3, 0, 2), "a": (3, 1, 1), "m": (3, 1, 1), "s.t": (3, 0, 3), "nothing": (3, 3, 0)}
    none = inventory.column_dictionary("t", df.limit(0)).collect()
    assert [(r["row_count"], r["distinct_count"]) for r in none] == [(0, 0)] * 5


def test_column_dictionary_moves_no_text(spark):
    df = spark.createDataFrame([("text", 1)], "a string, b int")
    plan = inventory.column_dictionary("t", df)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert plan.count("Scan ExistingRDD") == 1 and moved and all("h1" in line or "hashpartitioning(i" in line for line in moved)


def test_sketches_of_loads_merge(spark):
    def load(a, b, name):
        df = spark.range(a, b).selectExpr("id", "id % 7 AS few", "CASE WHEN id % 2 = 0 THEN cast(id AS string) END AS half")
        return inventory.column_sketches("t", df, name)

    loads = load(0, 60_000, "one").unionByName(load(40_000, 100_000, "two")).unionByName(load(0, 0, "empty"))
    got = {r["column_name"]: r for r in inventory.merged_dictionary(loads).collect()}
    assert [got[c]["row_count"] for c in ("id", "half")] == [120_000, 120_000] and got["half"]["null_count"] == 60_000
    for column, n in {"id": 100_000, "few": 7, "half": 50_000}.items():
        assert abs(got[column]["distinct_estimate"] - n) <= inventory.ERROR * n
    assert loads.where("length(sketch) > 10000").count() == 0  # a few kilobytes, whatever the number of values
