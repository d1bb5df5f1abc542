"""The Merkle manifest against a plain build in memory."""

import collections
import hashlib
import string
import zlib

import duckdb
import pytest

from marketday.llm import merkle
from marketday.llm.common import Scratch

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return h("".join(map(field, (*r[:4], text))))

    def build(hs):
        levels = [hs]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r, leaf(r, r[4])))
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        by[k].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    trees = [build([x[1] for x in by[k]]) for k in keys]
    top = build([t[-1][0] for t in trees])
    out = collections.Counter()
    for j, k in enumerate(keys):
        for i, (r, own) in enumerate(by[k]):
            fold = own
            if None not in (r[0], r[4]) and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                fold = leaf(r, r[4].translate(FOLD))
            siblings = []
            for levels, p in ((trees[j], i), (top, j)):
                for level in levels[:-1]:
                    a = p // 16 * 16
                    left, right = level[a:p], level[p + 1 : a + 16]
                    siblings += left + right
                    fold = h("".join([*left, fold, *right]))
                    p //= 16
            root = top[-1][0]
            out[(r[0], own, trees[j][-1][0], root, h("".join(siblings)), fold, fold == root)] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, tree string, idx int")


def table(sizes):
    rows, i = [], 0
    for source, n in sizes:
        for _ in range(n):
            rows.append((i, source, None if i % 7 == 0 else "en", i, f"Text {i} É" if i % 5 else None, "x", "y", 1))
            i += 1
    return rows


ODD = [(3, "a", None, None, "again A", "x", "y", 1)] * 40 + [(None, "a", "en", 1, "No id", "x", "y", 1), (3, "a", "en", 2, "B", "x", "y", 1), (9, "", "-", 0, "", "x", "y", 1)]


@pytest.mark.parametrize(
    "sizes,more",
    [
        ([("a", 600), ("b", 16), ("c", 17), (None, 1), ("é", 1), ("B", 33)], ODD),  # a hot source, lone leaves, repeated rows
        ([(f"s{k}", 1 + k % 3) for k in range(40)], []),  # more sources than one run of the tree above holds
        ([("only", 5)], []),
        ([("only", 1)], []),
    ],
)
def test_manifest(spark, sizes, more, monkeypatch):
    monkeypatch.setattr(merkle, "PER_COPY", 32)
    rows = table(sizes) + more
    got = collections.Counter(map(tuple, merkle.digest(frame(spark, rows).repartition(3)).collect()))
    assert got == brute([r[:5] for r in rows])


def test_manifest_of_nothing(spark):
    out = merkle.digest(frame(spark, []))
    assert out.columns[:3] == ["doc_id", "leaf", "subroot"] and out.collect() == []


def test_long_text_and_tampering(spark):
    rows = [(i, "s", "en", 1, ("Long " * 400_000) if i == 4 else "abc X", "x", "y", 1) for i in range(20)]
    got = merkle.digest(frame(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == brute([r[:5] for r in rows])
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i in range(20) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "(id * 37) % 101 AS v").repartition(7)
    out = merkle.ranked(df, ["g"], ["v"], "n", Scratch(spark, "ranked"), "one").collect()
    for g in range(3):
        mine = sorted((r["n"], r["v"]) for r in out if r["g"] == g)
        assert [n for n, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_upper_nodes_are_copied_by_their_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PER_COPY", 32)
    docs = frame(spark, table([("a", 600), ("b", 5)]))
    leaves = docs.select("source", "doc_id", merkle.leaf_digest([docs[c] for c in merkle.COLUMNS]).alias("leaf"))
    made = merkle.Manifest(leaves.selectExpr("*", "CAST(NULL AS STRING) AS changed"), Scratch(spark, "copies"))
    root = made.nodes.where("up_tree IS NULL").first()
    assert root["copies"] == 19 and made.nodes.where("copies > 1 AND level = 1").count() == 1  # the root stands at level 1 of its tree
    assert made.nodes.where("up_tree IS NOT NULL AND up_copies IS NULL").count() == 0


def test_manifest_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    out = merkle.digest(docs)
    theirs = con.execute(f"SELECT {', '.join(out.columns)} FROM ({merkle.SQL})").fetchall()
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(theirs)
