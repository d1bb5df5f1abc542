import datetime as dt
from decimal import Decimal

import pytest

from marketday import session
from marketday.sources import loads, sinks
from marketday.sources.schemas import MART, RAW, names
from marketday.streaming.increment import load_new_csv


def write(folder, name, text, encoding="utf-8"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding) if isinstance(text, str) else text)


ORDER = '1,2,15,7,,3,08:00:00,16:00:00,web,2022-02-01T10:00:00,,USD,10.5000,0.1,,10.6000\n'


def test_all_declared_tables(spark):
    assert len(RAW) == 9 and len(MART) == 4
    assert names(RAW["truck_reviews"]) == ["order_id", "language", "source", "review", "review_id"]


def test_typed_load(spark, tmp_path):
    write(tmp_path / "order_header", "a.csv", ORDER)
    row = loads.load_csv(spark, str(tmp_path / "order_header"), RAW["order_header"]).first()
    assert (row["order_id"], row["location_id"], row["order_total"]) == (1, 15.0, Decimal("10.6000"))
    assert row["order_ts"] == dt.datetime(2022, 2, 1, 10) and row["order_tax_amount"] == "0.1" and row["served_ts"] is None


def test_a_value_of_the_wrong_type_fails_the_load(spark, tmp_path):
    write(tmp_path / "in", "a.csv", ORDER.replace("1,2,15", "one,2,15"))
    with pytest.raises(Exception, match="one|MALFORMED"):
        loads.load_csv(spark, str(tmp_path / "in"), RAW["order_header"]).collect()


def test_json_in_a_quoted_field(spark, tmp_path):
    write(tmp_path / "in", "a.csv", '1,"{""k"": ""a,b"", ""n"": 3}"\n2,oops\n')
    df = loads.with_variant(loads.load_csv(spark, str(tmp_path / "in"), "id int, obj string"), "obj")
    got = df.selectExpr("id", "variant_get(obj, '$.k', 'string') AS k", "variant_get(obj, '$.n', 'int') AS n").collect()
    assert sorted(map(tuple, got)) == [(1, "a,b", 3), (2, None, None)]


def test_raw_tables_stored_and_opened(spark, tmp_path):
    for name in RAW:
        write(tmp_path / "csv" / name, "a.csv", "")
    write(tmp_path / "csv" / "order_header", "a.csv", ORDER)
    loads.store_raw(loads.load_raw(spark, str(tmp_path / "csv")), str(tmp_path / "raw"))
    opened = loads.open_raw(spark, str(tmp_path / "raw"))
    assert opened["order_header"].count() == 1 and opened["menu"].columns == names(RAW["menu"])


def test_a_run_takes_only_new_files(spark, tmp_path):
    folder, table, state = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "s")
    write(tmp_path / "in", "a.csv", "1,x\n2,y\n")
    assert load_new_csv(spark, folder, "id int, v string", table, state) == 2
    assert load_new_csv(spark, folder, "id int, v string", table, state) == 0
    write(tmp_path / "in", "b.csv", "3,z\n")
    assert load_new_csv(spark, folder, "id int, v string", table, state) == 1
    assert sorted(map(tuple, spark.read.parquet(table).collect())) == [(1, "x"), (2, "y"), (3, "z")]


def test_all_rows_of_many_batches_are_counted(spark, tmp_path):
    folder, table, state = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "s")
    for i in range(104):  # a query's progress keeps a hundred batches
        write(tmp_path / "in", f"{i}.csv", f"{i},x\n")
    assert load_new_csv(spark, folder, "id int, v string", table, state, maxFilesPerTrigger="1") == 104


def test_relations_keep_every_field_as_text(spark, tmp_path):
    write(tmp_path, "rel.csv", 'from,to,n\na,"b, ""c""",007\n')
    df = loads.load_relations(spark, str(tmp_path / "rel.csv"))
    assert df.columns == ["from", "to", "n"] and tuple(df.first()) == ("a", 'b, "c"', "007")


def test_whole_files_with_broken_bytes(spark, tmp_path):
    write(tmp_path / "code", "a.sql", "select 1\nfrom t\n")
    write(tmp_path / "code" / "deep", "b.py", b"caf\xff = 1")
    got = {r["name"]: r["content"] for r in loads.load_files(spark, str(tmp_path / "code")).collect()}
    assert got == {"a.sql": "select 1\nfrom t\n", "b.py": "caf� = 1"}


def test_list_files_does_not_read_contents(spark, tmp_path):
    write(tmp_path / "d" / "x", "a.bin", b"12345")
    df = loads.list_files(spark, str(tmp_path / "d"))
    assert [(r["path"].endswith("/x/a.bin"), r["length"]) for r in df.collect()] == [(True, 5)]
    assert "content" not in df.columns


def test_export_keeps_quotes_and_line_breaks_out_of_trouble(spark, tmp_path):
    rows = [("t", 'say "x", y', "", "a, b")]
    df = spark.createDataFrame(rows, "Table string, Column string, Definition string, Synonyms string")
    sinks.export_csv(df, str(tmp_path / "out"))
    back = loads.load_relations(spark, str(tmp_path / "out")).first()
    assert tuple(back)[:2] == ("t", 'say "x", y') and back["Synonyms"] == "a, b"


def test_replace_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.range(2), path)
    sinks.append_rows(spark.range(5), path)
    assert spark.read.parquet(path).count() == 7


class Session:
    """As much of a session as the folder lookup needs: that setting is fixed at launch."""

    def __init__(self, master, settings):
        self.settings, self.sparkContext, self.conf, self.master = settings, self, self, master

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.settings.get(key, default)

    def getCheckpointDir(self):
        return None


def test_shared_folder_is_the_named_one():
    named = Session("spark://cluster:7077", {"spark.checkpoint.dir": "hdfs://shared/x"})
    assert session.shared_dir(named) == "hdfs://shared/x"
    assert session.scratch_path(named, "part").startswith("hdfs://shared/x/part-")
    assert session.scratch_path(named, "part") != session.scratch_path(named, "part")


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("yarn", {}))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("local[4]", {}))


def test_documents_read_whole_come_in_bounded_files(spark, sf_dir, tmp_path, monkeypatch):
    from marketday.registry import io

    monkeypatch.setattr(io, "scratch_path", lambda *_: str(tmp_path / "files"))
    monkeypatch.setattr(io, "FILE_ROWS", 5, raising=False)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert [tuple(r) for r in io.src_whole_files(spark, sf_dir).collect()] == [("SQL", sum(len(r["text"]) + 1 for r in docs), len({r["doc_id"] % 8 for r in docs}))]
    longest = max(len(r["text"].encode()) + 1 for r in docs)
    assert all(f.stat().st_size <= 5 * longest for f in (tmp_path / "files").rglob("*.txt"))
    assert sum(1 for _ in (tmp_path / "files").rglob("*.txt")) >= len(docs) / 5


def test_latest_order_day_is_registered(spark, sf_dir):
    import __spark_entry__

    newest = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(max(o_orderdate) AS date)").first()[0]
    assert [str(r["as_of"]) for r in __spark_entry__.queries()["latest_order_day"](spark, sf_dir).collect()] == [str(newest)]
