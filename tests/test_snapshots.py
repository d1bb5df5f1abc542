"""Tables of versions: one whole version at any moment, whatever ends a run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketday.operators.snapshots import NO_DAY, Overtaken, SnapshotTable

D = dt.date(2024, 3, 10)
SCHEMA = "date date, item string, n bigint"


def day(k):
    return D - dt.timedelta(days=k)


def rows(spark, *triples):
    return spark.createDataFrame(list(triples), SCHEMA)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    made = SnapshotTable(spark, str(tmp_path / "table"), SCHEMA)
    assert content(made.read()) == [] and made.versions() == {}
    assert made.rebuild(rows(spark, (day(9), "a", 1), (day(2), "a", 2), (day(1), "b", 3), (day(1), None, 4), (None, "no day", 5)), None) == 5
    return made


OLD = sorted([(day(9), "a", 1), (day(2), "a", 2), (day(1), "b", 3), (day(1), None, 4), (None, "no day", 5)], key=str)
NEW = sorted([(day(9), "a", 1), (day(1), "new", 7), (day(-1), "later", 8), (None, "no day", 5)], key=str)


def fresh(spark):
    return rows(spark, (day(9), "outside", 6), (day(1), "new", 7), (day(-1), "later", 8))


def test_rebuild_replaces_the_window_and_stale_days_end(spark, table):
    assert content(table.read()) == OLD
    opened = table.read()
    assert table.rebuild(fresh(spark), day(3)) == 2
    assert content(table.read()) == NEW
    assert content(opened) == OLD and content(table.read(version=1)) == OLD  # a reader keeps what it has opened
    assert table.rebuild(fresh(spark), day(3)) == 2 and content(table.read()) == NEW
    assert content(table.read(since=day(1))) == [r for r in NEW if r[0] and r[0] >= day(1)]
    assert day(2).isoformat() not in table.days() and NO_DAY in table.days()


def test_an_empty_window_leaves_no_days(spark, table):
    assert table.rebuild(fresh(spark).limit(0), day(3)) == 0
    assert content(table.read()) == [r for r in OLD if r[0] is None or r[0] < day(3)]
    with pytest.raises(KeyError):
        table.read(version=99)


@pytest.mark.parametrize("where", ["write", "manifest", "commit"])
def test_a_run_that_ends_half_way_leaves_the_old_version(spark, table, monkeypatch, where):
    class Killed(Exception):
        pass

    def killed(*args):
        raise Killed

    create = SnapshotTable._create
    with monkeypatch.context() as m:
        if where == "write":
            m.setattr(SnapshotTable, "commit", killed)
        elif where == "manifest":
            m.setattr(SnapshotTable, "_create", killed)
        else:  # the commit file is there, but its writer did not get to fill it
            m.setattr(SnapshotTable, "_create", lambda self, name, text: create(self, name, text) if name.startswith("manifests") else (create(self, name, ""), killed())[0])
        with pytest.raises(Killed):
            table.rebuild(fresh(spark), day(3))
        assert content(table.read()) == OLD
    assert table.rebuild(fresh(spark), day(3)) == 2
    assert content(table.read()) == NEW


def test_every_state_of_a_rebuild_is_one_whole_version(spark, table, monkeypatch):
    seen = []
    create = SnapshotTable._create

    def watched(self, name, text):
        seen.append(content(table.read()))
        done = create(self, name, text)
        seen.append(content(table.read()))
        return done

    monkeypatch.setattr(SnapshotTable, "_create", watched)
    table.rebuild(fresh(spark), day(3))
    assert seen == [OLD, OLD, OLD, NEW]


def test_runs_on_other_days_go_together_and_on_the_same_days_do_not(spark, table, monkeypatch):
    commit = SnapshotTable.commit

    def meanwhile(other, cutoff):
        def late(self, written, own_cutoff, base):
            monkeypatch.setattr(SnapshotTable, "commit", commit)
            SnapshotTable(spark, table.path, SCHEMA).rebuild(other, cutoff)
            return commit(self, written, own_cutoff, base)

        monkeypatch.setattr(SnapshotTable, "commit", late)

    meanwhile(rows(spark, (day(1), "first", 1)), day(1))
    with pytest.raises(Overtaken):
        table.rebuild(fresh(spark), day(3))
    assert ("first" in [r[1] for r in content(table.read())]) and ("new" not in [r[1] for r in content(table.read())])
    meanwhile(rows(spark, (day(1), "second", 1), (day(9), "older", 2)), day(20))
    with pytest.raises(Overtaken):  # it replaced these days too
        table.rebuild(fresh(spark), day(3))
    meanwhile(rows(spark, (day(-3), "ahead", 1)), day(-2))  # days that the other run's window did not hold before
    with pytest.raises(Overtaken):
        table.rebuild(fresh(spark), day(3))
    meanwhile(rows(spark), day(-5))  # nothing of this window
    table.rebuild(fresh(spark), day(3))
    assert {r[1] for r in content(table.read())} == {"older", "new", "later", "no day"}


def test_expired_versions_go_and_kept_ones_stay(spark, table):
    for k in range(4):
        table.rebuild(rows(spark, (day(1), f"run {k}", k)), day(1))
    before = content(table.read())
    assert table.expire(keep=2) > 0
    assert sorted(table.versions()) == [4, 5]
    assert content(table.read()) == before and ("run 2" in [r[1] for r in content(table.read(version=4))])
    assert table.expire(keep=2) == 0
    assert table.rebuild(rows(spark, (day(0), "next", 9)), day(0)) == 1 and max(table.versions()) == 6


def test_scans_list_only_the_days_asked_for(spark, table):
    table.rebuild(fresh(spark), day(3))
    files = table.read(since=day(1)).select(F.input_file_name()).distinct().collect()
    assert len(files) == 2
    plan = table.read().filter(F.col("date") == F.lit(day(1)))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
