import duckdb
import pytest

import __spark_entry__ as entry
from kvlog.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    def plain(x):
        return round(x, 6) if isinstance(x, float) else x

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(str([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "value"]


def test_filters_reach_the_scan(spark, tmp_path):
    events = queries.events_log(spark, SF)
    events.write.parquet(str(tmp_path / "log"))
    from kvlog.operators import visibility

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = visibility.visible(spark.read.parquet(str(tmp_path / "log")), 500, "2", "5")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(user_key,2)" in plan and "LessThanOrEqual(seq,500)" in plan


def test_merges_and_multi_get_take_every_row(spark, tmp_path):
    spark.range(12_345).selectExpr("id as event_id", "id % 50 as user_id", "if(id % 7 = 0, 'error', 'view') as event_type", "string(id) as props").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(50).selectExpr("id as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    ask = lambda name: queries.queries()[name](spark, str(tmp_path)).collect()
    merged = [(r["user_key"], -r["seq"]) for r in ask("mrg01_merged_history")]
    assert len(merged) == 12_345 and merged == sorted(merged)
    after = ask("cmp03_partial_prefix")
    assert sorted(r["seq"] for r in after) == list(range(1, 12_346)) and {r["run_no"] for r in after} == {0, 4, 5, 6, 7}
    assert max(r["seq"] for r in after if r["run_no"] == 0) == 6173
    newest = {e % 50: e for e in range(12_345)}
    assert sorted((r["key"], r["value"]) for r in ask("get08_multi_get")) == sorted((str(u), str(e)) for u, e in newest.items() if e % 7)


def test_live_check_sees_rows_missing_on_either_side(spark, monkeypatch):
    visible = queries.visibility.visible
    gone = visible(queries.events_log(spark, SF)).first()["key"]
    for broken in ("rank", "hash"):
        monkeypatch.setattr(queries.visibility, "visible", lambda log, form="rank": visible(log, form=form).where(f"key <> '{gone}'") if form == broken else visible(log, form=form))
        assert [r["key"] for r in queries.queries()["met12_live_vs_model"](spark, SF).collect()] == [gone]
