"""Written tables: pruned and exchange-free plans, upsert, retention, replacement, binary bars."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import factors as fx
from tapeloom.plans import registry
from tapeloom.sources import binary, lake
from tapeloom.sources import market as m

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_windows_by_code_need_no_exchange(spark):
    assert "Exchange" not in plan(fx.enriched(m.bars(spark, DATA)).select(fx.FACTORS["f12_pv_divergence_20d"][0]()))
    assert "Exchange" not in plan(registry.queries()["s15_latest_dates"](spark, DATA))


def test_dates_and_codes_prune_the_scan(spark):
    text = plan(registry.queries()["s01_symbol_scan"](spark, DATA))
    assert "PartitionFilters: [isnotnull(year" in text and "year=1997, ... 1 entries" in text
    assert "GreaterThanOrEqual(date,1997-01-01)" in text and "EqualTo(code,7)" in text
    assert "high" not in text.split("ReadSchema")[1].split("\n")[0]


def test_a_changed_input_is_rolled_up_again(spark, tmp_path):
    line = spark.read.parquet(f"{DATA}/lineitem.parquet")
    line.where("l_suppkey = 1").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert m.bars(spark, str(tmp_path)).select("code").distinct().count() == 1
    line.where("l_suppkey IN (1, 2)").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert m.bars(spark, str(tmp_path)).select("code").distinct().count() == 2


def test_a_cleared_table_is_written_again(spark):
    make = lambda: spark.createDataFrame([(1, 1), (2, 1)], "id long, part int")
    t, first = lake.of_inputs(spark, "cleared", DATA, ("region",), ("id",), "part", "id", make)
    assert first.count() == 2 and lake.of_inputs(spark, "cleared", DATA, ("region",), ("id",), "part", "id", None)[1].count() == 2
    fs, p = lake._fs(spark, t.location(spark))
    fs.delete(p, True)
    assert lake.of_inputs(spark, "cleared", DATA, ("region",), ("id",), "part", "id", make)[1].count() == 2


@pytest.fixture
def table(spark):
    t = lake.Table(f"t_{np.random.default_rng().integers(1 << 60)}", ("id",), "part", "id")
    t.create(spark.createDataFrame([(i, i % 3, f"v{i}") for i in range(30)], "id long, part int, v string"))
    return t


def files(spark, t, part):
    return {line for line in lake.state_of(spark, t.location(spark)).split("\n") if f"/part={part}/" in line}


def test_merge_twice_is_merge_once(spark, table):
    batch = spark.createDataFrame([(1, 1, "new"), (4, 1, "a"), (100, 1, "more")], "id long, part int, v string")
    before = files(spark, table, 0), files(spark, table, 2)
    assert table.merge(batch) == [1]
    once = sorted(map(tuple, table.read(spark).select("id", "part", "v").collect()))
    table.merge(batch)
    assert sorted(map(tuple, table.read(spark).select("id", "part", "v").collect())) == once
    assert (1, 1, "new") in once and (100, 1, "more") in once and len(once) == 31
    assert (files(spark, table, 0), files(spark, table, 2)) == before


def test_merge_takes_the_last_of_equal_keys_and_moves_rows(spark, table):
    batch = spark.createDataFrame([(3, 2, "first", 1), (3, 2, "last", 2)], "id long, part int, v string, seq int")
    assert table.merge(batch, F.col("seq")) == [0, 2]
    assert [tuple(r) for r in table.read(spark).where("id = 3").select("part", "v").collect()] == [(2, "last")]
    assert table.merge(batch.limit(0), F.col("seq")) == []
    everything = table.read(spark).where("part = 1").withColumn("part", F.lit(0))
    table.merge(everything)
    assert table.read(spark).where("part = 1").count() == 0 and table.read(spark).count() == 30


def test_merged_tables_keep_their_buckets(spark, table):
    table.merge(spark.createDataFrame([(1, 1, "new")], "id long, part int, v string"))
    assert "Exchange" not in plan(table.read(spark).groupBy("id").agg(F.max("v")))


def test_retention(spark):
    t = lake.Table(f"t_{np.random.default_rng().integers(1 << 60)}", ("id",), "day", "id")
    rows = [(i, dt.datetime(2024, 1, 1 + i // 4, 6 * (i % 4))) for i in range(40)]
    t.create(spark.createDataFrame(rows, "id long, ts timestamp_ntz").withColumn("day", F.dayofmonth("ts")))
    kept = files(spark, lake.Table(t.name, t.key, "part", "id"), 9), {x for x in lake.state_of(spark, t.location(spark)).split("\n") if "/day=9/" in x}
    assert t.delete_before(spark, "ts", F.lit(dt.datetime(2024, 1, 5, 12)).cast("timestamp_ntz"), F.dayofmonth) == [1, 2, 3, 4]
    left = {r.ts for r in t.read(spark).collect()}
    assert left == {ts for _, ts in rows if ts >= dt.datetime(2024, 1, 5, 12)}
    assert {x for x in lake.state_of(spark, t.location(spark)).split("\n") if "/day=9/" in x} == kept[1]


def test_replace_reads_what_it_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    lake.replace_atomically(spark.range(5), path)
    lake.replace_atomically(spark.read.parquet(path).where("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


# binary bars
def records(*rows):
    return np.array(list(rows), binary.DAILY).tobytes()


def test_binary_scales_torn_tails_and_bad_dates(spark, tmp_path):
    body = records((19990104, 1234, 1300, 1200, 1250, 5.5, 7, 0), (19991340, 1, 1, 1, 1, 1, 1, 0), (19990105, 2000, 2000, 2000, 2000, 1, 1, 0))
    for name in ("sh600000.day", "sz110001.day", "512000.day", "sh900001.x.day"):
        (tmp_path / name).write_bytes(body + b"torn")
    got = {(r.symbol, str(r.date)): r.open for r in binary.read_bars(spark, str(tmp_path)).collect()}
    assert got == {(s, day): x / scale for s, scale in (("sh600000", 100), ("sz110001", 10000), ("512000", 1000), ("sh900001", 1000)) for day, x in (("1999-01-04", 1234), ("1999-01-05", 2000))}


def test_binary_dates_are_looked_up(spark, tmp_path, monkeypatch):
    first = dt.date(1990, 1, 1)
    days = [first + dt.timedelta(i) for i in range(3000)]
    (tmp_path / "a.day").write_bytes(records(*((binary.packed(d, "daily"), i, i, i, i, i, i, 0) for i, d in enumerate(days))))
    monkeypatch.setattr(binary, "SPLIT", 32 * 1000)
    reader = binary.BarReader(str(tmp_path), "daily")
    list(reader.pushFilters([binary.GreaterThanOrEqual(("date",), dt.date(1994, 1, 1)), binary.LessThan(("date",), dt.date(1994, 2, 1))]))
    splits = reader.partitions()
    assert [(s.start, s.end) for s in splits] == [(0, 32000), (32000, 64000), (64000, 96000)]
    rows = [b.num_rows for s in splits for b in reader.read(s)]
    assert sum(rows) == 32 and len(rows) == 1  # the bound is kept, Spark tests the strict one
    df = binary.read_bars(spark, str(tmp_path)).where("date >= DATE '1994-01-01' AND date < DATE '1994-02-01'")
    assert df.count() == 31


def test_binary_of_nothing(spark, tmp_path):
    empty = binary.read_bars(spark, str(tmp_path))
    assert empty.count() == 0
    binary.write_bars(empty, f"{tmp_path}/again")
    assert binary.read_bars(spark, f"{tmp_path}/again").count() == 0


def test_probed_symbols_that_numbers_share(spark, tmp_path):
    """100000 and 1000000 to 1000009 have one symbol by the SQL's lpad, which leaves open whose counts: here the number's own, else the least one's."""
    part = [100000, 1000000, 1000006]
    line = [(k, float(q)) for k, q in ((1000001, 7), (100000, 3), (100000, 4), (1000006, 5))]
    spark.createDataFrame([(k,) for k in part], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(line, "l_partkey long, l_quantity double").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    from tapeloom.plans import registry

    got = sorted(map(tuple, registry.queries()["s05_probe_suffixes"](spark, str(tmp_path)).collect()))
    assert got == [(100000, "100000.SH", 2, 7.0), (1000000, "100000.SH", 2, 7.0), (1000006, "100000.SH", 1, 5.0)]


def test_bars_have_one_exchange(spark, monkeypatch):
    """Trades are dealt once, by code and into the table's buckets: rolled up and written without another exchange; more input makes more buckets."""
    from tapeloom.sources import market as m

    plan = m.ohlcv(m.ticks(spark, DATA, 7), "code", "date")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(lake, "BUCKET_BYTES", 1000)
    path = f"{DATA}/lineitem.parquet"
    assert lake.buckets_of(spark, [path]) >= 10 * lake.buckets_of(spark, [f"{DATA}/region.parquet"])
    written = []
    monkeypatch.setattr(lake.Table, "create", lambda self, df, buckets=None, dealt=False: written.append((df, buckets, dealt)) or df)
    monkeypatch.setattr(lake.Table, "whole", lambda self, spark: False)
    m.written_bars(spark, DATA)
    ((df, buckets, dealt),) = written
    assert dealt and df.rdd.getNumPartitions() == buckets


def test_binary_files_of_many_symbols_share_splits_and_folders(spark, tmp_path, monkeypatch):
    """Tasks, and what the driver lists, follow records and not symbols; a file larger than a split is still cut."""
    rows = [(f"s{i:04}", dt.date(2020, 1, 1) + dt.timedelta(j), 1.0 * i, 2.0, 0.5, 1.5, 3.0, j, 0) for i in range(1200) for j in range(3 if i else 5000)]
    df = spark.createDataFrame(rows, binary.SCHEMAS["daily"])
    binary.write_bars(df.coalesce(1), f"file://{tmp_path}/t")
    read = binary.read_bars(spark, f"file://{tmp_path}/t")
    folders = [p for p in (tmp_path / "t").iterdir() if p.is_dir()]
    assert len(list((tmp_path / "t").rglob("*.day"))) == 1200 and len(folders) < 20 and read.rdd.getNumPartitions() == len(folders)
    assert sorted(map(tuple, read.select("symbol", "date", "open", "volume").collect())) == sorted((r[0], r[1], r[2], r[7]) for r in rows)
    few = read.where("date = DATE '2020-01-02'")
    assert few.count() == 1200 and {r.volume for r in few.collect()} == {1}
    plain = tmp_path / "plain"
    plain.mkdir()
    for p in (tmp_path / "t").rglob("*.day"):
        p.rename(plain / p.name)
    monkeypatch.setattr(binary, "SPLIT", 32 * 1500)
    reader = binary.BarReader(str(plain), "daily")
    splits = reader.partitions()
    assert len(splits) < 20 and sum(b.num_rows for s in splits for b in reader.read(s)) == len(rows)
