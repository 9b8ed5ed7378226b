import pytest

from candlewick.plans.workflows import describe, load_prices
from candlewick.sources import sinks
from candlewick.sources.csv import scan_banner_csv, scan_csv
from helpers import SCHEMA, random_prices

NUMBERS = {"col1": "bigint", "col2": "bigint"}


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8-sig")


@pytest.fixture()
def two_files(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    write(raw, "file1.csv", "Introdução\ncol1,col2\n1,2\n3,4")
    write(raw, "file 2é.csv", "Introdução\ncol1,col2\n5,6\n7,8")
    (raw / "notes.txt").write_text("Introdução\ncol1,col2\n9,9")
    (raw / "deeper").mkdir()
    write(raw / "deeper", "file3.csv", "x\ncol1,col2\n9,9")
    return raw


def test_bannered_files_combine(spark, two_files):
    got = scan_banner_csv(spark, str(two_files), NUMBERS)
    assert sorted(map(tuple, got.collect())) == [(1, 2), (3, 4), (5, 6), (7, 8)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_load_creates_the_target(spark, two_files, tmp_path, fmt):
    target = str(tmp_path / "processed" / "combined")
    load_prices(spark, str(two_files), target, NUMBERS, fmt)
    read = spark.read.parquet(target) if fmt == "parquet" else scan_csv(spark, target, "col1 long, col2 long")
    assert read.count() == 4
    load_prices(spark, str(two_files), target, NUMBERS, fmt)
    assert (spark.read.parquet(target) if fmt == "parquet" else scan_csv(spark, target, "col1 long, col2 long")).count() == 4


def test_empty_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_banner_csv(spark, str(tmp_path))


def test_missing_csv(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_csv(spark, str(tmp_path / "none.csv"), "a int").count()


def test_write_failure_reaches_the_caller(spark, two_files, monkeypatch):
    def refuse(*_):
        raise PermissionError("no")

    monkeypatch.setattr("candlewick.plans.workflows.write_combined", refuse)
    with pytest.raises(PermissionError):
        load_prices(spark, str(two_files), "unused")


def test_volume_column_and_differing_layouts(spark, tmp_path):
    head = "unix,date,symbol,open,high,low,close"
    write(tmp_path, "a.csv", f"site\n{head},Volume BTC,trades\n1,2024-01-01,BTC/USDT,1,2,0.5,1.5,10,7\n")
    write(tmp_path, "b.csv", f"site\n{head},Volume ETH\n2,2024-01-02 00:00:00,ETH/USDT,1,2,0.5,bad,20\n")
    write(tmp_path, "c.csv", "site\ndate,symbol,close\n2024-01-03,XRP/USDT,0.5\n")
    got = {r["symbol"]: r for r in scan_banner_csv(spark, str(tmp_path)).collect()}
    assert got["BTC/USDT"]["Volume"] == 10.0 and got["ETH/USDT"]["Volume"] == 20.0
    assert got["BTC/USDT"]["trades"] == "7" and got["ETH/USDT"]["trades"] is None
    assert got["ETH/USDT"]["close"] is None and got["XRP/USDT"]["Volume"] is None
    assert got["BTC/USDT"]["date"].isoformat() == "2024-01-01T00:00:00"


def test_result_sink_replaces_only_its_symbols(spark, tmp_path):
    path = str(tmp_path / "results")
    both = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, v int")
    sinks.write_results(both, path)
    sinks.write_results(spark.createDataFrame([("A", 10)], "symbol string, v int"), path)
    assert sorted(spark.read.parquet(path).select("symbol", "v").collect()) == [("A", 10), ("B", 2)]
    sinks.write_results(both, path, append=True)
    assert spark.read.parquet(path).count() == 4


def test_fixed_decimals_and_report_files(spark, tmp_path):
    sinks.write_fixed_csv(spark.createDataFrame([("a", 1.0)], "s string, d double"), str(tmp_path / "f"))
    lines = {line for p in (tmp_path / "f").glob("*.csv") for line in p.read_text().split()}
    assert lines == {"s,d", "a,1.00"}
    lines = spark.createDataFrame(
        [(2, 0, 0, "end"), (1, 1, 1, "b"), (1, 1, 0, "a")], "section int, item long, part int, line string"
    )
    sinks.write_report(lines, str(tmp_path / "r"))
    parts = sorted((tmp_path / "r").glob("*.txt"))
    assert "".join(p.read_text() for p in parts) == "a\nb\nend\n"


def test_describe_gives_every_table(spark):
    prices = spark.createDataFrame(random_prices([40, 30]), SCHEMA)
    tables = describe(prices)
    assert all(t.count() > 0 for t in tables.values())
    assert describe(prices, ["S1"])["summary_statistics"].count() == 1


def test_twenty_layouts_in_one_scan(spark, tmp_path):
    want = {}
    for n in range(20):
        extra = [f"x{n}"] * (n % 3)  # repeated names are numbered
        names = ["symbol", "close", *extra] if n % 2 else ["close", *extra, "symbol"]
        for copy in range(2):
            symbol = f"S{n}_{copy}"
            cells = {"symbol": symbol, "close": str(n + copy)}
            row = [cells.get(c, f"{c},{i}") for i, c in enumerate(names)]
            line = ",".join(f'"{v}"' for v in row)
            banner = "" if copy else line  # a blank banner, and one that looks like a row
            write(tmp_path, f"{n:02d} {copy}.csv", f"{banner}\n{','.join(names)}\n{line}\n{line}\n")
            want[symbol] = float(n + copy), [v for v in row if "," in v]
    write(tmp_path, "empty.csv", "")
    write(tmp_path, "only a banner.csv", "site\n")
    got = scan_banner_csv(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "Python" not in plan and "Union" not in plan
    rows = got.collect()
    assert len(rows) == 80 and {r["symbol"] for r in rows} == set(want)
    for r in rows:
        close, extra = want[r["symbol"]]
        assert r["close"] == close
        assert [v for c, v in r.asDict().items() if c[0] == "x" and v is not None] == extra


def test_large_files_in_many_splits(spark, tmp_path):
    body = "".join(f"S{i % 7},{i}.5\n" for i in range(20_000))
    write(tmp_path, "a.csv", f"site\n\nsymbol,close\n{body}")
    write(tmp_path, "b.csv", "site\nclose,symbol,note\n1,B,z\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        got = scan_banner_csv(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        assert got.count() == 20_001
        assert got.where("symbol = 'B'").first()["note"] == "z"
        assert got.agg({"close": "sum"}).first()[0] == sum(i + 0.5 for i in range(20_000)) + 1
    finally:
        spark.conf.set(key, before)


def test_files_without_header_only(spark, tmp_path):
    write(tmp_path, "a.csv", "site\n\n")
    with pytest.raises(ValueError):
        scan_banner_csv(spark, str(tmp_path))


def test_blank_lines_nan_and_odd_line_ends(spark, tmp_path):
    write(tmp_path, "a.csv", "site\n\n \nsymbol,close,note\nA,1.5,x y\n\nB,NaN,z\n")
    write(tmp_path, "b.csv", "site\r\nsymbol,close\r\nC,2\r\n")
    got = {r["symbol"]: (r["close"], r["note"]) for r in scan_banner_csv(spark, str(tmp_path)).collect()}
    assert got == {"A": (1.5, "x y"), "B": (None, "z"), "C": (2.0, None)}


def test_repeated_runs_leave_each_row_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    schema = "symbol string, v int"
    first = spark.createDataFrame([("A", 1), ("B", 2), ("B", 2), ("007", 7), (None, 0)], schema)
    second = spark.createDataFrame([("A", 10), ("A", 11)], schema)
    for run, rows in [("20240101", first), ("20240102", second), ("20240101", first), ("20240102", second)]:
        sinks.append_run(rows, path, run)
    rows = sinks.read_runs(spark, path).select("run", "symbol", "v").collect()
    assert len(rows) == 7
    latest = sinks.latest_runs(spark, path).select("symbol", "v").collect()
    key = lambda r: (r[0] or "", r[1])
    want = [(None, 0), ("007", 7), ("A", 10), ("A", 11), ("B", 2), ("B", 2)]
    assert sorted(map(tuple, latest), key=key) == want
    with pytest.raises(ValueError):
        sinks.append_run(first, path, "")


def test_failed_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "runs")
    good = spark.createDataFrame([("A", 1), ("B", 2)], "symbol string, v int")
    sinks.append_run(good, path, "r1")
    broken = good.selectExpr("symbol", "if(symbol = 'B', raise_error('lost'), v + 1) AS v")
    with pytest.raises(Exception, match="lost"):
        sinks.append_run(broken, path, "r1")
    assert sorted(map(tuple, sinks.latest_runs(spark, path).select("symbol", "v").collect())) == [("A", 1), ("B", 2)]
    sinks.append_run(good, path, "r1")
    assert sinks.read_runs(spark, path).count() == 2
