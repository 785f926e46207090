"""Files by their own headers, and the package on the workers."""

import os
import subprocess
import sys
import textwrap

from barloom.sources import bars as B, dimensions as D

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_each_file_by_its_own_header(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("ts,open,high,low,close,volume\n2024-01-02 09:15:00,1.0,3.0,0.5,2.0,10\n2024-01-02 09:20:00,2.0,3.0,0.5,2.5,x\n")
    (tmp_path / "bbb.csv").write_text("close,low,\"High\",OPEN,note,Volume,DateTime\r\n2.0,0.5,3.0,1.0,\"a,b\",10,2024-01-02 09:15:00\r\nbad,0.5,3.0,1.0,c,10,2024-01-02 09:20:00\r\n")
    (tmp_path / "ccc.csv").write_text("\ufefftimestamp,low,close,open,high\n2024-01-02 09:15:00,0.5,2.0,1.0,3.0\n")
    (tmp_path / "ddd.csv").write_text("what,is,this\n1,2,3\n")
    (tmp_path / "eee.csv").write_text("")
    want = [("AAA", 1.0, 3.0, 0.5, 2.0, 10), ("BBB", 1.0, 3.0, 0.5, 2.0, 10)]
    got = B.read_bars(spark, str(tmp_path), tz="UTC", min_bars=1).select("symbol", "open", "high", "low", "close", "volume")
    assert sorted(map(tuple, got.collect())) == want
    loose = B.read_bars_any(spark, str(tmp_path), min_rows=1).select("symbol", "open", "high", "low", "close", "volume")
    assert sorted(map(tuple, loose.collect())) == [*want, ("CCC", 1.0, 3.0, 0.5, 2.0, 0.0)]


def test_folder_without_any_bar_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    assert B.read_bars(spark, str(tmp_path), tz="UTC").count() == 0


def test_zones_and_gaps_by_name(spark, tmp_path):
    (tmp_path / "z.csv").write_text("ob_low,ob_high,symbol,date,ob_type,ob_time,ob_body_low,ob_body_high\n1,4,aa,2024-01-02,BULL,09:15,2,3\n")
    assert tuple(D.read_zones(spark, str(tmp_path / "z.csv")).select("symbol", "ob_body_high", "ob_body_low", "ob_high", "ob_low").first()) == ("AA", 3.0, 2.0, 4.0, 1.0)
    (tmp_path / "g.csv").write_text("gap_dir,symbol,daily_atr,date,gap_pct,today_open,prev_close\nUP,aa,5,2024-01-02,1.5,101.5,100\n")
    assert tuple(D.read_gaps(spark, str(tmp_path / "g.csv")).select("symbol", "prev_close", "today_open", "gap_pct", "gap_dir", "daily_atr").first()) == ("AA", 100.0, 101.5, 1.5, "UP", 5.0)


def test_workers_find_the_package(tmp_path):
    """Started in another folder, without a PYTHONPATH, a query with an Arrow function runs."""
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        import __spark_entry__ as entry
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        print("ROWS", entry.queries()["w9_adx"](spark, "/root/testdata/sf0.001").count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
