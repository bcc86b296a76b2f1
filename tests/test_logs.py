"""K16, S12, K1b."""

import logging
import os
import subprocess
import sys

import pandas as pd
from pyspark.sql import functions as F

from rinkframe import logs


def test_the_log_rotates_and_tells(tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "BYTES", 2000)
    path, log, told = logs.set_up(f"{tmp_path}/logs"), logging.getLogger(logs.LOGGER), []
    assert logs.set_up(f"{tmp_path}/logs") == path
    end = logs.listen(lambda level, text: told.append((level, text)))
    log.debug("not in the file")
    for i in range(200):
        log.info("line %d é", i)
    end()
    log.warning("nobody hears this")
    for h in list(log.handlers):
        log.removeHandler(h)
    assert told[0] == (logging.INFO, "line 0 é") and len(told) == 200
    names = sorted(os.listdir(f"{tmp_path}/logs"))
    assert names == ["app.log", *(f"app.log.{k}" for k in range(1, 6))]
    text = "".join(open(f"{tmp_path}/logs/{n}", encoding="utf-8").read() for n in names)
    assert "not in the file" not in text and "line 199 é" in text and "nobody hears this" in text


def test_resources_reach_workers(spark, tmp_path):
    with open(f"{tmp_path}/weights-of-test.txt", "w") as f:
        f.write("7")
    name = logs.ship_resource(spark, f"{tmp_path}/weights-of-test.txt")

    @F.pandas_udf("string")
    def read(x: pd.Series) -> pd.Series:
        from pyspark import SparkFiles

        return x.map(lambda _: open(SparkFiles.get(name)).read())

    assert [r[0] for r in spark.range(2).select(read("id")).collect()] == ["7", "7"]
    assert open(logs.resource(name)).read() == "7" and logs.resource("missing.txt", __file__) == os.path.join(os.path.dirname(os.path.abspath(__file__)), "missing.txt")


def test_tables_from_the_command_line(spark, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-m", "rinkframe.schemas", f"{tmp_path}/db", "--mixed"], cwd=root, check=True, capture_output=True, timeout=120)
    assert sorted(os.listdir(f"{tmp_path}/db")) == ["ends", "events", "games", "shots", "stones"] and "is_power_play" in spark.read.parquet(f"{tmp_path}/db/ends").columns
