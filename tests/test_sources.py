import json

import pytest
from pyspark.sql import functions as F

from weftlink.plans.model import Invalid
from weftlink.sources import csv_source, sinks


def test_csv_reader(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿id,name,phone\n7,"Acme, ""Inc""",1\n,Short\n'.encode())
    got = csv_source.read_csv(spark, str(path), "A").orderBy("row_index").collect()
    assert [(r.row_id, r.name, r.phone) for r in got] == [("7", 'Acme, "Inc"', "1"), ("A-2", "Short", "")]
    (tmp_path / "wide.csv").write_text("id,name\n1,x,y\n")
    with pytest.raises(Invalid):
        csv_source.read_csv(spark, str(tmp_path / "wide.csv"), "A")
    (tmp_path / "twice.csv").write_text("id,id\n1,2\n")
    with pytest.raises(Invalid):
        csv_source.read_csv(spark, str(tmp_path / "twice.csv"), "A")
    (tmp_path / "same.csv").write_text("id,name\n1,a\n1,b\n")
    with pytest.raises(Invalid):
        csv_source.read_csv(spark, str(tmp_path / "same.csv"), "A")


def test_defended_cells(spark):
    values = ["=1+1", "-5", "+1.5", "-1.5e3", ".5", "-5x", "\u200b\uff1d1", "\t@x", "plain", 'a"b', "a,b", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(sinks.cell(F.col("v"))).collect()]
    assert got == ["'=1+1", "-5", "'+1.5", "-1.5e3", ".5", "'-5x", "'\u200b\uff1d1", "'\t@x", "plain", '"a""b"', '"a,b"', ""]


def test_manifest_round_trip():
    files = {"a.csv": b"x", "b.csv": b"yy"}
    text = json.dumps(sinks.manifest(files, {"k": 1}, {}))
    assert sinks.verify(text, files) == []
    assert sinks.verify(text, {"a.csv": b"z"}) == ["hash:a.csv", "missing:b.csv"]
    assert sinks.verify("{", files) == ["manifest_unreadable"]
    assert sinks.safe_filename("../x/My.csv") == "My.csv"
    with pytest.raises(Invalid):
        sinks.safe_filename("x.exe")
    assert sinks.safe_token("run 1/2") == "run-1-2"


def test_content_hash_ignores_order(spark):
    df = spark.range(20).withColumn("x", F.col("id") * 2)
    assert sinks.content_hash(df) == sinks.content_hash(df.orderBy(F.desc("id")).repartition(3))
    assert sinks.content_hash(df) != sinks.content_hash(df.where("id > 0"))
