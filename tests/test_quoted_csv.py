import csv
import tempfile

import numpy as np
import pandas as pd
import pytest

from tessera.sources.quoted_csv import read_quoted_csv, records
from tessera.sources.readers import read_table

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def splits(spark):
    """Files are cut every 700 bytes."""
    before = spark.conf.get(SPLIT), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(SPLIT, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield 700
    spark.conf.set(SPLIT, before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def texts(rng, n):
    words = ["plain", "a,b", 'says "hi"', "two\nlines", "three\n\n\nlines", "\n", '"\n"', "dos\r\nbreak", "ünï", "x" * 40, '""', "long\n" * 700]
    return [" ".join(rng.choice(words[:-1], rng.integers(1, 6))) if i != n // 2 else words[-1] for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_equal_pandas(spark, splits, end):
    rng = np.random.default_rng(len(end))
    folder = tempfile.mkdtemp(prefix="tessera-csv-", dir="/tmp")
    for part in range(2):
        with open(f"{folder}/part{part}.csv", "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["id", "two\nline name", "n"])
            out.writerows((part * 1000 + i, t, rng.integers(0, 9)) for i, t in enumerate(texts(rng, 300)))
    got = read_quoted_csv(spark, folder)
    assert got.columns == ["id", "two\nline name", "n"]
    want = pd.concat([pd.read_csv(f"{folder}/part{p}.csv", dtype=str, keep_default_na=False, lineterminator=None) for p in range(2)])
    have = got.toPandas().fillna("").sort_values("id", key=lambda s: s.astype(int))
    assert len(have) == 600 and list(have["id"]) == list(want["id"]) and list(have["n"]) == list(want["n"])
    assert list(have["two\nline name"]) == list(want["two\nline name"])
    assert spark.read.text(folder).rdd.getNumPartitions() > 20
    typed = read_table(spark, folder, fmt="csv", multi_line="split")
    assert dict(typed.dtypes)["id"] == "bigint" and typed.count() == 600


def test_open_ends_blank_lines_and_nothing(spark, splits):
    folder = tempfile.mkdtemp(prefix="tessera-csv-", dir="/tmp")
    with open(f"{folder}/a.csv", "w") as f:
        f.write('﻿a,b\n\n1,"x\n\ny"\n\n2,"open\nend')
    assert sorted(r["record"] for r in records(spark, f"{folder}/a.csv").collect()) == ['1,"x\n\ny"', '2,"open\nend', "a,b"]  # no byte order mark
    got = read_quoted_csv(spark, f"{folder}/a.csv")
    assert got.columns == ["a", "b"] and got.where("a = '1'").first()["b"] == "x\n\ny"
    open(f"{folder}/b.csv", "w").close()
    assert read_quoted_csv(spark, f"{folder}/b.csv").count() == 0
    with open(f"{folder}/c.csv", "w") as f:
        f.write("a,b\n")
    none = read_quoted_csv(spark, f"{folder}/c.csv")
    assert none.columns == ["a", "b"] and none.count() == 0
