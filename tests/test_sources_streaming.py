import tempfile

from pyspark.sql import functions as F

from tessera.sources.readers import read_table
from tessera.sources.writers import write_csv
from tessera.streaming.profile_stream import running_profile


def test_csv_roundtrip_with_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-", dir="/tmp")
    path = f"{d}/weather.csv"
    with open(path, "w") as f:
        f.write("Date,Temperature,Humidity,WeatherType,Flag\n")
        f.write("2023-01-01,25.5,NA,Sunny,True\n2023-01-02,N/A,61,Rainy,False\n2023-01-03,22.0,59,,true\n")
    df = read_table(spark, path)
    types = dict(df.dtypes)
    assert types["Temperature"] == "double" and types["Humidity"] == "bigint"
    assert types["Date"] == "date" and types["Flag"] == "boolean" and types["WeatherType"] == "string"
    assert df.where(F.col("Temperature").isNull()).count() == 1
    assert df.where(F.col("WeatherType").isNull()).count() == 1
    out = f"{d}/out"
    write_csv(df, out)
    assert read_table(spark, out, fmt="csv").count() == 3


def test_running_profile_stream(spark, lineitem):
    d = tempfile.mkdtemp(prefix="tessera-stream-", dir="/tmp")
    lineitem.select("l_quantity", "l_discount").write.parquet(f"{d}/in")
    stream = spark.readStream.schema("l_quantity double, l_discount double").parquet(f"{d}/in")
    q = (running_profile(stream).writeStream.outputMode("complete").format("memory")
         .queryName("prof_test").option("checkpointLocation", f"{d}/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = {r["column"]: r for r in spark.sql("select * from prof_test").collect()}
    assert got["l_quantity"]["rows"] == lineitem.count()
