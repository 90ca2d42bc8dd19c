"""Readers and writers against small files."""

import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from geopanel.sources import archives, grids, pages, posts, regions


def record(text="hello|world", user="bob|x", fields=17, **other):
    row = [f"f{i}" for i in range(17)]
    row[0], row[3], row[7], row[9], row[10], row[11], row[16] = text, "1", user, "1", "40.7", "-111.9", "t"
    return "\t".join(row[:fields])


def parsed(spark, records):
    raw = spark.createDataFrame([(r,) for r in records], "value string")
    return posts.parse_posts(raw), raw


def test_parse_cases(spark):
    good, raw = parsed(
        spark,
        [record(), record('a\nb {"k":"v\tw"}'), record(fields=16), "no tabs {x}", record("{a:{b}}")],
    )
    rows = good.collect()
    assert [r["text"] for r in rows] == ["hello,world", "a\nb ", "}"]
    assert rows[0]["username"] == "bob,x" and rows[0]["coordinates"] == "40.7 -111.9"
    counts = {r["n_fields"]: (r["records"], r["accepted"]) for r in posts.parse_rejects(raw).collect()}
    assert counts == {17: (3, True), 16: (1, False), 1: (1, False)}


def test_raw_dump_round(spark, tmp_path):
    path = tmp_path / "dump.txt"
    path.write_text(record("two\nlines") + "\t1\n" + record("x") + "\t1\n" + record("tail") + "\t1")
    rows = posts.parse_posts(posts.read_raw_posts(spark, str(path))).collect()
    # the last record keeps its end mark without a line feed: 18 fields
    assert sorted(r["text"] for r in rows) == ["two\nlines", "x"]


def test_delimited_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi"\nthere', 1.5), ("2", "a|b", None)]
    schema = T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("v", T.DoubleType())]
    )
    df = spark.createDataFrame(rows, schema)
    posts.write_delimited(df, str(tmp_path / "out"))
    back = posts.read_delimited(spark, str(tmp_path / "out"), schema)
    assert sorted(map(tuple, back.collect())) == rows


def test_saved_table_prunes_partitions(spark, tmp_path):
    df = spark.range(100).withColumn("date", F.concat(F.lit("d"), (F.col("id") % 3).cast("string")))
    posts.write_table(df, str(tmp_path / "t"), ["date"])
    back = posts.read_table(spark, str(tmp_path / "t"))
    assert back.where("date = 'd1'").count() == 33 and back.count() == 100


def test_id_archives(spark, tmp_path):
    sub = tmp_path / "a" / "b"
    sub.mkdir(parents=True)
    with zipfile.ZipFile(sub / "x.zip", "w") as z:
        z.writestr("x_ID.txt", "11\n12  \n")
        z.writestr("readme.md", "13\n")
    rows = archives.read_id_archives(spark, str(tmp_path)).collect()
    assert sorted((r["file"], r["id"]) for r in rows) == [("x_ID.txt", "11"), ("x_ID.txt", "12")]


def test_batches_of_one_big_file(spark):
    ids = spark.range(0, 2500, 10).select(F.lit("f").alias("file"), F.col("id"))
    sizes = archives.batch_ids(ids, "file", "id", slice_width=64).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in sizes] == [(0, 100), (1, 100), (2, 50)]


def test_coverage(spark):
    ids = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "file string, id long")
    known = spark.createDataFrame([(1,), (1,), (3,)], "id long")
    got = {r["file"]: (r["found"], r["total"], r["ratio"]) for r in archives.coverage_report(ids, known, "file", "id").collect()}
    assert got == {"f": (1, 2, 0.5), "g": (1, 1, 1.0)}


PAGE = """<article><span class="n">Ann</span><span>x @ann</span><time datetime="2015-07-05T01:02:03Z">5 Jul</time>
<a href="/places/1"><span>Ogden, UT</span></a><div lang="en" data-testid="tweetText">Hello <b>you</b></div>
<img alt="sun" src="s.png"><img src="t.png" alt="sea"></article>"""


def test_page_fields(spark):
    stored = spark.createDataFrame([(1, PAGE), (2, PAGE.replace("datetime", "dt"))], "page_id long, html string")
    rows = pages.extract_post_fields(stored, keep=["page_id"]).collect()
    assert [tuple(r) for r in rows] == [(1, "Ann", "x @ann", "2015-07-05T01:02:03Z", "Ogden, UT", "Hello yousunsea")]


def test_search(spark):
    rows = spark.createDataFrame(
        [(1, "weather now", "2015-12-20", 40.85, -111.9), (2, "weather", "2015-12-21", 40.85, -111.9),
         (3, "weather old", "2015-12-01", 40.85, -111.9), (4, "weather far", "2015-12-19", 42.0, -111.9)],
        "id int, text string, timestamp string, lat double, lon double",
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    found = pages.search_posts(rows, "weather", until="2015-12-21", within=(40.768612, -111.906879, 10.0))
    assert [r["id"] for r in found.collect()] == [1, 3]


def test_wkt_rings(spark):
    layer = spark.createDataFrame(
        [("a", "POLYGON ((0 0, 0 10, 10 10, 10 0), (4 4, 6 4, 6 6, 4 6, 4 4))"),
         ("b", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 7 5, 7 7, 5 7, 5 5), (5.5 5.5, 6 5.5, 6 6, 5.5 5.5)))")],
        "name string, wkt string",
    )
    area = F.aggregate("rings", F.lit(0.0), lambda acc, r: acc + regions.signed_area(r))
    got = {r["name"]: (r["n"], r["area"], r["max_x"]) for r in regions.read_regions(layer).select("name", F.size("rings").alias("n"), area.alias("area"), "max_x").collect()}
    assert got == {"a": (2, 96.0, 10.0), "b": (3, 0.5 + 4 - 0.125, 7.0)}


def test_points_wkt_round(spark, tmp_path):
    df = spark.createDataFrame([(1, -111.5, 40.25)], "id int, lon double, lat double")
    regions.write_points_wkt(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).first()["wkt"] == "POINT (-111.5 40.25)"


def test_wide_grid(spark, tmp_path):
    wide = spark.createDataFrame([(1, "2.5 [K]", "3 [K]")], "id int, `2015-07-05` string, `2015-07-05 03:00:00` string")
    long = grids.grid_to_long(wide, "temperature")
    got = [(r["id"], str(r["timestamp"]), r["temperature"]) for r in long.orderBy("timestamp").collect()]
    assert got == [(1, "2015-07-05 00:00:00", 2.5), (1, "2015-07-05 03:00:00", 3.0)]
    tagged = long.withColumnRenamed("temperature", "value").withColumn("variable", F.lit("temperature"))
    grids.write_grid(tagged.unionByName(tagged.withColumn("variable", F.lit("pm25"))), str(tmp_path / "g"))
    part = grids.read_grid(spark, str(tmp_path / "g"), "pm25")
    assert part.count() == 2 and "PartitionFilters: [isnotnull(variable" in part._jdf.queryExecution().toString()
    assert grids.select_instants(long, "2015-07-05 01:00:00", "2015-07-06").count() == 1


def test_sanitized_names(spark):
    df = spark.createDataFrame([(1, 2)], "`food_&_dining` int, id int")
    assert grids.sanitize_columns(df).columns == ["food_._dining", "id"]
