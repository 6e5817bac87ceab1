import os
import tempfile

from pyspark.sql import functions as F

from eventlens.plans.pipelines import ingest_labelled
from eventlens.sources import files


def write(path, text, encoding="latin-1"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)


def test_tsv_line_rules(spark):
    root = tempfile.mkdtemp(prefix="eventlens-tsv-")
    write(
        f"{root}/fire_event/a.tsv",
        "id\ttweet\n"
        "1\tforest fire spreading near the town tonight\n"
        "2\n"                                                   # short row: kept, null tweet, then dropped
        "3\tthird field present here ok\textra\n"               # too many fields: dropped
        "4\tempty extra field still counts as one\t\n"          # dropped too
        '5\t"quoted\nnewline tweet about the fire"\n'           # one row
        "6\tNA\n",                                              # NA -> null
    )
    write(f"{root}/flood/b.tsv", "message\tx\nriver flood warning issued for the valley\t1\n")
    write(f"{root}/no_text/c.tsv", "foo\tbar\n1\t2\n")           # no text column: skipped, folder still numbered
    rows = files.read_event_folders(spark, root).collect()
    by_folder = {}
    for r in rows:
        by_folder.setdefault(r.folder, []).append(r.raw_tweet)
    assert sorted(by_folder["fire_event"], key=str) == sorted(
        [None, None, "forest fire spreading near the town tonight", "quoted\nnewline tweet about the fire"], key=str
    )
    assert by_folder["flood"] == ["river flood warning issued for the valley"]
    out = {r.event_title: r.event_id for r in ingest_labelled(spark, root).collect()}
    assert out == {"fire event": 0, "flood": 1}  # no_text holds id 2


def test_wide_header_and_folders_without_rows(spark):
    root = tempfile.mkdtemp(prefix="eventlens-tsv-")
    write(f"{root}/a_header_only/a.tsv", "id\ttweet\n")
    write(f"{root}/b_empty/b.tsv", "")
    names = [f"c{i}" for i in range(70)]
    write(f"{root}/c_wide/c.tsv", "\t".join([*names, "tweet"]) + "\n" + "\t".join(["x"] * 70 + ["a tweet behind seventy columns"]) + "\n")
    out = {r.event_title: (r.event_id, r.raw_tweet) for r in ingest_labelled(spark, root).collect()}
    assert out == {"c wide": (2, "a tweet behind seventy columns")}


def test_event_name_from_path(spark):
    df = spark.createDataFrame([("a/b/c.tsv",), ("http://h/x/1?q",), ("x",), ("a//b",)], "p string")
    got = [r.n for r in df.select(files.event_name_from_path("p").alias("n")).collect()]
    assert got == ["b", "x", "", "a"]


def test_na_tokens(spark):
    df = spark.createDataFrame([("NA",), ("n/a",), ("",), ("ok",), ("None",)], "s string")
    assert [r.s for r in df.select(files.na_to_null("s").alias("s")).collect()] == [None, None, None, "ok", None]


def test_csv_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="eventlens-csv-") + "/t"
    df = spark.createDataFrame([(1, 'say "hi"\nthen go'), (2, "NA")], "id long, text string")
    files.write_events(df, out, fmt="csv")
    back = {r.id: r.text for r in files.read_posts_csv(spark, out).select(F.col("id").cast("long").alias("id"), "text").collect()}
    assert back == {1: 'say "hi"\nthen go', 2: None}


def test_export_fixed_projection(spark):
    from eventlens.plans.pipelines import COVID_EXPORT_COLUMNS, export_events

    df = spark.createDataFrame(
        [("r", "c", "e", 1, "T", "global", "extra")],
        "raw_text string, clean_text string, emotion_text string, event_id long, event_title string, time_window string, x string",
    )
    out = tempfile.mkdtemp(prefix="eventlens-export-") + "/o"
    export_events(df, out, fmt="csv")
    back = files.read_posts_csv(spark, out)
    assert tuple(back.columns) == COVID_EXPORT_COLUMNS


def test_count_distinct_exact_and_approx(spark):
    from eventlens.operators.rows import count_distinct

    df = spark.range(1000).select((F.col("id") % 37).alias("k"))
    r = df.agg(count_distinct("k", "exact"), count_distinct("k", "approx", approx=True)).first()
    assert r.exact == 37 and abs(r.approx - 37) <= 2


def test_ledger_counts_what_a_scan_leaves_out(spark):
    root = tempfile.mkdtemp(prefix="eventlens-tsv-")
    write(f"{root}/one/a.tsv", "id\ttweet\n1\tall good here today\n2\ttoo\tmany\n3\tmany\t\n4\tNA\n5\n")
    write(f"{root}/one/b.tsv", 'x\ttext\n1\t"tab\there and ""quotes"""\n2\t"new\nline"\n3\t"a"\tb\n')
    write(f"{root}/two/c.tsv", "foo\tbar\n1\t2\n3\t4\n")
    write(f"{root}/two/d.tsv", "foo\tbar\n")
    write(f"{root}/three/e.tsv", "")
    scan = files.scan_event_folders(spark, root)
    name = lambda p: p.rsplit("/", 1)[1]
    assert {(name(r.path), r.folder, r.reason, r.rows) for r in scan.ledger.collect()} == {
        ("a.tsv", "one", "too many fields", 2), ("a.tsv", "one", "missing text", 2), ("b.tsv", "one", "too many fields", 1),
        ("c.tsv", "two", "no text column", 2), ("d.tsv", "two", "no text column", 0), ("e.tsv", "three", "empty file", 0),
    }
    texts = [r.raw_tweet for r in scan.posts.where("raw_tweet is not null").collect()]
    assert sorted(texts) == sorted(["all good here today", 'tab\there and "quotes"', "new\nline"])


def test_lines_of_a_split_file_keep_their_order(spark):
    root = tempfile.mkdtemp(prefix="eventlens-tsv-")
    write(f"{root}/big/a.tsv", "n\ttweet\n" + "".join(f"{i}\trow number {i} é\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        posts = files.read_event_folders(spark, root)
        rows = posts.orderBy("path", "row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.raw_tweet for r in rows] == [f"row number {i} é" for i in range(20000)]
    assert len({r.row_no.block for r in rows}) > 4


def test_inferred_types_go_up_the_lattice(spark):
    data = [
        ("1", "1.5", "True", "2020-07-25", "7", "1e3", "9999999999999999999", None, "x", " 4", "1d"),
        ("-2", "2", "false", "2020-07-25 10:00:01", None, "-.5", "1", None, "2", "5 ", "2"),
    ]
    names = list("abcdefghijk")
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in names))
    want = ["bigint", "double", "boolean", "timestamp_ntz", "bigint", "double", "double", "string", "string", "bigint", "string"]
    assert files.inferred_types(df) == dict(zip(names, want))
    got = files.typed(df).collect()
    assert (got[0].a, got[1].b, got[1].c, got[1].e, got[0].f, got[1].j) == (1, 2.0, False, None, 1000.0, 5)
    # one value decides for all rows, wherever it lies
    big = spark.range(5000).selectExpr("if(id = 4321, 'late', cast(id AS string)) AS v").repartition(8)
    assert files.inferred_types(big) == {"v": "string"} and files.inferred_types(big.limit(0)) == {"v": "string"}


def test_files_without_newlines_in_fields_are_split(spark):
    root = tempfile.mkdtemp(prefix="eventlens-csv-")
    write(f"{root}/plain/a.csv", "id,text\n" + "".join(f'{i},"row, {i}"\n' for i in range(20000)), "utf-8")
    write(f"{root}/broken/a.csv", 'id,text\n1,"two\nlines"\n', "utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        plain = files.read_posts_csv(spark, f"{root}/plain", infer=True)
        assert plain.rdd.getNumPartitions() > 4 and plain.dtypes == [("id", "bigint"), ("text", "string")]
        assert plain.agg(F.count("*"), F.sum("id")).first()[:] == (20000, 20000 * 19999 // 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in files.read_posts_csv(spark, f"{root}/broken", infer=True).collect()] == [(1, "two\nlines")]


def test_row_numbers_follow_path_and_place(spark):
    root = tempfile.mkdtemp(prefix="eventlens-csv-")
    for name, first in (("a", 0), ("b", 5000), ("c", 10000)):
        write(f"{root}/{name}.csv", "".join(f"{i},row {i}\n" for i in range(first, first + 5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = files.with_row_numbers(files.read_posts_csv(spark, root, header=False, names=["n", "t"])).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 15000 and all(int(r["n"]) == r["row_no"] for r in rows)


def test_files_with_open_quotes_are_cut_once_and_meet_their_header_without_a_shuffle(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="eventlens-tsv-")
    write(f"{root}/open/a.tsv", "id\ttweet\n" + "".join(f'{i}\t"two\nlines {i}"\n' for i in range(300)))
    write(f"{root}/plain/b.tsv", "text\tx\n" + "".join(f"one line {i}\t{i}\n" for i in range(200)))
    written = []
    keep = files.materialize
    monkeypatch.setattr(files, "materialize", lambda df, name="table": (written.append((name, t := keep(df, name))), t)[1])
    scan = files.scan_event_folders(spark, root)
    records = [t.count() for name, t in written if "fields" in t.columns]
    assert records == [502]  # every record and header, written once; no line of a file that is read whole
    plan = scan.posts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    got = {r.folder: r.n for r in scan.posts.groupBy("folder").agg(F.count("raw_tweet").alias("n")).collect()}
    assert got == {"open": 300, "plain": 200}
    only = files.scan_event_folders(spark, f"{root}/open")  # no other file: the lines are not scanned again
    assert only.posts.where("raw_tweet is not null").count() == 300
