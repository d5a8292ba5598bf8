import os
import re
import time

from pyspark.sql import functions as F

from voltaic.operators import clean
from voltaic.sources import files as FS
from voltaic.sources import html as H
from voltaic.streaming.ingest import ingest_available_now

PAGE = ('<html><table class="table striped"><tr><th>Date</th></tr>'
        '<tr><td>01-02-2024</td><td>8504</td><td> <b>500 KVA</b> Power Transformer &amp; kit </td>'
        '<td> India </td><td>2 NOS</td><td>$1,200.50</td></tr>'
        '<tr><td>short</td></tr>'
        '<tr><td>d</td><td>h</td><td>LED lamp</td><td>China</td><td>1</td><td>5</td></tr>'
        '<tr><td>d</td><td>h</td><td>1.2.3 kva transformer</td><td>China</td><td>1</td><td>5</td></tr>'
        '</table></html>')


def test_html_scan(spark):
    pages = spark.createDataFrame([(1, "https://x/import-in-united-kingdom/", PAGE)], "page_id int, url string, html string")
    rows = H.scan_listings(pages, scrape_date="2025-03-19").collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["description"] == "500 KVA Power Transformer & kit"
    assert r["origin"] == "India" and r["destination"] == "United Kingdom"
    assert r["quantity"] == 2.0 and r["unit_price_usd"] == 1200.5 and r["power_rating_kva"] == 500.0


def rows_brute(page):
    """Cells of all rows after the first of the first listing table, by a parser that follows nesting."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.rows, self.on, self.done = [], [], False, False

        def handle_starttag(self, tag, attrs):
            if tag == "table" and not self.on and "table" in (dict(attrs).get("class") or "").split():
                self.on = True
            if not self.on or self.done or tag not in ("table", "tr", "td"):
                return
            node = {"tag": tag, "text": [], "cells": []}
            if tag == "tr":
                self.rows.append(node)
            if tag == "td":
                for n in self.stack:
                    if n["tag"] == "tr":
                        n["cells"].append(node)
            self.stack.append(node)

        def handle_endtag(self, tag):
            if self.on and not self.done and tag in ("table", "tr", "td"):
                while self.stack and self.stack.pop()["tag"] != tag:
                    pass
                self.done = not self.stack

        def handle_data(self, data):
            for n in self.stack if not self.done else ():
                n["text"].append(data)
    r = Reader()
    r.feed(page)
    return [["".join(c["text"]).strip() for c in row["cells"]] for row in r.rows[1:]]


def test_nested_tables_follow_the_nesting(spark):
    inner = '<TABLE class="table"><tr><td>a</td><td>b<table><tr><td>deep</td></tr></table></td></tr><tr><td>c</td></tr></TABLE>'
    row = "<tr><td>1</td><td>2</td><td>{}</td><td>4</td><td>5</td><td>6</td></tr>"
    pages = [PAGE, '<table class="x table"><tr><th>h</th></tr>' + row.format("x " + inner + " y") + row.format("z") + "</table>" + row.format("outside") + "<table></table>",
             "<p><table><tr><td>none</td></tr></table>", '<table class="table"><tr><td>' + inner + "</td></tr>" + row.format("<b>bold</b> " + inner) + row.format(inner + inner) + "</table>",
             '<table class="table"><tr><th></th></tr>' + row.format(inner) + "<tr><td>cut", None, "", "no table", "<table class='table'></table>" + inner]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {}
    for r in sorted(H.table_rows(df).collect(), key=lambda r: (r.page_id, r.row_index)):
        got.setdefault(r.page_id, []).append(list(r.cells))
    want = {i: rows for i, p in enumerate(pages) if p and (rows := rows_brute(p))}
    assert {i: r for i, r in got.items() if i not in (0, 4)} == {i: r for i, r in want.items() if i not in (0, 4)}
    assert got[4][:len(want[4]) - 1] == want[4][:-1] and len(got[1]) == 5


def test_append_distinct_idempotent(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "k int, v string")
    path = os.path.join(tmpdir_path, "t")
    FS.append_distinct(spark, df, path)
    FS.append_distinct(spark, df, path)
    assert spark.read.parquet(path).count() == 3


def test_stream_equals_batch(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"{i * 100} KVA transformer", "$ 10") for i in range(50)],
                               "k bigint, description string, unit_price string")
    landing = os.path.join(tmpdir_path, "landing")
    df.where("k < 30").write.parquet(landing)
    df.where("k >= 20").write.mode("append").parquet(landing)

    def transform(s):
        return clean.clean_listings(s.withColumn("quantity", F.lit(None).cast("string")), min_kva=None,
                                    keep_rejected=True).select("k", "power_rating_kva", "unit_price_usd")

    target = os.path.join(tmpdir_path, "target")
    ingest_available_now(spark, landing, df.schema, target, os.path.join(tmpdir_path, "ck"), transform,
                         max_files_per_trigger=1)
    batch_path = os.path.join(tmpdir_path, "batch")
    FS.append_distinct(spark, transform(spark.read.parquet(landing)), batch_path)
    a = spark.read.parquet(target)
    b = spark.read.parquet(batch_path)
    assert a.count() == 50 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_csv_roundtrip_fallback(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "latin.csv")
    with open(p, "wb") as f:
        f.write("Origin,Description\n".encode() + "Côte,500 KVA transformer\n".encode("latin-1"))
    df = FS.read_csv_fallback(spark, p, "Origin string, Description string")
    assert df.first()["origin"] == "Côte"


def test_sound_csv_with_replacement_characters_stays_utf8(spark, tmpdir_path):
    for name, data in (("a.csv", "café \ufffd".encode()), ("b%20 c.csv", "Côte".encode("latin-1")), ("d.csv", b"plain")):
        with open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(b"Origin,Description\n" + data + b",x\n")
    df = FS.read_csv_fallback(spark, os.path.join(tmpdir_path, "a.csv"), "Origin string, Description string")
    assert df.first()["origin"] == "café \ufffd"
    both = FS.read_csv_fallback(spark, tmpdir_path, "Origin string, Description string")
    assert sorted(r["origin"] for r in both.collect()) == ["Côte", "café \ufffd", "plain"]
    assert sorted(r["origin"] for r in FS.read_csv_fallback(spark, tmpdir_path).collect()) == ["Côte", "café \ufffd", "plain"]


def test_append_reads_only_the_buckets_of_a_delivery(spark, tmpdir_path, monkeypatch):
    path = os.path.join(tmpdir_path, "t")
    rows = [(i, None if i % 9 == 0 else f"v{i % 50}") for i in range(2000)]
    FS.append_distinct(spark, spark.createDataFrame(rows, "k int, v string"), path)
    delivery = spark.createDataFrame([(5, "v5"), (9, None), (7000, "new"), (7000, "new")], "k int, v string")
    touched = {r[0] for r in FS.with_bucket(delivery).select(FS.BUCKET).distinct().collect()}
    every, held = FS.data_files(spark, path), FS.bucket_files(spark, path, sorted(touched))
    assert len(every) > 50 and len(held) <= len(touched) <= 3
    read = []
    plain = FS.new_distinct_rows
    monkeypatch.setattr(FS, "new_distinct_rows", lambda existing, new: read.append(len(existing.inputFiles())) or plain(existing, new))
    assert FS.append_distinct(spark, delivery, path) == 1 and read == [len(held)]
    assert FS.append_distinct(spark, delivery, path) == 0
    table = spark.read.parquet(path)
    assert table.columns == ["k", "v"] and table.count() == 2001 and table.distinct().count() == 2001
    # a table written by other means is read whole
    other = os.path.join(tmpdir_path, "o")
    delivery.distinct().write.parquet(other)
    assert FS.append_distinct(spark, delivery, other) == 0 and FS.append_distinct(spark, delivery.limit(0), other) == 0


def test_rejects_write_counts_as_it_goes(spark, tmpdir_path):
    df = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "k int, is_transformer boolean")
    seen = FS.write_with_rejects(df, os.path.join(tmpdir_path, "r"), counters={"large": F.col("k") > 2})
    assert seen == {"rows": 4, "kept": 2, "rejected": 2, "large": 2}
    assert spark.read.parquet(os.path.join(tmpdir_path, "r")).count() == 4


def test_stream_goes_on_and_replays_without_reading_the_target(spark, tmpdir_path):
    landing, target, ck = (os.path.join(tmpdir_path, n) for n in ("landing", "target", "ck"))
    a = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    a.write.parquet(landing)
    ingest_available_now(spark, landing, a.schema, target, ck)
    spark.createDataFrame([(2, None), (3, "c")], "k int, v string").write.mode("append").parquet(landing)
    ingest_available_now(spark, landing, a.schema, target, ck)
    want = [(1, "a"), (2, None), (3, "c")]
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == want
    # the last batch runs again when its commit is lost
    commits = os.path.join(ck, "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    os.replace(os.path.join(commits, last), os.path.join(tmpdir_path, "commit"))
    crc = os.path.join(commits, f".{last}.crc")
    if os.path.exists(crc):
        os.replace(crc, os.path.join(tmpdir_path, "crc"))
    ingest_available_now(spark, landing, a.schema, target, ck)
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == want
    # a stream that starts anew over the target
    ingest_available_now(spark, landing, a.schema, target, ck + "2")
    spark.createDataFrame([(1, "a"), (4, "d")], "k int, v string").write.mode("append").parquet(landing)
    ingest_available_now(spark, landing, a.schema, target, ck + "2")
    assert sorted(tuple(r) for r in spark.read.parquet(target).collect()) == want + [(4, "d")]


def test_csv_quotes_and_line_ends(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "quoted.csv")
    with open(p, "w") as f:
        f.write('Origin,Description\nIndia,"Transformer 12"" bushing, 500 KVA"\nChina,"two\nlines"\n')
    rows = FS.read_csv(spark, p, "Origin string, Description string", multiline=True).collect()
    assert [r["description"] for r in rows] == ['Transformer 12" bushing, 500 KVA', "two\nlines"]
    back = os.path.join(tmpdir_path, "back")
    FS.write_csv(spark.createDataFrame([("a", 'x "y", z')], "origin string, description string"), back)
    assert FS.read_csv(spark, back, "Origin string, Description string").first()["description"] == 'x "y", z'


def test_csv_encoding_is_decided_per_file(spark, tmpdir_path):
    for name, text, encoding in (("a b.csv", "Türkiye", "utf-8"), ("b.csv", "Côte", "latin-1"), ("c.csv", "Österreich", "utf-8")):
        with open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(("Origin,Description\n" + text + ",x\n").encode(encoding))
    df = FS.read_csv_fallback(spark, os.path.join(tmpdir_path, "*.csv"), "Origin string, Description string")
    assert sorted(r["origin"] for r in df.collect()) == ["Côte", "Türkiye", "Österreich"]


def test_ingest_without_marker_files_adds_nothing_twice(spark, tmpdir_path):
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    spark._jsc.hadoopConfiguration().set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
        landing, target = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "target")
        for n in range(2):
            df.write.mode("append").parquet(landing)
            ingest_available_now(spark, landing, df.schema, target, os.path.join(tmpdir_path, f"ck{n}"))  # a lost checkpoint replays all
        assert not os.path.exists(os.path.join(target, "_SUCCESS"))
        assert spark.read.parquet(target).count() == 2
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
        spark._jsc.hadoopConfiguration().unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_scratch_folder_must_be_shared_off_local_mode():
    import types

    import pytest

    from voltaic.session import ensure_checkpoint_dir
    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: d),
                                    sparkContext=types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(cluster)


def test_intermediates_are_released(spark):
    from voltaic.session import materialize, release_intermediates
    df = materialize(spark.range(5), "release")
    path = df.inputFiles()[0]
    assert release_intermediates(spark) >= 1
    assert not os.path.exists(path.removeprefix("file://"))


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = [os.path.join(at, name) for folder in folders for at, _, names in os.walk(folder) for name in names if name.startswith("shuffle_") and name.endswith(".data")]
    return {f: os.path.getsize(f) for f in files if os.path.exists(f)}


def test_a_delivery_meets_the_table_in_one_shuffle(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    spark.range(3000).selectExpr("id as k", "if(id % 7 = 0, null, concat('v', id % 50)) as v", "cast(id as double) as x").write.parquet(path)
    new = spark.range(1500, 4500).selectExpr("id as k", "if(id % 7 = 0, null, concat('v', id % 50)) as v", "cast(id as double) as x")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(new.where("k >= 3000").collect(), key=lambda r: r.k)
    for most in ("-1", limit):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            found = FS.new_distinct_rows(spark.read.parquet(path), new)
            assert sorted(found.collect(), key=lambda r: r.k) == want and found.dtypes == new.dtypes
            plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            rows = [line for line in plan.split("\n") if re.search(r"(?<!Broadcast)Exchange ", line) and "Reused" not in line]
            assert len(rows) == 1 and "__slot" in rows[0] and "Join" not in plan if most == "-1" else "BroadcastHashJoin" in plan
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    other = new.withColumn("k", F.col("k").cast("int"))                   # values of another type are other rows
    assert FS.new_distinct_rows(spark.read.parquet(path), other).count() == 3000


def test_large_deliveries_are_dealt_out_by_their_size(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(FS, "BYTES_A_TASK", 500)
    path, parts = os.path.join(tmpdir_path, "t"), []
    rows = spark.range(4000).selectExpr("id as k", "concat('v', id) as v")
    dealt = FS._dealt
    monkeypatch.setattr(FS, "_dealt", lambda rows, size: parts.append(dealt(rows, size)) or parts[-1])
    assert FS.append_distinct(spark, rows.where("k < 3000"), path) == 3000
    assert FS.append_distinct(spark, rows.where("k >= 2000").unionAll(rows.where("k >= 2000")), path) == 1000
    assert len(parts) == 2 and all(re.search(r'hashpartitioning\(__slot#\d+, \d{2,}\)', p._jdf.queryExecution().executedPlan().toString()) for p in parts)
    assert spark.read.parquet(path).exceptAll(rows).isEmpty() and rows.exceptAll(spark.read.parquet(path)).isEmpty()
    table = spark.read.parquet(path)                                      # each file still holds one bucket
    held = FS.with_bucket(table).select(FS.BUCKET, F.regexp_extract(F.input_file_name(), r"bucket-(\d+)-", 1).cast("int").alias("named"))
    assert held.where(f"{FS.BUCKET} <> named").isEmpty()


def test_written_tables_leave_no_shuffle_files(spark, tmpdir_path):
    from voltaic import session
    before, was = _shuffle_files(spark), spark.conf.get(session.FREED)
    rows = session.materialize(spark.range(5000).selectExpr("id as k", "concat('v', id % 50) as v").repartition(7, "k"), "freed")
    FS.append_distinct(spark, rows, os.path.join(tmpdir_path, "t"))
    landing = os.path.join(tmpdir_path, "landing")
    rows.write.parquet(landing)
    ingest_available_now(spark, landing, rows.schema, os.path.join(tmpdir_path, "target"), os.path.join(tmpdir_path, "ck"))
    assert spark.read.parquet(os.path.join(tmpdir_path, "target")).count() == 5000 and spark.conf.get(session.FREED) == was
    deadline = time.time() + 20

    def left():                                       # counts leave a few bytes, 5000 rows some 50,000
        return sum(size for f, size in _shuffle_files(spark).items() if f not in before)
    while time.time() < deadline and left() > 5000:   # files go while the driver does other things
        time.sleep(.2)
    assert left() <= 5000
