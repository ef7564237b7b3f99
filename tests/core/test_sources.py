import os

import pytest
from pyspark.sql import functions as F

from foldlog import cli
from foldlog.operators import log as scans
from foldlog.operators import state, stats
from foldlog.sources import records, replay, tables
from foldlog.streaming import bridge

LOG = "seq long, ts_ms long, op string, key string, body string"


@pytest.fixture
def log(spark):
    return spark.createDataFrame([(i, i * 10, "DELETE" if i % 5 == 0 else "PUT", f"k{i % 7}", f"body {i} é") for i in range(1, 41)], LOG)


def test_record_files_round_trip(spark, log, tmp_path):
    laid = log.withColumn("seg", F.ceil(F.col("seq") / 10).cast("long"))
    records.write_events(laid, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["1", "2", "3", "4"]
    back = records.read_events(spark, f"{tmp_path}/*/data").select("seq", "ts_ms", "op", "key", F.col("body").cast("string").alias("body"))
    wanted = log.withColumn("body", F.when(F.col("op") == "PUT", F.col("body")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, wanted.collect()))
    index = records.read_index(spark, f"{tmp_path}/2/index").orderBy("seq").collect()
    offsets = scans.record_offsets(log.where("seq between 11 and 20")).orderBy("seq").collect()
    assert [tuple(r) for r in index] == [tuple(r) for r in offsets]
    sizes = {f: os.path.getsize(f"{tmp_path}/{f}/data") for f in "1234"}
    assert sum(sizes.values()) == sum(40 + 2 + len(r["body"].encode()) * (r["op"] == "PUT") for r in log.collect())


def test_broken_records_raise(spark, log, tmp_path):
    records.write_events(log.withColumn("seg", F.lit(1)), str(tmp_path))
    for name, read in (("data", records.read_events), ("index", records.read_index)):
        raw = bytearray((tmp_path / "1" / name).read_bytes())
        raw[20] ^= 1
        (tmp_path / "1" / name).write_bytes(raw)
        with pytest.raises(Exception, match="checksum"):
            read(spark, f"{tmp_path}/1/{name}").collect()
    assert records.read_events(spark, f"{tmp_path}/1/data", verify=False).count() == 40


def test_fixed_store_size(spark, tmp_path):
    rows = [(i, 0, "DELETE", str(i), None) for i in range(1, 201)] + [(201, 0, "DELETE", "is so fat", None)]
    records.write_events(spark.createDataFrame(rows, LOG).withColumn("seg", F.lit(1)), str(tmp_path))
    assert os.path.getsize(tmp_path / "1" / "data") == 8541


def test_tables_and_commands(spark, log, tmp_path, capsys):
    single, seg, out = (str(tmp_path / n) for n in ("single", "seg", "out"))
    tables.write(log, single)
    run = lambda *args: (cli.main(list(args), spark), capsys.readouterr().out)[1]
    run("convert-to-segmented", single, seg, "--size", "10")
    assert run("is-segmented", seg) == "True\n" and run("is-segmented", single) == "False\n" and run("next-seq", seg) == "41\n"
    assert spark.read.parquet(seg).groupBy("seg").count().where("count = 10").count() == 4
    assert run("range", "3", "4", single) == "3 30 PUT k3\n4 40 PUT k4\n" and len(run("tail", single, "--n", "2").splitlines()) == 3
    run("key-filter", "k[12]", seg, out)
    assert spark.read.parquet(out).where("key not in ('k1', 'k2')").count() == 0 and tables.is_segmented(spark, out)
    with pytest.raises(Exception, match="(?i)exist"):
        run("key-filter", "k[12]", seg, out)
    run("key-list", single, str(tmp_path / "keys"))
    live = {r["key"] for r in state.live_state(log).collect()}
    assert {r["value"] for r in spark.read.text(str(tmp_path / "keys")).collect()} == live
    run("compact", single, str(tmp_path / "c1"), "--now", "1000", "--age", "650")
    run("compact", seg, str(tmp_path / "c2"), "--now", "1000", "--age", "650")
    assert spark.read.parquet(str(tmp_path / "c1")).count() == 6  # 34 to 40 without the delete at the cutoff itself
    for name, args in {"key-filter-not": ["k1"], "key-filter-deletes-not-older-than": ["100"], "key-filter-puts-not-older-than": ["k", "100"], "key-list-filter": ["k"], "key-list-filter-puts-older-than": ["k", "100"]}.items():
        run(name, *args, single, str(tmp_path / name))
        assert spark.read.format("text" if "list" in name else "parquet").load(str(tmp_path / name)).count() > 0
    run("convert-to-single", seg, str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again")).count() == 40 and "'n': 40" in run("status", seg)
    run("init-segmented", str(tmp_path / "new"))
    assert run("next-seq", str(tmp_path / "new")) == "1\n"
    (tmp_path / "members").write_text("one\n# two\n three \n\n")
    assert [r["path"] for r in tables.read_members(spark, str(tmp_path / "members")).collect()] == ["one", "three"]


class Sender:
    def __call__(self, method, url, body):
        if url.endswith("k3"):
            raise ConnectionError
        return 200 if method == "PUT" and body else 404


def test_replay_with_a_given_transport(spark, log):
    out = replay.replay(log, "http://h", Sender, workers=2, pause_s=0)
    counts = {r["status"]: r["n"] for r in stats.replay_report(out).collect()}
    assert sum(counts.values()) == 40 and counts[0] == log.where("key = 'k3'").count() and set(counts) == {0, 200, 404}


def test_report_by_batch(spark):
    rows = [(2 * i, 200 if i % 3 else 0, i) for i in range(7)]
    out = stats.batch_report(spark.createDataFrame(rows, "seq long, status int, ms long"), 4).orderBy("batch").collect()
    assert [tuple(r) for r in out] == [(0, 4, 1, 0.5, 666.6667), (1, 3, 5, 0.3333, 200.0)]


ROW = "log string, arrival long, kind string, seq long, op string, key string, body string"


def deliver(spark, tmp_path, batches, first_seq):
    bridge.use_state_store(spark)
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        full = [("l", 100 * i + k, kind, seq, "PUT", "k", body) for k, (kind, seq, body) in enumerate(rows)]
        spark.createDataFrame(full, ROW).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if os.path.getmtime(f) > 10**9:
                os.utime(f, (1000 + i, 1000 + i))
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(folder))
    run = bridge.ordered_delivery(stream, first_seq).writeStream.option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet")
    run.awaitTermination()
    return [(r["seq"], r["body"]) for r in spark.read.schema(bridge.OUTPUT).parquet(str(tmp_path / "out")).orderBy("position").collect()]


def test_ordered_delivery(spark, tmp_path):
    one = lambda seq, body="x": ("event", seq, body)
    got = deliver(spark, tmp_path, [[one(11)], [one(13), one(11, "late")], [one(10), one(9)], [one(12), one(10, "late")]], 10)
    assert got == [(10, "x"), (11, "x"), (12, "x"), (13, "x")]


def test_subranges_pass_gaps(spark, tmp_path):
    got = deliver(spark, tmp_path, [[("event", 13, "held"), ("event", 11, "gone")], [("part", 10, "a"), ("part", 12, "b"), ("range", 12, None)], [("range", 5, None), ("event", 14, "c")]], 10)
    assert got == [(10, "a"), (12, "b"), (13, "held"), (14, "c")]


def test_live_apply(spark, tmp_path):
    apply = bridge.live_apply(spark, str(tmp_path / "log"), str(tmp_path / "state"))
    cols = "seq long, op string, key string, body string"
    apply(spark.createDataFrame([(1, "PUT", "a", "x"), (2, "PUT", "b", "y")], cols), 0)
    for _ in range(2):  # a batch that is run again changes nothing
        apply(spark.createDataFrame([(3, "DELETE", "a", None), (4, "PUT", "b", "z")], cols), 1)
    rows = spark.read.parquet(str(tmp_path / "state" / "version=1")).collect()
    assert sorted((r["key"], r["op"], r["body"]) for r in rows) == [("a", "DELETE", None), ("b", "PUT", "z")]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_segments_are_compacted_in_place(spark, log, tmp_path, capsys):
    path = str(tmp_path / "log")
    tables.write_segmented(log, path, 10)
    tables.set_flag(spark, path, 2, "applied")
    cli.main(["compact-segments", path], spark)
    assert capsys.readouterr().out.split() == ["1", "2", "3"]
    kept = {s: sorted(r["seq"] for r in tables.read(spark, path).where(F.col("seg") == s).collect()) for s in (1, 2, 3, 4)}
    assert kept == {1: list(range(4, 11)), 2: list(range(14, 21)), 3: list(range(24, 31)), 4: list(range(31, 41))}
    flags = {r["seg"]: (r["is_live"], r["applied"], r["internally_compacted"]) for r in tables.manifest(spark, path).collect()}
    assert flags == {1: (False, False, True), 2: (False, True, True), 3: (False, False, True), 4: (True, False, False)}
    assert tables.compact_segments(spark, path) == []
    tables.delete_segment(spark, path, 2)
    tables.delete_segment(spark, path, 99)
    assert sorted(r["seg"] for r in tables.manifest(spark, path).collect()) == [1, 3, 4]


def test_interrupted_replacements_are_repaired(spark, log, tmp_path):
    path = str(tmp_path / "log")
    tables.write_segmented(log, path, 10)
    os.rename(f"{path}/seg=1", f"{path}/.1.temp")  # between the renames
    log.where("seq = 7").write.parquet(f"{path}/.1.compacting")
    log.where("seq = 17").write.parquet(f"{path}/.2.compacting")  # while writing
    log.where("seq = 27").write.parquet(f"{path}/.3.temp")  # before the last step
    assert tables.repair(spark, path) == [("1", "promote compacting"), ("2", "drop compacting"), ("3", "drop temp")]
    assert sorted(r["seq"] for r in tables.read(spark, path).collect()) == [7, *range(11, 41)]
    assert tables.repair(spark, path) == [] and not [n for n in os.listdir(path) if n.endswith(("temp", "compacting"))]
