"""Small logs with known results."""

import struct

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from foldlog.functions import checksum, codec, text
from foldlog.operators import compaction, consensus, filters, keys, log, membership, ordered, replication, segments, state, stats
from foldlog.schema import EVENT

PUTS, DELETES = "PUT", "DELETE"
SEG = "seg long, seq long, ts_ms long, op string, key string, body string"


def events(spark, rows):
    """Rows of (seq, ts, op, key[, body])."""
    full = [(r[0], r[1], DELETES if r[2] == "D" else PUTS, r[3], bytearray(r[4], "utf8") if len(r) > 4 else None) for r in rows]
    return spark.createDataFrame(full, EVENT)


def laid(spark, parts, ts=0):
    """Segments given as {seg: [(seq, key)]}, all deletes."""
    rows = [(s, q, ts, DELETES, str(k), None) for s, part in parts.items() for q, k in part]
    return spark.createDataFrame(rows, SEG)


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_single_log_compaction(spark):
    rows = [(i + 1, t, "PD"[i % 2], "ABCDEF"[i // 2]) for i, t in enumerate([2, 5, 8, 2, 5, 2, 5, 5, 5, 5, 5, 5])]
    assert seqs(compaction.single_log(events(spark, rows))) == [2, 4, 6, 8, 10, 12]
    assert seqs(compaction.single_log(events(spark, []))) == []
    old = [(1, 100, "P", "TooOld"), (2, 200, "D", "TooOld"), (3, 300, "P", "Slayer"), (4, 400, "P", "TooNew"), (5, 500, "D", "TooNew")]
    assert seqs(compaction.single_log(events(spark, old), 400)) == [3, 5]


def test_internal_and_against(spark):
    one = laid(spark, {1: list(zip(range(1, 6), "12225", strict=True))})
    assert seqs(compaction.internal(one)) == [1, 4, 5]
    two = laid(spark, {1: [(i, i) for i in range(1, 5)], 2: [(i + 2, i) for i in range(3, 7)]})
    assert {r["key"] for r in compaction.against(two, 2, 0).collect()} == {"1", "2"}
    same = laid(spark, {s: [(4 * s + i, i) for i in range(4)] for s in (1, 2, 3)})
    assert compaction.against(same, 2, 0).count() == 0
    with pytest.raises(ValueError, match="not compacted"):
        compaction.check_internal(segments.manifest(two), 1)


def test_tombstones_by_age(spark):
    now, hour = 10_000_000, 3_600_000
    rows = [(1, 1, now - 2 * hour, DELETES, "1", None)] + [(1, i, now, DELETES, str(i), None) for i in (2, 3, 4)] + [(2, 10 + i, now, DELETES, str(i), None) for i in (3, 4, 5, 6)]
    df = spark.createDataFrame(rows, SEG)
    assert {r["key"] for r in compaction.against(df, 2, compaction.delete_cutoff(now, 1)).collect()} == {"2"}
    assert {r["key"] for r in compaction.against(df, 2, compaction.delete_cutoff(now, 10**6)).collect()} == {"1", "2"}
    assert compaction.single_cutoff(now, 0) == 0


def test_masked_put_does_not_come_back(spark):
    rows = [(1, 1, 5, PUTS, "old", "x"), (1, 2, 6, DELETES, "old", None), (3, 9, 10**9, PUTS, "z", "y")]
    df = spark.createDataFrame([*rows, (2, 5, 10**9, PUTS, "other", "y")], SEG)
    assert {(r["seg"], r["key"]) for r in compaction.segmented(df, 10**8).collect()} == {(2, "other"), (3, "z")}


def test_segmented_compaction(spark):
    two = laid(spark, {1: [(i, i) for i in range(1, 11)], 2: [(10 + i, i + 5) for i in range(1, 11)], 3: [(21, 16)]})
    left = compaction.segmented(two, 0).collect()
    assert sorted(int(r["key"]) for r in left if r["seg"] == 1) == [1, 2, 3, 4, 5] and len(left) == 16
    three = laid(spark, {s: [(i, i) for i in range(1, 5)] for s in (1, 2, 3)} | {4: [(5, 9)]})  # sequences repeat
    assert sorted(r["seg"] for r in compaction.segmented(three, 0).collect()) == [3, 3, 3, 3, 4]
    follow = laid(spark, {1: [(i, i) for i in range(1, 5)], 2: [(i, i - 2) for i in range(5, 9)], 3: [(9, 100)]})
    assert compaction.segmented(follow, 0).where("seg < 3").count() == 6


def test_layout_appends_and_merging(spark):
    ten = events(spark, [(i, 0, "P", str(i)) for i in range(1, 21)])
    assert [(r["seg"], r["n"]) for r in segments.manifest(segments.layout(ten, 10)).orderBy("seg").collect()] == [(1, 10), (2, 10)]
    assert seqs(segments.check_append(ten, events(spark, [(1, 0, "P", "x"), (21, 0, "P", "y"), (999, 0, "P", "z")]))) == [1]
    assert log.bounds(events(spark, [(999, 0, "P", "z")])).first()["next_seq"] == 1000
    assert log.bounds(events(spark, [])).first()["next_seq"] == 1

    def merged(sizes, most, applied=None):
        applied = applied or [True] * len(sizes)
        rows = [(i + 1, n, 0, 0, a, a, False) for i, (n, a) in enumerate(zip(sizes, applied, strict=True))]
        df = spark.createDataFrame(rows, "seg long, n long, min_seq long, max_seq long, applied boolean, internally_compacted boolean, is_live boolean")
        return sorted(r["seg"] for r in segments.merged(df, most).collect())

    assert [merged([3, 3, 3], n) for n in (5, 6, 9)] == [[1, 2, 3], [1, 3], [1]]
    assert merged([6, 3, 3], 6) == [1, 2]
    assert merged([1, 1, 1, 1], 9, [True, False, True, True]) == [1, 2, 3]


def test_merge_plan_leaves_the_work_before_it_in_tasks_of_its_own(spark):
    def numbered(batches):
        for batch in batches:
            yield batch.assign(n=TaskContext.get().taskAttemptId(), applied=True)[["seg", "n", "applied"]]

    rows = spark.range(1, 9, numPartitions=4).toDF("seg").mapInPandas(numbered, "seg long, n long, applied boolean")
    plan = segments.merge_plan(rows, 0).collect()
    assert [(r["seg"], r["into"]) for r in plan] == [(i, i) for i in range(1, 9)]
    assert len({r["n"] for r in plan}) == 4


def test_ranges(spark):
    dense = events(spark, [(i, 0, "P", str(i)) for i in range(1, 12)])
    one = F.lit(1)
    assert seqs(log.range_while(dense, 1, 100, one, 5)) == [1, 2, 3, 4, 5]
    assert seqs(log.range_while(dense, 9, 100, one, 2)) == [9, 10]
    assert seqs(log.tail(dense, 3)) == [8, 9, 10, 11] and seqs(log.tail_count(dense, 3)) == [9, 10, 11]
    one_key = dense.withColumn("key", F.lit("k"))
    assert log.fold(one_key, 0, lambda a, e: a + e["seq"], lambda a: a < 10, "result long").first()["result"] == 10
    assert {r["key"]: r["result"] for r in log.fold(dense, 0, lambda a, e: a + e["seq"], schema="result long").collect()} == {str(i): i for i in range(1, 12)}
    index = spark.createDataFrame([(1, 0), (3, 1), (5, 2)], "seq long, offset long")
    far = 1 << 60
    asked = {(1, 5): (0, 2), (2, 4): (1, 1), (2, far): (1, 2), (-far, 4): (0, 1), (2, 2): (0, -1), (6, far): (0, -1), (far, -far): (0, -1)}
    assert {k: tuple(log.offset_range(index, *k).first()) for k in asked} == asked


@pytest.mark.parametrize(("top", "asked", "status"), [
    (9, (1, 2, None), ("COMPLETE", 1, 2, 2)), (9, (8, 11, None), ("PARTIAL", 8, 9, 2)), (4, (8, 11, None), ("EMPTY", None, None, 0)),
    (9, (1, 2, 2), ("COMPLETE", 1, 2, 2)), (9, (8, 11, 3), ("PARTIAL", 8, 9, 2)), (10, (8, 10, 2), ("COMPLETE", 8, 9, 2)),
])
def test_subranges(spark, top, asked, status):
    full = events(spark, [(i, 0, "P", str(i)) for i in range(1, top + 1)])
    r = log.subrange_status(full, spark.createDataFrame([asked], "start long, end long, limit long")).first()
    assert (r["status"], r["range_start"], r["range_end"], r["n_events"]) == status


def test_windows_across_buckets(spark):
    rows = events(spark, [(i * 3, 0, "P", str(i)) for i in range(1, 101)])
    got = {r["seq"]: (r["rn"], r["next_seq"]) for r in ordered.neighbours(ordered.row_numbers(rows, width=7), width=11).collect()}
    assert got == {i * 3: (i, (i + 1) * 3 if i < 100 else None) for i in range(1, 101)}


def test_keys_filters_and_state(spark):
    df = events(spark, [(1, 10, "P", "a1", "x"), (2, 20, "D", "a1"), (3, 30, "P", "b2", "y"), (4, 5, "P", "b2", "z")])
    assert [r["key"] for r in keys.live(df).collect()] == ["b2"]
    assert keys.live_matching(df, "a").count() == 0 and [r["key"] for r in keys.with_old_puts(df, "a", 15).collect()] == ["a1"]
    assert seqs(filters.without_old_deletes(df, 25)) == [1, 3, 4] and seqs(filters.without_old_puts(df, "b", 10)) == [1, 2, 3]
    assert [(r["key"], r["seq"], bytes(r["body"])) for r in state.live_state(df).collect()] == [("b2", 4, b"z")]
    half = state.merge_state(state.last_writes(df.where("seq < 3")), df.where("seq >= 3"))
    assert sorted(map(tuple, half.select("key", "seq", "op").collect())) == [("a1", 2, DELETES), ("b2", 4, PUTS)]
    letters = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "k string, v int")
    assert [r["k"] for r in filters.drop_while(letters, (F.col("k") != "B") & (F.col("v") != 2), "k").orderBy("k").collect()] == ["B", "C"]
    ages = spark.createDataFrame([(1, 1), (2, 1), (4, 900), (5, 1), (6, 900)], "slot long, ts_ms long")
    assert [r["slot"] for r in filters.drop_while(ages, F.col("ts_ms") < 500, "slot").orderBy("slot").collect()] == [4, 5, 6]
    assert [r["slot"] for r in filters.fresh(spark.createDataFrame([(1, 0), (2, 15), (3, 3)], "slot long, ts_ms long"), 15, 10).collect()] == [2]


class Failing:
    def handle_put(self, seq, key, body):
        if key == "bad":
            raise RuntimeError("no")

    def handle_delete(self, seq, key):
        pass


def test_handler_errors_are_results(spark):
    out = state.apply_handler(events(spark, [(1, 0, "P", "bad", "x"), (2, 0, "P", "good", "y"), (3, 0, "D", "gone")]), Failing)
    assert tuple(state.replay_counts(out).first()) == (2, 1)


def test_replication(spark):
    df = events(spark, [(i, 0, "P", str(i)) for i in (1, 2, 5, 6, 9)])
    assert sorted(map(tuple, replication.gaps(df).collect())) == [(3, 4), (7, 8)]
    arrived = spark.createDataFrame([(11, 1, "a"), (13, 2, "b"), (10, 3, "c"), (10, 4, "late"), (12, 5, "d"), (15, 6, "e"), (9, 7, "old")], "seq long, arrival long, body string")
    assert sorted((r["seq"], r["body"]) for r in replication.contiguous_prefix(arrived, 10).collect()) == [(10, "c"), (11, "a"), (12, "d"), (13, "b")]
    fold = lambda *o, **k: spark.range(1).select(replication.catch_up_fold(F.array(*map(F.lit, o)), **k).alias("s")).first()["s"].asDict()
    assert fold("COMPLETE", window=20, threshold=100) == {"window": 40, "threshold": 100}
    assert fold("COMPLETE", window=120, threshold=100)["window"] == 122 and fold("COMPLETE", window=1000, threshold=100)["window"] == 1000
    assert fold("FAILED", window=50, threshold=100) == {"window": 1, "threshold": 25} and fold("FAILED", "PARTIAL", window=1, threshold=7) == {"window": 1, "threshold": 7}


def test_consensus(spark):
    ballot = "struct<seq:int,leader:string>"
    votes = spark.createDataFrame([(1, (1, "a"), "one"), (1, (2, "a"), "two"), (2, (1, "a"), "three")], f"slot long, ballot {ballot}, command string")
    assert sorted((r["slot"], r["command"]) for r in consensus.highest_ballots(votes).collect()) == [(1, "two"), (2, "three")]
    x, y = spark.createDataFrame([(1, 5), (2, 3)], "k int, v int"), spark.createDataFrame([(1, 2), (3, 4)], "k int, v int")
    assert dict(map(tuple, consensus.overlay(x, y, "k", "v").collect())) == {1: 2, 2: 3, 3: 4}
    free = lambda *s, start=1: consensus.next_free_slot(spark.createDataFrame([(i,) for i in s], "slot long"), start).first()["slot"]
    assert [free(1), free(1, 2), free(1, 2, 4), free(5), free(1, start=4)] == [2, 3, 3, 1, 4]
    assert consensus.next_free_slot(spark.createDataFrame([], "slot long"), 7).first()["slot"] == 7
    own = spark.createDataFrame([(1, "a"), (2, "b")], "slot long, command string")
    decided = spark.createDataFrame([(1, "a"), (2, "c")], "slot long, command string")
    assert [tuple(r) for r in consensus.clobbered(own, decided).collect()] == [(2, "b", "c")]
    assert [consensus.majority(n) for n in range(4)] == [1, 1, 2, 2]
    old = spark.createDataFrame([(1, (5, "a"), "x", 1), (2, (1, "a"), "y", 1)], f"slot long, ballot {ballot}, command string, ts_ms long")
    new = spark.createDataFrame([(1, (2, "z"), "q", 9), (2, (1, "b"), "r", 9), (3, (0, ""), "s", 9)], old.schema)
    assert sorted((r["slot"], r["command"], r["ts_ms"]) for r in consensus.accept(old, new).collect()) == [(1, "x", 9), (2, "r", 9), (3, "s", 9)]


def test_quorum_and_preemption(spark):
    members = spark.range(1, 4).toDF("acceptor")
    own = spark.createDataFrame([(s, 1) for s in range(1, 7)], "slot long, ballot long")
    cast = {1: [(1, 1), (2, 1)], 2: [(1, 1), (2, 2)], 3: [(1, 1), (1, 1), (9, 1)], 4: [(1, 1), (3, 1), (2, 2)], 5: [(2, 2), (1, 1), (3, 1)], 6: [(1, 1), (2, 2), (3, 2)]}
    votes = spark.createDataFrame([(a, s, b, i) for s, vs in cast.items() for i, (a, b) in enumerate(vs)], "acceptor long, slot long, ballot long, arrival long")
    got = {r["slot"]: r["outcome"] for r in consensus.outcomes(own, votes, members).collect()}
    assert got == {1: "decided", 2: "preempted", 3: "open", 4: "decided", 5: "preempted", 6: "preempted"}
    assert sorted((r["slot"], r["ballot"]) for r in consensus.quorum(votes, members).collect()) == [(1, 1), (4, 1), (5, 1), (6, 2)]
    times = spark.createDataFrame([(1, 1), (2, 900), (4, 1), (5, 900)], "slot long, ts_ms long")
    kept, low = consensus.reaped(times, 1000, 200)
    assert low == 2 and sorted(r["slot"] for r in kept.collect()) == [2, 4, 5]
    assert consensus.reaped(times, 5000, 200)[1] == 6


def test_integers_beyond_doubles(spark):
    waits = spark.createDataFrame([(n,) for n in range(1000)], "w long").select("w", replication.catch_up_timeout_ms(F.col("w")).alias("t")).collect()
    assert all(r["t"] == 1000 + 10 * r["w"] for r in waits)
    big = (1 << 61) + 12345
    assert spark.range(1).select(stats.truncated_average(F.array(F.lit(big), F.lit(big)))).first()[0] == big
    rows = spark.createDataFrame([(1, 10**17), (2, 10**17 + 1), (3, 7)], "seq long, x long")
    assert [tuple(map(int, r)) for r in stats.weighted_average(rows, "x").orderBy("seq").collect()] == [(1, 10**17, 1), (2, 3 * 10**17 + 2, 3), (3, 3 * 10**17 + 23, 6)]


def test_ranges_reach_the_reader(spark):
    from foldlog import schema

    plain = schema.event_log(spark, "/root/testdata/sf0.001", 0)
    for df in (log.seq_range(plain, 200, 300), log.point(plain, 77), log.tail(plain, 20)):
        assert "event_id" in df._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("]")[0]


def test_members_and_statistics(spark):
    m = spark.createDataFrame([("a", "r1", 100), ("b", None, 0), ("x", "r2", 90)], "path string, ref string, last_seen long")
    config = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert sorted(map(tuple, membership.reconcile(m, config).collect())) == [("b", "resolve"), ("c", "resolve"), ("x", "drop")]
    assert [r["path"] for r in membership.dead(m, 135, 3, 10).collect()] == ["b", "x"] and membership.dead(m, 125, 3, 10).count() == 1
    assert membership.random_remote(m, "a", 1).first()["path"] == "x"
    cut = [spark.range(1).select(stats.truncated_average(F.array(*[F.lit(v).cast("long") for v in [50, 100, 1, 1][:n]]))).first()[0] for n in (1, 2, 3, 4)]
    assert cut == [50, 83, 42, 25]


def test_checksum_and_codec(spark):
    line = b"http://en.wikipedia.org/wiki/Fowler_Noll_Vo_hash"
    df = spark.createDataFrame([(b"",), (line,), (None,), (b"\xff\x00" * 9,)], "b binary")
    rows = df.select("b", checksum.fnv1a64(F.col("b")).alias("x"), checksum.fnv1a64_arrow(F.col("b")).alias("y")).collect()
    assert {(r["x"], r["y"]) for r in rows[:3]} == {(-3750763034362895579,) * 2, (-2758076559093427003,) * 2, (None, None)}
    assert rows[3]["x"] == rows[3]["y"] == checksum.fnv1a64_of(b"\xff\x00" * 9)
    df = events(spark, [(1234, 5678, "P", "hello", "world"), (1234, -5, "D", "hello")])
    data = codec.payload(F.col("seq"), F.col("ts_ms"), F.col("op"), F.col("key"), F.col("body"))
    made = [bytes(r[0]) for r in df.select(data).collect()]
    assert made == [struct.pack(">qqiii", 1234, 5678, 1, 5, 5) + b"helloworld", struct.pack(">qqiii", 1234, -5, 2, 5, 0) + b"hello"]
    back = df.select(codec.event(data).alias("e")).select("e.*").collect()
    assert [tuple(r)[:4] for r in back] == [(1234, 5678, PUTS, "hello"), (1234, -5, DELETES, "hello")] and bytes(back[0]["body"]) == b"world" and back[1]["body"] is None
    odd = spark.createDataFrame([(struct.pack(">qqiii", 1, 1, 7, 1, 0) + b"k",)], "d binary")
    assert odd.select(codec.event(F.col("d"), strict=False).alias("e")).first()["e"]["op"] == DELETES
    with pytest.raises(Exception, match="unknown event type 7"):
        odd.select(codec.event(F.col("d"))).collect()


def test_text_functions(spark):
    names = ["hostname", "hostname:1234", "absolute nonsense", "akka://x@h:1/user/y", "/user/z", "sys@host:9/user/q"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(text.full_address(F.col("n"))).collect()]
    assert got == ["akka://log-system@hostname:2552/user/log", "akka://log-system@hostname:1234/user/log", None, "akka://x@h:1/user/y", "/user/z", "akka://sys@host:9/user/q"]
    assert df.select(text.with_transport(F.lit("akka://x"), True)).first()[0] == "akka.ssl.tcp://x"
    assert df.select(text.base_name(F.lit("12.compacting")), text.as_number(F.lit("x"), strict=False), text.as_number(F.lit("12"))).first()[:] == ("12", None, 12)
