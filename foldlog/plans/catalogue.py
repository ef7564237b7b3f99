"""Named queries over the driver's tables, each with its DuckDB counterpart.

A query applies one operator to a whole log. ``query`` registers the function below it together with its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog import schema
from foldlog.functions import checksum, codec, text
from foldlog.operators import compaction, consensus, filters, keys, membership, ordered, replication, segments, state, stats
from foldlog.operators import log as scans
from foldlog.sources import records, shared
from foldlog.streaming import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG = """log AS (SELECT event_id + 1 AS seq, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op,
  user_id::VARCHAR AS key, props AS body, value, event_type FROM events)"""
PLAIN = LOG.replace("event_id + 1 AS seq", "event_id AS seq")
VOTES = "v AS (SELECT user_id % 5 AS acceptor, event_id // 16 AS slot, user_id // 5 % 2 AS ballot, event_id AS arrival FROM events)"
OLOG = """olog AS (SELECT o_orderkey + 1 AS seq, epoch_us(o_orderdate) // 1000 AS ts_ms, CASE WHEN o_orderstatus = 'F' THEN 'DELETE' ELSE 'PUT' END AS op,
  o_custkey::VARCHAR AS key, o_orderpriority AS body FROM orders)"""
PV = """pv AS (SELECT user_id % 5 AS acceptor, event_id // 4 AS slot, user_id % 8 AS bseq, event_type AS leader, event_id AS vote,
  lpad((user_id % 8)::VARCHAR, 4, '0') || rpad(event_type, 20, ' ') || lpad(event_id::VARCHAR, 15, '0') AS ballot,
  event_type || ':' || user_id::VARCHAR AS command, epoch_us(ts) // 1000 AS ts_ms FROM events)"""
SEGS = f"{LOG}, segs AS (SELECT *, ((row_number() OVER (ORDER BY seq) - 1) // 768 + 1)::BIGINT AS seg FROM log)"
OSEGS = f"{OLOG}, segs AS (SELECT *, ((row_number() OVER (ORDER BY seq) - 1) // 768 + 1)::BIGINT AS seg FROM olog)"
CUT = "(SELECT (min(ts_ms) + (max(ts_ms) - min(ts_ms)) // 2)::BIGINT FROM {})"
EVENT = "seq, ts_ms, op, key, body"
COLUMNS = EVENT.split(", ")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.event_log(spark, sf_dir)


def _olog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.order_log(spark, sf_dir)


def _segs(log: DataFrame) -> DataFrame:
    return segments.layout(log, 768)


def _middle(log: DataFrame) -> int:
    """A time in the middle of a log: stands for the clock minus an age, which callers give as a number."""
    low, high = log.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    return 0 if low is None else low + (high - low) // 2


# ---- scans, ranges, limits

@query(f"WITH {LOG} SELECT {EVENT} FROM log")
def log_scan(spark, sf_dir):
    return scans.scan(_log(spark, sf_dir)).select(*COLUMNS)


@query(f"WITH {PLAIN} SELECT {EVENT} FROM log WHERE seq BETWEEN 200 AND 300")
def log_range(spark, sf_dir):
    return scans.seq_range(schema.event_log(spark, sf_dir, 0), 200, 300).select(*COLUMNS)


@query(f"WITH {PLAIN} SELECT {EVENT} FROM log WHERE seq = 77")
def log_point(spark, sf_dir):
    return scans.point(schema.event_log(spark, sf_dir, 0), 77).select(*COLUMNS)


@query(f"WITH {PLAIN} SELECT {EVENT} FROM log WHERE seq BETWEEN (SELECT max(seq) - 20 FROM log) AND (SELECT max(seq) FROM log)")
def log_tail_20(spark, sf_dir):
    return scans.tail(schema.event_log(spark, sf_dir, 0), 20).select(*COLUMNS)


@query(f"WITH {LOG} SELECT {EVENT} FROM log ORDER BY seq DESC LIMIT 20")
def log_tail_count(spark, sf_dir):
    return scans.tail_count(_log(spark, sf_dir), 20).select(*COLUMNS)


@query(f"WITH {PLAIN} SELECT {EVENT} FROM log WHERE seq % 7 <> 1 AND seq BETWEEN 100 AND 900 ORDER BY seq LIMIT 50")
def log_first_n_of_range(spark, sf_dir):
    return scans.first_of_range(schema.replica(schema.event_log(spark, sf_dir, 0), 1), 100, 900, 50).select(*COLUMNS)


@query(f"""WITH {PLAIN}, c AS (SELECT *, coalesce(sum(length(body)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log WHERE seq BETWEEN 10 AND 1000000000)
SELECT {EVENT} FROM c WHERE before < 5000""")
def log_take_while_budget(spark, sf_dir):
    return scans.range_while(schema.event_log(spark, sf_dir, 0), 10, 1_000_000_000, F.length("body"), 5000).select(*COLUMNS)


@query(f"WITH {LOG} SELECT min(seq) AS min_seq, max(seq) AS max_seq, coalesce(max(seq), 0) + 1 AS next_seq, count(*)::BIGINT AS n FROM log")
def seq_bounds(spark, sf_dir):
    return scans.bounds(_log(spark, sf_dir))


_OFFSETS = f"""{LOG}, offs AS (SELECT seq, coalesce(sum(40 + length(encode(key)) + CASE WHEN op = 'PUT' THEN coalesce(length(encode(body)), 0) ELSE 0 END)
  OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM log)"""


@query(f'WITH {_OFFSETS} SELECT seq, "offset" FROM offs'.replace("length(encode", "octet_length(encode"))
def record_offsets(spark, sf_dir):
    return scans.record_offsets(_log(spark, sf_dir))


@query(f'WITH {_OFFSETS} SELECT coalesce(min("offset"), 0)::BIGINT AS first_offset, coalesce(max("offset"), -1)::BIGINT AS last_offset FROM offs WHERE seq BETWEEN 300 AND 400'.replace("length(encode", "octet_length(encode"))
def index_offset_range(spark, sf_dir):
    return scans.offset_range(scans.record_offsets(_log(spark, sf_dir)), 300, 400)


_ASKED = [(1, 20, None), (1, 20, 5), (50, 60, 10), (50, 60, 11), (990, 100_000_000, None), (100_000_000, 100_000_001, None), (30, 20, None), (5, 9, 0), (8, 8, 1), (995, 100_000_000, 5)]


@query(f"""WITH {LOG}, rep AS (SELECT seq FROM log WHERE seq % 7 <> 1), l AS (SELECT coalesce(max(seq), 0) AS last FROM rep),
asked(s, e0, lim) AS (VALUES {", ".join(f"({a}::BIGINT, {b}::BIGINT, {'NULL' if n is None else n}::BIGINT)" for a, b, n in _ASKED)}),
r AS (SELECT *, least(e0, last) AS e, (coalesce(lim, 1) <= 0 OR e0 < s OR e0 <= 0 OR s > last) AS none, (lim IS NULL OR lim > least(e0, last) - s) AS whole FROM asked, l),
f AS (SELECT r.*, (SELECT count(*) FROM rep WHERE seq BETWEEN s AND e) AS found FROM r),
g AS (SELECT f.*, (SELECT list(seq ORDER BY seq) FROM rep WHERE seq BETWEEN s AND e) AS seqs FROM f),
h AS (SELECT *, CASE WHEN whole THEN found ELSE least(found, lim) END AS given, (NOT whole AND found < lim) AS short FROM g)
SELECT s AS "start", e0 AS "end", lim AS "limit",
  CASE WHEN none THEN 'EMPTY' WHEN (whole OR short) AND e < e0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status,
  CASE WHEN NOT none THEN s END AS range_start,
  CASE WHEN NOT none THEN CASE WHEN whole OR short THEN e ELSE seqs[lim] END END AS range_end,
  CASE WHEN none THEN 0 ELSE given END::BIGINT AS n_events FROM h""")
def log_subranges(spark, sf_dir):
    asked = spark.createDataFrame(_ASKED, "start long, end long, limit long")
    return scans.subrange_status(schema.replica(_log(spark, sf_dir), 1), asked)


@query(f"""WITH {LOG}, rep AS (SELECT * FROM log WHERE seq % 7 <> 1), asked(s, e0, lim) AS (VALUES (1::BIGINT, 20::BIGINT, NULL::BIGINT), (1, 20, 5), (50, 60, 10), (995, 100000000, 5)),
r AS (SELECT s, e0, lim, rep.*, row_number() OVER (PARTITION BY s, e0, lim ORDER BY seq) AS i FROM asked JOIN rep ON seq BETWEEN s AND e0)
SELECT s AS "start", e0 AS "end", lim AS "limit", seq, op, key FROM r WHERE lim IS NULL OR i <= lim""")
def log_subrange_events(spark, sf_dir):
    asked = spark.createDataFrame([(1, 20, None), (1, 20, 5), (50, 60, 10), (995, 100_000_000, 5)], "start long, end long, limit long")
    return scans.subrange_events(schema.replica(_log(spark, sf_dir), 1), asked).select("start", "end", "limit", "seq", "op", "key")


@query(f"WITH {LOG} SELECT {EVENT} FROM log ORDER BY seq DESC LIMIT 1000")
def tail_cache(spark, sf_dir):
    return scans.tail_count(_log(spark, sf_dir), 1000).select(*COLUMNS)


@query(f"WITH {LOG} SELECT key, (sum(CASE WHEN op = 'PUT' THEN 1 ELSE -1 END) * 1000 + count(*))::BIGINT AS result FROM log GROUP BY key")
def log_fold(spark, sf_dir):
    return scans.fold(_log(spark, sf_dir).select("seq", "op", "key"), 0, lambda acc, e: acc + (1001 if e["op"] == "PUT" else -999), schema="result long")


# ---- filters

@query(f"WITH {LOG} SELECT {EVENT} FROM log WHERE regexp_matches(key, '[13]')")
def key_filter(spark, sf_dir):
    return filters.key_matches(_log(spark, sf_dir), "[13]").select(*COLUMNS)


@query(f"WITH {LOG} SELECT {EVENT} FROM log WHERE NOT regexp_matches(key, '[13]')")
def key_filter_not(spark, sf_dir):
    return filters.key_matches_not(_log(spark, sf_dir), "[13]").select(*COLUMNS)


@query(f"WITH {LOG} SELECT {EVENT} FROM log WHERE op = 'PUT' OR ts_ms >= {CUT.format('log')}")
def drop_old_deletes(spark, sf_dir):
    log = _log(spark, sf_dir)
    return filters.without_old_deletes(log, _middle(log)).select(*COLUMNS)


@query(f"WITH {LOG} SELECT {EVENT} FROM log WHERE NOT (op = 'PUT' AND regexp_matches(key, '[13]') AND ts_ms < {CUT.format('log')})")
def drop_old_puts(spark, sf_dir):
    log = _log(spark, sf_dir)
    return filters.without_old_puts(log, "[13]", _middle(log)).select(*COLUMNS)


@query(f"WITH {LOG}, f AS (SELECT min(seq) AS first FROM log WHERE NOT (value < 90)) SELECT seq, ts_ms, op, key FROM log, f WHERE seq >= first")
def drop_while_prefix(spark, sf_dir):
    return filters.drop_while(_log(spark, sf_dir), F.col("value") < 90, "seq").select("seq", "ts_ms", "op", "key")


@query(f"WITH {PV} SELECT slot, vote, command FROM pv WHERE slot > 150")
def undecided_accepted(spark, sf_dir):
    return filters.undecided(schema.proposals(spark, sf_dir), 150).select("slot", "ballot.vote", "command")


@query(f"WITH {PV} SELECT slot, vote, command FROM pv WHERE ts_ms >= {CUT.format('pv')}")
def fresh_proposals(spark, sf_dir):
    pv = schema.proposals(spark, sf_dir)
    now = _middle(pv) + 10_000
    return filters.fresh(pv, now, 10_000).select("slot", "ballot.vote", "command")


@query(f"WITH {PV}, d AS (SELECT slot, arg_max(command, ballot) AS command FROM pv GROUP BY slot) SELECT slot, command FROM d WHERE slot > 100")
def decisions_after_hint(spark, sf_dir):
    decided = consensus.highest_ballots(schema.proposals(spark, sf_dir)).select("slot", "command")
    return filters.after_hint(decided, 100)


# ---- keys and state

@query(f"WITH {LOG}, s AS (SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(body, seq) AS body FROM log GROUP BY key) SELECT key, seq, body FROM s WHERE op = 'PUT'")
def live_state(spark, sf_dir):
    return state.live_state(_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(ts_ms, seq) AS ts_ms, arg_max(body, seq) AS body FROM log GROUP BY key")
def last_write_per_key(spark, sf_dir):
    return state.last_writes(_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(ts_ms, seq) AS ts_ms, arg_max(body, seq) AS body FROM log GROUP BY key")
def incremental_state(spark, sf_dir):
    log = _log(spark, sf_dir)
    half = log.where("seq % 2 = 0")
    return state.merge_state(state.last_writes(half), log.where("seq % 2 = 1").select(*COLUMNS)).select("key", "seq", "op", "ts_ms", "body")


@query("SELECT l_orderkey AS key, max(l_linenumber * 1000000 + l_partkey)::BIGINT AS seq, arg_max(l_quantity, l_linenumber * 1000000 + l_partkey) AS body FROM (SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY 1")
def lineitem_last_write(spark, sf_dir):
    items = schema.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("body"))
    seq = (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long")
    log = items.select(F.col("l_orderkey").alias("key"), seq.alias("seq"), F.lit("PUT").alias("op"), F.lit(0).cast("long").alias("ts_ms"), "body")
    return state.live_state(log)


@query("SELECT key, seq, 'ok' AS status, NULL::VARCHAR AS error FROM (SELECT user_id::VARCHAR AS key, max(event_id + 1) AS seq FROM events GROUP BY 1)")
def handler_replay(spark, sf_dir):
    return state.apply_handler(_log(spark, sf_dir), _Memory)


class _Memory:
    """A handler that keeps a map."""

    def __init__(self):
        self.kept: dict = {}

    def handle_put(self, seq, key, body):
        self.kept[key] = (seq, body)

    def handle_delete(self, seq, key):
        self.kept.pop(key, None)


_LIVE = "SELECT key FROM (SELECT key, arg_max(op, seq) AS op FROM {} GROUP BY key) WHERE op = 'PUT'"


@query(f"WITH {LOG} {_LIVE.format('log')}")
def live_keys(spark, sf_dir):
    return keys.live(_log(spark, sf_dir))


@query(f"WITH {LOG}, m AS (SELECT * FROM log WHERE regexp_matches(key, '[13]')) {_LIVE.format('m')}")
def live_keys_filtered(spark, sf_dir):
    return keys.live_matching(_log(spark, sf_dir), "[13]")


@query(f"WITH {LOG} SELECT DISTINCT key FROM log WHERE op = 'PUT' AND regexp_matches(key, '[13]') AND ts_ms < {CUT.format('log')}")
def put_keys_older_than(spark, sf_dir):
    log = _log(spark, sf_dir)
    return keys.with_old_puts(log, "[13]", _middle(log))


@query(f"WITH {SEGS} SELECT DISTINCT key FROM segs WHERE seg = 2")
def segment_keys(spark, sf_dir):
    return keys.of_segment(_segs(_log(spark, sf_dir)), 2)


# ---- segments and compaction

@query(f"WITH {SEGS} SELECT seq, seg FROM segs")
def segment_layout(spark, sf_dir):
    return _segs(_log(spark, sf_dir)).select("seq", "seg")


@query(f"WITH {SEGS} SELECT seg, count(*)::BIGINT AS n, min(seq) AS min_seq, max(seq) AS max_seq, seg = (SELECT max(seg) FROM segs) AS is_live FROM segs GROUP BY seg")
def segment_manifest(spark, sf_dir):
    return segments.manifest(_segs(_log(spark, sf_dir))).select("seg", "n", "min_seq", "max_seq", "is_live")


@query(f"WITH {SEGS} SELECT seg, sum(40 + octet_length(encode(key)) + CASE WHEN op = 'PUT' THEN coalesce(octet_length(encode(body)), 0) ELSE 0 END)::BIGINT AS bytes FROM segs GROUP BY seg")
def segment_bytes(spark, sf_dir):
    return segments.segment_bytes(_segs(_log(spark, sf_dir)))


@query(f"WITH {SEGS}, m AS (SELECT max(seg) AS live FROM segs) SELECT DISTINCT seg FROM segs, m WHERE seg < live")
def compaction_candidates(spark, sf_dir):
    return segments.internal_candidates(segments.manifest(_segs(_log(spark, sf_dir)))).select("seg")


_SINGLE = "SELECT {e} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {t}) WHERE r = 1 AND NOT (op = 'DELETE' AND ts_ms <= {c})"


@query(f"WITH {LOG} {_SINGLE.format(e=EVENT, t='log', c=CUT.format('log'))}")
def compact_log_cutoff(spark, sf_dir):
    log = _log(spark, sf_dir)
    return compaction.single_log(log, _middle(log)).select(*COLUMNS)


@query(f"WITH {OLOG} {_SINGLE.format(e=EVENT, t='olog', c=CUT.format('olog'))}")
def order_log_compaction(spark, sf_dir):
    log = _olog(spark, sf_dir)
    return compaction.single_log(log, _middle(log)).select(*COLUMNS)


@query(f"WITH {OSEGS} SELECT seg, {EVENT} FROM segs QUALIFY row_number() OVER (PARTITION BY seg, key ORDER BY seq DESC) = 1")
def internal_compaction(spark, sf_dir):
    return compaction.internal(_segs(_olog(spark, sf_dir))).select("seg", *COLUMNS)


@query(f"""WITH {OSEGS}, i AS (SELECT * FROM segs QUALIFY row_number() OVER (PARTITION BY seg, key ORDER BY seq DESC) = 1)
SELECT seg, {EVENT} FROM i WHERE seg < 2 AND key NOT IN (SELECT key FROM i WHERE seg = 2) AND NOT (op = 'DELETE' AND ts_ms < {CUT.format('olog')})""")
def compact_against(spark, sf_dir):
    log = _olog(spark, sf_dir)
    return compaction.against(compaction.internal(_segs(log)), 2, _middle(log)).select("seg", *COLUMNS)


@query(f"""WITH {OSEGS}, m AS (SELECT max(seg) AS live FROM segs), ro AS (SELECT segs.* FROM segs, m WHERE seg < live),
l AS (SELECT * FROM ro QUALIFY row_number() OVER (PARTITION BY key ORDER BY seg DESC, seq DESC) = 1)
SELECT seg, {EVENT} FROM l WHERE NOT (op = 'DELETE' AND ts_ms < {CUT.format('olog')} AND seg < coalesce((SELECT max(seg) FROM ro), -1))
UNION ALL SELECT seg, {EVENT} FROM segs, m WHERE seg >= live""")
def segmented_compaction(spark, sf_dir):
    log = _olog(spark, sf_dir)
    return compaction.segmented(_segs(log), _middle(log)).select("seg", *COLUMNS)


@query(f"""WITH RECURSIVE {OSEGS}, m AS (SELECT max(seg) AS live FROM segs), ro AS (SELECT segs.* FROM segs, m WHERE seg < live),
l AS (SELECT * FROM ro QUALIFY row_number() OVER (PARTITION BY key ORDER BY seg DESC, seq DESC) = 1),
c AS (SELECT s.seg, count(l.seq)::BIGINT AS n FROM (SELECT DISTINCT seg FROM ro) s LEFT JOIN l ON l.seg = s.seg GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY seg) AS i FROM c),
w AS (SELECT i, seg, n, seg AS into_, n AS total FROM k WHERE i = 1
  UNION ALL SELECT k.i, k.seg, k.n, CASE WHEN w.total + k.n <= 600 THEN w.into_ ELSE k.seg END, CASE WHEN w.total + k.n <= 600 THEN w.total + k.n ELSE k.n END FROM w JOIN k ON k.i = w.i + 1)
SELECT seg, n, into_ AS "into" FROM w""")
def merged_segments(spark, sf_dir):
    laid = _segs(_olog(spark, sf_dir))
    after = compaction.segmented(laid, 0)
    rows = segments.manifest(laid).where(~F.col("is_live")).select("seg")
    counts = after.groupBy("seg").agg(F.count(F.lit(1)).alias("n"))
    full = rows.join(counts, "seg", "left").select("seg", F.coalesce("n", F.lit(0)).alias("n"), F.lit(True).alias("applied"))
    return segments.merge_plan(full, 600)


@query(f"WITH {SEGS} SELECT seq, op, key, body, 1::BIGINT AS seg FROM segs WHERE seg IN (1, 2)")
def merge_two_segments(spark, sf_dir):
    laid = _segs(_log(spark, sf_dir)).select("seq", "op", "key", "body", "seg")
    return segments.union(laid.where("seg = 1"), laid.where("seg = 2"), 1)


@query(f"WITH {LOG} SELECT {EVENT} FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log)")
def refused_appends(spark, sf_dir):
    log = _log(spark, sf_dir).select(*COLUMNS)
    half = (scans.bounds(log).first()["max_seq"] or 0) // 2
    return segments.check_append(log.where(F.col("seq") <= half), log)


@query("""WITH n AS (SELECT event_id // 5 AS base, bool_or(event_id % 7 = 0) AS plain, bool_or(event_id % 7 = 1) AS temp, bool_or(event_id % 7 = 2) AS compacting FROM events WHERE event_id % 7 < 3 GROUP BY 1)
SELECT base::VARCHAR AS base, CASE WHEN plain AND compacting THEN 'drop compacting' WHEN temp AND compacting THEN 'promote compacting' WHEN plain AND temp THEN 'drop temp' ELSE 'none' END AS action FROM n""")
def repair_plan(spark, sf_dir):
    e = schema.table(spark, sf_dir, "events")
    kind = F.col("event_id") % 7
    suffix = F.when(kind == 0, "").when(kind == 1, ".temp").when(kind == 2, ".compacting")
    return segments.repair_plan(e.select(F.concat(F.expr("event_id div 5").cast("string"), suffix).alias("name")).where(F.col("name").isNotNull()))


@query(f"WITH {_OFFSETS} SELECT seq, \"offset\" FROM offs WHERE seq > (SELECT max(seq) FROM offs WHERE seq <= 900)".replace("length(encode", "octet_length(encode"))
def index_repair(spark, sf_dir):
    data = scans.record_offsets(_log(spark, sf_dir))
    return records.missing_from_index(data, data.where("seq <= 900"))


# ---- replicas

@query(f"WITH {LOG}, g AS (SELECT seq, lead(seq) OVER (ORDER BY seq) AS nx FROM log WHERE seq % 7 <> 1) SELECT seq + 1 AS gap_start, nx - 1 AS gap_end FROM g WHERE nx - seq > 1")
def replica_gaps(spark, sf_dir):
    return replication.gaps(schema.replica(_log(spark, sf_dir), 1))


@query(f"""WITH {LOG}, a AS (SELECT * FROM log WHERE seq % 97 <> 0 AND seq >= 12), r AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn FROM a)
SELECT seq, op, key, body FROM r WHERE seq - rn = 11""")
def contiguous_prefix(spark, sf_dir):
    arrived = _log(spark, sf_dir).where("seq % 97 <> 0").select("seq", "op", "key", "body", F.xxhash64("seq").alias("arrival"))
    return replication.contiguous_prefix(arrived, 12).select("seq", "op", "key", "body")


@query(f"""WITH {LOG}, a AS (SELECT seq, op, key, body FROM log WHERE seq % 7 <> 1), b AS (SELECT seq, op, key, body FROM log WHERE seq % 7 <> 2)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def replica_divergence(spark, sf_dir):
    log = _log(spark, sf_dir)
    return replication.divergence(schema.replica(log, 1), schema.replica(log, 2))


_OUTCOMES = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PARTIAL' ELSE 'COMPLETE' END"


@query(f"""WITH RECURSIVE o AS (SELECT user_id AS node, {_OUTCOMES} AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
n AS (SELECT node, max(i) AS last FROM o GROUP BY 1),
f AS (SELECT node, 0::BIGINT AS i, 1 AS w, 500 AS s FROM n
  UNION ALL SELECT f.node, o.i,
    CASE WHEN outcome = 'COMPLETE' THEN least(CASE WHEN w < s THEN least(w * 2, s) ELSE w + 2 END, 1000) WHEN outcome = 'FAILED' AND w > 1 THEN 1 ELSE w END,
    CASE WHEN outcome = 'FAILED' AND w > 1 THEN greatest(w // 2, 1) ELSE s END
  FROM f JOIN o ON o.node = f.node AND o.i = f.i + 1)
SELECT f.node, w AS "window", s AS threshold FROM f JOIN n ON n.node = f.node AND n.last = f.i""")
def catch_up_windows(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "PARTIAL").otherwise("COMPLETE")
    outcomes = schema.table(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("step"), kind.alias("outcome"))
    return replication.catch_up(outcomes)


@query(f"""WITH {LOG}, r AS (SELECT seq, seq % 5 AS replica FROM log WHERE seq % 11 <> 3) SELECT replica, max(seq) AS max_seq, count(*)::BIGINT AS n, (SELECT max(seq) FROM r) - max(seq) AS behind FROM r GROUP BY replica""")
def replica_lag(spark, sf_dir):
    return replication.lag_of_replicas(_log(spark, sf_dir).where("seq % 11 <> 3").select("seq", (F.col("seq") % 5).alias("replica")))


# ---- consensus and members

@query(f"WITH {PV} SELECT slot, arg_max(command, ballot) AS command, arg_max(bseq, ballot) AS ballot_seq, arg_max(vote, ballot) AS vote FROM pv GROUP BY slot")
def pmax_per_slot(spark, sf_dir):
    return consensus.highest_ballots(schema.proposals(spark, sf_dir)).select("slot", "command", F.col("ballot.seq").alias("ballot_seq"), F.col("ballot.vote").alias("vote"))


@query(f"WITH {VOTES} SELECT slot, ballot, count(DISTINCT acceptor)::BIGINT AS acceptors FROM v WHERE acceptor < 4 GROUP BY slot, ballot HAVING count(DISTINCT acceptor) >= 3")
def quorum_slots(spark, sf_dir):
    return consensus.quorum(schema.votes(spark, sf_dir), spark.range(4).toDF("acceptor"))


_OUTCOMES_SQL = f"""WITH {VOTES}, s AS (SELECT DISTINCT slot FROM v), f AS (SELECT slot, acceptor, min(arrival) AS a FROM v WHERE ballot = 0 AND acceptor < 4 GROUP BY 1, 2),
q AS (SELECT slot, a AS third FROM f QUALIFY row_number() OVER (PARTITION BY slot ORDER BY a) = 3), p AS (SELECT slot, min(arrival) AS other FROM v WHERE ballot > 0 GROUP BY 1),
o AS (SELECT slot, CASE WHEN other < coalesce(third, other + 1) THEN 'preempted' WHEN third IS NOT NULL THEN 'decided' ELSE 'open' END AS outcome FROM s LEFT JOIN q USING (slot) LEFT JOIN p USING (slot))"""


def _first_ballots(spark, sf_dir):
    cast = schema.votes(spark, sf_dir)
    return cast.select("slot", F.lit(0).cast("long").alias("ballot")).distinct(), cast, spark.range(4).toDF("acceptor")


@query(f"{_OUTCOMES_SQL} SELECT slot, outcome FROM o")
def proposal_outcomes(spark, sf_dir):
    return consensus.outcomes(*_first_ballots(spark, sf_dir)).select("slot", "outcome")


@query(f"{_OUTCOMES_SQL} SELECT slot FROM o WHERE outcome = 'preempted'")
def preempted_slots(spark, sf_dir):
    return consensus.preempted(*_first_ballots(spark, sf_dir))


@query(f"WITH {PV}, w AS (SELECT min(slot) AS low FROM pv WHERE ts_ms >= {CUT.format('pv')}) SELECT slot, vote, command FROM pv, w WHERE slot >= low")
def reaped_accepts(spark, sf_dir):
    pv = schema.proposals(spark, sf_dir)
    return consensus.reaped(pv, _middle(pv) + 10_000, 10_000)[0].select("slot", "ballot.vote", "command")


_OWN = "own AS (SELECT slot, arg_max(command, ballot) AS command FROM pv WHERE acceptor = 1 GROUP BY slot), dec AS (SELECT slot, arg_max(command, ballot) AS command FROM pv WHERE acceptor <> 1 GROUP BY slot)"


def _own(spark, sf_dir):
    pv = schema.proposals(spark, sf_dir)
    best = lambda df: consensus.highest_ballots(df).select("slot", "command")
    return best(pv.where("acceptor = 1")), best(pv.where("acceptor <> 1"))


@query(f"WITH {PV}, {_OWN} SELECT coalesce(d.slot, o.slot) AS slot, coalesce(d.command, o.command) AS command FROM own o FULL JOIN dec d ON o.slot = d.slot")
def overlay_maps(spark, sf_dir):
    return consensus.overlay(*_own(spark, sf_dir), "slot", "command")


@query(f"WITH {PV}, {_OWN} SELECT o.slot, o.command, d.command AS decided FROM own o JOIN dec d ON o.slot = d.slot WHERE o.command <> d.command")
def clobbered_proposals(spark, sf_dir):
    return consensus.clobbered(*_own(spark, sf_dir))


@query(f"""WITH {PV}, {_OWN}, l AS (SELECT o.slot, o.command, row_number() OVER (ORDER BY o.slot) AS rn FROM own o JOIN dec d ON o.slot = d.slot WHERE o.command <> d.command)
SELECT (SELECT max(slot) FROM pv) + rn AS slot, command, slot AS from_slot FROM l""")
def reproposed_slots(spark, sf_dir):
    own, decided = _own(spark, sf_dir)
    return consensus.reproposed(own, decided, schema.proposals(spark, sf_dir), 1)


@query(f"""WITH {PV}, {_OWN}, u AS (SELECT slot FROM own UNION SELECT slot FROM dec WHERE slot % 13 <> 5)
SELECT min(s) AS slot FROM (SELECT 3 AS s UNION ALL SELECT slot + 1 FROM u WHERE slot >= 3) WHERE s NOT IN (SELECT slot FROM u)""")
def next_free_slot(spark, sf_dir):
    own, decided = _own(spark, sf_dir)
    return consensus.next_free_slot(own.select("slot").union(decided.where("slot % 13 <> 5").select("slot")), 3)


@query(f"""WITH {PV}, a AS (SELECT slot, max(ballot) AS ballot, arg_max(command, ballot) AS command, max(ts_ms) AS ts_ms FROM pv WHERE acceptor < 2 GROUP BY slot),
b AS (SELECT slot, max(ballot) AS ballot, arg_max(command, ballot) AS command, max(ts_ms) AS ts_ms FROM pv WHERE acceptor >= 2 GROUP BY slot)
SELECT coalesce(a.slot, b.slot) AS slot, CASE WHEN a.slot IS NOT NULL AND (b.slot IS NULL OR a.ballot > b.ballot) THEN a.command ELSE b.command END AS command, coalesce(b.ts_ms, a.ts_ms) AS ts_ms
FROM a FULL JOIN b ON a.slot = b.slot""")
def conflicting_accepts(spark, sf_dir):
    pv = schema.proposals(spark, sf_dir)
    best = lambda df: df.groupBy("slot").agg(F.max("ballot").alias("ballot"), F.max_by("command", "ballot").alias("command"), F.max("ts_ms").alias("ts_ms"))
    return consensus.accept(best(pv.where("acceptor < 2")), best(pv.where("acceptor >= 2"))).select("slot", "command", "ts_ms")


@query(f"WITH {PV} SELECT DISTINCT slot, vote, command FROM pv")
def all_accepted(spark, sf_dir):
    return consensus.all_accepted(schema.proposals(spark, sf_dir)).select("slot", "ballot.vote", "command")


@query("SELECT floor(count(*) / 2 + 1)::BIGINT AS majority FROM customer")
def simple_majority(spark, sf_dir):
    return consensus.majority_of(schema.table(spark, sf_dir, "customer"))


_MEMBERS = "m AS (SELECT user_id::VARCHAR AS path, CASE WHEN user_id % 4 <> 0 THEN 'ref' || user_id::VARCHAR END AS ref, epoch_us(max(ts)) // 1000 AS last_seen FROM events GROUP BY user_id)"


def _members(spark, sf_dir):
    e = schema.table(spark, sf_dir, "events")
    rows = e.groupBy("user_id").agg(schema.epoch_ms(F.max("ts")).alias("last_seen"))
    ref = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("ref"), F.col("user_id").cast("string")))
    return rows.select(F.col("user_id").cast("string").alias("path"), ref.alias("ref"), "last_seen")


@query(f"WITH {_MEMBERS} SELECT path, ref FROM m WHERE ref IS NOT NULL")
def active_members(spark, sf_dir):
    return membership.active(_members(spark, sf_dir)).select("path", "ref")


@query(f"WITH {_MEMBERS} SELECT path, last_seen FROM m WHERE (SELECT max(last_seen) FROM m) - last_seen > 3 * 600000 + 300000")
def dead_members(spark, sf_dir):
    members = _members(spark, sf_dir)
    now = members.agg(F.max("last_seen")).first()[0] or 0
    return membership.dead(members, now, 3, 600_000).select("path", "last_seen")


@query(f"""WITH {_MEMBERS}, c AS (SELECT (user_id + 3)::VARCHAR AS path FROM events GROUP BY 1)
SELECT path, 'drop' AS action FROM m WHERE path NOT IN (SELECT path FROM c)
UNION ALL SELECT c.path, 'resolve' FROM c LEFT JOIN m ON m.path = c.path WHERE m.ref IS NULL""")
def membership_reconcile(spark, sf_dir):
    config = schema.table(spark, sf_dir, "events").select((F.col("user_id") + 3).cast("string").alias("path")).distinct()
    return membership.reconcile(_members(spark, sf_dir), config)


@query(f"""WITH {LOG} SELECT key AS path, max(ts_ms) AS last_seen, arg_max(length(body), (ts_ms - 1700000000000) * 1000000 + seq)::BIGINT AS round_trip, (SELECT max(ts_ms) FROM log) - max(ts_ms) AS age_ms FROM log GROUP BY key""")
def member_staleness(spark, sf_dir):
    log = _log(spark, sf_dir)
    now = log.agg(F.max("ts_ms")).first()[0] or 0
    pings = log.select(F.col("key").alias("path"), "seq", "ts_ms", F.length("body").cast("long").alias("round_trip"))
    return membership.ages(pings, now)


# ---- statistics

@query("SELECT event_type, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share, round(1 - (SELECT count(*) FROM events WHERE event_type = 'view') / sum(count(*)) OVER (), 4) AS error_rate FROM events GROUP BY 1")
def status_report(spark, sf_dir):
    return stats.replay_report(schema.table(spark, sf_dir, "events"), "event_type", "view")


@query("""WITH r AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS batch, event_type, 1 + event_id % 97 AS ms FROM events)
SELECT batch::BIGINT AS batch, count(*)::BIGINT AS n, (sum(ms) // count(*))::BIGINT AS average_ms, round(count(*) FILTER (event_type <> 'view') / count(*), 4) AS error_rate, round(1000 * count(*) / sum(ms), 4) AS per_second FROM r GROUP BY 1""")
def batch_report(spark, sf_dir):
    events = schema.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", 200).otherwise(500)
    return stats.batch_report(events.select(F.col("event_id").alias("seq"), status.alias("status"), (1 + F.col("event_id") % 97).alias("ms")), 1000)


@query(f"WITH {LOG}, n AS (SELECT seq, length(body) AS x, row_number() OVER (ORDER BY seq) AS i FROM log) SELECT seq, (sum(i * x) OVER (ORDER BY seq))::BIGINT AS numerator, (i * (i + 1) // 2)::BIGINT AS denominator FROM n")
def weighted_avg_write(spark, sf_dir):
    rows = _log(spark, sf_dir).select("seq", F.length("body").cast("long").alias("x"))
    return stats.weighted_average(rows, "x").withColumn("numerator", F.col("numerator").cast("long"))


@query(f"""WITH RECURSIVE {LOG}, v AS (SELECT key, length(body)::BIGINT AS x, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM log),
f AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS a FROM v
  UNION ALL SELECT f.key, v.i, (2 * (f.a * (f.i * (f.i + 1) // 2) + v.x * v.i)) // (v.i * (v.i + 1)) FROM f JOIN v ON v.key = f.key AND v.i = f.i + 1)
SELECT key, max(a) FILTER (i = n)::BIGINT AS average FROM (SELECT f.*, max(i) OVER (PARTITION BY key) AS n FROM f) GROUP BY key""")
def truncated_avg_per_key(spark, sf_dir):
    rows = _log(spark, sf_dir).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", F.length("body").cast("long").alias("x")))).alias("xs"))
    return rows.select("key", stats.truncated_average(F.transform("xs", lambda s: s["x"])).alias("average"))


@query(f"WITH {LOG} SELECT arg_max(length(body), seq)::BIGINT AS last, max(length(body))::BIGINT AS longest FROM log")
def longest_duration(spark, sf_dir):
    return stats.longest(_log(spark, sf_dir).select("seq", F.length("body").cast("long").alias("x")), "x")


@query("SELECT event_type AS bean, 'n=' || count(*) || ',users=' || count(DISTINCT user_id) AS metrics FROM events GROUP BY 1")
def metric_maps(spark, sf_dir):
    e = schema.table(spark, sf_dir, "events")
    counts = e.groupBy(F.col("event_type").alias("bean")).agg(F.count(F.lit(1)).cast("string").alias("n"), F.count_distinct("user_id").cast("string").alias("users"))
    rows = counts.select("bean", F.explode(F.create_map(F.lit("n"), "n", F.lit("users"), "users")).alias("attribute", "value"), F.lit(None).cast("string").alias("error"))
    shown = F.array_join(F.transform(F.map_entries("metrics"), lambda m: F.concat(m["key"], F.lit("="), m["value"])), ",")
    return stats.metric_map(rows).select("bean", shown.alias("metrics"))


# ---- scalar functions

_FNV = """WITH RECURSIVE b AS (SELECT event_id + 1 AS seq, CASE WHEN props IS NULL THEN NULL ELSE encode(props) END AS d FROM events WHERE event_id < 500),
h AS (SELECT seq, d, 0 AS i, 14695981039346656037::UHUGEINT AS h FROM b WHERE d IS NOT NULL
  UNION ALL SELECT seq, d, i + 1, (xor(h, ('0x' || hex(d)[2 * i + 1:2 * i + 2])::UHUGEINT) * 1099511628211) % 18446744073709551616::UHUGEINT FROM h WHERE i < octet_length(d))
SELECT seq, (CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END)::BIGINT AS checksum FROM h WHERE i = octet_length(d)"""


@query(_FNV.replace(" WHERE event_id < 500", ""))
def fnv1a_checksum(spark, sf_dir):
    return _log(spark, sf_dir).select("seq", checksum.fnv1a64(F.col("body").cast("binary")).alias("checksum"))


def _hex(x: str, width: int) -> str:
    return f"lpad(lower(to_hex({x})), {width}, '0')"


@query(f"""WITH {LOG}, p AS (SELECT *, CASE WHEN op = 'PUT' THEN body ELSE '' END AS b FROM log)
SELECT seq, {_hex('seq', 16)} || {_hex('ts_ms', 16)} || CASE WHEN op = 'PUT' THEN '00000001' ELSE '00000002' END || {_hex('octet_length(encode(key))', 8)} || {_hex('octet_length(encode(b))', 8)} || lower(hex(encode(key))) || lower(hex(encode(b))) AS bytes FROM p""")
def encoded_events(spark, sf_dir):
    data = codec.payload(F.col("seq"), F.col("ts_ms"), F.col("op"), F.col("key"), F.col("body"))
    return _log(spark, sf_dir).select("seq", F.lower(F.hex(data)).alias("bytes"))


@query(f"WITH {LOG} SELECT seq, ts_ms, op, key, CASE WHEN op = 'PUT' THEN body END AS body, true AS whole FROM log")
def decoded_frames(spark, sf_dir):
    data = codec.payload(F.col("seq"), F.col("ts_ms"), F.col("op"), F.col("key"), F.col("body"))
    records = _log(spark, sf_dir).select(codec.frame(data).alias("record"))
    event = codec.event(F.substring("record", F.lit(13), F.octet_length("record")))
    return records.select(event.alias("e"), codec.frame_is_whole(F.col("record")).alias("whole")).select("e.seq", "e.ts_ms", "e.op", "e.key", F.col("e.body").cast("string").alias("body"), "whole")


@query(f"WITH {LOG} SELECT seq, seq || ' ' || ts_ms || ' ' || op || ' ' || key AS line, 'http://h/backend/' || key AS url FROM log")
def formatted_events(spark, sf_dir):
    return _log(spark, sf_dir).select("seq", text.event_line().alias("line"), text.replay_url("http://h", F.col("key")).alias("url"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'akka.tcp://log-system@host' || c_custkey || ':2552/user/log' WHEN c_custkey % 3 = 1 THEN 'akka.tcp://log-system@host' || c_custkey || ':99/user/log' ELSE NULL END AS address FROM customer""")
def node_addresses(spark, sf_dir):
    c = schema.table(spark, sf_dir, "customer")
    host = F.concat(F.lit("host"), F.col("c_custkey").cast("string"))
    name = F.when(F.col("c_custkey") % 3 == 0, host).when(F.col("c_custkey") % 3 == 1, F.concat(host, F.lit(":99"))).otherwise("no such thing")
    return c.select(F.col("c_custkey").alias("id"), text.with_transport(text.full_address(name)).alias("address"))


@query(f"WITH {LOG} SELECT seq, CASE WHEN op = 'DELETE' THEN 'error' WHEN body IS NULL THEN 'none' ELSE 'ok' END AS status, CASE WHEN op <> 'DELETE' THEN body END AS value FROM log")
def wrapped_results(spark, sf_dir):
    r = text.result(F.col("body"), F.when(F.col("op") == "DELETE", "deleted"))
    return _log(spark, sf_dir).select("seq", r.alias("r")).select("seq", "r.status", "r.value")


@query("SELECT event_id AS id, (1000 + 10 * (event_id % 1000))::BIGINT AS timeout_ms FROM events")
def catch_up_timeouts(spark, sf_dir):
    window = F.col("event_id") % 1000
    return schema.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), replication.catch_up_timeout_ms(window).alias("timeout_ms"))


# ---- streams

@query("SELECT (event_id // 1000)::VARCHAR AS log, event_id % 1000 + 1 AS position, event_id % 1000 + 1 AS seq FROM events")
def ordered_delivery_stream(spark, sf_dir):
    bridge.use_state_store(spark)
    events = schema.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    # Many logs of 1000 events each, which arrive in no order.
    seq = F.col("event_id") % 1000 + 1
    rows = stream.select(
        F.expr("event_id div 1000").cast("string").alias("log"), F.xxhash64("event_id").alias("arrival"), F.lit("event").alias("kind"), seq.alias("seq"),
        F.lit("PUT").alias("op"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("body"),
    )
    out, marks = shared.fresh_path(spark, "delivered"), shared.fresh_path(spark, "delivered-marks")
    run = bridge.ordered_delivery(rows).writeStream.option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start(out, format="parquet")
    run.awaitTermination()
    return spark.read.schema(bridge.OUTPUT).parquet(out).select("log", "position", "seq")


@query(f"WITH {LOG} SELECT key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(body, seq) AS body FROM log GROUP BY key")
def streamed_state(spark, sf_dir):
    events = schema.table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    rows = stream.select((F.col("event_id") + 1).alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("body"))
    last = rows.groupBy("key").agg(F.max_by(F.struct("op", "body"), "seq").alias("e"), F.max("seq").alias("seq")).select("key", "seq", "e.op", "e.body")
    out, marks = shared.fresh_path(spark, "state"), shared.fresh_path(spark, "state-marks")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    run = last.writeStream.foreachBatch(keep).option("checkpointLocation", marks).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(last.schema).parquet(out)
