"""Keyed state kept by batches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import keyedtable, state
from quire.session import scratch
from quire.sources.tables import table
from quire.streaming import claims, jobs

RULES = state.Rules(keep=("payload",), positive=("score",), always=("status",), stage=("category",))


def _changes(spark, d):
    """events as what each tells of its user's state."""
    e = table(spark, d, "events").select(
        "user_id", "event_id", F.col("event_type").alias("status"), F.when(F.col("value") > 60, F.col("event_type")).otherwise("").alias("category"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("payload"),
        (F.col("value") - 50).alias("score"), F.when(F.col("event_type") == "purchase", "tagging").otherwise("other").alias("stage"),
    )
    return state.as_state(e, "user_id", "event_id", RULES)


def state_merge_incremental(spark, d):
    """The state of each user from three batches in a keyed table, the last of them sent twice."""
    rows, path = _changes(spark, d), scratch(spark)
    t = keyedtable.create(spark, path, rows.schema, "user_id", 32)
    for n, part in enumerate((1, 0, 2, 2)):
        batch = _changes_of(spark, d, part)
        t = keyedtable.apply(spark, t, batch, lambda r: state.merge_states(r, "user_id"), "events", min(n, 2))
    return state.finished(keyedtable.read(spark, t), "user_id")


def _changes_of(spark, d, part):
    rows = _changes(spark, d)
    return rows.where(F.col("status.s") % 3 == part)


def stale_claims_stream(spark, d):
    """orders as a replayed stream of claims: those that the watermark has passed by half an hour are pending again."""
    stream = jobs.event_stream(spark, d, "orders.parquet")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed")
    changes = jobs.run_once(claims.claim_changes(stream.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("at")), 1800), "update")
    return claims.current_status(changes)


QUERIES = {f.__name__: f for f in (state_merge_incremental, stale_claims_stream)}

_LAST = lambda c, ok, name: f"arg_max({c}, event_id) filter (where {ok}) as {name}"
SQL = {
    "state_merge_incremental": f"select user_id, {_LAST('props', 'event_id % 3 <> 0', 'payload')}, {_LAST('value - 50', 'value - 50 > 0', 'score')}, arg_max(event_type, event_id) as status, {_LAST('''case when value > 60 then event_type else '' end''', '''value > 60 or event_type = 'purchase' ''', 'category')} from events group by user_id",
    "stale_claims_stream": "select o_orderkey as id, case when o_orderstatus = 'O' or (o_orderstatus = 'P' and o_orderdate < max(o_orderdate) over () - interval 1800 seconds) then 'pending' when o_orderstatus = 'P' then 'processing' else 'completed' end as status from orders",
}
