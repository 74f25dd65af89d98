"""Cohort retention: cells of clients by the period of their start, as two states of knowledge see them.

Method. One pass over the clicks gives each client both states' starts by conditional minima (a minimum needs no
deduplicated rows), its number of rows and its segment. The clicks then move once, by client: equal rows meet there and
count once, join their client's starts, and are summed per state, client and period; these sums roll up to cells.

A client with more than 1/PARTS of all rows is dealt to parts that hold about so many each: a click's part comes from its
own columns, so equal rows stay together, and the client's starts are copied to its parts. Such clients are fewer than
PARTS, whatever the input's size; their numbers of parts are the only thing that is broadcast.

Results. Rows whose columns are all equal count once, extra columns included. Rows of null time or client take no part; a
null id arrives when it says; a null arrival is known to the later state only. A client without a start in a state has no
rows there. Amounts that are null, not finite or beyond 64 bits as cents are 0; a cell whose cents leave 64 bits has null.
A client with several rows in ``clients`` takes the segment of the latest, of equals the greatest; null or missing is ''.
Times with a zone are instants (their days those of UTC), times without are read as they stand: no session's zone matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, free_name

#: No task's share of one client's rows is planned above 1/PARTS of all rows.
PARTS = 4096

DAY = 86_400_000_000


def _wall_clock(time: str) -> str:
    """SQL for the microseconds since 1970 of a time without a zone, which no session's zone moves."""
    parts = f"extract(HOUR FROM {time}) * 3600000000L + extract(MINUTE FROM {time}) * 60000000L"
    return f"(unix_date(CAST({time} AS DATE)) * {DAY}L + {parts} + CAST(extract(SECOND FROM {time}) * 1000000 AS BIGINT))"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(F.col(name))
    return F.expr(_wall_clock(f"CAST(`{name}` AS TIMESTAMP_NTZ)"))


def floor_div(x: Column, n: int) -> Column:
    """floor(x / n) of whole numbers, in whole numbers."""
    n = F.lit(n).cast("long")
    return F.call_function("div", x - F.pmod(x, n), n)


def _comparable(df: DataFrame) -> DataFrame:
    """``df`` with columns that hold maps, which Spark can't compare, as JSON."""
    maps = [f.name for f in df.schema if "map<" in f.dataType.simpleString()]
    return df.withColumns({m: F.to_json(F.struct(F.col(f"`{m}`"))) for m in maps})


def late_arrival(df: DataFrame, id_col: str = "click_id", arrived_col: str = "arrived_at") -> Column:
    """When a row arrives, in microseconds: CRC-32 of the decimal id, if 3 divides it, is the delay in days modulo 100."""
    h = F.crc32(F.col(id_col).cast("string"))
    return micros(df, arrived_col) + F.when(h % 3 == 0, (h % 100) * F.lit(DAY)).otherwise(F.lit(0).cast("long"))


def segments(clients: DataFrame, id_col: str = "client_id", segment_col: str = "city", updated_col: str = "updated_at") -> DataFrame:
    """(client, segment) of each client id: that of its latest row."""
    latest = F.max(F.struct(F.col(updated_col).alias("u"), F.coalesce(F.col(segment_col).cast("string"), F.lit("")).alias("s")))
    rows = clients.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_client")).agg(latest.alias("_latest"))
    return rows.select("_client", F.col("_latest")["s"].alias("_segment"))


def retention(
    clicks: DataFrame,
    clients: DataFrame,
    *,
    as_of: str,
    arrives: Column,
    time_col: str = "ts",
    client_col: str = "client_id",
    kind_col: str = "kind",
    start_kind: str = "purchase",
    value_col: str = "value",
    segment_col: str = "city",
    days: int = 3,
    parts: int = PARTS,
) -> DataFrame:
    """(state, segment, cohort, period, users, users_crc32, moved, cents) of each cell that isn't empty.

    State 0 knows the rows whose ``arrives`` (microseconds) is before ``as_of``, a time without a zone; state 1 knows all.
    Cohorts are runs of ``days`` days of the start since 1970; periods count as many days since the start itself. ``moved``
    counts clients that have a start in both states, in different cohorts.
    """
    at, client, known = micros(clicks, time_col), F.col(client_col).cast("long"), F.coalesce(arrives < F.expr(_wall_clock(f"TIMESTAMP_NTZ '{as_of}'")), F.lit(False))
    some = clicks.filter(F.col(time_col).isNotNull() & F.col(client_col).isNotNull())
    starting = F.col("_kind") == start_kind
    narrow = some.select(client.alias("_client"), at.alias("_at"), known.alias("_known"), F.col(kind_col).alias("_kind"))
    starts = narrow.groupBy("_client").agg(
        F.min(F.when(starting & F.col("_known"), F.col("_at"))).alias("_s0"), F.min(F.when(starting, F.col("_at"))).alias("_s1"), F.count("*").alias("_n")
    )
    # a hint, since a broadcast of one side would grow with the clients
    named = starts.join(segments(clients, client_col, segment_col).hint("merge"), "_client", "left")
    starts = cut(named.filter("_s1 is not null").withColumn("_segment", F.coalesce("_segment", F.lit(""))))
    total = some.count()
    most = max(1, -(-total // parts))
    hot = starts.filter(F.col("_n") > most).select("_client", F.ceil(F.col("_n") / most).cast("int").alias("_of"))  # fewer than ``parts``

    # clicks, by client and part; equal rows are neighbours there
    key, part, of, when, seen = (free_name(clicks, n) for n in ("_key", "_part", "_parts", "_when", "_seen"))
    rows = _comparable(some.withColumns({key: client, when: at, seen: known}))
    fixed = [F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, (T.FloatType, T.DoubleType))]  # of equal floats hashes may differ
    rows = rows.join(F.broadcast(hot.select(F.col("_client").alias(key), F.col("_of").alias(of))), key, "left")
    rows = rows.withColumn(part, F.coalesce(F.pmod(F.xxhash64(*fixed), F.col(of)).cast("int"), F.lit(0)))
    rows = rows.drop(of).repartition(key, part).distinct()
    own = starts.join(F.broadcast(hot), "_client", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_of", F.lit(1)) - 1)))
    cents = F.floor(F.col(value_col).cast("double") * 100 + 0.5)
    amount = F.when(F.abs(F.col(value_col).cast("double")) < 9.2e16, cents).otherwise(0).cast("long")
    rows = rows.select(F.col(key).alias("_client"), F.col(part).alias("_part"), F.col(when).alias("_at"), F.col(seen).alias("_known"), F.coalesce(amount, F.lit(0).cast("long")).alias("_cents"))
    met = rows.join(own.drop("_n", "_of").hint("merge"), ["_client", "_part"]).filter(F.col("_at") >= F.least("_s0", "_s1"))

    cohort = lambda s: floor_div(F.col(s), days * DAY)
    moved = F.coalesce(cohort("_s0") != cohort("_s1"), F.lit(False)).cast("int")

    def state(n: int, fits: Column) -> Column:
        start = f"_s{n}"
        cell = {"state": F.lit(n), "client": F.col("_client"), "segment": F.col("_segment"), "cohort": cohort(start), "period": floor_div(F.col("_at") - F.col(start), days * DAY), "moved": moved, "cents": F.col("_cents")}
        return F.when(fits, F.struct(*[c.alias(name) for name, c in cell.items()]))

    both = F.array_compact(F.array(state(0, F.col("_known") & (F.col("_at") >= F.col("_s0"))), state(1, F.col("_at") >= F.col("_s1"))))
    each = met.select(F.inline(both))
    users = each.groupBy("state", "client", "segment", "cohort", "period", "moved").agg(F.try_sum("cents").alias("cents"))
    return users.groupBy("state", "segment", "cohort", "period").agg(
        F.count("*").alias("users"), F.sum(F.crc32(F.col("client").cast("string"))).alias("users_crc32"), F.sum("moved").alias("moved"), F.try_sum("cents").alias("cents")
    )

