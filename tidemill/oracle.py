"""DuckDB SQL of the registered queries, written apart from the DataFrame code: one plain window over each log partition instead of
two levels, an ASOF join instead of a carried row, and so on."""

from __future__ import annotations

import re

_SUM_COLUMNS = "trips_5m, trips_30m, trips_60m, count_15m, fare_cents_15m, distance_milli_15m"

#: Common table expressions; each names those it needs.
_CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "e": ((), "select *, epoch_us(ts) // 1000 as ms from events"),
    "ordered": (
        ("e",),
        """select event_id, m0 + (ms - m0) // 60 as event_time_ms, (user_id + 1)::int as zone, trunc(value * 100 + 0.5)::bigint as fare_cents,
           (props::json->>'k')::bigint * 100 as distance_milli, ((user_id + 1)::int % 6)::int as partition,
           case when (event_id * 7919) % 1000 < 50 then (event_id * 104729) % 90001 else 0 end as delay_ms
           from e, (select min(ms) as m0 from e)""",
    ),
    "trips": (("ordered",), """select *, (row_number() over (partition by partition order by event_time_ms + delay_ms, event_id) - 1)::bigint as "offset" from ordered"""),
    "raw": (
        ("ordered",),
        """select event_id, case when event_id % 97 = 0 then event_time_ms - 400::bigint * 86400000 else event_time_ms end as pickup_ms,
           (case when event_id % 89 = 0 then 264 else zone end)::int as PULocationID, case when event_id % 83 = 0 then -1.0::double else fare_cents / 100.0::double end as fare_amount,
           case when event_id % 79 = 0 then 101.0::double else distance_milli / 1000.0::double end as trip_distance from ordered""",
    ),
    "reasons": (
        ("raw",),
        """select *, case when pickup_ms < epoch_ms(timestamp '2024-01-01') or pickup_ms >= epoch_ms(timestamp '2024-02-01') then 'bad_time'
           when PULocationID not between 1 and 263 then 'bad_zone' when fare_amount not between 0 and 500 then 'bad_fare'
           when trip_distance not between 0 and 100 then 'bad_distance' end as reason from raw""",
    ),
    "marked": (
        ("trips",),
        """select *, event_time_ms < closed_before as late from (
             select *, greatest(s0, (pm - 30000) - (pm - 30000) % 60000) as closed_before from (
               select *, max(event_time_ms) over (partition by partition order by "offset" rows between unbounded preceding and 1 preceding) as pm,
                 first_value(event_time_ms) over (partition by partition order by "offset") // 60000 * 60000 as s0 from trips))""",
    ),
    "parts": (
        ("marked",),
        """select partition, max("offset") as to_offset, max(event_time_ms) as max_event_time_ms,
           greatest(min(s0), (max(event_time_ms) - 30000) // 60000 * 60000) as closed_until_ms, count(*) filter (late) as late_dropped, count(*) as events
           from marked group by partition""",
    ),
    "buckets": (
        ("marked",),
        """select partition, zone, event_time_ms // 60000 * 60000 as start_ms, count(*) as "count", sum(fare_cents)::bigint as fare_cents, sum(distance_milli)::bigint as distance_milli
           from marked where not late group by all""",
    ),
    "features": (
        ("buckets", "parts"),
        """select b.partition, b.zone, b.start_ms + age * 60000 as window_end_ms,
           coalesce(sum("count") filter (age <= 5), 0)::bigint as trips_5m, coalesce(sum("count") filter (age <= 30), 0)::bigint as trips_30m,
           coalesce(sum("count") filter (age <= 60), 0)::bigint as trips_60m, coalesce(sum("count") filter (age <= 15), 0)::bigint as count_15m,
           coalesce(sum(fare_cents) filter (age <= 15), 0)::bigint as fare_cents_15m, coalesce(sum(distance_milli) filter (age <= 15), 0)::bigint as distance_milli_15m
           from buckets b cross join range(1, 62) r(age) join parts p on p.partition = b.partition
           where b.start_ms + age * 60000 <= p.closed_until_ms group by all""",
    ),
    "derived": (
        ("features",),
        """select *, case when count_15m = 0 then 0.0::double else fare_cents_15m / 100.0::double / count_15m end as fare_mean_15m,
           case when count_15m = 0 then 0.0::double else distance_milli_15m / 1000.0::double / count_15m end as distance_mean_15m,
           case when trips_60m = 0 then 0.0::double else trips_5m::double / (trips_60m / 12.0::double) end as demand_spike_ratio from features""",
    ),
    "latest": (("derived",), "select * from derived qualify row_number() over (partition by zone order by window_end_ms desc) = 1"),
    "retained": (("buckets", "parts"), "select b.* from buckets b join parts p using (partition) where start_ms >= closed_until_ms - 3600000"),
    "bad": (
        ("features",),
        f"""select * replace (trips_5m + case when (zone + window_end_ms // 60000) % 1009 = 0 then 1 else 0 end as trips_5m)
            from features where (zone + window_end_ms // 60000) % 1013 <> 0""",
    ),
    "rewritten": (  # each row, whether it is stored first (even), and whether it is written again and then differs
        ("features",),
        "select *, window_end_ms // 60000 % 2 = 0 as even, n % 1013 <> 0 as again, n % 1009 = 0 as changed from (select *, zone + window_end_ms // 60000 as n from features)",
    ),
    "labels": (
        ("features",),
        """select zone, window_end_ms + case when (zone + window_end_ms // 60000) % 7 = 0 then 12000000 else 90000 end as label_time_ms, (trips_5m % 2)::double as label
           from features where window_end_ms // 60000 % 5 = 0
           union all select zone, min(window_end_ms) - 864000000, null::double from features where window_end_ms // 60000 % 5 = 0 group by zone""",
    ),
    "made": (
        ("features",),
        """select n.zone, n.window_end_ms as label_time_ms, case when l.count_15m > 1.5::double * (n.trips_60m / 4.0::double) then 1.0::double else 0.0::double end as label
           from features n join features l on l.zone = n.zone and l.window_end_ms = n.window_end_ms + 900000 where n.trips_60m >= 8 and n.window_end_ms // 60000 % 60 % 5 = 0""",
    ),
    "rates": (
        ("counters",),
        """select event_type, sum(case when total >= b then total - b else total end)::bigint as increase, sum(case when total >= b then total - b else total end)::double / (max(t_s) - min(t)) as rate from (
             select *, lag(total) over w as b, lag(t_s) over w as t from counters window w as (partition by event_type order by t_s)) where b is not null group by event_type""",
    ),
    "cpu0": (("e",), "select (ms // 86400000)::int as run, 'c' || user_id as name, sum(trunc(value * 100 + 0.5)::bigint) / 100.0::double as cpu_s from e group by all"),
    "cpu1": (("e",), "select (ms // 86400000)::int as run, 'c' || (user_id + 40) as name, sum(trunc(value * 100 + 0.5)::bigint) * 2 / 100.0::double as cpu_s from e group by all"),
    "cores": (
        ("cpu0", "cpu1"),
        "select name, (b.cpu_s - a.cpu_s) / 90.0::double as cores from (select name, sum(cpu_s) as cpu_s from cpu0 group by name) a join (select name, sum(cpu_s) as cpu_s from cpu1 group by name) b using (name)",
    ),
    "folded": (
        ("dedup", "kv"),
        """select d.key, d.value, d."index" from (select * from dedup where applied qualify row_number() over (partition by key order by "index" desc) = 1) d
           where not exists (select 1 from kv q where q.op = 'purge' and q."index" > d."index" and starts_with(d.key, q.key))""",
    ),
    "pit": (
        ("labels", "features"),
        f"""select l.zone, l.label_time_ms, l.label, f.window_end_ms, {_SUM_COLUMNS} from labels l asof left join features f on l.zone = f.zone and l.label_time_ms >= f.window_end_ms""",
    ),
    "requests": (
        (),
        """select request_id, list_transform(range(0, request_id % 9 + 1), lambda i: ((request_id * 7 + i * 13) % 41 + 1)::int)
           || [999999, (request_id % 40 + 1)::int, (request_id % 40 + 1)::int] as ids from (select distinct event_id // 25 as request_id from events)""",
    ),
    "asked": (("requests",), "select request_id, unnest(ids)::int as zone, (generate_subscripts(ids, 1) - 1)::int as pos from requests"),
    "kv": (
        (),
        """select "index", client, (nth - case when nth % 13 = 0 then 1 else 0 end)::bigint as seq, op, key, value from (
             select *, row_number() over (partition by client order by "index") as nth from (
               select event_id as "index", 'c' || (user_id % 7) as client, case when event_id % 500 = 499 then 'purge' else 'put' end as op,
                 case when event_id % 1000 = 999 then 'c' || (event_id % 7) when event_id % 500 = 499 then substr(event_type, 1, 2) else event_type || '-' || (user_id % 50) end as key,
                 event_id::varchar as value from events))""",
    ),
    "puts": (
        ("kv",),
        """select p.*, (select max(q."index") from kv q where q.op = 'purge' and q."index" < p."index" and starts_with(p.client, q.key)) as epoch from kv p where p.op = 'put'""",
    ),
    "dedup": (
        ("puts",),
        """select "index", client, seq, key, value, coalesce(seq > max(seq) over (partition by client, epoch order by "index" rows between unbounded preceding and 1 preceding), true) as applied from puts""",
    ),
    "ops": (
        ("e",),
        """select (user_id % 32)::int as client, case when event_id % 2 = 0 then 'put' else 'get' end as kind, (event_id % 2 = 0 and event_id % 101 = 0) as unknown, (ms - m0) * 1000 as call_ns,
           case when event_id % 2 = 0 and event_id % 101 = 0 then -1 else (ms - m0) * 1000 + trunc(value * 1000 + 0.5)::bigint end as ret_ns from e, (select min(ms) as m0 from e)""",
    ),
    "gaps": (
        ("ops",),
        """select b / 1e9::double as at_s, (ret_ns - b) / 1e6::double as gap_ms from (select ret_ns, lag(ret_ns) over (order by ret_ns) as b from ops where kind = 'put' and not unknown) where b is not null""",
    ),
    "counters": (
        ("e",),
        """select event_type, hour, hour * 3600 as t_s, sum(n) over (partition by event_type, hour // 240 order by hour)::bigint as total
           from (select event_type, ms // 3600000 as hour, count(*) as n from e group by all)""",
    ),
    "scrapes": (
        ("e",),
        """select event_type, le, nth * 15000 as t_ms, sum(n) over (partition by event_type, le, nth // 37 order by nth)::bigint as total from (
             select event_type, le, (floor((ms - m0) / 60.0::double / 15000.0::double))::bigint as nth, count(*) filter (le is null or value <= le) as n
             from e, (select min(ms) as m0 from e), (select unnest([4.0::double, 16, 64, 256, null]) as le) group by all)""",
    ),
    "dup": (
        ("trips",),
        """select *, "offset" * 10 as arrival from trips union all select *, "offset" * 10 + 51 from trips where "offset" % 10 = 0""",
    ),
}

_T = "trips_10m, trips_120m, distance_milli_120m"
_CTE |= {  # the second view: buckets of two minutes, 45 seconds of lateness, spans of 5 and 60 buckets
    "t_marked": (
        ("trips",),
        """select *, event_time_ms < greatest(s0, (pm - 45000) // 120000 * 120000) as late from (
             select *, coalesce(max(event_time_ms) over (partition by partition order by "offset" rows between unbounded preceding and 1 preceding), 0) as pm,
               first_value(event_time_ms) over (partition by partition order by "offset") // 120000 * 120000 as s0 from trips)""",
    ),
    "t_features": (
        ("t_marked",),
        """select b.zone, b.start_ms + age * 120000 as window_end_ms, coalesce(sum(n) filter (age <= 5), 0)::bigint as trips_10m,
           coalesce(sum(n) filter (age <= 60), 0)::bigint as trips_120m, coalesce(sum(miles) filter (age <= 60), 0)::bigint as distance_milli_120m
           from (select partition, zone, event_time_ms // 120000 * 120000 as start_ms, count(*) as n, sum(distance_milli) as miles from t_marked where not late group by all) b
           cross join range(1, 62) r(age)
           join (select partition, greatest(min(s0), (max(event_time_ms) - 45000) // 120000 * 120000) as closed from t_marked group by 1) p on p.partition = b.partition
           where b.start_ms + age * 120000 <= p.closed group by all""",
    ),
    "t_latest": (
        ("t_features",),
        """select *, case when trips_120m = 0 then 0.0::double else distance_milli_120m / 1000.0::double / trips_120m end as distance_mean_120m,
           case when trips_120m = 0 then 0.0::double else trips_10m::double / (trips_120m / 12.0::double) end as trend_ratio
           from t_features qualify row_number() over (partition by zone order by window_end_ms desc) = 1""",
    ),
}


def _with(names: tuple[str, ...], body: str) -> str:
    need: list[str] = []

    def visit(n: str) -> None:
        for m in _CTE[n][0]:
            visit(m)
        if n not in need:
            need.append(n)

    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as materialized ({_CTE[n][1]})" for n in need) + "\n" + body if need else body


_F = f"zone, window_end_ms, {_SUM_COLUMNS}"
_HASH = "concat_ws('|', zone, window_end_ms, trips_5m, trips_30m, trips_60m, count_15m, fare_cents_15m, distance_milli_15m)"



def _tree(table: str, text: str, after: bool = False) -> str:
    """Tables of a tree of hashes over a table's rows, to follow a list of common table expressions."""
    name = f"{table}_tree"
    out = f"{name}_0 as materialized (select sha256({text}) as h, h as name, 1 as n from {table})"
    for k, digits in enumerate((6, 4, 2, 0)):
        out += f", {name}_{k + 1} as materialized (select substr(name, 1, {digits}) as name, sha256(string_agg(h, chr(10) order by name, h)) as h, sum(n) as n from {name}_{k} group by 1)"
    return f", {out}, {name} as (select h as sha256, n::bigint as row_count from {name}_4)"


def _rates(window: int, step: int) -> str:
    """Rates over a window at steps, by joining each step with all samples of its window."""
    return f"""steps as (select unnest(range(0, (select max(t_ms) from scrapes) + {window + step}, {step}))::bigint as at_ms),
      inside as (select event_type, le, at_ms, t_ms, total, lag(total) over (partition by event_type, le, at_ms order by t_ms) as b from steps join scrapes on t_ms > at_ms - {window} and t_ms <= at_ms),
      ends as (select event_type, le, at_ms, count(*) as n, min(t_ms) as t0, max(t_ms) as t1, arg_min(total, t_ms)::double as v0, arg_max(total, t_ms)::double as v1, coalesce(sum(b) filter (total < b), 0)::double as resets from inside group by all having count(*) > 1),
      grown as (select *, v1 - v0 + resets as g, (t1 - t0) / 1000.0::double as span, (t1 - t0) / 1000.0::double / (n - 1) as each_s, (t0 - (at_ms - {window})) / 1000.0::double as s0, (at_ms - t1) / 1000.0::double as s1 from ends),
      near as (select *, case when s0 >= each_s * 1.1::double then each_s / 2 else s0 end as d0, case when s1 >= each_s * 1.1::double then each_s / 2 else s1 end as d1 from grown),
      windowed as (select event_type, le, at_ms, g * ((span + case when g > 0 then least(d0, span * (v0 / g)) else d0 end + d1) / span / {window / 1000}::double) as rate from near)"""


_HEADER_TEXT = "concat_ws('|', partition, to_offset, max_event_time_ms, closed_until_ms, late_dropped, events)"
_BUCKET_TEXT = "concat_ws('|', partition, zone, start_ms, \"count\", fare_cents, distance_milli)"

_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "scan_trips": (("raw",), "select pickup_ms, PULocationID, fare_amount, trip_distance from raw"),
    "clean_trips": (
        ("reasons",),
        "select pickup_ms as event_time_ms, PULocationID as zone, trunc(fare_amount * 100 + 0.5)::bigint as fare_cents, trunc(trip_distance * 1000 + 0.5)::bigint as distance_milli, event_id from reasons where reason is null",
    ),
    "clean_stats": (
        ("reasons",),
        "select count(*) as rows_read, " + ", ".join(f"count(*) filter (reason = '{r}') as {r}" for r in ("bad_time", "bad_zone", "bad_fare", "bad_distance")) + ", count(*) filter (reason is null) as kept from reasons",
    ),
    "replay_slice": (("trips",), "select event_id, event_time_ms, zone from trips, (select min(event_time_ms) as m from trips) where event_time_ms >= m + 7200000 and event_time_ms < m + 18000000"),
    "replay_loop": (("trips",), "select event_id, event_time_ms + loop * 2678400000 as event_time_ms, zone, loop::int as loop from trips, range(3) r(loop)"),
    "replay_resume": (
        ("trips",),
        "select event_id, event_time_ms + 1036800000 as event_time_ms, zone, 1::bigint as loop from trips, (select min(event_time_ms) as m from trips) where event_time_ms + 1036800000 > m + 295 * 3600000",
    ),
    "late_injection": (("trips",), 'select partition, "offset", event_id, event_time_ms from trips'),
    "offset_dedup": (("dup",), 'select partition, "offset", event_id, min(arrival) as arrival from dup group by all'),
    "offset_gaps": (
        ("trips",),
        """select partition, b as after_offset, "offset", "offset" - b - 1 as missing from (select partition, "offset", lag("offset") over (partition by partition order by "offset") as b from trips where "offset" % 50 <> 7) where "offset" - b > 1""",
    ),
    "last_event_time": (("trips",), 'select max(t) as last_event_time_ms from (select arg_max(event_time_ms, "offset") as t from trips group by partition)'),
    "codec_roundtrip": (("trips",), "select event_id, event_time_ms, zone, fare_cents, distance_milli, 0::bigint as publish_ms, zone::varchar as key, 37::int as bytes from trips"),
    "malformed_count": (("trips",), "select partition, count(*) as records, count(*) filter (event_id % 41 = 0 or event_id % 43 = 0) as malformed from trips group by partition"),
    "bucket_floor": (
        ("trips",),
        "select event_id, t as t_ms, (floor(t / 60000.0::double) * 60000)::bigint as bucket_ms from (select event_id, event_time_ms - m - 3600000 as t from trips, (select min(event_time_ms) as m from trips))",
    ),
    "bucket_agg": (("buckets",), "select * from buckets"),
    "zone_features": (("features",), f"select {_F} from features"),
    "stream_features": (("features",), f"select {_F} from features"),
    "stream_wire": (("features",), f"select {_F} from features"),
    "stream_wire_counts": (
        ("parts",),
        """select partition, to_offset, events, late_dropped, malformed, 0::bigint as repeated, 0::bigint as gaps_accepted from parts
           join (select partition, count(*) filter (event_id % 41 = 0 or event_id % 43 = 0) as malformed from trips group by partition) using (partition)""",
    ),
    "replica_state": (("parts", "retained"), """select p.*, zone, start_ms, "count", fare_cents, distance_milli from parts p join retained r using (partition)"""),
    "quiet_rows": (("features",), "select zone, window_end_ms from features where trips_60m = 0"),
    "watermark": (("marked",), 'select partition, "offset", greatest(pm, event_time_ms) - 30000 as watermark_ms, closed_before from marked'),
    "late_events": (("marked",), 'select partition, "offset", event_id, event_time_ms, closed_before from marked where late'),
    "partition_stats": (("parts",), "select * from parts"),
    "partition_state": (
        ("parts", "retained"),
        """select p.*, (row_number() over (partition by p.partition order by zone, start_ms) - 1)::int as nth, zone, start_ms, "count", fare_cents, distance_milli from parts p join retained r using (partition)""",
    ),
    "retained_buckets": (("retained",), "select * from retained"),
    "derive_features": (("derived",), "select zone, window_end_ms, fare_mean_15m, distance_mean_15m, demand_spike_ratio from derived"),
    "model_vector": (
        ("derived",),
        """select zone, window_end_ms, trips_5m, trips_30m, trips_60m, fare_mean_15m, distance_mean_15m, demand_spike_ratio,
           round(sin(window_end_ms // 3600000 % 24 * (2 * pi()) / 24), 9) as hour_sin, round(cos(window_end_ms // 3600000 % 24 * (2 * pi()) / 24), 9) as hour_cos from derived""",
    ),
    "zone_card": (
        ("derived",),
        "select zone, window_end_ms, trips_5m, trips_60m, " + ", ".join(f"sign({c}) * floor(abs({c}) * 100 + 0.5) / 100 as {c}" for c in ("fare_mean_15m", "distance_mean_15m", "demand_spike_ratio")) + " from derived",
    ),
    "trailing_range": (
        ("buckets",),
        "select partition, zone, start_ms + 60000 as window_end_ms, "
        + ", ".join(
            f'sum({c}) over (partition by partition, zone order by start_ms range between {(k - 1) * 60000} preceding and current row)::bigint as {n}'
            for k, c, n in ((5, '"count"', "trips_5m"), (30, '"count"', "trips_30m"), (60, '"count"', "trips_60m"), (15, '"count"', "count_15m"), (15, "fare_cents", "fare_cents_15m"), (15, "distance_milli", "distance_milli_15m"))
        )
        + " from buckets",
    ),
    "latest_features": (("latest",), f"select {_F} from latest"),
    "last_n_per_zone": (("features",), "select zone, window_end_ms, trips_5m, row_number() over (partition by zone order by window_end_ms desc)::int as nth from features qualify nth <= 5"),
    "history_rows": (
        ("features", "trips"),
        f"select 'zone_demand_v1' as feature_view, {_F}, partition as source_partition, 0::int as conflicting_rewrites from features, (select min(event_time_ms) as m from trips) where window_end_ms >= m + 10800000 and window_end_ms < m + 14400000",
    ),
    "history_upsert": (
        ("rewritten",),
        f"""select 'zone_demand_v1' as feature_view, zone, window_end_ms, trips_5m + case when not even and changed then 1 else 0 end as trips_5m, {_SUM_COLUMNS.split(', ', 1)[1]},
            partition as source_partition, window_end_ms as source_offset, (even and again and changed)::int as conflicting_rewrites from rewritten where even or again""",
    ),
    "day_table": (
        ("rewritten",),
        f"""select 'zone_demand_v1' as feature_view, zone, window_end_ms, trips_5m + case when not even and changed then 1 else 0 end as trips_5m, {_SUM_COLUMNS.split(', ', 1)[1]},
            partition as source_partition, window_end_ms as source_offset, (even and again and changed)::int as conflicting_rewrites from rewritten where even or again""",
    ),
    "conflicting_rewrites": (("bad", "features"), "select count(*) as rewrites from bad b join features f using (zone, window_end_ms) where window_end_ms // 60000 % 2 = 0 and b.trips_5m <> f.trips_5m"),
    "insert_ignore": (("features",), "select zone, window_end_ms, trips_5m + case when window_end_ms // 60000 % 2 = 0 then 0 else 100 end as trips_5m from features"),
    "unnest_rows": (("features",), f"select partition as source_partition, {_F} from features"),
    "pit_join": (("pit",), "select * from pit"),
    "pit_training": (("pit",), "select * from pit where window_end_ms is not null"),
    "pit_leaks": (("pit",), "select count(*) as examples, count(*) filter (window_end_ms > label_time_ms) as leaks from pit"),
    "parity_cut": (("parts",), "select min(closed_until_ms) as cut_ms from parts where to_offset >= 0"),
    "parity": (
        ("features", "bad", "parts"),
        f"""select count(*) filter (a.zone is not null and b.zone is not null and a.trips_5m = b.trips_5m) as matched, count(*) filter (a.trips_5m <> b.trips_5m) as mismatched,
            count(*) filter (b.zone is null) as missing_right, count(*) filter (a.zone is null) as missing_left
            from (select f.* from features f, (select min(closed_until_ms) as c from parts) where window_end_ms <= c) a
            full join (select f.* from bad f, (select min(closed_until_ms) as c from parts) where window_end_ms <= c) b using (zone, window_end_ms)""",
    ),
    "backfill": (("features",), f"select 'zone_demand_v1__backfill' as feature_view, {_F} from features"),
    "oracle_diff": (
        ("rewritten",),
        """select zone, window_end_ms, case when not again then 'missing' when n % 1019 = 0 then 'extra' else 'different' end as kind
           from rewritten where case when n % 1019 = 0 then again else not again or changed end""",
    ),
    "skew_check": (
        ("features", "bad"),
        """select count(*) as samples, count(*) filter (b.window_end_ms = s.window_end_ms and b.trips_5m = s.trips_5m) as matched, count(*) filter (coalesce(b.window_end_ms <> s.window_end_ms or b.trips_5m <> s.trips_5m, true)) as mismatched
           from (select * from features where (zone * 17 + window_end_ms // 60000) % 301 = 0) s asof left join bad b on s.zone = b.zone and s.window_end_ms >= b.window_end_ms""",
    ),
    "fingerprint": (("features",), _tree("features", _HASH) + " select sha256, row_count from features_tree"),
    "shadow_check": (
        ("features", "bad"),
        """select count(*) filter (not pending) as checked, count(*) filter (not pending and (r_zone is null or r_5m <> s_5m)) as bad, count(*) filter (pending) as pending from (
             select s.trips_5m as s_5m, r.zone as r_zone, r.trips_5m as r_5m, r.zone is null and (t.reached is null or t.reached < s.window_end_ms) as pending
             from (select * from bad qualify row_number() over (partition by zone order by window_end_ms desc) = 1) s
             left join (select * from features where zone % 11 <> 3 or window_end_ms // 60000 % 2 = 0 qualify row_number() over (partition by zone order by window_end_ms desc) <= 240) r on r.zone = s.zone and r.window_end_ms = s.window_end_ms
             left join (select zone, max(window_end_ms) as reached from features where zone % 11 <> 3 or window_end_ms // 60000 % 2 = 0 group by zone) t on t.zone = s.zone)""",
    ),
    "serve_features": (
        ("asked", "latest"),
        "select request_id, pos, a.zone, l.zone is not null as found, window_end_ms, trips_5m, fare_mean_15m, demand_spike_ratio from asked a left join latest l on l.zone = a.zone",
    ),
    "stream_metrics": (("trips", "features"), "select 3::bigint as batches, (select count(*) from trips) as events, (select count(*) from features) as feature_rows, 0::bigint as lag, true as measured"),
    "shadow_report": (("trips", "latest"), "select count(*) as checked, count(*) filter (zone % 11 = 3) as bad, 0::bigint as pending, false as warming_up, (select count(*) from trips)::bigint as events from latest"),
    "paced_features": (("features",), f"select {_F} from features"),
    "trend_features": (("t_features",), f"select zone, window_end_ms, {_T} from t_features"),
    "trend_stream": (("t_features",), f"select zone, window_end_ms, {_T} from t_features"),
    "trend_serving": (("asked", "t_latest"), f"select request_id, pos, a.zone, l.zone is not null as found, window_end_ms, {_T}, distance_mean_120m, trend_ratio from asked a left join t_latest l on l.zone = a.zone"),
    "trend_pit": (("labels", "t_features"), f"select l.zone, label_time_ms, label, window_end_ms, {_T} from labels l asof left join t_features f on l.zone = f.zone and l.label_time_ms >= f.window_end_ms"),
    "cache_split": (("asked", "latest"), "select distinct request_id, a.zone, l.zone is not null as hit from asked a left join (select zone from latest where zone % 3 = 0) l on l.zone = a.zone"),
    "client_dedup": (("dedup",), 'select "index", client, seq, applied from dedup'),
    "kv_fold": (("folded",), "select * from folded"),
    "register_lookup": (("folded",), "select * from folded where key in ('click-3', 'none')"),
    "purge_counts": (
        ("dedup", "kv"),
        """, ap as (select "index", key from dedup where applied), pg as (select "index", key as prefix from kv where op = 'purge' and coalesce(key, '') <> '')
           select "index", prefix, count(*) filter (p is not null and (q is null or p > q)) as purged from (
             select g."index", g.prefix, (select max(a."index") from ap a where a.key = k.key and a."index" < g."index") as p, (select max(o."index") from pg o where o."index" < g."index" and starts_with(k.key, o.prefix)) as q
             from pg g left join (select distinct key from ap) k on starts_with(k.key, g.prefix)) group by all""",
    ),
    "merge_buckets": (
        ("trips", "buckets"),
        """select b.partition, b.zone, b.start_ms, b."count" * 1000 + arrival as "count", b.fare_cents, b.distance_milli from buckets b
           join (select partition, zone, event_time_ms // 60000 * 60000 as start_ms, max("offset" // 500) as arrival from trips group by all) l using (partition, zone, start_ms)
           join (select partition, max(event_time_ms) as most from trips group by partition) u using (partition) where b.start_ms >= most - 3600000""",
    ),
    "idempotent_apply": (
        ("dup",),
        """select partition, arrival, to_offset, coalesce(to_offset > max(to_offset) over (partition by partition order by arrival rows between unbounded preceding and 1 preceding), true) as applied from (
             select partition, arrival, to_offset from b union all select partition, arrival + 1000000, to_offset from b where arrival % 3 = 0)""",
    ),
    "linearizability": (
        (),
        """select key, count(*) as ops, key <> 'k3' as linearizable from (select case when event_id % 3 = 0 then 'hot' else 'k' || (event_id % 16) end as key from events) group by key""",
    ),
    "nearest_rank": (
        ("e",),
        """select event_type, n, p50, p99 from (select event_type, count(*) as n, list_sort(list(value)) as v, v[floor(0.5::double * (count(*) - 1))::int + 1] as p50, v[floor(0.99::double * (count(*) - 1))::int + 1] as p99 from e group by event_type)""",
    ),
    "upper_median": (("e",), "select event_type, n, v[n // 2 + 1] as median, v[1] as low, v[n] as high from (select event_type, count(*) as n, list_sort(list(value)) as v from e group by event_type)"),
    "probe_counts": (
        ("ops",),
        """select count(*) as ops, count(*) filter (kind = 'put' and not unknown) as puts_ok, count(*) filter (kind = 'put' and unknown) as puts_unknown, count(*) filter (kind <> 'put') as gets_ok,
           count(*) filter (kind = 'put' and not unknown) / (max(ret_ns) / 1e9::double) as puts_per_sec, count(*) filter (kind <> 'put') / (max(ret_ns) / 1e9::double) as gets_per_sec from ops""",
    ),
    "write_gaps": (("gaps",), "select at_s, gap_ms from gaps"),
    "gap_summary": (("gaps",), "select max(gap_ms) as max_gap_ms, (select at_s from gaps order by gap_ms desc, at_s limit 1) as max_gap_at_s, count(*) filter (gap_ms > 1000) as gaps_over_1s from gaps"),
    "unavailability": (
        ("gaps",),
        """select fault_id, f.at_s, coalesce(max(gap_ms), 0.0::double) as unavailable_ms from (select distinct event_id // 400 as fault_id, (event_id // 400) * 97.5::double + 3.25::double as at_s from events) f
           left join gaps g on g.at_s <= f.at_s + 20 and g.at_s + g.gap_ms / 1000 >= f.at_s group by all""",
    ),
    "lag_slope": (
        ("counters",),
        """select event_type, round(case when count(*) < 2 then 0.0::double else coalesce(regr_slope(y, x), 0.0::double) end, 6) as slope, round(case when count(*) < 2 then 0.0::double else coalesce(regr_intercept(y, x), avg(y)) end, 4) as intercept
           from (select event_type, (hour % 1000)::double as x, total::double as y from counters) group by event_type""",
    ),
    "counter_rate": (("rates",), "select * from rates"),
    "rate_by": (("rates",), "select substr(event_type, 1, 1) as label, sum(increase)::bigint as increase, round(sum(rate), 9) as rate from rates group by 1"),
    "hit_ratio": (("rates",), "select coalesce(sum(increase) filter (event_type = 'click'), 0)::double / sum(increase)::double as ratio from rates"),
    "gauge_max": (("counters",), "select max(total)::double as largest from counters"),
    "sustained": (("counters",), "select event_type, case when count(*) < 2 then 0.0::double else coalesce(regr_slope((total % 97)::double, hour::double), 0.0::double) end <= 0.05::double as sustained from counters group by event_type"),
    "counts_by_code": ((), "select case when event_id % 50 = 0 then 'deadline' else 'ok' end as code, count(*) as n from events group by 1"),
    "failover": (
        ("e",),
        """select min(ms) - t as failover_ms from (select ms, (event_id // 500 % 5)::varchar as leader from e), (select t, (select arg_max((event_id // 500 % 5)::varchar, ms) from e where ms <= t) as old from (select min(ms) + 10800000 as t from e))
           where ms > t and leader <> old group by t""",
    ),
    "fault_lines": (("e",), "select event_type || ' of ' || (event_id % 5) as fault, (ms - m0) / 1000.0::double as at_s from e, (select min(ms) as m0 from e) where event_id % 3 = 0 and event_id % 7 <> 0"),
    "check_totals": ((), "select (sum(n) filter (user_id % 10 <> 3))::bigint as ops_ok, false as illegal from (select user_id, count(*) as n from events group by user_id)"),
    "cpu_cores": (("cores",), "select name, round(cores, 9) as cores from cores"),
    "cpu_total": (("cores",), "select coalesce(round(sum(cores), 6), 0.0::double) as cores_total from cores"),
    "top_cpu": (("cpu1",), "select run, string_agg(printf('%s %.2f', name, cpu_s), ', ' order by cpu_s desc, name) as top from (select * from cpu1 qualify row_number() over (partition by run order by cpu_s desc, name) <= 3) group by run"),
    "before_after": (
        (),
        """select file, b.n as before_requests, b.m as before_max_ms, a.n as after_requests, a.m as after_max_ms from (select 'serve-' || event_type || '-' || (user_id % 20) as file, count(*) as n, max(value) as m from events group by 1) b
           join (select 'serve-' || event_type || '-' || (user_id % 23) as file, count(*) as n, max(value) as m from events group by 1) a using (file)""",
    ),
    "report_order": ((), "select 'serve-' || event_type || '-' || (user_id % 23) as file, count(*)::double as offered_rate_eps from events group by 1 order by 2, 1"),
    "role_changes": (
        ("e",),
        """select node, t, was, now from (select user_id % 5 as node, event_id as t, case when event_type = 'click' then 'leader' else 'follower' end as now, lag(case when event_type = 'click' then 'leader' else 'follower' end) over (partition by user_id % 5 order by event_id) as was from e) where was <> now""",
    ),
    "histogram_quantile": (
        ("e",),
        """select event_type, round(case when le is null then under else under + (le - under) * (total * 0.9::double - below) / (n - below) end, 9) as value from (
             select *, row_number() over (partition by event_type order by le nulls last) as nth from (
               select *, coalesce(lag(le) over w, 0.0::double) as under, coalesce(lag(n) over w, 0) as below, max(n) over (partition by event_type) as total from (
                 select event_type, le, count(*) filter (le is null or value <= le) as n from e, (select unnest([1.0::double, 2, 4, 8, 16, 32, 64, 128, 256, null]) as le) group by all)
               window w as (partition by event_type order by le nulls last)) where n >= total * 0.9::double and total > 0) where nth = 1""",
    ),
    "latency_summary": (
        ("e",),
        "select event_type, n as requests, "
        + ", ".join(f"v[floor({q}::double * (n - 1))::int + 1] as {c}" for c, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999)))
        + ", max_ms, mean_ms from (select event_type, count(*) as n, list_sort(list(value)) as v, max(value) as max_ms, round(avg(value), 9) as mean_ms from e group by event_type)",
    ),
    "latency_histogram": (
        ("e",),
        """, l as (select event_type, event_id % 50 = 0 as failed, trunc(value * 1000 + 0.5)::bigint as us from e),
           b as (select unnest(case when failed then ['all'] else ['all', event_type] end) as "of", us, (1::bigint << (greatest(length(bin(us)), 11) - 11)::bigint)::bigint as width from l),
           v as (select "of", us // width * width + width - 1 as top, us // width * width + width // 2 as middle from b),
           s as (select "of", count(*) as n, list_sort(list(top)) as t, sum(middle)::double as m from v group by 1)
           select "of", n as requests, """
        + ", ".join(f"t[greatest(1, floor({q}::double * n + 0.5)::bigint)] / 1000.0::double as {c}" for c, q in (("p50_ms", 0.5), ("p90_ms", 0.9), ("p99_ms", 0.99), ("p999_ms", 0.999)))
        + ", t[n] / 1000.0::double as max_ms, round(m / n / 1000, 9) as mean_ms from s",
    ),
    "range_rates": (("scrapes",), ", " + _rates(60_000, 30_000) + " select event_type, le, at_ms, round(rate, 9) as rate from windowed"),
    "rate_quantiles": (
        ("scrapes",),
        ", " + _rates(300_000, 60_000) + """, q as (select event_type, at_ms, le, rate as n, coalesce(lag(le) over w, 0.0::double) as under, coalesce(lag(rate) over w, 0.0::double) as below, max(rate) over (partition by event_type, at_ms) as total
             from windowed window w as (partition by event_type, at_ms order by le nulls last))
           select event_type, at_ms, round(arg_min(case when le is null then under else under + (le - under) * (total * 0.9::double - below) / (n - below) end, coalesce(le, 'inf'::double)), 6) as value
           from q where n >= total * 0.9::double and total > 0 group by all""",
    ),
    "make_labels": (("made",), "select * from made"),
    "label_table": (("made",), "select * from made"),
    "time_split": (("made",), "select cut_ms, count(*) filter (label_time_ms <= cut_ms) as train, count(*) filter (label_time_ms > cut_ms) as test from made, (select quantile_cont(label_time_ms::double, 0.7) as cut_ms from made) group by cut_ms"),
    "roc_auc": (
        ("derived",),
        """select round((sum(rank * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(n) - sum(p))), 9) as auc, round(sum(p * hits / seen) / sum(p), 9) as average_precision, round(sum(p) / sum(n), 9) as positive_rate, sum(n)::bigint as examples from (
             select n, p::double as p, sum(n) over (order by s) - n + (n + 1) / 2 as rank, (sum(p) over (order by s desc))::double as hits, sum(n) over (order by s desc) as seen from (
               select demand_spike_ratio as s, count(*)::bigint as n, count(*) filter (count_15m > 1) as p from derived group by 1))""",
    ),
    "partition_list": (("trips",), "select distinct partition from trips"),
    "replay_skipped": (("trips",), "select count(*) filter (event_time_ms + 1036800000 <= m + 295 * 3600000) as skipped, 1::bigint as loop from trips, (select min(event_time_ms) as m from trips)"),
    "first_events": (("trips",), 'select event_id, event_time_ms, partition, "offset" from trips order by event_time_ms, partition, "offset" limit 500'),
    "compact_roundtrip": (("trips",), "select event_time_ms // 1000 * 1000 as event_time_ms, zone, fare_cents, distance_milli // 10 * 10 as distance_milli from trips"),
    "ops_roundtrip": (
        ("e",),
        """select (user_id % 32)::int as client, case when event_id % 2 = 0 then 'put' else 'get' end as kind, event_type as key, event_id::varchar as value, event_id % 3 <> 0 as found, (event_id % 2 = 0 and event_id % 101 = 0) as unknown,
           (ms - m0) * 1000 as call_ns, case when event_id % 2 = 0 and event_id % 101 = 0 then -1 else (ms - m0) * 1000 + trunc(value * 1000 + 0.5)::bigint end as ret_ns from e, (select min(ms) as m0 from e)""",
    ),
    "log_roundtrip": (("trips",), 'select partition, "offset", event_time_ms, zone, fare_cents, distance_milli from trips'),
    "moments": (("e",), "select event_id, case event_id % 3 when 0 then epoch_ms(date_trunc('month', ts)) when 1 then ms // 1000 * 1000 end as parsed_ms, ms as again_ms from e"),
    "recent_points": (("features",), "select zone, window_end_ms as as_of_ms, trips_5m from features qualify row_number() over (partition by zone order by window_end_ms desc) <= 120"),
    "newest_window": (("features",), "select max(window_end_ms) as as_of_ms from features"),
    "busiest_zone": (("features",), "select zone, trips_5m from features order by trips_5m desc, zone limit 1"),
    "sample_rows": (
        ("features",),
        """select n, i::int as i, zone, window_end_ms, trips_5m from range(60) a(n), range(5) b(i), (select count(*) as total from features)
           join (select *, row_number() over (order by zone, window_end_ms) - 1 as nth from features) r on nth = (7 * n + 31 * i) % total""",
    ),
    "state_fingerprint": (
        ("parts", "retained", "features"),
        _tree("parts", _HEADER_TEXT) + _tree("retained", _BUCKET_TEXT) + _tree("features", _HASH)
        + """ select substr(sha256(r.sha256 || chr(10) || f.sha256 || chr(10) || p.sha256), 1, 16) as fingerprint, p.row_count as partitions, r.row_count as buckets, f.row_count as features from parts_tree p, retained_tree r, features_tree f""",
    ),
    "converged": (("features",), """select true as converged, 2::bigint as nodes, 'equal' as "case" union all select not exists (select 1 from features where zone % 7 = 3), 3, 'one differs'"""),
    "delete_view": (("features",), f"select 'zone_demand_v1' as feature_view, {_F} from features"),
    "merged_history": (
        ("rewritten",),
        f"select 'zone_demand_v1' as feature_view, {_F}, partition as source_partition, window_end_ms as source_offset, (again and changed)::int as conflicting_rewrites from rewritten",
    ),
    "touched_zones": (("features",), "select distinct zone from features where window_end_ms >= (select max(window_end_ms) from features) - 3600000"),
    "training_examples": (("made", "derived"), "select m.zone, label_time_ms, label, window_end_ms, trips_5m, trips_60m, demand_spike_ratio from made m join derived d on d.zone = m.zone and d.window_end_ms = m.label_time_ms"),
    "zone_names": (("latest",), "select zone, window_end_ms, coalesce(n_name, '') as zone_name, case when n_name is null then '' else 'b' end as borough from latest left join nation on n_nationkey + 1 = zone"),
    "top_zones": (("latest",), "select zone, demand_spike_ratio + trips_60m as score from latest order by score desc, zone limit 5"),
}


_HALF = '(select t.* from trips t join (select partition, max("offset") // 2 as to_offset from trips group by partition) u on t.partition = u.partition and t."offset" <= u.to_offset)'
_BAD_RECORD = "(event_id % 41 = 0 or event_id % 43 = 0)"


def _over(sql: str, half: str) -> str:
    """The statement over some of the log's events."""
    head, tail = sql.split("marked as materialized (", 1)
    return head + "marked as materialized (" + tail.replace("from trips)", f"from {half})", 1)


def _state_diff() -> str:
    """States of the whole log and of one that lacks some events of odd partitions, side by side."""
    chain = ("marked", "parts", "buckets", "retained")
    cut = {n: _CTE[n][1] for n in chain}
    for n in chain:
        cut = {k: re.sub(rf"\b(from|join) {n}\b", rf"\1 {n}_c", v) for k, v in cut.items()}
    cut["marked"] = cut["marked"].replace("from trips)", 'from trips where partition % 2 = 0 or "offset" % 40 <> 3)')
    more = "".join(f", {n}_c as materialized ({cut[n]})" for n in chain)
    listed = lambda t: f"""(select partition, list({{'z': zone, 's': start_ms, 'c': "count", 'f': fare_cents, 'd': distance_milli}} order by zone, start_ms) as l from {t} group by partition)"""
    columns = "to_offset, max_event_time_ms, closed_until_ms, late_dropped, events"
    same = " and ".join(f"p.{c} = q.{c}" for c in columns.split(", "))
    body = f"""{more} select p.partition, {same} and coalesce(a.l, []) = coalesce(b.l, []) as same, coalesce(len(a.l), 0)::int as expected_buckets, coalesce(len(b.l), 0)::int as actual_buckets
        from parts p join parts_c q using (partition) left join {listed('retained')} a using (partition) left join {listed('retained_c')} b using (partition)"""
    return _with(chain, body)


def oracle_sql() -> dict[str, str]:
    found = {k: _with(names, body) for k, (names, body) in _SQL.items()}
    found["idempotent_apply"] = found["idempotent_apply"].replace("\nselect partition, arrival", ',\nb as (select partition, arrival // 1000 as arrival, max("offset") as to_offset from dup group by all)\nselect partition, arrival', 1)
    found["state_diff"] = _state_diff()
    found["oracle_replay"] = _over(found["zone_features"], _HALF)
    for name in ("stream_wire", "stream_wire_counts"):
        found[name] = _over(found[name], f"(select * from trips where not {_BAD_RECORD})")
    return found
