"""DuckDB SQL for the registered queries, written on its own and not derived from them."""

from __future__ import annotations

from equivcheck.plans import suite
from equivcheck.plans.relations import RELATIONS
from equivcheck.registry import (
    CLOCKS_APART_MS,
    DAY,
    GENERATED_FIELDS,
    GENERATOR_SEED,
    HOUR,
    PLAIN,
    PRODUCERS,
    SETTINGS,
    STREAMED,
    WRITTEN,
    relation_key,
)
from equivcheck.sources import generate

EVENTS = "(SELECT event_id, epoch_us(ts) // 1000 AS ts, user_id AS key, value, event_type FROM events)"
LINEITEM = (
    "(SELECT epoch_us(l_shipdate) // 1000 AS ts, l_suppkey AS key, l_quantity, l_extendedprice FROM lineitem)"
)
SOURCE = {"events": EVENTS, "lineitem": LINEITEM}
COLUMNS = {"events": "ts, key, value", "lineitem": "ts, key, l_quantity, l_extendedprice"}
MAPPED = {
    "events": "ts - key * 3",
    "lineitem": "CAST(trunc(ts::DOUBLE / (key + 1)::DOUBLE) AS BIGINT)",
}


def _cents(field: str) -> str:
    return f"CAST(round({field} * 100) AS BIGINT)"


def _aggregate(agg: str, field: str) -> str:
    if agg in ("min", "max"):
        return f"{agg}({field})"
    if agg == "count":
        return "count(*)"
    if agg == "sum":
        return f"sum({_cents(field)})::DOUBLE / 100"
    return f"sum({_cents(field)})::DOUBLE / count({field}) / 100"


def _windowed(table: str, agg: str, keyed: bool, size: int) -> str:
    field = SETTINGS[table].field
    name = "count" if agg == "count" else field
    key = "key, " if keyed else ""
    return (
        f"SELECT (ts // {size}) * {size} AS start, (ts // {size}) * {size} + {size} AS \"end\", {key}"
        f'{_aggregate(agg, field)} AS "{name}" FROM {SOURCE[table]} GROUP BY ALL'
    )


def _relation(name: str, table: str) -> str:
    rel = RELATIONS[name]
    if rel.family == "filter":
        return f"SELECT {COLUMNS[table]} FROM {SOURCE[table]}"
    if rel.family == "map":
        return f"SELECT {COLUMNS[table]}, {MAPPED[table]} AS new_value FROM {SOURCE[table]}"
    return _windowed(table, rel.agg, rel.family == "keyagg", SETTINGS[table].window_ms)


# Finer than the last digit of doubles from 0.004 on: in these units they are integers.
UNIT = 2**60


def _plain(name: str, table: str = "lineitem") -> str:
    p, rel = SETTINGS[table], RELATIONS[name]
    units = f"sum(({p.field} * {UNIT}::DOUBLE)::HUGEINT)"
    # A large HUGEINT is not always cast to the nearest double: both halves are short enough to be exact.
    total = f"(({units} // {2**52})::DOUBLE * {2**52}::DOUBLE + ({units} % {2**52})::DOUBLE) / {UNIT}::DOUBLE"
    value = total if rel.agg == "sum" else f"{total} / count({p.field})"
    key = "key, " if rel.family == "keyagg" else ""
    size = p.window_ms
    return f"""SELECT (ts // {size}) * {size} AS start, (ts // {size}) * {size} + {size} AS "end", {key}
        {value} AS "{p.field}" FROM {SOURCE[table]} GROUP BY ALL"""


def _relations() -> dict[str, str]:
    out = {}
    for table, prefix in (("events", ""), ("lineitem", "lineitem_")):
        for name, rel in RELATIONS.items():
            key, sql = prefix + relation_key(name), _relation(name, table)
            out[f"{key}_origin"] = out[f"{key}_other"] = sql
            if rel.family in ("agg", "keyagg"):
                out[f"{key}_tagged"] = sql
    for n in suite.INNER_DIVISORS:
        out[f"winpart_sum_other_by{n}"] = _relation("WinPartSum", "events")
    for key, (name, _) in STREAMED.items():
        out[key] = _relation(name, "events")
    for name in PLAIN:
        for form in ("origin", "other", "tagged")[: 2 if RELATIONS[name].family == "winpart" else 3]:
            out[f"plain_{relation_key(name)}_{form}"] = _plain(name)
    for side in ("origin", "other"):
        out[f"stream_plain_keyagg_avg_{side}"] = _plain("KeyAggAvg", "events")
    return out


# -- comparison: counts of both sides and of rows without a partner ---------------


def _bags(left: str, right: str, columns: str, close: str | None = None) -> str:
    """Verdict row of two bags; ``close`` is a condition that accepts them within tolerance."""
    tolerant = close or "FALSE"
    return f"""
    WITH l AS ({left}), r AS ({right}),
    only_l AS (SELECT {columns} FROM l EXCEPT ALL SELECT {columns} FROM r),
    only_r AS (SELECT {columns} FROM r EXCEPT ALL SELECT {columns} FROM l),
    n AS (SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows,
        (SELECT count(*) FROM only_l) + (SELECT count(*) FROM only_r) AS differing)
    SELECT CASE WHEN differing = 0 THEN 'Equal' WHEN {tolerant} THEN 'Reordered' ELSE 'Diff' END
        AS relation, left_rows, right_rows, differing, differing > 0 AND {tolerant} AS tolerant FROM n
    """


def _avg_bigint() -> str:
    d = SETTINGS["lineitem"].window_ms
    return f"""SELECT (ts // {d}) * {d} AS start, (ts // {d}) * {d} + {d} AS "end", key,
        sum((ts * 1000003 + key * 7)::HUGEINT)::DOUBLE / count(*) AS wide FROM {LINEITEM} GROUP BY ALL"""


def _ranked(by: float) -> str:
    typed = "SELECT event_type, value FROM events"
    far = """NOT EXISTS (
        SELECT 1
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k FROM l) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k FROM r) b
        USING (event_type, k) WHERE abs(a.value - b.value) >= 0.001)"""
    return _bags(typed, f"SELECT event_type, value + {by} AS value FROM events", "*", far)


# -- 64-bit hashes as the generator draws them, with 128-bit arithmetic ------------

# The primes of xxHash64.
P1 = 0x9E3779B185EBCA87
P2 = 0xC2B2AE3D27D4EB4F
P3 = 0x165667B19E3779F9
P4 = 0x85EBCA77C2B2AE63
P5 = 0x27D4EB2F165667C5
M = 2**64


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _rotated(x: str, bits: int) -> str:
    return f"(({x} * {_u(2**bits)}) % {_u(M)} + {x} // {_u(2 ** (64 - bits))})"


def _hash_steps(value: str) -> list[str]:
    """Column ``h`` hashed with a 64-bit ``value`` on top, step by step through ``h`` and ``x``."""
    return [
        f"* REPLACE (({value}::UHUGEINT * {_u(P2)}) % {_u(M)} AS x)",
        f"* REPLACE ((({_rotated('x', 31)}) * {_u(P1)}) % {_u(M)} AS x)",
        f"* REPLACE (xor((h + {_u(P5 + 8)}) % {_u(M)}, x) AS h)",
        f"* REPLACE (({_rotated('h', 27)} * {_u(P1)} + {_u(P4)}) % {_u(M)} AS h)",
        f"* REPLACE ((xor(h, h // {_u(2**33)}) * {_u(P2)}) % {_u(M)} AS h)",
        f"* REPLACE ((xor(h, h // {_u(2**29)}) * {_u(P3)}) % {_u(M)} AS h)",
        f"* REPLACE (xor(h, h // {_u(2**32)}) AS h)",
    ]


def _hash_once(value: int, seed: int) -> int:
    """The same for two constants: the part of a column's hash that its seed contributes."""

    def rotated(x: int, bits: int) -> int:
        return ((x << bits) | (x >> (64 - bits))) % M

    h = (seed + P5 + 8) % M ^ (rotated(value % M * P2 % M, 31) * P1) % M
    h = (rotated(h, 27) * P1 + P4) % M
    h = (h ^ h >> 33) * P2 % M
    h = (h ^ h >> 29) * P3 % M
    return h ^ h >> 32


def _hashed(rows: str, names: list[str], position: str, tag: str, seed: int = GENERATOR_SEED) -> str:
    """CTEs ending in ``{tag}``: hashes of named columns at (producer, position) of ``rows``."""
    seeds = ", ".join(
        f"('{n}', {_u(_hash_once(generate.column_seed(seed, n), 42))})" for n in names
    )
    ctes = [
        f"{tag}_0 AS (SELECT r.*, s.name, s.h, {_u(0)} AS x "
        f"FROM {rows} r, (VALUES {seeds}) s(name, h))"
    ]
    for step in _hash_steps("producer") + _hash_steps(position):
        ctes.append(f"{tag}_{len(ctes)} AS MATERIALIZED (SELECT {step} FROM {tag}_{len(ctes) - 1})")
    signed = f"CASE WHEN h >= {_u(2**63)} THEN h::HUGEINT - {M} ELSE h::HUGEINT END"
    ctes.append(f"{tag} AS (SELECT *, {signed} AS v FROM {tag}_{len(ctes) - 1})")
    return ",\n".join(ctes)


def _within(value: str, low: int, high: int) -> str:
    width = high - low
    return f"(({value} % {width} + {width}) % {width} + {low})::BIGINT"


def _of(name: str) -> str:
    return f"max(v) FILTER (WHERE name = '{name}')"


_PRODUCED = f"""
    produced AS (SELECT event_id % {PRODUCERS} AS producer, count(*) AS records
        FROM events GROUP BY 1)"""


def _generated_times(seed: int = GENERATOR_SEED, produced: str = _PRODUCED) -> str:
    gaps = [f"gap{j}" for j in range(generate.BURST_ROWS)]
    low, high = generate.BURST_GAP_MS
    elapsed = ", ".join(
        " + ".join(_within(_of(g), low, high) for g in gaps[: j + 1]) for j in range(len(gaps))
    )
    return f"""WITH {produced},
    cycles AS (SELECT producer, records, unnest(range((records + 1) // 2)) AS cycle FROM produced),
    {_hashed("cycles", ["burst", "quiet", *gaps], "cycle", "noise", seed)},
    drawn AS (SELECT producer, records, cycle,
        {_within(_of("burst"), 1, generate.BURST_ROWS + 1)} AS burst,
        {_within(_of("quiet"), *generate.QUIET_GAP_MS)} AS quiet,
        [{elapsed}] AS elapsed FROM noise GROUP BY ALL),
    ended AS (SELECT *, elapsed[burst] + quiet AS length,
        sum(burst + 1) OVER w - burst - 1 AS base_row,
        sum(elapsed[burst] + quiet) OVER w - elapsed[burst] - quiet AS base_ts
        FROM drawn WINDOW w AS (PARTITION BY producer ORDER BY cycle)),
    rows AS (SELECT *, unnest(range(burst + 1)) AS j FROM ended)
    SELECT producer, (base_row + j)::BIGINT AS row,
        (base_ts + {generate.START_MS} + CASE WHEN j < burst THEN elapsed[j + 1] ELSE length END)::BIGINT AS ts
    FROM rows WHERE base_row + j < records"""


def _full_range(name: str, type_name: str) -> str:
    value = f"(({_of(name)}) + CASE WHEN {_of(name)} < 0 THEN {M} ELSE 0 END)"
    if type_name == "FLOAT32":
        return f"(({value} // {2**40})::DOUBLE / {float(2**24)})::FLOAT"
    if type_name == "FLOAT64":
        return f"({value} // {2**11})::DOUBLE / {float(2**53)}"
    if type_name == "UINT64":
        return f"({_of(name)} + {2**63})::VARCHAR"
    if type_name == "INT64":
        return f"({_of(name)})::BIGINT"
    width = int(type_name.lstrip("UINT"))
    less = 0 if type_name.startswith("U") else 2 ** (width - 1)
    held = {8: "SMALLINT", 16: "INTEGER", 32: "BIGINT"}[width]
    if less:
        held = {8: "TINYINT", 16: "SMALLINT", 32: "INTEGER"}[width]
    return f"({value} // {2 ** (64 - width)} - {less})::{held}"


def _generated_stream(seed: int = GENERATOR_SEED, produced: str = _PRODUCED, fields=GENERATED_FIELDS) -> str:
    names = ["key", *[n for n, _ in fields]]
    columns = ",\n".join(f"{_full_range(n, t)} AS {n}" for n, t in fields)
    return f"""WITH {produced},
    listed AS (SELECT producer, unnest(range(records)) AS row FROM produced),
    {_hashed("listed", names, "row", "noise", seed)}
    SELECT producer, row, {_within(_of("key"), 0, generate.KEYS)} AS key, {columns},
        row + 1000 AS n
    FROM noise GROUP BY producer, row"""


def _generated_source_written() -> str:
    seed = generate.column_seed(GENERATOR_SEED, WRITTEN.name)
    produced = f"""produced AS (SELECT p AS producer, (SELECT count(*) // {PRODUCERS} FROM events) AS records
        FROM range({PRODUCERS}) r(p))"""
    fields = [f for f in WRITTEN.fields if f[0] not in ("ts", "key")]
    columns = ", ".join(["ts", "key", *[n for n, _ in fields]])
    return f"""SELECT {columns} FROM ({_generated_times(seed, produced)}) t
        JOIN ({_generated_stream(seed, produced, fields)}) s USING (producer, row)"""


# -- reports ----------------------------------------------------------------------

_LOG = """
    log AS (SELECT CAST(o_custkey % 3 AS INTEGER) AS run_id, o_orderpriority AS strategy,
        CASE WHEN o_totalprice < 50000 THEN 'TimedOut' WHEN o_orderstatus = 'P' THEN 'Failed'
            WHEN o_orderkey % 10 = 0 THEN 'Skipped' ELSE 'Success' END AS status,
        CASE WHEN o_totalprice >= 400000 THEN 'Diff' WHEN o_orderkey % 41 = 0 THEN 'Error' WHEN o_orderstatus = 'F' THEN 'Equal'
            ELSE 'Reordered' END AS relation FROM orders)"""


def _summary(grouping: str) -> str:
    done = "status = 'Success'"
    counters = {
        "total_count": "count(*)",
        "success_count": f"count(*) FILTER ({done})",
        "fail_count": "count(*) FILTER (status = 'Failed')",
        "timeout_count": "count(*) FILTER (status = 'TimedOut')",
        "skipped_count": "count(*) FILTER (status = 'Skipped')",
        "total_res_count": f"count(*) FILTER ({done})",
        "equal_count": f"count(*) FILTER ({done} AND relation = 'Equal')",
        "reorder_count": f"count(*) FILTER ({done} AND relation = 'Reordered')",
        "diff_count": f"count(*) FILTER ({done} AND relation = 'Diff')",
        "error_count": f"count(*) FILTER ({done} AND relation = 'Error')",
    }
    listed = ", ".join(f"{sql} AS {name}" for name, sql in counters.items())
    return f"""WITH {_LOG}, counted AS (
        SELECT coalesce(run_id, -1)::INTEGER AS run_id, coalesce(strategy, 'All') AS strategy, {listed}
        FROM log GROUP BY {grouping})
    SELECT *, success_count / nullif(total_count, 0) AS exec_success_rate,
        (equal_count + reorder_count) / nullif(total_res_count, 0) AS eval_success_rate FROM counted"""


def _profile() -> str:
    """DuckDB forms of the profiled predicates, in the same order."""
    predicates = [
        "l_quantity > 25",
        "l_extendedprice <= 30000.5",
        "l_quantity < 10 AND key > 50",
        "l_quantity < 10 OR key <> 50",
        "NOT (l_extendedprice >= 1000)",
        "l_extendedprice / nullif(key - 7, 0)::DOUBLE < 900",
        "ts % nullif(key, 0) = 0",
        "CASE WHEN ts::HUGEINT * ts <= 9223372036854775807 THEN ts::HUGEINT * ts > 0 END",
    ]
    return " UNION ALL ".join(
        f"SELECT {i} AS predicate_id, count(*) FILTER ({p}) AS n_true, "
        f"count(*) FILTER (NOT ({p})) AS n_false, count(*) FILTER (({p}) IS NULL) AS n_null "
        f"FROM {LINEITEM}"
        for i, p in enumerate(predicates)
    )


def _operators() -> dict[str, str]:
    nullable = "(l_extendedprice / nullif(key - 7, 0)::DOUBLE < 900)"
    truth = {
        "lt": "l_quantity < 25",
        "le": "l_quantity <= 25",
        "gt": "l_quantity > 25",
        "ge": "l_quantity >= 25",
        "eq": "l_quantity = 25",
        "ne": "l_quantity <> 25",
        "both": f"l_quantity < 25 AND {nullable}",
        "either": f"l_quantity < 25 OR {nullable}",
        "neither": f"NOT (l_quantity < 25 OR {nullable})",
        "unknown": f"{nullable} IS NULL",
    }
    counted = ", ".join(f'count(*) FILTER ({p}) AS "{n}"' for n, p in truth.items())
    shifted = "nullif(key - 50, 0)"
    numbers = {
        "added": "ts + key",
        "subtracted": "key - ts",
        "multiplied": "ts * key",
        "overflowed": "CASE WHEN ts::HUGEINT * ts <= 9223372036854775807 THEN ts::HUGEINT * ts END",
        "divided": f"CAST(trunc(ts::DOUBLE / {shifted}::DOUBLE) AS BIGINT)",
        "remainder": f"ts % {shifted}",
        "squared": "key * key",
        "absolute": "abs(key - 50)",
        "smallest": "NULL",
        "tiny": "-128",
        "real": "0.25",
    }
    shown = ", ".join(
        f"coalesce(CAST({sql} AS VARCHAR), 'null') AS {name}" for name, sql in numbers.items()
    )
    return {
        "predicate_operators": f"SELECT key, {counted} FROM {LINEITEM} GROUP BY key",
        "scalar_arithmetic": f"SELECT ts, key, {shown} FROM {LINEITEM}",
    }


def all_sql() -> dict[str, str]:
    identified = f"SELECT event_id, ts, key, value FROM {EVENTS}"
    week = 7 * DAY
    price = "l_extendedprice"
    keyed = _relation("KeyAggSum", "events")
    li_keyed = _relation("KeyAggSum", "lineitem")
    counts = (
        f"SELECT (ts // {6 * HOUR}) * {6 * HOUR} AS start, "
        f"(ts // {6 * HOUR}) * {6 * HOUR} + {6 * HOUR} AS \"end\", count(*) AS count FROM {EVENTS} e"
    )
    rest = f"{counts} WHERE event_type <> 'error' GROUP BY ALL"
    spread = ", ".join(
        f"round(var_pop({kind}_success_rate), 8) AS {kind}_variance" for kind in ("exec", "eval")
    )
    return (
        _relations()
        | _operators()
        | {
            "predicate_profile": _profile(),
            "generated_source_written": _generated_source_written(),
            "predicate_pool": "SELECT i::INTEGER AS predicate_id, (SELECT count(*) FROM lineitem) "
            "AS covered FROM range(20) p(i)",
            "project_rename": f"SELECT key AS supplier, l_quantity, ts AS shipped FROM {LINEITEM}",
            "window_all_aggregates": f"SELECT (ts // {week}) * {week} AS start, "
            f"(ts // {week}) * {week} + {week} AS \"end\", "
            + ", ".join(f"{_aggregate(a, price)} AS {a}_price" for a in ("min", "max", "sum", "avg"))
            + f", count(*) AS n FROM {LINEITEM} GROUP BY ALL",
            "window_in_minutes": "SELECT (ts // 5400000) * 5400000 AS start, "
            '(ts // 5400000) * 5400000 + 5400000 AS "end", key, count(*) AS n '
            f"FROM {EVENTS} GROUP BY ALL",
            "multi_source_union": identified,
            "merged_producers": f"SELECT ts, key, value FROM {EVENTS} UNION ALL "
            "SELECT epoch_us(o_orderdate) // 1000, o_custkey, o_totalprice FROM orders",
            "from_source": identified,
            "stream_csv_source": identified,
            "stream_many_triggers": f"{counts} GROUP BY ALL",
            "stream_producer_clocks": f"WITH t AS (SELECT key, ts + (event_id % {PRODUCERS}) * "
            f"{CLOCKS_APART_MS} AS ts FROM {EVENTS} e) SELECT (ts // {6 * HOUR}) * {6 * HOUR} AS start, "
            f"(ts // {6 * HOUR}) * {6 * HOUR} + {6 * HOUR} AS \"end\", key, count(*) AS count "
            "FROM t GROUP BY ALL",
            "csv_sink": keyed,
            "typed_header_read": identified,
            "declared_ranges": """
                SELECT 'l_orderkey' AS field,
                    count(*) FILTER (l_orderkey NOT BETWEEN -32768 AND 32767) AS outside FROM lineitem
                UNION ALL SELECT 'l_suppkey', count(*) FILTER (l_suppkey NOT BETWEEN 0 AND 255)
                FROM lineitem
                UNION ALL SELECT 'l_linenumber', count(*) FILTER (l_linenumber NOT BETWEEN 0 AND 255)
                FROM lineitem""",
            "generated_times": _generated_times(),
            "generated_stream": _generated_stream(),
            "generated_stream_stats": f"SELECT event_id % {PRODUCERS} AS producer, count(*) AS records, "
            "count(DISTINCT event_id) AS positions, 0::BIGINT AS outside FROM events GROUP BY 1",
            "compare_equal": _bags(li_keyed, li_keyed, "*"),
            "compare_reordered": f"""
                WITH l AS (SELECT *, event_id AS pos FROM ({identified})),
                r AS (SELECT * REPLACE (-pos AS pos) FROM l),
                n AS (SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows,
                (SELECT count(*) FROM (SELECT * EXCLUDE (pos) FROM l EXCEPT ALL SELECT * EXCLUDE (pos) FROM r))
                + (SELECT count(*) FROM (SELECT * EXCLUDE (pos) FROM r EXCEPT ALL SELECT * EXCLUDE (pos) FROM l))
                AS differing, (SELECT count(*) FROM (FROM l EXCEPT ALL FROM r)) AS moved)
                SELECT CASE WHEN differing > 0 THEN 'Diff' WHEN moved > 0 THEN 'Reordered' ELSE 'Equal' END
                AS relation, left_rows, right_rows, differing, FALSE AS tolerant FROM n""",
            "compare_ordered_equal": f"""
                WITH l AS (SELECT *, event_id AS pos FROM ({identified})), n AS (SELECT
                (SELECT count(*) FROM l) AS rows, (SELECT count(*) FROM (FROM l EXCEPT ALL FROM l)) AS moved)
                SELECT CASE WHEN moved > 0 THEN 'Reordered' ELSE 'Equal' END AS relation, rows AS left_rows,
                rows AS right_rows, moved AS differing, FALSE AS tolerant FROM n""",
            # Row by row both values are close, so a pairing exists; no shifted row equals another one.
            "compare_two_floats": """
                WITH l AS (SELECT event_type, value, user_id / 4 AS share FROM events),
                r AS (SELECT event_type, value + 0.0004 AS value, share - 0.0004 AS share FROM l)
                SELECT CASE WHEN bool_and(abs(value + 0.0004 - value) < 1e-3) THEN 'Reordered' ELSE 'Diff' END
                AS relation, count(*) AS left_rows, count(*) AS right_rows,
                (SELECT count(*) FROM (FROM l EXCEPT ALL FROM r))
                + (SELECT count(*) FROM (FROM r EXCEPT ALL FROM l)) AS differing, TRUE AS tolerant FROM l""",
            "compare_crossed_pairs": """
                WITH e AS (SELECT event_id AS i, event_id // 60 AS part, event_id * 7919 % 13 * 0.0004::DOUBLE AS x,
                    event_id * 104729 % 17 * 0.0004::DOUBLE AS y FROM events),
                l AS (SELECT part, x, y FROM e),
                m AS (SELECT part, x, y, x + CASE WHEN i % 7 < 3.5 THEN 0.0009::DOUBLE ELSE -0.0009 END AS u,
                    y + CASE WHEN i % 11 < 5.5 THEN 0.0009::DOUBLE ELSE -0.0009 END AS v FROM e),
                r AS (SELECT part, u, v FROM m)
                SELECT CASE WHEN (SELECT bool_and(abs(x - u) < 1e-3 AND abs(y - v) < 1e-3) FROM m) THEN 'Reordered' ELSE 'Diff' END
                AS relation, count(*) AS left_rows, count(*) AS right_rows,
                (SELECT count(*) FROM (FROM l EXCEPT ALL FROM r))
                + (SELECT count(*) FROM (FROM r EXCEPT ALL FROM l)) AS differing, TRUE AS tolerant FROM l""",
            "compare_by_digest": f"""
                WITH l AS (SELECT count(*) AS n, count(*) FILTER (key <> 7) AS fewer FROM {LINEITEM})
                SELECT 'origin' AS name, n AS rows, TRUE AS same FROM l UNION ALL SELECT 'split', n, TRUE FROM l
                UNION ALL SELECT 'fewer', fewer, n = fewer FROM l""",
            "extract_diffs": """
                SELECT 'left' AS side, 1::BIGINT AS n, event_id, value FROM events WHERE event_id % 100 = 0
                UNION ALL SELECT 'right', 1, event_id, value + 0.5 FROM events WHERE event_id % 100 = 0""",
            "compare_missing": _bags(
                f"SELECT * FROM {LINEITEM}", f"SELECT * FROM {LINEITEM} WHERE key <> 7", "*"
            ),
            "compare_doubled": _bags(
                f"SELECT * FROM {LINEITEM}",
                f"SELECT * FROM {LINEITEM} UNION ALL SELECT * FROM {LINEITEM} WHERE l_quantity = 10",
                "*",
            ),
            "compare_missing_doubled": _bags(
                "SELECT event_id FROM events",
                "SELECT event_id - event_id % 2 AS event_id FROM events",
                "*",
            ),
            "compare_tolerance": _ranked(0.0004),
            "compare_tolerance_blocks": _ranked(0.0004),
            "compare_beyond_tolerance": _ranked(0.002),
            "compare_types": "SELECT CASE WHEN typeof(any_value(value)) <> 'VARCHAR' THEN 'Error' "
            "ELSE 'Equal' END AS relation, count(*) AS left_rows, count(*) AS right_rows FROM events",
            "diff_of_columns": f"""
                WITH l AS (SELECT event_id, key, value, event_id % 50 = 0 AS a, event_id % 70 = 0 AS b FROM ({identified})),
                r AS (SELECT event_id, CASE WHEN b THEN key + 1000000 ELSE key END AS key,
                    CASE WHEN a THEN value + 1000 ELSE value END AS value FROM l)
                SELECT event_id, CASE WHEN l.value <> r.value THEN 'value' ELSE 'key' END AS column, 1::BIGINT AS n, l.key, l.value
                FROM l JOIN r USING (event_id) WHERE (l.value <> r.value) <> (l.key <> r.key)
                UNION ALL SELECT event_id, NULL, 1, key, value FROM l WHERE a AND b
                UNION ALL SELECT event_id, NULL, 1, key, value FROM r WHERE event_id % 350 = 0""",
            "diff_of_results": f"""
                WITH l AS ({counts} GROUP BY ALL), r AS ({rest})
                SELECT 'left' AS side, 1::BIGINT AS n, * FROM (FROM l EXCEPT ALL FROM r)
                UNION ALL SELECT 'right', 1, * FROM (FROM r EXCEPT ALL FROM l)""",
            "suite_summary": _summary("run_id, strategy"),
            "suite_rollup": _summary("ROLLUP (run_id, strategy)"),
            "suite_totals": _summary("CUBE (run_id, strategy)"),
            "suite_rate_variance": f"SELECT strategy, {spread} "
            f"FROM ({_summary('run_id, strategy')}) GROUP BY strategy",
            # Three relations, two sets each, four others: a predicate of its own for each.
            "suite_predicates": "SELECT i::INTEGER AS run_id, 3 * 2 * 4::BIGINT AS others, "
            "3 * 2 * 4::BIGINT AS predicates FROM range(2) r(i)",
            # Two runs of two relations with an origin and two others each, all of them right.
            "report_of_runs": "SELECT r::INTEGER AS run_id, s AS strategy, 3::BIGINT AS total_count, "
            "3::BIGINT AS success_count, 0::BIGINT AS fail_count, 0::BIGINT AS timeout_count, "
            "0::BIGINT AS skipped_count, 2::BIGINT AS total_res_count, 2::BIGINT AS equal_count, "
            "0::BIGINT AS reorder_count, 0::BIGINT AS diff_count, 0::BIGINT AS error_count, 1::DOUBLE AS exec_success_rate, "
            "1::DOUBLE AS eval_success_rate FROM range(2) a(r), (VALUES ('Filter'), ('KeyAggSum')) b(s)",
            **{f"avg_bigint_{side}": _avg_bigint() for side in ("origin", "other")},
            "suite_verdicts": "SELECT i::INTEGER AS set_id, 'Other0' AS case_id, name AS strategy, "
            "'Equal' AS relation FROM (VALUES "
            + ", ".join(f"({i}, '{n}')" for i, n in enumerate(RELATIONS))
            + ") v(i, name)",
            "suite_verdicts_stream": "SELECT i::INTEGER AS set_id, 'Other0' AS case_id, name AS strategy, 'Equal' AS relation, "
            "CASE WHEN name = 'Filter' THEN (SELECT count(*) FROM events) ELSE 0 END AS filtered "
            "FROM (VALUES (0, 'Filter'), (1, 'AggCount'), (2, 'KeyAggAvg')) v(i, name)",
            "replay_pair": keyed,
            "recheck_stored": f"""
                WITH k AS ({keyed}), n AS (SELECT count(*) AS n, count(*) FILTER (key <> 7) AS rest FROM k)
                SELECT FALSE AS changed, 0 AS set_id, 'Other0' AS case_id, 'Equal' AS relation, n AS left_rows,
                    n AS right_rows, 0::BIGINT AS differing FROM n
                UNION ALL SELECT TRUE, 0, 'Other0', CASE WHEN n = rest THEN 'Equal' ELSE 'Diff' END, n, rest, n - rest FROM n""",
        }
    )
