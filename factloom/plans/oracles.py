"""The SQL twin of each query, for DuckDB over the same tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Columns of the tables that queries walk column by column.
COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "labels": ("doc_id", "quality", "toxic"),
}


def r(x: str, digits: int) -> str:
    factor = f"{10**digits}::DOUBLE"
    return f"(floor(({x})::DOUBLE * {factor} + 0.5) / {factor})"


def agg(kind: str, y: str = "y", where: str = "") -> str:
    tail = f" FILTER (WHERE {where})" if where else ""
    if kind == "count":
        return f"(count(*){tail})::DOUBLE"
    if kind == "count_distinct":
        return f"(count(DISTINCT {y}){tail})::DOUBLE"
    # Exact totals: the data has two decimals, and a float sum may fall either side of a tie.
    total = f"(sum(({y})::DECIMAL(30, 6)){tail})::DOUBLE"
    value = f"coalesce({total if kind == 'sum' else f'{total} / count({y}){tail}' if kind == 'avg' else f'{kind}({y}){tail}'}, 0)"
    return {"sum": r(value, 2), "avg": r(value, 4)}.get(kind, f"({value})::DOUBLE")


def shown(x: str) -> str:
    """Display text of a double."""
    return f"CASE WHEN {x} = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE ({x})::VARCHAR END"


def ranked(source: str, name: str, limit: int, measure: str, key: str = "k") -> str:
    """CTEs ``k<name>`` (kept keys) and ``n<name>`` (names with rank, Other last)."""
    return f"""
    g{name} AS (SELECT {name} AS g, {measure} AS v, min({key}) AS f FROM {source} WHERE {name} IS NOT NULL GROUP BY 1),
    r{name} AS (SELECT g, row_number() OVER (ORDER BY v DESC, f, g) AS rk, count(*) OVER () AS n FROM g{name}),
    k{name} AS (SELECT g, rk FROM r{name} WHERE (n <= {limit} AND rk <= {limit}) OR (n > {limit} AND rk < {limit})),
    n{name} AS (SELECT g AS name, rk - 1 AS o FROM k{name}
                UNION ALL SELECT 'Other', {limit} - 1 FROM (SELECT max(n) AS n FROM r{name}) WHERE n > {limit})"""


def time_sql(base: str, grain: str, kind: str, split: bool, fill: bool) -> str:
    """``base`` selects b (bucket), s (series), y and k (row order)."""
    form = {"hour": "%Y-%m-%dT%H:00", "day": "%Y-%m-%d", "week": "%Y-%m-%d", "month": "%Y-%m-01"}[grain]
    if not split:
        return f"""WITH base AS ({base}), cells AS (SELECT b, {agg(kind)} AS v FROM base WHERE b IS NOT NULL GROUP BY b)
        SELECT strftime(b, '{form}') AS x, 'value' AS series, v AS value,
               (row_number() OVER (ORDER BY b) - 1)::INTEGER AS x_ord, 0::INTEGER AS series_ord FROM cells"""
    present = "" if fill else "WHERE c.v IS NOT NULL"
    return f"""WITH base AS ({base}), {ranked("base", "s", 5, agg(kind))},
    lab AS (SELECT b, coalesce(ks.g, 'Other') AS name, y FROM base LEFT JOIN ks ON ks.g = base.s WHERE b IS NOT NULL AND s IS NOT NULL),
    cells AS (SELECT b, name, {agg(kind)} AS v FROM lab GROUP BY 1, 2),
    buckets AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS xo FROM (SELECT DISTINCT b FROM cells)),
    pts AS (SELECT u.b, u.xo, ns.name, ns.o, c.v FROM buckets u CROSS JOIN ns LEFT JOIN cells c ON c.b = u.b AND c.name = ns.name {present}),
    seen AS (SELECT name, min((xo * 2 + CASE WHEN v IS NULL THEN 1 ELSE 0 END) * 100 + o) AS first FROM pts GROUP BY name),
    orders_of AS (SELECT name, row_number() OVER (ORDER BY first) - 1 AS so FROM seen)
    SELECT strftime(p.b, '{form}') AS x, p.name AS series, coalesce(v, 0)::DOUBLE AS value, xo::INTEGER AS x_ord, so::INTEGER AS series_ord
    FROM pts p JOIN orders_of USING (name)"""


def category_sql(base: str, kind: str, limit: int) -> str:
    """``base`` selects x, s (series), y and k."""
    return f"""WITH base AS ({base}), {ranked("base", "x", limit, agg(kind))}, {ranked("base", "s", 5, "count(*)")},
    cells AS (SELECT coalesce(kx.g, 'Other') AS x, coalesce(ks.g, 'Other') AS s, {agg(kind)} AS v
              FROM base LEFT JOIN kx ON kx.g = base.x LEFT JOIN ks ON ks.g = base.s
              WHERE base.x IS NOT NULL AND base.s IS NOT NULL GROUP BY 1, 2)
    SELECT nx.name AS x, ns.name AS series, coalesce(v, 0)::DOUBLE AS value, nx.o::INTEGER AS x_ord, ns.o::INTEGER AS series_ord
    FROM nx CROSS JOIN ns LEFT JOIN cells ON cells.x = nx.name AND cells.s = ns.name"""


def other_sql(base: str, kind: str, limit: int, measure: str) -> str:
    return f"""WITH base AS ({base}), {ranked("base", "x", limit, measure)}
    SELECT coalesce(kx.g, 'Other') AS key, {agg(kind)} AS value, count(*) AS rows, max(nx.o)::INTEGER AS ord
    FROM base LEFT JOIN kx ON kx.g = base.x JOIN nx ON nx.name = coalesce(kx.g, 'Other') WHERE base.x IS NOT NULL GROUP BY 1"""


def histogram_sql(column: str, table: str) -> str:
    return f"""WITH v AS (SELECT {column}::DOUBLE AS v FROM {table} WHERE {column} IS NOT NULL),
    m AS (SELECT min(v) AS lo, max(v) AS hi, bool_and(v = floor(v)) AS ints FROM v),
    w AS (SELECT lo, CASE WHEN ints AND hi - lo < 20 THEN (hi - lo + 1)::INTEGER ELSE 20 END AS bins,
                 CASE WHEN ints AND hi - lo < 20 THEN 1.0::DOUBLE WHEN hi = lo THEN 1.0::DOUBLE / 20 ELSE (hi - lo) / 20 END AS width FROM m),
    c AS (SELECT least(floor((v.v - lo) / width)::INTEGER, bins - 1) AS bin, count(*) AS n FROM v, w GROUP BY 1)
    SELECT {r("lo + i * width", 2)} AS x, {r("lo + (i + 1) * width", 2)} AS x2, coalesce(n, 0)::DOUBLE AS value, i::INTEGER AS x_ord
    FROM w, unnest(range(bins)) AS g(i) LEFT JOIN c ON c.bin = g.i"""


# ---------- values ----------

ORACLES["rounding"] = f"""SELECT c_custkey, {r("c_acctbal", 0)} AS whole, {r("-c_acctbal / 8", 1)} AS tenth,
    {r("c_acctbal / 3", 4)} AS fourth FROM customer"""

_KEYS = {"hour": "%Y-%m-%dT%H:00", "day": "%Y-%m-%d", "week": "%Y-%m-%d", "month": "%Y-%m-01"}
_LABELS = {"hour": "%H:00 on %b %-d", "day": "%b %-d", "week": "the week of %b %-d", "month": "%B %Y"}
_WORDS = {"hour": "at ", "day": "on ", "week": "in ", "month": "in "}
ORACLES["bucket_keys"] = " UNION ALL ".join(
    f"""SELECT '{g}' AS grain, strftime(b, '{_KEYS[g]}') AS key, strftime(b, '{_LABELS[g]}') AS label,
        '{_WORDS[g]}' || strftime(b, '{_LABELS[g]}') AS phrase, strftime(b, '%Y-%m-01') AS month_key, count(*) AS n
        FROM (SELECT date_trunc('{g}', ts)::TIMESTAMP AS b FROM events) GROUP BY b"""
    for g in _KEYS
)

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"
ORACLES["day_numbers"] = f"""SELECT user_id, min(ts::DATE - DATE '1970-01-01')::INTEGER AS first_day,
    max(ts::DATE - DATE '1970-01-01')::INTEGER AS last_day, max(floor(epoch_us(ts) / 1000) / 1000)::DOUBLE AS last_second,
    max({_ISO}) AS last_text FROM events GROUP BY user_id"""

ORACLES["display_texts"] = f"""SELECT {shown("l_quantity")} AS l_quantity, {shown("l_discount")} AS l_discount,
    strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"""

ORACLES["price_texts"] = f"""SELECT l_orderkey, l_linenumber, l_partkey, {shown("big")} AS big,
    CASE WHEN small = 0 THEN '0' ELSE rtrim(rtrim(printf('%.6f', small), '0'), '.') END AS small
    FROM (SELECT *, l_extendedprice * 1000 + 0.5 AS big, l_discount / 100 AS small FROM lineitem)"""

ORACLES["category_keys"] = """SELECT CASE WHEN event_type <> 'error' THEN CASE WHEN value > 50 THEN 'Yes' ELSE 'No' END END AS key,
    count(*) AS n FROM events GROUP BY 1"""

_RAW = """SELECT o_orderkey, ' $' || o_totalprice::VARCHAR AS price, (o_orderkey % 50)::VARCHAR || '%' AS share,
    CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'NO ' ELSE 'maybe' END AS flag,
    month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) AS day,
    strftime(o_orderdate, '%Y-%m-%d') || 'T10:30:05.25+02:00' AS stamp, chr(9) || o_orderpriority || '  ' AS note FROM orders"""
_PARSED = """regexp_replace(price, '[ $]', '', 'g')::DOUBLE AS price, regexp_replace(share, '%', '')::DOUBLE AS share,
    CASE lower(trim(flag)) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END::INTEGER AS flag,
    strftime(strptime(day, '%-m/%-d/%Y'), '%Y-%m-%d') AS day,
    strftime(replace(stamp[:22], 'T', ' ')::TIMESTAMP - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%g') AS stamp,
    regexp_replace(note, '^\\s+|\\s+$', '', 'g') AS note"""
ORACLES["parsed_values"] = f"""SELECT o_orderkey, {_PARSED}, NULL::DOUBLE AS no_number, 1::INTEGER AS day_only FROM ({_RAW})"""

# ---------- types ----------

# The patterns of names, numbers and dates that type rules read.
_ID_NAME = "(?i)(^id$|_id$|^id_|uuid|guid)"
_CODE_NAME = "(?i)(status|code|level|rating|tier)"
_NUMBER = "[-+]?[$€£]?\\s?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\\.[0-9]+)?%?"
_DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?(\\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?"
_TYPE = f"""CASE WHEN n = 0 THEN 'text' WHEN regexp_matches(name, '{_ID_NAME}') THEN 'id' WHEN nb = n THEN 'boolean'
    WHEN nd >= 0.9 * n THEN 'datetime'
    WHEN nn >= 0.95 * n AND ni = n AND nv <= 12 AND regexp_matches(name, '{_CODE_NAME}') THEN 'categorical'
    WHEN nn >= 0.95 * n THEN 'numeric' WHEN nv <= least(200, greatest(50, n * 0.05)) THEN 'categorical'
    WHEN nv = n AND nx = n THEN 'id' ELSE 'text' END"""


def column_sql(table: str, name: str, position: int, source: str | None = None) -> str:
    """Statistics and type of one column, read as text."""
    source = source or name
    return f"""SELECT '{table}' AS dataset_id, name, {position}::INTEGER AS position, {_TYPE} AS type FROM (
        SELECT '{name}' AS name, count(*) AS n, count_if(lower(trim(v)) IN ('true', 'false', 'yes', 'no')) AS nb,
        count_if(regexp_full_match(v, '{_DATE}')) AS nd, count_if(regexp_full_match(v, '{_NUMBER}')) AS nn,
        count_if(regexp_full_match(v, '{_NUMBER}') AND try_cast(v AS DOUBLE) = floor(try_cast(v AS DOUBLE))) AS ni,
        count(DISTINCT v) AS nv, count_if(regexp_full_match(v, '[A-Za-z]*[-_]?[0-9]+')) AS nx
        FROM (SELECT ({source})::VARCHAR AS v FROM {table}) WHERE trim(v) <> '')"""


ORACLES["infer_types"] = " UNION ALL ".join(column_sql(t, c, i) for t, names in COLUMNS.items() for i, c in enumerate(names))
ORACLES["date_columns"] = f"""SELECT dataset_id, arg_min(name, position) AS date_column FROM ({ORACLES["infer_types"]})
    WHERE type = 'datetime' GROUP BY dataset_id"""
ORACLES["coerce_values"] = f"""SELECT o_orderkey::BIGINT AS o_orderkey, price, share::BIGINT AS share, lower(trim(raw_flag)) AS flag, day,
    stamp, note FROM (SELECT o_orderkey, flag AS raw_flag, {_PARSED.replace("END::INTEGER AS flag", "END AS no_flag")} FROM ({_RAW}))"""
ORACLES["coerce_values"] = ORACLES["coerce_values"].replace("lower(trim(raw_flag)) AS flag", "trim(raw_flag) AS flag")
ORACLES["retyped_column"] = """SELECT p_size::VARCHAR AS p_size, count(*) AS n, max(p_retailprice) AS dearest FROM part GROUP BY 1"""

# ---------- profiles ----------

ORACLES["profile_numeric"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, {i}::INTEGER AS position, {r(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", 4)} AS null_pct,
    count(DISTINCT {c}) AS distinct_count, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {r(f"avg({c})", 4)} AS mean,
    {r(f"quantile_cont({c}::DOUBLE, 0.5)", 4)} AS median, {r(f"quantile_cont({c}::DOUBLE, 0.95)", 4)} AS p95, {r(f"sum({c})", 2)} AS sum FROM lineitem"""
    for i, c in enumerate(("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
)
ORACLES["profile_numeric_bracketed"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, {r(f"quantile_cont({c}, 0.5)", 4)} AS median, {r(f"quantile_cont({c}, 0.95)", 4)} AS p95 FROM lineitem"""
    for c in ("l_extendedprice", "l_quantity")
)


def grain_of(lo: str, hi: str, monthly: str) -> str:
    span = f"(epoch({hi}) - epoch({lo}))"
    return f"""CASE WHEN {monthly} THEN 'month' WHEN {span} <= 3 * 86400 THEN 'hour' WHEN {span} <= 120 * 86400 THEN 'day'
        WHEN {span} <= 732 * 86400 THEN 'week' ELSE 'month' END"""


def monthly_of(c: str) -> str:
    return f"(bool_and({c} = date_trunc('month', {c})) AND count({c}) > 1 AND min({c}) <> max({c}))"


ORACLES["profile_datetime"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS dataset_id, '{c}' AS name, {r(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", 4)} AS null_pct,
    count(DISTINCT date_trunc('millisecond', {c})) AS distinct_count, strftime(min({c}), '%Y-%m-%dT%H:%M:%S.%gZ') AS min,
    strftime(max({c}), '%Y-%m-%dT%H:%M:%S.%gZ') AS max,
    {grain_of(f"date_trunc('millisecond', min({c}))", f"date_trunc('millisecond', max({c}))", monthly_of(c))} AS grain FROM {t}"""
    for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
)
ORACLES["profile_categorical"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, distinct_count, (row_number() OVER (ORDER BY n DESC, value) - 1)::INTEGER AS rank, value, n FROM (
        SELECT {c} AS value, count(*) AS n, count(*) OVER () AS distinct_count FROM part WHERE {c} IS NOT NULL GROUP BY {c})
        QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 10"""
    for c in ("p_name", "p_brand", "p_type")
)
ORACLES["table_sizes"] = " UNION ALL ".join(
    f"SELECT '{t}' AS dataset_id, count(*) AS row_count, {len(names)}::INTEGER AS column_count FROM {t}" for t, names in COLUMNS.items()
)

# ---------- filters, paging, lookup ----------

_TWO_STATUSES = "o_orderstatus IN ('F', 'O')"
ORACLES["filters_date_where"] = f"""SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
    WHERE o_orderdate::DATE BETWEEN '1996-01-01' AND '1997-12-31' AND {_TWO_STATUSES}"""
ORACLES["filters_by_stamp"] = """SELECT event_id, event_type FROM events WHERE date_trunc('milliseconds', ts) IN (
    SELECT date_trunc('milliseconds', min(ts)) FROM events GROUP BY event_type)"""
ORACLES["filters_by_text"] = f"""SELECT l_linenumber, l_discount, count(*) AS n FROM lineitem
    WHERE l_linenumber::VARCHAR IN ('1', '02', 'x', '3') AND {shown("l_discount")} IN ('0.05', '0.1', '0.10') GROUP BY 1, 2"""


def _preset(first: str) -> str:
    return f"""WITH m AS (SELECT max(ts)::DATE AS d FROM events)
    SELECT event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day
    FROM events, m WHERE ts::DATE BETWEEN {first} AND d GROUP BY event_type"""


ORACLES["date_preset_7d"] = _preset("d - 6")
ORACLES["date_preset_30d"] = _preset("d - 29")
ORACLES["date_preset_ytd"] = _preset("date_trunc('year', d)::DATE")
ORACLES["rows_page"] = f"""SELECT o_orderkey, o_orderstatus, o_totalprice, rn::INTEGER AS row_no, total FROM (
    SELECT *, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn, count(*) OVER () AS total
    FROM orders WHERE {_TWO_STATUSES}) WHERE rn BETWEEN 101 AND 150"""
ORACLES["deep_page"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, rn::INTEGER AS row_no, total FROM (
    SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey) AS rn, count(*) OVER () AS total FROM lineitem)
    WHERE rn > (total // 50 - 1) * 50 AND rn <= total // 50 * 50"""
ORACLES["rows_as_json"] = f"""SELECT '{{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus
    || '","o_totalprice":' || {shown("o_totalprice")} || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ')
    || '","o_orderpriority":"' || o_orderpriority || '"}}' AS json FROM orders"""
ORACLES["filter_values"] = """SELECT p_name AS value, count(*) AS n FROM part WHERE contains(lower(p_name), 're') GROUP BY 1
    ORDER BY n DESC, value LIMIT 100"""
ORACLES["filter_values_numeric"] = f"""SELECT {shown("l_quantity")} AS value, count(*) AS n FROM lineitem GROUP BY 1
    ORDER BY n DESC, value LIMIT 100"""
_FOUND = "contains(lower(c_name), 'mach') OR contains(lower(c_mktsegment), 'mach')"
ORACLES["catalog_page"] = f"""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
    CASE WHEN total > 100 THEN '100' END AS next_cursor FROM (
    SELECT *, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey DESC) AS rn, count(*) OVER () AS total
    FROM customer WHERE {_FOUND}) WHERE rn BETWEEN 51 AND 100"""
ORACLES["catalog_by_name"] = """SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CASE WHEN total > 50 THEN '50' END AS next_cursor FROM (
    SELECT *, row_number() OVER (ORDER BY lower(s_name), s_name) AS rn, count(*) OVER () AS total FROM supplier) WHERE rn <= 50"""
ORACLES["latest_by"] = """SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"""
ORACLES["latest_order"] = """SELECT o_custkey, o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""

# ---------- aggregation ----------

_CASES = [("value", a) for a in ("sum", "avg", "count", "min", "max", "count_distinct")] + [("event_type", "count_distinct")]
ORACLES["aggregates_all"] = f"""SELECT {", ".join(f"{agg(a, c)} AS {c}_{a}" for c, a in _CASES)}, 0::DOUBLE AS event_type_sum,
    {agg("avg", "(value > 50)::INTEGER")} AS dear_avg, {agg("sum", "(value > 50)::INTEGER")} AS dear_sum,
    {r("count(*)", 4)} AS gone_avg FROM events"""
_MASKS = {"open": "l_linestatus = 'O'", "back": "l_returnflag = 'R'", "both": "l_linestatus = 'O' AND l_returnflag = 'R'"}
_MASKED = (("l_extendedprice", "sum"), ("l_quantity", "avg"), ("l_partkey", "count_distinct"), ("1", "count"), ("l_discount", "max"))
ORACLES["masked_aggregates"] = f"""SELECT {", ".join(f"{agg(a, c, m)} AS {n}_{a}" for n, m in _MASKS.items() for c, a in _MASKED)} FROM lineitem"""
ORACLES["group_by_category"] = f"""SELECT l_linenumber::VARCHAR AS key, {agg("avg", "l_extendedprice")} AS value, count(*) AS rows,
    min(l_orderkey) AS first FROM lineitem GROUP BY 1"""
ORACLES["category_top_other"] = category_sql("SELECT p_brand AS x, 'value' AS s, p_retailprice AS y, p_partkey AS k FROM part", "sum", 5)
ORACLES["category_distinct_other"] = other_sql(
    "SELECT event_type AS x, user_id AS y, event_id AS k FROM events", "count_distinct", 3, agg("count_distinct"))
ORACLES["category_rows_other"] = other_sql("SELECT p_name AS x, p_retailprice AS y, p_partkey AS k FROM part", "avg", 6, "count(*)")
ORACLES["category_split"] = category_sql(
    "SELECT l_returnflag AS x, l_linestatus AS s, 1 AS y, l_orderkey AS k FROM lineitem", "count", 8)
ORACLES["category_split_other"] = category_sql(
    f"SELECT l_linenumber::VARCHAR AS x, {shown('l_tax')} AS s, l_quantity AS y, l_orderkey AS k FROM lineitem", "avg", 6)
ORACLES["time_series_split"] = time_sql(
    f"""SELECT date_trunc('month', o_orderdate) AS b, o_orderpriority AS s, o_totalprice AS y, o_orderkey AS k FROM orders
    WHERE o_orderdate::DATE BETWEEN '1996-01-01' AND '1999-12-31' AND {_TWO_STATUSES}""", "month", "avg", True, False)
ORACLES["time_series_fold"] = time_sql(
    "SELECT date_trunc('month', l_shipdate) AS b, l_linenumber::VARCHAR AS s, l_extendedprice AS y, l_orderkey AS k FROM lineitem",
    "month", "sum", True, True)
ORACLES["time_series_zero_fill"] = time_sql(
    "SELECT date_trunc('hour', ts) AS b, event_type AS s, 1 AS y, event_id AS k FROM events", "hour", "count", True, True)
ORACLES["time_series_sparse"] = time_sql(
    "SELECT date_trunc('hour', ts) AS b, (user_id % 7)::VARCHAR AS s, value AS y, event_id AS k FROM events", "hour", "max", True, False)
ORACLES["time_series_week"] = time_sql(
    "SELECT date_trunc('week', l_shipdate) AS b, 'value' AS s, l_extendedprice AS y, l_orderkey AS k FROM lineitem", "week", "sum", False, True)
ORACLES["time_series_distinct"] = time_sql(
    "SELECT date_trunc('day', ts) AS b, event_type AS s, user_id AS y, event_id AS k FROM events", "day", "count_distinct", True, False)
ORACLES["histogram_20"] = histogram_sql("o_totalprice", "orders")
ORACLES["histogram_unit"] = histogram_sql("l_linenumber", "lineitem")

_KEPT = f"""(SELECT * FROM orders WHERE o_orderdate::DATE BETWEEN '1996-01-01' AND '1999-12-31' AND {_TWO_STATUSES})"""


def _widget(widget_id: str, sql: str, fmt: str) -> str:
    return f"""SELECT '{widget_id}' AS widget_id, x, NULL::VARCHAR AS x2, series, value, x_ord, series_ord, '{fmt}' AS format,
        NULL::VARCHAR AS x_format FROM ({sql})"""


_BY_PRIORITY = f"SELECT o_orderpriority AS x, 'value' AS s, o_totalprice AS y, o_orderkey AS k FROM {_KEPT}"
ORACLES["dashboard_points"] = " UNION ALL ".join(
    [
        _widget("line", time_sql(f"SELECT date_trunc('month', o_orderdate) AS b, 'v' AS s, o_totalprice AS y, 1 AS k FROM {_KEPT}", "month", "avg", False, False), "currency"),
        _widget("rows", time_sql(f"SELECT date_trunc('month', o_orderdate) AS b, 'v' AS s, 1 AS y, 1 AS k FROM {_KEPT}", "month", "count", False, True), "number"),
        _widget("status", category_sql(f"SELECT o_orderstatus AS x, 'value' AS s, o_totalprice AS y, o_orderkey AS k FROM {_KEPT}", "avg", 8), "currency"),
        _widget("priority", category_sql(_BY_PRIORITY, "sum", 4), "currency"),
        _widget("buyers", category_sql(_BY_PRIORITY.replace("o_totalprice AS y", "o_custkey AS y"), "count_distinct", 6), "number"),
        f"""SELECT 'spread' AS widget_id, {shown("x")} AS x, {shown("x2")} AS x2, 'value' AS series, value, x_ord, 0::INTEGER AS series_ord,
            'number' AS format, 'currency' AS x_format FROM ({histogram_sql("o_totalprice", _KEPT)})""",
    ]
)

# ---------- KPIs ----------


def kpi_sql(source: str, kpis: list[tuple], value: str, current: str, previous: str, label: str) -> str:
    """``kpis``: (id, label, column, aggregation, format, scale, expression)."""
    parts = []
    for i, (kid, name, column, kind, fmt, scale, expression) in enumerate(kpis):
        v, c, p = (r(f"{agg(kind, expression, w)} * {scale}", 2) for w in (value, current, previous))
        parts.append(f"SELECT {i}::INTEGER AS ord, '{kid}' AS id, '{name}' AS label, '{column}' AS column, '{kind}' AS aggregation, "
                     f"{v} AS value, {c} AS cur, {p} AS prev, {label} AS label_text, '{fmt}' AS format FROM {source}")
    delta = r("(cur - prev) / abs(nullif(prev, 0))", 4)
    return f"""SELECT ord, id, label, "column", aggregation, value, {delta} AS delta,
        CASE WHEN prev <> 0 THEN label_text END AS delta_label, format FROM ({" UNION ALL ".join(parts)})"""


_EVENT_KPIS = [
    ("entities", "Users", "user_id", "count_distinct", "number", 1, "user_id"),
    ("m:value", "Total value", "value", "sum", "number", 1, "value"),
    ("rate:is_error", "Error rate", "is_error", "avg", "percent", 100, "(event_type = 'error')::INTEGER"),
]


def _event_windows(selected: str) -> tuple[str, str, str, str, str]:
    source = f"""(SELECT *, least(30, (hi - lo + 1) // 2) AS w FROM (SELECT *, (ts::DATE - DATE '1970-01-01') AS d,
        min(CASE WHEN {selected} THEN ts::DATE - DATE '1970-01-01' END) OVER () AS lo,
        max(CASE WHEN {selected} THEN ts::DATE - DATE '1970-01-01' END) OVER () AS hi FROM events))"""
    label = "'Last ' || max(w) || ' days vs prior ' || max(w)"
    return source, selected, "d BETWEEN hi - w + 1 AND hi", "d BETWEEN hi - 2 * w + 1 AND hi - w", label


_W = _event_windows("true")
ORACLES["kpis_default"] = kpi_sql(_W[0], _EVENT_KPIS, *_W[1:])
_W = _event_windows("ts::DATE >= '2024-01-12'")
ORACLES["kpis_open_range"] = kpi_sql(_W[0], _EVENT_KPIS, *_W[1:])
ORACLES["kpis_range"] = kpi_sql(
    "(SELECT * FROM events WHERE event_type IN ('click', 'error', 'view'))", _EVENT_KPIS,
    "ts::DATE BETWEEN '2024-01-15' AND '2024-01-21'", "ts::DATE BETWEEN '2024-01-15' AND '2024-01-21'",
    "ts::DATE BETWEEN '2024-01-08' AND '2024-01-14'", "'vs previous 7 days'")
ORACLES["dashboard_kpis"] = kpi_sql(
    f"(SELECT * FROM orders WHERE {_TWO_STATUSES})",
    [("entities", "Customers", "o_custkey", "count_distinct", "number", 1, "o_custkey"),
     ("m:o_totalprice", "Average o totalprice", "o_totalprice", "avg", "currency", 1, "o_totalprice")],
    "year(o_orderdate) = 1997", "year(o_orderdate) = 1997", "o_orderdate::DATE BETWEEN '1996-01-02' AND '1996-12-31'",
    "'vs previous 365 days'")

# ---------- catalog ----------

_DATES = {"ts", "o_orderdate", "l_shipdate"}


def _catalog_column(table: str, name: str, position: int, source: str | None = None) -> str:
    c = source or name
    text = f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%g')" if name in _DATES else f"({c})"
    lo, hi, monthly = (f"date_trunc('millisecond', min({c}))", f"date_trunc('millisecond', max({c}))", monthly_of(c)) if name in _DATES else ("NULL::TIMESTAMP", "NULL::TIMESTAMP", "false")
    top = f"""(SELECT max(n)::DOUBLE / sum(n) FROM (SELECT count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC LIMIT 10))"""
    return f"""SELECT t.*, p.* FROM ({column_sql(table, name, position, source)}) t, (SELECT
        {r(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)", 4)} AS null_pct, count(DISTINCT {text}) AS distinct_count,
        {lo} AS lo, {hi} AS hi, {grain_of(lo, hi, monthly)} AS grain, {top} AS share FROM {table}) p"""


_CATALOG = " UNION ALL ".join(
    [_catalog_column(t, c, i) for t in ("orders", "events", "part", "lineitem") for i, c in enumerate(COLUMNS[t])]
    + [_catalog_column("events", "is_error", 6, "event_type = 'error'")]
)


def over_catalog(tail: str) -> str:
    return f"WITH catalog AS MATERIALIZED ({_CATALOG}), {tail}"


# The name patterns of measures, most telling first, and of those that are averaged.
_TIERS = ("revenue|sales|gmv", "mrr|arr|recurring", "amount|total|net|value", "profit|margin",
          "latency|duration|response_time|_ms$", "price|cost", "seats|quantity|units|qty")
_TIER = "CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN {i}" for i, p in enumerate(_TIERS)) + " ELSE 7 END"
_AVERAGED = "price|latency|duration|_ms$|rate|pct|percent|ratio|score|age|discount"


def aggregation_of(name: str) -> str:
    return f"CASE WHEN regexp_matches({name}, '{_AVERAGED}') THEN 'avg' ELSE 'sum' END"


def format_of(name: str, kind: str) -> str:
    return f"""CASE WHEN {kind} IN ('count', 'count_distinct') THEN 'number' WHEN regexp_matches({name}, 'latency|duration|_ms$') THEN 'duration_ms'
        WHEN regexp_matches({name}, 'pct|percent') THEN 'percent'
        WHEN regexp_matches({name}, 'revenue|sales|gmv|mrr|arr|amount|price|cost|profit|total') THEN 'currency' ELSE 'number' END"""


def phrase_of(name: str) -> str:
    text = f"regexp_replace(regexp_replace(replace({name}, '_', ' '), '\\bpct\\b', '%'), '\\bms\\b', '')"
    acronyms = "'mrr', 'arr', 'gmv', 'sku', 'url', 'id', 'ip', 'roi', 'ltv', 'cac'"
    return f"""array_to_string(list_transform(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> ''),
        lambda w: CASE WHEN lower(w) IN ({acronyms}) THEN upper(w) ELSE lower(w) END), ' ')"""


def capital(text: str) -> str:
    return f"upper(left({text}, 1)) || substr({text}, 2)"


def label_of(name: str, kind: str) -> str:
    return f"""CASE WHEN {name} IS NULL OR {kind} = 'count' THEN 'Rows' ELSE CASE {kind} WHEN 'sum' THEN 'Total ' ELSE 'Average ' END || {phrase_of(name)} END"""


def flag_of(name: str) -> str:
    nouns = {"churn": "Churn", "cancel": "Cancellation", "error": "Error", "fail": "Failure", "refund": "Refund", "return": "Return", "bounce": "Bounce"}
    whens = " ".join(f"WHEN contains({name}, '{w}') THEN '{n}'" for w, n in nouns.items())
    bare = "regexp_replace(" + name + ", '^(is|has)_', '')"
    return f"CASE {whens} ELSE {capital(phrase_of(bare))} END"


def entity_of(name: str) -> str:
    base = f"coalesce(nullif(trim(replace(regexp_replace({name}, '(?i)(_id|id_|^id)$', ''), '_', ' ')), ''), 'record')"
    return capital(f"(CASE WHEN ends_with({base}, 's') THEN {base} ELSE {base} || 's' END)")


_MEASURES = f"""measures AS (SELECT *, {_TIER} AS tier, row_number() OVER (PARTITION BY dataset_id ORDER BY {_TIER}, position) AS rank
    FROM catalog WHERE type = 'numeric' AND distinct_count > 1)"""
_FLAGS = """flags AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY position) AS rank FROM catalog
    WHERE type = 'boolean' AND regexp_matches(name, 'churn|cancel|error|fail|refund|return|bounce'))"""
_SCORED = f"""scored AS (SELECT *, {r('''0.6 * (CASE WHEN share <= 0.6 THEN share / 0.6 ELSE greatest(0, 1 - (share - 0.6) / (1 - 0.6)) END)
    + 0.25 * (CASE WHEN distinct_count BETWEEN 3 AND 8 THEN 1.0 WHEN distinct_count = 2 OR distinct_count BETWEEN 9 AND 12 THEN 0.5 ELSE 0.25 END)
    + 0.15 * greatest(0, least(1, 1 - null_pct))''', 6)} AS score FROM catalog WHERE type = 'categorical')"""
_CATEGORIES = """categories AS (SELECT *, row_number() OVER (PARTITION BY dataset_id
    ORDER BY CASE WHEN distinct_count BETWEEN 3 AND 8 THEN 0 ELSE 1 END, position) AS rank FROM scored WHERE distinct_count BETWEEN 2 AND 20)"""

ORACLES["profile_catalog"] = over_catalog("done AS (SELECT 1) SELECT dataset_id, name, position, type, null_pct, distinct_count FROM catalog")
ORACLES["rank_measures"] = over_catalog(f"{_MEASURES} SELECT dataset_id, name, tier::INTEGER AS tier, rank::INTEGER AS rank FROM measures")
ORACLES["flag_columns"] = over_catalog(f"{_FLAGS} SELECT dataset_id, name, rank::INTEGER AS rank FROM flags")
ORACLES["column_labels"] = over_catalog(f"""named AS (SELECT *, {aggregation_of("name")} AS aggregation FROM catalog)
    SELECT dataset_id, name, aggregation, {format_of("name", "aggregation")} AS format, {capital(phrase_of("name"))} AS title,
    {phrase_of("name")} AS phrase, {flag_of("name")} AS flag_noun, {label_of("name", "aggregation")} AS measure_label,
    {entity_of("name")} AS entity_label FROM named""")
ORACLES["kpi_defs"] = over_catalog(f"""{_MEASURES}, {_FLAGS},
    ids AS (SELECT dataset_id, arg_min(name, position) AS name FROM catalog WHERE type = 'id' GROUP BY 1),
    named AS (SELECT *, {aggregation_of("name")} AS aggregation FROM measures WHERE rank <= 2)
    SELECT dataset_id, 0::INTEGER AS ord, 'entities' AS id, {entity_of("name")} AS label, name AS column, 'count_distinct' AS aggregation,
        'number' AS format, 1::DOUBLE AS scale FROM ids
    UNION ALL SELECT DISTINCT dataset_id, 0::INTEGER, 'rows', 'Rows', NULL, 'count', 'number', 1::DOUBLE FROM catalog WHERE dataset_id NOT IN (SELECT dataset_id FROM ids)
    UNION ALL SELECT dataset_id, rank::INTEGER, 'm:' || name, {label_of("name", "aggregation")}, name, aggregation, {format_of("name", "aggregation")}, 1::DOUBLE FROM named
    UNION ALL SELECT dataset_id, 3::INTEGER, 'rate:' || name, {flag_of("name")} || ' rate', name, 'avg', 'percent', 100::DOUBLE FROM flags WHERE rank = 1""")
ORACLES["bar_scores"] = over_catalog(f"{_SCORED} SELECT dataset_id, name, score FROM scored")
ORACLES["chartable_categories"] = over_catalog(f"{_SCORED}, {_CATEGORIES} SELECT dataset_id, name, rank::INTEGER AS rank, score FROM categories")

_SPAN = "(epoch(hi) - epoch(lo))"
_DASHBOARD = f"""{_MEASURES}, {_FLAGS}, {_SCORED}, {_CATEGORIES},
    dates AS (SELECT dataset_id, name AS date, CASE WHEN grain = 'month' OR {_SPAN} > 120 * 86400 THEN 'month' WHEN {_SPAN} > 3 * 86400 THEN 'day' ELSE 'hour' END AS story
              FROM catalog WHERE type = 'datetime' QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY position) = 1),
    heads AS (SELECT d.dataset_id, m.name AS measure, f.name AS flag, dates.date, dates.story,
              CASE WHEN m.name IS NULL THEN 'count' ELSE {aggregation_of("m.name")} END AS agg
              FROM (SELECT DISTINCT dataset_id FROM catalog) d LEFT JOIN measures m ON m.dataset_id = d.dataset_id AND m.rank = 1
              LEFT JOIN flags f ON f.dataset_id = d.dataset_id AND f.rank = 1 LEFT JOIN dates ON dates.dataset_id = d.dataset_id),
    donuts AS (SELECT dataset_id, min(rank) AS donut FROM categories WHERE rank > 2 AND distinct_count BETWEEN 3 AND 6 GROUP BY 1),
    barred AS (SELECT c.dataset_id, c.name, row_number() OVER (PARTITION BY c.dataset_id ORDER BY score DESC, position) AS n
               FROM (SELECT c.*, o.donut, row_number() OVER (PARTITION BY c.dataset_id ORDER BY rank) AS place FROM categories c
                     LEFT JOIN donuts o ON o.dataset_id = c.dataset_id WHERE o.donut IS NULL OR c.rank <> o.donut) c
               WHERE place <= CASE WHEN donut IS NULL THEN 3 ELSE 2 END),
    listed AS (
      SELECT dataset_id, 0 AS o, 'line' AS chart_type, {label_of("measure", "agg")} || ' by ' || story AS title, date AS x, measure AS y, agg AS aggregation, story AS time_grain, NULL::INTEGER AS lim FROM heads WHERE date IS NOT NULL
      UNION ALL SELECT dataset_id, 1, 'area', 'Rows by ' || story, date, NULL, 'count', story, NULL FROM heads WHERE date IS NOT NULL AND agg = 'avg'
      UNION ALL SELECT dataset_id, 2, 'line', {flag_of("flag")} || ' by ' || story, date, flag, 'sum', story, NULL FROM heads WHERE date IS NOT NULL AND flag IS NOT NULL
      UNION ALL SELECT h.dataset_id, 10 + n, 'bar', {label_of("measure", "agg")} || ' by ' || {phrase_of("b.name")}, b.name, measure, agg, NULL, 8 FROM barred b JOIN heads h ON h.dataset_id = b.dataset_id
      UNION ALL SELECT h.dataset_id, 80, 'donut', CASE WHEN agg = 'sum' AND measure IS NOT NULL THEN 'Share of ' || {phrase_of("measure")} || ' by ' || {phrase_of("c.name")} ELSE 'Rows by ' || {phrase_of("c.name")} END,
        c.name, CASE WHEN agg = 'sum' THEN measure END, CASE WHEN agg = 'sum' AND measure IS NOT NULL THEN 'sum' ELSE 'count' END, NULL, 6
        FROM donuts d JOIN categories c ON c.dataset_id = d.dataset_id AND c.rank = d.donut JOIN heads h ON h.dataset_id = d.dataset_id
      UNION ALL SELECT dataset_id, 90, 'histogram', 'Distribution of ' || {phrase_of("measure")}, measure, NULL, 'count', NULL, NULL FROM heads WHERE measure IS NOT NULL),
    specs AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY o) - 1 AS position FROM listed QUALIFY position < 8)"""
_SPECS = """SELECT dataset_id, position::INTEGER AS position, chart_type, title, x, y, aggregation, NULL::VARCHAR AS split, time_grain, lim AS "limit" FROM specs"""
ORACLES["auto_dashboard"] = over_catalog(f"{_DASHBOARD} {_SPECS}")
ORACLES["cleaned_specs"] = ORACLES["auto_dashboard"]
ORACLES["rebuilt_dashboard"] = over_catalog(f"""{_DASHBOARD},
    both_kinds AS (SELECT dataset_id, 0 AS block, position, 'auto' AS kind, title FROM specs
        UNION ALL SELECT dataset_id, 1, position, 'custom', 'My ' || name FROM catalog WHERE type = 'categorical')
    SELECT dataset_id, (row_number() OVER (PARTITION BY dataset_id ORDER BY block, position) - 1)::INTEGER AS position, kind, title FROM both_kinds""")
ORACLES["validated_specs"] = over_catalog("""charts AS (SELECT unnest(['line', 'area', 'bar', 'donut', 'histogram', 'pie']) AS chart),
    s AS (SELECT dataset_id, name, type, position, chart, position % 2 = 0 AS titled, position = 1 AS odd_agg, position % 3 = 0 AS has_y,
          position % 4 AS m, chart <> 'pie' AS known FROM catalog CROSS JOIN charts),
    e AS (SELECT *, list_filter([
        CASE WHEN NOT titled THEN 'title=Give the chart a title.' END,
        CASE WHEN NOT known THEN 'chartType=Choose a chart type.' END,
        CASE WHEN known AND NOT CASE WHEN chart IN ('line', 'area') THEN type = 'datetime' WHEN chart = 'bar' THEN type IN ('categorical', 'boolean', 'text')
             WHEN chart = 'donut' THEN type IN ('categorical', 'boolean') ELSE type = 'numeric' END THEN 'x=This column can''t be used on this chart''s x axis.' END,
        CASE WHEN known AND odd_agg THEN 'aggregation=Choose how to summarize values.' END,
        CASE WHEN known AND NOT odd_agg AND chart <> 'histogram' AND NOT has_y THEN 'y=Choose a value column.'
             WHEN known AND NOT odd_agg AND chart <> 'histogram' AND type NOT IN ('numeric', 'boolean') THEN 'y=Only number columns can be summed or averaged.' END,
        CASE WHEN known AND m = 2 THEN 'split=Unknown column.' WHEN known AND m = 3 AND chart IN ('donut', 'histogram') THEN 'split=This chart type can''t be split into series.' END],
        lambda v: v IS NOT NULL) AS found FROM s)
    SELECT dataset_id, name AS x, chart AS chart_type, array_to_string(list_sort(found), ';') AS errors FROM e""")

# ---------- facts ----------

_MONTHLY = """series AS (SELECT date_trunc('month', o_orderdate) AS b, {v} AS value, count(*) AS rows FROM orders GROUP BY 1)"""
_AVG_SERIES = _MONTHLY.format(v=agg("avg", "o_totalprice"))
_CHANGES = """lagged AS (SELECT *, lag(value) OVER (ORDER BY b) AS previous, lag(value, 2) OVER (ORDER BY b) AS two FROM series),
    moved AS (SELECT *, (value - previous) / abs(nullif(previous, 0)) AS change, coalesce(abs(value - two) / abs(nullif(two, 0)) <= 0.1, false) AS reverts FROM lagged),
    graded AS (SELECT *, abs(change) * CASE WHEN reverts THEN 0.5 ELSE 1 END * CASE WHEN change < 0 THEN 1.25 ELSE 1 END AS score FROM moved WHERE change IS NOT NULL)"""
ORACLES["period_series"] = f"WITH {_AVG_SERIES} SELECT strftime(b, '%Y-%m-01') AS x, value, rows FROM series"
ORACLES["period_changes"] = f"""WITH {_AVG_SERIES}, {_CHANGES} SELECT strftime(b, '%Y-%m-01') AS x, value, previous, {r("change", 8)} AS change,
    reverts::INTEGER AS reverts, {r("score", 8)} AS score FROM graded"""
ORACLES["best_change"] = f"""WITH {_MONTHLY.format(v=agg("sum", "o_totalprice"))}, {_CHANGES},
    best AS (SELECT * FROM graded ORDER BY score DESC, b LIMIT 1)
    SELECT strftime(b, '%Y-%m-01') AS x, value, previous, {r("change", 8)} AS change FROM best WHERE abs(change) >= 0.05"""


def z_sql(kind: str) -> str:
    return f"""series AS (SELECT date_trunc('hour', ts) AS b, {agg(kind, "value")} AS value, count(*) AS rows FROM events GROUP BY 1),
    med AS (SELECT *, median(value) OVER () AS med FROM series), dev AS (SELECT *, median(abs(value - med)) OVER () AS mad FROM med),
    scored AS (SELECT *, CASE WHEN mad = 0 THEN (value - avg(value) OVER ()) / coalesce(nullif(stddev_pop(value) OVER (), 0), 1)
        ELSE (value - med) / (1.4826 * mad) END AS z FROM dev)"""


ORACLES["robust_z"] = f"""WITH {z_sql("sum")} SELECT strftime(b, '%Y-%m-%dT%H:00') AS x, value, {r("z", 6)} AS z FROM scored"""
ORACLES["anomaly_points"] = f"""WITH {z_sql("avg")},
    strong AS (SELECT *, date_trunc('day', b) AS chart FROM (SELECT *, median(rows) OVER () * 0.8 AS least_rows FROM scored) WHERE abs(z) >= 1.5 AND rows >= least_rows),
    single AS (SELECT * FROM strong QUALIFY row_number() OVER (PARTITION BY chart ORDER BY abs(z) DESC, b) = 1)
    SELECT (row_number() OVER (ORDER BY abs(z) DESC, b))::INTEGER AS place, strftime(b, '%Y-%m-%dT%H:00') AS at, strftime(chart, '%Y-%m-%d') AS chart_x,
    value, {r("z", 1)} AS z FROM single QUALIFY place <= 3"""


def driver_sql(kind: str, sign: int) -> str:
    total = agg("sum", "o_totalprice") if kind != "count" else agg("count")
    value = agg(kind, "o_totalprice") if kind != "count" else agg("count")
    sides = " UNION ALL ".join(
        f"""SELECT '{c}' AS category, {i} AS cr, {c} AS key, side, {total} AS t, {value} AS v, min(o_orderkey) AS f FROM m GROUP BY 3, 4"""
        for i, c in enumerate(("o_orderpriority", "o_orderstatus"))
    )
    return f"""(WITH m AS (SELECT *, CASE WHEN date_trunc('month', o_orderdate) = DATE '1998-02-01' THEN 'now' ELSE 'before' END AS side FROM orders
        WHERE date_trunc('month', o_orderdate) IN (DATE '1998-01-01', DATE '1998-02-01')),
    whole AS (SELECT (SELECT {total} FROM m WHERE side = 'now') - (SELECT {total} FROM m WHERE side = 'before') AS delta),
    s AS ({sides}),
    j AS (SELECT coalesce(a.category, b.category) AS category, coalesce(a.cr, b.cr) AS cr, coalesce(a.key, b.key) AS key, coalesce(a.t, 0) AS nt,
          coalesce(a.v, 0) AS nv, coalesce(b.t, 0) AS bt, coalesce(b.v, 0) AS bv, CASE WHEN a.key IS NULL THEN 1 ELSE 0 END AS late, coalesce(a.f, b.f) AS f
          FROM (SELECT * FROM s WHERE side = 'now') a FULL JOIN (SELECT * FROM s WHERE side = 'before') b ON a.category = b.category AND a.key = b.key),
    g AS (SELECT *, (nt - bt) / delta AS share, (nv - bv) / abs(bv) AS change FROM j, whole WHERE delta <> 0 AND bv <> 0)
    SELECT '{kind}' AS aggregation, {sign}::INTEGER AS sign, category, key, {r("share", 6)} AS share, {r("change", 6)} AS change FROM g
    WHERE sign(change) = {sign} AND share >= 0.3 ORDER BY g.share DESC, cr, late, f, key LIMIT 1)"""


ORACLES["drivers"] = " UNION ALL ".join(f"SELECT * FROM {driver_sql(k, s)}" for s in (1, -1) for k in ("sum", "avg", "count"))
ORACLES["composition"] = f"""SELECT key, {r(f"t / (SELECT {agg('sum', 'l_quantity')} FROM lineitem) * 100", 1)} AS share FROM (
    SELECT l_returnflag AS key, sum(l_quantity) AS t, min(l_orderkey) AS f FROM lineitem GROUP BY 1) ORDER BY t DESC, f, key LIMIT 1"""

# ---------- text ----------

# What a sentence may say in digits without citing a fact.
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_ALLOWED = ("\\{\\{\\w+\\}\\}", f"\\b{_MONTH}\\s+\\d{{4}}\\b", f"\\b{_MONTH}\\s+\\d{{1,2}}(?:,\\s*\\d{{4}})?\\b",
            "\\b\\d{4}-\\d{2}-\\d{2}\\b", "\\b\\d{1,2}:\\d{2}\\b", "\\b(?:19|20)\\d{2}\\b")


def stripped_of(text: str) -> str:
    for p in _ALLOWED:
        text = f"regexp_replace({text}, '{p}', ' ', 'g')"
    return text


_NUMBERS = f"""list_transform(regexp_extract_all({stripped_of("text")}, '[-+−]?\\$?\\d[\\d,.]*\\s?%?'), lambda n: trim(n, ' ' || chr(10) || chr(13) || chr(9)))"""
_CITED = "list_transform(list_filter(regexp_extract_all(text, '\\{\\{(\\w+)\\}\\}', 1), lambda v: NOT list_contains(known, v)), lambda v: '{{' || v || '}}')"
ORACLES["ungrounded_numbers"] = f"""SELECT doc_id, len(o)::INTEGER AS n, array_to_string(o, '|') AS offenders FROM (
    SELECT doc_id, list_concat({_CITED}, {_NUMBERS}) AS o FROM (SELECT doc_id, text, []::VARCHAR[] AS known FROM documents))"""
ORACLES["grounded_sentences"] = f"""SELECT doc_id, place::INTEGER AS place, text AS sentence FROM (
    SELECT d.doc_id, d.place, d.text, coalesce(l.known, []::VARCHAR[]) AS known
    FROM (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS place, unnest(parts) AS text FROM (
        SELECT doc_id, string_split(text || '. In ' || lang || ' on Sep 18, 2025 at 14:00 it rose {{{{f1}}}}, see '
            || CASE WHEN n_chars % 3 = 0 THEN n_chars || '%' ELSE '{{{{f0}}}}' END, '. ') AS parts FROM documents)) d
    LEFT JOIN (SELECT doc_id, list('f' || quality) || list('f' || toxic) AS known FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)
    WHERE len({_CITED}) + len({_NUMBERS}) = 0"""

# ---------- events ----------

ORACLES["latest_job_state"] = """SELECT conv_id AS job_id, turn AS seq, stage, (stage IN ('ready', 'failed'))::INTEGER AS done FROM (
    SELECT *, CASE WHEN role = 'assistant' THEN 'ready' ELSE role END AS stage FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)"""
ORACLES["monotonic_events"] = """WITH l AS (SELECT *, floor(value * 10)::BIGINT AS seq FROM events),
    w AS (SELECT *, max(seq) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM l),
    f AS (SELECT *, sum(CASE WHEN value > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
          FROM w WHERE p IS NULL OR seq > p)
    SELECT user_id, event_id, seq FROM f WHERE coalesce(ended, 0) = 0"""
ORACLES["stage_durations"] = """WITH l AS (SELECT user_id AS job_id, CASE WHEN event_type = 'purchase' THEN 'done'
        ELSE event_type || '@' || (event_id % 3 * 50) END AS mark, ts FROM events),
    s AS (SELECT job_id, min(ts) AS started FROM l GROUP BY 1)
    SELECT l.job_id, mark, (epoch_us(min(ts)) - epoch_us(any_value(started))) / 1e6::DOUBLE AS seconds FROM l JOIN s ON s.job_id = l.job_id GROUP BY 1, 2"""
ORACLES["latency_percentiles"] = f"""SELECT {r("quantile_cont(value, 0.5)", 6)} AS p50, {r("quantile_cont(value, 0.95)", 6)} AS p95, max(value) AS max FROM events"""
ORACLES["purge"] = """SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (
    SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)"""
ORACLES["deleted_keys"] = """SELECT DISTINCT regexp_replace(md5(user_id::VARCHAR), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS key
    FROM events WHERE event_type = 'click' AND value < 100"""

# One step per event of a key: the accepted instants still young enough, then the verdict.
ORACLES["sliding_rate_limit"] = """WITH RECURSIVE
    o AS MATERIALIZED (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    walk AS (SELECT event_type, i, event_id, [t] AS held, 1 AS accepted, NULL::BIGINT AS retry_after FROM o WHERE i = 1
      UNION ALL SELECT o.event_type, o.i, o.event_id, CASE WHEN len(young) < 5 THEN list_append(young, o.t) ELSE young END,
        CASE WHEN len(young) < 5 THEN 1 ELSE 0 END, CASE WHEN len(young) >= 5 THEN greatest(1, ceil((young[1] + 3600000000 - o.t) / 1e6)::BIGINT) END
      FROM (SELECT w.event_type, w.i, list_filter(w.held, lambda e: n.t - e < 3600000000) AS young
            FROM walk w JOIN o n ON n.event_type = w.event_type AND n.i = w.i + 1) p
      JOIN o ON o.event_type = p.event_type AND o.i = p.i + 1)
    SELECT event_id, event_type, accepted::INTEGER AS accepted, retry_after FROM walk"""
