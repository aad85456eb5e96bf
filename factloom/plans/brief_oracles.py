"""The SQL twins of the facts, anomalies and briefs (F7-F10, D5): counted anew from the rows, told by the same rules."""

from __future__ import annotations

from dataclasses import dataclass

from factloom.plans.oracles import _CHANGES, _CITED, _DASHBOARD, _LABELS, _NUMBERS, _WORDS, ORACLES, agg, format_of, over_catalog, phrase_of, r


@dataclass(frozen=True)
class Told:
    """What the catalog says of a dataset: the names its story is told with."""

    dataset: str
    date: str
    measure: str
    kind: str
    label: str
    order: str
    story: str
    fine: str
    categories: tuple[str, ...]
    flag: str | None = None
    flag_sql: str = "NULL"
    flag_label: str | None = None


EVENTS = Told("events", "ts", "value", "sum", "Total value", "event_id", "day", "hour", ("event_type", "props"), "is_error", "(event_type = 'error')", "Error events")
ORDERS = Told("orders", "o_orderdate", "o_totalprice", "avg", "Average o totalprice", "o_orderkey", "month", "month", ("o_orderstatus", "o_orderpriority"))

# How a bucket is written where charts refer to it.
_TEXTS = {"hour": "%Y-%m-%dT%H:00", "day": "%Y-%m-%d", "month": "%Y-%m-01"}


def _when(bucket: str, grain: str) -> str:
    return f"('{_WORDS[grain]}' || strftime({bucket}, '{_LABELS[grain]}'))"


def _lowered(label: str | None) -> str:
    return (label or "")[:1].lower() + (label or "")[1:]


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else f"'{text}'"


def _stories(t: Told) -> str:
    """CTEs up to ``stories (ord, slot, slot_ord, facts, parts, questions, anomaly)``, numbered as ``numbered`` with ``start``."""
    wide = ", ".join(f"{c}::VARCHAR AS c{i}" for i, c in enumerate(t.categories))
    total = agg("count") if t.kind == "count" else agg("sum")
    value = agg(t.kind)
    cells = " UNION ALL ".join(
        f"""SELECT story, sign, flag, '{c}' AS category, {i} AS place, c{i} AS key, side,
            CASE WHEN flag THEN {agg("sum", "fl")} ELSE {total} END AS t, CASE WHEN flag THEN {agg("sum", "fl")} ELSE {value} END AS v, min(o) AS f
            FROM compared WHERE c{i} IS NOT NULL GROUP BY story, sign, flag, c{i}, side"""
        for i, c in enumerate(t.categories)
    )
    fact = "struct_pack(kind := {}, label := {}, value := ({})::DOUBLE, format := {}, ref_widget := {}, ref_x := CASE WHEN {} IS NOT NULL THEN {} END)"
    f = lambda kind, label, value, form, widget="NULL::VARCHAR", x="NULL::VARCHAR": fact.format(f"'{kind}'", label, value, form, widget, widget, x)
    form, lower = format_of(f"'{t.measure}'", f"'{t.kind}'"), _lowered(t.label)
    when = _when("b", t.story)
    share = r("least(share, 1.0) * 100", 1)
    about = f"(key || ' (' || {phrase_of('category')} || ')')"
    averaged = t.kind == "avg"
    change_facts = f"""list_filter([{f("change", f"'{t.label} change ' || {when}", r("change", 4), "'change'", "line", f"strftime(b, '{_TEXTS[t.story]}')")},
        CASE WHEN key IS NOT NULL THEN {f("contributor", f"key || ' {lower} change ' || {when}", r("moved", 4), "'change'", "bar", "key")} END
        {"" if averaged else ", CASE WHEN key IS NOT NULL THEN " + f("contributor", "key || ' share of the ' || CASE WHEN change < 0 THEN 'drop' ELSE 'increase' END", share, "'percent'") + " END"}],
        lambda v: v IS NOT NULL)"""
    opening = f"'{t.label}' || CASE WHEN change < 0 THEN ' fell ' ELSE ' rose ' END"
    if averaged:
        change_parts = f"""CASE WHEN key IS NULL THEN [{opening}, ' ' || {when} || '.'] ELSE [{opening}, ' ' || {when} || ', led by ' || {about} || ', where it moved ', '.'] END"""
    else:
        change_parts = f"""CASE WHEN key IS NULL THEN [{opening}, ' ' || {when} || '.']
            ELSE [{opening}, ' ' || {when} || ', driven mostly by ' || {about} || ', which moved ', ' and accounts for ', ' of the change.'] END"""
    flagged = f"""UNION ALL SELECT 1 AS target, date_trunc('{t.fine}', d) AS b, {agg("sum", "fl")} AS value, count(*) AS rows FROM base WHERE d IS NOT NULL GROUP BY 2""" if t.flag else ""
    name = f"CASE WHEN target = 1 THEN {_quoted(t.flag_label)} ELSE '{t.label}' END"
    at = _when("b", t.fine)
    far = f"' ' || {at} || ', far ' || CASE WHEN z > 0 THEN 'above' ELSE 'below' END || ' the usual level'"
    empty = "NULL::STRUCT(\"column\" VARCHAR, moment VARCHAR, z DOUBLE, direction VARCHAR, description VARCHAR)"
    x = "(SELECT x FROM specs WHERE dataset_id = '{}' AND chart_type = 'bar' ORDER BY position LIMIT 1)".format(t.dataset)
    mixed = "" if t.kind != "sum" else f"""UNION ALL
      SELECT 9, 'findings', 0, [{f("total", f"key || ' share of ' || {phrase_of(_quoted(t.measure))}", "share", "'percent'", "bar", "key")}],
        [key || ' is the largest ' || {phrase_of("category")} || ', with ', ' of ' || {phrase_of(_quoted(t.measure))} || '.'],
        ['How has the ' || {phrase_of("category")} || ' mix shifted over time?'], {empty}
      FROM (SELECT category, key, {r("s / nullif((SELECT v FROM whole), 0) * 100", 1)} AS share, (SELECT id FROM bars WHERE x = category) AS bar
            FROM ({" UNION ALL ".join(f"SELECT '{c}' AS category, c{i} AS key, sum(y) AS s, count(y) AS n, min(o) AS f FROM base WHERE c{i} IS NOT NULL GROUP BY 2" for i, c in enumerate(t.categories))})
            WHERE category = {x} AND n > 0 ORDER BY s DESC, f, key LIMIT 1) WHERE share IS NOT NULL"""
    return over_catalog(f"""{_DASHBOARD},
    base AS (SELECT {t.date} AS d, {t.measure} AS y, {t.flag_sql}::INTEGER AS fl, {t.order} AS o, {wide} FROM {t.dataset}),
    bars AS (SELECT x, 'auto:' || min(position) AS id FROM specs WHERE dataset_id = '{t.dataset}' AND chart_type = 'bar' GROUP BY x),
    refs AS (SELECT 'auto:' || min(position) FILTER (x = '{t.date}' AND y = '{t.measure}' AND time_grain = '{t.story}') AS line,
                    'auto:' || min(position) FILTER (y = {_quoted(t.flag)}) AS flagged FROM specs WHERE dataset_id = '{t.dataset}'),
    whole AS (SELECT {value} AS v FROM base),
    series AS (SELECT date_trunc('{t.story}', d) AS b, {value} AS value, count(*) AS rows FROM base WHERE d IS NOT NULL GROUP BY 1), {_CHANGES},
    best AS (SELECT * FROM (SELECT *, lag(b) OVER (ORDER BY b) AS before FROM moved) JOIN (SELECT b, score FROM graded ORDER BY score DESC, b LIMIT 1) USING (b) WHERE abs(change) >= 0.05),
    points AS (SELECT 0 AS target, date_trunc('{t.fine}', d) AS b, {value} AS value, count(*) AS rows FROM base WHERE d IS NOT NULL GROUP BY 2 {flagged}),
    medians AS (SELECT *, median(value) OVER w AS med, count(*) OVER w AS n, CASE WHEN target = 0 AND {averaged} THEN median(rows) OVER w * 0.8 ELSE 0 END AS least_rows,
                lag(b) OVER (PARTITION BY target ORDER BY b) AS before FROM points WINDOW w AS (PARTITION BY target)),
    spread AS (SELECT *, median(abs(value - med)) OVER (PARTITION BY target) AS mad FROM medians WHERE n >= 8),
    scored_points AS (SELECT *, CASE WHEN mad = 0 THEN (value - avg(value) OVER w) / coalesce(nullif(stddev_pop(value) OVER w, 0), 1) ELSE (value - med) / (1.4826 * mad) END AS z
                      FROM spread WINDOW w AS (PARTITION BY target)),
    strong AS (SELECT *, date_trunc('{t.story}', b) AS chart FROM scored_points WHERE abs(z) >= 3.5 AND rows >= least_rows),
    single AS (SELECT * FROM strong QUALIFY row_number() OVER (PARTITION BY target, chart ORDER BY abs(z) DESC, b) = 1),
    found AS (SELECT *, row_number() OVER (ORDER BY abs(z) DESC, target, b) AS nth FROM single QUALIFY nth <= 3),
    sides AS (SELECT 0 AS story, sign(change) AS sign, false AS flag, '{t.story}' AS grain, unnest([struct_pack(side := 'now', b := b), struct_pack(side := 'before', b := before)]) AS s FROM best
              UNION ALL SELECT nth, sign(z), target = 1, '{t.fine}', unnest([struct_pack(side := 'now', b := b), struct_pack(side := 'before', b := before)]) FROM found
              WHERE abs(z) >= 6 AND before IS NOT NULL),
    compared AS (SELECT story, sign, flag, s.side AS side, base.* FROM sides JOIN base ON date_trunc(grain, d) = s.b),
    totals AS (SELECT story, side, CASE WHEN flag THEN {agg("sum", "fl")} ELSE {total} END AS t FROM compared GROUP BY story, side, flag),
    deltas AS (SELECT story, coalesce(max(t) FILTER (side = 'now'), 0) - coalesce(max(t) FILTER (side = 'before'), 0) AS delta FROM totals GROUP BY story),
    cells AS ({cells}),
    beside AS (SELECT story, sign, category, place, key, coalesce(max(t) FILTER (side = 'now'), 0) AS nt, coalesce(max(v) FILTER (side = 'now'), 0) AS nv,
               coalesce(max(t) FILTER (side = 'before'), 0) AS bt, coalesce(max(v) FILTER (side = 'before'), 0) AS bv,
               min(CASE side WHEN 'now' THEN 0 ELSE 1 END) AS seen, arg_min(f, CASE side WHEN 'now' THEN 0 ELSE 1 END) AS f FROM cells GROUP BY ALL),
    led AS (SELECT story, category, key, (nt - bt) / delta AS share, (nv - bv) / abs(bv) AS moved FROM beside JOIN deltas USING (story)
            WHERE delta <> 0 AND bv <> 0 AND sign(nv - bv) = sign AND (nt - bt) / delta >= 0.3
            QUALIFY row_number() OVER (PARTITION BY story ORDER BY (nt - bt) / delta DESC, place, seen, f, key) = 1),
    stories AS (
      SELECT 0 AS ord, 'summary' AS slot, 9 AS slot_ord, [{f("total", f"'{t.label}'", "v", form)}] AS facts, ['Across the whole dataset, {lower} is ', '.'] AS parts,
        []::VARCHAR[] AS questions, {empty} AS anomaly FROM whole
      UNION ALL
      SELECT 1, 'summary', 1, {change_facts}, {change_parts},
        list_filter([CASE WHEN key IS NOT NULL THEN 'What changed for ' || key || ' ' || {when} || '?' END,
          'Is the ' || CASE WHEN change < 0 THEN 'drop' ELSE 'rise' END || ' ' || {when} || ' a one-off or the start of a trend?'], lambda v: v IS NOT NULL), {empty}
      FROM (SELECT best.*, led.category, key, share, moved, line, (SELECT id FROM bars WHERE x = led.category) AS bar FROM best CROSS JOIN refs LEFT JOIN led ON led.story = 0)
      UNION ALL
      SELECT nth + 1, CASE WHEN leads THEN 'lead' ELSE 'findings' END, 0,
        list_filter([{f("anomaly", f"{name} || ' ' || {at}", r("value", 2), f"CASE WHEN target = 1 THEN 'number' ELSE {form} END", "widget", f"strftime(chart, '{_TEXTS[t.story]}')")},
          CASE WHEN leads AND key IS NOT NULL THEN {f("contributor", f"key || ' share of the ' || CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END || ' ' || {at}", share, "'percent'", "bar", "key")} END], lambda v: v IS NOT NULL),
        CASE WHEN leads AND key IS NOT NULL THEN [{name} || CASE WHEN z > 0 THEN ' spiked to ' ELSE ' dropped to ' END, {far} || ', with ' || {about} || ' accounting for ', ' of the jump.']
          ELSE [{name} || CASE WHEN z > 0 THEN ' spiked to ' ELSE ' dropped to ' END, {far} || '.'] END,
        CASE WHEN leads AND key IS NOT NULL THEN ['What happened to ' || key || ' ' || {at} || '?'] ELSE []::VARCHAR[] END,
        struct_pack("column" := CASE WHEN target = 1 THEN {_quoted(t.flag)} ELSE '{t.measure}' END, moment := strftime(b, '{_TEXTS[t.fine]}'), z := {r("z", 1)},
          direction := CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END,
          description := 'Unusually ' || CASE WHEN z > 0 THEN 'high ' ELSE 'low ' END || CASE WHEN target = 1 THEN '{_lowered(t.flag_label)}' ELSE '{lower}' END || ' ' || {at} || '.')
      FROM (SELECT found.*, abs(z) >= 6 AND before IS NOT NULL AS leads, led.category, key, share, CASE WHEN target = 1 THEN flagged ELSE line END AS widget,
                   (SELECT id FROM bars WHERE x = led.category) AS bar FROM found CROSS JOIN refs LEFT JOIN led ON led.story = nth)
      {mixed}),
    numbered AS (SELECT *, coalesce(sum(len(facts)) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM stories)""")


def facts_sql(t: Told) -> str:
    return f"""{_stories(t)} SELECT (start + i)::INTEGER AS ord, 'f' || (start + i) AS id, kind, label, value, format, ref_widget, ref_x
        FROM (SELECT start, generate_subscripts(facts, 1) AS i, unnest(facts, recursive := true) FROM numbered)"""


def anomalies_sql(t: Told) -> str:
    return f"""{_stories(t)} SELECT 'a' || row_number() OVER (ORDER BY ord) AS id, 'f' || (start + 1) AS fact_id, anomaly."column" AS "column",
        anomaly.moment AS "at", anomaly.z AS z, anomaly.direction AS direction, anomaly.description AS description FROM numbered WHERE anomaly IS NOT NULL"""


def brief_sql(t: Told) -> str:
    cited = "array_to_string([p || CASE WHEN i < len(parts) THEN '{{f' || (start + i) || '}}' ELSE '' END for p, i in parts], '')"
    return f"""{_stories(t)},
    ids AS (SELECT list('f' || (start + i)) AS known FROM (SELECT start, generate_subscripts(facts, 1) AS i FROM numbered)),
    sentences AS (SELECT slot, slot_ord * 100 + ord AS ord, {cited} AS text FROM numbered
        UNION ALL SELECT 'questions', ord * 100 + i - 1, text FROM (SELECT ord, generate_subscripts(questions, 1) AS i, unnest(questions) AS text FROM numbered)),
    grounded AS (SELECT slot, ord, text FROM sentences, ids WHERE len({_CITED}) + len({_NUMBERS}) = 0),
    asked AS (SELECT text, min(ord) AS ord FROM grounded WHERE slot = 'questions' GROUP BY text ORDER BY ord LIMIT 3),
    telling AS (SELECT text, ord FROM grounded WHERE slot = 'findings' ORDER BY ord LIMIT 5)
    SELECT (SELECT coalesce(string_agg(text, ' ' ORDER BY slot <> 'lead', ord), '') FROM grounded WHERE slot IN ('lead', 'summary')) AS summary,
        (SELECT coalesce(string_agg(text, '|' ORDER BY ord), '') FROM telling) AS findings, (SELECT coalesce(string_agg(text, '|' ORDER BY ord), '') FROM asked) AS questions"""


ORACLES["event_facts"] = facts_sql(EVENTS)
ORACLES["event_anomalies"] = anomalies_sql(EVENTS)
ORACLES["event_brief"] = brief_sql(EVENTS)
ORACLES["order_facts"] = facts_sql(ORDERS)
