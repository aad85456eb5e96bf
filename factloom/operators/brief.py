"""Facts, anomalies and the written brief of one dataset.

A *story* is one row: the facts it adds, the sentence citing them and the
questions it raises. There are at most six (total, change, three anomalies,
composition), so numbering the facts and ordering the text happen on a handful of
rows after one scan of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from factloom.functions.calendar import anomaly_grain, bucket_text, in_period
from factloom.functions.naming import entity_label, flag_noun, phrase, uncapitalised, value_format
from factloom.functions.rounding import finish, js_round
from factloom.functions.text import display_string, is_number, is_temporal
from factloom.operators.aggregates import number_column
from factloom.operators.anomalies import MOST_ANOMALIES, anomalies
from factloom.operators.changes import best_change, compared_cells, period_changes, rank_drivers
from factloom.operators.cube import ALL, Subject, analysis_cube, cube_series, cube_value
from factloom.operators.dashboards import dataset_heads
from factloom.operators.grounding import offenders
from factloom.session import gathered, handful

Z_HEADLINE = 6
MOST_FINDINGS, MOST_QUESTIONS = 5, 3
FACT = "struct<kind:string,label:string,value:double,format:string,ref_widget:string,ref_x:string>"
ANOMALY = "struct<column:string,at:string,z:double,direction:string,description:string>"


@dataclass(frozen=True)
class Setting:
    """Names and labels the stories are told with: metadata only."""

    measure: str | None
    aggregation: str
    label: str
    format: str
    date: str | None
    grain: str | None
    fine: str | None
    flag: str | None
    flag_label: str | None
    categories: tuple[str, ...]
    bars: dict[str, str]
    line: tuple[str, str] | None
    flag_widget: tuple[str, str | None] | None


def _setting(df: DataFrame, profiles: DataFrame, widgets: DataFrame) -> Setting:
    """Reads the schema-sized profile and widget tables of the dataset."""
    profiles, widgets = profiles.coalesce(1), widgets.coalesce(1)
    first_id = F.min_by("name", "position")
    ids = profiles.filter("type = 'id'").groupBy("dataset_id").agg(first_id.alias("id_column"))
    spans = profiles.select("dataset_id", F.col("name").alias("date"), "datetime")
    noun = flag_noun(F.col("flag"))
    subject = F.when(noun == "Churn", F.lit("Churned")).otherwise(noun)
    head = (
        dataset_heads(profiles)
        .join(ids, "dataset_id", "left")
        .join(spans, ["dataset_id", "date"], "left")
        .select(
            "measure", "aggregation", "date", "flag", "grain",
            F.col("metric").alias("label"),
            value_format(F.col("measure"), F.col("aggregation")).alias("format"),
            anomaly_grain(F.col("grain"), F.col("datetime.min"), F.col("datetime.max")).alias("fine"),
            F.when(F.col("id_column").isNull(), noun)
            .otherwise(F.concat_ws(" ", subject, F.lower(entity_label(F.col("id_column")))))
            .alias("flag_label"),
            F.col("datetime").isNotNull().alias("spanned"),
        )
        .first()
    )
    named = widgets if "id" in widgets.columns else widgets.withColumn("id", F.concat(F.lit("auto:"), "position"))
    if "kind" in named.columns:
        named = named.filter("kind = 'auto'")
    auto = named.orderBy("position").collect()
    categorical = [r["name"] for r in profiles.filter("type = 'categorical'").orderBy("position").select("name").collect()]
    bars = {}
    for w in auto:
        if w["chart_type"] == "bar":
            bars.setdefault(w["x"], w["id"])
    dated = bool(head["spanned"]) and head["date"] in df.columns and is_temporal(df.schema[head["date"]].dataType)
    line = _pick(auto, x=head["date"], y=head["measure"], time_grain=head["grain"])
    flag_widget = _pick(auto, y=head["flag"]) if head["flag"] else None
    categories = [c for c in dict.fromkeys([*bars, *categorical]) if c in df.columns]
    return Setting(
        head["measure"], head["aggregation"], head["label"], head["format"],
        head["date"] if dated else None, head["grain"], head["fine"], head["flag"], head["flag_label"],
        tuple(categories), bars,
        (line["id"], line["time_grain"]) if line else None,
        (flag_widget["id"], flag_widget["time_grain"]) if flag_widget else None,
    )


def _pick(widgets: list[Row], **fields: str | None) -> Row | None:
    return next((w for w in widgets if all(w[k] == v for k, v in fields.items())), None)


# ---------- story rows ----------


def _fact(kind: str, label: Column, value: Column, fmt: Column | str,
          widget: Column | str | None = None, x: Column | None = None) -> Column:
    """A fact; the reference is dropped as a whole when there is no chart."""
    widget = widget if isinstance(widget, Column) else F.lit(widget).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        label.alias("label"),
        value.cast("double").alias("value"),
        (F.lit(fmt) if isinstance(fmt, str) else fmt).alias("format"),
        widget.alias("ref_widget"),
        F.when(widget.isNotNull(), F.lit(None) if x is None else x).cast("string").alias("ref_x"),
    ).cast(FACT)


def _story(ord_: Column, slot: Column | str, slot_ord: int, facts: list[Column], parts: list[Column | str],
           questions: list[Column], anomaly: Column | None = None) -> list[Column]:
    """``parts`` are the pieces of the sentence around its facts, in order; null pieces drop out."""
    pieces = F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return [
        ord_.cast("int").alias("ord"),
        (F.lit(slot) if isinstance(slot, str) else slot).alias("slot"),
        F.lit(slot_ord).alias("slot_ord"),
        F.array_compact(F.array(*facts)).alias("facts"),
        F.array_compact(pieces).alias("parts"),
        F.array_compact(F.array(*questions)).cast("array<string>").alias("questions"),
        (F.lit(None) if anomaly is None else anomaly).cast(ANOMALY).alias("anomaly"),
    ]


def _join(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("string")
    return F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))[key]


def _total_story(cube: DataFrame, s: Setting) -> DataFrame:
    """F8: the measure over the whole table."""
    lower = uncapitalised(F.lit(s.label))
    whole = cube.filter(F.col("category") == ALL).agg(cube_value(s.aggregation).alias("value"))
    return whole.select(
        *_story(F.lit(0), "summary", 9, [_fact("total", F.lit(s.label), F.col("value"), s.format)],
                [_join("Across the whole dataset, ", lower, " is "), "."], [])
    )


def _change_story(change: DataFrame, drivers: DataFrame, s: Setting) -> DataFrame:
    """The best period change with its driver."""
    told = change.withColumn("story", F.lit(0)).join(drivers.withColumnRenamed("change", "moved"), "story", "left")
    label, lower = F.lit(s.label), uncapitalised(F.lit(s.label))
    key = bucket_text(F.col("bucket"), s.grain)
    when = in_period(key, s.grain)
    fell = F.col("change") < 0
    driven = F.col("key").isNotNull()
    averaged = s.aggregation == "avg"
    share = js_round(F.least(F.col("share"), F.lit(1.0)) * 100, 1)
    about = _join(F.col("key"), " (", phrase(F.col("category")), ")")
    facts = [
        _fact("change", _join(label, " change ", when), js_round(F.col("change"), 4), "change",
              s.line[0] if s.line else None, key),
        F.when(driven, _fact("contributor", _join(F.col("key"), " ", lower, " change ", when),
                             js_round(F.col("moved"), 4), "change", _lookup(s.bars, F.col("category")), F.col("key"))),
    ]
    opening = _join(label, F.when(fell, " fell ").otherwise(" rose "))
    if averaged:
        parts = [
            opening,
            F.when(driven, _join(" ", when, ", led by ", about, ", where it moved ")).otherwise(_join(" ", when, ".")),
            F.when(driven, F.lit(".")),
        ]
    else:
        word = F.when(fell, "drop").otherwise("increase")
        facts.append(F.when(driven, _fact("contributor", _join(F.col("key"), " share of the ", word), share, "percent")))
        parts = [
            opening,
            F.when(driven, _join(" ", when, ", driven mostly by ", about, ", which moved ")).otherwise(_join(" ", when, ".")),
            F.when(driven, F.lit(" and accounts for ")),
            F.when(driven, F.lit(" of the change.")),
        ]
    questions = [
        F.when(driven, _join("What changed for ", F.col("key"), " ", when, "?")),
        _join("Is the ", F.when(fell, "drop").otherwise("rise"), " ", when, " a one-off or the start of a trend?"),
    ]
    return told.select(*_story(F.lit(1), "summary", 1, facts, parts, questions))


def _anomaly_stories(found: DataFrame, drivers: DataFrame, s: Setting) -> DataFrame:
    """Up to three outliers; the strong ones lead the summary with their driver."""
    told = found.join(drivers.drop("change").withColumnRenamed("story", "place"), "place", "left")
    flagged = F.col("target") == 1

    def by_target(measure: str | None, flag: str | None) -> Column:
        return F.when(flagged, F.lit(flag)).otherwise(F.lit(measure)).cast("string")

    label = by_target(s.label, s.flag_label)
    widget = by_target(s.line[0] if s.line else None, s.flag_widget[0] if s.flag_widget else None)
    chart_grain = by_target(_chart_grain(s.line, s.grain), _chart_grain(s.flag_widget, s.grain))
    at = bucket_text(F.col("bucket"), s.fine)
    chart_x = F.when(chart_grain == "hour", bucket_text(F.col("chart_bucket"), "hour")).otherwise(
        bucket_text(F.col("chart_bucket"), "day")
    )
    when = in_period(at, s.fine)
    high = F.col("z") > 0
    leads = F.col("previous_bucket").isNotNull() & (F.abs("z") >= Z_HEADLINE)
    driven = leads & F.col("key").isNotNull()
    share = js_round(F.least(F.col("share"), F.lit(1.0)) * 100, 1)
    about = _join(F.col("key"), " (", phrase(F.col("category")), ")")
    facts = [
        _fact("anomaly", _join(label, " ", when), js_round(F.col("value"), 2), by_target(s.format, "number"), widget, chart_x),
        F.when(driven, _fact("contributor",
                             _join(F.col("key"), " share of the ", F.when(high, "spike").otherwise("drop"), " ", when),
                             share, "percent", _lookup(s.bars, F.col("category")), F.col("key"))),
    ]
    far = _join(" ", when, ", far ", F.when(high, "above").otherwise("below"), " the usual level")
    parts = [
        _join(label, F.when(high, " spiked to ").otherwise(" dropped to ")),
        F.when(driven, _join(far, ", with ", about, " accounting for ")).otherwise(_join(far, ".")),
        F.when(driven, F.lit(" of the jump.")),
    ]
    anomaly = F.struct(
        by_target(s.measure or "rows", s.flag).alias("column"),
        at.alias("at"),
        js_round(F.col("z"), 1).alias("z"),
        F.when(high, "spike").otherwise("drop").alias("direction"),
        _join("Unusually ", F.when(high, "high").otherwise("low"), " ", uncapitalised(label), " ", when, ".").alias("description"),
    )
    questions = [F.when(driven, _join("What happened to ", F.col("key"), " ", when, "?"))]
    slot = F.when(leads, F.lit("lead")).otherwise(F.lit("findings"))
    return told.select(*_story(F.col("place") + 1, slot, 0, facts, parts, questions, anomaly))


def _chart_grain(widget: tuple[str, str | None] | None, grain: str | None) -> str | None:
    return (widget[1] if widget else None) or grain


def composition(df: DataFrame, x: str, measure: str, order_by: str | None = None) -> DataFrame:
    """the largest category's share of a summed measure: ``(key, share)`` or no row."""
    first = F.min(order_by) if order_by else F.max(F.lit(None).cast("int"))
    groups = df.groupBy(display_string(F.col(x), df.schema[x].dataType).alias("key")).agg(
        F.sum(number_column(df, measure)).alias("total"), F.count(measure).alias("filled"), first.alias("first")
    )
    # Rows without a category still count for the total.
    return composition_of(groups, groups.agg(finish(F.sum("total"), "sum")).scalar())


def composition_of(groups: DataFrame, whole: Column) -> DataFrame:
    """F7 from ``(key, total, filled, first)`` and the published total."""
    ranked = groups.filter(F.col("key").isNotNull() & (F.col("filled") > 0)).orderBy(
        F.desc("total"), F.asc_nulls_last("first"), F.asc("key")
    )
    share = js_round(F.col("total") / F.nullif(whole, F.lit(0.0)) * 100, 1)
    return ranked.limit(1).select("key", share.alias("share")).filter(F.col("share").isNotNull())


def _composition_story(cube: DataFrame, s: Setting) -> DataFrame | None:
    if not s.bars or s.aggregation != "sum" or not s.measure:
        return None
    x = next(iter(s.bars))
    if x not in s.categories:
        return None
    states = [F.sum("total").alias("total"), F.sum("filled").alias("filled"), F.min("first").alias("first")]
    groups = cube.filter(F.col("category") == x).groupBy("key").agg(*states)
    # Rows without this category still count for the total.
    whole = cube.filter(F.col("category") == ALL).agg(finish(F.sum("total"), "sum")).scalar()
    told = composition_of(groups, whole)
    of = phrase(F.lit(s.measure))
    kind = phrase(F.lit(x))
    return told.select(
        *_story(
            F.lit(9), "findings", 0,
            [_fact("total", _join(F.col("key"), " share of ", of), F.col("share"), "percent", s.bars[x], F.col("key"))],
            [_join(F.col("key"), " is the largest ", kind, ", with "), _join(" of ", of, ".")],
            [_join("How has the ", kind, " mix shifted over time?")],
        )
    )


def _stories(cube: DataFrame, s: Setting) -> DataFrame:
    stories = [_total_story(cube, s)]
    if s.date:
        change = handful(best_change(period_changes(cube_series(cube, s.grain, s.aggregation))), 1)
        targets = [cube_series(cube, s.fine, s.aggregation).select(
            F.lit(0).alias("target"), F.lit(s.aggregation == "avg").alias("averaged"), "bucket", "value", "rows")]
        if s.flag:
            targets.append(cube_series(cube, s.fine, "sum", flag=True).select(
                F.lit(1).alias("target"), F.lit(False).alias("averaged"), "bucket", "value", "rows"))
        points = targets[0] if len(targets) == 1 else targets[0].unionByName(targets[1])
        grains = F.when(F.col("target") == 1, F.lit(_chart_grain(s.flag_widget, s.grain))).otherwise(
            F.lit(_chart_grain(s.line, s.grain)))
        found = handful(anomalies(points, grains), MOST_ANOMALIES)
        sides = ["story", "bucket", "previous_bucket", "sign", "flag"]
        changed = change.select(F.lit(0).alias("story"), "bucket", "previous_bucket",
                                F.signum("change").cast("int").alias("sign"), F.lit(False).alias("flag")).select(*sides)
        strong = found.filter((F.abs("z") >= Z_HEADLINE) & F.col("previous_bucket").isNotNull()).select(
            F.col("place").alias("story"), "bucket", "previous_bucket",
            F.signum("z").cast("int").alias("sign"), (F.col("target") == 1).alias("flag")).select(*sides)
        cells = compared_cells(cube, changed, s.grain, list(s.categories)).unionByName(
            compared_cells(cube, strong, s.fine, list(s.categories)))
        kinds = F.when(F.col("flag"), F.lit("sum")).otherwise(F.lit(s.aggregation))
        drivers = handful(rank_drivers(cells, kinds), 1 + MOST_ANOMALIES)
        stories += [_change_story(change, drivers, s), _anomaly_stories(found, drivers, s)]
    mixed = _composition_story(cube, s)
    if mixed is not None:
        stories.append(mixed)
    told = stories[0]
    for story in stories[1:]:
        told = told.unionByName(story)
    sizes = F.sum(F.size("facts")).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return told.withColumn("start", F.coalesce(sizes, F.lit(0)).cast("int"))


class FactSet:
    """numbered facts, anomalies and sentences, read from the story rows."""

    def __init__(self, stories: DataFrame) -> None:
        self.stories = stories

    def facts(self) -> DataFrame:
        numbered = self.stories.select("start", F.posexplode("facts").alias("_i", "fact"))
        place = F.col("start") + F.col("_i") + 1
        return numbered.select(place.alias("ord"), F.concat(F.lit("f"), place).alias("id"), "fact.*")

    def anomalies(self) -> DataFrame:
        rows = self.stories.filter(F.col("anomaly").isNotNull())
        place = F.row_number().over(Window.orderBy("ord"))
        return rows.select(
            F.concat(F.lit("a"), place).alias("id"), F.concat(F.lit("f"), F.col("start") + 1).alias("fact_id"), "anomaly.*"
        )

    def sentences(self) -> DataFrame:
        """``(slot, ord, text)`` of the draft: lead, summary, findings and questions."""
        cited = F.transform(
            "parts",
            lambda p, i: F.when(
                i < F.size("parts") - 1, F.concat(p, F.lit("{{f"), (F.col("start") + i + 1).cast("string"), F.lit("}}"))
            ).otherwise(p),
        )
        written = self.stories.select(
            "slot", (F.col("slot_ord") * 100 + F.col("ord")).alias("ord"), F.array_join(cited, "").alias("text")
        )
        asked = self.stories.select("ord", F.posexplode("questions").alias("_i", "text")).select(
            F.lit("questions").alias("slot"), (F.col("ord") * 100 + F.col("_i")).alias("ord"), "text"
        )
        return written.unionByName(asked)

    def brief(self) -> DataFrame:
        return render_brief(self.sentences(), self.facts())


def build_facts(
    df: DataFrame, profiles: DataFrame, widgets: DataFrame, order_by: str | None = None
) -> FactSet:
    """one scan of ``df`` into the analysis cube, then a handful of story rows.

    ``profiles`` and ``widgets`` are the schema-sized tables of this dataset.
    """
    s = _setting(df, profiles, widgets)
    fine = s.fine if s.date else "month"
    subject = Subject(s.date, s.measure, s.aggregation, s.flag)
    measurable = not s.measure or is_number(df.schema[s.measure].dataType)
    subject = subject if measurable else Subject(s.date, None, "count", s.flag)
    cube = analysis_cube(df, subject, fine, list(s.categories), order_by).persist()
    try:
        return FactSet(handful(_stories(gathered(cube), s), 3 + MOST_ANOMALIES))
    finally:
        cube.unpersist()


def render_brief(sentences: DataFrame, facts: DataFrame) -> DataFrame:
    """``summary``, ``findings`` and ``questions`` of the grounded sentences."""
    # Schema-sized on both sides: a handful of sentences and the ids they may cite.
    known = sentences.withColumn("known", facts.agg(F.collect_set("id")).scalar())
    grounded = known.filter(F.size(offenders(F.col("text"), F.col("known"))) == 0)
    lead = F.when(F.col("slot") == "lead", 0).otherwise(1)

    def ordered(slots: list[str]) -> Column:
        entry = F.struct(lead.alias("lead"), F.col("ord"), F.col("text"))
        rows = F.array_sort(F.collect_list(F.when(F.col("slot").isin(slots), entry)))
        return F.transform(rows, lambda r: r["text"])

    return grounded.agg(
        F.array_join(ordered(["lead", "summary"]), " ").alias("summary"),
        F.slice(ordered(["findings"]), 1, MOST_FINDINGS).alias("findings"),
        F.slice(F.array_distinct(ordered(["questions"])), 1, MOST_QUESTIONS).alias("questions"),
    )
