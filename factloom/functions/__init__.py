"""Column functions: no I/O, no actions, everything inside code generation."""

from factloom.functions.calendar import (
    anomaly_grain,
    bucket_key,
    bucket_start,
    bucket_text,
    day_index,
    epoch_seconds,
    in_period,
    infer_grain,
    period_label,
    story_grain,
)
from factloom.functions.naming import (
    default_aggregation,
    entity_label,
    flag_noun,
    humanize,
    measure_label,
    phrase,
    value_format,
)
from factloom.functions.rounding import finish, js_round
from factloom.functions.text import (
    category_key,
    display_string,
    is_day_only,
    iso_string,
    stripped,
    to_boolean,
    to_datetime,
    to_number,
    trimmed,
)

__all__ = [name for name in dir() if not name.startswith("_")]
