"""Key, list, number and JSON helpers as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display labels of algorithm keys (fixed values).
MODEL_LABELS = {
    "mlp": "MLP",
    "rf": "RF",
    "lightgbm": "LightGBM",
    "xgboost": "XGBoost",
    "catboost": "CatBoost",
}


def lookup(mapping: Mapping[str, str]) -> Column:
    if not mapping:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def algorithm_key(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    key = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(lookup(aliases or {}), key), key)


def algorithm_label(name: Column, labels: Mapping[str, str] = MODEL_LABELS) -> Column:
    key = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(lookup(labels), key), F.upper(key))


def int_list(text: Column) -> Column:
    """Sorted distinct integers of a comma list; a bad entry is an error."""
    return F.array_sort(F.array_distinct(F.transform(_items(text), lambda t: t.cast("int"))))


def string_list(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_items(text), lambda t: F.lower(t))))


def _items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda t: t != "")


def to_number(value: Column) -> Column:
    """Finite double or NULL."""
    v = F.trim(value.cast("string")).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def fixed(value: Column, digits: int = 4) -> Column:
    """Fixed digits, '-' when not a number."""
    number = to_number(value)
    return F.when(number.isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f", number))


def percent(value: Column, digits: int = 2) -> Column:
    number = to_number(value) * 100
    return F.when(number.isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f%%", number))


def json_field(document: Column, path: str, default: str | None = None) -> Column:
    found = F.get_json_object(document, path)
    return found if default is None else F.coalesce(found, F.lit(default))


def first_token(names: Column, tokens: Sequence[str]) -> Column:
    """First name of an array that contains a token, trying the tokens in order."""
    def holding(token: str) -> Column:
        return F.get(F.filter(names, lambda n: F.contains(F.lower(n), F.lit(token.lower()))), F.lit(0))

    return F.coalesce(*[holding(t) for t in tokens])


def logistic(score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-score))


def softmax(scores: Sequence[Column]) -> list[Column]:
    top = F.greatest(*scores)
    parts = [F.exp(s - top) for s in scores]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def utc_stamp() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
