"""Predicates on JSON metadata: only top-level values that are JSON strings match."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _path(key: str) -> str:
    return "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"


def string_value(metadata: Column, key: str) -> Column:
    """The value of a top-level key where it is a JSON string, else null; bad JSON is null."""
    document = F.try_parse_json(metadata)
    value = F.try_variant_get(document, _path(key), "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(document, _path(key), "string"))


def matches(metadata: Column, key: str, value: str) -> Column:
    return F.coalesce(string_value(metadata, key) == value, F.lit(False))


def usable(metadata_filters: dict | str | None) -> dict[str, str]:
    """The filters whose values are strings; others are ignored."""
    if isinstance(metadata_filters, str):
        metadata_filters = json.loads(metadata_filters) if metadata_filters else {}
    return {k: v for k, v in (metadata_filters or {}).items() if isinstance(v, str)}


def candidate(modality: Column, metadata: Column, modality_filter: str | None = None, metadata_filters: dict | str | None = None) -> Column | None:
    """The conjunction of all usable filters, None if there are none. Filter values that are no strings are ignored."""
    parts = [modality == modality_filter] if modality_filter else []
    parts += [matches(metadata, k, v) for k, v in usable(metadata_filters).items()]
    return reduce(lambda a, b: a & b, parts) if parts else None


def string_fields(metadata: DataFrame) -> DataFrame:
    """(key, value, id, born) of the top-level string values in (id, metadata, born); bad JSON and other values have none."""
    parsed = metadata.select("id", "born", F.try_parse_json("metadata").alias("__doc"))
    fields = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("__doc").outer()))
    return fields.where(F.schema_of_variant("value") == "STRING").select("key", F.try_variant_get("value", "$", "string").alias("value"), "id", "born")
