"""Answers of a model held to a schema: parsed as variants, recovered from chatter, and cut to what is allowed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def recovered(raw: Column) -> Column:
    """The answer's object as a variant: the text's, or else the one that begins at its first brace; what follows an object doesn't count. Null if there is none."""
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    whole, inner = F.try_parse_json(raw), F.try_parse_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1))
    return F.when(is_object(whole), whole).when(is_object(inner), inner)


def _kind(answer: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(answer, f"$.{field}", "variant"))


def _text(answer: Column, field: str) -> Column:
    """The field as text, without white space around; null if it is missing, null, false, 0 or empty."""
    text = trimmed(F.try_variant_get(answer, f"$.{field}", "string"))
    return F.when(~text.isin("", "false", "0", "0.0", "[]", "{}"), text)


def word_of(answer: Column, field: str, allowed: Sequence[str], other: str) -> Column:
    """The field in lower case if it is one of ``allowed``, else ``other``."""
    word = F.lower(trimmed(F.try_variant_get(answer, f"$.{field}", "string")))
    return F.when(word.isin(*allowed), word).otherwise(other)


def text_of(answer: Column, field: str, most: int | None = None, other: str | None = None) -> Column:
    """The field's first ``most`` characters, ``other`` if there is none."""
    text = _text(answer, field)
    return F.coalesce(text if most is None else F.substring(text, 1, most), F.lit(other))


def words_of(answer: Column, field: str, allowed: Sequence[str] | None = None, most: int | None = None) -> Column:
    """The field's list as texts, blank ones and nulls left out: those of ``allowed`` in lower case, or any; the first ``most``. Not a list: none."""
    listed = F.transform(F.coalesce(F.try_variant_get(answer, f"$.{field}", "array<variant>"), F.array().cast("array<variant>")), lambda x: trimmed(F.try_variant_get(x, "$", "string")))
    kept = F.filter(listed, lambda x: x != "")
    if allowed is not None:
        kept = F.filter(F.transform(kept, F.lower), lambda x: x.isin(*allowed))
    return kept if most is None else F.slice(kept, 1, most)


def codes_of(answer: Column, field: str, most: int) -> Column:
    """Two or three letters each, in lower case, once."""
    codes = F.transform(words_of(answer, field), lambda x: F.substring(F.lower(x), 1, 3))
    return F.slice(F.array_distinct(F.filter(codes, lambda x: x.rlike(r"^\p{L}{2,3}$"))), 1, most)


def number_of(answer: Column, field: str, low: int, high: int) -> Column:
    """The whole part of a number within bounds; texts and booleans are no numbers."""
    value = F.try_variant_get(answer, f"$.{field}", "double")
    return F.when(_kind(answer, field).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & value.between(low, high), F.floor(value).cast("int"))


def flag_of(answer: Column, field: str) -> Column:
    """Whether the field is anything but missing, null, false, 0 or empty."""
    raw = F.try_variant_get(answer, f"$.{field}", "string")
    return F.coalesce(F.when(_kind(answer, field) == "STRING", raw != "").otherwise(~raw.isin("false", "0", "0.0", "[]", "{}")), F.lit(False))
