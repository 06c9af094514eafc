"""Small values: numbers in text, separated fields, tool arguments, coverage."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from stelae.functions.identity import SEPARATOR

_SIGNED, _UNSIGNED = r"^[+-]?[0-9]+\z", r"^\+?[0-9]+\z"


def parsed_time(text: Column) -> Column:
    """Signed 64-bit seconds; null where the text is anything else.  A cast alone
    would take surrounding blanks."""
    return F.when(text.rlike(_SIGNED), text.try_cast("long"))


def parsed_count(text: Column) -> Column:
    """An unsigned count; null where the text is anything else."""
    return F.when(text.rlike(_UNSIGNED), text.try_cast("decimal(20,0)"))


def optional_number(text: Column) -> Column:
    """A count, absent as ``-``."""
    return F.when(text != "-", parsed_count(text))


def rendered_optional(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit("-"))


def joined(*fields: Column) -> Column:
    """Fields as one record."""
    return F.concat_ws(SEPARATOR, *fields)


def fields_of(record: Column) -> Column:
    """A record's fields, trailing empty ones included."""
    return F.split(record, SEPARATOR, -1)


def tool_argument(arguments: str) -> str:
    """The ``argument`` of a tool call: '' where missing or null.

    Raises ``ValueError`` for text that is no JSON object and for an argument
    that is no text.
    """
    try:
        value = json.loads(arguments) if arguments.strip() else {}
    except json.JSONDecodeError as error:
        raise ValueError(f"the arguments are not JSON: {error}") from error
    if not isinstance(value, dict):
        raise ValueError("the arguments are not an object")
    argument = value.get("argument")
    if argument is None:
        return ""
    if not isinstance(argument, str):
        raise ValueError("the argument is not text")
    return argument


# Coverage of a run: did it look, and what did it find.
YIELDED, BARREN, SKIPPED, UNMET = "yielded", "barren", "skipped", "unmet"


def coverage_of_run(findings: Column) -> Column:
    """Name of the coverage of a run that happened."""
    return F.when(findings > 0, F.lit(YIELDED)).otherwise(F.lit(BARREN))


def has_run(name: Column) -> Column:
    return name.isin(YIELDED, BARREN)


def is_evidence_of_absence(name: Column) -> Column:
    """Only a run that looked and found nothing is."""
    return name == BARREN


def findings_of(name: Column, findings: Column) -> Column:
    return F.when(name == YIELDED, findings).otherwise(F.lit(0).cast("long"))
