"""Replies parsed into typed fields, and a reject table that says why a reply was not.

A reply's JSON is parsed once into a VARIANT; fields are taken from it by path and type. What is not JSON, lacks a field
or holds something else in it is told apart from a reply that is simply absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rubrica.functions import scoring as S
from rubrica.functions import text as X

EMPTY, NO_OBJECT, MALFORMED = "empty", "no object", "malformed"
MISSING, WRONG_TYPE = "missing ", "wrong type "


def parse_replies(replies: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """``replies`` with one column per field and ``reason``, NULL where all fields were found.

    ``fields`` maps a name, which is also the key in the reply's outermost object, to its type. The first
    reason that applies counts: empty, no object, malformed, missing <field>, wrong type <field>. A JSON null is a missing
    field. A row with a reason has no fields.
    """
    clash = set(fields) & set(replies.columns) | {"reason"} & set(replies.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    # The parser stops after a first value: inside brackets whatever follows the object is an error or one more entry.
    framed = F.try_parse_json(F.concat(F.lit('{"r": ['), X.json_object(F.col(text)), F.lit("]}")))
    frame = F.try_variant_get(framed, "$", "map<string, array<variant>>")
    parsed = F.when((F.size(frame) == 1) & (F.size(frame["r"]) == 1), frame["r"][0])
    reason = (
        F.when(S.strip(F.coalesce(F.col(text), F.lit(""))) == "", EMPTY)
        .when(X.json_object(F.col(text)).isNull(), NO_OBJECT)
        .when(F.col("_reply").isNull(), MALFORMED)
    )
    for name, kind in fields.items():
        path = f"$['{name}']"
        whole = F.try_variant_get("_reply", path, "variant")
        reason = reason.when(whole.isNull() | F.is_variant_null(whole), MISSING + name)
        reason = reason.when(F.try_variant_get("_reply", path, kind).isNull(), WRONG_TYPE + name)
    rows = replies.withColumn("_reply", parsed).withColumn("reason", reason)
    found = [
        F.when(F.col("reason").isNull(), F.try_variant_get("_reply", f"$['{n}']", k)).alias(n) for n, k in fields.items()
    ]
    return rows.select(*replies.columns, *found, "reason")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason IS NULL").drop("reason")


def rejected(parsed: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The reject table: the reply's own columns and the reason."""
    return parsed.filter("reason IS NOT NULL").drop(*fields)
