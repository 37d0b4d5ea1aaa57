"""Judges' replies: reading them, and what they decide. Null means no opinion, and stays null through every combination."""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship_package
from .text import strip_thinking

#: The fields of each axis in the order of the contract; boolean ones are mandatory.
TEXT_FIELDS = {"refused": ("evidence",), "fabricated": ("unsupported_claim",), "misdirected": ("asked_about", "answer_is_about")}
BOOLEAN_FIELDS = {"refused": ("answered_anyway", "refused"), "fabricated": ("fabricated",), "misdirected": ("mismatch_named", "misdirected")}
AXES, EXTRA_AXES = ("refused", "fabricated"), ("misdirected",)
PROMPT_VERSION, AXIS_PROMPT_VERSION = "3", {"misdirected": "m2"}
#: Fixed value: what is quoted for the positive case.
QUOTE_FIELD = {"refused": "evidence", "fabricated": "unsupported_claim", "misdirected": "answer_is_about"}
WORDS = {"true": True, "yes": True, "false": False, "no": False}

VERDICT = "struct<ok:boolean,error:string,flags:map<string,boolean>,texts:map<string,string>>"


def schema(axis: str) -> dict:
    """The JSON schema of an axis's reply."""
    kinds = {**dict.fromkeys(TEXT_FIELDS[axis], "string"), **dict.fromkeys(BOOLEAN_FIELDS[axis], "boolean")}
    return {"type": "object", "properties": {k: {"type": v} for k, v in kinds.items()}, "required": list(kinds)}


#: A string, closed or not, or a brace.
_PIECE = re.compile(r'"(?:[^"\\]|\\.?)*"?|[{}]', re.S)


def first_object(text: str) -> str | None:
    """The first stretch that opens with a brace and closes it, braces in strings aside; null if no brace is ever closed.

    From each opening brace on, the pieces count +1, -1 or 0; the object ends with the
    first piece at which the running sum is 0.
    """
    worth = {"{": 1, "}": -1}
    for start in re.finditer("{", text):
        pieces, closing = _PIECE.finditer(text, start.start()), _PIECE.finditer(text, start.start())
        levels = accumulate(worth.get(p[0], 0) for p in pieces)
        end = next((p.end() for level, p in zip(levels, closing, strict=True) if level == 0), None)
        if end is not None:
            return text[start.start() : end]
    return None


def truth(value) -> bool | None:
    """Booleans, and the words for them in any case; numbers are no answer."""
    return value if isinstance(value, bool) else WORDS.get(value.strip().lower()) if isinstance(value, str) else None


def _object(reply: str | None) -> tuple[dict, str | None]:
    """(what the reply's object holds, why it can't be used)."""
    blob = first_object(reply or "")
    try:
        return (json.loads(blob), None) if blob else ({}, "the reply holds no object")
    except json.JSONDecodeError as e:
        return {}, f"the object is not JSON ({e.msg})"


def read_reply(axis: str, reply: str | None) -> dict:
    """The verdict in a reply whose thinking blocks are gone: every field of the axis is read by its kind; boolean ones must be there."""
    held, why = _object(reply)
    texts = {k: v.strip() if isinstance(v := held.get(k), str) else "" for k in TEXT_FIELDS[axis]}
    flags = {k: truth(held.get(k)) for k in BOOLEAN_FIELDS[axis]}
    silent = ", ".join(k for k in flags if flags[k] is None)
    why = why or (f"neither true nor false: {silent}" if silent else None)
    return {"ok": why is None, "error": why, "flags": flags, "texts": texts}


def parse_verdict(axis: Column, raw: Column) -> Column:
    """A ``VERDICT`` struct. Nested objects and strings need a state machine, so an Arrow-batched function reads them."""
    @F.pandas_udf(VERDICT)
    def run(axes: pd.Series, replies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_reply(a, r) for a, r in zip(axes, replies, strict=True)], columns=["ok", "error", "flags", "texts"])

    ship_package(SparkSession.active())
    return run(axis, strip_thinking(raw))


def decision(axis: Column, ok: Column, flag, text=None) -> Column:
    """What an axis decides; ``flag(name)`` gives a boolean field. A verdict that did not parse decides nothing."""
    refused = flag("refused") & ~flag("answered_anyway")
    chosen = F.when(axis == "refused", refused).when(axis == "misdirected", flag("misdirected")).otherwise(flag("fabricated"))
    return F.when(ok, chosen)


def verdict_decision(axis: Column, verdict: Column) -> Column:
    return decision(axis, verdict["ok"], lambda k: verdict["flags"][k])


def quote_missing(axis: Column, verdict: Column) -> Column:
    """The positive case is claimed, but nothing is quoted for it."""
    out = F.lit(False)
    for name, quote in QUOTE_FIELD.items():
        out = F.when(axis == name, verdict["flags"][name] & (verdict["texts"][quote] == "")).otherwise(out)
    return F.coalesce(verdict["ok"] & out, F.lit(False))


def clean(refused: Column, fabricated: Column) -> Column:
    """Refused and not fabricated; null if either is (false and null would be false)."""
    return F.when(refused.isNotNull() & fabricated.isNotNull(), refused & ~fabricated)


def hand_clean(refused: Column, fabricated: Column, misdirected: Column) -> Column:
    given = refused.isNotNull() & fabricated.isNotNull()
    return F.when(given & F.coalesce(misdirected, F.lit(False)), False).when(given, refused & ~fabricated)


def prompt_version(axis: Column) -> Column:
    out = F.lit(PROMPT_VERSION)
    for name, version in AXIS_PROMPT_VERSION.items():
        out = F.when(axis == name, version).otherwise(out)
    return out
