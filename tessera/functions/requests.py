"""What is left of model calls without a network: keys of requests, waits after refusals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WAIT = 120.0
#: Fixed value: where a refusal's text names the wait, in seconds.
RETRY_DELAY = r'''retryDelay'?"?\s*:\s*'?"?(\d+(?:\.\d+)?)s'''


def request_key(provider: Column, model: Column, messages: Column, schema: Column, options: Column) -> Column:
    """64 hex digits that name everything a reply depends on. messages: an array of (role, content); options: a map of strings, whose order makes no difference; schema may be null, the rest may not, or the key is null.

    Parts are joined by control characters of descending level, so no two requests share a text.
    """
    unit, record, group = "\u001f", "\u001e", "\u001d"
    said = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(unit), m["content"])), record)
    chosen = F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda o: F.concat(o["key"], F.lit(unit), o["value"])), record)
    return F.sha2(F.concat(provider, F.lit(group), model, F.lit(group), said, F.lit(group), F.coalesce(schema, F.lit("\u0000")), F.lit(group), chosen), 256)


def retry_after(header: Column, body: Column) -> Column:
    """Seconds that a server asks to wait: its header, else what its text says; null if that is no number."""
    said = F.nullif(F.regexp_extract(body, RETRY_DELAY, 1), F.lit(""))
    return F.coalesce(header, said).try_cast("double")


def backoff(attempt: Column, asked: Column, jitter: Column) -> Column:
    """The wait before the next attempt: what was asked, else 2 to the attempt; plus jitter from 0 to 1, at most ``MAX_WAIT``."""
    return F.least(F.lit(MAX_WAIT), F.coalesce(asked, F.pow(F.lit(2.0), attempt)) + jitter)
