"""Values with a lifetime as state of a stream: cache entries that expire, upload sessions that end, by timers of event time.

A value is valid until `lifetime` after its last sign; a sign within that time renews it, one at the very end or later
begins anew. Each stretch of validity gives one row, once the watermark has passed its end: first_at, last_at, expires_at,
n (signs) and value (that of the last sign; of several at one time the greatest, a null before any other).

A key's state is its open stretches, which late signs may lengthen or join: no more than fit between the watermark and the
newest sign, whatever the number of signs. Keys share GROUPS groups by their hash, as a call of Python for each key costs far
more than its signs; a group's state has the stretches of its keys. Signs come in pieces of bounded size, so that a key with a
third of all rows isn't held at once. Rows without a time are left out; a null key is a key. Signs later than the watermark are dropped, as
every stateful operator does. State and progress are in the checkpoint, so a restarted stream gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STRETCH = "first long, last long, n long, value string"
_MICROS = 1_000_000
#: Groups that keys are dealt to (those with the same components null); a stream that goes on from its checkpoint needs the same number.
GROUPS = 2048
_NAN = float("nan")


def joined(stretches: list[tuple], lifetime: int) -> list[tuple]:
    """Stretches (first, last, n, value) in order, those that reach into the next as one; times and lifetime in one unit."""
    out: list[tuple] = []
    for first, last, n, value in sorted(stretches, key=lambda s: s[:2]):
        if out and first < out[-1][1] + lifetime:
            a, b, m, held = out.pop()
            newest = max((b, held is not None, held or ""), (last, value is not None, value or ""))
            first, last, n, value = a, newest[0], n + m, newest[2] if newest[1] else None
        out.append((first, last, n, value))
    return out


def _plain(x: object) -> object:
    """A component of a key as Python has it; of what isn't a number one, so that it equals itself."""
    return x.to_pydatetime() if isinstance(x, pd.Timestamp) else _NAN if x != x else x


def _signs(rows: DataFrame, keys: list[str], time: str, value: Column) -> DataFrame:
    return rows.where(F.col(time).isNotNull()).select(*keys, time, F.unix_micros(time).alias("_at"), value.cast("string").alias("_value"))


def _named(rows: DataFrame, keys: list[str], lifetime: int) -> DataFrame:
    at = lambda c, more=0: F.timestamp_micros(F.col(c) + more)
    return rows.select(*keys, at("first").alias("first_at"), at("last").alias("last_at"), at("last", lifetime).alias("expires_at"), "n", "value")


def of_stream(rows: DataFrame, keys: list[str], time: str, value: Column, seconds: int, late: str = "1 day") -> DataFrame:
    """The stretches of a stream that have ended (keys, first_at, last_at, expires_at, n, value), each once (output mode append)."""
    lifetime = seconds * _MICROS
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def step(group: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[tuple]] = {}
        for *key, first, last, n, value in state.get[0] if state.exists else ():
            held.setdefault(tuple(map(_plain, key)), []).append((first, last, n, value))
        for piece in pieces:
            new: dict[tuple, list[tuple]] = {}
            parts = [[None] * len(piece) if none else map(_plain, piece[k].tolist()) for k, none in zip(keys, group[1:], strict=True)]
            for *key, t, v in zip(*parts, piece["_at"].tolist(), piece["_value"].tolist(), strict=True):
                new.setdefault(tuple(key), []).append((t, t, 1, v if isinstance(v, str) else None))
            for key, signs in new.items():
                held[key] = joined(held.get(key, []) + signs, lifetime)
        now = state.getCurrentWatermarkMs()
        rows = [(*key, *s) for key, stretches in held.items() for s in stretches]
        ended = [r for r in rows if (r[-3] + lifetime) // 1000 < now]
        left = [r for r in rows if (r[-3] + lifetime) // 1000 >= now]
        if left:
            state.update((left,))
            state.setTimeoutTimestamp(min(r[-3] + lifetime for r in left) // 1000)
        elif state.exists:
            state.remove()
        if ended:
            yield pd.DataFrame(ended, columns=[*keys, "first", "last", "n", "value"])

    signs = _signs(rows.withWatermark(time, late), keys, time, value)
    group = {"_group": F.pmod(F.xxhash64(*keys), F.lit(GROUPS))} | {f"_none{i}": F.col(k).isNull() for i, k in enumerate(keys)}
    parts = ",".join(f"k{i}:{kinds[k]}" for i, k in enumerate(keys))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {_STRETCH}"
    found = signs.withColumns(group).groupBy(*group).applyInPandasWithState(step, schema, f"stretches array<struct<{parts},first:bigint,last:bigint,n:bigint,value:string>>", "append", GroupStateTimeout.EventTimeTimeout)
    return _named(found, keys, lifetime)


def of_table(rows: DataFrame, keys: list[str], time: str, value: Column, seconds: int) -> DataFrame:
    """All stretches of a table, ended or not, by session windows; as those take in what comes at their very end, they are a microsecond shorter."""
    lifetime = seconds * _MICROS
    found = _signs(rows, keys, time, value).groupBy(*keys, F.session_window(time, f"{seconds - 1} seconds 999999 microseconds")).agg(
        F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("n"), F.max(F.struct("_at", "_value"))["_value"].alias("value")
    )
    return _named(found, keys, lifetime)
