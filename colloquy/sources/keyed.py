"""One JSON object of any size as rows of (key, value), read by many tasks.

A task that starts in the middle of an object doesn't know whether it stands in a string or how deep. So ranges of bytes
are looked at twice. First each says what it would do to either state: the parity of its quotes, and its change of depth
if it starts outside or inside a string. Sums over the ranges before then give each range its state, and the members of
the object that begin in a range are cut out by its task, which reads on where the last one ends beyond it.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.sources.files import listing, opened
from colloquy.sources.storage import written

#: Bytes of a range, and tasks at most.
RANGE, TASKS = 8 << 20, 4096
_SPACE = (32, 9, 10, 13)
_KEY = re.compile(r'\s*("(?:[^"\\]|\\.)*")\s*:', re.DOTALL)
_BOM = b"\xef\xbb\xbf"


def _steps(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray]:
    """(in a string before each byte, change of depth at each byte). escaped: the byte before escapes the first one."""
    at = np.arange(len(data), dtype=np.int32)
    last = np.maximum.accumulate(np.where(data != 92, at, np.int32(-2 if escaped else -1)))
    quotes = np.flatnonzero(data == 34)
    run = np.where(quotes > 0, quotes - 1 - last[quotes - 1], int(escaped))  # backslashes before a quote
    toggles = np.zeros(len(data) + 1, np.int32)
    toggles[quotes[run % 2 == 0] + 1] = 1
    within = (np.cumsum(toggles) + int(inside)) % 2 == 1
    change = ((data == 123) | (data == 91)).astype(np.int8) - ((data == 125) | (data == 93)).astype(np.int8)
    change[within[:-1]] = 0
    return within, change


def _escaped(f, at: int) -> bool:
    """Whether an odd number of backslashes stands before a place."""
    run, end = 0, at
    while end > 0:
        start = max(0, end - 4096)
        f.seek(start)
        piece = f.read(end - start)
        left = piece.rstrip(b"\\")
        run += len(piece) - len(left)
        if left:
            break
        end = start
    return run % 2 == 1


def _first(f) -> int:
    """The place of the first byte that is no blank or mark."""
    f.seek(0)
    at = 3 if f.read(3) == _BOM else 0
    f.seek(at)
    while piece := f.read(4096):
        left = piece.lstrip(bytes(_SPACE))
        if left:
            return at + len(piece) - len(left)
        at += len(piece)
    return at


def _piece(f, at: int, n: int) -> np.ndarray:
    f.seek(at)
    return np.frombuffer(f.read(n), np.uint8)


def _outlined(batches):
    """path, length, at -> and odd (quotes), outside and inside (changes of depth)."""
    for batch in batches:
        for row in batch.to_pylist():
            with opened(row["path"]) as f:
                data, escaped = _piece(f, row["at"], row["size"]), _escaped(f, row["at"])
            within, change = _steps(data, False, escaped)
            inside = _steps(data, True, escaped)[1]
            yield pa.RecordBatch.from_pylist([row | {"odd": int(within[-1]), "outside": int(change.sum()), "inside": int(inside.sum())}])


def _bad(path: str, what: str):
    return ValueError(f"{path} is not a JSON object: {what}")


def _member(path: str, text: bytes) -> dict | None:
    held = text.decode("utf-8")
    found = _KEY.match(held)
    if not found:
        raise _bad(path, f"no key in {held[:80]!r}")
    value = held[found.end() :].strip()
    json.loads(value)  # damaged values raise
    return {"key": json.loads(found[1]), "value": value}


def _cut(path: str, f, at: int, size: int, length: int, inside: bool, depth: int):
    """The members that begin in a range, one by one."""
    first = at
    if at == 0:
        f.seek(0)
        if f.read(3) == _BOM:
            first = 3
    pending, began = b"", False  # the bytes of a member that is not at its end
    here, escaped, n = first, _escaped(f, first), at + size - first
    while n > 0:
        beyond = here >= at + size
        data = _piece(f, here, n)
        within, change = _steps(data, inside, escaped)
        after = depth + np.cumsum(change, dtype=np.int64)
        before = after - change
        if after.min(initial=0) < 0:
            raise _bad(path, "too many brackets are closed")
        free = ~within[:-1]
        loose = (before == 0) & (change == 0) & ~np.isin(data, _SPACE)
        if loose.any():
            raise _bad(path, "text outside of the object")
        opens, closes = (before == 0) & (change == 1), (after == 0) & (change == -1)
        if (data[opens] != 123).any() or (data[closes] != 125).any():
            raise _bad(path, "another value or bracket")
        if opens.any() and (np.flatnonzero(opens) + here != _first(f)).any():
            raise _bad(path, "a second object")
        raw, start = data.tobytes(), 0
        for p in np.flatnonzero(opens | closes | (free & (before == 1) & (data == 44))).tolist():
            if began:
                text = pending + raw[start:p]
                pending = b""
                if data[p] == 44 or text.strip() or not opened_here:
                    yield _member(path, text)
            opened_here = data[p] == 123
            began = data[p] != 125 and not beyond
            start = p + 1
            if beyond:
                return
        if began:
            pending += raw[start:]
        elif beyond or here + len(data) >= at + size:
            return
        inside, depth, here = bool(within[-1]), int(after[-1]) if len(after) else depth, here + len(data)
        escaped, n = _escaped(f, here), min(1 << 16, length - here)


def _members(batches):
    for batch in batches:
        for row in batch.to_pylist():
            out, held = [], 0
            with opened(row["path"]) as f:
                for m in _cut(row["path"], f, row["at"], row["size"], row["length"], row["string"], row["depth"]):
                    out.append(m)
                    held += len(m["value"])
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out)


def members(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """key, value (JSON text) of the members of the object in each file below path.

    Damaged text, another value than an object, or text beside it raise an error; so does a path with nothing but empty files. Keys that
    repeat give a row each. A value is held by one task.
    """
    found = listing(spark, path)
    n = found.agg(F.sum(F.ceil(F.col("length") / size))).first()[0]  # one row
    if not n:
        raise _bad(path, "it is empty")
    tasks = int(min(n, TASKS))
    ranges = found.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    ranges = ranges.withColumn("size", F.least(F.lit(size), F.col("length") - F.col("at"))).repartition(tasks, "path", "at")
    outline = written(ranges.mapInArrow(_outlined, "path string, length long, at long, size long, odd long, outside long, inside long"), "json-ranges")
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one small row a range
    state = outline.withColumn("string", F.coalesce(F.sum("odd").over(w), F.lit(0)) % 2 == 1)
    state = state.withColumn("step", F.when(F.col("string"), F.col("inside")).otherwise(F.col("outside")))
    state = state.withColumn("depth", F.coalesce(F.sum("step").over(w), F.lit(0)))
    last = F.col("at") + F.col("size") == F.col("length")
    whole = (F.col("depth") + F.col("step") == 0) & (F.col("string") == (F.col("odd") == 1))
    stop = F.raise_error(F.concat("path", F.lit(" is not a JSON object: it has no end"))).cast("boolean")
    state = state.filter(F.when(~last | whole, True).otherwise(stop))
    held = written(state.select("path", "length", "at", "size", "string", "depth"), "json-states")
    return held.repartition(tasks, "path", "at").mapInArrow(_members, "key string, value string")
