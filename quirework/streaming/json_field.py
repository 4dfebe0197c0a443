"""One string field of a JSON text that arrives in pieces: what each piece adds to the field's value.

The field is the first `"name"`, and its value begins behind the first quote after the first colon after it. However
the text is cut, the pieces add up to the same value. `\\n \\r \\t \\b \\f` and `\\uXXXX` are decoded, any other escaped
character stands for itself, four characters that aren't hexadecimal stay as written, and two halves of a
surrogate pair make one character (half a pair U+FFFD). Pieces behind the closing quote add nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STOP = re.compile(r'["\\]')
SHORT = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
STATE = "phase int, held string, half int"
SEEK, COLON, QUOTE, INSIDE, DONE = range(5)


class Place(NamedTuple):
    """Where the text stopped: the phase, characters to look at again, and the first half of a pair."""

    phase: int = SEEK
    held: str = ""
    half: int = 0


def _unit(code: int, half: int) -> tuple[str, int]:
    """(text, open half) after one 16-bit unit."""
    if 0xDC00 <= code < 0xE000 and half:
        return chr(0x10000 + ((half - 0xD800) << 10) + code - 0xDC00), 0
    lost = "�" if half else ""
    return (lost, code) if 0xD800 <= code < 0xDC00 else (lost + ("�" if 0xDC00 <= code < 0xE000 else chr(code)), 0)


def advance(place: Place, piece: str, name: str) -> tuple[Place, str]:
    """The next place, and what ``piece`` adds to the value."""
    phase, text, half = place.phase, place.held + piece, place.half
    marker = f'"{name}"'
    for at, mark in ((SEEK, marker), (COLON, ":"), (QUOTE, '"')):
        if phase == at:
            found = text.find(mark)
            if found < 0:
                return Place(phase, text[-(len(mark) - 1) :] if len(mark) > 1 else "", 0), ""
            phase, text = at + 1, text[found + len(mark) :]
    if phase == DONE:
        return Place(DONE), ""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == '"':
            return Place(DONE), "".join(out) + ("�" if half else "")
        if c != "\\":
            end = m.start() if (m := STOP.search(text, i)) else len(text)
            out.append(("�" if half else "") + text[i:end])
            half, i = 0, end
            continue
        if i + 1 == len(text) or text[i + 1] == "u" and i + 6 > len(text):
            break  # an escape that the next piece completes
        if text[i + 1] == "u":
            digits = text[i + 2 : i + 6]
            try:
                added, half = _unit(int(digits, 16), half)
            except ValueError:
                added, half = ("�" if half else "") + "\\u" + digits, 0
            i += 6
        else:
            added, half, i = ("�" if half else "") + SHORT.get(text[i + 1], text[i + 1]), 0, i + 2
        out.append(added)
    return Place(INSIDE, text[i:], half), "".join(out)


def field_pieces(pieces: DataFrame, key: str, order: str, piece: str, name: str) -> DataFrame:
    """``key``, ``order`` and ``delta`` of each piece, in batch. A key's pieces lie in one partition, sorted by
    Spark, and pass one by one with only the place between them kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = (), Place()
        for batch in batches:
            deltas = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                place, delta = advance(place if (k,) == last else Place(), text or "", name)
                last = (k,)
                deltas.append(delta)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(deltas, pa.string())], names=[key, order, "delta"])

    given = pieces.select(key, order, piece).repartition(key).sortWithinPartitions(key, order)
    kinds = given.schema
    return given.mapInArrow(run, f"{key} {kinds[key].dataType.simpleString()}, {order} {kinds[order].dataType.simpleString()}, delta string")


def field_stream(pieces: DataFrame, key: str, order: str, piece: str, name: str) -> DataFrame:
    """The same of a stream: the place of each key is its state. Pieces of a batch are put in order first; a batch
    must not hold pieces that come before those of an earlier one."""

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        place = Place(*state.get) if state.exists else Place()
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        deltas = []
        for text in rows[piece]:
            place, delta = advance(place, text or "", name)
            deltas.append(delta)
        state.update(tuple(place))
        yield pd.DataFrame({key: rows[key].to_numpy(), order: rows[order].to_numpy(), "delta": deltas})

    kinds = pieces.schema
    out = f"{key} {kinds[key].dataType.simpleString()}, {order} {kinds[order].dataType.simpleString()}, delta string"
    return pieces.select(key, order, piece).groupBy(key).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)


def whole_field(deltas: DataFrame, key: str, order: str) -> DataFrame:
    """``key`` and ``value``: what the pieces add up to."""
    parts = F.array_sort(F.collect_list(F.struct(order, "delta")))
    return deltas.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["delta"]), "").alias("value"))
