"""Edit distance on bytes: as built-in expressions, and of all short texts of a box at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORT = 64  # bytes, one per bit of a word
_PAIRS = 1 << 15  # that are measured together, so that what is written per step stays in a core's cache


def byte_text(text: Column) -> Column:
    """The text with one character per UTF-8 byte, so that ``levenshtein`` counts bytes."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, text).otherwise(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))


def byte_levenshtein(a: Column, b: Column, limit: Column | None = None) -> Column:
    """Edit distance in bytes. With ``limit``, -1 where the distance is larger (and found out early)."""
    sides = [byte_text(a), byte_text(b)]
    return F.call_function("levenshtein", *sides, *([] if limit is None else [limit]))


def epoch_micros(df: DataFrame, name: str = "ts", value: Column | None = None) -> Column:
    """Microseconds since 1970 of a timestamp column, or of ``value``, which has that column's type.

    Instants give their epoch time; timestamps without a zone count as they stand, in any session zone.
    """
    ts = F.col(name) if value is None else value
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(ts)
    minutes = F.unix_date(ts.cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    seconds = F.date_part(F.lit("SECOND"), ts) * 1_000_000
    return minutes * 60_000_000 + seconds.cast("long")


def slot_start(df: DataFrame, seconds: int, name: str = "ts") -> Column:
    """Start, in epoch seconds, of the slot of that many seconds the time falls into."""
    micros = epoch_micros(df, name)
    return ((micros - F.pmod(micros, F.lit(seconds * 1_000_000))) / 1_000_000).cast("long")


def _measured(codes: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the texts ``a`` and ``b``, neither of which is null.

    One word per pair holds where the cost rises by one along one text, another where it falls; each step takes a byte
    of the other, in all pairs that still have one. (In :func:`alertfold.functions.script.prefix_costs`, for one pair.)
    """
    one, kinds = np.uint64(1), int(codes.max(initial=0)) + 1
    places = np.zeros((len(codes), kinds), np.uint64)
    for i in range(int(size.max(initial=0))):
        long = np.flatnonzero(size > i)
        places[long, codes[long, i]] |= one << np.uint64(i)
    along, steps = np.where(size[a] < size[b], b, a), np.where(size[a] < size[b], a, b)
    order = np.argsort(-size[steps].astype(np.int8), kind="stable")
    along, steps = along[order], steps[order]
    left = size[steps]
    row, flat = along * kinds, places.ravel()
    rise, fall = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    columns = np.ascontiguousarray(codes.T)
    for j in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -j, "left"))  # pairs with more than j steps, which come first
        equal = flat[row[:n] + columns[j][steps[:n]]]
        up, down = rise[:n], fall[:n]
        diagonal = equal & up
        diagonal += up
        diagonal ^= up
        diagonal |= equal
        diagonal |= down
        ups = diagonal | up
        np.invert(ups, out=ups)
        ups |= down
        up &= diagonal  # now where it falls
        ups <<= one
        ups |= one
        up <<= one
        np.bitwise_and(ups, diagonal, out=down)
        diagonal |= ups
        np.invert(diagonal, out=diagonal)
        up |= diagonal
    width = size[along]
    mask = np.where(width < SHORT, (one << (width % SHORT).astype(np.uint64)) - one, ~np.uint64(0))
    out = np.empty(len(a), np.int8)
    out[order] = left + np.bitwise_count(rise & mask).astype(np.int64) - np.bitwise_count(fall & mask)
    return out


def _distances_of(boxes: pa.Array) -> pa.Array:
    """Per box the distances of its texts to those before them: text 1 to 0, 2 to 0, 2 to 1, 3 to 0 and so on."""
    counts = pc.list_value_length(boxes).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = pc.cast(boxes.flatten(), pa.large_binary())
    size = pc.binary_length(texts).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = np.cumsum(counts) - counts
    pairs = counts * (counts - 1) // 2
    values, known = [], []
    todo = np.cumsum(pairs) // _PAIRS
    for part in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(todo)) + 1) if len(counts) else []:
        # all pairs of the boxes of this part, by the later text
        low, high = int(first[part[0]]), int(first[part[-1]] + counts[part[-1]])
        place = np.arange(low, high) - np.repeat(first[part], counts[part])
        b = np.repeat(np.arange(high - low), place)
        a = np.arange(len(b)) - np.repeat(np.cumsum(place) - place, place) + (b - np.repeat(place, place))
        own = size[low:high]
        widest = max(int(own.max(initial=0)), 0)
        at = ends[low:high, None] + np.arange(widest)
        bytes_of = np.where(np.arange(widest) < own[:, None], data[np.minimum(at, len(data) - 1)] if len(data) else 0, 0)
        numbers = np.cumsum(np.bincount(bytes_of.ravel(), minlength=256) > 0) - 1
        both = (own[a] >= 0) & (own[b] >= 0)
        lev = np.full(len(b), -1, np.int8)
        lev[both] = _measured(numbers[bytes_of], np.maximum(own, 0), a[both], b[both])
        values.append(lev)
        known.append(both)
    empty = np.zeros(0, np.int8)
    offsets = np.concatenate([[0], np.cumsum(pairs)]).astype(np.int32)
    filled = pa.array(np.concatenate([empty, *values]), pa.int8(), mask=~np.concatenate([empty.astype(bool), *known]))
    return pa.ListArray.from_arrays(pa.array(offsets), filled)


@F.arrow_udf(T.ArrayType(T.ByteType()))
def short_distances(texts: pa.Array) -> pa.Array:
    """Byte distances between the texts of a box, each of up to ``SHORT`` bytes or null: entry ``y * (y - 1) / 2 + x`` is
    that of texts x and y, x < y; null if one of them is."""
    return _distances_of(texts)
