"""Reading key-length-value telemetry packets. Imported by Python workers, so it needs no Spark session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The local set's key; tag -> field, bytes are signed, lower and upper end of the range.
KEY = bytes.fromhex("060e2b34020b01010e01030101000000")
TIME_TAG = 2
TAGS = {5: ("heading", False, 0.0, 360.0), 6: ("pitch", True, -20.0, 20.0), 7: ("roll", True, -50.0, 50.0), 13: ("y", True, -90.0, 90.0), 14: ("x", True, -180.0, 180.0), 15: ("z", False, -900.0, 19000.0)}
FIELDS = ("heading", "pitch", "roll", "x", "y", "z")


def _tag(data: bytes, at: int) -> tuple[int, int]:
    """K3: a tag number of seven bits a byte, and the place after it."""
    number = 0
    while True:
        byte = data[at]
        number, at = number << 7 | byte & 0x7F, at + 1
        if byte < 0x80:
            return number, at


def _length(data: bytes, at: int) -> tuple[int, int]:
    """K3: a short length, or as many bytes of a long one as the first byte says."""
    n = data[at]
    if n < 0x80:
        return n, at + 1
    size = n & 0x7F
    if at + 1 + size > len(data):
        raise IndexError("length cut off")
    return int.from_bytes(data[at + 1 : at + 1 + size], "big"), at + 1 + size


def decoded(packet: bytes | None) -> tuple | None:
    """K1/K2: time in microseconds and the fields; None for a wrong key, a cut packet or one without a time."""
    if not packet or packet[: len(KEY)] != KEY:
        return None
    try:
        size, at = _length(packet, len(KEY))
        end = at + size
        if end > len(packet):
            return None
        time, values = None, dict.fromkeys(FIELDS)
        while at < end:
            tag, at = _tag(packet, at)
            n, at = _length(packet, at)
            if at + n > end:
                return None
            raw, at = packet[at : at + n], at + n
            if tag == TIME_TAG and n == 8:
                time = int.from_bytes(raw, "big")
            elif tag in TAGS and n:
                name, signed, low, high = TAGS[tag]
                number = int.from_bytes(raw, "big", signed=signed)
                values[name] = number * high / (2 ** (8 * n - 1) - 1) if signed else low + number * (high - low) / (2 ** (8 * n) - 1)
        return None if time is None else (time, *(values[f] for f in FIELDS))
    except IndexError:
        return None


def _integers(data: np.ndarray, at: np.ndarray, n: np.ndarray, signed: bool) -> np.ndarray:
    """Big-endian numbers of n bytes (8 at most) at the places."""
    total = np.zeros(len(at), np.uint64)
    for k in range(8):
        inside = k < n
        total = np.where(inside, total << np.uint64(8) | data[np.where(inside, at + k, 0)], total)
    if not signed:
        return total
    shift = (np.uint64(64) - np.uint64(8) * n.astype(np.uint64)) & np.uint64(63)
    return (total << shift).view(np.int64) >> shift.astype(np.int64)


def decoded_batch(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K1/K2 for many packets at once: numbers of those that decode, their times, their fields (NaN where absent). The
    packets are read tag by tag, all at a time; ones with long tags, lengths or values are left to ``decoded``."""
    start, stop = offsets[:-1], offsets[1:]
    head = len(KEY)
    fine = stop - start > head
    at = np.where(fine, start, 0)
    for k, byte in enumerate(KEY):
        fine &= data[np.minimum(at + k, max(len(data) - 1, 0))] == byte if len(data) else False
    size = data[np.where(fine, start + head, 0)].astype(np.int64) if len(data) else np.zeros(len(start), np.int64)
    odd = fine & (size >= 0x80)
    place, end = start + head + 1, start + head + 1 + size
    fine &= ~odd & (end <= stop)
    time, timed, values = np.zeros(len(start), np.int64), np.zeros(len(start), bool), np.full((len(FIELDS), len(start)), np.nan)
    todo = np.flatnonzero(fine & (place < end))
    while len(todo):
        whole = place[todo] + 1 < end[todo]
        fine[todo[~whole]] = False
        todo = todo[whole]
        tag, n = data[place[todo]].astype(np.int64), data[place[todo] + 1].astype(np.int64)
        long = (tag >= 0x80) | (n > 8) & (np.isin(tag, list(TAGS)) | (n >= 0x80))
        odd[todo[long]] = True
        over = ~long & (place[todo] + 2 + n > end[todo])
        fine[todo[over | long]] = False
        todo, tag, n = (x[~(over | long)] for x in (todo, tag, n))
        at = place[todo] + 2
        clock = (tag == TIME_TAG) & (n == 8)
        time[todo[clock]], timed[todo[clock]] = _integers(data, at[clock], n[clock], False).view(np.int64), True
        for number, (name, signed, low, high) in TAGS.items():
            mine = (tag == number) & (n > 0)
            if mine.any():
                raw, bits = _integers(data, at[mine], n[mine], signed).astype(np.float64), 8.0 * n[mine]
                values[FIELDS.index(name), todo[mine]] = raw * high / (2.0 ** (bits - 1) - 1) if signed else low + raw * (high - low) / (2.0**bits - 1)
        place[todo] = at + n
        todo = todo[place[todo] < end[todo]]
    fine &= timed
    for k in np.flatnonzero(odd):
        found = decoded(data[start[k] : stop[k]].tobytes())
        fine[k] = found is not None
        if found:
            time[k] = found[0]
            values[:, k] = [np.nan if v is None else v for v in found[1:]]
    some = np.flatnonzero(fine)
    return some, time[some], values[:, some]


def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payload = pc.fill_null(batch.column("payload"), b"")
        _, places, data = payload.buffers()
        offsets = np.frombuffer(places, np.int32)[payload.offset : payload.offset + len(payload) + 1].astype(np.int64) if len(payload) else np.zeros(1, np.int64)
        some, time, values = decoded_batch(np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets)
        rows = pa.array(some)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("video_id", "seq", "stream")), pa.array(time), *(pa.array(v, pa.float64(), from_pandas=True) for v in values)], ["video_id", "seq", "stream", "time_us", *FIELDS])
