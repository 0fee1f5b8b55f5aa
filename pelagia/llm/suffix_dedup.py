"""Removal of byte strings that occur twice, by suffix arrays of shards.

Windows of ``k`` bytes are dealt by their minimiser: the least hash of their ``m``-byte grams. Neighbouring windows
with one minimiser form a segment, so equal windows always meet in one shard, whatever documents they come from.
Segments whose minimiser is found once hold no repeat; equal segments are collapsed; the distinct segments of a
minimiser go to a shard, whose suffix array is built by induced sorting. Permuted common prefixes of neighbouring
suffixes then tell the windows that occur twice. The segments of a minimiser with too many of them for one shard are
texts of a next turn, which deals their windows by longer grams; the last turn's grams are whole windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_of
from .words import _BYTE, blocks, mix, powers

LENGTH, GRAM = 200, 32
#: Bytes of a shard, and the distinct segments of one minimiser above which a next turn deals them by longer grams.
SHARD_BYTES, SPLIT = 1 << 21, 3000
#: Grams of the turns, as shares of what a window has beyond its first gram.
TURNS = (0.0, 0.4, 0.8, 1.0)
#: Alphabets up to this size are induced bucket by bucket, larger ones suffix by suffix.
WIDE = 1024
_BLOCK = 1 << 20
_INVERSE = pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_inverse_powers = np.ones(1, np.uint64)


def _unpower(n: int) -> np.ndarray:
    """The first n powers of the hash base's inverse, modulo 2**64."""
    global _inverse_powers
    if n > len(_inverse_powers):
        _inverse_powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, np.uint64(_INVERSE))]), dtype=np.uint64)
    return _inverse_powers[:n]


def _prefix(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(len(codes)), dtype=np.uint64)])


def _runs(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each stretch, from the prefix sums of its codes."""
    return mix((prefix[end] - prefix[start]) * _unpower(len(prefix))[start] + (end - start).astype(np.uint64))


# --- suffix array of a shard -------------------------------------------------------------------------------------


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last suffix counts as such."""
    step = np.sign(np.diff(text.astype(np.int32)))
    step = np.append(step, 1)
    place = np.where(step != 0, np.arange(len(text)), len(text))
    following = np.minimum.accumulate(place[::-1])[::-1]
    return step[following] > 0


def _ranks(sorted_codes: np.ndarray) -> np.ndarray:
    """Number of each entry within its run of equal codes."""
    new = np.flatnonzero(np.diff(sorted_codes, prepend=-1))
    return np.arange(len(sorted_codes)) - np.repeat(new, np.diff(np.append(new, len(sorted_codes))))


def induce(text: np.ndarray, smaller: np.ndarray, marks: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order from the leftmost-smaller ones (``marks``) in order: larger ones are induced bucket by
    bucket upwards, then smaller ones downwards. A bucket's entries are handled together, those that they induce
    into their own bucket in the next turn."""
    if symbols > WIDE:
        return _induce_each(text, smaller, marks, symbols)
    size = np.bincount(text, minlength=symbols)
    tail = np.cumsum(size)
    head = tail - size
    out = np.full(len(text), -1, np.int64)
    codes = text[marks]
    order = np.argsort(codes, kind="stable")
    sorted_marks, codes = marks[order], codes[order]
    n_marks = np.bincount(codes, minlength=symbols)
    mark_start = tail - n_marks
    out[mark_start[codes] + _ranks(codes)] = sorted_marks
    free = head.copy()

    def put(entries: np.ndarray, upwards: bool) -> None:
        before = entries[entries > 0] - 1
        before = before[smaller[before] != upwards]
        if not len(before):
            return
        codes = text[before]
        order = np.argsort(codes, kind="stable")
        codes, before = codes[order], before[order]
        rank = _ranks(codes)
        if upwards:
            out[free[codes] + rank] = before
        else:
            out[free[codes] - 1 - rank] = before
        count = np.bincount(codes, minlength=symbols)
        np.add(free, count if upwards else -count, out=free)

    for c in np.flatnonzero(size):
        done = head[c]
        while done < free[c]:
            done, now = free[c], out[done : free[c]].copy()
            put(now, True)
        if n_marks[c]:
            put(out[mark_start[c] : tail[c]].copy(), True)
    larger_end = free.copy()
    free = tail.copy()
    for c in np.flatnonzero(size)[::-1]:
        if c == 0:  # the end mark is the only suffix of its bucket
            out[0] = len(text) - 1
            break
        if c == text[-1]:
            continue
        done = tail[c]
        while done > free[c]:
            done, now = free[c], out[free[c] : done][::-1].copy()
            put(now, False)
        put(out[head[c] : larger_end[c]][::-1].copy(), False)
    return out


def _induce_each(text: np.ndarray, smaller: np.ndarray, marks: np.ndarray, symbols: int) -> np.ndarray:
    """``induce`` for a large alphabet, whose buckets hold few suffixes each."""
    size = np.bincount(text, minlength=symbols)
    tail = np.cumsum(size)
    # the bucket that a suffix induces into, upwards and downwards; -1 for none, also at the place of no suffix (-1)
    led, larger = np.append(text[:-1], -1), np.append(~smaller[:-1], False)
    up, down = (np.append(-1, np.where(turn, led, -1)).tolist() for turn in (larger, ~larger))
    codes, out, end = text.tolist(), [-1] * len(text), tail.tolist()
    for place in marks[::-1].tolist():
        c = codes[place]
        end[c] -= 1
        out[end[c]] = place
    free = (tail - size).tolist()
    for place in out:  # filled ahead of the place that is read
        c = up[place]
        if c >= 0:
            out[free[c]] = place - 1
            free[c] += 1
    free = tail.tolist()
    for place in reversed(out):
        c = down[place]
        if c >= 0:
            free[c] -= 1
            out[free[c]] = place - 1
    out[0] = len(codes) - 1  # the end mark
    return np.array(out, np.int64)


def _names(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the strings ``text[starts:ends]``, which are in order: equal strings have one number."""
    length = ends - starts
    new = np.ones(len(starts), bool)
    new[1:] = length[1:] != length[:-1]
    like = np.flatnonzero(~new)  # as long as the one before: compared with it symbol by symbol
    if len(like):
        many = length[like]
        first = np.cumsum(many) - many
        place = np.arange(int(many.sum())) - np.repeat(first, many)
        differs = text[np.repeat(starts[like], many) + place] != text[np.repeat(starts[like - 1], many) + place]
        new[like] = np.add.reduceat(differs, first, dtype=np.int64) > 0
    return np.cumsum(new) - 1


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array by induced sorting; ``text`` ends with its only 0. The leftmost-smaller substrings are sorted by
    inducing, their names are a text whose suffix array gives the order of the leftmost-smaller suffixes, and these
    induce all others."""
    if len(text) == 1:
        return np.zeros(1, np.int64)
    smaller = suffix_types(text)
    marks = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    first = induce(text, smaller, marks, symbols)
    is_mark = np.zeros(len(text), bool)
    is_mark[marks] = True
    sorted_marks = first[is_mark[first]]
    number = np.full(len(text), -1, np.int64)
    number[marks] = np.arange(len(marks))
    end = np.append(marks[1:] + 1, len(text))[number[sorted_marks]]
    names = _names(text, sorted_marks, end)
    if names[-1] < len(marks) - 1:
        reduced = np.empty(len(marks), np.int64)
        reduced[number[sorted_marks]] = names
        sorted_marks = marks[suffix_array(reduced, int(names[-1]) + 1)]
    return induce(text, smaller, sorted_marks, symbols)


_PACK = 7  # symbols of 9 bits that a 63-bit word holds


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the suffix before it in the array and their common prefix. Where the symbols before the two are
    equal, the prefix is that of the place before less one; only the other places' suffixes are compared."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], order[0]
    place = np.arange(n)
    own = (place == 0) | (before == 0) | (text[place - 1] != text[before - 1])
    own[order[0]] = True
    word = np.zeros(n + _PACK, np.int64)
    for k in range(_PACK):
        word[: max(n - k, 0)] |= text[k:].astype(np.int64) << (9 * k)
    at = np.flatnonzero(own & (place != order[0]))
    common = np.zeros(n, np.int64)
    a, b = at, before[at]
    while len(at):  # whole words first, then the symbols of the first word that differs
        same = word[a] == word[b]
        common[at[same]] += _PACK
        a, b, at = a[same] + _PACK, b[same] + _PACK, at[same]
        on = (a < n) & (b < n)
        a, b, at = a[on], b[on], at[on]
    at = np.flatnonzero(own & (place != order[0]))
    for _ in range(_PACK):
        a, b = at + common[at], before[at] + common[at]
        on = (a < n) & (b < n)
        at, a, b = at[on], a[on], b[on]
        same = text[a] == text[b]
        at = at[same]
        common[at] += 1
    reach = np.where(own, common + place, 0)
    last = np.maximum.accumulate(np.where(own, place, 0))
    common = np.maximum(reach[last] - place, 0)
    common[order[0]] = 0
    return before, common


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the places where a window begins that begins at another place of some segment too."""
    size = np.array([len(s) for s in segments], np.int64)
    start = np.cumsum(size + 1) - size - 1
    text = np.ones(int(size.sum()) + len(segments) + 1, np.int16)
    text[-1] = 0
    place = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[place] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 2
    left = np.zeros(len(text), np.int64)
    left[place] = np.repeat(start + size, size) - place
    before, common = permuted_prefixes(text, suffix_array(text, 258))
    again = np.flatnonzero((common >= length) & (left >= length) & (left[before] >= length))
    flag = np.zeros(len(text), bool)
    flag[again] = flag[before[again]] = True
    return [np.flatnonzero(flag[s : s + n]) for s, n in zip(start, size, strict=True)]


# --- the Spark job -----------------------------------------------------------------------------------------------


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows, minimiser and hash of every segment of a block."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    prefix = _prefix(_BYTE[data])
    place = np.arange(n - gram + 1)
    hashes = _runs(prefix, place, place + gram)
    low = np.uint64((1 << max(20, int(n).bit_length())) - 1)
    key = (hashes & ~low) | place.astype(np.uint64)
    width = length - gram + 1
    rows = np.full(-(-len(key) // width) * width, np.uint64(2**64 - 1))
    rows[: len(key)] = key
    rows = rows.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = (np.minimum(down[:count], up[width - 1 : width - 1 + count]) & low).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(count), "right") - 1
    valid = np.arange(count) + length <= offsets[doc + 1]
    new = np.empty(count, bool)
    new[0], new[1:] = True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, count))
    first, windows = first[valid[first]], windows[valid[first]]
    return doc[first], first - offsets[doc[first]], windows, hashes[least[first]].view(np.int64), _runs(prefix, first, first + windows + length - 1).view(np.int64)


def _segment_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("data").cast(pa.binary()).view(pa.string()), _BLOCK):
                doc, start, windows, minimiser, value = segments(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays([batch.column("owner").slice(i, j - i).take(pa.array(doc)), pa.array(start), pa.array(windows), pa.array(minimiser), pa.array(value)], ["owner", "start", "windows", "mini", "seg"])

    return run


def _solve(length: int):
    def run(shard: pa.Table) -> pa.Table:
        # rows that repeat an owner and its text repeat its segments
        own = {(m, s): k for k, (m, s) in enumerate(zip(shard.column("mini").to_pylist(), shard.column("seg").to_pylist(), strict=True))}
        shard = shard.take(pa.array(list(own.values())))
        places = repeated_windows(shard.column("bytes").to_pylist(), length)
        row, begin, end = [], [], []
        for k, found in enumerate(places):
            if len(found):
                cut = np.flatnonzero(np.diff(found) > 1)
                begin.append(found[np.concatenate([[0], cut + 1])])
                end.append(found[np.concatenate([cut, [len(found) - 1]])] + 1)
                row.append(np.full(len(cut) + 1, k))
        row, begin, end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (row, begin, end))
        return pa.table({"mini": shard.column("mini").take(pa.array(row)), "seg": shard.column("seg").take(pa.array(row)), "begin": begin, "end": end})

    return run


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, turn: int = 0) -> DataFrame:
    """``owner, begin, end``: the windows of ``texts`` (owner, data) that begin at another place too, as ranges of their
    first bytes. Rows with one owner are places of their own, with one text."""
    step = gram + round(TURNS[turn] * (length - gram))
    rows = materialise(texts.mapInArrow(_segment_rows(length, step), "owner bigint, start bigint, windows bigint, mini bigint, seg bigint"))
    # written first, so that the join reads two plain shuffles and Spark can split a hot minimiser
    twice = materialise(rows.groupBy("mini").agg(F.count("*").alias("c")).where("c > 1").select("mini"))
    met = materialise(rows.join(twice.hint("merge"), "mini"))
    discard(rows, twice)
    distinct = materialise(met.groupBy("mini", "seg").agg(F.count("*").alias("n"), F.first("owner").alias("owner"), F.first("start").alias("start"), F.first("windows").alias("windows")))
    several = materialise(distinct.groupBy("mini").agg(F.count("*").alias("c")).where("c > 1"))
    chosen = distinct.join(several.hint("merge"), "mini")
    whole = distinct.where("n > 1").select("mini", "seg", F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.col("windows").alias("end"))).alias("found"))
    if turn == len(TURNS) - 1:  # a minimiser is a window here: other segments of it do not exist
        ranges = whole
    else:
        total = chosen.where(F.col("c") <= SPLIT).agg(F.sum(F.col("windows") + length)).first()[0] or 0
        by_text = chosen.groupBy("owner").agg(F.collect_list(F.struct("mini", "seg", "start", "windows", "c")).alias("segs"))
        cut = texts.join(by_text.hint("merge"), "owner").select("data", F.explode("segs").alias("s"))
        cut = materialise(cut.select("s.mini", "s.seg", "s.c", F.substring("data", (F.col("s.start") + 1).cast("int"), (F.col("s.windows") + (length - 1)).cast("int")).alias("bytes")))
        shard = F.pmod(F.xxhash64("mini"), F.lit(max(1, round(total / SHARD_BYTES))))
        solved = cut.where(F.col("c") <= SPLIT).select("mini", "seg", "bytes", shard.alias("shard")).groupBy("shard").applyInArrow(_solve(length), "mini bigint, seg bigint, begin bigint, end bigint")
        hot = cut.where(F.col("c") > SPLIT)
        if not several.where(F.col("c") > SPLIT).isEmpty():
            named = hot.select("mini", "seg", F.xxhash64("mini", "seg").alias("owner"), F.col("bytes").alias("data")).dropDuplicates(["mini", "seg"])
            deeper = repeated_ranges(named.select("owner", "data"), length, gram, turn + 1)
            solved = solved.union(named.select("mini", "seg", "owner").join(deeper, "owner").select("mini", "seg", "begin", "end"))
        solved = materialise(solved.groupBy("mini", "seg").agg(F.collect_set(F.struct("begin", "end")).alias("found")))
        discard(cut)
        ranges = whole.union(solved.join(distinct.where("n > 1").select("mini", "seg"), ["mini", "seg"], "left_anti").select("mini", "seg", "found"))
    covered = met.join(ranges.hint("merge"), ["mini", "seg"]).select("owner", F.explode(F.transform("found", lambda r: F.struct((r["begin"] + F.col("start")).alias("begin"), (r["end"] + F.col("start")).alias("end")))).alias("cut"))
    covered = materialise(covered.select("owner", "cut.begin", "cut.end"))
    discard(met, distinct, several)
    return covered


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
                data = (text.as_py() or "").encode()
                gone, spans, kept, at = 0, 0, [], 0
                for cut in cuts.as_py() or ():  # in order of begin
                    begin, end = cut["begin"], cut["end"] + length - 1
                    if begin > at or not spans:
                        kept.append(data[at:begin])
                        spans += 1
                        gone, at = gone + end - begin, end
                    elif end > at:
                        gone, at = gone + end - at, end
                kept.append(data[at:])
                whole = b"".join(kept)
                out.append((len(data), gone, spans, hashlib.sha256(whole).hexdigest(), whole))
            n_bytes, gone, spans, digest, whole = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(whole, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the bytes ``kept``.

    Every byte of the UTF-8 text is removed that lies in a ``length``-byte string which begins at another place
    too, in the same text or another; judged on the input. Null and empty texts have no bytes. Null ids are like
    other ids; rows that repeat id and text are places of their own, so that each removes the other. Other columns
    are not read. An empty table gives an empty table."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(docs, text_col)
    held = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col], text).alias("owner"), text.alias("text"))
    covered = repeated_ranges(held.select("owner", F.col("text").cast("binary").alias("data")), length, gram)
    cuts = covered.groupBy("owner").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("cuts"))
    joined = held.join(cuts.hint("merge"), "owner", "left").select("id", "text", "cuts")
    return joined.mapInArrow(_removed(length), f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
