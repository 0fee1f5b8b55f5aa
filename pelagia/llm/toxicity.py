"""Toxicity of text after noisy-channel deobfuscation.

A writer's channel swaps letters for look-alikes, repeats them or spaces them out. Every stretch of text where
the channel may have acted is a lattice of characters; Viterbi decoding under a character trigram model, whose
counts cover all documents, restores the likeliest reading. A hashed linear model scores the restored text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .linear import SAMPLE, Ftrl, held_out, scored, train
from .words import _BYTE, blocks, mix, powers, words

THRESHOLD = 0.5
# The letters that a look-alike character may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "h", "€": "e", "£": "l",
}
# Letters of other scripts that look like Latin ones (lower case).
OTHER_LETTERS = {
    "а": "a", "в": "b", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɡ": "g", "ɑ": "a",
}
#: Negative log-likelihoods of the channel's acts: a look-alike for a letter, a repeated letter, a spaced word's gap.
SWAP, REPEAT, GAP, KEEP = 1.5, 2.0, 0.7, 6.0
#: The same for a mark, not a blank, between two single characters that hides nothing.
DIVIDED = 3.0
#: The same for digits and exclamation marks behind a word that are no letters of it.
BEHIND = 3.0

# Symbols of the language model, one a code point: 0 word boundary, 1-26 letters, 27 digit, 28 other ASCII and marks,
# 29 other Latin letters, 30 Greek and Cyrillic, 31 all else.
SYMBOLS = 32
_SYMBOL = np.full(256, 28, np.int64)
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 0
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
_SYMBOL[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_SYMBOL[ord("0") : ord("9") + 1] = 27
# first bytes of longer code points; those that follow count for nothing
_SYMBOL[0xC3:0xCE], _SYMBOL[0xCE:0xD5], _SYMBOL[0xD5:] = 29, 30, 31


def _symbol(ch: str) -> int:
    code = ord(ch)
    return int(_SYMBOL[code]) if code < 128 else 28 if code < 0xC0 else 29 if code < 0x380 else 30 if code < 0x540 else 31


def character_counts(docs: DataFrame) -> DataFrame:
    """``cell, n``: occurrences of every symbol trigram in all texts; texts begin and end with a boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(SYMBOLS**3, np.int64)
            for _, _, data, offsets in blocks(batch.column("text")):
                lead = (data & 0xC0) != 0x80
                places = np.concatenate([[0], np.cumsum(lead)])[offsets]
                at = np.insert(_SYMBOL[data[lead]], np.repeat(places, 2), 0)
                total += np.bincount((at[:-2] * SYMBOLS + at[1:-1]) * SYMBOLS + at[2:], minlength=SYMBOLS**3)
            cell = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    return docs.select("text").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame) -> np.ndarray:
    """Negative log-likelihood of a symbol after two others; at most SYMBOLS**3 counts come to the driver."""
    counts = np.zeros(SYMBOLS**3)
    for row in character_counts(docs).collect():
        counts[row["cell"]] = row["n"]
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    pairs = counts.sum(axis=0)
    backed = (pairs + 0.5 * (pairs.sum(axis=0) + 1) / (pairs.sum() + SYMBOLS)) / (pairs.sum(axis=1, keepdims=True) + 0.5)
    return -np.log((counts + 5.0 * backed[None]) / (counts.sum(axis=2, keepdims=True) + 5.0))


def _lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each place of the stretch the readings and their channel costs. Letters of other scripts stand for Latin
    ones in words with a Latin letter only."""
    places: list[list[tuple[str, float]]] = []
    foreign = {i for word in _WORD.finditer(stretch) if _LATIN.search(word[0]) for i in range(*word.span()) if stretch[i] in OTHER_LETTERS}
    i = 0
    while i < len(stretch):
        ch = stretch[i]
        j = i + 1
        while j < len(stretch) and stretch[j] == ch:
            j += 1
        run = j - i
        letters = OTHER_LETTERS[ch] if i in foreign else LOOK_ALIKES.get(ch, "")
        if ch.isalpha() and i not in foreign:
            readings = [(ch * min(run, 2), REPEAT * (run > 2)), (ch, REPEAT)] if run > 1 else [(ch, 0.0)]
        elif letters:
            readings = [(ch * run, KEEP)] + [(x * k, SWAP + (REPEAT if k < run else 0.0)) for x in letters for k in {1, min(run, 2)}]
        else:
            readings = [(ch * run, 0.0)] + ([("", GAP)] if i and j < len(stretch) else [])
        places.append(readings)
        i = j
    return places


def _viterbi(places: list[list[tuple[str, float]]], costs: np.ndarray) -> tuple[float, str]:
    """The cheapest path through a lattice between word boundaries; states are the last two symbols, and a path is
    kept as its last reading and the path before."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in [*places, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (so_far, path) in best.items():
            for reading, cost in readings:
                p, q, total = a, b, so_far + cost
                for ch in reading:
                    r = _symbol(ch)
                    total += costs[p, q, r]
                    p, q = q, r
                old = after.get((p, q))
                if old is None or total < old[0]:
                    after[p, q] = (total, (path, reading))
        best = after
    cost, path = min(best.values(), key=lambda found: found[0])
    parts = []
    while path:
        path, reading = path
        parts.append(reading)
    return cost, "".join(reversed(parts))[:-1]


#: Letters and digits of any script; the marks that look like letters; the marks that divide letters.
_ALNUM, _MARKS, _DIVIDERS = r"[^\W_]", r"@$!|+(*#€£", r".\-_"
_LETTER = r"[^\W\d_]"
_OTHER = "".join(OTHER_LETTERS)
#: A Latin letter beside a look-alike of another script; words between dividers.
_MIXED, _LATIN, _WORD = rf"(?:[a-z][{_OTHER}]|[{_OTHER}][a-z])", re.compile("[a-z]"), re.compile(rf"[^{_DIVIDERS}\s]+")
_DIVIDER = rf"(?:[ \t]+(?:[{_DIVIDERS}]+[ \t]+)?|[{_DIVIDERS}*]+[ \t]*|[/,;:~])"
_SINGLE = rf"(?:{_ALNUM}|[{_MARKS}])"
#: Where the channel may have acted: single characters in a row; runs of letters, look-alikes and dividers that are
#: not plain words. Every other mark, and white space, ends a run.
_SPACED = re.compile(rf"(?<!{_ALNUM})(?<!{_ALNUM}[{_DIVIDERS}*'’/:@]){_SINGLE}(?:{_DIVIDER}{_SINGLE}(?!{_ALNUM})){{2,}}")
_RUN = rf"[\w{_MARKS}.\-]"
_STRETCH = re.compile(rf"(?P<spaced>{_SPACED.pattern})|(?<!{_RUN})(?![{_MARKS}](?:{_SPACED.pattern}))(?={_RUN}*?(?:[\d_{_MARKS}.\-]|{_MIXED}|({_LETTER})\2\2)){_RUN}+")
#: What makes a run suspicious: letters around or behind or before look-alikes or dividers, or a letter three times.
_HIDDEN = re.compile(rf"{_LETTER}[\d{_MARKS}{_DIVIDERS}]+{_LETTER}|^[\d{_MARKS}]+{_LETTER}|{_LETTER}[\d@$!|+(]$|{_MIXED}|({_LETTER})\1\1")
_BEHIND = re.compile(r"[\d!]*?(!*)$")
#: Marks without width between characters that Latin words are written with; the full-width forms of ASCII.
_NO_WIDTH = "\u00ad\u034f\u200b\u200c\u200d\u2060\ufeff"
_INVISIBLE = re.compile(rf"(?<=[\da-zA-Z{_MARKS}{_OTHER}])[{_NO_WIDTH}]+(?=[\da-zA-Z{_MARKS}{_OTHER}])")
_FULL_WIDTH = {code: code - 0xFEE0 for code in range(0xFF01, 0xFF5F)}
_DISGUISED = rf"[{_NO_WIDTH}\x{{ff01}}-\x{{ff5e}}]"

#: Runs without any letter that are no words: numbers with their marks, one mark repeated.
_NUMERAL = re.compile(rf"[{_MARKS}]*\d[\d.\-_]*[{_MARKS}]*")
_SUSPECT = (
    r"\pL[0-9@$!|+(*#\x{20ac}\x{a3}._\-]+\pL|(?:^|[^\pL\pN])[0-9@$!|+(*#\x{20ac}\x{a3}]+\pL|\pL[0-9@$!|+(]|[^\x00-\x7f]{3}"
    r"|[@$!|+(*#\x{20ac}\x{a3}][0-9@$!|+(*#\x{20ac}\x{a3}]|[0-9][@$!|+(*#\x{20ac}\x{a3}]"
    r"|(?:^|[^\pL\pN])[\pL\pN@$!|+(*#\x{20ac}\x{a3}][ \t.\-_*/,;:~]+[\pL\pN@$!|+(*#\x{20ac}\x{a3}][ \t.\-_*/,;:~]+[\pL\pN@$!|+(*#\x{20ac}\x{a3}]|"
) + f"{_MIXED}|" + "|".join(f"{c}{{3}}" for c in "abcdefghijklmnopqrstuvwxyz")


def _decode_spaced(stretch: str, costs: np.ndarray) -> str:
    """One spaced word, or the row of single characters as it is. A divider counts once, however long it is."""
    letters, dividers, at = [stretch[0]], [], 1
    for found in re.finditer(rf"({_DIVIDER})({_SINGLE})(?!{_ALNUM})", stretch[1:]):
        dividers.append(found[1].strip(" \t")[:1] or " ")
        letters.append(found[2])
    joined = _viterbi(_lattice("".join(letters)), costs)
    plain = letters[0] + "".join(map("".join, zip(dividers, letters[1:], strict=True)))
    as_it_is = _viterbi([[(ch, 0.0)] for ch in plain], costs)
    left = as_it_is[0] + DIVIDED * sum(ch != " " for ch in dividers)
    return joined[1] if joined[0] + GAP * len(dividers) <= left else stretch


def decode(stretch: str, costs: np.ndarray) -> str:
    """The likeliest reading of one stretch (lower case). A row of single characters is one spaced word or is
    left as it is; marks at the ends that only divide or enclose stay; a run that hides nothing stays."""
    if _SPACED.fullmatch(stretch):
        return _decode_spaced(stretch, costs)
    core = stretch.strip("._-")
    if not core:
        return stretch
    at = stretch.index(core)
    head, tail = stretch[:at], stretch[at + len(core) :]
    if re.search(_LETTER, core):
        hidden = _HIDDEN.search(core)
    else:
        hidden = len(set(core)) > 1 and len(core) > 2 and any(ch in LOOK_ALIKES and not ch.isdigit() for ch in core) and not _NUMERAL.fullmatch(core)
    return head + _reading(core, costs) + tail if hidden else stretch


def _reading(core: str, costs: np.ndarray) -> str:
    """The cheapest reading of a run, whole or without the digits and exclamation marks behind it."""
    found = [_viterbi(_lattice(core), costs)]
    behind = _BEHIND.search(core)
    for end in {behind.start(), behind.start(1)} - {0, len(core)}:
        cost, read = _viterbi(_lattice(core[:end]), costs)
        found.append((cost + BEHIND, read + core[end:]))
    return min(found, key=lambda f: f[0])[1]


def _undisguised(texts: pa.Array) -> pa.Array:
    """Full-width forms as ASCII; marks without width out of words in Latin letters."""
    some = pc.match_substring_regex(texts, _DISGUISED)
    if not pc.any(some).as_py():
        return texts
    return pc.replace_with_mask(texts, some, pa.array([_INVISIBLE.sub("", t.translate(_FULL_WIDTH)) for t in texts.filter(some).to_pylist()], texts.type))


def restorer(costs: np.ndarray):
    """A function from a batch of texts to their restored, lower-case forms; readings are remembered per task."""
    known: dict[str, str] = {}

    def read(stretch: str) -> str:
        found = known.get(stretch)
        if found is None:
            if len(known) > 200_000:
                known.clear()
            found = decode(stretch, costs)
            if len(stretch) <= 64:
                known[stretch] = found
        return found

    def reading(match: re.Match[str]) -> str:
        stretch = match[0]
        # an opening bracket is a look-alike too, but not where it is closed again
        if stretch[0] == "(" and not match["spaced"] and match.string[match.end() : match.end() + 1] == ")":
            return "(" + read(stretch[1:]) if len(stretch) > 1 else stretch
        return read(stretch)

    def restore(texts: pa.Array) -> pa.Array:
        texts = pc.utf8_lower(_undisguised(pc.fill_null(texts, "")))
        suspects = np.flatnonzero(pc.match_substring_regex(texts, _SUSPECT).to_numpy(zero_copy_only=False))
        if not len(suspects):
            return texts
        mask = np.zeros(len(texts), bool)
        mask[suspects] = True
        mended = pa.array([_STRETCH.sub(reading, t) for t in texts.take(pa.array(suspects)).to_pylist()], texts.type)
        return pc.replace_with_mask(texts, pa.array(mask), mended)

    return restore


PREFIXES = range(3, 9)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without marks at their ends, and the first 3 to 8 bytes of each."""
    letters = ((data | 32) >= ord("a")) & ((data | 32) <= ord("z")) | (data >= 128)
    found = words(np.where(letters, data, 32).astype(np.uint8), offsets)
    length = found.end - found.start
    parts, total = [(mix(found.hash + np.uint64(1)), found.doc)], np.zeros(len(length), np.uint64)
    for k, power in enumerate(powers(PREFIXES.stop)[: PREFIXES.stop - 1]):
        long = np.flatnonzero(length > k)
        total[long] += _BYTE[data[found.start[long] + k]] * power
        if k + 1 in PREFIXES:
            parts.append((mix(total[long] + np.uint64(k + 100)), found.doc[long]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.ones(len(offsets) - 1)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted`` (1 from the threshold on).

    Only the text is an input of the score. Null and empty texts get the score of the bias alone; a null id
    counts as not held out; repeated rows get equal rows; other columns are not read; without labels every
    score is 0.5 and ``predicted`` 1. An empty table gives an empty table."""
    held = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    restore = restorer(character_model(held))
    model = Ftrl(alpha=0.3, l1=3.0, l2=1.0, epochs=4)
    weights = train(held, labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")), features, restore, model, sample, damped=True)
    return scored(held, weights, features, restore, damped=True).select(
        F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
