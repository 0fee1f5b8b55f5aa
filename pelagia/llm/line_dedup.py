"""Fuzzy line deduplication in built-in functions only: MinHash, banding, exact Jaccard, connected components.

Lines are compared in lower case with single blanks, as sets of all their character shingles. Each register of a
line's signature holds its shingle hash that is nearest to the register's mark, the least one under XOR with it. Bands
are runs of registers of which any two share one register, so that few registers make many bands; equal bands propose
pairs. A pair that sizes and parity bits do not rule out is verified by the Jaccard similarity of the sets. Texts are
never shuffled for the signatures: the map side reduces each line to its registers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_of
from .similar import linked_classes, members, parity_words

#: Every run of this many characters is a shingle; a shorter line is one shingle.
SHINGLE = 5
THRESHOLD = 0.8
#: Registers of a signature, and the registers of the first band. All differences of two places are different modulo
#: REGISTERS, so any two of the bands, which follow by shifting, share exactly one register.
REGISTERS = 21
FIRST_BAND = (3, 6, 7, 12, 14)
#: Bands of a line. Registers of small sets often hold the same shingle, so their bands tell less: a line whose
#: registers hold fewer than FEW different shingles has all REGISTERS bands. A pair at exactly the threshold misses all
#: bands with a probability of 0.06 for sets of 4 and 5 shingles, and of 0.05 to 0.08 from 9 shingles on.
BANDS = 12
FEW = 11
#: Parity bits of a line, 64 in each word; more bits rule out more pairs below the threshold.
PARITY_WORDS = 16
#: Shingles that an aggregation takes in one row: most of its time goes to rows and buffers, not to the hashes.
STRIDE = 4
_CODE = 4  # bytes of a character in UTF-32
#: White space within a line, and what tells that a text has other than single blanks.
_WIDE, _HINTS = r"[\x20\x09\x0B-\x0D]+", ("  ", "\t", "\r", "\x0b", "\x0c")


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_lines(text: Column) -> Column:
    """The plain lines of a text, as an array: exploding it computes each of them once."""
    wide = text.contains(_HINTS[0])
    for mark in _HINTS[1:]:
        wide = wide | text.contains(mark)
    single = F.when(wide, F.regexp_replace(text, _WIDE, " ")).otherwise(text)
    return F.transform(F.split(F.lower(single), "\n", -1), lambda line: F.trim(line))


def shingle_set(line: Column) -> Column:
    """The different shingles of a plain line, each as its 64-bit hash."""

    def hashes(coded: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(coded) - (SHINGLE - 1) * _CODE, F.lit(1)), F.lit(_CODE))
        return F.transform(starts, lambda at: F.xxhash64(F.substring(coded, at, F.lit(SHINGLE * _CODE))))

    return F.array_distinct(_let(F.encode(line, "UTF-32"), hashes))


def _strides(lines: DataFrame, *kept: str) -> DataFrame:
    """The shingles of ``lines`` (id, coded, a line in UTF-32) as rows of STRIDE hashes ``h0``, ``h1`` and so on, with
    their place ``at``, and the columns ``kept``. A row at the end of a line repeats its last shingle."""
    last = F.greatest(F.octet_length("coded") - (SHINGLE * _CODE - 1), F.lit(1))
    placed = lines.select(*kept, "id", "coded", F.explode(F.sequence(F.lit(1), last, F.lit(STRIDE * _CODE))).alias("at"))
    hashes = (F.xxhash64(F.substring("coded", F.least(F.col("at") + i * _CODE, last), F.lit(SHINGLE * _CODE))) for i in range(STRIDE))
    return placed.select(*kept, "id", "at", *(h.alias(f"h{i}") for i, h in enumerate(hashes)))


def _marks(n: int) -> list[int]:
    """n 64-bit numbers whose leading bits are spread evenly, so that each register prefers other hashes."""
    return [((i * 2**64 // n) ^ (0x9E3779B97F4A7C15 * (i + 1) % 2**56)) - 2**63 for i in range(n)]


def signatures(lines: DataFrame, bands: int = BANDS) -> DataFrame:
    """``id, doc, n, keys``: each different line of ``lines`` (doc, line) with one row that has it, its occurrences
    and its band keys."""
    coded = lines.select("doc", F.xxhash64("line").alias("id"), F.encode("line", "UTF-32").alias("coded"))
    least = lambda m: F.least(*(F.col(f"h{i}").bitwiseXOR(F.lit(m)) for i in range(STRIDE)))
    nearest = [F.min(least(m)).alias(f"r{i}") for i, m in enumerate(_marks(REGISTERS))]
    signed = _strides(coded, "doc").groupBy("id").agg(F.min("doc").alias("doc"), F.count_if(F.col("at") == 1).alias("n"), *nearest)
    band = lambda b: F.xxhash64(F.lit(b), *(f"r{(place + b) % REGISTERS}" for place in FIRST_BAND))
    held = F.array_distinct(F.array(*(F.col(f"r{i}").bitwiseXOR(F.lit(m)) for i, m in enumerate(_marks(REGISTERS)))))
    more = F.when(F.size(held) < FEW, F.array(*map(band, range(bands, REGISTERS)))).otherwise(F.array().cast("array<bigint>"))
    return signed.select("id", "doc", "n", F.concat(F.array(*map(band, range(bands))), more).alias("keys"))


def _lines_of(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id, line`` of the wanted lines (id, doc), each read in the row that was noted for it."""
    by_doc = wanted.groupBy("doc").agg(F.collect_set("id").alias("ids")).hint("merge")
    found = held.join(by_doc, "doc").select("doc", "ids", F.explode(F.array_distinct(plain_lines(F.col("text")))).alias("line"))
    named = found.where("line <> ''").select("ids", "line", F.xxhash64("line").alias("id"))
    return named.where(F.array_contains("ids", F.col("id"))).select("id", "line").dropDuplicates(["id"])


def _facts(lines: DataFrame) -> DataFrame:
    """``id``, the size ``n`` of each line's shingle set and its parity words."""
    each = lines.select("id", F.explode(shingle_set(F.col("line"))).alias("h"))
    return each.groupBy("id").agg(F.count("*").alias("n"), *parity_words(F.col("h"), PARITY_WORDS))


def _verifier(lines: DataFrame, threshold: float):
    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (lines.select(F.col("id").alias(i), F.col("line").alias(name)).hint("merge") for i, name in (("u", "a"), ("v", "b")))
        sets = pairs.join(a, "u").join(b, "v").select("u", "v", shingle_set(F.col("a")).alias("a"), shingle_set(F.col("b")).alias("b"))
        both = F.size(F.array_intersect("a", "b"))
        return sets.where(both >= F.lit(threshold) * (F.size("a") + F.size("b") - both)).select("u", "v")

    return verify


def line_classes(held: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """``id, n`` of the different lines of ``held`` (doc, text) that occur more than once, and ``id, class`` of those
    that share a bucket with another: lines linked by the similarity have one class, the least id."""
    lines = held.select("doc", F.explode(plain_lines(F.col("text"))).alias("line")).where("line <> ''")
    signed = materialise(signatures(lines, bands))
    member = members(signed.select("id", F.explode("keys").alias("key")))
    repeated = materialise(signed.where("n > 1").select("id", "n"))
    texts = materialise(_lines_of(held, signed.select("id", "doc").join(member.select("id").distinct(), "id")))
    discard(signed)
    facts = materialise(_facts(texts))
    label = linked_classes(member, facts, _verifier(texts, threshold), threshold)
    discard(member, texts, facts)
    return repeated, label


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, counts: bool = True) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and with ``counts`` also ``n_lines`` and ``n_removed`` (where
    ``docs`` has columns of these names, those give way).

    Lines of any length that are equal, or linked through lines of the similarity, form a component; one line of it
    stays in the whole table: its line with the least hash, at its first place in the row of the least id (then least
    text hash) that has it. Lines without text stay. Null and empty texts have one empty line and stay as they are.
    Rows without an id keep their lines, and do not count. Rows that repeat an id and its text are one and are treated
    alike; rows that repeat an id with another text are rows of their own. Other columns are kept as they are, whatever
    their names. An empty table gives an empty table."""
    text = text_of(docs, text_col)
    held = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id"), F.xxhash64(docs[id_col], text).alias("doc"), text.alias("text"))
    repeated, label = line_classes(held.select("doc", "text"), threshold, bands)
    # a line that is not its component's least one goes everywhere; another one that is repeated stays in one place
    gone = label.where("id <> class").select("id", F.lit(True).alias("gone"))
    rule = materialise(gone.union(repeated.join(gone, "id", "left_anti").select("id", F.lit(False))))
    places = held.select("id", "doc", F.posexplode(plain_lines(F.col("text"))).alias("at", "line")).where("line <> ''")
    places = places.select(F.xxhash64("line").alias("line"), "id", "doc", "at")
    met = materialise(places.join(rule.hint("merge").withColumnRenamed("id", "line"), "line"))
    met = materialise(met.groupBy("line", "gone", "id", "doc").agg(F.min("at").alias("first"), F.collect_set("at").alias("ats")))
    home = materialise(met.where("not gone").groupBy("line").agg(F.min(F.struct("id", "doc")).alias("home")))
    settled = met.join(home.hint("merge"), "line", "left")
    drop = F.when(F.col("home.doc") == F.col("doc"), F.array_remove("ats", F.col("first"))).otherwise(F.col("ats"))
    verdict = settled.select("doc", drop.alias("ats")).where(F.size("ats") > 0).groupBy("doc").agg(F.flatten(F.collect_list("ats")).alias("drop"))
    return _rewritten(docs, verdict, id_col, text_col, counts)


def _rewritten(docs: DataFrame, verdict: DataFrame, id_col: str, text_col: str, counts: bool) -> DataFrame:
    names = [c for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    text = text_of(docs, text_col)
    # the columns of the table stay in a struct, so that none can clash with what is joined
    held = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col], text)).alias("doc"))
    joined = held.join(verdict.hint("merge"), "doc", "left")
    lines = F.split(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")), "\n", -1)

    def kept(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drop")
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    new = F.when(F.col("drop").isNotNull(), _let(lines, kept)).otherwise(F.col("row")[text_col])
    fields = F.struct(*((new if c == text_col else F.col("row")[c]).alias(c) for c in names))
    if not counts:
        return joined.select(fields.alias("row")).select("row.*")
    removed = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("bigint")
    return joined.select(fields.alias("row"), F.size(lines).cast("bigint").alias("n_lines"), removed.alias("n_removed")).select("row.*", "n_lines", "n_removed")
