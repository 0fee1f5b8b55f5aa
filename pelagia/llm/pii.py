"""Personal data and the terms that give it away, in built-in functions only.

Patterns find the base kinds. A term, a word of a text that holds such a value, discloses the value where their
pointwise mutual information over the corpus reaches a share of the value's own information: then seeing the term
tells nearly as much as the value. Disclosing terms are spans of kind ``term`` at every place of a text with the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialise

# The patterns of the base kinds. A match begins where a run of its first characters begins or the
# last match ended; saying so, and never giving back, keeps the search linear in long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Share of a value's information from which on a term discloses it, and the documents that must hold both.
SHARE, SUPPORT = 0.8, 3
#: Terms, and rows with their terms, that a broadcast holds at most; more are shuffled.
BROADCAST_TERMS, BROADCAST_ROWS = 200_000, 20_000
_WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Entries that are folded at a time: a fold copies what it has gathered with every entry, so long arrays are folded in
#: pieces of this many, and then the pieces.
FOLD = 64


def _pieces(entries: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(entries) / FOLD).cast("int") - 1, F.lit(0))), lambda i: F.slice(entries, i * FOLD + 1, FOLD))


def _starts(steps: Column) -> Column:
    """Where each match (g, m: the lengths of the gap before it and of itself) starts: running sums."""
    whole = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x["g"] + x["m"])
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    before = lambda pieces: F.aggregate(pieces, none, lambda s, part: F.struct((s["at"] + whole(part)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
    within = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), F.array().cast("array<int>").alias("all")), lambda s, x: F.struct((s["at"] + x["g"] + x["m"]).alias("at"), F.concat(s["all"], F.array(s["at"] + x["g"])).alias("all")), lambda s: s["all"])
    return _let(_pieces(steps), lambda pieces: F.flatten(F.zip_with(pieces, before(pieces), within)))


def _placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost matches; the gaps between them are what a split leaves."""

    def places(pair: Column) -> Column:
        found = F.transform(pair["found"], F.length)
        steps = F.zip_with(F.slice(F.transform(pair["gaps"], F.length), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        return F.zip_with(_let(steps, _starts), pair["found"], lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    matches = _let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) == 0, empty).otherwise(_let(F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found")), places)))
    return matches


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right: every second digit from the right counts double, less 9 above 9."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))))
    return F.aggregate(places, F.lit(0), lambda s, x: s + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.coalesce(F.right(part, F.lit(3)).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, value) of one base kind."""
    found = F.filter(_placed(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
    hint = text.contains(HINTS[kind]) if HINTS[kind] else text.rlike("[0-9]")
    return F.when(hint, found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _term(word: Column) -> Column:
    """The form under which terms are counted: lower case without marks at the ends."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _pairs_of(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value")))


def text_terms(found: DataFrame, texts: int, support: int) -> tuple[DataFrame, DataFrame]:
    """``kind, value, n_value`` of the values that a term can disclose, and ``t, copies, vs, term``: the different
    words of each different text that holds such values, without words that touch a base span. ``found`` has row, t,
    text, spans; ``t`` stands for the text."""
    held = found.where(F.size("spans") > 0)
    reps = held.groupBy("t").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    each = held.join(reps, ["t", "row"]).select("t", "copies", "row", F.explode(_pairs_of(F.col("spans"))).alias("v")).distinct()
    values = each.groupBy("v").agg(F.sum("copies").alias("n_value"), F.count("*").alias("texts")).where((F.col("texts") >= support) & (F.col("n_value") < texts))
    values = materialise(values.select("v", "n_value"))
    wanted = each.join(values.select("v"), "v", "left_semi").groupBy("row", "copies").agg(F.collect_list("v").alias("vs"))
    masked = found.join(wanted.hint("merge"), "row").select("t", "copies", "vs", _sanitised(F.translate("text", "\ue000", " "), F.col("spans"), "\ue000").alias("text"))
    words = F.filter(F.split("text", SPACE, -1), lambda w: ~w.contains("\ue000"))
    terms = masked.select("t", "copies", "vs", F.explode(F.array_distinct(F.transform(words, _term))).alias("term"))
    return values, materialise(terms.where(F.length("term") > 0))


def disclosing(found: DataFrame, values: DataFrame, terms: DataFrame, texts: int, share: float, support: int) -> DataFrame:
    """``v, term``: pairs whose mutual information reaches the share of the value's information, by the documents with
    the value, with the term, and with both. Pairs need ``support`` different texts with both, so that copies of one
    document tell nothing."""
    both = terms.select("term", "copies", F.explode("vs").alias("v")).groupBy("v", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts"))
    information = F.log(F.lit(float(max(texts, 1))) / F.col("n_value"))
    tells = lambda n_term: (information > 0) & (F.log(F.col("both") * F.lit(float(max(texts, 1))) / (F.col("n_value") * F.col(n_term))) >= F.lit(share) * information)
    # a term is in as many documents at least as have it beside a value: most pairs fail by that count alone
    beside = terms.groupBy("term").agg(F.sum("copies").alias("n_beside"))
    both = materialise(both.where(F.col("texts") >= support).join(values, "v").join(beside, "term").where(tells("n_beside")))
    wanted = both.select("term").distinct()
    # a checked number of terms is sent to the words; more of them meet the words in a shuffle
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted.hint("merge")
    words = found.select(F.explode(F.array_distinct(F.transform(F.split("text", SPACE, -1), _term))).alias("term"))
    known = words.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    return both.join(known, "term").where(tells("n_term")).select("v", "term")


def told_places(found: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``row, _terms``: the spans of disclosing terms at all their places in every text that holds the value."""
    told = terms.select("t", "term", F.explode("vs").alias("v")).join(pairs, ["v", "term"], "left_semi").groupBy("t").agg(F.collect_set("term").alias("told"))
    held = found.where(F.size("spans") > 0).join(materialise(told).hint("merge"), "t")
    # words that touch a base span hold its mark
    pieces = held.select("row", F.posexplode(F.regexp_extract_all(_masked(F.col("text"), F.col("spans")), F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), 0)).alias("at", "piece"))
    ends = Window.partitionBy("row").orderBy("at")
    words = pieces.select("row", F.regexp_extract("piece", _WORD, 0).alias("word"), F.sum(F.length("piece")).over(ends).cast("int").alias("end")).where(~F.contains("word", F.lit("\ue000")))
    words = words.select("row", (F.col("end") - F.length("word")).alias("start"), "end", _term(F.col("word")).alias("term"))
    words = words.join(held.select("row", F.explode("told").alias("term")), ["row", "term"])
    return words.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end", F.col("term").alias("value")))).alias("_terms"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, value), base kinds as in KINDS, then ``term``, each by
    place; and ``sanitised``: the text with each span as its kind in brackets, terms as ``[term]``, longer first
    where spans overlap at one place.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Rows with a null id and repeated
    rows are searched and counted each; equal texts count once as support. Other columns are kept, but for ones named
    ``spans`` or ``sanitised``, which give way. An empty table gives an empty table."""
    names = [c for c in docs.columns if c not in ("spans", "sanitised")]
    # the columns of the table stay in a struct, so that none can clash with what is added
    held = docs.select(F.struct(*(docs[c] for c in names)).alias("held"), F.monotonically_increasing_id().alias("row"))
    text = F.coalesce(F.col("held")[text_col].cast("string"), F.lit(""))
    found = materialise(held.withColumn("spans", F.concat(*(_named(base_spans(text, kind), kind) for kind in KINDS))))
    narrow = found.select("row", text.alias("text"), "spans").withColumn("t", F.xxhash64("text"))
    texts = narrow.count()
    values, terms = text_terms(narrow, texts, support)
    pairs = disclosing(narrow, values, terms, texts, share, support)
    told = materialise(told_places(narrow, terms, pairs))
    told = F.broadcast(told) if told.count() <= BROADCAST_ROWS else told.hint("merge")
    done = found.join(told, "row", "left").withColumn("spans", F.concat("spans", F.coalesce("_terms", F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))))
    return done.select("held", "spans", _sanitised(text, F.col("spans")).alias("sanitised")).select("held.*", "spans", "sanitised")


def _apart(spans: Column, cut: bool) -> Column:
    """Spans by place, longer first, without those that begin within an earlier one; with ``cut`` these begin where it
    ends, where something of them is left."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    one = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    kind = "array<struct<kind:string,start:int,end:int>>"

    def step(s: Column, x: Column) -> Column:
        start = F.greatest(x["start"], s["at"]) if cut else x["start"]
        kept = F.struct(x["kind"].alias("kind"), start.alias("start"), x["end"].alias("end"))
        fits = (start >= s["at"]) & (x["end"] > start)
        return F.when(fits, F.struct(x["end"].alias("at"), F.concat(s["all"], F.array(kept)).alias("all"))).otherwise(s)

    def piece(s: Column, part: Column) -> Column:
        got = F.aggregate(part, F.struct(s["at"].alias("at"), F.array().cast(kind).alias("all")), step)
        return _let(got, lambda g: F.struct(g["at"].alias("at"), F.concat(s["all"], F.array(g["all"])).alias("all")))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("all"))
    return F.flatten(F.aggregate(_let(F.transform(order, one), _pieces), none, piece, lambda s: s["all"]))


#: A character before every piece that is decoded, so that none begins with what could be taken for a byte order mark.
_GUARD = b"\x00\x00\x00x"


def _replaced(text: Column, spans: Column, mark) -> Column:
    """The text with each of some spans that are apart and in order as ``mark(span)``. Pieces are cut from the text in a
    code of four bytes a character, so that none is looked for from the beginning."""

    def joined(s: Column) -> Column:
        cut = lambda start, end: F.substring(F.decode(F.concat(F.lit(_GUARD), F.substring(s["coded"], start * 4 + 1, (end - start) * 4)), "UTF-32"), F.lit(2), end - start)
        before = lambda i: F.coalesce(F.get(s["spans"], i - 1)["end"], F.lit(0))
        pieces = F.transform(s["spans"], lambda x, i: F.concat(cut(before(i), x["start"]), mark(x)))
        last = F.element_at(s["spans"], -1)["end"]
        return F.concat(F.array_join(pieces, ""), cut(last, (F.octet_length(s["coded"]) / 4).cast("int")))

    held = F.struct(F.encode(text, "UTF-32").alias("coded"), spans.alias("spans"))
    return F.when(F.size(spans) == 0, text).otherwise(_let(held, joined))


def _sanitised(text: Column, spans: Column, mark: str | None = None) -> Column:
    """The text with each span as ``mark``, or as its kind in brackets."""
    to = lambda x: F.lit(mark) if mark else F.concat(F.lit("["), x["kind"], F.lit("]"))
    return F.when(F.size(spans) == 0, text).otherwise(_let(_apart(spans, False), lambda kept: _replaced(text, kept, to)))


def _masked(text: Column, spans: Column) -> Column:
    """The text with each character of a span as a private one; what the text itself has of that is a blank."""
    clean = F.translate(text, "\ue000", " ")
    return F.when(F.size(spans) == 0, clean).otherwise(_let(_apart(spans, True), lambda kept: _replaced(clean, kept, lambda x: F.repeat(F.lit("\ue000"), x["end"] - x["start"]))))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256`` and ``spans`` as text for each row of
    ``personal_data``; a row without spans has zeros and the digest of the empty text."""
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select(id_col, *counts, F.sha2(_written(F.filter("spans", lambda s: s["kind"] != "term")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
