"""Every operator on small tables: edge rows, planted cases, and brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pelagia.llm import decontamination, line_dedup, near_duplicates, packing, pii, quality_classifier, quality_rules, similar, suffix_dedup, toxicity, url_filter
from pelagia.llm.components import components

WORDS = "the of and a to in river stone light cold walk over green tree house near water long road bird song night field small open deep wind grass hill rain snow door hand".split()
EDGE = [(900, None), (901, ""), (902, " \n \t"), (903, "x" * 3000), (904, "one two"), (904, "one two"), (None, "no id at all here"), (905, "word " * 4000)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "ly", "er"]) for _ in range(n))


def docs(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    return df.select("*", F.lit("clash").alias("id"), F.lit(1).alias("n"), F.lit("k").alias("key"), F.lit(None).cast("string").alias("kept"), F.lit(0).alias("label")) if extra else df


def empty(spark):
    return docs(spark, [(1, "a")]).limit(0)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            parent[max(find(u), find(v))] = min(find(u), find(v))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(2)
    base = [prose(rng, rng.choice([12, 60, 200])).split() for _ in range(12)]
    rows = []
    for k in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(999)}"
        rows.append((k, " ".join(w)))
    rows += EDGE
    got = near_duplicates.near_duplicate_classes(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    cls = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = (t or "", frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {i: i for i in cls}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in cls:
        for j in cls:
            a, b = sets[i], sets[j]
            if i < j and (a[0] == b[0] or (a[1] and len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]))):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert cls == {i: find(i) for i in cls}
    assert near_duplicates.near_duplicate_classes(empty(spark)).count() == 0
    kept = near_duplicates.one_per_class(docs(spark, rows)).collect()
    assert len(kept) == len(set(cls.values())) + 1


def test_near_duplicates_with_a_repeated_block(spark):
    rng = random.Random(17)
    rows = []
    for k in range(24):
        words = [f"w{k}x{rng.randrange(10**6)}" for _ in range(95)]
        block = words[60:]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:60] + block * 60))]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicate_classes(docs(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_near_duplicates_of_rows_that_share_an_id(spark):
    rng = random.Random(19)
    a, b = prose(rng, 40), prose(rng, 40)
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (None, a), (None, "alone")]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *(f"7 AS {c}" for c in ("id", "row", "given", "held", "class", "class_id", "home", "n")))
    got = sorted((str(r["doc_id"]), str(r["class_id"])) for r in near_duplicates.near_duplicate_classes(clash).collect())
    assert got == sorted([("1", "1"), ("2", "1"), ("2", "2"), ("3", "2"), ("3", "2"), ("None", "1"), ("None", "None")])
    kept = near_duplicates.one_per_class(clash)
    assert kept.columns == clash.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", a), ("2", b), ("None", a), ("None", "alone")])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = values[:200], values[50:250]
    sig = near_duplicates.signatures(np.concatenate([a, b]), np.repeat([0, 1], 200), np.ones(400), 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - 150 / 250) < 0.07
    heavy = near_duplicates.signatures(values[:2], np.zeros(2, int), np.array([9.0, 1.0]), 1, 2000)
    assert abs((heavy[0] == values[0]).mean() - 0.9) < 0.03


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(4)
    lines = [prose(rng, rng.choice([4, 9, 25])) for _ in range(40)]
    rows = []
    for k in range(60):
        mine = []
        for _ in range(5):
            line = rng.choice(lines).split()
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = f"q{rng.randrange(99)}"
            mine.append(rng.choice(["", " "]) + " ".join(line))
        rows.append((k, "\n".join(mine)))
    rows += EDGE
    out = line_dedup.deduplicated_lines(docs(spark, rows))
    assert out.columns == [*docs(spark, rows).columns, "n_lines", "n_removed"]
    got = out.collect()
    assert len(got) == len(rows)
    plain = lambda t: [p for p in (re.sub(r"[\x20\x09-\x0d]+", " ", x).strip(" ").lower() for x in (t or "").split("\n")) if p]
    have = sorted({p for i, t in rows if i is not None for p in plain(t)})
    sets = [frozenset(p[i : i + 5] for i in range(max(1, len(p) - 4))) for p in have]
    parent = list(range(len(have)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(have)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    kept = collections.Counter(p for i, t in {(r["doc_id"], r["text"]) for r in got} if i is not None for p in plain(t))
    assert max(kept.values()) == 1
    comps = collections.Counter(find(have.index(p)) for p in kept)
    assert set(comps) == {find(i) for i in range(len(have))}
    assert sum(n > 1 for n in comps.values()) <= 2  # a pair may miss every band
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (900, 901, 902, 904)} == {900: None, 901: "", 902: " \n \t", 904: "one two"}
    assert line_dedup.deduplicated_lines(empty(spark)).count() == 0


def test_line_dedup_compares_all_characters(spark):
    rng = random.Random(14)
    token = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    base = [f"https://{token(12)}.org/{token(30)}" for _ in range(8)] + ["data:image/png;base64," + token(60) for _ in range(4)]
    base += ["".join(chr(0x4E00 + x) for x in [*range(8), *rng.sample(range(20, 900), 40)]) for _ in range(4)] + [f"internationalisation{k} {token(9)} {token(70)}" for k in range(4)]
    near = [x[:-4] + token(4) for x in base]
    rows = [(k, x) for k, x in enumerate(base + near + base)]
    plain = sorted(set(base + near))
    sets = {x: {x[i : i + 5] for i in range(len(x) - 4)} for x in plain}
    parent = {x: x for x in plain}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in plain:
        for y in plain:
            if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                parent[find(y)] = find(x)
    got = collections.Counter(r["text"] for r in line_dedup.deduplicated_lines(docs(spark, rows)).collect() if r["text"])
    assert max(got.values()) == 1
    comps = collections.Counter(map(find, got))
    assert set(comps) == set(map(find, plain)) and len(comps) >= len(base)
    assert sum(n > 1 for n in comps.values()) <= 2  # a pair may miss every band


def test_line_dedup_keeps_one_place_of_equal_lines(spark):
    rows = [(1, "Yes.\nnext one\nYES. "), (2, "yes.\nother"), (2, "other text of the same id\nother"), (3, "a\n\n b\n\nb"), (4, None), (5, "B"), (None, "yes.")]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", *(f"7 AS {c}" for c in ("id", "doc", "row", "drop", "line", "key", "n_lines", "n_removed", "_id", "_drop", "_lines", "_once")))
    out = line_dedup.deduplicated_lines(clash)
    assert len(set(out.columns)) == len(out.columns)
    got = sorted((str(r["doc_id"]), r["text"] or "", r["n_lines"], r["n_removed"], r["key"]) for r in out.collect())
    assert got in (
        sorted([("1", "Yes.\nnext one", 3, 1, 7), ("2", a, 2, x, 7), ("2", b, 2, y, 7), ("3", "a\n\n b\n", 5, 1, 7), ("4", "", 1, 0, 7), ("5", "", 1, 1, 7), ("None", "yes.", 1, 0, 7)])
        for a, x, b, y in (("other", 1, "other text of the same id", 1), ("", 2, "other text of the same id\nother", 0))
    )


def test_line_bands_find_pairs(spark):
    rng = random.Random(18)
    pairs = []
    for k in range(400):
        line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.choice([30, 80, 300])))
        other, part = list(line), set()
        while True:
            sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in (line, "".join(other))]
            if len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1]):
                break
            part = "".join(other)
            other[rng.randrange(len(other))] = rng.choice("0123456789")
        pairs.append((line, part))
    lines = spark.createDataFrame([(2 * k + i, x) for k, p in enumerate(pairs) for i, x in enumerate(p)], "doc bigint, line string")
    keys = {r["doc"]: set(r["keys"]) for r in line_dedup.signatures(lines).collect()}
    found = np.mean([bool(keys[2 * k] & keys[2 * k + 1]) for k in range(len(pairs)) if 2 * k in keys and 2 * k + 1 in keys])
    assert found > 0.9  # pairs just above the threshold


def test_line_classes_of_small_buckets_in_one_round(spark, monkeypatch):
    """Lines of small buckets get their class from all pairs at once; no later round moves them again."""
    rng = random.Random(21)
    token = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    lines = [x + y for x in (token(80) for _ in range(6)) for y in ("", "1", "22")]
    lines += ["abc" * 20, "abc" * 400, token(3), token(4), token(5)]  # one set of shingles; lines of one shingle
    moved = []
    for name in ("_pivot_pairs", "_rest"):
        plain = getattr(similar, name)
        monkeypatch.setattr(similar, name, lambda p, *rest, plain=plain: (moved.append(p.count()), plain(p, *rest))[1])
    out = line_dedup.deduplicated_lines(docs(spark, list(enumerate(lines)))).collect()
    kept = [r["text"] for r in out if r["text"]]
    assert moved == [0, 0, 0]
    assert len(kept) == 6 + 1 + 3 and sum(x.startswith("abcabc") for x in kept) == 1


@pytest.mark.parametrize("size", [4, 5, 6, 8, 9, 12, 16, 24])
def test_line_bands_find_pairs_of_short_lines(spark, size):
    """At the threshold itself: a line and the same with characters more, sets of ``size`` and size / 0.8 shingles."""
    rng = random.Random(size)
    more = size // 4
    whole = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size + 4 + more)) for _ in range(1500)]
    pairs = [(x[: size + 4], x) if k % 2 else (x[more:], x) for k, x in enumerate(whole)]
    lines = spark.createDataFrame([(2 * k + i, x) for k, p in enumerate(pairs) for i, x in enumerate(p)], "doc bigint, line string")
    keys = {r["doc"]: set(r["keys"]) for r in line_dedup.signatures(lines).collect()}
    found = np.mean([bool(keys[2 * k] & keys[2 * k + 1]) for k in range(len(pairs)) if 2 * k in keys and 2 * k + 1 in keys])
    assert found > 0.9


@pytest.mark.parametrize("split", [2, 3000])
def test_suffix_array_and_repeats(spark, monkeypatch, split):
    rng = random.Random(5)
    for wide in (0, 3, 1024) * 30:  # suffix by suffix, bucket by bucket
        monkeypatch.setattr(suffix_dedup, "WIDE", wide)
        x = np.array([rng.randrange(rng.choice([1, 2, 4])) + 1 for _ in range(rng.randrange(1, 80))] + [0], np.int16)
        b = bytes(x.astype(np.uint8))
        order = sorted(range(len(b)), key=lambda i: b[i:])
        assert list(suffix_dedup.suffix_array(x, 258)) == order
        before, common = suffix_dedup.permuted_prefixes(x, np.array(order))
        for i, j in zip(order[1:], order, strict=False):
            assert before[i] == j and common[i] == next(k for k in range(len(b)) if b[i : i + k + 1] != b[j : j + k + 1])
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)  # 2: also the turns of hot minimisers
    shared = [prose(rng, 60) for _ in range(3)]
    rows = [(k, prose(rng, 30) + " é" + rng.choice(shared)[rng.randrange(40) :] + prose(rng, 20)) for k in range(25)]
    rows += [*EDGE, (50, "ab" * 300), (51, "y" * 199), (52, "z" * 200), (53, None)]
    got = suffix_dedup.without_repeats(docs(spark, rows))
    assert got.count() == len(rows)
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[i : i + 200] for _, b in texts for i in range(len(b) - 199))
    expected = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        expected.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in got.drop("kept").collect())
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.choice([15, 30, 60]))) for k in range(20)] + [(90, "tiny"), (91, None), (92, ""), (None, prose(rng, 25))]
    rows, truth = [], set()
    for k in range(60):
        text = prose(rng, rng.choice([0, 40, 300]))
        if k % 3 == 0:
            item, passage = items[k % 20]
            c = list(passage)
            for _ in range(int(len(c) * 0.08) if k % 2 else 0):
                at = rng.randrange(len(c))
                c[at] = rng.choice(["", "q", c[at] + "x"])
            at = rng.randrange(len(text) + 1)
            text = text[:at] + "".join(c).upper().replace(" ", "\n") + text[at:]
            truth.add((k, item))
        rows.append((k, text))
    rows += [*EDGE, (70, "the TINY one")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("id", F.lit(1))
    got = decontamination.contaminated(docs(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth | {(70, 90)}
    for r in got:
        if r["edits"] == 0 and r["item_id"] != 90:
            text = dict(rows)[r["doc_id"]]
            assert text[r["start"] : r["end"]].lower().replace("\n", " ") == dict(items)[r["item_id"]]
    clean = decontamination.without_contaminated(docs(spark, rows), bench)
    assert sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(i) for i, _ in rows if i not in {d for d, _ in truth} | {70})
    assert decontamination.contaminated(empty(spark), bench).count() == 0 and decontamination.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_long_items_and_rare_letters(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "HITS", 50)
    monkeypatch.setattr(decontamination, "CELLS", 200)
    rng = random.Random(21)
    astral = "".join(chr(0x10041 + i) for i in range(16))
    long = prose(rng, 1500)
    changed = list(long)
    for _ in range(300):
        changed[rng.randrange(len(changed))] = "q"
    items = spark.createDataFrame([(1, astral), (2, long), (3, "abcdefghijklmnop" * 3), (4, "abcdefgh" * 40)], "item_id bigint, text string")
    rows = [(1, "so " + astral + " it is"), (2, "abcdefghijklmnop"), (3, "x" * 500 + "".join(changed) + "y" * 500), (4, "abcdefghijklmnop" * 3), (5, "abcdefgh" * 60), (6, None)]
    got = decontamination.contaminated(docs(spark, rows), items).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"] == 0) for r in got} == {(1, 1, True), (3, 2, False), (4, 3, True), (5, 4, True)}


def _least_edits(pattern, text):
    """Edits of the best region of ``text``, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_against_every_alignment(spark):
    """The whole result, every document against every item: items of 1 to 90 characters, many of them of under q, equal
    items of different ids, passages with more and fewer edits than the budget, and texts of one letter."""
    rng = random.Random(31)
    items = [(k, prose(rng, rng.choice([2, 4, 8, 14]))[: rng.choice([17, 25, 40, 90])]) for k in range(14)]
    items += [(50 + k, "".join(rng.choice("abt e\U0001f40d") for _ in range(rng.randrange(1, 8)))) for k in range(25)]
    items += [(80, items[20][1]), (81, "aaaaaaaaaaaa")]
    rows = [(0, ""), (1, None), (2, "a" * 40), (3, "t")]
    for k in range(10, 40):
        c = list(rng.choice(items[:14])[1])
        for _ in range(rng.randrange(0, 2 + len(c) // 10)):
            c[rng.randrange(len(c))] = rng.choice(["", "q", "xz"])
        rows.append((k, prose(rng, rng.choice([0, 3, 12])) + "".join(c) + prose(rng, 3)))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontamination.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    expected = {}
    for d, text in rows:
        for i, item in items:
            budget = min(int(len(item) * decontamination.EDIT_RATE), max(0, (len(item) - decontamination.Q) // decontamination.Q))
            edits = _least_edits(decontamination.plain(item).tolist(), decontamination.plain(text or "").tolist())
            if text and edits <= budget:
                expected[d, i] = edits
    assert got == expected and any(e > 0 for e in got.values())


def test_decontamination_of_a_text_of_a_megabyte(spark):
    """First places of 800 short items, and one long passage, in a text of over 1 MB beside short ones."""
    rng = random.Random(33)
    text = prose(rng, 160_000)
    passage = prose(rng, 60)
    text = text[:700_000] + passage + text[700_000:]
    shorts = sorted({"".join(rng.choice("abcdefghilnorstw ") for _ in range(rng.randrange(2, 8))) for _ in range(800)})
    items = [(k, s) for k, s in enumerate(shorts)] + [(9000, passage)]
    rows = [(1, text), (2, "tree"), (3, text[:5000])]
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"]) for r in decontamination.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(text) > 10**6
    assert got == {(d, i): (t.find(s), t.find(s) + len(s)) for d, t in rows for i, s in items if s in t}


def test_alignment_band_against_full_table():
    rng = random.Random(7)
    for _ in range(40):
        p = [rng.randrange(3) + 1 for _ in range(rng.randrange(3, 12))]
        t = [rng.randrange(3) + 1 for _ in range(30)]
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        edits, *_ = decontamination.aligned([np.array(p, np.uint16)], np.array(t, np.uint16), np.array([-12]), np.array([60]), np.array([0]), np.array([30]))
        assert edits[0] == min(row)


def test_pii_base_and_terms(spark):
    secret = "4111 1111 1111 1111"
    rows = [(k, f"note {k} alpha\nclient Quorvex pays with {secret} today {k}\nother line {prose(random.Random(k), 20)}") for k in range(8)]
    rows += [(20 + k, prose(random.Random(99 + k), 60)) for k in range(30)]
    rows += [*EDGE, (60, "é a@b.cd%e@f.gh 1.2.3.4.5.6.7.8 999.1.1.1 +1 (743) 555-3824 +12 1234567890123"), (61, "1" * 5000 + "@"), (62, "a" * 5000)]
    clash = ["row", "_row", "_terms", "spans", "sanitised", "held", "t", "text_2"]
    found = pii.personal_data(docs(spark, rows).select("*", *(F.lit(7).alias(c) for c in clash)))
    assert sorted(found.columns) == sorted({*docs(spark, rows).columns, *clash})
    got = {r["doc_id"]: r for r in pii.span_digests(found).collect() if r["doc_id"] is not None}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, v):
        digits = re.sub("[^0-9]", "", v)
        luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]

    for i, t in rows:
        if i is not None:
            spans = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t or "") if valid(k, m[0])]
            assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
            assert got[i]["n_email"] == sum(s[0] == "email" for s in spans)
    told = {r["doc_id"]: r["sanitised"] for r in found.collect()}
    # "other" and "line" stand in texts with the value only, so they disclose it too; the prose does not
    assert "Quorvex" not in told[3] and secret not in told[3] and prose(random.Random(3), 20)[-40:] in told[3]
    assert "term" not in got[25]["spans"] and told[25] == dict(rows)[25]
    assert pii.personal_data(empty(spark)).count() == 0


def test_pii_of_a_text_with_very_many_matches(spark):
    """A text of over 1 MB: offsets, the base digest and the sanitised text of 28,000 addresses among numbers; what
    surrounds them has characters of every length, marks of byte order and the private character of the mask."""
    rng = random.Random(22)
    parts = [rng.choice([f"u{rng.randrange(10**6)}@ex{k}.org", str(rng.randrange(10**9)), "é\U0001f40d\ufeff", "\ufeffa\ue000b", "(Wu)"]) for k in range(140_000)]
    text = "\ufeff" + " ".join(parts)
    spans = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found = pii.personal_data(docs(spark, [(1, text), (2, text), (3, text + " x"), *EDGE])).where("doc_id IN (1, 3)")
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(text) > 10**6 and len(spans) > 15_000
    assert [(s["start"], s["end"]) for s in got[1]["spans"] if s["kind"] == "email"] == spans
    order, out, at = sorted(((s["start"], -s["end"], s["kind"]) for s in got[1]["spans"])), [], 0
    for start, end, kind in order:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = -end
    assert got[1]["sanitised"] == "".join(out) + text[at:]


def test_pii_terms_of_the_whole_text(spark):
    rng = random.Random(16)
    rows = [(k, f"Quorvex\n\nby Wu, {k}\nmail <w@quorvex.org> or quorvex.\n{prose(rng, 30)}\n\n(QUORVEX) and Wu") for k in range(8)]
    rows += [(8, rows[0][1])] + [(20 + k, prose(rng, 60) + " mail once" + str(k) + "@a.org by hand") for k in range(60)] + [(90, "Wu alone"), *EDGE]
    found = {r["doc_id"]: r for r in pii.personal_data(docs(spark, rows)).collect()}
    texts = dict(rows)
    for k in range(9):
        spans = sorted((s["start"], s["end"]) for s in found[k]["spans"] if s["kind"] == "term" and s["value"] in ("quorvex", "wu"))
        assert spans == [m.span() for m in re.finditer(r"\S+", texts[k]) if m[0].strip("(),.").lower() in ("quorvex", "wu")] and len(spans) == 5
        assert not re.search("quorvex|wu", found[k]["sanitised"].lower())
    assert not any(s["kind"] == "term" for i in (20, 90) for s in found[i]["spans"])


def test_quality_rules(spark):
    rng = random.Random(8)
    good = [(k, prose(rng, 80)) for k in range(40)]
    bad = [(100 + k, " ".join(w + "%%%" for w in prose(rng, 80).split())) for k in range(10)]
    rows = good + bad + EDGE + [(300, (prose(rng, 30) + "\n") * 4), (301, "# a\n# a\n\n|b|")]
    trusted = spark.createDataFrame([(k,) for k, _ in good[:25]], "doc_id bigint")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs(spark, rows), trusted).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert all(got[k]["kept"] for k, _ in good) and not any(got[k]["kept"] for k, _ in bad)
    assert quality_rules.quality_rules(empty(spark), trusted).count() == 0
    assert quality_rules.quality_rules(docs(spark, rows), trusted.limit(0)).count() == len(rows)


def test_quality_rules_ratio_against_plain_counts(spark):
    rng = random.Random(20)
    texts = ["Ab c9 dd E", "x Ab c9 dd E", "one", "", None, " a\nB  9\n", "#" * 20_000, *(prose(rng, 40) for _ in range(30))]
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return [*w, *zip(w, w[1:], strict=False)]

    trusted = range(7, 20)
    raw, target = (collections.Counter(g for i in which for g in grams(texts[i])) for which in (range(len(texts)), trusted))
    share, prior = sum(target.values()) / sum(raw.values()), quality_rules.PRIOR
    score = lambda g: np.log((target[g] + prior * share) / ((raw[g] + prior) * share))
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, rating int")
    got = quality_rules.quality_rules(df, df.where(F.col("doc_id").isin(*trusted)), buckets=1 << 17).collect()
    close = [abs(r["log_ratio"] - (np.mean([score(g) for g in grams(texts[r["doc_id"]])]) if grams(texts[r["doc_id"]]) else 0)) < 0.003 for r in got]
    assert sum(close) >= len(texts) - 3  # two n-grams may share a bucket
    kept = quality_rules.rated(df, df.where(F.col("doc_id").isin(*trusted))).select("row.*")
    assert kept.columns == df.columns


def test_quality_classifier_learns_and_holds_out(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, 60) if k % 2 else prose(rng, 60).upper()) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows] + [(3, None), (None, 1), (5, 1)], "doc_id bigint, quality int")
    got = quality_classifier.quality_scores(docs(spark, rows + EDGE), labels)
    out = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows) + len(EDGE)
    assert all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _ in rows)
    assert np.mean([out[k]["predicted"] == k % 2 for k, _ in rows if out[k]["held_out"]]) > 0.95
    assert 0 <= out[900]["score"] <= 1 and out[900]["score"] == out[901]["score"]
    assert quality_classifier.quality_scores(docs(spark, rows[:3]), labels.limit(0)).first()["score"] == 0.5
    assert quality_classifier.quality_scores(empty(spark), labels).count() == 0


def test_toxicity_restores_and_scores(spark):
    rng = random.Random(10)
    bad = ["moron", "idiot", "trash"]
    rows = []
    for k in range(300):
        words = prose(rng, 60).split()
        if k % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
    hidden = [(500, "m0r0n"), (501, "i d i o t"), (502, "traaaash"), (503, "1d1ot"), (504, "m.o.r.o.n")]
    rows2 = rows + [(i, prose(rng, 20) + f" {t} stone {t} river {t} " + prose(rng, 20)) for i, t in hidden] + EDGE
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id bigint, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs(spark, rows2), labels).collect()}
    assert all(out[i]["predicted"] == 1 for i, _ in hidden)
    assert np.mean([out[k]["predicted"] == (k % 3 == 0) for k, _ in rows if out[k]["held_out"]]) > 0.95
    assert out[901]["predicted"] == 0
    assert toxicity.toxicity_scores(empty(spark), labels).count() == 0


@pytest.mark.parametrize(
    ("hidden", "read"),
    [("stup" + 30 * "i" + "d", "stupid"), ('"1d10t"', '"idiot"'), ("'1d10t'", "'idiot'"), ("[1d10t]", "[idiot]"), ("(1d10t)", "(idiot)"), ("5tup1d/m0r0n", "stupid/moron"), ("x\u20141d10t", "x\u2014idiot"), ("5t\u00fcp1d", "st\u00fcpid"), ("s  t  u  p  i  d", "stupid"),
     ("s t u p i d.", "stupid."), ("s t u p i d, so", "stupid, so"), ("(s t u p i d)", "(stupid)"), ("@$$", "ass"), ("$100, 2024 (2019) +1 ### ---", "$100, 2024 (2019) +1 ### ---")],
)
def test_toxicity_reads_hidden_words(spark, hidden, read):
    rng = random.Random(15)
    words = [*WORDS, "stupid", "idiot", "moron", "ass"]
    texts = [" ".join(rng.choice(words) for _ in range(20_000))]
    held = spark.createDataFrame([(t,) for t in texts], "text string")
    restore = toxicity.restorer(toxicity.character_model(held))
    assert restore(pa.array([f"the {hidden} stone"])).to_pylist() == [f"the {read} stone"]


@pytest.mark.parametrize(
    ("hidden", "read"),
    [("\u0456d\u0456\u043et", "idiot"), ("m\u043er\u043en", "moron"), ("\uff53\uff54\uff55\uff50\uff49\uff44", "stupid"), ("\uff2d\uff10\uff52\uff10\uff2e", "moron"), ("s\u200bt\u200bu\u2060p\u00adid", "stupid"), ("i/d/i/o/t", "idiot"),
     ("i,d,i,o,t", "idiot"), ("5tup!d!", "stupid!"), ("m0r0n123", "moron123"), ("1d10t!", "idiot!"), ("stone!", "stone!"), ("road 1/2/3 a, b, c and 1,2,3", "road 1/2/3 a, b, c and 1,2,3"),
     ("\u0434\u043e\u0440\u043e\u0433\u0430 usb-\u043a\u0430\u0431\u0435\u043b\u044c \u03bf\u03b4\u03cc\u03c2", "\u0434\u043e\u0440\u043e\u0433\u0430 usb-\u043a\u0430\u0431\u0435\u043b\u044c \u03bf\u03b4\u03cc\u03c2"), ("\u0645\u06cc\u200c\u0631\u0648\u0645", "\u0645\u06cc\u200c\u0631\u0648\u0645")],
)
def test_toxicity_reads_disguised_letters(spark, hidden, read):
    """Letters of other scripts in Latin words, full-width forms, marks without width, more dividers, and digits or
    marks behind a word; whole words of other scripts stay."""
    rng = random.Random(15)
    words = [*WORDS, "stupid", "idiot", "moron", "ass", "1/2", "3,4", "2019", "so!", "hill,", "usb-cable", "caf\u00e9", "\u0434\u043e\u0440\u043e\u0433\u0430"]
    restore = toxicity.restorer(toxicity.character_model(spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(20_000)),)], "text string")))
    assert restore(pa.array([f"the {hidden} hand", None])).to_pylist() == [f"the {read} hand", ""]


def test_character_counts_are_of_code_points(spark):
    texts = ["a\u00e9 \u20ac\u0436\u4e00", "", None, "\u00a3 z9"]
    held = spark.createDataFrame([(t,) for t in texts], "text string").select(F.coalesce("text", F.lit("")).alias("text"))
    expected = collections.Counter()
    for t in texts:
        at = [0, 0, *(toxicity._symbol(c) for c in t or ""), 0, 0]
        expected.update(zip(at, at[1:], at[2:], strict=False))
    got = {(r["cell"] // toxicity.SYMBOLS**2, r["cell"] // toxicity.SYMBOLS % toxicity.SYMBOLS, r["cell"] % toxicity.SYMBOLS): r["n"] for r in toxicity.character_counts(held).collect()}
    assert all(got[k] == n for k, n in expected.items() if k[1:] != (0, 0) and k[:2] != (0, 0))


def test_first_fit_decreasing_against_a_plain_search():
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 50, 200):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room, expected = [], {}
        for item in sorted(range(n), key=lambda i: (-lengths[i], i)):
            b = next((b for b, r in enumerate(room) if r >= lengths[item]), len(room))
            room += [100] if b == len(room) else []
            expected[item] = (b, 100 - room[b])
            room[b] -= lengths[item]
        assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [expected[i] for i in range(n)]


def test_packing(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(12)
    rows = [(k, prose(rng, rng.choice([1, 30, 3000]))) for k in range(40)] + [(i, t) for i, t in EDGE if i != 904] + [(77, "héllo <|endoftext|> 'll   x  ")]
    got = packing.packed(docs(spark, rows), path, group=20).toPandas()
    plain = Tokenizer.from_file(path)
    ids = {i: np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    for r in got.itertuples():
        mine = ids[None if r.doc_id != r.doc_id else r.doc_id]
        assert zlib.crc32(mine[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(mine)
    assert got.length.sum() == sum(map(len, ids.values()))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 1024
    assert packing.packed(empty(spark), path).count() == 0


def test_url_rules_and_propagation(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
    rows = [(1, "http://A.example.com/en/x?q", ""), (2, "http://www.example.com/en/", None), (3, "https://b.net/es/1#t", ""), (4, "http://c.org/a", '<a HREF="http://b.net/es/1">'), (5, "c.org/no", ""), (6, None, None), (7, "http://d.org?x", '<a href=//c.org/>'), (7, "http://d.org?x", ""), (8, "http://x.com", ""), (9, "http://notexample.com/en/", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = url_filter.url_verdicts(df, rules)
    out = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert out[2]["verdict"] == "allow" and out[2]["rule"] == "www.example.com/en/"
    assert out[4]["rule"] is None and out[4]["verdict"] == "block" and out[7]["verdict"] == "block"  # two steps from the blocked host
    assert (out[5]["host"], out[6]["host"], out[5]["verdict"]) == ("", "", "allow") and out[8]["rule"] is None and out[9]["rule"] == "com/"
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    t, u = {"a": 1.0, "b": 0.0, "c": 0.0}, {"a": 0.0, "b": 0.0, "c": 1.0}
    start = dict(t), dict(u)
    out_n, in_n = {"a": 3, "b": 1}, {"b": 2, "c": 2}
    for _ in range(url_filter.ROUNDS):
        t, u = ({x: 0.15 * start[0][x] + sum(0.85 * t[s] * n / out_n[s] for (s, e), n in edges.items() if e == x) for x in "abc"}, {x: 0.15 * start[1][x] + sum(0.85 * u[e] * n / in_n[e] for (s, e), n in edges.items() if s == x) for x in "abc"})
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 1.0)], "host string, trust double, distrust double")
    for r in url_filter.propagate(spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, n bigint"), seeds).collect():
        assert (r["trust"], r["distrust"]) == (pytest.approx(t[r["host"]]), pytest.approx(u[r["host"]]))
    assert url_filter.url_verdicts(df.limit(0), rules).count() == 0
