"""Filter audit, top-k search and centroid clusters against plain forms, with odd rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.llm import clustering, filter_audit, topk_search
from pelagia.llm.vectors import LARGEST

INF, NAN = float("inf"), float("nan")


# --- filter audit --------------------------------------------------------------------------------------------------
def audited(docs, labels):
    """The contract, document by document."""
    good, bad = ({i for i, *y in labels if y[k] == 1} for k in (0, 1))
    parts = {}
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": re.search(r"[#$%&*|]", t) is not None,
            "E": any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in docs),
        }
        parts.setdefault(lang or "", []).append((fails, i in good, i in bad))
    out = []
    for part, rows in parts.items():
        made = []
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if r[0][letter]]
                left = [r for r in left if not r[0][letter]]
                failing = [r for r in rows if r[0][letter]]
                only = [r for r in failing if sum(r[0].values()) == 1]
                made.append([part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), len(only), sum(r[1] for r in gone), sum(r[2] for r in gone)])
        for row in made:
            out.append((*row, sum(r[4] for r in made if r[1][r[2] - 1] == row[1][row[2] - 1])))
    return sorted(out)


def test_filter_audit(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgHIJ") for _ in range(rng.randint(2, 7)))
    texts = [None, "", " \n\t\x0b\x0c\r ", "A", "x" * 200_000, "one\x0btwo\x0cthree\rfour " * 40, " ".join(f"w{i}" for i in range(30_000)), "a#b " * 120, "ÄÖÜ ABC d" * 3]
    texts += [" ".join(word() for _ in range(rng.choice((20, 99, 100, 101, 150)))) + rng.choice(("", "", "|", "%", " $")) for _ in range(40)]
    docs = [(rng.choice((None, rng.randrange(60), rng.randrange(60))), rng.choice(texts), rng.choice(("en", "en", "de", None, ""))) for _ in range(150)]
    docs += [(500 + i, texts[-1], "hot") for i in range(60)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in [*range(0, 60, 2), *range(0, 60, 3), 505, 520]]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").select("*", *(F.lit("clash").alias(c) for c in ("id", "part", "mask", "n", "words", "good", "first", "bare")))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit("clash"))
    got = filter_audit.filter_audit(frame, marks)
    assert sorted(map(tuple, got.collect())) == audited(docs, labels)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys((*filter_audit.MEASURES, "shapley"), "bigint")}
    assert filter_audit.filter_audit(frame.limit(0), marks).count() == 0
    assert filter_audit.filter_audit(frame, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_packed_fields_do_not_overflow():
    """Counts near the largest long stay in their own fields."""
    n = (1 << 62) - 1
    total = n * filter_audit.packed_outcome("ABCDE", 0b00011, True, False) + n * filter_audit.packed_outcome("ABCDE", 0, False, False)
    fields = filter_audit.unpacked(total, "ABCDE")
    assert fields.shape == (120, 5, 6) and set(np.unique(fields)) == {0, n, 2 * n}
    first = fields[0]  # ABCDE: A removes, B finds them gone
    assert first[0].tolist() == [n, n, 0, 0, n, 0] and first[1].tolist() == [n, 0, n, 0, 0, 0] and first[2].tolist() == [n, 0, 0, 0, 0, 0]


# --- vectors -------------------------------------------------------------------------------------------------------
def whole(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(64 * x) for x in v]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("*", *(F.lit("clash").alias(c) for c in ("row", "dim", "components", "block", "part", "score", "rank", "cluster", "n", "name")))


def odd_vectors(rng, dim):
    small = lambda n: [float(np.float32(rng.uniform(-0.6, 0.6))) for _ in range(n)]
    rows = [(i, small(dim)) for i in range(120)]
    rows += [(200 + i, [0.25] * dim) for i in range(40)]  # one vector, many times
    rows += [(20, small(dim)), (20, rows[20][1]), (40, small(3)), (41, small(3)), (None, small(dim)), (None, rows[3][1]), (300, []), (320, [])]
    rows += [(60, None), (80, [None] * dim), (81, [NAN] + small(dim - 1)), (100, [INF] + small(dim - 1)), (101, [0.0] * dim), (140, [-5.0] * dim), (141, [1e4] + [-1e4] * (dim - 1))]
    return rows


@pytest.mark.parametrize(("k", "block"), [(20, 32768), (7, 40), (300, 64)])
def test_top_products(spark, k, block):
    rows = odd_vectors(random.Random(k), 6)
    kept = [(n, i, v) for n, (i, v) in enumerate((i, whole(v)) for i, v in rows) if v is not None]
    expected = []
    for n, i, q in kept:
        if i is not None and i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for m, j, v in kept if m != n and len(v) == len(q))[:k]
            expected += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(found, 1)]
    got = topk_search.highest_products(embeddings(spark, rows), k, block=block, group=5)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_top_products_of_no_rows(spark):
    frame = embeddings(spark, odd_vectors(random.Random(1), 4))
    assert topk_search.highest_products(frame.limit(0)).count() == 0
    assert topk_search.highest_products(frame.where("vec_id = 7")).count() == 0
    assert topk_search.highest_products(frame.where("vec_id = 120 OR vec_id IS NULL AND false")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        topk_search.highest_products(embeddings(spark, [(20, [float(LARGEST)]), (1, [1.0])])).count()


def test_sliced_sums_are_inner_products():
    rng = np.random.default_rng(5)
    for n, dim, size in ((1, 1, 2), (64, 3, 9), (65, 17, 300), (1000, 64, 40), (130, 5, LARGEST)):
        x, q = rng.integers(-size, size, (n, dim)), rng.integers(-size, size, dim)
        slices, shift = topk_search.slices_of(x)
        score = topk_search.score_slices(slices, ~slices, q)
        base = shift * int(q.sum()) + int(q[q < 0].sum()) * ((1 << slices.shape[1]) - 1)
        assert [v + base for v in topk_search._values(score, np.arange(n))] == [int(sum(int(a) * int(b) for a, b in zip(r, q, strict=True))) for r in x]


def clustered(rows, k, rounds, dim):
    kept = [(i, v) for i, v in ((i, whole(v)) for i, v in rows) if v is not None and len(v) == dim]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    give = lambda: [min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        at = give()
        for c in set(at):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = give()
    rows = [(i, a, away(v, centroids[a])) for (i, v), a in zip(kept, at, strict=True)]
    return [(i, a, d, sum(e for _, b, e in rows if b == a), sum(e for *_, e in rows), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest()) for i, a, d in rows]


@pytest.mark.parametrize(("k", "bits"), [(16, 6), (5, 1), (16, 3), (400, 4)])
def test_centroid_clusters(spark, k, bits):
    rows = odd_vectors(random.Random(7), 6)
    got = clustering.centroid_clusters(embeddings(spark, rows), k, 3, 6, bits=bits)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, clustered(rows, k, 3, 6)))


def test_clusters_of_no_rows(spark):
    frame = embeddings(spark, odd_vectors(random.Random(1), 6))
    assert clustering.centroid_clusters(frame.limit(0), dim=6).count() == 0
    assert clustering.centroid_clusters(frame).count() == 0  # none has 64 components


def test_few_full_vectors_are_fetched():
    """Intervals decide for most rows where vectors lie in groups; the result is that of all distances."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (8, 16))
    x = centres[rng.integers(0, 8, 3000)] + rng.integers(-10, 10, (3000, 16))
    least, greatest = x.min(0), x.max(0)
    cells = clustering.Cells([[int(a + (z - a + 1) * i // 16) for i in range(1, 16)] for a, z in zip(least, greatest, strict=True)], list(least), list(greatest))
    found, fetched = clustering.nearest(cells.of(x), lambda rows: x[rows], *cells.tables(centres), centres)
    assert (found == ((x[:, None] - centres) ** 2).sum(2).argmin(1)).all() and fetched < 300
