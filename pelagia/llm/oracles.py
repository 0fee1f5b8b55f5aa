"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from .near_duplicates import SIZE
from .near_duplicates import THRESHOLD as ALIKE
from .suffix_dedup import LENGTH
from .url_filter import DAMPING, ROUNDS, THRESHOLD

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _host(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {_LETTERS})"


def url_verdicts(rules: Sequence[tuple[str, str, str]]) -> str:
    """Rules by length, then trust and distrust in as many rounds as the operator makes."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    pick = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, a)}'" for h, p, a in order) + " END"
    link = r"(?i)\bhref\s*=\s*[\"'']?((?:[a-z][a-z0-9+.\-]*:)?//[^\"''>\s]+)"
    parts = [
        f"place AS (SELECT page_id, html, {_host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)",
        f"judged AS (SELECT page_id, host, path, {pick(lambda h, p, a: h + p)} AS rule, {pick(lambda h, p, a: a)} AS action FROM place)",
        f"link AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS l FROM place WHERE host <> '')",
        f"edge AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {_host(chr(40) + 'CASE WHEN starts_with(l, ' + chr(39) + '//' + chr(39) + ') THEN concat(' + chr(39) + 'x:' + chr(39) + ', l) ELSE l END' + chr(41))} AS dst FROM link) WHERE dst <> '' AND src <> dst GROUP BY 1, 2)",
        "way AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM edge)",
        "share AS (SELECT host, CAST(2 * count(*) FILTER (action = 'allow') > count(*) AS DOUBLE) AS t, CAST(2 * count(*) FILTER (action = 'block') > count(*) AS DOUBLE) AS d FROM judged WHERE host <> '' GROUP BY 1)",
        "seed AS (SELECT host, t / coalesce(nullif(sum(t) OVER (), 0), 1) AS t, d / coalesce(nullif(sum(d) OVER (), 0), 1) AS d FROM share)",
        "r0 AS (SELECT * FROM seed)",
    ]
    for k in range(ROUNDS):
        start = f"SELECT host, t * {1 - DAMPING!r} AS t, d * {1 - DAMPING!r} AS d FROM seed"
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT host, sum(t) AS t, sum(d) AS d FROM ({start} UNION ALL SELECT dst, t * forth * {DAMPING}, 0 FROM way JOIN r{k} ON src = host UNION ALL SELECT src, 0, d * back * {DAMPING} FROM way JOIN r{k} ON dst = host) GROUP BY 1)")
    parts.append(f"score AS (SELECT * FROM r{ROUNDS} WHERE (SELECT count(*) FROM edge) > 0 UNION ALL SELECT * FROM seed WHERE (SELECT count(*) FROM edge) = 0)")
    verdict = f"coalesce(action, CASE WHEN coalesce(d, 0) - coalesce(t, 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END)"
    return f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, {verdict} AS verdict, round(coalesce(t, 0), 12) AS trust, round(coalesce(d, 0), 12) AS distrust FROM judged LEFT JOIN score USING (host)"


def near_duplicate_classes() -> str:
    """All texts that share a shingle, their similarity, and the components of the links."""
    parts = [
        "t AS (SELECT lower(coalesce(text, '')) AS body, min(doc_id) AS first FROM documents GROUP BY 1)",
        "w AS (SELECT first, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t)",
        f"s AS (SELECT DISTINCT first, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {SIZE - 1}], ' ') FOR i IN range(1, len(w) - {SIZE - 2})] END) AS g FROM w)",
        "n AS (SELECT first, count(*) AS n FROM s GROUP BY 1)",
        "p AS (SELECT a.first AS u, b.first AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.first < b.first GROUP BY 1, 2)",
        f"l AS (SELECT u, v FROM p JOIN n x ON x.first = u JOIN n y ON y.first = v WHERE k >= {ALIKE} * (x.n + y.n - k))",
        "e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l)",
        "r AS (SELECT first AS u, first AS v FROM t UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)",
        "c AS (SELECT u, min(v) AS class_id FROM r GROUP BY 1)",
    ]
    return f"WITH RECURSIVE {', '.join(parts)} SELECT doc_id, class_id FROM documents JOIN t ON lower(coalesce(text, '')) = body JOIN c ON c.u = t.first"


def without_repeats() -> str:
    """Every window of every text, those that begin twice, and what is left between their runs."""
    parts = [
        "d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)",
        f"w AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d))",
        "again AS (SELECT r, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k))",
        f"run AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM again))",
        f"span AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS z FROM run GROUP BY r, run)",
        "piece AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM span UNION ALL SELECT r, coalesce(max(z), 0), max(len(h) // 2) FROM d LEFT JOIN span USING (r) GROUP BY r)",
        "kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM piece JOIN d USING (r) GROUP BY r)",
        "gone AS (SELECT r, sum(z - a) AS n, count(*) AS spans FROM span GROUP BY r)",
    ]
    return f"WITH {', '.join(parts)} SELECT doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256 FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)"


def filter_audit() -> str:
    """The failures of every document as letters, counted by part, and all orders over these counts."""
    letters = "SELECT unnest(['A', 'B', 'C', 'D', 'E'])"
    earlier = "translate(fails, left(filter_order, step - 1), '')"
    fails, out = "contains(fails, letter)", "length(" + earlier + ") < length(fails)"
    count = lambda test: f"CAST(coalesce(sum(n) FILTER ({test}), 0) AS BIGINT)"
    parts = [
        "w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)",
        "y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) = 1 AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) = 1 AS bad FROM labels GROUP BY 1)",
        "f AS (SELECT doc_id, part, concat(CASE WHEN len(w) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails FROM w)",
        "g AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n FROM f LEFT JOIN y USING (doc_id) GROUP BY ALL)",
        f"l(x) AS ({letters})",
        "o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x) JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x))",
        "s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o))",
        f"r AS (SELECT part, filter_order, step, letter, {count(f'NOT {fails} AND NOT {out}')} AS kept, {count(f'{fails} AND NOT {out}')} AS removed, {count(f'{fails} AND {out}')} AS redundant, {count('fails = letter')} AS unique_fails, {count(f'good AND {fails} AND NOT {out}')} AS good_lost, {count(f'bad AND {fails} AND NOT {out}')} AS toxic_lost FROM g CROSS JOIN s GROUP BY ALL)",
    ]
    return f"WITH {', '.join(parts)} SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"


_WHOLE = "SELECT row_number() OVER () AS r, vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


def highest_products(k: int = 20, every: int = 20) -> str:
    """Every query against every other row."""
    pair = f"SELECT a.r, a.vec_id AS query_id, b.vec_id, b.r AS other, CAST(coalesce(list_inner_product(a.v, b.v), 0) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % {every} = 0"
    return f"WITH v AS ({_WHOLE}) SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS INTEGER) AS rank FROM ({pair})) WHERE rank <= {k}"


def centroid_clusters(k: int = 16, rounds: int = 3, dim: int = 64, seed: str = "1") -> str:
    """The rounds one after the other."""
    parts = [f"v AS MATERIALIZED (SELECT * FROM ({_WHOLE}) WHERE len(v) = {dim})", f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY name, v) - 1 AS INTEGER) AS c, v AS m FROM (SELECT *, sha256(concat('{seed}:', vec_id)) AS name FROM v) ORDER BY name, v LIMIT {k})"]
    distance = "list_inner_product(v, v) - 2 * list_inner_product(v, m) + list_inner_product(m, m)"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, d, m FROM (SELECT r, vec_id, v, c, m, {distance} AS d FROM v CROSS JOIN c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            parts.append(f"n{i} AS (SELECT c, list(f ORDER BY i) AS m FROM (SELECT c, i, floor(sum(x) / count(*)) AS f FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i) GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN n{i} n USING (c))")
    total = lambda over: f"CAST(sum(d) OVER ({over}) AS BIGINT)"
    return f"WITH {', '.join(parts)} SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, {total('PARTITION BY c')} AS cluster_inertia, {total('')} AS inertia, sha256(array_to_string([CAST(x AS BIGINT) FOR x IN m], ',')) AS centroid_sha256 FROM a{rounds}"
