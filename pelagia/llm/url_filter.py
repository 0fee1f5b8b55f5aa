"""URL verdicts from host and path rules, and trust propagated over the links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

DAMPING, ROUNDS = 0.85, 20
#: A host is blocked where its distrust exceeds its trust by more than this.
THRESHOLD = 0.0
MAX_RULES = 1000
_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LINK = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"'>\s]+)"""
_URL = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), *_LETTERS)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The struct (size, rule, action) of the longest rule (host, path, action) that fits, else null."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(action).alias("action")))
        for h, p, action in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,action:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links from the pages of one host to another host; ``pages`` has host and html."""
    link = F.explode(F.regexp_extract_all("html", F.lit(_LINK)))
    edges = pages.where("host <> ''").select(F.col("host").alias("src"), link.alias("link"))
    edges = edges.select("src", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return edges.where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` from ``seeds`` of the same columns (each summing to 1 or 0): trust follows links,
    distrust follows them backwards. What reaches a host without further links stays there. Without links every host
    keeps its seed; a host that only links or is linked has a row too; null hosts do not occur in ``edges``."""
    sums = edges.groupBy("src").agg(F.sum("n").alias("out")), edges.groupBy("dst").agg(F.sum("n").alias("in"))
    weighted = materialise(edges.join(sums[0], "src").join(sums[1], "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("on"), (F.col("n") / F.col("in")).alias("back")))
    if weighted.isEmpty():
        return seeds
    start = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    now, nothing = seeds, F.lit(0.0)
    for turn in range(rounds):
        forth = weighted.join(now, weighted["src"] == now["host"]).select(F.col("dst").alias("host"), (F.col("trust") * F.col("on") * damping).alias("trust"), nothing.alias("distrust"))
        back = weighted.join(now, weighted["dst"] == now["host"]).select(F.col("src").alias("host"), nothing.alias("trust"), (F.col("distrust") * F.col("back") * damping).alias("distrust"))
        now = start.union(forth).union(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if turn % 5 == 4 or turn == rounds - 1:
            now = materialise(now)
    return now


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trusted: Sequence[str] = (), blocked: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``.

    The longest rule that fits decides (at most MAX_RULES rules of host, path prefix and ``allow`` or ``block``).
    Other pages get their host's verdict: block where distrust exceeds trust by more than ``threshold``. Seeds are
    the named hosts and those of whose pages more than half are allowed or blocked by rules. A null url, or one
    without ``://``, has an empty host and path and no seeds: allow. Null html has no links. Null ids and repeated
    rows are judged each. Other columns are not read. An empty table gives an empty table."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    judged = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"), pages[html_col].cast("string").alias("html"))
    judged = judged.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    share = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("found.action") == "allow").alias("good"), F.count_if(F.col("found.action") == "block").alias("bad"))
    seeds = share.select("host", (F.col("host").isin(*trusted) | (2 * F.col("good") > F.col("n"))).cast("double").alias("trust"), (F.col("host").isin(*blocked) | (2 * F.col("bad") > F.col("n"))).cast("double").alias("distrust"))
    total = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    seeds = materialise(seeds.select("host", (F.col("trust") / (total["t"] or 1.0)).alias("trust"), (F.col("distrust") / (total["d"] or 1.0)).alias("distrust")))
    scores = propagate(host_edges(judged.select("host", "html")), seeds)
    scored = judged.drop("html").join(scores, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    verdict = F.coalesce("found.action", F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")
