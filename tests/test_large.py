"""Groups, documents and files too large for a task: the forms in pieces give the rows of the plain ones."""

import glob
import hashlib
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pelagia import queries
from pelagia.operators import asof, quality, quantiles, segments, timeline
from pelagia.operators.timeline import DEP
from pelagia.plans import jobs
from pelagia.sources import ordered, tables
from pelagia.streaming import stateful


@pytest.fixture(scope="module")
def hot(spark):
    """One long deployment with bursts, repeated times, stops and missing values; small ones; one without a name."""
    rng = random.Random(8)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 0, 1, 1, 1, 2, 400 if i % 300 == 0 else 3])
        rows.append((1, i, t, rng.choice([0.0, rng.random()]), rng.choice([0.0, rng.random()]), rng.choice([None, -1.0]), rng.choice([None, None, None, 90.0])))
    for d in (2, 3, None):
        rows += [(d, i, 5 * i, float(i), 1.0, None, None) for i in range(rng.choice([1, 2, 9]))]
    df = spark.createDataFrame([(d, r, float(s), x, y, z, h, 1.0, 2.0) for d, r, s, x, y, z, h in rows], "deployment_id bigint, row_no bigint, s double, x double, y double, z double, heading double, pitch double, roll double")
    return tables.written(df.withColumn("ts", F.timestamp_micros((F.col("s") * 1e6).cast("bigint"))).drop("s"))


def rows(df, columns=None):
    names = sorted(columns or df.columns)
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*(f"`{c}`" for c in names)).collect())


@pytest.mark.parametrize("size", [7, 400])
def test_scans_in_segments(hot, size):
    named = hot.where("deployment_id IS NOT NULL")
    for whole, cut in (
        (timeline.track_heading(hot, 45.0), timeline.track_heading(hot, 45.0, segment_rows=size)),
        (timeline.carried_heading(hot, offset=3.0), timeline.carried_heading(hot, offset=3.0, segment_rows=size)),
        (timeline.carried_heading(hot, force=True), timeline.carried_heading(hot, force=True, segment_rows=size)),
        (timeline.object_ids(hot).withColumn("object_id", F.col("object_id").cast("bigint")), timeline.object_ids(hot, segment_rows=size)),
        (timeline.resampled(named, 3.0), timeline.resampled(named, 3.0, segment_rows=size)),
        (timeline.gaps(named), timeline.gaps(named, segment_rows=size)),
        (timeline.median_interval(named, True), timeline.median_interval(named, True, segment_rows=size)),
    ):
        assert rows(whole) == rows(cut)
    sets = named.withColumns({"set_id": F.col(DEP), "ts": F.when(F.col("row_no") % 3 != 0, F.col("ts"))})
    assert rows(timeline.sequence_order(sets).withColumn("sequence_order", F.col("sequence_order").cast("bigint"))) == rows(timeline.sequence_order(sets, segment_rows=size))
    asks = named.where("row_no % 5 = 0").withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + 700_000))
    assert rows(asof.nearest_rows(asks, named)) == rows(asof.nearest_rows_bucketed(asks, named, segment_rows=size))


def test_segments_are_even(spark, hot):
    """No segment is much larger than asked, but for rows of one time, and no window is over a whole deployment's rows."""
    cut = segments.segmented(hot, [DEP], F.unix_micros("ts"), 100)
    sizes = [r["n"] for r in cut.where("deployment_id = 1").groupBy("_seg").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1500 and len(sizes) >= 10 and max(sizes) <= 250
    plan = timeline.carried_heading(hot, segment_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line and "row_no" in line.partition("windowspecdefinition")[2]:
            assert "_seg" in line.rpartition("], [")[0]
    assert jobs.scan_rows(hot) is None and segments.largest_group(hot, DEP) == 1500


@pytest.mark.parametrize(("few", "bins"), [(2, 3), (1000, 2048)])
def test_quantiles_and_modes(spark, few, bins):
    rng = random.Random(few)
    groups = {"skew": [1.0] * 500 + [1.0 + 1e-12 * i for i in range(40)] + [1e9], "one": [5.0], "two": [1.0, 2.0], "wide": [rng.uniform(-1e308, 1e308) for _ in range(60)], "ends": [float("-inf"), 0.0, 1.0, 1.0, float("inf")], None: [rng.gauss(0, 1) for _ in range(101)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)], "k string, value double")
    counts = quantiles.value_counts(df, ["k"], "value")
    got = {r["k"]: r["q"] for r in quantiles.quantiles(counts, ["k"], [0.0, 0.25, 0.5, 1.0], few, bins).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s = sorted(vs)
        for share, v in zip([0.0, 0.25, 0.5, 1.0], got[k], strict=True):
            at = share * (len(s) - 1)
            low, part = s[int(at)], at - int(at)
            assert v == (low if part == 0 else pytest.approx(low * (1 - part) + s[int(at) + 1] * part, rel=1e-12))
    mode = {r["k"]: r["mode"] for r in quantiles.modes(counts, ["k"]).collect()}
    assert mode["skew"] == 1.0 and mode["two"] == 1.0 and mode["ends"] == 1.0
    assert rows(quality.described(df.where("k <> 'ends'"), ["k"])) == rows(quality.described(df.where("k <> 'ends'"), ["k"], few=few))
    assert quantiles.quantiles(quantiles.value_counts(df.limit(0), ["k"], "value"), ["k"], [0.5]).count() == 0


def test_one_document_over_many_splits(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: rng.choice(["plain", "a } b", 'q " uote', "back\\slash", "[x{", '\\"', "é", "", '"image-set-items": {', "}}]]"])
    made, docs = {}, {}
    for k in range(6):
        items = {f"i{j}{rng.choice(['', '}', '{ '])}.tif": {"image-uuid": str(j), "text": text(), "obj": {"a": [1, {"b": text()}]}, "l": [text()]} for j in range((0, 1, 5, 60, 60, 7)[k])}
        body = [{"$filename": n, **v} for n, v in items.items()] + [{"$filename": "dup.tif", "v": "1"}, {"$filename": "dup.tif", "v": "2"}, {"none": 1}, {"$filename": ""}] if k % 2 else items | {"bad": None, "num": 3, "dup.tif": {"v": "x"}}
        whole = {"image-set-header": {"image-pi": {"name": text()}, "list": [{"a": 1}, [2]]}, "image-set-items": body, "other": {"x": {"y": {"z": 1}}, "image-set-items": {"no": {}}}}
        docs[f"d{k}.json"] = json.dumps(whole, indent=rng.choice([None, 1]), ensure_ascii=False)
        made |= {(f"d{k}.json", n): set(v) for n, v in items.items()} | {(f"d{k}.json", "dup.tif"): {"v"}}
    docs["d0.json"] = docs["d0.json"].replace('"dup.tif": {"v": "x"}', '"dup.tif": {"w": "first"}, "dup.tif": {"v": "1", "v": "x"}').replace('"dup.tif": {\n', '"dup.tif": {"w": "first"}, "dup.tif": {"v": "1", \n')
    docs |= {"e1.json": "{}", "e2.json": "not json }{", "e3.json": '{"image-set-items": {}}', "e4.json": ""}
    (tmp_path / "in").mkdir()
    for name, body in docs.items():
        (tmp_path / "in" / name).write_text(body)
    texts = spark.createDataFrame([(n, 1, b) for n, b in docs.items()], "set_id string, source_no int, document string")
    whole = {(r["set_id"], r["filename"]): r["item"] for r in tables.document_items(texts).collect()}
    assert {k: set(v) for k, v in whole.items()} == made
    assert whole["d0.json", "dup.tif"] == {"v": "x"} and whole["d1.json", "dup.tif"] == {"v": "1"}
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "99"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            if size == "99":
                assert spark.read.text(str(tmp_path / "in/d3.json")).rdd.getNumPartitions() > 20
            got = {(os.path.basename(r["source_file"]), r["filename"]): r["item"] for r in ordered.scanned_items(spark, str(tmp_path / "in")).collect()}
            assert got == whole
        log = "a,b\n" + "".join(f"{i},{'x' * (i % 7)}\n" for i in range(400))
        (tmp_path / "log.csv").write_text(log)
        read = tables.read_log(spark, str(tmp_path / "log.csv"))
        assert spark.read.text(str(tmp_path / "log.csv")).rdd.getNumPartitions() > 10
        assert all(int(r["a"]) == r["row_no"] for r in read.collect()) and read.count() == 400
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    reasons = {r["set_id"]: r["reason"] for r in tables.unreadable_documents(texts).collect()}
    assert reasons == {"e1.json": "no items", "e2.json": "not JSON", "e4.json": "not JSON"}


def test_files_in_blocks(spark, tmp_path):
    for i, size in enumerate((1, 10, 11, 5000)):
        (tmp_path / f"a b%{i}.tif").write_bytes(bytes(range(256)) * (size // 256 + 1) if size > 256 else b"x" * size)
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    for whole in (10, 1 << 20):
        got = {r["path"].rpartition("/")[2]: r["sha256"] for r in tables.file_hashes(spark, str(tmp_path), whole, 64).collect()}
        assert sorted(got.values()) == sorted(want.values()) and len(got) == 4


def test_documents_in_parts(spark, tmp_path):
    """A large set is written by several tasks; its parts in order are its document."""
    images = spark.range(900).select(F.when(F.col("id") < 800, 1).otherwise(2).alias("set_id"), F.format_string("i%05d.tif", F.col("id")).alias("filename"), F.concat(F.lit("p/"), F.col("id")).alias("path"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is one part
    try:
        tables.write_documents(ordered.manifest_lines(images, F.lit("s")), str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in os.listdir(tmp_path / "m/set_id=1") if f.startswith("part")]) > 1
    lines = {}
    for r in ordered.read_in_order(spark, str(tmp_path / "m")).collect():
        lines.setdefault(r["set_id"], []).append((r["place"], r["value"]))
    for key, n in ((1, 800), (2, 100)):
        assert [p for p, _ in sorted(lines[key])] == list(range(n + 2))
        read = json.loads("".join(v for _, v in sorted(lines[key])))
        assert read["n_images"] == n and [i["filename"] for i in read["images"]] == sorted(i["filename"] for i in read["images"]) and len(read["images"]) == n


def test_table_pairs_like_a_search(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("aAbB_") for _ in range(rng.randint(0, 5)))
    asks, have = [[(rng.choice("xyz"), name()) for _ in range(n)] for n in (60, 25)]
    have.append(("lone", "q"))
    asks.append(("lone", "z"))

    def best(folder, ask):
        there = sorted({c for f, c in have if f == folder})
        if sum(f == folder for f, _ in have) == 1:
            return there[0]
        size = lambda c: len(os.path.commonprefix([ask.lower(), c.lower()]))
        top = max(map(size, there), default=0)
        return min((c for c in there if size(c) == top), default=None) if top else None

    df = lambda v: spark.createDataFrame(v, "folder string, name string")
    got = {(r["folder"], r["name"]): r["camera_table"] for r in tables.table_pairs(df(asks), df(have)).collect()}
    assert got == {a: best(*a) for a in asks}


def event(side, no=None, us=None, name=None, ms=None):
    return {"side": side, "row_no": no, "us": us, "filename": name, "path": name, "elapsed_ms": ms, "v": [float(no), None] if side == stateful.ROW else None}


def test_state_gives_final_answers_only():
    """Telemetry out of order within the delay and any batches give the answers of a search over all rows; each frame
    is answered once, and state is kept for a while only."""
    rng = random.Random(6)
    for trial in range(20):
        times = [rng.randrange(0, 400) * 1000 for _ in range(80)]
        start = min(times)
        feed = [(t + rng.randrange(50_000), event(stateful.ROW, n, t)) for n, t in enumerate(times)]
        asks = [(rng.randrange(420), f"f{i}") for i in range(30)]
        feed += [(start + 1000 * ms + rng.choice([-100_000, 0, 30_000]), event(stateful.FRAME, i, None, name, ms)) for i, (ms, name) in enumerate(asks)]
        feed += [(rng.randrange(400_000), event(stateful.FRAME, 99, None, "still", None))]
        feed = [e for _, e in sorted(feed, key=lambda f: f[0])] + [event(stateful.END)]
        stored, out, most = None, [], 0
        while feed:
            cut = rng.choice([1, 7, 30])
            batch, feed = feed[:cut], feed[cut:]
            d = stateful._Deployment(stored)
            ended = d.add(pd.DataFrame(batch))
            out += d.answered(ended, 50_000, 150_000, 10**9)
            stored = d.stored()
            most = max(most, len(d.rows))
        found = {r[1]: r for r in out}
        assert len(found) == len(out) == 31 and found["still"][-1] == "no time" and not d.waiting
        order = sorted((t, n) for n, t in enumerate(times))
        for ms, name in asks:
            at = start + 1000 * ms
            i = np.searchsorted([t for t, _ in order], at, "left")
            t, n = min((order[k] for k in (i - 1, i) if 0 <= k < len(order)), key=lambda r: (abs(r[0] - at), r[0] >= at))
            assert found[name][-1] == "late" or found[name][4:7] == (at, n, t)
        assert sum(r[-1] == "late" for r in out) < 12


def test_frames_from_before_what_is_kept_are_late():
    d = stateful._Deployment(None)
    d.add(pd.DataFrame([event(stateful.ROW, n, n * 1_000_000) for n in range(100)]))
    assert d.answered(False, 0, 10_000_000, 10**9) == [] and len(d.rows) <= 12
    d.add(pd.DataFrame([event(stateful.FRAME, 1, None, "old", 5_000), event(stateful.FRAME, 2, None, "new", 95_400), event(stateful.FRAME, 3, None, "next", 120_000)]))
    got = {r[1]: r for r in d.answered(False, 0, 10_000_000, 10**9)}
    assert got["old"][-1] == "late" and got["new"][5] == 95 and "next" not in got


def test_one_read_counts_what_it_rejects(spark):
    raw = spark.createDataFrame([(1, 0, "1", "5", "2024-01-01 00:00:00"), (1, 1, "-", "5", "2024-01-01 00:00:00"), (2, 2, "3", "5", "never"), (2, 3, None, None, None)], "deployment_id bigint, row_no bigint, X string, Y string, Time string")
    track, seen = jobs.read_telemetry(raw, {"x": "X", "y": "Y", "time": "Time"})
    assert seen == {"kept": 1, "no position": 2, "no time": 1} and track.count() == 1
    with pytest.raises(ValueError, match="no rows"):
        jobs.read_telemetry(raw.where("row_no > 0"), {"x": "X", "y": "Y", "time": "Time"})


@pytest.mark.parametrize("many", [False, True])
def test_many_keys_share_files(spark, tmp_path, monkeypatch, many):
    """Files of more keys than get a folder follow the rows, and readers get the same table, lines and places."""
    monkeypatch.setattr(tables, "FOLDERS", 20 if many else 100)
    table = spark.range(400).select((F.col("id") % 40).alias("set_id"), F.format_string("i%03d", F.col("id")).alias("filename"), (F.col("id") * 0.5).alias("x y"))
    for form in ("csv", "json"):
        path = str(tmp_path / form)
        tables.write_in_order(table, path, ["set_id"], ["filename"], form=form)
        assert len(glob.glob(f"{path}/set_id=*")) == (0 if many else 40) and len(glob.glob(f"{path}/**/part*", recursive=True)) <= (4 if many else 40)
        reader = spark.read.schema("filename string, `x y` double, set_id bigint")
        read = reader.csv(path, header=True) if form == "csv" else reader.json(path)
        assert rows(read) == rows(table)
        kept = read.withColumn("at", F.monotonically_increasing_id()).orderBy("set_id", "at").select("set_id", "filename").collect()
        assert kept == sorted(kept)
    images = table.select("set_id", "filename", F.concat(F.lit("p/"), F.col("filename")).alias("path"))
    tables.write_documents(ordered.manifest_lines(images, F.lit("s")), str(tmp_path / "m"))
    assert len(glob.glob(str(tmp_path / "m/set_id=*"))) == (0 if many else 40)
    lines = {}
    for r in ordered.read_in_order(spark, str(tmp_path / "m")).collect():
        lines.setdefault(r["set_id"], []).append((r["place"], r["value"]))
    assert sorted(lines) == list(range(40))
    for key, found in lines.items():
        assert [p for p, _ in sorted(found)] == list(range(12))
        assert [i["filename"] for i in json.loads("".join(v for _, v in sorted(found)))["images"]] == [f"i{i:03d}" for i in range(key, 400, 40)]


@pytest.mark.parametrize("name", ["s11_manifest", "s10_document_files", "e4_image_sets"])
def test_a_document_is_read_once(spark, name):
    """No text of a whole set is parsed again for each of its rows: nothing above the generator parses JSON."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "json" not in plan[: plan.index("Generate")].lower()


def test_entries_of_xml(spark):
    text = '<PAMDataset><Metadata domain="iFDO"><MDI key="a>b">&lt;1&gt;</MDI><MDI key="e"/><MDI key="k">old</MDI>\n<MDI key="k">&amp;lt;</MDI></Metadata></PAMDataset>'
    texts = spark.createDataFrame([("s", "a", 0, text), ("s", "b", 0, text.replace("iFDO", "x")), ("s", "c", 0, "<PAMDataset/>"), ("s", "d", 0, None)], "set_id string, filename string, source_no int, xml string")
    found = tables.xml_items(texts, "iFDO")
    assert [(r["filename"], r["item"]) for r in found.collect()] == [("a", {"a>b": "<1>", "e": "", "k": "&lt;"})]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_points_are_dealt_by_their_number(hot, monkeypatch):
    """A track whose few rows become many is cut by the points, and windows over them keep that cut."""
    named = hot.where("deployment_id IS NOT NULL")
    whole = rows(timeline.track_heading(timeline.resampled(named, 3.0)))
    monkeypatch.setattr(timeline, "POINTS", 40)
    cut = timeline.track_heading(timeline.resampled(named, 3.0))
    n = timeline.resampled(named, 3.0).count()
    assert rows(cut) == whole and cut.rdd.getNumPartitions() >= n / 40 / 2


def test_state_is_bytes():
    """What a deployment keeps of its telemetry is a value for each column, not an object for each number."""
    d = stateful._Deployment(None)
    d.add(pd.DataFrame([event(stateful.ROW, n, n * 1_000_000) for n in (2, 1)] + [event(stateful.FRAME, 7, None, "a", 400)]))
    d.answered(False, 10**9, 10**9, 10**9)
    stored = d.stored()
    assert [type(x) for x in stored[4:7]] == [bytes] * 3
    again = stateful._Deployment(stored)
    assert again.waiting == [(7, "a", "a", 400)] and again.answered(True, 0, 0, 0) == [(7, "a", "a", 400, 1_400_000, 1, 1_000_000, [1.0, None], "found")]


def test_logs_that_share_files(spark, tmp_path):
    """Rows are numbered in their own log, whether the logs of a file come one after another or mixed, in few splits or
    many, and where some have no name."""
    rng = random.Random(5)
    (tmp_path / "in").mkdir()
    want, seen = [], {}
    for part in ("p0", "p1", "p2"):
        lines = []
        for _ in range(200):
            log = rng.choice(["a", "b", "", "d"])
            seen[log] = seen.get(log, -1) + 1
            lines.append(f"{len(want)},{log}")
            want.append((log or None, seen[log]))
        (tmp_path / f"in/{part}.csv").write_text(" no,log \n" + "\n".join(lines) + "\n")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "99"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            read = tables.read_log(spark, str(tmp_path / "in"), ["log"])
            assert read.columns == ["no", "log", "source_file", "row_no"]
            assert [(r["log"], r["row_no"]) for r in sorted(read.collect(), key=lambda r: int(r["no"]))] == want
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("many", [False, True])
def test_row_numbers_of_many_logs(spark, tmp_path, monkeypatch, many):
    """More deployments than get a folder share files, so that the number of files follows the rows."""
    monkeypatch.setattr(tables, "FOLDERS", 20 if many else 100)
    monkeypatch.setattr(queries, "_fresh", lambda spark: str(tmp_path / "log"))
    user = F.when(F.col("id") % 41 != 0, F.col("id") % 41)
    events = spark.range(500).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + 60 * F.col("id")).alias("ts"), user.alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"))
    events.union(events.where("event_id % 7 = 0")).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((str(r["deployment_id"]), r["file_row"], r["row_no"]) for r in queries.QUERIES["s1_row_numbers"](spark, str(tmp_path)).collect())
    logs = {}
    for n in range(500):
        logs.setdefault(str(n % 41 or None), []).extend([n] * (1 + (n % 7 == 0)))
    assert got == sorted((log, i, n) for log, ns in logs.items() for i, n in enumerate(ns))
    files = glob.glob(str(tmp_path / "log/**/part*.csv"), recursive=True)
    assert len(files) <= 4 if many else len(files) == 41


def _shuffle_files(spark):
    """The data files of shuffles that lie on the disks of the session."""
    return {f for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


@pytest.mark.parametrize("many", [False, True])
def test_files_of_image_sets_take_little_disk(spark, tmp_path, monkeypatch, many):
    """Documents that repeat their header are packed, in files of bounded rows; the frames meet the inventory once; what
    the writes shuffle goes with them."""
    monkeypatch.setattr(tables, "FOLDERS", 3 if many else 100)
    monkeypatch.setattr(tables, "PACKED_ROWS", 30, raising=False)
    frames = spark.range(400).select((F.col("id") % 8).alias("set_id"), F.col("id").alias("row_no"), F.format_string("a/i%03d.tif", F.col("id")).alias("path"), F.format_string("i%03d.tif", F.col("id")).alias("filename"), F.lit(1).alias("camera_id"), F.lit("5.5").alias("Latitude"), F.lit("6.5").alias("Longitude"), F.lit(None).alias("no; type"))
    inventory = frames.where("row_no % 10 <> 0").select("set_id", "path")
    heads = frames.select("set_id").distinct().select("set_id", F.create_map(F.lit("image-set-name"), F.concat(F.lit("s"), F.col("set_id")), F.lit("image-abstract"), F.lit("long " * 400)).alias("header"))
    cameras = spark.createDataFrame([(0, "1")], "row_no bigint, camera_id string")
    before = _shuffle_files(spark)
    made = jobs.image_sets(frames, cameras, inventory, inventory.select("path", F.sha2("path", 256).alias("sha256")).distinct(), heads, pair=("Latitude", "Longitude"))
    assert "Join" not in made["skipped"]._jdf.queryExecution().optimizedPlan().toString()
    jobs.write_image_sets(made, str(tmp_path / "out"), "per-image")
    left = sum(os.path.getsize(f) for f in _shuffle_files(spark) - before)
    documents = glob.glob(str(tmp_path / "out/documents/**/part*"), recursive=True)
    read = spark.read.json(str(tmp_path / "out/documents"), schema="name string, document string, set_id bigint").collect()
    assert len(read) == 360 and len({(r["set_id"], r["name"]) for r in read}) == 360
    for r in read:
        doc = json.loads(r["document"])
        assert doc["image-set-header"]["image-set-name"] == f"s{r['set_id']}" and [f"{n}.ifdo.json" for n in doc["image-set-items"]] == [r["name"]]
    assert sum(map(os.path.getsize, documents)) * 8 < sum(len(r["document"]) for r in read) and len(documents) >= 360 / 30
    assert left < 20_000  # what two counts of sets have shuffled
    joined = made["joined"].where("Frame_row_no = 1").first()
    assert joined["Frame_path"] == "a/i001.tif" and joined["Frame_no; type"] is None and joined["Camera_row_no"] == 0


def test_written_frames_have_any_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0, None), (2, None, None, [1])], "`x y` int, `X Y` string, `a,;{}()=.b` double, l array<int>").select("*", F.lit(None).alias("none"))
    got = tables.written(df)
    assert got.columns == df.columns and [str(f.dataType) for f in got.schema] == [str(f.dataType) for f in df.schema]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert tables.written(df.limit(0)).count() == 0
