import json
import math

import pytest
from pyspark.sql import functions as F

from staffline.plans import experiment as X
from staffline.streaming import files as T

NAN = float("nan")


def summary(spark, rows):
    return spark.createDataFrame(rows, "condition STRING, metric STRING, value DOUBLE")


def test_mean_rules(spark):
    rows = [("a", "m", 1.0), ("a", "m", 3.0), ("b", "m", 1.0), ("b", "m", NAN), ("c", "m", math.inf), ("c", "m", 1.0), ("d", "k", 2.0)]
    got = {(r["condition"], r["metric"]): r["value"] for r in X.summarise(summary(spark, rows), ["condition"]).collect()}
    assert got["a", "m"] == 2.0 and math.isnan(got["b", "m"]) and got["c", "m"] == math.inf and ("d", "m") not in got


def test_pivot_and_leaderboard(spark):
    s = summary(spark, [("a", "m", 1.0), ("b", "m", NAN), ("c", "m", 5.0), ("c", "k", 2.0)])
    wide = {r["condition"]: r for r in X.pivot_metrics(s, ["m", "k"]).collect()}
    assert math.isnan(wide["a"]["k"]) and wide["c"]["k"] == 2.0
    for descending, order in ((True, ["c", "a", "b"]), (False, ["a", "c", "b"])):
        board = X.leaderboard(s, "m", descending).orderBy("rank").collect()
        assert [r["condition"] for r in board] == order and [r["is_best"] for r in board] == [True, False, False]


def test_normalise_modes(spark):
    s = summary(spark, [("a", "m", 1.0), ("b", "m", 3.0), ("a", "k", 7.0), ("b", "k", 7.0), ("a", "n", NAN), ("b", "n", 1.0)])
    heat = {(r["condition"], r["metric"]): r["value"] for r in X.normalise_metrics(s).collect()}
    assert heat["a", "m"] == 0.0 and heat["b", "m"] == 1.0 and heat["a", "k"] == 7.0 and math.isnan(heat["a", "n"])
    radar = {(r["condition"], r["metric"]): r["value"] for r in X.normalise_metrics(s, "radar").collect()}
    assert radar["a", "k"] == 0.5


def test_benchmarks_and_jobs(spark):
    t = spark.createDataFrame([("x", 2.0, 10.0), ("x", 4.0, 10.0), ("y", 1.0, 5.0)], "stage STRING, seconds DOUBLE, items DOUBLE")
    rep = {r["stage"]: r for r in X.repeats(t).collect()}
    assert rep["x"]["mean_s"] == 3.0 and round(rep["x"]["std_s"], 6) == round(math.sqrt(2), 6) and rep["y"]["std_s"] == 0.0
    base = spark.createDataFrame([("ingest", 4.0, 1.0), ("gone", 1.0, 1.0), ("zero", 0.0, 0.0)], "stage STRING, mean_s DOUBLE, per_sec DOUBLE")
    new = spark.createDataFrame([("ingest", 2.0, 2.0), ("new", 1.0, 1.0), ("zero", 1.0, 0.0)], "stage STRING, mean_s DOUBLE, per_sec DOUBLE")
    got = {r["stage"]: r for r in X.compare_benchmarks(base, new).collect()}
    assert got["ingest"]["speedup"] == 2.0 and got["ingest"]["is_best"] and got["ingest"]["unit"] == "files/s"
    assert got["gone"]["speedup"] is None and got["zero"]["speedup"] is None and not got["new"]["is_best"]
    log = spark.createDataFrame([("j", 1, "pending", 0.0, None), ("j", 2, "running", 1.0, None), ("j", 3, "failed", 4.5, "boom")],
                                "job_id STRING, seq INT, status STRING, at DOUBLE, error STRING")
    j = X.latest_jobs(log).first()
    assert (j["status"], j["elapsed"], j["error"]) == ("failed", 3.5, "boom")


def test_relay_reads_each_file_once_and_survives_bad_ones(spark, tmp_path):
    box, out, state = tmp_path / "box", str(tmp_path / "out"), str(tmp_path / "state")
    box.mkdir()
    (box / "cond_1.json").write_text(json.dumps({"condition_label": "c1", "rank": 0, "metrics_summary": {"vae": {"psnr": 3.0, "mse": 1.0}, "total": 7}}))
    (box / "cond_2.json").write_text("{broken")
    (box / "other.json").write_text("{}")
    run = lambda: T.run_available(T.relay(spark, str(box), max_files=1), T.batch_folder_sink(out), state)
    run()
    rows = spark.read.parquet(out)
    assert {r["key"]: r["value"] for r in rows.filter("bad IS NULL").collect()} == {"c1/vae/psnr": 3.0, "c1/vae/mse": 1.0, "c1/total": 7.0}
    assert rows.filter("bad IS NOT NULL").count() == 1
    (box / "cond_3.json").write_text(json.dumps({"condition_label": "c3", "rank": 1, "metrics_summary": {"v": {"psnr": 1.0}}}))
    run()  # restart from the checkpoint: only the new file
    rows = spark.read.parquet(out)
    assert rows.filter("bad IS NULL").count() == 4 and rows.filter("bad IS NOT NULL").count() == 1


def test_streamed_means_equal_batch(spark, tmp_path):
    src, out, state = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "state")
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("metric"), F.col("id").cast("double").alias("value"))
    df.repartition(6).write.parquet(src)
    means = T.running_means(T.read_files(spark, src, "metric STRING, value DOUBLE", max_files=2), ["metric"])
    T.run_available(means, T.batch_folder_sink(out), state, mode="complete")
    got = T.latest(spark, out)
    want = T.running_means(df, ["metric"])
    assert got.exceptAll(want).count() == 0 and got.count() == 3


@pytest.mark.parametrize("seed", [0, 1])
def test_transitions_of_late_bars_equal_the_batch(spark, tmp_path, seed):
    """Bars of three sequences in files out of order, with places that repeat; a batch that is written twice changes nothing."""
    import random
    from collections import Counter

    rng = random.Random(seed)
    schema = "sequence_id STRING, bar_index INT, pc INT"
    rows = [(s, rng.randrange(40), rng.randrange(4)) for s in "aaab" for _ in range(15)] + [("c", 0, 3)]
    parts = [[r for r in rows if rng.random() < 0.4] for _ in range(3)] + [[("d", 1, 2)]]
    parts[0] += [(s, i, i % 3) for i in range(10) for s in "ae"]
    src, folder = str(tmp_path / "src"), str(tmp_path / "moves")
    sink = T.transition_sink(folder)
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        T.run_available(T.read_files(spark, src, schema), sink, str(tmp_path / "state"))
        if i == 2:
            sink(spark.createDataFrame(part, schema), i)
    want = Counter()
    seen = sorted(r for part in parts for r in part)
    for (s, _, x), (t, _, y) in zip(seen, seen[1:]):
        if s == t:
            want[s, x, y] += 1
    assert {tuple(r)[:3]: r["n"] for r in T.transitions(spark, folder).collect()} == dict(want)


def test_ingest_in_many_batches_equals_one(spark, tmp_path):
    """Notes of one song lie in three files and overlap across them."""
    from helpers import NOTE

    from staffline.operators.ingest import notes_to_segments

    data = [(s, t, 40 + (i * 7) % 5, (i * 11) % 300, (i * 11) % 300 + 1 + i % 120, 1 + i % 127, i) for i in range(240) for s, t in [(i % 2, i % 3)]]
    notes = spark.createDataFrame(data, NOTE)
    for part in range(3):
        notes.where(f"note_ord % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    raw = T.read_files(spark, str(tmp_path / "src"), NOTE, max_files=1)
    pieces = str(tmp_path / "pieces")
    T.run_available(raw, T.pieces_sink(pieces, lambda b: b, n_bars=8), str(tmp_path / "state"))
    assert spark.read.parquet(pieces).select("batch").distinct().count() == 3
    columns = ["song_id", "track_idx", "bar_index", "pitch", "on", "off", "velocity", "starts"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(T.landed_segments(spark, pieces)) == rows(notes_to_segments(notes, n_bars=8))
