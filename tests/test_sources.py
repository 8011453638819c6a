import json

import pytest

from staffline.sources import notes as S
from staffline.sources import records as R
from staffline.sources import selection as Sel


def paths(df):
    return sorted(r["path"] for r in df.collect())


@pytest.fixture(scope="module")
def files(spark):
    names = ["a/1.mid", "a/b/2.mid", "ab/3.mid", "c/4.midi", "c/5.mid", "top.mid"]
    return spark.createDataFrame([("/data/" + n,) for n in names], "path STRING")


def test_subdirectory_is_component_wise(files):
    assert paths(Sel.select_sources(files, "/data", subdirectory="a")) == ["/data/a/1.mid", "/data/a/b/2.mid"]


@pytest.mark.parametrize(
    "glob, want",
    [
        ("*.mid", ["/data/top.mid"]),
        ("**/*.mid", ["/data/a/1.mid", "/data/a/b/2.mid", "/data/ab/3.mid", "/data/c/5.mid", "/data/top.mid"]),
        ("a*/?.mid", ["/data/a/1.mid", "/data/ab/3.mid"]),
        ("c/[!5].mid*", ["/data/c/4.midi"]),
        ("nothing/*", []),
    ],
)
def test_glob(files, glob, want):
    assert paths(Sel.select_sources(files, "/data", glob=glob)) == want


def test_allow_list_file(spark, files, tmp_path):
    listing = tmp_path / "list.txt"
    listing.write_text("# comment\n\n  a/1.mid\n/data/c/5.mid\nx/../top.mid\nmissing.mid\n")
    allowed = Sel.read_allow_list(spark, str(listing), "/data")
    assert paths(Sel.select_sources(files, "/data", allowed=allowed)) == ["/data/a/1.mid", "/data/c/5.mid", "/data/top.mid"]


def test_fraction_cap_and_validation(files):
    assert len(paths(Sel.select_sources(files, "/data", fraction=0.5))) == 3
    assert len(paths(Sel.select_sources(files, "/data", fraction=0.01))) == 1
    assert paths(Sel.select_sources(files, "/data", max_files=2)) == ["/data/a/1.mid", "/data/a/b/2.mid"]
    same = [paths(Sel.select_sources(files.repartition(n), "/data", fraction=0.5, fraction_seed=9)) for n in (1, 5)]
    assert same[0] == same[1]
    for bad in ({"fraction": 0.0}, {"fraction": 1.5}, {"subdirectory": "a", "glob": "*"}):
        with pytest.raises(ValueError):
            Sel.select_sources(files, "/data", **bad)


def test_collections(files):
    assert len(paths(S.collection_files(files, "lakh"))) == 5
    assert paths(S.collection_files(files, "maestro")) == ["/data/c/4.midi"]
    assert len(paths(S.collection_files(files.filter("path NOT LIKE '%midi'"), "maestro"))) == 5
    assert len(paths(S.collection_files(files, "maestro", union=True))) == 6


def test_bad_lines_and_files_do_not_fail(spark, tmp_path):
    good = {"song_id": "s", "track_idx": 0, "program": 1, "is_drum": False, "pitch": 60, "start_tick": 0,
            "duration_ticks": 10, "velocity": 64, "note_ord": 1, "ticks_per_quarter": 480}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.json").write_text(json.dumps(good) + "\n{broken\n")
    rows, quarantine = S.split_corrupt(S.read_notes(spark, str(tmp_path), "json").cache())
    assert rows.count() == 1 and quarantine.count() == 1
    assert rows.first()["source_path"].endswith("a.json")
    table = tmp_path / "pq"
    rows.drop("source_path").write.parquet(str(table))
    (table / "broken.parquet").write_bytes(b"not a table")
    assert S.read_notes(spark, str(table)).count() == 1


def test_cells_by_instrument(spark, tmp_path):
    df = spark.createDataFrame([(1, "bass"), (2, "drums")], "x INT, instrument STRING")
    S.write_cells(df, str(tmp_path / "cells"))
    assert (tmp_path / "cells" / "instrument=bass").is_dir()


def test_rank_and_benchmark_records(spark, tmp_path):
    from staffline.plans import experiment as X

    a = {"rank": 0, "conditions": ["x", "y"], "condition_indices": [3, 1], "elapsed_seconds": 1.25,
         "metrics_summary": {"x": {"psnr": 1.0, "mse": 5.0}, "y": {"psnr": 2.0}}}
    b = {"rank": 1, "conditions": ["x"], "condition_indices": [0], "elapsed_seconds": 2.0, "metrics_summary": {"x": {"psnr": 9.0}}}
    (tmp_path / "sweep_summary_rank0.json").write_text(json.dumps(a, indent=1))
    (tmp_path / "sweep_summary_rank1.json").write_text(json.dumps(b))
    (tmp_path / "sweep_summary_rank2.json").write_text("{nope")
    (tmp_path / "other.json").write_text(json.dumps(a))
    ranks = R.read_rank_summaries(spark, str(tmp_path)).cache()
    t = X.merge_rank_totals(ranks).first()
    assert (t["num_ranks"], t["total_elapsed_seconds"], t["num_conditions"], t["condition_indices"]) == (2, 3.25, 3, [0, 1, 3])
    got = {(r["condition"], r["metric"]): r["value"] for r in X.merge_rank_metrics(ranks).collect()}
    assert got == {("x", "psnr"): 9.0, ("y", "psnr"): 2.0}  # the later file replaces x as a whole
    bench = tmp_path / "bench.json"
    bench.write_text(json.dumps({"timestamp": "t", "results": [{"stage": "ingest", "mean_s": 2.0, "files_per_sec": 3.0}]}))
    assert R.read_benchmark(spark, str(bench)).first()["files_per_sec"] == 3.0
    R.write_records(R.read_benchmark(spark, str(bench)), str(tmp_path / "out"))
    assert R.read_records(spark, str(tmp_path / "out"), "stage STRING").first()["stage"] == "ingest"
