"""Small frames in the library's table shapes."""

from staffline.operators.layout import by_bar

NOTE = "song_id BIGINT, track_idx INT, pitch INT, onset_step INT, offset_step INT, velocity INT, note_ord BIGINT"
PRED = "song_id BIGINT, track_idx INT, bar_index INT, pitch INT, onset INT, offset INT, velocity INT"
PLANE = "song_id BIGINT, track_idx INT, bar_index INT, row INT, step INT, value DOUBLE"

# Four notes of the anchor bar: pitch, on, off, velocity.
ANCHOR = [(60, 0, 24, 100), (64, 24, 48, 80), (67, 48, 72, 90), (72, 72, 96, 110)]


def notes(spark, rows, song=1, track=0):
    data = [(song, track, p, a, b, v, i) for i, (p, a, b, v) in enumerate(rows)]
    return spark.createDataFrame(data, NOTE)


def pred(spark, rows, song=1, track=0, bar=0):
    return spark.createDataFrame([(song, track, bar, p, a, b, v) for p, a, b, v in rows], PRED)


def plane(spark, rows, song=1, track=0, bar=0):
    """``rows``: {row: [values over steps]}; zeros are left out."""
    data = [(song, track, bar, r, t, float(v)) for r, vs in rows.items() for t, v in enumerate(vs) if v > 0]
    return by_bar(spark.createDataFrame(data, PLANE))


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def found(df):
    return sorted((r["pitch"], r["onset"], r["offset"], r["velocity"]) for r in df.collect())

