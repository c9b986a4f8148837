import datetime as dt
import math

from hypothesis import given, settings, strategies as st

from newslens import schemas
from newslens.operators import frames, timeline
from newslens.plans import jobs

START = dt.date(2024, 1, 1)
SERIES = "date date, avg_tone double, article_count long"


def day(i):
    return START + dt.timedelta(days=i)


def series(spark, tones, counts=None):
    counts = counts or [1] * len(tones)
    return spark.createDataFrame([(day(i), t, n) for i, (t, n) in enumerate(zip(tones, counts))], SERIES)


def ordered(df):
    return df.orderBy("date").collect()


points = st.lists(st.tuples(st.integers(-9, 9), st.integers(0, 9)), min_size=1, max_size=30)


@settings(max_examples=10, deadline=None)
@given(points, st.integers(1, 12))
def test_smoothing_equals_plain_python(spark, data, window):
    got = ordered(timeline.smooth_timeline(
        series(spark, [float(t) for t, _ in data], [n for _, n in data]), window))
    for i, row in enumerate(got):
        part = data[max(0, i - window // 2): min(len(data), i + math.ceil(window / 2))]
        weight = sum(n for _, n in part)
        assert math.isclose(row.avg_tone, sum(t * n for t, n in part) / weight if weight else 0.0, abs_tol=1e-12)
        assert row.article_count == math.floor(weight / len(part) + 0.5)


@settings(max_examples=10, deadline=None)
@given(points)
def test_trend_equals_plain_python(spark, data):
    tones = [float(t) for t, _ in data]
    n = len(tones)
    sx, sy = sum(range(n)), sum(tones)
    sxy, sxx = sum(i * t for i, t in enumerate(tones)), sum(i * i for i in range(n))
    denominator = n * sxx - sx * sx
    slope = (n * sxy - sx * sy) / denominator if denominator else 0.0
    intercept = (sy - slope * sx) / n
    for i, row in enumerate(ordered(timeline.tone_trend(series(spark, tones)))):
        assert row.i == i
        assert math.isclose(row.trend, intercept + slope * i, abs_tol=1e-9)


def test_downsample(spark):
    assert len(ordered(timeline.downsample(series(spark, [0.0] * 30), target=10))) == 10
    assert [r.date for r in ordered(timeline.downsample(series(spark, [0.0] * 25), target=10))][:3] == [day(0), day(2), day(4)]
    assert len(ordered(timeline.downsample(series(spark, [0.0] * 7), target=10))) == 7


def test_axis_stats(spark):
    assert timeline.axis_stats(series(spark, [1.0, 3.0])).first() == (0.0, 3.0, 1.0)
    assert timeline.axis_stats(series(spark, [-1.0, 3.0])).first() == (-1.0, 3.0, 0.75)
    assert timeline.axis_stats(series(spark, [0.0])).first() == (0.0, 0.0, 0.0)
    assert timeline.axis_stats(series(spark, [0.1]), margin=0.5).first() == (-0.5, 0.5, 0.5)


def test_rolling_mean_spans_calendar_days(spark):
    sparse = spark.createDataFrame([(day(0), 1.0, 1), (day(2), 3.0, 1), (day(5), 5.0, 1)], SERIES)
    assert [r.rolling_tone for r in ordered(timeline.rolling_mean(sparse, 3))] == [1.0, 2.0, 5.0]


def test_era_spans(spark):
    boundaries = ("2024-01-01", "2024-01-04", "2024-02-01", "2025-01-01")
    spans = {r.era: r for r in timeline.era_spans(series(spark, [0.0] * 10), boundaries).collect()}
    assert (spans[0].start_index, spans[1].start_index, spans[2].start_index) == (0, 3, 0)
    assert (spans[0].width_share, spans[1].width_share, spans[2].width_share) == (0.3, -0.3, 1.0)


def test_sparkline(spark):
    boundaries = ("2024-01-01", "2024-01-04", "2024-01-05", "2024-01-06")
    got = timeline.sparkline_points(series(spark, [1.0, -1.0, 0.0, 9.0, 9.0, 9.0]), boundaries).orderBy("era", "date").collect()
    assert [(r.era, r.x, r.y) for r in got] == [(0, 0.0, 0.0), (0, 0.5, 1.0), (0, 1.0, 0.5)]


def cube(spark, rows):
    return spark.createDataFrame([(day(i), c, t, n) for i, c, t, n in rows], schemas.COVERAGE)


def test_global_timeline(spark):
    got = ordered(timeline.global_timeline(cube(spark, [
        (0, "FRA", 1.0, 1), (0, "DEU", 4.0, 2), (1, "FRA", 1.0, 0), (1, "DEU", None, 3),
    ])))
    assert [tuple(r) for r in got] == [(day(0), 3.0, 3)]


days = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(-9, 9)), st.integers(0, 9)), min_size=1, max_size=20
)


@settings(max_examples=15, deadline=None)
@given(days, st.integers(1, 6), st.one_of(st.none(), st.integers(0, 5)), st.integers(1, 3))
def test_frames_equal_a_rolling_buffer(spark, data, size, jump, step):
    filled = cube(spark, [(i, "FRA", None if t is None else float(t), n) for i, (t, n) in enumerate(data)])
    start = None if jump is None else day(jump).isoformat()
    got = {r.date: r for r in frames.rolling_country_frame(filled, size, start, step).collect()}
    buffer = []
    for i in range(jump or 0, len(data), step):
        buffer = (buffer + [data[i]])[-size:]
        total = sum(n for t, n in buffer if t is not None and n)
        row = got.pop(day(i), None)
        if not total:
            assert row is None
            continue
        mass = sum(t * n for t, n in buffer if t is not None and n)
        assert math.isclose(row.avg_tone, mass / total, abs_tol=1e-12)
        assert row.article_count == math.floor(total / len(buffer) + 0.5)
    assert not got


def test_frame_average(spark):
    frame = cube(spark, [(0, "FRA", 1.0, 1), (0, "DEU", 4.0, 2), (0, "ITA", None, 5)])
    assert frames.frame_average(frame).first().avg_tone == 3.0
    assert frames.frame_average(cube(spark, [(0, "ITA", None, 0)])).first().avg_tone is None


def test_overview(spark):
    rows = [(i, "FRA", float(i % 7), 1 + i % 3) for i in range(60)]
    chart = ordered(jobs.overview_series(cube(spark, rows), window=10, target=20))
    assert len(chart) == 20
    assert all(r.zero_offset == 1.0 for r in chart)
