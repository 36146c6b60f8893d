import datetime as dt
import random

import pytest

from broadsheet.functions.dates import frame_times
from broadsheet.operators import mapping
from broadsheet.plans.runs import map_tables
from broadsheet.sources.features import points

SCHEMA = (
    "article_id string, lccn string, date string, page string, article string, url string, "
    "Title string, City string, State string, Long double, Lat double"
)
D = dt.date


def located(rows, places, **same):
    """Rows at ``(lon, lat, date[, page[, article]])``."""
    data = []
    for i, (lon, lat, date, *rest) in enumerate(places):
        page, article = [*rest, *["p1", "gold rush"][len(rest) :]]
        data.append((f"{i:03}", same.get("lccn", "s1"), date, page, article, "http://x/1.jp2",
                     "The T", same.get("city", "Rome"), "IT", lon, lat))
    return rows(data, SCHEMA)


def frames_of(rows, dates, **kw):
    pts = points(located(rows, [(1.0, 2.0, d) for d in dates]))
    shown = mapping.heat_frames(pts, mapping.map_groups(pts), per_point=True, **kw).collect()
    return sorted((r.frame_no, str(r.frame_time)) for r in shown)


def test_groups_round_and_count(rows):
    pts = points(located(rows, [
        (1.0000001, 2.0, "1900-01-01", "p1", "Gold gold x_1"), (1.0, 2.0, None, "p2", "none"),
        (-0.0, 0.0, None, "", "gold"), (0.0, 0.0, None, None, None), (None, 3.0, None),
    ]))
    got = {(r.lat, r.lon): r for r in mapping.map_groups(pts, "GOLD").collect()}
    one, two = got[2.0, 1.0], got[0.0, 0.0]
    assert (one.article_count, one.page_count, one.key_term_frequency, one.word_count) == (2, 2, 2, 4)
    assert (two.article_count, two.page_count, two.key_term_frequency, two.word_count) == (2, 2, 1, 1)


@pytest.mark.parametrize(
    "choice, expected",
    [
        ({}, [1.0, 2.0]),
        ({"metric": "unknown"}, [1.0, 2.0]),
        ({"normalize": True}, [1.0, 1.0]),
        ({"metric": "key_term_frequency"}, [0.0, 3.0]),
        ({"metric": "key_term_frequency", "normalize": True}, [0.0, 0.75]),
        ({"metric": "key_term_frequency", "normalize": True, "denominator": "article_count"}, [0.0, 1.5]),
    ],
)
def test_values(rows, choice, expected):
    pts = points(located(rows, [(1.0, 1.0, None, "p1", "gold gold"), (1.0, 1.0, None, "p1", "gold x"), (2.0, 2.0, None, "p1", "")]))
    assert sorted(r.value for r in mapping.map_groups(pts, "gold", **choice).collect()) == expected


def test_all_zero_becomes_one_and_largest_radius(rows):
    pts = points(located(rows, [(1.0, 1.0, None), (2.0, 2.0, None)]))
    groups = mapping.map_groups(pts, "absent", metric="key_term_frequency")
    got = mapping.graduated_radii(groups, 3, 9).collect()
    assert [(r.value, r.radius) for r in got] == [(1.0, 9.0)] * 2
    with pytest.raises(ValueError):
        mapping.map_groups(pts, normalize=True, denominator="letters")


def test_radii(rows):
    pts = points(located(rows, [(float(k), 1.0, None) for k in (1, 2, 2, 3, 3, 3)]))
    radii = mapping.graduated_radii(mapping.map_groups(pts), 10, 5)
    assert sorted(r.radius for r in radii.collect()) == [10.0, 10.5, 11.0]
    assert sorted(r.radius for r in mapping.point_radii(mapping.map_groups(pts)).collect()) == [3.0, 5.0, 5.0]


def test_frames_without_linger(rows):
    got = frames_of(rows, ["1900-01-01", "1900-01-02", "1900-02-01", "1900-02-10"])
    assert got == [(0, "1900-01-01")] + [(1, "1900-02-01")] * 3


def test_linger_may_end_before_the_next_frame(rows):
    dates = ["1900-01-01", "1900-01-05", "1900-02-01"]
    assert frames_of(rows, dates, linger_unit="week", linger=1) == [(0, "1900-01-01"), (1, "1900-02-01")]
    assert frames_of(rows, dates, linger_unit="month", linger=1) == [(0, "1900-01-01")] + [(1, "1900-02-01")] * 2


def test_one_date_has_two_frames(rows):
    assert frames_of(rows, ["1900-01-05"], linger_unit="year", linger=1) == [(0, "1900-01-05"), (1, "1900-02-05")]


def test_undated_points_are_in_no_frame(rows):
    assert frames_of(rows, [None, "soon"]) == []
    assert frames_of(rows, [None, "soon"], linger=2) == []
    assert len(frames_of(rows, [None, "1900-01-01"])) == 1


def loop_frames(dates, unit, size, linger_unit, linger):
    """Frames by loops, from the definition."""
    from broadsheet.functions.dates import step

    times, out = frame_times(min(dates), max(dates), unit, size), []
    for day in dates:
        later = [i for i, t in enumerate(times) if t >= day]
        entry = later[0] if later else len(times) - 1
        if not linger:
            out.append(entry)
            continue
        until = step(day, linger_unit, linger)
        out += [i for i, t in enumerate(times) if i >= entry and t < until]
    return sorted(out)


@pytest.mark.parametrize("unit, size", [("day", 3), ("week", 1), ("month", 1), ("year", 1)])
@pytest.mark.parametrize("linger_unit, linger", [("day", 0), ("day", 5), ("month", 2)])
def test_frames_agree_with_loops(rows, unit, size, linger_unit, linger):
    rng = random.Random(size * 31 + linger)
    dates = [D(1903, 12, 31) + dt.timedelta(days=rng.randint(0, 500)) for _ in range(40)]
    got = frames_of(rows, [d.isoformat() for d in dates], unit=unit, size=size, linger_unit=linger_unit, linger=linger)
    assert [n for n, _ in got] == loop_frames(dates, unit, size, linger_unit, linger)


def test_weights(rows):
    pts = points(located(rows, [(1.0, 1.0, "1900-01-01"), (1.0, 1.0, None), (2.0, 2.0, "1900-01-01")]))
    groups = mapping.map_groups(pts)
    static = sorted((r.lat, r.weight) for r in mapping.heat_points(pts, groups, 0.5).collect())
    assert static == [(1.0, 1.0), (1.0, 1.0), (2.0, 0.5)]
    assert mapping.heat_frames(pts, groups, multiplier=-1).count() == 2
    summed = mapping.heat_frames(pts, groups, per_point=False)
    assert sorted((r.lat, r.weight, r.points) for r in summed.collect()) == [(1.0, 2.0, 1), (2.0, 1.0, 1)]
    zero = groups.withColumn("value", groups.value * 0)
    assert {r.weight for r in mapping.heat_points(pts, zero, 3).collect()} == {3.0}


def test_clusters(rows):
    pts = points(located(rows, [(10.0, 10.0, None)] * 9 + [(10.2, 10.2, None)] * 2 + [(90.0, 10.0, None)] * 1200))
    got = sorted((r.metric_sum, r.locations, r.articles, r.size_class, r.label) for r in mapping.map_clusters(mapping.map_groups(pts)).collect())
    assert got == [(11.0, 2, 11, "medium", "11"), (1200.0, 1, 1200, "large", "1,200")]


def test_levels_of_clusters_equal_clusters_of_every_zoom(rows):
    places = [(x * 7.3 - 89.9, x * 13.7 - 179.9, None) for x in range(24)] + [(-90.0, -180.0, None), (-90.5, -180.5, None), (90.0, 180.0, None)]
    groups = mapping.map_groups(points(located(rows, places * 2))).persist()
    zooms = (7, 0, 3, 3, 18)
    got = mapping.map_cluster_levels(groups, zooms)
    assert got.dropDuplicates(["zoom", "cell_x", "cell_y"]).count() == got.count()
    for zoom in set(zooms):
        want = mapping.map_clusters(groups, zoom)
        level = got.where(got.zoom == zoom).select(*want.columns)
        assert sorted(map(tuple, level.collect())) == sorted(map(tuple, want.collect()))
    assert mapping.map_cluster_levels(groups, []).count() == 0
    assert mapping.map_cluster_levels(groups.limit(0)).count() == 0
    assert mapping.map_cluster_levels(groups, [2], normalized=True).first().label.endswith(".0000")
    with pytest.raises(ValueError):
        mapping.map_cluster_levels(groups, [2.5])


def test_entries_and_titles(rows):
    pts = points(located(rows, [(1.0, 2.0, "19000102", " p1 ", "Head <b>\nthe GOLD rush")]))
    entry = mapping.map_entries(pts, "gold", details=True).first()
    assert entry.label == "1900-01-02 — The T — Rome, IT"
    assert (entry.first_line, entry.page, entry.pdf_url) == ("Head &lt;b&gt;", "p1", "http://x/1.pdf")
    assert entry.context == "Head &lt;b&gt; the <mark>GOLD</mark> rush" == entry.details
    assert mapping.map_entries(pts).first().context == ""
    assert mapping.map_titles(pts, "gold").first().title == 'Articles mentioning "gold" in Rome'
    nowhere = points(located(rows, [(1.0, 2.0, None)], city=" "))
    assert mapping.map_titles(nowhere).first().title == "Articles in this location"


def test_label_falls_back(rows):
    bare = rows([("1", None, None, None, None, 1.0, 1.0, " News "), ("2", None, None, None, None, 1.0, 1.0, None)],
                "article_id string, date string, Title string, City string, State string, Long double, Lat double, headline string")
    got = {r.article_id: r.label for r in mapping.map_entries(points(bare)).collect()}
    assert got == {"1": "News", "2": "Feature"}


def test_summary(rows):
    pts = points(located(rows, [(1.0, 1.0, "1900-01-01"), (1.0, 1.0, "1900-05-01"), (1.0, 1.0, "x")]))
    got = mapping.map_summary(pts).first()
    assert tuple(got) == (3, 1, 1, "1900-01-01", "1900-05-01")
    undated = mapping.map_summary(points(located(rows, [(1.0, 1.0, None)], lccn="")), end="1901-01-01").first()
    assert (undated.start_date, undated.end_date, undated.newspapers) == ("1901-01-01", "1901-01-01", 1)


def test_formats(rows):
    from pyspark.sql import functions as F

    df = rows([(1234.0,), (None,)], "v double")
    shown = df.select(
        mapping.format_metric(F.col("v"), "article_count").alias("a"),
        mapping.format_metric(F.col("v") / 7, "article_count", True).alias("b"),
        mapping.format_coordinate(F.col("v")).alias("c"),
    ).collect()
    assert [tuple(r) for r in shown] == [("1,234", "176.2857", "1234.000000"), ("n/a", "n/a", "")]


def test_metric_labels():
    assert mapping.metric_label(None) == mapping.metric_label("unknown") == "Articles"
    assert mapping.metric_label("KEY_TERM_FREQUENCY", True) == "Term Frequency / Total Words"


def test_attribute_tables(rows):
    pts = points(located(rows, [(1.0, float(i), f"1900-01-0{1 + i}") for i in range(5)]))
    minimal = mapping.attribute_table(pts, "minimal", limit=2)
    assert minimal.columns[:3] == ["Latitude", "Longitude", "date"] and "article" not in minimal.columns
    assert sorted(r.date for r in minimal.collect()) == ["1900-01-01", "1900-01-02"]
    assert "article" not in mapping.attribute_table(pts, "full", lightweight=True).columns
    open_pts = pts.selectExpr("lat", "lon", "day", "article_id", "map('zeta', 'z', 'page', page) AS properties")
    assert mapping.attribute_table(open_pts).columns == ["Latitude", "Longitude", "article_id"]
    listed = mapping.attribute_table(open_pts, properties=("page", "zeta", "Page"))
    assert listed.columns == ["Latitude", "Longitude", "page", "zeta", "Page_"]
    assert {r.Page_ for r in listed.collect()} == {""}
    long = mapping.property_rows(open_pts, "article_id").collect()
    assert len(long) == 10 and {r.property for r in long} == {"page", "zeta"}
    many = points(located(rows, [(1.0, 1.0, "1900-01-01", "p1", "word " * 300)] * 1100))
    assert mapping.attribute_table(many, lightweight=True).count() == 1100
    assert len(mapping.attribute_table(many, "article", article_length=None).first().article) == 1499


def test_mixed_case_names_can_be_written(rows, tmp_path):
    pts = points(located(rows, [(1.0, 1.0, "1900-01-01")])).selectExpr("lat", "lon", "map('page', 'a', 'Page', 'b', 'Headline', 'h') AS properties")
    table = mapping.attribute_table(pts, properties=("page", "Page", "headline"))
    table.write.parquet(str(tmp_path / "t"))
    assert tuple(table.first())[2:] == ("a", "b", "h")


@pytest.mark.parametrize("mode, columns", [("points", "radius"), ("graduated", "radius"), ("cluster", "size_class"), ("heatmap", "frame_no")])
def test_map_tables(rows, mode, columns):
    data = located(rows, [(1.0, 1.0, "1900-01-01"), (2.0, 2.0, "1900-02-01")])
    tables = map_tables(data, "gold", mode=mode)
    assert columns in tables["layer"].columns
    assert {k: t.count() > 0 for k, t in tables.items()} == dict.fromkeys(tables, True)
    flat = map_tables(data, "gold", mode="heatmap", disable_time=True, table_mode="article")["layer"]
    assert flat.columns == ["lat", "lon", "weight"]
