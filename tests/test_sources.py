from plenum.sources import chunks, html


def test_chunks_cover_the_text():
    text = ". ".join(f"sentence number {i} of a long text" for i in range(500))
    points = chunks.cut_points(text)
    assert points[0][0] == 0 and points[-1][1] == len(text)
    assert all(b - a <= chunks.MOST for a, b in points)
    assert all(c < b for (_, b), (c, _) in zip(points, points[1:], strict=False))
    assert chunks.cut_points("") == [] and chunks.cut_points("short") == []


def test_subtitles(spark):
    vtt = "WEBVTT\n\n1\n00:01.500 --> 00:02.000\n<v Jan>Goedenavond</v>\n\n01:00:00.000 --> 01:00:03.250\n[De voorzitter]: Dank u\n\n00:05.000 --> 00:06.000\nzonder naam"
    got = [tuple(r) for r in html.subtitles(spark.createDataFrame([(vtt,)], "value string")).collect()]
    assert got == [(1.5, 2.0, "Jan", "Goedenavond"), (3600.0, 3603.25, "De voorzitter", "Dank u"), (5.0, 6.0, None, "zonder naam")]


def test_links(spark):
    page = '<p><a class="x" href="/a">A <b>b</b></a> <A HREF="/c">C</A></p>'
    got = [tuple(r) for r in html.page_links(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()]
    assert got == [(1, 0, "/a", "A b"), (1, 1, "/c", "C")]
