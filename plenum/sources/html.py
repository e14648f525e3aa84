"""Rows out of HTML and subtitles."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import dutch_date, let, seconds
from plenum.operators.shared import written


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, place, href, label of each link."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("place", "tag"))
    label = F.trim(F.regexp_replace(F.regexp_extract("tag", r"(?is)>(.*)</a>", 1), "<[^>]*>", ""))
    return rows.select("page_id", "place", F.regexp_extract("tag", r'(?i)href="([^"]*)"', 1).alias("href"), label.alias("label"))


def subtitles(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """start, stop, speaker, text of each WebVTT cue; a speaker stands as <v name> or [name]:."""
    cue = F.explode(F.split(F.regexp_replace(text_col, "\r", ""), r"\n\s*\n")).alias("cue")
    clock = r"((?:\d+:)?\d+:\d+[.,]\d+) --> ((?:\d+:)?\d+:\d+[.,]\d+)[^\n]*\n([\s\S]*)"
    rows = texts.select(cue).filter(F.col("cue").rlike(clock))
    part = lambda i: F.regexp_extract("cue", clock, i)
    said = r"^\s*(?:<v ([^>]+)>|\[([^\]]+)\]:)\s*"
    speaker = F.coalesce(F.nullif(F.regexp_extract(part(3), said, 1), F.lit("")), F.nullif(F.regexp_extract(part(3), said, 2), F.lit("")))
    return rows.select(seconds(part(1)).alias("start"), seconds(part(2)).alias("stop"), speaker.alias("speaker"), F.trim(F.regexp_replace(F.regexp_replace(part(3), said, ""), "</?v[^>]*>", "")).alias("text"))


#: Elements without content, and those whose text isn't shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(["script", "style"])


class _Outline(HTMLParser):
    """The elements and texts of a page in order, each with the places of what it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def _put(self, tag: str, text: str | None, attributes: dict) -> int:
        self.rows.append((len(self.rows), tag, [at for at, _ in self.open], [t for _, t in self.open], attributes.get("href"), attributes.get("class"), text))
        return len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        at = self._put(tag, None, dict(attrs))
        if tag not in VOID:
            self.open.append((at, tag))

    def handle_startendtag(self, tag, attrs):
        self._put(tag, None, dict(attrs))

    def handle_endtag(self, tag):
        if any(t == tag for _, t in self.open):  # what was left open inside it ends, too
            while self.open.pop()[1] != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not (self.open and self.open[-1][1] in HIDDEN):
            self._put("#text", data.strip(), {})


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, at, tag, within, inside, href, class, text: elements and texts (tag '#text') of each page in order; within has the places of all elements around
    one, from the outermost on, inside their tags. Null pages have none; pages are read whole."""
    kinds = (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string(), pa.string())
    names = ["at", "tag", "within", "inside", "href", "class", "text"]

    def read(batches):
        for b in batches:
            for i, page in enumerate(b[html]):
                outline = _Outline()
                outline.feed(page.as_py() or "")
                outline.close()
                for start in range(0, len(outline.rows), 20_000):
                    columns = list(zip(*outline.rows[start : start + 20_000], strict=True))
                    own = b[key].take(pa.array([i] * len(columns[0]), pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [key, *names])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInArrow(read, f"`{key}` {kind}, at int, tag string, within array<int>, inside array<string>, href string, class string, text string")


#: What a card of the calendar is known by, and how days and times are written on it.
AGENDA, CARDS = "/Agenda/Index/", ("article", "div")
DAY, TIME = r"(?i)\b(?:maandag|dinsdag|woensdag|donderdag|vrijdag|zaterdag|zondag)\b", r"^\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2}$"


def calendar(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, meeting, name, committee, location, subtitle, start: the meetings of calendar pages, each once, by the first link to its agenda.

    Its card is the nearest article or div around the link, else the link; the card's texts are read up to the first time. The first one is the committee, the
    first in parentheses the location, the last with a weekday the day, the first other one of 4 to 119 characters without an @ the subtitle."""
    around = lambda *tags: F.filter("within", lambda x, i: F.get("inside", i).isin(*tags))
    meeting = F.when((F.col("tag") == "a") & F.col("href").contains(AGENDA), F.nullif(F.element_at(F.split("href", "/"), -1), F.lit("")))
    rows = nodes(pages, key, html).select(key, "at", "text", meeting.alias("meeting"), F.when(F.col("tag") == "#text", around("a", *CARDS)).alias("cards"), F.coalesce(F.try_element_at(around(*CARDS), F.lit(-1)), "at").alias("card"))
    rows = written(rows.filter("meeting is not null or text is not null"))  # read twice below; a page is parsed once
    cards = rows.filter("meeting is not null").groupBy(key, "meeting").agg(F.min_by("card", "at").alias("card"))
    part = F.explode(F.split("text", r"\|")).alias("part")
    said = rows.filter("text is not null").select(key, F.explode("cards").alias("card"), "at", "text").select(key, "card", "at", part).withColumn("part", F.trim("part")).filter("part != ''")
    said = said.groupBy(key, "card").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))  # the texts of one card
    each = cards.join(said.hint("merge"), [key, "card"]).select(key, "meeting", "p")  # neither side is ever broadcast
    parts = F.transform("p", lambda x: x["part"])
    is_day, is_time = (lambda x: x.rlike(DAY)), (lambda x: x.rlike(TIME) & ~x.rlike(DAY))
    is_place = lambda x: x.startswith("(") & x.endswith(")")
    until = lambda xs: F.coalesce(F.array_min(F.filter(F.transform(xs, lambda x, i: F.when(is_time(x), i)), lambda i: i.isNotNull())), F.size(xs))
    rest = let(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda xs: F.slice(xs, 1, until(xs) + 1))
    found = each.select(key, "meeting", F.get(parts, F.lit(0)).alias("committee"), rest.alias("rest"))
    other = lambda x, i: ~is_day(x) & ~is_time(x) & ~(is_place(x) & (F.array_position(F.transform("rest", is_place), True) == i + 1)) & F.length(x).between(4, 119) & ~x.contains("@")
    day, time = F.try_element_at(F.filter("rest", is_day), F.lit(-1)), F.get(F.filter("rest", is_time), F.lit(0))
    found = found.select(key, "meeting", "committee", F.regexp_replace(F.get(F.filter("rest", is_place), F.lit(0)), r"^[()]+|[()]+$", "").alias("location"), F.get(F.filter("rest", other), F.lit(0)).alias("subtitle"), day.alias("day"), time.alias("time"))
    begin = F.coalesce(F.lpad(F.trim(F.substring_index("time", "-", 1)), 5, "0"), F.lit("00:00"))
    start = F.to_timestamp(F.concat_ws(" ", dutch_date(F.col("day")).cast("string"), begin))
    name = F.coalesce(F.concat("committee", F.lit(" — "), "subtitle"), "committee", F.lit("Vergadering"))
    return found.select(key, "meeting", name.alias("name"), "committee", "location", "subtitle", F.when(dutch_date(F.col("day")).isNotNull(), start).alias("start"))
