"""Column functions over texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months and number words.
MONTHS = "januari februari maart april mei juni juli augustus september oktober november december".split()
NUMBER_WORDS = "een twee drie vier vijf zes zeven acht negen tien".split()


def let(value: Column, body) -> Column:
    """body(value), with value computed once: an expression that is used several times is else written out as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def clean_label(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def clean_name(name: Column) -> Column:
    """Without the prefix 'zzz '; a name of digits only is null."""
    return F.when(~F.trim(name).rlike("^[0-9]+$"), F.regexp_replace(name, "^zzz ", ""))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def point_id(document_id: Column, row_id: Column) -> Column:
    """The first 15 hexadecimal digits of md5(document_row) as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", document_id.cast("string"), row_id.cast("string"))), 1, 15), 16, 10).cast("long")


def has_provenance(snippet: Column, stored: Column) -> Column:
    """The snippet's 40 characters from the 21st on stand in the stored text, without regard to case and spacing."""
    anchor = F.substring(normalised(snippet), 21, 40)
    return (F.length(anchor) > 0) & (F.instr(normalised(stored), anchor) > 0)


def attribution(chunk: Column, document: Column) -> Column:
    """missing, exact, whitespace, overlap (0.8 of the chunk's words or more) or mismatch."""
    words, own = word_set(chunk), word_set(document)
    share = F.size(F.array_intersect(words, own)) / F.nullif(F.size(words), F.lit(0))
    return (
        F.when(document.isNull() | chunk.isNull() | (F.trim(chunk) == ""), "missing")
        .when(document.contains(chunk), "exact")
        .when(normalised(document).contains(normalised(chunk)), "whitespace")
        .when(share >= 0.8, "overlap")
        .otherwise("mismatch")
    )


def budget_years(text: Column) -> Column:
    """Sorted distinct years; a range of under ten years is expanded, of a longer one only the first counts."""
    first = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d\d)(?:\s*[-–/]\s*(20\d\d))?\b"), F.lit(0)), lambda m: F.split(m, r"\s*[-–/]\s*"))

    def years(p: Column) -> Column:
        a, b = F.get(p, F.lit(0)).cast("int"), F.coalesce(F.get(p, F.lit(1)), F.get(p, F.lit(0))).cast("int")
        return F.when((b >= a) & (b - a < 10), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(first, years))))


def year_range(question: Column, today: Column) -> Column:
    """The dates (van, tot) that a question's phrase means; the first phrase that fits decides. After and since a year both begin with it,
    before and until end with it; the last month or months are 90 days. Ranges between two years come after all of these."""
    q, y = F.lower(question), F.year(today)
    year = lambda rx, i=1: F.nullif(F.regexp_extract(q, rx, i), F.lit("")).cast("int")
    first, last = (lambda n: F.make_date(n, F.lit(1), F.lit(1))), (lambda n: F.make_date(n, F.lit(12), F.lit(31)))
    none = F.lit(None).cast("date")
    span = lambda a, b: F.struct(a.alias("van"), b.alias("tot"))
    since, until, within = year(r"\b(?:sinds|na|since|from)\s+(20\d{2})\b"), year(r"\b(?:voor|tot)\s+(20\d{2})\b"), year(r"\bin\s+(20\d{2})\b")
    both = r"\b(?:tussen|van)\s+(20\d{2})\s+(?:en|t/m)\s+(20\d{2})\b"
    return (
        F.when(since.isNotNull(), span(first(since), none))
        .when(until.isNotNull(), span(none, last(until)))
        .when(within.isNotNull(), span(first(within), last(within)))
        .when(q.rlike(r"\b(vorig\s+jaar|last\s+year)\b"), span(first(y - 1), last(y - 1)))
        .when(q.rlike(r"\b(dit\s+jaar|this\s+year)\b"), span(first(y), last(y)))
        .when(q.rlike(r"\bafgelopen\s+maand(en)?\b"), span(F.date_sub(today, 90), today))
        .when(q.rlike(both), span(first(year(both)), last(year(both, 2))))
        .when(year(r"\bvanaf\s+(20\d{2})\b").isNotNull(), span(first(year(r"\bvanaf\s+(20\d{2})\b")), none))
        .otherwise(span(none, none))
    )


def spoken_period(question: Column, today: Column) -> Column:
    """The dates (van, tot) of the last N years or months (365 and 30 days each), N in digits or words; or of since, in, and from a year to another."""
    q = F.replace(F.lower(question), F.lit("één"), F.lit("een"))
    number = r"(\d+|" + "|".join(NUMBER_WORDS) + ")"
    word = lambda rx: F.nullif(F.regexp_extract(q, rx, 1), F.lit(""))
    known = F.array(*[F.lit(w) for w in NUMBER_WORDS])

    def count(unit: str) -> Column:
        found = word(rf"(?:afgelopen|laatste)\s+{number}\s+{unit}")
        return F.nullif(F.coalesce(found.try_cast("int"), F.array_position(known, found).cast("int")), F.lit(0))

    day = lambda year, end: F.try_to_date(F.concat(year, F.lit(end)))
    span = lambda a, b: F.struct(a.alias("van"), b.alias("tot"))
    none = F.lit(None).cast("date")
    since, within, begin = word(r"sinds\s+(\d{4})"), word(r"\bin\s+(\d{4})\b"), word(r"van\s+(\d{4})\s+tot\s+\d{4}")
    return (
        F.when(count("jaar").isNotNull(), span(F.date_sub(today, (365 * count("jaar")).cast("int")), today))
        .when(since.isNotNull(), span(day(since, "-01-01"), today))
        .when(within.isNotNull(), span(day(within, "-01-01"), day(within, "-12-31")))
        .when(count("maanden").isNotNull(), span(F.date_sub(today, (30 * count("maanden")).cast("int")), today))
        .when(begin.isNotNull(), span(day(begin, "-01-01"), day(word(r"van\s+\d{4}\s+tot\s+(\d{4})"), "-12-31")))
        .otherwise(span(none, none))
    )


#: What shows that a question names a time.
TEMPORAL_SIGNALS = "vorig|afgelopen|sinds|recent|eerder|laatste|dit jaar|vorige maand|begin 20|eind 20|na 20|voor 20|in 20|from 20|since 20|last year|this year|ago".split("|")


def names_a_time(question: Column) -> Column:
    return F.coalesce(F.lower(question).rlike("|".join(TEMPORAL_SIGNALS)), F.lit(False))


def dutch_date(text: Column) -> Column:
    """'5 maart 2024' to a date."""
    part = lambda i: F.regexp_extract(F.lower(text), r"(\d{1,2}) (" + "|".join(MONTHS) + r") (\d{4})", i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(2)).cast("int")
    return F.when(part(2) != "", F.try_to_date(F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0"))))


#: Outcomes, in the order in which they are looked for, and what they must stand near.
OUTCOMES = "aangenomen verworpen ingetrokken aangehouden".split()
VOTED_ON = "motie|amendement|voorstel"


def vote_outcome(text: Column) -> Column:
    """The first outcome whose first place has a word of VOTED_ON within 200 characters on either side."""
    low = F.lower(text)

    def near(word: str) -> Column:
        at = F.instr(low, word)
        window = F.substring(low, F.greatest(at - 200, F.lit(1)), F.least(at, F.lit(201)) - 1 + len(word) + 200)
        return (at > 0) & window.rlike(VOTED_ON)

    return F.coalesce(*[F.when(near(w), w) for w in OUTCOMES])


def title_outcome(name: Column) -> Column:
    """The first outcome that a title names, else onbekend."""
    return F.coalesce(*[F.when(F.lower(name).contains(w), w) for w in OUTCOMES], F.lit("onbekend"))


def vote_counts(text: Column) -> Column:
    """(voor, tegen): 45 to 0 'met algemene stemmen', else of one phrase that has both; null without one."""
    together = r"(?i)met\s+(\d+)\s+stemmen?\s+voor\s+en\s+(\d+)\s+(?:stemmen?\s+)?tegen"
    apart = r"(?is)(\d+)\s+(?:stemmen?\s+)?voor.*?(\d+)\s+(?:stemmen?\s+)?tegen"
    told = lambda rx: F.struct(F.regexp_extract(text, rx, 1).try_cast("int").alias("voor"), F.regexp_extract(text, rx, 2).try_cast("int").alias("tegen"))
    unanimous = F.struct(F.lit(45).alias("voor"), F.lit(0).alias("tegen"))
    return F.when(text.rlike(r"(?i)met\s+algemene\s+stemmen"), unanimous).when(text.rlike(together), told(together)).when(text.rlike(apart), told(apart))


def motion_number(text: Column) -> Column:
    """The first number of a motion or amendment, as in 'motie nr. M2023-042'."""
    return F.nullif(F.regexp_extract(text, r"(?i)(?:motie|amendement)\s+(?:nr\.?\s*)?([A-Z]?\d{4}[-/]\d{2,4})", 1), F.lit(""))


#: Parties by their aliases, and words in parentheses that are roles.
PARTIES = {
    "pvda": "PvdA", "partij van de arbeid": "PvdA", "pvda/groenlinks": "GroenLinks-PvdA", "groenlinks/pvda": "GroenLinks-PvdA", "groenlinks-pvda": "GroenLinks-PvdA",
    "gl-pvda": "GroenLinks-PvdA", "gl/pvda": "GroenLinks-PvdA", "glpvda": "GroenLinks-PvdA", "groenlinks": "GroenLinks", "vvd": "VVD", "d66": "D66", "denk": "DENK",
    "sp": "SP", "volt": "Volt", "cda": "CDA", "bij1": "BIJ1", "50plus": "50PLUS", "50+": "50PLUS", "christenunie": "ChristenUnie", "sgp/christenunie": "SGP/ChristenUnie",
    "christenunie/sgp": "SGP/ChristenUnie", "sgp": "SGP", "leefbaar": "Leefbaar Rotterdam", "leefbaar rotterdam": "Leefbaar Rotterdam", "lr": "Leefbaar Rotterdam",
    "nida": "NIDA", "partij voor de dieren": "Partij voor de Dieren", "pvdd": "Partij voor de Dieren",
}
ROLES = "voorzitter commissievoorzitter wethouder burgemeester secretaris griffier lid plaatsvervangend raadslid commissielid".split()


def _literal(word: str) -> str:
    return "".join("\\" + c if c in "+.()[]*?^$|/-" else c for c in word)


def party(raw: Column, aliases: dict[str, str] = PARTIES) -> Column:
    """The party that an alias names, else null."""
    return F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])[F.lower(F.trim(raw))]


def party_in_query(question: Column, aliases: dict[str, str] = PARTIES) -> Column:
    """The party of the longest alias that stands by itself in a question."""
    low = F.lower(question)
    longest = sorted(aliases, key=len, reverse=True)
    return F.coalesce(*[F.when(low.rlike(rf"(?<![a-zà-ÿ]){_literal(a)}(?![a-zà-ÿ])"), aliases[a]) for a in longest])


def speakers(text: Column) -> Column:
    """Array of (speaker, party) of 'De heer NAME (PARTY)' and then '[NAME (PARTY)]:', each speaker once; roles are no parties."""
    found = []
    for rx in (r"(?:[Dd]e heer|[Mm]evrouw)\s+(\w[\w\s.'-]{1,40}?)\s*\(([^)]{2,40})\)", r"\[([^\]]+?)\s*\(([^)]{2,40})\)\]\s*:"):
        names, inside = (F.regexp_extract_all(text, F.lit(rx), F.lit(i)) for i in (1, 2))
        found.append(F.arrays_zip(names.alias("name"), inside.alias("raw")))
    named = F.filter(F.concat(*found), lambda x: ~F.lower(F.trim(x["raw"])).isin(ROLES))
    rows = F.transform(named, lambda x: F.struct(F.regexp_replace(F.trim(x["name"]), r"\.+$", "").alias("speaker"), party(x["raw"]).alias("party")))
    keys = F.transform(rows, lambda x: F.lower(x["speaker"]))
    return F.filter(rows, lambda x, i: F.array_position(keys, F.lower(x["speaker"])) == i + 1)


def parties_in_text(text: Column) -> Column:
    """The parties that a text's speakers belong to, in order of their first place."""
    found = []
    for rx in (r"(?:[Dd]e heer|[Mm]evrouw)\s+\w[\w\s.'-]{1,40}?\s*\(([^)]{2,40})\)", r"\[[^\]]+?\s*\(([^)]{2,40})\)\]\s*:"):
        found.append(F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), lambda x: party(x)))
    return F.array_distinct(F.array_compact(F.concat(*found)))


def without_role(name: Column) -> Column:
    """A speaker's name without roles in parentheses and titles before it."""
    plain = F.regexp_replace(name, r"(?i)\((commissievoorzitter|lid|plaatsvervangend voorzitter|wethouder|burgemeester|secretaris|raadslid)\)", "")
    for title in ("wethouder", "voorzitter", "burgemeester", "de heer", "mevrouw"):
        plain = F.regexp_replace(plain, rf"(?i)^{title}\s+", "")
    return F.trim(plain)


#: Words that speech recognition mistakes.
CORRECTIONS = {"koor": "COR", "kor": "COR", "ibab": "iBabs", "ibabs": "iBabs", "royal cast": "Royalcast", "royalcast": "Royalcast", "raads voorstel": "raadsvoorstel", "ver vallen": "vervallen"}


def corrected(text: Column) -> Column:
    for wrong, right in CORRECTIONS.items():
        text = F.regexp_replace(text, rf"(?i)\b{wrong}\b", right)
    return text


def section_topic(title: Column, meeting: Column) -> Column:
    """'committee: the title's first ten words', the committee being what stands before ' - ' in the meeting's name, at most 60 characters."""
    words = F.array_join(F.slice(F.array_remove(F.split(F.trim(title), r"\s+"), ""), 1, 10), " ")
    committee = F.substring(F.trim(F.get(F.split(meeting, " - "), F.lit(0))), 1, 60)
    return F.when(F.length(title) > 0, F.when(F.length(committee) > 0, F.concat(committee, F.lit(": "), words)).otherwise(words))


#: Abbreviations after which no sentence ends.
ABBREVIATIONS = "bijv bv nl o.a m.a.w d.w.z i.p.v t.o.v enz etc a.u.b z.o.z jl b.v vgl art lid dhr mw drs dr ir mr ing prof sr jr ca m.i i.v.m i.h.b t.a.v t.e.m m.b.t n.v.t ivm iom tbv tav".split()


def sentences(text: Column) -> Column:
    """Sentences end with . ? or ! before a capital or digit, but not after an abbreviation."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    guard = "".join(rf"(?<!(?i:(?:^|[ (]){_literal(a)})\.)" for a in ABBREVIATIONS)
    return F.filter(F.split(plain, rf"(?<=[.?!]){guard} (?=[\p{{Lu}}\p{{N}}\"'(\[])"), lambda x: x != "")


def dutch_date_text(day: Column) -> Column:
    """A date to '5 maart 2024'."""
    month = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.month(day) - 1)
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), month, F.year(day).cast("string"))


def coerced_date(raw: Column) -> Column:
    """The date that a text begins with, else null."""
    return F.try_to_date(F.substring(raw, 1, 10))


def clock(s: Column) -> Column:
    """Seconds to H:MM:SS."""
    n = F.floor(s).cast("int")
    return F.format_string("%d:%02d:%02d", F.floor(n / 3600).cast("int"), F.floor(n % 3600 / 60).cast("int"), n % 60)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def seconds(clock: Column) -> Column:
    """H:MM:SS.mmm or MM:SS.mmm to seconds."""
    p = F.split(F.replace(clock, F.lit(","), F.lit(".")), ":")
    return F.aggregate(p, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))


def surname_key(name: Column) -> Column:
    """The last word that is no particle, title or initial, up to a hyphen."""
    plain = F.regexp_replace(F.lower(name), r"\b(dhr|mevr|mr|drs|dr|ir|prof|wethouder|burgemeester|raadslid)\b\.?|\b\p{L}\.", "")
    words = F.filter(F.split(F.trim(plain), r"\s+"), lambda w: ~w.isin("van", "de", "der", "den", "het", "ten", "ter", "te", "la", "el", ""))
    return F.nullif(F.get(F.split(F.try_element_at(words, F.lit(-1)), "-"), F.lit(0)), F.lit(""))


#: Words that are no names even with a capital.
FUNCTION_WORDS = """de het een van in op voor met door aan uit over bij naar tot als om dat die dit deze er ook maar nog wel niet geen wat dan meer zeer alle andere wordt worden werd
zijn was heeft hebben kan moet zal zou na te is en of zo""".split()


def facts(sentence: Column) -> Column:
    """What can be held against a source, lowered: numbers, dates, and words with a capital that neither begin the sentence nor are function words."""
    low = F.lower(sentence)
    numbers = F.regexp_extract_all(low, F.lit(r"\d[\d.,]*\d|\d+"), F.lit(0))
    dates = F.regexp_extract_all(low, F.lit(r"\d{1,2}\s+(?:" + "|".join(MONTHS) + r")\s+\d{4}"), F.lit(0))
    words = F.transform(F.split(F.trim(sentence), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_-]", ""))
    names = F.filter(words, lambda w, i: (i > 0) & w.rlike(r"^\p{Lu}") & ~F.lower(w).isin(FUNCTION_WORDS))
    return F.array_union(F.array_union(numbers, dates), F.transform(names, F.lower))


def grounded_share(sentence: Column, corpus: Column) -> Column:
    """Share of the sentence's facts that stand in corpus; null without facts."""
    f = facts(sentence)
    return F.size(F.filter(f, lambda x: F.instr(F.lower(corpus), F.lower(x)) > 0)) / F.nullif(F.size(f), F.lit(0))
