"""What parties say, hand in, ask and vote, out of minutes; the policy area of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Policy areas in the order in which they are looked for, and the words that name them.
AREAS = {
    "wonen": ["huis", "woning", "huur", "koop", "leegstand", "sociale"],
    "klimaat": ["klimaat", "co2", "duurzaam", "energie", "groen"],
    "mobiliteit": ["fiets", "auto", "verkeer", "parkeer", "openbaar vervoer"],
    "onderwijs": ["school", "onderwijs", "student", "universiteit"],
    "zorg": ["zorg", "gezondheid", "jeugd", "ouderen", "wmo"],
    "economie": ["bedrijf", "economie", "werk", "handel"],
    "veiligheid": ["veiligheid", "politie", "criminaliteit"],
    "inclusiviteit": ["inclusiviteit", "discriminatie", "migratie", "gelijk"],
}
#: How minutes write what a party does. Group 1 is its text, for votes group 1 the direction and group 2 the text; the number is its most characters.
SPANS = {
    "uitspraak": ([r"(?i)\(GroenLinks[^\)]*\):\s*([^(\n]{50,})", r"(?i)\(PvdA[^\)]*\):\s*([^(\n]{50,})", r"(?i)GL-fractie.*?:\s*([^(\n]{50,})"], 150),
    "motie": ([r"(?i)(motie.*?(?:groenlinks|pvda)[^\n\.]{30,}(?:[.!?]|$))"], 150),
    "vraag": ([r"(?i)(vraag.*?(?:groenlinks|pvda)[^\n\.]{30,}(?:[.!?]|$))"], 150),
}
VOTES, VOTE_LENGTH = r"(?i)(voor|tegen|onthouden):\s*([^;\n]*(?:groenlinks|pvda)[^;\n]*)", 100
PROPOSAL, INITIATIVE = "raadsvoorstel", "initiatiefvoorstel"


def area(text: Column) -> Column:
    """The first policy area that a word of a text names, else Overig."""
    low = F.lower(text)
    named = lambda words: low.rlike("|".join(words))
    return F.coalesce(*[F.when(named(words), name.capitalize()) for name, words in AREAS.items()], F.lit("Overig"))


def positions(minutes: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, place (from 1, within key and kind), direction (votes only), said, area of everything that parties say, hand in, ask and vote in whole texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    row = lambda said, direction: F.struct(direction.alias("direction"), said.alias("said"))
    none = F.lit(None).cast("string")
    shortened = lambda spans, most: F.transform(spans, lambda x: row(F.left(x, F.lit(most)), none))
    found = []
    for kind, (patterns, most) in SPANS.items():
        spans = F.flatten(F.array(*[F.regexp_extract_all(whole, F.lit(rx), F.lit(1)) for rx in patterns]))
        found.append(F.struct(F.lit(kind).alias("kind"), shortened(spans, most).alias("rows")))
    votes = F.arrays_zip(F.regexp_extract_all(whole, F.lit(VOTES), F.lit(1)).alias("d"), F.regexp_extract_all(whole, F.lit(VOTES), F.lit(2)).alias("t"))
    found.append(F.struct(F.lit("stemming").alias("kind"), F.transform(votes, lambda v: row(F.left(v["t"], F.lit(VOTE_LENGTH)), F.upper(v["d"]))).alias("rows")))
    each = minutes.select(key, F.explode(F.array(*found)).alias("f")).select(key, "f.kind", F.posexplode("f.rows").alias("place", "x"))
    return each.select(key, "kind", (F.col("place") + 1).cast("long").alias("place"), "x.direction", "x.said", area(F.col("x.said")).alias("area"))


#: Parties that a position is held against; what shows the kind of evidence and the position, the first that is found.
PARTY = r"(?i)groenlinks|pvda|partij van de arbeid"
EVIDENCE = [("wethouder_respons", "wethouder|reactie|antwoord|zegt|stelt"), ("stemgedrag", "stemming|voor|tegen|onthouden|aangenomen|verworpen"), ("begroting", "budget|miljoen|€|begroting|geld")]
STANCES = [("College kiest voor marktmechanismen in ", "markt"), ("College investeert in ", "investeringen|budget"), ("College benadrukt duurzaamheid in ", "duurzaam|groen"), ("College heeft reserveringen over GL-PvdA voorstellen in ", "tegen|bezwaar")]
OTHERWISE = "College positie inferred op "
#: Areas that are looked for, all but the last of AREAS.
IMPLIED = list(AREAS)[:-1]


def context(text: Column, word: str) -> Column:
    """From 50 characters before the first word that begins with word to 150 after it; where that is 20 characters or less, the text's first 200."""
    found = F.regexp_extract(text, rf"(?is)(.{{0,50}}?\b{word}\w{{0,50}}.{{0,150}})", 1)
    return F.when(F.length(found) > 20, found).otherwise(F.left(text, F.lit(200)))


def implied(minutes: DataFrame, key: str, text: str) -> DataFrame:
    """key, area, evidence, position, context, strength: what the executive's position on an area may be, for each area that a text with the parties names."""
    whole, low = F.col(text), F.lower(F.col(text))
    first = lambda table, other: F.coalesce(*[F.when(low.rlike(words), name) for name, words in table], F.lit(other))
    each = F.array_compact(F.array(*[F.when(low.contains(a), F.struct(F.lit(a).alias("area"), context(whole, a).alias("context"))) for a in IMPLIED]))
    rows = minutes.filter(whole.rlike(PARTY)).select(key, first(EVIDENCE, "uitspraak").alias("evidence"), first(STANCES, OTHERWISE).alias("stance"), F.explode(each).alias("x"))
    n = F.length("x.context")
    strength = F.when(n > 200, "STERK").when(n > 100, "MATIG").otherwise("ZWAK")
    return rows.select(key, F.initcap("x.area").alias("area"), "evidence", F.concat("stance", "x.area").alias("position"), F.left("x.context", F.lit(150)).alias("context"), strength.alias("strength"))
