"""Rule trees over names and texts: document types, damage, signals, substantive items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.text import let

#: The first pattern that a lowered name has gives its type.
DOC_TYPES = [
    ("motie", "motie"), ("amendement", "amendement"), ("raadsvoorstel", "raadsvoorstel"), ("notulen", "notulen"), ("verslag", "verslag"), ("besluitenlijst", "besluitenlijst"),
    ("begroting|jaarrekening|financ", "financieel"), ("brief", "brief"), ("annotati", "annotatie"), ("transcript", "virtual_notulen"),
]
#: Classes by parts of a name, and parts that exclude them.
CLASSES = [
    ("motie", ["motie"], ["promotie", "demotie"]), ("amendement", ["amendement"], []), ("notulen", ["notulen"], []), ("verslag", ["verslag"], ["notulen"]), ("agenda", ["agenda"], []),
    ("annotatie", ["annotatie"], []), ("adviezenlijst", ["adviezenlijst", "advieslijst"], []), ("besluitenlijst", ["besluitenlijst"], []), ("spreektijdentabel", ["spreektijd"], []),
]
#: Words of budgets.
FINANCIAL = (
    r"begrot(?:ing|e)|jaarstukken|jaarrekening|voorjaarsnota|najaarsnota|10[\s-]?maands|lasten\s+en\s+baten|saldo\b|reserves?\b|programma(?:rekening|begroting)"
    r"|taakveld(?:en)?|x\s*€?\s*1\.000|dekkingspercentage|kostendekkend|gemeentefonds|ozb\b|afvalstoffenheffing|rioolheffing"
)
#: What a document's name says of its layout.
FINANCIAL_NAME = r"begroting|jaarstuk|jaarrekening|voorjaarsnota|10.?maands"
TABLE_NAME = r"bestemmingsplan|mer\b|deelrapport|milieu.?effect|havenbestemmings|bijlage.*rapport|verslag.*hoorzitting|toelichting|rapportage"
TABLE_LENGTH = 100_000


def substantive(number: Column, name: Column, meeting: Column) -> Column:
    """Whether an agenda item is more than procedure."""
    low, group = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(meeting, F.lit("")))
    cor = group.contains("commissie tot onderzoek van de rekening") | F.array_contains(F.split(group, r"\s+"), "cor")
    first = F.coalesce(F.get(F.split(number, r"\."), F.lit(0)).try_cast("double") == 1.0, F.lit(False))
    worth = low.rlike("regeling van werkzaamheden|verkenning|voorstel|beleid|strategie")
    return ~low.contains("ingekomen stukken") & ~(first & ~cor & ~worth) & ~low.contains("vaststellen van de agenda")


def doc_type(name: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(name).rlike(rx), kind) for rx, kind in DOC_TYPES], F.lit("overig"))


def doc_class(name: Column) -> Column:
    """The first class whose parts a name has without those that exclude it; null without one."""
    low = F.lower(name)
    has = lambda parts: low.rlike("|".join(parts))
    return F.coalesce(*[F.when(has(parts) & ~has(without) if without else has(parts), kind) for kind, parts, without in CLASSES])


def garbled(text: Column) -> Column:
    """Whether words have run together, once addresses, file names, paths and codes are out."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def prose(x: Column) -> Column:  # a file name is looked for from the beginning of a word only: from its other letters it would be the same one
        for rx in (r"(?i)https?://\S+", r"(?i)(?<!\S)\S+\.(?:pdf|docx?|xlsx?|txt|xml|json|csv|png|jpg)\b", r"(?<!\w)/[\w/.\-]{15,}", r"\b(?:[A-Z]{2,}[\-_]){2,}[A-Z0-9]+\b|\b[A-Z0-9]{20,}\b"):
            x = F.regexp_replace(x, rx, " ")
        return trimmed(x)

    told = lambda x: F.struct(
        F.length(x).alias("size"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).alias("blanks"), F.length(F.array_join(F.regexp_extract_all(x, F.lit(r"[^\s]{35,}"), F.lit(0)), "")).alias("runs"),
    )

    def judged(x: Column) -> Column:
        spaces, run = x["blanks"] / x["size"], x["runs"] / x["size"]
        return (x["size"] >= 20) & (((spaces < 0.06) & (run > 0.05)) | (run > 0.20) | ((spaces < 0.10) & (run > 0.10)))

    whole = lambda x: F.when(F.length(trimmed(x)) >= 50, let(let(prose(x), told), judged))
    return F.coalesce(let(text, whole), F.lit(False))


def layout(doc_id: Column, name: Column, content: Column) -> Column:
    """Which of seven ways a document is read; garbled texts are known by their first 5,000 characters."""
    money, tables = F.lower(name).rlike(FINANCIAL_NAME), F.lower(name).rlike(TABLE_NAME) & (F.length(content) > TABLE_LENGTH)
    kinds = lambda broken: (
        F.when(doc_id.startswith("transcript_"), "transcript")
        .when(money & tables, "financial_table_rich").when(money, "financial")
        .when(broken & tables, "garbled_table_rich").when(broken, "garbled_ocr")
        .when(tables, "table_rich").otherwise("regular")
    )
    return let(garbled(F.substring(content, 1, 5000)), kinds)


def damage(text: Column, term: str) -> Column:
    """The first fault of a text: unclean characters, a term that stands only inside other words, ligatures, words without spaces between."""
    clean = F.length(F.regexp_replace(text, r"[^\x20-\x7E\xC0-\xFF\n]", "")) / F.greatest(F.length(text), F.lit(1))
    low = F.lower(text)
    return (
        F.when(clean < 0.95, "low_clean_ratio")
        .when(low.contains(term) & ~low.rlike(rf"(^|[^\p{{L}}\p{{N}}]){term}([^\p{{L}}\p{{N}}]|$)"), "bm25_miss")
        .when(text.rlike("[ﬁﬂ]"), "ligature")
        .when(text.rlike("[a-zà-ÿ]{3,}[A-ZÀ-Ý][a-zà-ÿ]{2,}[A-ZÀ-Ý]") & text.rlike(r"[^\s]{40,}"), "garbled_spacing")
        .otherwise("unknown")
    )


def financial_hits(text: Column) -> Column:
    """Lowered words of budgets in a text of 200 characters or more, as often as they stand there."""
    return F.when(F.length(text) >= 200, F.regexp_extract_all(F.lower(text), F.lit(FINANCIAL), F.lit(0))).otherwise(F.array().cast("array<string>"))


#: Joint bodies by what names them.
ENTITIES = [("grjr", r"grjr|jeugdhulp.*rijnmond|gemeenschappelijke.*regeling.*jeugd"), ("dcmr", r"dcmr|milieudienst.*rijnmond"), ("vrr", r"vrr|veiligheidsregio.*rotterdam"), ("mrdh", r"mrdh|metropoolregio")]


def entity(title: Column, url: Column, content: Column) -> Column:
    """The body that a title, else an address, else a text's first 500 characters name; rotterdam if none does."""
    return F.coalesce(*[F.when(F.lower(x).rlike(rx), kind) for x in (title, url, F.substring(content, 1, 500)) for kind, rx in ENTITIES], F.lit("rotterdam"))
