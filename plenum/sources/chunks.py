"""Chunks of long texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST, MOST, OVERLAP, SHORTEST = 2000, 2500, 250, 20
BREAKS = ("\n\n", "\n", ". ", "; ", " ")


def cut_points(text: str) -> list[tuple[int, int]]:
    """(start, end) of chunks: the best break between LEAST and MOST characters, then OVERLAP back; short ends are left out."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + MOST)
        if end < len(text):
            for mark in BREAKS:
                found = text.rfind(mark, at + LEAST, end)
                if found >= 0:
                    end = found + len(mark)
                    break
        if len(text[at:end].strip()) >= SHORTEST:
            out.append((at, end))
        if end == len(text):
            break
        at = max(at + 1, end - OVERLAP)
    return out


def recursive_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, chunk_index, start, stop, content; each text is scanned by itself."""

    def cut(batches):
        for b in batches:
            rows = [(i, k, s, e, t[s:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for k, (s, e) in enumerate(cut_points(t))]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [id_col, "chunk_index", "start", "stop", "content"])

    return docs.select(id_col, text_col).mapInArrow(cut, f"{id_col} long, chunk_index int, start int, stop int, content string")


#: Characters of a narrative chunk at most, and about as many that the next one takes along.
NARRATIVE, CARRIED = 2000, 250
#: Characters of chunks that a task holds before it hands them on.
HELD = 1_000_000
HEADING = re.compile(r"(#{1,4})\s+(\S.*)", re.DOTALL)
CAPITALS = re.compile(r"[A-Z][A-Z\s]{3,}")


def without_tables(text: str) -> str:
    """A text without its Markdown tables: rows that begin with | and have another one, and the empty line after the last of them."""
    out, table = [], False
    for line in text.splitlines():
        row = line.strip()
        is_row = row.startswith("|") and row.count("|") > 1
        if not is_row and not (table and not row):
            out.append(line)
        table = is_row
    return "\n".join(out)


def tail(block: str) -> str:
    """What the next chunk takes along: from a paragraph's or else a sentence's beginning within the last characters on, else just as many."""
    low = max(0, len(block) - CARRIED - 100)
    paragraph, sentence = block.rfind("\n\n", low, max(0, len(block) - 50)), block.rfind(". ", low)
    if len(block) <= CARRIED:
        return block
    return block[paragraph if paragraph > low else sentence + 2 if sentence > low else -CARRIED :].strip()


def narrative(text: str, name: str) -> list[tuple[str, str, str]]:
    """(title, path, content): paragraphs put together to chunks. The title is the last heading before a chunk ends, the path all headings above it,
    the name of the document first; a line of capitals is a heading of the first level. Short texts are one chunk under the document's name."""
    text = without_tables(text).strip()
    if len(text) <= NARRATIVE:
        return [(name, name, text)] if text else []
    out, headings, block = [], [], ""

    def ended() -> None:
        if block.strip():
            title = headings[-1][1] if headings else name
            out.append((title, " > ".join([name, *(h for _, h in headings)]), block.strip()))

    for paragraph in filter(None, (p.strip() for p in re.split(r"\n{2,}", text))):
        found = HEADING.match(paragraph)
        level, title = (len(found[1]), found[2].strip()[:200]) if found else (1, paragraph[:200]) if CAPITALS.fullmatch(paragraph) else (0, "")
        if level:
            headings = [h for h in headings if h[0] < level] + [(level, title)]
        full = len(block) + len(paragraph) + 2 > NARRATIVE
        if full:
            ended()
        kept = tail(block) if full else block
        block = f"{kept}\n\n{paragraph}" if kept else paragraph
    ended()
    return out


def narrative_chunks(docs: DataFrame, id_col: str, name_col: str, text_col: str) -> DataFrame:
    """id, chunk_index, title, path, content of each document's narrative; null texts have none."""

    def cut(batches):
        for b in batches:
            rows: list[tuple] = []
            held = 0

            def handed(b=b, rows=rows):
                at, *columns = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.string(), pa.string(), pa.string())
                own = b[id_col].take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([own, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [id_col, "chunk_index", "title", "path", "content"])

            for i, (name, text) in enumerate(zip(b[name_col], b[text_col], strict=True)):
                for k, found in enumerate(narrative(text.as_py() or "", name.as_py() or "")):
                    rows.append((i, k, *found))
                    held += sum(map(len, found))
                    if held >= HELD:
                        yield handed()
                        rows.clear()
                        held = 0
            if rows:
                yield handed()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, name_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, chunk_index int, title string, path string, content string")
