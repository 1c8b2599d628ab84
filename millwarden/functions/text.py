"""Column expressions over documents, records, reports and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the published definitions.
CHUNK_SIZE = 1200
CHUNK_OVERLAP = 200
INCIDENT_PATTERN = r"\bINC-\d{4}\b"
PROCEDURE_PATTERN = r"\bFSP-SOP-\d{3}\b"
CITATION_PATTERN = r"\b(?:INC-\d{4}|FSP-SOP-\d{3})\b"
REQUIRED_SECTIONS = ("FACTS", "POSSIBLE HYPOTHESES", "RECOMMENDED ACTIONS", "EVIDENCE SOURCES", "LIMITATIONS")
INSUFFICIENT = "the retrieved evidence is insufficient to answer this safely."
NO_EVIDENCE = "No relevant evidence was retrieved from the knowledge base."
INCIDENT_FIELDS = {"incident_id": "Incident ID", "machine_id": "Machine ID", "event_type": "Event Type", "severity": "Severity"}

# Whitespace as Unicode text stripping sees it.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
STRIP_PATTERN = f"^[{SPACES}]+|[{SPACES}]+$"
# Line boundaries as Unicode line splitting sees them.
LINE_PATTERN = "\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(text: str | Column) -> Column:
    return F.btrim(_col(text), F.lit(SPACES))


def lines(text: str | Column) -> Column:
    """Stripped lines."""
    return F.transform(F.split(_col(text), LINE_PATTERN), strip)


def chunks(text: str | Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping pieces of a long text, stripped, blank ones dropped; a short text is one piece."""
    value, step = _col(text), size - overlap
    # The last piece is the first whose end reaches the end of the text.
    last = F.ceil((F.length(value) - size) / F.lit(step)).cast("int")
    starts = F.sequence(F.lit(0), last)
    pieces = F.transform(starts, lambda i: strip(F.substring(value, i * step + 1, F.lit(size))))
    return F.when(F.length(value) <= size, F.array(value)).otherwise(F.filter(pieces, lambda p: p != ""))


def chunk_id(source: str, index: str) -> Column:
    return F.left(F.sha2(F.concat_ws(":", F.col(source), F.col(index).cast("string")), 256), F.lit(20))


def header_value(text: str | Column, name: str) -> Column:
    """Value after the last line that starts with ``**name:**``; null when no line does."""
    prefix = f"**{name}:**"
    hits = F.filter(lines(text), lambda line: F.startswith(line, F.lit(prefix)))
    return strip(F.substring(F.try_element_at(hits, F.lit(-1)), len(prefix) + 1, 2147483647))



def record_section(text: str | Column, heading: str) -> Column:
    """Stripped text between ``## heading`` and the next ``## `` line."""
    parts = F.split(F.concat(F.lit("\n"), _col(text)), "\n## ")
    wanted = F.filter(parts, lambda p: F.startswith(p, F.lit(heading + "\n")))
    return strip(F.substring(F.try_element_at(wanted, F.lit(1)), len(heading) + 2, 2147483647))


def bullet_list(section: Column) -> Column:
    """Items of a ``- `` list."""
    items = F.filter(lines(section), lambda line: F.startswith(line, F.lit("- ")))
    return F.transform(items, lambda line: strip(F.substring(line, 3, 2147483647)))


def table_cell(section: Column, name: str) -> Column:
    """Second cell of the two-column table row whose first cell is ``name``."""
    rows = F.filter(lines(section), lambda line: F.startswith(line, F.lit(f"| {name} |")))
    return strip(F.try_element_at(F.split(F.try_element_at(rows, F.lit(1)), r"\|"), F.lit(3)))


def report_section(text: str | Column, heading: str, headings: tuple[str, ...] = REQUIRED_SECTIONS) -> Column:
    """Stripped text under a heading line, written with ``## `` or bare; case is ignored for bare ones.

    Empty when the report has no such heading.
    """
    blank = r"[^\S\n]*"
    head = rf"(?md)^(?:## {blank}([^\n]*?)|{blank}(?:##[^\S\n]+)?((?i:{'|'.join(headings)}))){blank}$"
    # Each heading line becomes: mark, name, mark.
    marked = F.regexp_replace(_col(text), head, "\ue000$1$2\ue001")
    parts = F.split(marked, "\ue000")
    wanted = F.filter(parts, lambda p: F.lower(F.substring_index(p, "\ue001", 1)) == heading.lower())
    body = F.try_element_at(F.split(F.try_element_at(wanted, F.lit(1)), "\ue001"), F.lit(2))
    return F.coalesce(strip(body), F.lit(""))


def cited(text: str | Column, pattern: str) -> Column:
    """Distinct matches in sorted order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))))


def cited_ids(text: str | Column) -> Column:
    """Incident and procedure identifiers together, sorted."""
    return F.array_sort(F.array_union(cited(text, INCIDENT_PATTERN), cited(text, PROCEDURE_PATTERN)))


def ordered_citations(text: str | Column) -> Column:
    """Distinct identifiers in order of first use."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(CITATION_PATTERN), F.lit(0)))


def preview(text: str | Column, size: int = 250, n_lines: int = 2) -> Column:
    """First non-blank lines on one line, bold marks removed, cut to ``size`` characters."""
    kept = F.slice(F.filter(lines(text), lambda line: line != ""), 1, n_lines)
    return F.left(F.replace(F.array_join(kept, " "), F.lit("**"), F.lit("")), F.lit(size))


#: Search sentences: before and after the event, and without one.
SEARCHES = {
    "incident": ("earlier trouble on the line with ", "", "earlier trouble on the line"),
    "procedure": ("work instruction for ", ": what to do and how to prevent it", "work instruction: what to do and how to prevent it"),
}


def event_query(event: str | Column, kind: str) -> Column:
    """Search text for an event type; a general one when there is none."""
    before, after, general = SEARCHES[kind]
    readable = F.replace(_col(event), F.lit("_"), F.lit(" "))
    return F.when(F.length(_col(event)) > 0, F.concat(F.lit(before), readable, F.lit(after))).otherwise(general)
