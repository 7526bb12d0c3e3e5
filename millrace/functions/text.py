"""Text, key, link and label functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticket keys: ASCII word boundaries are spelled out, since Java's differ for other letters.
KEY_PATTERN = r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9_]+-[0-9]+)(?![A-Za-z0-9_])"
TOKEN_PATTERN = r"([a-z0-9]+)"
#: Characters that only take up space (Unicode's class Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def ticket_keys(text: Column, most: int = 5) -> Column:
    """Keys such as ZX-731 in order of appearance, each once, at most ``most`` (a feature of the shortcut)."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(KEY_PATTERN), F.lit(1))), 1, most)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(1))


def source_id(source_type: Column, source_key: Column) -> Column:
    return F.concat_ws(":", source_type, source_key)


def split_source_id(c: Column) -> tuple[Column, Column]:
    """Type and key, split at the first colon only; null without one."""
    at = F.instr(c, ":")
    return F.when(at > 0, F.substring_index(c, ":", 1)), F.when(at > 0, F.substr(c, at + 1))


def key_prefix(key: Column) -> Column:
    """What stands before the last hyphen; empty without one."""
    return F.regexp_extract(key, r"^(.+)-[^-]*$", 1)


def link_kind(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")


def cut_bytes(c: Column, most: int) -> Column:
    """The longest start of whole characters with at most ``most`` bytes; null for a null text."""
    b = c.cast("binary")
    whole = F.lit("")
    for n in range(max(0, most - 3), most + 1):  # a character has four bytes at most; those after its first are 80 to BF
        inside = F.hex(F.substring(b, n + 1, 1)).between("80", "BF")
        whole = F.when(~inside, F.decode(F.substring(b, 1, n), "UTF-8")).otherwise(whole)
    return F.when(F.octet_length(c) <= most, c).when(c.isNotNull(), whole)


def trimmed_lines(body: Column) -> Column:
    """Lines with more than spaces, without those at their ends. (``F.trim`` itself would take a line's index for what to cut.)"""
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")


def first_line(body: Column) -> Column:
    """The first line with more than spaces, trimmed; null if there is none."""
    return F.get(trimmed_lines(body), F.lit(0))


def title_of(body: Column, filename: Column, kind: Column) -> Column:
    """Of markdown and HTML the first level-1 heading; else the first non-blank line, at most 200 bytes; else the
    file's stem; else a fixed text."""
    heading = F.nullif(F.trim(F.regexp_extract(body, r"(?dm)^#\s+(.+?)\s*$", 1)), F.lit(""))
    stem = F.nullif(F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit(""))
    return F.coalesce(F.when(kind.isin("markdown", "html"), heading), cut_bytes(first_line(body), 200), stem, F.lit("Untitled document"))


def document_kind(content_type: Column, filename: Column) -> Column:
    """markdown, text, html or pdf, from the declared type, or from the extension where that says nothing; else null."""
    ct = F.trim(F.substring_index(F.lower(F.trim(content_type)), ";", 1))
    ext = F.lower(F.regexp_extract(filename, r"(\.[^./]*)$", 1))
    by_type = F.when(ct.isin("text/markdown", "text/x-markdown"), "markdown").when(ct == "text/plain", "text").when(ct.isin("text/html", "application/xhtml+xml"), "html").when(ct == "application/pdf", "pdf")
    by_ext = F.when(ext.isin(".md", ".markdown"), "markdown").when(ext == ".txt", "text").when(ext.isin(".html", ".htm"), "html").when(ext == ".pdf", "pdf")
    return F.coalesce(by_type, F.when(F.coalesce(ct, F.lit("")).isin("", "application/octet-stream"), by_ext))


def looks_scanned(text: Column, pages: Column) -> Column:
    """Fewer than ten ASCII letters a page, or no pages."""
    return (pages <= 0) | (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) < 10 * pages)


def human_bytes(n: Column) -> Column:
    """1024-based units with one decimal; - for none."""
    out = F.when(n == 0, F.lit("-")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate("KMGTPE", 1):
        scaled = F.format_string("%.1f", F.bround(n / F.lit(float(1024**power)), 1))
        out = out.otherwise(F.concat(scaled, F.lit(f" {unit}B"))) if unit == "E" else out.when(
            n < 1024 ** (power + 1), F.concat(scaled, F.lit(f" {unit}B")),
        )
    return out


def relative_age(at: Column, as_of: Column) -> Column:
    """just now, minutes, hours or days ago, or the date when a month has passed."""
    s = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))
    ago = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m")).when(s < 86400, ago(3600, "h")).when(s < 30 * 86400, ago(86400, "d")).otherwise(F.date_format(at, "MMM d, yyyy"))


def truncated(c: Column, most: int) -> Column:
    """Trimmed, and cut at a whole character after ``most`` bytes with an ellipsis."""
    t = F.trim(c)
    return F.when(F.octet_length(t) <= most, t).otherwise(F.concat(cut_bytes(t, most), F.lit("…")))


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, "</?mark>", "")


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def only_marks(c: Column) -> Column:
    """Escaped, with the highlight tags alone let through."""
    return F.replace(F.replace(html_escaped(c), F.lit("&lt;mark&gt;"), F.lit("<mark>")), F.lit("&lt;/mark&gt;"), F.lit("</mark>"))


def titled(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "(untitled)").otherwise(t)


def meta_line(status: Column, kind: Column, assignee: Column, updated: Column) -> Column:
    """Status, type, assignee and day of update, those there are, with a line's end; empty if none is."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    line = F.concat_ws(
        " | ", part("Status", status), part("Type", kind), part("Assignee", assignee),
        part("Updated", F.date_format(updated, "yyyy-MM-dd")),
    )
    return F.when(line == "", "").otherwise(F.concat(line, F.lit("\n")))


def page_number(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/pages/([0-9]+)", 1), F.lit(""))


def parsed_time(c: Column) -> Column:
    """ISO timestamps with numeric offset or Z, with or without fractions; null if none fits."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss.SSSZ", "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def bearer_token(header: Column) -> Column:
    """The token of an Authorization header, null for any other scheme."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(header), r"(?i)^bearer\s+(\S+)$", 1)), F.lit(""))


def safe_filename(c: Column) -> Column:
    """Quotes and line ends replaced, so that the name can stand in a header."""
    return F.regexp_replace(c, "[\"\\r\\n\\\\]", "_")


def blob_key(c: Column) -> Column:
    """A trimmed relative key; null if it climbs."""
    t = F.trim(c)
    return F.when(~F.contains(t, F.lit("..")) & (t != ""), F.regexp_replace(t, "^/+", ""))


def light_html(c: Column, citations: int = 0) -> Column:
    """Escaped text with code fences, inline code, bold, italics, paragraphs and line breaks, and [^N] as links to citations;
    with a number of ``citations``, only to those there are."""
    known = "|".join(str(n) for n in range(citations, 0, -1))
    note = rf"\[\^(0*(?:{known}))\]" if citations else r"\[\^([0-9]+)\]"
    t = F.regexp_replace(html_escaped(c), r"(?s)```[a-zA-Z0-9_-]*\n(.+?)\n?```", "<pre><code>$1</code></pre>")
    t = F.regexp_replace(t, note, '<sup><a href="#cite-$1">[$1]</a></sup>')
    t = F.regexp_replace(t, r"`([^`\n]+)`", "<code>$1</code>")
    t = F.regexp_replace(t, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    t = F.regexp_replace(t, r"(^|[^*])\*([^*\n]+)\*", "$1<em>$2</em>")
    parts = F.filter(F.transform(F.split(t, "\n\n"), lambda b: F.regexp_replace(b, r"\A\s+|\s+\z", "")), lambda b: b != "")

    def html(b: Column) -> Column:
        plain = F.concat(F.lit("<p>"), F.replace(b, F.lit("\n"), F.lit("<br>")), F.lit("</p>\n"))
        return F.when(F.startswith(b, F.lit("<pre>")), F.concat(b, F.lit("\n"))).otherwise(plain)

    return F.array_join(F.transform(parts, html), "")
