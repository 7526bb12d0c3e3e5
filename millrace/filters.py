"""Filters written inside a search text, such as ``project:ZOO after:2024-05-01 broken login``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

#: The filters' names and the form of a time (fixed values).
_FILTER = re.compile(r"(?i)(?<!\S)(project|space|source|after):(\S+)")
_TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2}))?")


@dataclass
class ParsedQuery:
    text: str
    projects: list[str] = field(default_factory=list)
    spaces: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    after: str | None = None


def parsed(q: str) -> ParsedQuery:
    """Take the filters out of a text. A time is a date, which is its midnight in UTC, or a date and time with its offset;
    anything else stays in the text. ``after`` is in UTC."""
    out = ParsedQuery("")

    def take(m: re.Match) -> str:
        name, value = m.group(1).lower(), m.group(2)
        if name == "after":
            try:
                at = datetime.fromisoformat(value) if _TIME.fullmatch(value) else None
            except ValueError:
                at = None
            if at is None:
                return m.group()
            at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
            out.after = at.strftime("%Y-%m-%d %H:%M:%S.%f").removesuffix(".000000")
        else:
            {"project": out.projects, "space": out.spaces, "source": out.sources}[name].append(value)
        return ""

    out.text = " ".join(_FILTER.sub(take, q).split())
    return out
