"""Settings of the pipeline, and a reader and writer for files of KEY="value" lines."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from datetime import datetime, timezone

DEFAULT_START = "2018-01-01T00:00:00Z"


@dataclass(frozen=True)
class Settings:
    """All parameters that change results. Searches, chunks and cutoffs take theirs from here."""

    min_age_days: int = 14
    start_date: str = DEFAULT_START
    use_cached_stats: bool = False
    k1: float = 0.9
    b: float = 0.4
    chunk_size: int = 450
    chunk_overlap: int = 50
    chunk_max: int = 512
    top_k: int = 100
    top_tickets: int = 10
    answer_top_k: int = 5
    answer_top_tickets: int = 5
    fusion_k: int = 60
    max_age_days: int = 1
    poll_limit: int = 20
    check_interval_s: int = 300
    ticket_url: str = "https://desk.example"
    search_prompt: str = "Search phrase for this ticket: {ticket_content}"
    answer_prompt: str = "Answer this ticket: {ticket_content}\n\nFindings:\n{search_results}"

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> Settings:
        """Settings from text values by upper-case name; unknown names are ignored, missing ones keep their default."""
        given = {}
        for field in fields(cls):
            raw = values.get(field.name.upper())
            if raw is None:
                continue
            kind = type(field.default)
            if kind is bool:
                given[field.name] = raw.strip().lower() == "true"
            elif kind is str:
                given[field.name] = raw.replace("\\n", "\n")
            else:
                given[field.name] = kind(raw)
        made = replace(cls(), **given)
        return replace(made, start_date=_valid_date(made.start_date), ticket_url=made.ticket_url.rstrip("/"))

    @classmethod
    def from_environment(cls, prefix: str = "THREADLOOM_") -> Settings:
        return cls.from_mapping({k[len(prefix) :]: v for k, v in os.environ.items() if k.startswith(prefix)})


def _valid_date(text: str) -> str:
    """The date as it stands if it is one, else the default."""
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return DEFAULT_START
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).isoformat()


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines; comments, blank lines and lines without a sign are skipped, one pair of quotes is taken off."""
    values = {}
    for line in text.splitlines():
        key, sign, value = line.strip().partition("=")
        if not sign or key.startswith("#"):
            continue
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        values[key.strip()] = value
    return values


def upsert_env(text: str, changes: Mapping[str, str]) -> str:
    """The same lines with the values of known keys replaced and new keys appended; comments stay where they are."""
    left = {k: str(v).replace("\n", "\\n") for k, v in changes.items()}
    written = dict(left)
    lines = []
    for line in text.splitlines():
        key = line.strip().partition("=")[0]
        if "=" in line and not line.lstrip().startswith("#") and key in written:
            lines.append(f'{key}="{written[key]}"')
            left.pop(key, None)
        else:
            lines.append(line)
    lines += [f'{k}="{v}"' for k, v in left.items()]
    return "\n".join(lines) + "\n"
