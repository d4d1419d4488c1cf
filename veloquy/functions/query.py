"""Search queries: quoted phrases and terms, on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

#: Letters and digits of any script, as in `text.regex_tokens`.
_TERM = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Query:
    """Terms are alternatives and count as often as they stand; phrases must all occur."""

    terms: tuple[str, ...] = ()
    phrases: tuple[str, ...] = field(default=())


def plain_terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def parse_query(text: str, tokenizer: Callable[[str], list[str]] = plain_terms) -> Query:
    phrases = [p for p in (m.strip() for m in re.findall(r'"([^"]*)"', text)) if p]
    return Query(tuple(tokenizer(re.sub(r'"[^"]*"', " ", text))), tuple(phrases))
