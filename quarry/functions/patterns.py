"""Translation of POSIX-flavoured patterns into the Java dialect."""

from __future__ import annotations

_CLASSES = {"[:alpha:]": r"\p{IsAlphabetic}", "[:space:]": r"\s", "[:blank:]": r" \t", "[:digit:]": r"\d", "[:alnum:]": r"\p{IsAlphabetic}\d", "[:punct:]": r"\p{Punct}"}


def to_java(pattern: str, word_boundary_is_backspace: bool = True, dot_all: bool = True) -> str:
    """Word ends, bracket classes and newline rules of the source dialect.  There a backslash-b is a backspace; pass
    False for what the author of such a pattern meant."""
    out = pattern.replace(r"\m", r"\b").replace(r"\M", r"\b").replace(r"\y", r"\b") if not word_boundary_is_backspace else None
    if out is None:
        out = pattern.replace(r"\b", r"\x08").replace(r"\m", r"\b").replace(r"\M", r"\b").replace(r"\y", r"\b")
    for name, by in _CLASSES.items():
        out = out.replace(name, by)
    return ("(?s)" if dot_all else "") + out
