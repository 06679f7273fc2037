"""SQL text for the twins: Java expressions put into RE2's terms."""

from __future__ import annotations

import re

_WORD = r"\p{L}\p{M}\p{N}_"


def re2(expression: str) -> str:
    """Unicode words and boundaries, which RE2 lacks: boundaries become neighbours (good for searches, not for places)."""
    e = re.sub(r"^\(\?[a-zA-Z]+\)", "", expression)
    e = e.replace(r"[\W]", f"[^{_WORD}]")
    out, i, in_class = [], 0, False
    while i < len(e):
        two = e[i : i + 2]
        if two == r"\b" and e[i + 2 : i + 5] == r"\s+" or two == r"\b" and e[max(0, i - 3) : i] == r"\s+":
            i += 2  # white space on one side, so the boundary says nothing more
        elif two == r"\b":
            rest = e[i + 2 :]
            ends = rest == "" or rest[0] in "|)" or rest.startswith(r"\s") or rest.startswith(".*")
            out.append(f"(?:$|[^{_WORD}])" if ends else f"(?:^|[^{_WORD}])")
            i += 2
        elif two == r"\w":
            out.append(_WORD if in_class else f"[{_WORD}]")
            i += 2
        elif two[0:1] == "\\":
            out.append(two)
            i += 2
        else:
            in_class = e[i] == "[" or (in_class and e[i] != "]")
            out.append(e[i])
            i += 1
    return "".join(out).replace("'", "''")


def any_match(text: str, expressions: list[str], flags: str = "i") -> str:
    each = [re.sub(r"\\w\*$", "", e) for e in expressions]  # changes nothing for a test
    return f"regexp_matches({text}, '{'|'.join(f'(?:{re2(e)})' for e in each)}', '{flags}')"


def whole_word(text: str, expressions: list[str], flags: str = "i") -> str:
    """One of the expressions between word boundaries."""
    return f"regexp_matches({text}, '(?:^|[^{_WORD}])(?:{'|'.join(re2(e) for e in expressions)})(?:$|[^{_WORD}])', '{flags}')"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
