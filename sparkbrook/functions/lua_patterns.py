"""Lua string patterns as Java regular expressions."""

from __future__ import annotations

#: The character classes of Lua patterns, in ASCII.
CLASSES = {"a": "A-Za-z", "c": r"\x00-\x1F\x7F", "d": "0-9", "g": r"\x21-\x7E", "l": "a-z", "p": r"!-/:-@\[-`{-~", "s": r" \t-\r", "u": "A-Z", "w": "A-Za-z0-9", "x": "A-Fa-f0-9"}


def to_regex(pattern: str) -> str:
    """The Java regex of a Lua pattern. ``%b`` and ``%f`` have no regular equivalent and are refused.

    A quantifier counts only right after one letter, class or set; elsewhere (at the start, after a capture or a quantifier) it is an ordinary letter.
    """
    out, i, n = [], 0, len(pattern)
    if pattern.startswith("^"):
        out.append("^")
        i = 1
    single = False  # whether what came before takes a quantifier
    while i < n:
        c = pattern[i]
        if single and c in "*+-?":
            out.append("*?" if c == "-" else c)
            single = False
        elif c in "()":
            out.append(c)
            single = False
        elif c == "$" and i == n - 1:
            out.append("\\z")
        else:
            single = True
            if c == "%":
                i += 1
                if i == n:
                    raise ValueError("pattern ends with %")
                c = pattern[i]
                if c in "bf":
                    raise ValueError(f"%{c} is not supported")
                if c.isdigit():
                    out.append(f"(?:\\{c})")
                    single = False
                elif c.lower() in CLASSES:
                    out.append(f"[{'^' if c.isupper() else ''}{CLASSES[c.lower()]}]")
                else:
                    out.append(f"\\{c}" if not c.isalnum() else c)
            elif c == "[":
                i, part = _set(pattern, i)
                out.append(part)
            elif c == ".":
                out.append("[\\s\\S]")
            else:
                out.append(f"\\{c}" if c in r"\^$|{}]*+-?" else c)
        i += 1
    return "".join(out)


def _set(pattern: str, i: int) -> tuple[int, str]:
    """The set that begins at ``i``, and the place of its closing bracket."""
    out, i = ["["], i + 1
    if pattern[i : i + 1] == "^":
        out.append("^")
        i += 1
    first = True
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and not first:
            return i, "".join(out) + "]"
        first = False
        if c == "%":
            i += 1
            c = pattern[i : i + 1]
            if c.lower() in CLASSES and c.islower():
                out.append(CLASSES[c])
            elif c.lower() in CLASSES:
                out.append(f"[^{CLASSES[c.lower()]}]")
            else:
                out.append(f"\\{c}")
        else:
            out.append(f"\\{c}" if c in r"\[]&^" else c)
        i += 1
    raise ValueError("set is not closed")
