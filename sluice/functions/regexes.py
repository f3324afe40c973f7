"""RE2 patterns, as rules are written in, for Java's regex engine.

The dialects differ in group syntax and in what a few classes and anchors
mean; ``to_java`` rewrites a pattern so that it matches what RE2 would, and
``replacement`` does the same for replacement templates.
"""

from __future__ import annotations

import re

WORD = "[0-9A-Za-z_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NOT_BOUNDARY = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
CLASSES = {"s": r"\t\n\f\r ", "d": "0-9", "w": "0-9A-Za-z_"}


class BadPattern(ValueError):
    """The pattern is none of RE2's."""


def group_names(pattern: str) -> dict[str, int]:
    """Named groups and their numbers."""
    names, number, i, in_class = {}, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            i += 2 if pattern[i + 1 : i + 2] == "]" else 3 if pattern[i + 1 : i + 3] == "^]" else 1
            continue
        if c == "]":
            in_class = False
        elif c == "(" and not in_class:
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
            if m:
                number += 1
                names[m[1]] = number
            elif pattern[i + 1 : i + 2] != "?":
                number += 1
        i += 1
    return names


def to_java(pattern: str) -> str:
    """The pattern for Java; BadPattern if it is no valid RE2 pattern."""
    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:[=!]|<[=!]|>)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise BadPattern(f"look-around, atomic groups and back references are not supported: {pattern!r}")
    out, i, in_class, first = ["(?d)"], 0, False, False
    multi = bool(re.match(r"\(\?[a-zA-Z]*m", pattern))
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 >= len(pattern):
                raise BadPattern(f"trailing backslash: {pattern!r}")
            n = pattern[i + 1]
            if n in CLASSES:
                out.append(CLASSES[n] if in_class else f"[{CLASSES[n]}]")
            elif n in "SDW":
                out.append(f"[^{CLASSES[n.lower()]}]")
            elif n == "b" and not in_class:
                out.append(BOUNDARY)
            elif n == "B" and not in_class:
                out.append(NOT_BOUNDARY)
            elif n == "z":
                out.append(r"\z")
            elif n == "C":
                raise BadPattern(r"\C is not supported")
            else:
                out.append(c + n)
            i, first = i + 2, False
            continue
        if in_class:
            if c == "]" and not first:
                in_class = False
                out.append(c)
            elif c == "[" and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
                out.append(f"\\{'P' if m[1] else 'p'}{{{m[2].capitalize() if m[2] != 'xdigit' else 'XDigit'}}}")
                i, first = i + m.end(), False
                continue
            else:
                out.append("\\" + c if c in "[&]" else c)
                first = first and c == "^" and pattern[i - 1] == "["
            i += 1
            continue
        if c == "[":
            in_class, first = True, True
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            continue
        if c == "(" and (m := re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])):
            out.append("(")  # read by number: Java's names allow no underscore
            i += m.end()
            continue
        if c == "$" and not multi:
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    try:
        re.compile(re.sub(r"\(\?P?<([A-Za-z_]\w*)>", "(", pattern).replace(r"\z", r"\Z"))
    except re.error as e:
        if "global flags" not in str(e) and "bad escape" not in str(e):
            raise BadPattern(f"{pattern!r}: {e}") from e
    return "".join(out)


def replacement(template: str, pattern: str) -> str:
    """An RE2 replacement template ($1, ${name}, $$; unknown groups are empty) for Java."""
    names = group_names(pattern)
    count = len(re.findall(r"(?<!\\)\((?!\?)", re.sub(r"\(\?P?<[A-Za-z_]\w*>", "(", pattern)))
    out, i = [], 0
    while i < len(template):
        if template[i] == "$":
            if template.startswith("$$", i):
                out.append(r"\$")
                i += 2
                continue
            if m := re.match(r"\$(?:\{(\w+)\}|(\w+))", template[i:]):
                name = m[1] or m[2]
                number = int(name) if name.isdigit() else names.get(name)
                if number is not None and number <= count:
                    out.append(f"${number}")
                    if template[i + m.end() : i + m.end() + 1].isdigit():
                        out.append("\\" + template[i + m.end()])
                        i += 1
                i += m.end()
                continue
            out.append(r"\$")
        else:
            out.append("\\\\" if template[i] == "\\" else template[i])
        i += 1
    return "".join(out)
