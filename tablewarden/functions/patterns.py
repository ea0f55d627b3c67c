"""Patterns written for a linear-time regex dialect, translated for the JVM's."""

from __future__ import annotations

import re


class RegexError(ValueError):
    """A pattern that the contract dialect does not have, or that is not well formed."""


# POSIX class names and the ASCII characters they stand for: fixed values.
_POSIX = {
    "alpha": "A-Za-z",
    "digit": "0-9",
    "alnum": "0-9A-Za-z",
    "upper": "A-Z",
    "lower": "a-z",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r\x20",
    "blank": r"\t\x20",
    "cntrl": r"\x00-\x1F\x7F",
    "graph": "!-~",
    "print": r"\x20-~",
    "xdigit": "0-9A-Fa-f",
    "word": "0-9A-Za-z_",
    "ascii": r"\x00-\x7F",
}
#: Letters that may follow a backslash; all others mean nothing in the dialect, or something else in the JVM's.
_ESCAPES = set("dDsSwWbBAzpPxuUntrfva")


def _escape(pattern: str, i: int) -> tuple[str, int]:
    """The JVM's spelling of the escape at ``i``, and where it ends."""
    n = pattern[i + 1 : i + 2]
    if not n:
        raise RegexError("the pattern ends in a lone backslash")
    if n.isdigit():
        raise RegexError(f"`\\{n}` is not supported: patterns have no back-references")
    if n.isalpha() and n not in _ESCAPES or n in "<>":
        raise RegexError(f"`\\{n}` is not supported in patterns")
    if n == "v":  # the one character, not the JVM's class of line ends
        return "\\x0B", i + 2
    if n in "xuU":
        braced = pattern[i + 2 : i + 3] == "{"
        end = pattern.find("}", i) if braced else i + 2 + {"x": 2, "u": 4, "U": 8}[n]
        digits = pattern[i + 3 : end] if braced else pattern[i + 2 : end]
        if end < 0 or not digits or any(c not in "0123456789abcdefABCDEF" for c in digits) or len(digits) < (1 if braced else end - i - 2):
            raise RegexError(f"`\\{n}` is not followed by a code point")
        return f"\\x{{{digits}}}", end + braced
    if n in "bB" and pattern[i + 2 : i + 3] == "{":
        raise RegexError("`\\b{...}` is not supported in patterns")
    return "\\" + n, i + 2


def _repeats(pattern: str, i: int) -> bool:
    return re.match(r"\{[0-9]+(?:,[0-9]*)?\}", pattern[i:]) is not None


def java_pattern(pattern: str) -> str:
    """The pattern for ``RLIKE``: search semantics, Unicode classes, ASCII in POSIX classes, only a line feed ends
    a line (so ``.`` matches any other character), and ``$`` only at the very end.

    What the contract dialect lacks is refused: look-around, back-references, possessive quantifiers, quoting,
    and the JVM's own escapes. So are the few things that the JVM lacks.
    """
    out, i, depth, in_class, multiline = [], 0, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            spelled, i = _escape(pattern, i)
            out.append(spelled)
            continue
        if in_class:
            if pattern.startswith("[:", i):
                end = pattern.find(":]", i)
                name = pattern[i + 2 : end].lstrip("^") if end > 0 else ""
                if name not in _POSIX:
                    raise RegexError(f"unknown class `[:{name}:]`")
                out.append(f"[^{_POSIX[name]}]" if pattern[i + 2] == "^" else _POSIX[name])
                i = end + 2
                continue
            if pattern.startswith(("--", "~~"), i):
                raise RegexError(f"`{pattern[i : i + 2]}` between classes is not supported")
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class = 1
            out.append(c)
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":  # a leading bracket stands for itself
                out.append("\\]")
                i += 1
            continue
        elif c == "(":
            if pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), i):
                raise RegexError("look-around is not supported in patterns")
            if pattern.startswith("(?P<", i):
                depth += 1
                out.append("(?<")
                i += 4
                continue
            flags = pattern[i + 2 :].partition(")")[0].partition(":")[0] if pattern.startswith("(?", i) else ""
            if flags and not set(flags) <= set("imsx-<") and not flags.startswith("<"):
                raise RegexError(f"the flags `{flags}` are not supported in patterns")
            multiline |= "m" in flags.partition("-")[0] and flags.isalpha()
            depth += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise RegexError("a closing bracket without its opening one")
        elif c == "$" and not multiline:
            out.append("\\z")
            i += 1
            continue
        elif c in "*+?" or c == "{" and _repeats(pattern, i):
            end = i + 1 if c != "{" else pattern.index("}", i) + 1
            if pattern[end : end + 1] in ("+", "*"):
                raise RegexError(f"`{pattern[i : end + 1]}` repeats a repetition")
            lazy = pattern[end : end + 1] == "?"
            out.append(pattern[i : end + lazy])
            i = end + lazy
            continue
        out.append(c)
        i += 1
    if depth or in_class:
        raise RegexError("a bracket is not closed")
    return "(?Ud)" + "".join(out)
