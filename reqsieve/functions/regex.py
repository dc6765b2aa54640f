"""Rule patterns: RE2 syntax in, Spark predicates out.

Rules are written in RE2 syntax and Spark's ``rlike`` runs ``java.util.regex``.
``to_java`` rewrites the spots where the two read the same text differently.
``matches`` also notices which substrings a pattern cannot match without and asks
for those with ``contains`` first: that compares UTF-8 bytes in place, so most rows
never pay for decoding the body and running the regex.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""
      (?P<quoted>\\Q.*?(?:\\E|$))
    | (?P<prop>\\[pP](?:\{\^?\w+\}|[A-Z]))
    | (?P<hex>\\x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2}))
    | (?P<octal>\\0[0-7]{0,2}|\\[1-7][0-7]{1,2})
    | (?P<escape>\\.)
    | (?P<posix>\[:\^?\w+:\])
    | (?P<named>\(\?P?<[A-Za-z_]\w*>)
    | (?P<flags>\(\?[imsU]*(?:-[imsU]+)?[:)])
    | (?P<special>\(\?.?)
    | (?P<repeat>(?:\{\d+(?:,\d*)?\}|[*+?])\??)
    | (?P<char>.)
    """,
    re.VERBOSE | re.DOTALL,
)

# The POSIX class names of RE2 and their Java spelling.
_POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank",
    "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower",
    "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper",
    "xdigit": "XDigit",
}
_SPACE = r"\t\n\f\r "
_ESCAPES = set(r"abBAdDsSwWfntrvz")


def _escape(tok: str, in_class: bool) -> str:
    c = tok[1]
    if c.isalnum() and c not in _ESCAPES:
        raise ValueError(f"escape {tok} is not supported in rule patterns")
    if c == "s":
        return _SPACE if in_class else f"[{_SPACE}]"
    if c == "S":
        return f"[^{_SPACE}]"
    if c == "v":
        return r"\x0B"
    if c == "b" and not in_class:
        return r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    if c == "B" and not in_class:
        return r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
    return tok


def _flags(tok: str) -> str:
    on, _, off = tok[2:-1].replace("U", "").partition("-")
    on = on.replace("i", "iu")
    body = on + (f"-{off}" if off else "")
    return f"(?{body}{tok[-1]}" if body or tok[-1] == ":" else ""


def to_java(pattern: str) -> str:
    """The Java spelling of an RE2 pattern (for searching, not for capturing)."""
    # Is ^ and $ about lines? One answer per open group.
    by_line = [False]
    out, in_class, class_start, after_repeat = ["(?d)"], False, False, False
    for m in _TOKEN.finditer(pattern):
        kind, tok = m.lastgroup, m.group()
        first, class_start, repeated, after_repeat = class_start, False, after_repeat, False
        if kind in ("named", "flags", "special", "repeat") and in_class:
            # Inside brackets these are ordinary characters; "[" cannot occur in them.
            out.append(tok)
            continue
        if kind == "posix" and not in_class:
            raise ValueError(f"{tok} outside of brackets")
        if kind == "prop":
            name = tok[2:].strip("{}")
            negated = (tok[1] == "P") != name.startswith("^")
            name = name.lstrip("^")
            name = name if len(name) <= 2 else f"Is{name}"
            tok = rf"\{'P' if negated else 'p'}{{{name}}}"
        elif kind == "octal":
            tok = rf"\x{{{int(tok[1:], 8):x}}}"
        elif kind == "escape":
            tok = _escape(tok, in_class)
        elif kind == "posix":
            name = tok.strip("[]:")
            word, negated = name.lstrip("^"), name.startswith("^")
            if word == "word":
                tok = r"\W" if negated else r"\w"
            elif word in _POSIX:
                tok = rf"\{'P' if negated else 'p'}{{{_POSIX[word]}}}"
            else:
                raise ValueError(f"unknown character class {tok}")
        elif kind == "named":
            by_line.append(by_line[-1])
            tok = "(?:"
        elif kind == "flags":
            on, _, off = tok.partition("-")
            lines = "m" in on or (by_line[-1] and "m" not in off)
            if tok[-1] == ":":
                by_line.append(lines)
            else:
                by_line[-1] = lines
            tok = _flags(tok)
        elif kind == "special":
            raise ValueError(f"group {tok} is not supported in rule patterns")
        elif kind == "repeat":
            if repeated:
                raise ValueError(f"nested repetition {tok}")
            after_repeat = True
        elif kind == "char":
            if in_class:
                if tok == "]" and not first:
                    in_class = False
                elif tok == "^" and first and out[-1] == "[":
                    class_start = True
                elif tok in "[]&":
                    tok = "\\" + tok
            elif tok == "[":
                in_class = class_start = True
            elif tok == "{":
                tok = r"\{"
            elif tok == "(":
                by_line.append(by_line[-1])
            elif tok == ")" and len(by_line) > 1:
                by_line.pop()
            elif tok == "$":
                tok = r"(?=\n|\z)" if by_line[-1] else r"\z"
            elif tok == "^":
                tok = r"(?:\A|(?<=\n))" if by_line[-1] else r"\A"
        out.append(tok)
    if in_class:
        raise ValueError("missing closing ]")
    return "".join(out)


def _without_case(pattern: str) -> str | None:
    """The inside of a pattern that is one ``(?i:...)`` group or starts with ``(?i)``."""
    if pattern.startswith("(?i)"):
        return pattern[4:]
    if not pattern.startswith("(?i:"):
        return None
    depth, in_class, end = 0, False, 0
    for m in _TOKEN.finditer(pattern):
        kind, tok = m.lastgroup, m.group()
        if kind == "char" and tok in "[]":
            in_class = tok == "["
        elif not in_class:
            opens = kind in ("named", "special") or (kind == "flags" and tok[-1] == ":") or (kind == "char" and tok == "(")
            depth += opens - (kind == "char" and tok == ")")
        if depth == 0:
            end = m.end()
            break
    return pattern[4:-1] if end == len(pattern) else None


def literal_runs(pattern: str) -> tuple[list[list[str]], bool] | None:
    """``(alternatives, exact)``: every match holds all literals of one of the alternatives.

    ``exact`` says that holding the literal of one is also enough. None when nothing can be
    said. Only text outside groups is looked at, which is enough for typical rules.
    """
    runs: list[list[str]] = [[""]]
    exact, depth, in_class, fresh = True, 0, False, False

    def cut() -> None:
        nonlocal exact
        exact = False
        runs[-1].append("")

    for m in _TOKEN.finditer(pattern):
        kind, tok = m.lastgroup, m.group()
        if in_class:
            if kind == "char" and tok == "]" and not fresh:
                in_class = False
            fresh = fresh and kind == "char" and tok == "^"
            continue
        if kind == "flags" and tok.endswith(")"):
            # Flags for the rest of the pattern change what its text means.
            return None
        if kind in ("named", "special", "flags") or (kind == "char" and tok == "("):
            depth += 1
            cut()
        elif kind == "char" and tok == ")":
            depth -= 1
            cut()
        elif kind == "char" and tok == "[":
            in_class = fresh = True
            cut()
        elif depth:
            continue
        elif kind == "repeat":
            # The repeated item may be absent: take it out of the run before it.
            runs[-1][-1] = runs[-1][-1][:-1]
            cut()
        elif kind == "char" and tok == "|":
            runs.append([""])
        elif kind == "char" and tok not in ".^$":
            runs[-1][-1] += tok
        elif kind == "escape" and not tok[1].isalnum():
            runs[-1][-1] += tok[1]
        else:
            cut()
    held = [[part for part in parts if part] for parts in runs]
    return (held, exact) if all(held) else None


#: Members of a bracket that are tried one by one, and repeats of one that are told apart.
_MEMBERS, _REPEATS = 4, {1: 2, 2: 2, 3: 2, 4: 1}
_RANGES = re.compile(r"(?:[A-Za-z0-9]-[A-Za-z0-9]|[^-\[\]&^\\])+")


def _items(tokens: list[tuple[str, str]], at: int = 0) -> tuple[list[list], int]:
    """``(alternatives, end)`` of a group: lists of ``(members, least, most)``, and None for what is not looked into. Many members are not
    listed."""
    runs: list[list] = [[]]
    while at < len(tokens):
        kind, tok = tokens[at]
        at += 1
        if kind == "char" and tok == ")":
            break
        if kind in ("named", "special", "flags") or (kind == "char" and tok == "("):
            inner, at = _items(tokens, at)
            plain = tok in ("(", "(?:") or kind == "named"
            repeated = at < len(tokens) and tokens[at][0] == "repeat"
            runs[-1] += inner[0] if plain and not repeated and len(inner) == 1 else [None]
        elif kind == "char" and tok == "[":
            members, fresh, first = set(), True, at
            while at < len(tokens):
                kind, tok = tokens[at]
                at += 1
                if kind == "char" and tok == "]" and not fresh:
                    break
                known = (kind == "char" and tok not in "^-[]&") or (kind == "escape" and not tok[1].isalnum())
                members.add(tok[-1] if known else None)
                fresh = fresh and kind == "char" and tok == "^"
            simple = None not in members or _RANGES.fullmatch("".join(tok for _, tok in tokens[first:at - 1]))
            runs[-1].append((sorted(members) if None not in members and len(members) <= _MEMBERS else [], 1, 1) if simple else None)
        elif kind == "repeat":
            least, _, most = {"*": "0,", "+": "1,", "?": "0,1"}.get(tok[0], tok.rstrip("?")[1:-1]).partition(",")
            most = most or (least if "," not in tok and tok[0] == "{" else "")
            if runs[-1] and runs[-1][-1] is not None:
                runs[-1][-1] = (runs[-1][-1][0], int(least), int(most) if most else None)
            runs[-1].append(None) if not runs[-1] else None
        elif kind == "char" and tok == "|":
            runs.append([])
        elif (kind == "char" and tok not in ".^$") or (kind == "escape" and not tok[1].isalnum()):
            runs[-1].append(([tok[-1]], 1, 1))
        else:
            runs[-1].append(None)
    return runs, at


def _spelled(before: str, members: list[str], least: int, most: int | None, after: str) -> list[str] | None:
    """Texts of which one is where some members stand between two literals."""
    if not before or not after:
        return [before + c + after for c in members] if least else None
    repeats = _REPEATS[len(members)]
    sizes = [n for n in range(least, repeats + 1) if most is None or n <= most]
    out = [before + "".join(some) + after for n in sizes for some in product(members, repeat=n)]
    if most is None or most > repeats:
        out += [before + "".join(some) for some in product(members, repeat=repeats + 1)]
    return out


def needed_texts(pattern: str) -> list[list[list[str]]] | None:
    """Every match holds, for one of these alternatives, one text of each of its lists.

    These are the literals, and what stands where two of them meet over a small bracket or a repeated character. None when
    nothing can be said.
    """
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(pattern)]
    if any(kind == "flags" and tok.endswith(")") for kind, tok in tokens):
        return None
    out = []
    alternatives, end = _items(tokens)
    if end < len(tokens):
        return None
    for items in alternatives:
        parts: list = [""]  # literals, brackets and unknown things in turn
        for item in items:
            if item is not None and item[1:] == (1, 1) and len(item[0]) == 1:
                parts[-1] += item[0][0]
            else:
                parts += [item if item and item[0] else None, ""]
        needed = [[text] for text in parts[::2] if text]
        for i in range(1, len(parts), 2):
            if parts[i] is not None and (parts[i - 1] or parts[i + 1]):
                needed.append(_spelled(parts[i - 1][-6:], *parts[i], parts[i + 1][:6]) or [])
        out.append([texts for texts in needed if texts])
    return out if all(out) else None


def is_plain(pattern: str) -> bool:
    """Is a pattern made of ASCII characters, small brackets of them, repeats and alternatives only? Such a pattern is found in the
    same texts by every engine."""
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(pattern)]
    alternatives, end = _items(tokens)
    return pattern.isascii() and end == len(tokens) and all(None not in items for items in alternatives)


def required_literals(pattern: str) -> tuple[list[str], bool] | None:
    """``(literals, exact)``: every match holds one of ``literals``, the longest of each alternative; see ``literal_runs``."""
    known = literal_runs(pattern)
    return known and ([max(parts, key=len) for parts in known[0]], known[1])


def caseless_literals(pattern: str) -> list[str] | None:
    """What the lower-case form of any text matched by a caseless pattern must hold.

    Text is cut at ``s``, which a long s matches too without being its upper case, and at
    anything outside ASCII.
    """
    inside = _without_case(pattern)
    known = inside is not None and required_literals(inside)
    if not known:
        return None
    parts = [max(re.split(r"[sS]|[^\x00-\x7F]", text), key=len).lower() for text in known[0]]
    return parts if all(parts) else None


_MOST_ALTERNATIVES = 8


def matches(value: Column, pattern: str) -> Column:
    """True where the RE2 ``pattern`` is found anywhere in ``value``."""
    regex = to_java(pattern)

    def holds(text: Column, literals: list[str]) -> Column:
        return reduce(or_, [F.contains(text, F.lit(part)) for part in literals])

    known = required_literals(pattern)
    if known and len(known[0]) <= _MOST_ALTERNATIVES:
        literals, exact = known
        return holds(value, literals) if exact else holds(value, literals) & value.rlike(regex)
    literals = caseless_literals(pattern)
    if literals and len(literals) <= _MOST_ALTERNATIVES:
        return holds(F.lower(value), literals) & value.rlike(regex)
    return value.rlike(regex)


def subsequence(value: Column, text: str) -> Column:
    """True where the characters of ``text`` occur in this order, in any case."""
    steps = "".join(
        rf"[^\x{{{ord(c):x}}}]*+\x{{{ord(c):x}}}" for c in text
    )
    return value.rlike(rf"(?iu)\A{steps}")
