"""Globs, reference patterns and ignore rules as Java regular expressions, built on the driver from configuration."""

from __future__ import annotations

import re

#: Bounds on what configuration may state.
MAX_LENGTH, MAX_BRACES = 1024, 256


class PatternError(ValueError):
    """A pattern beyond the bounds, or badly formed."""


def expand_braces(glob: str) -> list[str]:
    """``a{b,c}d`` as abd and acd, nested; a brace without a comma or an end is literal."""
    out = [""]

    def product(left: list[str], right: list[str]) -> list[str]:
        if len(left) * len(right) > MAX_BRACES:
            raise PatternError("a pattern expands to too many")
        return [a + b for a in left for b in right]

    at = 0
    while at < len(glob):
        if glob[at] == "{":
            depth, parts, start, end = 0, [], at + 1, -1
            for k in range(at, len(glob)):
                if glob[k] == "{":
                    depth += 1
                elif glob[k] == "}":
                    depth -= 1
                    if not depth:
                        parts.append(glob[start:k])
                        end = k
                        break
                elif glob[k] == "," and depth == 1:
                    parts.append(glob[start:k])
                    start = k + 1
            if end >= 0 and len(parts) > 1:
                out = product(out, [e for part in parts for e in expand_braces(part)])
                at = end + 1
                continue
        out = [o + glob[at] for o in out]
        at += 1
    return out


def _segment(text: str) -> str:
    out, at = "", 0
    while at < len(text):
        c = text[at]
        if c == "*":
            out += "[^/]*"
            while text[at : at + 1] == "*":
                at += 1
            continue
        if c == "?":
            out += "[^/]"
        elif c == "[" and "]" in text[at + 2 :]:
            end = text.index("]", at + 2)
            body = text[at + 1 : end]
            negated = body[0] in "!^"
            out += "[" + ("^/" if negated else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body[negated:]) + "]"
            at = end
        else:
            out += re.escape(c)
        at += 1
    return out


def alternative_regex(one: str) -> str:
    """The expression of a glob whose braces are expanded, without its ends."""
    segments, out = one.split("/"), ""
    for k, segment in enumerate(segments):
        last = k == len(segments) - 1
        if segment == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(segment) + ("" if last else "/")
    return out


def glob_regex(glob: str) -> str:
    """``*`` and ``?`` stay in a segment, ``**`` spans any number of them, ``[...]`` and ``{a,b}`` as usual."""
    if len(glob) > MAX_LENGTH:
        raise PatternError("a pattern is too long")
    return "^(?:" + "|".join(alternative_regex(one) for one in expand_braces(glob)) + ")$"


def ref_like(pattern: str) -> str:
    """A root pattern (``*`` any text, ``?`` one code point) as a LIKE pattern with backslash escapes."""
    return "".join({"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\"}.get(c, c) for c in pattern)


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """(regex over a path, negated, directories only) of one line of an ignore file; None for blank lines and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].removeprefix("\\")
    only_dirs = line.endswith("/")
    body = line.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    return glob_regex(body if anchored else f"**/{body}"), negated, only_dirs
