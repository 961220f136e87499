"""Text functions that SQL lacks: line hashes, strict JSON, a YAML subset, shell words, script entries of HTML, reference spelling."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units a line's hash looks ahead over, and its factor: fixed values of the fingerprint format.
WINDOW, FACTOR = 100, 37


def line_hashes(text: str) -> list[str]:
    """``hex:occurrence`` of each line: a rolling hash, modulo 2^64, over the next WINDOW units from its start without blanks and tabs; line ends count as one unit. One sentinel ends the text, and zeros follow it."""
    lines = re.split(r"\r\n|\r|\n", text)
    units = np.frombuffer("\n".join(re.sub(r"[ \t]", "", line) for line in lines).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    units = np.concatenate([units, np.array([0xFFFF], np.uint64), np.zeros(WINDOW, np.uint64)])
    powers = np.array([pow(FACTOR, WINDOW - 1 - k, 1 << 64) for k in range(WINDOW)], np.uint64)
    out, seen, at = [], {}, 0
    for line in lines:
        with np.errstate(over="ignore"):
            value = int((units[at : at + WINDOW] * powers).sum(dtype=np.uint64))
        seen[value] = seen.get(value, 0) + 1
        out.append(f"{value:x}:{seen[value]}")
        at += len(re.sub(r"[ \t]", "", line).encode("utf-16-le", "surrogatepass")) // 2 + 1
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def line_hashes_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else line_hashes(t))


def symbol_fingerprint(code: str, ref: str) -> Column:
    """SHA-256 of code and reference, a line each."""
    return F.sha2(F.concat_ws("\n", F.col(code), F.col(ref)), 256)


class StrictJSONError(ValueError):
    """What a strict document may not hold."""


def strict_json(text: str, max_depth: int = 64):
    """Decode JSON, refusing repeated members, other constants than JSON's, and nesting beyond ``max_depth``."""

    def members(pairs: list[tuple]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise StrictJSONError("a member is repeated")
        return out

    def refuse(name: str):
        raise StrictJSONError(f"{name} is no JSON")

    def depth(value, left: int) -> None:
        if left < 0:
            raise StrictJSONError("nested too deeply")
        for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            depth(inner, left - 1)

    try:
        value = json.loads(text, object_pairs_hook=members, parse_constant=refuse)
    except (RecursionError, json.JSONDecodeError) as e:
        raise StrictJSONError(str(e)) from e
    depth(value, max_depth)
    return value


def json_strings(text: str | None) -> list[str] | None:
    """Every string a document holds as a value, in order; None where it is no JSON."""
    try:
        value = strict_json(text or "")
    except StrictJSONError:
        return None
    out: list[str] = []

    def walk(v) -> None:
        if isinstance(v, str):
            out.append(v)
        for inner in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
            walk(inner)

    walk(value)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_strings_udf(texts: pd.Series) -> pd.Series:
    return texts.map(json_strings)


def shell_words(line: str) -> list[list[str]]:
    """Static words of each command of a shell line; a word that expands something is left out."""
    commands, words, word, dynamic, at, quoted = [], [], None, False, 0, ""

    def end_word() -> None:
        nonlocal word, dynamic
        if word is not None and not dynamic:
            words.append(word)
        word, dynamic = None, False

    def end_command() -> None:
        nonlocal words
        end_word()
        if words:
            commands.append(words)
        words = []

    while at < len(line):
        c = line[at]
        if quoted:
            if c == quoted:
                quoted = ""
            elif c == "\\" and quoted == '"' and at + 1 < len(line):
                at += 1
                word = (word or "") + line[at]
            else:
                dynamic |= quoted == '"' and c in "$`"
                word = (word or "") + c
        elif c in "'\"":
            quoted, word = c, word or ""
        elif c == "\\" and at + 1 < len(line):
            at += 1
            word = (word or "") + line[at]
        elif c in " \t":
            end_word()
        elif c in ";&|\n()":
            end_command()
        elif c == "#" and word is None:
            at = line.find("\n", at)
            if at < 0:
                break
            continue
        else:
            dynamic |= c in "$`*?"
            word = (word or "") + c
        at += 1
    end_command()
    return commands


class _Scripts(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        held = dict(attrs)
        if tag == "script" and held.get("src"):
            self.found.append(held["src"])
        if tag == "link" and "modulepreload" in (held.get("rel") or "").lower().split() and held.get("href"):
            self.found.append(held["href"])


def html_entries(html: str | None) -> list[str]:
    """Scripts that a page loads, in order."""
    reader = _Scripts()
    reader.feed(html or "")
    return reader.found


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_entries_udf(pages: pd.Series) -> pd.Series:
    return pages.map(html_entries)


def yaml_value(text: str):
    """A block YAML subset: mappings, sequences, plain and quoted scalars, comments. Raises ValueError beyond it."""
    lines = [(len(raw) - len(raw.lstrip(" ")), raw.strip()) for raw in (re.sub(r"(^|\s)#.*$", "", line.rstrip()) if "'" not in line and '"' not in line else line.rstrip() for line in text.splitlines()) if raw.strip() and raw.strip() != "---"]
    at = 0

    def scalar(s: str):
        s = s.strip()
        if len(s) > 1 and s[0] == s[-1] == "'":
            return s[1:-1].replace("''", "'")
        if s[:1] == '"':
            return json.loads(s)
        if s[:1] in "[{":
            return json.loads(re.sub(r"([\[{,:]\s*)([A-Za-z_./@*-][^,\]\}:\"]*)", lambda m: m[1] + (m[2] if m[2] in ("true", "false", "null") else json.dumps(m[2].strip())), s))
        if s[:1] in "&*!|>%@`":
            raise ValueError(f"beyond the subset: {s[:20]}")
        if s in ("", "~", "null"):
            return None
        if s in ("true", "false"):
            return s == "true"
        return int(s) if re.fullmatch(r"-?(0|[1-9]\d*)", s) else float(s) if re.fullmatch(r"-?\d+\.\d+", s) else s

    def block(indent: int):
        nonlocal at
        if lines[at][1].startswith("- ") or lines[at][1] == "-":
            out = []
            while at < len(lines) and lines[at][0] == indent and (lines[at][1].startswith("- ") or lines[at][1] == "-"):
                rest = lines[at][1][1:].strip()
                if not rest:
                    at += 1
                    out.append(block(lines[at][0]) if at < len(lines) and lines[at][0] > indent else None)
                elif re.match(r"[^\s'\"\[{][^'\"]*?:(\s|$)", rest):
                    lines[at] = (indent + 2, rest)
                    out.append(block(indent + 2))
                else:
                    at += 1
                    out.append(scalar(rest))
            return out
        found: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            m = re.match(r"""("(?:[^"\\]|\\.)*"|'[^']*'|[^:\s][^:]*?)\s*:(?:\s+(.*)|)$""", lines[at][1])
            if not m:
                raise ValueError(f"no mapping: {lines[at][1][:20]}")
            key, rest = str(scalar(m[1])), (m[2] or "").strip()
            if key in found:
                raise ValueError(f"{key} is repeated")
            at += 1
            if rest:
                found[key] = scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
                found[key] = block(lines[at][0])
            else:
                found[key] = None
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError("indented too far")
        return found

    if not lines:
        return None
    if len(lines) == 1 and not re.search(r":(\s|$)|^- ", lines[0][1]):
        return scalar(lines[0][1])
    value = block(lines[0][0])
    if at != len(lines):
        raise ValueError("lines are left over")
    return value


@F.pandas_udf(T.StringType())
def yaml_json_udf(texts: pd.Series) -> pd.Series:
    """YAML documents as JSON text; null where they are beyond the subset."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(yaml_value(text or ""), ensure_ascii=False)
        except (ValueError, IndexError):
            return None

    return texts.map(one)


#: Characters a reference's path and name keep as they are.
SAFE = "-._~!$&'()*+,;=:@"


@F.pandas_udf(T.StringType())
def encoded_udf(texts: pd.Series) -> pd.Series:
    """Percent-encoding of a path, segments kept."""
    return texts.map(lambda t: None if t is None else quote(t, safe=SAFE + "/"))


def ref_of(package: str, path: str, fragment: str) -> Column:
    """``ts://package/path#fragment`` of encoded parts; no fragment for files."""
    return F.concat(F.lit("ts://"), F.col(package), F.lit("/"), encoded_udf(F.col(path)), F.when(F.col(fragment) != "", F.concat(F.lit("#"), F.col(fragment))).otherwise(F.lit("")))
