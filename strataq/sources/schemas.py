"""Tables, keys and indexes of SQL and Prisma schemas, read from tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from .brace_code import lex

SCHEMA = "path string, owner string, kind string, columns array<string>, line int"

_SQL = re.compile(r"""(?P<skip>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>'(?:[^']|'')*'?)|(?P<quoted>"[^"]*"?|`[^`]*`?|\[[\w $]*\])|(?P<word>[\w$]+)|(?P<mark>.)""", re.S)


class Word(NamedTuple):
    text: str  # quoted names without their quotes, other words in capitals
    name: str  # as a column or table is compared: lower case
    line: int
    quoted: bool


def _statements(text: str) -> Iterator[list[Word]]:
    held, line = [], 1
    for m in _SQL.finditer(text):
        piece, kind = m.group(), m.lastgroup
        if kind == "mark" and piece == ";":
            yield held
            held = []
        elif kind == "quoted":
            held.append(Word(piece[1:-1], piece[1:-1].lower(), line, True))
        elif kind != "skip":
            held.append(Word("" if kind == "text" else piece.upper(), piece.lower(), line, kind == "text"))
        line += piece.count("\n")
    yield held


def _is(words: list[Word], i: int, *texts: str) -> bool:
    return all(i + k < len(words) and not words[i + k].quoted and words[i + k].text == t for k, t in enumerate(texts))


def _name(words: list[Word], i: int) -> tuple[str, int]:
    """The last part of a dotted name at i, and what follows it."""
    while _is(words, i + 1, "."):
        i += 2
    return (words[i].name if i < len(words) else ""), i + 1


def _group(words: list[Word], i: int) -> tuple[list[list[Word]], int]:
    """The comma-separated parts of the brackets that open at i, and what follows them."""
    depth, parts = 0, [[]]
    for k in range(i, len(words)):
        depth += _is(words, k, "(") - _is(words, k, ")")
        if depth == 0:
            return [p for p in parts if p], k + 1
        if depth == 1 and _is(words, k, ","):
            parts.append([])
        elif k > i:
            parts[-1].append(words[k])
    return [p for p in parts if p], len(words)


def _columns(words: list[Word], i: int) -> tuple[list[str], int]:
    parts, after = _group(words, i)
    return [_name(p, 0)[0] for p in parts], after


def _skip(words: list[Word], i: int, *optional: str) -> int:
    while any(_is(words, i, o) for o in optional):
        i += 1
    return i


def _bracket(words: list[Word], i: int) -> int:
    """The next opening bracket from i on."""
    return next((k for k in range(i, len(words)) if _is(words, k, "(")), len(words))


def _part(words: list[Word]) -> Iterator[tuple[str, list[str]]]:
    """(kind, columns) of what one part of a table's brackets declares."""
    i = 2 if _is(words, 0, "CONSTRAINT") else 0
    key = {"PRIMARY": "primary", "FOREIGN": "foreign", "UNIQUE": "index", "KEY": "index", "INDEX": "index"}.get(words[i].text if i < len(words) and not words[i].quoted else "")
    if key and (opened := _bracket(words, i)) < len(words) and opened - i <= 3:
        yield key, _columns(words, opened)[0]
        return
    column = words[0].name
    if any(_is(words, k, "PRIMARY", "KEY") for k in range(len(words))):
        yield "primary", [column]
    if any(_is(words, k, "UNIQUE") for k in range(len(words))):
        yield "index", [column]
    if any(_is(words, k, "REFERENCES") for k in range(len(words))):
        yield "foreign", [column]


def _sql(text: str) -> Iterator[tuple[str, str, list[str], int]]:
    for words in _statements(text):
        starts = [k for k in range(len(words)) if _is(words, k, "CREATE") or _is(words, k, "ALTER", "TABLE")][:1]
        for k in starts:
            line = words[k].line
            if _is(words, k, "ALTER"):
                table, i = _name(words, _skip(words, k + 2, "ONLY", "IF", "EXISTS"))
                for j in range(i, len(words)):
                    if _is(words, j + 1, "KEY") and words[j].text in ("FOREIGN", "PRIMARY"):
                        yield table, words[j].text.lower(), _columns(words, _bracket(words, j))[0], line
                continue
            i = _skip(words, k + 1, "TEMP", "TEMPORARY", "UNLOGGED", "UNIQUE", "GLOBAL", "LOCAL")
            passing = any(_is(words, j, t) for j in range(k, i) for t in ("TEMP", "TEMPORARY"))
            if _is(words, i, "TABLE"):
                table, i = _name(words, _skip(words, i + 1, "IF", "NOT", "EXISTS"))
                if not _is(words, i, "("):
                    continue
                yield table, "temporary" if passing else "table", [], line
                for part in _group(words, i)[0]:
                    for kind, columns in _part(part):
                        yield table, kind, columns, part[0].line
            elif _is(words, i, "INDEX"):
                on = next((j for j in range(i, len(words)) if _is(words, j, "ON")), len(words))
                table, i = _name(words, _skip(words, on + 1, "ONLY"))
                if (opened := _bracket(words, i)) < len(words):
                    yield table, "index", _columns(words, opened)[0], line


def _listed(words: list[str], i: int) -> list[str]:
    """The names that stand first in the items of the list that opens at or after i; what brackets in it hold is passed over."""
    names, depth, fresh = [], 0, True
    for word in words[words.index("[", i) + 1 :]:
        if word == "]" and not depth:
            break
        depth += (word in "([") - (word in ")]")
        if fresh and not depth:
            names.append(word.lower())
        fresh = word == "," and not depth
    return names


def _model(rows: dict[int, list[str]], indexed: bool) -> Iterator[tuple[str, list[str], int]]:
    """(kind, columns, line) of a model's lines. `indexed`: the database makes an index for each relation, or has none."""
    for line, words in rows.items():
        marks = {words[k + 1]: k for k in range(len(words) - 1) if words[k] == "@"}
        keyed = [m for m in ("id", "unique", "index") if m in marks]
        if words[0] == "@":
            if keyed and "[" in words:
                yield "primary" if keyed[0] == "id" else "index", _listed(words, 0), line
            continue
        for mark in keyed[:1]:
            yield "primary" if mark == "id" else "index", [words[0].lower()], line
        if "relation" in marks and "fields" in words[marks["relation"] :]:
            columns = _listed(words, words.index("fields", marks["relation"]))
            yield "foreign", columns, line
            if indexed:
                yield "index", columns, line


def _prisma(text: str) -> Iterator[tuple[str, str, list[str], int]]:
    tokens = [t for t in lex(text) if t.kind != "comment"]
    blocks = []  # (kind, name, line, lines of words)
    depth = 0
    for k, t in enumerate(tokens):
        if t.text == "{":
            depth += 1
            if depth == 1 and k >= 2:
                blocks.append((tokens[k - 2].text, tokens[k - 1].text, tokens[k - 2].line, {}))
        elif t.text == "}":
            depth -= 1
        elif depth and blocks:
            blocks[-1][3].setdefault(t.line, []).append(t.text)
    providers = [words[2][1:-1] for kind, _, _, rows in blocks if kind == "datasource" for words in rows.values() if words[:2] == ["provider", "="] and len(words) > 2]
    for kind, name, line, rows in blocks:
        if kind == "model":
            yield name.lower(), "table", [], line
            for found in _model(rows, "mysql" in providers or "mongodb" in providers):
                yield name.lower(), *found


def schema(path: str, text: str) -> list[tuple]:
    """(path, owner, kind, columns, line): kind is table, temporary, primary, index or foreign.

    MySQL makes an index for each foreign key and MongoDB has none, so there a relation comes with an index of its own.
    """
    if path.endswith(".prisma"):
        return [(path, *row) for row in _prisma(text)]
    found = list(_sql(text))
    if re.search(r"(?i)\bauto_increment\b|\bengine\s*=", text):
        found += [(owner, "index", columns, line) for owner, kind, columns, line in found if kind == "foreign"]
    return [(path, *row) for row in found]
