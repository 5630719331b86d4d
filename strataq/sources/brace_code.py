"""JavaScript, TypeScript, Java, C and C++ by a lexer: comments and strings are set apart, braces give spans.

Complexity counts decision tokens, which a lexer sees as a parser does. Unused, unreachable and insecure rules are
approximations from token order and say so in `approximate`.
"""

from __future__ import annotations

import re
from zlib import crc32

from .python_code import MOST_TODO

LEXER = re.compile(r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<mark>\?\?=?|&&=?|\|\|=?|=>|\?\.|[-+*/%=<>!&|^~?:;,.(){}\[\]#@])|(?P<space>\s+)|(?P<other>.)", re.S)
METRICS = "path string, code_lines int, comment_lines int, blank_lines int, functions int, classes int, max_complexity int, max_nesting int"
FUNCTIONS = "path string, name string, line int, end_line int, complexity int, nesting int, parameters int"
SYMBOLS = "path string, name string, kind string, parent string, exported boolean, line int"
FINDINGS = "path string, rule_id string, severity string, line int, evidence string, key string, approximate boolean"

DECISIONS = {"if", "for", "while", "case", "catch", "&&", "||", "??", "?"}
OPENS = {"if", "for", "while", "do", "switch", "try", "else", "catch", "finally"}
NOT_FUNCTIONS = OPENS | {"return", "new", "function", "with", "synchronized", "throw", "typeof", "sizeof", "await"}


TOKENS = "path string, hashes array<bigint>, rows array<int>"


class Token(tuple):
    """(kind, text, line)"""

    __slots__ = ()
    kind, text, line = (property(lambda self, i=i: self[i]) for i in range(3))


def lex(text: str) -> list[Token]:
    """Tokens without white space; template strings are one token."""
    out, line = [], 1
    for m in LEXER.finditer(text):
        if m.lastgroup != "space":
            out.append(Token((m.lastgroup, m.group(), line)))
        line += m.group().count("\n")
    return out


def tokens(path: str, text: str) -> list[tuple]:
    """Hashes of a file's tokens and the rows they begin in, from 0; comments and white space are no tokens."""
    code = [t for t in lex(text) if t.kind != "comment"]
    return [(path, [crc32(t.text.encode("utf-8", "replace")) for t in code], [t.line - 1 for t in code])] if code else []


def _closing(tokens: list[Token], at: int, pair: str) -> int:
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].kind == "mark" and tokens[i].text in pair:
            depth += 1 if tokens[i].text == pair[0] else -1
            if depth == 0:
                return i
    return len(tokens) - 1


def _function_spans(code: list[Token]) -> list[tuple[str, int, int, int, int]]:
    """(name, head, parameters begin, body begins, body ends) of functions, methods and arrow functions with a block."""
    out = []
    for i, t in enumerate(code):
        if t.text == "(" and i and t.kind == "mark":
            end = _closing(code, i, "()")
            after = end + 1
            arrow = after < len(code) and code[after].text == "=>"
            if arrow:
                after += 1
            elif after < len(code) and code[after].text == ":":  # a TypeScript result type
                while after < len(code) and code[after].text not in ("{", ";", "=>", ")"):
                    after += 1
                if after < len(code) and code[after].text == "=>":
                    arrow, after = True, after + 1
            while after < len(code) and code[after].text in ("throws", "const", "noexcept", "override", "final") or (after < len(code) and code[after - 1].text in ("throws", ",") and code[after].kind == "name"):
                after += 1
            if after >= len(code) or code[after].text != "{":
                continue
            before = code[i - 1]
            if arrow:
                k = i - 1
                while k > 0 and code[k].text in ("async", "=", ":"):
                    k -= 1
                name = code[k].text if code[k].kind == "name" and k < i - 1 else "<anonymous>"
            elif before.kind == "name" and before.text not in NOT_FUNCTIONS:
                name = before.text
            elif before.text == "function":
                name = code[i - 3].text if i >= 3 and code[i - 2].text == "=" else "<anonymous>"
            else:
                continue
            out.append((name, i - 1, i, after, _closing(code, after, "{}")))
    return out


def functions(path: str, text: str) -> list[tuple]:
    code = [t for t in lex(text) if t.kind != "comment"]
    spans = _function_spans(code)
    out = []
    for name, head, params, begin, end in spans:
        inner = [(b, e) for _, _, _, b, e in spans if begin < b and e < end]
        total, depth, deepest, stack = 1, 0, 0, []
        for i in range(begin + 1, end):
            if any(b <= i <= e for b, e in inner):
                continue
            t = code[i]
            if t.kind in ("name", "mark") and t.text in DECISIONS and not (t.text == "?" and i + 1 < end and code[i + 1].text in (":", ")", ",", ";")):
                total += 1
            if t.text == "{" and t.kind == "mark":
                k = i - 1
                if code[k].text == ")":
                    k = _opening(code, k) - 1
                opens = code[k].text in OPENS and not (code[k].text == "else")
                chained = code[k].text == "if" and code[k - 1].text == "else"
                stack.append(opens and not chained or code[k].text == "else" and False)
                depth += stack[-1]
                deepest = max(deepest, depth)
            elif t.text == "}" and t.kind == "mark" and stack:
                depth -= stack.pop()
        inside = code[params + 1 : _closing(code, params, "()")]
        level, commas = 0, 0
        for t in inside:
            level += t.text in "([{<" and t.kind == "mark"
            level -= t.text in ")]}>" and t.kind == "mark"
            commas += t.text == "," and level == 0
        out.append((path, name, code[head].line, code[end].line, total, deepest, commas + 1 if inside else 0))
    return sorted(out, key=lambda r: (r[2], r[1]))


def _opening(code: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, -1, -1):
        if code[i].kind == "mark":
            depth += (code[i].text == ")") - (code[i].text == "(")
            if depth == 0:
                return i
    return 0


def metrics(path: str, text: str) -> list[tuple]:
    tokens = lex(text)
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    code, comment = set(), set()
    for t in tokens:
        (comment if t.kind == "comment" else code).update(range(t.line, t.line + t.text.count("\n") + 1))
    found = functions(path, text)
    classes = sum(t.kind == "name" and t.text in ("class", "interface") for t in tokens)
    blank = sum(1 for i, x in enumerate(lines, 1) if not x.strip() and i not in code and i not in comment)
    return [(path, len(code), len(comment - code), blank, len(found), classes, max((f[4] for f in found), default=0), max((f[5] for f in found), default=0))]


_DECLARED = re.compile(r"(?m)^[ \t]*(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(function|class|interface|type|enum|const|let)\s+\*?\s*([A-Za-z_$][\w$]*)")
_KINDS = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "const": "constant", "let": "variable"}


def blanked(text: str) -> str:
    """The text with comments and the insides of strings replaced by spaces, so that patterns see code only."""

    def blank(m: re.Match) -> str:
        if m.lastgroup == "comment":
            return re.sub(r"[^\n]", " ", m.group())
        if m.lastgroup == "text" and len(m.group()) > 2:
            return m.group()[0] + re.sub(r"[^\n]", " ", m.group()[1:-1]) + m.group()[-1]
        return m.group()

    return LEXER.sub(blank, text)


def symbols(path: str, text: str) -> list[tuple]:
    """Top-level declarations of JavaScript and TypeScript, and the methods of classes."""
    plain = blanked(text)
    at = lambda i: plain.count("\n", 0, i) + 1
    out, depth, depths = [], 0, []
    for c in plain:
        depths.append(depth)
        depth += (c == "{") - (c == "}")
    classes = []
    for m in _DECLARED.finditer(plain):
        if depths[m.start(2)] == 0:
            kind = _KINDS[m.group(2)]
            if kind == "constant" and re.match(r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::[^=]+)?=>", plain[m.end() :]):
                kind = "function"
            out.append((path, m.group(3), kind, None, bool(m.group(1)), at(m.start(2))))
            if kind == "class":
                classes.append((m.group(3), m.end(), bool(m.group(1))))
    for name, begin, exported in classes:
        inside = depths[begin] + 1
        for m in re.finditer(r"(?m)^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(#?[A-Za-z_$][\w$]*)\s*(?:<[^>\n]*>)?\((?:[^;{}]|\{[^{}]*\})*?\)\s*(?::[^{;\n]+)?\{", plain[begin:]):
            if depths[begin + m.start(1)] < inside:
                break
            if depths[begin + m.start(1)] == inside and m.group(1) not in NOT_FUNCTIONS:
                private = m.group(1).startswith("#") or "private" in plain[begin + m.start() : begin + m.start(1)]
                out.append((path, m.group(1), "method", name, exported and not private, at(begin + m.start(1))))
    return sorted(out, key=lambda r: (r[5], r[1]))


# Shapes of dangerous calls by language group (rule, severity, pattern on code without comments).
INSECURE = {
    "js": (
        ("injection/dynamic-code-execution", "HIGH", r"\b(?:eval|new\s+Function)\s*\(\s*(?!['\"`)])[^)]"),
        ("injection/os-command", "HIGH", r"\b(?:exec|execSync)\s*\(\s*(?:`[^`]*\$\{|[A-Za-z_$][\w$.]*\s*[,+)]|['\"][^'\"]*['\"]\s*\+)"),
        ("injection/sql", "HIGH", r"\.(?:query|execute|raw)\s*\(\s*(?:`\s*(?i:select|insert|update|delete)\b[^`]*\$\{|['\"]\s*(?i:select|insert|update|delete)\b[^'\"]*['\"]\s*\+)"),
        ("injection/xss-sink", "MEDIUM", r"\.(?:innerHTML|outerHTML)\s*=\s*(?!['\"`]\s*['\"`]?;?)[A-Za-z_$]|\bdangerouslySetInnerHTML\b|\bdocument\.write\s*\(\s*[A-Za-z_$]"),
        ("crypto/tls-verification-disabled", "HIGH", r"\brejectUnauthorized\s*:\s*false\b|NODE_TLS_REJECT_UNAUTHORIZED['\"]?\]?\s*=\s*['\"]?0"),
        ("crypto/jwt-verification-disabled", "HIGH", r"\balgorithms?\s*:\s*\[?\s*['\"]none['\"]|\bignoreExpiration\s*:\s*true\b"),
        ("crypto/weak-hash", "MEDIUM", r"\bcreateHash\s*\(\s*['\"](?i:md5|md4|sha-?1)['\"]"),
        ("crypto/weak-cipher", "MEDIUM", r"\bcreateCipher(?:iv)?\s*\(\s*['\"](?i:des|rc4|[\w-]*-ecb)[\w-]*['\"]|\bcreateCipher\s*\("),
        ("crypto/insecure-randomness", "MEDIUM", r"(?i)\b\w*(?:token|secret|password|nonce|salt|otp|session_?id|csrf)\w*\s*[:=][^;\n]*\bMath\.random\s*\("),
    ),
    "java": (
        ("injection/os-command", "HIGH", r"\.exec\s*\(\s*(?:\"[^\"]*\"\s*\+|[a-z]\w*\s*[,)+])"),
        ("injection/sql", "HIGH", r"\.(?:executeQuery|executeUpdate|execute|createQuery|prepareStatement)\s*\(\s*\"\s*(?i:select|insert|update|delete)\b[^\"]*\"\s*\+"),
        ("unsafe/deserialization", "MEDIUM", r"\bnew\s+ObjectInputStream\s*\("),
        ("crypto/weak-hash", "MEDIUM", r"MessageDigest\.getInstance\s*\(\s*\"(?i:md5|md2|sha-?1)\""),
        ("crypto/weak-cipher", "MEDIUM", r"Cipher\.getInstance\s*\(\s*\"(?:DES|RC4|[^\"]*/ECB/)[^\"]*\""),
        ("crypto/insecure-randomness", "MEDIUM", r"(?i)\b\w*(?:token|secret|password|nonce|salt|otp)\w*\s*=[^;\n]*\bnew\s+Random\s*\("),
    ),
    "c": (("memory/unsafe-c-function", "MEDIUM", r"(?<![\w.>])(?:gets|strcpy|strcat|sprintf|vsprintf)\s*\("), ("injection/os-command", "HIGH", r"(?<![\w.>])(?:system|popen)\s*\(\s*(?!\")[A-Za-z_]")),
}
GROUPS = {"js": "js", "jsx": "js", "ts": "js", "tsx": "js", "mjs": "js", "cjs": "js", "java": "java", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c"}
_TODO = re.compile(r"\b(?:TODO|FIXME|HACK|XXX)\b")


def findings(path: str, text: str) -> list[tuple]:
    """Insecure calls, debugger statements, empty catch blocks, unused imports and marked comments."""
    group = GROUPS.get(path.rsplit(".", 1)[-1].lower())
    lines, out = text.split("\n"), []
    no_comments = LEXER.sub(lambda m: re.sub(r"[^\n]", " ", m.group()) if m.lastgroup == "comment" else m.group(), text)

    def emit(offset: int, rule: str, severity: str, key: str, approximate: bool) -> None:
        line = text.count("\n", 0, offset) + 1
        out.append((path, rule, severity, line, lines[line - 1].strip()[:160], key, approximate))

    for rule, severity, pattern in INSECURE.get(group, ()):
        for m in re.finditer(pattern, no_comments):
            emit(m.start(), rule, severity, m.group()[:40], True)
    plain = blanked(text)
    for m in re.finditer(r"(?m)^\s*debugger\s*;?", plain) if group == "js" else ():
        emit(m.end() - 1, "smell/debugger-statement", "LOW", "debugger", False)
    for m in re.finditer(r"\bcatch\s*(?:\([^)]*\))?\s*\{\s*\}", plain):
        emit(m.start(), "smell/empty-catch", "MEDIUM", "catch", False)
    if group == "js":
        for m in re.finditer(r"(?m)^\s*import\s+(?:type\s+)?(?:([A-Za-z_$][\w$]*)\s*,?\s*)?(?:\*\s+as\s+([\w$]+)|\{([^}]*)\})?\s*from\b", plain):
            names = [m.group(1), m.group(2), *(re.split(r"\s+as\s+", x.strip())[-1].removeprefix("type ").strip() for x in (m.group(3) or "").split(","))]
            for name in filter(None, names):
                if not re.search(rf"(?<![\w$.]){re.escape(name)}(?![\w$])", plain[: m.start()] + plain[m.end() :]):
                    emit(m.start() + len(m.group()) - len(m.group().lstrip()), "dead-code/unused-import", "LOW", name, True)
    marks = [t for t in lex(text) if t.kind == "comment" and _TODO.search(t.text)]
    for t in marks[:MOST_TODO]:
        out.append((path, "smell/todo-comment", "INFO", t.line + t.text[: _TODO.search(t.text).start()].count("\n"), lines[t.line - 1].strip()[:160], _TODO.search(t.text).group(), False))
    return sorted(set(out), key=lambda r: (r[3], r[1], r[5]))
