"""Python sources: one pass over the syntax tree gives line counts, functions, symbols and findings."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator
from zlib import crc32

METRICS = "path string, code_lines int, comment_lines int, blank_lines int, logical_lines int, functions int, classes int, max_complexity int, max_nesting int, error boolean"
FUNCTIONS = "path string, name string, line int, end_line int, complexity int, nesting int, parameters int, code_lines int"
SYMBOLS = "path string, name string, kind string, parent string, exported boolean, line int, end_line int, signature string"
FINDINGS = "path string, rule_id string, severity string, line int, evidence string, key string"
IMPORTS = "path string, specifier string, name string, alias string, line int"

_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _docstrings(tree: ast.Module) -> set[int]:
    """Lines of documentation strings, which count as comments."""
    lines: set[int] = set()
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, *_FUNCTIONS)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                lines.update(range(first.lineno, first.end_lineno + 1))
    return lines


def line_classes(text: str, tree: ast.Module | None) -> tuple[set[int], set[int], int]:
    """(code lines, comment lines, blank lines); a line with code is code whatever else it holds."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    code, comment = set(), set()
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                comment.add(t.start[0])
            elif t.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
                code.update(range(t.start[0], t.end[0] + 1))
    except (tokenize.TokenError, SyntaxError):
        code.update(i for i, x in enumerate(lines, 1) if x.strip() and not x.strip().startswith("#"))
    doc = _docstrings(tree) if tree else set()
    code -= doc
    comment = (comment | doc) - code
    blank = sum(1 for i, x in enumerate(lines, 1) if not x.strip() and i not in code and i not in comment)
    return code, comment, blank


def tokens(path: str, text: str) -> list[tuple]:
    """Hashes of a file's tokens and the rows they begin in, from 0; comments, line ends and indents are no tokens."""
    code = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type not in (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER):
                code.append((crc32(t.string.encode("utf-8", "replace")), t.start[0] - 1))
    except (tokenize.TokenError, SyntaxError):
        pass  # what stands before the fault counts
    return [(path, [h for h, _ in code], [row for _, row in code])] if code else []


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes of a function without those of functions and classes inside it."""
    todo = list(ast.iter_child_nodes(node))
    while todo:
        n = todo.pop()
        yield n
        if not isinstance(n, (*_FUNCTIONS, ast.ClassDef, ast.Lambda)):
            todo.extend(ast.iter_child_nodes(n))


def complexity(node: ast.AST) -> int:
    """One, one for each decision, and one for each further operand of a boolean expression and condition of a comprehension."""
    total = 1
    for n in _own(node):
        if isinstance(n, _DECISIONS):
            total += 1 + (len(n.ifs) if isinstance(n, ast.comprehension) else 0)
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
    return total


def nesting(node: ast.AST, depth: int = 0) -> int:
    """The deepest stack of open constructs; an elif continues its if."""
    deepest = depth
    todo = [(c, depth, False) for c in ast.iter_child_nodes(node)]
    while todo:
        n, d, chained = todo.pop()
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef, ast.Lambda)):
            continue
        at = d + (isinstance(n, _NESTS) and not chained)
        deepest = max(deepest, at)
        for field, value in ast.iter_fields(n):
            for c in value if isinstance(value, list) else [value]:
                if isinstance(c, ast.AST):
                    elif_ = isinstance(n, ast.If) and field == "orelse" and len(value) == 1 and isinstance(c, ast.If)
                    todo.append((c, at, elif_))
    return deepest


def functions(path: str, text: str) -> list[tuple]:
    tree = _tree(text)
    if tree is None:
        return []
    code, _, _ = line_classes(text, tree)
    out = []
    for n in ast.walk(tree):
        if isinstance(n, _FUNCTIONS):
            a = n.args
            names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)] + [x.arg for x in (a.vararg, a.kwarg) if x]
            n_params = len(names) - (bool(names) and names[0] in ("self", "cls"))
            out.append((path, n.name, n.lineno, n.end_lineno, complexity(n), nesting(n), n_params, len(code & set(range(n.lineno, n.end_lineno + 1)))))
    return sorted(out, key=lambda r: r[2])


def metrics(path: str, text: str) -> list[tuple]:
    tree = _tree(text)
    code, comment, blank = line_classes(text, tree)
    found = functions(path, text)
    logical = sum(isinstance(n, ast.stmt) for n in ast.walk(tree)) if tree else 0
    classes = sum(isinstance(n, ast.ClassDef) for n in ast.walk(tree)) if tree else 0
    return [(path, len(code), len(comment), blank, logical, len(found), classes, max((f[4] for f in found), default=0), max((f[5] for f in found), default=0), tree is None)]


def symbols(path: str, text: str) -> list[tuple]:
    """Functions, classes, methods and constants of the module, exported unless the name begins with an underscore or
    __all__ leaves it out."""
    tree = _tree(text)
    if tree is None:
        return []
    listed = None
    for n in tree.body:
        if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets) and isinstance(n.value, (ast.List, ast.Tuple)):
            listed = {e.value for e in n.value.elts if isinstance(e, ast.Constant)}
    public = lambda name: name in listed if listed is not None else not name.startswith("_")
    head = lambda n: f"def {n.name}({ast.unparse(n.args)})"
    out = []
    for n in tree.body:
        if isinstance(n, _FUNCTIONS):
            out.append((path, n.name, "function", None, public(n.name), n.lineno, n.end_lineno, head(n)))
        elif isinstance(n, ast.ClassDef):
            out.append((path, n.name, "class", None, public(n.name), n.lineno, n.end_lineno, f"class {n.name}"))
            out += [(path, m.name, "method", n.name, public(n.name) and not m.name.startswith("_"), m.lineno, m.end_lineno, head(m)) for m in n.body if isinstance(m, _FUNCTIONS)]
        elif isinstance(n, ast.Assign):
            out += [(path, t.id, "constant", None, public(t.id), n.lineno, n.end_lineno, None) for t in n.targets if isinstance(t, ast.Name) and t.id.isupper()]
    return out


def imports(path: str, text: str) -> list[tuple]:
    tree = _tree(text)
    out = []
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, ast.Import):
            out += [(path, a.name, None, a.asname or a.name.split(".")[0], n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out += [(path, "." * n.level + (n.module or ""), a.name, a.asname or a.name, n.lineno) for a in n.names]
    return out


def _name(node: ast.AST) -> str:
    """Dotted name of a callee, '' if it is none."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ""


def _constant(node: ast.AST | None) -> bool:
    if node is None or isinstance(node, ast.Constant):
        return True
    if isinstance(node, ast.BinOp):
        return _constant(node.left) and _constant(node.right)
    return isinstance(node, (ast.Tuple, ast.List)) and all(map(_constant, node.elts))


_SQL = re.compile(r"^\s*(?:select|insert|update|delete|replace|merge|create|drop|alter|truncate|with)\b|\bselect\b.*\bfrom\b", re.I | re.S)
_SENSITIVE = re.compile(r"token|secret|passw(?:or)?d|nonce|salt|otp|api_?key|session_?id|csrf", re.I)
_WEAK = ("md5", "md4", "md2", "sha1")


def _sql_text(node: ast.AST) -> str | None:
    """Constant parts of a built string, None if nothing is put into it."""
    if isinstance(node, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in node.values):
        return "".join(v.value for v in node.values if isinstance(v, ast.Constant))
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod)) and not _constant(node):
        return "".join(x.value for x in ast.walk(node) if isinstance(x, ast.Constant) and isinstance(x.value, str))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format" and isinstance(node.func.value, ast.Constant):
        return str(node.func.value.value)
    return None


def insecure(path: str, text: str) -> list[tuple]:
    """Dangerous calls by their shape: callee, constant or computed arguments, flags. No data flow."""
    tree = _tree(text)
    if tree is None:
        return []
    lines, out = text.split("\n"), []

    def emit(node: ast.AST, rule: str, severity: str, key: str) -> None:
        out.append((path, rule, severity, node.lineno, lines[node.lineno - 1].strip()[:160], key))

    for n in ast.walk(tree):
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and _name(n.value.func).startswith("random.") and any(_SENSITIVE.search(ast.unparse(t)) for t in n.targets):
            emit(n, "crypto/insecure-randomness", "MEDIUM", _name(n.value.func))
        if not isinstance(n, ast.Call):
            continue
        name = _name(n.func)
        last, first = name.rsplit(".", 1)[-1] if name else getattr(n.func, "attr", ""), n.args[0] if n.args else None
        flags = {k.arg: k.value for k in n.keywords if k.arg}
        on = lambda k: isinstance(flags.get(k), ast.Constant) and flags[k].value is True  # noqa: E731, B023
        off = lambda k: isinstance(flags.get(k), ast.Constant) and flags[k].value is False  # noqa: E731, B023
        if name in ("eval", "exec") and first is not None and not _constant(first):
            emit(n, "injection/dynamic-code-execution", "HIGH", name)
        elif name in ("os.system", "os.popen", "commands.getoutput") and not _constant(first):
            emit(n, "injection/os-command", "HIGH", name)
        elif name.startswith("subprocess.") and on("shell") and not _constant(first):
            emit(n, "injection/os-command", "HIGH", name)
        elif last in ("execute", "executemany", "raw") and first is not None and (sql := _sql_text(first)) and _SQL.search(sql):
            emit(n, "injection/sql", "HIGH", last)
        elif name in ("pickle.load", "pickle.loads", "cPickle.loads", "marshal.loads", "dill.loads", "shelve.open"):
            emit(n, "unsafe/deserialization", "MEDIUM", name)
        elif name == "yaml.load" and not any(x in ast.unparse(n) for x in ("SafeLoader", "CSafeLoader")):
            emit(n, "unsafe/deserialization", "MEDIUM", name)
        elif off("verify") or name == "ssl._create_unverified_context":
            emit(n, "crypto/jwt-verification-disabled" if last == "decode" else "crypto/tls-verification-disabled", "HIGH", name or last)
        elif last == "decode" and isinstance(flags.get("options"), ast.Dict) and "verify_signature" in ast.unparse(flags["options"]) and "False" in ast.unparse(flags["options"]):
            emit(n, "crypto/jwt-verification-disabled", "HIGH", name or last)
        elif name in tuple(f"hashlib.{w}" for w in _WEAK) and not off("usedforsecurity"):
            emit(n, "crypto/weak-hash", "MEDIUM", name)
        elif name == "hashlib.new" and isinstance(first, ast.Constant) and str(first.value).lower() in _WEAK:
            emit(n, "crypto/weak-hash", "MEDIUM", name)
        elif last in ("DES", "ARC4", "Blowfish") or (last == "new" and name.split(".")[0] in ("DES", "ARC4", "DES3", "Blowfish")) or "MODE_ECB" in ast.unparse(n):
            emit(n, "crypto/weak-cipher", "MEDIUM", name)
        elif last == "run" and on("debug"):
            emit(n, "config/debug-mode", "MEDIUM", name)
    return sorted(set(out), key=lambda r: (r[3], r[1]))


_TODO = re.compile(r"\b(?:TODO|FIXME|HACK|XXX)\b")
MOST_TODO = 20


def quality(path: str, text: str) -> list[tuple]:
    """Code-quality findings that the tree shows: unused imports and private functions, unreachable code, bare and empty
    handlers, debugger calls, marked comments."""
    tree = _tree(text)
    if tree is None:
        return []
    lines, out = text.split("\n"), []

    def emit(line: int, rule: str, severity: str, key: str) -> None:
        out.append((path, rule, severity, line, lines[line - 1].strip()[:160], key))

    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.value.id for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)}
    attributes = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
    texts = {n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    if not path.endswith("__init__.py"):
        for _, spec, name, alias, line in imports(path, text):
            if alias not in used and alias not in texts and name != "*" and spec != "__future__":
                emit(line, "dead-code/unused-import", "LOW", alias)
    for n in ast.walk(tree):
        if isinstance(n, _FUNCTIONS) and n.name.startswith("_") and not n.name.startswith("__") and n.name not in used | attributes | texts:
            emit(n.lineno, "dead-code/unused-private", "LOW", n.name)
        if isinstance(n, ast.ExceptHandler):
            if n.type is None:
                emit(n.lineno, "smell/bare-except", "MEDIUM", "except")
            if all(isinstance(s, ast.Pass) for s in n.body):
                emit(n.lineno, "smell/empty-catch", "MEDIUM", "pass")
        if isinstance(n, ast.Call) and _name(n.func) in ("breakpoint", "pdb.set_trace", "ipdb.set_trace"):
            emit(n.lineno, "smell/debugger-statement", "LOW", _name(n.func))
        for body in (getattr(n, f, None) for f in ("body", "orelse", "finalbody")):
            if isinstance(body, list):
                ends = next((i for i, s in enumerate(body) if isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue))), None)
                if ends is not None and ends + 1 < len(body):
                    emit(body[ends + 1].lineno, "dead-code/unreachable", "MEDIUM", type(body[ends]).__name__.lower())
    marks = [i for i, x in enumerate(lines, 1) if "#" in x and _TODO.search(x.split("#", 1)[1])]
    for i in marks[:MOST_TODO]:
        emit(i, "smell/todo-comment", "INFO", _TODO.search(lines[i - 1]).group())
    return sorted(set(out), key=lambda r: (r[3], r[1], r[5]))
