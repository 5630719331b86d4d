"""HTTP routes that sources declare: scripts and Java from tokens, Python from its syntax tree."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from .brace_code import Token, _closing, lex

ENDPOINTS = "path string, method string, route string, line int, framework string, auth boolean, reads_body boolean, validated boolean"

# Modules that serve, modules that call, objects whose methods are calls or look-ups, and method names.
SERVER_MODULES = {"express": "Express", "fastify": "Fastify", "koa": "Koa", "@koa/router": "Koa", "koa-router": "Koa", "hono": "Hono", "restify": "restify", "@hapi/hapi": "hapi", "polka": "polka", "h3": "h3", "elysia": "elysia"}
CLIENT_MODULES = "axios ky got superagent supertest node-fetch undici".split()
CLIENT_OBJECTS = "axios http https client request superagent got ky fetcher instance $http httpclient apiclient supertest agent cy page map cache params headers searchparams url store storage localstorage sessionstorage redis res response".split()
METHODS = "GET HEAD POST PUT PATCH DELETE OPTIONS".split()
CALLS = {"get": "GET", "post": "POST", "put": "PUT", "patch": "PATCH", "delete": "DELETE", "del": "DELETE", "all": "ANY", "options": "OPTIONS", "head": "HEAD"}
SCRIPTS = "js jsx ts tsx mjs cjs".split()
DECORATED = ("NestJS", "Flask", "FastAPI", "Python", "Spring")

AUTH = re.compile(r"\b(?:require|is|ensure|check)?auth(?!or)\w*|\b(?:login_required|permission_required|jwt_required|current_user|IsAuthenticated|PreAuthorize|Secured|RolesAllowed|passport|session\.user|verifyToken|Depends\(\s*get_current)", re.I)
BODY = re.compile(r"\b(?:req|request|ctx|c)\.(?:body|json\(|form|get_json|data|POST|files)|@Body\(|@RequestBody|\brequest\.(?:json|form)\b|await\s+\w+\.json\(\)")
VALIDATED = re.compile(r"\b(?:zod|joi|yup|ajv|celebrate|express-validator|class-validator|pydantic|BaseModel|marshmallow|safeParse|validationResult|ValidationPipe|schema\s*:|serializer)|\.parse\(|@Valid(?:ated)?\b", re.I)
ABOVE, BELOW = 3, 60  # lines that belong to a route, at most

Route = tuple[str, str, int, str]  # method, route, line, framework


def _path(*parts: str) -> str:
    return "/" + "/".join(filter(None, (p.strip("/") for p in parts)))


class Code:
    """Tokens without comments, and the questions that routes are found by."""

    def __init__(self, text: str):
        self.tokens = [t for t in lex(text) if t.kind != "comment"]

    def word(self, i: int) -> str:
        """The token at i, or nothing beyond the ends."""
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def string(self, i: int) -> str | None:
        """What a string token without insertions holds."""
        if 0 <= i < len(self.tokens) and self.tokens[i].kind == "text":
            held = self.tokens[i].text
            if held[0] not in "`" or "${" not in held:
                return held[1:-1] if len(held) > 1 and held[-1] == held[0] else held[1:]
        return None

    def end(self, i: int) -> int:
        """Where the bracket that opens at i closes."""
        return _closing(self.tokens, i, "()")

    def find(self, *words: str) -> Iterator[int]:
        """Places where these words follow one another; an empty one stands for any token."""
        for i in range(len(self.tokens) - len(words) + 1):
            if all(not w or self.tokens[i + k].text == w for k, w in enumerate(words)):
                yield i

    def annotations(self) -> Iterator[tuple[int, str, list[Token]]]:
        """(place, name, arguments) of each @name or @name(...)."""
        for i in self.find("@", ""):
            inside = self.tokens[i + 3 : self.end(i + 2)] if self.word(i + 2) == "(" else []
            yield i, self.word(i + 1), inside

    def modules(self) -> set[str]:
        named = {self.string(i + 1) for i in self.find("from", "")} | {self.string(i + 2) for i in self.find("require", "(", "")}
        return {m for m in named if m}


def _first_string(tokens: list[Token]) -> str:
    return next((t.text[1:-1] for t in tokens if t.kind == "text"), "")


def _by_folder(path: str, code: Code) -> list[Route] | None:
    """Routes that a file's place names: an app folder's route file, or a file below pages/api. None elsewhere."""
    *folders, name = path.split("/")
    stem, _, ending = name.partition(".")
    if stem == "route" and ending in SCRIPTS and "app" in folders:
        shown = [f for f in folders[folders.index("app") + 1 :] if f[0] != "@" and not (f[0] == "(" and f[-1] == ")")]
        found = []
        for i, t in enumerate(code.tokens):
            after = [code.word(k) for k in range(i + 1, i + 4)]
            if t.text == "export":
                words = after[1:] if after[0] == "async" else after
                found += [(words[1], t.line)] if words[0] in ("function", "const") else []
            elif t.text == "as":
                found.append((after[0], t.line))
        return [(method, _path(*shown), line, "Next.js") for method, line in found if method in METHODS]
    if ending in SCRIPTS and ("pages", "api") in zip([*folders, name], [*folders[1:], stem], strict=False):
        below = [*folders, stem][folders.index("pages") + 1 :]
        route = _path(*(below[:-1] if stem == "index" and len(below) > 1 else below))
        return [("ANY", route, code.tokens[i].line, "Next.js") for i in list(code.find("export", "default"))[:1]]
    return None


def _controllers(code: Code) -> list[Route]:
    """Decorated methods of a controller class."""
    prefix, found = "", []
    for i, name, inside in code.annotations():
        if name == "Controller":
            prefix = prefix or _first_string(inside[:1])
        elif name.lower() in CALLS and name[0].isupper() and name != "Del" and code.word(i + 2) == "(":
            found.append((CALLS[name.lower()], _first_string(inside[:1]), code.tokens[i].line))
    return [(method, _path(prefix, route), line, "NestJS") for method, route, line in found]


def _chained(code: Code, i: int) -> Iterator[str]:
    """Names of the calls that follow one another from the bracket at i."""
    at = code.end(i) + 1
    while code.word(at) == "." and code.word(at + 2) == "(":
        yield code.word(at + 1)
        at = code.end(at + 2) + 1


def _script(path: str, text: str) -> list[Route]:
    code = Code(text)
    placed = _by_folder(path, code)
    if placed is not None:
        return placed
    modules = code.modules()
    if "@nestjs/common" in modules:
        return _controllers(code)
    serving = [SERVER_MODULES[m] for t in code.tokens if t.kind == "text" and (m := t.text[1:-1]) in modules and m in SERVER_MODULES]
    framework, calling = (serving or ["Node.js"])[0], not modules.isdisjoint(CLIENT_MODULES)
    found = []
    for i in code.find(".", "", "("):
        name, called, route = code.word(i - 1), code.word(i + 1), code.string(i + 3)
        if route is None or not route.startswith("/"):
            continue
        router = name in ("app", "server", "fastify", "route", "routes") or name.lower().endswith("router")
        if called in CALLS and ((router and (serving or not calling)) or (serving and name.lower() not in CLIENT_OBJECTS and code.tokens[i - 1].kind == "name")):
            found.append((CALLS[called], route, code.tokens[i].line, framework))
        elif called == "route" and serving:
            found += [(CALLS[c], route, code.tokens[i].line, framework) for c in _chained(code, i + 2) if c in CALLS and c not in ("del", "options", "head")]
    return found


def _text(node: ast.expr | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _python(path: str, text: str) -> list[Route]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    nodes = list(ast.walk(tree))
    tops = {a.name.split(".")[0] for n in nodes if isinstance(n, ast.Import) for a in n.names} | {(n.module or "").split(".")[0] for n in nodes if isinstance(n, ast.ImportFrom) and not n.level}
    framework = "FastAPI" if "fastapi" in tops else "Flask" if "flask" in tops else "Python"
    found = []
    for node in nodes:
        for d in getattr(node, "decorator_list", ()):
            if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute)):
                continue
            named, called = {k.arg: k.value for k in d.keywords}, d.func.attr
            route = _text(d.args[0] if d.args else named.get("path"))
            if route is None or (route and route[0] != "/"):
                continue
            if called in ("route", "api_route"):
                listed = [m.upper() for e in getattr(named.get("methods"), "elts", ()) if (m := _text(e))] or ["GET"]
            else:
                listed = [called.upper()] if called in ("get", "post", "put", "patch", "delete") else []
            found += [(method, route or "/", d.lineno, framework) for method in listed]
        if path.rsplit("/", 1)[-1] == "urls.py" and isinstance(node, ast.Call) and node.args and (route := _text(node.args[0])) is not None:
            called = node.func.id if isinstance(node.func, ast.Name) else getattr(node.func, "attr", "")
            included = any(isinstance(a, ast.Call) and getattr(a.func, "id", getattr(a.func, "attr", "")) == "include" for a in node.args)
            if called in ("path", "re_path") and not included:
                found.append(("ANY", _path(route.removeprefix("^").removesuffix("$")), node.lineno, "Django"))
            elif called == "register" and isinstance(node.func, ast.Attribute):
                found.append(("ANY", _path(route), node.lineno, "Django REST framework"))
    return found


def _java(path: str, text: str) -> list[Route]:
    code = Code(text)
    marked = list(code.annotations())
    if not any(name in ("Controller", "RestController") for _, name, _ in marked):
        return []
    declared = next(code.find("class", ""), 0)
    prefix, found = "", []
    for i, name, inside in marked:
        kind, mapping, rest = name.partition("Mapping")
        if not mapping or rest or kind.lower() not in (*CALLS, "request"):
            continue
        route = _first_string(inside)
        if i < declared:
            prefix = route if kind == "Request" else prefix
            continue
        words = [t.text for t in inside]
        method = kind.upper() if kind != "Request" else words[words.index("RequestMethod") + 2] if "RequestMethod" in words[:-2] else "ANY"
        found.append((method, _path(prefix, route), code.tokens[i].line, "Spring"))
    return found


READERS = {**dict.fromkeys(SCRIPTS, _script), "py": _python, "java": _java}


def endpoints(path: str, text: str) -> list[tuple]:
    """Routes a file declares, each method and path once, with what the route's own lines show of authentication, body and
    validation. A route's lines end where the next begins; decorators above a route belong to it, up to the previous route."""
    read = READERS.get(path.rpartition(".")[2])
    routes = sorted(read(path, text), key=lambda r: r[2]) if read else []
    starts, lines = [r[2] for r in routes], text.split("\n")
    checked = VALIDATED.search(text[:2000]) is not None
    told: dict[tuple[str, str], tuple] = {}
    for k, (method, route, line, framework) in enumerate(routes):
        if (method, route) in told:
            continue
        top = max([line - 1 - (ABOVE if framework in DECORATED else 0), *starts[max(0, k - 1) : k], 0])
        bottom = min([len(lines), line + BELOW, *(s - 1 for s in starts if s > line)])
        own = "\n".join(lines[top : max(bottom, line)])
        shown = [pattern.search(own) is not None for pattern in (AUTH, BODY, VALIDATED)]
        told[method, route] = (path, method, route, line, framework, shown[0], shown[1], shown[2] or checked)
    return list(told.values())
