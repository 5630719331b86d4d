"""Dependency manifests and lock files of npm, Python, the JVM, Go and Rust."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET

DEPENDENCIES = "path string, ecosystem string, name string, spec string, resolved string, dev boolean, source string, line int"
LOCKED = "path string, ecosystem string, name string, version string, dev boolean, public_registry boolean"

# Sections of package.json and whether they are for development; groups of Python extras that are.
NPM_SECTIONS = (("dependencies", False), ("optionalDependencies", False), ("peerDependencies", False), ("devDependencies", True))
DEV_GROUPS = "dev develop development test tests testing lint linting docs doc typing types mypy ci bench benchmark".split()
PUBLIC_NPM = ("https://registry.npmjs.org/", "https://registry.yarnpkg.com/", "https://registry.npmmirror.com/")


def _line(text: str, pattern: str, start: int = 0) -> int | None:
    m = re.compile(pattern, re.M).search(text, start)
    return text.count("\n", 0, m.start()) + 1 + m.group().count("\n", 0, len(m.group()) - len(m.group().lstrip())) if m else None


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings are kept."""
    keep = lambda m: m.group(1) or ""
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', keep, text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', keep, plain)


def _json(text: str) -> dict:
    try:
        value = json.loads(text)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def npm_source(spec: str) -> str:
    s = spec.strip()
    for source, pattern in (("workspace", r"workspace:"), ("path", r"(?:file|link|portal):"), ("git", r"git\+|git:|github:|gitlab:|bitbucket:|gist:|[\w.-]+/[\w.-]+(?:#.*)?$"), ("url", r"https?://")):
        if re.match(pattern, s):
            return source
    return "registry"


def exact_npm(spec: str) -> str | None:
    m = re.fullmatch(r"\s*[=v]?(\d+\.\d+\.\d+(?:-[\w.-]+)?(?:\+[\w.-]+)?)\s*", spec)
    return m and m.group(1)


def exact_python(spec: str) -> str | None:
    m = re.fullmatch(r"\s*={2,3}\s*([0-9][\w.+!-]*)\s*", spec)
    return m and m.group(1)


def python_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name.lower())


def package_json(path: str, text: str) -> list[tuple]:
    """Direct dependencies; a name in several sections counts in the first."""
    package, out, seen = _json(text), [], set()
    for section, dev in NPM_SECTIONS:
        table = package.get(section)
        begin = re.search(rf'"{section}"\s*:', text)
        for name, spec in table.items() if isinstance(table, dict) else ():
            if isinstance(spec, str) and name not in seen:
                seen.add(name)
                source = npm_source(spec)
                out.append((path, "npm", name, spec, exact_npm(spec) if source == "registry" else None, dev, source, _line(text, rf'^[ \t{{]*"{re.escape(name)}"\s*:', begin.end() if begin else 0)))
    return out


def package_lock(path: str, text: str) -> list[tuple]:
    """package-lock.json and npm-shrinkwrap.json of any version; links, git and file packages left out."""
    lock, out = _json(text), []
    foreign = lambda v: re.match(r"git\+|git:|file:|https?:", v)
    public = lambda e: not str(e.get("resolved") or "").startswith("http") or str(e["resolved"]).startswith(PUBLIC_NPM)
    if isinstance(lock.get("packages"), dict):
        for at, e in lock["packages"].items():
            if "node_modules/" in at and isinstance(e, dict) and not e.get("link") and isinstance(e.get("version"), str) and not re.match(r"git|file:", str(e.get("resolved") or "")):
                out.append((path, "npm", e.get("name") or at.rsplit("node_modules/", 1)[1], e["version"], bool(e.get("dev") or e.get("devOptional")), public(e)))
        return out
    todo = [lock.get("dependencies")]
    while todo:
        for name, e in (todo.pop() or {}).items():
            if isinstance(e, dict) and isinstance(e.get("version"), str):
                if not foreign(e["version"]):
                    out.append((path, "npm", name, e["version"], bool(e.get("dev")), public(e)))
                todo.append(e.get("dependencies"))
    return out


def yarn_lock(path: str, text: str) -> list[tuple]:
    """Both formats: an unindented header of specs, then its version and perhaps its address."""
    out = []
    for block in re.split(r"\n(?=\S)", text):
        head, _, body = block.partition("\n")
        if head.startswith("#") or not head.rstrip().endswith(":") or head.startswith("__metadata"):
            continue
        specs = [s.strip().strip('"') for s in head.rstrip()[:-1].split(",")]
        name, _, span = specs[0].rpartition("@") if specs[0].count("@") > specs[0].startswith("@") else (specs[0], "", "")
        version = re.search(r'^\s+version:?\s+"?([^"\s]+)', body, re.M)
        address = re.search(r'^\s+resolved\s+"?([^"\s]+)', body, re.M)
        name = re.match(r"(@?[^@]+)@", specs[0])
        if name and version and not re.match(r"(?:git|github|file|link|portal|patch|workspace|exec)[:+]|https?:", specs[0][name.end() :]):
            out.append((path, "npm", name.group(1), version.group(1), False, address is None or address.group(1).startswith(PUBLIC_NPM)))
    return out


def pnpm_lock(path: str, text: str) -> list[tuple]:
    """The keys of `packages:` in every format: name@version, /name@version and /name/version."""
    part = re.search(r"(?ms)^packages:\s*\n(.*?)(?=^\S|\Z)", text)
    out, seen = [], set()
    for m in re.finditer(r"(?m)^  ['\"]?/?((?:@[^/'\"\s]+/)?[^/@'\"\s]+)[@/](\d[^:('\"_]*)[^:\n]*:(.*(?:\n    .*)*)", part.group(1) if part else ""):
        if (m.group(1), m.group(2)) not in seen:
            seen.add((m.group(1), m.group(2)))
            tarball = re.search(r"tarball:\s*([^,}\s]+)", m.group(3))
            out.append((path, "npm", m.group(1), m.group(2), bool(re.search(r"^\s+dev:\s*true\s*$", m.group(3), re.M)), tarball is None or tarball.group(1).startswith(PUBLIC_NPM)))
    return out


def bun_lock(path: str, text: str) -> list[tuple]:
    packages, out = _json(strip_jsonc(text)).get("packages"), []
    for e in packages.values() if isinstance(packages, dict) else ():
        m = re.fullmatch(r"(@?[^@]+)@(\d.*)", e[0]) if isinstance(e, list) and e and isinstance(e[0], str) else None
        if m:
            registry = e[1] if len(e) > 1 and isinstance(e[1], str) else ""
            out.append((path, "npm", m.group(1), m.group(2), False, not registry or registry.startswith(PUBLIC_NPM)))
    return out


def npm_registries(path: str, text: str) -> list[tuple]:
    """(path, scope or null, address) of .npmrc and .yarnrc.yml; tokens are never read."""
    if path.endswith(".npmrc"):
        return [(path, m.group(1), m.group(2).strip().strip("\"'")) for m in re.finditer(r"(?m)^\s*(?:(@[^:\s=]+):)?registry\s*=\s*(.+)$", text)]
    out = [(path, None, m.group(1).strip().strip("\"'")) for m in re.finditer(r"(?m)^npmRegistryServer\s*:\s*(.+)$", text)]
    scopes = re.search(r"(?ms)^npmScopes\s*:\s*\n(.*?)(?=^\S|\Z)", text)
    out += [(path, "@" + m.group(1), m.group(2).strip().strip("\"'")) for m in re.finditer(r"(?m)^\s+['\"]?@?([\w.-]+)['\"]?\s*:\s*\n(?:\s+(?!npmRegistryServer).*\n)*?\s+npmRegistryServer\s*:\s*(.+)$", scopes.group(1) if scopes else "")]
    return out


def _requirement(text: str) -> tuple[str, str, str] | None:
    """(name, spec, source) of one requirement."""
    req = re.sub(r";.*$", "", text).strip()
    direct = re.match(r"([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*@\s*(\S+)", req)
    if direct:
        url = direct.group(2)
        return python_name(direct.group(1)), url, "git" if url.startswith("git+") else "path" if url.startswith("file:") else "url"
    m = re.match(r"([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*(.*)$", req)
    return (python_name(m.group(1)), re.sub(r"\s+", "", m.group(2).strip("()")), "registry") if m else None


def requirements(path: str, text: str) -> list[tuple]:
    """requirements*.txt: continued lines belong to their first, options are left out, editable and address lines need an egg."""
    base = path.rsplit("/", 1)[-1].removesuffix(".txt")
    dev = re.search(r"(?:^|[-_.])(?:dev|test|tests|testing|lint|docs|ci)(?:[-_.]|$)", base, re.I) is not None
    out, line = [], 0
    for whole in re.split(r"(?<!\\)\n", text):
        begin, line = line + 1, line + 1 + whole.count("\n")
        req = re.sub(r"\s--hash=\S+", "", re.sub(r"(?:^|\s)#.*", "", whole).replace("\\\n", " ")).strip()
        if re.match(r"-e\s|--editable\s|git\+|https?://", req):
            url = re.sub(r"^(?:-e|--editable)\s+", "", req)
            egg = re.search(r"[#&]egg=([\w.-]+)", url)
            if egg:
                out.append((path, "PyPI", python_name(egg.group(1)), url, None, dev, "git" if url.startswith("git+") else "path" if url[0] in "./" else "url", begin))
        elif req and not req.startswith("-") and (r := _requirement(req)):
            out.append((path, "PyPI", r[0], r[1] or None, exact_python(r[1]) if r[2] == "registry" else None, dev, r[2], begin))
    return out


def pyproject(path: str, text: str) -> list[tuple]:
    """pyproject.toml (project, dependency groups, uv, Poetry) and Pipfile."""
    data, out = _toml(text), []

    def add(name: str, spec: str, resolved: str | None, dev: bool, source: str) -> None:
        out.append((path, "PyPI", name, spec or None, resolved, dev, source, _line(text, rf"^[ \t]*[\"']?{re.escape(name).replace('-', '[-_.]')}\b(?i:)") or _line(text, re.escape(name).replace("\\-", "[-_.]"))))

    def listed(items, dev: bool) -> None:
        for item in items if isinstance(items, list) else ():
            if isinstance(item, str) and (r := _requirement(item)):
                add(r[0], r[1], exact_python(r[1]) if r[2] == "registry" else None, dev, r[2])

    def tabled(table, dev: bool, pip: bool) -> None:
        for key, value in table.items() if isinstance(table, dict) else ():
            if key.lower() == "python":
                continue
            spec = value if isinstance(value, str) else value.get("version", "") if isinstance(value, dict) else ""
            kind = value if isinstance(value, dict) else {}
            source = "git" if "git" in kind else "path" if "path" in kind or "file" in kind else "url" if "url" in kind else "registry"
            bare = not pip and re.fullmatch(r"\d[\w.+!-]*", spec or "*")
            spec = f"=={spec}" if bare else spec or "*"
            add(python_name(key), spec, exact_python(spec) if source == "registry" else None, dev, source)

    project, tool = data.get("project", {}), data.get("tool", {})
    listed(project.get("dependencies"), False)
    for group, items in project.get("optional-dependencies", {}).items():
        listed(items, group.lower() in DEV_GROUPS)
    for items in data.get("dependency-groups", {}).values():
        listed(items, True)
    listed(tool.get("uv", {}).get("dev-dependencies"), True)
    poetry = tool.get("poetry", {})
    tabled(poetry.get("dependencies"), False, False)
    tabled(poetry.get("dev-dependencies"), True, False)
    for group, table in poetry.get("group", {}).items():
        tabled(table.get("dependencies"), group.lower() in DEV_GROUPS, False)
    if path.endswith("Pipfile"):
        tabled(data.get("packages"), False, True)
        tabled(data.get("dev-packages"), True, True)
    return out


def python_lock(path: str, text: str) -> list[tuple]:
    """poetry.lock, uv.lock, pdm.lock and Pipfile.lock; packages from elsewhere than a registry are left out."""
    if path.endswith("Pipfile.lock"):
        lock = _json(text)
        return [(path, "PyPI", python_name(n), v, dev, True) for part, dev in (("default", False), ("develop", True)) for n, e in (lock.get(part) or {}).items() if isinstance(e, dict) and (v := exact_python(str(e.get("version", ""))))]
    out = []
    for p in _toml(text).get("package", []):
        source = p.get("source", {}) if isinstance(p.get("source"), dict) else {}
        foreign = any(k in source for k in ("git", "editable", "virtual", "path", "directory")) or source.get("type") in ("git", "directory", "file", "url") or ("url" in source and "type" not in source and "registry" not in source)
        if isinstance(p.get("name"), str) and isinstance(p.get("version"), str) and not foreign:
            out.append((path, "PyPI", python_name(p["name"]), p["version"], p.get("category") == "dev", True))
    return out


def pom(path: str, text: str) -> list[tuple]:
    """pom.xml: dependencies with properties put in; test scope is for development."""
    try:
        root = ET.fromstring(re.sub(r"\sxmlns(?::\w+)?=\"[^\"]*\"|\s\w+:\w+=\"[^\"]*\"", "", text))
    except ET.ParseError:
        return []
    names = {p.tag: (p.text or "").strip() for t in root.findall("properties") for p in t}
    fill = lambda s: re.sub(r"\$\{([^}]+)\}", lambda m: names.get(m.group(1), m.group()), s)
    managed = {(d.findtext("groupId"), d.findtext("artifactId")): d.findtext("version") for d in root.findall("dependencyManagement/dependencies/dependency")}
    out = []
    for d in root.findall("dependencies/dependency"):
        group, artifact = d.findtext("groupId", ""), d.findtext("artifactId", "")
        spec = fill(d.findtext("version") or managed.get((group, artifact)) or "")
        resolved = re.fullmatch(r"\[?([0-9][\w.+-]*)\]?", spec)
        out.append((path, "Maven", f"{fill(group)}:{artifact}", spec or None, resolved and resolved.group(1), d.findtext("scope") == "test", "registry", _line(text, rf"<artifactId>\s*{re.escape(artifact)}\s*<")))
    return out


def gradle(path: str, text: str) -> list[tuple]:
    """build.gradle and build.gradle.kts: string notation of known configurations."""
    out = []
    plain = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m.group()) if not text[: m.start()].endswith(":") else m.group(), text, flags=re.S)
    for m in re.finditer(r"(?m)^\s*(\w*(?:[iI]mplementation|[aA]pi|[cC]ompileOnly|[rR]untimeOnly|compile|kapt|annotationProcessor))\s*\(?\s*(?:platform\()?['\"]([\w.-]+):([\w.-]+)(?::([^'\"@:]+))?", plain):
        resolved = m.group(4) if m.group(4) and re.fullmatch(r"[0-9][\w.+-]*", m.group(4)) and not m.group(4).endswith("+") else None
        out.append((path, "Maven", f"{m.group(2)}:{m.group(3)}", m.group(4), resolved, m.group(1).lower().startswith(("test", "androidtest")), "registry", plain.count("\n", 0, m.start(1)) + 1))
    return out


def go_mod(path: str, text: str) -> list[tuple]:
    """Requirements, single or in blocks; indirect ones are left out."""
    out = []
    for m in re.finditer(r"(?m)^(?:require\s+|\t|\s{2,})([\w.-]+\.[\w./~-]+)\s+(v[^\s]+)(.*)$", text):
        if "// indirect" not in m.group(3) and "=>" not in m.group(3):
            out.append((path, "Go", m.group(1), m.group(2), m.group(2).removeprefix("v").split("+")[0], False, "registry", text.count("\n", 0, m.start(1)) + 1))
    return out


def cargo_toml(path: str, text: str) -> list[tuple]:
    data, out = _toml(text), []
    parts = [(data, ""), *((t, "") for t in (data.get("target") or {}).values() if isinstance(t, dict))]
    for table, _ in parts:
        for section, dev in (("dependencies", False), ("build-dependencies", True), ("dev-dependencies", True)):
            for name, value in (table.get(section) or {}).items():
                kind = value if isinstance(value, dict) else {"version": value}
                spec = kind.get("version")
                source = "git" if "git" in kind else "path" if "path" in kind else "workspace" if kind.get("workspace") else "registry"
                exact = re.fullmatch(r"\s*=\s*(\d+\.\d+\.\d+[\w.+-]*)\s*", spec or "")
                out.append((path, "crates.io", kind.get("package", name), spec, exact and exact.group(1), dev, source, _line(text, rf"^\s*{re.escape(name)}\s*=")))
    return out


def cargo_lock(path: str, text: str) -> list[tuple]:
    return [(path, "crates.io", p["name"], p["version"], False, "crates.io" in p["source"]) for p in _toml(text).get("package", []) if isinstance(p.get("source"), str) and not p["source"].startswith("git+")]


READERS = (
    (r"(?:^|/)package\.json$", package_json), (r"(?:^|/)requirements[^/]*\.txt$", requirements), (r"(?:^|/)(?:pyproject\.toml|Pipfile)$", pyproject), (r"(?:^|/)pom\.xml$", pom),
    (r"(?:^|/)build\.gradle(?:\.kts)?$", gradle), (r"(?:^|/)go\.mod$", go_mod), (r"(?:^|/)Cargo\.toml$", cargo_toml),
)
LOCK_READERS = (
    (r"(?:^|/)(?:package-lock|npm-shrinkwrap)\.json$", package_lock), (r"(?:^|/)yarn\.lock$", yarn_lock), (r"(?:^|/)pnpm-lock\.yaml$", pnpm_lock), (r"(?:^|/)bun\.lock$", bun_lock),
    (r"(?:^|/)(?:poetry\.lock|uv\.lock|pdm\.lock|Pipfile\.lock)$", python_lock), (r"(?:^|/)Cargo\.lock$", cargo_lock),
)


def _by_name(readers, path: str, text: str) -> list[tuple]:
    return next((read(path, text) for pattern, read in readers if re.search(pattern, path)), [])


def dependencies(path: str, text: str) -> list[tuple]:
    """Direct dependencies of whichever manifest this is."""
    return _by_name(READERS, path, text)


def locked(path: str, text: str) -> list[tuple]:
    return _by_name(LOCK_READERS, path, text)
