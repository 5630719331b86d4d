"""Text, path and identity functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"

# Formats of provider tokens, each replaced as a whole.
TOKEN_FORMATS = (
    r"\b[spr]k_(?:live|test)_[0-9A-Za-z]{8,}",
    r"\bgh[pousr]_[0-9A-Za-z]{20,}",
    r"\bgithub_pat_[0-9A-Za-z_]{20,}",
    r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{35}",
    r"\beyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+",
)
SECRET_NAME = r"[\w.-]*(?:password|passwd|secret|token|api[_-]?key|private[_-]?key|credential|auth)[\w-]*"
REDACTED = "<redacted>"


def redact_secrets(text: Column) -> Column:
    """Token formats, values assigned to a secret-sounding name, and quoted opaque literals of 20 characters or more that
    hold a letter and a digit."""
    for pattern in TOKEN_FORMATS:
        text = F.regexp_replace(text, pattern, REDACTED)
    text = F.regexp_replace(text, rf"(?i)({SECRET_NAME}[\"'`]?\s*(?::|=>|=)\s*)([\"'`])[^\"'`\n]+\2", rf"$1$2{REDACTED}$2")
    text = F.regexp_replace(text, rf"(?i)({SECRET_NAME}\s*=\s*)(?![\"'`<])[^\s,;]+", rf"$1{REDACTED}")
    return F.regexp_replace(text, r"([\"'`])(?=[^\"'`\s]*[0-9])(?=[^\"'`\s]*[A-Za-z])[A-Za-z0-9+/_=.-]{20,}\1", rf"$1{REDACTED}$1")


def snippet(text: Column, most: int = 160) -> Column:
    """The first line with white space collapsed, secrets redacted and cut to `most` characters."""
    line = redact_secrets(F.trim(F.regexp_replace(F.get(F.split(text, r"\r?\n"), F.lit(0)), r"\s+", " ")))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def clean_text(text: Column, most: int = 4000) -> Column:
    """Line ends to \\n, control characters gone, secrets redacted, at most `most` characters."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.substring(redact_secrets(plain), 1, most)


def sanitize_output(text: Column, most: int = 65536) -> Column:
    """Terminal escapes gone, secrets redacted, the last `most` characters from a line start on."""
    plain = redact_secrets(F.regexp_replace(F.regexp_replace(text, r"\x1B\[[0-?]*[ -/]*[@-~]", ""), r"\x1B\][^\x07]*(?:\x07|\x1B\\)", ""))
    tail = F.right(plain, F.lit(most))
    after = F.regexp_replace(tail, r"^[^\n]*\n", "")
    return F.when(F.length(plain) <= most, plain).otherwise(F.when(F.instr(tail, "\n") > 0, after).otherwise(tail))


def mask_secret(value: Column, keep: int = 4) -> Column:
    """A beginning of at most a third of the secret."""
    shown = F.least(F.lit(keep), F.floor(F.length(value) / 3).cast("int"))
    return F.concat(F.substring(value, F.lit(1), shown), F.lit("…[redacted]"))


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws(NUL, *parts), 256)


def line_count(text: Column) -> Column:
    """Lines of a text; a final line feed ends a line and begins none, an empty text has 0."""
    feeds = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(text == "", 0).otherwise(feeds + F.when(F.right(text, F.lit(1)) == "\n", 0).otherwise(1))


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.translate(head, "\n", "")) + 1


def word_count(text: Column) -> Column:
    """Words outside fenced code blocks."""
    prose = F.regexp_replace(text, r"(?s)```.*?(?:```|$)", " ")
    return F.size(F.array_remove(F.split(prose, r"\s+"), ""))


def tokens(text: Column) -> Column:
    """Lower-case words of an identifier or phrase: camelCase and acronyms are split, parts of one character dropped."""
    split = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^a-z0-9]+"), lambda x: F.length(x) >= 2)


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.size(F.filter(same, lambda x: x)) - 1


def similarity(term: Column, token: Column) -> Column:
    """3 for equal words; 2.5 if they share 5 leading characters or more that make 0.7 of the shorter; 1 if one begins the other; else 0."""
    shared, short = common_prefix(term, token), F.least(F.length(term), F.length(token))
    return (
        F.when(term == token, 3.0).when((shared >= 5) & (shared >= 0.7 * short), 2.5)
        .when(token.startswith(term) | term.startswith(token), 1.0).otherwise(0.0)
    )


# --- paths


def base_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension_of(name: Column) -> Column:
    """Lower-case extension of a file name; a leading dot begins none."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def normalized(path: Column) -> Column:
    """The path with . and .. resolved; null if it leaves the top."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    done = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(acc.isNull(), acc).when(x != "..", F.array_append(acc, x)).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)),
    )
    return F.array_join(done, "/")


def join_path(directory: Column, relative: Column) -> Column:
    return normalized(F.concat_ws("/", directory, relative))


def module_key(path: Column, depth: int | Column) -> Column:
    """The first `depth` directories of a path, '.' at the top."""
    parts = F.split(dir_of(path), "/")
    return F.when(dir_of(path) == "", ".").otherwise(F.array_join(F.slice(parts, F.lit(1), depth if isinstance(depth, Column) else F.lit(depth)), "/"))


def ancestors(path: Column) -> Column:
    """Every directory above a file, the top as '', nearest last."""
    parts = F.split(dir_of(path), "/")
    return F.when(dir_of(path) == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))


def test_stem(path: Column) -> Column:
    """What a test file is named after."""
    name = F.regexp_replace(base_of(path), r"\.[^.]+$", "")
    name = F.regexp_replace(name, r"(?i)\.(?:test|spec|e2e|cy)$", "")
    name = F.regexp_replace(name, r"(?i)^test_|_test$", "")
    return F.lower(F.regexp_replace(name, r"(?<=\w)Tests?$", ""))


def source_stem(path: Column) -> Column:
    """A file's own name, or its directory's for index files."""
    stem = F.lower(F.regexp_replace(base_of(path), r"\.[^.]+$", ""))
    return F.when(stem.isin("index", "__init__", "mod", "main"), F.lower(base_of(dir_of(path)))).otherwise(stem)


def specifier_stem(spec: Column) -> Column:
    """The module that an import names."""
    slashed = F.regexp_replace(F.substring_index(F.translate(spec, "\\", "/"), "/", -1), r"\.[cm]?[jt]sx?$|\.py$", "")
    dotted = F.element_at(F.filter(F.split(spec, r"\."), lambda x: x != ""), -1)
    return F.lower(F.when(spec.rlike(r"[/\\]"), slashed).otherwise(F.coalesce(dotted, spec)))


# The layers, highest first, their directories and file-name suffixes.
LAYERS = (
    ("interface", "components pages views screens ui layouts widgets routes router routers controllers controller handlers api endpoints resolvers cli", "controller route routes handler resolver page component view"),
    ("service", "services service usecases use-cases use_cases application domain business", "service usecase"),
    ("data", "models model entities entity repositories repository repos dao daos db database persistence migrations", "repository repo model entity dao schema"),
    ("shared", "utils util helpers helper common shared constants", "util utils helper helpers constants"),
)
LAYER_ORDER = tuple(x[0] for x in LAYERS)


def _lookup(column: int) -> Column:
    return F.create_map(*[F.lit(x) for layer in LAYERS for word in layer[column].split() for x in (word, layer[0])])


def infer_layer(path: Column) -> Column:
    """The layer that the file name's suffix names, else that of the nearest directory that names one, else null."""
    stem = F.regexp_replace(base_of(path), r"\.[^.]+$", "")
    marked, humped = F.regexp_extract(stem, r"[._-]([A-Za-z]+)$", 1), F.regexp_extract(stem, r"[a-z]([A-Z][a-z]+)$", 1)
    suffix = F.lower(F.when(marked != "", marked).otherwise(humped))
    above = F.transform(F.reverse(F.split(F.lower(dir_of(path)), "/")), lambda d: F.try_element_at(_lookup(1), d))
    return F.coalesce(F.try_element_at(_lookup(2), suffix), F.get(F.filter(above, lambda x: x.isNotNull()), F.lit(0)))


# --- versions, names and addresses of packages


def exact_version(spec: Column, ecosystem: str) -> Column:
    """The version that a requirement pins exactly, null for ranges."""
    pattern = {
        "npm": r"^\s*(?:=|v)?(\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?)\s*$",
        "PyPI": r"^\s*={2,3}\s*([0-9][0-9A-Za-z.+!-]*)\s*$",
        "Maven": r"^\[?([0-9][0-9A-Za-z.+_-]*)\]?$",
        "crates.io": r"^\s*=\s*([0-9]+\.[0-9]+\.[0-9]+[0-9A-Za-z.+-]*)\s*$",
    }[ecosystem]
    found = F.regexp_extract(spec, pattern, 1)
    return F.when((found != "") & ~found.contains("*"), found)


def npm_source(spec: Column) -> Column:
    s = F.trim(spec)
    return (
        F.when(s.rlike(r"^workspace:"), "workspace").when(s.rlike(r"^(file|link|portal):"), "path")
        .when(s.rlike(r"^(git\+|git:|github:|gitlab:|bitbucket:|gist:)|^[\w.-]+/[\w.-]+(#.*)?$"), "git").when(s.rlike(r"^https?://"), "url").otherwise("registry")
    )


def python_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[-_.]+", "-")


def npm_package_of(specifier: Column) -> Column:
    """The package that an import specifier belongs to; null for paths, addresses and scopes alone."""
    found = F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1)
    return F.when((found != "") & ~specifier.rlike(r"^[./]|^[A-Za-z][A-Za-z0-9+.-]*:"), found)


def redact_spec(spec: Column) -> Column:
    """A version spec without credentials of its address."""
    return F.regexp_replace(spec, r"://[^/@\s]+@", "://<redacted>@")


def is_unpinned(spec: Column, ecosystem: Column) -> Column:
    """Whether any version will do, by the ecosystem's own words for it."""
    s = F.trim(F.coalesce(spec, F.lit("")))
    return (
        F.when(ecosystem == "npm", s.isin("", "*", "latest", "x")).when(ecosystem == "PyPI", s.isin("", "*"))
        .when(ecosystem == "Maven", (s == "") | s.rlike(r"(?i)^(?:LATEST|RELEASE|latest\.\w+)$") | s.endswith("+")).when(ecosystem == "crates.io", s == "*").otherwise(False)
    )


def repository_url(url: Column) -> Column:
    """struct(host, owner, name) of an https address of a repository on GitHub or GitLab, else null."""
    pattern = r"^https://(?:www\.)?(github\.com|gitlab\.com)/([\w.-]+(?:/[\w.-]+)*?)/([\w.-]+?)(?:\.git)?/?$"
    host, owner, name = (F.regexp_extract(url, pattern, k) for k in (1, 2, 3))
    bad = owner.rlike(r"(^|/)\.\.?(/|$)") | name.isin(".", "..") | ((host == "github.com") & owner.contains("/"))
    return F.when((host != "") & ~bad, F.struct(host.alias("host"), owner.alias("owner"), name.alias("name")))


def strip_jsonc(text: Column) -> Column:
    """JSON with comments and trailing commas to JSON; strings are kept as they are."""
    plain = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")
    return F.regexp_replace(plain, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")
