"""File trees: reading, inventory, language, kind, role and skip rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_of, extension_of, line_count

# Directories that are never read.
IGNORED = "node_modules .git dist build out coverage .next .nuxt .svelte-kit .turbo .cache .parcel-cache venv .venv env __pycache__ .pytest_cache .mypy_cache .tox target .gradle .idea .vscode bower_components vendor __MACOSX Pods .terraform".split()

# Languages by file name and by extension.
LANGUAGE_NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "CMakeLists.txt": "cmake", "Jenkinsfile": "groovy"}
LANGUAGE_EXTENSIONS = {
    "javascript": "js mjs cjs jsx", "typescript": "ts mts cts tsx", "python": "py pyw", "java": "java", "c": "c h", "cpp": "cc cpp cxx c++ hh hpp hxx ipp",
    "go": "go", "rust": "rs", "ruby": "rb", "php": "php", "csharp": "cs", "kotlin": "kt kts", "swift": "swift", "scala": "scala", "dart": "dart", "lua": "lua", "r": "r", "objective-c": "m",
    "shell": "sh bash zsh", "powershell": "ps1", "vue": "vue", "svelte": "svelte", "html": "html htm", "css": "css", "scss": "scss sass", "less": "less", "sql": "sql", "prisma": "prisma", "graphql": "graphql gql",
    "protobuf": "proto", "markdown": "md mdx", "restructuredtext": "rst", "json": "json jsonc", "yaml": "yml yaml", "toml": "toml", "xml": "xml", "ini": "ini", "gradle": "gradle",
}
PROGRAMMING = "javascript typescript python java c cpp go rust ruby php csharp kotlin swift scala dart lua r objective-c shell powershell vue svelte".split()
BINARY_EXTENSIONS = "png jpg jpeg gif bmp ico webp avif tiff psd mp3 mp4 wav ogg webm mov avi flac zip gz tgz bz2 xz 7z rar jar war ear exe dll so dylib o a lib obj class pyc pyo wasm node pdf doc docx xls xlsx ppt pptx ttf otf woff woff2 eot db sqlite sqlite3 bin dat pkl h5 onnx pt".split()

# Path patterns of each kind.
TEST_PATHS = r"(?i:(?:^|/)(?:__tests__|__mocks__|tests?|spec|specs|e2e|cypress|playwright)/)|(?:^|/)src/test/|(?i:\.(?:test|spec|e2e|cy)\.[cm]?[jt]sx?$)|(?:^|/)test_[^/]+\.py$|_test\.(?:py|go|c|cc|cpp)$|(?:^|/)[^/]+Tests?\.java$|(?:^|/)conftest\.py$"
GENERATED = r"(?i:\.min\.(?:js|css)$|\.map$|\.d\.ts$|\.generated\.[a-z]+$|(?:^|/)generated/)|(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Pipfile\.lock|composer\.lock|Cargo\.lock|gradle\.lockfile)$|\.(?:pb|pb2)\.(?:go|py)$|_pb2(?:_grpc)?\.py$|(?:^|/)migrations/\d+[^/]*\.(?:py|sql)$"
DOC_NAMES = r"(?i)^(?:readme|changelog|changes|contributing|code_of_conduct|security|authors|license|licence|copying|notice)(?:\.[a-z]+)?$"
CONFIG_NAMES = "package.json tsconfig.json jsconfig.json requirements.txt pyproject.toml setup.py setup.cfg Pipfile pom.xml build.gradle build.gradle.kts settings.gradle settings.gradle.kts CMakeLists.txt Makefile Dockerfile docker-compose.yml docker-compose.yaml compose.yml compose.yaml Jenkinsfile .gitlab-ci.yml azure-pipelines.yml vercel.json netlify.toml Procfile tox.ini pytest.ini babel.config.js vite.config.ts vite.config.js next.config.js next.config.mjs next.config.ts webpack.config.js jest.config.js jest.config.ts vitest.config.ts vitest.config.js tailwind.config.js tailwind.config.ts postcss.config.js postcss.config.mjs eslint.config.js eslint.config.mjs prettier.config.js nodemon.json".split()
CONFIG_EXTENSIONS = "json jsonc yml yaml toml ini cfg conf xml properties env gradle".split()

# Names and paths of each role.
SECRET_FILES = r"(?i)^(?:\.env(?:\.(?!example$|sample$|template$|dist$|defaults$)[\w.-]+)?|\.npmrc|\.pypirc|\.netrc|id_(?:rsa|dsa|ecdsa|ed25519)|[\w.-]+\.(?:pem|key|p12|pfx|jks|keystore))$"
LOCKFILES = r"^(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?|poetry\.lock|uv\.lock|pdm\.lock|Pipfile\.lock|Cargo\.lock|go\.sum|composer\.lock|Gemfile\.lock|gradle\.lockfile)$"
MANIFESTS = r"^(?:package\.json|requirements[^/]*\.txt|pyproject\.toml|Pipfile|setup\.py|setup\.cfg|pom\.xml|build\.gradle(?:\.kts)?|settings\.gradle(?:\.kts)?|go\.mod|Cargo\.toml|composer\.json|Gemfile|[\w.-]+\.csproj|deno\.jsonc?)$"
INFRASTRUCTURE_NAMES = r"(?i)^(?:Dockerfile(?:\..+)?|[\w.-]+\.dockerfile|\.dockerignore|(?:docker-)?compose(?:\.[\w-]+)?\.ya?ml|Procfile|vercel\.json|netlify\.toml|fly\.toml|render\.yaml|app\.yaml|serverless\.ya?ml|Jenkinsfile|\.gitlab-ci\.yml|azure-pipelines\.yml|\.travis\.yml|bitbucket-pipelines\.yml|skaffold\.yaml|Chart\.yaml|nginx\.conf)$"
INFRASTRUCTURE_PATHS = r"(?i)(?:^|/)(?:\.github/workflows|\.circleci|k8s|kubernetes|helm|charts|terraform|infra|deploy|deployment|ansible)/|\.(?:tf|tfvars|hcl)$"

MOST_FILES, OVERSIZED = 50_000, 1_000_000


def _listed(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path below the root, size) of all files; ignored directories and links are not entered. Hidden files count, which
    Spark's own readers leave out."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, todo, out = fs.makeQualified(top).toUri().getPath().rstrip("/") + "/", [top], []
    while todo:
        for status in fs.listStatus(todo.pop()):
            name, path = status.getPath().getName(), status.getPath().toUri().getPath()
            if status.isSymlink() or (status.isDirectory() and name in IGNORED):
                continue
            if status.isDirectory():
                todo.append(status.getPath())
            else:
                out.append((path.removeprefix(base), status.getLen()))
    return sorted(out)


def read_tree(spark: SparkSession, root: str, most: int = MOST_FILES) -> tuple[DataFrame, bool]:
    """(path, size, content) of the files below a root, ignored directories and root .gitignore rules left out, in path order;
    and whether there were more than `most`.

    Names are listed on the driver, at most `most` of them go on; contents are read by the executors. `root` is a path or
    uri that pyarrow opens.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    found = _listed(spark, root)
    if any(path == ".gitignore" for path, _ in found):
        with store.open_input_file(f"{base}/.gitignore") as f:
            rules = gitignore_patterns(f.read().decode("utf-8", "replace"))
        hidden = lambda path: [negated for pattern, negated in rules if re.search(pattern, path)][-1:] == [False]
        found = [x for x in found if not hidden(x[0])]

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{path}") as f:
                    yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "content": [f.read()]}, schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())]))

    names = spark.createDataFrame(found[:most], "path string, size long").repartitionByRange(max(1, len(found[:most]) // 500), "path")
    return names.mapInArrow(read, "path string, size long, content binary"), len(found) > most


def gitignore_patterns(text: str) -> list[tuple[str, bool]]:
    """Regular expressions on paths for the rules of a .gitignore, and whether each is a negation."""
    out = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        negated, rule = rule.startswith("!"), rule.lstrip("!")
        rooted, rule = "/" in rule.rstrip("/"), rule.strip("/")
        body = re.escape(rule).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out.append((f"{'^' if rooted else '(?:^|/)'}{body}(?:/|$)", negated))
    return out


def is_binary(content: Column) -> Column:
    """A NUL byte in the first 8 KiB."""
    return F.contains(F.substring(content, 1, 8192), F.lit(bytearray(1)))


def language_of(path: Column) -> Column:
    name = base_of(path)
    by_name = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    by_extension = F.create_map(*[F.lit(x) for lang, es in LANGUAGE_EXTENSIONS.items() for e in es.split() for x in (e, lang)])
    return F.coalesce(F.try_element_at(by_name, name), F.when(name.startswith("Dockerfile"), "dockerfile"), F.try_element_at(by_extension, extension_of(name)))


def kind_of(path: Column, language: Column, binary: Column) -> Column:
    name, ext = base_of(path), extension_of(base_of(path))
    docs = name.rlike(DOC_NAMES) | ext.isin("md", "mdx", "rst", "adoc") | ((ext == "txt") & path.rlike(r"(?i)(?:^|/)docs?/"))
    config = name.isin(*CONFIG_NAMES) | name.startswith(".") | name.startswith("Dockerfile") | ext.isin(*CONFIG_EXTENSIONS) | path.rlike(r"(?:^|/)\.github/")
    return (
        F.when(binary | ext.isin(*BINARY_EXTENSIONS), "BINARY").when(path.rlike(GENERATED), "GENERATED")
        .when(F.coalesce(language.isin(*PROGRAMMING), F.lit(False)), F.when(path.rlike(TEST_PATHS), "TEST").otherwise("SOURCE"))
        .when(docs, "DOCUMENTATION").when(config, "CONFIG").otherwise("OTHER")
    )


def role_of(path: Column, kind: Column) -> Column:
    name = base_of(path)
    return (
        F.when(name.rlike(SECRET_FILES), "secret").when(kind == "BINARY", "binary").when(name.rlike(LOCKFILES), "lockfile").when(kind == "GENERATED", "generated")
        .when(name.rlike(MANIFESTS), "manifest").when(kind == "SOURCE", "source").when(kind == "TEST", "test")
        .when(name.rlike(INFRASTRUCTURE_NAMES) | path.rlike(INFRASTRUCTURE_PATHS), "infrastructure")
        .when(kind == "DOCUMENTATION", "documentation").when(kind == "CONFIG", "config").otherwise("other")
    )


def inventory(tree: DataFrame) -> DataFrame:
    """A row per file: language, kind, role, lines, whether it is oversized, content hash and text (null for binary files)."""
    binary = is_binary(F.col("content"))
    d = tree.withColumn("language", language_of(F.col("path"))).withColumn("kind", kind_of(F.col("path"), F.col("language"), binary)).withColumn("role", role_of(F.col("path"), F.col("kind")))
    text = F.when((F.col("kind") != "BINARY") & (F.col("size") <= OVERSIZED), F.make_valid_utf8(F.col("content").cast("string")))
    d = d.withColumn("content_hash", F.sha2("content", 256)).withColumn("oversized", F.col("size") > OVERSIZED).withColumn("text", text)
    return d.withColumn("lines", line_count(F.col("text"))).drop("content")


def skipped(text: Column) -> Column:
    """Why a text is not analysed: minified by its mean or longest line; null if it is."""
    longest = F.array_max(F.transform(F.split(text, "\n"), lambda x: F.length(x)))
    return F.when((F.try_divide(F.length(text), line_count(text)) > 300) | (longest > 5000), "minified")


def verified(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state) of files whose content hash differs from what was expected, or that are missing or new."""
    d = expected.select("path", F.col("content_hash").alias("want")).join(actual.select("path", F.col("content_hash").alias("have")), "path", "full_outer")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "changed")
    return d.select("path", state.alias("state")).where("state is not null")


def orphans(files: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Files that nothing refers to."""
    return files.join(references.select(key).distinct(), key, "left_anti")
