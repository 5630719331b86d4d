"""Secret scans: candidate spans by pattern, false positives removed by a random forest.

Candidates are long mixed runs, values assigned to a telling name, credentials in connection strings and private keys.
The forest looks at a candidate's length, its character classes and transitions, how much of it dictionary words and
letter runs cover, the path of its text and the words around it. It is trained from labelled findings: those given, or
else ones generated from publicly documented forms of credentials and of the things they are mistaken for. The
dictionary is the vocabulary of Python's own documentation and, where `dictionary` is used, the frequent words of the
texts that are scanned.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LEAST_RUN, LEAST_VALUE, AROUND = 20, 8, 80
RUN = re.compile(r"[A-Za-z0-9_+/=\-]{20,}")
ASSIGNED = re.compile(r"[=:]\s{0,8}[\"'`]?(?=[^\s\"'`,;<>|]{8})")
VALUE = re.compile(r"[^\s\"'`,;<>|]+")
NAME = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)[a-z0-9_\-]{0,24}[\"'`]?\s{0,8}$", re.I)
LOGIN = re.compile(r"://[^\s:/@]++:([^\s:/@]{4,}+)@")
PEM_EDGE = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
LEAST_PEM = 16
MARK = "<secret>"

# Words that speak for a secret, for a digest or an identifier, and for a placeholder.
SECRET_WORDS = "token secret password passwd pwd key apikey api_key access_key credential credentials auth bearer private".split()
DIGEST_WORDS = "sha sha1 sha256 sha512 md5 commit digest checksum integrity hash uuid guid id isbn etag revision version order serial phone".split()
PLACEHOLDER_WORDS = "example changeme change_me placeholder your yours dummy sample fake test xxxx none null todo insert here redacted".split()
TEST_PATHS, NOISY_SUFFIXES = ("test", "spec", "fixture", "example", "sample", "mock", "docs"), (".lock", ".min.js", ".svg", ".map", ".sum", ".md")


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: str
    inner: tuple["Candidate", ...] = ()  # assigned values that begin inside


def _assigned(text: str) -> Iterator[Candidate]:
    """Values after each sign that a telling name stands before, one inside another included; a value runs to its end."""
    end = 0
    for m in ASSIGNED.finditer(text):
        if NAME.search(text[max(0, m.start() - 64) : m.start()]):
            if m.end() >= end:  # else it lies in the last value and ends with it
                end = VALUE.match(text, m.end()).end()
            yield Candidate(m.end(), end, "assigned")


def _keys(text: str) -> Iterator[Candidate]:
    """Private keys, from a begin line to the end line that follows it, whatever stands between."""
    begun = None
    for m in PEM_EDGE.finditer(text):
        if m.group(1) == "BEGIN":
            begun = m
        elif begun:
            if m.start() - begun.end() >= LEAST_PEM:
                yield Candidate(begun.start(), m.end(), "private-key")
            begun = None


def candidates(text: str) -> list[Candidate]:
    """Spans worth a look, in order and without overlaps: spans that overlap are one, of the earliest's, then longest's kind."""
    found = []
    if "=" in text or ":" in text:
        found += _assigned(text)
        if "://" in text:
            found += [Candidate(m.start(1), m.end(1), "login") for m in LOGIN.finditer(text)]
    if "-----BEGIN" in text:
        found += _keys(text)
    at = 0
    for word in text.split():
        if len(word) >= LEAST_RUN and not word.isalpha():
            at = text.index(word, at)
            for m in RUN.finditer(word):
                run = m.group()
                if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
                    found.append(Candidate(at + m.start(), at + m.end(), "run"))
            at += len(word)
    groups: list[list[Candidate]] = []
    end = 0
    for c in sorted(found, key=lambda c: (c.start, -c.end)):
        if groups and c.start < end:
            groups[-1].append(c)
        else:
            groups.append([c])
        end = max(end, c.end)
    return [Candidate(g[0].start, max(c.end for c in g), g[0].kind, tuple(c for c in g[1:] if c.kind == "assigned" and c.start > g[0].start)) for g in groups]


def _classes(value: str) -> str:
    return "".join("l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in value)


FEATURES = (
    "length", "entropy", "distinct", "lower", "upper", "digit", "symbol", "changes", "letter_digit", "case_changes", "hex", "longest_letters", "repeats",
    "coverage", "vowels", "placeholder", "test_path", "noisy_path", "assigned", "login", "pem", "secret_near", "digest_near", "quoted", "in_url", "placeholder_near",
)


@functools.cache
def known_words() -> frozenset[str]:
    """Some 3000 English words and words of code."""
    from pydoc_data import topics

    return frozenset(re.findall(r"[a-z]{3,}", " ".join(topics.topics.values()).lower()))


def dictionary(docs: DataFrame, scratch: Scratch, most: int = 20_000, least: int = 20, text_col: str = "text") -> frozenset[str]:
    """Up to `most` words of letters alone that stand most often in all the texts, `least` times at least. Words are taken by
    octaves of their counts, eighths of them apart, as long as all of one still fit; so ties need no order, and nothing
    but these words and a total for each octave comes to the driver. An empty table gives none."""
    word = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("word")
    count = docs.select(word).where(F.length("word").between(3, 24)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    count = scratch.save(count.select("word", F.floor(8 * F.log2("n")).cast("int").alias("octave")), "words")
    total, lowest = 0, None
    for r in sorted(count.groupBy("octave").agg(F.count("*").alias("n")).collect(), reverse=True):  # some hundred rows at most
        total += r.n
        if total > most:
            break
        lowest = r.octave
    return frozenset(r.word for r in count.where(F.col("octave") >= lowest).select("word").collect()) if lowest is not None else frozenset()


def covered(runs: list[str], words: frozenset[str]) -> int:
    """Letters that words cover, the longest word taken at each place."""
    total = 0
    for run in runs:
        at = 0
        while at + 3 <= len(run):
            for to in range(min(len(run), at + 24), at + 2, -1):
                if run[at:to] in words:
                    total, at = total + to - at, to
                    break
            else:
                at += 1
    return total


def features(text: str, c: Candidate, path: str | None, words: frozenset[str]) -> list[float]:
    v = text[c.start : c.end]
    n, low, kinds = len(v), v.lower(), _classes(v)
    pairs = list(zip(kinds, kinds[1:], strict=False))
    count = Counter(v)
    runs = re.findall(r"[^\W\d_]+", low)
    before, after = text[max(0, c.start - AROUND) : c.start].lower(), text[c.end : c.end + AROUND].lower()
    near = re.findall(r"[a-z0-9_]+", before)[-4:] + re.findall(r"[a-z0-9_]+", after)[:2]
    where = (path or "").lower()
    share = lambda k: kinds.count(k) / n
    return [
        math.log(n), -sum(x / n * math.log2(x / n) for x in count.values()), len(count) / n, share("l"), share("u"), share("d"), share("s"),
        sum(a != b for a, b in pairs) / n, sum({a, b} in ({"l", "d"}, {"u", "d"}) for a, b in pairs) / n, sum({a, b} == {"l", "u"} for a, b in pairs) / n,
        float(all(x in string.hexdigits for x in v)), max(map(len, runs), default=0) / n, sum(a == b for a, b in zip(v, v[1:], strict=False)) / n,
        covered(runs, words) / n, sum(x in "aeiou" for x in low) / max(1, sum(map(len, runs))),
        float(any(w in low for w in PLACEHOLDER_WORDS)), float(any(w in where for w in TEST_PATHS)), float(where.endswith(NOISY_SUFFIXES)),
        float(c.kind == "assigned"), float(c.kind == "login"), float(c.kind == "private-key"),
        float(any(w in SECRET_WORDS or any(s in w for s in ("token", "secret", "passw", "key")) for w in near)), float(any(w in DIGEST_WORDS or w.startswith(("sha", "md5")) for w in near)),
        float(before[-1:] in ("'", '"', "`") and before[-1:] != ""), float("://" in before.split(" ")[-1]), float(any(w in PLACEHOLDER_WORDS for w in near)),
    ]


def generated_findings(n: int = 6000, seed: int = 11, words: frozenset[str] | None = None) -> list[tuple[str, str, bool]]:
    """Labelled findings (text, path, is a secret): publicly documented forms of credentials, and of hashes, identifiers, names,
    paths and placeholders that are none, in the syntaxes they are written in."""
    r = random.Random(seed)
    vocabulary = sorted(words or known_words())
    pick = lambda k, letters: "".join(r.choices(letters, k=k))
    low, up, digits, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, string.digits + "abcdef"
    b62 = string.ascii_letters + digits
    word = lambda: r.choice(vocabulary)
    joined = lambda sep, k: sep.join(word() for _ in range(k))
    prose = lambda: joined(" ", r.randint(0, 9))
    uuid = lambda: "-".join(pick(k, hexa) for k in (8, 4, 4, 4, 12))
    either = lambda *forms: r.choice(forms)()
    opaque = lambda: either(
        lambda: pick(r.choice([16, 18, 20, 24, 32, 40, 48, 64]), r.choice([hexa, hexa, hexa.upper()])), lambda: pick(r.randint(16, 64), b62), lambda: pick(40, b62 + "+/"), lambda: pick(r.randint(20, 64), b62 + "_-"),
        lambda: r.choice(["AKIA", "ASIA"]) + pick(16, up + "234567"), lambda: r.choice(["ghp_", "gho_", "ghs_"]) + pick(36, b62), lambda: "glpat-" + pick(20, b62), lambda: f"xoxb-{pick(11, digits)}-{pick(12, digits)}-{pick(24, b62)}",
        lambda: r.choice(["sk_live_", "rk_live_"]) + pick(24, b62), lambda: "AIza" + pick(35, b62 + "_-"), lambda: f"SG.{pick(22, b62)}.{pick(43, b62)}", lambda: "npm_" + pick(36, b62), lambda: "SK" + pick(32, hexa),
        lambda: f"eyJ{pick(r.randint(17, 40), b62)}.eyJ{pick(r.randint(30, 600), b62)}.{pick(43, b62 + '_-')}", lambda: pick(86, b62 + "+/") + "==", lambda: "dop_v1_" + pick(64, hexa),
    )
    password = lambda: either(lambda: pick(r.randint(8, 20), b62 + "!@#%^*"), lambda: pick(r.randint(8, 24), low + digits), lambda: word().title() + pick(r.randint(2, 6), digits + "!$"), lambda: pick(r.randint(8, 24), hexa))
    name = lambda: r.choice([str.lower, str.upper, str.title])(r.choice(["", "", word() + "_"]) + r.choice(["token", "api_key", "apikey", "secret", "password", "passwd", "access_key", "client_secret", "auth_token", "secret_key", "credential"]))
    q = lambda: r.choice(["'", '"', "`"])

    def assign(key: str, value: str) -> str:
        mark = q()
        return r.choice([f"{key}={value}", f"{key} = {mark}{value}{mark}", f"{key}: {value}", f"{key}: {mark}{value}{mark}", f'"{key}": "{value}",', f"export {key}={value}", f"const {key} = {mark}{value}{mark};", f"?{word()}={word()}&{key}={value}"])

    good = [
        lambda: assign(name(), opaque()), lambda: assign(name(), opaque()), lambda: assign(name(), password()), lambda: f"Authorization: Bearer {opaque()}", lambda: f"curl -H 'X-Api-Key: {opaque()}' https://{word()}.io",
        lambda: f"{r.choice(['postgres', 'mysql', 'amqp', 'redis', 'https'])}://{word()}:{password().translate(str.maketrans('@#:/', 'abcd'))}@{word()}.internal/db", lambda: f"{word()} --token {opaque()}",
        lambda: f"-----BEGIN {r.choice(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----\n" + "\n".join(pick(64, b62 + "+/") for _ in range(r.randint(2, 30))) + "\n-----END PRIVATE KEY-----",
        lambda: r.choice(["AKIA", "ASIA"]) + pick(16, up + "234567"), lambda: f"{r.choice(['secret', 'key', 'token', 'credentials', 'private'])} {opaque()}", lambda: r.choice(["ghp_" + pick(36, b62), "sk_live_" + pick(24, b62), "AIza" + pick(35, b62)]),
    ]
    bad = [
        lambda: f"commit {pick(40, hexa)}", lambda: f"{r.choice(['sha256', 'sha1', 'md5', 'checksum', 'digest'])}{r.choice([': ', '=', ' '])}{pick(r.choice([32, 40, 64]), hexa)}", lambda: f'"integrity": "sha512-{pick(86, b62 + "+/")}=="',
        lambda: f"{r.choice(['id', 'guid', 'uuid', 'request_id', 'order'])}{r.choice(['=', ': ', ' '])}{uuid()}", lambda: f"https://{word()}.com/{joined('/', 2)}/{pick(32, hexa)}", lambda: f"https://{word()}.org/{joined('-', 5)}-{r.randint(1, 9999)}",
        lambda: assign(name(), r.choice(["your_token_here", "YOUR-API-KEY", "changeme", "changeme123", "example_key_1", "xxxxxxxxxxxx", "<redacted>", "placeholder", "insert-key-here", "dummy_value_1", "test1234", "********"])),
        lambda: assign(name(), r.choice(["${" + name().upper() + "}", f"os.environ[{name()}]", f"get_{word()}_from_{word()}()", f"process.env.{name().upper()}", f"config.{word()}.{word()}", f"{word()}.{word()}({word()})", "{{ " + word() + "." + word() + " }}"])),
        lambda: f"{joined('_', 6)}_{r.randint(0, 99)}", lambda: f"{joined('-', 5)}-2024-{word()}", lambda: f"{joined('/', 5)}{r.randint(0, 9)}.{word()}", lambda: "".join(word().title() for _ in range(5)) + str(r.randint(1, 9)),
        lambda: f"{word()}.{pick(r.choice([8, 20, 32]), hexa)}.{r.choice(['js', 'css', 'png'])}", lambda: f"ssh-rsa AAAAB3NzaC1yc2E{pick(200, b62 + '+/')} {word()}@{word()}", lambda: f"data:image/png;base64,iVBORw0KGgo{pick(r.randint(40, 300), b62 + '+/')}",
        lambda: f"etag {pick(32, hexa)}", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}-{word()}.{pick(14, digits)}+{pick(7, hexa)}", lambda: f"order {pick(16, digits)}A{pick(8, digits)}", lambda: assign(r.choice(["author", "token_type", "secret_name", "key_file", "auth_method"]), joined(r.choice(["-", "_", "."]), 3)),
        lambda: f"{name()}: {joined('', 3)}", lambda: f"{word()}={joined('', 2)}{r.randint(1, 99)}&{word()}={joined('_', 4)}_{r.randint(1, 9)}", lambda: f"revision {pick(12, digits)}-{pick(12, hexa)}",
    ]
    anywhere = ["", "", "", "app/main.py", "config/settings.yml", "web/server.ts", "deploy/prod.env", "src/{}.go", "{}.txt", "{}"]
    quiet = ["tests/{}.py", "{}.lock", "docs/{}.md", "web/{}.min.js", "icons/{}.svg", "go.sum", "fixtures/{}.json"]
    out = []
    for i in range(n):
        real = i % 2 == 0
        body = r.choice(good if real else bad)()
        path = r.choice(anywhere if real and r.random() < 0.9 or r.random() < 0.6 else quiet).format(word())
        out.append((f"{prose()} {body}{r.choice(['', '', '.', ',', ';'])} {prose()}", path, real))
    return out


class Forest:
    """Binary classification trees on bootstrap samples, each split the best of a few random features by Gini impurity."""

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 5):
        self.shape, self.rng, self.trees = (trees, depth, least), np.random.default_rng(seed), []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        trees, depth, least = self.shape
        for _ in range(trees):
            rows = self.rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(nodes, x[rows], y[rows].astype(float), depth, least)
            self.trees.append(np.array(nodes))
        return self

    def _grow(self, nodes: list, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, y.mean()])  # feature, threshold, left, right, share of secrets
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return me
        best = (0.0, -1, 0.0)
        for f in self.rng.choice(x.shape[1], max(1, math.isqrt(x.shape[1])), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
            if not ok.any():
                continue
            p, q = t[:-1] / n, (t[-1] - t[:-1]) / (len(y) - n)
            gain = np.where(ok, y.mean() * (1 - y.mean()) - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(f), (v[k] + v[k + 1]) / 2)
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            nodes[me][:2] = best[1:]
            nodes[me][2] = self._grow(nodes, x[left], y[left], depth - 1, least)
            nodes[me][3] = self._grow(nodes, x[~left], y[~left], depth - 1, least)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of secrets in the leaves reached."""
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while (inner := t[at, 0] >= 0).any():
                here = at[inner]
                go = x[inner, t[here, 0].astype(int)] <= t[here, 1]
                at[inner] = np.where(go, t[here, 2], t[here, 3]).astype(int)
            total += t[at, 4]
        return total / max(1, len(self.trees))


class Detector:
    """A forest with the dictionary that its features are made with."""

    def __init__(self, forest: Forest, words: frozenset[str]):
        self.forest, self.words = forest, words

    def chances(self, found: list[tuple[str, Candidate, str | None]]) -> np.ndarray:
        return self.forest.predict(np.array([features(t, c, p, self.words) for t, c, p in found])) if found else np.zeros(0)


def train(findings: Iterable[tuple[str, str, bool]] | None = None, words: frozenset[str] = frozenset(), most: int = 20000) -> Detector:
    """A detector from labelled findings (text, path, is a secret), the first `most` of them; each text's candidates are its
    rows. Generated findings are used if none are given. `words` come on top of the words that are known anyway."""
    words = known_words() | words
    x, y = [], []
    for text, path, real in itertools.islice(generated_findings(words=words) if findings is None else findings, most):
        for c in candidates(text):
            for inner in (c, *c.inner):  # as they are judged
                x.append(features(text, inner, path, words))
                y.append(real)
    return Detector(Forest().fit(np.array(x), np.array(y)), words)


def _judge(detector: Detector, texts: list[str | None], paths: list[str | None], threshold: float) -> list[list[tuple[Candidate, float]]]:
    """For each text its candidates of at least `threshold`, each as likely as it or the likeliest value assigned inside it;
    the forest is asked once for all texts."""
    found = [candidates(t) if t else [] for t in texts]
    chances = iter(detector.chances([(t, x, p) for t, p, cs in zip(texts, paths, found, strict=True) for c in cs for x in (c, *c.inner)]).tolist())
    scored = [[(c, max(next(chances) for _ in range(1 + len(c.inner)))) for c in cs] for cs in found]
    return [[x for x in cs if x[1] >= threshold] for cs in scored]


def _paths(docs: DataFrame, path_col: str | None):
    return F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")


def scan(docs: DataFrame, detector: Detector, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per secret: doc_id, start and length in characters, kind, probability, and the sha256 of the secret in
    place of the secret. Null and empty texts have none; repeated rows are reported each; texts are read whole. A null path
    is an unknown one. An empty table gives no rows. Other columns are ignored whatever their names."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _paths(docs, path_col).alias("path"))
    kind = d.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "kind", "probability", "secret_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                texts = batch.column("text").to_pylist()
                found = _judge(detector, texts, batch.column("path").to_pylist(), threshold)
                rows = [(i, c.start, c.end - c.start, c.kind, round(p, 6), hashlib.sha256(texts[i][c.start : c.end].encode()).hexdigest()) for i, cs in enumerate(found) for c, p in cs]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0])), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], names)

    return d.mapInArrow(run, f"doc_id {kind}, start long, length long, kind string, probability double, secret_sha256 string")


def redact(docs: DataFrame, detector: Detector, threshold: float = 0.5, text_col: str = "text", path_col: str | None = "source", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every secret in the text replaced by MARK; `length_col`, where it exists, follows the text. Texts without
    secrets, null ones included, stay as they are, as do all other columns, whatever their names, and repeated rows."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(texts), 512):
            some, where = texts.slice(k, 512).to_pylist(), paths.slice(k, 512).to_pylist()
            for t, cs in zip(some, _judge(detector, some, where, threshold), strict=True):
                if not cs:
                    out.append(None)  # the JVM still has it
                    continue
                parts, at = [], 0
                for c, _ in cs:
                    parts += [t[at : c.start], MARK]
                    at = c.end
                out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), clean(F.col(f"`{text_col}`"), _paths(docs, path_col)).alias("cleaned"))
    kept = lambda c: F.col("row").getField(c)
    of = {text_col: F.coalesce("cleaned", kept(text_col))}
    if length_col in names and length_col:
        of[length_col] = F.when(F.col("cleaned").isNull(), kept(length_col)).otherwise(F.length("cleaned").cast(docs.schema[length_col].dataType))
    return d.select(*[of.get(c, kept(c)).alias(c) for c in names])
