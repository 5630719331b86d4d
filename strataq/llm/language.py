"""Language ID by compression: the language whose dictionary makes a text smallest.

Each language has a Zstandard raw-content dictionary of its own texts, lower case as are the texts. A text is cut into chunks, each chunk is
compressed with every dictionary, and the sizes are summed: chunks keep a long text from becoming its own dictionary,
so all of it counts. The score is the softmax of the code lengths per byte; predictions whose two best sizes are within
`margin` are marked as rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced

#: Up to so many languages have whole dictionaries; more share what these would hold, and learn from fewer texts each.
WHOLE = 64
SLOTS, DICTIONARY_BYTES, LEAST_BYTES, MOST_LANGUAGES = 256, 200 * 1024, 1024, 20_000
#: A long text is read in so many slices, spread from its start to its end.
SLICES, SLICE_CHARS = 8, 500
CHUNK, LEVEL, MARGIN, SHARPNESS = 4096, 6, 0.01, 60.0


def spread(data: bytes, room: int) -> bytes:
    """At most `room` bytes of data, in equal slices from its start to its end."""
    if len(data) <= room:
        return data
    n = max(1, min(SLICES, room // 64))
    size = room // n
    return b"".join(data[k : k + size] for k in (i * (len(data) - size) // max(1, n - 1) for i in range(n)))


def fit_dictionaries(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", slots: int = SLOTS, dictionary_bytes: int = DICTIONARY_BYTES, least_bytes: int = LEAST_BYTES, whole: int = WHOLE, most_languages: int = MOST_LANGUAGES,
) -> dict[str, bytes]:
    """Raw-content dictionaries of all languages, from a bounded sample of labelled rows: `slots` texts of a language (of each
    of `slots` id-hash classes the smallest hash), SLICES slices of a text and `dictionary_bytes` of a language. More than
    `whole` languages share whole * slots texts and whole * dictionary_bytes, but each has a text and `least_bytes` at least.

    Rows with null text or language teach nothing. Of rows that share an id and a language the smallest text is taken. More
    than `most_languages` different languages are an error, as their dictionaries must fit in a worker's memory.
    """
    d = docs.select(F.xxhash64(id_col).alias("hash"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    d = d.where("lang is not null and text is not null")
    n = max(1, d.select("lang").distinct().count())
    if n > most_languages:
        raise ValueError(f"{n} languages; at most {most_languages} can be learned")
    slots, budget = max(1, min(slots, whole * slots // n)), max(least_bytes, min(dictionary_bytes, whole * dictionary_bytes // n))
    picked = d.groupBy("lang", F.pmod("hash", F.lit(slots)).alias("slot")).agg(F.min("hash").alias("hash"))
    sample = d.join(F.broadcast(picked.select("lang", "hash")), ["lang", "hash"]).select("lang", "hash", F.lower(sliced(F.col("text"), SLICES, SLICE_CHARS)).alias("text"))
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in sample.groupBy("lang", "hash").agg(F.min("text").alias("text")).collect():  # a row per language and slot
        texts.setdefault(row["lang"], []).append((row["hash"], row["text"]))
    out = {}
    for lang, rows in sorted(texts.items()):
        parts = [t.encode() for _, t in sorted(rows)]
        left, share = budget - len(parts), {}
        for k, i in enumerate(sorted(range(len(parts)), key=lambda i: len(parts[i]))):  # what short texts leave goes to longer ones
            share[i] = min(len(parts[i]), max(1, left // (len(parts) - k)))
            left -= share[i]
        out[lang] = b"\n".join(spread(x, share[i]) for i, x in enumerate(parts))[-budget:]
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], margin: float = MARGIN):
        self.langs, self.margin, self.zips = sorted(dictionaries), margin, []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.zips.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        chunks = [data[k : k + CHUNK] for k in range(0, len(data), CHUNK)]
        return [sum(len(z.compress(c)) for c in chunks) for z in self.zips]

    def __call__(self, text: str) -> tuple[str, float, bool]:
        """(language, score, rejected). Equal sizes go to the first language in code-point order."""
        data = text.lower().encode("utf-8", "replace")
        sizes = self.sizes(data)
        least = min(sizes)
        best = sizes.index(least)
        weights = [math.exp(-SHARPNESS * (s - least) / max(least, 1)) for s in sizes]
        second = min((s for i, s in enumerate(sizes) if i != best), default=math.inf)
        return self.langs[best], 1 / sum(weights), (second - least) / max(least, 1) < self.margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row, in place: no shuffle.

    Null text or a text without a letter is `und` with score 0, as is every text if no language was learned. Whole texts
    are read, however long. Repeated rows each get a row; other columns are ignored whatever their names.
    """
    dictionaries = dict(dictionaries)
    kept: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = kept.get("c") or kept.setdefault("c", Classifier(dictionaries, margin))
        for batch in batches:
            out = [classify(t) if letter and classify.langs else ("und", 0.0, True) for t, letter in zip(batch.column("text").to_pylist(), batch.column("letter").to_pylist(), strict=True)]
            cols = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True))] if out else [batch.column("doc_id"), pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "rejected"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    d = d.withColumn("letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return d.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Dictionaries from the documents that are not held out, predictions for all."""
    learned = fit_dictionaries(docs.where(~held_out("doc_id")))
    found = identify(docs, learned)
    return found.withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score", "rejected")
