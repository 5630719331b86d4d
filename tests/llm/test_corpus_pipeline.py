"""The pipeline stage by stage against brute force, and the contracts of the registered queries, on the smallest tables."""

import collections
import re
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_llm_operators import WORD, awkward, brute_components, check_packing, clashing, ids_of  # noqa: E402

import corpus_pipeline  # noqa: E402
from strataq.llm import queries, secret_scan  # noqa: E402
from strataq.llm.common import table  # noqa: E402
from strataq.session import ship  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Every stage's input and output, written and read again."""
    ship(spark)
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def test_stage_columns(stages):
    names = list(stages)
    assert names == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    for name in names[:-1]:
        assert stages[name][1].columns == list(corpus_pipeline.COLUMNS)


def test_quality_keeps_good_documents(spark, sf_dir, stages):
    before, after = stages["quality"]
    kept = {r["doc_id"] for r in after.collect()}
    labels = table(spark, sf_dir, "labels").collect()
    good, bad = [r["doc_id"] in kept for r in labels if r["quality"] and not r["toxic"]], [r["doc_id"] in kept for r in labels if not r["quality"]]
    assert sum(good) / len(good) > 0.97 and sum(bad) / max(1, len(bad)) < 0.2
    rows = {r["doc_id"]: tuple(r) for r in before.collect()}
    assert all(rows[r["doc_id"]] == tuple(r) for r in after.collect())


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    want, _ = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5)
    assert {r["doc_id"] for r in after.collect()} == {i for i, c in want.items() if i == c}


def test_secrets_are_gone_and_nothing_else(stages):
    before, after = stages["secrets"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert not re.search(r'token = "[0-9a-f]{40}"', r["text"])
        planted = re.sub(r'(?i)(token = ")[0-9a-f]{40}"', rf'\1{secret_scan.MARK}"', texts[r["doc_id"]])
        assert re.sub(r"password=[0-9a-f]{18}|AKIA[A-Z2-7]{16}", secret_scan.MARK, planted) == r["text"]
        assert r["n_chars"] == len(r["text"])
    assert after.count() == before.count()


def test_mix_repeats_whole_documents(stages):
    before, after = stages["mixing"]
    rows = {r["doc_id"]: tuple(r) for r in before.collect()}
    copies = collections.Counter(r["doc_id"] for r in after.collect())
    assert all(rows[r["doc_id"]] == tuple(r) for r in after.collect()) and set(copies.values()) <= {1, 2}
    words = {i: len(WORD.findall(r[1])) for i, r in rows.items()}
    assert abs(sum(words[i] * c for i, c in copies.items()) / sum(words.values()) - 1.5) < 0.1


def test_mix_keeps_rows_with_null_and_repeated_ids(spark):
    """Rows are taken as the operator says, whether their ids are null, repeat or clash across sources."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None if i % 3 == 0 else i % 40, f"w{i} " * (1 + i % 7), "en", (None, "a", "b", "c")[i % 4], i) for i in range(400)]
    docs = spark.createDataFrame(rows, kinds)
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    assert mixed.columns == list(corpus_pipeline.COLUMNS)
    got = collections.Counter(map(tuple, mixed.collect()))
    assert set(got) <= set(rows) and set(got.values()) <= {1, 2}
    said = collections.Counter()
    for x in corpus_pipeline.mixing.mix(docs, corpus_pipeline.Scratch(spark)).collect():
        said[x["doc_id"], x["size"], x["source_size"]] += x["copies"]
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    assert len(set(sizes.values())) == 4
    mine = collections.Counter()
    for r, n in got.items():
        mine[r[0], len(r[1].split()), sizes[r[3]]] += n
    assert mine == +said and any(k[0] is None for k in mine)


def stage_of(name, spark, docs, sf_dir):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert name == "packing" or out.columns == list(corpus_pipeline.COLUMNS)
    return collections.Counter(map(str, out.collect()))


def rows_of(docs):
    return collections.Counter(map(str, docs.select(*corpus_pipeline.COLUMNS).collect()))


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "secrets", "mixing", "packing"])
def test_stages_on_awkward_rows(spark, sf_dir, name):
    """Nulls, empty and very long texts, repeated rows, columns of clashing names, and no rows at all."""
    ship(spark)
    docs = awkward(spark)
    got = stage_of(name, spark, clashing(docs), sf_dir)
    assert got == stage_of(name, spark, docs.repartition(3), sf_dir) or name == "packing"
    assert not stage_of(name, spark, docs.limit(0), sf_dir)
    all_rows = rows_of(docs)
    if name == "quality":
        blank = rows_of(docs.where("text is null or trim(translate(text, '\t\n', '  ')) = ''"))
        assert not (got - all_rows) and not (got & blank)
    if name == "near_duplicates":
        assert set(got.values()) == {1} and set(got) == set(rows_of(docs.where("doc_id is null or doc_id <> 6")))
    if name == "secrets":
        assert got == all_rows
    if name == "mixing":
        assert not (set(got) - set(all_rows)) and all(n <= 2 * all_rows[row] for row, n in got.items())


def test_one_row_of_a_group_stays_whatever_ids_repeat(spark, sf_dir):
    text, near, other = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    near = text.rsplit(" ", 1)[0] + " end"
    rows = [(7, text), (7, other), (7, near), (9, other), (9, other), (None, other), (None, other), (3, None), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect())
    assert set(got.values()) == {1} and len(got) == 5
    assert {(7, other), (None, other), (3, None), (3, "")} < set(got) and len({(7, text), (7, near)} & set(got)) == 1


def test_packing_holds_every_row(stages):
    before, after = stages["packing"]
    rows = before.collect()
    ids = dict(zip([r["doc_id"] for r in rows], ids_of([r["text"] for r in rows], 1), strict=True))
    copies = collections.Counter(r["doc_id"] for r in rows)
    pieces = after.collect()
    got = collections.Counter()
    for p in pieces:
        assert ids[p["doc_id"]][4 * p["start"] : 4 * (p["start"] + p["length"])] == p["ids"]
        got[p["doc_id"]] += p["length"]
    assert got == {i: c * len(ids[i]) // 4 for i, c in copies.items()}
    single = [p for p in pieces if copies[p["doc_id"]] == 1]
    assert len(single) > 0 and check_packing(pieces, {}) == 0


def test_run_gives_the_same_pieces(spark, sf_dir, stages):
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", F.crc32("ids")).groupBy("doc_id").agg(F.sum("length")).collect()))
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages["packing"][1])


CONTRACTS = {
    "op1_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op2_near_dups": "doc_id n_shingles component_id kept", "op3_language_id": "doc_id held_out lang_pred score",
    "op4_quality_classifier": "doc_id expected_grade tail_probability kept", "op5_warc": "page_id payload_bytes payload_digest record_type refers_to", "op6_exact_topk": "query_id rank vec_id score",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op8_secret_scan": "doc_id start length kind probability", "op9_mixing": "doc_id size source_size target taken", "op10_token_files": "doc_id start n_tokens ids_crc32",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(name, spark, sf_dir):
    df = queries.queries()[name](ship(spark), sf_dir)
    kinds = dict(df.dtypes)
    assert set(CONTRACTS[name].split()) <= set(kinds)
    rows = df.collect()
    documents = table(spark, sf_dir, "documents")
    if name not in ("op1_packing", "op5_warc", "op6_exact_topk", "op8_secret_scan"):
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents.select("doc_id").collect())
    if name in ("op1_packing", "op10_token_files"):
        end = 1 if name == "op1_packing" else 0
        texts = documents.collect()
        docs = dict(zip([r["doc_id"] for r in texts], ids_of([r["text"] for r in texts], end), strict=True))
        for r in rows:
            part = docs[r["doc_id"]] if end == 0 else docs[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert zlib.crc32(part) == r["ids_crc32"]


def test_mixing_equals_its_sql(spark, sf_dir):
    from compare import assert_same, connect

    assert_same(queries.queries()["op9_mixing"](spark, sf_dir), connect(sf_dir), queries.oracle_sql()["op9_mixing"])
