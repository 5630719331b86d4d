import pathlib
import random
import resource
import threading

import pytest
from pyspark.sql import functions as F

from strataq.operators import aggregates, clones, graph, query, score, search
from strataq.plans import reports
from strataq.plans.scratch import Scratch
from strataq.sources import files
from strataq.streaming import lifecycle

FINDING = "rule_id string, category string, severity string, fingerprint string, subject string, type string, path string, line int"


def found(spark, rows):
    return spark.createDataFrame([(r, c, s, f, "x", "t", "p", i) for i, (r, c, s, f) in enumerate(rows)], FINDING)


def subject(spark, lines=500, duplication=0.0, present=()):
    return spark.createDataFrame([("x", lines, duplication, list(present))], "subject string, lines int, duplication double, present array<string>")


def none(spark):
    return spark.createDataFrame([], "fingerprint string")


def test_no_findings_is_full_score(spark):
    assert score.health(found(spark, []), subject(spark), none(spark)).collect() == [("x", 100, "A")]


def test_weights_sum_to_a_hundred():
    assert sum(d[1] for d in score.DIMENSIONS) == 100


def test_critical_secret_caps_the_score(spark):
    f = found(spark, [("a", "SECRET", "CRITICAL", "f1")])
    assert score.health(f, subject(spark), none(spark)).first()["score"] == 49
    out = score.health(f, subject(spark), spark.createDataFrame([("f1",)], "fingerprint string")).first()
    assert (out["score"], out["grade"]) == (100, "A")


def test_penalties_are_capped_and_per_thousand_lines(spark):
    many = found(spark, [("a", "CODE_QUALITY", "MEDIUM", f"f{i}") for i in range(100)])
    small = {r["dimension"]: r["score"] for r in score.dimension_scores(many, subject(spark), none(spark)).collect()}
    large = {r["dimension"]: r["score"] for r in score.dimension_scores(many, subject(spark, 100_000), none(spark)).collect()}
    assert small["codeQuality"] == 70 and large["codeQuality"] == 94


def test_fixed_penalties_and_duplication(spark):
    f = found(spark, [("testing/no-tests", "TESTING", "HIGH", "f1"), ("documentation/missing-readme", "DOCUMENTATION", "MEDIUM", "f2")])
    d = {r["dimension"]: (r["score"], r["applies"]) for r in score.dimension_scores(f, subject(spark, duplication=30.0, present=("codeQuality",)), none(spark)).collect()}
    assert d["testing"] == (20, True) and d["documentation"] == (60, True) and d["codeQuality"] == (85, True) and d["api"] == (None, False)


def test_triage_edges(spark):
    f, empty = found(spark, [("a", "SECRET", "HIGH", "f1")]), none(spark)
    assert query.triaged(f, empty, "untriaged").count() == 1 and query.triaged(f, empty, "triaged").count() == 0


def test_lists_and_paths_are_checked():
    assert query.checked_list("a, b", "abc") == ["a", "b"]
    for bad in ("x", ",".join(["a"] * 21)):
        with pytest.raises(ValueError):
            query.checked_list(bad, "a")
    for bad in ("/etc", "a/../b", "", "C:/x"):
        with pytest.raises(ValueError):
            query.checked_path(bad)


def test_page_sizes(spark):
    d = spark.range(500)
    assert [r[0] for r in query.page(d, [F.col("id")], 2, 10).collect()] == list(range(10, 20))
    assert query.page(d, [F.col("id")], 0, 9999).count() == 200


def test_empty_filters_add_nothing(spark):
    f = found(spark, [("a", "SECRET", "HIGH", "f1"), ("b", "API", "LOW", "f2")])
    assert f.where(query.findings_where(severity=[], category=None)).count() == 2
    assert f.where(query.findings_where(severity=["LOW"])).count() == 1


def test_nearest_rank_is_a_member(spark):
    d = spark.createDataFrame([(x,) for x in (5, 1, 4, 2, 3, 10, 9, 8, 7, 6)], "v int")
    for percent, want in ((0, 1), (50, 6), (90, 10), (100, 10)):
        assert aggregates.nearest_rank(d, [], "v", percent).first()["v"] == want


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_strong_components(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g")])
    got = {(r["id"], r["component"]) for r in graph.strong_components(e, Scratch(spark)).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}


def test_strong_components_of_a_chain(spark):
    chain = edges(spark, [(f"{i:02d}", f"{i + 1:02d}") for i in range(12)])
    assert graph.strong_components(chain, Scratch(spark)).count() == 0


def test_cycle_paths(spark):
    far = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("n060", "n000")]  # longer than any fixed depth
    e = edges(spark, [("a", "c"), ("c", "a"), ("a", "b"), ("b", "a"), *far[:8], ("n008", "n000")])
    s = Scratch(spark)
    found = {r["component"]: (r["length"], r["path"]) for r in graph.cycle_paths(e, graph.strong_components(e, s), s).collect()}
    assert found == {"a": (2, ["a", "b", "a"]), "n000": (9, [f"n{i:03d}" for i in range(9)] + ["n000"])}


def test_scratch_is_shared_or_local():
    from types import SimpleNamespace

    unset = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        Scratch(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://host:7077"), conf=unset))


def test_shortest_cycle(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")])
    s = Scratch(spark)
    assert graph.shortest_cycle(e, graph.strong_components(e, s), s).collect() == [("a", 2)]


def test_bfs_depth_and_limit(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("a", "a")])
    start = spark.createDataFrame([("a",)], "id string")
    got = {tuple(r) for r in graph.bfs(e, start, Scratch(spark), max_depth=2).collect()}
    assert got == {("b", 1), ("x", 1), ("c", 2)}
    assert [r["id"] for r in graph.bfs(e, start, Scratch(spark), limit=1).collect()] == ["b"]


def test_pagerank_sums_to_one(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("a", "c"), ("c", "a")])
    r = {x["id"]: x["rank"] for x in graph.pagerank(e, spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), Scratch(spark)).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["b"] > r["c"]


def test_evidence_is_numbered_and_capped(spark):
    hits = spark.createDataFrame([("a", 3.0), ("b", 5.0)], "path string, score double")
    parts = {"symbol": spark.createDataFrame([("a", "a", f"s{i:03d}") for i in range(60)] + [("b", "b", "s")], "path string, of string, summary string"), "import": spark.createDataFrame([("x", "a", "i")] * 3, "path string, of string, summary string")}
    rows = search.evidence_bundle(hits, parts).collect()
    assert rows[0]["ref"] == "E1" and rows[0]["path"] == "b"
    assert sum(r["kind"] == "symbol" for r in rows) == 40 and sum(r["kind"] == "import" for r in rows) == 1


def test_query_terms():
    assert search.query_terms("Where is the OrderService defined?") == ["order", "service"]


def test_greedy_and_window_clones_agree(spark):
    block = [hash(("b", i)) % 10**6 for i in range(60)]
    a = [1] * 0 + list(range(100, 120)) + block
    b = block + list(range(300, 330))
    rows_a, rows_b = [i // 6 for i in range(len(a))], [i // 6 for i in range(len(b))]
    greedy = clones.greedy_scan([("a", a, rows_a), ("b", b, rows_b)], 50, 6)
    assert len(greedy) == 1 and greedy[0][0] == "b" and greedy[0][3] == "a"
    d = spark.createDataFrame([("a", a), ("b", b)], "path string, hashes array<bigint>")
    (w,) = clones.window_clones(d, 50).collect()
    assert (w["path"], w["original"], w["start"], w["original_start"], w["tokens"]) == ("b", "a", 0, 20, 60)


def test_clones_inside_one_file_do_not_overlap(spark):
    d = spark.createDataFrame([("a", [1] * 30)], "path string, hashes array<bigint>")
    found = clones.window_clones(d, 10).collect()
    assert found and all(w["original_start"] + 10 <= w["start"] for w in found)


def test_transitions_cover_the_table():
    assert lifecycle.allowed("QUEUED", "MATERIALIZING") and lifecycle.allowed("TESTING", "CANCELLED")
    assert not lifecycle.allowed("READY_FOR_REVIEW", "FAILED") and not lifecycle.allowed("FAILED", "QUEUED") and not lifecycle.allowed("QUEUED", "TESTING")


def test_no_success_without_a_passing_test(spark):
    s = spark.createDataFrame([("r", "RUN", "READY_FOR_REVIEW")], "run_id string, type string, status string")
    schema = "run_id string, kind string, exit_code int, timed_out boolean, started_at int, id int"
    for rows, want in (([], "NOT_TESTED"), ([("r", "TEST", 0, False, 1, 1), ("r", "TEST", 1, False, 2, 2)], "TESTS_FAILED"), ([("r", "TEST", 0, True, 1, 1)], "TESTS_FAILED"), ([("r", "TEST", 0, False, 1, 1)], "TESTS_PASSED")):
        assert reports.outcomes(s, spark.createDataFrame(rows, schema)).first()["outcome"] == want


def test_reports_are_stored_once(spark):
    r = spark.createDataFrame([("s", "x", 1, "a"), ("s", "x", 2, "b"), ("s", "y", 3, "c")], "subject_key string, body string, generated_at int, id string")
    first = reports.new_reports(r, spark.createDataFrame([], "subject_key string, fingerprint string"))
    assert first.count() == 2 and reports.new_reports(r, first).count() == 0


def test_file_tree(spark, tmp_path):
    for path, data in {"src/a.py": b"x = 1\n", "logo.dat": b"\x00\x01", ".gitignore": b"*.log\n/secret\n", "x.log": b"l", "secret/k": b"k", "node_modules/m/i.js": b"1", "README.md": b"# t"}.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    tree, more = files.read_tree(spark, str(tmp_path))
    got = {r["path"]: (r["kind"], r["lines"]) for r in files.inventory(tree).collect()}
    assert not more
    assert got == {"src/a.py": ("SOURCE", 1), "logo.dat": ("BINARY", None), ".gitignore": ("CONFIG", 2), "README.md": ("DOCUMENTATION", 1)}


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    from strataq import catalog

    queries = catalog.queries()
    for name in ("findings_page", "clones_windows", "tree_rollup"):
        got = []
        for n in ("1", "8"):
            before = spark.conf.get("spark.sql.shuffle.partitions")
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(str, queries[name](spark, sf_dir).collect())))
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got[0] == got[1]


@pytest.mark.parametrize("window,least_lines,most_kept", [(7, 2, 8), (6, 1, 2), (50, 2, 8), (1, 1, 3)])
def test_greedy_clones_of_a_stream_are_those_of_the_scan_in_memory(spark, window, least_lines, most_kept):
    """Copies, near copies, periods, shared lines, one-line files, null and equal repositories and repeated paths."""
    r = random.Random(window)
    blocks = [[r.randrange(10**9) for _ in range(r.choice((window, 3 * window)))] for _ in range(6)] + [[5] * (4 * window), [1, 2, 3] * (2 * window)]
    files = []
    for i in range(150):
        tokens = [t for _ in range(r.randrange(6)) for t in r.choice((r.choice(blocks), [r.randrange(40) for _ in range(r.randrange(20))]))]
        if files and r.random() < 0.3:
            tokens = list(r.choice(files)[2])
            if tokens and r.random() < 0.5:
                tokens[r.randrange(len(tokens))] = 77
        rows, row = [], 0
        wide = r.choice((0.05, 0.3, 0.0))
        for _ in tokens:
            rows.append(row)
            row += r.random() < wide
        files.append((r.choice(("a", "b", None)), f"{i:04d}", tokens, rows))
    wanted = sorted(
        ((repository, *c) for repository in ("a", "b", None) for c in clones.greedy_scan([f[1:] for f in files if f[0] == repository], window, least_lines, most_kept)),
        key=repr,
    )
    d = spark.createDataFrame(files, "repository string, path string, hashes array<bigint>, rows array<int>").repartition(5)
    assert len(wanted) > 20 and sorted(map(tuple, clones.greedy_clones(d, window, least_lines, most_kept).collect()), key=repr) == wanted


def test_greedy_clones_hold_no_whole_repository(spark):
    """A repository of 2 million tokens in 40 files, each in two copies: no worker may hold them or all their windows."""
    peak, over = [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            for p in pathlib.Path("/proc").glob("[0-9]*"):
                try:
                    if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                        peak[0] = max(peak[0], int((p / "statm").read_text().split()[1]) * resource.getpagesize())
                except OSError:
                    pass

    hashes = F.transform(F.sequence(F.lit(0), F.lit(49999)), lambda i: F.xxhash64(i, F.floor(F.col("id") / 2)))
    d = spark.range(40).select(F.lit("r").alias("repository"), F.format_string("%05d", "id").alias("path"), hashes.alias("hashes"), F.transform(F.sequence(F.lit(0), F.lit(49999)), lambda i: (i / 10).cast("int")).alias("rows"))
    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = clones.greedy_clones(d).orderBy("path").collect()
    finally:
        over.set()
        watcher.join()
    assert [tuple(r) for r in found] == [("r", f"{i:05d}", 1, 5000, f"{i - 1:05d}", 1, 5000, 50000) for i in range(1, 40, 2)]
    assert 0 < peak[0] < 500e6
