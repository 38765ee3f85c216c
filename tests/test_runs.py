"""Stored tables with two writers, scans that push down, stage runs, events, structure views on odd input."""

import threading

import pytest
from pyspark.sql import functions as F

from granary.operators import stages, structures
from granary.sources import snapshots, tables


def test_versions_and_two_writers(spark, tmp_path):
    table = snapshots.Table(spark, f"file://{tmp_path}/t", "k string, n int")
    assert table.version() == 0 and table.read().count() == 0
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n int")
    assert table.insert(rows(("a", 1), ("b", 2))) == 1
    pinned = table.read(1)
    with pytest.raises(snapshots.Conflict):
        table.write(rows(("late", 0)), after=0)
    assert table.upsert(rows(("b", 3), ("c", 4), (None, 5), ("c", 4)), "k") == 2
    assert sorted(map(repr, table.read().collect())) == sorted(map(repr, rows(("a", 1), ("b", 3), ("c", 4), (None, 5)).collect()))
    assert sorted(tuple(r) for r in pinned.collect()) == [("a", 1), ("b", 2)]
    table.update({"k": "a"}, {"n": 9})
    assert table.read().where("k = 'a'").first().n == 9 and table.read(2).where("k = 'a'").first().n == 1

    failed = []

    def add(i):
        try:
            snapshots.Table(spark, f"file://{tmp_path}/t", "k string, n int").change(lambda prior: prior.unionByName(rows((f"w{i}", i))))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=add, args=(i,)) for i in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed and table.version() == 7
    assert {r.k for r in table.read().where("k LIKE 'w%'").collect()} == {"w0", "w1", "w2", "w3"}


def test_status_of_known_and_unknown_jobs(spark, tmp_path):
    jobs = snapshots.Table(spark, f"file://{tmp_path}/jobs", snapshots.JOBS)
    one = lambda *x: spark.createDataFrame(list(x), snapshots.JOBS)
    jobs.insert(one(("a", "RUNNING", None, {"x": "1", "y": "2"}), ("b", "RUNNING", None, None)))
    snapshots.set_status(jobs, one(("a", "DONE", None, {"y": "3"}), ("z", "FAILED", None, None)))
    got = {r.job_id: (r.status, r.facts) for r in jobs.read().collect()}
    assert got == {"a": ("DONE", {"x": "1", "y": "3"}), "b": ("RUNNING", {}), "z": ("FAILED", {})}


def test_conditions_are_pushed_down(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("kind")).write.parquet(f"{tmp_path}/t")
    found = tables.matching(spark.read.parquet(f"{tmp_path}/t"), {"kind": "3", "id": {"in": [3, 10, 11, None]}})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,3)" in plan and "In(id" in plan
    assert sorted(r.id for r in found.collect()) == [3, 10]
    assert tables.matching(found, None).count() == 2 and tables.matching(found, {"id": {"in": []}}).count() == 0


def test_scan_of_a_database(spark, monkeypatch):
    url, driver = "jdbc:derby:memory:granary;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(50).select(F.col("id").cast("int").alias("ID"), (F.col("id") % 5).cast("int").alias("KIND"))
    tables.insert(rows, url, "FILES", **driver)
    monkeypatch.setattr(tables, "PER_PARTITION", 3)
    found = tables.scan(spark, url, "FILES", {"KIND": {"in": [1, 2]}}, split="ID", **driver)
    assert found.rdd.getNumPartitions() > 1 and sorted(r.ID for r in found.collect()) == [i for i in range(50) if i % 5 in (1, 2)]
    assert "PushedFilters: [*In(KIND" in found._jdf.queryExecution().executedPlan().toString()
    assert tables.scan(spark, url, "FILES", {"ID": 7}, **driver).count() == 1
    assert tables.scan(spark, url, "FILES", {"ID": -1}, split="ID", **driver).count() == 0


def test_a_run_goes_on_where_it_failed(spark, tmp_path):
    calls = []

    def double(df):
        calls.append("double")
        return df.select((F.col("n") * 2).alias("n"))

    broken = stages.Stage("last", lambda df: df.select(F.raise_error(F.lit("token=abc is bad")).alias("n")))
    first = spark.createDataFrame([(1,), (2,)], "n int")
    steps = [stages.Stage("double", double, {"total": F.sum("n")})]
    run = stages.Run(spark, f"file://{tmp_path}", "r1")
    with pytest.raises(Exception, match="bad"):
        run.run([*steps, broken], first)
    assert run.completed() == ["double"] and run.state.read().first().failed
    again = stages.Run(spark, f"file://{tmp_path}", "r2")
    out = again.run([*steps, stages.Stage("last", lambda df: df.where("n > 2"))], first)
    assert [r.n for r in out.collect()] == [4] and again.completed() == ["double", "last"]
    events = again.events.read()
    kinds = [r.event_type for r in events.orderBy("timestamp").collect()]
    assert kinds == ["stage_started", "stage_completed", "stage_started", "stage_failed", "pipeline_failed", "stage_started", "stage_completed"]
    assert "abc" not in str(events.collect())
    assert {(r.stage, r.metric): r.value for r in again.metrics().collect()} == {("double", "rows"): 2, ("double", "total"): 6, ("last", "rows"): 1}


def test_parser_events_of_odd_files(spark):
    files = spark.createDataFrame([("a", "jcl"), ("b", None)], "path string, artifact_type string")
    found = spark.createDataFrame([("a", "DD", 3), ("a", "EXEC", None), (None, "DD", 1)], "path string, evidence_type string, source_line int")
    got = sorted((r.path, r.event_type, r.source_line) for r in stages.parser_events(files, found, "P").collect())
    assert [x[:2] for x in got] == [("a", "evidence_extracted"), ("a", "parser_completed"), ("a", "parser_selected"), ("a", "parser_started"), ("b", "parser_completed"), ("b", "parser_selected"), ("b", "parser_started")]
    assert got[0][2] == 3
    assert stages.parser_events(files.limit(0), found, "P").count() == 0


ARTIFACTS = "artifact_id string, artifact_type string, name string, source_file string, facts string"


def test_views_of_odd_artifacts(spark):
    rows = [
        ("o", "OTHER", None, None, None), ("j", "jcl", "J", None, "{}"), ("x", None, None, None, "not json"), ("c", "COBOL", "C", "c.cbl", '{"properties":{"divisions":["A"],"sections":"no list"}}'),
        ("e", "COPYBOOK", None, None, '{"fields":[],"properties":{"copybook_fragment_hierarchy":[{"type":"paragraph","name":"P","children":[{"name":"S"}]}]}}'), ("d", "DATASET", "D", None, '{"organization":""}'),
        ("t", "OTHER", None, None, '{"artifact_type":"catalog","entries":[{"name":"N"}]}'),
    ]
    found = structures.canonical(spark.createDataFrame(rows, ARTIFACTS))
    nodes = structures.view(found)
    got = sorted((r.artifact_id, ".".join(map(str, r.path)), r.type, r.name) for r in nodes.select("artifact_id", "path", "type", "name").collect())
    assert got == [("c", "0", "program", "C"), ("c", "0.0", "division_group", "Divisions"), ("c", "0.0.0", "division", "A"), ("e", "0", "paragraph", "P"), ("e", "0.0", "copybook_fragment", "S"), ("t", "0", "catalog_entry", "N")]
    shown = {r.artifact_id: (r.available, r.message) for r in structures.availability(found, nodes).collect()}
    assert {k for k, v in shown.items() if not v[0]} == {"o", "j", "x", "d"} and all((m is None) == a for a, m in shown.values())
    assert {r.artifact_id for r in found.where("malformed").collect()} == {"x"}
    assert structures.view(found.limit(0)).count() == 0


def test_links_come_once_and_in_order(spark):
    found = structures.canonical(spark.createDataFrame([("p", "COBOL", None, None, '{"copybooks_used":["B","A",null,"B"]}')], ARTIFACTS))
    edges = spark.createDataFrame([(2, "p", "A", "USES_COPYBOOK"), (1, "p", "q", None), (3, "p", "p", "CALLS"), (4, "q", "p", "READS"), (5, "q", "z", "READS"), (6, None, "p", "X"), (7, "p", None, "READS")], "place int, source_id string, target_id string, rel_type string")
    got = structures.links(found, edges).orderBy("role", "list", "place").collect()
    assert [(r.role, r.other) for r in got] == [
        ("called_programs", "p"), ("copybooks", "A"), ("copybooks", "B"), ("referenced_by", "q"), ("references", "q"), ("references", "A"), ("references", "p")]


def test_analyses_as_classes(spark):
    datasets = spark.createDataFrame([("A",), ("B",), ("A",), (None,), ("*",)], "dsn string")
    analyses = spark.createDataFrame([(1, ["A"]), (2, []), (3, None), (4, ["A", "A", "Z"]), (5, [None])], "analysis_id int, related array<string>")
    entries, members = structures.analyses_of_datasets(datasets, analyses)
    assert sorted(tuple(r) for r in entries.collect()) == [("*", 2), ("*", 3), ("A", 1), ("A", 4)]
    assert sorted(tuple(r) for r in structures.analysis_counts(entries, members).collect()) == [("A", 2, 2), ("B", 0, 2)]


def test_uploads_close_at_their_limits(spark, tmp_path):
    from granary.streaming import uploads

    def put(name, data):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)

    for name, data in {"good/a.cbl": b"x" * 5, "good/src/b.cpy": b"y" * 7, "good/keep": b"", "good/.gitkeep": b"", "empty/keep": b"", "large/a": b"z" * 30, "many/1": b"1", "many/2": b"2", "many/3": b"3"}.items():
        put(name, data)
    files = uploads.read(spark, f"file:{tmp_path}/in")
    limits = {"most_bytes": 20, "most_files": 2}
    closed = uploads.latest(files, **limits)
    assert {r.upload: (r.n_files, r.n_empty, r.n_bytes, r.reason) for r in closed.collect()} == {
        "good": (2, 0, 12, None), "large": (1, 0, 30, "file too large"), "many": (3, 0, 3, "too many files")}
    listed = spark.createDataFrame([("good", "a.cbl", 5), ("good", "keep", 0), ("large", "a", 30), (None, "x", 1)], uploads.FILES)
    assert [r.path for r in uploads.accepted(listed, closed).collect()] == ["a.cbl"]


def test_an_upload_stays_closed_over_batches(spark, tmp_path):
    from granary.streaming import uploads

    for i, (path, size) in enumerate([("../x", 1), ("ok", 2), ("fine", 3)]):
        spark.createDataFrame([("u", path, size), ("v", "f", 1), ("w", "e", 0), ("w", "n", None), (None, "p", 1)], uploads.FILES).coalesce(1).write.parquet(f"{tmp_path}/{i}")
    rows = spark.readStream.schema(uploads.FILES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = {r.upload: (r.n_files, r.n_empty, r.reason) for r in uploads.latest(rows, most_files=2).collect()}
    assert got == {"u": (3, 0, "unsafe path"), "v": (3, 0, "too many files"), "w": (0, 6, "no file")}


def test_events_rules_and_ddl_files(spark, tmp_path):
    from granary.operators import catalogs
    from granary.sources import repository

    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.json").write_text('[{"audit_id":"1","stage":"X"}, 5, "text"]')
    (tmp_path / "e" / "b.json").write_text('{"audit_id":"2"}\nnot json\n{"audit_id":"3"}')
    (tmp_path / "e" / "c.json").write_text("[broken")
    got = repository.read_events(spark, f"file://{tmp_path}/e", "audit_id string, stage string")
    assert sorted(r.audit_id for r in got.collect()) == ["1", "2", "3"]
    scripts = spark.createDataFrame([("b", "CREATE TABLE b (\n);"), ("a", "CREATE TABLE a (\n);")], "table_name string, ddl string")
    repository.write_ddl(scripts, f"file://{tmp_path}/ddl")
    assert spark.read.option("lineSep", "\n\n").text(f"file://{tmp_path}/ddl").count() == 2
    rules = spark.createDataFrame([("r1", 'say "x"\nand y')], "id string, rule string")
    repository.write_rules(rules, f"file://{tmp_path}/rules")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/rules")
    assert [tuple(r) for r in back.collect()] == [("r1", 'say "x"\nand y')]
    files = spark.createDataFrame([("ok", "[]"), ("bad", "{"), ("null", None)], "path string, content string")
    assert [tuple(r) for r in catalogs.json_errors(files).collect()] == [("bad", "malformed JSON")]
