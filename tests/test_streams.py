import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from golden import BASELINE, MODIFIED
from weft.operators.keyed_table import KeyedTable
from weft.plans import reports as V
from weft.plans.build import build
from weft.schemas import EDGES_TOPIC, LOG_ENVELOPE, METADATA, METADATA_TOPIC, NODES_TOPIC, SCOPES_TOPIC
from weft.operators.contract import envelope
from weft.operators.file_table import FileTable
from weft.sources.eventlog import append_log, read_log, route, stream_log
from weft.jobs import stream_jobs as J


def event(file, **changes):
    base = dict(
        schema_version="1.0", event_time="2024-01-01T00:00:00Z", repo_name="r", file_path=file,
        metadata_id=f"id-{file}", file_hash="h", line_count=1, function_count=0, class_count=0,
        import_count=0, node_count=1, edge_count=0, status="parsed",
    )
    return {k: v for k, v in (base | changes).items() if v != "drop"}


@pytest.fixture
def write_log(spark, tmp_path):
    """Append raw metadata records to a file log, one file per call."""
    offsets = iter(range(1000))

    def write(*values):
        rows = []
        for value in values:
            text = json.dumps(value) if isinstance(value, dict) else value
            data = None if text is None else bytearray(text.encode())
            rows.append((bytearray(b"k"), data, METADATA_TOPIC, 0, next(offsets), None))
        df = spark.createDataFrame(rows, LOG_ENVELOPE)
        df.coalesce(1).write.mode("append").partitionBy("topic").parquet(str(tmp_path / "log"))

    write.path = str(tmp_path / "log")
    return write


def run(spark, write_log, store):
    query = J.start_metadata(stream_log(spark, write_log.path, METADATA_TOPIC), store, available_now=True)
    query.awaitTermination()
    return query


def stored(store):
    return {r.metadata_id: r for r in store.read().collect()}


def test_stream_values(spark, write_log, tmp_path):
    write_log(
        event("a"), "{broken", event("b", line_count="x"), event("c", line_count=2.5), None,
        event("d", extra=1), event("e", metadata_id="drop"), event("f", repo_name="drop"),
        event("g", file_path=None),
    )
    store = J.metadata_table(spark, str(tmp_path / "table"))
    run(spark, write_log, store)
    rows = {r.file_path: r for r in store.read().collect()}
    assert set(rows) == {"a", "b", "c", "d", "e"}
    assert rows["b"].line_count is None and rows["c"].line_count is None
    assert rows["e"].metadata_id == spark.sql("SELECT sha2(concat_ws('\\u001f', 'r', 'e'), 256)").first()[0]
    assert all(r.ingested_at is not None and r.spark_batch_id == 0 for r in rows.values())
    rejected = spark.read.parquet(f"{store.rejects}/0").orderBy("offset").collect()
    assert [r.reject_reason for r in rejected] == ["malformed json", "malformed json", "missing repo_name", "missing file_path"]
    assert [r.value and bytes(r.value)[:7] for r in rejected][:2] == [b"{broken", None]


def test_resume_applies_nothing_twice(spark, write_log, tmp_path):
    store = J.metadata_table(spark, str(tmp_path / "table"))
    write_log(event("a"), event("b"))
    run(spark, write_log, store)
    before, artifacts = store.read().count(), V.checkpoint_artifacts(spark, store.checkpoint).count()
    idle = run(spark, write_log, store)
    assert sum(p.numInputRows for p in idle.recentProgress) == 0
    after = V.checkpoint_artifacts(spark, store.checkpoint).count()
    assert (before, artifacts) == (store.read().count(), after)
    assert V.resume_verdict(before, store.read().count(), after).startswith("result=PASSED")
    assert V.resume_verdict(2, 3, after).startswith("result=FAILED")
    write_log(event("a", file_hash="new"))
    run(spark, write_log, store)
    rows = stored(store)
    assert rows["id-a"].file_hash == "new" and rows["id-a"].spark_batch_id == 1
    assert rows["id-b"].spark_batch_id == 0


def test_latest_offset_wins_within_a_batch(spark, write_log, tmp_path):
    store = J.metadata_table(spark, str(tmp_path / "table"))
    write_log(*[event("a", node_count=i) for i in range(20)])
    run(spark, write_log, store)
    assert stored(store)["id-a"].node_count == 19


def test_whole_rows_are_replaced(spark, write_log, tmp_path):
    store = J.metadata_table(spark, str(tmp_path / "table"))
    write_log(event("a", line_count=5))
    run(spark, write_log, store)
    write_log(event("a", line_count="drop"))
    run(spark, write_log, store)
    assert stored(store)["id-a"].line_count is None


def test_reset_starts_over(spark, write_log, tmp_path):
    store = J.metadata_table(spark, str(tmp_path / "table"))
    write_log(event("a"))
    run(spark, write_log, store)
    store.reset()
    assert store.read().count() == 0
    run(spark, write_log, store)
    assert set(stored(store)) == {"id-a"}


def test_keyed_table_against_a_model(spark, tmp_path):
    schema = METADATA.__class__.fromDDL("k string, v int")
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["k"], ["v"])
    assert table.read().count() == 0
    rng, model = random.Random(5), {}
    history = {}
    for seq in range(6):
        history[seq] = dict(model)
        rows = {f"k{rng.randrange(12)}": rng.randrange(99) for _ in range(6)}
        batch = spark.createDataFrame(list(rows.items()), schema)
        table.upsert(batch, seq)
        if seq % 2:
            table.upsert(batch, seq)  # the retry of a batch changes nothing
        model |= rows
        if seq in (2, 4):
            gone = sorted(model)[:2]
            for key in gone:  # two deletes between the same batches
                table.delete(table.read().where(F.col("k") == key))
            model = {k: v for k, v in model.items() if k not in gone}
        if seq == 3:
            table.compact()
            table.delete(table.read().where(F.col("k") == min(model)))
            del model[min(model)]
        assert {r.k: r.v for r in table.read().collect()} == model
    assert {r.k: r.v for r in table.read(before=5).collect()} == history[5]
    some = sorted(model)[::2]
    read = table.read(only=F.col("k").isin(*some)).collect()
    assert {r.k: r.v for r in read} == {k: model[k] for k in some}
    gone = set("k%d" % i for i in range(12)) - set(model)
    assert table.read(only=F.col("k").isin("none", *gone)).count() == 0


FILE_ROWS = "id string, repo_name string, file_path string, v int"


def test_file_table_against_a_model(spark, tmp_path):
    table = FileTable(spark, str(tmp_path / "t"), METADATA.__class__.fromDDL(FILE_ROWS), buckets=4)
    rng, model = random.Random(6), {}
    assert table.read().count() == 0 and table.read("r", "f1").count() == 0

    def check():
        assert {r.id: (r.file_path, r.v) for r in table.read().collect()} == model
        for file in ("f0", "f3"):
            mine = {k: v for k, v in model.items() if v[0] == file}
            assert {r.id: (r.file_path, r.v) for r in table.read("r", file).collect()} == mine

    for step in range(5):
        files = [f"f{rng.randrange(8)}" for _ in range(4)]
        rows = {f"{f}/{rng.randrange(5)}": (f, rng.randrange(99)) for f in files}
        gone = {f"f{rng.randrange(8)}" for _ in range(step)}
        batch = spark.createDataFrame([(k, "r", f, v) for k, (f, v) in rows.items()], FILE_ROWS)
        scope = spark.createDataFrame([("r", f) for f in gone], "repo_name string, file_path string")
        for _ in range(1 + step % 2):  # the retry of a batch changes nothing
            table.apply(batch, scope)
        model = {k: v for k, v in model.items() if v[0] not in gone} | rows
        check()
    some = spark.createDataFrame([("r", "f1"), ("r", "f2")], "repo_name string, file_path string")
    found = table.read_files(some)
    assert {r.id for r in found.collect()} == {k for k, v in model.items() if v[0] in ("f1", "f2")}
    table.delete(found)
    model = {k: v for k, v in model.items() if v[0] not in ("f1", "f2")}
    check()
    # Every row gone: the folders are emptied, not left as they were.
    table.delete(table.read())
    model = {}
    check()


def test_one_file_rewrites_one_folder(spark, tmp_path):
    table = FileTable(spark, str(tmp_path / "t"), METADATA.__class__.fromDDL(FILE_ROWS), buckets=16)
    rows = [(f"{f}/{i}", "r", f"f{f}", i) for f in range(200) for i in range(3)]
    table.apply(spark.createDataFrame(rows, FILE_ROWS))

    def parts():
        return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*.parquet")}

    before = parts()
    assert len(before) >= 16
    one = spark.createDataFrame([("7/9", "r", "f7", 9)], FILE_ROWS)
    table.apply(one, one.select("repo_name", "file_path"))
    after = parts()
    assert len({p.rsplit("/", 2)[1] for p in before.keys() ^ after.keys()}) == 1
    assert [r.id for r in table.read("r", "f7").collect()] == ["7/9"] and table.read().count() == 598
    assert len({p.rsplit("/", 2)[1] for p in table.read("r", "f7").inputFiles()}) >= 1
    plan = table.read("r", "f7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_scope_records_act_in_their_place(spark, sources, tmp_path):
    """Events, a scope and newer events in one batch, in several ones, and with a batch applied again."""
    log = str(tmp_path / "log")
    publish(sources, log, {"probe.py": BASELINE, "other.py": b"x = 1\n"})
    scope = spark.createDataFrame([("example", "probe.py"), ("example", "gone.py")], "repo_name string, file_path string")
    append_log(route(scopes=envelope(scope, F.lit("2024-01-01T00:00:00Z"))), log, 1 << 50)
    publish(sources, log, {"probe.py": MODIFIED}, first_offset=1 << 51)
    logs = {t: read_log(spark, log).where(F.col("topic").isin(t, SCOPES_TOPIC)) for t in (NODES_TOPIC, EDGES_TOPIC)}

    def state(store):
        return {r.id for r in store.nodes.read().collect()}, {r.id for r in store.edges.read().collect()}

    at_once = J.GraphStore(spark, str(tmp_path / "at_once"))
    at_once.apply_nodes(logs[NODES_TOPIC], 0)
    at_once.apply_edges(logs[EDGES_TOPIC], 0)
    want = state(at_once)
    assert [len(part) for part in want] == [14 + 5, 26 + 8]
    assert at_once.placeholders().count() == 0

    stepwise = J.GraphStore(spark, str(tmp_path / "stepwise"))
    cuts = [0, 1 << 50, 1 << 51, 1 << 62]
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = (F.col("offset") >= low) & (F.col("offset") < high)
        for _ in range(2):
            stepwise.apply_edges(logs[EDGES_TOPIC].where(part), batch)
            stepwise.apply_nodes(logs[NODES_TOPIC].where(part), batch)
        if batch == 1:
            assert [len(part) for part in state(stepwise)] == [5, 8]
    assert state(stepwise) == want


def publish(sources, path, files, first_offset=0):
    build(sources(files)).publish(path, first_offset)


def graph(store):
    return (
        {r.id for r in store.nodes.read().collect()},
        {(r.id, r.type) for r in store.edges.read().collect()},
        {r.id: r.file_hash for r in store.files.read().collect()},
        {r.name for r in store.repositories.read().collect()},
        {r.id for r in store.placeholders().collect()},
    )


def test_graph_jobs_in_any_order(spark, sources, tmp_path):
    log = str(tmp_path / "log")
    publish(sources, log, {"a.py": MODIFIED, "b.py": BASELINE})
    nodes, edges = read_log(spark, log, NODES_TOPIC), read_log(spark, log, EDGES_TOPIC)

    streamed = J.GraphStore(spark, str(tmp_path / "streamed"))
    for job in J.start_graph(
        stream_log(spark, log, NODES_TOPIC), stream_log(spark, log, EDGES_TOPIC), streamed, available_now=True
    ):
        job.awaitTermination()
    want = graph(streamed)
    assert [len(part) for part in want] == [24, 44, 2, 1, 0]

    edges_first = J.GraphStore(spark, str(tmp_path / "edges_first"))
    edges_first.apply_edges(edges, 0)
    assert edges_first.placeholders().count() == 24
    edges_first.apply_nodes(nodes, 0)
    assert graph(edges_first) == want

    mixed = J.GraphStore(spark, str(tmp_path / "mixed"))
    half = F.col("offset") % 2 == 0
    mixed.apply_nodes(nodes.where(half), 0)
    mixed.apply_edges(edges.where(~half), 0)
    mixed.apply_edges(edges.where(~half), 0)
    mixed.apply_edges(edges.where(half), 1)
    mixed.apply_nodes(nodes.where(~half), 1)
    assert graph(mixed) == want


def test_replay_with_and_without_cleanup(spark, sources, tmp_path):
    log = str(tmp_path / "log")
    publish(sources, log, {"probe.py": BASELINE, "other.py": b"x = 1\n"})
    store = J.GraphStore(spark, str(tmp_path / "graph"))

    def apply(batch_id, first):
        for topic, job in ((NODES_TOPIC, store.apply_nodes), (EDGES_TOPIC, store.apply_edges)):
            job(read_log(spark, log, topic).where(F.col("offset") >= first), batch_id)

    def probe():
        mine = "file_path = 'probe.py'"
        return store.nodes.read().where(mine).count(), store.edges.read().where(mine).count()

    apply(0, 0)
    assert probe() == (10, 18)
    publish(sources, log, {"probe.py": MODIFIED}, first_offset=1 << 50)
    apply(1, 1 << 50)
    assert probe() == (14, 27)
    scope = spark.createDataFrame([("example", "probe.py")], "repo_name string, file_path string")
    assert store.delete_files(scope).count() == 14
    assert probe() == (0, 0)
    assert store.delete_files(scope).count() == 0
    assert store.nodes.read().where("file_path = 'other.py'").count() == 5
    apply(2, 1 << 50)
    assert probe() == (14, 26)
    assert store.placeholders().count() == 0


def test_bad_records_are_kept_aside(spark, sources, tmp_path):
    log = str(tmp_path / "log")
    publish(sources, log, {"a.py": b"x = 1\n"})
    edges = read_log(spark, log, EDGES_TOPIC)
    wrong = edges.limit(1).select(
        *[c for c in edges.columns if c != "value"],
        F.regexp_replace(F.col("value").cast("string"), '"(AST|CFG)"', '"XXX"').cast("binary").alias("value"),
    )
    broken = wrong.withColumn("value", F.lit("{").cast("binary"))
    store = J.GraphStore(spark, str(tmp_path / "graph"))
    store.apply_edges(edges.unionByName(wrong).unionByName(broken), 0)
    assert store.edges.read().count() == edges.count()
    rejected = spark.read.parquet(f"{store.rejects}/{EDGES_TOPIC}/0")
    assert {r.reject_reason for r in rejected.collect()} == {"bad edge_type", "malformed json"}


def test_placeholders_come_and_go(spark, sources, tmp_path):
    """Edges first, half of the nodes, all events again, then the other half: every id is reported and resolved once."""
    full, log, out = (str(tmp_path / name) for name in ("full", "log", "out"))
    publish(sources, full, {"a.py": MODIFIED})
    nodes, edges = (read_log(spark, full, topic) for topic in (NODES_TOPIC, EDGES_TOPIC))
    half = F.col("offset") % 2 == 0
    seen = []
    for part in (edges, nodes.where(half), edges.unionByName(nodes.where(half)), nodes.where(~half)):
        part.write.mode("append").partitionBy("topic").parquet(log)
        J.start_placeholders(stream_log(spark, log, NODES_TOPIC, EDGES_TOPIC), out, available_now=True).awaitTermination()
        seen.append(sorted((r.change, r.id) for r in spark.read.parquet(f"{out}/changes").collect()))
    ids = sorted(json.loads(r.value)["node_id"] for r in nodes.collect())
    assert seen[0] == [("placeholder", i) for i in ids]
    assert len(seen[1]) == len(ids) + nodes.where(half).count() and seen[2] == seen[1]
    assert seen[3] == [("placeholder", i) for i in ids] + [("resolved", i) for i in ids]


def test_document_store_options():
    options = J.DOCUMENT_UPSERT_OPTIONS
    assert options["idFieldList"] == "metadata_id"
    assert options["operationType"] == "replace"
    assert options["upsertDocument"] == "true"


def test_placeholders_of_many_ids_share_a_group(spark, sources, tmp_path, monkeypatch):
    """Python is called per group of ids, not per id, and the changes are the same for any number of groups."""
    calls = tmp_path / "calls"
    calls.mkdir()
    resolve = J._resolve

    def counted(key, parts, state):
        (calls / uuid.uuid4().hex).touch()
        return resolve(key, parts, state)

    monkeypatch.setattr(J, "STATE_GROUPS", 2)
    monkeypatch.setattr(J, "_resolve", counted)
    log, out, full = (str(tmp_path / name) for name in ("log", "out", "full"))
    publish(sources, full, {"a.py": MODIFIED})
    nodes, edges = (read_log(spark, full, topic) for topic in (NODES_TOPIC, EDGES_TOPIC))
    half = F.col("offset") % 2 == 0
    for part in (edges.unionByName(nodes.where(half)), nodes.where(~half), edges):
        part.write.mode("append").partitionBy("topic").parquet(log)
        J.start_placeholders(stream_log(spark, log, NODES_TOPIC, EDGES_TOPIC), out, available_now=True).awaitTermination()
    changes = spark.read.parquet(f"{out}/changes")
    late = {i for (i,) in nodes.where(~half).select(F.get_json_object(F.col("value").cast("string"), "$.node_id")).collect()}
    for kind in ("placeholder", "resolved"):
        found = [r.id for r in changes.where(F.col("change") == kind).collect()]
        assert len(found) == len(set(found)) and set(found) == late
    assert 0 < len(list(calls.iterdir())) <= 2 * 3
