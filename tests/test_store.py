import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from verdigris.operators.compaction import CompactionRefused
from verdigris.operators.fabric import FeatureTable
from verdigris.operators.merging import ConcurrentChangeError, NotReconciledError, OpenSessionError, ReconcileOptions
from verdigris.sources.editing import SessionClosedError
from verdigris.sources.enterprise import is_transient, retried_once
from verdigris.sources.geodatabase import QueryOptions, create_geodatabase, jdbc_table, open_geodatabase, parse_connection_string
from verdigris.sources.store import LockTimeoutError, ReadWriteLock, SnapshotMovedError, file_lock, stale_locks


@pytest.fixture
def gdb(spark, tmp_path):
    base = spark.createDataFrame([(i, f"v{i}", float(i)) for i in range(1, 6)], "objectid long, val string, size double")
    adds = spark.createDataFrame([], "objectid long, sde_state_id long, val string, size double")
    deletes = spark.createDataFrame([], "sde_deletes_row_id long, sde_state_id long, deleted_at long")
    return create_geodatabase(spark, str(tmp_path / "store"), {"parcels": FeatureTable("parcels", base, adds, deletes, 18)})


def values(gdb, version):
    return {r.objectid: r.val for r in gdb.open_table("Parcels").query(QueryOptions(version=version)).collect()}


def test_edit_undo_save_and_read(gdb):
    gdb.create_version("v1")
    with gdb.edit("sde.v1") as s:
        new = s.insert("parcels", {"VAL": "new", "size": 9.0})
        assert new == 6
        assert s.update("parcels", 2, {"val": "two"}) and s.delete("parcels", 3)
        assert not s.update("parcels", new, {"val": "x"}), "a row of this session is not found"
        assert s.delete("parcels", 1) and s.undo() and s.can_redo and s.undo_count == 3
        assert s.has_unsaved_changes and s.modified_tables == {"parcels"}
        s.save()
        assert s.state == "saved"
        with pytest.raises(SessionClosedError):
            s.insert("parcels", {})
    gdb.refresh()
    assert values(gdb, "sde.v1") == {1: "v1", 2: "two", 4: "v4", 5: "v5", 6: "new"}
    assert values(gdb, "DEFAULT") == {i: f"v{i}" for i in range(1, 6)}
    assert gdb.open_table("parcels").count() == 5
    assert [(r.n_adds, r.n_deletes) for r in gdb.version_statistics("sde.v1")] == [(2, 2)]


def test_delete_of_an_updated_row_and_repeated_delete(gdb):
    with gdb.edit() as s:
        s.update("parcels", 1, {"val": "x"})
        s.update("parcels", 1, {"val": "y"})
        s.delete("parcels", 1)
        s.delete("parcels", 2)
        s.delete("parcels", 2)
        s.save()
    gdb.refresh()
    assert sorted(values(gdb, "DEFAULT")) == [3, 4, 5]
    assert gdb.fabric.tables["parcels"].deletes.count() == 3


def test_second_session_loses(gdb):
    one, two = gdb.edit(), gdb.edit()
    one.delete("parcels", 1)
    two.delete("parcels", 2)
    one.save()
    with pytest.raises(ConcurrentChangeError):
        two.save()
    two.discard()
    assert two.state == "discarded"


def test_reconcile_post_compact(gdb):
    gdb.create_version("v1")
    with gdb.edit_transaction("sde.v1") as s:
        s.update("parcels", 1, {"val": "child"})
        s.insert("parcels", {"val": "added"})
    with gdb.edit_transaction() as s:
        s.update("parcels", 1, {"size": 77.0})
        s.delete("parcels", 5)
    with pytest.raises(NotReconciledError):
        gdb.post_version("sde.v1")
    assert gdb.reconcile_version("sde.v1", ReconcileOptions(detect_only=True)).conflict_count == 1
    done = gdb.reconcile_version("sde.v1")
    assert done.applied and done.merged_count == 1 and done.common_ancestor_state_id == 0
    merged = gdb.open_table("parcels").query(QueryOptions(version="sde.v1", where="objectid = 1")).first()
    assert (merged.val, merged["size"]) == ("child", 77.0)
    assert sorted(values(gdb, "sde.v1")) == [1, 2, 3, 4, 6]
    posted = gdb.post_version("sde.v1", delete_version=True)
    assert posted.changes_posted > 0 and gdb.get_version("sde.v1") is None
    seen = values(gdb, "DEFAULT")
    assert sorted(seen) == [1, 2, 3, 4, 6]
    with pytest.raises(CompactionRefused):
        gdb.compact()
    result = gdb.compact(acknowledge_experimental_unsafe=True, graduate=True, collapse_lineages=True, verify=True, bypass_closure_gate=True)
    assert result.self_check and result.graduated_upserts == 2
    assert values(gdb, "DEFAULT") == seen and gdb.open_table("parcels").count() == 5


def test_compaction_waits_for_editors(gdb):
    with gdb.edit():
        assert gdb.compact(acknowledge_experimental_unsafe=True, wait_seconds=0.1).deferred == "editors-active"


def test_ids_are_given_out_once(gdb):
    for name in ("a", "b"):
        gdb.create_version(name)
    one, two = gdb.edit("sde.a"), gdb.edit("sde.b")
    ids = [one.insert("parcels", {"val": "a"}), two.insert("parcels", {"val": "b"}), *two.insert_many("parcels", [{}, {}]), one.insert("parcels", {})]
    assert len(set(ids)) == 5 and one.current_state_id != two.current_state_id
    two.save()
    one.save()
    assert gdb.open_table("parcels").insert({"val": "base"}) > max(ids)
    gdb.refresh()
    assert gdb.fabric.tables["parcels"].adds.groupBy("objectid").count().filter("count > 1").isEmpty()


def test_states_are_never_used_again(gdb):
    gdb.create_version("a")
    with gdb.edit_transaction("sde.a") as s:
        s.update("parcels", 1, {"val": "x"})
        dead = s.current_state_id
    gdb.delete_version("sde.a")
    assert gdb.compact(acknowledge_experimental_unsafe=True).states_removed == 1
    with gdb.edit_transaction() as s:
        s.update("parcels", 1, {"val": "y"})
        assert s.current_state_id > dead


def test_an_open_session_locks_its_state(gdb):
    gdb.create_version("a")
    with gdb.edit_transaction() as s:
        s.update("parcels", 3, {"val": "parent"})
    with gdb.edit("sde.a") as s:
        s.update("parcels", 1, {"val": "x"})
        gdb.refresh()
        assert [r.state_id for r in gdb.fabric.locks.collect()] == [s.current_state_id] and not gdb.fabric.states.filter(F.col("state_id") == s.current_state_id).isEmpty()
    gdb.refresh()
    assert gdb.fabric.locks.isEmpty() and gdb.fabric.states.filter(F.col("state_id") == s.current_state_id).isEmpty() and s.state == "closed"
    with gdb.edit_transaction("sde.a") as s:
        s.update("parcels", 1, {"val": "x"})
    with gdb.edit("sde.a"), pytest.raises(OpenSessionError):
        gdb.rebase_version("sde.a", unsafe_experimental=True)


def test_an_edit_writes_its_own_rows_only(spark, tmp_path):
    base = spark.range(1, 20_001).selectExpr("id as objectid", "repeat(uuid(), 4) as val")
    adds = spark.range(1, 20_001).selectExpr("id as objectid", "0L as sde_state_id", "repeat(uuid(), 4) as val").filter("objectid > 10000")
    deletes = spark.createDataFrame([], "sde_deletes_row_id long, sde_state_id long, deleted_at long")
    big = create_geodatabase(spark, str(tmp_path / "big"), {"t": FeatureTable("t", base, adds, deletes, 5)})
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "big").rglob("*.parquet"))
    before = size()
    with big.edit_transaction() as s:
        s.update("t", 7, {"val": "x"})
    assert before > 1_000_000 and size() - before < 60_000
    assert big.open_table("t").query(QueryOptions(version="DEFAULT", where="objectid = 7")).first().val == "x"
    assert big.store.clean(0) > 0 and big.open_table("t").query(QueryOptions(version="DEFAULT")).count() == 20_000
    one = big.store.read()
    big.store.commit(one, one.fabric)
    folders = {p.name for p in (tmp_path / "big").iterdir()}
    with pytest.raises(SnapshotMovedError):
        big.store.commit(one, replace(one.fabric, versions=one.fabric.versions.filter("false")))
    assert {p.name for p in (tmp_path / "big").iterdir()} == folders, "a refused commit leaves nothing"


def test_transactions(gdb):
    table = gdb.open_table("parcels")
    with gdb.transaction():
        assert table.insert({"val": "a"}) == 6
        with gdb.transaction():
            assert table.update(6, {"val": "b"}) and not table.update(99, {"val": "c"}) and not table.update(1, {"objectid": 5})
        assert gdb.in_transaction
    assert table.get_feature(6)["attributes"]["val"] == "b"
    with pytest.raises(ZeroDivisionError), gdb.transaction():
        table.delete(6)
        raise ZeroDivisionError
    assert table.count() == 6
    assert table.delete_many([6, 1, 77]) == 2 and table.count("size > 2") == 3
    assert table.insert_many([]) == [] and table.get_features([]) == []
    assert [f["id"] for f in table.stream(QueryOptions(order_by=("objectid desc",), limit=2))] == [5, 4]


def test_rebase_and_revert(gdb):
    gdb.create_version("v1")
    with gdb.edit_transaction("sde.v1") as s:
        s.update("parcels", 1, {"val": "child"})
        s.delete("parcels", 2)
    with gdb.edit_transaction() as s:
        s.update("parcels", 3, {"val": "parent"})
    assert gdb.revert_features("sde.v1", [("parcels", 2), ("parcels", 99)]) == 2
    assert values(gdb, "sde.v1") == {1: "child", 2: "v2", 3: "v3", 4: "v4", 5: "v5"}
    assert gdb.rebase_version("sde.v1", dry_run=True).outcomes == {"replay": 1}
    with pytest.raises(PermissionError):
        gdb.rebase_version("sde.v1")
    before = {(r.objectid, r.sde_state_id) for r in gdb.fabric.tables["parcels"].adds.collect()}
    done = gdb.rebase_version("sde.v1", unsafe_experimental=True)
    tip, parent = done.new_state_id, gdb.fabric.tip("sde.DEFAULT")
    assert {(r.objectid, r.sde_state_id) for r in gdb.fabric.tables["parcels"].adds.collect()} - before == {(1, tip)}
    assert [r.sde_state_id for r in gdb.fabric.tables["parcels"].deletes.collect() if r.sde_state_id == tip] == [], "an update needs no marker"
    assert {r.lineage_id for r in gdb.fabric.lineages.filter(F.col("lineage_name") == tip).collect()} == {0, parent, tip}
    assert gdb.rebase_version("sde.v1").already_current
    assert values(gdb, "sde.v1") == {1: "child", 2: "v2", 3: "parent", 4: "v4", 5: "v5"}


def test_versions(gdb):
    assert gdb.create_version("A") == "sde.A"
    assert gdb.create_version("a", name_rule="UNIQUE") == "sde.a1"
    with pytest.raises(ValueError):
        gdb.create_version("a")
    gdb.create_version("child", parent="sde.A")
    for name in ("sde.A", "DEFAULT"):
        with pytest.raises(ValueError):
            gdb.delete_version(name)
    gdb.delete_version("CHILD")
    gdb.start_editing("sde.a")
    assert gdb.editing and gdb.current_version == "sde.a" and gdb.lineage("sde.a") is None
    with pytest.raises(KeyError):
        gdb.set_current_version("nobody")
    gdb.stop_editing()
    view = gdb.register_version_view("parcels", "sde.A")
    with pytest.raises(KeyError):
        gdb.open_view(f"x.{view}")
    handle = gdb.open_view(view)
    assert handle.read_only and handle.count() == 5
    with pytest.raises(PermissionError):
        handle.insert({})
    assert gdb.sql("select count(*) n from parcels where size > :least", least=3).first().n == 2


def test_snapshots_and_locks(gdb, spark, tmp_path):
    one, two = gdb.store.read(), gdb.store.read()
    gdb.store.commit(one, one.fabric)
    with pytest.raises(SnapshotMovedError):
        gdb.store.commit(two, two.fabric)
    path = tmp_path / "x.lock"
    with file_lock(path, False, 1), file_lock(path, False, 1), pytest.raises(LockTimeoutError), file_lock(path, True, 0.05):
        pass
    locks = spark.createDataFrame([(1, 5, "2024-01-01"), (2, 5, "2024-01-01"), (3, 5, "2024-02-01")], "sde_id int, state_id long, t string").select("sde_id", "state_id", F.to_timestamp("t").alias("lock_time"))
    live = spark.createDataFrame([(2,)], "sde_id int")
    assert [r.sde_id for r in stale_locks(locks, live, "2024-02-01").collect()] == [1]
    assert open_geodatabase(spark, gdb.source).list_tables() == ["parcels"]


def test_read_write_lock():
    lock, order = ReadWriteLock(), []
    reading = threading.Event()

    def reader():
        with lock.read():
            reading.set()
            time.sleep(0.1)
            order.append("r")

    def writer():
        with lock.write():
            order.append("w")

    threads = [threading.Thread(target=reader), threading.Thread(target=writer)]
    threads[0].start()
    reading.wait()
    threads[1].start()
    time.sleep(0.03)
    late = threading.Thread(target=reader)
    late.start()
    for t in (*threads, late):
        t.join()
    assert order == ["r", "w", "r"]


def test_connection_strings(spark):
    config = parse_connection_string("postgresql://u:secret@host/db")
    assert (config["driver"], config["port"], config["database"]) == ("postgresql", 5432, "db") and "secret" not in config["source"]
    assert parse_connection_string("sqlserver://h/d")["port"] == 1433
    assert parse_connection_string("/data/x")["type"] == "file"
    with pytest.raises(ValueError):
        parse_connection_string("oracle://h/d")
    with pytest.raises(Exception, match="(?i)driver|class"):
        jdbc_table(spark, config, "t")


def test_a_database_server(spark):
    """The server's fabric over JDBC, with the database that comes with Spark in place of a server."""
    url = "jdbc:derby:memory:fabric;create=true"
    spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    statement = spark._jvm.java.sql.DriverManager.getConnection(url).createStatement()
    for text in (
        "create schema sde", "create schema cad",
        "create table sde.sde_states (state_id bigint, parent_state_id bigint, lineage_name bigint)", "insert into sde.sde_states values (0, 0, 0), (1, 0, 1), (2, 1, 2)",
        "create table sde.sde_state_lineages (lineage_name bigint, lineage_id bigint)", "insert into sde.sde_state_lineages values (0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)",
        "create table sde.sde_versions (owner varchar(9), name varchar(9), parent_name varchar(20), state_id bigint)",
        "insert into sde.sde_versions values ('sde', 'DEFAULT', null, 1), ('sde', 'v', 'sde.DEFAULT', 2)",
        "create table sde.sde_state_locks (sde_id int, state_id bigint, lock_time timestamp)",
        "create table sde.sde_table_registry (registration_id int, owner varchar(9), table_name varchar(9), object_flags int)", "insert into sde.sde_table_registry values (7, 'cad', 'lots', 8), (8, 'cad', 'notes', 1)",
        "create table cad.lots (objectid bigint, val varchar(9))", "insert into cad.lots values (1, 'a'), (2, 'b')",
        "create table cad.a7 (objectid bigint, sde_state_id bigint, val varchar(9))", "insert into cad.a7 values (3, 1, 'c'), (1, 2, 'A')",
        "create table cad.d7 (sde_deletes_row_id bigint, sde_state_id bigint, deleted_at bigint)", "insert into cad.d7 values (1, 2, 2), (2, 2, 2)",
    ):
        statement.execute(text)
    server = open_geodatabase(spark, {"type": "enterprise", "driver": "derby", "url": url, "source": "derby://fabric"})
    assert server.list_tables() == ["lots"] and [v["name"] for v in server.list_versions()] == ["DEFAULT", "v"]
    read = lambda version: {r.objectid: r.val for r in server.open_table("LOTS").query(QueryOptions(version=version)).collect()}
    assert read(None) == {1: "a", 2: "b"} and read("DEFAULT") == {1: "a", 2: "b", 3: "c"} and read("v") == {1: "A", 3: "c"}
    assert server.lineage("sde.v") == [2, 1] and [(r.n_adds, r.n_deletes) for r in server.version_statistics("v")] == [(2, 2)]
    for write in (lambda: server.create_version("x"), lambda: server.edit(), lambda: server.compact(), lambda: server.reconcile_version("v"), lambda: server.open_table("lots").delete(1)):
        with pytest.raises(PermissionError):
            write()


def test_transient_faults():
    calls = []

    def read(message):
        calls.append(message)
        raise RuntimeError(message)

    assert is_transient(RuntimeError("Connection reset by peer")) and not is_transient(RuntimeError("syntax error near FROM"))
    for message, tries in (("deadlock detected", 2), ("no such table", 1)):
        calls.clear()
        with pytest.raises(RuntimeError):
            retried_once(lambda m=message: read(m), 0)
        assert len(calls) == tries
