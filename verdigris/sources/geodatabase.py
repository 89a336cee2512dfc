"""The store behind one object: tables, versions, edits, merging and compaction, each change in one commit."""

from __future__ import annotations

import contextlib
import logging
import os
from dataclasses import dataclass, replace
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import changes, compaction, merging, versioned
from verdigris.operators.fabric import ROOT, Fabric, FeatureTable, VersionNotFoundError, append_rows, state_set
from verdigris.operators.spatial import spatial_filter
from verdigris.sources.catalog import list_versions, to_feature
from verdigris.sources.editing import NOT_WRITABLE, EditSession, ReadOnlyError
from verdigris.sources.enterprise import read_fabric
from verdigris.sources.store import LockTimeoutError, Snapshot, SnapshotMovedError, SnapshotStore

log = logging.getLogger("verdigris")
DEFAULT = "sde.DEFAULT"


def parse_connection_string(uri: str) -> dict:
    """driver, server, port, database, user of a uri, or the folder of snapshots; the password is left out of `source`."""
    if "://" not in uri or uri.startswith("file://"):
        return {"type": "file", "path": uri.removeprefix("file://")}
    parts = urlparse(uri)
    ports = {"sqlserver": 1433, "postgresql": 5432, "postgres": 5432}
    if parts.scheme not in ports:
        raise ValueError(f"unknown driver {parts.scheme}")
    driver = "postgresql" if parts.scheme.startswith("postgres") else parts.scheme
    port, database = parts.port or ports[parts.scheme], parts.path.strip("/")
    return {
        "type": "enterprise",
        "driver": driver,
        "server": parts.hostname,
        "port": port,
        "database": database,
        "user": parts.username,
        "password": parts.password,
        "source": f"{driver}://{parts.hostname}:{port}/{database}",
    }


def jdbc_table(spark: SparkSession, config: dict, name: str, key: str = "objectid", partitions: int = 1, bounds: tuple[int, int] | None = None, fetch_size: int = 100) -> DataFrame:
    """A table of a database server, read in `partitions` ranges of `key`. The server's driver must be on the class path."""
    urls = {"sqlserver": "jdbc:sqlserver://{server}:{port};databaseName={database}", "postgresql": "jdbc:postgresql://{server}:{port}/{database}"}
    reader = spark.read.format("jdbc").option("url", config.get("url") or urls[config["driver"]].format(**config)).option("dbtable", name).option("fetchsize", fetch_size)
    for option in ("user", "password"):
        if config.get(option):
            reader = reader.option(option, config[option])
    if bounds and partitions > 1:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


@dataclass(frozen=True)
class QueryOptions:
    where: str | None = None
    out_fields: tuple[str, ...] | None = None
    order_by: tuple[str, ...] | None = None
    limit: int | None = None
    offset: int | None = None
    version: str | None = None
    geometry: object | None = None
    spatial_relationship: str = "intersects"
    distance: float | None = None
    return_distance: bool = False


class Table:
    """A handle of one table. Reads without a version see the base rows."""

    def __init__(self, gdb: Geodatabase, name: str, rows: DataFrame | None = None, shape_field: str | None = None):
        self._gdb, self.name, self._view, self._shape = gdb, name, rows, shape_field

    @property
    def read_only(self) -> bool:
        return self._view is not None

    @property
    def source(self) -> FeatureTable:
        return self._gdb.fabric.tables[self.name]

    @property
    def shape_field(self) -> str | None:
        return self._shape if self.read_only else self.source.shape_field

    @property
    def registration_id(self) -> int | None:
        return None if self.read_only else self.source.registration_id

    @property
    def is_versioned(self) -> bool:
        return self.registration_id is not None

    @property
    def fields(self):
        return (self._view if self.read_only else self.source.base).schema.fields

    def _rows(self, version: str | None) -> DataFrame:
        if self.read_only:
            return self._view
        if version is None:
            return self.source.base
        if not self.is_versioned:
            raise ValueError(f"{self.name} is not versioned")
        return versioned.read_version(self._gdb.fabric, self.name, version)

    def query(self, options: QueryOptions = QueryOptions()) -> DataFrame:
        """Rows by the options; the spatial test comes after the version is resolved. The distance is returned without a version only."""
        rows = self._rows(options.version)
        if options.geometry is not None:
            if not self.shape_field:
                raise ValueError(f"{self.name} has no shape field")
            rows = spatial_filter(rows, options.geometry, options.spatial_relationship, options.distance, self.shape_field, None, options.return_distance and options.version is None)
        return versioned.read_options(rows, options.where, list(options.out_fields) if options.out_fields else None, list(options.order_by) if options.order_by else None, options.limit, options.offset)

    def stream(self, options: QueryOptions = QueryOptions()):
        """The features one by one; partitions are fetched ahead."""
        for row in self.query(options).toLocalIterator(prefetchPartitions=True):
            yield to_feature(row, self.shape_field)

    def get_feature(self, objectid: int) -> dict | None:
        return next(iter(self.get_features([objectid])), None)

    def get_features(self, objectids: list[int]) -> list[dict]:
        """Base rows of the ids."""
        if not objectids:
            return []
        rows = self._rows(None).filter(F.col("objectid").isin([int(i) for i in objectids]))
        return [to_feature(r, self.shape_field) for r in rows.collect()]

    def count(self, where: str | None = None) -> int:
        rows = self._rows(None)
        return (rows.filter(where) if where else rows).count()

    def read_feature_at_state(self, objectid: int, ancestor: int, version: str = DEFAULT) -> dict | None:
        tip = self._gdb.fabric.tip(version)
        states = state_set(self._gdb.spark, self._gdb.fabric.tree().walk(tip))
        row = versioned.feature_at_state(self.source, objectid, ancestor, states).first()
        return to_feature(row, self.shape_field) if row is not None else None

    def _changed(self, change) -> None:
        """Commits change(base) as the base rows."""
        if self.read_only:
            raise ReadOnlyError(self.name)
        self._gdb._commit(lambda f: f.with_table(replace(f.tables[self.name], base=change(f.tables[self.name].base))))

    def insert(self, attributes: dict) -> int:
        return self.insert_many([attributes])[0]

    def insert_many(self, rows: list[dict]) -> list[int]:
        """New base rows with new object ids."""
        if self.read_only:
            raise ReadOnlyError(self.name)
        if not rows:
            return []
        schema, ids = self.source.base.schema, list(self._gdb.store.take_object_ids(self.name, len(rows)))
        lowered = [{k.lower(): v for k, v in r.items() if k.lower() not in NOT_WRITABLE} | {"objectid": i} for i, r in zip(ids, rows)]
        new = self._gdb.spark.createDataFrame([tuple(r.get(f.name.lower()) for f in schema.fields) for r in lowered], schema).coalesce(1)
        self._changed(lambda base: append_rows(base, new))
        return ids

    def update(self, objectid: int, attributes: dict) -> bool:
        given = {k.lower(): v for k, v in attributes.items() if k.lower() not in NOT_WRITABLE}
        if not given or self.get_feature(objectid) is None:
            return False
        kinds = {f.name: f.dataType for f in self.source.base.schema.fields}
        own = F.col("objectid") == objectid
        columns = [F.when(own, F.lit(given[c.lower()]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c.lower() in given else F.col(c) for c in kinds]
        self._changed(lambda base: base.select(*columns))
        return True

    def delete(self, objectid: int) -> bool:
        return self.delete_many([objectid]) == 1

    def delete_many(self, objectids: list[int]) -> int:
        if self.read_only:
            raise ReadOnlyError(self.name)
        gone = self.source.base.filter(F.col("objectid").isin([int(i) for i in objectids])).count() if objectids else 0
        if gone:
            self._changed(lambda base: base.filter(~F.col("objectid").isin([int(i) for i in objectids])))
        return gone


class Geodatabase:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, SnapshotStore(spark, folder)
        self.source = f"file://{os.path.abspath(folder)}"
        self._current: Snapshot | None = None
        self._tables: dict[str, Table] = {}
        self._staged: Snapshot | None = None
        self.current_version = DEFAULT
        self.editing = False
        self.snapshot  # noqa: B018  a store that is not there fails here

    @property
    def snapshot(self) -> Snapshot:
        if self._staged is not None:
            return self._staged
        if self._current is None:
            self._current = self.store.read()
        return self._current

    @property
    def fabric(self) -> Fabric:
        return self.snapshot.fabric

    @property
    def version(self) -> str:
        return ".".join(map(str, self.snapshot.version))

    @property
    def in_transaction(self) -> bool:
        return self._staged is not None

    def refresh(self) -> None:
        self._current = None

    def _commit(self, change) -> None:
        """Commits change(fabric), outside of a transaction on the snapshot that is current then."""
        if self.in_transaction:
            self._staged = replace(self._staged, fabric=change(self._staged.fabric))
        else:
            self._current = self.store.change(change)

    @contextlib.contextmanager
    def transaction(self):
        """All changes within are committed together or, on an error, not at all. A nested transaction is part of the outer one."""
        if self.in_transaction:
            yield self
            return
        start = self.store.read()
        self._staged = start
        try:
            yield self
            staged = self._staged
        finally:
            self._staged = None
        if staged is not start:
            self._current = self.store.commit(start, staged.fabric)

    def sql(self, text: str, **arguments) -> DataFrame:
        """SQL over the base rows of the tables, by their names."""
        for name, table in self.fabric.tables.items():
            table.base.createOrReplaceTempView(name)
        return self.spark.sql(text, args=arguments or None)

    def list_tables(self) -> list[str]:
        return sorted(self.fabric.tables)

    def open_table(self, name: str) -> Table:
        key = name.lower()
        if key not in self._tables:
            found = next((n for n in self.fabric.tables if n.lower() == key), None)
            if found is None:
                raise KeyError(name)
            self._tables[key] = Table(self, found)
        return self._tables[key]

    def evict_table(self, name: str) -> None:
        self._tables.pop(name.lower(), None)

    def open_view(self, name: str, shape_field: str | None = None) -> Table:
        """A read-only table of a view named schema.name; temporary views of the session are of no schema and named without one."""
        if name.count(".") > 1:
            raise ValueError("a view is named schema.name")
        if not self.spark.catalog.tableExists(name):
            raise KeyError(name)
        return Table(self, name, self.spark.table(name), shape_field)

    def register_version_view(self, table: str, version: str, name: str | None = None) -> str:
        """A view of the session with the table as a version sees it, by default <table>_evw."""
        view = name or f"{table}_evw"
        versioned.read_version(self.fabric, table, version).createOrReplaceTempView(view)
        return view

    def list_versions(self, server_time_zone: str | None = None) -> list:
        """The versions by name; times of a server's zone become UTC."""
        return list_versions(self.fabric.versions, server_time_zone).collect()

    def get_version(self, name: str):
        return self.fabric.find_version(name)

    def lineage(self, version: str) -> list[int] | None:
        """The version's walk; None at the root state."""
        tip = self.fabric.tip(version)
        walk = self.fabric.tree().walk(tip)
        return (sorted((r.state for r in walk.collect()), reverse=True) if isinstance(walk, DataFrame) else walk) or None

    def set_current_version(self, name: str) -> None:
        if self.get_version(name) is None:
            raise VersionNotFoundError(name)
        self.current_version = name

    def create_version(self, name: str, parent: str = DEFAULT, owner: str = "sde", description: str | None = None, name_rule: str = "EXACT") -> str:
        """A new version at its parent's tip. With the rule UNIQUE a name that is taken gets a number."""
        above = self.get_version(parent)
        if above is None:
            raise VersionNotFoundError(parent)
        chosen, number = name, 0
        while self.get_version(f"{owner}.{chosen}") is not None:
            if name_rule != "UNIQUE":
                raise ValueError(f"{owner}.{name} exists")
            number += 1
            chosen = f"{name}{number}"
        values = {"owner": owner, "name": chosen, "parent_name": f"{above.owner}.{above['name']}", "state_id": above.state_id, "description": description}
        row = self.spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in self.fabric.versions.schema.fields])
        self._commit(lambda f: replace(f, versions=append_rows(f.versions, row)))
        return f"{owner}.{chosen}"

    def delete_version(self, name: str) -> None:
        version = self.get_version(name)
        if version is None:
            raise VersionNotFoundError(name)
        full = f"{version.owner}.{version['name']}"
        if full.lower() == DEFAULT.lower():
            raise ValueError("the default version stays")
        if any((v.parent_name or "").lower() == full.lower() for v in self.list_versions()):
            raise ValueError(f"{full} has child versions")
        self._commit(lambda f: replace(f, versions=f.versions.filter(~((F.col("owner") == version.owner) & (F.col("name") == version["name"])))))

    def start_editing(self, version: str = DEFAULT) -> None:
        self.set_current_version(version)
        self.editing = True

    def stop_editing(self) -> None:
        self.editing = False

    def edit(self, version: str = DEFAULT) -> EditSession:
        return EditSession(self.store, version)

    @contextlib.contextmanager
    def edit_transaction(self, version: str = DEFAULT):
        """A session that is saved at the end and discarded on an error."""
        session = self.edit(version)
        try:
            yield session
            session.save()
            self.refresh()
        finally:
            session.close()

    def version_statistics(self, version: str) -> list:
        tip = self.fabric.tip(version)
        states = state_set(self.spark, self.fabric.tree().walk(tip))
        return changes.version_stats(self.fabric, states).collect()

    def _merged(self, version: str, operation):
        with self.store.editor_lock(), self.store.version_lock(version):
            self.refresh()
            result = []

            def change(fabric: Fabric) -> Fabric:
                fabric, found = operation(fabric)
                result.append(found)
                return fabric

            if self.in_transaction:
                self._commit(change)
            else:
                # The plan holds for the snapshot that it was made from; if that has moved, it is made anew.
                for left in reversed(range(8)):
                    base = self.store.read()
                    moved = change(base.fabric)
                    try:
                        self._current = self.store.commit(base, moved) if moved is not base.fabric else base
                        break
                    except SnapshotMovedError:
                        if not left:
                            raise
            return result[-1]

    def reconcile_version(self, version: str, options: merging.ReconcileOptions = merging.ReconcileOptions()) -> merging.ReconcileResult:
        return self._merged(version, lambda f: merging.reconcile(f, version, options))

    def post_version(self, version: str, trim: bool = False, delete_version: bool = False) -> merging.PostResult:
        return self._merged(version, lambda f: merging.post(f, version, trim, delete_version))

    def rebase_version(self, version: str, **options) -> merging.RebaseResult:
        return self._merged(version, lambda f: merging.rebase(f, version, **options))

    def revert_features(self, version: str, features: list[tuple[str, int]]) -> int:
        return self._merged(version, lambda f: merging.revert(f, version, features))

    def compact(self, **options) -> compaction.CompactionResult:
        """Compaction under the exclusive lock; with editors active it is deferred, and nothing is done.

        No session is alive under that lock, so state locks that are left are stale and go first. If the versions change meanwhile, nothing is done either.
        """
        if self.in_transaction:
            raise RuntimeError("compaction is no part of a transaction")
        if not options.get("acknowledge_experimental_unsafe"):
            raise compaction.CompactionRefused("compaction must be acknowledged as experimental and unsafe")
        try:
            with self.store.compaction_lock(options.pop("wait_seconds", 30.0)):
                self.refresh()
                if not self.store.read().fabric.locks.isEmpty():
                    self.store.change(lambda f: replace(f, locks=f.locks.limit(0)))
                base = self.store.read()
                fabric, result = compaction.compact(base.fabric, **options)
                try:
                    self._current = self.store.commit(base, fabric) if fabric is not base.fabric else base
                except SnapshotMovedError:
                    return compaction.CompactionResult(result.phases, skipped="version-set-changed")
                return result
        except LockTimeoutError:
            log.info("compaction deferred, editors are active")
            return compaction.CompactionResult((), deferred="editors-active")

    def close(self) -> None:
        self._tables.clear()
        self._current = None


class EnterpriseGeodatabase(Geodatabase):
    """The fabric of a database server, for reading: versions, changes and conflicts are found here, writing is the server's."""

    def __init__(self, spark: SparkSession, config: dict, schema: str = "sde", only: list[str] | None = None):
        self.spark, self.source = spark, config["source"]
        self._config, self._schema, self._only = config, schema, only
        self._tables, self._staged, self._current = {}, None, None
        self.current_version, self.editing = DEFAULT, False
        self.snapshot  # noqa: B018  a server that cannot be read fails here

    @property
    def snapshot(self) -> Snapshot:
        if self._current is None:
            self._current = Snapshot(0, read_fabric(self.spark, self._config, jdbc_table, self._schema, self._only), (0, 0, 0))
        return self._current

    def _read_only(self, *_, **__):
        raise ReadOnlyError(self.source)

    _commit = _merged = edit = edit_transaction = compact = transaction = _read_only


def open_geodatabase(spark: SparkSession, uri: str | dict) -> Geodatabase:
    """A store of snapshots by its path, or, by its uri, a database server for reading; also by a config as parse_connection_string gives it, in which
    `url` may be any JDBC address.
    """
    config = parse_connection_string(uri) if isinstance(uri, str) else uri
    return Geodatabase(spark, config["path"]) if config["type"] == "file" else EnterpriseGeodatabase(spark, config)


def create_geodatabase(spark: SparkSession, folder: str, tables: dict[str, FeatureTable] | None = None) -> Geodatabase:
    """A new store with the root state, the default version, and these tables."""
    states = spark.createDataFrame([(ROOT, ROOT, ROOT)], "state_id long, parent_state_id long, lineage_name long")
    lineages = spark.createDataFrame([(ROOT, ROOT)], "lineage_name long, lineage_id long")
    versions = spark.createDataFrame([("sde", "DEFAULT", None, ROOT, None)], "owner string, name string, parent_name string, state_id long, description string")
    locks = spark.createDataFrame([], "sde_id int, state_id long, lock_time timestamp")
    SnapshotStore(spark, folder).create(Fabric(states, lineages, versions, locks, tables or {}))
    return Geodatabase(spark, folder)
