"""The stored graph and vectors, and stages kept between runs."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import schema
from quern.config import StoreConfig
from quern.operators import nodes as node_ops
from quern.operators import retrieval
from quern.operators.counting import observed
from quern.operators.retrieval import modality_of, with_norm
from quern.sources import commits
from quern.sources.commits import place
from quern.sources.vector_index import VectorIndex


def present(spark: SparkSession, path: str) -> bool:
    system, p = place(spark, path)
    return system.exists(p)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    return present(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    system, p = place(spark, path)
    system.delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A fresh place that driver and executors share, removed at exit: under spark.checkpoint.dir where that
    is set, on one machine a temporary folder, else an error."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] == "local":
        shared = "file://" + tempfile.mkdtemp(prefix="quern-scratch-")
        atexit.register(shutil.rmtree, shared.removeprefix("file://"), True)
    if not shared:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = f"{shared.rstrip('/')}/quern-{uuid.uuid4().hex[:12]}"

    def gone():
        try:
            remove(spark, own)
        except Exception:  # the session has ended: nothing is left to ask
            return

    atexit.register(gone)
    return own


def connected(call: Callable, attempts: int = 10, wait: float = 5.0, sleep=time.sleep):
    """call's result; a storage that can't be reached is tried again, at even intervals."""
    for n in range(attempts):
        try:
            return call()
        except (OSError, Py4JJavaError) as error:
            if n == attempts - 1:
                raise
            logging.getLogger("quern").warning("storage not reached, try %d of %d: %s", n + 1, attempts, error)
            sleep(wait)


def save_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cached_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage at a path; built and written first where it is absent or a write broke off.  The
    path should name all that the stage depends on (see stage_path)."""
    if not exists(spark, path):
        save_stage(build(), path)
    return load_stage(spark, path)


def stage_path(root: str, name: str, topic: str, pages: int) -> str:
    import hashlib

    return f"{root}/{name}-{hashlib.sha256(f'{topic}|{pages}'.encode()).hexdigest()[:16]}"


def vectors_of(nodes: DataFrame, collection: str = "wiki") -> DataFrame:
    """Vectors of nodes that have one: the collection follows the kind of node, the modality its type."""
    rows = nodes.where("embedding is not null and kind != 'document'")
    place = F.concat(F.lit(collection), F.when(F.col("kind") == "image", "_image").otherwise("_text"))
    return with_norm(rows.select("node_id", place.alias("collection"), modality_of(F.col("type")).alias("modality"), F.col("embedding").cast("array<float>").alias("embedding")))


def of_dimension(vectors: DataFrame, dims: dict[str, int | None]) -> DataFrame:
    """Vectors, where one of another length than its collection's is an error; None checks nothing."""
    known = {c: n for c, n in dims.items() if n is not None}
    if not known:
        return vectors
    want = F.coalesce(*[F.when(F.col("collection") == c, F.lit(n)) for c, n in known.items()])
    wrong = F.raise_error(F.concat(F.lit("wrong vector length in "), F.col("collection"))).cast(vectors.schema["embedding"].dataType)
    return vectors.withColumn("embedding", F.when((F.size("embedding") == want) | want.isNull(), F.col("embedding")).otherwise(wrong))


_ID = T.StructField("page_id", T.StringType())
#: The store's tables; `pages` says which version of a page counts.
TABLES = {
    "nodes": schema.NODE_SCHEMA,
    "edges": T.StructType([*schema.EDGE_SCHEMA.fields, _ID]),
    "vectors": T.StructType([*schema.VECTOR_SCHEMA.fields, _ID]),
    "pages": T.StructType([_ID]),
}


#: Batches of about one size that the store merges, and rows to a file of a batch, about.
FAN, FILE_ROWS = 8, 1 << 20


@dataclass
class GraphStore:
    """nodes, edges and vectors under one path; pages that are stored again replace all they had.

    Every call of store() writes its rows in folders of their own, then commits them as one entry of the
    log (quern.sources.commits); a page's rows are those of its last batch in the order of the log.  So a batch
    costs what it holds, one that breaks off is never seen, and writers that store at the same time lose
    nothing: the later entry counts.  Batches of like size are merged as they come (merge_small), so that many small
    ones leave few files.  `at` holds a reader to the state after an entry; nothing that it reads goes
    before vacuum().

    A vector index (build_index) covers the state it was built at; search() asks it for all pages that have
    not been stored since, and looks through the vectors of those that have."""

    spark: SparkSession
    config: StoreConfig
    at: int | None = None

    def __post_init__(self):
        self.log = commits.CommitLog(self.spark, f"{self.config.path}/log")

    def pinned(self) -> GraphStore:
        """The store as it is now, whatever is written later."""
        return GraphStore(self.spark, self.config, self.log.last())

    def _state(self) -> list[commits.Live]:
        return connected(lambda: self.log.state(self.at))

    def _path(self, table: str) -> str:
        return f"{self.config.path}/{table}"

    def _all(self, table: str, batches: list[commits.Live]) -> DataFrame:
        """The rows of some batches, with `version`: their place in the order."""
        full = T.StructType([*TABLES[table].fields, T.StructField("batch", T.StringType())])
        if not batches:
            return self.spark.createDataFrame([], full).withColumn("version", F.lit(0)).drop("batch")
        paths = [f"{self._path(table)}/batch={x.batch}" for x in batches]
        rows = self.spark.read.schema(full).option("basePath", self._path(table)).parquet(*paths)
        if len(batches) == 1:
            return rows.withColumn("version", F.lit(batches[0].order)).drop("batch")
        order = self.spark.createDataFrame([(x.batch, x.order) for x in batches], "batch string, version int")
        return rows.join(F.broadcast(order), "batch").drop("batch")

    def _current(self, table: str, batches: list[commits.Live] | None = None, among: list[commits.Live] | None = None) -> DataFrame:
        """The rows of a table that count: those of each page's last batch.  among: look at these only."""
        state = self._state() if batches is None else batches
        rows = self._all(table, state if among is None else among)
        if len(state) > 1:
            last = self._all("pages", state).groupBy("page_id").agg(F.max("version").alias("version"))
            rows = rows.join(last, ["page_id", "version"], "left_semi")
        return rows.select(*TABLES[table].names)

    def _write(self, df: DataFrame, table: str, batch: str, rows: int = 0) -> None:
        """rows: how many they are, about.  Vectors are written in their order, and which file holds which
        of them is written beside (scroll)."""
        out = df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table]])
        place = f"{self._path(table)}/batch={batch}"
        if table != "vectors":
            out.write.option("maxRecordsPerFile", FILE_ROWS).parquet(place)
            return
        out.repartitionByRange(max(1, -(-rows // FILE_ROWS)), "collection", "node_id").sortWithinPartitions("collection", "node_id").write.parquet(place)
        held = self.spark.read.schema(TABLES[table]).parquet(place).select("collection", "node_id", F.col("_metadata.file_path").alias("file"))
        held.groupBy("collection", "file").agg(F.min("node_id").alias("low"), F.max("node_id").alias("high"), F.count(F.lit(1)).alias("rows")).coalesce(1).write.parquet(f"{self._path('order')}/batch={batch}")

    def dimensions(self) -> dict[str, int | None]:
        return {f"{self.config.collection}_text": self.config.text_dim, f"{self.config.collection}_image": self.config.image_dim}

    def store(self, nodes: DataFrame) -> int:
        """Nodes, then their edges, then their vectors; returns the entry.  The nodes are computed once, however
        much their model stages cost: edges and vectors come from what was written."""
        batch = uuid.uuid4().hex
        full = nodes if "embedding" in nodes.columns else nodes.withColumn("embedding", F.lit(None).cast("array<float>"))
        staged = f"{self.config.path}/staged/{batch}"
        seen = Observation()
        save_stage(full.observe(seen, F.count(F.lit(1)).alias("rows")), staged)
        held = load_stage(self.spark, staged)
        self._write(schema.as_nodes(held), "nodes", batch)
        own = held.select("node_id", "page_id")
        self._write(node_ops.edges(schema.as_nodes(held)).join(own.withColumnRenamed("node_id", "dst_id"), "dst_id"), "edges", batch)
        vectors = of_dimension(vectors_of(held, self.config.collection), self.dimensions())
        rows = observed(seen).get("rows", 0)
        self._write(vectors.join(own, "node_id"), "vectors", batch, rows)
        self._write(held.select("page_id").distinct(), "pages", batch)
        entry = self.log.commit(batch, rows)
        remove(self.spark, staged)
        self.merge_small()
        return entry

    def _merge(self, run: list[commits.Live]) -> bool:
        """One batch that stands for neighbours in the order.  Of what they hold, only each page's last of
        them is kept; if another writer has merged some of them meanwhile, this one's work is dropped: False."""
        batch, files = uuid.uuid4().hex, lambda n: max(1, -(-n // FILE_ROWS))
        for table in TABLES:
            rows = self._current(table, run)
            rows = rows.distinct() if table == "pages" else rows
            total = sum(x.rows for x in run)
            self._write(rows.coalesce(files(total)) if table != "vectors" else rows, table, batch, total)
        rows = self.spark.read.parquet(f"{self._path('nodes')}/batch={batch}").count()
        try:
            self.log.commit(batch, rows, tuple(x.batch for x in run))
            return True
        except commits.Outdated:
            self._drop(batch)
            return False

    def merge_small(self) -> None:
        """Merge runs of FAN batches of like size; an index keeps what it covers."""
        while runs := commits.runs_to_merge(self.log.state(), FAN, self.indexed()):
            if not all([self._merge(run) for run in runs]):
                return  # another writer is merging

    def compact(self) -> None:
        """All batches as one; an index is built anew.  Readers that are pinned go on reading the old ones."""
        state = self.log.state()
        if len(state) > 1:
            self._merge(state)
            if self.indexed() is not None:
                self.build_index()

    def vacuum(self, keep_from: int | None = None) -> int:
        """Remove batches that no state from an entry (the last) on holds; returns how many.  Folders of
        writers that have not committed stay."""
        gone = self.log.unused([n.removeprefix("batch=") for n in commits.names(self.spark, self._path("pages"))], self.log.last() if keep_from is None else keep_from)
        for batch in gone:
            self._drop(batch)
        return len(gone)

    def _drop(self, batch: str) -> None:
        for table in (*TABLES, "order"):
            remove(self.spark, f"{self._path(table)}/batch={batch}")

    def nodes(self) -> DataFrame:
        return self._current("nodes")

    def edges(self) -> DataFrame:
        return self._current("edges").select("src_id", "dst_id", "rel")

    def vectors(self) -> DataFrame:
        return self._current("vectors").select("node_id", "collection", "modality", "embedding", "norm")

    def node(self, node_id: str) -> DataFrame:
        return self.nodes().where(F.col("node_id") == node_id)

    def collections(self) -> DataFrame:
        return self.vectors().select("collection").distinct()

    def sample(self, collection: str, n: int = 10) -> DataFrame:
        """The first n vectors of a collection, for a look."""
        return self.vectors().where(F.col("collection") == collection).orderBy("node_id").limit(n)

    def scroll(self, collection: str, n: int = 10, after: str | None = None) -> tuple[DataFrame, str | None]:
        """(the next n vectors of a collection in order of node_id, the cursor to go on from): `after` is the
        cursor that the page before gave; None begins, and ends.

        The files that hold what comes next are known by their least and greatest node_id, so a page reads a
        few files of each batch that counts, however large the collection is."""
        state = self._state()
        none = self.spark.createDataFrame([], TABLES["vectors"]).drop("page_id")
        if not state or n < 1:
            return none, None
        schema_ = "collection string, file string, low string, high string, rows long"
        order = self.spark.read.schema(schema_).parquet(*[f"{self._path('order')}/batch={x.batch}" for x in state]).where(F.col("collection") == collection)
        order = order if after is None else order.where(F.col("high") > after)
        most = len(state) + 1
        while True:
            files = order.orderBy("low", "file").limit(most + 1).collect()  # a row for each file that is read
            bound = files[most]["low"] if len(files) > most else None
            if not files:
                return none, None
            rows = self._of_files([f["file"] for f in files[:most]], state).where(F.col("collection") == collection)
            rows = rows if after is None else rows.where(F.col("node_id") > after)
            rows = rows if bound is None else rows.where(F.col("node_id") < bound)
            page = rows.orderBy("node_id").limit(n).select(*TABLES["vectors"].names[:-1])
            last = page.agg(F.count(F.lit(1)).alias("n"), F.max("node_id").alias("at")).first()
            if last["n"] == n:
                return page, last["at"]
            if bound is None:
                return page, None
            most *= 2

    def _of_files(self, files: list[str], state: list[commits.Live]) -> DataFrame:
        """The vectors of some files that count."""
        order = {x.batch: x.order for x in state}
        parts: dict[int, list[str]] = {}
        for f in files:
            parts.setdefault(order[f.split("/batch=")[1].split("/")[0]], []).append(f)
        out = reduce(DataFrame.unionByName, [self.spark.read.schema(TABLES["vectors"]).parquet(*own).withColumn("version", F.lit(n)) for n, own in sorted(parts.items())])
        if len(state) == 1:
            return out
        own = out.select("page_id").distinct()
        last = self._all("pages", state).join(own, "page_id", "left_semi").groupBy("page_id").agg(F.max("version").alias("version"))
        return out.join(last, ["page_id", "version"], "left_semi")

    def indexed(self) -> int | None:
        """The entry that the newest index covers, of those up to `at`."""
        done = [int(n) for n in commits.names(self.spark, self._path("index")) if exists(self.spark, f"{self._path('index')}/{n}/about")]
        return max((n for n in done if self.at is None or n <= self.at), default=None)

    def index(self) -> VectorIndex | None:
        n = self.indexed()
        return None if n is None else VectorIndex(self.spark, f"{self._path('index')}/{n}")

    def build_index(self, cells: int | None = None, recall: float | None = None) -> VectorIndex:
        """An index of the vectors that count now.  recall: how much of the true nearest a search is to
        find (VectorIndex.calibrate); without it all cells are asked."""
        entry = self.log.last()
        index = VectorIndex(self.spark, f"{self._path('index')}/{entry}").build(self._current("vectors", self.log.state(entry)), cells)
        if recall is not None:
            index.calibrate(recall)
        return index

    def search(self, queries: DataFrame, limits: dict[str | None, int], probes: int | None = None) -> DataFrame:
        """retrieval.nearest over the vectors that count; by the index where there is one."""
        entry, index, state = self.indexed(), self.index(), self._state()
        if index is None:
            return retrieval.nearest(self._current("vectors", state), queries, limits)
        newer = [x for x in state if x.order > entry]
        if not newer:
            return index.search(queries, limits, probes)
        changed = self._all("pages", newer).select("page_id").distinct()
        old = index.search(queries, limits, probes, index.vectors().join(changed, "page_id", "left_anti"))
        return retrieval.best(old.unionByName(retrieval.nearest(self._current("vectors", state, newer), queries, limits)), limits)

    def text_first(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """retrieval.text_first by search()."""
        return self.search(queries, {"text": k, "image": k // 2})
