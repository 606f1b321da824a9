"""The versioned vector store: append-only vectors per domain, one manifest per commit, lineage, tasks and queries.

``vectors/domain=…`` holds (vec_id, embedding), ``manifests/domain=…/commit=…`` holds (id, vec_id) of the live records and
``lineage/…`` one row per commit. A manifest becomes visible by the success marker that Spark writes last, so a failed
build leaves at most unreferenced vectors, which ``vacuum`` lists.
"""

from __future__ import annotations

import secrets
import string
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavec.operators import search
from stratavec.operators.changes import apply_changes, latest
from stratavec.operators.embed import HashingEmbedder, embed
from stratavec.session import cut

_ALNUM = string.ascii_letters + string.digits
VECTORS, MANIFEST = "vec_id bigint, embedding array<float>", "id string, vec_id bigint"


def create_index_name(domain: str, commit: str) -> str:
    return f"{quote(domain, safe='-._~')}@{commit}"


def parse_index_name(name: str) -> tuple[str, str]:
    from urllib.parse import unquote

    domain, at, commit = name.partition("@")
    if not at:
        raise ValueError("an index name needs an @")
    return unquote(domain), commit


def load(store: VectorStore, path: str, domain: str, commit: str, previous: str | None = None, strict: bool = True) -> int:
    """Index the operations of JSON-lines files under a commit; the number of live records."""
    from stratavec.sources.oplog import read_operations

    return store.build(domain, commit, read_operations(store.spark, path, strict), previous)


class VectorStore:
    """One store below a path that all executors see."""

    def __init__(self, spark: SparkSession, path: str, embedder=None):
        self.spark, self.path, self.embedder = spark, path.rstrip("/"), embedder or HashingEmbedder()
        self._lock = threading.RLock()
        self._pool = ThreadPoolExecutor(4)
        self._tasks: dict[str, dict] = {}
        self._pending: dict[str, str] = {}
        self._indexes: dict[tuple[str, str], DataFrame] = {}

    # paths encode both names, so no name can leave its folder
    def _vectors(self, domain: str) -> str:
        return f"{self.path}/vectors/{quote(domain, safe='')}"

    def _manifest(self, domain: str, commit: str) -> str:
        return f"{self.path}/manifests/{quote(domain, safe='')}/{quote(commit, safe='')}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    # vectors
    def vectors(self, domain: str) -> DataFrame:
        """(vec_id, embedding) of a domain; one that nothing was ever appended to raises ``KeyError``."""
        path = self._vectors(domain)
        if not self._exists(path):
            raise KeyError(f"no domain {domain}")
        return self.spark.read.schema(VECTORS).parquet(path)

    def count(self, domain: str) -> int:
        """Vectors of a domain; 0 for one that does not exist yet."""
        if not self._exists(self._vectors(domain)):
            return 0
        top = self.vectors(domain).agg(F.max("vec_id")).first()[0]
        return 0 if top is None else top + 1

    def append(self, domain: str, rows: DataFrame, order: str, embedding: str = "embedding") -> DataFrame:
        """Append vectors in the order of a column and return the rows with their ``vec_id``, contiguous from the count.

        Numbers come from counts per range of the order, so no single task sorts all rows.
        """
        with self._lock:
            offset = self.count(domain)
            parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
            ranged = rows.repartitionByRange(int(parts), order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("_t"), F.monotonically_increasing_id().alias("_m"))
            placed = cut(ranged)
            sizes = placed.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
            # one row per partition
            before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            out = placed.join(F.broadcast(before), "_t").withColumn("vec_id", F.lit(offset) + F.col("_before") + F.col("_m") - F.col("_first")).drop("_t", "_m", "_n", "_first", "_before")
            out.select("vec_id", F.col(embedding).cast("array<float>").alias("embedding")).write.mode("append").parquet(self._vectors(domain))
            return out

    def vector(self, domain: str, vec_id: int) -> list[float] | None:
        """One vector by id, None out of range; the file's statistics skip all other row groups."""
        row = self.vectors(domain).filter(F.col("vec_id") == vec_id).select("embedding").head(1)
        return row[0][0] if row else None

    def page(self, domain: str, number: int, size: int = 2) -> DataFrame:
        """The vectors of one page of ``size``, in order; the last page may be short, those beyond it are empty."""
        return self.vectors(domain).filter(F.col("vec_id").between(number * size, number * size + size - 1)).orderBy("vec_id")

    def add_and_load(self, domain: str, vectors: list[list[float]]) -> DataFrame:
        """Append a few vectors, one or many, and read them back in their order: (vec_id, embedding)."""
        rows = self.spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "at long, embedding array<float>")
        with self._lock:
            first = self.count(domain)
            self.append(domain, rows, "at")
        return self.vectors(domain).filter(F.col("vec_id").between(first, first + len(vectors) - 1)).orderBy("vec_id")

    # manifests
    def manifest(self, domain: str, commit: str) -> DataFrame:
        path = self._manifest(domain, commit)
        if not self._exists(f"{path}/_SUCCESS"):
            raise KeyError(f"no index {create_index_name(domain, commit)}")
        return self.spark.read.schema(MANIFEST).parquet(path)

    def index(self, domain: str, commit: str) -> DataFrame:
        """(id, vec_id, embedding) of the live records; a record without vector fails the job."""
        m = self.manifest(domain, commit).join(self.vectors(domain), "vec_id", "left")
        checked = F.when(F.col("embedding").isNull(), F.raise_error(F.lit("a record's vector is missing")).cast("array<float>")).otherwise(F.col("embedding"))
        return m.select("id", "vec_id", checked.alias("embedding"))

    def cached(self, domain: str, commit: str) -> DataFrame:
        """``index`` of a commit, kept by the executors after its first use and found again by later queries."""
        with self._lock:
            if (domain, commit) not in self._indexes:
                self._indexes[domain, commit] = self.index(domain, commit).persist()
            return self._indexes[domain, commit]

    def forget(self, domain: str, commit: str) -> None:
        """Let go of a cached index; builds and assignments do so for the commit that they write."""
        with self._lock:
            kept = self._indexes.pop((domain, commit), None)
        if kept is not None:
            kept.unpersist()

    def build(self, domain: str, commit: str, ops: DataFrame, previous: str | None = None, allow_duplicate_ids: bool = False) -> int:
        """Apply operations (op, id, string, seq) to the previous commit and save the result; the number of live records.

        The vectors are checkpointed as the embedder gives them, so a text is sent to it once, unless a task is run again.
        """
        base = self.manifest(domain, previous) if previous is not None else self.spark.createDataFrame([], MANIFEST)
        ops = ops.filter("op <> 'Error'")
        texts = (ops if allow_duplicate_ids else latest(ops)).filter(F.col("op").isin("Inserted", "Changed"))
        embedded = cut(embed(texts.select("id", "seq", "string"), "string", self.embedder).select("id", "seq", "embedding"))
        placed = self.append(domain, embedded.filter("embedding is not null"), "seq")
        entered = placed.select("id", "vec_id")
        if allow_duplicate_ids:
            out = base.unionByName(entered)
        else:
            touched = ops.select("id").distinct()
            out = base.join(touched, "id", "left_anti").unionByName(entered)
        out.write.mode("overwrite").parquet(self._manifest(domain, commit))
        self.forget(domain, commit)
        n = self.manifest(domain, commit).count()
        self.spark.createDataFrame([(domain, commit, previous, n, "Complete")], "domain string, commit string, previous string, n_docs bigint, status string").coalesce(1).write.mode("append").parquet(f"{self.path}/lineage")
        return n

    def lineage(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lineage")

    def assign(self, domain: str, source: str, target: str, overwrite: bool = True) -> None:
        """Save the source commit's index under the target's name as well."""
        rows = self.manifest(domain, source)
        if source == target:
            return
        if not overwrite and self._exists(f"{self._manifest(domain, target)}/_SUCCESS"):
            raise FileExistsError(create_index_name(domain, target))
        rows.write.mode("overwrite").parquet(self._manifest(domain, target))
        self.forget(domain, target)

    # tasks
    def start(self, domain: str, commit: str, ops: DataFrame, previous: str | None = None) -> str:
        """Build in the background; the id of the task, or of the one that is building the same index already."""
        name = create_index_name(domain, commit)
        with self._lock:
            if name in self._pending:
                return self._pending[name]
            task = "".join(secrets.choice(_ALNUM) for _ in range(8))
            self._pending[name] = task
            self._tasks[task] = {"status": "Pending", "percentage": 0.0}

        def run():
            try:
                self._tasks[task] = {"status": "Pending", "percentage": 0.3}
                self._tasks[task] = {"status": "Complete", "indexed_documents": self.build(domain, commit, ops, previous)}
            except Exception as e:  # the caller learns of any failure by the status
                self._tasks[task] = {"status": "Error", "message": str(e)}
            finally:
                with self._lock:
                    self._pending.pop(name, None)

        self._pool.submit(run)
        return task

    def check(self, task: str) -> dict:
        """The status of a task; an unknown one raises ``KeyError``."""
        return dict(self._tasks[task])

    def wait(self, task: str, timeout: float = 600) -> dict:
        """The status of a task once it is no longer pending."""
        end = time.monotonic() + timeout
        while (status := self.check(task))["status"] == "Pending" and time.monotonic() < end:
            time.sleep(0.05)
        return status

    # queries
    def search(self, domain: str, commit: str, text: str, count: int = 10, approximate: bool = False) -> DataFrame:
        """(id, distance) of the records nearest to a text, exactly or by hashed projections (for unit vectors)."""
        query = self.embedder.one(text)
        if query is None:
            return self.spark.createDataFrame([], "id string, distance double")
        find = search.lsh_nearest if approximate else search.nearest
        return find(self.cached(domain, commit), query, count, key="id")

    def similar(self, domain: str, commit: str, record: str, count: int = 10, exclude_self: bool = False) -> DataFrame:
        return search.similar(self.cached(domain, commit), record, count, key="id", order="vec_id", exclude_self=exclude_self)

    def duplicates(self, domain: str, commit: str, threshold: float = 0.0, approximate: bool = False) -> DataFrame:
        """(id1, id2) of the candidate pairs; ``approximate`` joins by hashed projections instead of comparing all."""
        points = self.cached(domain, commit)
        pairs = search.lsh_duplicates(points, threshold) if approximate else search.duplicates(points, threshold)
        ids = points.select("vec_id", "id")
        return pairs.join(ids.withColumnsRenamed({"vec_id": "i", "id": "id1"}), "i").join(ids.withColumnsRenamed({"vec_id": "j", "id": "id2"}), "j").select("id1", "id2")

    def statistics(self, domain: str) -> DataFrame:
        """(domain, n_vectors, last_id, n_files) of what is stored for a domain."""
        v = self.vectors(domain)
        return v.agg(F.count(F.lit(1)).alias("n_vectors"), F.max("vec_id").alias("last_id")).select(F.lit(domain).alias("domain"), "n_vectors", "last_id", F.lit(len(v.inputFiles())).cast("long").alias("n_files"))

    def vacuum(self, domain: str) -> DataFrame:
        """(vec_id) of vectors that no manifest of the domain refers to."""
        path = f"{self.path}/manifests/{quote(domain, safe='')}"
        used = self.spark.read.schema(MANIFEST).parquet(f"{path}/*") if self._exists(path) else self.spark.createDataFrame([], MANIFEST)
        return self.vectors(domain).select("vec_id").join(used.select("vec_id").distinct(), "vec_id", "left_anti")
