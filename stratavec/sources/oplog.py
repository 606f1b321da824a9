"""Reading change streams: JSON lines in batch, as a stream and over HTTP, and the embeddings' binary form."""

from __future__ import annotations

from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from stratavec.operators.changes import validated, with_seq
from stratavec.session import ship

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("op", "id", "string", "message")])


def read_operations(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Operations of JSON-lines files, numbered by ``seq`` in file order. Strict reading fails at a malformed or invalid line."""
    if strict:
        rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    else:
        rows = spark.read.schema(T.StructType([*SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)
        rows = rows.filter(F.col("op").isNotNull()).drop("_corrupt_record")
    return validated(with_seq(rows.select("*", "_metadata")).drop("_metadata"), strict)


def read_operation_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The same files as a stream of micro-batches."""
    return spark.readStream.schema(SCHEMA).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).json(path)


class HttpChanges(DataSource):
    """Operations that a service streams as JSON lines for a commit: ``spark.read.format("http_changes")``.

    Options: ``endpoint``, ``domain``, ``commit``, ``previous`` (optional), ``user_header``, the header that
    names the user, and ``timeout`` in seconds. An answer other than 200
    fails with its body. The stream is read by one task, line by line, as it comes in order.
    """

    @classmethod
    def name(cls) -> str:
        return "http_changes"

    def schema(self) -> str:
        return "line string, seq bigint"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(dict(self.options))


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        query = {"commit_id": options["commit"]} | ({"previous": options["previous"]} if options.get("previous") else {})
        self.url = f"{options['endpoint'].rstrip('/')}/{quote(options['domain'], safe='')}?{urlencode(query)}"
        self.timeout, self.headers = float(options.get("timeout", 60)), {options.get("user_header", "X-Forwarded-User"): "admin"}

    def read(self, partition):
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            answer = urlopen(Request(self.url, headers=self.headers), timeout=self.timeout)
        except HTTPError as e:
            raise RuntimeError(f"{e.code}: {e.read().decode('utf-8', 'replace')}") from None
        with answer:
            if answer.status != 200:
                raise RuntimeError(f"{answer.status}: {answer.read().decode('utf-8', 'replace')}")
            k = 0
            for line in answer:
                if text := line.decode("utf-8").strip():
                    yield text, k
                    k += 1


def read_http_operations(spark: SparkSession, endpoint: str, domain: str, commit: str, previous: str | None = None, strict: bool = True) -> DataFrame:
    """(op, id, string, message, seq) of a commit as the service at ``endpoint`` streams them; strict as in ``read_operations``."""
    ship(spark)
    spark.dataSource.register(HttpChanges)
    options = {"endpoint": endpoint, "domain": domain, "commit": commit} | ({"previous": previous} if previous else {})
    lines = spark.read.format("http_changes").options(**options).load()
    parsed = lines.select(F.from_json("line", SCHEMA, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("o"), "seq")
    return validated(parsed.select("o.*", "seq"), strict)


def pack_vectors(vectors: DataFrame, per: int = 65_536, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(first, content): the little-endian floats of ``per`` vectors with consecutive ids, the inverse of ``unpack_vectors``."""
    import numpy as np
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        if len(ids) and (ids[order] != ids[order[0]] + np.arange(len(ids))).any():
            raise ValueError("ids are not consecutive")
        flat = t.column("e").combine_chunks().take(pa.array(order)).flatten().to_numpy(zero_copy_only=False).astype("<f4")
        return pa.table({"first": [int(ids[order[0]])], "content": pa.array([flat.tobytes()], pa.binary())})

    rows = vectors.select(F.floor(F.col(key) / per).alias("block"), F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<float>").alias("e"))
    return rows.groupBy("block").applyInArrow(run, "first bigint, content binary")


def unpack_vectors(binary: DataFrame, content: str = "content", dim: int = 1536, first: str | None = None) -> DataFrame:
    """(vec_id, embedding) of raw vector files read with ``binaryFile``: ``dim`` little-endian floats a vector, ids by place.

    ``first`` names a column with the id of each row's first vector, 0 without it.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for v, start in zip(b.column(0), b.column(1).to_pylist()):
                x = np.frombuffer(v.as_buffer(), "<f4")
                if len(x) % dim:
                    raise ValueError("the file holds no whole number of vectors")
                for a in range(0, len(x), dim * 4096):
                    part = x[a : a + dim * 4096]
                    n = len(part) // dim
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array(start + np.arange(a // dim, a // dim + n)), lists], names=["vec_id", "embedding"])

    return binary.select(content, F.col(first).cast("long") if first else F.lit(0).cast("long")).mapInArrow(run, "vec_id bigint, embedding array<float>")
