"""Token counts: additive totals by source, language and tokenizer version, kept up to date by signed batches."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievemill.llm.tokenizing import cached_ids

KEYS = ["source", "lang", "tokenizer"]


def counted(docs: DataFrame, tokenizers: dict[str, str], *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", more: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of `docs` and tokenizer version: doc_id, source, lang, tokenizer, tokens. Map only.

    `tokenizers`: version -> path of a byte-level BPE file. `more`: further columns, by name, of expressions over `docs`
    (such as a digest of the text), so that no join has to bring them back. Null and empty texts have 0 tokens; null
    ids, sources and languages stay null, the last two as a group of their own. Repeated rows and ids are each counted.
    An empty table gives no rows. Other columns, also clashing ones, are not read.
    """
    names = {"doc_id": F.col(f"`{doc_id}`").cast("long"), "source": F.col(f"`{source}`").cast("string"), "lang": F.col(f"`{lang}`").cast("string")} | (more or {})
    df = docs.select(*[c.alias(k) for k, c in names.items()], F.col(f"`{text}`").cast("string").alias("__text"))
    out = [*names, "tokenizer", "tokens"]
    schema = StructType([f for f in df.schema if f.name != "__text"]).add("tokenizer", "string").add("tokens", "long")

    def run(it):
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                for version, path in tokenizers.items():
                    n = [len(x) // 4 for x in cached_ids(path).encode(texts)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=out)

    return df.mapInArrow(run, schema)


def _signed(counts: DataFrame, docs: Column, tokens: Column) -> DataFrame:
    return counts.select(*KEYS, docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))


def inserted(counts: DataFrame) -> DataFrame:
    """Signed rows that add documents. A null count is 0."""
    return _signed(counts, F.lit(1), F.coalesce(F.col("tokens"), F.lit(0)))


def deleted(counts: DataFrame, times: str | None = None) -> DataFrame:
    """Signed rows that take documents out again; `counts` as they were added, each as often as the column `times` says."""
    n = F.col(times) if times else F.lit(1)
    return _signed(counts, -n, -n * F.coalesce(F.col("tokens"), F.lit(0)))


def revised(counts: DataFrame, old: str = "old", new: str = "tokens") -> DataFrame:
    """Signed rows that replace one count of a document by another: no document more, new - old tokens. Null is 0."""
    return _signed(counts, F.lit(0), F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0)))


def later_copies(counts: DataFrame, digest: str = "digest") -> DataFrame:
    """Rows (KEYS, tokens, times): all rows of `counts` but one of each digest and tokenizer, equal rows as one row.

    The smallest doc_id stays (null last), of equal ids the row whose source and language come first. Null digests have
    no copies. Rows are summed up by all their columns, and the one that stays is found by a pre-aggregated minimum; the
    join that takes it off is by these columns, so a digest of very many rows is spread by their ids.
    """
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "source", "lang")
    rows = counts.where(F.col(digest).isNotNull()).groupBy(digest, "doc_id", *KEYS, "tokens").agg(F.count("*").alias("m"))
    first = rows.groupBy(F.col(digest).alias("d"), F.col("tokenizer").alias("t")).agg(F.min(place).alias("p")).select("d", "t", F.col("p.doc_id").alias("i"), F.col("p.source").alias("s"), F.col("p.lang").alias("l"))
    same = (rows[digest] == first.d) & (rows.tokenizer == first.t) & rows.doc_id.eqNullSafe(first.i) & rows.source.eqNullSafe(first.s) & rows.lang.eqNullSafe(first.l)
    out = rows.join(first, same, "left").withColumn("times", F.col("m") - F.when(F.col("d").isNotNull(), 1).otherwise(0))
    return out.where("times > 0").select(*KEYS, "tokens", "times")


class Rollup:
    """Totals kept as one small table for each committed batch, below `root`, a folder all executors share.

    A batch is summed by key (pre-aggregated before the shuffle) and written to a folder of its own. Then a small file
    that names this folder is moved to a name derived from the batch's id, which fails if that name is taken: the move
    is the commit, so of two writers of one id one wins, a batch that failed half-way counts nowhere, and an id that is
    committed already is not counted again. Where a file system moves files without such a check (an object store
    without conditional writes), one writer at a time must commit. Totals are sums, so the order of batches doesn't
    matter. `compact` folds the committed batches into one table that lists their ids, committed in the same way.
    """

    SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path("batches"))
        self.fs.mkdirs(self._path("folded"))

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _listed(self, name: str) -> set[str]:
        return {s.getPath().getName() for s in self.fs.listStatus(self._path(name))}

    @staticmethod
    def _name(batch: str) -> str:
        return "b" + hashlib.sha256(batch.encode()).hexdigest()

    def _take(self, folder: str, *to: str) -> bool:
        """Commits a folder under a name, unless the name is taken."""
        jvm, temp = self.spark._jvm, self._path(f"tmp-{uuid.uuid4().hex}")
        out = self.fs.create(temp, False)
        out.write(bytearray(folder.encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, self._path(*to), none)
        except Py4JJavaError as e:
            self.fs.delete(temp, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _folder(self, *name: str) -> str:
        """The folder that a commit names."""
        got = self.fs.open(self._path(*name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(got, "UTF-8")
        finally:
            got.close()

    def _folded(self) -> tuple[str | None, str | None]:
        """The newest fold and its folder."""
        best = max(self._listed("folded"), default=None)
        return (best, self._folder("folded", best)) if best else (None, None)

    def _new(self, folder: str | None) -> set[str]:
        """Committed batches that are in no fold; only these few names come to the driver."""
        names = self._listed("batches")
        if not folder or not names:
            return names
        given = self.spark.createDataFrame([(n,) for n in sorted(names)], "batch string")
        return {r.batch for r in given.join(self.spark.read.schema("batch string").parquet(f"{self.root}/{folder}/ids"), "batch", "left_anti").collect()}

    def committed(self, batch: str) -> bool:
        """Whether a batch of that id counts already."""
        name = self._name(batch)
        if self.fs.exists(self._path("batches", name)):
            return True
        _, folder = self._folded()
        return bool(folder) and not self.spark.read.schema("batch string").parquet(f"{self.root}/{folder}/ids").where(F.col("batch") == name).isEmpty()

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Adds a batch of signed rows; False if its id was committed before, and then nothing is read or written."""
        if self.committed(batch):
            return False
        folder = f"data-{uuid.uuid4().hex}"
        signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.root}/{folder}")
        if self._take(folder, "batches", self._name(batch)):
            return True
        self.fs.delete(self._path(folder), True)
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches; groups in which nothing is left go."""
        _, folder = self._folded()
        paths = [f"{self.root}/{self._folder('batches', b)}" for b in sorted(self._new(folder))] + ([f"{self.root}/{folder}/sums"] if folder else [])
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        out = self.spark.read.schema(self.SCHEMA).parquet(*paths).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Writes the totals with the ids in them, commits that, then deletes what it holds. One folder at a time."""
        fold, folder = self._folded()
        new = self._new(folder)
        if not new:
            return
        into, name = f"data-{uuid.uuid4().hex}", f"f{int(fold[1:]) + 1 if fold else 1:012d}"
        self.totals().write.parquet(f"{self.root}/{into}/sums")
        ids = self.spark.createDataFrame([(i,) for i in sorted(new)], "batch string")
        ids = ids.unionByName(self.spark.read.schema("batch string").parquet(f"{self.root}/{folder}/ids")) if folder else ids
        ids.write.parquet(f"{self.root}/{into}/ids")
        if not self._take(into, "folded", name):
            self.fs.delete(self._path(into), True)
            raise RuntimeError("another writer is folding")
        for b in new:
            gone = self._folder("batches", b)
            self.fs.delete(self._path("batches", b), False)
            self.fs.delete(self._path(gone), True)
        if fold:
            self.fs.delete(self._path("folded", fold), False)
            self.fs.delete(self._path(folder), True)
