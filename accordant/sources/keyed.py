"""A table that is looked up by key and grows by batches.

Each batch is a part, laid out by the first hex digits of the key's md5 and sorted by key; a lookup reads the folders of
the prefixes it asks for and no others.  Parts are merged once there are many, into files sorted by key with Bloom
filters, so the number of files stays bounded and row groups without a wanted key are passed over.

A batch that was chosen against the version it is committed after holds only new keys.  The table then keeps the fact
that its keys are unique, and reading needs no grouping.  A batch committed over another writer's (``append`` says
so in the facts) ends that until the next merge; readers then take the first row per key by ``written_at``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from accordant.sources.versions import Version, Versions


class KeyedTable:
    """Rows of ``schema`` by a string column ``key``; ``written_at`` and a prefix are added.

    Rows that do not fulfil ``live`` are written with their batch but are no answers; merging drops them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType, *, live: str = "true", digits: int = 1, merge_after: int = 16):
        self.spark, self.key, self.live, self.digits, self.merge_after = spark, key, live, digits, merge_after
        own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = own.fieldNames()
        self.schema = T.StructType([*own.fields, T.StructField("written_at", T.TimestampType()), T.StructField("prefix", T.StringType())])
        self.versions = Versions(spark, path)

    def prefix(self, key: Column) -> Column:
        return F.substring(F.md5(key.cast("string")), 1, self.digits)

    def version(self) -> Version:
        return self.versions.latest()

    def _read_parts(self, parts: Sequence[str]) -> DataFrame:
        folders = [self.versions.folder(p) for p in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        # Prefixes are text: '00' must not become a number.  The part's own name is left out by naming its folder.
        frames = [self.spark.read.schema(self.schema).option("basePath", f).parquet(f) for f in folders]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def rows(self, version: Version | None = None, prefixes: Sequence[str] | None = None) -> DataFrame:
        """All live rows of a version, or those of some prefixes; keys may repeat unless the version says they are unique."""
        version = version or self.version()
        out = self._read_parts(version.parts).filter(self.live)
        return out if prefixes is None else out.filter(F.col("prefix").isin(list(prefixes)))

    def first_rows(self, version: Version | None = None, prefixes: Sequence[str] | None = None) -> DataFrame:
        """One row per key, the first one written, with the columns of the schema."""
        version = version or self.version()
        out = self.rows(version, prefixes)
        if version.facts.get("unique", True):
            return out.select(*self.columns)
        return self._first(out).select(*self.columns)

    def _first(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c != self.key]
        mark = F.struct("written_at", F.xxhash64(*rest))
        return rows.groupBy(self.key).agg(F.min_by(F.struct(*rest, "written_at"), mark).alias("r")).select(self.key, "r.*")

    def get(self, keys: Sequence[str], version: Version | None = None) -> DataFrame:
        """The rows of a few keys: only their prefixes are read, and of those the row groups that may hold them."""
        wanted = self.spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("k")).select(self.prefix(F.col("k")).alias("p"))
        prefixes = [r["p"] for r in wanted.distinct().collect()]
        out = self.rows(version, prefixes).filter(F.col(self.key).isin(list(keys)))
        return self._first(out).select(*self.columns)

    def wanted_prefixes(self, keys: DataFrame) -> list[str]:
        """The prefixes that a table of keys touches: 16 to the number of digits at most."""
        return [r["p"] for r in keys.select(self.prefix(F.col(self.key)).alias("p")).distinct().collect()]

    def write(self, rows: DataFrame) -> str:
        """Write a part, uncommitted, and return its name.  Every row of ``rows`` is computed once."""
        part = self.versions.new_part()
        out = rows.select(*self.columns).withColumn("written_at", F.current_timestamp()).withColumn("prefix", self.prefix(F.col(self.key)))
        out.repartition("prefix").sortWithinPartitions("prefix", self.key).write.partitionBy("prefix").parquet(self.versions.folder(part))
        return part

    def part(self, part: str) -> DataFrame:
        """All rows of one written part, live or not, with ``written_at``."""
        return self._read_parts([part]).select(*self.columns, "written_at")

    def append(self, part: str, seen: Version, **facts) -> Version:
        """Commit a written part whose keys were chosen against the version ``seen``."""
        now = seen
        while True:
            unique = now.number == seen.number and now.facts.get("unique", True)
            done = self.versions.commit(now, [*now.parts, part], **{**now.facts, **facts, "unique": unique})
            if done:
                return self.merge(done) if len(done.parts) >= self.merge_after else done
            now = self.version()

    def merge(self, version: Version | None = None) -> Version:
        """All parts of a version as one, each key once.  If another writer commits meanwhile, the table stays as that one left it."""
        version = version or self.version()
        if len(version.parts) < 2 and version.facts.get("unique", True):
            return version
        rows = self.rows(version)
        return self.replace(rows if version.facts.get("unique", True) else self._first(rows), version) or self.version()

    def replace(self, rows: DataFrame, seen: Version, **facts) -> Version | None:
        """A version of these rows alone, each key once; None if another writer has committed since ``seen``.

        ``rows`` must be stored ones, as ordering them reads them twice.  They keep their ``written_at`` if they have one.
        """
        part = self.versions.new_part()
        kept = rows if "written_at" in rows.columns else rows.withColumn("written_at", F.current_timestamp())
        out = kept.select(*self.columns, "written_at").withColumn("prefix", self.prefix(F.col(self.key)))
        (out.repartitionByRange("prefix", self.key).sortWithinPartitions("prefix", self.key)
         .write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("prefix").parquet(self.versions.folder(part)))
        return self.versions.commit(seen, [part], **{**seen.facts, **facts, "unique": True})

    def clear(self) -> Version:
        """A version without rows; ``versions.vacuum()`` then deletes the parts."""
        while True:
            done = self.versions.commit(self.version(), [], unique=True)
            if done:
                return done
