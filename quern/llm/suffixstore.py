"""The index family of suffixdedup as stored levels: batches that come later are compared with all that came before.

A level is a folder of two tables: `anchors` (h, k1, k2) of distinct texts in
order of the gram's hash, and their `texts` (k1, k2, data). add() finds the
anchors of a batch, meets them with each level by a join on the hash, and
hands the strings at anchors that met, old and new, to the suffix arrays of
suffixdedup, which tell the repeats on both sides. The batch becomes a level;
while two levels have the same power of two of anchors, they merge into one of
the next, so there are at most log2(anchors) levels and an anchor is
rewritten as often at most. What was found is kept as `spans`.

The manifest names the levels and spans of each state by a sequence number
and is written last: a run that dies leaves the state before. One writer at a
time; folders of earlier states stay until they are cleaned.

Defined results: after any cut of a table into batches, told() equals the
batch operator over the whole table. A null text is empty; texts shorter than
`span` keep all and aren't stored; a text that equals another of its batch or
of an earlier one goes whole; an empty batch changes nothing; extra columns
of any name are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .suffixdedup import SPAN, _cut, _told, anchor_rows, keyed, spans_at

MANIFEST = "sequence long, kind string, folder string, rank int"
SPANS = "array<struct<start:bigint,end:bigint>>"


class StoredFamily:
    """The levels in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, span: int = SPAN):
        self.spark, self.path, self.span = spark, path, span

    def state(self) -> tuple[int, dict[str, int], list[str]]:
        """The last sequence number, its levels' folders with their ranks, and the folders of spans."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest").collect()  # a row a folder and state
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        last = max((r["sequence"] for r in rows), default=0)
        rows = [r for r in rows if r["sequence"] == last]
        return last, {r["folder"]: r["rank"] for r in rows if r["kind"] == "level"}, [r["folder"] for r in rows if r["kind"] == "spans"]

    def _read(self, folders: list[str], table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{f}/{table}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _anchors(self, folders: list[str]) -> DataFrame:
        return self._read(folders, "anchors", "h long, k1 long, k2 long, often boolean")

    def _texts(self, folders: list[str]) -> DataFrame:
        return self._read(folders, "texts", "k1 long, k2 long, data binary")

    def _write_anchors(self, anchors: DataFrame, folder: str) -> None:
        anchors.select("h", "k1", "k2", "often").repartitionByRange("h").sortWithinPartitions("h", "k1", "k2").write.parquet(f"{self.path}/{folder}/anchors")

    def add(self, docs: DataFrame) -> DataFrame:
        """docs (text) join the index -> k1, k2, spans: what is now known to repeat because of them, in texts of any batch."""
        sequence, levels, found = self.state()
        old = list(levels)
        batch = keyed(docs).where(F.octet_length("data") >= self.span).groupBy("k1", "k2").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("n"))
        name = uuid.uuid4().hex
        seen = self._texts(old).select("k1", "k2", F.lit(True).alias("seen"))
        batch.join(seen, ["k1", "k2"], "left").withColumn("seen", F.col("seen").isNotNull()).write.parquet(f"{self.path}/batch-{name}/texts")
        batch = self.spark.read.schema("k1 long, k2 long, data binary, n long, seen boolean").parquet(f"{self.path}/batch-{name}/texts")

        level = f"level-{name}"
        fresh = batch.where("not seen").select("k1", "k2", "data")
        fresh.write.parquet(f"{self.path}/{level}/texts")
        fresh = self._texts([level])
        self._write_anchors(anchor_rows(fresh, self.span), level)
        mine = self._anchors([level])

        grams = mine.groupBy("h").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.max("often").alias("often"))
        met = self._anchors(old).join(grams.select("h"), "h", "left_semi").select("h", "k1", "k2")
        again = grams.where("a <> b or often").select("h").unionByName(met.select("h")).distinct()
        wanted = mine.join(again, "h", "left_semi").select("h", "k1", "k2").unionByName(met)
        wanted.write.parquet(f"{self.path}/batch-{name}/wanted")  # a text has an anchor once: rows are distinct
        wanted = self.spark.read.schema("h long, k1 long, k2 long").parquet(f"{self.path}/batch-{name}/wanted")

        repeats = spans_at(self._texts([*old, level]), wanted, self.span).select("k1", "k2", F.col("spans").cast(SPANS).alias("spans"))
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("data").cast("long").alias("end"))).cast(SPANS)
        copies = batch.where("n > 1 or seen").select("k1", "k2", whole.alias("spans"))
        repeats.unionByName(copies).write.parquet(f"{self.path}/batch-{name}/spans")

        count = mine.count()  # from the files' footers
        if count:
            levels[level] = count.bit_length()
        self._commit(sequence + 1, self._merged(levels), [*found, f"batch-{name}"])
        return self._spans([f"batch-{name}"])

    def _merged(self, levels: dict[str, int]) -> dict[str, int]:
        """Levels of equal rank become one of a higher rank, until all ranks differ."""
        levels = dict(levels)
        while True:
            by: dict[int, list[str]] = {}
            for folder, rank in levels.items():
                by.setdefault(rank, []).append(folder)
            pair = next((f[:2] for f in by.values() if len(f) > 1), None)
            if pair is None:
                return levels
            merged = f"level-{uuid.uuid4().hex}"
            self._texts(pair).write.parquet(f"{self.path}/{merged}/texts")
            self._write_anchors(self._anchors(pair), merged)
            for folder in pair:
                del levels[folder]
            levels[merged] = self._anchors([merged]).count().bit_length()

    def _commit(self, sequence: int, levels: dict[str, int], spans: list[str]) -> None:
        rows = [(sequence, "level", f, r) for f, r in levels.items()] + [(sequence, "spans", f, None) for f in spans]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _spans(self, folders: list[str]) -> DataFrame:
        return self._read(folders, "spans", f"k1 long, k2 long, spans {SPANS}")

    def told(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """docs (`keep`, text), of any batches -> `keep`, n_bytes, n_removed, n_spans, kept_sha256, kept (null: all is kept) by all that was added so far."""
        spans = self._spans(self.state()[2]).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        texts = keyed(docs).join(spans, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("data").alias("data"), F.first("spans").alias("spans"))
        known = _cut(texts, True).withColumn("n", F.lit(None).cast("long"))
        return _told(docs, known, keep)
