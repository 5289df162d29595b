"""Deliveries as streams: exactly one copy of each change, and causal order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.tables import clean_changes


def read_deliveries(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class _OneOfEach(StatefulProcessor):
    """Per identity: which hashes were let through, which of them deliveries without a hash belong to, and whether one of these came first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getMapState("hashes", "hash string", "one boolean")
        self.owner = handle.getValueState("owner", "hash string")
        self.bare = handle.getValueState("bare", "one boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        frames = [x for x in rows if len(x)]
        if not frames:
            yield pd.DataFrame({"full_hash": pd.Series(dtype=object), "whole_row": pd.Series(dtype=object)})
            return
        got = pd.concat(frames, ignore_index=True).sort_values("arrived", kind="stable")
        kept = [self._first(h if isinstance(h, str) else None, bool(whole)) for h, whole in zip(got["full_hash"], got["is_whole"])]
        yield got.loc[kept, ["full_hash", "whole_row"]]

    def _first(self, h: str | None, whole: bool) -> bool:
        if h is None:
            if not whole:
                return True  # nothing tells it from others: a change of its own
            if self.owner.exists() or self.bare.exists():
                return False
            self.bare.update((True,))
            return True
        if self.hashes.containsKey((h,)):
            return False
        self.hashes.updateValue((h,), (True,))
        if self.owner.exists():
            return True
        self.owner.update((h,))
        return not self.bare.exists()

    def close(self) -> None:
        pass


def distinct_deliveries(stream: DataFrame) -> DataFrame:
    """Each change once, at its first delivery, by the identity of :func:`opweave.operators.delivery.first_deliveries`.

    A delivery without a hash is the change with the same ``doc_id``, ``actor`` and ``seq``, whichever came first; one
    without a hash of which one of these is null is let through.  State is kept per (``doc_id``, ``actor``, ``seq``);
    a hash that comes with several of these is let through once (its second copy is told by hash alone, unless the
    change itself went through without its hash).

    There is no watermark: a copy may come at any time, so the keys are kept for good (RocksDB holds
    them outside the heap).
    """
    c = clean_changes(stream)
    written = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
    whole = F.col("doc_id").isNotNull() & F.col("actor").isNotNull() & F.col("seq").isNotNull()
    alone = F.concat(F.lit("alone "), F.coalesce(F.col("delivery_id").cast("string"), F.lit("")))
    who = F.when(whole, F.to_json(F.struct("doc_id", "actor", "seq"))).otherwise(F.coalesce(F.concat(F.lit("hash "), "hash"), alone))
    rows = c.select(
        who.alias("who"), whole.alias("is_whole"), F.col("delivery_id").alias("arrived"), F.col("hash").alias("full_hash"),
        F.to_json(F.struct(*[F.col(f"`{x}`") for x in c.columns]), written).alias("whole_row"),
    )
    kept = rows.groupBy("who").transformWithStateInPandas(_OneOfEach(), outputStructType="full_hash string, whole_row string", outputMode="append", timeMode="none")
    once = kept.withColumn("_once", F.coalesce(F.concat(F.lit("h"), "full_hash"), F.concat(F.lit("r"), "whole_row"))).dropDuplicates(["_once"])
    return once.select(F.from_json("whole_row", c.schema, written).alias("_c")).select("_c.*")


_RELEASED = "doc_id bigint, hash string, actor string, seq bigint, held boolean"


class _CausalQueue(StatefulProcessor):
    """Per document: hashes that were released, and changes that wait for others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.released = handle.getMapState("released", "hash string", "one boolean")
        self.waiting = handle.getMapState("waiting", "hash string", "actor string, seq bigint, missing array<string>")
        self.asked = handle.getMapState("asked", "hash string", "by array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        out = []
        for batch in rows:
            for r in batch.itertuples(index=False):
                me = (r.hash,)
                if self.released.containsKey(me) or self.waiting.containsKey(me):
                    continue
                missing = [d for d in (r.deps if r.deps is not None else []) if not self.released.containsKey((d,))]
                if missing:
                    self.waiting.updateValue(me, (r.actor, int(r.seq), missing))
                    for d in missing:
                        by = self.asked.getValue((d,))[0] if self.asked.containsKey((d,)) else []
                        self.asked.updateValue((d,), ([*by, r.hash],))
                    continue
                free = [(r.hash, r.actor, int(r.seq), False)]
                while free:
                    row = free.pop()
                    self.released.updateValue((row[0],), (True,))
                    out.append((int(key[0]), *row))
                    if not self.asked.containsKey((row[0],)):
                        continue
                    for h in list(self.asked.getValue((row[0],))[0]):
                        actor, seq, left = self.waiting.getValue((h,))
                        left = [d for d in left if d != row[0]]
                        if left:
                            self.waiting.updateValue((h,), (actor, seq, left))
                        else:
                            self.waiting.removeKey((h,))
                            free.append((h, actor, seq, True))
                    self.asked.removeKey((row[0],))
        yield pd.DataFrame(out, columns=["doc_id", "hash", "actor", "seq", "held"])

    def close(self) -> None:
        pass


def causal_stream(stream: DataFrame) -> DataFrame:
    """Changes (``doc_id``, ``hash``, ``actor``, ``seq``, ``deps``) in an order in which all a change depends on comes before it.

    A change whose dependencies haven't come is held until the last of them does; ``held`` tells.
    Copies are dropped.  State is keyed by document, and each arrival touches only the changes it
    frees.  Needs the RocksDB state store.
    """
    rows = clean_changes(stream.select("doc_id", "hash", "actor", "seq", "deps")).where(F.col("hash").isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").transformWithStateInPandas(_CausalQueue(), outputStructType=_RELEASED, outputMode="append", timeMode="none")


def current_entries_table(stream: DataFrame, path: str, checkpoint: str):
    """Keeps a folded fact table of a stream of operations in step (parquet, one folder for each version).

    Each micro-batch folds its facts with those before; as folding is commutative and idempotent,
    repeated and late batches change nothing.  Returns the started query.
    """
    from ..operators.feed import fold_ops, op_facts

    def step(batch: DataFrame, epoch: int) -> None:
        facts = op_facts(batch)
        if epoch > 0:
            facts = facts.unionByName(batch.sparkSession.read.parquet(f"{path}/v{epoch - 1}"))
        fold_ops(facts).write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
