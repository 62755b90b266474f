"""Streaming de-identification.

New document files arrive in a folder.  Detection is the same projection as in L01;
the keys of the spans then meet Spark's state store, which keeps the value of every
key ever seen: state is partitioned by a hash of ``map_key`` into ``buckets`` groups,
each a map from key to value, so a micro-batch reads and writes the keys it holds and
nothing else, however large the mapping has grown.  The values a micro-batch settles are
spliced into its texts and written.

A row whose ``event`` is ``reset`` (A09) goes to every bucket and opens a new epoch
there: values of older epochs count no more.  It takes effect before the documents of its
own micro-batch.

The state is versioned with the checkpoint under the shared ``spark.checkpoint.dir``:
a micro-batch that is run again after a failure starts from the same state and gives
the same values, and its output folder (``batch_id``) is written anew.  With
``mapping_dir`` the stored mapping seeds the state when the stream first starts, and the
keys new to the state are appended to it, version = epoch of its last reset + offset +
batch id; the stored mapping is not read again.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shroud.catalog import HANDLER_THRESHOLD
from shroud.functions.fakes import SPARK, map_key_sql
from shroud.operators.mapping import MappingStore
from shroud.operators.replace import REPL_DDL, apply_spans_sql, span_fields, with_fakes_sql
from shroud.plans.deidentify import detect_documents
from shroud.session import checkpoint_dir, show_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: rows that pass the state: a document, or one of its distinct keys with the value made for it
ROW_DDL = "bucket int, kind string, uid string, doc_id long, text string, spans string, map_key string, entity_type string, fake_value string, route string"


class KeyedValues(StatefulProcessor):
    """One bucket of the mapping: the first value of a key stays until a reset."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epoch = handle.getValueState("epoch", "epoch long")
        self.values = handle.getMapState("values", "map_key string", "fake_value string, epoch long")

    def _now(self) -> int:
        return self.epoch.get()[0] if self.epoch.exists() else 0

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        rows_ = pd.concat(frames, ignore_index=True)
        if (rows_["kind"] == "reset").any():
            self.epoch.update((self._now() + 1,))
        now, settled = self._now(), {}
        keys = rows_[rows_["kind"] == "key"].drop_duplicates("map_key")
        for map_key, made in zip(keys["map_key"], keys["fake_value"]):
            known = self.values.getValue((map_key,)) if self.values.containsKey((map_key,)) else None
            if known is not None and known[1] == now:
                settled[map_key] = (known[0], "cached")
            else:
                self.values.updateValue((map_key,), (made, now))
                settled[map_key] = (made, "new")
        out = rows_[rows_["kind"] != "reset"].copy()
        is_key = out["kind"] == "key"
        out.loc[is_key, "fake_value"] = [settled[k][0] for k in out.loc[is_key, "map_key"]]
        out.loc[is_key, "kind"] = [settled[k][1] for k in out.loc[is_key, "map_key"]]
        yield out

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for map_key, value in zip(initialState["map_key"], initialState["fake_value"]):
            self.values.updateValue((map_key,), (value, 0))

    def close(self) -> None:
        pass


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def state_rows(docs: DataFrame, salt: str, buckets: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, event) that pass the state."""
    is_reset = F.coalesce(F.col("event") == "reset", F.lit(False))
    found = detect_documents(docs.withColumn("uid", F.expr("uuid()")), threshold=HANDLER_THRESHOLD)
    found = found.withColumn("spans", F.expr(with_fakes_sql("spans", salt=salt)).cast(REPL_DDL))
    none = {n: F.lit(None).cast("string") for n in ("text", "spans", "map_key", "entity_type", "fake_value", "route")}

    def row(kind: str, bucket, **values):
        fields = {"kind": F.lit(kind), "bucket": bucket} | none | values
        return F.struct(*[fields[n].alias(n) for n in ("bucket", "kind", "text", "spans", "map_key", "entity_type", "fake_value", "route")])

    doc = row("doc", _bucket("uid", buckets), text=F.col("text"), spans=F.to_json("spans"))
    key = f"transform(spans, kx -> named_struct('map_key', {map_key_sql(SPARK, 'kx.entity_type', 'kx.raw_txt')}, 'entity_type', kx.entity_type, 'fake_value', kx.fake_value, 'route', kx.route))"
    keyed = F.transform(F.array_distinct(F.expr(f"coalesce({key}, array())")), lambda k: F.struct(
        F.pmod(F.xxhash64(k["map_key"]), F.lit(buckets)).cast("int").alias("bucket"), F.lit("key").alias("kind"), none["text"].alias("text"), none["spans"].alias("spans"),
        k["map_key"].alias("map_key"), k["entity_type"].alias("entity_type"), k["fake_value"].alias("fake_value"), k["route"].alias("route")))
    resets = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.struct(
        b.alias("bucket"), F.lit("reset").alias("kind"), *[c.alias(n) for n, c in none.items()]))
    rows = F.when(is_reset, resets).otherwise(F.concat(F.array(doc), keyed))
    flat = found.select("uid", "doc_id", F.explode(rows).alias("r"))
    return flat.select("r.bucket", "r.kind", "uid", "doc_id", "r.text", "r.spans", "r.map_key", "r.entity_type", "r.fake_value", "r.route")


def splice(settled: DataFrame) -> DataFrame:
    """(doc_id, text_deid) of one micro-batch from the rows behind the state."""
    docs = settled.where("kind = 'doc'").select("uid", "doc_id", "text", F.from_json("spans", REPL_DDL).alias("spans"))
    keys = settled.where("kind <> 'doc'").groupBy("uid").agg(F.map_from_entries(F.collect_set(F.struct("map_key", "fake_value"))).alias("_values"))
    d = docs.join(keys, "uid", "left")
    value = f"coalesce(try_element_at(_values, {map_key_sql(SPARK, 'sx.entity_type', 'sx.raw_txt')}), sx.fake_value)"
    spans = f"coalesce(transform(spans, sx -> named_struct({span_fields('sx')}, 'fake_value', {value})), array())"
    d = d.withColumn("spans", F.expr(spans))
    return d.select("doc_id", F.expr(apply_spans_sql("text", "spans")).alias("text_deid"))


def deidentify_stream(spark: SparkSession, source_dir: str, output_dir: str, mapping_dir: str | None = None,
                      schema: str = "doc_id long, text string", fmt: str = "parquet", *, salt: str,
                      query_name: str = "shroud_deid", max_files_per_trigger: int = 64,
                      checkpoint: str | None = None, version_base: int = 1_000_000,
                      available_now: bool = False, buckets: int = 256):
    """Start the stream; returns the ``StreamingQuery``.  ``available_now``
    processes what is in the folder (in bounded micro-batches) and stops.  ``schema``
    may have a column ``event``; ``buckets`` must stay what it was at the first start."""
    show_package(spark)
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir)
    if "event" not in stream.columns:
        stream = stream.withColumn("event", F.lit(None).cast("string"))
    rows = state_rows(stream.select("doc_id", "text", "event"), salt, buckets).groupBy("bucket")
    store = MappingStore(spark, mapping_dir) if mapping_dir else None
    seed = None
    if store is not None and store.state()["runs"]:
        seed = store.live().select(_bucket("map_key", buckets).alias("bucket"), "map_key", "fake_value").groupBy("bucket")
    settled = rows.transformWithStateInPandas(KeyedValues(), ROW_DDL, "Append", "None", initialState=seed)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        (splice(batch).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(output_dir))
        if store is not None:
            fresh = batch.where("kind = 'new'").dropDuplicates(["map_key"])
            store.append(fresh.select("map_key", "entity_type", "fake_value", "route",
                                      F.lit(store.epoch() + version_base + batch_id).cast("long").alias("version"), F.lit(False).alias("is_reset")))
        batch.unpersist()

    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), query_name)
    writer = settled.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", ckpt).queryName(query_name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(PROVIDER, before)


def stream_documents_once(spark: SparkSession, docs: DataFrame, *, salt: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) as files under the shared checkpoint
    folder (as many as the frame has partitions), run the stream over them once
    and return its output."""
    base = os.path.join(checkpoint_dir(spark), f"shroud-stream-{uuid.uuid4().hex}")
    docs.select("doc_id", "text").write.parquet(os.path.join(base, "in"))
    q = deidentify_stream(spark, os.path.join(base, "in"), os.path.join(base, "out"),
                          query_name=f"shroud_{uuid.uuid4().hex[:8]}", checkpoint=os.path.join(base, "ckpt"),
                          available_now=True, salt=salt)
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out")).select("doc_id", "text_deid")
