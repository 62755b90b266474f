"""Persistent replacement mapping, routing and model batches.

Mapping table: ``map_key STRING (32 hex), entity_type STRING, fake_value
STRING, route STRING, version BIGINT, is_reset BOOLEAN``.  A run appends the keys
it created as files of its own, so no job ever overwrites what another reads; a log
of commits (``commitlog``) names the runs that count.  The live mapping is every row
after the newest reset, the oldest of a key wins ("existing non-empty value wins").

Versions: each run claims one.  A reset opens a new epoch (the next multiple of
2**32), so every later append, by a batch job or by a stream, has a larger version.
A run that was committed meanwhile by another writer makes an upsert drop the keys
that it brought, so racing writers leave one value a key.

Compaction is levelled: ``FAN`` runs of a level become one of the next, which holds
one row a key, bucketed and sorted by it, with a Bloom filter of its keys a file.  The
largest run is the base.  A look-up joins the base bucket by bucket, without an exchange
on that side, then the rest, which is small.  New keys are aggregated on the key itself,
so one exchange serves both the distinct and the ``left_anti`` join.  Keys that fill much
of the looked-up rows (at most four a shuffle partition) are joined apart, by a broadcast
of their few values, so no task gets all rows of a hot value.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.functions.fakes import SPARK, hash_sql, map_key_sql
from shroud.functions.spans import explode_nonempty
from shroud.operators.commitlog import CommitLog, Unchanged
from shroud.operators.replace import route_sql, routed_fake_sql
from shroud.session import show_package

MAPPING_SCHEMA = T.StructType(
    [
        T.StructField("map_key", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("fake_value", T.StringType()),
        T.StructField("route", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("is_reset", T.BooleanType()),
    ]
)

MODEL_SYSTEM_PROMPT = (
    "You invent stand-ins for personal data. For every numbered or listed item answer with exactly one line: "
    "a made-up value of the same kind, and nothing else on that line."
)
MODEL_PROMPT_HEADER = "Please invent one stand-in for each of these, one a line, keeping the order:"
# Batch size and time limit in seconds.
MODEL_BATCH_SIZE = 30
MODEL_TIME_LIMIT = 10.0

# Python's str.splitlines() boundaries, as a Java regex.
SPLITLINES_RE = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"


def with_map_key(df: DataFrame, entity_col: str = "entity_type", raw_col: str = "raw_txt") -> DataFrame:
    return df.withColumn("map_key", F.expr(map_key_sql(SPARK, f"`{entity_col}`", f"`{raw_col}`")))


def empty_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MAPPING_SCHEMA)


EPOCH = 1 << 32


def reset_marker(mapping: DataFrame) -> DataFrame:
    """One row, ``base``: the version of the newest reset marker, or -1."""
    return mapping.filter("is_reset").agg(F.coalesce(F.max("version"), F.lit(-1)).alias("base"))


def live_mapping(mapping: DataFrame) -> DataFrame:
    """Rows after the newest reset marker, one per key, the oldest wins.

    A frame without ``is_reset`` is a snapshot: one row per key already."""
    if "is_reset" not in mapping.columns:
        return mapping
    return oldest_rows(mapping.filter(F.col("version") > reset_marker(mapping).scalar()))


def oldest_rows(mapping: DataFrame) -> DataFrame:
    """One row a key: the oldest that has a value."""
    rows = mapping.filter("NOT is_reset AND fake_value IS NOT NULL AND fake_value != ''")
    oldest = F.min_by(F.struct("entity_type", "fake_value", "route", "version"), F.struct("version", "fake_value"))
    return rows.groupBy("map_key").agg(oldest.alias("m")).select("map_key", "m.*")


def new_pairs(spans: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """Distinct (type, raw) of ``spans`` whose key is not in the live mapping."""
    pairs = with_map_key(spans.select("entity_type", "raw_txt"))
    pairs = pairs.groupBy("map_key").agg(F.min(F.struct("entity_type", "raw_txt")).alias("p")).select("map_key", "p.*")
    if mapping is None:
        return pairs
    return pairs.join(live_mapping(mapping).select("map_key"), "map_key", "left_anti")


def generate_pairs(pairs: DataFrame, salt: str = "") -> DataFrame:
    """Offline generation for new pairs (local generators; the model route's
    deterministic default where no model is used)."""
    pairs = pairs.withColumn("_h", F.expr(hash_sql(SPARK, "entity_type", "raw_txt", salt)))
    return pairs.select(
        "map_key",
        "entity_type",
        F.expr(routed_fake_sql("entity_type", "raw_txt", salt, h="_h")).alias("fake_value"),
        F.expr(route_sql("entity_type")).alias("route"),
    )


def mapping_upsert(spans: DataFrame | None, mapping: DataFrame | None = None, version: int = 1,
                   salt: str = "", generated: DataFrame | None = None) -> DataFrame:
    """Rows to append -- keys new to ``mapping`` with their values.

    ``generated`` may carry externally made values (e.g. A12 model output,
    columns map_key, entity_type, fake_value, route).  Rows with route
    ``fallback`` or ``kept`` hold the raw text, not a substitute, and are never
    stored (fix F4); keys that are stored already stay as they are."""
    if generated is None:
        fresh = generate_pairs(new_pairs(spans, mapping), salt)
    else:
        fresh = generated.filter("route NOT IN ('fallback', 'kept')").groupBy("map_key").agg(
            F.min(F.struct("entity_type", "fake_value", "route")).alias("m")).select("map_key", "m.*")
        if mapping is not None:
            fresh = fresh.join(live_mapping(mapping).select("map_key"), "map_key", "left_anti")
    return fresh.select(
        "map_key", "entity_type", "fake_value", "route",
        F.lit(int(version)).cast("long").alias("version"), F.lit(False).alias("is_reset"),
    )


FAN = 16


class MappingStore:
    """The mapping under ``path``: runs of Parquet files, ``_log`` says which of them count.

    The state has ``next`` (version), ``reset`` (version of the newest reset), ``runs``
    (name, level, rows, buckets) and ``trash`` (runs that a compaction has replaced; they
    stay until two more have, for readers that know them)."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.log = CommitLog(spark, f"{self.path}/_log")

    def state(self) -> dict:
        return {"next": 1, "reset": 0, "runs": [], "trash": []} | self.log.newest()[1]

    def _run(self, run: dict) -> DataFrame:
        """The rows of a run; a bucketed one is read as a table of the session, which needs no exchange by key."""
        path = f"{self.path}/{run['name']}"
        if not run["buckets"]:
            return self.spark.read.schema(MAPPING_SCHEMA).parquet(path)
        table = self._table(run["name"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MAPPING_SCHEMA)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (map_key) SORTED BY (map_key) "
                       f"INTO {run['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    @staticmethod
    def _table(name: str) -> str:
        return "shroud_mapping_" + name.split("=")[1]

    def _rows(self, state: dict, runs: list[dict]) -> DataFrame:
        frames = [self._run(r).where(F.col("version") > state["reset"]) for r in runs]
        return reduce(DataFrame.unionByName, frames) if frames else empty_mapping(self.spark)

    def read(self) -> DataFrame:
        """All rows that count, after the newest reset."""
        state = self.state()
        return self._rows(state, state["runs"])

    def next_version(self) -> int:
        return self.state()["next"]

    def epoch(self) -> int:
        """Version of the newest reset marker, 0 before the first: the base of stream versions."""
        return self.state()["reset"]

    def _commit(self, change: Callable[[dict], None]) -> dict:
        def changed(state: dict) -> dict:
            state = {"next": 1, "reset": 0, "runs": [], "trash": []} | state
            change(state)
            return state

        return self.log.commit(changed)

    def claim(self) -> int:
        """A version that no other writer gets."""
        def take(state: dict) -> None:
            state["next"] += 1

        return self._commit(take)["next"] - 1

    def _write(self, rows: DataFrame) -> tuple[dict, int]:
        """A run of level 0, not yet part of the table, and its largest version."""
        name, seen = f"run={uuid.uuid4().hex}", Observation()
        rows = rows.select(*MAPPING_SCHEMA.names).observe(seen, F.count("*").alias("n"), F.max("version").alias("version"))
        rows.write.parquet(f"{self.path}/{name}")
        return {"name": name, "level": 0, "buckets": 0, "rows": seen.get["n"]}, seen.get["version"] or 0

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def append(self, rows: DataFrame) -> None:
        """Add rows that carry their version."""
        run, version = self._write(rows)
        self._add(run, version)
        self.compact()

    def _add(self, run: dict, version: int, based_on: list[str] | None = None) -> bool:
        """Make a run part of the table; False if runs that ``based_on`` doesn't name have joined it."""
        def add(state: dict) -> None:
            if based_on is not None and any(r["name"] not in based_on for r in state["runs"]):
                raise Unchanged
            if run["rows"]:
                state["runs"] = [*state["runs"], run]
            state["next"] = max(state["next"], version + 1)

        try:
            self._commit(add)
        except Unchanged:
            return False
        if not run["rows"]:
            self._delete(run["name"])
        return True

    def upsert(self, spans: DataFrame | None, salt: str = "", generated: DataFrame | None = None) -> DataFrame:
        """Store values for the keys that have none, and return the new rows.

        Where another writer commits first, the keys it brought are dropped from this run."""
        state = self.state()
        version = self.claim()
        run, _ = self._write(mapping_upsert(spans, self._rows(state, state["runs"]), version, salt, generated))
        while not self._add(run, version, [r["name"] for r in state["runs"]]):
            state, old = self.state(), run
            version = self.claim()
            known = oldest_rows(self._rows(state, state["runs"])).select("map_key")
            mine = self._run(old).join(known, "map_key", "left_anti").withColumn("version", F.lit(version).cast("long"))
            run, _ = self._write(mine)
            self._delete(old["name"])
        rows = self._run(run) if run["rows"] else empty_mapping(self.spark)
        self.compact()
        return rows

    def reset(self) -> None:
        """Forget every value written so far; later versions are larger."""
        def forget(state: dict) -> None:
            state["reset"] = (state["next"] // EPOCH + 1) * EPOCH
            state["next"] = state["reset"] + 1
            state["trash"] = [*state["trash"], [r["name"] for r in state["runs"]]]
            state["runs"] = []

        self._commit(forget)

    def compact(self, everything: bool = False) -> None:
        """Merge the levels that are full; with ``everything`` all runs to one."""
        while True:
            state = self.state()
            levels = sorted({r["level"] for r in state["runs"]})
            full = [lv for lv in levels if sum(r["level"] == lv for r in state["runs"]) >= self.fan]
            if everything and (len(state["runs"]) > 1 or any(not r["buckets"] for r in state["runs"])):
                merged = state["runs"]
            elif full:
                merged = [r for r in state["runs"] if r["level"] == full[0]]
            else:
                return
            run = self._merge(state, merged)
            names = {r["name"] for r in merged}

            def replace(now: dict) -> None:
                if not names <= {r["name"] for r in now["runs"]} or now["reset"] != state["reset"]:
                    raise Unchanged
                now["runs"] = [r for r in now["runs"] if r["name"] not in names] + ([run] if run["rows"] else [])
                now["trash"] = [*now["trash"], sorted(names)][-3:]

            old = [n for batch in state["trash"][:-2] for n in batch]
            try:
                self._commit(replace)
            except Unchanged:  # another writer was faster, or reset the table
                self._delete(run["name"])
                continue
            for name in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
                self._delete(name)

    def _merge(self, state: dict, runs: list[dict]) -> dict:
        """One run of one row a key, bucketed by it."""
        run = {"name": f"run={uuid.uuid4().hex}", "level": max(r["level"] for r in runs) + 1, "rows": sum(r["rows"] for r in runs)}
        run["buckets"] = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows, seen = oldest_rows(self._rows(state, runs)).withColumn("is_reset", F.lit(False)), Observation()
        rows = rows.select(*MAPPING_SCHEMA.names).observe(seen, F.count("*").alias("n"))
        (rows.repartition(run["buckets"], "map_key").write.mode("overwrite").format("parquet")
         .bucketBy(run["buckets"], "map_key").sortBy("map_key")
         .option("parquet.bloom.filter.enabled#map_key", "true")
         .option("parquet.bloom.filter.expected.ndv#map_key", str(max(1000, run["rows"] // run["buckets"])))
         .option("path", f"{self.path}/{run['name']}").saveAsTable(self._table(run["name"])))
        return run | {"rows": seen.get["n"]}

    def live(self) -> DataFrame:
        return oldest_rows(self.read())

    def layers(self) -> list[DataFrame]:
        """Frames (map_key, fake_value) of one row a key, the first that has a key decides: the base, bucketed by
        the key, then the other runs together."""
        state = self.state()
        base = max((r for r in state["runs"] if r["buckets"]), key=lambda r: r["rows"], default=None)
        rest = [r for r in state["runs"] if r is not base]
        out = [] if base is None else [self._rows(state, [base])]
        out += [oldest_rows(self._rows(state, rest))] if rest or not out else []
        return [f.select("map_key", "fake_value") for f in out]

    def snapshot(self) -> DataFrame:
        """The live mapping as one table of one row a key, which is a compaction of all runs."""
        self.compact(everything=True)
        state = self.state()
        return self._rows(state, state["runs"]).drop("is_reset")


def _layers(mapping: DataFrame | MappingStore) -> list[DataFrame]:
    if isinstance(mapping, MappingStore):
        return mapping.layers()
    return [live_mapping(mapping).select("map_key", "fake_value")]


def hot_keys(rows: DataFrame, key: str = "map_key") -> DataFrame:
    """Keys that fill a quarter of an average shuffle partition or more: at most four a partition."""
    share = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.count("*").alias("n"))
    return rows.groupBy(key).count().where(F.col("count") * share >= total.scalar()).select(key)


def join_mapping(rows: DataFrame, mapping: DataFrame | MappingStore, out: str = "cached_value") -> DataFrame:
    """``rows`` (with ``map_key``) and their stored value, null where there is none.

    ``rows`` are read three times: write them first where they cost much."""
    hot = hot_keys(rows)
    few = F.broadcast(hot)
    common, cold = rows.join(few, "map_key", "left_semi"), rows.join(few, "map_key", "left_anti")
    found = []
    for k, layer in enumerate(_layers(mapping)):
        value = layer.withColumnRenamed("fake_value", f"_v{k}")
        common = common.join(F.broadcast(value.join(few, "map_key", "left_semi")), "map_key", "left")
        cold = cold.join(value, "map_key", "left")
        found.append(F.col(f"_v{k}"))
    value = F.coalesce(*found) if found else F.lit(None).cast("string")
    names = [F.col(f"`{c}`") for c in rows.columns]
    return common.select(*names, value.alias(out)).unionByName(cold.select(*names, value.alias(out)))


def lookup(span_table: DataFrame, mapping: DataFrame | MappingStore) -> DataFrame:
    """Attach ``cached_value`` to a span table (left join on the key)."""
    return join_mapping(with_map_key(span_table), mapping)


def route_spans(span_table: DataFrame, mapping: DataFrame | MappingStore | None = None, salt: str = "") -> DataFrame:
    """Cached -> mapping value; local type -> generator; else model route."""
    if mapping is None:
        t = with_map_key(span_table).withColumn("cached_value", F.lit(None).cast("string"))
    else:
        t = lookup(span_table, mapping)
    t = t.withColumn("_h", F.expr(hash_sql(SPARK, "entity_type", "raw_txt", salt)))
    route = F.when(F.col("cached_value").isNotNull(), "cached").otherwise(F.expr(route_sql("entity_type")))
    value = F.coalesce(F.col("cached_value"), F.expr(routed_fake_sql("entity_type", "raw_txt", salt, h="_h")))
    return t.withColumn("route", route).withColumn("fake_value", value).drop("cached_value", "_h")


def build_model_batches(pairs: DataFrame, batch_size: int = MODEL_BATCH_SIZE, buckets: int | None = None) -> DataFrame:
    """A10: groups of ``batch_size`` (type, raw) pairs with their prompt.

    Pairs are spread over ``buckets`` by their key, numbered within a bucket
    in key order and cut into batches: every group is bounded by the batch
    size and no step needs a global order.  Output: batch_id, items
    (array<struct<pos,entity_type,raw>>), prompt."""
    if buckets is None:  # scale the bucket count with the session's shuffle width
        buckets = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    p = pairs if "map_key" in pairs.columns else with_map_key(pairs)
    p = p.withColumn("_bucket", F.expr(f"CAST(conv(substring(map_key, 1, 8), 16, 10) AS BIGINT) % {int(buckets)}"))
    w = Window.partitionBy("_bucket").orderBy("map_key")
    p = p.withColumn("_rn", F.row_number().over(w) - 1)
    p = p.withColumn("batch_id", F.col("_bucket") * F.lit(1_000_000_000) + F.floor(F.col("_rn") / batch_size))
    p = p.withColumn("pos", (F.col("_rn") % batch_size).cast("int"))
    g = p.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "entity_type", F.col("raw_txt").alias("raw"), "map_key"))).alias("items")
    )
    lines = F.transform("items", lambda it: F.concat(F.lit("type="), it["entity_type"], F.lit("; raw="), it["raw"]))
    prompt = F.array_join(F.concat(F.array(F.lit(MODEL_PROMPT_HEADER)), lines), "\n")
    return g.withColumn("prompt", prompt)


def parse_model_batches(batches: DataFrame, response_col: str = "response") -> DataFrame:
    """One row per item with the model's line for it.  The whole reply
    is stripped and split like ``str.splitlines``; missing lines count as
    blank; a blank line or one equal to the raw value keeps the raw value
    (route ``kept``)."""
    carried = ["status"] if "status" in batches.columns else []
    stripped = F.regexp_replace(F.col(response_col), r"(?U)^\s+|\s+$", "")
    # the reply is cut into lines once, not once an item
    lined = F.transform(F.array(F.split(stripped, SPLITLINES_RE, -1)), lambda lines: F.transform(
        "items", lambda it: F.struct(it.alias("it"), F.get(lines, it["pos"].cast("int")).alias("line"))))[0]
    items = explode_nonempty(batches, ["batch_id", *carried], lined, alias="x").select("batch_id", *carried, "x.it", "x.line")
    pos = F.col("it.pos").cast("int")
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    keep_raw = line.isNull() | (line == "") | (line == F.col("it.raw"))
    return items.select(
        "batch_id",
        *carried,
        pos.alias("pos"),
        F.col("it.map_key").alias("map_key"),
        F.col("it.entity_type").alias("entity_type"),
        F.col("it.raw").alias("raw_txt"),
        F.when(keep_raw, F.col("it.raw")).otherwise(line).alias("fake_value"),
        F.when(keep_raw, F.lit("kept")).otherwise(F.lit("model")).alias("route"),
    )


class ReplyLedger:
    """Replies of a model under a shared folder, one file a prompt: a batch that has its reply is not asked again.

    A reply is written under a temporary name and renamed, so it is there whole or not
    at all.  Reached by ``pyarrow.fs`` from the workers."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _at(self, prompt: str):
        from shroud.sources.textfiles import _store

        store, root = _store(self.path)
        key = hashlib.sha256(f"{MODEL_SYSTEM_PROMPT}\n{prompt}".encode()).hexdigest()
        return store, f"{root}/{key[:2]}", f"{root}/{key[:2]}/{key}"

    def get(self, prompt: str) -> str | None:
        store, _, at = self._at(prompt)
        try:
            with store.open_input_file(at) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, prompt: str, reply: str) -> None:
        store, folder, at = self._at(prompt)
        store.create_dir(folder, recursive=True)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(reply.encode())
        store.move(draft, at)


#: calls of one task that overran their limit and have not returned; beyond, the task's other batches fall back
MAX_OVERRUN = 4


def model_generate(batches: DataFrame, make_client: Callable[[], Callable[[str, str], str]],
                   time_limit: float | None = MODEL_TIME_LIMIT, ledger: str | None = None) -> DataFrame:
    """Call a user model per batch inside the executors.

    ``make_client()`` runs once per task and returns ``chat(system, user) ->
    str``.  An exception, or no reply within ``time_limit`` seconds, gives an
    empty reply with status ``fallback``; its items keep their raw values and
    are never stored.  A call that overran keeps its thread until it returns;
    the next batch starts with a new one, while fewer than ``MAX_OVERRUN`` do.
    ``ledger`` names a shared folder that keeps every reply as soon as it is there:
    a task that is run again, and a later run, ask no batch a second time."""
    show_package(batches.sparkSession)
    schema = T.StructType(batches.schema.fields + [T.StructField("response", T.StringType()),
                                                   T.StructField("status", T.StringType())])

    def run(it):
        chat = make_client()
        kept = ReplyLedger(ledger) if ledger else None
        pool, overrun = ThreadPoolExecutor(max_workers=1), []

        def ask(prompt: str) -> str | None:
            nonlocal pool, overrun
            overrun = [call for call in overrun if not call.done()]
            if len(overrun) >= MAX_OVERRUN:
                return None
            call = pool.submit(chat, MODEL_SYSTEM_PROMPT, prompt)
            try:
                return str(call.result(time_limit))
            except TimeoutError:
                overrun.append(call)
                pool.shutdown(wait=False)
                pool = ThreadPoolExecutor(max_workers=1)
            except Exception:  # one bad batch must not fail the job
                pass
            return None

        for pdf in it:
            responses = []
            for prompt in pdf["prompt"]:
                reply = kept.get(prompt) if kept else None
                if reply is None:
                    reply = ask(prompt)
                    if kept and reply is not None:
                        kept.put(prompt, reply)
                responses.append(reply)
            status = ["fallback" if r is None else "ok" for r in responses]
            yield pdf.assign(response=pd.Series([r or "" for r in responses], dtype=object), status=pd.Series(status, dtype=object))

    return batches.mapInPandas(run, schema)


def model_values(batches_with_response: DataFrame) -> DataFrame:
    """A11 + F4: parsed values; items of failed batches become ``fallback``.

    The status travels with the reply, so the model runs once per batch."""
    parsed = parse_model_batches(batches_with_response)
    failed = F.col("status") == "fallback"
    return parsed.select(
        "map_key", "entity_type", "raw_txt",
        F.when(failed, F.col("raw_txt")).otherwise(F.col("fake_value")).alias("fake_value"),
        F.when(failed, F.lit("fallback")).otherwise(F.col("route")).alias("route"),
    )
