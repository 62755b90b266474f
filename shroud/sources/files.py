"""File-level sources, sinks and bookkeeping.

Inputs are file *listings* (``path`` plus an arrival order) or whole-text
reads; all logic is column expressions, so a listing of millions of files
is just another table.
"""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.functions.spans import explode_nonempty
from shroud.session import show_package
from shroud.sources.textfiles import FORMAT, DocumentFiles, _store

# Accepted upload extensions, cap, text extensions.
ACCEPTED_EXTENSIONS = ("txt", "pdf", "doc", "docx")
MAX_FILES = 20
TEXT_EXTENSIONS = ("txt", "csv", "html", "json", "md")
LEGACY_TEXT_EXTENSIONS = ("txt", "md", "log")

#: bytes of a file that become one row, and what its neighbours share
ROW_BYTES = 64 << 20
OVERLAP = 64 << 10


def read_text_documents(spark: SparkSession, path: str, lenient: bool = False, row_bytes: int = ROW_BYTES, overlap: int = OVERLAP) -> DataFrame:
    """Rows (path, text, part, base, status, error) of files read as UTF-8.

    Strict: a file that is not UTF-8 has a null text, status ``error`` and the reason;
    the others are read.  ``lenient`` drops undecodable sequences instead.  A file of
    more than ``row_bytes`` gives several rows, ``part`` 0, 1, ...: byte ranges cut at
    character boundaries, each with ``overlap`` bytes of its neighbours on either side.
    Empty files have an empty text.  ``base`` is the number of bytes before the row's text; :func:`own_spans` keeps of the
    spans found in such a row those that begin in its own range."""
    show_package(spark)
    # Spark's listing has the empty files, too; tasks ask for the lengths, as a scan would need one for every few files
    uris = spark.read.format("binaryFile").load(path).inputFiles()
    listed = spark.createDataFrame([(unquote(uri).replace("file:///", "file:/"),) for uri in uris], "path string")
    files = listed.mapInArrow(_lengths, "path string, length long")
    ranges = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / row_bytes).cast("int") - 1, F.lit(0)))
    parts = files.select("path", "length", F.explode(ranges).alias("part"))
    parts = parts.repartition("path", "part")
    decode = _range_reader(row_bytes, overlap, lenient)
    return parts.mapInArrow(decode, "path string, text string, part int, base long, status string, error string")


def _lengths(batches):
    for batch in batches:
        paths = batch.column(0).to_pylist()
        sizes = [store.get_file_info(at).size or 0 for store, at in map(_store, paths)]  # what can't be read fails in the reader
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])


def _range_reader(row_bytes: int, overlap: int, lenient: bool):
    def run(batches):
        for batch in batches:
            for path, length, part in zip(*(c.to_pylist() for c in batch.columns)):
                lo, hi = max(part * row_bytes - overlap, 0), min((part + 1) * row_bytes + overlap, length)
                store, at = _store(path)
                try:
                    with store.open_input_file(at) as f:
                        f.seek(lo)
                        raw = f.read(hi - lo)
                    cut = 0
                    while lo and cut < 4 and cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                        cut += 1  # the tail of a character of the range before
                    end = len(raw)
                    if hi < length:  # the head of a character of the range behind
                        end -= next((k for k in range(1, 5) if k <= end and raw[end - k] & 0xC0 != 0x80 and not _whole(raw[end - k :])), 0)
                    text, status, error = raw[cut:end].decode("utf-8", "ignore" if lenient else "strict"), "ok", None
                    base = lo + cut
                except (UnicodeDecodeError, OSError) as exc:
                    text, base, status, error = None, lo, "error", f"{type(exc).__name__}: {exc}"[:500]
                row = [[path], [text], [part], [base], [status], [error]]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["path", "text", "part", "base", "status", "error"])

    return run


def _whole(raw: bytes) -> bool:
    """Whether bytes that begin a character hold all of it."""
    first = raw[0]
    return len(raw) >= (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)


def own_spans(rows: DataFrame, spans_col: str = "spans", text_col: str = "text", row_bytes: int = ROW_BYTES) -> DataFrame:
    """The spans of files read in ranges, as rows (path, entity_type, start, end, score, raw_txt) with byte offsets in the
    file: of a row's spans those that begin in its own range."""
    at = F.col("base") + F.octet_length(F.expr(f"substring(`{text_col}`, 1, s.start)"))
    spans = explode_nonempty(rows, ["path", "part", "base", text_col], spans_col, alias="s").withColumn("at", at)
    own = (F.col("at") >= F.col("part") * F.lit(row_bytes)) & (F.col("at") < (F.col("part") + 1) * F.lit(row_bytes))
    return spans.where(own).select("path", "s.entity_type", F.col("at").alias("start"), (F.col("at") + F.octet_length("s.raw_txt")).alias("end"), "s.score", "s.raw_txt")


def file_name(path) -> F.Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def path_suffix(path) -> F.Column:
    """Python ``Path.suffix``: last '.x' of the name, none for dot-files."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def classify_file_type(df: DataFrame, path_col: str = "path", out: str = "type", variant: str = "backend") -> DataFrame:
    """``backend`` -- .pdf/.docx by suffix, everything else text;
    ``legacy`` -- txt/md/log text, docx, doc, pdf, else binary."""
    p = F.col(path_col)
    if variant == "backend":
        ext = F.lower(path_suffix(p))
        t = F.when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").otherwise("text")
    else:
        name = F.lower(file_name(p))
        ext = F.when(name.contains("."), F.regexp_extract(name, r"\.([^.]*)$", 1)).otherwise(F.lit(""))
        t = (F.when(ext.isin(*LEGACY_TEXT_EXTENSIONS), "text").when(ext == "docx", "docx")
             .when(ext == "doc", "doc").when(ext == "pdf", "pdf").otherwise("binary"))
    return df.withColumn(out, t)


def select_input_files(df: DataFrame, path_col: str = "path", order_col: str = "arrival",
                       max_files: int | None = None, by: str = "name") -> DataFrame:
    """Drop '~$' temp files and unaccepted extensions, keep the first file
    per name (``by="name"``, the upload page) or per path (``by="path"``, the
    backend), in arrival order; ``max_files`` is the upload limit, where wanted.

    Equal arrivals are decided by the path.  The first row of a name is a
    grouped minimum, so a name that fills the listing is combined map-side."""
    name = file_name(F.col(path_col))
    ext = F.lower(F.element_at(F.split(name, r"\.", -1), -1))
    ok = df.withColumn("name", name).filter(~F.col("name").startswith("~$")).filter(ext.isin(*ACCEPTED_EXTENSIONS))
    row = F.struct(*[F.col(f"`{c}`") for c in ok.columns])
    key = F.col("name") if by == "name" else F.col(path_col)
    first = ok.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(order_col, path_col)).alias("_row")).select("_row.*")
    if max_files is None:
        return first
    return first.orderBy(order_col, path_col).limit(max_files)


def output_name(df: DataFrame, path_col: str = "path", out: str = "output_name") -> DataFrame:
    """S05: '{stem}_deid{ext}' with the suffix lower-cased, '.txt' if none."""
    name = file_name(F.col(path_col))
    suffix = path_suffix(F.col(path_col))
    stem = F.when(suffix == "", name).otherwise(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1))
    ext = F.when(suffix == "", F.lit(".txt")).otherwise(F.lower(suffix))
    return df.withColumn(out, F.concat(stem, F.lit("_deid"), ext))


def write_deidentified(df: DataFrame, path: str, fmt: str = "parquet", text_col: str = "text_deid",
                       path_col: str | None = None) -> None:
    """Write the cleaned documents (create target, overwrite).

    ``fmt="files"`` writes one file a document, named as S05 says (``path_col`` holds the
    source path), with the text byte for byte; ``fmt="text"`` puts each of them into a
    folder ``_name=<name>`` of its own, which Spark reads back as a column.  Files of
    other names stay.  Two documents of one name are an error, raised before anything
    is written."""
    if fmt not in ("files", "text"):
        df.write.mode("overwrite").format(fmt).save(path)
        return
    spark = df.sparkSession
    show_package(spark)
    named = output_name(df, path_col or "path", "name").select("name", F.col(text_col).cast("binary").alias("text"))
    twice = named.groupBy("name").count().where("count > 1").select("name").limit(5).collect()
    if twice:
        raise ValueError(f"several documents would be written as {', '.join(sorted(r['name'] for r in twice))}")
    spark.dataSource.register(DocumentFiles)
    (named.write.format(FORMAT).mode("append").option("path", path).option("layout", "folders" if fmt == "text" else "flat").save())


def result_manifest(files: DataFrame, path_col: str = "path", out_dir: str = "processed",
                    text_col: str = "text_deid") -> DataFrame:
    """One row per input -- output name, type, output path, status,
    error.  A file whose text could not be produced gets status 'error'."""
    df = output_name(classify_file_type(files, path_col), path_col)
    failed = F.col(text_col).isNull()
    return df.select(
        F.col(path_col).alias("src"),
        F.when(failed, file_name(F.col(path_col))).otherwise(F.col("output_name")).alias("file_name"),
        "type",
        F.when(failed, F.lit(None).cast("string")).otherwise(F.concat(F.lit(out_dir + "/"), F.col("output_name"))).alias("output_path"),
        F.when(failed, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        F.when(failed, F.lit("no text")).alias("error"),
    )


def export_list(manifest: DataFrame) -> DataFrame:
    """S07 export part: ``{file: basename, src: path}`` de-duplicated by source.

    The status hangs on the whole plan that made the text.  A filter on it would be pushed
    below that plan's projections and hold all of them written out; so the rows are
    chosen by a generated column (see ``explode_nonempty``)."""
    path = F.when(F.col("status") == "ok", F.struct("output_path"))
    ok = explode_nonempty(manifest, [], F.array(path), alias="s").select("s.output_path")
    return ok.select(file_name(F.col("output_path")).alias("file"), F.col("output_path").alias("src")).dropDuplicates(["src"])


def write_manifest(manifest: DataFrame, path: str) -> None:
    """S07 as JSON lines, with the ``fileUrl`` of each output."""
    url = F.when(F.col("output_path").isNotNull(), F.concat(F.lit("file:///"), F.regexp_replace("output_path", "^/+", "")))
    manifest.withColumn("fileUrl", url).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
