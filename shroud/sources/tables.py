"""Table sources (S02) and the derived test corpora.

The driver's tables hold one row group per file, so a plain scan gives one
task; the registered queries pass ``scan_width`` to deal such rows out.  At scale
the files are many and large, and the scan alone is wide enough.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows to ``partitions`` tasks, where a number is given and the
    scan has fewer files; else the scan's own partitioning (no shuffle).  Only
    file listings are looked at: no job runs."""
    if partitions is None or len(df.inputFiles()) >= partitions:
        return df
    return df.repartition(partitions)


def scan_width(spark: SparkSession) -> int:
    """Tasks for the driver's tables, which are single files of one row group."""
    return spark.sparkContext.defaultParallelism * 2


def read_table_documents(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id",
                         text_col: str = "text", keep=(), partitions: int | None = None) -> DataFrame:
    """A table column as the document source -> (doc_id, text, ...)."""
    df = table(spark, sf_dir, name).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    return spread(df, partitions)


# The derived corpus of Taiwan formats, MAC and e-mail, built from
# ``customer`` identically in Spark SQL and DuckDB (FIXTURES.md section 3).
CUSTOMER_CORPUS_SQL = (
    "SELECT c_custkey AS doc_id, concat('ID A', cast(1 + c_custkey % 2 as string), "
    "lpad(cast(c_custkey as string), 8, '0'), ' UBN ', lpad(cast((c_custkey * 7919) % 100000000 as string), 8, '0'), "
    "' call 09', lpad(cast(c_custkey % 100 as string), 2, '0'), '-', lpad(cast(c_custkey % 1000 as string), 3, '0'), "
    "'-', lpad(cast((c_custkey * 7) % 1000 as string), 3, '0'), ' tel 02-', lpad(cast(c_custkey as string), 8, '1'), "
    "' joined ', cast(1 + c_custkey % 40 as string), ' years ago, mail cust', cast(c_custkey as string), "
    "'@example.com NHI card 0000', lpad(cast(c_custkey as string), 8, '0'), ' MAC 00:1A:2B:3C:4D:', "
    "lpad(cast(c_custkey % 100 as string), 2, '0')) AS text FROM customer"
)

# Orders corpus: dates in several shapes, a nation name (LOCATION) and the
# customer name; joins orders -> customer -> nation.
ORDERS_CORPUS_SQL = (
    "SELECT o_orderkey AS doc_id, concat('Order of ', c_name, ' placed ', "
    "cast(cast(o_orderdate as date) as string), ' (', "
    "lpad(cast(extract(day from o_orderdate) as string), 2, '0'), '/', "
    "lpad(cast(extract(month from o_orderdate) as string), 2, '0'), '/', cast(extract(year from o_orderdate) as string), "
    "') ships to ', n_name, ' within 3 days, priority ', o_orderpriority) AS text "
    "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
)


def _n(digits: int, expr: str = "c_custkey") -> str:
    """The last ``digits`` digits of a number, zero-padded."""
    return f"lpad(cast(({expr}) % {10**digits} as string), {digits}, '0')"


def _nhs_sql() -> str:
    """Ten digits whose last is the modulus-11 check digit (none where that would be 10)."""
    nine = f"concat('4', {_n(8, 'c_custkey * 7919')})"  # a leading 0 would make it a landline
    total = " + ".join(f"cast(substring({nine}, {i + 1}, 1) as bigint) * {10 - i}" for i in range(9))
    return f"concat({nine}, cast((11 - ({total}) % 11) % 11 as string))"


# Chinese names, which stand in running text without spaces.
CJK_PERSON = ("concat(substring('王李張陳林黃吳劉', cast(n_nationkey % 8 + 1 as int), 1), '小', "
              "substring('明華美強芳玲偉', cast(n_nationkey % 7 + 1 as int), 1))")
CJK_PLACE = "concat(substring('東西南北中', cast(r_regionkey % 5 + 1 as int), 1), '城市')"

# Forms corpus: one shape per customer in turn -- phones, durations, ids with
# computed check digits, dates, names, and texts that are null, empty or blank.
FORMS = (
    f"concat('mobile +886 9', {_n(2)}, ' ', {_n(3)}, ' 345 end')",
    f"concat('mobile (+886) 9', {_n(2)}, ' ', {_n(3)}, ' 678 end')",
    f"concat('mobile +886 9', {_n(8)}, ' end')",
    f"concat('mobile +8869', {_n(8)}, ' end')",
    "concat('工作 ', cast(1 + c_custkey % 9 as string), ' 年 , ', cast(1 + c_custkey % 11 as string), ' 個月 .')",
    "concat('she is ', cast(20 + c_custkey % 60 as string), ' years old .')",
    "concat('has ', cast(1 + c_custkey % 30 as string), ' years of experience , ', cast(1 + c_custkey % 5 as string), ' months of service')",
    "concat('takes ', cast(c_custkey % 7 as string), '-', cast(7 + c_custkey % 9 as string), ' weeks or about ', cast(1 + c_custkey % 12 as string), ' months , 2.5 days')",
    f"concat('landline (02) 2', {_n(6)}, ' and (0', cast(3 + c_custkey % 5 as string), ')', {_n(7)}, ' end')",
    f"concat('landline +886 2 2', {_n(7)}, ' or 02', {_n(8)}, ' end')",
    f"concat('MAC 00-1a-2b-3c-4d-', {_n(2)}, ' and 001a.2b3c.', {_n(4)}, ' end')",
    "concat('MAC ', CASE WHEN c_custkey % 2 = 0 THEN '00:00:00:00:00:00' ELSE 'ff:ff:ff:ff:ff:ff' END, ' or ', CASE WHEN c_custkey % 3 = 0 THEN '0000.0000.0000' ELSE 'ffff.ffff.ffff' END, ' end')",
    f"concat('call 09', {_n(8)}, ' or 212-555-', {_n(4)}, ' or +9', {_n(8)}, ' id A1', {_n(8)}, ' now')",
    f"concat('ssn 123-45-', lpad(cast(1 + c_custkey % 9999 as string), 4, '0'), ' itin 912-70-', {_n(4)}, ' end')",
    f"concat('passport C', {_n(8)}, ' , passport 3', {_n(7)}, ' , account 12', {_n(8)}, ' end')",
    f"concat('driver license D', {_n(7)}, ' , medical license AB', {_n(6)}, ' end')",
    f"concat('iban DE', lpad(cast(98 - (c_custkey * 1000000 + 131400) % 97 as string), 2, '0'), {_n(18)}, ' , DE00', {_n(18)}, ' end')",
    f"concat('nhs ', {_nhs_sql()}, ' end')",
    f"concat('national insurance AB ', {_n(2)}, ' ', {_n(2, 'c_custkey * 7')}, ' ', {_n(2, 'c_custkey * 13')}, ' C end')",
    "concat('wallet 1BoatSLRHtKNngkdXEeobR76b', replace(cast(c_custkey as string), '0', '9'), 'x end')",
    "concat('host 2001:db8:0:0:0:0:0:', cast(c_custkey % 9999 as string), ' and 10.1.', cast(c_custkey % 256 as string), '.7 end')",
    "concat('see https://example.org/p/', cast(c_custkey as string), '?q=1 , and http://a.example/x.')",
    "concat('born ', lpad(cast(1 + c_custkey % 28 as string), 2, '0'), '-03-1995 , or 199503', lpad(cast(1 + c_custkey % 28 as string), 2, '0'), ' , or 08-25-25')",
    "concat('next Monday , March 20', lpad(cast(c_custkey % 30 as string), 2, '0'), ' , recently , 17 March 2021 , Mar 5th, 2020')",
    "concat('at 2021/03/', lpad(cast(1 + c_custkey % 28 as string), 2, '0'), ' 10:22 , 09/27/2024 09:56 PM , 17.03.1995 , 2025.08.25')",
    "concat('日期 2021 年 3 月 ', cast(1 + c_custkey % 28 as string), ' 日 , 民國 110 年 3 月 5 日 , 明天 見')",
    "concat('week 2021-W', lpad(cast(1 + c_custkey % 52 as string), 2, '0'), ' , Q3 2021 , 2025-Q4 , 2025-08-25T00:00:00 , last night')",
    f"concat('NHI card 0000', {_n(8)}, ' 健保 end')",
    "concat('signed Anna Maria van ', n_name, ' of Bank of ', r_name, ' in ', n_name, ' .')",
    "concat('mail ', n_name, '@example.com or Anna Maria van ', n_name, ' today')",
    "concat('paid to Granite Works ', cast(r_regionkey as string), ' by Quiet River Trust , not by Granite Works ', cast(r_regionkey as string), '7 .')",
    f"concat('昨天', {CJK_PERSON}, '在', {CJK_PLACE}, '與北方電子公司的代表見面,', {CJK_PERSON}, '說再見。')",
    f"concat('Sato met ', {CJK_PERSON}, 'さん and ', {CJK_PERSON}, ' of ', n_name, '及', {CJK_PLACE}, n_name, 'x')",
    "concat('in ', cast(1 + c_custkey % 9 as string), ' days , ', cast(1 + c_custkey % 9 as string), ' weeks from now , this coming month')",
    "cast(null as string)",
    "''",
    "'   '",
)
FORMS_CORPUS_SQL = (
    "SELECT c_custkey AS doc_id, CASE c_custkey % " + str(len(FORMS)) + " "
    + " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(FORMS))
    + " END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)


def sql_over_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run ``sql`` with its ``FROM`` / ``JOIN`` tables bound to the driver's
    parquet files as DataFrame parameters -- no temp views are registered,
    so the caller's session catalog is left untouched."""
    names = sorted(set(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql)))
    bound = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m.group(1)} {{{m.group(2)}}}", sql)
    return spark.sql(bound, **{n: table(spark, sf_dir, n) for n in names})


def customer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(sql_over_tables(spark, sf_dir, CUSTOMER_CORPUS_SQL), scan_width(spark))


def orders_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(sql_over_tables(spark, sf_dir, ORDERS_CORPUS_SQL), scan_width(spark))


def forms_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(sql_over_tables(spark, sf_dir, FORMS_CORPUS_SQL), scan_width(spark))


# Names beside the plain ones: persons and organisations of several words.
LONG_NAMES_SQL = (
    "SELECT 'PERSON' AS entity_type, concat('Anna Maria van ', n_name) AS phrase FROM nation",
    "SELECT 'ORGANIZATION' AS entity_type, concat('Bank of ', r_name) AS phrase FROM region",
    "SELECT 'ORGANIZATION' AS entity_type, concat('Granite Works ', cast(r_regionkey as string)) AS phrase FROM region",
    "SELECT DISTINCT 'ORGANIZATION' AS entity_type, 'Quiet River Trust' AS phrase FROM region",
    "SELECT DISTINCT 'ORGANIZATION' AS entity_type, '北方電子公司' AS phrase FROM region",
    f"SELECT 'PERSON' AS entity_type, {CJK_PERSON} AS phrase FROM nation",
    f"SELECT 'LOCATION' AS entity_type, {CJK_PLACE} AS phrase FROM region",
)


def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (sql_over_tables(spark, sf_dir, q) for q in LONG_NAMES_SQL))


# Texts of over 200,000 words with names all through them, in Latin script and without spaces.
LONG_TEXTS_SQL = (
    "SELECT r_regionkey AS doc_id, repeat(concat('the ', lower(r_name), ' way to ', r_name, ' with Bank of ', r_name, "
    f"' or ', r_name, 's , Quiet River Trust ', {CJK_PLACE}, '說 '), 14500) AS text FROM region"
)


def long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(sql_over_tables(spark, sf_dir, LONG_TEXTS_SQL), scan_width(spark))


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing derived from ``documents``: one path per document,
    extension by document id, arrival = doc_id (for S03-S07)."""
    exts = "array('txt', 'pdf', 'docx', 'doc', 'md', 'csv', 'html', 'json', 'log', 'bin', 'TXT', '')"
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("arrival"),
        F.expr(f"concat('/in/', source, '/', CASE WHEN doc_id % 17 = 0 THEN '~$' ELSE '' END, lang, '_', "
               f"cast(doc_id % 97 as string), CASE WHEN element_at({exts}, cast(doc_id % 12 as int) + 1) = '' THEN '' "
               f"ELSE concat('.', element_at({exts}, cast(doc_id % 12 as int) + 1)) END)").alias("path"),
        F.col("text"),
    )
