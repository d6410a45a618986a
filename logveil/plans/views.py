"""Inputs of the registered queries, made from the given tables; each as Spark and as SQL.

``files`` gives the documents names, sizes and contents of many kinds, so that
classification has something to tell apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.sources import synth
from logveil.sources.files import join_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.log_lines(table(spark, sf_dir, "events"))


def log_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_lines(log_lines(spark, sf_dir), "doc_id", "line_no", "line")


EXTENSIONS = (".log", ".TXT", ".json", ".bin", ".xml", ".yaml", ".png", ".properties", ".Html", "", ".conf", ".gz")
_FILES = (
    "SELECT doc_id, concat('logs/', source, '/', CASE doc_id % 7 WHEN 0 THEN 'NUL' WHEN 1 THEN 'com1.old' "
    "WHEN 2 THEN 'lpt9' ELSE concat('doc', doc_id) END, CASE doc_id % {n} {extensions} END) AS path, "
    "cast(octet_length({bytes}) * 400 AS bigint) AS size, text FROM documents")
_HEX = (
    "CASE doc_id % 6 WHEN 0 THEN concat('00', hex(text)) WHEN 1 THEN concat('E920', hex(text)) "
    "WHEN 2 THEN concat('FFFE', regexp_replace(hex(source), '(..)', '{group}00'{all})) "
    "WHEN 3 THEN concat('0102030405060708', hex(source)) "
    "WHEN 4 THEN concat(substr(hex(text), 1, 0), '') ELSE hex(text) END")


def files_sql(dialect: str = "spark") -> str:
    extensions = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS))
    return _FILES.format(n=len(EXTENSIONS), extensions=extensions, bytes="text" if dialect == "spark" else "encode(text)")


def contents_sql(dialect: str = "spark") -> str:
    """``(doc_id, hexed)``: the bytes of each file, in hexadecimal."""
    spark = dialect == "spark"
    return f"SELECT doc_id, {_HEX.format(group='$1' if spark else chr(92) + '1', all='' if spark else chr(44) + chr(39) + 'g' + chr(39))} AS hexed FROM documents"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(files_sql().replace("FROM documents", "FROM {documents}"),
                     documents=table(spark, sf_dir, "documents"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, content)`` with NULs, control bytes, Latin-1, UTF-16 and empty files among them."""
    hexed = spark.sql(contents_sql().replace("FROM documents", "FROM {documents}"),
                      documents=table(spark, sf_dir, "documents"))
    return hexed.select("doc_id", F.unhex("hexed").alias("content"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, content)``: the contents under their names, some of them cut UTF-16 or with a zero at the very end."""
    named = files(spark, sf_dir).select("doc_id", "path").join(contents(spark, sf_dir), "doc_id")
    return named.withColumn("content", F.expr(
        "CASE WHEN doc_id % 10 = 0 THEN X'FFFE00' WHEN doc_id % 15 = 5 THEN concat(content, X'00') ELSE content END"))


def log_files_sql(dialect: str = "spark") -> str:
    """``(path, kind, text)`` of log documents as files: device names among them, binaries, and logs with a zero byte at the end."""
    return ("SELECT doc_id, concat('d', doc_id % 3, '/', CASE doc_id % 5 WHEN 0 THEN concat('NUL.', doc_id, '/x.log') WHEN 1 THEN concat('doc', doc_id, '.TXT') "
            "WHEN 2 THEN concat('image', doc_id, '.png') WHEN 3 THEN concat('cut', doc_id, '.json') ELSE concat('doc', doc_id, '/a b.conf') END) AS path, "
            "CASE doc_id % 5 WHEN 2 THEN 'copied' WHEN 3 THEN 'quarantined' ELSE 'redacted' END AS kind, text FROM documents")


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, content)`` of the same."""
    found = spark.sql(log_files_sql().replace("FROM documents", "FROM {documents}"), documents=log_docs(spark, sf_dir))
    return found.select("path", F.expr("IF(kind = 'quarantined', concat(cast(text AS binary), X'00'), cast(text AS binary))").alias("content"))
