"""Dictionaries at their edges: many buckets, hot values, and batches that arrive one by one."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from logveil.functions.rules import Catalogue, Rule
from logveil.operators import pseudonyms
from logveil.operators.redact import redact_corpus, redact_documents, redact_lines
from logveil.streaming.incremental import batch_redactor, read_dictionary, redact_stream
from logveil.streaming.masks import mask_stream, windowed_counts


def test_dense_numbers_equal_one_window(spark):
    values = spark.range(5000).select(
        (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("v"), "id") \
        .withColumn("b", F.floor(F.col("v") / 1000))
    dense = pseudonyms.dense_numbers(values, ["g"], "b", ["v", "id"], "n")
    want = values.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert dense.select("g", "id", "n").exceptAll(want.select("g", "id", F.col("n").cast("bigint"))).isEmpty()
    assert dense.count() == 5000


def _hot_lines(spark):
    """One user on a third of all lines, many others once."""
    return spark.range(60_000).select(
        F.lit(1).alias("doc"), (F.col("id") + 1).alias("n"),
        F.when(F.col("id") % 3 == 0, F.lit("user=hot ok")).otherwise(F.concat(F.lit("user=u"), "id")).alias("line"))


def test_hot_values_are_split_off(spark, monkeypatch):
    monkeypatch.setattr(pseudonyms, "LINES_PER_BUCKET", 500)
    done = redact_lines(_hot_lines(spark), "doc", "n", "line", blocks=False)
    rows = {r.n: r.line for r in done.rows.collect()}
    assert len(rows) == 60_000
    assert rows[1] == "user=user001 ok" and rows[2] == "user=user002" and rows[4] == "user=user001 ok"
    assert rows[60_000] == "user=user40001"
    assert len(set(rows.values())) == 40_001


def test_batches_keep_pseudonyms(spark, tmp_path):
    out, dictionary = str(tmp_path / "out"), str(tmp_path / "dictionary")
    run = batch_redactor("doc", "n", "line", out, dictionary)

    def batch(*lines):
        return spark.createDataFrame([(1, i + 1, line) for i, line in enumerate(lines)], "doc int, n bigint, line string")

    def lines(batch_id):
        return [r.line for r in spark.read.parquet(f"{out}/batch={batch_id}").orderBy("n").collect()]
    run(batch("mail a@b.com", "mail c@d.org from 10.0.0.1"), 0)
    first = lines(0)
    run(batch("c@d.org again", "new e@f.net", "user=a@b.com", "plain"), 1)
    second = lines(1)
    assert second[0].split()[0] == first[1].split()[1]
    assert second[1] == "new user003@redacted.com" and second[3] == "plain"
    run(batch("c@d.org again", "new e@f.net", "user=a@b.com", "plain"), 1)
    assert lines(1) == second
    entries = read_dictionary(spark, dictionary)
    assert entries.filter("category = 'email'").count() == 3
    assert entries.groupBy("category", "id").count().filter("count > 1").isEmpty()


def test_stream_and_masks(spark, tmp_path):
    lines = spark.createDataFrame(
        [(1, i + 1, f"user=u{i % 4} password=x{i}", f"2024-01-01 00:0{i}:00") for i in range(8)],
        "doc int, n bigint, line string, at string").withColumn("at", F.to_timestamp("at"))
    lines.repartitionByRange(4, "n").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    redact_stream(arriving, "doc", "n", "line", str(tmp_path / "out"), str(tmp_path / "dictionary"),
                  str(tmp_path / "checkpoint"), available_now=True, blocks=False).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    by_user = {}
    for r in rows:
        by_user.setdefault((r.n - 1) % 4, set()).add(r.line)
    assert len(rows) == 8 and all(len(v) == 1 for v in by_user.values()) and len(by_user) == 4

    def finished(df, mode, name):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name).collect()
    masked = finished(mask_stream(arriving, "line"), "append", "masked")
    assert all(r.line.endswith("password=PASSWORD_REDACTED") and "user=u" in r.line for r in masked)
    counts = finished(windowed_counts(arriving, "line", "at", "4 minutes", "1 minute"), "complete", "windowed")
    assert sorted((r.category, r.n) for r in counts) == [("password", 4), ("password", 4), ("username", 4), ("username", 4)]


def test_rows_without_an_id_are_kept(spark):
    lines = spark.createDataFrame([(None, 1, "a@b.com"), (None, 2, "user=x"), ("d", 1, "a@b.com c@d.org"), ("d", None, "user=x")],
                                  "doc string, n bigint, line string")
    lines = lines.unionByName(spark.createDataFrame(
        [(None, 3, "SELECT a"), (None, 4, "  FROM b"), (None, 5, "-----BEGIN CERTIFICATE-----"), (None, 6, "x"),
         (None, 7, "-----END CERTIFICATE-----"), (None, None, "plain")], lines.schema))
    done = redact_lines(lines, "doc", "n", "line")
    assert sorted(r.line for r in done.rows.collect()) == [
        "CERTIFICATE_REDACTED", "QUERY_REDACTED", "plain", "user001@redacted.com",
        "user001@redacted.com user002@redacted.com", "user=user001", "user=user001"]


def test_rules_of_one_category_share_its_numbers(spark):
    rules = Catalogue.builtin().add("hostname", r"\b[a-z]+\.mycompany\.com\b", "{UNIQUE}.redacted", ["mycompany"]) \
        .add("ticket", r"INC-\d+", "{UNIQUE}", ["inc-"]).add("ticket", r"CHG-\d+|INC-\d+", "{UNIQUE}", ["chg-"])
    docs = spark.createDataFrame([(1, "server1.local and x.mycompany.com\nINC-1 CHG-2 y.mycompany.com"), (2, "CHG-9"), (3, None)], "doc int, text string")
    texts = {r.doc: r.text for r in redact_documents(docs, "text", rules).collect()}
    assert texts == {1: "host001.redacted and host002.redacted\nTICKET_001 TICKET_002 host003.redacted", 2: "TICKET_001", 3: None}
    done = redact_corpus(docs, "doc", "text", rules)
    found = done.dictionary.collect()
    assert len(found) == 6 and len({(r.category, r.id) for r in found}) == 6 and len({r.replacement for r in found}) == 6
    more = redact_corpus(docs.select("doc", F.concat("text", F.lit(" z.mycompany.com")).alias("text")), "doc", "text", rules, done.entries)
    assert [(r.original, r.id) for r in more.dictionary.collect()] == [("z.mycompany.com", 4)]


def test_dictionary_of_a_later_run_is_whole(spark):
    first = redact_corpus(spark.createDataFrame([(1, "site=/views/a0/b")], "doc int, text string"), "doc", "text")
    later = redact_corpus(spark.createDataFrame([(2, "site=/views/a0/c and wb=/views/a0")], "doc int, text string"), "doc", "text", known=first.entries)
    assert later.dictionary.count() == later.entries.count()
    assert all(r.original[-1].isalnum() and not r.original.endswith("entity") for r in later.dictionary.collect())


def test_own_catalogue_with_ids_from_zero(spark):
    rules = Catalogue([Rule(0, "ticket", r"INC\d+", "{UNIQUE}", ("inc",))])
    docs = spark.createDataFrame([(1, "see INC77\nINC5 INC77")], "doc int, text string")
    assert redact_documents(docs, "text", rules).first().text == "see TICKET_001\nTICKET_002 TICKET_001"


def test_dictionary_before_the_first_batch_is_empty(spark, tmp_path):
    assert read_dictionary(spark, str(tmp_path / "none")).count() == 0
