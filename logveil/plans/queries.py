"""The registered queries: one per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logveil.functions import files as P
from logveil.functions import text as T
from logveil.functions.rules import Catalogue, Rule
from logveil.operators import audits, reports
from logveil.operators.blocks import collapse_blocks
from logveil.operators.detect import count, detect, mask
from logveil.operators.redact import findings, redact_corpus, redact_documents, redact_lines
from logveil.operators.scan import redact_lines_scan as scan_lines
from logveil.operators.tree import redact_tree
from logveil.plans import views
from logveil.plans.views import table
from logveil.sources import files as sources
from logveil.sources import synth
from logveil.sources.staging import scratch, staged
from logveil.streaming.incremental import quarantine, read_dictionary, redact_stream
from logveil.streaming.blocks import BlockRedactor, redact_blocks_stream
from logveil.sources.tree import unseen_files, write_tree
from logveil.streaming.dictionary import DictionaryLog
from logveil.streaming.files import FileRouter, arriving_files, files_together, route_stream
from logveil.streaming.masks import mask_stream, running_counts

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE = Catalogue.builtin()
CUSTOM = CATALOGUE.add("ticket", r"\b(?:INC|CHG)-?\d{4,}\b|iid=\d+", "{UNIQUE}", ["inc", "chg", "iid="])
STATIC = CATALOGUE.select(rule_ids=[r.rule_id for r in CATALOGUE if not r.is_unique])
#: Two added rules of one category, and one of a built-in category.
SAME = CATALOGUE.add("ticket", r"iid=\d+", "{UNIQUE}", ["iid="]).add("ticket", r"attempt \d+", "{UNIQUE}", ["attempt "]) \
    .add("hostname", r"org\.sample\.[A-Za-z]+", "{UNIQUE}.redacted", ["org.sample"])
#: A rule whose repeated group has alternatives.
RUNS = CATALOGUE.add("run", r"(?:[a-z]+-|[0-9]+:)+[A-Z]", "RUN_REDACTED", ["-", ":"])
BIGINT = "cast({} AS bigint)".format


# --- one rule by itself --------------------------------------------------------

def detect_rule(rule: Rule, spark: SparkSession, sf_dir: str) -> DataFrame:
    if rule.multiline:
        return detect(views.log_docs(spark, sf_dir), ["doc_id"], "text", rule, CATALOGUE)
    return detect(views.log_lines(spark, sf_dir), ["doc_id", "line_no"], "line", rule, CATALOGUE)


def count_rule(rule: Rule, spark: SparkSession, sf_dir: str) -> DataFrame:
    if rule.multiline:
        return count(views.log_docs(spark, sf_dir), "text", rule, CATALOGUE)
    return count(views.log_lines(spark, sf_dir), "line", rule, CATALOGUE)


def redact_rule(rule: Rule, spark: SparkSession, sf_dir: str) -> DataFrame:
    only = CATALOGUE.select(rule_ids=[rule.rule_id])
    return redact_documents(views.log_docs(spark, sf_dir), "text", only).select("doc_id", "text")


def documents_rule(name: str, key: str, text: str, rule_id: int, spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, name), key.split(","), text, CATALOGUE[rule_id], CATALOGUE)


# --- gates, classes, preparation -------------------------------------------------

def keyword_prefilter(spark, sf_dir):
    return views.log_lines(spark, sf_dir).select(
        "doc_id", "line_no", F.expr(T.may_have_matches("line", CATALOGUE)).alias("may_match"))


def present_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.expr(T.present_keywords("text", CATALOGUE)), "|").alias("keywords"))


def applicable_rules(spark, sf_dir):
    return views.log_lines(spark, sf_dir).select(
        "doc_id", "line_no", F.array_join(F.expr(T.applicable_rules("line", CATALOGUE)), ",").alias("rules"))


def multiline_gate(spark, sf_dir):
    low = table(spark, sf_dir, "documents").withColumn("low", F.lower("text"))
    return low.select("doc_id", *[F.expr(T.gate("low", r)).alias(r.category) for r in CATALOGUE.text_rules])


def candidate_lines(spark, sf_dir):
    """Lines on which some rule matches, and how many of them the fast path would miss."""
    done = _lines_redacted(spark, sf_dir)
    candidate = F.expr(T.matches("before", T.candidate_regex(CATALOGUE)))
    return done.filter("size(hits) > 0").agg(
        F.count("*").alias("changed"), F.count_if(~candidate).alias("missed"))


def classify_files(spark, sf_dir):
    return sources.manifest(views.files(spark, sf_dir))


def size_class(spark, sf_dir):
    return sources.manifest(views.files(spark, sf_dir)).groupBy("size_class").agg(F.count("*").alias("files"))


def binary_sniff(spark, sf_dir):
    return views.contents(spark, sf_dir).select("doc_id", F.expr(P.looks_binary("content")).alias("is_binary"))


def tree_routing(spark, sf_dir):
    """What becomes of each file; none is left out."""
    found = views.tree(spark, sf_dir)
    outcomes = {"redacted": sources.text_files, "copied": sources.untouched_files, "quarantined": sources.rejected_files}
    return reduce(DataFrame.unionByName, (of(found).select("doc_id", F.lit(name).alias("outcome")) for name, of in outcomes.items()))


def decode_text(spark, sf_dir):
    return views.contents(spark, sf_dir).withColumn("encoding", F.expr(P.encoding("content"))) \
        .withColumn("decoded", F.expr(P.decoded("content"))) \
        .select("doc_id", "encoding", F.length("decoded").cast("bigint").alias("chars"), F.md5("decoded").alias("digest"))


def line_split(spark, sf_dir):
    return sources.split_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def line_reassemble(spark, sf_dir):
    return sources.join_lines(line_split(spark, sf_dir), "doc_id", "line_no", "line")


def sanitize_path(spark, sf_dir):
    return views.files(spark, sf_dir).select("doc_id", F.expr(P.sanitized_path("path")).alias("path"))


def output_path(spark, sf_dir):
    return views.files(spark, sf_dir).select("doc_id", F.expr(P.output_root("path")).alias("root"))


def file_roundtrip(spark, sf_dir):
    """Documents written as a file tree, scanned as files and as lines, and compared."""
    root = scratch(spark, "tree")
    docs = table(spark, sf_dir, "documents")
    sources.split_lines(docs, "doc_id", "text").select(
        F.concat(F.lit("d"), (F.col("doc_id") % 8).cast("string")).alias("part"),
        F.concat_ws(" ", "doc_id", "line_no", "line").alias("value")) \
        .repartitionById(8, F.expr("coalesce(cast(substr(part, -1) AS int), 0)")).write.mode("overwrite").partitionBy("part").text(root)
    found = sources.scan_files(spark, root, "*.txt").groupBy(F.substring_index("path", "/", 1).alias("part")) \
        .agg(F.sum("size").cast("bigint").alias("bytes"))
    lines = sources.scan_lines(spark, root, "*.txt").groupBy(F.substring_index("path", "/", 1).alias("part")) \
        .agg(F.count("*").alias("lines"), F.sum("line_no").cast("bigint").alias("line_nos"))
    return found.join(lines, "part")


def encoded_lines(spark, sf_dir):
    """Documents written as files in four encodings and read as lines; two of their letters look like a line feed when cut."""
    root = scratch(spark, "encoded")
    text = "regexp_replace(text, '[^\\u0000-\\u00FF]', '?')"
    content = (f"CASE doc_id % 4 WHEN 0 THEN cast(text AS binary) WHEN 1 THEN encode(concat('é', {text}), 'ISO-8859-1') "
               "WHEN 2 THEN concat(X'FFFE', encode(concat('\u0a05\u4e00', text), 'UTF-16LE')) "
               "ELSE concat(X'FEFF', encode(concat('\u4e00\u0a05', text), 'UTF-16BE')) END")
    docs = table(spark, sf_dir, "documents")
    write_tree(spark, docs.select(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".log")).alias("path"),
                                  F.expr(content).alias("content")).repartition(8), root)
    return sources.scan_encoded_lines(spark, root).select("path", "line_no", F.md5("line").alias("digest"))


# --- synthetic logs --------------------------------------------------------------

def synth_log_lines(spark, sf_dir):
    return views.log_lines(spark, sf_dir)


def synth_expected_counts(spark, sf_dir):
    return synth.audit_expected(table(spark, sf_dir, "events"), "event_id")


def synth_mix(permille: int, spark, sf_dir):
    return synth.mixed_lines(table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number")), "number", permille)


# --- redaction ---------------------------------------------------------------------

def redact_static(spark, sf_dir):
    masked = mask(views.log_lines(spark, sf_dir), "line", CATALOGUE)
    return masked.select("doc_id", "line_no", "line")


def redact_full_doc(spark, sf_dir):
    return redact_documents(views.log_docs(spark, sf_dir), "text").select("doc_id", "text")


def redact_full_corpus(spark, sf_dir):
    return redact_corpus(views.log_docs(spark, sf_dir), "doc_id", "text").rows.select("doc_id", "text")


def redact_subset(spark, sf_dir):
    only = CATALOGUE.select(categories=["email", "internal_ip", "hostname", "username"])
    return redact_documents(views.log_docs(spark, sf_dir), "text", only).select("doc_id", "text")


def redact_custom(spark, sf_dir):
    return redact_documents(views.log_docs(spark, sf_dir), "text", CUSTOM).select("doc_id", "text")


def redact_custom_same_category(spark, sf_dir):
    """Categories with several rules have one row of numbers."""
    return redact_documents(views.log_docs(spark, sf_dir), "text", SAME).select("doc_id", "text")


def pseudonym_dictionary_same_category(spark, sf_dir):
    return redact_corpus(views.log_docs(spark, sf_dir), "doc_id", "text", SAME).dictionary


def redact_long_lines(spark, sf_dir):
    """Every log document as a single line, under all rules and one that repeats a group."""
    docs = views.log_docs(spark, sf_dir).withColumn("text", F.expr("replace(text, '\\n', ' ')"))
    return redact_documents(docs, "text", RUNS).select("doc_id", "text")


def redact_lines_doc(spark, sf_dir):
    """The same as ``redact_full_doc`` by way of lines and barriers, counted per category."""
    lines = views.log_lines(spark, sf_dir)
    done = redact_lines(lines, "doc_id", "line_no", "line")
    return done.rows.groupBy("doc_id").agg(F.count("*").alias("lines"), F.md5(F.expr(
        "array_join(transform(array_sort(collect_list(struct(line_no, line))), x -> x.line), '\\n')")).alias("digest"))


def redact_lines_scan(spark, sf_dir):
    """The same again by way of chunks so short that blocks cross their edges."""
    done = scan_lines(views.log_lines(spark, sf_dir), "doc_id", "line_no", "line", lines_per_chunk=7)
    return sources.join_lines(done.rows, "doc_id", "line_no", "line")


def findings_lines_scan(spark, sf_dir):
    done = scan_lines(views.log_lines(spark, sf_dir), "doc_id", "line_no", "line", lines_per_chunk=7)
    return done.findings.groupBy("doc_id", "category").agg(F.count("*").alias("n"))


def documents_redacted(spark, sf_dir):
    return redact_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), "text") \
        .select("doc_id", "text")


def conversations_redacted(spark, sf_dir):
    done = redact_documents(table(spark, sf_dir, "conversations"), "text")
    return done.select("conv_id", "turn", "role", "text")


def pages_redacted(spark, sf_dir):
    done = redact_documents(table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return done.select("page_id", "html")


def pseudonym_dictionary_doc(spark, sf_dir):
    lines = views.log_lines(spark, sf_dir)
    return redact_lines(lines, "doc_id", "line_no", "line").dictionary


def pseudonym_dictionary_corpus(spark, sf_dir):
    return redact_corpus(views.log_docs(spark, sf_dir), "doc_id", "text").dictionary


def pseudonym_format(spark, sf_dir):
    names = [c for c in CATALOGUE.unique_categories] + ["ticket"]
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") + 1).alias("id"), F.element_at(
        F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int")).alias("category"))
    return rows.select("event_id", F.expr(T.pseudonym("category", "id", names)).alias("replacement"))


def sql_block_islands(spark, sf_dir):
    lines = views.log_lines(spark, sf_dir)
    done = collapse_blocks(lines, "doc_id", "line_no", "line", CATALOGUE)
    return sources.join_lines(done, "doc_id", "line_no", "line")


# --- counts and reports ------------------------------------------------------------------

def _redacted(spark, sf_dir):
    return redact_documents(views.log_docs(spark, sf_dir).withColumn("before", F.col("text")), "text")


def counts_by_doc(spark, sf_dir):
    return reports.counts_by_document(_redacted(spark, sf_dir), "doc_id")


def counts_total(spark, sf_dir):
    return reports.totals(counts_by_doc(spark, sf_dir))


def replacements_by_doc(spark, sf_dir):
    return reports.replacements_by_document(counts_by_doc(spark, sf_dir), "doc_id")


def distinct_originals(spark, sf_dir):
    unique = findings(_redacted(spark, sf_dir), "doc_id").filter(F.col("category").isin(CATALOGUE.unique_categories))
    scoped = unique.withColumn("original", F.concat_ws(":", "doc_id", "original"))
    return reports.distinct_originals(scoped)


def distinct_originals_merged(spark, sf_dir):
    """Distinct values from the stored sketches of ten runs, held against the exact number: off by 3 % at most."""
    path = scratch(spark, "sketches")
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("number"))
    found = staged(findings(redact_documents(synth.mixed_lines(lines, "number", 500).withColumn(
        "line", F.expr("concat(line, ' user=u', number div 3, ' mail m', number div 7, '@x.org')")), "line"), "number"), "found")
    # one pass over what was found sketches all runs
    sketches = staged(reports.original_sketches(found.withColumn("run", F.col("number") % 10), "run"), "run-sketches")
    for run in range(10):
        reports.store_sketches(sketches.filter(F.col("run") == run).drop("run"), path, str(run))
    about = reports.sketched_originals(spark.read.parquet(path)).withColumnRenamed("n", "about")
    return reports.distinct_originals(found).join(about, "category").filter(F.col("category").isin("username", "email")).select(
        "category", "n", (F.abs(F.col("about") - F.col("n")) <= 0.03 * F.col("n")).alias("close"))


def manifest_rollup(spark, sf_dir):
    return reports.manifest_rollup(sources.manifest(views.files(spark, sf_dir)))


def _metrics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("phase"), F.col("doc_id").alias("file"), (F.col("n_chars") * 1024).alias("bytes"),
        (F.col("doc_id") % 8 + 1).cast("double").alias("seconds"),
        (F.col("n_chars") * 128).alias("compressed_bytes"))


def throughput_report(spark, sf_dir):
    done = reports.throughput(_metrics(spark, sf_dir), "phase")
    return done.select("phase", "files", "bytes", F.round("seconds", 3).alias("seconds"),
                       F.round("overall_mib_s", 3).alias("overall_mib_s"), F.round("mean_mib_s", 3).alias("mean_mib_s"))


def time_left(spark, sf_dir):
    return reports.time_left(_metrics(spark, sf_dir), 10 ** 9).select("readable")


def compression_ratio(spark, sf_dir):
    return reports.compression_ratio(_metrics(spark, sf_dir))


def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr(P.duration("cast(event_id * 7 + 0.5D AS double)")).alias("readable"))


def _results(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("path"),
        F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("failed: "), "source")).alias("error"))


def top_errors(spark, sf_dir):
    return reports.top_errors(_results(spark, sf_dir))


# --- trees of files ------------------------------------------------------------------------

def _tree(spark, sf_dir):
    """Log documents written as a tree of files; its folder, and one for the result."""
    root = scratch(spark, "tree")
    write_tree(spark, views.log_files(spark, sf_dir).repartition(8), f"{root}/in", safe_names=False)
    return f"{root}/in", f"{root}/out"


def tree_redact(spark, sf_dir):
    """The tree that a run wrote, read back."""
    source, target = _tree(spark, sf_dir)
    redact_tree(spark, source, target)
    return sources.scan_files(spark, target).unionByName(unseen_files(spark, target)).select("path", F.md5("content").alias("digest"))


def tree_results(spark, sf_dir):
    run = redact_tree(spark, *_tree(spark, sf_dir))
    replaced = F.expr("coalesce(aggregate(map_values(counts), 0L, (n, c) -> n + c), 0L)").alias("replaced")
    return run.files.select("path", "target", "outcome", "size", "written", replaced, "error")


def tree_metrics(spark, sf_dir):
    """What the phases of a run measured; their times differ from run to run and are only tested."""
    run = redact_tree(spark, *_tree(spark, sf_dir))
    report = reports.throughput(run.phases.withColumn("bytes", F.col("bytes_in")), "phase")
    return run.phases.join(report.select("phase", "overall_mib_s"), "phase").select(
        "phase", "files", "bytes_in", "bytes_out", (F.col("seconds") > 0).alias("timed"), (F.col("overall_mib_s") > 0).alias("rated"))


def stream_files(spark, sf_dir):
    """The tree arriving as files, a hundred in a batch or a twentieth of them, routed to three tables."""
    source, target = _tree(spark, sf_dir)
    router = FileRouter(target)
    waiting = sources.scan_files(spark, source).count()
    route_stream(arriving_files(spark, source, files_together(waiting)), router, f"{target}/checkpoint", available_now=True).awaitTermination()
    text = spark.read.schema("path string, text string").parquet(f"{target}/redacted/batch=*").select("path", F.lit("redacted").alias("outcome"), F.md5("text").alias("digest"))
    for outcome in ("copied", "quarantined"):
        rows = spark.read.schema("path string, content binary").parquet(f"{target}/{outcome}/batch=*")
        text = text.unionByName(rows.select("path", F.lit(outcome).alias("outcome"), F.md5("content").alias("digest")))
    return text


# --- audits --------------------------------------------------------------------------------

def audit_expected(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = redact_documents(synth.audit_lines(events, "event_id"), "line")
    actual = findings(done, "doc_id").groupBy("category").agg(F.count("*").alias("n"))
    return audits.expected_counts(synth.audit_expected(events, "event_id"), actual)


def _short_documents(spark, sf_dir):
    """Log documents of five lines, redacted: few of them hold a block."""
    lines = views.log_lines(spark, sf_dir).withColumn("doc_id", F.col("doc_id") * 100 + F.floor((F.col("line_no") - 1) / 5))
    docs = sources.join_lines(lines, "doc_id", "line_no", "line")
    return redact_documents(docs.withColumn("before", F.col("text")), "text")


def _damaged(rows: DataFrame, column: str, where: str, damage: str) -> DataFrame:
    """What an audit must find: ``column`` made wrong on some rows."""
    return rows.withColumn(column, F.expr(f"IF({where}, {damage}, {column})"))


def audit_line_count(spark, sf_dir):
    return audits.line_counts(_short_documents(spark, sf_dir), "doc_id", "before", "text")


def audit_line_count_damaged(spark, sf_dir):
    rows = _damaged(_short_documents(spark, sf_dir), "text", "doc_id % 7 = 3", "concat(text, '\\n')")
    return audits.line_counts(rows, "doc_id", "before", "text").select("doc_id")


def _lines_redacted(spark, sf_dir):
    rules = CATALOGUE.select(rule_ids=[r.rule_id for r in CATALOGUE.line_rules])
    return redact_documents(views.log_lines(spark, sf_dir).withColumn("before", F.col("line")), "line", rules)


def audit_clean_lines(spark, sf_dir):
    return audits.clean_lines(_lines_redacted(spark, sf_dir), "before", "line").select("doc_id", "line_no")


def audit_clean_lines_damaged(spark, sf_dir):
    rows = _damaged(_lines_redacted(spark, sf_dir), "line", "line_no % 9 = 4", "concat(line, '.')")
    return audits.clean_lines(rows, "before", "line").select("doc_id", "line_no")


def audit_indentation(spark, sf_dir):
    return audits.indentation(_lines_redacted(spark, sf_dir), "before", "line").select("doc_id", "line_no")


def audit_indentation_damaged(spark, sf_dir):
    rows = _damaged(_lines_redacted(spark, sf_dir), "line", "line_no % 9 = 5", "concat(' ', line)")
    return audits.indentation(rows, "before", "line").select("doc_id", "line_no")


def audit_json(spark, sf_dir):
    return audits.json_kept(_lines_redacted(spark, sf_dir), "before", "line").select("doc_id", "line_no")


def audit_json_damaged(spark, sf_dir):
    rows = _damaged(_lines_redacted(spark, sf_dir), "line", "line LIKE '%}'", "substr(line, 1, length(line) - 1)")
    return audits.json_kept(rows, "before", "line").select("doc_id", "line_no")


def _leaks(spark, sf_dir, rows):
    found = findings(rows, "doc_id").filter(F.col("category").isin(CATALOGUE.unique_categories))
    return audits.leaks(found, rows.select("doc_id", "line_no", "line"), ["doc_id", "line_no"], "line")


def audit_leaks(spark, sf_dir):
    """Values of the unique categories that stand in redacted lines, of the same or another document."""
    return _leaks(spark, sf_dir, staged(_lines_redacted(spark, sf_dir), "redacted"))


def audit_leaks_damaged(spark, sf_dir):
    return _leaks(spark, sf_dir, staged(_damaged(_lines_redacted(spark, sf_dir), "line", "line_no % 9 = 2", "before"), "redacted"))


def audit_bijection(spark, sf_dir):
    return audits.bijection(pseudonym_dictionary_corpus(spark, sf_dir))


def audit_residual(spark, sf_dir):
    lines = sources.split_lines(redact_full_doc(spark, sf_dir), "doc_id", "text")
    return audits.residual(lines, ["doc_id", "line_no"], "line", CATALOGUE) \
        .groupBy("rule", "category").agg(F.count("*").alias("n"))


def audit_length_ratio(spark, sf_dir):
    return audits.length_ratio(_redacted(spark, sf_dir), "doc_id", "before", "text", 0.9, 1.0)


def audit_utf8(spark, sf_dir):
    return audits.valid_utf8(documents_redacted(spark, sf_dir), "doc_id", "text")


def audit_utf8_damaged(spark, sf_dir):
    rows = _damaged(documents_redacted(spark, sf_dir), "text", "doc_id % 13 = 1", "cast(concat(cast(text AS binary), X'C328') AS string)")
    return audits.valid_utf8(rows, "doc_id", "text")


def audit_complete_damaged(spark, sf_dir):
    return audits.complete(table(spark, sf_dir, "documents"), documents_redacted(spark, sf_dir).filter("doc_id % 11 != 2"), "doc_id")


def audit_bijection_damaged(spark, sf_dir):
    """Every original whose number is divisible by 6 gets the number before it."""
    wrong = _damaged(pseudonym_dictionary_corpus(spark, sf_dir), "id", "id % 6 = 0", "id - 1")
    return audits.bijection(wrong).select("scope", "category", "value", "n", "kind")


def audit_length_ratio_damaged(spark, sf_dir):
    rows = _damaged(_short_documents(spark, sf_dir), "text", "doc_id % 7 = 2", "repeat(text, 5)")
    return audits.length_ratio(rows, "doc_id", "before", "text").select("doc_id")


def audit_complete(spark, sf_dir):
    return audits.complete(table(spark, sf_dir, "documents"), documents_redacted(spark, sf_dir), "doc_id")


# --- streams ---------------------------------------------------------------------------------

def _stream(spark, sf_dir):
    """The log lines as a stream of files, a few files per batch."""
    root = scratch(spark, "stream")
    lines = views.log_lines(spark, sf_dir)
    # a batch has a file for each core, so that its tasks fill the cluster
    together = max(2, spark.sparkContext.defaultParallelism)
    lines.repartitionByRange(2 * together, "doc_id").sortWithinPartitions("doc_id", "line_no").write.parquet(f"{root}/in")
    arriving = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", together).parquet(f"{root}/in")
    return root, arriving


def _run_stream(root, name, arriving, mode="append"):
    """Run a stream to its end and read what it wrote in complete or append mode."""
    spark = arriving.sparkSession

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
    arriving.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/{name}-checkpoint") \
        .foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/{name}")


def stream_redact(spark, sf_dir):
    """Pseudonyms given in one batch hold in the later ones; the dictionary in the end."""
    root, arriving = _stream(spark, sf_dir)
    redact_stream(arriving, "doc_id", "line_no", "line", f"{root}/out", f"{root}/dictionary", f"{root}/checkpoint",
                  available_now=True, blocks=False).awaitTermination()
    return read_dictionary(spark, f"{root}/dictionary").groupBy("category").agg(
        F.count("*").alias("originals"), F.count_distinct("id").alias("ids"), F.max("id").alias("last"))


def _in_line_ranges(spark, sf_dir, catalogue):
    """Logs arriving in ranges of lines, so that every document is cut by every batch: the texts, and what gives the dictionary."""
    root = scratch(spark, "blocks")
    lines = staged(views.log_lines(spark, sf_dir), "log-lines")
    batches = 5
    for k in range(batches):
        lines.filter(F.floor((F.col("line_no") - 1) / 21) == k).repartition(1).write.mode("append").parquet(f"{root}/in")
    arriving = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    redactor = BlockRedactor("doc_id", "line_no", "line", f"{root}/out", f"{root}/dictionary", f"{root}/carry", catalogue=catalogue)
    redact_blocks_stream(arriving, redactor, f"{root}/checkpoint", available_now=True).awaitTermination()
    redactor.flush(spark, batches - 1, lines.schema)
    texts = sources.join_lines(spark.read.schema(lines.schema).parquet(f"{root}/out/batch=*"), "doc_id", "line_no", "line")
    return texts, lambda: DictionaryLog(f"{root}/dictionary").before(spark, batches + 1)


def stream_blocks(spark, sf_dir):
    """Blocks and masks in documents cut by batches."""
    return _in_line_ranges(spark, sf_dir, STATIC)[0]


def stream_text(spark, sf_dir):
    """All rules in documents cut by batches; numbers, which follow arrival, are hidden."""
    text = "regexp_replace(regexp_replace(text, '(user|host|entity)[0-9]+', '$1#'), '10[.][0-9]+[.]0[.]1', '10.#.0.1')"
    return _in_line_ranges(spark, sf_dir, CATALOGUE)[0].withColumn("text", F.expr(text))


def stream_dictionary(spark, sf_dir):
    """The dictionary that the batches left in their log."""
    _, left = _in_line_ranges(spark, sf_dir, CATALOGUE)
    known = left()
    last = known.last.groupBy("category").agg(F.max("last").alias("last"))
    return known.all().groupBy("category").agg(F.count("*").alias("originals"), F.count_distinct("id").alias("ids")).join(last, "category")


def stream_mask(spark, sf_dir):
    root, arriving = _stream(spark, sf_dir)
    return _run_stream(root, "masked", mask_stream(arriving, "line")).select("doc_id", "line_no", "line")


def stream_counts(spark, sf_dir):
    root, arriving = _stream(spark, sf_dir)
    counts = _run_stream(root, "counts", running_counts(arriving, "line"), "complete")
    return counts.groupBy("category").agg(F.max("n").alias("n"))


def stream_quarantine(spark, sf_dir):
    files = views.contents(spark, sf_dir).withColumn("content", F.when(
        F.col("doc_id") % 10 == 0, F.expr("unhex('FFFE00')")).otherwise(F.col("content")))
    good, bad = quarantine(files)
    return good.agg(F.count("*").alias("n")).withColumn("outcome", F.lit("text")).unionByName(
        bad.groupBy("error").agg(F.count("*").alias("n")).withColumnRenamed("error", "outcome"))


def registry() -> dict[str, Query]:
    named: dict[str, Query] = {}
    for rule in CATALOGUE:
        named[f"detect_r{rule.rule_id:02d}"] = partial(detect_rule, rule)
        named[f"count_r{rule.rule_id:02d}"] = partial(count_rule, rule)
        named[f"redact_r{rule.rule_id:02d}"] = partial(redact_rule, rule)
    named["documents_email"] = partial(documents_rule, "documents", "doc_id", "text", 8)
    named["documents_sql"] = partial(documents_rule, "documents", "doc_id", "text", 2)
    named["pages_email"] = partial(documents_rule, "pages", "page_id", "html", 8)
    named["conversations_email"] = partial(documents_rule, "conversations", "conv_id,turn", "text", 8)
    for permille in (0, 1, 50, 500):
        named[f"synth_mix_{permille:03d}"] = partial(synth_mix, permille)
    for query in (
            keyword_prefilter, present_keywords, applicable_rules, multiline_gate, candidate_lines, classify_files,
            size_class, binary_sniff, tree_routing, decode_text, line_split, line_reassemble, sanitize_path, output_path,
            file_roundtrip, encoded_lines, synth_log_lines, synth_expected_counts, redact_static, redact_full_doc,
            redact_full_corpus, redact_subset, redact_custom, redact_custom_same_category, redact_long_lines, redact_lines_doc, redact_lines_scan, findings_lines_scan, documents_redacted,
            conversations_redacted, pages_redacted, pseudonym_dictionary_doc, pseudonym_dictionary_corpus,
            pseudonym_dictionary_same_category, pseudonym_format, sql_block_islands, counts_by_doc, counts_total, replacements_by_doc,
            distinct_originals, distinct_originals_merged, manifest_rollup, throughput_report, time_left, compression_ratio, format_duration,
            top_errors, audit_expected, audit_line_count, audit_clean_lines, audit_indentation, audit_json,
            audit_line_count_damaged, audit_clean_lines_damaged, audit_indentation_damaged, audit_json_damaged, audit_utf8_damaged,
            audit_complete_damaged, audit_bijection_damaged, audit_length_ratio_damaged, audit_leaks, audit_leaks_damaged,
            audit_bijection, audit_residual, audit_length_ratio, audit_utf8, audit_complete, stream_redact,
            stream_blocks, stream_text, stream_dictionary, stream_files, tree_redact, tree_results, tree_metrics, stream_mask, stream_counts, stream_quarantine):
        named[query.__name__] = query
    return named
