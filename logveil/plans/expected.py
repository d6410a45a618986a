"""The SQL that each registered query must agree with, by name."""

from __future__ import annotations

from logveil.functions import files as P
from logveil.functions.rules import Catalogue
from logveil.operators.audits import allowed_shapes
from logveil.plans import oracle as O
from logveil.plans import views
from logveil.plans.queries import CATALOGUE, CUSTOM, RUNS, SAME, STATIC
from logveil.sources import synth

LINE_RULES = CATALOGUE.select(rule_ids=[r.rule_id for r in CATALOGUE.line_rules])
LINES_AS_DOCS = f"SELECT doc_id * 1000 + line_no AS doc_id, line AS text FROM ({O.LOG_LINES}) AS log_lines"
FILES = views.files_sql("portable")
LOG_FILES = views.log_files_sql("portable").replace("FROM documents", f"FROM ({O.LOG_DOCS}) AS log_docs")
CONTENTS = views.contents_sql("portable")


def _names(values) -> str:
    return ", ".join(map(O.lit, values))


def _redacted(docs: str, catalogue: Catalogue = CATALOGUE, scope: str = "doc") -> str:
    return O.cascade(docs, catalogue, scope) + "SELECT doc_id, text FROM redacted"


def _dictionary(scope: str, catalogue: Catalogue = CATALOGUE) -> str:
    return O.cascade(O.LOG_DOCS, catalogue, scope) + \
        "SELECT scope, category, original, cast(id AS bigint) AS id, replacement FROM dictionary"


def _from_cascade(select: str, docs: str = O.LOG_DOCS, catalogue: Catalogue = CATALOGUE, scope: str = "doc") -> str:
    return O.cascade(docs, catalogue, scope) + select


def _masked_lines() -> str:
    rules = [r for r in CATALOGUE.line_rules if not r.is_unique]
    sql = f"SELECT doc_id, line_no, line, line AS raw FROM ({O.LOG_LINES}) AS log_lines"
    for r in rules:
        sql = (f"SELECT doc_id, line_no, CASE WHEN {O.gate('lower(raw)', r)} THEN {O.masked('line', r)} "
               f"ELSE line END AS line, raw FROM ({sql}) AS after{r.rule_id}")
    return f"SELECT doc_id, line_no, line FROM ({sql}) AS masked"


def _duration(s: str) -> str:
    rest = f"cast(round_even({s} % 60, 0) AS bigint)"
    return (f"CASE WHEN {s} < 60 THEN printf('%.1fs', {s}) WHEN {s} < 3600 THEN "
            f"printf('%dm %ds', cast(floor({s} / 60) AS bigint), {rest}) ELSE "
            f"printf('%dh %dm %ds', cast(floor({s} / 3600) AS bigint), "
            f"cast(floor(({s} % 3600) / 60) AS bigint), {rest}) END")


def _pick(values, index: str) -> str:
    return f"([{_names(values)}])[{index} + 1]"


def _mixed(permille: int) -> str:
    at = lambda salt, m: f"(cast('0x' || substr(md5('{salt}' || number), 1, 8) AS bigint) % {m})"
    clean = " || ".join([
        _pick(synth.MIX_TIMES, at("t", len(synth.MIX_TIMES))), "' '",
        _pick(synth.MIX_LEVELS, at("l", len(synth.MIX_LEVELS))), "'  '",
        _pick(synth.MIX_CLEAN, at("c", len(synth.MIX_CLEAN)))])
    return (f"SELECT number, CASE WHEN {at('r', 1000)} < {permille} THEN "
            f"{_pick(synth.MIX_SENSITIVE, at('s', len(synth.MIX_SENSITIVE)))} ELSE {clean} END AS line "
            "FROM (SELECT l_orderkey * 10 + l_linenumber AS number FROM lineitem) AS source")


def _split(source: str = "documents") -> str:
    return ("SELECT doc_id, cast(generate_subscripts(parts, 1) AS bigint) AS line_no, "
            "regexp_replace(unnest(parts), '\\r$', '') AS line FROM (SELECT doc_id, "
            "CASE WHEN ends_with(text, chr(10)) OR text = '' THEN string_split(text, chr(10))[:-2] "
            f"ELSE string_split(text, chr(10)) END AS parts FROM {source}) AS cut")


def _sniffed() -> str:
    controls = [f"{i:02X}" for i in range(32) if i not in (9, 10, 13)]
    return ("SELECT doc_id, coalesce(list_contains(pairs, '00') OR "
            f"len(list_filter(pairs, lambda p: p IN ({_names(controls)}))) > {P.CONTROL_SHARE} * len(pairs), false) "
            f"AS is_binary FROM (SELECT doc_id, regexp_extract_all(substr(hexed, 1, {2 * P.SNIFFED_BYTES}), '..') AS pairs "
            f"FROM ({CONTENTS}) AS contents) AS sampled")


def _routed() -> str:
    controls = [f"{i:02X}" for i in range(32) if i not in (9, 10, 13)]
    changed = "CASE WHEN doc_id % 10 = 0 THEN 'FFFE00' WHEN doc_id % 15 = 5 THEN hexed || '00' ELSE hexed END"
    return (f"SELECT doc_id, CASE WHEN {_suffix('path')} NOT IN ({_names(P.TEXT_EXTENSIONS)}) THEN 'copied' "
            "WHEN starts_with(bytes, 'FFFE') THEN CASE WHEN length(bytes) % 4 = 0 THEN 'redacted' ELSE 'quarantined' END "
            "WHEN list_contains(regexp_extract_all(bytes, '..'), '00') OR len(list_filter(regexp_extract_all(bytes, '..'), "
            f"lambda p: p IN ({_names(controls)}))) > 0.1 * length(bytes) / 2 THEN 'quarantined' ELSE 'redacted' END AS outcome "
            f"FROM ({FILES}) AS files JOIN (SELECT doc_id, {changed} AS bytes FROM ({CONTENTS}) AS contents) AS c USING (doc_id)")


def _decoded() -> str:
    latin = "array_to_string(list_transform(regexp_extract_all(hexed, '..'), lambda h: chr(cast('0x' || h AS integer))), '')"
    return (
        "SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN 'UTF-16' WHEN 1 THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding, "
        "cast(CASE doc_id % 6 WHEN 0 THEN 1 + length(text) WHEN 1 THEN length(hexed) / 2 WHEN 2 THEN length(source) "
        "WHEN 3 THEN 8 + length(source) WHEN 4 THEN 0 ELSE length(text) END AS bigint) AS chars, "
        f"CASE doc_id % 6 WHEN 1 THEN md5({latin}) WHEN 2 THEN md5(source) ELSE md5(unhex(hexed)) END AS digest "
        f"FROM ({CONTENTS}) AS contents JOIN documents USING (doc_id)")


def _suffix(path: str) -> str:
    return f"lower(regexp_extract({path}, '[^/](\\.[^./]+)$', 1))"


def _size_class(size: str) -> str:
    return f"CASE WHEN {size} >= {P.STREAMED_BYTES} THEN 'streamed' WHEN {size} >= {P.LARGE_BYTES} THEN 'large' ELSE 'small' END"


MANIFEST = (f"SELECT path, size, CASE WHEN {_suffix('path')} IN ({_names(P.TEXT_EXTENSIONS)}) THEN 'text' ELSE 'binary' END "
            f"AS class, {_size_class('size')} AS size_class FROM ({FILES}) AS files")
METRICS = ("SELECT source AS phase, doc_id AS file, n_chars * 1024 AS bytes, cast(doc_id % 8 + 1 AS double) AS seconds, "
           "n_chars * 128 AS compressed_bytes FROM documents")
COUNTS = "SELECT doc_id, category, cast(sum(n) AS bigint) AS n FROM hits GROUP BY doc_id, category"
AUDIT_LINES = (f"SELECT event_id AS doc_id, {_pick(synth.AUDIT_TEMPLATES, f'event_id % {len(synth.AUDIT_TEMPLATES)}')} "
               "AS text FROM events")
AUDIT_KNOWN = ", ".join(f"({O.lit(c)}, {t}, {n})" for c, t, n in synth.AUDIT_EXPECTED)
AUDIT_EXPECTED = (f"SELECT category, cast(sum(each) AS bigint) AS n FROM events JOIN (VALUES {AUDIT_KNOWN}) "
                  f"AS known(category, template, each) ON event_id % {len(synth.AUDIT_TEMPLATES)} = template GROUP BY category")


def _pseudonym_format() -> str:
    names = [*CATALOGUE.unique_categories, "ticket"]
    rows = f"SELECT event_id, event_id + 1 AS id, {_pick(names, f'event_id % {len(names)}')} AS category FROM events"
    return f"SELECT event_id, {O.pseudonym('category', 'id', names)} AS replacement FROM ({rows}) AS r"


def _residual() -> str:
    found = " UNION ALL ".join(
        f"SELECT {r.rule_id} AS rule, {O.lit(r.category)} AS category, unnest({O.values('line', r)}) AS original "
        f"FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM redacted) AS l "
        f"WHERE {O.gate('lower(line)', r)}" for r in CATALOGUE)
    return _from_cascade(f"SELECT rule, category, count(*) AS n FROM ({found}) AS f "
                         f"WHERE NOT regexp_matches(original, {O.lit(allowed_shapes(CATALOGUE))}) GROUP BY rule, category")


def _line_audit(condition: str) -> str:
    return _from_cascade(
        "SELECT cast((r.doc_id - r.doc_id % 1000) / 1000 AS bigint) AS doc_id, r.doc_id % 1000 AS line_no "
        f"FROM redacted r JOIN docs d ON r.doc_id = d.doc_id WHERE {condition}", LINES_AS_DOCS, LINE_RULES)


SHORT_DOCS = ("SELECT doc_id * 100 + (line_no - 1) // 5 AS doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text "
              f"FROM ({O.LOG_LINES}) AS log_lines GROUP BY ALL")


def _line_count(after: str) -> str:
    """Documents with another number of lines than they had, counted on the rules' own values."""
    newlines = "cast(length({0}) - length(replace({0}, chr(10), '')) AS bigint)".format
    steps, previous = [], "d.text"
    for r in CATALOGUE.text_rules:
        steps.append(f"(CASE WHEN {O.gate('lower(d.text)', r)} THEN list_sum(list_transform({O.values(previous, r)}, "
                     f"lambda v: {newlines('v')})) ELSE 0 END)")
        previous = f"(CASE WHEN {O.gate('lower(d.text)', r)} THEN {O.masked(previous, r)} ELSE {previous} END)"
    lost = " + ".join(f"coalesce({x}, 0)" for x in steps)
    return _from_cascade(
        f"SELECT d.doc_id, {newlines('d.text')} AS lines_before, {newlines(after)} AS lines_after FROM docs d JOIN redacted r "
        f"ON d.doc_id = r.doc_id WHERE {newlines('d.text')} != {newlines(after)} + {lost}", SHORT_DOCS)


def _leaks(text: str) -> str:
    """Every value of the unique categories tried on every line."""
    word = lambda c: f"regexp_matches({c}, '^[\\p{{L}}\\p{{N}}_]')"
    left, right = "CASE WHEN parts[i] = '' AND i > 1 THEN right(original, 1) ELSE right(parts[i], 1) END", "left(parts[i + 1], 1)"
    apart = (f"NOT ({word('left(original, 1)')} AND {word(left)}) AND NOT ({word('right(original, 1)')} AND "
             f"{word(f'CASE WHEN parts[i + 1] = {chr(39) * 2} AND i + 1 < len(parts) THEN left(original, 1) ELSE {right} END')})")
    return _from_cascade(
        "SELECT cast((doc_id - doc_id % 1000) / 1000 AS bigint) AS doc_id, doc_id % 1000 AS line_no, category, original FROM ("
        "SELECT l.doc_id, v.category, v.original, string_split(l.line, v.original) AS parts "
        f"FROM (SELECT r.doc_id, {text} AS line FROM redacted r JOIN docs d ON r.doc_id = d.doc_id) AS l "
        "JOIN (SELECT DISTINCT category, original FROM dictionary WHERE regexp_matches(original, '[\\p{L}\\p{N}_]')) AS v "
        "ON contains(l.line, v.original)) AS met "
        f"WHERE len(list_filter(range(1, len(parts)), lambda i: {apart})) > 0", LINES_AS_DOCS, LINE_RULES)


def _bijection() -> str:
    def half(one: str, many: str) -> str:
        return (f"SELECT scope, category, cast({one} AS varchar) AS value, count(DISTINCT {many}) AS n, '{one}' AS kind "
                f"FROM dictionary GROUP BY scope, category, {one} HAVING count(DISTINCT {many}) > 1")
    return _from_cascade(half("original", "id") + " UNION ALL " + half("id", "original"), scope="corpus")


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    for r in CATALOGUE:
        source, keys, text = (O.LOG_DOCS, ["doc_id"], "text") if r.multiline else (O.LOG_LINES, ["doc_id", "line_no"], "line")
        sql[f"detect_r{r.rule_id:02d}"] = O.detect(source, keys, text, r)
        sql[f"count_r{r.rule_id:02d}"] = O.count(source, text, r)
        sql[f"redact_r{r.rule_id:02d}"] = _redacted(O.LOG_DOCS, CATALOGUE.select(rule_ids=[r.rule_id]))
    sql["documents_email"] = O.detect("SELECT * FROM documents", ["doc_id"], "text", CATALOGUE[8])
    sql["documents_sql"] = O.detect("SELECT * FROM documents", ["doc_id"], "text", CATALOGUE[2])
    sql["pages_email"] = O.detect("SELECT * FROM pages", ["page_id"], "html", CATALOGUE[8])
    sql["conversations_email"] = O.detect("SELECT * FROM conversations", ["conv_id", "turn"], "text", CATALOGUE[8])
    for permille in (0, 1, 50, 500):
        sql[f"synth_mix_{permille:03d}"] = _mixed(permille)

    # gates, classes, preparation
    sql["keyword_prefilter"] = (
        "SELECT doc_id, line_no, (" + " OR ".join(f"contains(lower(line), {O.lit(k)})" for k in CATALOGUE.keywords)
        + f") AS may_match FROM ({O.LOG_LINES}) AS log_lines")
    sql["present_keywords"] = (
        f"SELECT doc_id, array_to_string(list_filter([{_names(CATALOGUE.keywords)}], lambda k: contains(low, k)), '|') "
        "AS keywords FROM (SELECT doc_id, lower(text) AS low FROM documents) AS lowered")
    sql["applicable_rules"] = (
        "SELECT doc_id, line_no, array_to_string(list_filter(["
        + ", ".join(f"CASE WHEN {O.gate('lower(line)', r)} THEN '{r.rule_id}' END" for r in CATALOGUE.line_rules)
        + f"], lambda x: x IS NOT NULL), ',') AS rules FROM ({O.LOG_LINES}) AS log_lines")
    sql["multiline_gate"] = "SELECT doc_id, " + ", ".join(
        f"{O.gate('lower(text)', r)} AS {r.category}" for r in CATALOGUE.text_rules) + " FROM documents"
    sql["candidate_lines"] = _from_cascade(
        "SELECT count(DISTINCT doc_id) AS changed, cast(0 AS bigint) AS missed FROM hits", LINES_AS_DOCS, LINE_RULES)
    sql["classify_files"] = MANIFEST
    sql["size_class"] = f"SELECT size_class, count(*) AS files FROM ({MANIFEST}) AS manifest GROUP BY size_class"
    sql["binary_sniff"] = _sniffed()
    sql["tree_routing"] = _routed()
    sql["decode_text"] = _decoded()
    sql["line_split"] = _split()
    sql["line_reassemble"] = (
        f"SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ({_split()}) AS s GROUP BY doc_id")
    sql["sanitize_path"] = (
        "SELECT doc_id, array_to_string(list_transform(string_split(path, '/'), lambda p: CASE WHEN "
        f"upper(regexp_replace(p, '(.)\\.[^.]+$', '\\1')) IN ({_names(P.RESERVED_NAMES)}) THEN '_' || p ELSE p END), '/') "
        f"AS path FROM ({FILES}) AS files")
    sql["output_path"] = (f"SELECT doc_id, regexp_replace(path, '([^/])\\.[^./]+$', '\\1') || {O.lit(P.OUTPUT_SUFFIX)} AS root "
                          f"FROM ({FILES}) AS files")
    sql["file_roundtrip"] = (
        "SELECT 'part=d' || (doc_id % 8) AS part, cast(sum(octet_length(encode(concat(doc_id, ' ', line_no, ' ', line))) + 1) "
        "AS bigint) AS bytes, count(*) AS lines, cast(count(*) * (count(*) + 1) / 2 AS bigint) AS line_nos "
        f"FROM ({_split()}) AS s GROUP BY doc_id % 8")

    latin = "regexp_replace(text, '[^\\x00-\\xFF]', '?', 'g')"
    shown = (f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'é' || {latin} WHEN 2 THEN '\u0a05\u4e00' || text ELSE '\u4e00\u0a05' || text END AS text "
             "FROM documents")
    sql["encoded_lines"] = ("SELECT 'd' || (doc_id % 7) || '/' || doc_id || '.log' AS path, line_no, md5(line) AS digest "
                            f"FROM ({_split(f'({shown})')}) AS s")

    # synthetic logs
    sql["synth_log_lines"] = O.LOG_LINES
    sql["synth_expected_counts"] = AUDIT_EXPECTED

    # redaction
    sql["redact_static"] = _masked_lines()
    sql["redact_full_doc"] = _redacted(O.LOG_DOCS)
    sql["redact_full_corpus"] = _redacted(O.LOG_DOCS, scope="corpus")
    sql["redact_subset"] = _redacted(O.LOG_DOCS, CATALOGUE.select(categories=["email", "internal_ip", "hostname", "username"]))
    sql["redact_custom"] = _redacted(O.LOG_DOCS, CUSTOM)
    sql["redact_custom_same_category"] = _redacted(O.LOG_DOCS, SAME)
    sql["pseudonym_dictionary_same_category"] = _dictionary("corpus", SAME)
    sql["redact_lines_doc"] = _from_cascade(
        "SELECT doc_id, cast(length(text) - length(replace(text, chr(10), '')) + 1 AS bigint) AS lines, "
        "md5(text) AS digest FROM redacted")
    sql["redact_long_lines"] = _redacted(f"SELECT doc_id, replace(text, chr(10), ' ') AS text FROM ({O.LOG_DOCS}) AS log_docs", RUNS)
    sql["redact_lines_scan"] = _redacted(O.LOG_DOCS)
    sql["findings_lines_scan"] = _from_cascade(COUNTS)
    sql["documents_redacted"] = _redacted("SELECT doc_id, text FROM documents")
    sql["conversations_redacted"] = _from_cascade(
        "SELECT conv_id, turn, role, r.text FROM redacted r JOIN conversations c ON r.doc_id = c.conv_id * 100000 + c.turn",
        "SELECT conv_id * 100000 + turn AS doc_id, text FROM conversations")
    sql["pages_redacted"] = _from_cascade("SELECT doc_id AS page_id, text AS html FROM redacted",
                                          "SELECT page_id AS doc_id, html AS text FROM pages")
    sql["pseudonym_dictionary_doc"] = _dictionary("doc")
    sql["pseudonym_dictionary_corpus"] = _dictionary("corpus")
    sql["pseudonym_format"] = _pseudonym_format()
    sql["sql_block_islands"] = _redacted(O.LOG_DOCS, CATALOGUE.select(rule_ids=[r.rule_id for r in CATALOGUE.text_rules]))

    # counts and reports
    sql["counts_by_doc"] = _from_cascade(COUNTS)
    sql["counts_total"] = _from_cascade("SELECT category, cast(sum(n) AS bigint) AS n FROM hits GROUP BY category")
    sql["replacements_by_doc"] = _from_cascade("SELECT doc_id, cast(sum(n) AS bigint) AS n FROM hits GROUP BY doc_id")
    sql["distinct_originals"] = _from_cascade("SELECT category, count(*) AS n FROM dictionary GROUP BY category")
    numbered = (f"SELECT line || ' user=u' || (number // 3) || ' mail m' || (number // 7) || '@x.org' AS line FROM ({_mixed(500)}) AS m")
    sql["distinct_originals_merged"] = " UNION ALL ".join(
        f"SELECT '{CATALOGUE[rule].category}' AS category, count(DISTINCT original) AS n, true AS close FROM "
        f"({O.detect(f'SELECT 1 AS id, line FROM ({numbered}) AS l', ['id'], 'line', CATALOGUE[rule])}) AS found" for rule in (8, 14))
    sql["manifest_rollup"] = (
        "SELECT coalesce(class, 'all') AS class, coalesce(size_class, 'all') AS size_class, count(*) AS files, "
        f"cast(sum(size) AS bigint) AS bytes FROM ({MANIFEST}) AS manifest GROUP BY ROLLUP (class, size_class)")
    sql["throughput_report"] = (
        "SELECT phase, count(*) AS files, cast(sum(bytes) AS bigint) AS bytes, round(sum(seconds), 3) AS seconds, "
        "round(sum(bytes) / 1048576 / sum(seconds), 3) AS overall_mib_s, "
        f"round(avg(bytes / 1048576 / seconds), 3) AS mean_mib_s FROM ({METRICS}) AS metrics GROUP BY phase")
    sql["time_left"] = (f"SELECT {_duration('left_s')} AS readable FROM (SELECT 1e9::double * sum(seconds) / sum(bytes) "
                        f"AS left_s FROM ({METRICS}) AS metrics) AS eta")
    sql["compression_ratio"] = f"SELECT sum(bytes) / sum(compressed_bytes) AS ratio FROM ({METRICS}) AS metrics"
    sql["format_duration"] = (f"SELECT event_id, {_duration('s')} AS readable "
                              "FROM (SELECT event_id, cast(event_id * 7 + 0.5 AS double) AS s FROM events) AS e")
    errors = "SELECT concat('doc', doc_id) AS path, concat('failed: ', source) AS error FROM documents WHERE doc_id % 9 = 0"
    sql["top_errors"] = (
        f"SELECT * FROM (SELECT path, error FROM ({errors}) AS e ORDER BY path LIMIT 5) AS first_errors UNION ALL "
        f"SELECT NULL AS path, '... and ' || (count(*) - 5) || ' more' AS error FROM ({errors}) AS e HAVING count(*) > 5")

    # trees of files
    kinds = f"({LOG_FILES}) AS f LEFT JOIN redacted r USING (doc_id)"
    bytes_in = "cast(octet_length(encode(f.text)) + CASE f.kind WHEN 'quarantined' THEN 1 ELSE 0 END AS bigint)"
    bytes_out = ("cast(CASE f.kind WHEN 'redacted' THEN octet_length(encode(r.text)) WHEN 'copied' THEN octet_length(encode(f.text)) ELSE 0 END AS bigint)")
    sql["tree_redact"] = _from_cascade(
        f"SELECT regexp_replace(f.path, '/NUL[.]', '/_NUL.') AS path, md5(CASE f.kind WHEN 'redacted' THEN r.text ELSE f.text END) AS digest "
        f"FROM {kinds} WHERE f.kind != 'quarantined'", O.LOG_DOCS)
    sql["tree_results"] = _from_cascade(
        f"SELECT f.path, regexp_replace(f.path, '/NUL[.]', '/_NUL.') AS target, f.kind AS outcome, {bytes_in} AS size, {bytes_out} AS written, cast(CASE f.kind WHEN 'redacted' THEN coalesce(h.n, 0) "
        "ELSE 0 END AS bigint) AS replaced, CASE f.kind WHEN 'quarantined' THEN 'looks binary' END AS error "
        f"FROM {kinds} LEFT JOIN (SELECT doc_id, sum(n) AS n FROM hits GROUP BY doc_id) h USING (doc_id)", O.LOG_DOCS)
    sql["tree_metrics"] = _from_cascade(
        "SELECT phase, count(*) AS files, cast(sum(size) AS bigint) AS bytes_in, "
        "cast(sum(written) AS bigint) AS bytes_out, true AS timed, true AS rated FROM ("
        f"SELECT unnest(CASE f.kind WHEN 'redacted' THEN ['redact', 'write'] WHEN 'copied' THEN ['copy'] ELSE ['quarantine'] END) AS phase, "
        f"{bytes_in} AS size, {bytes_out} AS written FROM {kinds}) AS each_phase GROUP BY phase", O.LOG_DOCS)
    sql["stream_files"] = _from_cascade(
        "SELECT f.path, f.kind AS outcome, CASE f.kind WHEN 'redacted' THEN md5(r.text) WHEN 'copied' THEN md5(f.text) "
        f"ELSE md5(unhex(hex(f.text) || '00')) END AS digest FROM {kinds}", O.LOG_DOCS)

    # audits
    sql["audit_expected"] = _from_cascade(
        "SELECT category, expected, actual, actual - expected AS difference FROM ("
        "SELECT coalesce(e.category, a.category) AS category, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual "
        f"FROM ({AUDIT_EXPECTED}) e FULL JOIN (SELECT category, cast(sum(n) AS bigint) AS n FROM hits GROUP BY category) a "
        "ON e.category = a.category) AS both_counts WHERE abs(actual - expected) > 0.1 * expected", AUDIT_LINES)
    sql["audit_line_count"] = _line_count("r.text")
    sql["audit_line_count_damaged"] = f"SELECT doc_id FROM ({_line_count('CASE WHEN r.doc_id % 7 = 3 THEN r.text || chr(10) ELSE r.text END')}) AS a"
    sql["audit_clean_lines_damaged"] = _line_audit(
        "(r.doc_id % 1000 % 9 = 4 OR r.text != d.text) AND r.doc_id NOT IN (SELECT doc_id FROM hits)")
    lead = "regexp_extract({0}, '^\\s*')".format
    sql["audit_indentation_damaged"] = _line_audit(
        f"(r.doc_id % 1000 % 9 = 5 AND (d.text = '' OR {lead('d.text')} != ' ' || {lead('r.text')})) "
        f"OR (r.doc_id % 1000 % 9 != 5 AND ((r.text = '') != (d.text = '') OR {lead('r.text')} != {lead('d.text')}))")
    sql["audit_json_damaged"] = _line_audit(
        "ltrim(d.text) LIKE '{%' AND json_valid(d.text) AND (ends_with(r.text, '}') OR NOT json_valid(r.text))")
    sql["audit_utf8_damaged"] = "SELECT doc_id FROM documents WHERE doc_id % 13 = 1 AND text IS NOT NULL"
    sql["audit_complete_damaged"] = "SELECT doc_id FROM documents WHERE doc_id % 11 = 2"
    sql["audit_bijection_damaged"] = _from_cascade(
        "SELECT scope, category, cast(id - 1 AS varchar) AS value, cast(2 AS bigint) AS n, 'id' AS kind FROM dictionary WHERE id % 6 = 0", scope="corpus")
    ratio = "CASE WHEN d.doc_id % 7 = 2 THEN 5 ELSE 1 END * length(r.text) / length(d.text)"
    sql["audit_length_ratio_damaged"] = _from_cascade(
        f"SELECT d.doc_id FROM docs d JOIN redacted r ON d.doc_id = r.doc_id WHERE length(d.text) > 0 AND ({ratio} < 0.5 OR {ratio} > 3.0)", SHORT_DOCS)
    sql["audit_leaks"] = _leaks("r.text")
    sql["audit_leaks_damaged"] = _leaks("CASE WHEN r.doc_id % 1000 % 9 = 2 THEN d.text ELSE r.text END")
    sql["audit_clean_lines"] = _line_audit("r.text != d.text AND r.doc_id NOT IN (SELECT doc_id FROM hits)")
    sql["audit_indentation"] = _line_audit(
        "(r.text = '') != (d.text = '') OR regexp_extract(r.text, '^\\s*') != regexp_extract(d.text, '^\\s*')")
    sql["audit_json"] = _line_audit("ltrim(d.text) LIKE '{%' AND json_valid(d.text) AND NOT json_valid(r.text)")
    sql["audit_bijection"] = _bijection()
    sql["audit_residual"] = _residual()
    sql["audit_length_ratio"] = _from_cascade(
        "SELECT d.doc_id, cast(length(d.text) AS bigint) AS chars_before, cast(length(r.text) AS bigint) AS chars_after "
        "FROM docs d JOIN redacted r ON d.doc_id = r.doc_id WHERE length(d.text) > 0 "
        "AND (length(r.text) < 0.9 * length(d.text) OR length(r.text) > 1.0 * length(d.text))")
    sql["audit_utf8"] = "SELECT doc_id FROM documents WHERE text IS NULL"
    sql["audit_complete"] = "SELECT doc_id FROM documents WHERE doc_id IS NULL"

    # streams
    sql["stream_redact"] = _from_cascade(
        "SELECT category, count(*) AS originals, count(DISTINCT id) AS ids, max(id) AS last FROM entries GROUP BY category",
        catalogue=LINE_RULES, scope="corpus")
    sql["stream_blocks"] = _redacted(O.LOG_DOCS, STATIC)
    sql["stream_text"] = _from_cascade(
        "SELECT doc_id, regexp_replace(regexp_replace(text, '(user|host|entity)[0-9]+', '\\1#', 'g'), '10[.][0-9]+[.]0[.]1', '10.#.0.1', 'g') AS text "
        "FROM redacted", scope="corpus")
    sql["stream_dictionary"] = _from_cascade(
        "SELECT category, count(*) AS originals, count(DISTINCT id) AS ids, max(id) AS last FROM entries GROUP BY category", scope="corpus")
    sql["stream_mask"] = _masked_lines()
    sql["stream_counts"] = _from_cascade("SELECT category, cast(sum(n) AS bigint) AS n FROM hits GROUP BY category", LINES_AS_DOCS)
    sql["stream_quarantine"] = (
        "SELECT CASE WHEN doc_id % 10 = 0 THEN 'invalid UTF-16' ELSE 'text' END AS outcome, count(*) AS n "
        "FROM documents GROUP BY doc_id % 10 = 0")
    return sql
