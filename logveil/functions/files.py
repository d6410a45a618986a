"""Expressions over files: their class by name, size and content, decoding, and output paths.

As in ``text``, arguments and results are SQL expressions as strings.
"""

from __future__ import annotations

from logveil.functions.text import let, literal, when

# --- Fixed values -------------------------------------------------------------
TEXT_EXTENSIONS = (".log", ".txt", ".json", ".xml", ".yml", ".yaml", ".properties", ".conf", ".config", ".html", ".htm")
LARGE_BYTES = 5 * 1024 * 1024
STREAMED_BYTES = 20 * 1024 * 1024
SNIFFED_BYTES = 8192
CONTROL_SHARE = 0.1
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL",
                  "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
                  "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9")
OUTPUT_SUFFIX = "_anonymized"
# --- End of fixed values ------------------------------------------------------


def _names(values) -> str:
    return ", ".join(map(literal, values))


def suffix(path: str) -> str:
    """The lower-case extension of the last path part, with its dot; none for names like ``.profile``."""
    return f"lower(regexp_extract({path}, '[^/](\\\\.[^./]+)$', 1))"


def file_class(path: str) -> str:
    return f"IF({suffix(path)} IN ({_names(TEXT_EXTENSIONS)}), 'text', 'binary')"


def size_class(size: str) -> str:
    return f"CASE WHEN {size} >= {STREAMED_BYTES} THEN 'streamed' WHEN {size} >= {LARGE_BYTES} THEN 'large' ELSE 'small' END"


def looks_binary(content: str) -> str:
    """A NUL among the first bytes, or too many control bytes; empty content is text."""
    controls = r"regexp_count(sample, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')"
    return let("sample", f"decode(substring({content}, 1, {SNIFFED_BYTES}), 'ISO-8859-1')",
               f"(sample RLIKE '\\\\x00' OR {controls} > {CONTROL_SHARE} * length(sample))")


def holds_controls(content: str) -> str:
    """A NUL anywhere, or too many control bytes in the whole content."""
    controls = r"regexp_count(whole, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')"
    return let("whole", f"decode({content}, 'ISO-8859-1')",
               f"(contains(whole, '\\0') OR {controls} > {CONTROL_SHARE} * length(whole))")


def route(path: str, content: str) -> str:
    """What becomes of a file: ``copied`` if its name does not say text, else ``redacted`` or, if unreadable, ``quarantined``.

    The encoding is told first, so that the zeros of UTF-16 are not taken for those of a binary file.
    """
    return (f"CASE WHEN {file_class(path)} = 'binary' THEN 'copied' WHEN {decoding_error(content)} IS NOT NULL THEN 'quarantined' "
            f"WHEN {encoding(content)} != 'UTF-16' AND {holds_controls(content)} THEN 'quarantined' ELSE 'redacted' END")


def encoding(content: str) -> str:
    """UTF-16 only with a byte order mark, else UTF-8 where it is valid, else Latin-1."""
    return (f"CASE WHEN hex(substring({content}, 1, 2)) IN ('FFFE', 'FEFF') THEN 'UTF-16' "
            f"WHEN is_valid_utf8(cast({content} AS string)) THEN 'UTF-8' ELSE 'ISO-8859-1' END")


def decoded(content: str) -> str:
    """The content as text."""
    return (f"CASE {encoding(content)} WHEN 'UTF-16' THEN decode({content}, 'UTF-16') "
            f"WHEN 'UTF-8' THEN cast({content} AS string) ELSE decode({content}, 'ISO-8859-1') END")


def decoding_error(content: str) -> str:
    """Why the content cannot be decoded; NULL where it can."""
    le = r"^FFFE(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])*+$"
    be = r"^FEFF(?:(?:[0-9A-CEF].|D[0-7])..|D[89AB]..D[C-F]..)*+$"
    return (f"CASE WHEN {content} IS NULL THEN 'no content' "
            f"WHEN {encoding(content)} = 'UTF-16' AND NOT hex({content}) RLIKE {literal(le + '|' + be)} "
            f"THEN 'invalid UTF-16' END")


def stem(name: str) -> str:
    """A file name without its last extension."""
    return f"regexp_replace({name}, '(?<=.)\\\\.[^.]+$', '')"


def sanitized_path(path: str) -> str:
    """Prefix path parts that Windows reserves for devices with an underscore."""
    return (f"array_join(transform(split({path}, '/', -1), part -> "
            f"{when(f'upper({stem('part')}) IN ({_names(RESERVED_NAMES)})', 'concat(\'_\', part)', 'part')}), '/')")


def output_root(archive: str) -> str:
    """Where an archive's redacted tree goes: ``logs.zip`` becomes ``logs_anonymized``."""
    return f"concat(regexp_replace({archive}, '(?<=[^/])\\\\.[^./]+$', ''), {literal(OUTPUT_SUFFIX)})"


def duration(seconds: str) -> str:
    """``5.5s``, ``1m 30s``, ``1h 2m 5s``."""
    rest = f"cast(rint(pmod({seconds}, 60D)) AS bigint)"
    return (f"CASE WHEN {seconds} < 60 THEN format_string('%.1fs', {seconds}) "
            f"WHEN {seconds} < 3600 THEN format_string('%dm %ds', cast(floor({seconds} / 60) AS bigint), {rest}) "
            f"ELSE format_string('%dh %dm %ds', cast(floor({seconds} / 3600) AS bigint), "
            f"cast(floor(pmod({seconds}, 3600D) / 60) AS bigint), {rest}) END")
