"""Classification of files: decoding, types, roles, signals and the findings that need nothing but one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import byte_entropy, line_count, max_line_length
from ..functions.paths import extension, roles
from ..functions.signals import LONG_LINE, eof_offset, gap_line, gap_run, has_text_after_eof, raw_signals
from .findings import finding
from .signatures import signature_findings

# Extensions, markers and byte signatures.
JS_EXTENSIONS = ["js", "cjs", "mjs", "jsx", "ts", "cts", "mts", "tsx"]
NON_CODE_EXTENSIONS = ["svg", "woff", "woff2", "png", "jpg", "jpeg", "gif", "webp", "json", "data", "txt", "md", "lock"]
EXECUTABLE_MARKERS = ["require(", "module.exports", "child_process", "process.env", "eval(", "new Function", "function ", "const ", "import ", "Invoke-Expression", "#!/bin/"]
EXPECTED_MIME = {
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "pdf": "application/pdf",
    "zip": "application/zip",
    "gz": "application/gzip",
    "gzip": "application/gzip",
    "woff": "font/woff",
    "woff2": "font/woff2",
}
#: (offset, bytes as hex, type); the first that fits counts. Fonts have the older names that signature libraries give.
MAGIC = [
    (0, "FFD8FF", "image/jpeg"),
    (0, "89504E47", "image/png"),
    (0, "474946", "image/gif"),
    (8, "57454250", "image/webp"),
    (0, "424D", "image/bmp"),
    (0, "25504446", "application/pdf"),
    (0, "504B0304", "application/zip"),
    (0, "504B0506", "application/zip"),
    (0, "504B0708", "application/zip"),
    (257, "7573746172", "application/x-tar"),
    (0, "1F8B08", "application/gzip"),
    (0, "425A68", "application/x-bzip2"),
    (0, "377ABCAF271C", "application/x-7z-compressed"),
    (0, "FD377A585A00", "application/x-xz"),
    (0, "28B52FFD", "application/zstd"),
    (0, "774F464600010000", "application/font-woff"),
    (0, "774F463200010000", "application/font-woff"),
    (0, "0001000000", "application/font-sfnt"),
    (0, "4F54544F00", "application/font-sfnt"),
    (0, "0061736D", "application/wasm"),
    (0, "4D5A", "application/vnd.microsoft.portable-executable"),
    (0, "7F454C46", "application/x-executable"),
    (0, "CFFAEDFE", "application/x-mach-binary"),
    (0, "CEFAEDFE", "application/x-mach-binary"),
    (0, "FEEDFACF", "application/x-mach-binary"),
    (0, "FEEDFACE", "application/x-mach-binary"),
    (0, "2321", "text/x-shellscript"),
]
BINARY_PROBE = 8192


def detected_mime(content: Column) -> Column:
    out = F.when(F.lit(False), "")
    for offset, magic, mime in MAGIC:
        out = out.when(F.substring(content, offset + 1, len(magic) // 2) == F.unhex(F.lit(magic)), mime)
    return out


def decoded(content: Column, suffix: Column) -> tuple[Column, Column]:
    """(encoding, text); text is null where bytes don't decode. A file with a zero byte near its start is binary unless it is JavaScript by name."""
    head3, head2 = F.substring(content, 1, 3), F.substring(content, 1, 2)
    bom8, le, be = head3 == F.unhex(F.lit("EFBBBF")), head2 == F.unhex(F.lit("FFFE")), head2 == F.unhex(F.lit("FEFF"))
    rest8 = F.substring(content, 4, 1 << 30)
    rest16 = F.substring(content, 3, 1 << 30)
    zero = F.instr(F.hex(F.substring(content, 1, BINARY_PROBE)), "00") > 0
    has_zero = zero & F.hex(F.substring(content, 1, BINARY_PROBE)).rlike(r"\A(?:..)*?00")
    binary = has_zero & ~F.coalesce(suffix.isin(JS_EXTENSIONS), F.lit(False))
    text8, text16 = F.try_validate_utf8(rest8.cast("string")), _utf16(rest16, be)
    text = F.when(bom8, text8).when(le | be, text16).when(~binary, F.try_validate_utf8(content.cast("string")))
    encoding = (
        F.when(content.isNull(), None)
        .when(bom8, F.when(text8.isNotNull(), "utf-8-bom").otherwise("unknown"))
        .when(le, F.when(text16.isNotNull(), "utf-16le").otherwise("unknown"))
        .when(be, F.when(text16.isNotNull(), "utf-16be").otherwise("unknown"))
        .when(binary, "binary")
        .when(F.try_validate_utf8(content.cast("string")).isNotNull(), "utf-8")
        .otherwise("unknown")
    )
    return encoding, text


def _utf16(rest: Column, big_endian: Column) -> Column:
    """UTF-16 text, null for odd lengths and lone surrogates, told by the hex units before any decoding."""
    units = F.regexp_replace(F.hex(rest), "(....)", "$1 ")
    big = F.when(big_endian, units).otherwise(F.regexp_replace(F.hex(rest), "(..)(..)", "$2$1 "))
    well_formed = (F.octet_length(rest) % 2 == 0) & big.rlike(r"\A(?:(?:(?!D[89A-F]).... )|(?:D[89AB].. D[C-F].. ))*+\z")
    return F.when(well_formed & big_endian, F.decode(rest, "UTF-16BE")).when(well_formed, F.decode(rest, "UTF-16LE"))


def is_executable_mime(mime: Column) -> Column:
    return F.coalesce(mime.contains("executable") | mime.contains("x-elf") | mime.contains("x-msdownload"), F.lit(False))


def type_mismatch(path: Column, suffix: Column, mime: Column, text: Column) -> Column:
    expected = F.create_map(*[F.lit(x) for pair in EXPECTED_MIME.items() for x in pair])[suffix]
    shown = F.regexp_replace(text, r"(?U)\A\x{FEFF}*\s*", "")
    svg = (suffix == "svg") & text.isNotNull() & ~shown.startswith("<svg") & ~shown.startswith("<?xml")
    wrong = F.coalesce(svg, F.lit(False)) | (expected.isNotNull() & ~expected.eqNullSafe(mime))
    high = is_executable_mime(mime)
    evidence = F.array(F.concat(F.lit("extension: ."), suffix), F.concat(F.lit("detected MIME: "), F.coalesce(mime, F.lit("unknown"))))
    return F.when(
        wrong,
        finding(
            "FILE-TYPE-MISMATCH", F.when(high, "high").otherwise("medium"), "high", F.when(high, 80).otherwise(45), "File extension does not match its content",
            "The declared file type disagrees with byte signatures or expected structure.", file=path, evidence=evidence,
        ),
    )


def executable_markers(text: Column) -> Column:
    found = F.lit(0)
    for marker in EXECUTABLE_MARKERS:
        found = found + text.contains(marker).cast("int")
    return found


def executable_content(path: Column, suffix: Column, text: Column) -> Column:
    return F.when(
        suffix.isin(NON_CODE_EXTENSIONS) & (executable_markers(text) >= 2),
        finding(
            "FILE-EXECUTABLE-CONTENT", "medium", "medium", 45, "Executable-looking text uses a non-code extension",
            "The file contains multiple source-code indicators despite its declared asset or data extension.", file=path, evidence=F.array(F.concat(F.lit("extension: ."), suffix)),
        ),
    )


def raw_findings(path: Column, text: Column, longest_line: Column) -> list[Column]:
    gap = gap_run(text)
    return [
        F.when(
            longest_line >= LONG_LINE,
            finding(
                "RAW-EXTREME-LINE", "medium", "high", 40, "Extremely long line", "Very long lines can conceal code outside the normal editor viewport.",
                file=path, evidence=F.array(F.concat(F.lit("maximum line length: "), longest_line.cast("string"), F.lit(" bytes"))),
            ),
        ),
        F.when(
            has_text_after_eof(text),
            finding(
                "RAW-CONTENT-AFTER-EOF", "high", "high", 75, "Content follows an apparent logical EOF marker",
                "Printable content appears after a control character commonly treated as end-of-file.",
                file=path, evidence=F.array(F.concat(F.lit("content resumes after byte offset "), eof_offset(text).cast("string"))),
            ),
        ),
        F.when(
            gap > 0,
            finding(
                "RAW-HIDDEN-AFTER-WHITESPACE", "high", "high", 75, "Content hidden after extreme horizontal whitespace",
                "Non-whitespace content appears after a large horizontal gap on one line.",
                file=path, line=gap_line(text), evidence=F.array(F.concat(F.lit("horizontal whitespace run: "), gap.cast("string"), F.lit(" bytes"))),
            ),
        ),
    ]


def classify(files_raw: DataFrame) -> DataFrame:
    """files_raw with the columns of a file record, decoded text, and the findings of each file in the order in which they are reported.

    Rows without content (links, special files, files over a limit) only get what their path says.
    """
    path, content = F.col("path"), F.col("content")
    there = content.isNotNull()
    base = files_raw.withColumn("extension", extension(path)).withColumn("roles", F.when(F.col("kind") == "file", roles(path)).otherwise(F.array().cast("array<string>")))
    encoding, text = decoded(content, F.col("extension"))
    measured = (
        base.withColumn("encoding", encoding)
        .withColumn("text", text)
        .withColumn("detected_mime", detected_mime(content))
        .withColumn("entropy", byte_entropy(content))
        .withColumn("line_count", F.when(there, line_count(content)))
        .withColumn("max_line_length", F.when(there, max_line_length(content)))
        .withColumn("sha256", F.sha2(content, 256))
        .withColumn("content_scanned", there)
        .withColumn("parsed_language", F.lit(None).cast("string"))
    )
    signals = raw_signals(F.col("text"), F.col("max_line_length"), F.octet_length(content), F.col("entropy"))
    found = [
        *raw_findings(path, F.col("text"), F.col("max_line_length")),
        *signature_findings(path, content),
        type_mismatch(path, F.col("extension"), F.col("detected_mime"), F.col("text")),
        executable_content(path, F.col("extension"), F.col("text")),
    ]
    return measured.withColumn("raw_signals", F.when(there, signals).otherwise(F.array().cast("array<string>"))).withColumn(
        "found", F.when(there, F.array_compact(F.array(*found))).otherwise(F.array().cast(measured.select(F.array(found[0])).schema[0].dataType))
    )
