"""The 22 content signals, in the order in which they are reported, as one array column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .content import byte_view, contains_any, longest_match, occurrences

# Thresholds and markers.
LONG_LINE = 10_000
LONG_GAP = 512
LONG_RUN = 512
UNICODE_ESCAPES = 32
HEX_IDENTIFIERS = 8
DELAY_MS, DELAY_WINDOW = 5_000, 128
ENTROPY_BYTES, ENTROPY_BITS = 2_048, 5.5
VM_MARKERS = ["VirtualBox", "VMware", "QEMU", "Parallels"]
LOCALE_MARKERS = ["navigator.language", "process.env.LANG", "Intl.DateTimeFormat"]
PROCESS_LIST_MARKERS = ["tasklist", "Get-Process", "ps aux", "/proc/"]
SECURITY_TOOLS = ["Wireshark", "ProcessHacker", "x64dbg", "OllyDbg", "Procmon"]
LARGEST_U64 = str(2**64 - 1)

#: A gap that text follows on the same line; a line's own \r\n doesn't count as text.
GAP = rf"(?<![ \t])[ \t]{{{LONG_GAP},}}+(?!\r\n)[^ \t\n]"
AFTER_EOF = r"(?sU)\A[^\x1A]*\x1A.*[^\s\p{Cc}]"
IPV4_TOKEN = r"(?<![0-9.])(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9.])"
WALLET_TOKEN = r"(?<![A-Za-z0-9])[0-9a-fA-F]{40}(?![A-Za-z0-9])"


def whole_run(characters: str, least: int) -> str:
    """Runs of a class that are at least so long; a run is tried once, from its start."""
    return rf"(?<![{characters}])[{characters}]{{{least},}}+"


def has_text_after_eof(text: Column) -> Column:
    return text.contains("\x1a") & text.rlike(AFTER_EOF)


def eof_offset(text: Column) -> Column:
    return F.octet_length(F.substring_index(text, "\x1a", 1)).cast("long")


def gap_run(text: Column) -> Column:
    """Length of the first long gap that text follows, else 0."""
    return F.greatest(F.length(F.regexp_extract(text, GAP, 0)) - 1, F.lit(0))


def gap_line(text: Column) -> Column:
    before = F.substr(text, F.lit(1), F.regexp_instr(text, F.lit(GAP)))
    return (F.length(before) - F.length(F.translate(before, "\n", "")) + 1).cast("long")


def has_long_delay(text: Column) -> Column:
    """A number of at least 4 digits and 5000 within 128 bytes after a timer's name; digits are cut at the window's end, as they are read there."""
    windows = F.regexp_extract_all(byte_view(text), F.lit(rf"(?s)(?:setTimeout|setInterval)(?=(.{{0,{DELAY_WINDOW}}}))"), F.lit(1))

    def long_enough(digits: Column) -> Column:
        bare = F.ltrim(digits, F.lit("0"))
        size = F.length(bare)
        fits = (size < len(LARGEST_U64)) | ((size == len(LARGEST_U64)) & (bare <= LARGEST_U64))
        return (F.length(digits) >= 4) & fits & ((size > 4) | ((size == 4) & (bare >= str(DELAY_MS))))

    found = F.exists(windows, lambda w: F.exists(F.regexp_extract_all(w, F.lit("[0-9]+"), F.lit(0)), long_enough))
    return contains_any(text, ["setTimeout", "setInterval"]) & found


def ipv4_tokens(text: Column) -> Column:
    """Maximal runs of digits and dots that are four numbers up to 255."""
    return F.when(text.rlike(r"[0-9]\.[0-9]"), F.regexp_count(text, F.lit(IPV4_TOKEN))).when(text.isNotNull(), 0).cast("long")


def wallet_tokens(text: Column) -> Column:
    """Maximal ASCII alphanumeric runs of exactly 40 hex digits."""
    return F.regexp_count(text, F.lit(WALLET_TOKEN)).cast("long")


def url_count(text: Column) -> Column:
    return occurrences(text, "http://") + occurrences(text, "https://")


def _counted(label: str, value: Column, least: int, unit: str = "") -> Column:
    return F.when(value >= least, F.concat(F.lit(label), value.cast("string"), F.lit(unit)))


def _plain(label: str, found: Column) -> Column:
    return F.when(found, F.lit(label))


def signal_columns(text: Column, longest_line: Column, size: Column, entropy: Column) -> dict[str, Column]:
    """A nullable string column per signal, keyed H1 to H22; all but H1 need decoded text."""
    bytes_of: Callable[[Column], Column] = byte_view
    gap = gap_run(text)
    return {
        "H1": _counted("extreme line length: ", longest_line, LONG_LINE, " bytes"),
        "H2": _plain("content follows an apparent logical EOF marker", has_text_after_eof(text)),
        "H3": F.when(gap > 0, F.concat(F.lit("code follows "), gap.cast("string"), F.lit(" horizontal whitespace bytes"))),
        "H4": F.when(gap == 0, _counted("extreme horizontal whitespace: ", longest_match(text, whole_run(r" \t", LONG_GAP)), LONG_GAP, " bytes")),
        "H5": _counted("large base64-like sequence: ", longest_match(text, whole_run("A-Za-z0-9+/=", LONG_RUN)), LONG_RUN, " bytes"),
        "H6": _counted("large hexadecimal sequence: ", longest_match(text, whole_run("0-9A-Fa-f", LONG_RUN)), LONG_RUN, " bytes"),
        "H7": _counted("unicode escape sequences: ", occurrences(text, "\\u"), UNICODE_ESCAPES),
        "H8": _plain("character-code string construction", contains_any(text, ["String.fromCharCode", "String['fromCharCode']"])),
        "H9": _plain("possible XOR string decoder", text.contains("charCodeAt") & text.contains("^")),
        "H10": _counted("_0x-style identifiers: ", occurrences(text, "_0x"), HEX_IDENTIFIERS),
        "H11": _plain("anti-debugging or automation check", contains_any(text, ["debugger;", "navigator.webdriver"])),
        "H12": _plain("virtual-machine environment check", contains_any(text, VM_MARKERS)),
        "H13": _plain("locale or regional environment check", contains_any(text, LOCALE_MARKERS)),
        "H14": _plain("security-tool process enumeration check", contains_any(text, PROCESS_LIST_MARKERS) & contains_any(text, SECURITY_TOOLS)),
        "H15": _plain("long timer delay", has_long_delay(text)),
        "H16": _plain("PowerShell download or execution primitive", contains_any(text, ["Invoke-WebRequest", "Invoke-Expression"])),
        "H17": _counted("URL occurrences: ", url_count(text), 1),
        "H18": _counted("IPv4 address occurrences: ", ipv4_tokens(text), 1),
        "H19": _counted("wallet-like identifiers: ", wallet_tokens(text), 1),
        "H20": _plain("webhook endpoint", contains_any(text, ["discord.com/api/webhooks", "hooks.slack.com"])),
        "H21": _plain("shortened URL", contains_any(text, ["bit.ly/", "tinyurl.com/", "t.co/"])),
        "H22": F.when((size >= ENTROPY_BYTES) & (entropy >= ENTROPY_BITS), F.format_string("high-entropy text: %.2f bits per byte", entropy)),
    }


def raw_signals(text: Column, longest_line: Column, size: Column, entropy: Column) -> Column:
    return F.array_compact(F.array(*signal_columns(text, longest_line, size, entropy).values()))
