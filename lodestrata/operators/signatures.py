"""Byte signatures: all strings of a rule must occur, letters in either case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .findings import finding

# Rule name, finding id, title, message, patterns.
SIGNATURES = [
    (
        "PF_Aes_Encrypted_Function_Loader",
        "YARA-JS-ENCRYPTED-LOADER",
        "Encrypted JavaScript loader pattern",
        "A file combines AES decryption and dynamic JavaScript function construction indicators.",
        ["createDecipheriv", "aes-256-cbc", r"new\s+Function"],
    ),
    (
        "PF_Encoded_PowerShell_Download_Execute",
        "YARA-POWERSHELL-DOWNLOAD-EXEC",
        "Encoded PowerShell download and execution pattern",
        "A file combines remote download, base64 decoding, and PowerShell expression execution indicators.",
        ["DownloadString", "FromBase64String", "Invoke-Expression"],
    ),
]


def matches(content: Column, patterns: list[str]) -> Column:
    """On a one-character-per-byte view, so undecodable bytes don't hide a match."""
    view = F.decode(content, "ISO-8859-1")
    found = F.lit(True)
    for pattern in patterns:
        found = found & view.rlike(f"(?i){pattern}")
    return found


def signature_findings(path: Column, content: Column) -> list[Column]:
    """In the order of the rules in their source: PowerShell first."""
    return [
        F.when(matches(content, patterns), finding(id, "medium", "medium", 60, title, message, file=path, evidence=F.array(F.lit(f"matched YARA-X rule {rule}"))))
        for rule, id, title, message, patterns in reversed(SIGNATURES)
    ]
