"""The rule catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Ids and descriptions. Three don't name a parser or a signature engine, as this one has its own.
RULES = {
    "CONFIG-PARSE-FAILED": "Security-relevant configuration could not be parsed; scan coverage is incomplete.",
    "DEVCONTAINER-EXECUTION-HOOK": "A devcontainer hook can execute repository-controlled commands.",
    "FILE-EXECUTABLE-CONTENT": "Executable-looking text appears under a non-code extension.",
    "FILE-PARSEABLE-JAVASCRIPT": "Executable-looking text under a non-code extension parses as JavaScript.",
    "FILE-TYPE-MISMATCH": "File extension and content signature or structure disagree.",
    "FS-ABSOLUTE-SYMLINK": "An absolute symlink target was recorded without following it.",
    "FS-PATH-ESCAPE": "A path resolved outside the scan root and was not read.",
    "FS-SPECIAL-FILE": "A device, FIFO, socket, or other special file was not opened.",
    "FS-SYMLINK-ESCAPE": "A symlink target escapes the scan root and was not followed.",
    "IDE-AUTOMATIC-TASKS": "Workspace settings permit automatic tasks.",
    "IDE-FOLDER-OPEN-DOWNLOAD-EXECUTE": "A VS Code folder-open task contains a download or execution command.",
    "IDE-FOLDER-OPEN-TASK": "A VS Code task runs on folder open.",
    "IDE-HIDDEN-SECURITY-FILES": "Workspace settings conceal security-relevant files.",
    "IDE-PRELAUNCH-TASK": "A debug launch configuration invokes a workspace task.",
    "LANG-EXECUTION-ROOT": "A recognized build or package hook can run repository-controlled source.",
    "LANG-REMOTE-DATA-EXECUTION-CAPABILITY": "One recognized language source contains remote-input and execution capabilities; runtime data flow is not proven.",
    "LANG-REMOTE-DOWNLOAD-EXECUTE": "A recognized language source directly pipes or passes remote content to execution.",
    "JS-COMBINED-ATTACK-CHAIN": "One evidenced route contains secret exfiltration and remote execution chains.",
    "JS-CONCEALED-EXECUTION": "Reachable code or process execution coincides with visual concealment.",
    "JS-DOWNLOAD-WRITE-EXECUTE": "Remote bytes flow through a filesystem write into process execution.",
    "JS-DYNAMIC-EXECUTION": "JavaScript contains a dynamic code execution capability; the call alone does not prove maliciousness.",
    "JS-PROCESS-EXECUTION": "JavaScript contains a process execution capability; the call alone does not prove maliciousness.",
    "JS-PERSISTENCE-COMMAND": "JavaScript invokes a recognized command that registers automatic startup.",
    "JS-PERSISTENCE-WRITE": "JavaScript writes to a recognized automatic startup location.",
    "JS-REACHABLE-DISGUISED-SOURCE": "An execution root imports parseable JavaScript under a non-code extension.",
    "JS-REMOTE-CODE-EXECUTION": "Remote-controlled data reaches dynamic JavaScript execution.",
    "JS-REMOTE-PROCESS-EXECUTION": "Remote-controlled data reaches a process execution API.",
    "JS-SECRET-EXFILTRATION": "Sensitive environment, file, or clipboard data reaches an outbound request.",
    "NPM-EXECUTION-SCRIPT": "An npm script is a possible execution root.",
    "NPM-LIFECYCLE-SCRIPT": "An npm lifecycle hook can run during installation or preparation.",
    "RAW-CONTENT-AFTER-EOF": "Printable content follows an apparent logical EOF marker.",
    "RAW-EXTREME-LINE": "An extremely long line may conceal source outside an editor viewport.",
    "RAW-HIDDEN-AFTER-WHITESPACE": "Content follows a large horizontal whitespace run.",
    "YARA-POWERSHELL-DOWNLOAD-EXEC": "A signature matched a PowerShell download, decode, and execution pattern.",
    "YARA-JS-ENCRYPTED-LOADER": "A signature matched an AES-decrypted dynamic JavaScript loader pattern.",
}


def rules_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES.items()), "id string, description string")


def show(id: str) -> str | None:
    return f"{id}\n{RULES[id]}" if id in RULES else None
