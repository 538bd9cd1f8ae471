"""Remote input and execution in other languages, by indicators in one source file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import first_line
from ..functions.paths import basename, exact_extension, language
from ..limits import DEFAULT
from .findings import finding

# Fixed values: (remote-input indicators, execution indicators) in lower case, in reporting order.
INDICATORS = {
    "shell": (["curl", "wget", "invoke-webrequest", "downloadstring"], ["| sh", "| bash", "invoke-expression", "bash -c", "sh -c"]),
    "powershell": (["invoke-webrequest", "downloadstring", "start-bitstransfer"], ["invoke-expression", "iex ", "start-process", "scriptblock::create"]),
    "batch": (["certutil", "bitsadmin", "curl", "powershell -command"], ["start ", "call ", "cmd /c", "-encodedcommand"]),
    "python": (["requests.get", "urllib.request", "urlopen(", "httpx.get"], ["exec(", "eval(", "subprocess.", "os.system("]),
    "rust": (["reqwest::get", "ureq::get", "hyper::client", "tcpstream::connect"], ["process::command", "command::new", ".spawn(", ".output("]),
    "go": (["http.get(", "http.newrequest", "client.do(", "net.dial("], ["exec.command(", "commandcontext(", ".start(", ".run("]),
    "php": (["curl_exec(", "file_get_contents(", "fopen("], ["eval(", "shell_exec(", "proc_open(", "system("]),
    "ruby": (["net::http", "open-uri", "http.get("], ["kernel.system", "system(", "exec(", "open3.capture"]),
    "java": (["httpclient", "url.openconnection", "httpurlconnection"], ["processbuilder", "runtime.getruntime().exec", " .start("]),
    "dotnet": (["httpclient", "webclient", "downloadstring(", "downloadfile("], ["process.start(", "powershell", "assembly.load("]),
}
ROOT_NAMES = {
    "shell": ["install.sh", "setup.sh", "build.sh"],
    "powershell": ["install.ps1", "setup.ps1", "build.ps1"],
    "batch": ["install.bat", "setup.cmd", "build.cmd"],
    "java": ["build.gradle", "build.gradle.kts", "pom.xml"],
}


def matched(lang: Column, source: Column, role: int) -> Column:
    """Indicators of the file's language that occur, in reporting order."""
    table = F.create_map(*[x for name, lists in INDICATORS.items() for x in (F.lit(name), F.array(*map(F.lit, lists[role])))])
    return F.filter(F.coalesce(table[lang], F.array().cast("array<string>")), lambda needle: F.contains(source, needle))


def is_direct(sources: Column, sinks: Column) -> Column:
    def both(source: str, *sink: str) -> Column:
        return F.array_contains(sources, source) & F.arrays_overlap(sinks, F.array(*map(F.lit, sink)))

    return F.arrays_overlap(sources, sinks) | both("downloadstring", "invoke-expression") | both("curl", "| sh", "| bash")


def is_execution_root(path: Column, lang: Column, source: Column) -> Column:
    name = basename(path)
    out = F.when(lang == "python", (name == "setup.py") | ((name == "pyproject.toml") & source.contains("build-backend")))
    out = out.when(lang == "rust", (name == "build.rs") | source.contains("rustc-wrapper") | source.contains("runner ="))
    out = out.when(lang == "ruby", (name == "extconf.rb") | name.endswith(".gemspec"))
    out = out.when(lang == "php", (name == "composer.json") & source.contains('"scripts"'))
    out = out.when(lang == "go", source.rlike(r"(?mU)^\s*//go:generate"))
    out = out.when(lang == "dotnet", F.coalesce(exact_extension(name).isin("csproj", "props", "targets"), F.lit(False)) & source.contains("<target"))
    for known, names in ROOT_NAMES.items():
        out = out.when(lang == known, name.isin(names))
    return out.otherwise(False)


def language_findings(path: Column, text: Column, max_bytes: int = DEFAULT.language_bytes) -> list[Column]:
    lang = language(path)
    source = F.when(F.octet_length(text) <= max_bytes, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    sources, sinks = matched(lang, source, 0), matched(lang, source, 1)
    direct = is_direct(sources, sinks)
    message = F.concat(F.lit("The "), lang, F.lit(" source contains both remote-input and execution indicators; this bounded text analysis does not prove runtime data flow."))
    both = finding(
        F.when(direct, "LANG-REMOTE-DOWNLOAD-EXECUTE").otherwise("LANG-REMOTE-DATA-EXECUTION-CAPABILITY"),
        F.when(direct, "high").otherwise("medium"), F.when(direct, "high").otherwise("medium"), F.when(direct, 85).otherwise(60),
        F.when(direct, "Remote content is directly piped or passed to execution").otherwise("Remote input and execution capabilities occur in one source file"),
        message, file=path, line=indicator_line(text, F.get(sources, F.lit(0))),
        evidence=F.array(F.concat(F.lit("remote-input indicator: "), F.array_join(sources, ", ")), F.concat(F.lit("execution indicator: "), F.array_join(sinks, ", "))),
    )
    root = finding(
        "LANG-EXECUTION-ROOT", "informational", "high", 10, F.concat(lang, F.lit(" build or package hook is an execution root")),
        "The file can run automatically during build, packaging, or developer-tool startup.", file=path, evidence=F.array(F.concat(F.lit("recognized execution-root path: "), path)),
    )
    return [F.when((F.size(sources) > 0) & (F.size(sinks) > 0), both), F.when(source.isNotNull() & is_execution_root(path, lang, source), root)]


def indicator_line(text: Column, needle: Column) -> Column:
    return first_line(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), needle)


def language_reasons(path: Column, text: Column, scanned: Column, max_bytes: int = DEFAULT.language_bytes) -> Column:
    """Why a recognised source wasn't analysed; null otherwise."""
    lang = language(path)
    return F.when(
        lang.isNotNull() & scanned,
        F.when(text.isNull(), F.concat(F.lit("cannot decode "), lang, F.lit(" source: "), path)).when(
            F.octet_length(text) > max_bytes, F.concat(lang, F.lit(f" source exceeds {max_bytes} byte analysis limit: "), path)
        ),
    )


def analyse_languages(classified: DataFrame, max_bytes: int = DEFAULT.language_bytes) -> DataFrame:
    """classified with the language of other sources, its findings in language_found, and why a source wasn't analysed in language_reason."""
    path, text, scanned = F.col("path"), F.col("text"), F.col("content_scanned")
    own = F.array_compact(F.array(*language_findings(path, text, max_bytes)))
    return (
        classified.withColumn("language_found", F.when(scanned, own).otherwise(F.expr("slice(found, 1, 0)")))
        .withColumn("language", F.when(scanned, language(path)))
        .withColumn("language_reason", language_reasons(path, text, scanned, max_bytes))
    )
