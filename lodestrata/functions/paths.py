"""What a path says about a file: extension, roles, language, and what a module specifier resolves to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and suffixes.
LOCKFILES = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml"]
EXECUTABLE_CONFIGS = ["vite", "webpack", "tailwind", "postcss", "eslint", "next", "babel", "jest", "rollup"]
BUILD_SCRIPTS = ["Makefile", "Dockerfile", "justfile", "Taskfile", "Taskfile.yml"]
CODE_SUFFIXES = [".js", ".cjs", ".mjs", ".ts", ".cts", ".mts", ".jsx", ".tsx", ".html", ".htm", ".xhtml", ".vue", ".md", ".mdx"]
LANGUAGE_BASENAMES = {"setup.py": "python", "pyproject.toml": "python", "build.rs": "rust", "extconf.rb": "ruby", "composer.json": "php", "pom.xml": "java"}
LANGUAGE_EXTENSIONS = {
    "shell": ["sh", "bash", "zsh", "fish"],
    "powershell": ["ps1", "psm1", "psd1"],
    "batch": ["bat", "cmd"],
    "python": ["py", "pyw"],
    "rust": ["rs"],
    "go": ["go"],
    "php": ["php"],
    "ruby": ["rb"],
    "java": ["java", "gradle", "kts"],
    "dotnet": ["cs", "csproj", "props", "targets"],
}


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def exact_extension(path: Column) -> Column:
    """Text after the last dot of the file name; null for names without one or with only a leading one."""
    name = basename(path)
    return F.when(name.rlike(r"(?s)\A.+\.[^.]*\z") & (name != ".."), F.substring_index(name, ".", -1))


def extension(path: Column) -> Column:
    return F.lower(exact_extension(path))


def roles(path: Column) -> Column:
    whole, name = slashes(path), basename(slashes(path))
    tags = [
        ("npm_manifest", name == "package.json"),
        ("dependency_lockfile", name.isin(LOCKFILES)),
        ("developer_tool_config", whole.startswith(".vscode/") | (whole == ".devcontainer/devcontainer.json")),
        ("executable_config", name.rlike(rf"\A(?:{'|'.join(EXECUTABLE_CONFIGS)})\.config\.")),
        ("ci_config", whole.startswith(".github/workflows/") | name.isin([".gitlab-ci.yml", "Jenkinsfile"])),
        ("build_script", name.isin(BUILD_SCRIPTS) | name.startswith("docker-compose")),
    ]
    return F.array_compact(F.array(*[F.when(found, F.lit(tag)) for tag, found in tags]))


def language(path: Column) -> Column:
    """The language of files outside JavaScript; by name first, then by the extension as it is written."""
    whole, name = slashes(path), basename(slashes(path))
    out = F.when(whole.isin([".cargo/config", ".cargo/config.toml"]), "rust").when(name.endswith(".gemspec"), "ruby")
    for base, lang in LANGUAGE_BASENAMES.items():
        out = out.when(name == base, lang)
    suffix = exact_extension(name)
    for lang, suffixes in LANGUAGE_EXTENSIONS.items():
        out = out.when(suffix.isin(suffixes), lang)
    return out


def has_code_extension(path: Column) -> Column:
    return path.rlike(r"\.(?:" + "|".join(s[1:] for s in CODE_SUFFIXES) + r")\z")


#: What is tried after the specifier itself, in this order.
IMPORT_SUFFIXES = [".js", ".cjs", ".mjs", ".ts", ".cts", ".mts", ".jsx", ".tsx", "/index.js", "/index.ts"]


def resolve_from(source: Column, specifier: Column) -> Column:
    """specifier as seen from the folder of source; empty if it is absolute or leaves the root."""
    folder = F.when(F.instr(source, "/") > 0, F.regexp_replace(source, r"/[^/]*\z", "")).otherwise("")
    parts = F.filter(F.split(F.concat_ws("/", folder, specifier), "/"), lambda p: (p != "") & (p != "."))
    step = F.aggregate(
        parts,
        F.lit(None).cast("array<string>"),
        lambda done, p: F.when(p != "..", F.concat(F.coalesce(done, F.array().cast("array<string>")), F.array(p)))
        .when(F.coalesce(F.size(done), F.lit(0)) > 0, F.slice(done, 1, F.size(done) - 1))
        .otherwise(F.array(F.lit("..").cast("string"), F.lit("..").cast("string"))),
    )
    left = F.exists(_depths(parts), lambda d: d < 0)
    return F.when(specifier.startswith("/") | left, "").otherwise(F.concat_ws("/", step))


def _depths(parts: Column) -> Column:
    """Folder depth after each part; negative where the path has left its root."""
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
        lambda n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda depth, p: depth + F.when(p == "..", -1).otherwise(1)),
    )
