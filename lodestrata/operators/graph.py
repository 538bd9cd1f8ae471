"""The import graph: resolution, reachability with routes, called scope, and the findings that follow from them.

Everything is keyed by repo_id, so many repositories are done in one job.
modules(repo_id, seq, id, path), imports(repo_id, module_id, seq, specifier,
line), calls(repo_id, module_id, seq, name, line, evidence, capability,
function), roots(repo_id, seq, file, trigger, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import IMPORT_SUFFIXES, has_code_extension, resolve_from
from ..limits import DEFAULT
from ..storage import durable, durable_by, noting, remove
from .findings import finding, first_per_key
from .ranges import PLACE_BITS, in_ranges, places

# Modules of the runtime, capabilities, signal prefixes.
BUILTIN_MODULES = ["fs", "os", "path", "http", "https", "vm", "child_process", "crypto", "net", "tls"]
DANGEROUS = ["DynamicCode", "Process", "Secret", "Network"]
EXECUTION = ["DynamicCode", "Process"]
OBFUSCATION = [
    (0, ["_0x-style identifiers:", "unicode escape sequences:", "character-code string construction", "possible XOR string decoder"]),
    (1, ["large base64-like sequence:", "large hexadecimal sequence:", "high-entropy text:"]),
    (2, ["anti-debugging or automation check", "virtual-machine environment check", "locale or regional environment check", "security-tool process enumeration check", "long timer delay"]),
]


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Relative imports with the path they resolve to, null if none: repo_id, module_id, seq, source, specifier, line, target.

    Eleven candidates are tried in order. They are one equi-join on the path;
    the best rank is aggregated before the shuffle.
    """
    paths = modules.select("repo_id", F.col("path").alias("candidate")).distinct()
    own = modules.select("repo_id", F.col("id").alias("module_id"), F.col("path").alias("source")).distinct()
    relative = imports.filter(F.col("specifier").startswith(".")).join(own, ["repo_id", "module_id"])
    relative = relative.withColumn("base", resolve_from(F.col("source"), F.col("specifier")))
    options = F.array(F.col("base"), *[F.concat(F.col("base"), F.lit(s)) for s in IMPORT_SUFFIXES])
    keys = ["repo_id", "module_id", "seq", "source", "specifier", "line"]
    tried = relative.filter("base != ''").select(*keys, F.posexplode(options).alias("rank", "candidate"))
    hits = tried.join(paths, ["repo_id", "candidate"]).groupBy("repo_id", "module_id", "seq").agg(F.min_by("candidate", "rank").alias("target"))
    return relative.select(*keys).join(hits, ["repo_id", "module_id", "seq"], "left")


def import_edges(resolved: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges to every module of the file that an import resolves to: repo_id, src, dst, line, seq, dst_seq."""
    targets = modules.select("repo_id", F.col("path").alias("target"), F.col("id").alias("dst"), F.col("seq").alias("dst_seq"))
    found = resolved.filter("target is not null").join(targets, ["repo_id", "target"])
    return found.select("repo_id", F.col("module_id").alias("src"), "dst", "line", "seq", "dst_seq")


def lost_imports(imports: DataFrame, resolved: DataFrame, modules: DataFrame) -> DataFrame:
    """repo_id, module_id, seq, edge: a message for each import that leads nowhere in the repository."""
    own = modules.select("repo_id", F.col("id").alias("module_id"), F.col("path").alias("source")).distinct()
    outside = imports.filter(~F.col("specifier").startswith(".")).join(own, ["repo_id", "module_id"])
    dynamic = F.col("specifier").startswith("<dynamic ")
    builtin = F.col("specifier").startswith("node:") | F.col("specifier").isin(BUILTIN_MODULES)

    def message(why: Column) -> Column:
        return F.concat("source", F.lit(":"), F.col("line").cast("string"), F.lit(" -> "), "specifier", F.lit(" ("), why, F.lit(")"))

    reason = F.when(dynamic, "dynamic module target unresolved").otherwise("external package not inspected")
    missing = resolved.filter("target is null").select("repo_id", "module_id", "seq", message(F.lit("relative import unresolved")).alias("edge"))
    return outside.filter(dynamic | ~builtin).select("repo_id", "module_id", "seq", message(reason).alias("edge")).unionByName(missing)


def unresolved_imports(imports: DataFrame, resolved: DataFrame, modules: DataFrame) -> DataFrame:
    """repo_id, edge: distinct messages of imports that lead nowhere in the repository."""
    return lost_imports(imports, resolved, modules).select("repo_id", "edge").distinct()


def within_edge_limit(edges: DataFrame, lost: DataFrame, imports: DataFrame, modules: DataFrame, limit: int = DEFAULT.graph_edges) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, lost imports, repositories that were cut): the first `limit` of both together, by module, import and target.

    A repository is cut, or told to be, when an import is left once the limit is
    reached. Only those that reach it are numbered.
    """
    items = edges.select("repo_id", F.col("src").alias("module_id"), "seq", "dst_seq").unionByName(lost.select("repo_id", "module_id", "seq", F.lit(-1).cast("long").alias("dst_seq")))
    over = items.groupBy("repo_id").count().filter(F.col("count") >= limit).select("repo_id")
    order = modules.select("repo_id", F.col("id").alias("module_id"), F.col("seq").alias("module_seq"))
    placed = numbered(items.join(over, "repo_id", "left_semi").join(order, ["repo_id", "module_id"]), ["module_seq", "seq", "dst_seq"], "n")
    gone = placed.filter(F.col("n") > limit)
    last = placed.filter(F.col("n") == limit).select("repo_id", F.struct("module_seq", "seq").alias("last"))
    later = imports.select("repo_id", "module_id", "seq").join(last, "repo_id").join(order, ["repo_id", "module_id"]).filter(F.struct("module_seq", "seq") > F.col("last"))
    kept = edges.join(gone.select("repo_id", F.col("module_id").alias("src"), "seq", "dst_seq"), ["repo_id", "src", "seq", "dst_seq"], "left_anti").select(*edges.columns)
    told = lost.join(gone.filter("dst_seq < 0").select("repo_id", "module_id", "seq"), ["repo_id", "module_id", "seq"], "left_anti").select(*lost.columns)
    return kept, told, gone.select("repo_id").unionByName(later.select("repo_id")).distinct()


def unresolved_roots(roots: DataFrame, modules: DataFrame) -> DataFrame:
    known = modules.select("repo_id", F.col("id").alias("file")).distinct()
    lost = roots.join(known, ["repo_id", "file"], "left_anti")
    edge = F.when(F.col("file") == "", F.concat("trigger", F.lit(" (command target unresolved)"))).otherwise(F.concat("trigger", F.lit(" -> "), "file", F.lit(" (entry unresolved)")))
    return lost.select("repo_id", edge.alias("edge")).distinct()


def entry_points(roots: DataFrame, modules: DataFrame) -> DataFrame:
    """The first root of each module: repo_id, id, path, seq, route of depth 0."""
    first = first_per_key(roots, ["repo_id", "file"], ["seq"])
    at = F.when(F.col("line").isNotNull(), F.concat(F.lit(" at line "), F.col("line").cast("string"))).otherwise("")
    route = F.array(F.concat(F.lit("trigger: "), "trigger", at), F.concat(F.lit("entry: "), "path"))
    # Roots name modules by id, not by path.
    named = modules.select("repo_id", F.col("id").alias("file"), "path")
    return first.join(named, ["repo_id", "file"]).select("repo_id", F.col("file").alias("id"), "path", "seq", route.alias("route"))


def _queued(level: DataFrame, order: list[str]) -> DataFrame:
    """level, written in the order of its queue, with rank, which grows along it."""
    ranged = in_ranges(level, [], order, label="graph-level")
    return ranged.withColumn("rank", F.shiftleft(F.col("_part").cast("long"), PLACE_BITS) + F.col("_at")).drop("_part", "_at")


def reachable_modules(roots: DataFrame, edges: DataFrame, modules: DataFrame, max_route: int = DEFAULT.route_length) -> tuple[DataFrame, DataFrame]:
    """(repo_id, id, path, depth, route of every reachable module; repositories in which a route reached its limit).

    Breadth first, level by level. Of several ways to a module on one level the
    first in queue order wins: by its parent's rank in the level before, then by
    the edge's numbers. Edges and modules lie in buckets, so a level moves its
    own modules and a few numbers for each edge that leaves it; routes are made
    once the parents are chosen. Levels are written to the shared folder, so
    that the plan doesn't grow with their work and a lost executor costs a
    reread.
    """
    spark = edges.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    steps = durable_by(edges.select("repo_id", "src", "dst", "line", "seq", "dst_seq").repartition(n, "repo_id", "src"), "graph-steps", ["repo_id", "src"], n)
    known = durable_by(modules.repartition(n, "repo_id", "id").groupBy("repo_id", "id").agg(F.min("path").alias("path")), "graph-modules", ["repo_id", "id"], n)
    frontier = _queued(durable(entry_points(roots, known), "graph-entries"), ["seq"])
    routes = frontier.select("repo_id", "id", "path", "rank", "route")
    seen, reached, depth = frontier.select("repo_id", "id"), routes.withColumn("depth", F.lit(0)), 0
    while True:
        ways = frontier.select("repo_id", F.col("id").alias("src"), F.col("rank").alias("parent")).join(steps, ["repo_id", "src"])
        first = ways.groupBy("repo_id", F.col("dst").alias("id")).agg(F.min(F.struct("parent", "seq", "dst_seq", "line")).alias("way"))
        onward = first.join(seen, ["repo_id", "id"], "left_anti").join(known, ["repo_id", "id"]).select("repo_id", "id", "path", "way.*")
        at_limit = depth + 2 >= max_route
        if not at_limit:
            with noting() as passing:
                found = durable(onward, "graph-found")
        if at_limit or found.isEmpty():
            limited = onward.select("repo_id").distinct() if at_limit else found.select("repo_id")
            return reached.select("repo_id", "id", "path", "depth", "route"), limited
        frontier, depth = _queued(found, ["parent", "seq", "dst_seq"]), depth + 1
        remove(spark, *passing)
        parents = routes.select(F.col("rank").alias("parent"), F.col("path").alias("source"), "route")
        step = F.concat("source", F.lit(":"), F.col("line").cast("string"), F.lit(" imports "), "path")
        routed = frontier.join(parents, "parent").select("repo_id", "id", "path", "rank", F.concat("route", F.array(step)).alias("route"))
        routes = durable(routed, "graph-routes")
        seen, reached = seen.unionByName(frontier.select("repo_id", "id")), reached.unionByName(routes.withColumn("depth", F.lit(depth)))


def called_functions(calls: DataFrame, keep=None) -> DataFrame:
    """(repo_id, module_id, function) of local functions that a module calls from its top level, directly or through others."""
    keep = keep or (lambda df: durable(df, "call-level"))
    named = calls.filter(F.col("name").startswith("local:")).select("repo_id", "module_id", F.col("function").alias("caller"), F.expr("substring(name, 7)").alias("function")).distinct()
    frontier = keep(named.filter("caller is null").select("repo_id", "module_id", "function").distinct())
    seen = frontier
    while not frontier.isEmpty():
        onward = named.join(frontier.withColumnRenamed("function", "caller"), ["repo_id", "module_id", "caller"]).select("repo_id", "module_id", "function").distinct()
        frontier = keep(onward.join(seen, ["repo_id", "module_id", "function"], "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def in_called_scope(calls: DataFrame, called: DataFrame) -> DataFrame:
    """calls with a boolean column in_scope: at top level, or in a function that is called."""
    marks = called.withColumn("_called", F.lit(True))
    return calls.join(marks, ["repo_id", "module_id", "function"], "left").withColumn("in_scope", F.col("function").isNull() | F.coalesce("_called", F.lit(False))).drop("_called")


def obfuscation_category(signal: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for category, prefixes in OBFUSCATION:
        for prefix in prefixes:
            out = out.when(signal.startswith(prefix) if prefix.endswith(":") else signal == prefix, category)
    return out


def first_obfuscations(signals: Column) -> Column:
    """The first signals of up to two distinct obfuscation categories, in order."""
    firsts = F.filter(signals, lambda s, i: obfuscation_category(s).isNotNull() & ~F.exists(F.slice(signals, F.lit(1), i), lambda t: obfuscation_category(t).eqNullSafe(obfuscation_category(s))))
    return F.slice(firsts, 1, 2)


def graph_findings(modules: DataFrame, calls: DataFrame, reachable: DataFrame, files: DataFrame) -> DataFrame:
    """Concealed execution, disguised sources, and execution capabilities: repo_id, module_seq, position, and the finding."""
    scoped = in_called_scope(calls, called_functions(calls))

    def first_call(capabilities: list[str], name: str) -> DataFrame:
        hit = scoped.filter(F.col("in_scope") & F.col("capability").isin(capabilities))
        return hit.groupBy("repo_id", "module_id").agg(F.min_by(F.struct("name", "line"), "seq").alias(name))

    signals = files.select("repo_id", "path", "raw_signals")
    facts = (
        modules.select("repo_id", F.col("seq").alias("module_seq"), F.col("id").alias("module_id"), "path")
        .join(reachable.select("repo_id", F.col("id").alias("module_id"), "route"), ["repo_id", "module_id"], "left")
        .join(first_call(DANGEROUS, "dangerous"), ["repo_id", "module_id"], "left")
        .join(first_call(EXECUTION, "execution"), ["repo_id", "module_id"], "left")
        .join(signals, ["repo_id", "path"], "left")
    )
    path, route = F.col("path"), F.col("route")
    hidden = F.slice(F.filter("raw_signals", lambda s: s.startswith("code follows ") | s.contains("logical EOF")), 1, 1)
    obfuscation = first_obfuscations(F.col("raw_signals"))
    relevant = F.coalesce("execution", "dangerous")
    concealed = F.when(
        route.isNotNull() & F.col("dangerous").isNotNull() & ((F.size(hidden) > 0) | ((F.size(obfuscation) == 2) & F.col("execution").isNotNull())),
        finding(
            "JS-CONCEALED-EXECUTION", "high", "high", 88, "Reachable execution capability is concealed or obfuscated",
            "Executable JavaScript combines an evidenced execution route, concealment or multiple obfuscation signals, and a code or process execution capability.",
            file=path, line=relevant["line"],
            evidence=F.concat(route, F.transform(F.concat(hidden, obfuscation), lambda s: F.concat(F.lit("concealment: "), s)), F.array(F.concat(F.lit("capability: "), relevant["name"]))),
        ),
    )
    armed = F.col("dangerous").isNotNull()
    named = F.array(F.concat(F.lit("capability: "), F.col("dangerous.name"), F.lit(" at line "), F.col("dangerous.line").cast("string")))
    disguised = F.when(
        ~has_code_extension(path) & route.isNotNull(),
        finding(
            "JS-REACHABLE-DISGUISED-SOURCE", F.when(armed, "critical").otherwise("high"), "high", F.when(armed, 95).otherwise(80),
            "Executable source disguised as an asset is reachable", "A repository execution root statically imports parseable JavaScript under a non-code extension.",
            file=path, line=F.col("dangerous.line"), evidence=F.when(armed, F.concat(route, named)).otherwise(route),
        ),
    )
    per_module = facts.select("repo_id", "module_seq", F.posexplode(F.array_compact(F.array(concealed, disguised))).alias("position", "found"))
    routed = modules.select("repo_id", F.col("seq").alias("module_seq"), F.col("id").alias("module_id"), "path").join(reachable.select("repo_id", F.col("id").alias("module_id"), "route"), ["repo_id", "module_id"], "left")
    single = (
        scoped.filter(F.col("capability").isin(EXECUTION))
        .join(routed, ["repo_id", "module_id"])
        .select(
            "repo_id", "module_seq", (F.col("seq") + 2).cast("int").alias("position"),
            finding(
                F.when(F.col("capability") == "DynamicCode", "JS-DYNAMIC-EXECUTION").otherwise("JS-PROCESS-EXECUTION"), "medium", "high", 45,
                "JavaScript contains an execution capability", "This capability can execute code or a process; the call alone does not establish malicious intent.",
                file=path, line=F.col("line"),
                evidence=F.concat(F.when(F.col("in_scope") & route.isNotNull(), route).otherwise(F.array().cast("array<string>")), F.array(F.concat(F.lit("call: "), "evidence"))),
            ).alias("found"),
        )
    )
    return per_module.unionByName(single).select("repo_id", "module_seq", "position", "found.*")


def combined_chains(flow_findings: DataFrame) -> DataFrame:
    """A finding for each remote execution that shares a known trigger with a secret exfiltration: the first such one.

    flow_findings has repo_id, emit_seq and the finding's fields.
    """
    trigger = F.get(F.filter("evidence", lambda e: e.startswith("trigger:")), F.lit(0))
    known = flow_findings.withColumn("trigger", trigger).filter((F.col("trigger") != "trigger: unresolved") & F.col("trigger").isNotNull())
    secrets = known.filter("id = 'JS-SECRET-EXFILTRATION'").groupBy("repo_id", "trigger").agg(F.min_by(F.struct("file", "line"), "emit_seq").alias("secret"))
    remote = known.filter(F.col("id").isin("JS-REMOTE-CODE-EXECUTION", "JS-REMOTE-PROCESS-EXECUTION")).join(secrets, ["repo_id", "trigger"])

    def component(id: Column, file: Column, line: Column) -> Column:
        return F.concat(F.lit("component: "), id, F.lit(" at "), F.coalesce(file, F.lit("unknown")), F.lit(":"), F.coalesce(line, F.lit(0)).cast("string"))

    made = finding(
        "JS-COMBINED-ATTACK-CHAIN", "critical", "high", 99, "One execution route can exfiltrate secrets and execute remote input",
        "Separate source-to-sink findings share a file or evidenced execution trigger. This correlation does not establish a malware family.",
        file=F.col("file"), line=F.col("line"),
        evidence=F.array(component(F.col("id"), F.col("file"), F.col("line")), component(F.lit("JS-SECRET-EXFILTRATION"), F.col("secret.file"), F.col("secret.line"))),
    )
    return remote.select("repo_id", "emit_seq", made.alias("found")).select("repo_id", "emit_seq", "found.*")


def tree_changes(head: DataFrame, base: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of head that base lacks or has with another value; rows that only base has don't count."""
    old = base.select(*keys, F.struct(*values).alias("_old"))
    return head.join(old, keys, "left").filter(~F.struct(*values).eqNullSafe(F.col("_old"))).drop("_old")


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """The parts one after the other, by a column `part`."""
    out = None
    for number, part in enumerate(parts):
        part = part.withColumn("part", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return out


def numbered(rows: DataFrame, order: list[str | Column], name: str = "emit_seq") -> DataFrame:
    """rows with their place within their repository, which may lie in many partitions."""
    return places(rows, ["repo_id"], order, name)
