"""Structural analyses of changed code: clones, dead code, broken interfaces, documentation, metrics, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.operators.diff import FILE, PR
from lathework.operators.paths import has_any, language

STRIP = r"^\s+|\s+$"


def strip(column: Column | str) -> Column:
    return F.regexp_replace(column, STRIP, "")


# ---------------------------------------------------------------- clones


def clone_windows(lines: DataFrame, window: int = 4, least_length: int = 10) -> DataFrame:
    """Fingerprints of ``window`` consecutive shown lines: ``key`` and the first ``line_no`` of each key in a file.

    Lines are stripped, cut at ``//`` and ``#``, and their white space squeezed;
    windows in which fewer than half of the lines have ``least_length``
    characters are left out.
    """
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip("text"), r"(?d)//.*$", ""), r"(?d)#.*$", ""), r"\s+", " ")
    ready = lines.select(*FILE, "line_no", clean.alias("clean"))
    order = Window.partitionBy("file_id").orderBy("line_no")
    frame = order.rowsBetween(0, window - 1)
    windows = ready.withColumns(
        {"n": F.count(F.lit(1)).over(frame), "long": F.sum(F.when(F.length("clean") >= least_length, 1).otherwise(0)).over(frame), "key": F.md5(F.array_join(F.collect_list("clean").over(frame), "\n"))}
    ).filter((F.col("n") == window) & (F.col("long") >= window // 2))
    return windows.groupBy(*FILE, "key").agg(F.min("line_no").alias("line_no"))


def clones(windows: DataFrame, most: int = 3) -> DataFrame:
    """Pairs of files of one pull request that share fingerprints, with the first ``most`` shared places of each pair."""
    left = windows.select(*PR, "key", F.struct("file_ord", "file_id").alias("a"), F.col("filename").alias("path_a"), F.col("line_no").alias("line_a"))
    right = windows.select(*PR, "key", F.struct("file_ord", "file_id").alias("b"), F.col("filename").alias("path_b"), F.col("line_no").alias("line_b"))
    pairs = left.join(right, [*PR, "key"]).filter("a < b")
    order = Window.partitionBy("a.file_id", "b.file_id").orderBy("line_a", "line_b", "key")
    return pairs.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).select(F.col("a.file_id").alias("file_a"), F.col("b.file_id").alias("file_b"), "path_a", "line_a", "path_b", "line_b")


# ---------------------------------------------------------------- dead code


def _imported(lines: DataFrame) -> DataFrame:
    text = strip("text")
    listed = F.coalesce(
        F.nullif(F.regexp_extract(text, r"^from\s+[\w.]+\s+import\s+(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^import\s+(.+)$", 1), F.lit(""))
    )
    part = strip(F.col("part"))
    python = (
        lines.filter("language = 'python'")
        .withColumn("part", F.explode(F.split(listed, ",")))
        .withColumn("name", strip(F.when(part.contains(" as "), F.substring_index(part, " as ", -1)).otherwise(F.substring_index(part, ".", -1))))
        .filter("NOT name LIKE '\\_%'")
    )
    braces = F.split(F.nullif(F.regexp_extract("text", r"import\s+\{([^}]+)\}", 1), F.lit("")), ",")
    single = F.array(F.nullif(F.regexp_extract("text", r"import\s+(\w+)\s+from", 1), F.lit("")))
    script = (
        lines.filter("language IN ('javascript', 'typescript')")
        .withColumn("part", F.explode(F.concat(F.coalesce(braces, F.array().cast("array<string>")), single)))
        .filter("part IS NOT NULL")
        .withColumn("name", strip(F.when(part.contains(" as "), F.substring_index(part, " as ", -1)).otherwise(part)))
    )
    return python.drop("part").unionByName(script.drop("part")).filter(F.col("name").rlike(r"^\w+$"))


def unused_imports(lines: DataFrame) -> DataFrame:
    """``file_id, line_no, name`` of imports that no other shown line of the file mentions as a word.

    A name is a run of word characters; words are compared by equality instead
    of searching every line for every name.
    """
    ready = lines.withColumn("language", language(F.col("filename")))
    names = _imported(ready).select("file_id", "line_no", "name").distinct()
    words = ready.filter("language IN ('python', 'javascript', 'typescript')").select("file_id", F.col("line_no").alias("at"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("word"))
    used = names.join(words, (names.file_id == words.file_id) & (names.name == words.word) & (names.line_no != words.at), "left_anti")
    return used


def unreachable(lines: DataFrame) -> DataFrame:
    """``file_id, line_no`` of bare exits followed by an indented line, or by any line after a blank one."""
    ready = lines.filter(language(F.col("filename")).isin("python", "javascript", "typescript", "go"))
    order = Window.partitionBy("file_id").orderBy("line_no")
    numbered = ready.select("file_id", "line_no", "text", F.row_number().over(order).alias("nth")).filter(F.col("text").rlike(r"\S"))
    follows = F.lead("text").over(order)
    gap = F.lead("nth").over(order) - F.col("nth")
    leaves = F.col("text").rlike(r"(?d)(?:return|throw|raise|panic|os\.Exit)\s*(?:\(.*\))?\s*;?\s*$")
    return numbered.withColumns({"follows": follows, "gap": gap}).filter(leaves & (F.col("follows").rlike(r"^\s+\w") | ((F.col("gap") > 1) & F.col("follows").rlike(r"^\s*\w")))).select("file_id", "line_no")


# ---------------------------------------------------------------- interfaces

#: How interfaces are declared.
ENDPOINTS = [
    r"(?i)(?:@(?:app|router|api|blueprint)\.(?:get|post|put|delete|patch|head|options))\s*\(\s*['\"]([^'\"]+)['\"]",
    r"(?:app|router)\.\s*(?:get|post|put|delete|patch|all)\s*\(\s*['\"]([^'\"]+)['\"]",
    r"(?i)(?:Route|path|url)\s*\(\s*['\"]([^'\"]+)['\"]",
]
FUNCTION = r"^(?:export\s+)?(?:async\s+)?(?:def|function|func)\s+(\w+)\s*\("
CLASS = r"^(?:export\s+)?class\s+(\w+)"
EXPORT = r"^export\s+(?:default\s+)?(?:const|let|var|function|class|type|interface)\s+(\w+)"
GO_EXPORTED = r"^func\s+(?:\([^)]+\)\s+)?([A-Z]\w+)\s*\("


def broken_interfaces(sides: DataFrame) -> DataFrame:
    """``file_id, kind, line_no, name`` of removed declarations whose name no added line has.

    Endpoints are looked for as text, exports as words after ``export``, the rest as words.
    """
    added = sides.filter("side = 'added'").groupBy("file_id").agg(F.collect_list("text").alias("added"))
    removed = sides.filter("side = 'removed'").select("file_id", "line_no", "text")
    bare = strip("text")
    kinds = [*[("endpoint_removed", F.regexp_extract("text", p, 1)) for p in ENDPOINTS], ("function_removed", F.regexp_extract(bare, FUNCTION, 1)), ("class_removed", F.regexp_extract(bare, CLASS, 1)), ("export_removed", F.regexp_extract(bare, EXPORT, 1)), ("function_removed", F.regexp_extract(bare, GO_EXPORTED, 1))]
    declared = removed.select("file_id", "line_no", F.explode(F.array(*[F.struct(F.lit(i).alias("how"), F.lit(k).alias("kind"), n.alias("name")) for i, (k, n) in enumerate(kinds)])).alias("d")).select("file_id", "line_no", "d.*")
    public = declared.filter("name <> '' AND NOT (kind IN ('function_removed', 'class_removed') AND how < 6 AND name LIKE '\\_%')")
    joined = public.join(added, "file_id", "left").withColumn("added", F.coalesce("added", F.array().cast("array<string>")))
    kept = F.expr(
        "CASE WHEN kind = 'endpoint_removed' THEN exists(added, x -> contains(x, name)) "
        "WHEN kind = 'export_removed' THEN exists(added, x -> x rlike concat('(?d)export\\\\b.*\\\\b', name, '\\\\b')) "
        "ELSE exists(added, x -> x rlike concat('\\\\b', name, '\\\\b')) END"
    )
    return joined.filter(~kept).select("file_id", "kind", "line_no", "name")


# ---------------------------------------------------------------- documentation

#: Public declarations and documentation by language.
PUBLIC = {
    "python": [(r"^(?:async\s+)?def\s+([a-zA-Z][a-zA-Z0-9_]*)\s*\(", "function"), (r"^class\s+([A-Z][a-zA-Z0-9_]*)\s*[\(:]", "class")],
    "javascript": [(r"^export\s+(?:async\s+)?function\s+(\w+)", "function"), (r"^export\s+class\s+(\w+)", "class"), (r"^export\s+(?:const|let)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\()", "function")],
    "typescript": [(r"^export\s+(?:async\s+)?function\s+(\w+)", "function"), (r"^export\s+class\s+(\w+)", "class"), (r"^export\s+interface\s+(\w+)", "interface"), (r"^export\s+type\s+(\w+)", "type")],
    "go": [(r"^func\s+(?:\([^)]+\)\s+)?([A-Z]\w*)\s*\(", "function"), (r"^type\s+([A-Z]\w*)\s+", "type")],
    "java": [(r"^\s*public\s+(?:static\s+)?(?:\w+\s+)+(\w+)\s*\(", "method"), (r"^\s*public\s+class\s+(\w+)", "class"), (r"^\s*public\s+interface\s+(\w+)", "interface")],
    "rust": [(r"^pub\s+(?:async\s+)?fn\s+(\w+)", "function"), (r"^pub\s+struct\s+(\w+)", "struct"), (r"^pub\s+enum\s+(\w+)", "enum"), (r"^pub\s+trait\s+(\w+)", "trait")],
}
DOCUMENTED = {"python": r'^\s*"""', "javascript": r"^\s*(?:/\*\*|///)", "typescript": r"^\s*(?:/\*\*|///)", "go": r"^\s*//\s*\w", "java": r"^\s*/\*\*", "rust": r"^\s*///"}
DOC_TEST_MARKS = ["test_", "_test.", ".test.", ".spec.", "tests/", "__tests__/"]


def undocumented(lines: DataFrame) -> DataFrame:
    """``file_id, line_no, kind, name``: public declarations without documentation on one of the two shown lines before."""
    ready = lines.filter(~has_any(F.lower("filename"), DOC_TEST_MARKS)).withColumn("language", language(F.col("filename")))
    order = Window.partitionBy("file_id").orderBy("line_no")
    near = ready.select("file_id", "line_no", "language", strip("text").alias("text")).withColumns({"one": F.lag("text", 1).over(order), "two": F.lag("text", 2).over(order)})
    found = F.lit(None)
    documented = F.lit(False)
    for lang, patterns in PUBLIC.items():
        for pattern, kind in patterns:
            hit = F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", pattern, 1).alias("name"))
            found = F.coalesce(found, F.when((F.col("language") == lang) & F.col("text").rlike(pattern), hit))
        doc = DOCUMENTED[lang]
        documented = documented | ((F.col("language") == lang) & (F.coalesce(F.col("one").rlike(doc), F.lit(False)) | F.coalesce(F.col("two").rlike(doc), F.lit(False))))
    return near.select("file_id", "line_no", found.alias("found"), documented.alias("documented")).filter("found IS NOT NULL AND NOT documented").select("file_id", "line_no", "found.kind", "found.name")


# ---------------------------------------------------------------- metrics

#: Branches and function heads by language.
BRANCH = {
    "python": r"\b(?:if|elif|for|while|except|and|or|assert)\b",
    "javascript": r"\b(?:if|else\s+if|for|while|do|case|catch|&&|\|\||\?\?)\b",
    "typescript": r"\b(?:if|else\s+if|for|while|do|case|catch|&&|\|\||\?\?)\b",
    "go": r"\b(?:if|for|case|select|&&|\|\|)\b",
    "java": r"\b(?:if|else\s+if|for|while|do|case|catch|&&|\|\|)\b",
    "rust": r"\b(?:if|else\s+if|for|while|loop|match|&&|\|\|)\b",
}
HEAD = {
    "python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)",
    "javascript": r"^(?:(?:async\s+)?function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))\s*\(([^)]*)\)",
    "typescript": r"^(?:(?:async\s+)?function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*(?::\s*\w+)?\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))\s*\(([^)]*)\)",
    "go": r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(([^)]*)\)",
    "java": r"^(?:public|private|protected|static|\s)+\w+\s+(\w+)\s*\(([^)]*)\)",
    "rust": r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*(?:<[^>]+>)?\s*\(([^)]*)\)",
}
DEEPER, SHALLOWER = r"[{(]\s*$|:\s*$", r"^\s*[})]"


def function_metrics(lines: DataFrame) -> DataFrame:
    """One row per function head and the shown lines up to the next: ``file_id, start_line, name, loc, cyclomatic, cognitive, depth, parameters``.

    Branches inside a line count as often as they occur; the cognitive sum weighs
    each by the nesting at its line, a count that goes up and down with line ends
    and closing marks and never below 0.
    """
    ready = lines.withColumn("language", language(F.col("filename"))).filter(F.col("language").isin(*HEAD))
    bare = strip("text")
    by_language = lambda make: F.coalesce(*[F.when(F.col("language") == lang, make(lang)) for lang in HEAD])
    is_head = by_language(lambda lang: bare.rlike(HEAD[lang]))
    name = by_language(lambda lang: F.regexp_extract(bare, HEAD[lang], 1) if lang not in ("javascript", "typescript") else F.concat(F.regexp_extract(bare, HEAD[lang], 1), F.regexp_extract(bare, HEAD[lang], 2)))
    given = by_language(lambda lang: F.regexp_extract(bare, HEAD[lang], 3 if lang in ("javascript", "typescript") else 2))
    branches = by_language(lambda lang: F.regexp_count("text", F.lit(BRANCH[lang])))
    step = ready.select("file_id", "line_no", "language", "text", is_head.alias("is_head"), name.alias("name"), given.alias("given"), branches.alias("branches"), bare.rlike(DEEPER).alias("deeper"), bare.rlike(SHALLOWER).alias("shallower"))
    blocks = step.withColumn("block", F.sum(F.when(F.col("is_head"), 1).otherwise(0)).over(Window.partitionBy("file_id").orderBy("line_no"))).filter("block > 0")
    grouped = blocks.groupBy("file_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "branches", "deeper", "shallower", "name", "given"))).alias("rows"), (F.sum("branches") + 1).cast("int").alias("cyclomatic"), F.count(F.lit(1)).alias("loc")
    )
    fold = F.expr(
        "aggregate(rows, struct(0 AS level, 0 AS total, 0 AS deepest), (a, x) -> struct("
        "  greatest(0, a.level + int(x.deeper) - int(x.shallower)) AS level,"
        "  a.total + x.branches * (1 + greatest(0, a.level + int(x.deeper) - int(x.shallower))) AS total,"
        "  greatest(a.deepest, a.level + int(x.deeper)) AS deepest))"
    )
    parameters = F.size(F.filter(F.split(F.col("rows")[0]["given"], ","), lambda p: ~strip(p).isin("", "self", "cls")))
    return grouped.withColumn("fold", fold).select(
        "file_id", F.col("rows")[0]["line_no"].alias("start_line"), F.col("rows")[0]["name"].alias("name"), "loc", "cyclomatic", F.col("fold.total").alias("cognitive"), F.col("fold.deepest").alias("depth"), parameters.alias("parameters")
    )


# ---------------------------------------------------------------- licences and dependencies

#: Licence texts; the first that fits counts.
LICENCES = [
    ("GPL-3.0", r"(?id)GNU\s+General\s+Public\s+License.*(?:version\s+)?3"), ("GPL-2.0", r"(?id)GNU\s+General\s+Public\s+License.*(?:version\s+)?2"), ("AGPL-3.0", r"(?i)GNU\s+Affero\s+General\s+Public\s+License"),
    ("LGPL-3.0", r"(?id)GNU\s+Lesser\s+General\s+Public\s+License.*3"), ("LGPL-2.1", r"(?id)GNU\s+Lesser\s+General\s+Public\s+License.*2\.1"), ("MPL-2.0", r"(?id)Mozilla\s+Public\s+License.*2"),
    ("Apache-2.0", r"(?id)Apache\s+License.*2"), ("MIT", r"(?i)\bMIT\s+License\b"), ("BSD-3-Clause", r"(?i)BSD\s+3-Clause"), ("BSD-2-Clause", r"(?i)BSD\s+2-Clause"), ("ISC", r"(?i)\bISC\s+License\b"),
    ("SSPL-1.0", r"(?i)Server\s+Side\s+Public\s+License"), ("BUSL-1.1", r"(?i)Business\s+Source\s+License"), ("Elastic-2.0", r"(?i)Elastic\s+License\s+2"),
]

#: What a licence name contains, in the order the classes are tried.
LICENCE_CLASSES = [
    ("copyleft", "high", ["GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "EUPL-1.1", "EUPL-1.2", "OSL-3.0", "SSPL-1.0", "BUSL-1.1"]),
    ("commercial_restriction", "high", ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "Elastic-2.0"]),
    ("permissive", "info", ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Unlicense", "CC0-1.0", "WTFPL", "Zlib", "PSF-2.0", "Python-2.0"]),
]

#: Packages that are worth a warning, and manifests by ecosystem.
RISKY = ["event-stream", "ua-parser-js", "coa", "rc", "colors", "faker", "node-ipc", "request", "moment", "lodash", "pycrypto", "python-jwt", "django-hierarchical", "urllib3", "github.com/dgrijalva/jwt-go"]
COMPROMISED = ["event-stream", "ua-parser-js", "coa", "rc"]
MANIFESTS = {
    "package.json": "npm", "package-lock.json": "npm", "yarn.lock": "npm", "pnpm-lock.yaml": "npm", "requirements.txt": "pip", "Pipfile": "pip", "pyproject.toml": "pip", "setup.py": "pip", "setup.cfg": "pip",
    "Gemfile": "gem", "go.mod": "go", "Cargo.toml": "cargo", "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "composer.json": "composer", "pubspec.yaml": "pub",
}


def licence_of(text: Column) -> Column:
    """The first licence whose name the text has, else null."""
    return F.coalesce(*[F.when(text.rlike(p), name) for name, p in LICENCES])


def licence_class(name: Column) -> Column:
    """Class and severity of a licence name by the parts it contains."""
    upper = F.upper(strip(name))
    chain = F.when(F.lit(False), F.struct(F.lit("").alias("risk"), F.lit("").alias("severity")))
    for risk, severity, parts in LICENCE_CLASSES:
        chain = chain.when(has_any(upper, [p.upper() for p in parts]), F.struct(F.lit(risk).alias("risk"), F.lit(severity).alias("severity")))
    return chain.otherwise(F.struct(F.lit("unknown").alias("risk"), F.lit("medium").alias("severity")))


def dependency_findings(lines: DataFrame) -> DataFrame:
    """``file_id, line_no, kind, package, severity``: risky packages in manifests (found as part of a line), npm versions that are open or come from elsewhere."""
    base = F.substring_index("filename", "/", -1)
    ecosystem = F.element_at(F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv]), base)
    ready = lines.withColumn("ecosystem", ecosystem).filter("ecosystem IS NOT NULL").withColumn("bare", strip("text"))
    row = lambda kind, package, severity: F.struct(F.lit(kind).alias("kind"), package.alias("package"), F.lit(severity).alias("severity"))
    risky = [F.when(F.lower("bare").contains(p.lower()), row("risky", F.lit(p), "critical" if p in COMPROMISED else "high")) for p in RISKY]
    pair = r'"([^"]+)":\s*"([^"]+)"'
    name, version = F.regexp_extract("bare", pair, 1), F.regexp_extract("bare", pair, 2)
    npm = (F.col("ecosystem") == "npm") & (name != "")
    open_version = F.when(npm & version.isin("*", "latest"), row("unpinned", name, "high"))
    elsewhere = F.when(npm & version.rlike(r"^(?:git|http|file:|github:)"), row("risky", name, "medium"))
    pip = F.regexp_extract("bare", r"^([\w-]+)\s*$", 1)
    loose = F.when((F.col("ecosystem") == "pip") & F.col("filename").rlike(r"\.(?:txt|cfg)$") & (pip != ""), row("unpinned", pip, "medium"))
    return ready.select("file_id", "line_no", F.explode(F.array_compact(F.array(*risky, open_version, elsewhere, loose))).alias("f")).select("file_id", "line_no", "f.*")


def many_dependencies(lines: DataFrame, most: int = 5) -> DataFrame:
    """Pull requests that show more than ``most`` dependencies in npm manifests and pip lists: ``repo_full_name, pr_number, head_sha, dependencies``."""
    base = F.substring_index("filename", "/", -1)
    ecosystem = F.element_at(F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv]), base)
    npm = (ecosystem == "npm") & strip("text").rlike(r'"([^"]+)":\s*"([^"]+)"')
    pip = (ecosystem == "pip") & F.col("filename").rlike(r"\.(?:txt|cfg)$") & strip("text").rlike(r"(?d)^([\w-]+)\s*([><=!~]+.+)?$")
    return lines.filter(npm | pip).groupBy(*PR).agg(F.count(F.lit(1)).alias("dependencies")).filter(F.col("dependencies") > most)


#: Manifests with a licence field, its pattern, and the groups that may hold the name.
LICENCE_FIELDS = [
    ("package.json", r"(?i)\"license\"\s*:\s*\"([^\"]+)\"", (1,)),
    ("cargo.toml", r"(?i)license\s*=\s*\"([^\"]+)\"", (1,)),
    ("pyproject.toml", r"(?i)license\s*=\s*(?:\"([^\"]+)\"|\{.*text\s*=\s*\"([^\"]+)\")", (1, 2)),
]


def licence_findings(lines: DataFrame) -> DataFrame:
    """``file_id, line_no, licence, risk, severity``: licence files (at their first line) and licence fields that are not permissive.

    A licence file's shown lines are read as one text, which is as long as its
    patch.
    """
    lower = F.lower("filename")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    texts = lines.filter(has_any(lower, ["license", "copying"])).groupBy("file_id").agg(F.min("line_no").alias("line_no"), whole.alias("text"))
    named = texts.select("file_id", "line_no", licence_of(F.col("text")).alias("licence"))
    for name, pattern, groups in LICENCE_FIELDS:
        field = F.coalesce(*[F.nullif(F.regexp_extract("text", pattern, g), F.lit("")) for g in groups])
        named = named.unionByName(lines.filter(lower.endswith(name)).select("file_id", "line_no", field.alias("licence")))
    known = named.filter("licence IS NOT NULL").withColumn("c", licence_class(F.col("licence")))
    return known.filter("c.risk <> 'permissive'").select("file_id", "line_no", "licence", "c.risk", "c.severity")
