"""Dependency manifests and lockfiles: each file is one row of text, each dependency one row of the result."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.advisories import bare_version, package_name
from ..operators.rounds import settled
from ..shipping import ship

SCHEMA = "path string, ecosystem string, package_name string, version string, version_specifier string, dependency_type string, is_direct boolean, depth int, parent_package string"
#: Sections that declare dependencies, in the order in which a name of several sections takes its type.
SECTIONS = {"devDependencies": "development", "optionalDependencies": "optional", "peerDependencies": "peer", "dependencies": "direct"}
_MODULES = re.compile(r"(?:^|/)node_modules/")


def kind_of(path: Column) -> Column:
    """Which reader a file needs, by its name; null for none. Manifests of installed packages aren't read."""
    p = F.lower(path)
    npm, pypi = ~p.contains("node_modules"), ~p.contains("site-packages")
    return (
        F.when(npm & p.endswith("package-lock.json"), "lock").when(npm & p.endswith("package.json"), "package").when(pypi & p.rlike(r"requirements(-dev)?\.txt$"), "requirements")
        .when(p.endswith("pom.xml"), "maven").when(p.rlike(r"\.gradle(\.kts)?$"), "gradle")
    )


def lock_key(key: str) -> tuple[str, str | None, int]:
    """Name, enclosing package and nesting of a key such as node_modules/a/node_modules/b."""
    parts = [p for p in _MODULES.split(key.replace("\\", "/").lstrip("/")) if p]
    return (parts[-1], parts[-2] if len(parts) > 1 else None, len(parts)) if parts else (key, None, 1)


def _table(value) -> dict:
    return value if isinstance(value, dict) else {}


def declared(manifest: dict) -> dict[str, tuple[str, str]]:
    """Type and specifier of each package that a manifest declares."""
    out: dict[str, tuple[str, str]] = {}
    for section, kind in SECTIONS.items():
        for name, spec in _table(manifest.get(section)).items():
            if name.strip():
                out.setdefault(name.strip(), (kind, str(spec or "*")))
    return out


def declaration_order(manifest: dict) -> list[str]:
    names: dict[str, None] = {}
    for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        names |= {n.strip(): None for n in _table(manifest.get(section)) if n.strip()}
    return list(names)


def distances(needs: dict[str, list[str]], roots: list[str]) -> dict[str, tuple[int, str | None]]:
    """Least number of steps from the roots (which have 1) and the package that a shortest way comes from; ways are
    tried in the order of names, level by level."""
    out: dict[str, tuple[int, str | None]] = {r: (1, None) for r in roots}
    level = list(out)
    while level:
        following = []
        for name in level:
            for other in needs.get(name, ()):
                if other not in out:
                    out[other] = (out[name][0] + 1, name)
                    following.append(other)
        level = following
    return out


def _flag(entry: dict, flags=("dev", "optional", "peer")) -> str:
    names = {"dev": "development", "optional": "optional", "peer": "peer"}
    return next((names[f] for f in flags if entry.get(f)), "transitive")


def lock_rows(text: str | None, manifest: dict | None = None) -> list[tuple]:
    """(package, version, specifier, type, is_direct, depth, parent) of a package-lock.json of version 1, 2 or 3; nothing
    for empty, damaged or other JSON. Rows of one name, version and parent count once."""
    try:
        lock = json.loads(text) if text and text.strip() else {}
    except (ValueError, RecursionError):
        return []
    if not isinstance(lock, dict):
        return []
    packages = {k: v for k, v in _table(lock.get("packages")).items()}
    root = _table(packages.get("")) or manifest or {}
    direct = declared(root)
    rows: dict[tuple, tuple] = {}

    def add(name, version, spec, kind, is_direct, depth, parent):
        rows.setdefault((name, version, parent or ""), (name, version, spec, kind, is_direct, depth, parent))

    if packages:
        entries = [(lock_key(k), v) for k, v in packages.items() if k and isinstance(v, dict)]
        needs: dict[str, list[str]] = {}
        for (name, _, _), entry in entries:
            needs.setdefault(entry.get("name") or name, []).extend([*_table(entry.get("dependencies")), *_table(entry.get("optionalDependencies"))])
        near = distances(needs, declaration_order(root))
        for (key_name, outer, nesting), entry in entries:
            name = entry.get("name") or key_name
            version = str(entry.get("version") or "0.0.0").strip()
            if nesting == 1 and name in direct:
                kind, spec = direct[name]
                add(name, version, spec, kind, True, 1, None)
            elif outer:
                add(name, version, None, _flag(entry), False, nesting, outer)
            else:
                depth, parent = near.get(name, (2, None))
                add(name, version, None, _flag(entry), False, depth, parent)
        return list(rows.values())

    # depth first in the order of the file, without recursion
    levels = [(iter(_table(lock.get("dependencies")).items()), None, 1)]
    while levels:
        entries, parent, depth = levels[-1]
        name, entry = next(entries, (None, None))
        if name is None:
            levels.pop()
        elif name and isinstance(entry, dict):
            version = str(entry.get("version") or "0.0.0").strip()
            if depth == 1 and name in direct:
                kind, spec = direct[name]
                if entry.get("optional") and kind in ("peer", "direct"):
                    kind, spec = "optional", None
                add(name, version, spec, kind, True, 1, None)
            else:
                add(name, version, None, _flag(entry, ("dev", "optional")), False, depth, parent)
            levels.append((iter(_table(entry.get("dependencies")).items()), name, depth + 1))
    return list(rows.values())


def read_locks(files: DataFrame) -> DataFrame:
    """Dependencies of lockfiles; ``files`` has path, content and manifest (the text of the package.json beside it, or
    null). One pass without a shuffle: a lockfile's graph is in its own text."""

    def run(batches):
        for batch in batches:
            out = []
            for path, content, manifest in batch.itertuples(index=False):
                try:
                    own = json.loads(manifest) if manifest else {}
                except (ValueError, RecursionError):
                    own = {}
                out += [(path, "npm", *row) for row in lock_rows(content, _table(own))]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    ship(files.sparkSession)
    return files.select("path", "content", "manifest").mapInPandas(run, SCHEMA)


def _direct(rows: DataFrame, ecosystem: str, name: Column, specifier: Column, kind: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        "path", F.lit(ecosystem).alias("ecosystem"), name.alias("package_name"), bare_version(specifier).alias("version"), specifier.alias("version_specifier"),
        kind.alias("dependency_type"), F.lit(True).alias("is_direct"), F.lit(1).alias("depth"), none.alias("parent_package"),
    )


def read_packages(files: DataFrame) -> DataFrame:
    """Declared dependencies of package.json files, a row for each section that has a name; damaged JSON gives none."""
    maps = ", ".join(f"{s}: map<string, string>" for s in SECTIONS)
    parsed = files.select("path", F.from_json("content", f"struct<{maps}>").alias("j"))

    def entries(section: str, kind: str) -> Column:
        pairs = F.map_entries(F.coalesce(F.col(f"j.{section}"), F.create_map().cast("map<string,string>")))
        spec = lambda e: F.when(F.coalesce(e["value"], F.lit("")) == "", "*").otherwise(e["value"])
        return F.transform(pairs, lambda e: F.struct(F.trim(e["key"]).alias("name"), spec(e).alias("spec"), F.lit(kind).alias("kind")))

    rows = parsed.select("path", F.explode(F.flatten(F.array(*[entries(*x) for x in SECTIONS.items()]))).alias("d")).where("d.name <> ''")
    return _direct(rows, "npm", F.col("d.name"), F.col("d.spec"), F.col("d.kind"))


def read_requirements(files: DataFrame) -> DataFrame:
    """Requirements of requirements.txt files; comments, -r and -i lines and lines of other forms are skipped."""
    pattern = r"^([a-zA-Z0-9_\-.]+)\s*([><=!~^].*)?$"
    lines = files.select("path", F.explode(F.split("content", "\n")).alias("raw")).select("path", F.trim(F.regexp_replace("raw", r"[\r\t]", " ")).alias("line"))
    rows = lines.where((F.col("line") != "") & ~F.col("line").rlike("^(#|-r|-i)") & F.col("line").rlike(pattern))
    spec = F.trim(F.regexp_extract("line", pattern, 2))
    return _direct(rows, "pypi", F.regexp_extract("line", pattern, 1), F.when(spec == "", "*").otherwise(spec), F.lit("direct"))


def read_maven(files: DataFrame) -> DataFrame:
    """Dependencies of pom.xml files: each <dependency> block with a group and an artifact."""
    blocks = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("b"))
    tag = lambda name: F.trim(F.regexp_extract("b", rf"(?s)<{name}>(.*?)</{name}>", 1))
    rows = blocks.where((tag("groupId") != "") & (tag("artifactId") != ""))
    version = F.when(tag("version") == "", "*").otherwise(tag("version"))
    return _direct(rows, "maven", F.concat(tag("groupId"), F.lit(":"), tag("artifactId")), version, F.when(tag("scope") == "test", "test").otherwise("direct"))


def read_gradle(files: DataFrame) -> DataFrame:
    pattern = r"(?:implementation|api|testImplementation)\s+['\"]([^'\"]+:[^'\"]+:[^'\"]+)['\"]"
    rows = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), 1)).alias("c"))
    return _direct(rows, "gradle", F.regexp_replace("c", ":[^:]*$", ""), F.regexp_extract("c", "([^:]*)$", 1), F.lit("direct"))


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies of a snapshot's files (path, content), with normalized_name.

    A folder's package.json files count only where none of its lockfiles gives a dependency; a lockfile takes its
    specifiers from the package.json beside it if it has none itself. Versions are specifiers without their operators.
    Rows of one ecosystem, name, version, parent and file count once: the one with the least depth, then the type that
    comes first of direct, development, peer, optional and others. Files of other names, of installed packages, null
    paths and null contents give nothing; of several rows of one path all are read. An empty table gives an empty result."""
    path = F.replace("path", F.lit("\\"), F.lit("/"))
    f = files.select(path.alias("path"), "content").where("content is not null")
    f = f.select("path", "content", kind_of(F.col("path")).alias("kind"), F.regexp_replace("path", "[^/]*$", "").alias("folder")).where("kind is not null")
    packages = f.where("kind = 'package'")
    beside = packages.where(F.col("path") == F.concat("folder", F.lit("package.json"))).groupBy("folder").agg(F.min("content").alias("manifest"))
    locked = settled(read_locks(f.where("kind = 'lock'").join(beside, "folder", "left")))  # read twice below
    full = locked.select(F.regexp_replace("path", "[^/]*$", "").alias("folder")).distinct()
    rows = locked.unionByName(read_packages(packages.join(full, "folder", "left_anti")))
    for kind, read in (("requirements", read_requirements), ("maven", read_maven), ("gradle", read_gradle)):
        rows = rows.unionByName(read(f.where(F.col("kind") == kind)))
    rows = rows.withColumn("normalized_name", package_name(F.col("ecosystem"), F.col("package_name")))
    keys = ["ecosystem", "package_name", "version", "parent_package", "path"]
    rest = [c for c in rows.columns if c not in keys]
    order = F.array_position(F.array(*[F.lit(t) for t in ("direct", "development", "peer", "optional")]), F.col("dependency_type"))
    first = F.struct("depth", F.when(order == 0, 9).otherwise(order), F.coalesce("version_specifier", F.lit("")))
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), first).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
