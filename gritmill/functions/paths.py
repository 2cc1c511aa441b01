"""Paths of repository files: normal form, language, tests, production sources, and which files an ingestion takes.

All are column expressions; null and empty paths are never tests or sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, endings and patterns that decide about a path.
TEST_FOLDERS = ["test", "tests", "__tests__", "spec", "specs", "testing", "fixtures", "__fixtures__"]
OTHER_FOLDERS = ["docs", "doc", "documentation", "examples", "example", "demo", "demos", "dist", "build", "out", "vendor", "node_modules", "coverage", ".github", ".claude", ".gemini", ".configs"]
SOURCE_ENDINGS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py", ".java"]
SKIPPED_FOLDERS = [
    ".git", ".github", "node_modules", "vendor", "dist", "build", "coverage", ".next", ".nuxt", "target", ".turbo", "out", "bin", "obj", ".cache", "tmp", "temp",
    ".idea", ".vscode", "venv", ".venv", "env", ".env", "__pycache__", ".pytest_cache", ".mypy_cache", ".tox",
]
BINARY_ENDINGS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".bmp", ".tiff", ".tif", ".psd", ".ai", ".mp4", ".mov", ".avi", ".mkv", ".webm", ".flv", ".wmv", ".mp3", ".wav", ".flac", ".ogg", ".aac", ".m4a",
    ".zip", ".tar", ".gz", ".tgz", ".7z", ".rar", ".bz2", ".xz", ".zst", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".exe", ".dmg", ".iso", ".bin", ".dll", ".so", ".dylib", ".class", ".jar", ".war", ".ear", ".pyc", ".pyo", ".pyd", ".wasm", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".map",
]
#: Special file names by language; all are of the type config.
NAMED = {
    "docker": ["dockerfile"], "yaml": ["docker-compose.yml", "docker-compose.yaml"], "makefile": ["makefile"], "cmake": ["cmakelists.txt"],
    "json": ["package.json", "package-lock.json", "composer.json"], "text": ["requirements.txt", ".env.example", ".env.sample"], "toml": ["pyproject.toml", "cargo.toml", "cargo.lock"],
    "go-mod": ["go.mod"], "go-sum": ["go.sum"], "xml": ["pom.xml"], "groovy": ["build.gradle"], "ruby": ["gemfile"],
}
#: Endings by (type, language).
ENDINGS = {
    ("source", "javascript"): [".js", ".jsx", ".mjs", ".cjs"], ("source", "typescript"): [".ts", ".tsx", ".mts", ".cts"], ("source", "python"): [".py", ".pyw"], ("source", "java"): [".java"],
    ("source", "kotlin"): [".kt", ".kts"], ("source", "scala"): [".scala"], ("source", "groovy"): [".groovy"], ("source", "go"): [".go"], ("source", "rust"): [".rs"], ("source", "c"): [".c", ".h"],
    ("source", "cpp"): [".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"], ("source", "php"): [".php", ".phtml"], ("source", "ruby"): [".rb", ".erb"], ("source", "csharp"): [".cs"], ("source", "swift"): [".swift"],
    ("script", "shell"): [".sh", ".bash", ".zsh"], ("markup", "html"): [".html", ".htm"], ("style", "css"): [".css"], ("style", "scss"): [".scss"], ("style", "sass"): [".sass"], ("style", "less"): [".less"],
    ("source", "vue"): [".vue"], ("source", "svelte"): [".svelte"], ("query", "sql"): [".sql"], ("schema", "graphql"): [".graphql", ".gql"], ("schema", "protobuf"): [".proto"],
    ("config", "json"): [".json"], ("config", "yaml"): [".yaml", ".yml"], ("config", "toml"): [".toml"], ("config", "xml"): [".xml"], ("config", "ini"): [".ini"],
    ("documentation", "markdown"): [".md", ".markdown"], ("documentation", "rst"): [".rst"], ("documentation", "text"): [".txt"],
}


#: Routes that are open by design.
PUBLIC_ROUTES = [
    r"^/health(?:/.*)?$", r"^/api/health(?:/.*)?$", r"^/api/auth/(?:login|google|register|signup|callback|csrf|token)$", r"^/api/webhooks(?:/.*)?$", r"^/api/docs(?:/.*)?$", r"^/favicon\.ico$", r"^/public(?:/.*)?$",
]


def normal_path(path: Column) -> Column:
    """Forward slashes, no leading ./, no outer white space; null becomes empty."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"^\./", ""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ending(path: Column) -> Column:
    """The extension in lower case with its dot; empty for dotfiles and names without one."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]*)$", 1))


def folders(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def git_path(path: Column) -> Column:
    """A path of a diff without its a/ or b/; /dev/null stays, empty is null."""
    p = F.trim(path)
    return F.when(path == "", None).otherwise(F.regexp_replace(p, "^[ab]/", ""))


def language_of(path: Column) -> Column:
    e = ending(normal_path(path))
    return F.when(e == ".py", "python").when(e == ".java", "java").when(e.isin(".ts", ".tsx"), "typescript").when(e.isin(".js", ".jsx", ".mjs", ".cjs"), "javascript").otherwise("unknown")


def is_test_path(path: Column) -> Column:
    """Whether a folder or the file's name marks a test; names that merely hold the letters (contest, latest) don't."""
    p = normal_path(path)
    name = F.lower(file_name(p))
    in_folder = F.exists(folders(p), lambda x: x.isin(TEST_FOLDERS) | x.rlike("^(test[-_]|spec-)"))
    named = name.rlike(r"^(test[_.]|spec\.)|_test\.py$|-test\.js$|\.(test|spec|test-[a-z0-9]+)\.[^.]+$|(test|testcase|tests)\.java$")
    return (p != "") & (in_folder | named)


def is_production_path(path: Column) -> Column:
    """Whether a path is a source file that is neither test, type declaration, bundle, configuration nor auxiliary."""
    p = normal_path(path)
    name = F.lower(file_name(p))
    other = F.exists(folders(p), lambda x: x.isin(OTHER_FOLDERS))
    built = name.rlike(r"\.d\.ts$|\.min\.(js|css)$|(rollup|vite|webpack|babel|jest|eslint)\.config\.[a-z]+$|\.eslintrc|build-browser\.js$")
    return ending(p).isin(SOURCE_ENDINGS) & ~built & ~is_test_path(path) & ~other


def file_decision(path: Column, size: Column, largest: int = 1_000_000) -> Column:
    """struct(include, reason, language, type): whether an ingestion takes a file, why not, or what it is."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    raw, name = file_name(p), F.lower(file_name(p))
    e = ending(F.lower(p))
    special = name.isin([x for names in NAMED.values() for x in names])
    known = [x for names in ENDINGS.values() for x in names]
    reason = (
        F.when(path.isNull() | (path == ""), "invalid_path")
        .when(F.exists(folders(p), lambda x: x.isin(SKIPPED_FOLDERS) | x.startswith(".")), "excluded_directory")
        .when(raw.startswith(".") & ~special, "excluded_dotfile")
        .when(name.rlike(r"\.min\.(js|css)$|\.bundle\.js$"), "excluded_minified_bundle")
        .when(e.isin(BINARY_ENDINGS), "excluded_binary_or_media")
        .when(F.coalesce(size, F.lit(0)) > largest, "file_too_large")
        .when(~special & ~e.isin(known), "unsupported_extension")
    )
    language = kind = F.lit(None).cast("string")
    for (t, lang), names in ENDINGS.items():
        language, kind = F.when(e.isin(names), lang).otherwise(language), F.when(e.isin(names), t).otherwise(kind)
    for lang, names in NAMED.items():
        language, kind = F.when(name.isin(names), lang).otherwise(language), F.when(name.isin(names), "config").otherwise(kind)
    return F.struct(reason.isNull().alias("include"), reason.alias("reason"), F.when(reason.isNull(), language).alias("language"), F.when(reason.isNull(), kind).alias("type"))


def route_path(prefix: Column, path: Column) -> Column:
    """A prefix and a path joined: one slash between parts, one in front, none at the end."""
    joined = F.regexp_replace(F.concat(F.coalesce(prefix, F.lit("")), F.lit("/"), F.coalesce(path, F.lit(""))), "/+", "/")
    bare = F.regexp_replace(joined, "/$", "")
    return F.when(bare == "", "/").when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))


def is_public_route(path: Column) -> Column:
    """Whether a route is open by design; null is not."""
    return F.coalesce(path.rlike("|".join(PUBLIC_ROUTES)), F.lit(False))
