"""File rules: kinds, languages, exclusions, ids and safe names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names and extensions by kind.
CODE = (".py", ".pyx", ".pyi", ".ipynb", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".java", ".scala", ".kt", ".groovy", ".clj", ".c", ".cpp", ".cxx", ".cc", ".h", ".hpp", ".hxx", ".cs", ".vb", ".fs", ".php", ".rb", ".go", ".rs", ".swift", ".sh", ".bash", ".zsh", ".fish", ".ps1", ".bat", ".cmd", ".sql", ".r", ".m", ".pl", ".lua", ".dart", ".hs", ".elm", ".ml", ".f90", ".f95", ".f03", ".asm", ".s", ".vim", ".el")
LICENSES = ("license", "licence", "copying", "copyright", "legal", "notice", "authors", "contributors", "credits", "acknowledgment")
BUILDS = ("Makefile", "CMakeLists.txt", "build.gradle", "pom.xml", "package.json", "requirements.txt")
DATA = (".csv", ".json", ".xml", ".sql", ".db", ".sqlite")
CONFIGS = (".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf")
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz", ".gz", ".bz2", ".xz", ".7z", ".rar", ".zst")
IMPORTANT = ("readme", "license", "licence", "contributing", "changelog", "makefile", "dockerfile", "setup.py", "requirements.txt", "package.json", "pom.xml")
EXCLUDED_DIRS = (
    ".git", ".svn", ".hg", ".bzr", "node_modules", "bower_components", ".yarn", ".pnp", ".parcel-cache",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".tox", ".coverage", ".hypothesis",
    ".venv", "venv", "env", ".env", ".virtualenv", ".conda", ".ipynb_checkpoints",
    "build", "dist", "out", "output", "target", "bin", "obj", ".gradle", ".idea", ".vscode", ".settings",
    ".cache", "logs", "log", ".next", ".nuxt", ".expo", ".android", ".ios", ".history", ".npm", ".jspm",
    ".c9", ".cloud9", ".sublime-*", ".nyc_output", ".mocha", ".istanbul", ".jupyter",
    ".Rproj.user", ".Rhistory", ".RData", ".Ruserdata", ".snapshots", ".metadata", ".factorypath",
    ".tmp", ".bak", ".old", ".orig", ".save", ".crash", ".pid", ".seed", ".pid.lock",
    ".yarn-cache", ".yarnrc", ".pnp.*", ".eslintcache", ".pyre", ".pytype",
)
EXCLUDED_FILES = (".DS_Store", "Thumbs.db", "desktop.ini", ".Trash-*", ".AppleDouble", ".LSOverride", "*.log", "*.tmp", "*.swp", "*.swo")
BINARIES = (".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".class", ".jar", ".pyc", ".png", ".jpg", ".jpeg", ".gif", ".mp4", ".pdf")
LANGUAGES = {".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".r": "r", ".sh": "shell", ".sql": "sql"}
RESERVED = ("con", "prn", "aux", "nul", "com1", "com2", "com3", "lpt1", "lpt2", "lpt3")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def parent(path: Column | str) -> Column:
    """Path of the directory that holds it; empty at the root."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def is_documentation(path: Column | str) -> Column:
    return extension(path) == ".md"


def is_code(path: Column | str) -> Column:
    return extension(path).isin(*CODE)


def is_license(path: Column | str) -> Column:
    return F.lower(name(path)).rlike("|".join(LICENSES))


def is_docker(path: Column | str) -> Column:
    low = F.lower(name(path))
    return (low == ".dockerignore") | (low.startswith("docker") & (low != "docker"))


def is_build(path: Column | str) -> Column:
    return name(path).isin(*BUILDS)


def is_data(path: Column | str) -> Column:
    return extension(path).isin(*DATA)


def is_config(path: Column | str) -> Column:
    return extension(path).isin(*CONFIGS)


def is_config_or_build(path: Column | str) -> Column:
    return is_config(path) | is_build(path) | _c(path).rlike(r"(^|/)(\.github|\.circleci|\.gitlab|\.idea|\.vscode)(/|$)")


def is_important(path: Column | str) -> Column:
    """A name of the list, with or without its extension, or one that says readme or license."""
    low = F.lower(name(path))
    return low.isin(*IMPORTANT) | F.regexp_replace(low, r"(?<=.)\.[^.]*$", "").isin(*IMPORTANT) | low.rlike("readme|licen[sc]e")


def is_archive(path: Column | str) -> Column:
    low, out = F.lower(_c(path)), F.lit(False)
    for suffix in ARCHIVES:
        out = out | low.endswith(suffix)
    return out


def category(path: Column | str) -> Column:
    """The first kind that fits: license, documentation, docker, build, code, data, config; else null."""
    return (
        F.when(is_license(path), "license")
        .when(is_documentation(path), "documentation")
        .when(is_docker(path), "docker")
        .when(is_build(path), "build")
        .when(is_code(path), "code")
        .when(is_data(path), "data")
        .when(is_config(path), "config")
        .when(is_config_or_build(path), "documentation")
    )


def _matches(x: Column, names: tuple[str, ...]) -> Column:
    """Whether a name is one of the list, as written; a star stands for anything."""
    globs = [n.replace(".", r"\.").replace("*", ".*") for n in names if "*" in n]
    return x.isin(*(n for n in names if "*" not in n)) | x.rlike(f"^({'|'.join(globs)})$")


def excluded(path: Column | str) -> Column:
    """Whether scans skip the file: a directory on its way or its own name is excluded."""
    return F.exists(F.split(parent(path), "/"), lambda p: _matches(p, EXCLUDED_DIRS)) | _matches(name(path), EXCLUDED_FILES)


def skip_reason(path: Column | str, size: Column | str) -> Column:
    """Why a file is not read: binary, large data, too large; null if it is."""
    size = _c(size)
    return (
        F.when(extension(path).isin(*BINARIES), "binary").when(is_data(path) & (size > 10 * 1024 * 1024), "large data").when(size > 50 * 1024 * 1024, "too large").otherwise(F.lit(None).cast("string"))
    )


def language(path: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def graph_kind(path: Column | str) -> Column:
    """Node kind of a file in the artifact graph; ``.txt`` is documentation."""
    low = F.lower(name(path))
    return (
        F.when(low.isin("requirements.txt", "package.json", "pom.xml", "build.gradle", "setup.py", "pyproject.toml"), "DependencyFile")
        .when(extension(path).isin(".md", ".rst", ".txt"), "Documentation")
        .when(is_code(path), "CodeFile")
        .when(is_dataset(path), "Dataset")
        .otherwise("File")
    )


def is_dataset(path: Column | str) -> Column:
    low = F.lower(_c(path))
    return is_data(path) | low.rlike(r"(^|/)(data|dataset|datasets)/")


def is_test(path: Column | str) -> Column:
    low = F.lower(name(path))
    return low.startswith("test") | low.endswith("_test.py") | F.lower(_c(path)).rlike(r"(^|/)tests?/")


def documentation_type(path: Column | str) -> Column:
    """What a documentation file is for, by the first word that its path holds."""
    low = F.lower(_c(path))
    return F.when(low.contains("readme"), "readme").when(low.contains("license"), "license").when(low.contains("changelog"), "changelog").when(low.rlike("api|reference"), "api").otherwise("general")


# Kinds of dependency files by a part of their path, the first that fits.
DEPENDENCY_FILES = {"requirements": "python_requirements", "package.json": "npm_package", "pom.xml": "maven_pom", "build.gradle": "gradle_build", "setup.py": "python_setup", "pyproject.toml": "python_pyproject"}


def dependency_type(path: Column | str) -> Column:
    low = F.lower(_c(path))
    return F.coalesce(*(F.when(low.contains(part), kind) for part, kind in DEPENDENCY_FILES.items()), F.lit("unknown"))


def guideline_parts(path: Column | str) -> tuple[Column, Column, Column]:
    """(id, name, year) of a guideline file ``<id>_<name>_<year>.md``; names may have several words."""
    pattern = r"^([0-9]+)_([A-Za-z_]+?)_([0-9]{4})\.md$"
    file = name(path)
    year = F.regexp_extract(file, pattern, 3)
    return F.regexp_extract(file, pattern, 1), F.upper(F.replace(F.regexp_extract(file, pattern, 2), F.lit("_"), F.lit(" "))), F.when(year != "", year.cast("int"))


def safe_name(file: Column | str) -> Column:
    """ASCII name without illegal characters, reserved words or trailing dots, at most 200 characters."""
    plain = F.regexp_replace(_c(file), r"[^\x20-\x7E]", "")
    plain = F.regexp_replace(plain, r'[<>:"/\\|?*]', "_")
    plain = F.regexp_replace(plain, r"^[. ]+|[. ]+$", "")
    plain = F.when(plain == "", "unnamed").when(F.lower(plain).isin(*RESERVED), F.concat(F.lit("_"), plain)).otherwise(plain)
    return F.substring(plain, 1, 200)
