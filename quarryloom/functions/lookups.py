"""Tables that results must agree with."""

# Symbol kinds by the names and letters that taggers use; other kinds stay as they are.
KINDS = {
    "function": ("f", "func", "function", "method"),
    "class": ("c", "class"),
    "struct": ("s", "struct"),
    "interface": ("i", "interface"),
    "type": ("t", "type", "typedef"),
    "variable": ("v", "var", "variable"),
    "constant": ("const", "constant"),
    "package": ("p", "package"),
    "field": ("m", "member", "field"),
    "enum": ("e", "enum", "enumerator"),
}

# Languages by extension, for symbol patterns.
PATTERN_LANGUAGES = {
    "go": ("go",),
    "typescript": ("ts", "tsx"),
    "javascript": ("js", "jsx", "mjs"),
    "python": ("py",),
    "rust": ("rs",),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh"),
    "ruby": ("rb",),
    "php": ("php",),
    "csharp": ("cs",),
    "kotlin": ("kt",),
    "swift": ("swift",),
}

# Languages by extension, for structural chunks.
CHUNK_LANGUAGES = {
    "go": ("go",),
    "python": ("py",),
    "javascript": ("js", "mjs", "jsx"),
    "typescript": ("ts",),
    "tsx": ("tsx",),
    "rust": ("rs",),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hxx"),
    "ruby": ("rb",),
}

# Languages by extension (case matters), for chunk records; others are "unknown".
RECORD_LANGUAGES = {
    "go": ("go",),
    "python": ("py",),
    "javascript": ("js", "jsx"),
    "typescript": ("ts", "tsx"),
    "rust": ("rs",),
    "java": ("java",),
    "c": ("c",),
    "cpp": ("cpp", "cc", "cxx", "h", "hpp"),
    "ruby": ("rb",),
    "php": ("php",),
    "swift": ("swift",),
    "kotlin": ("kt",),
    "scala": ("scala",),
    "csharp": ("cs",),
    "shell": ("sh", "bash"),
    "sql": ("sql",),
    "yaml": ("yaml", "yml"),
    "json": ("json",),
    "xml": ("xml",),
    "markdown": ("md",),
}

# Extensions of code files, for symbols (lower-cased before the test), embedding and watching.
SYMBOL_FILES = ("go", "js", "ts", "tsx", "jsx", "py", "rb", "java", "c", "cpp", "h", "hpp", "rs", "swift", "kt", "scala", "php", "cs", "sh", "bash", "zsh", "sql", "lua", "vim", "el")
EMBED_FILES = ("go", "js", "ts", "tsx", "jsx", "py", "rb", "java", "c", "cpp", "h", "hpp", "rs", "swift", "kt", "scala", "php", "cs", "sh", "sql")
WATCH_FILES = ("go", "js", "ts", "tsx", "jsx", "py", "java", "c", "cpp", "h", "hpp", "rs", "rb", "php", "swift", "kt", "scala", "cs", "md", "json", "yaml", "yml", "toml")

# Directories that scans skip besides those that begin with a dot.
IGNORED_DIRS = ("node_modules", "vendor", "dist", "build", "target", "__pycache__", ".git", ".svn", ".hg")

# Kinds that bound symbol chunks.
BOUNDARY_KINDS = ("function", "struct", "class", "type", "interface", "method")

# Words taken off the front of a matched text, in this order, before its name is read.
NAME_PREFIXES = ("func ", "function ", "def ", "class ", "interface ", "type ", "struct ", "enum ", "trait ", "const ", "let ", "var ")

# Paths in free text.
PATH_PATTERNS = (r"[\w\-./]+\.(?:go|py|js|ts|tsx|jsx|java|rb|rs|c|cpp|h|hpp|sql|sh)", r"[\w\-]+/[\w\-./]+")

# Dimensions by model; others have the default.
MODEL_DIMENSIONS = {"nomic-embed-text": 768, "mxbai-embed-large": 1024, "all-minilm": 384}
DEFAULT_DIMENSIONS = 768


def by_name(table: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """From {result: names} to {name: result}."""
    return {n: k for k, names in table.items() for n in names}
