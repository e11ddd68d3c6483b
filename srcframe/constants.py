"""Fixed values.

The tables below decide which rows an analysis keeps and how it labels them, so they
have to be exactly these for results to be right. They are plain data.
"""

# --- fixed values: languages by file-name suffix (and by whole file name) -------------
LANGUAGE_BY_KEY = {
    ".py": "Python",
    ".js": "JavaScript",
    ".ts": "TypeScript",
    ".java": "Java",
    ".c": "C",
    ".cpp": "C++",
    ".h": "C/C++ Header",
    ".cs": "C#",
    ".go": "Go",
    ".rs": "Rust",
    ".rb": "Ruby",
    ".php": "PHP",
    ".html": "HTML",
    ".css": "CSS",
    ".scss": "SCSS",
    ".md": "Markdown",
    ".json": "JSON",
    ".yml": "YAML",
    ".yaml": "YAML",
    ".sh": "Shell",
    ".bat": "Batch",
    ".ps1": "PowerShell",
    "Dockerfile": "Dockerfile",
}

# --- fixed values: full-line comment marker by language -------------------------------
HASH_COMMENT_LANGUAGES = ("Python", "Ruby", "Shell")
SLASH_COMMENT_LANGUAGES = (
    "JavaScript", "TypeScript", "Java", "C", "C++", "C#", "Go", "Rust",
)

# --- fixed values: directories never entered ------------------------------------------
DEFAULT_IGNORED_DIRS = ("node_modules", ".git", "__pycache__")

# --- fixed values: suffixes the distill job reads -------------------------------------
SOURCE_SUFFIXES = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".cs", ".go",
    ".rs", ".rb", ".php", ".swift", ".kt", ".m", ".mm", ".html", ".htm", ".css",
    ".scss", ".sass", ".md", ".rst", ".txt", ".yaml", ".yml", ".toml", ".ini", ".cfg",
    ".sh", ".bash", ".zsh", ".ps1", ".bat", ".tf", ".jsonl",
)

# --- fixed values: suffixes the pack job never reads ----------------------------------
BINARY_SUFFIXES = (
    ".npz", ".npy", ".pt", ".pth", ".bin", ".onnx", ".safetensors", ".pkl", ".joblib",
    ".data", ".dat", ".dll", ".so", ".exe", ".o", ".a", ".png", ".jpg", ".jpeg", ".gif",
    ".svg", ".ico", ".webp", ".mp3", ".mp4", ".wav", ".mov", ".avi", ".zip", ".gz",
    ".tar", ".rar", ".7z", ".pdf", ".pyc", ".pyo",
)

# --- fixed values: suffixes left out of the largest-files report ----------------------
NON_SOURCE_SUFFIXES = (
    ".pt", ".pth", ".bin", ".onnx", ".safetensors", ".npz", ".npy", ".csv", ".json",
    ".parquet", ".pkl", ".joblib", ".log", ".txt", ".png", ".jpg", ".jpeg", ".gif",
    ".svg", ".ico", ".mp4", ".mp3", ".zip", ".gz", ".tar", ".pdf",
)

# --- fixed values: important-file rules (compared in lower case) ----------------------
IMPORTANT_RULES = {
    "name": (
        "readme.md", "dockerfile", "docker-compose.yml", "package.json",
        "pyproject.toml", "requirements.txt", "pom.xml", "build.gradle", "makefile",
    ),
    "suffix": (".cfg", ".conf", ".ini", ".lock", ".yml", ".yaml"),
    "substring": (
        "main", "app", "server", "index", "config", "settings", "train", "model",
        "data", "pipeline", "utils",
    ),
}

# --- fixed values: limits and layout ---------------------------------------------------
MAX_FILES_PER_REPO = 5000
PACK_TOKEN_BUDGET = 250_000
PACK_MAX_FILE_KB = 100
TOKENS_PER_FILE_OVERHEAD = 50
LFS_SPEC_LINE = "https://git-lfs.github.com/spec/v1"
PACK_RULE = "=" * 42
DISTILL_RULE = "=" * 50
DISTILL_HEADER_LINES = 3
DISTILL_FOOTER_LINES = 2
REPORT_VERSION = "1.1"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# First line of every text this package writes; files that carry it are not inputs.
GENERATED_MARKER = "# -- generated by srcframe --"

# --- character classes, written for Java regular expressions ---------------------------
# Line breaks as str.splitlines() sees them, and white space as str.strip() sees it.
LINE_BREAKS = r"\n-\r\x1c-\x1e\x85\u2028\u2029"
WHITE_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_SPACE_CHARS = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# White space that does not end a line.
BLANKS = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
