"""Word lists, lookup tables, globs, limits and message formats.

Results only match when these agree with the established definitions, so they
are kept verbatim, together, in their natural order.  Everything here has a
constant size, which is what makes it safe to embed in a plan as literals.
"""

# -- fixed values: extension -> grammar language -----------------------------
GRAMMAR_LANGUAGE = {
    ".py": "python",
    ".pyw": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "javascript",
    ".tsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".java": "java",
    ".go": "go",
    ".php": "php",
    ".inc": "php",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".hpp": "cpp",
    ".cc": "cpp",
    ".cs": "c_sharp",
    ".rb": "ruby",
    ".rs": "rust",
    ".swift": "swift",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".xml": "xml",
    ".md": "markdown",
    ".sql": "sql",
}
DEFAULT_LANGUAGE = "python"

# -- fixed values: extensions whose files become components -------------------
COMPONENT_EXTENSIONS = [
    ".py", ".pyw", ".pyi",
    ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs",
    ".java", ".go", ".php", ".c", ".h", ".cpp", ".hpp", ".cc", ".cs", ".rb", ".rs",
    ".html", ".htm", ".css", ".json", ".yaml", ".yml", ".sh", ".bash",
    ".md", ".markdown", ".swift", ".kt", ".kts",
]

# -- fixed values: extension -> display language ------------------------------
DISPLAY_LANGUAGE = {
    ".py": "Python",
    ".js": "JavaScript",
    ".jsx": "JavaScript (React)",
    ".ts": "TypeScript",
    ".tsx": "TypeScript (React)",
    ".java": "Java",
    ".go": "Go",
    ".php": "PHP",
    ".inc": "PHP",
    ".rb": "Ruby",
    ".c": "C",
    ".cpp": "C++",
    ".h": "C/C++ Header",
    ".cs": "C#",
    ".html": "HTML",
    ".css": "CSS",
    ".json": "JSON",
    ".xml": "XML",
    ".yml": "YAML",
    ".yaml": "YAML",
    ".md": "Markdown",
    ".sql": "SQL",
}
UNKNOWN_LANGUAGE = "Unknown"

# -- fixed values: entry-point stems and per-extension content marks ----------
ENTRY_STEMS = ["index", "main", "app", "server", "application", "program", "start", "init", "bootstrap"]
ENTRY_MARKS = {
    ".py": ["if __name__ == '__main__'", 'if __name__ == "__main__"'],
    ".js": ["exports.handler", "addEventListener('load'"],
    ".php": ["function rcmail"],
    ".java": ["public static void main"],
    ".go": ["func main()"],
}
PHP_OPEN_TAG = "<?php"
PHP_OPEN_TAG_WINDOW = 100

# -- fixed values: scan rules --------------------------------------------------
TEST_WORD = "test"
IGNORE_NAMES = [
    ".git", ".github", "__pycache__", ".pytest_cache", ".vscode", ".idea", "node_modules", "venv", "env",
    "*.pyc", "*.pyo", "*.pyd", "*.so", "*.dylib", "*.dll", "*.class", "*.jar", "*.war", "*.ear", "*.zip",
    ".tar.gz", "*.log", ".DS_Store", "Thumbs.db",
]
# Directory and file globs that carry a slash; only applied with strict_globs.
STRICT_IGNORE_DIRS = [
    "node_modules", ".git", "venv", ".venv", "__pycache__", "dist", "build", ".idea", ".vscode",
    "tests", "test", "vendor",
]
STRICT_IGNORE_FILES = [
    "*.min.js", "*.min.css", "jquery*.js", "bootstrap*.js", "bootstrap*.css", "*.png", "*.jpg", "*.jpeg", "*.gif",
    "*.ico", "*.svg", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.map", "*.pb", "*.pyc", "*.pyo", "*.pyd",
    "*.so", "*.dylib", "*.dll", "*.exe", "*.bin", "*.obj", "*.o", "*.a", "*.lib", "*.out", "*.class",
    "*.jar", "*.war", "*.ear", "*.zip", "*.tar", "*.tar.gz", "*.tar.bz2", "*.rar", "*.7z",
]
LANGUAGE_SCAN_SKIP = [".git", "node_modules", "__pycache__", "venv", ".idea", "build", "dist"]
REPO_INDICATORS = [
    ".git", ".gitignore", "package.json", "requirements.txt", "composer.json", "Gemfile", "pom.xml", "build.gradle",
    "Cargo.toml", "go.mod", "CMakeLists.txt", ".sln", "Makefile", "README.md", "setup.py", "index.php", "index.html",
    "main.py", "app.py", "src", "lib", "app", "test", "tests", "docs",
]
KEY_DIRECTORY_WORDS = [
    "src", "lib", "core", "api", "controller", "model", "view", "service",
    "util", "common", "main", "app", "module", "component",
]

# -- fixed values: selection word lists ----------------------------------------
PRIORITY_WORDS = [
    "auth", "login", "user", "admin", "password", "hash", "crypt", "token", "jwt", "oauth", "permission", "role",
    "security", "key", "secret", "credential", "session", "cookie", "api", "controller", "upload", "file", "sql",
    "query", "database", "model", "payment", "validator", "request", "response", "config", "settings",
]
SECURITY_WORDS = [
    "auth", "security", "login", "password", "crypt", "hash", "permission", "access", "token", "jwt", "oauth",
    "session", "cookie", "credential", "secret", "key", "cert", "config", "env", "setting", "admin", "root",
    "sudo", "superuser",
]
DATABASE_WORDS = ["db", "database", "model", "schema", "migration", "sql", "query", "repository"]
TIER_WORDS = {
    "security": ["security", "auth", "login", "user", "password", "credential"],
    "model": ["model", "database", "schema", "repository"],
    "api": ["api", "controller", "service", "route"],
}
EXTENSION_BOUNDARIES = [".php", ".py", ".js"]

# -- fixed values: chunking and token budgets ----------------------------------
CHUNK_CHARS, CHUNK_OVERLAP = 1000, 200
LARGE_CHUNK_CHARS, LARGE_CHUNK_OVERLAP = 2000, 100
SUMMARY_ITEMS = 5
CHARS_PER_TOKEN = 4
TOKEN_SAFETY = 50
SECTION_BUFFER = 20
CONTEXT_CHARS = 2000
TRUNCATED_MARK = "... [truncated]"
MIDDLE_MARK = "\n\n[...content truncated...]\n\n"
LIMIT_CLASSES, LIMIT_ITEMS = 3, 5

# -- fixed values: exploration questions -----------------------------------------
BASE_QUESTIONS = ["How is user input validated?", "Are there any authentication checks?"]
LANGUAGE_QUESTIONS = {
    ".php": [
        "How are database queries constructed?",
        "Is user input properly sanitized?",
        "Are there any file operations?",
        "How are sessions managed?",
    ],
    ".js": [
        "Are there any DOM manipulation functions?",
        "How is AJAX/fetch used?",
        "Is there input sanitization?",
    ],
    ".py": [
        "How are database queries constructed?",
        "Are there any shell commands or exec calls?",
        "How is authentication handled?",
    ],
}
SCRIPT_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]
DATABASE_QUESTIONS = ["How is SQL injection prevented?", "Are prepared statements used?"]
LOGIN_QUESTIONS = ["How are passwords stored?", "Is MFA implemented?", "How are sessions managed?"]
PRIORITY_QUESTIONS = [
    "What security checks are performed?",
    "Are there any hardcoded credentials?",
    "How is sensitive data handled?",
]
FLOW_QUESTIONS = [
    "How is data validated before processing?",
    "What security checks are performed on the parameters?",
]

# -- fixed values: threat records --------------------------------------------------
THREAT_FIELDS = ["type", "description", "severity", "impact", "mitigation", "code_snippet"]
MISSING_FIELD = "Not specified"
SEVERITIES = ["low", "medium", "high"]
SEVERITY_SCORE = {"Low": 1, "Medium": 2, "High": 3}
CROSSING_WEIGHT, VULNERABILITY_WEIGHT = 1.5, 2.0
PLACEHOLDER_THREAT = {
    "type": "Information Disclosure",
    "description": "This is a placeholder threat (LLM unavailable)",
    "severity": "Medium",
    "impact": "Unknown (LLM unavailable)",
    "mitigation": "Please download the LLM model to get real threat analysis",
}
UNKNOWN_STACK = "Unknown technology stack"
BOUNDARY_WARNING = "WARNING: This data flow crosses security boundaries!"

# -- fixed values: diagram text --------------------------------------------------
FLOW_STYLES = [
    "    classDef component fill:#f9f,stroke:#333,stroke-width:2px;",
    "    classDef dataflow fill:#bbf,stroke:#33c,stroke-width:1px;",
    "    classDef security fill:#fbb,stroke:#c33,stroke-width:2px,stroke-dasharray: 5 5;",
]
THREAT_STYLES = [
    "    classDef component fill:#f9f,stroke:#333,stroke-width:2px;",
    "    classDef dataflow fill:#bbf,stroke:#33c,stroke-width:1px;",
    "    classDef threat fill:#fbb,stroke:#c33,stroke-width:2px;",
    "    classDef highThreat fill:#f88,stroke:#c33,stroke-width:3px;",
    "    classDef mediumThreat fill:#fc8,stroke:#c83,stroke-width:2px;",
    "    classDef lowThreat fill:#ff8,stroke:#cc3,stroke-width:1px;",
    "    classDef boundary fill:none,stroke:#333,stroke-width:2px,stroke-dasharray: 5 5;",
    "    classDef vulnerability fill:#f66,stroke:#900,stroke-width:3px;",
    "    classDef critical fill:#f00,stroke:#900,stroke-width:4px;",
]
THREAT_LEGEND = [
    "    subgraph Legend[Legend]",
    "        comp[Component]:::component",
    "        flow([Data Flow]):::dataflow",
    "        high_threat{{High Threat}}:::highThreat",
    "        med_threat{{Medium Threat}}:::mediumThreat",
    "        low_threat{{Low Threat}}:::lowThreat",
    "        prio[Priority Component]:::critical",
    "        vuln[/Vulnerability/]:::vulnerability",
    "        legend_boundary[Security Boundary]:::boundary",
    "    end",
]
CROSSING_MARK = "\U0001F534"
