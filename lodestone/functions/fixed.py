"""Word lists, tables, patterns and constants that results depend on."""

# Words that queries and identifiers leave out.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could "
    "should may might shall can need dare ought used to of in for on with at by from "
    "as into through during before after above below between out off over under again further then "
    "once here there when where why how all each every both few more most other some such no "
    "nor not only own same so than too very just because but and or if while about up "
    "what which who whom this that these those am it its i me my we our you your he him "
    "his she her they them their"
).split()

# Abbreviation -> words that a query with it also looks for.
SYNONYMS = {
    "auth": ["authentication", "authorize", "authorization", "login"],
    "config": ["configuration", "settings", "preferences"],
    "db": ["database", "sqlite", "postgres", "mysql"],
    "err": ["error", "exception"],
    "fn": ["function", "method"],
    "func": ["function", "method"],
    "init": ["initialize", "initialization", "setup"],
    "msg": ["message"],
    "nav": ["navigation", "navigate", "router"],
    "param": ["parameter", "argument"],
    "pkg": ["package"],
    "req": ["request"],
    "res": ["response"],
    "repo": ["repository"],
    "sync": ["synchronize", "synchronization"],
    "util": ["utility", "utilities", "helper"],
    "utils": ["utility", "utilities", "helper"],
    "env": ["environment"],
    "middleware": ["interceptor", "handler"],
    "api": ["endpoint", "route"],
}

# Words that look like calls but are syntax or built in.
NOT_A_REFERENCE = (
    "if for while switch catch return function class const let var new this super typeof instanceof await async "
    "import export from default try finally throw else case break continue do in of and or not is None True "
    "False null true false undefined self def elif lambda pass raise with as print len str int float bool "
    "list dict set type public private protected static void int32 string error nil func struct enum impl "
    "trait mod pub fn use match where interface extends implements package module require console log"
).split()

# Extension -> language family.
LANGUAGES = {
    ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ts": "js", ".tsx": "js", ".mts": "js", ".cts": "js",
    ".py": "py", ".pyi": "py", ".go": "go", ".rs": "rs", ".java": "java", ".kt": "java", ".scala": "java",
    ".rb": "rb", ".php": "php", ".c": "c", ".h": "c", ".cc": "c", ".cpp": "c", ".hpp": "c", ".cxx": "c",
    ".m": "c", ".mm": "c", ".sql": "sql",
}

# Definition patterns of each family in order of precedence: (pattern, kind), the name in group 1.
DEFINITIONS = {
    "js": [
        (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", "function"),
        (r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)", "class"),
        (r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>", "function"),
        (r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?function", "function"),
        (r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)", "interface"),
        (r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*=", "type"),
        (r"^\s*(?:export\s+)?enum\s+([A-Za-z_$][\w$]*)", "enum"),
        (r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=", "const"),
        (r"^\s{2,}(?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{", "method"),
    ],
    "py": [
        (r"^\s*(?:async\s+)?def\s+([A-Za-z_][\w]*)", "function"),
        (r"^\s*class\s+([A-Za-z_][\w]*)", "class"),
    ],
    "go": [
        (r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_][\w]*)", "function"),
        (r"^\s*type\s+([A-Za-z_][\w]*)", "type"),
    ],
    "rs": [
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_][\w]*)", "function"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_][\w]*)", "struct"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z_][\w]*)", "enum"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z_][\w]*)", "trait"),
        (r"^\s*impl(?:<[^>]*>)?\s+(?:[A-Za-z_][\w:]*\s+for\s+)?([A-Za-z_][\w]*)", "impl"),
        (r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z_][\w]*)", "module"),
    ],
    "java": [
        (r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:abstract\s+)?class\s+([A-Za-z_][\w]*)", "class"),
        (r"^\s*(?:public|private|protected)?\s*interface\s+([A-Za-z_][\w]*)", "interface"),
        (r"^\s*(?:public|private|protected)?\s*enum\s+([A-Za-z_][\w]*)", "enum"),
        (r"^\s*(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?[\w<>\[\].]+\s+([A-Za-z_][\w]*)\s*\(", "method"),
    ],
    "rb": [
        (r"^\s*def\s+(?:self\.)?([A-Za-z_][\w]*[?!=]?)", "function"),
        (r"^\s*class\s+([A-Za-z_][\w]*)", "class"),
        (r"^\s*module\s+([A-Za-z_][\w]*)", "module"),
    ],
    "php": [
        (r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+([A-Za-z_][\w]*)", "function"),
        (r"^\s*(?:abstract\s+|final\s+)?class\s+([A-Za-z_][\w]*)", "class"),
        (r"^\s*interface\s+([A-Za-z_][\w]*)", "interface"),
        (r"^\s*trait\s+([A-Za-z_][\w]*)", "trait"),
    ],
    "c": [
        (r"^\s*(?:static\s+|inline\s+|extern\s+)*[A-Za-z_][\w\s*]*\s+\*?([A-Za-z_][\w]*)\s*\([^;]*\)\s*\{", "function"),
        (r"^\s*(?:typedef\s+)?struct\s+([A-Za-z_][\w]*)", "struct"),
        (r"^\s*(?:typedef\s+)?enum\s+([A-Za-z_][\w]*)", "enum"),
        (r"^\s*class\s+([A-Za-z_][\w]*)", "class"),
    ],
    "sql": [
        (r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|FUNCTION|PROCEDURE|INDEX|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?([A-Za-z_][\w]*)", "table"),
        (r"(?i)^\s*ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?[`\"\[]?([A-Za-z_][\w]*)", "table"),
    ],
}

# What is blanked before references are read, in this order: (pattern, replacement).
NOISE = [
    (r"/\*[\s\S]*?\*/", " "),
    (r"(?m)(^|[^:])//.*$", "$1 "),
    (r"(?m)^\s*#.*$", " "),
    (r'"""[\s\S]*?"""', " "),
    (r"'''[\s\S]*?'''", " "),
    (r"`(?:[^`\\]|\\.)*`", " "),
    (r'"(?:[^"\\]|\\.)*"', " "),
    (r"'(?:[^'\\]|\\.)*'", " "),
]
CALL = r"([A-Za-z_$][\w$]{2,})\s*\("
MEMBER_CALL = r"\.([A-Za-z_$][\w$]{2,})\s*\("
IMPORTED = r"(?:import|from)\s+\{([^}]*)\}"
CONSTRUCTED = r"\bnew\s+([A-Z][\w$]{2,})"

# Lines on which a syntax chunk begins, by extension.
BOUNDARIES = {
    ".ts": r"^(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|const\s+\w+\s*=\s*(?:async\s+)?\(|enum)\b",
    ".tsx": r"^(?:export\s+)?(?:async\s+)?(?:function|class|interface|type|const\s+\w+\s*=\s*(?:async\s+)?\(|enum)\b",
    ".js": r"^(?:export\s+)?(?:async\s+)?(?:function|class|const\s+\w+\s*=\s*(?:async\s+)?\()\b",
    ".jsx": r"^(?:export\s+)?(?:async\s+)?(?:function|class|const\s+\w+\s*=\s*(?:async\s+)?\()\b",
    ".py": r"^(?:def |class |async def )",
    ".go": r"^(?:func |type )",
    ".rs": r"^(?:pub\s+)?(?:fn |struct |enum |impl |trait |mod )",
    ".java": r"^(?:public |private |protected )?(?:static\s+)?(?:class |interface |enum |.*\s+\w+\s*\()",
    ".rb": r"^(?:def |class |module )",
    ".php": r"^(?:function |class |interface |trait )",
    ".sql": r"(?i)^(?:CREATE |ALTER |DROP |INSERT |SELECT |WITH |-- ===)",
}
COMMENT_LINE = r"^\s*(//|#|/\*|\*|--|;;|@|[\"']{3})"
CHARS_PER_TOKEN = 4

# Ranking.
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
WEIGHT_VECTOR, WEIGHT_BM25, WEIGHT_RRF = 0.4, 0.3, 0.3
MULTIPLIERS = {"readme": 0.5, "markdown": 0.7, "test": 0.85, "config": 0.8}
TEST_FILE = r"\.(test|spec)\.[^.]+$|__(tests|test)__|/test/"
CONFIG_FILE = r"\.(json|ya?ml|toml|ini|cfg|conf)$|(^|/)\.[^/]*$"
IDENTIFIER_STEP, IDENTIFIER_CAP = 0.5, 2.5
FILE_STEP, FILE_CAP = 0.1, 1.5
MERGE_GAP = 5
PPR_ALPHA, PPR_ITERATIONS, PPR_TOLERANCE = 0.85, 20, 1e-6
CODE_PREVIEW, CLI_PREVIEW = 400, 300

# Router: patterns that stay with a literal search.
METACHARACTERS = r"[*+?\[\]{}()|\\^$]"
MARKER = r"^[@#]|TODO|FIXME|HACK|XXX|DEPRECATED"
URL_LIKE = r":/{2}|localhost"
SHELL_SEARCH = r"^\s*(?:rg|grep|ag|ack)\s+([^|;&]*)"
SHELL_COUNTS = r"(?:^|\s)-[a-zA-Z]*[cl](?:\s|$)"
SHELL_TOKEN = r"\"[^\"]*\"|'[^']*'|\S+"

# Directories that a walk skips.
SKIPPED_DIRS = "node_modules .git .venv venv __pycache__ .next dist build .claude .DS_Store .vscode .idea".split()

DEFAULTS = {
    "embedding": {
        "api_base": "http://localhost:11434/v1",
        "model": "qwen3-embedding:0.6b",
        "api_key_env": "",
        "dimensions": 1024,
        "batch_size": 10,
        "query_prefix": "Instruct: Given a code search query, retrieve the code that answers it\nQuery: ",
        "document_prefix": "",
    },
    "chunking": {"strategy": "hybrid", "max_tokens": 512, "overlap_tokens": 50},
    "indexing": {
        "include": [f"**/*.{x}" for x in "ts tsx js jsx py go rs java rb php sql md".split()],
        "exclude": ["node_modules/**", "dist/**", "build/**", ".next/**", "*.lock", "*.min.js"],
        "max_file_size_kb": 500,
        "auto_index": True,
        "max_files": 10000,
    },
    "search": {
        "top_k": 10,
        "similarity_threshold": 0.35,
        "hybrid": {
            "enabled": True,
            "weight_vector": 0.4,
            "weight_bm25": 0.3,
            "weight_rrf": 0.3,
            "doc_penalty": 0.5,
            "identifier_boost": 1.5,
            "debug": False,
            "weight_graph": 1.0,
            "graph_seeds": 5,
            "graph_damping": "raw",
            "graph_expand": 3,
            "graph_expand_min": 0.05,
            "graph_max_definers": 0,
        },
    },
    "storage": {"path": ".index"},
    "intercept": {"enabled": True, "min_pattern_length": 4, "mode": "redirect"},
}

# Provider -> (endpoint, model, key variable, dimensions, batch size, query prefix, document prefix).
PROVIDERS = {
    "ollama": ("http://localhost:11434/v1", "qwen3-embedding:0.6b", "", 1024, 10, "Instruct: Given a code search query, retrieve the code that answers it\nQuery: ", ""),
    "ollama-nomic": ("http://localhost:11434/v1", "nomic-embed-text", "", 768, 10, "search_query: ", "search_document: "),
    "openai": ("https://api.openai.com/v1", "text-embedding-3-small", "OPENAI_API_KEY", 1536, 100, "", ""),
    "voyage": ("https://api.voyageai.com/v1", "voyage-code-3", "VOYAGE_API_KEY", 1024, 50, "", ""),
    "litellm": ("http://localhost:4000/v1", "voyage-code-3", "LITELLM_API_KEY", 1024, 50, "", ""),
}
