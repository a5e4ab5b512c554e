"""Dimension values that decide results. All are fixed values, stated as plain text."""

from __future__ import annotations

# Modules whose import is worth a warning.
RISKY_MODULES = ("subprocess", "pickle", "marshal", "shelve", "yaml", "telnetlib", "ftplib", "ctypes", "os")

# Rule -> category. Rules that are not listed are their own category.
RULE_CATEGORY = {
    "weak_hash_md5": "weak_crypto",
    "weak_hash_sha1": "weak_crypto",
    "B324": "weak_crypto",
    "B303": "weak_crypto",
    "command_injection_danger": "command_injection",
    "shell_injection": "command_injection",
    "B602": "command_injection",
    "B605": "command_injection",
    "sql_injection_variable": "sql_injection",
    "B608": "sql_injection",
    "insecure_pickle": "insecure_deserialization",
    "insecure_yaml": "insecure_deserialization",
    "B301": "insecure_deserialization",
    "B506": "insecure_deserialization",
    "weak_random_crypto": "weak_random",
    "B311": "weak_random",
    "hardcoded_password": "hardcoded_secret",
    "hardcoded_token": "hardcoded_secret",
    "hardcoded_api_key": "hardcoded_secret",
    "B105": "hardcoded_secret",
    "B106": "hardcoded_secret",
    "B107": "hardcoded_secret",
    "B307": "dangerous_eval_exec",
    "B102": "dangerous_eval_exec",
    "B306": "insecure_temp_file",
    "B101": "assert_used",
    "B401": "unsafe_imports",
    "B402": "unsafe_imports",
    "B403": "unsafe_imports",
    "B404": "unsafe_imports",
    "import_subprocess": "unsafe_imports",
    "import_pickle": "unsafe_imports",
    "import_marshal": "unsafe_imports",
    "import_shelve": "unsafe_imports",
    "import_yaml": "unsafe_imports",
    "import_telnetlib": "unsafe_imports",
    "import_ftplib": "unsafe_imports",
    "import_ctypes": "unsafe_imports",
    "import_os": "unsafe_imports",
    "dynamic_import": "unsafe_imports",
    "B609": "path_traversal",
    "xxe_injection": "xxe",
    "xxe_vulnerability": "xxe",
    "B410": "xxe",
    "B411": "xxe",
    "ssrf_danger": "ssrf",
    "ssrf_vulnerability": "ssrf",
    "race_condition_toctou": "race_condition",
    "toctou": "race_condition",
    "integer_overflow_risk": "integer_overflow",
    "dos_risk": "resource_exhaustion",
    "insecure_permissions": "insecure_file_permissions",
    "B103": "insecure_file_permissions",
}

# Categories of severity HIGH; all others are MEDIUM.
HIGH = (
    "dangerous_eval_exec",
    "command_injection",
    "sql_injection",
    "hardcoded_secret",
    "insecure_deserialization",
    "path_traversal",
    "xxe",
    "ssrf",
    "privilege_escalation",
    "format_string_injection",
)

# What the SQL rules look for.
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE", "DROP", "ALTER", "AND", "OR")
SQL_PLACEHOLDERS = ("%s", "?", ":name", "$1", "%(", ":%(")
TAINT_SOURCES = ("input", "request", "argv", "environ", "form", "args", "params", "data", "body", "get_json")

# The line scan for literal secrets, in the order of its patterns.
SECRET_PATTERNS = (
    ("password", r"password\s*=\s*[\"']([^\"']+)[\"']"),
    ("api_key", r"api[_-]?key\s*=\s*[\"']([^\"']+)[\"']"),
    ("secret", r"secret\s*=\s*[\"']([^\"']{8,})[\"']"),
    ("token", r"token\s*=\s*[\"']([^\"']{8,})[\"']"),
)
SECRET_SKIP_LOWER = ("os.environ", "getenv", "config.get", ".get(", "input(")
SECRET_SKIP = ('f"', "f'", ".format", "{", "}")
SECRET_PLACEHOLDERS = ("your_", "example", "test", "xxx", "***")

# Names that the other rules look for.
SHELL_CALLS = ("os.popen", "os.system", "commands.getoutput")
PICKLE_CALLS = ("pickle.loads", "pickle.load", "cPickle.loads", "cPickle.load")
YAML_CALLS = ("yaml.load", "yaml.unsafe_load")
CRYPTO_CONTEXT = ("password", "token", "key", "secret", "salt", "nonce", "crypto", "session")
PATH_CALLS = ("open", "os.path.join", "pathlib.Path")
XML_MODULES = ("xml.etree.ElementTree", "xml.sax", "xml.dom.minidom", "lxml.etree")
CHECK_CALLS = ("os.path.exists", "os.path.isfile", "os.access")
USE_CALLS = ("open", "os.remove", "os.unlink", "os.rename", "os.makedirs")
TEMP_CALLS = ("tempfile.mktemp", "os.tempnam", "os.tmpnam")
BUFFER_CALLS = ("bytearray", "bytes", "list", "array.array")
SECRET_NAMES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "auth", "credential", "passphrase")
LOOP_IO = ("read", "recv", "get", "fetch")
CHMOD_CALLS = ("os.chmod", "os.fchmod")
HTTP_CALLS = ("requests.get", "requests.post", "urllib.request.urlopen", "http.client.request")
PRIVILEGE_WORDS = ("role", "permission", "privilege", "access", "level")

# Class decorators and bases that mark a class as special.
SPECIAL_CLASSES = ("dataclass", "TypedDict", "Protocol", "ABC", "NamedTuple", "Enum", "IntEnum")

# Words that index and re-ranking pass over.
STOPWORDS = (
    "the", "is", "at", "on", "def", "class", "if", "for", "in", "and", "or", "as", "with", "from", "import", "return", "self", "true", "false",
    "none", "try", "except", "pass", "async", "await", "elif", "else", "while",
)

# Words that questions are stripped of.
QUESTION_STOPWORDS = (
    "does", "works", "explain", "show", "tell", "find", "get", "the", "this", "that", "with", "from", "have", "what", "when", "where", "which", "who",
    "how", "why", "can", "should", "would", "could", "will", "make", "use",
)

# Intents in declaration order, their patterns and weights.
INTENT_PATTERNS = (
    ("definition_lookup", "where is .* defined", 1.0),
    ("definition_lookup", "find (class|function|def)", 1.0),
    ("definition_lookup", "locate", 0.8),
    ("definition_lookup", "show me .* (class|function)", 0.9),
    ("definition_lookup", "what is (the )?(class|function|method)", 0.7),
    ("flow_explanation", "how does .* work", 1.0),
    ("flow_explanation", "explain.*flow", 1.0),
    ("flow_explanation", "what happens when", 0.9),
    ("flow_explanation", "trace", 0.8),
    ("flow_explanation", "workflow", 0.9),
    ("flow_explanation", "walk me through", 0.9),
    ("flow_explanation", "step by step", 0.8),
    ("flow_explanation", "process for", 0.8),
    ("dependency_analysis", "what (does|libraries|packages|imports)", 0.9),
    ("dependency_analysis", "dependencies", 1.0),
    ("dependency_analysis", "uses? which", 0.7),
    ("dependency_analysis", "requires?", 0.8),
    ("dependency_analysis", "what libraries", 1.0),
    ("error_analysis", "(why|what).*error", 1.0),
    ("error_analysis", "debug", 0.9),
    ("error_analysis", "fix", 0.7),
    ("error_analysis", "bug", 0.8),
    ("error_analysis", "not working", 0.8),
    ("error_analysis", "exception", 1.0),
    ("error_analysis", "fails?", 0.8),
    ("error_analysis", "crash", 0.9),
    ("error_analysis", "wrong with", 0.7),
    ("security_check", "security", 1.0),
    ("security_check", "vulnerability", 1.0),
    ("security_check", "vulnerabilities", 1.0),
    ("security_check", "safe", 0.6),
    ("security_check", "injection", 1.0),
    ("security_check", "exploit", 1.0),
    ("security_check", "risk", 0.7),
    ("optimization", "optimize", 1.0),
    ("optimization", "optimise", 1.0),
    ("optimization", "improve.*performance", 1.0),
    ("optimization", "make.*faster", 0.9),
    ("optimization", "make.*better", 0.8),
    ("optimization", "make.*efficient", 0.9),
    ("optimization", "speed up", 0.9),
    ("optimization", "refactor", 0.8),
    ("counting_query", "how many", 1.0),
    ("counting_query", "count (of|the)?", 0.9),
    ("counting_query", "total number", 1.0),
    ("counting_query", "number of", 0.9),
    ("listing_query", "list (all|the)?", 1.0),
    ("listing_query", "show (all|me all)?", 0.8),
    ("listing_query", "what (are|functions|classes|methods)", 0.9),
    ("listing_query", "give me (all|the list)", 0.9),
)
COUNTING = "how many|count|total number|number of"
LISTING = "list (all|the)?|show (all|me all)?|what (are|functions|classes)"
COMPOUND = (
    r"\b(and|then)\b|\b(also|plus|additionally)\b"
)

# Intent -> preferred chunk types, exact-match boost, code check, weights of vector and word scores.
INTENT_PARAMS = (
    ("definition_lookup", ("class", "function", "init_method"), True, False, 0.5, 0.5),
    ("flow_explanation", ("function", "class", "code_block", "nested_function"), False, False, 0.8, 0.2),
    ("dependency_analysis", ("imports", "class", "function"), False, False, 0.6, 0.4),
    ("error_analysis", ("function", "class"), True, True, 0.65, 0.35),
    ("security_check", ("function", "class"), False, True, 0.7, 0.3),
    ("optimization", ("function", "class"), True, True, 0.6, 0.4),
    ("counting_query", (), False, False, 0.5, 0.5),
    ("listing_query", (), False, False, 0.5, 0.5),
    ("general_query", (), False, False, 0.7, 0.3),
    ("code_review", (), False, False, 0.7, 0.3),
    ("pattern_analysis", (), False, False, 0.75, 0.25),
    ("performance_analysis", (), False, False, 0.65, 0.35),
    ("code_quality", (), False, False, 0.65, 0.35),
)
TOP_K = 5

# Weight of each kind of metadata match.
BOOST = {
    "exact_match": 2.8,
    "name": 2.2,
    "keywords": 1.5,
    "chunk_type": 0.8,
    "function_calls": 1.0,
    "docstring_match": 1.2,
    "type_hint_match": 1.1,
    "decorator_match": 0.9,
}
NAME_HIT = 0.5

# Base weights and exceptions of the router's own boost table.
ROUTER_BOOST = {
    "exact_match": 1.0,
    "name": 0.5,
    "chunk_type": 0.3,
    "keywords": 0.4,
    "file_context": 0.2,
    "function_calls": 0.35,
    "docstring_match": 0.45,
    "type_hint_match": 0.4,
    "decorator_match": 0.3,
}

# Topic -> terms that a question on it is widened by.
TOPIC_TERMS = {
    "authentication": ("login", "password", "user", "auth", "credentials"),
    "late fee": ("fine", "overdue", "penalty", "charge"),
    "reservation": ("reserve", "queue", "booking", "hold"),
    "search": ("find", "query", "lookup", "filter"),
    "security": ("vulnerability", "exploit", "risk", "injection"),
    "cache": ("lru_cache", "memoize", "cached", "redis"),
    "async": ("await", "coroutine", "asyncio", "task"),
    "decorator": ("property", "staticmethod", "classmethod", "wraps"),
}

# Sizes of chunks in characters; overlap.
CHUNK_MIN, CHUNK_MAX, CHUNK_OVERLAP = 800, 2500, 150

# BM25 and score constants.
BM25_K1, BM25_B, BM25_NORM = 1.5, 0.75, 10.0
