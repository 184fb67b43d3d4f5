"""Word lists, patterns and lookup tables the results depend on.

Everything here is data, stated as plain text in one place. Code elsewhere
imports these names and never repeats them.
"""

from __future__ import annotations

# --- fixed values: file selection -------------------------------------------
INDEXABLE_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyx", ".go", ".rs",
    ".java", ".kt", ".scala", ".rb", ".php", ".c", ".cpp", ".h", ".hpp", ".cs",
    ".swift", ".vue", ".svelte", ".json", ".yaml", ".yml", ".toml", ".md", ".mdx",
    ".cbl", ".cob", ".cobol", ".cpy", ".copy", ".jcl", ".pli", ".pl1", ".asm",
    ".s", ".sql", ".bms", ".prc", ".proc",
]
EXCLUDED_DIRS = [
    "node_modules", ".git", "dist", "build", ".next", "coverage", "__pycache__",
    "venv", ".venv", "vendor", "posts", "blog", "content", "articles", "_posts",
]
EXCLUDED_SUFFIXES = [".min.js", ".bundle.js"]
EXCLUDED_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml"]

INVENTORY_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte",
    ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".rs", ".go",
    ".java", ".kt", ".kts", ".scala", ".groovy", ".gradle",
    ".py", ".rb", ".php", ".pl", ".pm", ".lua", ".r",
    ".cs", ".fs", ".vb",
    ".cbl", ".cob", ".cpy", ".jcl", ".prc", ".bms", ".asm", ".s",
    ".pli", ".pl1", ".rpg", ".rpgle", ".clp", ".clle", ".dspf", ".pf",
    ".hs", ".lhs", ".ml", ".mli", ".erl", ".ex", ".exs", ".elm", ".clj", ".cljs",
    ".sh", ".bash", ".zsh", ".ps1", ".psm1", ".bat", ".cmd",
    ".json", ".yaml", ".yml", ".toml", ".xml", ".ini", ".conf", ".cfg",
    ".sql", ".ddl", ".dml", ".plsql", ".pgsql",
    ".md", ".mdx", ".rst", ".txt",
    ".css", ".scss", ".less", ".sass",
    ".swift", ".m", ".mm", ".dart",
    ".proto", ".graphql", ".gql", ".tf", ".hcl",
]
INVENTORY_IGNORED_DIRS = [
    "node_modules", ".git", "dist", "build", ".next", "coverage",
    "__pycache__", "venv", ".venv", "vendor", ".cache", ".turbo",
]
SOURCE_EXTENSIONS = [
    ".ts", ".js", ".tsx", ".jsx", ".py", ".go", ".rs", ".java", ".rb", ".php",
    ".cs", ".cpp", ".c", ".h",
]
SOURCE_IGNORED_DIRS = [
    "node_modules", ".git", "dist", "build", "coverage", ".next", "__pycache__",
    "vendor",
]
CHANGE_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".kt", ".rb",
    ".php", ".c", ".cpp", ".cs", ".swift",
]
DOC_EXTENSIONS = [".md", ".txt", ".rst", ".adoc"]
ASSET_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".css", ".js"]

# --- fixed values: languages ---------------------------------------------------
PARSER_LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx",
    ".mjs": "javascript", ".cjs": "javascript", ".py": "python", ".pyx": "python",
    ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin",
    ".scala": "scala", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp",
    ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".vue": "vue",
    ".svelte": "svelte", ".cbl": "cobol", ".cob": "cobol", ".cobol": "cobol",
    ".cpy": "cobol", ".copy": "cobol", ".jcl": "jcl", ".pli": "pli",
    ".pl1": "pli", ".asm": "asm", ".s": "asm", ".sql": "sql", ".bms": "bms",
    ".prc": "jcl", ".proc": "jcl",
}

INDEX_LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin",
    ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".h": "c",
    ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".vue": "vue",
    ".svelte": "svelte", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".md": "markdown", ".cbl": "cobol", ".cob": "cobol", ".cobol": "cobol",
    ".cpy": "cobol", ".copy": "cobol", ".jcl": "jcl", ".pli": "pli", ".pl1": "pli",
    ".asm": "asm", ".s": "asm", ".sql": "sql", ".bms": "bms", ".prc": "jcl",
    ".proc": "jcl",
}

# --- fixed values: path predicates ----------------------------------------------
TEST_FILE_PATTERNS = [
    r"\.test\.", r"\.spec\.", r"_test\.", r"test_", r"__tests__", r"tests/",
    r"\.stories\.", r"__mocks__",
]
ENTRY_POINT_PATTERNS = [
    r"^(src/)?index\.[tj]sx?$", r"^(src/)?main\.[tj]sx?$", r"^(src/)?app\.[tj]sx?$",
    r"package\.json$", r"vite\.config\.[tj]s$", r"next\.config\.[tj]s$",
    r"webpack\.config\.[tj]s$", r"^(src/)?main\.py$", r"^(src/)?app\.py$",
    r"^(src/)?__main__\.py$", r"setup\.py$", r"pyproject\.toml$",
    r"Main\.(java|kt)$", r"Application\.(java|kt)$", r"pom\.xml$",
    r"build\.gradle(\.kts)?$", r"Program\.cs$", r"Startup\.cs$", r"\.csproj$",
    r"^(cmd/)?main\.go$", r"go\.mod$", r"^src/main\.rs$", r"^src/lib\.rs$",
    r"Cargo\.toml$", r"^(lib/)?.*\.rb$", r"Gemfile$", r"Rakefile$",
    r"AppDelegate\.swift$", r"ContentView\.swift$", r"\.xcodeproj",
    r"Package\.swift$", r"MAINPGM\.cbl$", r"COBOL/.*\.cbl$", r"\.jcl$",
    r"Makefile$", r"Dockerfile$", r"docker-compose\.ya?ml$",
]
ENTRY_POINT_NAMES = [
    "main", "index", "app", "application", "program", "start", "server", "bootstrap",
]
ANCHORED_ENTRY_PATTERNS = [
    r"^src/index\.[tj]sx?$", r"^src/main\.[tj]sx?$", r"^src/app\.[tj]sx?$",
    r"^src/App\.[tj]sx?$", r"^index\.[tj]sx?$", r"^main\.[tj]sx?$",
    r"^src/pages/_app\.[tj]sx?$", r"^src/app/layout\.[tj]sx?$",
    r"^pages/_app\.[tj]sx?$", r"^package\.json$", r"vite\.config\.[tj]s$",
    r"next\.config\.[tj]s$", r"webpack\.config\.[tj]s$",
]
INDEX_FILE_SUFFIXES = ["/index.ts", "/index.tsx", "/index.js"]

# --- fixed values: stop words ---------------------------------------------------
PAGE_STOP_WORDS = (
    "the and for are but not you all can had her was one our out has have been "
    "this that with from they will would there their what about which when make "
    "like time just know take into year your some could them than then look only "
    "come over such also back after well most made where being does here much "
    "these each other"
).split()
QUESTION_STOP_WORDS = (
    "the a an is are was were what how why where when which who this that these "
    "those and or but in on at to for of with by you do run can does"
).split()

# --- fixed values: question and relationship patterns ----------------------------
FLOW_QUESTION_PATTERNS = [
    r"how does .+ work", r"what happens when", r"trace .+ flow", r"show .+ flow",
    r"walk.* through", r"step.* by.* step", r"sequence of", r"data flow",
    r"call flow", r"explain the flow", r"show me how", r"visualize", r"diagram",
    r"architecture of", r"components.* interact",
]
DIAGRAM_PATTERNS = [
    ("sequence", r"sequence|step|order|process|workflow|when.+then|after.+before"),
    ("hierarchy", r"hierarch|structure|organization|parent|child|inherit|extends"),
    ("dataflow", r"data.+flow|transform|input.+output|pipeline"),
]
DEFAULT_DIAGRAM = "flowchart"
RELATION_VERBS = [
    "uses", "calls", "depends", "imports", "extends", "implements", "sends",
    "receives", "triggers", "creates", "returns", "handles",
]

# --- fixed values: chunk types and label categories -------------------------------
CHUNK_TYPES = [
    "file", "module", "class", "interface", "type", "enum", "function", "method",
    "constructor", "property", "constant", "import-block", "export-block", "config",
    "test", "hook", "component", "middleware", "handler", "model", "service",
    "repository", "controller", "util", "unknown",
]
LABEL_CATEGORIES = [
    "authentication", "authorization", "user-management", "data-access",
    "api-endpoint", "business-logic", "validation", "error-handling", "logging",
    "caching", "messaging", "scheduling", "file-handling", "payment",
    "notification", "search", "analytics", "configuration", "testing",
    "infrastructure", "ui-component", "state-management", "routing", "middleware",
    "utility", "unknown",
]

# --- fixed values: page planning --------------------------------------------------
SECTION_ORDER = ["Overview", "architecture", "components", "guides", "api", "reference"]
DIRECTORY_PAGE_TYPES = {
    "components": ("component", "UI components"),
    "pages": ("component", "Page components and routing"),
    "views": ("component", "View components"),
    "layouts": ("component", "Layout components"),
    "hooks": ("module", "Custom React hooks"),
    "utils": ("module", "Utility functions"),
    "helpers": ("module", "Helper functions"),
    "lib": ("module", "Library code"),
    "services": ("module", "Service layer"),
    "api": ("api", "API endpoints"),
    "routes": ("api", "Route handlers"),
    "controllers": ("api", "Controllers"),
    "models": ("module", "Data models"),
    "store": ("module", "State management"),
    "context": ("module", "React context providers"),
    "types": ("module", "Type definitions"),
    "config": ("guide", "Configuration"),
    "scripts": ("guide", "Build and utility scripts"),
}
SKIPPED_PAGE_DIRS = [
    "node_modules", "dist", "build", ".git", "coverage", "__tests__", "__mocks__",
]
EXTENSION_PROJECT_TYPES = {
    ".ts": "TypeScript", ".tsx": "TypeScript/React", ".js": "JavaScript",
    ".jsx": "JavaScript/React", ".py": "Python", ".java": "Java", ".kt": "Kotlin",
    ".scala": "Scala", ".go": "Go", ".rs": "Rust", ".c": "C", ".cpp": "C++",
    ".cs": "C#/.NET", ".rb": "Ruby", ".php": "PHP", ".swift": "Swift/iOS",
    ".dart": "Dart/Flutter", ".cbl": "COBOL/Mainframe", ".cob": "COBOL/Mainframe",
    ".cpy": "COBOL/Mainframe", ".jcl": "Mainframe/JCL", ".bms": "CICS/Mainframe",
}
COVERAGE_EXTENSION_TITLES = {
    ".cbl": "COBOL Programs", ".cob": "COBOL Programs",
    ".cpy": "Copybooks & Data Structures", ".jcl": "Job Control (JCL)",
    ".bms": "Screen Maps (BMS)", ".ts": "TypeScript Modules",
    ".tsx": "React Components", ".js": "JavaScript Modules",
    ".jsx": "React Components", ".py": "Python Modules", ".java": "Java Classes",
    ".go": "Go Packages", ".rs": "Rust Modules", ".sql": "Database Scripts",
}
PLAN_EXTENSION_TITLES = {
    ".ts": "TypeScript Modules", ".tsx": "React Components",
    ".js": "JavaScript Modules", ".jsx": "React Components",
    ".py": "Python Modules", ".java": "Java Classes", ".go": "Go Packages",
    ".rs": "Rust Modules", ".cbl": "COBOL Programs", ".cob": "COBOL Programs",
    ".cpy": "Copybooks", ".jcl": "JCL Jobs", ".bms": "BMS Screen Maps",
    ".sql": "Database Scripts", ".c": "C Source Files", ".cpp": "C++ Source Files",
    ".cs": "C# Classes", ".rb": "Ruby Files",
}
# (title, file name, page type, path pattern, least files, least files when the
#  project has under 50, most files listed or None, context)
PAGE_BUCKETS = [
    ("UI Components", "components.md", "component",
     r"/components/|/Components/|^(?!.*/pages/).*\.tsx$", 5, 2, 20,
     "Reusable UI components, their props, and usage patterns"),
    ("Custom Hooks", "hooks.md", "module", r"/hooks/|use.*\.ts$", 3, 1, None,
     "Custom React hooks, their purpose, and usage examples"),
    ("API Reference", "api.md", "api",
     r"/api/|/routes/|/endpoints/|router|handler", 2, 1, 20,
     "API endpoints, route handlers, and request/response formats"),
    ("Utilities & Helpers", "utilities.md", "module",
     r"/utils/|/helpers/|/lib/|util|helper", 3, 1, 15,
     "Utility functions, helper modules, and shared logic"),
    ("State Management", "state-management.md", "module",
     r"/store/|/state/|/redux/|/context/|store|slice", 2, 1, None,
     "Application state, stores, reducers, and data flow patterns"),
    ("Type Definitions", "types.md", "module",
     r"/types/|/interfaces/|\.d\.ts|types\.ts", 2, 1, None,
     "TypeScript types, interfaces, and type utilities"),
    ("Pages & Routing", "pages.md", "component",
     r"/pages/|/views/|/screens/", 2, 2, 20,
     "Page components, routing structure, and navigation"),
    ("Configuration", "configuration.md", "config",
     r"config|\.json$|\.yaml$|\.yml$|\.toml$", 2, 2, 10,
     "Project configuration, environment setup, and build settings"),
]
# context of the overview (its project type in place of the braces), of the getting started page and, after the path,
# of key files; most files listed for a directory's page and for a page added for coverage
OVERVIEW_CONTEXT = (
    "High-level architecture of this {} project. Main entry points and how components interact."
)
GETTING_STARTED_CONTEXT = "Installation, setup, development workflow, and quick start guide"
CORE_FILE_CONTEXT = ". Entry point or main configuration."
DIRECTORY_PAGE_FILES = 20
PLANNED_PAGE_FILES = 10
SETUP_FILE_PATTERN = r"package\.json|README|CONTRIBUTING|setup|install"
MANIFEST_FRAMEWORKS = [
    ("next", "web app", "Next.js"), ("react", "web app", "React"),
    ("vue", "web app", "Vue"), ("svelte", "web app", "Svelte"),
    ("express", "server", "Express"), ("fastify", "server", "Fastify"),
    ("@anthropic-ai/sdk", "AI application", "Anthropic SDK"),
]

# --- fixed values: scores and limits ----------------------------------------------
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
RELEVANCE_THRESHOLD = 0.3
CHARS_PER_CHUNK = 1500
DOCUMENTATION_CHARS = 200
CHARS_PER_TOKEN = 4
MIN_CHUNK_CHARS = 100
MAX_CHUNK_CHARS = 1500
WINDOW_CHARS = 1500
WINDOW_OVERLAP_LINES = 4
WINDOW_LOOK_AHEAD = 10
PASSAGE_CHARS = 800
CONTEXT_BUDGET_CHARS = 12000
HISTORY_TOKEN_LIMIT = 180000
HISTORY_KEEP = 20
TOKEN_WARNING = 150000
BATCH_CHUNKS = 3000
