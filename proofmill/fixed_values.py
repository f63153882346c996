"""Point tables, word lists and patterns that results depend on.

These must equal the published semantics exactly, so they are stated here as
plain text, in natural order, and used everywhere else by name.  Patterns avoid
look-around and back-references so Spark (Java) and other engines can share them.
"""

# -- file path patterns (case-insensitive) -----------------------------------
CODE_FILE = r"(?i)\.(?:[cm]?[jt]sx?|py|rs|go|java|kt|kts|rb|cs|cpp|cc|c|h|hpp|swift|php|scala|ex|exs)$"
TEST_PATH = (
    r"(?i)(^|/)(test|tests|spec|__tests__)(/|\.|$)|[._](test|spec)\.[^/]+$"
    r"|(^|/)test_[^/]+\.[^/]+$|(^|/)conftest\.py$"
)
TEST_SUPPORT = r"(?i)(^|/)conftest\.py$"
PACKAGE_MARKER = r"(?i)(^|/)__init__\.py$"
BUILD_SUPPORT = r"(?i)(^|/)build\.rs$"
CONFIG_OR_DECLARATION = (
    r"(?i)(^|/)(?:tsconfig|vite\.config|webpack\.config|eslint\.config)|\.(?:config|d)\.[cm]?[jt]s$"
)
ROOT_LEVEL = r"^[^/]+$"
IMPLEMENTATION_TREE = r"(?i)(^|/)(src|lib|packages)(/|$)"
PYTHON_FILE = r"(?i)\.py$"
RUST_FILE = r"(?i)\.rs$"
NON_SOURCE_TREE = (
    r"(?i)(^|/)(docs?|examples?|samples?|scripts?|tools|vendor|build|dist|fixtures?"
    r"|generated|\.venv|venv)(/|$)"
)
SCRIPT_SOURCE = r"(?i)\.[cm]?[jt]sx?$"

MANIFEST_FILE = (
    r"(?i)(^|/)(package\.json|pyproject\.toml|setup\.cfg|Cargo\.toml|go\.mod|pom\.xml"
    r"|build\.gradle(?:\.kts)?)$"
)
AUTOMATION_FILE = r"(?i)^\.github/workflows/.*\.ya?ml$"
OVERVIEW_FILE = r"(?i)(^|/)README(?:\.[^/]*)?$"
DESIGN_FILE = r"(?i)(^|/)(architecture|design|adr|rfcs?)(/|\.|$)|(^|/)(ADR|RFC)-?\d+[^/]*\.md$"
SECURITY_FILE = r"(?i)(^|/)(SECURITY|THREAT_MODEL)(\.[^/]*)?$"
DECISION_NAME = r"(?i)ADR|RFC"
ENTRY_FILE = r"(?i)(^|/)(index|main|cli|server|app|__init__|__main__)\.[^/]+$"
EXAMPLE_TREE = r"(?i)(^|/)(examples?|samples?)(/|$)"

SLICE_EXCLUDED = (
    r"(?i)(^|/)(node_modules|vendor|dist|build|coverage|fixtures?|snapshots?|generated|\.vscode|\.idea"
    r"|\.agents)(/|$)|(^|/)(AGENTS|CLAUDE)\.md$|^\.github/(copilot-instructions|instructions)(/|\.|$)"
    r"|\.(lock|min\.(js|css)|map|png|jpe?g|gif|pdf|zip|wasm)$|\.i18n\.ya?ml$"
)
SLICE_TEXT_FILE = (
    r"(?i)(^|/)(README|ARCHITECTURE|DESIGN|CONTRIBUTING|SECURITY)(\.[^/]*)?$"
    r"|\.(md|mdx|ts|tsx|js|jsx|py|rs|go|java|kt|rb|toml|cfg|ya?ml|json)$"
)
SLICE_DESIGN = (
    r"(?i)(^|/)(architecture|design|adr)(/|\.|$)|(^|/)(rfcs?)(/|$)|(^|/)(RFC-\d+|ADR-\d+)[^/]*\.md$"
)
DOCUMENTATION_PATH = r"(?i)(^|/)(README|docs?|architecture|design|adr|rfcs?)(/|\.|$)|(^|/)(ADR|RFC)-?\d+"
DESIGN_DECISION = r"(?i)(^|/)(architecture|design|adr|rfcs?)(/|\.|$)|(^|/)(ADR|RFC)-?\d+"

# -- repository scoring -------------------------------------------------------
CI_WORKFLOW = r"(?i)^\.github/workflows/.+\.ya?ml$"
WORKFLOW_DIR = r"(?i)^\.github/workflows/"
GOVERNANCE_DOC = r"(?i)(^|/)(CONTRIBUTING|SECURITY|CODE_OF_CONDUCT)(\.md)?$"
TRANSFER_TREE = r"(?i)(^|/)(packages?|src|lib)(/|$)"
ROOT_README = r"(?i)^README(\.[^.]+)?$"
DOCS_TREE = r"(?i)(^|/)(docs|architecture|adr)(/|$)"
SCORE_MANIFEST = r"(?i)(^|/)(package\.json|pyproject\.toml|Cargo\.toml|go\.mod)$"
DECISION_TREE = r"(?i)(^|/)(architecture|adr|rfcs?)(/|$)"
STATIC_CHECKS = r"(?i)(^|/)(eslint|biome|ruff|clippy|golangci|tsconfig|mypy)"

OVERALL_WEIGHTS = {
    "domain": 0.30,
    "maturity": 0.18,
    "transferability": 0.17,
    "clarity": 0.14,
    "design": 0.16,
    "safety": 0.05,  # applied to 100 - risk
}

CATEGORY_POINTS = {
    "overview": 10,
    "design": 20,
    "manifest": 10,
    "source": 20,
    "test": 20,
    "automation": 10,
    "relationships": 10,
}

SEMANTIC_ROLES = ["contract", "invariant", "failure", "relationship", "test"]
ARCHITECTURE_ROLES = ["contract", "data-model", "failure", "extension-point", "test"]

ROLE_PATH_HINTS = {
    "contract": r"(?i)(?:^|[/_.-])(?:api|contract|contracts|interface|interfaces|protocol|types|schema)(?:[/_.-]|$)",
    "invariant": r"(?i)(?:^|[/_.-])(?:invariant|invariants|validat\w*|guard|guards|constraint|constraints|state)(?:[/_.-]|$)",
    "failure": r"(?i)(?:^|[/_.-])(?:error|errors|exception|exceptions|failure|failures|retry|recovery|result)(?:[/_.-]|$)",
    "relationship": r"(?i)(?:^|[/_.-])(?:registry|router|adapter|adapters|composition|container|wiring)(?:[/_.-]|$)",
    "test": r"(?i)(?:^|[/_.-])(?:test|tests|spec|specs)(?:[/_.-]|$)",
}

QUALITY_POINTS = {
    "readable-implementation-evidence": 15,
    "readable-test-evidence": 15,
    "syntactic-implementation-evidence": 15,
    "syntactic-test-evidence": 15,
    "parsed-declaration-structure": 15,
    "resolved-static-relationship-evidence": 10,
    "cross-modal-corroboration-evidence": 15,
}

STRENGTH_LEVELS = ["missing", "textual", "syntactic", "resolved", "corroborated"]  # ordinal 0..4
CONFIDENCE_CEILING = {
    "missing": 0.2,
    "textual": 0.65,
    "syntactic": 0.8,
    "resolved": 0.9,
    "corroborated": 0.95,
}

BLUEPRINT_SECTIONS = [
    "modules", "contracts", "dataModels", "relationships", "failureSemantics",
    "testConcepts", "extensionPoints", "negativeSpace",
]
SECTION_PRIORITY = {
    "contracts": 8, "relationships": 7, "failureSemantics": 6, "testConcepts": 5,
    "dataModels": 4, "extensionPoints": 3, "modules": 2, "negativeSpace": 1,
}

# Words looked for inside windows; word boundaries are ASCII ones.
STRUCTURE_WORDS = "interface|class|type|function|def|trait|struct|test|describe|example|architecture"
FAILURE_WORDS = (
    "error|errors|failure|failures|exception|exceptions|retry|timeout|abort|reject|invalid"
    "|panic|catch|throw"
)

# -- domain vocabulary ---------------------------------------------------------
GENERIC_WORDS = """
a an and or the this that with without for from into of to in on at as is be are it its
implement implementation build create develop make add support supports supporting provide use using used
small tiny simple lightweight basic new existing project software system library libraries application app
package module core runtime dependency dependencies deps zero free provider neutral
typescript javascript type script node nodejs python rust golang go java cpp csharp ruby swift kotlin
esm commonjs exports sideeffects side effect effects readme documentation docs test tests testing tested
fully all full deterministic built builtin framework frameworks external no any only
function functions functional pure async asynchronous synchronous modern fast performant performance scalable
robust production ready high quality well clean maintainable reusable design architecture
api interface interfaces method methods generic
must should need want please first then also return returns value values key keys boolean string number
implementing development engineering unit integration end
零依赖 无依赖 无运行时依赖 类型安全 跨语言 高质量 确定性测试 测试 文档 工程规范
""".split()

# -- import scanning and resolution ---------------------------------------------
IMPORT_FROM = r"""(?:import|export)\s+(?:[^"']*?\s+from\s+)?["']([^"']+)["']"""
REQUIRE_CALL = r"""require\s*\(\s*["']([^"']+)["']\s*\)"""
DYNAMIC_IMPORT = r"""import\s*\(\s*["']([^"']+)["']\s*\)"""
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
SCRIPT_SWAPS = {".js": ".ts", ".jsx": ".tsx", ".mjs": ".mts", ".cjs": ".cts"}

# -- declaration evidence ---------------------------------------------------------
RUST_DECLARATION = r"(?m)^(?:\s*pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|impl|fn|type|const|static)([^A-Za-z0-9_]|$)"
PYTHON_DECLARATION = r"(?m)^(?:async\s+)?(?:def|class)\s+\w+"
RUST_TEST_FUNCTION = r"#\s*\[\s*(?:\w+::)*test\s*\][\s\S]{0,500}?[^A-Za-z0-9_]fn\s+\w+"
RUST_ASSERTION = r"(^|[^A-Za-z0-9_])(?:assert|assert_eq|assert_ne|debug_assert)\s*!"
PYTHON_TEST_FUNCTION = r"(?m)^\s*(?:async\s+)?def\s+test_\w+\s*\("
PYTHON_ASSERTION = r"(^|[^A-Za-z0-9_])assert([^A-Za-z0-9_]|$)|(^|[^A-Za-z0-9_])self\.assert\w+\s*\("

# Per-language line patterns for the declaration fallback scan.
DECLARATION_LINES = {
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|impl|fn|type|const|static)([^A-Za-z0-9_]|$)",
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+\w+",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:interface|class|type|function|enum|namespace)\s+\w+",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:class|function)\s+\w+",
    "go": r"^(?:func|type)\s+",
}

# -- licences ------------------------------------------------------------------
ALLOWED_LICENSES = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC"]

# -- style inventory -------------------------------------------------------------
CLASS_ATTRIBUTE = r"""class(?:Name)?\s*=\s*(?:"([^"]*)"|'([^']*)'|`([^`]*)`)"""
STYLE_FILE = r"(?i)\.(?:css|scss|sass|less|html|htm|tsx|jsx|vue|svelte)$"
STYLE_CONFIG = (
    r"(?i)(^|/)(?:tailwind\.config|theme|themes|tokens|design-tokens|styles?|palette)"
    r"(?:\.[a-z0-9_-]+)?\.(?:ts|js|mjs|cjs|json)$"
)
STYLE_EXTENSIONS = ["css", "scss", "sass", "less", "html", "htm", "tsx", "jsx", "vue", "svelte"]
STYLE_CONFIG_STARTS = ["tailwind.config", "theme", "tokens", "design-tokens", "style", "palette"]
STYLE_CONFIG_EXTENSIONS = ["ts", "js", "mjs", "cjs", "json"]
STYLE_IGNORED_DIRS = [
    ".git", ".next", ".nuxt", "node_modules", "dist", "build", "coverage", "target", "vendor",
]
VARIABLE_DEFINITION = r"(?i)(--[a-z0-9_-]+)\s*:\s*([^;}{]{1,160})"
VARIABLE_REFERENCE = r"(?i)var\(\s*(--[a-z0-9_-]+)"
COLOR_LITERAL = r"(?i)(#[0-9a-f]{3,8}(?:WORD_END)|(?:rgb|hsl)a?\([^)]{3,80}\))"
FONT_SIZE = r"(?i)font-size\s*:\s*([^;}{]{1,40})"
BORDER_RADIUS = r"(?i)border-radius\s*:\s*([^;}{]{1,40})"
BACKGROUND = r"(?i)(?:background|background-color)\s*:\s*([^;}{]{1,160})"
CLASS_FONT_SIZE = r"(?i)^text-(?:xs|sm|base|lg|xl|[2-9]xl|\[[^\]]+\])$"
CLASS_RADIUS = r"(?i)^rounded(?:-[a-z0-9_\[\]./-]+)?$"
CLASS_BLACK = r"(?i)^bg-black(?:/100)?$|^bg-\[#0{3,8}\]$"
CLASS_NEAR_BLACK = r"(?i)^bg-(?:slate|gray|zinc|neutral|stone)-(?:900|950)$"
CLASS_BORDER = r"(?i)^border(?:-[trblxy])?(?:-[0-9]+)?$"
CLASS_SHADOW = r"(?i)^shadow(?:-[a-z0-9_\[\]./-]+)?$"
CLASS_GRADIENT = r"(?i)^bg-gradient-to-[trblxy]{1,2}$"
CLASS_RESPONSIVE = r"(?i)^(?:sm|md|lg|xl|2xl):"
CARD_WORDS = "card|panel|tile|surface-box"

# id -> borders, cards, type steps, dominant radius share, gradient policy
STYLE_PROFILES = {
    "calm-product": (10, 12, 4, 0.75, "restrained"),
    "data-console": (18, 18, 4, 0.8, "avoid"),
    "editorial-docs": (8, 8, 5, 0.7, "avoid"),
    "expressive-marketing": (8, 10, 5, 0.7, "restrained"),
    "productivity-editor": (14, 12, 4, 0.78, "avoid"),
    "commerce-catalog": (12, 14, 4, 0.75, "avoid"),
}

VISUAL_ROUTE_THRESHOLD = 50
# name, points, ASCII-word alternatives, plain alternatives
VISUAL_SIGNALS = [
    ("explicit-visual-language", 50,
     "ui|ux|visual|aesthetic|styling|style|layout|responsive|design system|visual hierarchy",
     "界面|视觉|审美|美观|样式|布局|响应式|设计系统|视觉层级"),
    ("user-facing-surface", 30,
     "page|website|landing|homepage|dashboard|admin console|portal|storefront|catalog|checkout|documentation site|app shell",
     "页面|网站|落地页|首页|看板|仪表盘|后台|控制台|门户|商城|商店|结账页|文档站"),
    ("frontend-stack", 20,
     r"front[ -]?end|react|next\.?js|vue|nuxt|svelte|solid|astro|html|css|scss|tailwind|shadcn",
     "前端"),
    ("visual-quality-requirement", 20,
     "polished|beautiful|premium|distinctive|elegant|refined|brand|not ai|production[- ]ready ui",
     "精致|好看|漂亮|高级感|品牌感|不要.*ai味|去.*ai味"),
]
VISUAL_ARCHETYPES = [
    ("expressive-marketing", "landing|homepage|marketing|launch|hero|pricing", "官网|落地页|营销|发布页|首页"),
    ("data-console", "dashboard|admin|analytics|metrics|operations|data table|console", "看板|仪表盘|后台|数据台|运营台|控制台"),
    ("editorial-docs", "documentation|docs site|knowledge base|reference portal|long[- ]form", "文档站|知识库|参考手册|长文"),
    ("productivity-editor", "editor|workspace|notebook|ide|productivity|developer tool", "编辑器|工作台|笔记|生产力工具|开发者工具"),
    ("commerce-catalog", "e-?commerce|storefront|catalog|product detail|checkout|shopping", "电商|商城|商品|目录|结账|购物"),
]
DEFAULT_ARCHETYPE = "calm-product"

# -- workflow phases ---------------------------------------------------------------
MUTATION_TOOLS = ["edit", "write", "bash", "powershell", "apply_patch"]
STRICT_SIGNALS = {
    "idle": "prepare_required",
    "preparing": "discovery_in_progress",
    "reviewing": "evidence_review_required",
    "awaiting_confirmation": "reference_confirmation_required",
    "distilling": "design_dossier_required",
    "awaiting_design_confirmation": "design_confirmation_required",
    "blocked": "no_approved_precedent",
}
ADVISORY_SIGNALS = {
    "idle": "advisory_learning_required",
    "preparing": "advisory_learning_in_progress",
}

# -- snapshot comparison --------------------------------------------------------------
SNAPSHOT_IGNORED = [".git", "node_modules"]
