"""Fixed values that define results: word lists, name lists and weights, in natural order."""

# fixed values: words left out of full-text queries
QUERY_STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been have has had do does did will would "
    "could should may might can this that these those i you he she it we they what when where why how which who"
).split()

# fixed values: words left out of query concepts
CONCEPT_STOP_WORDS = [*QUERY_STOP_WORDS, "being"]

# fixed values: words left out of keywords
KEYWORD_STOP_WORDS = (
    "the a an is was are were be been being have has had do does did will would could should may might shall can to of "
    "in for on with at by from as into through during before after it its this that these and but or nor not"
).split()

# fixed values: words left out of default concepts
COMMON_WORDS = "the and that this with from have they been were more when what some time".split()

# fixed values: opposites that mark a contradiction
OPPOSITES = [
    ("succeeded", "failed"), ("enabled", "disabled"), ("true", "false"), ("added", "removed"),
    ("created", "deleted"), ("started", "stopped"), ("working", "broken"),
]

# fixed values: parts of file names that are never ingested
SENSITIVE_NAMES = (
    ".env .env. id_rsa id_ed25519 id_ecdsa id_dsa .pem .key .p12 .pfx credentials secret .keychain .keystore .jks "
    "known_hosts authorized_keys .netrc .npmrc .pypirc token.json service-account .htpasswd"
).split()

# fixed values: extensions of binary files
BINARY_EXTENSIONS = (
    "exe bin o so dylib a dll png jpg jpeg gif webp bmp ico tiff heic heif raw mp4 mov avi mkv mp3 wav flac aac m4a zip gz "
    "tar bz2 xz 7z rar dmg pdf doc xls ppt docx xlsx pptx woff woff2 ttf otf sqlite sqlite-shm sqlite-wal db db-shm db-wal "
    "ldb sst log class pyc pyo photoslibrary dict data"
).split()

# fixed values: path parts and file names of events that are rejected
IGNORED_PATHS = (
    ".git/ node_modules/ __pycache__/ .DS_Store ~ .swp .tmp .xbel venv/ .venv/ site-packages/ .tox/ .mypy_cache/ "
    ".ruff_cache/ .pytest_cache/ .egg-info/ .eggs/"
).split()
LOCK_FILES = (
    "go.sum package-lock.json yarn.lock Cargo.lock poetry.lock pnpm-lock.yaml Gemfile.lock composer.lock "
    ".release-please-manifest.json CHANGELOG.md"
).split()
EVENT_SENSITIVE_NAMES = (
    ".env id_rsa id_ed25519 id_ecdsa .pem .key credentials secret .keychain .keystore .netrc .htpasswd"
).split()
SOURCE_EXTENSIONS = ".go .py .js .ts .java .rs .cpp .c .h".split()
CONFIG_EXTENSIONS = ".cfg .conf .yaml .json .toml".split()
TRIVIAL_COMMANDS = "cd ls pwd clear exit history which whoami echo".split()
SIGNAL_COMMANDS = "git make go npm docker kubectl ssh curl python node".split()
COMPOUND_COMMANDS = "git docker kubectl npm go cargo pip yarn make systemctl brew apt".split()
CODE_INDICATORS = "{ } function def class import package".split()

# fixed values: keywords and what each adds to an event's score
KEYWORD_WEIGHTS = [
    (0.15, "error bug fix todo hack important decision deadline meeting".split()),
    (0.10, "config deploy release review merge refactor test fail".split()),
    (0.05, "update change add remove create install".split()),
]

# fixed values: path segments that are no concepts
PATH_NOISE = (
    "home users user var usr opt etc root volumes mnt media run projects documents desktop downloads workspace workspaces "
    "internal cmd pkg src lib bin tmp test main index mod sum go the and for git node_modules vendor dist build target "
    "images icons fonts assets static public resources res img figures screenshots docs doc bytes data cache temp logs "
    "output out generated gen third_party thirdparty deps extern external"
).split()

# fixed values: weights of retrieval
RELATION_WEIGHTS = {
    "caused_by": 1.2, "part_of": 1.15, "reinforces": 1.1, "temporal": 1.1, "similar": 1.0, "contradicts": 0.8,
}
SOURCE_WEIGHTS = {"mcp": 1.5, "terminal": 0.8, "clipboard": 0.6, "filesystem": 0.5}
TYPE_WEIGHTS = {"decision": 1.3, "error": 1.25, "insight": 1.2, "learning": 1.15}
TYPE_SALIENCE = {"decision": 0.85, "error": 0.8, "insight": 0.9, "learning": 0.8, "handoff": 0.95}
FEEDBACK_VALUES = {"helpful": 1.0, "partial": 0.0, "irrelevant": -1.0}

# fixed values: quality gate of captured examples
CONTROLLED_VOCABULARY = (
    "go python javascript typescript sql bash html css docker git linux macos systemd build ci deployment debugging testing "
    "refactoring configuration migration documentation review api database filesystem networking security authentication "
    "performance logging ui cli memory encoding retrieval embedding agent llm daemon mcp watcher decision error fix insight "
    "learning planning research dependency schema config"
).split()
SIGNIFICANCES = "routine notable important critical".split()
TONES = "neutral satisfying frustrating exciting concerning".split()
OUTCOMES = "success failure ongoing unknown".split()
PLACEHOLDER_GISTS = [
    "user did something", "something happened", "file changed", "event occurred", "unknown event", "observation",
]
GENERATED_MARKERS = [
    "generated by", "do not edit", "auto-generated", "automatically generated", "this file is generated",
    "code generated", "machine generated",
]

# fixed values: fields of study and keywords (patterns) of papers
NEURO_FIELDS = ["neuroscience", "psychology", "cognitive science", "philosophy"]
CS_FIELDS = ["computer science"]
NEURO_KEYWORDS = [
    r"memory\s+consolidation", r"memory\s+encoding", r"memory\s+retrieval", r"spread(?:ing)?\s+activation", r"episodic\s+memory",
    r"semantic\s+memory", r"working\s+memory", r"associative\s+memory", r"metacognition", r"levels?\s+of\s+processing", r"salience",
    r"hippocampus", r"hippocampal", r"long[\s-]term\s+potentiation", r"cognitive\s+load", r"pattern\s+recognition", r"schema\s+theory",
    r"memory\s+decay", r"memory\s+reactivation", r"memory\s+replay", r"sleep\s+(?:and\s+)?memory",
    r"attention(?:al)?\s+(?:mechanism|control|network)", r"neural\s+plasticity", r"synaptic\s+plasticity", r"prefrontal\s+cortex",
    r"inhibitory\s+control", r"cognitive\s+neuroscience", r"recollection", r"familiarity\s+(?:and\s+)?recollection",
    r"memory\s+(?:re)?consolidation", r"interference\s+(?:theory|in\s+memory)", r"forgetting\s+curve", r"spaced\s+repetition",
    r"desirable\s+difficult", r"testing\s+effect", r"retrieval\s+practice", r"consciousness", r"neural\s+correlates?\s+of\s+consciousness",
    r"global\s+workspace\s+theory", r"integrated\s+information\s+theory", r"phenomenal\s+consciousness", r"access\s+consciousness", r"qualia",
    r"self[\s-]awareness", r"introspection", r"binding\s+problem", r"higher[\s-]order\s+thought", r"predictive\s+processing",
    r"predictive\s+coding", r"free\s+energy\s+principle", r"default\s+mode\s+network", r"mind\s+wandering",
    r"altered\s+states?\s+of\s+consciousness", r"unconscious\s+processing", r"subliminal\s+perception",
]
CS_KEYWORDS = [
    r"information\s+retrieval", r"knowledge\s+graph", r"semantic\s+search", r"neural\s+network", r"natural\s+language\s+processing",
    r"text\s+classification", r"named\s+entit", r"concept\s+extraction", r"vector\s+search", r"embedding(?:s)?", r"transformer(?:s)?",
    r"language\s+model", r"attention\s+mechanism", r"graph\s+neural", r"retrieval[\s-]augmented", r"question\s+answering",
    r"text\s+summarization", r"sentiment\s+analysis", r"topic\s+model", r"word2vec|glove|fasttext", r"bert|gpt|t5\b",
]

# fixed values: tags of wanted questions
POST_TAGS = (
    "go golang python python-3.x javascript typescript node.js sql sqlite machine-learning deep-learning neural-network nlp "
    "natural-language-processing information-retrieval search elasticsearch full-text-search algorithm data-structures json rest api "
    "linux bash shell"
).split()
