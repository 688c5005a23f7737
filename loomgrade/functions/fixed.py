"""These must equal the values that the ranked and mined collections were made with, for equal results."""

STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "any", "can", "had", "has", "her",
    "was", "one", "our", "out", "use", "uses", "used", "using", "with", "this", "that", "from",
    "into", "your", "them", "they", "then", "than", "when", "what", "which", "while", "will",
    "would", "should", "could", "have", "how", "its", "via", "per", "etc", "such", "also",
    "each", "more", "most", "some", "only", "over", "under", "between", "about", "after",
    "before", "during",
)
SALIENCE_PHRASES = ("always ", "never ", "prefer ", "don't ", "do not ", "i want ", "avoid ", "make sure ", "please use ", "please don't ", "please never ", "please always ")
PREFERENCE_PHRASES = ("always ", "never ", "prefer ", "don't ", "do not ", "i want ", "use ", "avoid ", "make sure ", "please use ", "please don't ", "please never ", "please always ")
SCOPING_PHRASES = ("this project", "this repo", "our repo", "this codebase", "our codebase", "here ", "in this ", "for this ")
REFUSED_SPEAKERS = ("system", "System", "SYSTEM")
REFUSED_PREFIXES = ("Ignore previous instructions", "You are now", "Override", "SYSTEM PROMPT", "New instructions", "Disregard")
GENERIC_DIRECTORIES = ("home", "root", "tmp", "var", "usr", "opt", "etc", "srv", "data", "workspace", "work", "projects", "repos", "src", "code")
LIFECYCLE_FILES = ("SKILL.md", "SKILL.md.pending", "SKILL.md.rejected", "SKILL.md.retired")
IGNORED_DIRECTORIES = (
    ".git",
    "target",
    "node_modules",
    ".github",
    ".claude",
    ".opencode",
    ".cursor",
    ".continue",
    ".aider",
    ".codeium",
    ".windsurf",
    ".gemini",
    ".amazonq",
)
SECTIONS = {"## procedures": "procedure", "## conventions": "convention", "## assets": "asset", "## evidence": "evidence", "## summary": "summary"}
CAUTION_CUES = (
    "never", "don't", "do not", "avoid", "not ", "instead of", "warning", "failure mode", "dangerous", "caution",
    "beware", "prohibited", "forbidden", "should not", "must not", "rather than",
)
ENDORSEMENT_CUES = (
    "run ", "execute ", "use ", "call ", "invoke ", "to clean up", "clean up using", "clean up with", "you can run",
    "you should run", "we can run", "try running", "simply run", "just run",
)
SYSTEM_DIRECTORIES = ("home", "usr", "var", "tmp", "opt", "etc", "root", "srv")
COMMAND_LANGUAGES = {
    "Rust": ("cargo ", "rustc ", "rust-analyzer"),
    "TypeScript": ("npm ", "yarn ", "pnpm "),
    "Python": ("python ", "pip ", "uv "),
    "Go": ("go build", "go test"),
    "Java": ("mvn ", "gradle "),
}
EXTENSION_LANGUAGES = {
    "Rust": (".rs",),
    "TypeScript": (".ts", ".tsx"),
    "JavaScript": (".js", ".jsx"),
    "Python": (".py",),
    "Go": (".go",),
    "Java": (".java",),
}
