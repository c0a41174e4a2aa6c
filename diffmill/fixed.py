"""Texts, lists and limits that results must carry exactly.

They are stated plainly here so that every operator reads the same ones.
"""

# Domains of the stored columns, in declaration order (severity rank = position).
STATUSES = ("pending", "running", "done", "failed")
FINISHED = ("done", "failed")
FINDING_TYPES = ("code_smell", "security_issue", "suggestion", "best_practice")
SEVERITIES = ("low", "medium", "high", "critical")

# Words that decide a finding type, tested in this order.
TYPE_WORDS = (
    (("error", "issue", "bug"), "code_smell"),
    (("security", "vulnerability"), "security_issue"),
    (("best", "practice", "pattern"), "best_practice"),
)

# Source files.
LANGUAGES = {
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".py": "python",
}
MEASURED_LANGUAGES = ("javascript", "typescript")
SKIPPED_DIRECTORY = "node_modules"

# Decision points: keywords before "(", and operators.
DECISION_KEYWORDS = ("if", "for", "while", "switch", "catch")
DECISION_OPERATORS = ("&&", "||", "?")

# White space of ECMAScript's \s beyond ASCII.
UNICODE_SPACES = r"\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

# Latency histogram bounds in milliseconds.
LATENCY_BOUNDS_MS = (100, 500, 1000, 2000, 5000, 10000, 30000)

# Topics.
REQUEST_TOPIC = "code-review-requests"
STATIC_TOPIC = "static-analysis-results"

# Scores and bands.
DEFAULT_SCORE = 80
GOOD_SCORE = 80
FAIR_SCORE = 60

# Diagrams.
EMPTY_DIAGRAM = "@startuml\n@enduml"
DEFAULT_DIAGRAM = (
    "@startuml\nclass CodeReview {\n  +quality_score: int\n  +findings: List\n}\n@enduml"
)

# Response used when no model is configured or its answer is unusable.
CANNED_RESPONSE = {
    "quality_score": 80,
    "findings": [
        {
            "type": "suggestion",
            "severity": "low",
            "file_path": None,
            "line_number": None,
            "message": "Consider adding more detailed comments to improve code readability",
            "suggestion": "Add docstrings and inline comments where complex logic exists",
        }
    ],
    "plantuml": DEFAULT_DIAGRAM,
}

# Response used when the model service itself cannot be reached.
UNREACHABLE_RESPONSE = {
    "quality_score": 85,
    "findings": [
        {
            "type": "code_smell",
            "severity": "medium",
            "file_path": "README.md",
            "line_number": 5,
            "message": "Consider adding more detailed documentation",
            "suggestion": "Add examples and usage instructions to improve clarity",
        },
        {
            "type": "best_practice",
            "severity": "low",
            "file_path": None,
            "line_number": None,
            "message": "Good use of clear commit messages",
            "suggestion": "Continue following conventional commit format",
        },
        {
            "type": "suggestion",
            "severity": "low",
            "file_path": "README.md",
            "line_number": 1,
            "message": "Consider adding a table of contents for better navigation",
            "suggestion": "Add ToC links for sections",
        },
    ],
    "plantuml": DEFAULT_DIAGRAM,
}

# Texts around the diff in a review prompt.
PROMPT_BEFORE = "Review the following code diff and provide a structured analysis:\n\n"
PROMPT_AFTER = (
    "\n\nPlease analyze the code changes and provide:\n"
    "1. A quality score (0-100)\n"
    "2. List of findings (code smells, security issues, suggestions)\n"
    "3. A PlantUML diagram representation\n\n"
    "Return the response in JSON format."
)
SYSTEM_PROMPT = (
    "You are a code review assistant. Analyze the provided code diff and return a JSON response with:\n"
    "- quality_score: integer (0-100)\n"
    "- findings: array of objects with type, severity, message, suggestion (optional), "
    "file_path (optional), line_number (optional)\n"
    "- plantuml: string with PlantUML diagram code\n\n"
    "IMPORTANT: The 'type' field must be one of: 'code_smell', 'security_issue', 'suggestion', "
    "or 'best_practice'\n"
    "The 'severity' field must be one of: 'low', 'medium', 'high', or 'critical'\n\n"
    "Return ONLY valid JSON, no markdown formatting."
)

# Parts of a rendered review comment. The signature line is a setting (see README).
COMMENT_HEADING = "## 🤖 AI Code Review\n\n"
COMMENT_SCORE = ("**Quality Score:** ", "/100\n\n")
COMMENT_LIST_HEADING = "### Top Suggestions:\n\n"
COMMENT_SUGGESTION = "\n   💡 *Suggestion:* "
COMMENT_NO_ISSUES = "✅ No major issues found!\n\n"
COMMENT_RULE = "---\n"
COMMENT_SIGNATURE = "*Generated by automated code review*"

# Header lines of a rebuilt diff for a file whose whole content is new.
NEW_FILE_MODE = "new file mode 100644"
EMPTY_BLOB = "0000000"
