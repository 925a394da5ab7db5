"""Schemas and fixed values of the code graph."""

from __future__ import annotations

NODES = "id string, name string, file string, start_line int, end_line int, kind string, is_test boolean, complexity double, cognitive double"
EDGES = "src string, dst string, kind string"
FILES = "file string, change_count long, ord long"
TEST_CALLS = "source string, source_name string, source_file string, source_start int, source_end int, source_kind string, source_is_test boolean, target string, strategy string, confidence double, line int, ord long"
TEST_FILES = "test_file string, file string"
SIMILAR = "a string, b string, score double, same_file boolean, ord long"
CO_CHANGES = "file string, partner string, co_changes long, score double, ord long"
SIGNALS = "node_id string, ord int, family string, type string, value double, severity string, text string, tool string, file string, start_line int, end_line int"
FINDINGS = "file string, line int, severity string, message string"

# They must be equal for equal results.
NODE_KINDS = ("Function", "Interface", "Type", "Module")
EDGE_KINDS = ("CALLS", "IMPORTS", "USAGE")
CALLER_KINDS = ("CALLS", "USAGE")
USE_KIND_RANK = {"CALLS": 0, "USAGE": 1, "IMPORTS": 2}
DEFAULT_HOPS = 2
ENTRY_MIN_REACH, ENTRY_MAX, LOADED_BY_SHOWN, PINS_MAX = 3, 12, 3, 50
DEPENDENTS_MAX = 200
CROSS_SECTION_MAX = 20
CO_CHANGE_MIN, CO_CHANGE_SCORE, CO_CHANGE_MAX = 5, 0.5, 20
SIMILAR_SCORE, SIMILAR_MAX = 0.9, 20
USED_BY_MAX_AGENT, USED_BY_MAX_UI = 50, 200
TESTED_BY_MAX = 20
EVIDENCE_CONFIDENCE = 0.9
EVIDENCE_STRATEGIES = ("import_map", "lsp_ts_import", "lsp_ts_jsx_import")
EVIDENCE_FRAGMENTS = (".test.", ".spec.", "_test.", "test_", "_spec.", "Test.", "Tests.", "IT.", "__tests__/", "tests/", "test/", "spec/", "e2e/", "cypress/", "playwright/")
SEVERE_COMPLEXITY, SEVERE_COGNITIVE = 21, 15
BLAST_FLOOR, HOTSPOT_FLOOR, CO_CHANGE_FLOOR = 10, 10, 3
HEALTH_CLUSTERS, HEALTH_MEMBERS = 12, 8
REVIEW_AFFECTED_MAX = 50
REVEAL_TWO_LAYERS, REVEAL_LAYER, REVEAL_RELATIONS = 12, 30, 3
PARTITION_LEAST, COMMUNITY_LEAST, POOL_LEAST, LABEL_SHARE = 40, 4, 2, 0.5
LOUVAIN_PASSES, LOUVAIN_LEVELS = 32, 16
RELATIONS_MAX, SEEDS_MAX = 50, 1000
BACKEND_ROWS_MAX = 100_000
SOURCE_CHARS_MAX = 8000
LOD_CELL, VIEW_MARGIN = 400.0, 0.5
HISTORY_MAX, RECENT_MAX = 500, 10
SEVERITY_RANK = {"blocker": 0, "major": 1, "minor": 2, "info": 3}
REVIEW_BOT_SEVERITY = {"blocker": "blocker", "critical": "blocker", "major": "major", "high": "major", "minor": "minor", "medium": "minor", "info": "info", "low": "info", "nit": "info", "nitpick": "info", "suggestion": "info"}
PR_BOT_SEVERITY = {"high": "blocker", "critical": "blocker", "medium": "major", "moderate": "major", "low": "minor", "minimal": "info"}
TEST_DIRECTORIES = ("__tests__", "test", "tests", "spec", "__mocks__", "e2e", "cypress", "playwright")
TEST_SUPPORT_STEMS = ("testrender", "test-utils", "testutils", "setuptests", "jest.setup", "vitest.setup")
TEST_FILE_PATTERNS = (
    r"(?i)\.(test|spec)\.",
    r"(?i)_test\.go$",
    r"(?i)^test_.*\.py$",
    r"(?i)_test\.py$",
    r"(?i)^conftest\.py$",
    r"(?i)_spec\.rb$",
    r"(Tests?|IT)\.([jJ][aA][vV][aA]|[kK][tT])$",
    r"Tests\.[cC][sS]$",
)
#: What counts as white space in texts of the map.
SPACES = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
CLIPPED = "\n… (truncated)"
MINUTE_MS, HOUR_MS, DAY_MS, AGE_DAYS_MAX, AGE_TICK_MAX_MS = 60_000, 3_600_000, 86_400_000, 365, 60_000
#: Shapes of a review bot's Markdown: places in free text, the line that states the risk, the parts of the issue list.
TICKED_PLACE = r"`([^`\s]+\.[A-Za-z0-9]+):(\d+)`"
TICKED_FILE = r"`([^`\s]+\.[A-Za-z0-9]+)`"
BARE_PLACE = r"\b([^\s:]+\.[A-Za-z0-9]+):(\d+)\b"
LINE_MENTION = r"(?i)\blines?\s*[:#]?\s*(\d+)\b"
RISK_LINE = r"(?i)risk[^\n]*?\b(low|medium|high)\b"
FENCE_MARK = r"^\s{0,3}```"
ISSUES_START = "(?i)key issues to review"
ISSUES_END = r"^\s{0,3}#{1,6}\s|(?i)</details>"
ISSUE_BULLET = r"^\s{0,3}(?:[-*]|\d+\.)\s+(\S.*)$"
#: The header of a table of rows in a backend's text reply.
REPLY_HEADER = r"^rows:\s*(\d+)\s*\(cols:\s*([^)]*)\)"
