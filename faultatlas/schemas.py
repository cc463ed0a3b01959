"""Spark DDL of the tables the operators exchange.

``repo_key`` is in every table, so one query covers a whole corpus of
repositories.
"""

FILES = (
    "repo_key string, path string, language string, size bigint, "
    "service_boundary string, is_test boolean, content string"
)

# One wide, nullable row per fact that the Python parser reports; ``kind`` is one
# of symbol, class, import, call, error.
PARSED = (
    "repo_key string, file string, kind string, ord int, "
    "name string, qualified_name string, owner_class string, "
    "line_start int, line_end int, signature string, complexity int, "
    "decorators array<string>, bases array<string>, methods array<string>, "
    "is_from boolean, module string, imported string, asname string, "
    "chain array<string>, local_target string, dotted string, "
    "error_message string, error_column int, error_text string"
)

NODES = "repo_key string, node_id string, node_type string, file string, attrs map<string,string>"

EDGES = (
    "repo_key string, src string, dst string, edge_type string, resolved boolean, "
    "confidence string, pass_no int, src_file string, dst_file string, dst_type string"
)

FINDINGS = (
    "repo_key string, finding_id string, issue_class string, severity string, title string, "
    "description string, file_path string, line_number int, `column` int, code_snippet string, "
    "tool_source string, rule_id string, confidence double, suggested_fix string, "
    "evidence string, root_cause string, source_priority int, seq bigint"
)

MEMORY = (
    "fix_id string, repo_key string, bug_type string, root_cause string, fix_strategy string, "
    "affected_file string, confidence_score double, finding_id string, files_changed string, "
    "validation_summary string, validated_at timestamp"
)

# What the task of one file reports; problems are codes with figures, their sentences are made later.
APPLIED = (
    "patch_id string, file_path string, new_content string, unified_diff string, edits_applied int, edits_total int, "
    "problems array<struct<code:string,edit:int,figure:int,total:int,near:string>>, ok boolean, first_seq int"
)

EVENTS = (
    "job_id string, event_type string, ts timestamp, agent_name string, phase string, "
    "message string, details map<string,string>"
)
