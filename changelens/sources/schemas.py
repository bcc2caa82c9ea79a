"""Schemas of the interchange files and the columns of each table, in file order."""

from __future__ import annotations

# Interchange tables as (native column, file column, type).  Lists
# are ";"-joined strings in files and arrays in the engine.
_COMMIT = [
    ("slug", "SLUG", "string"), ("sha", "SHA", "string"), ("ts", "TIMESTAMP", "timestamp"),
    ("author_id", "AUTHOR_ID", "string"), ("committer_id", "COMMITTER_ID", "string"),
    ("message", "MESSAGE", "string"), ("num_parents", "NUM_PARENTS", "int"),
    ("num_additions", "NUM_ADDITIONS", "bigint"), ("num_deletions", "NUM_DELETIONS", "bigint"),
    ("num_files_changed", "NUM_FILES_CHANGED", "bigint"), ("files", "FILES", "array<string>"),
    ("src_loc_added", "SRC_LOC_ADDED", "bigint"), ("src_loc_deleted", "SRC_LOC_DELETED", "bigint"),
    ("num_src_files_touched", "NUM_SRC_FILES_TOUCHED", "bigint"), ("src_files", "SRC_FILES", "array<string>"),
]
TABLES = {
    "issues": [
        ("slug", "SLUG", "string"), ("id", "ID", "bigint"), ("number", "NUMBER", "int"),
        ("state", "STATE", "string"), ("created_at", "CREATED_AT", "issue_time"),
        ("closed_at", "CLOSED_AT", "issue_time"), ("created_by_login", "CREATED_BY_LOGIN", "string"),
        ("closed_by_login", "CLOSED_BY_LOGIN", "string"), ("assignee_login", "ASSIGNEE_LOGIN", "string"),
        ("title", "TITLE", "string"), ("num_comments", "NUM_COMMENTS", "int"),
        ("labels", "LABELS", "array<string>"), ("is_pl", "IS_PL", "boolean"),
    ],
    "comments": [
        ("slug", "SLUG", "string"), ("issue_id", "ISSUE_ID", "bigint"), ("issue_number", "ISSUE_NUMBER", "int"),
        ("comment_id", "COMMENT_ID", "bigint"), ("body", "BODY", "string"), ("created_at", "CREATED_AT", "timestamp"),
        ("updated_at", "UPDATED_AT", "timestamp"), ("user_login", "USER_LOGIN", "string"),
        ("user_id", "USER_ID", "bigint"),
    ],
    "commits": _COMMIT,
    "blamed_commit": _COMMIT,
    "commit_files": [
        ("slug", "SLUG", "string"), ("sha", "SHA", "string"), ("commit_file", "COMMIT_FILE", "string"),
        ("loc_ins", "LOC_INS", "bigint"), ("loc_del", "LOC_DEL", "bigint"), ("lang", "LANG", "int"),
    ],
    "issue_links": [
        ("slug", "SLUG", "string"), ("commit_sha", "COMMIT_SHA", "string"), ("line_num", "LINE_NUM", "int"),
        ("issue_number", "ISSUE_NUMBER", "int"), ("issue_is_pl", "ISSUE_IS_PL", "boolean"),
        ("delta_open", "DELTA_OPEN", "double"), ("delta_closed", "DELTA_COLSED", "double"),
    ],
    "blames_commit": [
        ("slug", "SLUG", "string"), ("bug_fixing_commit", "BUG_FIXING_COMMIT", "string"), ("path", "PATH", "string"),
        ("type", "TYPE", "int"), ("blamed_commit", "BLAMED_COMMIT", "string"),
        ("num_blamed_lines", "NUM_BLAMED_LINES", "bigint"),
    ],
    "contributors": [
        ("slug", "SLUG", "string"), ("contributor_id", "CONTRIBUTOR_ID", "string"), ("name", "NAME", "string"),
        ("email", "EMAIL", "string"),
    ],
    "cross_references": [("slug", "SLUG", "string"), ("ref", "REF", "string"), ("type", "TYPE", "string")],
}
