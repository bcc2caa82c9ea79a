"""The given tables seen as a change history.

Orders are commits, line items are changed files, customers are developers,
events are issues, conversations and documents are discussions.  Every view
covers its whole tables and is plain SQL that Spark and DuckDB both run, so
the same text feeds the queries and their checks.  Bucket sizes (people with
one name, one address, ...) stay the same as the tables grow, but for one
address that a fixed share of all people use.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from changelens.at_once import at_once
from changelens.operators.changes import COMMIT
from changelens.scratch import settle_at, settle_by
from changelens.session import CO_PARTITIONED

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _group(column: str, size: int) -> str:
    """Number of the group of ``size`` consecutive values that a column's value falls into."""
    return f"cast(({column} - {column} % {size}) / {size} as bigint)"


def _project(key: str) -> str:
    return f"concat('org', {key} % 5, '/proj', {key} % 25)"


VIEWS = {
    "vw_person": f"""
        select c_custkey, concat('org', c_nationkey % 5, '/proj', c_nationkey) as slug, name, email,
          md5(concat(lower(name), lower(email))) as contributor_id
        from (select c_custkey, c_nationkey,
            case when c_custkey % 97 = 0 then 'github'
                 when c_custkey % 13 = 0 then translate(substr(md5(cast({_group('c_custkey', 39)} as string)), 1, 8),
                   '0123456789abcdef', 'ABCDEFGHIJKLMNOP')
                 when c_custkey % 7 = 0 then concat('dev', {_group('c_custkey', 5)} + 1)
                 when c_custkey % 7 = 1 then concat(' Dev', {_group('c_custkey', 5)}, ' ')
                 else concat('dev', {_group('c_custkey', 4)}, ' ', lower(c_mktsegment)) end as name,
            case when c_custkey % 97 = 0 then 'noreply@github.com'
                 when c_custkey % 11 = 0 then 'none'
                 when c_custkey % 19 = 0 then 'Team@shared.org'
                 when c_custkey % 23 = 0 then concat('dev', c_custkey, '@example.com')
                 when c_custkey % 29 = 0 then concat('dev', c_custkey, '.(none)')
                 when c_custkey % 3 = 0 then concat('dev', {_group('c_custkey', 5)}, '@host', {_group('c_custkey', 8)}, '.org')
                 else concat('d', {_group('c_custkey', 6)}, '.x@mail', {_group('c_custkey', 9)}, '.com') end as email
          from customer) p""",
    "vw_contributors": "select distinct slug, contributor_id, name, email from vw_person",
    "vw_commits": f"""
        select o_orderkey, {_project('o_orderkey')} as slug, md5(cast(o_orderkey as string)) as sha, o_orderdate as ts,
          p.name as author_name, p.email as author_email,
          case when o_orderkey % 5 = 0 then 'GitHub' else p.name end as committer_name,
          case when o_orderkey % 5 = 0 then 'noreply@github.com' else p.email end as committer_email,
          p.contributor_id as author_id,
          concat('  Update module', chr(10),
            case when o_orderkey % 4 = 0 then concat('Fixes #', {_group('o_orderkey', 75)}, ', #', {_group('o_orderkey', 75)})
                 when o_orderkey % 4 = 1 then concat('closes GH-', {_group('o_orderkey', 75)}, ' not xGH-1')
                 else concat('refs (org', o_custkey % 5, '/proj', o_custkey % 25, '#', {_group('o_orderkey', 75)}, ')') end,
            chr(10), 'See (#', {_group('o_orderkey', 80)}, ') for ', o_orderpriority, chr(10)) as message,
          case when o_orderkey % 50 = 0 then 0 else 1 + o_orderkey % 2 end as num_parents
        from orders join vw_person p on o_custkey = p.c_custkey""",
    "vw_line": """
        select l_orderkey, l_linenumber, max(l_partkey) as l_partkey, sum(cast(l_quantity as int)) as qty
        from lineitem group by l_orderkey, l_linenumber""",
    "vw_file_changes": """
        select c.slug, c.sha, c.ts, l_linenumber as patch_pos, path as old_path, path as new_path, is_binary,
          cast(case when is_binary then 0 else qty end as bigint) as loc_ins,
          cast(case when is_binary then 0 else -l_linenumber end as bigint) as loc_del,
          l_orderkey, l_partkey, cast(qty as int) as qty
        from (select l_orderkey, l_linenumber, l_partkey, qty, l_partkey % 23 = 0 as is_binary,
            concat(case p_partkey % 6 when 0 then 'src' when 1 then 'docs' when 2 then 'test' when 3 then 'lib'
                     when 4 then 'app/media' else 'app/src' end,
              '/', replace(p_name, ' ', '_'), l_partkey % 3,
              case l_partkey % 27 when 0 then '.py' when 1 then '.java' when 2 then '.md' when 3 then '.h' when 4 then '.rb'
                when 5 then '.cfg' when 6 then '.c' when 7 then '.txt' when 8 then '.css' when 9 then '.html' when 10 then '.json'
                when 11 then '.xml' when 12 then '.yml' when 13 then '.ts' when 14 then '.sql' when 15 then '.rs' when 16 then '.kt'
                when 17 then '.php' when 18 then '.inc' when 19 then '.unlisted' when 20 then '.tar.gz' when 21 then '/Dockerfile'
                when 22 then '/Gemfile' when 23 then '/.vimrc' when 24 then '/NOTICE' when 25 then '.mm' else '' end) as path
          from vw_line join part on l_partkey = p_partkey) l
        join vw_commits c on l_orderkey = c.o_orderkey""",
    "vw_issues": f"""
        select {_project('event_id')} as slug, {_group('event_id', 50)} as number, event_id as version,
          cast(make_date(cast(1992 + event_id % 5 as int), cast(1 + event_id % 12 as int), 1) as timestamp) as created_at,
          case when event_id % 29 = 0 then null else
            cast(make_date(cast(1997 + event_id % 5 as int), cast(1 + event_id % 12 as int), 15) as timestamp) end as closed_at,
          case event_type when 'error' then 'fix' when 'click' then 'ui;retain' when 'view' then 'question' else '' end as labels,
          event_type = 'purchase' as is_pl
        from events""",
    "vw_comments": f"""
        select {_project('conv_id')} as slug, conv_id as issue_number, conv_id * 1000 + turn as comment_id,
          concat(text, ' see org', turn % 5, '/proj', conv_id % 7, '#', conv_id % 31, ' and (org1/proj1@', turn, 'ab)') as body
        from conversations
        union all
        select {_project('doc_id')}, doc_id, doc_id * 1000 + 999,
          concat(text, ' cf. [org', doc_id % 5, '/proj', doc_id % 7, '#', doc_id, '] x/y@abc12 a/b#1,c/d#2')
        from documents""",
    "vw_aliases": """
        select p.contributor_id as uid, e.rep
        from (select distinct contributor_id, email from vw_person) p
        join (select email, min(contributor_id) as rep from vw_person group by email) e on p.email = e.email""",
    "vw_blame_hunks": """
        select slug, sha as fix_sha, old_path as path, patch_pos, cast(patch_pos * 10 as int) as start_line,
          cast(1 + qty % 4 as int) as num_lines, md5(cast(l_orderkey - 25 * (1 + l_partkey % 50) as string)) as blamed_sha
        from vw_file_changes""",
    "vw_moves": """
        select slug, sha, ts, patch_pos, concat('f', l_partkey % 12, '.', l_partkey % 3) as old_path,
          concat('f', l_partkey % 12, '.', (l_partkey + case when l_orderkey % 4 = 0 then 1 else 0 end) % 3) as new_path,
          concat('x = ', qty % 7) as removed, concat('x = ', l_partkey % 7) as added
        from vw_file_changes""",
    "vw_wide_hunks": """
        select slug, fix_sha, path, patch_pos, blamed_sha, cast(case when start_line % 4 = 0 then 1 else start_line end as int) as start_line,
          cast(case num_lines when 1 then 10000000 when 2 then 40000 when 3 then 600 else num_lines end as int) as num_lines
        from vw_blame_hunks""",
}

_REMOVED_TEXT = """case when n % 3 = 0 then '  # note' when n % 7 = 0 then '' else concat('x = ', n % 7) end"""
_ADDED_TEXT = "concat('x = ', (l_partkey + n) % 7)"


def _diff_lines(rows_between: str) -> str:
    return f"""
        select slug, sha, ts, patch_pos, 0 as hunk_pos, old_path, new_path, is_binary, '-' as origin,
          cast(n as int) as old_lineno, cast(null as int) as new_lineno, {_REMOVED_TEXT} as content
        from (select *, {rows_between.format('patch_pos * 10', 'patch_pos * 10 + qty % 4')} as n
              from vw_file_changes where not is_binary) r
        union all
        select slug, sha, ts, patch_pos, 0, old_path, new_path, is_binary, '+',
          cast(null as int), cast(n as int), {_ADDED_TEXT}
        from (select *, {rows_between.format('patch_pos * 10', 'patch_pos * 10 + qty % 3')} as n
              from vw_file_changes where not is_binary) a
        union all
        select slug, sha, ts, patch_pos, cast(null as int), old_path, new_path, is_binary, cast(null as string),
          cast(null as int), cast(null as int), cast(null as string)
        from vw_file_changes where is_binary"""


# The one view whose text differs: each engine has its own way to count up.
SPARK_VIEWS = {**VIEWS, "vw_diff_lines": _diff_lines("explode(sequence(cast({} as bigint), cast({} as bigint)))")}
DUCKDB_VIEWS = {**VIEWS, "vw_diff_lines": _diff_lines("unnest(range(cast({} as bigint), cast({} as bigint) + 1))")}

# Diff text, Spark only: what vw_diff_lines holds as rows, one patch per row.
SPARK_VIEWS["vw_diff_text"] = f"""
    select slug, sha, patch_pos as first_patch,
      concat('diff --git a/', old_path, ' b/', new_path, chr(10), 'index 1111111..2222222 100644', chr(10),
        case when is_binary then concat('Binary files a/', old_path, ' and b/', new_path, ' differ', chr(10)) else
        concat('--- a/', old_path, chr(10), '+++ b/', new_path, chr(10),
          '@@ -', patch_pos * 10, ',', 1 + qty % 4, ' +', patch_pos * 10, ',', 1 + qty % 3, ' @@', chr(10),
          array_join(transform(sequence(patch_pos * 10, patch_pos * 10 + qty % 4), n -> concat('-', {_REMOVED_TEXT})), chr(10)),
          chr(10),
          array_join(transform(sequence(patch_pos * 10, patch_pos * 10 + qty % 3), n -> concat('+', {_ADDED_TEXT})), chr(10)),
          chr(10)) end) as diff
    from vw_file_changes"""

def _sha(order: str) -> str:
    return f"md5(cast({order} as string))"


def _packed_sha(order: str) -> str:
    """What ``functions.ids.packed`` makes of the ``sha``, which always is a hexadecimal number."""
    return f"concat(X'01', unhex({_sha(order)}))"


def _replaced(text: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        if old not in text:
            raise ValueError(f"no {old!r} in {text}")
        text = text.replace(old, new)
    return text


def _dealt_views(sha: Callable[[str], str]) -> dict[str, str]:
    """The same rows for :class:`WrittenHistory`: dealt out by ``slug, sha`` while they are narrow, and joined where the commits lie."""
    orders, lines = sha("o_orderkey"), sha("l_orderkey")
    return {
        "vw_commits": _replaced(
            VIEWS["vw_commits"],
            ("md5(cast(o_orderkey as string)) as sha", f"{orders} as sha"),
            ("p.contributor_id as author_id", "md5(concat(lower(p.name), lower(p.email))) as author_id"),
            ("from orders join vw_person p on o_custkey = p.c_custkey", f"""from (
          select o_orderkey, o_orderdate, o_custkey, o_orderpriority, name, email
          from orders join vw_person on o_custkey = c_custkey distribute by {_project('o_orderkey')}, {orders}) p"""),
        ),
        "vw_file_changes": _replaced(
            VIEWS["vw_file_changes"],
            ("from (select l_orderkey,", f"from (select *, {_project('l_orderkey')} as at_slug, {lines} as at_sha from (select l_orderkey,"),
            ("on l_partkey = p_partkey) l", f"on l_partkey = p_partkey distribute by {_project('l_orderkey')}, {lines}) p) l"),
            ("on l_orderkey = c.o_orderkey", "on at_slug = c.slug and at_sha = c.sha and l_orderkey = c.o_orderkey"),
        ),
    }


DEALT_VIEWS = _dealt_views(_sha)

# With commits' ids packed, and without the columns that DERIVED adds when they are read.  Nothing reads the author's id.
PACKED_VIEWS = _dealt_views(_packed_sha)
_COMMITTER = """case when o_orderkey % 5 = 0 then 'GitHub' else {name} end as committer_name,
          case when o_orderkey % 5 = 0 then 'noreply@github.com' else {email} end as committer_email"""
PACKED_VIEWS["vw_commits"] = _replaced(
    PACKED_VIEWS["vw_commits"],
    (f"{_COMMITTER.format(name='p.name', email='p.email')},\n", ""), ("md5(concat(lower(p.name), lower(p.email))) as author_id,", ""),
)
PACKED_VIEWS["vw_file_changes"] = _replaced(
    PACKED_VIEWS["vw_file_changes"],
    (" path as new_path,", ""),
    ("cast(case when is_binary then 0 else qty end as bigint) as loc_ins,", ""),
    ("cast(case when is_binary then 0 else -l_linenumber end as bigint) as loc_del,", ""),
)
DERIVED = {
    "vw_commits": f"*, {_COMMITTER.format(name='author_name', email='author_email')}",
    "vw_file_changes": """*, old_path as new_path, cast(case when is_binary then 0 else qty end as bigint) as loc_ins,
          cast(case when is_binary then 0 else -patch_pos end as bigint) as loc_del""",
}
_BLAMED = "md5(cast(l_orderkey - 25 * (1 + l_partkey % 50) as string))"
PACKED_VIEWS["vw_blame_hunks"] = _replaced(VIEWS["vw_blame_hunks"], (_BLAMED, f"concat(X'01', unhex({_BLAMED}))"))


def with_views(sql: str, views: dict[str, str], tables: dict[str, str] | None = None) -> str:
    """Head a statement with the views it needs, in dependency order.

    ``tables`` maps table names to statements that read them, where the engine
    does not know the tables by name.
    """
    known = {**(tables or {}), **views}
    needed: list[str] = []

    def visit(text: str, inside: str = "") -> None:
        for name in known:
            if name not in (inside, *needed) and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                visit(known[name], name)
                needed.append(name)

    visit(sql)
    heads = ",\n".join(f"{name} as ({known[name]})" for name in needed)
    if not heads:
        return sql
    body = sql.lstrip()
    for word in ("with recursive ", "with "):
        if body.lower().startswith(word):
            return f"{word}{heads},\n{body[len(word):]}"
    return f"with {heads}\n{sql}"


@lru_cache(maxsize=None)
def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of a folder; only its plan is kept, never rows."""
    return _view(spark, sf_dir, name, {})


def _view(spark: SparkSession, sf_dir: str, name: str, written: dict[str, str], instead: dict[str, str] | None = None) -> DataFrame:
    sources = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES} | written
    tables = {t: f"select * from {source}" for t, source in sources.items()}
    views = {v: sql for v, sql in (SPARK_VIEWS | (instead or {})).items() if v not in written}
    return spark.sql(with_views(f"select * from {name}", views, tables))


class WrittenHistory:
    """Views of one query, with commits and file changes written out once, bucketed by commit.

    Nearly every step of the longer queries reads these two, as it would read
    given tables in real use; deriving them again each time would be most of
    the work.  What is counted or looked up by commit needs no shuffle then.
    With ``packed`` the ids of commits are bytes (``functions.ids``) in every
    view.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, packed: bool = False):
        self.spark, self.sf_dir, self.written = spark, sf_dir, {}
        self.instead = PACKED_VIEWS if packed else DEALT_VIEWS
        spark.conf.set(CO_PARTITIONED, "false")
        for name in ("vw_commits", "vw_file_changes"):
            at = settle_by(_view(spark, sf_dir, name, self.written, self.instead), *COMMIT)
            self.written[name] = f"(select {DERIVED[name]} from {at})" if packed else at

    def view(self, name: str) -> DataFrame:
        return _view(self.spark, self.sf_dir, name, self.written, self.instead)

    def parts(self, of: DataFrame, part: str) -> dict[bool, Callable[[str], DataFrame]]:
        """The views over two parts of the commits: ``of`` has ``slug, sha`` and a boolean column ``part``.

        Lines and hunks are derived from a part's file changes, so only commits and file changes are dealt out.
        """
        with at_once(self.spark) as begin:
            begun = {name: begin(settle_at, self.view(name).join(of, ["slug", "sha"])) for name in self.written}
            dealt = {name: step.result() for name, step in begun.items()}

        def views(which: bool) -> Callable[[str], DataFrame]:
            written = {n: f"(select * except ({part}) from parquet.`{at}` where {part} = {which})" for n, at in dealt.items()}
            return lambda name: _view(self.spark, self.sf_dir, name, written)

        return {which: views(which) for which in (True, False)}


def oracle(sql: str) -> str:
    return with_views(sql, DUCKDB_VIEWS)
