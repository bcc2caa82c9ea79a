"""SQL counterparts of the registered queries, for DuckDB over the same tables.

Written from the definitions, with plain joins, self-joins and correlated
groupings, not from the Spark plans.
"""

from __future__ import annotations

from changelens.functions import fixed_values as V
from drivercheck.views import DUCKDB_VIEWS, with_views


def _base(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def _ext(base: str) -> str:
    body = f"ltrim({base}, '.')"
    return f"(case when contains({body}, '.') then concat('.', string_split({body}, '.')[-1]) else '' end)"


def _root(base: str) -> str:
    return f"left({base}, length({base}) - length({_ext(base)}))"


def _any(path: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains({path}, '{p}')" for p in parts) + ")"


def _in(value: str, items: list[str]) -> str:
    return f"{value} in (" + ", ".join(f"'{i}'" for i in items) + ")"


def _label(path: str) -> str:
    base = _base(path)
    popular = sorted({e for exts in V.POPULAR_EXTENSIONS.values() for e in exts})
    return f"""cast(case when contains({path}, '/.git/') then -1
        when {_any(path, V.MEDIA_PATHS)} then 2 when {_any(path, V.DOC_PATHS)} then 2
        when {_in(_ext(base), V.DOC_EXTENSIONS)} then 2 when {_in(_root(base), V.DOC_NAMES)} then 2
        when {_any(path, V.TEST_PATHS)} then 1 when {_any(path, V.SOURCE_PATHS)} then 0
        when {_in(_ext(base), popular)} then 0 else 3 end as int)"""


def _language(base: str) -> str:
    """First language by name that lists the extension or, as an extension, the root; else the file name."""
    listed = [
        (lang, kind, value)
        for kind, table in (("e", V.POPULAR_EXTENSIONS), ("e", V.OTHER_EXTENSIONS), ("f", V.FILE_NAMES))
        for lang, values in table.items()
        for value in values
    ]
    rows = ", ".join(f"('{lang}', '{kind}', '{value}')" for lang, kind, value in listed)
    return f"""coalesce((select min(lang) from (values {rows}) t(lang, kind, v)
        where ({_ext(base)} <> '' and kind = 'e' and v in ({_ext(base)}, {_root(base)}))
           or ({_ext(base)} = '' and kind = 'f' and v = {_root(base)})), 'ambiguous')"""


def _line_label(line: str) -> str:
    return rf"""cast(case when regexp_matches(translate({line}, concat(chr(13), chr(10)), ''),
        '^[ \t]*(#|\\\*|\*\*|//|/\*|$)') then 1 else 0 end as int)"""


_WEEK = "cast((year(ts) - 1990) * 52 + cast(strftime(ts, '%U') as int) as int)"
_MONTH = "cast((year(ts) - 1990) * 12 + month(ts) as int)"
_DAY = "strftime(ts, '%Y-%m-%d')"
_BLANK = r"concat(' ', chr(9), chr(10), chr(13))"

STEPS = {
    "o_commits": "select * from vw_commits where num_parents > 0",
    "o_mentions": r"""
        select slug, sha, ts, cast(line_num as int) as line_num, unnest(list_distinct(list_concat(
            [cast(d as bigint) for d in regexp_extract_all(line, '[^a-zA-Z0-9_#/]#(\d+)\b', 1)],
            [cast(d as bigint) for d in regexp_extract_all(line, '\bGH-(\d+)\b', 1)]))) as number
        from (select slug, sha, ts, num_parents, unnest(string_split(message, chr(10))) as line,
                generate_subscripts(string_split(message, chr(10)), 1) as line_num from vw_commits) l""",
    "o_issues": """
        select slug, number, created_at, closed_at, labels, is_pl from vw_issues i
        where version = (select max(version) from vw_issues j where j.slug = i.slug and j.number = i.number)""",
    "o_links": """
        select m.slug, m.sha as commit_sha, line_num, m.number as issue_number, is_pl as issue_is_pl,
          cast(epoch(m.ts) - epoch(created_at) as double) as delta_open,
          cast(epoch(m.ts) - epoch(closed_at) as double) as delta_closed
        from o_mentions m join o_commits c on m.sha = c.sha and m.slug = c.slug and m.ts = c.ts
        join o_issues i on m.slug = i.slug and m.number = i.number""",
    "o_fixes": """
        select distinct l.slug, commit_sha as sha from o_links l
        join o_issues i on l.slug = i.slug and l.issue_number = i.number
        where delta_open > 0 and delta_closed <= 0 and not issue_is_pl
          and (labels = '' or list_has_any(string_split(labels, ';'), ['fix', 'bug-fix', 'retain']))""",
    "o_files": f"""
        select slug, sha, patch_pos, {_base('new_path')} as file, loc_ins, loc_del, is_binary,
          {_label('new_path')} as path_label, {_label(_base('new_path'))} as lang from vw_file_changes""",
    "o_facts": f"""
        select c.slug, c.sha, c.ts, md5(concat(lower(author_name), lower(author_email))) as author_id,
          md5(concat(lower(committer_name), lower(committer_email))) as committer_id, trim(message, {_BLANK}) as message,
          num_parents, cast(coalesce(t.ins, 0) as bigint) as num_additions, cast(coalesce(t.dels, 0) as bigint) as num_deletions,
          coalesce(t.files, 0) as num_files_changed, cast(coalesce(t.src_ins, 0) as bigint) as src_loc_added,
          cast(coalesce(t.src_dels, 0) as bigint) as src_loc_deleted, coalesce(t.src_files, 0) as num_src_files_touched
        from o_commits c left join (
          select slug, sha, sum(loc_ins) as ins, sum(-loc_del) as dels, count(*) as files,
            sum(loc_ins) filter (where not is_binary and path_label <> 2) as src_ins,
            sum(-loc_del) filter (where not is_binary and path_label <> 2) as src_dels,
            count(*) filter (where not is_binary and path_label <> 2) as src_files
          from o_files group by slug, sha) t on c.slug = t.slug and c.sha = t.sha""",
    "o_origins": """
        select slug, sha as blamed_sha from o_facts where num_files_changed < 50 and num_additions < 200""",
    "o_removed": f"""
        select d.slug, d.sha as fix_sha, d.ts, d.old_path as path, {_label('d.old_path')} as type, patch_pos, hunk_pos,
          old_lineno, content, {_line_label('content')} as line_label
        from vw_diff_lines d join o_fixes f on d.slug = f.slug and d.sha = f.sha
        where origin = '-' and not is_binary and {_label(_base('new_path'))} <> 1 and {_label('old_path')} <> 2""",
    "o_blamed_lines": """
        select r.*, h.blamed_sha from o_removed r join vw_blame_hunks h on r.slug = h.slug and r.fix_sha = h.fix_sha
          and r.path = h.path and r.old_lineno between h.start_line and h.start_line + h.num_lines - 1
        join o_origins o on h.slug = o.slug and h.blamed_sha = o.blamed_sha""",
    "o_blames": """
        select slug, fix_sha as bug_fixing_commit, path, type, blamed_sha as blamed_commit, count(*) as num_blamed_lines
        from o_blamed_lines where line_label = 0 group by slug, fix_sha, path, type, blamed_sha""",
    "o_contributors": """
        select slug, contributor_id, name, email from (
          select *, row_number() over (partition by slug, contributor_id order by name desc, email desc) as rn from (
            select distinct slug, md5(concat(lower(author_name), lower(author_email))) as contributor_id,
              lower(author_name) as name, lower(author_email) as email from o_commits
            union
            select distinct slug, md5(concat(lower(committer_name), lower(committer_email))),
              lower(committer_name), lower(committer_email) from o_commits) p) q where rn = 1""",
    "o_induced_rows": """
        select coalesce(a.rep, c.author_id) as user_id, b.slug, b.blamed_commit as sha, l.issue_number,
          b.bug_fixing_commit as fixing_sha
        from o_blames b join vw_commits c on b.slug = c.slug and b.blamed_commit = c.sha
        join o_links l on b.slug = l.slug and b.bug_fixing_commit = l.commit_sha
        join o_contributors p on c.slug = p.slug and c.author_id = p.contributor_id
        left join {aliases} a on c.author_id = a.uid
        where b.type <> 2 and not (p.name = 'github' and p.email = 'noreply@github.com')""",
    "o_user_commits": f"""
        select coalesce(a.rep, f.author_id) as user_id, f.slug as project, f.*, {_DAY} as day, {_WEEK} as week, {_MONTH} as month
        from o_facts f left join {{aliases}} a on f.author_id = a.uid""",
    # Files that change their names: what lies at a path, from one second to another, and what it was before.
    "o_timed_moves": "select *, cast(epoch(ts) as bigint) as sec from vw_moves",
    "o_renames": """
        select slug, old_path, sec, min(new_path) as new_path from o_timed_moves where old_path <> new_path group by slug, old_path, sec""",
    "o_starts": """
        select slug, path, sec, min(before) as before from (select slug, new_path as path, sec, old_path as before from o_renames
          union all select slug, old_path, sec, null from o_renames) s group by slug, path, sec""",
    "o_spans": """
        select slug, path, sec as since, coalesce(lead(sec) over (partition by slug, path order by sec), 1000000000000) as until, before from o_starts
        union all
        select p.slug, p.path, -1000000000000, coalesce(min(s.sec), 1000000000000), null
        from (select slug, old_path as path from vw_moves union select slug, new_path from vw_moves) p
        left join o_starts s on p.slug = s.slug and p.path = s.path group by p.slug, p.path""",
    "o_trace": """
        select a.slug, a.old_path as asked_path, a.sec as asked_at, s.path, s.since, s.until, s.before
        from (select distinct slug, old_path, sec from o_timed_moves) a
        join o_spans s on a.slug = s.slug and a.old_path = s.path and s.since < a.sec and a.sec <= s.until
        union all
        select t.slug, t.asked_path, t.asked_at, s.path, s.since, s.until, s.before
        from o_trace t join o_spans s on t.slug = s.slug and t.before = s.path and s.since < t.since and t.since <= s.until""",
    # Identities.
    "o_ids": rf"""
        select uid, login, login as name, is_real, email,
          nullif(case when contains(email, '@') then string_split(email, '@')[1] end, '') as prefix,
          nullif(case when contains(email, '@') then string_split(email, '@')[-1] end, '') as domain
        from (select contributor_id as uid, trim(name, {_BLANK}) as login, not regexp_matches(name, '^[A-Z]{{8}}$') as is_real,
            case when e in ('', 'none') or ends_with(e, '@server.fake') or ends_with(e, '@server.com')
                   or ends_with(e, '@example.com') or ends_with(e, '@email.com')
                   or (ends_with(e, '.(none)') and not regexp_matches(e,
                     '[^@ ()]+@([a-z0-9]([a-z0-9-]*[a-z0-9])?[.])+[a-z0-9]'))
                 then null else e end as email
          from (select *, lower(trim(email, {_BLANK})) as e, row_number() over (
                partition by contributor_id order by name desc, email desc) as rn
              from vw_contributors where not (name = 'github' and email = 'noreply@github.com')) c where rn = 1) i""",
    "o_login": """
        select distinct key, uid, email from (select login as key, uid, email from o_ids
          union all select lower(login), uid, email from o_ids where is_real) k""",
    "o_name": """
        select distinct key, uid, email from (select name as key, uid, email from o_ids where name <> ''
          union all select lower(name), uid, email from o_ids where name <> '' and not contains(name, ' ')) k""",
    "o_simple": """
        select prefix as key, uid, email from o_ids where prefix is not null and not (contains(prefix, '.') or contains(prefix, '_'))""",
    "o_comp": """
        select prefix as key, uid, email from o_ids where contains(prefix, '.') or contains(prefix, '_')""",
    "o_domain": "select domain as key, uid, email from o_ids where domain is not null",
    "o_buckets": """
        select space, key, count(*) as n from (select 'login' as space, key from o_login union all select 'name', key from o_name
          union all select 'simple_prefix', key from o_simple union all select 'composite_prefix', key from o_comp
          union all select 'domain', key from o_domain) k group by space, key""",
    "o_small": "select space, key, n from o_buckets where n < 10",
    "o_clues": """
        select 'COMP_EMAIL_PREFIX' as rule, x.uid as a, y.uid as b, x.email as ea, y.email as eb from o_comp x join o_comp y
          on x.key = y.key and x.uid < y.uid join o_small s on s.space = 'composite_prefix' and s.key = x.key
          where length(x.key) >= 3
        union all
        select 'SIMPLE_EMAIL_PREFIX', x.uid, y.uid, x.email, y.email from o_simple x join o_simple y
          on x.key = y.key and x.uid < y.uid join o_small s on s.space = 'simple_prefix' and s.key = x.key
          where length(x.key) >= 3
        union all
        select 'PREFIX_LOGIN', x.uid, y.uid, x.email, y.email from o_login x join o_simple y
          on x.key = y.key and x.uid < y.uid join o_small s on s.space = 'simple_prefix' and s.key = x.key
        union all
        select 'PREFIX_NAME', x.uid, y.uid, x.email, y.email from o_name x join o_simple y
          on x.key = y.key and x.uid < y.uid join o_small s on s.space = 'simple_prefix' and s.key = x.key
          join o_small t on t.space = 'name' and t.key = x.key
        union all
        select 'LOGIN_NAME', x.uid, y.uid, x.email, y.email from o_name x join o_login y
          on x.key = y.key and x.uid < y.uid join o_small s on s.space = 'name' and s.key = x.key
        union all
        select case when contains(x.key, ' ') then 'FULL_NAME' else 'SIMPLE_NAME' end, x.uid, y.uid, x.email, y.email
          from o_name x join o_name y on x.key = y.key and x.uid < y.uid join o_small s on s.space = 'name' and s.key = x.key
        union all
        select 'EMAIL_DOMAIN', x.uid, y.uid, x.email, y.email from o_domain x join o_domain y
          on x.key = y.key and x.uid < y.uid join o_small s on s.space = 'domain' and s.key = x.key""",
    "o_email_pairs": "select x.uid as a, y.uid as b from o_ids x join o_ids y on x.email = y.email and x.uid < y.uid",
    "o_pairs": """
        select a, b, comp as "COMP_EMAIL_PREFIX", simple as "SIMPLE_EMAIL_PREFIX",
          case when simple > 0 then 0 else pl end as "PREFIX_LOGIN", case when simple > 0 then 0 else pn end as "PREFIX_NAME",
          case when simple > 0 then 0 else ln end as "LOGIN_NAME", fn as "FULL_NAME", sn as "SIMPLE_NAME", dom as "EMAIL_DOMAIN"
        from (select a, b, count(*) filter (where rule = 'COMP_EMAIL_PREFIX') as comp,
            count(*) filter (where rule = 'SIMPLE_EMAIL_PREFIX') as simple, count(*) filter (where rule = 'PREFIX_LOGIN') as pl,
            count(*) filter (where rule = 'PREFIX_NAME') as pn, count(*) filter (where rule = 'LOGIN_NAME') as ln,
            count(*) filter (where rule = 'FULL_NAME') as fn, count(*) filter (where rule = 'SIMPLE_NAME') as sn,
            count(*) filter (where rule = 'EMAIL_DOMAIN') as dom
          from o_clues where ea is null or eb is null or ea <> eb group by a, b) p""",
    "o_held": """
        select a, b, 1 as "EMAIL", 0 as "COMP_EMAIL_PREFIX", 0 as "SIMPLE_EMAIL_PREFIX", 0 as "PREFIX_LOGIN", 0 as "PREFIX_NAME",
          0 as "LOGIN_NAME", 0 as "FULL_NAME", 0 as "SIMPLE_NAME", 0 as "EMAIL_DOMAIN" from o_email_pairs
        union all
        select a, b, 0, "COMP_EMAIL_PREFIX", "SIMPLE_EMAIL_PREFIX", "PREFIX_LOGIN", "PREFIX_NAME", "LOGIN_NAME", "FULL_NAME",
          "SIMPLE_NAME", "EMAIL_DOMAIN" from o_pairs
        where "COMP_EMAIL_PREFIX" + "SIMPLE_EMAIL_PREFIX" + "PREFIX_LOGIN" + "PREFIX_NAME" + "LOGIN_NAME" + "FULL_NAME"
          + "SIMPLE_NAME" + "EMAIL_DOMAIN" >= 2 or "FULL_NAME" = 1 or "COMP_EMAIL_PREFIX" = 1""",
    "o_near": """
        select uid, min(lo) as lo, min(hi) as hi from (select a as uid, null as lo, b as hi from o_held
          union all select b, a, null from o_held) e group by uid""",
    "o_parent": """
        select x.uid, case when x.lo is not null then x.lo when h.lo < x.uid then x.hi else x.uid end as parent
        from o_near x left join o_near h on x.hi = h.uid""",
    "o_climb": """
        select uid, uid as here, parent, 0 as hops from o_parent
        union all
        select c.uid, p.uid, p.parent, c.hops + 1 from o_climb c join o_parent p on c.parent = p.uid where c.here <> c.parent""",
    "o_clusters": "select uid, here as cluster from o_climb where here = parent",
    "o_counts": """
        select cluster, sum("EMAIL") as "EMAIL", sum("COMP_EMAIL_PREFIX") as "COMP_EMAIL_PREFIX",
          sum("SIMPLE_EMAIL_PREFIX") as "SIMPLE_EMAIL_PREFIX", sum("PREFIX_LOGIN") as "PREFIX_LOGIN",
          sum("PREFIX_NAME") as "PREFIX_NAME", sum("LOGIN_NAME") as "LOGIN_NAME", sum("FULL_NAME") as "FULL_NAME",
          sum("SIMPLE_NAME") as "SIMPLE_NAME", sum("EMAIL_DOMAIN") as "EMAIL_DOMAIN"
        from o_held h join o_clusters c on h.a = c.uid group by cluster""",
    "o_cluster_facts": """
        select cluster, count(*) as members, count(*) filter (where is_real) as real_members,
          count(distinct coalesce(email, '(null)')) filter (where is_real) as real_emails, min(uid) as rep
        from o_clusters join o_ids using (uid) group by cluster""",
    "o_groups": """
        select *, "EMAIL" >= members - 1 or real_emails = 1 or (real_members <= 1 and kinds > 1 and least_count >= members - 1)
          or (real_members <= 1 and kinds = 1 and ("COMP_EMAIL_PREFIX" > 0 or "FULL_NAME" > 0))
          or ("FULL_NAME" >= members - 1 and "EMAIL_DOMAIN" >= members - 1)
          or (real_members = 0 and ("COMP_EMAIL_PREFIX" >= members - 1 or "FULL_NAME" >= members - 1)) as valid
        from (select f.*, c.* exclude (cluster), list_min(list_filter(fired, lambda n: n > 0)) as least_count,
            len(list_filter(fired, lambda n: n > 0)) as kinds
          from o_cluster_facts f join (select *, ["EMAIL", "COMP_EMAIL_PREFIX", "SIMPLE_EMAIL_PREFIX", "PREFIX_LOGIN",
              "PREFIX_NAME", "LOGIN_NAME", "FULL_NAME", "SIMPLE_NAME", "EMAIL_DOMAIN"] as fired from o_counts) c
            on f.cluster = c.cluster) g""",
    "o_alias_map": """
        select i.uid, coalesce(g.rep, i.uid) as rep from o_ids i left join o_clusters c on i.uid = c.uid
        left join o_groups g on c.cluster = g.cluster""",
}

_RULES = (
    "EMAIL COMP_EMAIL_PREFIX SIMPLE_EMAIL_PREFIX PREFIX_LOGIN PREFIX_NAME LOGIN_NAME FULL_NAME SIMPLE_NAME EMAIL_DOMAIN"
).split()
_ALL_RULES = ", ".join(f'cast("{r}" as bigint) as "{r}"' for r in _RULES)
_PAIR_RULES = ", ".join(f'cast("{r}" as bigint) as "{r}"' for r in _RULES[1:])


_FIRED = "array_to_string(list_filter([" + ", ".join(f"""case when "{r}" > 0 then concat('{r}=', cast("{r}" as bigint)) end""" for r in _RULES) + "], lambda x: x is not null), ';')"


def _project_report(period: str) -> str:
    key = f"user_id, project, {period}"
    on = " and ".join(f"b.{k} = x.{k}" for k in ("user_id", "project", period))
    return f"""
        select b.user_id, b.project, b.{period}, num_commits, coalesce(num_file_touches, 0) as num_file_touches,
          coalesce(num_src_file_touches, 0) as num_src_file_touches, coalesce(num_files_touched, 0) as num_files_touched,
          coalesce(num_src_files_touched, 0) as num_src_files_touched, loc_added, src_loc_added, loc_deleted, src_loc_deleted,
          coalesce(num_bugs_induced, 0) as num_bugs_induced, coalesce(num_bug_inducing_commits, 0) as num_bug_inducing_commits
        from (select {key}, count(*) as num_commits, cast(sum(num_additions) as bigint) as loc_added,
            cast(sum(src_loc_added) as bigint) as src_loc_added, cast(sum(num_deletions) as bigint) as loc_deleted,
            cast(sum(src_loc_deleted) as bigint) as src_loc_deleted from o_user_commits group by {key}) b
        left join (select {key}, count(*) as num_file_touches, count(distinct file) as num_files_touched,
            count(*) filter (where path_label <> 2) as num_src_file_touches,
            count(distinct case when path_label <> 2 then file end) as num_src_files_touched
          from o_user_commits c join o_files f on c.slug = f.slug and c.sha = f.sha where not is_binary group by {key}) x on {on}
        left join (select {key}, count(distinct issue_number) as num_bugs_induced,
            count(distinct c.sha) as num_bug_inducing_commits
          from o_user_commits c join o_induced_rows i using (user_id, slug, sha) group by {key}) y
          on {on.replace('x.', 'y.')}"""


_COMPAT_REPORT = """
    select user_id, project, day, count(*) as num_commits, count(files) as num_file_touches,
      count(src_files) as num_src_file_touches, count(distinct files) as num_files_touched,
      count(distinct src_files) as num_src_files_touched, cast(sum(num_additions) as bigint) as loc_added,
      cast(sum(src_loc_added) as bigint) as src_loc_added, cast(sum(num_deletions) as bigint) as loc_deleted,
      cast(sum(src_loc_deleted) as bigint) as src_loc_deleted, count(distinct bugs) as num_bugs_induced,
      count(bugs) as num_bug_inducing_commits
    from o_user_commits c
    left join (select slug, sha, string_agg(file, ';' order by patch_pos) as files,
        string_agg(file, ';' order by patch_pos) filter (where path_label <> 2) as src_files
      from o_files where not is_binary group by slug, sha) f using (slug, sha)
    left join (select user_id, slug, sha, string_agg(issue_number, ';' order by issue_number) as bugs
      from (select distinct user_id, slug, sha, issue_number from o_induced_rows) i group by user_id, slug, sha) b
      using (user_id, slug, sha)
    group by user_id, project, day"""


def _language_report(period: str) -> str:
    return f"""
        select user_id, language, {period}, count(*) as num_commits, count(*) as num_src_file_touches,
          count(distinct file) as num_src_files_touched, cast(sum(loc_ins) as bigint) as src_loc_added,
          cast(sum(loc_del) as bigint) as src_loc_deleted, count(distinct concat(slug, ' ', sha)) as num_distinct_commits
        from (select c.user_id, c.{period}, c.slug, c.sha, s.file, n.language, t.loc_ins, t.loc_del
          from o_user_commits c join o_files s on c.slug = s.slug and c.sha = s.sha
          join (select *, row_number() over (partition by slug, sha, file order by patch_pos) as rn from o_files) t
            on s.slug = t.slug and s.sha = t.sha and s.file = t.file and t.rn = 1
          join (select file, {_language('file')} as language from (select distinct file from o_files) d) n on s.file = n.file
          where not s.is_binary and s.path_label <> 2 and t.lang <> 2) r
        group by user_id, language, {period}"""


def _every_period(report) -> str:
    parts = [f"select * exclude ({p}), cast({p} as varchar) as value, '{p}' as period from ({report(p)}) r_{p}" for p in ("day", "week", "month")]
    return " union all by name ".join(parts)


_TOKENS = r"regexp_extract_all({}, '\S+/\S+(?:#\d+|@\d+)')"
_NONE = "'(null)'"
_COMMENT_ROWS = f"""
    select concat('org', conv_id % 5, '/proj', conv_id % 25) as slug, conv_id as issue_id, cast(conv_id as int) as issue_number,
      conv_id * 1000 + turn as comment_id, trim(text, {_BLANK}) as body, '2020-01-02 03:04:05' as created_at,
      '2020-01-02 03:04:06' as updated_at, concat('user', turn) as user_login, turn as user_id from conversations
    union all
    select concat('org', doc_id % 5, '/proj', doc_id % 25), doc_id, cast(doc_id as int), doc_id, trim(text, {_BLANK}),
      '2020-01-02 03:04:05', '2020-01-02 03:04:06', concat('user', n_chars), n_chars from documents where doc_id % 5 <> 0"""
_DIFF_ROWS = f"""
    select slug, sha, patch_pos, old_path, new_path, is_binary, coalesce(hunk_pos, -1) as hunk_pos,
      coalesce(origin, {_NONE}) as origin, coalesce(old_lineno, -1) as old_lineno, coalesce(new_lineno, -1) as new_lineno,
      coalesce(content, {_NONE}) as content from vw_diff_lines"""
_LINK_ROWS = """
    select slug, commit_sha, line_num, issue_number, issue_is_pl, delta_open, coalesce(delta_closed, -1.0) as delta_closed
    from o_links"""
_PATCH_TOTALS = """
    select slug, sha, patch_pos, any_value(old_path) as old_path, any_value(new_path) as new_path,
      any_value(is_binary) as is_binary, count(*) filter (where origin = '+') as loc_ins,
      -count(*) filter (where origin = '-') as loc_del
    from vw_diff_lines group by slug, sha, patch_pos"""

_REFERENCES = f"""
        select slug, translate(token, '()[]', '') as ref, type from (
          select slug, 'commit' as type, unnest({_TOKENS.format('message')}) as token from vw_commits
          union all select slug, 'issue/pr', unnest({_TOKENS.format('body')}) from vw_comments) t
        where not contains(token, slug)"""

STATEMENTS = {
    "slug_folder_roundtrip": """
        select slug, replace(slug, '/', '_____') as folder, replace(slug, '/', '_') as file_stem, slug as back,
          count(*) as num_commits from vw_commits group by slug""",
    "file_labels": f"""
        select sha, patch_pos, new_path, {_base('new_path')} as base, {_ext(_base('new_path'))} as ext,
          {_root(_base('new_path'))} as root, {_label('new_path')} as label from vw_file_changes""",
    "file_languages": f"""
        select sha, patch_pos, f.file, language from (select sha, patch_pos, {_base('new_path')} as file from vw_file_changes) f
        join (select file, {_language('file')} as language from (select distinct {_base('new_path')} as file
          from vw_file_changes) d) n on f.file = n.file""",
    "line_labels": f"""
        select origin, content, {_line_label('content')} as line_label, count(*) as n from vw_diff_lines
        where origin is not null group by origin, content""",
    "period_indexes": f"select sha, {_DAY} as day, {_WEEK} as week, {_MONTH} as month from vw_commits",
    "issue_mentions": """
        select m.slug, m.sha, line_num, number from o_mentions m join o_commits c on m.slug = c.slug and m.sha = c.sha""",
    "issue_links": _LINK_ROWS,
    "native_roundtrip": _LINK_ROWS,
    "fixing_commits": "select slug, sha from o_fixes",
    "pending_issues": """
        select slug, number from vw_issues
        except select slug, issue_number from o_links where delta_open > 0 and delta_closed <= 0""",
    "commit_facts": "select * exclude (ts), strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from o_facts",
    "commit_files": "select slug, sha, patch_pos, file as commit_file, loc_ins, loc_del, lang from o_files",
    "commit_file_lists": """
        select slug, sha, 0 as part, string_agg(file, ';' order by patch_pos) as files,
          coalesce(string_agg(file, ';' order by patch_pos) filter (where path_label <> 2), '') as src_files
        from o_files where not is_binary group by slug, sha""",
    "file_changes": _PATCH_TOTALS,
    "file_changes_from_diffs": _PATCH_TOTALS,
    "contributor_ids": "select slug, contributor_id, name, email from o_contributors",
    "bug_origins": "select * from o_blames",
    "line_origins": """
        select r.slug, r.fix_sha, r.path, h.blamed_sha, count(*) as lines, min(old_lineno) as first_line, max(old_lineno) as last_line
        from o_removed r join vw_wide_hunks h on r.slug = h.slug and r.fix_sha = h.fix_sha and r.path = h.path
          and r.old_lineno between h.start_line and h.start_line + h.num_lines - 1
        group by r.slug, r.fix_sha, r.path, h.blamed_sha""",
    "bug_origins_compat": """
        select t.slug, t.fix_sha as bug_fixing_commit, t.path, t.type, t.blamed_sha as blamed_commit, n.num_blamed_lines
        from (select *, row_number() over (partition by slug, blamed_sha order by ts desc, fix_sha, patch_pos, hunk_pos) as rn
          from o_blamed_lines) t
        join (select slug, blamed_sha, count(*) as num_blamed_lines from o_blamed_lines where line_label = 0
          group by slug, blamed_sha) n on t.slug = n.slug and t.blamed_sha = n.blamed_sha where rn = 1""",
    "bug_origins_asof": """
        select l.slug, l.fix_sha as bug_fixing_commit, l.path, l.type, l.blamed_sha as blamed_commit,
          count(*) as num_blamed_lines
        from (select r.slug, r.fix_sha, r.path, r.type, r.patch_pos, r.old_lineno, max({'at': a.ts, 'sha': a.sha}).sha as blamed_sha
          from o_removed r join vw_diff_lines a on a.origin = '+' and r.slug = a.slug and r.path = a.new_path
            and r.content = a.content and a.ts < r.ts
          where r.line_label = 0 group by r.slug, r.fix_sha, r.path, r.type, r.patch_pos, r.old_lineno) l
        join o_origins o on l.slug = o.slug and l.blamed_sha = o.blamed_sha
        group by l.slug, l.fix_sha, l.path, l.type, l.blamed_sha""",
    "line_origins_renamed": """
        select m.slug, m.sha as fix_sha, m.old_path as path, m.patch_pos, m.removed as content, o.blamed_sha
        from o_timed_moves m join (
          select t.slug, t.asked_path, t.asked_at, a.added, max({'sec': a.sec, 'sha': a.sha}).sha as blamed_sha
          from o_trace t join o_timed_moves a on t.slug = a.slug and t.path = a.new_path and a.sec >= t.since and a.sec < t.until and a.sec < t.asked_at
          group by t.slug, t.asked_path, t.asked_at, a.added) o
          on m.slug = o.slug and m.old_path = o.asked_path and m.sec = o.asked_at and m.removed = o.added""",
    "email_parts": f"""
        select uid, name, is_real, coalesce(email, {_NONE}) as email, coalesce(prefix, {_NONE}) as prefix,
          coalesce(domain, {_NONE}) as domain, coalesce(contains(prefix, '.') or contains(prefix, '_'), false) as is_composite
        from o_ids""",
    "identity_keys": """
        select case when space in ('login', 'name', 'simple_prefix') then 'word' when space = 'domain' then 'domain'
            else 'composite' end as realm, key, cast(sum(case when space = 'login' then n else 0 end) as bigint) as n_login,
          cast(sum(case when space = 'name' then n else 0 end) as bigint) as n_name,
          cast(sum(case when space = 'simple_prefix' then n else 0 end) as bigint) as n_simple_prefix,
          cast(sum(case when space = 'composite_prefix' then n else 0 end) as bigint) as n_composite_prefix,
          cast(sum(case when space = 'domain' then n else 0 end) as bigint) as n_domain
        from o_buckets group by 1, 2""",
    "identity_pairs": f"select a, b, {_PAIR_RULES} from o_pairs",
    "email_pair_counts": 'select a as uid, count(*) as "EMAIL" from o_email_pairs group by a',
    "alias_clusters": "select uid, cluster from o_clusters",
    "alias_validity": f"select cluster, members, real_members, real_emails, rep, {_ALL_RULES}, valid from o_groups",
    "alias_map": "select uid, rep from o_alias_map",
    "alias_members": f"""
        select c.cluster, valid, rep, c.uid, name, coalesce(i.email, {_NONE}) as email
        from o_clusters c join o_groups g on c.cluster = g.cluster join o_ids i on c.uid = i.uid""",
    "alias_shared_email": f"""
        select c.cluster, coalesce(i.email, {_NONE}) as email, count(*) as members, min(c.uid) as rep
        from o_clusters c join o_groups g on c.cluster = g.cluster join o_ids i on c.uid = i.uid
        where not valid and g."EMAIL" > 0 group by c.cluster, i.email having count(*) > 1""",
    "cross_references": _REFERENCES,
    "cross_reference_file": _REFERENCES,
    "induced_bugs": """
        select user_id, slug, sha, issue_number, fixing_sha, count(*) as times from o_induced_rows
        group by user_id, slug, sha, issue_number, fixing_sha""",
    "induced_bugs_per_commit": """
        select user_id, slug, sha, count(distinct issue_number) as num_issues, count(*) as num_fixes from o_induced_rows
        group by user_id, slug, sha""",
    "activity_by_project": _project_report("day"),
    "activity_weekly": _project_report("week"),
    "activity_monthly": _project_report("month"),
    "activity_by_project_compat": _COMPAT_REPORT,
    "activity_by_language": _language_report("day"),
    "activity_by_language_monthly": _language_report("month"),
    "activity_every_period": _every_period(_project_report),
    "activity_by_language_every_period": _every_period(_language_report),
    "activity_whole_chain": _project_report("day"),
    "whole_history": _project_report("day"),
    "history_in_two_halves": _project_report("day"),
    "normalise_issues": f"""
        select concat('org', event_id % 5, '/proj', event_id % 25) as slug, event_id as id, cast(event_id % 1000 as int) as number,
          'closed' as state, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at, strftime(ts, '%Y-%m-%d %H:%M:%S') as closed_at,
          case when user_id % 7 <> 0 then concat('user', user_id) else {_NONE} end as created_by_login,
          case when user_id % 3 <> 0 then concat('user', user_id + 1) else {_NONE} end as closed_by_login,
          {_NONE} as assignee_login, concat('Report on ', props) as title, cast(event_id % 9 as int) as num_comments,
          case when event_id % 2 = 0 then concat(event_type, ';ui') else event_type end as labels,
          event_type = 'purchase' as is_pl
        from events where event_type <> 'signup'""",
    "normalise_comments": _COMMENT_ROWS,
    "csv_roundtrip": _COMMENT_ROWS,
    "delimited_roundtrip": "select slug, contributor_id, name, email from vw_contributors",
    "typed_issues": """
        select slug, number, version as id, concat('a, "b"', chr(10), 'c') as title, labels, is_pl,
          strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at,
          coalesce(strftime(closed_at, '%Y-%m-%d %H:%M:%S'), '(null)') as closed_at
        from vw_issues qualify row_number() over (partition by slug, number order by version desc) = 1""",
    "folder_scan": """
        select slug, contributor_id, name, case when length(name) % 2 = 0 then email else '' end as email
        from vw_contributors""",
    "project_list": """
        select distinct slug, replace(slug, '/', '_____') as folder, replace(slug, '/', '_') as file_stem from vw_commits""",
    "author_times": "select sha, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from vw_commits",
    "rejected_payloads": """
        select concat('org', event_id % 5, '/proj', event_id % 25) as slug,
          case event_id % 11 when 0 then 'malformed' when 1 then 'no id' when 2 then 'missing' else 'unreadable time' end as reason,
          count(*) as n
        from events where event_id % 11 < 4 group by 1, 2""",
    "comments_per_issue": "select slug, issue_number, count(*) as num_comments from vw_comments group by slug, issue_number",
    "diff_lines": _DIFF_ROWS,
    # Patches are numbered from 1 without gaps in the given history.
    "diff_files": _DIFF_ROWS.replace("patch_pos,", "dense_rank() over (partition by slug, sha order by patch_pos) as patch_pos,", 1),
    "alias_audit_files": f"""
        with fired as (
          select cluster, {_FIRED} as rules from o_groups),
        listed as (select c.cluster, g.valid, g.rep, c.uid, i.email, f.rules, g."EMAIL" as by_email
          from o_clusters c join o_groups g on c.cluster = g.cluster join o_ids i on c.uid = i.uid join fired f on c.cluster = f.cluster),
        parts as (select cluster, email, min(uid) as rep from listed where not valid and by_email > 0 group by cluster, email having count(*) > 1),
        shared as (select l.cluster, p.rep, l.uid, l.rules, coalesce(l.email, '') as email
          from listed l join parts p on l.cluster = p.cluster and l.email is not distinct from p.email)
        select 'map' as file, '' as cluster, rep, uid, '' as rules, '' as email from o_alias_map where uid <> rep
        union all select 'map', '', rep, uid, '', '' from shared where uid <> rep
        union all select 'log', cluster, rep, uid, rules, coalesce(email, '') from listed where valid
        union all select 'log', cluster, rep, uid, rules, email from shared
        union all select 'maybe', cluster, rep, uid, rules, coalesce(email, '') from listed where not valid""",
}


def _statement(name: str) -> str:
    aliases = "o_alias_map" if name in ("activity_whole_chain", "whole_history", "history_in_two_halves") else "vw_aliases"
    steps = {step: sql.replace("{aliases}", aliases) for step, sql in STEPS.items()}
    statement = with_views(STATEMENTS[name], {**DUCKDB_VIEWS, **steps})
    return statement.replace("with ", "with recursive ", 1) if "o_climb" in statement or "o_trace" in statement else statement


def oracle_sql() -> dict[str, str]:
    return {name: _statement(name) for name in STATEMENTS}
