"""Input tables for the registered queries, derived from the given tables in SQL.

Each view is one SELECT written so that Spark and a second SQL engine build the
same rows; ``@name(...)`` marks the few spots where the two dialects differ.
Code files are generated around the whole text of `documents`, one file per row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from proofmill.sources.sinks import work_folder, write_table

BASE_TABLES = ("customer documents events lineitem orders pages part benchmark labels conversations").split()

_DIALECTS = {
    "spark": {
        "arr": "array({})", "noarr": "cast(array() as array<string>)", "nullarr": "cast(null as array<string>)",
        "size": "size({})", "join": "array_join({})", "s": "cast({} as string)", "i": "cast({} as bigint)",
        "ts": "cast({} as timestamp)", "div": "cast(floor({}) as bigint)",
    },
    "duck": {
        "arr": "list_value({})", "noarr": "cast([] as varchar[])", "nullarr": "cast(null as varchar[])",
        "size": "len({})", "join": "array_to_string({})", "s": "cast({} as varchar)", "i": "cast({} as bigint)",
        "ts": "cast({} as timestamp)", "div": "cast(floor({}) as bigint)",
    },
}


def render(sql: str, dialect: str) -> str:
    """Expand the ``@name(args)`` spots of a portable query; spots may nest."""
    spots = _DIALECTS[dialect]
    out, at = [], 0
    for m in re.finditer(r"@([a-z]+)\b(\()?", sql):
        if m.start() < at or m.group(1) not in spots:
            continue
        out.append(sql[at:m.start()])
        if m.group(2) is None:
            out.append(spots[m.group(1)])
            at = m.end()
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(spots[m.group(1)].replace("{}", render(sql[m.end():end - 1], dialect)))
        at = end
    return "".join(out) + sql[at:]


VIEWS: dict[str, str | dict[str, str]] = {}

# One repository per 400 consecutive documents of a source, so a repository stays
# small however large (or skewed) the table is.
VIEWS["v_docs"] = """
select doc_id, text, lang, n_chars, source,
       source || '/r' || @s(@div(doc_id / 400)) as full_name,
       @div(doc_id / 20) as n, @div(doc_id / 20) % 10 as k
from documents"""

VIEWS["v_files"] = """
select doc_id, n, k, lang, full_name, 'r1' as revision,
  case k when 0 then 'README.d' || @s(doc_id)
         when 1 then 'docs/architecture/' || @s(doc_id) || '.md'
         when 2 then 'src/app/m' || @s(doc_id) || '.py'
         when 3 then 'src/core/m' || @s(doc_id) || '.ts'
         when 4 then 'test/core/m' || @s(doc_id) || '.test.ts'
         when 5 then 'tests/test_m' || @s(doc_id) || '.py'
         when 6 then '.github/workflows/w' || @s(doc_id) || '.yml'
         when 7 then 'packages/' || lang || @s(doc_id) || '/package.json'
         when 8 then 'src/rs/m' || @s(doc_id) || '.rs'
         else 'src/rs/m' || @s(doc_id) || '/mod.rs' end as path,
  case when k in (0, 1, 6) then text
       when k = 2 then 'from .m' || @s(doc_id + 200) || ' import run' || chr(10) || 'import json' || chr(10)
         || chr(10) || 'class Store' || @s(doc_id) || '(Protocol):' || chr(10) || '    limit: int = 3' || chr(10)
         || '    def check(self, value):' || chr(10) || '        if value is None:' || chr(10)
         || '            raise ValueError(' || chr(34) || 'bad' || chr(34) || ')' || chr(10)
         || '        assert value' || chr(10) || '        return value' || chr(10) || chr(10)
         || 'def run(item, retry=2):' || chr(10) || '    try:' || chr(10) || '        return json.dumps(item)' || chr(10)
         || '    except TypeError:' || chr(10) || '        return None' || chr(10)
         || '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10)
         || case when n % 30 = 12 then 'def broken(:' || chr(10) else '' end
       when k = 3 then 'import { run } from ' || chr(34) || './m' || @s(doc_id + 200) || chr(34) || ';' || chr(10)
         || 'export { B } from ' || chr(39) || '../app/m' || @s(doc_id - 20) || chr(39) || ';' || chr(10)
         || 'const gone = require(' || chr(34) || './gone' || @s(doc_id) || chr(34) || ');' || chr(10)
         || 'export interface Api' || @s(doc_id) || ' { run(): void }' || chr(10)
         || '// ' || replace(text, chr(10), chr(10) || '// ')
       when k = 4 then 'import { run } from ' || chr(34) || '../../src/core/m' || @s(doc_id - 20) || chr(34) || ';' || chr(10)
         || 'const later = import(' || chr(39) || '../../src/core/m' || @s(doc_id + 180) || '.js' || chr(39) || ');' || chr(10)
         || 'test(' || chr(39) || 'runs' || chr(39) || ', () => run());' || chr(10)
         || '// ' || replace(text, chr(10), chr(10) || '// ')
       when k = 5 then 'import pytest' || chr(10) || 'from app.m' || @s(doc_id - 60) || ' import run' || chr(10) || chr(10)
         || '@' || 'pytest.fixture' || chr(10) || 'def local_res():' || chr(10) || '    return 1' || chr(10) || chr(10)
         || 'def test_run_' || @s(doc_id) || '(local_res, shared, missing_res):' || chr(10)
         || '    assert run(local_res)' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ')
       when k = 7 then '{' || chr(34) || 'name' || chr(34) || ': ' || chr(34) || 'pkg-' || @s(doc_id) || chr(34) || ', '
         || chr(34) || 'description' || chr(34) || ': ' || chr(34)
         || replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')
         || chr(34) || ', ' || chr(34) || 'dependencies' || chr(34) || ': {' || chr(34) || 'dep' || @s(n % 7) || chr(34)
         || ': ' || chr(34) || '1' || chr(34) || ', ' || chr(34) || lang || chr(34) || ': ' || chr(34) || '2' || chr(34) || '}, '
         || chr(34) || 'peerDependencies' || chr(34) || ': {' || chr(34) || 'peer' || chr(34) || ': ' || chr(34) || '*' || chr(34) || '}, '
         || chr(34) || 'devDependencies' || chr(34) || ': {' || chr(34) || 'dev' || @s(n % 3) || chr(34) || ': ' || chr(34) || '3' || chr(34) || '}, '
         || chr(34) || 'scripts' || chr(34) || ': {' || chr(34) || 'test' || chr(34) || ': ' || chr(34) || 't' || chr(34) || '}, '
         || chr(34) || 'workspaces' || chr(34) || ': [' || chr(34) || 'packages/*' || chr(34) || '], '
         || chr(34) || 'main' || chr(34) || ': ' || chr(34) || './index.js' || chr(34) || ', '
         || chr(34) || 'exports' || chr(34) || ': {' || chr(34) || '.' || chr(34) || ': {' || chr(34) || 'import' || chr(34)
         || ': ' || chr(34) || './lib/m' || @s(n % 5) || '.js' || chr(34) || '}}' || case when n % 30 = 17 then ' oops' else '' end || '}'
       when k = 8 then 'use crate::rs::m' || @s(doc_id + 200) || '::Thing;' || chr(10) || 'use super::m' || @s(doc_id + 20) || '::go;' || chr(10)
         || 'use std::fmt;' || chr(10) || 'mod inner;' || chr(10) || 'pub struct Thing' || @s(doc_id) || ';' || chr(10)
         || '// ' || replace(text, chr(10), chr(10) || '// ')
       else 'use super::m' || @s(doc_id - 20) || '::Thing' || @s(doc_id - 20) || ';' || chr(10)
         || '#[test]' || chr(10) || 'fn checks() { assert!(true); }' || chr(10)
         || '// ' || replace(text, chr(10), chr(10) || '// ') end as content
from v_docs"""

# Per repository: a shared fixture file and two manifests.
VIEWS["v_extra"] = """
select cast(null as bigint) as doc_id, e.n, e.k, 'en' as lang, r.full_name, 'r1' as revision, e.path,
  case e.k when 10 then 'import pytest' || chr(10) || chr(10) || '@' || 'pytest.fixture' || chr(10) || 'def shared():' || chr(10)
              || '    return ' || @s(r.files) || chr(10)
           when 11 then '[project]' || chr(10) || 'name = ' || chr(34) || replace(r.full_name, '/', '-') || chr(34) || chr(10)
              || 'dependencies = [' || chr(34) || 'dep' || @s(r.files % 7) || '>=1' || chr(34) || ', ' || chr(34) || 'requests' || chr(34) || ']' || chr(10)
              || '[project.optional-dependencies]' || chr(10) || 'extra = [' || chr(34) || 'numpy' || chr(34) || ']' || chr(10)
              || '[project.scripts]' || chr(10) || 'run-it = ' || chr(34) || 'app.m' || @s(r.first_doc + 40) || ':run' || chr(34) || chr(10)
              || '[dependency-groups]' || chr(10) || 'dev = [' || chr(34) || 'pytest' || chr(34) || ']' || chr(10)
              || '[tool.setuptools.packages.find]' || chr(10) || 'where = [' || chr(34) || 'src' || chr(34) || ']' || chr(10)
           else '[package]' || chr(10) || 'name = ' || chr(34) || replace(r.full_name, '/', '_') || chr(34) || ' # crate' || chr(10)
              || 'edition = ' || chr(34) || '2021' || chr(34) || chr(10) || chr(10) || '[dependencies]' || chr(10)
              || 'serde = ' || chr(34) || '1' || chr(34) || chr(10) || 'dep' || @s(r.files % 7) || ' = { version = ' || chr(34) || '2' || chr(34) || ' }' || chr(10)
              || '[dev-dependencies]' || chr(10) || 'proptest = ' || chr(34) || '1' || chr(34) || chr(10)
              || '[features]' || chr(10) || 'fast = []' || chr(10) || '[workspace]' || chr(10)
              || 'members = [' || chr(34) || 'crates/a' || chr(34) || ', ' || chr(34) || 'crates/b' || chr(34) || ']' || chr(10)
              || '[[bin]]' || chr(10) || 'name = ' || chr(34) || 'tool' || chr(34) || chr(10)
              || 'path = ' || chr(34) || 'src/rs/m' || @s(r.first_doc + 160) || '.rs' || chr(34) || chr(10) end as content
from (select full_name, count(*) as files, min(doc_id) as first_doc from v_docs group by full_name) r
cross join (select cast(0 as bigint) as n, cast(10 as bigint) as k, 'tests/conftest.py' as path
            union all select 0, 11, 'pyproject.toml' union all select 0, 12, 'Cargo.toml') e"""

VIEWS["v_blobs"] = """
select doc_id, n, k, lang, full_name, revision, path, content from v_files
union all select doc_id, n, k, lang, full_name, revision, path, content from v_extra"""

VIEWS["v_tree"] = """
select full_name, revision, path, 'blob' as type, @i(length(content)) as size from v_blobs"""

VIEWS["v_catalog"] = """
select lower(replace(p_brand, '#', '')) || '/part-' || @s(p_partkey) as full_name, 'r1' as revision,
  p_partkey, p_name || ' ' || lower(p_type) as description,
  @arr(lower(p_type), lower(replace(p_brand, '#', ''))) as topics,
  coalesce(lines, 0) * 100 as stars, coalesce(suppliers, 0) as forks, @i(p_partkey % 50) as open_issues,
  @i(p_size) * 8000 as size_kb, p_size % 17 = 0 as archived, p_size % 13 = 0 as fork,
  case p_partkey % 3 when 0 then last_ship when 1 then first_ship else last_ship - interval 365 day end as pushed_at,
  case p_size % 4 when 0 then 'MIT' when 1 then 'Apache-2.0' when 2 then 'GPL-3.0' end as license,
  case p_partkey % 2 when 0 then 'python' else 'rust' end as language,
  case when p_partkey % 10 <> 9 then 'src' || @s(p_partkey % 20) || '/r0' end as tree_name
from part left join (
  select l_partkey, count(*) as lines, count(distinct l_suppkey) as suppliers,
         max(@ts(l_shipdate)) as last_ship, min(@ts(l_shipdate)) as first_ship
  from lineitem group by l_partkey) s on p_partkey = l_partkey"""

VIEWS["v_names"] = """
select p_name, lower(min(p_type)) as type_word, count(*) as parts,
       split_part(p_name, ' ', 1) as adjective, split_part(p_name, ' ', 2) as noun
from part group by p_name"""

VIEWS["v_tasks"] = """
select 't_' || replace(p_name, ' ', '_') as task_id,
  'Build a ' || p_name || '  tracker with ' || type_word || ' orders, ' ||
  case length(noun) when 3 then 'a polished react dashboard page' when 4 then 'command line batch jobs'
    when 5 then 'responsive layout and brand style' else 'a landing page in Vue' end as task,
  case length(adjective) when 3 then 'python' when 4 then 'rust' end as language,
  case when length(noun) = 5 then 'node' end as ecosystem,
  @arr('needs ' || noun || ' lookup', '  needs ' || noun || '   lookup ', 'Report ' || adjective) as must_have,
  case when length(adjective) = 3 then @arr(' ' || noun || ' inventory ', '') else @noarr end as queries
from v_names"""

# `old` tasks have no profile and fall back to lexical anchors.
VIEWS["v_concepts"] = """
select task_id, 'purpose' as kind, @i(0) as ordinal, name, @arr(alias, alias || 's') as aliases, evidence from (
  select 't_' || replace(p_name, ' ', '_') as task_id, case when adjective = 'hot' then p_name else noun end as name,
    case when adjective = 'hot' then noun else adjective || ' ' || noun end as alias, 'build a ' || p_name as evidence
  from v_names where adjective <> 'old') p
union all
select 't_' || replace(p_name, ' ', '_'), 'capability', 1, adjective, @arr('very ' || adjective), 'report ' || adjective
from v_names where adjective <> 'old'
union all
select 't_' || replace(p_name, ' ', '_'), 'capability', 2, type_word, case length(noun) when 3 then @arr('retry budget') when 4 then @arr('runs the run') else @arr('json dumps') end,
  case when length(noun) = 4 then 'made up quote' else 'with ' || type_word || ' orders' end
from v_names where adjective <> 'old'"""

VIEWS["v_task_text"] = """
select 'b' || @s(item_id) as task_id, text as task from benchmark
union all select 'c' || @s(conv_id) || '-' || @s(turn), text from conversations where role = 'user'"""

# Every order asks for one or two repositories, some with a revision, some malformed.
VIEWS["v_requested"] = """
select 'o' || @s(o_orderkey) as task_id, cast(1 as bigint) as seq,
  case o_orderkey % 6 when 0 then 'Brand' || @s(o_custkey % 25) || '/Part-' || @s(o_orderkey % 2000) || '.git'
    when 1 then 'https://github.com/Brand' || @s(o_custkey % 25) || '/part-' || @s(o_orderkey % 2000) || '@v1'
    when 2 then 'https://user:pw@github.com/brand1/part-' || @s(o_custkey)
    when 3 then ' brand' || @s(o_custkey % 25) || '/part-' || @s(o_orderkey % 2000) || '@r1 '
    when 4 then 'https://github.com/brand2/part-1?tab=x' else 'not a repository ' || @s(o_custkey) end as requested
from orders
union all
select 'o' || @s(o_orderkey), 2, case o_orderpriority when '1-URGENT' then 'brand' || @s(o_custkey % 25) || '/part-' || @s(o_orderkey % 2000)
    else 'brand3/part-' || @s(o_custkey) end
from orders where o_orderstatus <> 'O'
union all
select 'o' || @s(o_orderkey), 3, 'brand4/part-4' from orders where o_orderpriority = '5-LOW' and o_orderstatus = 'P'"""

VIEWS["v_symbols"] = {
    "spark": """
select full_name, revision, path, name, kind, language, role, visibility, start_line, end_line, has_body,
       raises, catches, bases, fields, assertion_count, unsafe_count, fixture_name, fixture_requests from (
select b.full_name, b.revision, b.path, b.k, s, array_join(array(case when s % 4 = 3 then '_S' else 'S' end, cast(b.doc_id as string), cast(s as string)), '_') as name,
  case s % 6 when 0 then 'class' when 1 then 'function' when 2 then 'trait' when 3 then 'enum' when 4 then 'type' else 'module' end as kind,
  case when b.k in (8, 9) then 'rust' when b.k in (3, 4) then 'typescript' else 'python' end as language,
  case when b.k in (4, 5) then case when s % 5 = 4 then 'fixture' else 'test' end else 'implementation' end as role,
  case when b.k in (8, 9) and s % 2 = 0 then 'pub' end as visibility,
  s * 7 + 1 as start_line, least(s * 7 + 5, size(split(b.content, chr(10)))) as end_line, s % 9 <> 8 as has_body,
  case when s % 3 = 0 then array('ValueError') else cast(array() as array<string>) end as raises,
  case when s % 4 = 1 then array('TypeError') else cast(array() as array<string>) end as catches,
  case when s % 5 = 2 then array('Protocol') else cast(array() as array<string>) end as bases,
  case when s % 2 = 1 then array('limit', 'size') else cast(array() as array<string>) end as fields,
  cast(s % 4 as bigint) as assertion_count, cast(case when s % 11 = 10 then 1 else 0 end as bigint) as unsafe_count,
  case when s % 5 = 4 and b.k in (4, 5) then concat('fx', cast(s as string)) end as fixture_name,
  case when b.k in (4, 5) and s % 5 <> 4 then array(concat('fx', cast(s - s % 5 + 4 as string)), 'shared') else cast(array() as array<string>) end as fixture_requests
from v_files b lateral view explode(sequence(0, cast(floor((size(split(b.content, chr(10))) - 1) / 7) as bigint))) t as s
where b.k in (2, 3, 4, 5, 8, 9)) x""",
    "duck": """
select full_name, revision, path, name, kind, language, role, visibility, start_line, end_line, has_body,
       raises, catches, bases, fields, assertion_count, unsafe_count, fixture_name, fixture_requests from (
select b.full_name, b.revision, b.path, b.k, s, array_to_string([case when s % 4 = 3 then '_S' else 'S' end, cast(b.doc_id as varchar), cast(s as varchar)], '_') as name,
  case s % 6 when 0 then 'class' when 1 then 'function' when 2 then 'trait' when 3 then 'enum' when 4 then 'type' else 'module' end as kind,
  case when b.k in (8, 9) then 'rust' when b.k in (3, 4) then 'typescript' else 'python' end as language,
  case when b.k in (4, 5) then case when s % 5 = 4 then 'fixture' else 'test' end else 'implementation' end as role,
  case when b.k in (8, 9) and s % 2 = 0 then 'pub' end as visibility,
  s * 7 + 1 as start_line, least(s * 7 + 5, len(split(b.content, chr(10)))) as end_line, s % 9 <> 8 as has_body,
  case when s % 3 = 0 then ['ValueError'] else cast([] as varchar[]) end as raises,
  case when s % 4 = 1 then ['TypeError'] else cast([] as varchar[]) end as catches,
  case when s % 5 = 2 then ['Protocol'] else cast([] as varchar[]) end as bases,
  case when s % 2 = 1 then ['limit', 'size'] else cast([] as varchar[]) end as fields,
  cast(s % 4 as bigint) as assertion_count, cast(case when s % 11 = 10 then 1 else 0 end as bigint) as unsafe_count,
  case when s % 5 = 4 and b.k in (4, 5) then 'fx' || cast(s as varchar) end as fixture_name,
  case when b.k in (4, 5) and s % 5 <> 4 then ['fx' || cast(s - s % 5 + 4 as varchar), 'shared'] else cast([] as varchar[]) end as fixture_requests
from (select f.*, unnest(range(0, cast(floor((len(split(f.content, chr(10))) - 1) / 7) as bigint) + 1)) as s from v_files f where f.k in (2, 3, 4, 5, 8, 9)) b) x""",
}

# Evidence slices: every ten-line window at stride five of every file.
_SLICE_COLUMNS = """
  b.full_name, case when b.doc_id % 37 = 0 then 'r0' else 'r1' end as revision, b.path, s + 1 as start_line,
  b.doc_id % 47 as relevance,
  case when b.k in (2, 3, 8, 9, 4, 5) and b.doc_id % 3 <> 0 then case when b.k in (8, 9) then 'rust-syntax' when b.k in (3, 4) then 'typescript-ast' else 'python-ast' end
       else 'line-window' end as strategy,
  case when b.k in (2, 3, 8, 9) then case when s = 0 and b.n % 3 = 1 then @noarr else @arr('implementation') end
       when b.k in (4, 5) then case when s = 0 and b.n % 3 = 1 then @noarr else @arr('test') end else @nullarr end as evidence_roles,
  case when s = 0 and b.k in (2, 3, 4, 5, 8, 9) then @arr('relationship')
       when b.k in (4, 5) then @arr('test', 'invariant')
       when b.k in (2, 3, 8, 9) then case (b.n + s) % 4 when 0 then @arr('contract') when 1 then @arr('contract', 'failure') when 2 then @arr('invariant') else @noarr end
       else @noarr end as architecture_roles,
  case when b.n % 4 = 0 then 'MIT' end as license"""
VIEWS["v_slices"] = {
    "spark": f"""
select substring(sha2(concat_ws(chr(0), full_name, revision, path, cast(start_line as string), cast(start_line + n_lines - 1 as string)), 256), 1, 16) as slice_id,
  full_name, revision, path, start_line, start_line + n_lines - 1 as end_line, relevance, strategy, evidence_roles, architecture_roles, license, content
from (select {_SLICE_COLUMNS}, cast(size(slice(split(b.content, chr(10)), s + 1, 10)) as bigint) as n_lines,
        array_join(slice(split(b.content, chr(10)), s + 1, 10), chr(10)) as content
      from v_files b lateral view explode(sequence(0, size(split(b.content, chr(10))) - 1, 5)) t as s) w""",
    "duck": f"""
select substring(sha256(concat_ws(chr(0), full_name, revision, path, cast(start_line as varchar), cast(start_line + n_lines - 1 as varchar))), 1, 16) as slice_id,
  full_name, revision, path, start_line, start_line + n_lines - 1 as end_line, relevance, strategy, evidence_roles, architecture_roles, license, content
from (select {_SLICE_COLUMNS}, cast(len(list_slice(split(b.content, chr(10)), s + 1, s + 10)) as bigint) as n_lines,
        array_to_string(list_slice(split(b.content, chr(10)), s + 1, s + 10), chr(10)) as content
      from (select f.*, unnest(range(0, len(split(f.content, chr(10))), 5)) as s from v_files f) b) w""",
}

# Import edges with a line anchor: code files point at the file 200 documents on.
VIEWS["v_relations"] = """
select a.full_name, a.revision, a.path as src, b.path as dst, case when a.k in (4, 5) then 'tests' else 'imports' end as kind,
  case when a.doc_id % 9 = 8 then b.path else a.path end as evidence_path,
  'https://host.example/' || a.full_name || '/blob/r1/' || a.path ||
    case a.doc_id % 5 when 0 then '#L1' when 1 then '#L1-L2' when 2 then '#L2-L14' when 3 then '#L2-3' else '' end as source_url,
  case when a.k in (8, 9) then 'rust-module-candidate' else 'static-candidate' end as resolution, 'module' as scope
from v_files a join v_files b on a.full_name = b.full_name
  and b.doc_id = case a.k when 4 then a.doc_id - 20 when 5 then a.doc_id - 60 else a.doc_id + 200 end
where a.k in (2, 3, 4, 5, 8, 9)"""

VIEWS["v_style"] = """
select split_part(split_part(url, '://', 2), '/', 1) as workspace,
  split_part(split_part(split_part(url, '#', 1), '?', 1), '/', 4) || '/' || case page_id % 9 when 7 then 'node_modules/' else '' end || 'p' || @s(page_id) || case page_id % 5 when 0 then '.css' when 1 then '.html' when 2 then '.tsx' when 3 then '.vue' else '.theme' end as path,
  html || chr(10) || ':root { --bg' || @s(page_id % 3) || ': ' || case page_id % 4 when 0 then '#000000' when 1 then '#0a0a0a' when 2 then 'rgb(12, 12, 20)' else '#f6f5f1' end
    || '; } body { background: var(--bg' || @s(page_id % 3) || '); color: #' || @s(100 + page_id % 60) || '; font-size: ' || @s(12 + page_id % 6) || 'px; } '
    || case when page_id % 6 = 0 then '@' || 'media (max-width: 700px) { h1 { font-size: 34px; } } ' else '' end
    || '.card { border: 1px solid; border-radius: ' || @s(4 * (page_id % 3)) || 'px; } .panel { background-color: hsl(0 0% 0%); box-shadow: 0 1px; background: linear-gradient(red, blue); }'
    || '<main className=' || chr(34) || 'bg-zinc-950 rounded-lg text-sm md:flex border-b-2 shadow-md w-' || @s(page_id % 8) || chr(34) || '>' as content
from pages"""

VIEWS["v_eval_runs"] = """
select 's' || @s(o_custkey % 5) as suite, 'run' || @s(o_orderkey) as run_id, 'task' || @s(o_custkey % 50) as task_id,
  case o_orderkey % 2 when 0 then 'baseline' else 'treatment' end as variant,
  row_number() over (partition by o_custkey, o_orderkey % 2 order by o_orderkey) as repetition,
  case o_orderstatus when 'F' then 0 when 'O' then 1 end as verification_exit_code,
  o_totalprice as duration_ms, coalesce(files, 0) as changed_files, o_custkey as worker
from orders left join (select l_orderkey, count(*) as files from lineitem group by l_orderkey) l on o_orderkey = l_orderkey"""

VIEWS["v_before"] = """select full_name as run, path, content from v_files"""
VIEWS["v_after"] = """
select full_name as run, path, case when doc_id % 7 = 0 then content || '!' else content end as content from v_files where doc_id % 11 <> 0
union all select full_name, 'new/' || path, content from v_files where doc_id % 13 = 0
union all select full_name, 'node_modules/' || path, content from v_files where doc_id % 17 = 0"""

VIEWS["v_judge_log"] = """
select @s(conv_id) || '-' || @s(turn) as log_id, @arr('repo/' || @s(conv_id), 'repo/x') as allowed,
  text || ' {' || chr(34) || 'note' || chr(34) || ': {' || chr(34) || 'k' || chr(34) || ': ' || chr(34) || 'a}b' || chr(34) || '}} '
  || case when turn % 5 = 4 then '{broken' else '{' || chr(34) || 'approvedRepositories' || chr(34) || ': [' || chr(34) || 'repo/' || @s(conv_id + turn % 2) || chr(34)
       || ', ' || chr(34) || 'repo/x' || chr(34) || ', ' || chr(34) || 'repo/x' || chr(34) || '], ' || chr(34) || 'rationale' || chr(34) || ': ' || chr(34)
       || case when turn % 3 = 2 then 'short' else 'clear shared mechanism' end || chr(34) || '}' end as log
from conversations"""

VIEWS["v_workflow"] = """
select @s(user_id) as task_id, event_id as seq, @ts(ts) as ts,
  case event_type when 'signup' then 'reviewing' when 'purchase' then 'approved' when 'error' then 'blocked' end as phase,
  case event_type when 'click' then case event_id % 2 when 0 then 'edit' else 'bash' end when 'view' then 'read' end as tool,
  case user_id % 2 when 0 then 'strict' else 'advisory' end as mode
from events"""

# Reviews: one decision per (pack, repository); packs are 400-document repositories.
VIEWS["v_bundle_slices"] = """
select 'bu-' || full_name || '-' || @s(@div(start_line / 20)) as bundle_id, full_name, slice_id, path, start_line
from v_slices where revision = 'r1'"""
VIEWS["v_bundles"] = """
select bundle_id, full_name, case when max(case when path like 'docs/%' then 1 else 0 end) = 1 then 'explicit' else 'observed' end as ceiling
from v_bundle_slices group by bundle_id, full_name"""
VIEWS["v_reviews"] = """
select f.full_name as pack_id, f.full_name as repository, f.doc_id as review_no,
  case when coalesce(l.quality, 1) = 1 then case when f.doc_id % 4 = 1 then 'adapt' else 'adopt' end when f.doc_id % 3 = 0 then 'pending' else 'reject' end as verdict,
  case when coalesce(l.toxic, 0) = 1 then 'high' when f.doc_id % 5 = 0 then 'medium' else 'low' end as risk,
  least((f.doc_id % 11) / 10.0e0, 1.0e0) as confidence, 'Reviewer ' || @s(f.doc_id % 3) as reviewer,
  case when f.doc_id % 6 = 5 then '' else 'summary of ' || f.path end as summary,
  @i(f.doc_id % 3) as n_patterns, @i(f.doc_id % 2) as n_mismatches, @i(f.doc_id % 2) as n_risks,
  case when f.doc_id % 8 = 7 then 'adjacent' when f.doc_id % 9 <> 8 then 'same-domain' end as relation,
  case when f.doc_id % 5 = 4 then 'too short' else 'shares the product responsibility' end as rationale
from v_files f left join labels l on f.doc_id = l.doc_id where f.k in (2, 3, 4, 5)"""
VIEWS["v_review_slices"] = """
select f.full_name as repository, f.doc_id as review_no, s.slice_id
from v_files f join v_slices s on s.full_name = f.full_name and s.path = f.path where f.k in (2, 3, 4, 5) and s.start_line < 12 and f.doc_id % 13 <> 0
union all
select f.full_name, f.doc_id, s.slice_id from v_files f join v_files g on g.doc_id = f.doc_id + 1
  join v_slices s on s.full_name = g.full_name and s.path = g.path where f.k in (2, 3, 4, 5) and s.start_line = 1 and f.doc_id % 13 = 0
union all
select f.full_name, f.doc_id, 'missing' || @s(f.doc_id) from v_files f where f.k = 2 and f.doc_id % 7 = 0"""
VIEWS["v_review_bundles"] = """
select f.full_name as repository, f.doc_id as review_no, 'bu-' || f.full_name || '-0' as bundle_id from v_files f where f.k in (2, 3, 4, 5) and f.doc_id % 10 <> 3
union all
select f.full_name, f.doc_id, 'bu-' || g.full_name || '-0' from v_files f join v_files g on g.doc_id = f.doc_id + 1 where f.k = 3 and f.doc_id % 4 = 0
union all
select f.full_name, f.doc_id, 'bu-none' from v_files f where f.k = 4 and f.doc_id % 5 = 0"""

# Claims, concepts and mappings from lines, orders and order priorities.
VIEWS["v_claims"] = """
select l_orderkey as concept_no, @i(l_linenumber) as line_no, @s(l_orderkey) || '-' || @s(l_linenumber) as claim_id,
  case (l_partkey + l_linenumber) % 5 when 0 then 'explicit' when 1 then 'inferred' when 2 then 'unknown' else 'observed' end as status,
  least(round(l_discount * 10, 2), 1.0e0) as confidence, @i(case when l_quantity > 40 then 0 else 1 end) as n_limitations, l_partkey, l_suppkey,
  case when l_linenumber % 3 = 0 then @arr('cs' || @s(l_partkey), 'cs' || @s(l_partkey + 1)) when l_suppkey % 9 = 8 then @noarr else @arr('cs' || @s(l_partkey)) end as slice_ids,
  case when l_suppkey % 4 = 0 then @arr('cs' || @s(l_partkey)) when l_suppkey % 4 = 1 then @arr('cs' || @s(l_partkey + 2)) else @noarr end as counter_ids,
  case when l_partkey % 11 = 10 then @noarr when l_partkey % 17 = 16 then @arr('cb' || @s(@div(l_partkey / 4)), 'cb-none') else @arr('cb' || @s(@div(l_partkey / 4))) end as bundle_ids,
  case when l_partkey % 13 = 12 then @noarr when l_partkey % 19 = 18 then @arr('co-none') else @arr('co' || @s(@div(l_partkey / 2))) end as observation_ids
from lineitem"""


# Views that stand for landed tables (trees, file contents, parser output): they are
# written once per data folder, so queries scan columns instead of rebuilding them.
LANDED = ("v_files", "v_tree", "v_symbols", "v_slices", "v_relations", "v_catalog", "v_style", "v_tasks",
          "v_concepts", "v_task_text", "v_py_imports", "v_rs_imports", "v_claims", "v_bundle_slices", "v_extra", "v_bundles",
          "v_reviews", "v_review_slices", "v_review_bundles")
# Of these, views of a few narrow columns: they are written from the given tables where their inputs are not landed yet, so a query that
# needs no file contents writes none.
NARROW = {"v_tree": ("v_files", "v_extra")}


def needs(sql: str, stop: tuple[str, ...] = ()) -> list[str]:
    """Views named in a query, dependencies first; views in `stop` are not looked into."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b[vo]_[a-z_]+\b", text):
            if name in VIEWS and name not in order:
                body = VIEWS[name]
                if name not in stop:
                    visit(body if isinstance(body, str) else body["duck"])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_views(sql: str, dialect: str, stop: tuple[str, ...] = ()) -> str:
    """`sql` with a WITH clause that defines every view it names (but those in `stop`)."""
    parts = []
    for name in needs(sql, stop):
        if name not in stop:
            body = VIEWS[name]
            parts.append(f"{name} as ({render(body if isinstance(body, str) else body[dialect], dialect)})")
    text = render(sql, dialect).strip()
    if not parts:
        return text
    head = re.match(r"(?is)with\s+(recursive\s+)?", text)
    if head:
        return ("with recursive " if head.group(1) else "with ") + ",\n".join(parts) + ",\n" + text[head.end():]
    return "with " + ",\n".join(parts) + "\n" + text


_LANDED_AT: dict[tuple[str, str, str], str] = {}


class Inputs:
    """Base tables of one data folder plus the derived views, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._made: dict = {}

    def memo(self, key, make):
        """One DataFrame per step of a query, however many later steps read it."""
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def base(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def _register(self, text: str, instead: dict[str, DataFrame]) -> None:
        """Make the base tables a query names visible, reading only those; `instead` holds what stands in for some."""
        for table in BASE_TABLES:
            if re.search(rf"\b{table}\b", text):
                (instead[table] if table in instead else self.base(table)).createOrReplaceTempView(table)

    def _land(self, name: str) -> None:
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _LANDED_AT:
            body = VIEWS[name]
            text = body if isinstance(body, str) else body["spark"]
            path = f"{work_folder(self.spark)}/{name}"
            write_table(self._prepared(text, tuple(x for x in NARROW.get(name, ()) if not self.has_landed(x))), path)
            _LANDED_AT[key] = path
        self.spark.read.parquet(_LANDED_AT[key]).createOrReplaceTempView(name)

    def has_landed(self, name: str) -> bool:
        return (self.spark.sparkContext.applicationId, self.folder, name) in _LANDED_AT

    def _prepared(self, text: str, inline: tuple[str, ...] = (), instead: dict[str, DataFrame] | None = None) -> DataFrame:
        stop = tuple(x for x in LANDED if x not in inline)
        for name in needs(text, stop):
            if name in stop:
                self._land(name)
        full = with_views(text, "spark", stop)
        self._register(full, instead or {})
        return self.spark.sql(full)

    def unlanded(self, name: str, **instead: DataFrame) -> DataFrame:
        """A landed view's rows without writing it, so that columns and rows which a query does not use are not made.

        `instead` stands in for base tables of these names; without it the view is read where it is landed already.
        """
        return self(name) if self.has_landed(name) and not instead else self._prepared(f"select * from {name}", (name,), instead)

    def __call__(self, name: str) -> DataFrame:
        return self.memo(name, lambda: self._prepared(f"select * from {name}"))

    def sql(self, text: str) -> DataFrame:
        return self._prepared(text)
