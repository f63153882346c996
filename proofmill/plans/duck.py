"""Helpers for the comparison queries: snippets of plain SQL."""

from __future__ import annotations

from proofmill import fixed_values as fv

SPACES = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return ", ".join(lit(v) for v in values)


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit(pattern)})"


def norm(x: str) -> str:
    camel = f"regexp_replace(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower({camel}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + SPACES + '+|' + SPACES + '+$')}, '', 'g')"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(SPACES + '+')}, ' ', 'g'))"


def contains_norm(hay: str, needle: str) -> str:
    return (f"({needle} <> '' and case when regexp_matches({needle}, '[\\x{{4e00}}-\\x{{9fff}}]') then contains({hay}, {needle}) "
            f"else contains(' ' || {hay} || ' ', ' ' || {needle} || ' ') end)")


def meaningful(x: str, prefs: str = "''") -> str:
    return (f"list_filter(split({norm(x)}, ' '), lambda t: length(t) >= case when regexp_matches(t, '[\\x{{4e00}}-\\x{{9fff}}]') then 2 else 3 end "
            f"and not list_contains([{words(fv.GENERIC_WORDS)}], t) and not list_contains(split({norm(prefs)}, ' '), t))")


def reasons(*pairs: tuple[str, str]) -> str:
    """`|`-joined messages whose condition holds; messages are SQL expressions."""
    items = ", ".join(f"case when {c} then {m} end" for c, m in pairs)
    return f"concat_ws('|', {items})"


def stable_id(*parts: str) -> str:
    return f"substring(sha256(concat_ws(chr(0), {', '.join(parts)})), 1, 16)"


def dirname(p: str) -> str:
    return f"case when contains({p}, '/') then regexp_extract({p}, '^(.*)/[^/]*$', 1) else '.' end"


def is_code(p):
    return rx(p, fv.CODE_FILE)


def is_support(p):
    return rx(p, fv.TEST_SUPPORT)


def is_test(p):
    return f"({rx(p, fv.TEST_PATH)} and not {is_support(p)})"


def is_behavior(p):
    return f"({is_code(p)} and not {rx(p, fv.CONFIG_OR_DECLARATION)})"


def is_impl(p):
    return (f"({is_behavior(p)} and not {is_test(p)} and not {is_support(p)} and not {rx(p, fv.BUILD_SUPPORT)} and "
            f"({rx(p, fv.ROOT_LEVEL)} or {rx(p, fv.IMPLEMENTATION_TREE)} or ({rx(p, fv.PYTHON_FILE)} and not {rx(p, fv.NON_SOURCE_TREE)})))")


def primary_kind(p="path", e="evidence_roles", a="architecture_roles"):
    return (f"case when coalesce(len({e}) = 0 and list_contains({a}, 'relationship'), false) then 'relationship' "
            f"when {rx(p, fv.MANIFEST_FILE)} then 'manifest' when {is_support(p)} then 'test-support' "
            f"when coalesce(list_contains({e}, 'test') and not list_contains({e}, 'implementation'), false) or {is_test(p)} then 'test' "
            f"when {rx(p, fv.DOCUMENTATION_PATH)} then 'documentation' else 'implementation' end")


def semantic_kinds(e="evidence_roles"):
    return (f"list_filter([case when list_contains({e}, 'implementation') then 'implementation' end, "
            f"case when list_contains({e}, 'test') then 'test' end], lambda x: x is not null)")


def slice_kinds(p="path", e="evidence_roles", a="architecture_roles"):
    return f"case when len({semantic_kinds(e)}) > 0 then {semantic_kinds(e)} else [{primary_kind(p, e, a)}] end"


def quality_modalities(p="path", e="evidence_roles", a="architecture_roles"):
    return (f"case when coalesce(len({e}) = 0 and list_contains({a}, 'relationship'), false) then ['relationship'] "
            f"when len({semantic_kinds(e)}) > 0 then {semantic_kinds(e)} when {rx(p, fv.MANIFEST_FILE)} then ['manifest'] "
            f"when {is_support(p)} then ['test-support'] when {is_test(p)} then ['test'] when {rx(p, fv.DOCUMENTATION_PATH)} then ['documentation'] "
            f"when {is_impl(p)} then ['implementation'] else cast([] as varchar[]) end")


def joined(array: str) -> str:
    return f"array_to_string({array}, '|')"
