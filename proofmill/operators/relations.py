"""Import and fixture resolution: candidates are exploded and equi-joined with the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import paths as pt
from proofmill.functions.frames import stage
from proofmill.operators.structure import cap_per_group
from proofmill.sources.sinks import landed

REQUIRE = r"(?<![A-Za-z0-9_])" + fv.REQUIRE_CALL
DYNAMIC = r"(?<![A-Za-z0-9_])" + fv.DYNAMIC_IMPORT


def scan_imports_js(blobs: DataFrame) -> DataFrame:
    """Textual import specifiers of script files, in scan order."""
    found = F.concat(*[F.regexp_extract_all("content", F.lit(rx), F.lit(1)) for rx in (fv.IMPORT_FROM, REQUIRE, DYNAMIC)])
    return (blobs.filter(F.col("path").rlike(fv.SCRIPT_SOURCE))
            .select("full_name", "revision", "path", F.posexplode(found).alias("ord", "specifier")))


def script_candidates(base: Column) -> Column:
    """Files a relative specifier may mean, beyond the exact path."""
    swapped = base
    for js, ts in fv.SCRIPT_SWAPS.items():
        swapped = F.regexp_replace(swapped, rf"\{js}$", ts)
    swap = F.when(base.rlike(r"\.[cm]?jsx?$"), swapped)
    tails = [F.concat(base, F.lit(e)) for e in fv.SCRIPT_EXTENSIONS] + [F.concat(base, F.lit("/index" + e)) for e in fv.SCRIPT_EXTENSIONS]
    return F.array_distinct(F.array_compact(F.array(swap, *tails)))


def resolve_relative_imports(imports: DataFrame, tree: DataFrame) -> DataFrame:
    """Relative specifier -> file: the exact path wins, otherwise a unique candidate."""
    base = pt.join_path(pt.dirname(F.col("path")), F.col("specifier"))
    asked = stage(imports.filter(F.col("specifier").startswith(".")).select("full_name", "path", "specifier").distinct(), base=base)
    options = asked.select("full_name", "path", "specifier", F.explode(F.concat(
        F.array(F.struct(F.lit(True).alias("exact"), F.col("base").alias("file"))),
        F.transform(script_candidates(F.col("base")), lambda c: F.struct(F.lit(False).alias("exact"), c.alias("file"))))).alias("o"))
    files = tree.filter("type = 'blob'").select("full_name", F.col("path").alias("file"))
    hits = options.select("full_name", "path", "specifier", "o.exact", "o.file").join(files, ["full_name", "file"])
    found = hits.groupBy("full_name", "path", "specifier").agg(
        F.max(F.when(F.col("exact"), F.col("file"))).alias("exact_file"), F.countDistinct("file").alias("n"), F.max("file").alias("any_file"))
    target = F.coalesce("exact_file", F.when(F.col("n") == 1, F.col("any_file")))
    return found.select("full_name", "path", "specifier", target.alias("target")).filter("target is not null")


def build_relations(imports: DataFrame, tree: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct edges; kind `tests` when the source is a test path."""
    resolved = imports.join(resolve_relative_imports(imports, tree), ["full_name", "path", "specifier"])
    kind = F.when(pt.is_test(F.col("path")), "tests").otherwise("imports")
    edges = resolved.groupBy("full_name", F.col("path").alias("src"), F.col("target").alias("dst"), kind.alias("kind")).agg(F.min("ord").alias("ord"))
    return cap_per_group(edges, ["full_name"], ["src", "ord", "dst"], limit).drop("ord")


TYPED = ["full_name", "src", "dst", "kind", "language", "line", "resolution"]
NO_NAMES = "cast(array() as array<string>)"


def typed_relations(tree: DataFrame, blobs: DataFrame, script_imports: DataFrame, python_imports: DataFrame, python_edges: DataFrame, rust_imports: DataFrame, rust_edges: DataFrame) -> DataFrame:
    """One edge table of all languages: TYPED, the import's scope, context (array) and aliases (array).

    * Scripts: parsed imports (script_imports: full_name, path, line, module, scope, context, aliases) of the files that have any, otherwise
      what the text shows; an edge of two files and a kind counts once, at its first import.  Edges from text have no line and no resolution.
    * Python and Rust: the resolved edges (PY_KEY or RS_KEY and dst), once per line.

    An edge is a test's where its source is a test file, or, in Rust, where the import stands under cfg(test).
    """
    plain = F.when(pt.is_test(F.col("path")), "tests").otherwise("imports")
    parsed = script_imports.select("full_name", "path").distinct()
    read = script_imports.filter(F.col("module").startswith(".")).select("full_name", "path", F.col("module").alias("specifier"), F.col("line").alias("ord"), "line", F.coalesce("scope", F.lit("module")).alias("scope"), "context", "aliases",
                                                                       F.lit("static-candidate").alias("resolution"))
    texts = scan_imports_js(blobs.join(parsed, ["full_name", "path"], "left_anti")).select(
        "full_name", "path", "specifier", F.col("ord").cast("long").alias("ord"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("scope"), F.expr(NO_NAMES).alias("context"),
        F.expr(NO_NAMES).alias("aliases"), F.lit(None).cast("string").alias("resolution"))
    scripts = landed(read.unionByName(texts), "script-imports")
    found = scripts.join(resolve_relative_imports(scripts, tree), ["full_name", "path", "specifier"])
    facts = ["line", "resolution", "scope", "context", "aliases"]

    def once(rows: DataFrame, key: list[str], language: str) -> DataFrame:
        first = rows.groupBy(*key).agg(F.min(F.struct("ord", *[f for f in facts if f not in key])).alias("f"))
        rest = [F.col(f"f.{f}").alias(f) for f in facts if f not in key]
        return first.select(*key, *rest).withColumn("language", F.lit(language)).select(*TYPED, "scope", "context", "aliases")

    ends = ["full_name", "src", "dst", "kind"]
    script = once(found.select("full_name", F.col("path").alias("src"), F.col("target").alias("dst"), plain.alias("kind"), "ord", *facts), ends, "script")

    def backed(imports: DataFrame, edges: DataFrame, key: list[str], names: str, resolution: str, kind: Column) -> DataFrame:
        blank = {c: F.lit(None).cast("string") if c == "scope" else F.expr(NO_NAMES) for c in ("scope", "context", names) if c not in imports.columns}
        rows = imports.withColumns(blank).withColumns({"scope": F.coalesce("scope", F.lit("module")), "context": F.coalesce("context", F.expr(NO_NAMES)), "aliases": F.coalesce(names, F.expr(NO_NAMES))})
        return edges.join(rows.select(*key, "scope", "context", "aliases"), key).select(
            "full_name", F.col("path").alias("src"), "dst", kind.alias("kind"), "line", F.lit(resolution).alias("resolution"), F.col("module").alias("ord"), "scope", "context", "aliases")

    under_test = F.exists("context", lambda c: c.rlike(r"cfg\s*\(\s*test\s*\)"))
    python = once(backed(python_imports, python_edges, PY_KEY, "aliases", "static-candidate", plain), [*ends, "line"], "python")
    rust = once(backed(rust_imports, rust_edges, RS_KEY, "aliases", "rust-module-candidate", F.when(under_test, "tests").otherwise(plain)), [*ends, "line"], "rust")
    return script.unionByName(python).unionByName(rust)


IDENTIFIER = r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$"


def python_import_roots(tree: DataFrame, declared: DataFrame) -> DataFrame:
    """Candidate import roots: '.', 'src', manifest folders and their src, safe declared roots.

    `declared` has full_name, path (of the manifest) and root.
    """
    folder = pt.dirname(F.col("path"))
    fixed = tree.select("full_name").distinct().select("full_name", F.explode(F.array(F.lit("."), F.lit("src"))).alias("root"))
    found = tree.filter(F.col("path").rlike(r"(^|/)(pyproject\.toml|setup\.cfg)$")).select(
        "full_name", F.explode(F.array(folder, pt.join_path(folder, F.lit("src")))).alias("root"))
    safe = (F.col("root").rlike(r"^[\w./-]+$") & ~F.col("root").startswith("/")
            & ~F.array_contains(F.split("root", "/"), ".."))
    named = declared.filter(safe).select("full_name", pt.join_path(folder, F.col("root")).alias("root"))
    return fixed.union(found).union(named).distinct()


def _ancestors(directory: Column) -> Column:
    """A directory and all its parents, ending in '.'."""
    parts = F.split(directory, "/")
    nested = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(directory == ".", F.array(F.lit("."))).otherwise(F.concat(nested, F.array(F.lit("."))))


PY_KEY = ["full_name", "path", "line", "level", "module"]


def module_places(tree: DataFrame) -> DataFrame:
    """The module paths of each repository as a table: (full_name, loc, is_dir, is_py, has_init) for every directory and Python file."""
    files = tree.filter("type = 'blob'").select("full_name", "path")
    dirs = files.select("full_name", F.explode(_ancestors(pt.dirname(F.col("path")))).alias("loc"), F.lit("dir").alias("kind"))
    mods = files.filter("path like '%.py'").select("full_name", F.regexp_replace("path", r"\.py$", "").alias("loc"), F.lit("py").alias("kind"))
    inits = files.filter("path like '%__init__.py'").select("full_name", pt.dirname(F.col("path")).alias("loc"), F.lit("init").alias("kind"))
    seen = lambda kind: F.bool_or(F.col("kind") == kind)
    return dirs.union(mods).union(inits).groupBy("full_name", "loc").agg(seen("dir").alias("is_dir"), seen("py").alias("is_py"), seen("init").alias("has_init")).filter("is_dir or is_py")


def _depth(c: Column) -> Column:
    return F.when(c == ".", 0).otherwise(F.size(F.split(c, "/")))


def resolve_python_imports(imports: DataFrame, roots: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved) of Python imports; only unambiguous conventional layouts resolve.

    Names are resolved once per distinct name (`asked`: an absolute module, or the place that a relative one climbs to), against the
    landed tables of module places and files; import rows meet the answers by key.
    """
    files = landed(tree.filter("type = 'blob'").select("full_name", F.col("path").alias("file")), "python-files")
    roots = landed(roots.select("full_name", "root").distinct(), "python-roots")
    mod_path = F.when(F.col("module").rlike(IDENTIFIER), F.replace("module", F.lit("."), F.lit("/")))
    named = landed(imports.select(*PY_KEY, "names", mod_path.alias("mod_path"), pt.dirname(F.col("path")).alias("dir")).distinct(), "python-names")

    # Absolute names: refuse a name any of whose prefixes exists in two places.
    absolute = named.filter("level = 0 and mod_path is not null").select("full_name", "module", "mod_path").distinct()
    parts = F.split("mod_path", "/")
    prefixes = absolute.select("full_name", "module", F.size(parts).alias("n"), F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("i", "prefix"))
    located = prefixes.join(roots, "full_name").withColumn("loc", pt.join_path(F.col("root"), F.col("prefix"))).select(
        "full_name", "module", "n", "i", "loc").distinct().join(landed(module_places(tree), "python-places"), ["full_name", "loc"])
    clash = F.col("is_py") & ((F.col("i") + 1 < F.col("n")) | F.col("has_init"))
    ambiguous = located.groupBy("full_name", "module", "i").agg(F.count("*").alias("places"), F.bool_or(clash).alias("clash")).filter(
        "places > 1 or clash").select("full_name", "module").distinct()
    ambiguous = landed(ambiguous, "python-ambiguous")

    # Relative names climb from the importing directory, bounded by the package depth.
    owners = (named.filter("level > 0").select("full_name", "dir").distinct().withColumn("root", F.explode(_ancestors(F.col("dir")))).join(roots, ["full_name", "root"])
              .groupBy("full_name", "dir").agg(F.max_by("root", F.length("root")).alias("owner")))
    up = F.array_join(F.slice(F.split("dir", "/"), 1, F.greatest(_depth(F.col("dir")) - F.col("level") + 1, F.lit(0)).cast("int")), "/")
    climbs = (F.col("level") > 0) & ((F.col("module") == "") | F.col("mod_path").isNotNull()) & (F.col("level") <= _depth(F.col("dir")) - _depth(F.coalesce("owner", F.lit("."))))
    place = F.when(climbs, pt.join_path(up, F.coalesce("mod_path", F.lit(""))))
    rows = stage(named.join(owners, ["full_name", "dir"], "left"), place=place)
    fine = rows.join(ambiguous.withColumn("clashes", F.lit(True)), ["full_name", "module"], "left").withColumn("clashes", F.coalesce("clashes", F.lit(False)) & (F.col("level") == 0))
    asked = F.when((F.col("level") == 0) & F.col("mod_path").isNotNull() & ~F.col("clashes"), F.concat(F.lit("module:"), "module")).otherwise(F.concat(F.lit("place:"), "place"))
    rows = landed(fine.select(*PY_KEY, "mod_path", "place", "clashes", asked.alias("asked"), F.filter("names", lambda n: (n != "*") & n.rlike(IDENTIFIER)).alias("names")), "python-asked")

    live = rows.filter("asked is not null")
    bases = live.filter("level = 0").select("full_name", "asked", "mod_path").distinct().join(roots, "full_name").select("full_name", "asked", pt.join_path(F.col("root"), F.col("mod_path")).alias("base")).unionByName(
        live.filter("level > 0").select("full_name", "asked", F.col("place").alias("base"))).distinct()
    names = live.select("full_name", "asked", F.explode(F.concat(F.array(F.lit("")), F.coalesce("names", F.expr("cast(array() as array<string>)")))).alias("name")).distinct()
    stem = F.when(F.col("name") == "", F.col("base")).otherwise(F.concat_ws("/", "base", F.replace("name", F.lit("."), F.lit("/"))))
    options = F.transform(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py"))), lambda f: F.when(F.col("name") == "", f).otherwise(pt.join_path(F.lit("."), f)))
    slots = bases.join(names, ["full_name", "asked"]).select("full_name", "asked", "name", F.explode(options).alias("file"))
    hits = slots.join(files, ["full_name", "file"]).groupBy("full_name", "asked", "name").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.max("file").alias("file"))
    hits = landed(hits, "python-hits")

    module = hits.filter("name = ''").select("full_name", "asked", F.col("n").alias("module_hits"), F.when(F.col("files") == 1, F.col("file")).alias("module_file"))
    closed = (F.col("module_hits") > 1) | (F.col("module_file").isNotNull() & ~F.col("module_file").endswith("/__init__.py"))
    met = live.join(module, ["full_name", "asked"], "left")
    children = met.filter(~F.coalesce(closed, F.lit(False))).select(*PY_KEY, "asked", F.explode("names").alias("name")).join(
        hits.filter("name <> '' and files = 1").select("full_name", "asked", "name", "file"), ["full_name", "asked", "name"])
    edges = landed(met.filter("module_hits = 1").select(*PY_KEY, F.col("module_file").alias("dst")).unionByName(children.select(*PY_KEY, F.col("file").alias("dst"))).distinct(), "python-edges")
    missing = rows.groupBy(*PY_KEY).agg(F.bool_or("clashes").alias("clashes")).join(edges.select(*PY_KEY), PY_KEY, "left_anti")
    unresolved = missing.select(*PY_KEY, F.when(F.col("clashes"), "ambiguous-package-prefix").otherwise("external-missing-or-unsupported-target").alias("reason"))
    return edges, unresolved


RS_KEY = ["full_name", "path", "line", "module"]


def resolve_rust_imports(imports: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved) of `mod` and `use` items with filesystem-backed targets.

    imports: RS_KEY plus kind ('module' or 'use'), scope, context.
    """
    files = tree.filter("type = 'blob'").select("full_name", F.col("path").alias("file"))
    p, m = F.col("path"), F.col("module")
    parts = F.split(p, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.rs$", "")
    owner = F.when(stem.isin("lib", "main", "mod"), pt.dirname(p)).otherwise(pt.join_path(pt.dirname(p), stem))
    last_src = F.size(parts) - F.array_position(F.reverse(parts), "src") + 1
    root = F.when(F.array_contains(parts, "src"), F.array_join(F.slice(parts, 1, last_src.cast("int")), "/"))
    scopes = F.when(F.coalesce("scope", F.lit("module")) == "module", F.array().cast("array<string>")).otherwise(
        F.filter(F.split("scope", "::"), lambda s: s != ""))
    segments = F.filter(F.transform(F.split(m, "::"), lambda s: F.trim(s)), lambda s: ~s.isin("", "self", "*"))
    r = stage(imports, owner=owner, root=root, scopes=scopes, segments=segments)
    supers = F.size("segments") - F.size(F.aggregate("segments", F.array().cast("array<string>"), lambda acc, s: F.when(
        (s == "super") & (F.size(acc) == 0), acc).otherwise(F.array_append(acc, s))))
    first = F.get("segments", F.lit(0))
    r = stage(r, head=F.when(F.col("kind") == "module", "mod").when(F.col("root").isNull(), "no-root")
              .when(F.size("segments") == 0, "empty").when(first == "crate", "crate").when(first == "super", "super")
              .when(m.startswith("self::"), "self").otherwise("extern"), n_supers=supers)
    n_supers = F.when(F.col("head") == "super", F.col("n_supers")).otherwise(0)
    popped = F.least(n_supers, F.size("scopes"))
    owner_parts = F.split("owner", "/")
    climbed = F.array_join(F.slice(owner_parts, 1, F.greatest(F.size(owner_parts) - n_supers + popped, F.lit(0))), "/")
    inner = F.array_join(F.slice("scopes", 1, F.greatest(F.size("scopes") - popped, F.lit(0))), "/")
    used = F.when(F.col("head") == "crate", 1).otherwise(n_supers)
    r = stage(r, climbed=climbed, inner=inner,
              rest=F.slice("segments", used + 1, F.greatest(F.size("segments") - used, F.lit(0))))
    escapes = (F.col("head") == "super") & (F.col("climbed") != F.col("root")) & ~F.startswith("climbed", F.concat("root", F.lit("/")))
    path_attr = F.exists(F.coalesce("context", F.array().cast("array<string>")), lambda c: c.rlike(r"^path([^A-Za-z0-9_]|$)"))
    early = (F.when((F.col("head") == "mod") & path_attr, "explicit-path-module-unsupported")
             .when(F.col("head") == "no-root", "source-outside-conventional-crate-root")
             .when(F.col("head") == "empty", "empty-or-unsupported-use-tree")
             .when(escapes, "use-escapes-crate-root").when(F.col("head") == "extern", "extern-prelude-or-ambiguous-bare-use"))
    base = (F.when(F.col("head") == "crate", F.col("root"))
            .when(F.col("head") == "super", F.array_join(F.filter(F.array("climbed", "inner"), lambda x: x != ""), "/"))
            .when(F.col("head") == "mod", F.array_join(F.filter(F.array(F.col("owner"), F.col("inner"), m), lambda x: x != ""), "/"))
            .otherwise(F.col("owner")))
    r = stage(r, base=base, early=early, entry=(F.col("head") != "mod") & (F.size("rest") == 0))
    live = r.filter("early is null")
    none = F.array().cast("array<struct<len:int,file:string>>")

    def option(n: Column, base: Column, tail: str) -> Column:
        return F.struct(n.cast("int").alias("len"), F.concat(base, F.lit(tail)).alias("file"))

    prefixes = F.flatten(F.transform(F.sequence(F.lit(1), F.size("rest")), lambda i: F.array(
        option(i, F.concat_ws("/", "base", F.array_join(F.slice("rest", 1, i), "/")), ".rs"),
        option(i, F.concat_ws("/", "base", F.array_join(F.slice("rest", 1, i), "/")), "/mod.rs"))))
    options = (F.when(F.col("head") == "mod", F.array(option(F.lit(1), F.col("base"), ".rs"), option(F.lit(1), F.col("base"), "/mod.rs")))
               .when(F.col("entry"), F.array(option(F.lit(1), F.col("root"), "/lib.rs"), option(F.lit(1), F.col("root"), "/main.rs")))
               .when(F.size("rest") > 0, prefixes).otherwise(none))
    hits = live.select(*RS_KEY, F.explode(options).alias("o")).select(*RS_KEY, "o.len", "o.file").join(files, ["full_name", "file"])
    unique = hits.groupBy(*RS_KEY, "len").agg(F.countDistinct("file").alias("n"), F.max("file").alias("file")).filter("n = 1")
    edges = unique.groupBy(*RS_KEY).agg(F.max_by("file", "len").alias("dst"))
    late = (F.when(F.col("head") == "mod", "inline-generated-or-missing-module").when(F.col("entry"), "ambiguous-or-missing-crate-entry")
            .otherwise("external-missing-generated-or-inline-module"))
    unresolved = r.join(edges.select(*RS_KEY), RS_KEY, "left_anti").select(*RS_KEY, F.coalesce("early", late).alias("reason"))
    return edges, unresolved


def unresolved_imports(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Union of unresolved imports (full_name, path, line, module, reason), capped per repository."""
    columns = ["full_name", "path", "line", "module", "reason"]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return cap_per_group(out, ["full_name"], ["path", "line", "module", "reason"], limit)


def link_fixtures(symbols: DataFrame, limit: int | None = None) -> DataFrame:
    """Test/fixture request -> the lexically visible fixture, when exactly one is visible."""
    scope = F.array_join(F.slice(F.split("name", r"\."), 1, F.greatest(F.size(F.split("name", r"\.")) - 1, F.lit(0))), ".")
    s = symbols.withColumn("scope", scope)
    asks = s.filter(F.col("role").isin("test", "fixture")).select(
        "full_name", F.col("path").alias("test_path"), F.col("name").alias("test_symbol"), "scope", F.explode("fixture_requests").alias("request"))
    own_name = F.coalesce(F.nullif("fixture_name", F.lit("")), F.element_at(F.split("name", r"\."), -1))
    gives = s.filter("role = 'fixture'").select("full_name", F.col("path").alias("fixture_path"), F.col("name").alias("fixture_symbol"),
                                                F.col("scope").alias("fixture_scope"), own_name.alias("request"))
    same = asks.join(gives.withColumn("test_path", F.col("fixture_path")), ["full_name", "test_path", "request"]).filter(
        (F.col("fixture_scope") == "") | (F.col("fixture_scope") == F.col("scope")))
    shared = gives.filter(F.col("fixture_path").rlike(r"(^|/)conftest\.py$") & (F.col("fixture_scope") == "")).withColumn("dir", pt.dirname(F.col("fixture_path")))
    above = asks.withColumn("dir", F.explode(_ancestors(pt.dirname(F.col("test_path"))))).join(shared, ["full_name", "dir", "request"]).filter(
        "fixture_path <> test_path")
    key = ["full_name", "test_path", "test_symbol", "request"]
    columns = [*key, "fixture_path", "fixture_symbol"]
    seen = same.select(*columns).unionByName(above.select(*columns)).groupBy(*key).agg(
        F.count("*").alias("n"), F.max("fixture_path").alias("fixture_path"), F.max("fixture_symbol").alias("fixture_symbol"))
    out = asks.select(*key).distinct().join(seen, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = F.col("n") == 1
    out = out.select(*key, F.when(one, "candidate").otherwise("unresolved").alias("status"), F.when(one, F.col("fixture_path")).alias("fixture_path"),
                     F.when(one, F.col("fixture_symbol")).alias("fixture_symbol"),
                     F.when(one, "lexically-visible-fixture").when(F.col("n") > 1, "ambiguous-fixture-shadowing").otherwise("fixture-not-inspected-or-external-plugin").alias("reason"))
    return cap_per_group(out, ["full_name"], ["test_path", "test_symbol", "request"], limit)


def fixture_scope_completeness(links: DataFrame, tree: DataFrame, parsed: DataFrame) -> DataFrame:
    """Downgrade links whose enclosing fixture files were not all parsed."""
    scopes = tree.filter(pt.is_test_support(F.col("path"))).select("full_name", F.col("path").alias("scope_path"), pt.dirname(F.col("path")).alias("dir"))
    unread = scopes.join(parsed.select("full_name", F.col("path").alias("scope_path")).distinct(), ["full_name", "scope_path"], "left_anti")
    tests = links.select("full_name", "test_path").distinct().withColumn("dir", F.explode(_ancestors(pt.dirname(F.col("test_path")))))
    gaps = tests.join(unread, ["full_name", "dir"]).select("full_name", "test_path").distinct().withColumn("gap", F.lit(True))
    out = links.join(gaps, ["full_name", "test_path"], "left")
    gap = F.coalesce("gap", F.lit(False))
    return out.select("full_name", "test_path", "test_symbol", "request", F.when(gap, "unresolved").otherwise(F.col("status")).alias("status"),
                      F.when(~gap, F.col("fixture_path")).alias("fixture_path"), F.when(~gap, F.col("fixture_symbol")).alias("fixture_symbol"),
                      F.when(gap, "fixture-scope-not-completely-inspected").otherwise(F.col("reason")).alias("reason"))
