"""Path predicates: one boolean (or category) column each, evaluated on `path` alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofmill import fixed_values as fv


def is_code(p: Column) -> Column:
    return p.rlike(fv.CODE_FILE)


def is_test_support(p: Column) -> Column:
    return p.rlike(fv.TEST_SUPPORT)


def is_test(p: Column) -> Column:
    return p.rlike(fv.TEST_PATH) & ~is_test_support(p)


def is_marker(p: Column) -> Column:
    return p.rlike(fv.PACKAGE_MARKER)


def is_build_support(p: Column) -> Column:
    return p.rlike(fv.BUILD_SUPPORT)


def is_behavior_code(p: Column) -> Column:
    return is_code(p) & ~p.rlike(fv.CONFIG_OR_DECLARATION)


def is_implementation(p: Column) -> Column:
    placed = (p.rlike(fv.ROOT_LEVEL) | p.rlike(fv.IMPLEMENTATION_TREE)
              | (p.rlike(fv.PYTHON_FILE) & ~p.rlike(fv.NON_SOURCE_TREE)))
    return is_behavior_code(p) & ~is_test(p) & ~is_test_support(p) & ~is_build_support(p) & placed


def ecosystem(p: Column) -> Column:
    return (F.when(p.rlike(r"(?i)package\.json$"), "node")
            .when(p.rlike(r"(?i)pyproject\.toml$|setup\.cfg$"), "python")
            .when(p.rlike(r"(?i)Cargo\.toml$"), "rust")
            .when(p.rlike(r"(?i)go\.mod$"), "go")
            .when(p.rlike(r"(?i)pom\.xml|build\.gradle"), "jvm")
            .otherwise("unknown"))


def doc_kind(p: Column) -> Column:
    return (F.when(p.rlike(fv.SECURITY_FILE), "security")
            .when(p.rlike(fv.DESIGN_FILE), F.when(p.rlike(fv.DECISION_NAME), "decision").otherwise("architecture"))
            .otherwise("overview"))


def is_arch_doc(p: Column) -> Column:
    return p.rlike(fv.OVERVIEW_FILE) | p.rlike(fv.DESIGN_FILE) | p.rlike(fv.SECURITY_FILE)


def modality(p: Column) -> Column:
    """Slice-selection modality of a path, in precedence order."""
    return (F.when(is_test_support(p), "test-support")
            .when(is_test(p), "test")
            .when(p.rlike(fv.MANIFEST_FILE), "manifest")
            .when(p.rlike(fv.SLICE_DESIGN) | p.rlike(fv.OVERVIEW_FILE), "documentation")
            .otherwise("implementation"))


def slice_kinds(p: Column, evidence_roles: Column, architecture_roles: Column) -> Column:
    """Evidence kinds of a slice; a NULL `evidence_roles` means the file was not parsed."""
    semantic = F.array_compact(F.array(
        F.when(F.array_contains(evidence_roles, "implementation"), "implementation"),
        F.when(F.array_contains(evidence_roles, "test"), "test")))
    single = primary_kind(p, evidence_roles, architecture_roles)
    return F.when(F.size(semantic) > 0, semantic).otherwise(F.array(single))


def primary_kind(p: Column, evidence_roles: Column, architecture_roles: Column) -> Column:
    """The one kind used when a representative per kind is picked."""
    anchor_only = (F.size(evidence_roles) == 0) & F.array_contains(architecture_roles, "relationship")
    only_test = F.array_contains(evidence_roles, "test") & ~F.array_contains(evidence_roles, "implementation")
    no = F.lit(False)
    return (F.when(F.coalesce(anchor_only, no), "relationship")
            .when(p.rlike(fv.MANIFEST_FILE), "manifest")
            .when(is_test_support(p), "test-support")
            .when(F.coalesce(only_test, no) | is_test(p), "test")
            .when(p.rlike(fv.DOCUMENTATION_PATH), "documentation")
            .otherwise("implementation"))


def quality_modalities(p: Column, evidence_roles: Column, architecture_roles: Column) -> Column:
    """Like `slice_kinds`, but unclassified paths give an empty array."""
    no = F.lit(False)
    anchor_only = F.coalesce((F.size(evidence_roles) == 0) & F.array_contains(architecture_roles, "relationship"), no)
    semantic = F.array_compact(F.array(
        F.when(F.array_contains(evidence_roles, "implementation"), "implementation"),
        F.when(F.array_contains(evidence_roles, "test"), "test")))
    by_path = (F.when(p.rlike(fv.MANIFEST_FILE), "manifest")
               .when(is_test_support(p), "test-support")
               .when(is_test(p), "test")
               .when(p.rlike(fv.DOCUMENTATION_PATH), "documentation")
               .when(is_implementation(p), "implementation"))
    return (F.when(anchor_only, F.array(F.lit("relationship")))
            .when(F.size(semantic) > 0, semantic)
            .otherwise(F.array_compact(F.array(by_path))))


def is_safe(p: Column) -> Column:
    bad_segment = F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))
    return (p != "") & ~p.startswith("/") & ~F.contains(p, F.lit("\\")) & ~bad_segment & ~p.rlike(r"[\x00\r\n]")


def depth(p: Column) -> Column:
    return F.size(F.split(p, "/"))


def dirname(p: Column) -> Column:
    """Directory of a path; '.' at the root."""
    d = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.when(F.contains(p, F.lit("/")), d).otherwise(F.lit("."))


def join_path(base: Column, rel: Column) -> Column:
    """POSIX join and normalisation of two relative paths, folding '.' and '..'."""
    parts = F.filter(F.split(F.concat_ws("/", base, rel), "/"), lambda s: ~s.isin("", "."))

    def step(acc: Column, seg: Column) -> Column:
        can_pop = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when(seg != "..", F.array_append(acc, seg)).otherwise(
            F.when(can_pop, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, seg)))

    empty = F.array().cast("array<string>")
    folded = F.array_join(F.aggregate(parts, empty, step), "/")
    return F.regexp_replace(folded, "^$", ".")
