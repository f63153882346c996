"""Tunable limits of every operator, as one frozen dataclass.

``None`` means "no cap", and is the default wherever a limit would only cut a result.  Numbers remain
where they are the feature: top-k searches and picks, selection budgets, thresholds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from proofmill import fixed_values as fv


@dataclass(frozen=True)
class Params:
    # discovery
    min_stars: int = 100
    candidate_limit: int = 12
    inspect_limit: int = 6
    max_queries: int = 5
    # acceptance
    min_overall: int = 60
    min_domain: int = 50
    max_risk: int = 45
    license_policy: str = "warn"
    allowed_licenses: tuple[str, ...] = field(default_factory=lambda: tuple(fv.ALLOWED_LICENSES))
    # slicing
    max_repositories: int = 2
    files_per_repository: int | None = None
    lines_per_slice: int = 60
    max_slices: int = 48
    slice_characters: int = 120_000
    # structural reads
    atlas_files: int | None = None
    atlas_characters: int | None = None
    max_file_bytes: int | None = None
    min_coverage: int = 50
    required_categories: tuple[str, ...] = ("source", "test")
    # bundles
    bundles_per_repository: int | None = None
    slices_per_bundle: int | None = None
    min_kinds: int = 2
    # review
    min_confidence: float = 0.7
    min_cited_slices: int = 1
    max_review_risk: str = "medium"
    # observations and advisory
    observations_per_repository: int | None = None
    witnesses_per_observation: int | None = None
    benefit_threshold: int = 60
    brief_observations: int = 5
    # workspaces
    workspace_files: int = 48
    workspace_characters: int = 160_000
    workspace_file_characters: int = 40_000
    workspace_candidates: int | None = None
    # payloads
    payload_characters: int = 60_000
    # recency, in days
    recent_days: int = 180
    stale_days: int = 730


DEFAULT = Params()
