"""Plain greedy loops that the distributed operators are held against."""

from __future__ import annotations


def _weight(name: str) -> int:
    return 1000 if name.startswith("modality:") else 200 if name.startswith("role:") else 20


def _covers(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    for s, e in sorted(spans):
        if s <= start <= e:
            start = e + 1
    return start > end


def _supported(edge, chosen) -> bool:
    target = any(c.path == edge["dst"] for c in chosen)
    spans = [(c.start_line, c.end_line) for c in chosen if c.path == edge["src"]]
    return bool(target and edge["located"] and _covers(spans, edge["s"], edge["e"]))


def greedy_cover(items: list, edges: list[dict], max_slices: int, max_chars: int) -> list[tuple]:
    """Picks (item, gain, gained features) in order: most new weight, then relevance, shorter, id."""
    by_path: dict[str, list[dict]] = {}
    for e in edges:
        for p in {e["src"], e["dst"]}:
            by_path.setdefault(p, []).append(e)
    pool, chosen, covered, used = list(items), [], set(), 0
    while pool and len(chosen) < max_slices:
        best = None
        for it in pool:
            if it.chars > max_chars - used:
                continue
            gains = {f: _weight(f) for f in it.features if f not in covered}
            for e in by_path.get(it.path, []):
                if _supported(e, [c for c, _g, _f in chosen] + [it]):
                    gains["role:relationship"] = 200
                elif it.path == e["src"] and it.anchor:
                    gains["relationship:anchor"] = 80
                elif it.path == e["dst"] and "role:relationship" not in covered:
                    gains["relationship:target"] = 40
            gains = {f: w for f, w in gains.items() if f not in covered}
            total = sum(gains.values())
            rank = (-total, -it.relevance, it.chars, it.slice_id)
            if best is None or rank < best[0]:
                best = (rank, it, total, sorted(gains))
        if best is None or best[2] == 0:
            break
        _rank, it, total, names = best
        pool.remove(it)
        chosen.append((it, total, names))
        covered.update(names)
        used += it.chars
    return chosen


def cover_of_tasks(selected, candidates, edges, max_slices, max_chars):
    """{(task, repository, slice): (place, status, gain, gained features)} by the loop above, repositories in order, budgets shared."""
    out = {}
    for task in {t for t, _, _ in selected}:
        groups = [(name, [c for c in candidates if c.full_name == name]) for _, name in sorted((r, n) for t, n, r in selected if t == task)]
        groups = [(n, g) for n, g in groups if g]
        slices = chars = 0
        for i, (name, items) in enumerate(groups):
            left = len(groups) - i
            slots, room = (max_slices - slices) // left, (max_chars - chars) // left
            picked = greedy_cover(items, [e for e in edges if e["full_name"] == name], slots, room)
            spent = sum(it.chars for it, _, _ in picked)
            for n, (it, gain, names) in enumerate(picked, 1):
                out[task, name, it.slice_id] = (n, "selected", gain, tuple(names))
            for it in items:
                if (task, name, it.slice_id) not in out:
                    out[task, name, it.slice_id] = (None, "budget" if it.chars > room - spent or len(picked) >= slots else "redundant", 0, ())
            slices, chars = slices + len(picked), chars + spent
    return out
