"""What each stage of the pipeline must keep, the plain way."""

from tests.llm.test_lines_and_benchmark import brute_hits, brute_lines
from tests.llm.test_near_duplicates import brute_components


def brute_pipeline_stage(name, before, after, items):
    rows = [(r.doc_id, r.text) for r in before]
    kept = sorted((r.doc_id, r.text) for r in after) if name != "best_fit_packing" else None
    if name == "language_id":
        letters = {d for d, t in rows if any(c.isalpha() for c in t or "")}
        assert {d for d, _ in kept} <= letters and len(kept) >= 0.99 * sum(d in letters for d, _ in rows)
        assert set(kept) <= set(rows)
    elif name == "line_dedup":
        assert kept == sorted((d, t) for d, t, _, _ in brute_lines(rows))
        assert all(r.n_chars == len(r.text) for r in after)
    elif name == "near_duplicates":
        unique = {d: t for d, t in rows}
        roots = {d for d, _, c in brute_components(list(unique.items())) if d == c}
        assert kept == sorted((d, unique[d]) for d in roots)
    elif name == "benchmark_decontamination":
        hits = {d: brute_hits(t, items, 13) for d, t in rows}
        assert [d for d, _ in kept] == sorted(d for d, (n, hit, _) in hits.items() if not (hit and 20 * hit >= n))
        assert all(t == dict(rows)[d] for d, t in kept if not hits[d][1])
    else:
        total = {}
        for r in after:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        assert total == {d: len((t or "").split()) for d, t in rows}
