"""What screens say, as text: one line for each arm of a collected report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.evaluation import MIN_CLUSTERS, SATURATION

#: Words for what stands against a result.
CAVEATS = {
    "few_clusters": f"fewer than {MIN_CLUSTERS} papers: the intervals are wide, and small differences can't be told",
    "saturated": f"success is above {SATURATION:.0%}: read the reciprocal rank",
}


def interval(point: float | None, lo: float | None, hi: float | None) -> str:
    return "-" if point is None else f"{point:.3f} [{lo:.3f}, {hi:.3f}]"


def change(row, metric: str) -> str:
    """A paired difference with its interval, starred where it is detectable."""
    point = row[f"{metric}_delta_point"]
    star = "*" if row[f"{metric}_delta_detectable"] else ""
    return "-" if point is None else f"{point:+.3f} [{row[f'{metric}_delta_ci_lo']:+.3f}, {row[f'{metric}_delta_ci_hi']:+.3f}]{star}"


def table(heads: list[str], rows: list[list[str]]) -> str:
    widths = [max(len(r[i]) for r in [heads, *rows]) for i in range(len(heads))]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip()
    return "\n".join([line(heads), line(["-" * w for w in widths]), *map(line, rows)])


def screen(report: DataFrame, default: str) -> str:
    """The default first, then the other arms by name, and what to keep in mind below."""
    rows = sorted(report.collect(), key=lambda r: (r["arm"] != default, r["arm"]))
    cells = [[r["arm"], *(x for m in ("success", "mrr") for x in (interval(r[f"{m}_point"], r[f"{m}_ci_lo"], r[f"{m}_ci_hi"]), change(r, m)))] for r in rows]
    said = sorted({w for r in rows for w in r["warnings"] or []})
    better = [r["arm"] for r in rows if any(r[f"{m}_delta_detectable"] and r[f"{m}_delta_point"] > 0 for m in ("success", "mrr"))]
    return "\n".join([
        table(["arm", "success", "change", "mrr", "change"], cells),
        f"better than {default}: {', '.join(better) if better else 'none that can be told'}",
        *(f"note: {CAVEATS[w]}" for w in said),
    ])


def run(summary: DataFrame, k: int, candidates: int) -> str:
    r = summary.first()
    return f"success@{candidates} {r['success']:.3f}  mrr@{k} {r['mrr']:.3f}  (with gold in the pool: {r['n_conditioned']}, without gold: {r['n_ungoldable']})"


def elbow(rows: DataFrame) -> str:
    told = sorted(rows.collect(), key=lambda r: r["arm"])
    return table(["arm", "returned", "recall", "precision"], [[r["arm"], f"{r['mean_returned']:.2f}", f"{r['recall']:.3f}", f"{r['precision']:.3f}"] for r in told])


def cells(sizes: DataFrame) -> str:
    told = sorted(sizes.collect(), key=lambda r: (r["change"] != 0, r["arm"]))
    return table(["cell", "chunks", "change", "lost ids"], [[r["arm"], str(r["n_chunks"]), f"{r['change']:+d}", str(r["collisions"])] for r in told])
