"""Command line: the merge of a fold program.

    python -m foldwright.cli --json program.json [--mode MODE]
    python -m foldwright.cli --scala Aggregator.scala [--to text|json|merge]
    python -m foldwright.cli --batch IN OUT [--jobs N] [--mode MODE]
    python -m foldwright.cli --report DIR [DIR ...]
"""

from __future__ import annotations

import argparse
import json
import multiprocessing
import sys
import time
from collections import Counter
from pathlib import Path

from .lang.ast import show
from .lang.typecheck import TypeProblem
from .sources.programs import read_program, statistics, write_program
from .sources.scala import read_scala, ScalaError
from .synth.derive import derive_merge
from .synth.refute import refute, refute_two_sided

MODES = ("full", "no-refute", "no-lift", "no-deduce", "no-decompose", "no-reduction")


def solve(f, mode: str = "full") -> dict:
    """Status, merge, statistics, sizes and seconds."""
    began = time.time()
    out = {"status": "Success", "normalizer": {"Ok": ""}, "input_stats": statistics(f), "input_ast_size": f.acc.size(), "normalizer_ast_size": 0}
    try:
        d = derive_merge(f, without=(mode.removeprefix("no-"),))
        if d.merge is None:
            found = (refute(f) or refute_two_sided(f)) if mode != "no-refute" else None
            out["status"] = "Refuted" if found else "Ordered"
            out["normalizer"] = {"Err": found.rule if found else f"{d.failure}; evaluate in order"}
        else:
            out["status"] = "Lifted" if d.lifted is not None else "Success"
            out["normalizer"], out["normalizer_ast_size"] = {"Ok": show(d.merge)}, d.merge.size()
    except TypeProblem as e:
        out["status"], out["normalizer"] = "Error", {"Err": str(e)}
    return out | {"elapsed": round(time.time() - began, 6)}


def _solve_file(task: tuple[str, str, str]) -> str:
    source, target, mode = task
    path = Path(source)
    try:
        f = read_program(path.read_text(), path.stem) if path.suffix == ".json" else read_scala(path.read_text())
        out = solve(f, mode)
    except (ScalaError, ValueError, KeyError) as e:
        out = {"status": "Error", "normalizer": {"Err": f"{type(e).__name__}: {e}"}, "elapsed": 0.0}
    Path(target).write_text(json.dumps(out) + "\n")
    return out["status"]


def batch(source: str, target: str, mode: str = "full", jobs: int = 1) -> dict[str, int]:
    """Solve every JSON and Scala program of a folder, ``jobs`` at a time; a result file each, and counts by status."""
    Path(target).mkdir(parents=True, exist_ok=True)
    tasks = [(str(p), str(Path(target) / (p.stem + ".json")), mode) for p in sorted(Path(source).iterdir()) if p.suffix in (".json", ".scala")]
    if jobs > 1:
        with multiprocessing.get_context("spawn").Pool(jobs) as pool:
            found = pool.map(_solve_file, tasks)
    else:
        found = list(map(_solve_file, tasks))
    return dict(Counter(found))


def compare(folders: list[str]) -> dict:
    """A report for each folder and, for folders after the first, the programs that they alone solve or miss."""
    solved = {}
    for folder in folders:
        results = {p.stem: json.loads(p.read_text()) for p in sorted(Path(folder).glob("*.json"))}
        solved[folder] = {n for n, r in results.items() if r["status"] in ("Success", "Lifted")}
    first = solved[folders[0]]
    return {f: report(f) | ({"solved_more": sorted(solved[f] - first), "solved_less": sorted(first - solved[f])} if f != folders[0] else {}) for f in folders}


def report(folder: str) -> dict:
    """Counts, sizes and times over a folder of result files."""
    results = [r for p in sorted(Path(folder).glob("*.json")) if "input_stats" in (r := json.loads(p.read_text()))]
    solved = [r for r in results if r["status"] in ("Success", "Lifted")]
    times = sorted(r["elapsed"] for r in solved)
    quantile = lambda xs, q: sorted(xs)[min(len(xs) - 1, int(q * len(xs)))] if xs else None
    middle = quantile(times, 0.5)
    spread = {k: {str(q): quantile([r[k] for r in results], q) for q in (0.25, 0.5, 0.75, 0.9, 1.0)} for k in ("input_ast_size", "normalizer_ast_size", "elapsed")}
    status: dict[str, int] = {}
    for r in results:
        status[r["status"]] = status.get(r["status"], 0) + 1
    return {
        "programs": len(results), "status": status, "mean_seconds": sum(times) / len(times) if times else None, "median_seconds": middle, "max_seconds": times[-1] if times else None,
        "within_seconds": {str(s): sum(t <= s for t in times) for s in (0.1, 1, 10)},
        "mean_input_size": sum(r["input_ast_size"] for r in results) / len(results) if results else None,
        "mean_merge_size": sum(r["normalizer_ast_size"] for r in results) / len(results) if results else None,
        "quantiles": spread,
        **{k: sum(r["input_stats"][k] for r in results) for k in ("has_tuple", "has_collection", "has_nested_collection", "has_conditional")},
    }


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foldwright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--json", help="a fold program; - reads standard input")
    p.add_argument("--scala", help="a Scala Aggregator; - reads standard input")
    p.add_argument("--to", choices=("text", "json", "merge"), default="merge")
    p.add_argument("--mode", choices=MODES, default="full")
    p.add_argument("--report", nargs="+", help="summarise folders of results, and compare them with the first")
    p.add_argument("--batch", nargs=2, metavar=("IN", "OUT"), help="solve every program of a folder")
    p.add_argument("--jobs", type=int, default=1)
    p.add_argument("--suite", action="store_true", help="solve the built-in catalogue, one line each")
    p.add_argument("-o", "--output")
    a = p.parse_args(argv)
    read = lambda path: sys.stdin.read() if path == "-" else Path(path).read_text()
    try:
        if a.report:
            text = json.dumps(report(a.report[0]) if len(a.report) == 1 else compare(a.report))
        elif a.batch:
            text = json.dumps(batch(*a.batch, a.mode, a.jobs))
        elif a.suite:
            from .operators.catalog import CATALOG

            text = "\n".join(json.dumps({"name": n} | solve(f, a.mode)) for n, f in CATALOG.items())
        elif a.json or a.scala:
            f = read_program(read(a.json), Path(a.json).stem) if a.json else read_scala(read(a.scala))
            text = f"{show(f.acc)}\n{show(f.init)}" if a.to == "text" else write_program(f) if a.to == "json" else json.dumps(solve(f, a.mode))
        else:
            p.print_usage(sys.stderr)
            return 2
    except (ScalaError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if a.output:
        Path(a.output).write_text(text + "\n")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
