"""A read-only view of search runs over HTTP: JSON of the runs below a folder, and one page that lists them."""

from __future__ import annotations

import html
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import unquote, urlsplit

from tickforge.plans.evolve import layers
from tickforge.sources.store import load_run, runs


def answer(folder: str, path: str) -> tuple[int, object]:
    """(status, content) of a GET: /health, /api/runs, /api/runs/NAME (its summary), /api/runs/NAME/pareto (the candidates no other dominates by
    test Sharpe ratio, drawdown and complexity) and / (a page, as text). 400 for names that leave the folder, 404 for what is not there."""
    parts = [unquote(p) for p in urlsplit(path).path.split("/") if p]
    if parts == ["health"]:
        return 200, {"status": "ok"}
    if not parts:
        rows = "".join(f"<tr><td>{html.escape(r['run'])}</td><td>{r['candidates']}</td><td>{r['sharpe']}</td></tr>" for r in runs(folder))
        return 200, f"<!doctype html><title>Runs</title><h1>Runs</h1><table><tr><th>run</th><th>candidates</th><th>best Sharpe ratio</th></tr>{rows}</table>"
    if parts[:2] != ["api", "runs"]:
        return 404, {"error": "no such path"}
    if len(parts) == 2:
        return 200, runs(folder)
    at, base = (Path(folder) / parts[2]).resolve(), Path(folder).resolve()
    if base not in at.parents:
        return 400, {"error": "no name of a run"}
    try:
        if len(parts) == 3:
            return 200, json.loads((at / "summary.json").read_text())
        if parts[3:] == ["pareto"]:
            found, _ = load_run(str(at))
            points = [(-r["test_metrics"]["sharpe"], r["test_metrics"]["max_drawdown"], r["complexity"]) for r in found]
            return 200, [{"strategy_id": r["strategy_id"], "expression": r["expression"], "complexity": r["complexity"], "test_metrics": r["test_metrics"]} for r in (found[i] for i in layers(points)[0])]
    except (OSError, ValueError):
        pass
    return 404, {"error": "no such run"}


def serve(folder: str = "runs", host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """A server for answer; the caller runs serve_forever."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            status, content = answer(folder, self.path)
            page = isinstance(content, str)
            body = content.encode() if page else json.dumps(content).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if page else "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def plot(series: dict[str, list[float]], path: str, width: int = 800, height: int = 300) -> None:
    """Lines over bar numbers as an SVG file, one per name."""
    values = [x for s in series.values() for x in s if x == x]
    low, high = (min(values), max(values)) if values else (0.0, 1.0)
    span, lines = (high - low) or 1.0, []
    for k, (name, s) in enumerate(series.items()):
        at = " ".join(f"{i * width / max(1, len(s) - 1):.1f},{height - (x - low) / span * height:.1f}" for i, x in enumerate(s) if x == x)
        hue = 360 * k // max(1, len(series))
        lines.append(f'<polyline fill="none" stroke="hsl({hue} 70% 40%)" points="{at}"><title>{html.escape(name)}</title></polyline>')
    Path(path).write_text(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}">{"".join(lines)}</svg>')
