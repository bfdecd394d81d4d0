"""A small JSON service over a search engine, with the standard library's server.

GET /api/search?q=&mode=&k=&mmr=&session=   POST /api/feedback {session, doc_id}   POST /api/reset {session}   GET /api/stats
"""

from __future__ import annotations

import html
import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from tarn.functions.text import score_terms_of
from tarn.plans.engine import SearchEngine


def marked(snippet: str, terms: list[str]) -> str:
    """A snippet safe for HTML, with hits marked."""
    safe = html.escape(snippet)
    if not terms:
        return safe
    either = "|".join(sorted(map(re.escape, set(terms)), key=len, reverse=True))
    return re.sub(rf"\b({either})\b", r"<mark>\1</mark>", safe, flags=re.IGNORECASE)


def answer(engine: SearchEngine, method: str, target: str, body: dict) -> tuple[int, dict]:
    """Status and JSON of a request."""
    url = urlsplit(target)
    args = {k: v[-1] for k, v in parse_qs(url.query).items()}
    try:
        if (method, url.path) == ("GET", "/api/search"):
            query = args.get("q", "")
            k = min(50, max(1, int(args.get("k", 10))))
            found = engine.search(query, args.get("session"), args.get("mode", "bm25"), k, args.get("mmr") in ("1", "true", "on"))
            rows = [r | {"score": round(r["score"], 6), "snippet": marked(r["snippet"], score_terms_of(query))} for r in found]
            return 200, {"results": rows, "notice": found.notice}
        if (method, url.path) == ("POST", "/api/feedback"):
            return 200, {"ok": engine.mark_relevant(str(body.get("session") or ""), int(body["doc_id"]))}
        if (method, url.path) == ("POST", "/api/reset"):
            engine.reset_feedback(str(body.get("session") or ""))
            return 200, {"ok": True}
        if (method, url.path) == ("GET", "/api/stats"):
            return 200, engine.stats()
    except (ValueError, KeyError, TypeError) as e:
        return 400, {"error": str(e)}
    return 404, {"error": "not found"}


def serve(engine: SearchEngine, port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self):
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
            except ValueError:
                body = {}
            status, out = answer(engine, self.command, self.path, body)
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
