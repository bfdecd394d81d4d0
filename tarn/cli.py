"""Command line: ``python -m tarn.cli [-q QUERY] [--corpus FILE | --index DIR] [--mode bm25] [-k 10] [--mmr]``; without a query, a prompt."""

from __future__ import annotations

import argparse
import sys

from tarn.functions.text import score_terms_of
from tarn.operators.index import Index, build_index
from tarn.operators.ranking import parse_ranking_mode
from tarn.plans.engine import SearchEngine, SearchResults
from tarn.session import local_session
from tarn.sources.corpus import corpus_from

HELP = ":mode NAME  :k N  :mmr on|off  :rel DOC_ID  :reset  :stats  :help  :quit"


def show(results: SearchResults, terms: list[str], out=sys.stdout) -> None:
    import re

    either = re.compile(r"\b(" + "|".join(sorted(map(re.escape, terms), key=len, reverse=True)) + r")\b", re.IGNORECASE) if terms else None
    if results.notice:
        print(results.notice, file=out)
    if not len(results):
        print("no results", file=out)
    for r in results:
        text = either.sub("\033[1;33m\\1\033[0m", r["snippet"]) if either else r["snippet"]
        print(f"{r['rank']:>3}. [{r['doc_id']}] {r['score']:.6f}  {r['title'] or r['url'] or '(untitled)'}\n     {text}", file=out)


def command(engine: SearchEngine, state: dict, line: str, out=sys.stdout) -> bool:
    """One line at the prompt; False ends it."""
    name, _, value = line[1:].partition(" ")
    value = value.strip()
    try:
        if name in ("quit", "q"):
            return False
        if name == "mode":
            state["mode"] = parse_ranking_mode(value).value
        elif name == "k":
            state["k"] = max(1, int(value))
        elif name == "mmr":
            state["mmr"] = value != "off"
        elif name == "rel":
            print("noted" if engine.mark_relevant(state["session"], int(value)) else "unknown document", file=out)
        elif name == "reset":
            engine.reset_feedback(state["session"])
        elif name == "stats":
            print(engine.stats(), file=out)
        else:
            print(HELP, file=out)
    except ValueError as e:
        print(e, file=out)
    return True


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="search a corpus")
    p.add_argument("-q", "--query")
    p.add_argument("--corpus")
    p.add_argument("--backend")
    p.add_argument("--index")
    p.add_argument("--mode", default="bm25")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--mmr", action="store_true")
    args = p.parse_args(argv)
    try:
        mode = parse_ranking_mode(args.mode).value
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = local_session()
    try:
        engine = SearchEngine(Index.open(spark, args.index) if args.index else build_index(corpus_from(spark, args.backend, args.corpus)))
    except Exception as e:  # noqa: BLE001  whatever keeps the corpus from being read
        print(e, file=sys.stderr)
        return 1
    state = {"mode": mode, "k": args.k, "mmr": args.mmr, "session": engine.open_session()}
    ask = lambda q: show(engine.search(q, state["session"], state["mode"], state["k"], state["mmr"]), score_terms_of(q))
    if args.query is not None:
        ask(args.query)
        return 0
    while line := sys.stdin.readline():
        line = line.strip()
        if line.startswith(":"):
            if not command(engine, state, line):
                break
        elif line:
            ask(line)
    return 0



if __name__ == "__main__":
    sys.exit(main())
