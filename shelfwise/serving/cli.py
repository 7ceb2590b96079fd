"""python -m shelfwise.serving.cli --folder F health | metadata | forecast S I | replenishment S I | risk [--top N] [--store S] | summary"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from shelfwise.serving.store import ForecastStore, StoreError


def answer(f: Callable, *args, **kwargs) -> int:
    """Prints the answer; an error goes to stderr as JSON, with exit code 1. No traceback reaches the caller."""
    try:
        print(json.dumps(f(*args, **kwargs), default=str, indent=2))
    except StoreError as e:
        return failed(type(e).__name__, e)
    except Exception as e:  # noqa: BLE001  the last resort
        return failed("InternalError", e)
    return 0


def failed(kind: str, error: Exception) -> int:
    print(json.dumps({"error": kind, "message": str(error)}), file=sys.stderr)
    return 1


def main(argv: list[str] | None = None, store: ForecastStore | None = None) -> int:
    parser = argparse.ArgumentParser(prog="shelfwise")
    parser.add_argument("--folder", default="reports/serving")
    ask = parser.add_subparsers(dest="ask", required=True)
    for name in ("health", "metadata", "summary"):
        ask.add_parser(name)
    for name in ("forecast", "replenishment"):
        p = ask.add_parser(name)
        p.add_argument("store_id")
        p.add_argument("item_id")
    p = ask.add_parser("risk")
    p.add_argument("--top", type=int, default=20)
    p.add_argument("--store", default=None)
    a = parser.parse_args(argv)
    if store is None:
        from shelfwise.session import session

        store = ForecastStore(session(), a.folder)
    if a.ask in ("forecast", "replenishment"):
        return answer(getattr(store, f"get_{a.ask}"), a.store_id, a.item_id)
    if a.ask == "risk":
        return answer(store.get_risk, a.top, a.store)
    return answer(store.get_summary if a.ask == "summary" else getattr(store, a.ask))


if __name__ == "__main__":
    sys.exit(main())
