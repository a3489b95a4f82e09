"""Run registered queries against their SQL: ``python tests/check.py [prefix ...]``."""

import pathlib
import sys
import time
import traceback

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from foliolens.plans import compare, load_all  # noqa: E402
from foliolens.session import build_session  # noqa: E402


def main(names: list[str]) -> int:
    sf = "/root/testdata/sf0.01"
    for n in list(names):
        if n.startswith("/"):
            sf = n
            names.remove(n)
    queries, oracle = load_all()
    spark = build_session("local[8]", 8)
    con = compare.duck(sf)
    failed = 0
    for name, fn in queries.items():
        if names and not any(name == n or name.startswith(n + "_") or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            if name in oracle:
                ok, detail = compare.compare(fn(spark, sf), con, oracle[name])
            else:
                ok, detail = True, f"{fn(spark, sf).count()} rows (no SQL)"
        except Exception as exc:  # report and go on
            ok, detail = False, "".join(traceback.format_exception_only(exc))[:900]
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {detail}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
