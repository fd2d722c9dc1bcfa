"""Command line: python tests/check_queries.py FOLDER [name-part ...] compares queries with SQL."""

import importlib
import sys
import time
import traceback

sys.path.insert(0, ".")
sys.path.insert(0, "tests")
from compare import difference, duck  # noqa: E402
from conftest import make_session  # noqa: E402

import catalog.registry as reg  # noqa: E402

if __name__ == "__main__":
    folder, parts = sys.argv[1], sys.argv[2:]
    importlib.import_module("catalog.all_queries")
    spark = make_session()
    con = duck(folder)
    bad = 0
    for name, fn in reg.QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in reg.SQL:
                msg = difference(df, con, reg.SQL[name])
            else:
                msg = "" if df.count() >= 0 else "?"
                msg = msg or f"(rows only: {df.count()})"
        except Exception as e:
            msg = "ERROR " + str(e)[:900]
            if len(parts) == 1:
                traceback.print_exc()
        state = "ok  " if msg == "" or msg.startswith("(") else "BAD "
        bad += state == "BAD "
        print(f"{state}{name:38s} {time.time()-t:6.2f}s {msg}", flush=True)
    print("bad:", bad)
