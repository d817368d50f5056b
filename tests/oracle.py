"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, int):
        return v
    return float(v)


def _kind(v):
    return {int: "int", float: "float", str: "str", bool: "bool", type(None): "null"}.get(type(v), "other")


def differences(df, con, sql) -> str | None:
    """None when equal; else a short account of the first difference."""
    cols = sorted(df.columns)
    ours = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = [tuple(_plain(r[i]) for i in at) for r in cur.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    key = lambda r: tuple((v is None, str(v)) for v in r)
    for a, b in zip(sorted(ours, key=key), sorted(theirs, key=key)):
        if a != b or [_kind(x) for x in a] != [_kind(x) for x in b]:
            bad = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y or _kind(x) != _kind(y)]
            return f"{a[:1]} {str(bad)[:400]}"
    return None


def main(argv):
    sys.path.insert(0, "/root/repo")
    from inkprint.plans.registry import oracle_sql, queries
    from inkprint.session import local_session

    sf = argv[0]
    wanted = argv[1:]
    spark, con = local_session(), duck(sf)
    q, o = queries(), oracle_sql()
    failed = 0
    for name in q:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = q[name](spark, sf)
            if name in o:
                built = time.time() - t
                why = differences(df, con, o[name])
                state = "ok" if why is None else f"DIFF {why}"
            else:
                state = f"rows {len(df.collect())}"
        except Exception as e:  # noqa: BLE001 - report and go on
            state = f"ERROR {str(e)[:600]}"
        failed += state.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - t:6.2f}s {state}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
