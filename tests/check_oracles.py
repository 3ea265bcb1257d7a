"""Run queries and oracles side by side: python tests/check_oracles.py [pattern] [sf_dir]."""
import math
import sys
import time

sys.path.insert(0, "/root/repo")
import duckdb

from tapeloom.session import local_session


def canon(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canon(v)) for k, v in value.items()))
    return str(value)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} != {sorted(duck_cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} != {len(duck_rows)}"
    order = sorted(spark_cols)
    a = sorted((tuple(canon(r[spark_cols.index(c)]) for c in order) for r in spark_rows), key=repr)
    b = sorted((tuple(canon(r[duck_cols.index(c)]) for c in order) for r in duck_rows), key=repr)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if not bad:
        return None
    x, y = bad[0]
    diff = {c: (x[i], y[i]) for i, c in enumerate(order) if x[i] != y[i]}
    return f"{len(bad)} of {len(a)} rows differ, e.g. {diff} in {x}"


def main():
    import __spark_entry__ as entry
    pattern = sys.argv[1] if len(sys.argv) > 1 else ""
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark = local_session()
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    oracles = entry.oracle_sql()
    failed = []
    import re
    for name, fn in entry.queries().items():
        if not re.search(pattern, name):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if name not in oracles:
                print(f"ROWS {name}: {len(rows)} rows, {t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(oracles[name])
            cols = [d[0] for d in cur.description]
            duck = cur.fetchall()
            t2 = time.time()
            problem = compare(rows, df.columns, duck, cols)
            if problem is None:
                types = dict(zip(cols, [str(d[1]) for d in cur.description]))
                odd = {c: (t, types[c]) for c, t in df.dtypes if
                       {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                        "date": "DATE", "boolean": "BOOLEAN"}.get(t, types[c]) != types[c]}
                if odd:
                    problem = f"types {odd}"
            if problem is None and len(rows) == 0:
                problem = "no rows"
        except Exception as error:  # report and go on
            problem, t1, t2 = f"{type(error).__name__}: {str(error)[:1500]}", time.time(), time.time()
            rows = []
        if problem:
            failed.append(name)
            print(f"FAIL {name}: {problem[:1800]}", flush=True)
        else:
            print(f"ok   {name}: {len(rows)} rows, spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
