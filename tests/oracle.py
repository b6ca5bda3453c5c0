"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=repr)


def compare(con, df, statement: str) -> str | None:
    """None if names, types, row count and values agree; else what differs."""
    mine = df.toArrow()
    theirs = con.execute(statement).to_arrow_table()
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return f"columns {mine.column_names} / {theirs.column_names}"
    kinds = {
        n: (str(mine.schema.field(n).type), str(theirs.schema.field(n).type))
        for n in mine.column_names
    }
    odd = {
        n: k for n, k in kinds.items()
        if k[0].replace("large_", "") != k[1].replace("large_", "")
    }
    if odd:
        return f"types {odd}"
    a, b = _rows(mine), _rows(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        x, y = different[0]
        return f"{len(different)} values, first {str(x)[:300]} / {str(y)[:300]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from parley.session import local_session
    import __spark_entry__ as entry

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, statements = entry.queries(), entry.oracle_sql()
    con = database(sf_dir)
    failed = 0
    for name in names or sorted(queries):
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in statements:
                verdict = compare(con, df, statements[name])
                verdict = "ok" if verdict is None else f"DIFFERS {verdict}"
            else:
                verdict = f"rows {df.count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {str(error)[:700]}"
            if names:
                traceback.print_exc()
        failed += verdict.startswith(("DIFFERS", "ERROR"))
        print(f"{name:32s} {time.time() - started:6.2f} {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
