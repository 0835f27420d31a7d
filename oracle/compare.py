"""Compare a Spark DataFrame with an oracle SQL result the way the driver
does: row count, column names, column type families, and an
order-insensitive hash of the values (columns sorted by name)."""

from __future__ import annotations

import hashlib
import math
import os
from dataclasses import dataclass

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

_SPARK_FAMILY = {"bigint": "int64", "int": "int32", "double": "float64", "string": "string",
                 "date": "date", "boolean": "bool"}
_DUCK_FAMILY = {"BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "float64", "VARCHAR": "string",
                "DATE": "date", "BOOLEAN": "bool"}


def duckdb_for(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def digest(rows) -> str:
    keys = sorted(repr(tuple(_norm(x) for x in r)) for r in rows)
    return hashlib.sha1("\n".join(keys).encode()).hexdigest()[:16]


@dataclass
class Result:
    rows: int
    oracle_rows: int
    same_columns: bool
    type_diffs: list
    same_hash: bool

    @property
    def ok(self) -> bool:
        return self.same_columns and not self.type_diffs and self.same_hash and self.rows == self.oracle_rows


def compare(df, con, sql: str) -> Result:
    cols = df.columns
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    ocols = [c[0] for c in res.description]
    otypes = dict(zip(ocols, (str(c[1]) for c in res.description)))
    orows = res.fetchall()
    same_cols = sorted(cols) == sorted(ocols)
    tdiff = [(c, stypes[c], otypes[c]) for c in cols if c in otypes
             and _SPARK_FAMILY.get(stypes[c], stypes[c]) != _DUCK_FAMILY.get(otypes[c], otypes[c])]
    if not same_cols:
        return Result(len(srows), len(orows), False, tdiff, False)
    so = sorted(range(len(cols)), key=lambda i: cols[i])
    oo = sorted(range(len(ocols)), key=lambda i: ocols[i])
    hs = digest([tuple(r[i] for i in so) for r in srows])
    ho = digest([tuple(r[i] for i in oo) for r in orows])
    return Result(len(srows), len(orows), True, tdiff, hs == ho)
