"""Runs registered queries next to their SQL: same columns, same types, same rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _order(row):
    return tuple((value is None, str(value)) for value in row)


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(_plain(row[name]) for name in names) for row in df.select(*[f"`{n}`" for n in names]).collect()]
    return names, sorted(rows, key=_order)


def duck_rows(connection, sql):
    relation = connection.sql(sql)
    names = sorted(relation.columns)
    position = [relation.columns.index(name) for name in names]
    rows = [tuple(_plain(row[i]) for i in position) for row in relation.fetchall()]
    return names, sorted(rows, key=_order)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN"}


def type_differences(df, connection, sql):
    relation = connection.sql(sql)
    theirs = dict(zip(relation.columns, map(str, relation.types)))
    return {name: (kind, theirs.get(name)) for name, kind in df.dtypes if TYPES.get(kind) != theirs.get(name)}
