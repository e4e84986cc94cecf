"""A query's rows against those of its SQL."""

import datetime
import decimal
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)


def sql_rows(sql, folder):
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    columns = sorted(con.sql(sql).columns)
    names = ", ".join(f'"{c}"' for c in columns)
    return columns, sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {names} FROM ({sql}) q_").fetchall()), key=str)
