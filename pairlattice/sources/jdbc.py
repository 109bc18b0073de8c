"""Inserts over JDBC that may be repeated: a staging table, then one transaction with a high-water mark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = "insert_marks"


@contextmanager
def _transaction(spark: SparkSession, url: str) -> Iterator:
    """A connection of the driver's JVM: committed at the end, rolled back on an error."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    connection.setAutoCommit(False)
    try:
        yield connection
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _run(connection, sql: str, *values) -> int:
    statement = connection.prepareStatement(sql)
    try:
        for i, v in enumerate(values, 1):
            statement.setLong(i, v) if isinstance(v, int) else statement.setString(i, v)
        return statement.executeUpdate()
    finally:
        statement.close()


def _has(connection, table: str) -> bool:
    found = connection.getMetaData().getTables(None, None, None, None)
    while found.next():
        if found.getString("TABLE_NAME").lower() == table.lower():
            return True
    return False


def mark_of(spark: SparkSession, url: str, table: str) -> int:
    """The greatest key that was inserted into a table; -1 before the first insert."""
    with _transaction(spark, url) as c:
        if not _has(c, MARKS):
            return -1
        statement = c.prepareStatement(f"SELECT mark FROM {MARKS} WHERE name = ?")
        statement.setString(1, table)
        rows = statement.executeQuery()
        mark = rows.getLong(1) if rows.next() else -1
        statement.close()
        return mark


def insert_new(df: DataFrame, url: str, table: str, key: str, batch: int = 1000, types: str | None = None) -> int:
    """Insert the rows whose key (a whole number from 0, rising from call to call) is above the table's mark; the number of rows inserted.

    Tasks fill a staging table, each anew if the job is run again. Then one transaction of the driver moves the distinct
    rows above the mark into the table and raises the mark, so a job that fails, a task that writes twice and a call that is repeated all leave
    every row once. Tables are made if there are none, with strings as ``VARCHAR(4000)`` unless types (as Spark's ``createTableColumnTypes``)
    say otherwise, since long texts cannot be told apart in SQL.
    """
    types = types or ", ".join(f"{c} VARCHAR(4000)" for c, kind in df.dtypes if kind == "string")
    made = {"url": url, "batchsize": str(batch)} | ({"createTableColumnTypes": types} if types else {})
    spark, staging = df.sparkSession, f"{table}_staging"
    mark = mark_of(spark, url, table)
    fresh = df.filter(F.col(key) > mark)
    fresh.write.format("jdbc").options(dbtable=staging, **made).mode("overwrite").save()
    if mark < 0:  # an empty table of the same columns, if there is none yet
        with _transaction(spark, url) as c:
            missing = not _has(c, table)
        if missing:
            df.limit(0).write.format("jdbc").options(dbtable=table, **made).save()
    names = ", ".join(f'"{c}"' for c in df.columns)
    with _transaction(spark, url) as c:
        if not _has(c, MARKS):
            _run(c, f"CREATE TABLE {MARKS} (name VARCHAR(128) PRIMARY KEY, mark BIGINT NOT NULL)")
        if not _run(c, f"UPDATE {MARKS} SET mark = mark WHERE name = ?", table):  # takes the row's lock
            _run(c, f"INSERT INTO {MARKS} (name, mark) VALUES (?, -1)", table)
        n = _run(c, f'INSERT INTO {table} ({names}) SELECT DISTINCT {names} FROM {staging} WHERE "{key}" > (SELECT mark FROM {MARKS} WHERE name = ?)', table)
        if n:
            _run(c, f'UPDATE {MARKS} SET mark = (SELECT MAX("{key}") FROM {staging}) WHERE name = ?', table)
        _run(c, f"DROP TABLE {staging}")
    return n
