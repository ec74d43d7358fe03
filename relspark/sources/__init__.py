"""Where tuples come from and go to: Parquet tables, text, delimited text, JSON, JDBC, and relvar snapshots."""

from __future__ import annotations

import base64
import datetime as dt
import html
import json
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.relation import Relation

def table(spark: SparkSession, folder: str, name: str, keys=None) -> Relation:
    """A Parquet table of a folder. Spark pushes projections and conditions into the scan; without keys, duplicates go."""
    return read_parquet(spark, f"{folder}/{name}.parquet", keys)


def read_parquet(spark: SparkSession, path: str, keys=None) -> Relation:
    return Relation(spark.read.parquet(path), keys, distinct=keys is not None)


def read_csv(spark: SparkSession, path: str, schema: str, keys=None) -> Relation:
    return Relation(spark.read.csv(path, header=True, schema=schema), keys, distinct=keys is not None)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text (a multiset, so no relation)."""
    return spark.read.text(path)


def read_jdbc(spark: SparkSession, url: str, name: str, keys=None, **options) -> Relation:
    """A table of a database server; Spark pushes what it can into its SQL."""
    return Relation(spark.read.format("jdbc").options(url=url, dbtable=name, **options).load(), keys, distinct=keys is not None)


def write_parquet(r: Relation, path: str) -> None:
    r.df.write.mode("errorifexists").parquet(path)


def to_json(r: Relation) -> DataFrame:
    """Each tuple as JSON text, in the column ``json``."""
    return r.df.select(F.to_json(F.struct(*r.attributes)).alias("json"))


def json_text(value) -> str:
    """Any value as JSON: relations and arrays as arrays, tuples as objects, binaries in base 64, datetimes in ISO form."""

    def of(v):
        if isinstance(v, Relation):
            return [of(t) for t in v.each()]
        if isinstance(v, Row):
            v = v.asDict()
        if isinstance(v, dict):
            return {n: of(x) for n, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [of(x) for x in v]
        if isinstance(v, (bytes, bytearray)):
            return base64.b64encode(v).decode()
        return v.isoformat() if isinstance(v, dt.datetime) else v

    return json.dumps(of(value), ensure_ascii=False)


def put(r: Relation) -> str:
    """A relation as text, its tuples in order of their text."""
    return "RELATION{" + ", ".join(sorted("TUPLE{" + ", ".join(f"{k} {v!r}" for k, v in sorted(t.asDict().items())) + "}" for t in r.each())) + "}"


def form_to_tuple(form: str) -> dict[str, str]:
    """A web form's fields."""
    return dict(parse_qsl(form, keep_blank_values=True))


def hescape(text: str) -> str:
    return html.escape(text)
