"""Named queries from SQL files: `-- name: x` opens a block, `-- params: a, b` declares what `:a` and `:b` stand for."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans.named import UnknownQueryError


@dataclass(frozen=True)
class SqlQuery:
    name: str
    sql: str
    params: tuple[str, ...]
    source: str

    @property
    def is_ddl(self) -> bool:
        words = " ".join(x for x in self.sql.splitlines() if not x.lstrip().startswith("--")).split()
        return bool(words) and words[0].upper() in ("CREATE", "DROP", "ALTER")


def parse(text: str, source: str = "") -> list[SqlQuery]:
    out: list[SqlQuery] = []
    for block in text.split("-- name:")[1:]:
        name, _, body = block.partition("\n")
        lines = body.splitlines()
        params = [p.strip() for x in lines if x.startswith("-- params:") for p in x.removeprefix("-- params:").split(",")]
        out.append(SqlQuery(name.strip(), "\n".join(x for x in lines if not x.startswith("-- params:")).strip().rstrip(";"), tuple(params), source))
    return out


def load(folder: str) -> dict[str, SqlQuery]:
    """All blocks of the folder's files in the order of their names; a name twice is an error."""
    out: dict[str, SqlQuery] = {}
    for path in sorted(Path(folder).glob("*.sql")):
        for q in parse(path.read_text(), path.name):
            if q.name in out:
                raise ValueError(f"{q.name} is in {out[q.name].source} and in {path.name}")
            out[q.name] = q
    return out


class SqlLayer:
    """Runs SQL blocks over registered views, with bound parameters; nothing is pasted into a statement."""

    def __init__(self, spark: SparkSession, queries: dict[str, SqlQuery], defaults: dict | None = None):
        self.spark, self.queries, self.defaults = spark, queries, defaults or {}

    def create_views(self) -> list[str]:
        made = [q.name for q in self.queries.values() if q.is_ddl]
        for name in made:
            self.spark.sql(self.queries[name].sql)
        return made

    def analytical_queries(self) -> list[str]:
        return [q.name for q in self.queries.values() if not q.is_ddl]

    def run(self, name: str, **params) -> DataFrame:
        if name not in self.queries:
            raise UnknownQueryError(name)
        q = self.queries[name]
        given = {p: {**self.defaults, **params}[p] for p in q.params if p in {**self.defaults, **params}}
        if missing := [p for p in q.params if p not in given]:
            raise ValueError(f"{name} needs {missing}")
        return self.spark.sql(q.sql, args=given)
