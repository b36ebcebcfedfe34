"""SQL over registered tables, read only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


#: Parts of a parsed query that may stand in one, and functions that may not: they run code or read what isn't a table.
_PARTS = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Join", "SubqueryAlias", "UnresolvedWith", "UnresolvedRelation", "UnresolvedHaving", "Distinct", "Union",
    "Except", "Intersect", "OneRowRelation", "UnresolvedInlineTable", "WithWindowDefinition", "UnresolvedSubqueryColumnAliases", "Generate", "LateralJoin", "UnresolvedOrdinal", "Pivot", "UnresolvedPivot",
}
_REFUSED = {"reflect", "java_method", "try_reflect", "input_file_name", "raise_error", "from_avro", "to_avro", "session_user", "current_user"}


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The result of a query over the listed tables.

    The parsed query, with all its subqueries, is read before anything runs: whatever isn't a part of a plain query, any relation that isn't
    a listed table or a name of its own WITH, table functions and functions that run code are refused.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    seen: list = []
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    kinds = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{c}", True, loader) for c in ("plans.logical.LogicalPlan", "expressions.PlanExpression")]
    _walk(plan, seen, kinds[0].isInstance, kinds[1].isInstance)
    own = {r.alias().lower() for kind, r in seen if kind == "SubqueryAlias"}
    for kind, node in seen:
        if kind == "UnresolvedRelation":
            name = [node.multipartIdentifier().apply(i) for i in range(node.multipartIdentifier().size())]
            if len(name) != 1 or name[0].lower() not in own | set(TABLES):
                raise ValueError(f"no table {'.'.join(name)}")
        elif kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = node.nameParts() if kind == "UnresolvedFunction" else node.name()
            name = parts.apply(parts.size() - 1).lower() if hasattr(parts, "size") else parts.toString().lower()
            if name in _REFUSED:
                raise ValueError(f"the function {name} may not run")
    register(spark, sf_dir)
    return spark.sql(text)


def _walk(node, seen: list, is_plan, has_plan) -> None:
    """All plans and expressions under a plan, subqueries and WITH included."""
    kind = node.getClass().getSimpleName()
    plan = is_plan(node)
    if plan and kind not in _PARTS:
        raise ValueError(f"only queries may run, not {kind}")
    seen.append((kind, node))
    below = [node.children(), node.innerChildren(), node.expressions()] if plan else [node.children()]
    for group in below:
        for i in range(group.size()):
            child = group.apply(i)
            if hasattr(child, "getClass"):
                _walk(child, seen, is_plan, has_plan)
    if not plan and has_plan(node):
        _walk(node.plan(), seen, is_plan, has_plan)


def table_schema(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    fields = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in fields], "name string, type string")


def list_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW TABLES")


def read_jdbc(spark: SparkSession, connection: str, query: str, **options) -> DataFrame:
    """A remote engine's query; its driver has to be on the class path."""
    parts = parse_connection(connection)
    url = f"jdbc:{parts['scheme']}://{parts['hosts']}/{parts['database']}"
    return spark.read.format("jdbc").options(url=url, query=query, user=parts["user"], password=parts["password"], **options).load()


def parse_connection(text: str) -> dict[str, str | None]:
    """``scheme://user:password@host:port/database?options`` in its parts."""
    m = re.fullmatch(r"([a-z][a-z0-9+.-]*)://(?:([^:@/]*)(?::([^@]*))?@)?([^/?]*)(?:/([^?]*))?(?:\?(.*))?", text)
    if m is None:
        raise ValueError("not a connection string")
    return dict(zip(("scheme", "user", "password", "hosts", "database", "options"), m.groups(), strict=True))


def format_connection(parts: dict[str, str | None]) -> str:
    login = f"{parts['user']}:{parts['password']}@" if parts.get("user") else ""
    tail = f"?{parts['options']}" if parts.get("options") else ""
    return f"{parts['scheme']}://{login}{parts['hosts']}/{parts.get('database') or ''}{tail}"
