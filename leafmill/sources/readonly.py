"""The guard of read-only SQL: a walk of the parsed statement, class by class.

Every node of the plan must be one that queries are made of, wherever it stands: in a subquery, a common table expression, a window
definition or a lateral join. Functions must be built in or registered with the session and not call into Java; relations
must be names of tables, views or common table expressions, never a file by its path.
"""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

# Spark's plan nodes that read and combine rows, its functions that call into Java, and the homes of built-in functions.
PLANS = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation "
    "PipeOperator Pivot Project Range Repartition RepartitionByExpression Sample Sort SubqueryAlias Union Unpivot UnresolvedHaving UnresolvedHint "
    "UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith Window "
    "WithWindowDefinition".split()
)
CALLS_JAVA = frozenset(("reflect", "try_reflect", "java_method"))
HOMES = ((), ("builtin",), ("session",), ("system", "builtin"), ("system", "session"))
_CATALYST = "org.apache.spark.sql.catalyst."
_TRUSTED = (f"{_CATALYST}analysis.", f"{_CATALYST}expressions.", f"{_CATALYST}plans.logical.")


class Refused(ValueError):
    """A statement that does more than read tables, or is no statement at all."""


class _Walk:
    def __init__(self, spark: SparkSession):
        self.spark, self.state = spark, spark._jsparkSession.sessionState()
        find = spark._jvm.java.lang.Class.forName
        self.plan, self.node = find(f"{_CATALYST}plans.logical.LogicalPlan"), find(f"{_CATALYST}trees.TreeNode")
        self.many, self.product = find("scala.collection.Iterable"), find("scala.Product")

    def check(self, item: object) -> None:
        """Look at a node, or at whatever a field of one holds, and at all below it."""
        waiting = [item]
        while waiting:
            item = waiting.pop()
            if not isinstance(item, JavaObject):
                continue
            if self.node.isInstance(item):
                if self._closed(item):
                    continue
                waiting.extend(_each(item.productIterator()))
            elif self.many.isInstance(item):
                waiting.extend(_each(item.iterator()))
            elif self.product.isInstance(item):
                waiting.extend(_each(item.productIterator()))

    def _closed(self, node: JavaObject) -> bool:
        """Refuse a node that may not stand in a query; True if nothing below it needs a look."""
        kind = node.getClass()
        name = kind.getSimpleName().rstrip("$")
        if not kind.getName().startswith(_TRUSTED) or ".objects." in kind.getName():
            raise Refused(f"only queries are read; this holds {name}")
        if self.plan.isInstance(node):
            if name not in PLANS:
                raise Refused(f"only queries are read; this holds {name}")
            if name == "UnresolvedRelation":
                self._relation(node)
            elif name == "UnresolvedTableValuedFunction":
                self._function(_texts(node.name()), self.state.tableFunctionRegistry())
        elif name == "UnresolvedFunction":
            self._function(_texts(node.nameParts()), self.state.functionRegistry())
        elif name == "UnresolvedGenerator":
            self._function([node.name().funcName()], self.state.functionRegistry())
        elif name.endswith("WithUnresolvedIdentifier"):
            raise Refused("names must be written out")
        return name == "LocalRelation"

    def _relation(self, node: JavaObject) -> None:
        parts = _texts(node.multipartIdentifier())
        if node.isStreaming():
            raise Refused("streams are not read here")
        if len(parts) > 1 and not self.spark.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in parts)):
            raise Refused(f"no table {'.'.join(parts)}; files cannot be read by their path")

    def _function(self, parts: list[str], registry: JavaObject) -> None:
        *home, name = (p.lower() for p in parts)
        known = registry.functionExists(getattr(self.spark._jvm, f"{_CATALYST}FunctionIdentifier")(name))
        if name in CALLS_JAVA or tuple(home) not in HOMES or not known:
            raise Refused(f"function {'.'.join(parts)} is not available here")


def _each(iterator: JavaObject) -> Iterator[object]:
    while iterator.hasNext():
        yield iterator.next()


def _texts(names: JavaObject) -> list[str]:
    return [str(n) for n in _each(names.iterator())]


def check_select(spark: SparkSession, sql: str) -> str:
    """The statement, if it is one that Spark reads as a query over tables and nothing in it does more."""
    statement = (sql or "").strip()
    if not statement:
        raise Refused("the query is empty")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as exc:  # noqa: BLE001 - the parser's own message says what is wrong
        raise Refused(f"not a single SQL query: {str(exc).strip().splitlines()[0]}") from None
    _Walk(spark).check(plan)
    return statement
