"""What a caller's statement may do: read, and only the relations that it is given."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from ..errors import ReadOnlyError, ScopeError

#: Nodes of a parsed statement that only read.  Anything else is refused.
READING = frozenset(
    """Aggregate AsOfJoin BaseEvalPython CTERelationDef CTERelationRef Deduplicate Distinct Except Expand ExplainCommand Filter Generate GlobalLimit
    Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation ParameterizedQuery NameParameterizedQuery PosParameterizedQuery Pivot Project Range RepartitionByExpression
    Sample Sort Subquery SubqueryAlias Tail Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedOrderBy UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith Unpivot UnpivotTransformer Window WithWindowDefinition""".split()
)
_CALLS_OUT = re.compile(r"'(?:try_)?(?:reflect|java_method|input_file_name|read_files|session_user|current_user)\(", re.I)


def _list(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _nodes(plan) -> Iterator:
    yield plan
    for children in (plan.children(), plan.subqueries()):
        for child in _list(children):
            yield from _nodes(child)
    name = plan.getClass().getSimpleName()
    if name == "UnresolvedWith":
        for pair in _list(plan.cteRelations()):
            yield from _nodes(pair._2())
    if name == "ExplainCommand":
        yield from _nodes(plan.logicalPlan())


def require_read_only(spark: SparkSession, statement: str, relations: Iterable[str] | None = None) -> set[str]:
    """Refuse a statement that is not a query over the given relations; returns those it names.

    The statement is parsed, never run.  ``EXPLAIN`` of a query is a query.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    named, defined = set(), set()
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind not in READING:
            raise ReadOnlyError(f"{kind} does more than read")
        if kind == "UnresolvedRelation":
            named.add(".".join(_list(node.multipartIdentifier())).lower())
        if kind == "UnresolvedWith":
            defined |= {pair._1().lower() for pair in _list(node.cteRelations())}
        if _CALLS_OUT.search(node.simpleString(10_000)):
            raise ReadOnlyError("a function that leaves the query")
    named -= defined
    if relations is not None and (foreign := named - {r.lower() for r in relations}):
        raise ScopeError(f"no such relation here: {', '.join(sorted(foreign))}")
    return named
