"""Read-only SQL over the public views, bounded in time and rows."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterable, Iterator
from datetime import date, datetime
from decimal import Decimal

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import SparkSession

from townledger.plans.catalog import VIEWS

MAX_CHARS, MAX_ROWS, MAX_SECONDS = 4000, 200, 3.0
#: Functions that a query may call; operators, casts and CASE are not functions here.
ALLOWED = frozenset(
    "count sum avg min max mean median stddev variance first last any_value min_by max_by count_if bool_and bool_or every some array_agg collect_list collect_set listagg string_agg percentile "
    "abs ceil ceiling floor round bround sqrt pow power exp ln log log2 log10 sign mod greatest least coalesce nullif nvl ifnull if iff isnull isnotnull "
    "lower upper trim ltrim rtrim btrim length char_length octet_length substring substr left right replace translate concat concat_ws split split_part instr locate position lpad rpad repeat reverse initcap "
    "startswith endswith contains regexp_like rlike like regexp_extract regexp_extract_all regexp_replace regexp_count levenshtein format_number printf "
    "year month day quarter week dayofweek dayofyear hour minute second date to_date try_to_date date_add date_sub datediff date_diff add_months months_between last_day trunc date_trunc date_format make_date current_date extract date_part "
    "size cardinality array array_contains array_distinct array_sort sort_array array_join array_max array_min array_position array_union array_intersect array_except element_at get slice flatten filter transform aggregate reduce exists forall zip_with explode explode_outer posexplode inline unnest sequence "
    "get_json_object json_tuple named_struct struct map row_number rank dense_rank percent_rank ntile lag lead first_value last_value nth_value grouping grouping_id range in".split()
)


#: What a parsed query may be made of; every other node or expression is refused, whatever it does.
NODES = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project Sample Sort SubqueryAlias Tail Union Unpivot "
    "UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedWith WithWindowDefinition".split()
)
EXPRESSIONS = frozenset(
    "Add AggregateExpression Alias And AnyValue AttributeReference BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Coalesce Collate Concat CreateNamedStruct Cube CurrentRow Divide EqualNullSafe EqualTo Exists First GreaterThan "
    "GreaterThanOrEqual GroupingSets ILike In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction Last LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Lower MultiAlias Multiply NamePlaceholder Not NotLikeAll NotLikeAny "
    "Or Overlay PipeExpression RLike Remainder Rollup ScalarSubquery ShiftLeft ShiftRight ShiftRightUnsigned SortOrder SpecifiedWindowFrame StringLocate StringTrim StringTrimLeft StringTrimRight Substring Subtract TimestampAdd TimestampDiff UnaryMinus UnaryPositive "
    "UnboundedFollowing UnboundedPreceding UnresolvedAlias UnresolvedAttribute UnresolvedCollation UnresolvedExtractValue UnresolvedFunction UnresolvedGenerator UnresolvedNamedLambdaVariable UnresolvedOrdinal UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedWindowExpression "
    "UnspecifiedFrame WindowExpression WindowSpecDefinition".split()
)
#: Leaves of an analysed query that hold no table.
TABLELESS = frozenset("OneRowRelation LocalRelation Range CTERelationRef UnionLoopRef".split())


class SqlError(Exception):
    """code is one of invalid_arguments, permission_denied, read_only_violation, multiple_statements, row_limit_exceeded, timeout, sql_error."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _expressions(plan) -> Iterator:
    """All expressions of a node of a plan, however deep."""
    todo = [*_each(plan.expressions())]
    while todo:
        x = todo.pop()
        yield x
        todo += _each(x.children())


def _kind(node) -> str:
    """The class of a node or expression, without its package and what a singleton or an unnamed subclass adds to it."""
    return node.getClass().getName().rpartition(".")[2].partition("$")[0]


def _allowed(name: str) -> None:
    if name.lower() not in ALLOWED:
        raise SqlError("permission_denied", f"{name} is not allowed")


def _walk(plan, known: frozenset[str]) -> None:
    """Refuse all but known kinds of nodes and expressions, relations that are not known where they are named, and functions that are not allowed.

    A common table is known to the ones after it and to the query below, to itself only if it may be recursive, and nowhere else.
    """
    kind = _kind(plan)
    if kind not in NODES:
        raise SqlError("permission_denied", f"{kind} is not allowed")
    if kind == "UnresolvedWith":
        for one in _each(plan.cteRelations()):
            own = frozenset([one._1().lower()])
            _walk(one._2(), known | own if plan.allowRecursion() else known)
            known |= own
    elif kind == "UnresolvedRelation":
        name = ".".join(_each(plan.multipartIdentifier()))
        if name.lower() not in known:
            raise SqlError("permission_denied", f"no such view: {name}")
    elif kind == "UnresolvedTableValuedFunction":
        _allowed(".".join(_each(plan.name())))
    for x in _expressions(plan):
        if (what := _kind(x)) not in EXPRESSIONS:
            raise SqlError("permission_denied", f"{what} is not allowed")
        if what == "UnresolvedFunction":
            _allowed(".".join(_each(x.nameParts())))
        elif what == "UnresolvedGenerator":
            _allowed(x.name().unquotedString())
    for part in (plan.children(), plan.subqueries()):
        for below in _each(part):
            _walk(below, known)


def _reached(plan, allowed: frozenset[str]) -> None:
    """Refuse tables of an analysed plan that are not below an allowed view; the second look, after Spark has resolved all names."""
    kind = _kind(plan)
    if kind == "SubqueryAlias" and plan.identifier().name().lower() in allowed and _kind(plan.child()) == "View":
        return
    if not plan.children().size() and kind not in TABLELESS:
        raise SqlError("permission_denied", f"{kind} is not allowed")
    for part in (plan.children(), plan.subqueries(), plan.innerChildren()):
        for below in _each(part):
            _reached(below, allowed)


def check(spark: SparkSession, query: str, allowed: Iterable[str] = VIEWS) -> None:
    """Refuse what is not one query over the allowed views, by Spark's own parse of it."""
    if not query.strip() or len(query.strip()) > MAX_CHARS:
        raise SqlError("invalid_arguments", f"a query has 1 to {MAX_CHARS} characters")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:  # the parser's errors come as they are thrown in the JVM
        body = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*", "", query).strip().rstrip(";")
        raise SqlError("multiple_statements" if ";" in body else "sql_error", str(e).splitlines()[0]) from e
    kind = plan.nodeName()
    if re.search(r"Command$|^(Insert|Create|Drop|Alter|Cache|Uncache|Set|Update|Delete|Merge|Truncate|Refresh|Describe|Show|Explain|Replace|Add|Analyze|Load|Repair|Use|Call|Comment|Clear|Declare|Execute)", kind):
        raise SqlError("read_only_violation", f"{kind} is no query")
    _walk(plan, frozenset(v.lower() for v in allowed))


def _plain(value):
    return value.isoformat() if isinstance(value, (date, datetime)) else float(value) if isinstance(value, Decimal) else value


def run(spark: SparkSession, query: str, allowed: Iterable[str] = VIEWS, seconds: float = MAX_SECONDS) -> dict[str, list]:
    """{"columns", "rows"} of a query; SqlError with a code for what is refused, fails, takes too long or has over MAX_ROWS rows."""
    check(spark, query, allowed)
    sc, group = spark.sparkContext, f"sql-{uuid.uuid4().hex}"
    late = threading.Event()
    timer = threading.Timer(seconds, lambda: (late.set(), sc.cancelJobGroup(group)))
    sc.setJobGroup(group, "sql", interruptOnCancel=True)
    timer.start()
    try:
        df = spark.sql(query)
        _reached(df._jdf.queryExecution().analyzed(), frozenset(v.lower() for v in allowed))
        rows = df.limit(MAX_ROWS + 1).collect()
    except (AnalysisException, ParseException) as e:
        raise SqlError("sql_error", str(e).splitlines()[0]) from e
    except PySparkException as e:
        raise SqlError("timeout" if late.is_set() else "sql_error", str(e).splitlines()[0]) from e
    except Exception as e:
        if not late.is_set():
            raise SqlError("sql_error", str(e).splitlines()[0]) from e
        raise SqlError("timeout", f"the query took over {seconds} s") from e
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if len(rows) > MAX_ROWS:
        raise SqlError("row_limit_exceeded", f"the query has over {MAX_ROWS} rows")
    return {"columns": df.columns, "rows": [[_plain(v) for v in r] for r in rows]}
