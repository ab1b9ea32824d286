"""Records of extraction and answers: equality with gold records, validity, metrics of answers and agents, and places in units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from townledger.functions import text as T
from townledger.operators.metrics import nearest_rank


def last_token(c: Column) -> Column:
    """The last word in lower case; a null stays null, a blank text is empty."""
    return F.lower(F.element_at(F.split(T.squeeze(c), " "), -1))


def same_record(kind: Column, gold: Column, found: Column) -> Column:
    """Whether a record is the gold one, by what tells records of its kind apart.

    Structs of mover, seconder, ayes, noes, abstain, absent, members (name, value), identifier, outcome, amount_usd,
    speaker and summary; people are told by their last names. The members of a vote count only where gold has some.
    """
    name = lambda c: last_token(c)
    same = lambda f, field: f(gold[field]).eqNullSafe(f(found[field]))
    plain = lambda c: c
    members = lambda r: F.array_sort(F.transform(r["members"], lambda m: F.struct(last_token(m["name"]).alias("n"), m["value"].alias("v"))))
    counts = same(plain, "ayes") & same(plain, "noes") & same(plain, "abstain") & same(plain, "absent")
    vote = counts & ((F.coalesce(F.size(gold["members"]), F.lit(0)) == 0) | members(gold).eqNullSafe(members(found)))
    amount = F.coalesce(F.abs(gold["amount_usd"] - found["amount_usd"]) <= 0.005, F.lit(False))
    motion, ordinance = same(name, "mover") & same(name, "seconder"), same(lambda c: F.upper(T.squeeze(c)), "identifier") & same(plain, "outcome")
    return F.when(kind == "vote", vote).when(kind == "amount", amount).when(kind == "motion", motion).when(kind == "ordinance", ordinance).when(kind == "statement", same(name, "speaker")).otherwise(F.lit(False))


def valid_answer(kind: Column, answer: Column) -> Column:
    """Whether an answer has the form of its type: a number, an ISO date, an identifier or name of 1 to 300 characters."""
    number, sized = answer.rlike(r"^-?\d+(\.\d+)?$"), F.length(F.trim(answer)).between(1, 300)
    date = answer.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(answer, "yyyy-MM-dd").isNotNull()
    return F.coalesce(F.when(kind == "number", number).when(kind == "date", date).otherwise(sized), F.lit(False))


def answer_metrics(cases: DataFrame, *by: str) -> DataFrame:
    """Accuracy of the answerable, declines of both kinds, pooled faithfulness and latencies of cases.

    Cases: answerable, correct, declined (booleans), supported, sentences (counts) and latency_ms. A share of no cases is null.
    """
    share = lambda c, of: F.round(F.avg(F.when(of, c.cast("int"))), 6)
    able = F.col("answerable")
    return cases.groupBy(*by).agg(
        share(F.col("correct"), able).alias("accuracy"), share(F.col("declined"), ~able).alias("decline"), share(F.col("declined"), able).alias("false_decline"),
        F.round(F.try_divide(F.sum("supported").cast("double"), F.sum("sentences").cast("double")), 6).alias("faithfulness"), nearest_rank("latency_ms", 0.5).alias("p50"), nearest_rank("latency_ms", 0.95).alias("p95"),
    )


def agent_metrics(tasks: DataFrame, *by: str) -> DataFrame:
    """Completion, mean share of gold documents cited and mean steps of tasks (completed, cited, gold, steps)."""
    recall = F.try_divide(F.size(F.array_intersect("cited", "gold")).cast("double"), F.size(F.array_distinct("gold")).cast("double"))
    return tasks.groupBy(*by).agg(F.round(F.avg(F.col("completed").cast("int")), 6).alias("completion"), F.round(F.avg(recall), 6).alias("recall"), F.round(F.avg("steps"), 6).alias("steps"))


def find_all(df: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    """(key, start, end) of every place of a literal that does not overlap the one before."""
    if not literal:
        raise ValueError("the literal is empty")
    parts = F.split(F.col(text), r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E", -1)
    w = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.filter(F.contains(F.col(text), F.lit(literal))).select(key, F.monotonically_increasing_id().alias("_row"), F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.length(x)).alias("_n"))
    rows = rows.select(key, "_row", F.posexplode("_n").alias("i", "n"))
    start = F.sum("n").over(w) + F.col("i") * len(literal)
    return rows.select(key, start.alias("start"), (start + len(literal)).alias("end"))


def unit_offsets(spans: DataFrame, units: DataFrame, doc: str = "document_id") -> DataFrame:
    """spans (doc, start, end) of texts whose units are joined by line ends, with unit, unit_start and unit_end of each unit they touch.

    units: (doc, unit, length). A document's units add up where they lie; spans meet them by document and overlap.
    """
    w = Window.partitionBy(doc).orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("_at", F.coalesce(F.sum(F.col("length") + 1).over(w), F.lit(0)))
    both = spans.join(placed, doc).filter((F.col("start") < F.col("_at") + F.col("length")) & (F.col("end") > F.col("_at")))
    return both.withColumns({"unit_start": F.greatest(F.lit(0), F.col("start") - F.col("_at")), "unit_end": F.least(F.col("length"), F.col("end") - F.col("_at"))}).drop("_at", "length")


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that the seed and their keys decide, whatever the partitions; fewer if there are fewer."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those with their keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def below_minimum(df: DataFrame, by: str, **least: int) -> DataFrame:
    """(by, measure, n, least) of groups whose sums (or, for "rows", counts) are under what is asked for."""
    sums = [(F.count(F.lit(1)) if c == "rows" else F.sum(c)).alias(c) for c in least]
    each = F.array(*(F.struct(F.lit(c).alias("measure"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n"), F.lit(n).alias("least")) for c, n in least.items()))
    return df.groupBy(by).agg(*sums).select(by, F.explode(each).alias("m")).select(by, "m.*").filter("n < least")


def counts_with_zeros(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(value, n) for every one of the values, also those without rows."""
    return df.agg(*(F.count_if(F.col(column) == v).alias(v) for v in values)).unpivot([], values, "value", "n")
