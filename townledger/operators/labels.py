"""How many labels of each kind there must be, and the answers that are left of checked sentences."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules that count all labels of a type, and those of a city.
TOTAL = {"question": "Q-1", "agenda_count": "C-1", "extraction": "X-1", "agent_task": "A-1"}
BY_CITY = {"question": "Q-2", "agenda_count": "C-1", "extraction": "X-1", "agent_task": "A-1"}


@dataclass(frozen=True)
class Bound:
    """What a rule asks of a count, in all (whole) or in each city; part names what is counted there, as a question's type.

    Without a low or high end, that side is open. A bound of Q-6 holds for every document.
    """

    rule: str
    low: int | None = None
    high: int | None = None
    part: str | None = None
    whole: bool = False


def label_entries(labels: DataFrame) -> DataFrame:
    """(rule, city, part): what each label counts for.

    labels: type, city, answerable (null for other types than questions), question_type, reason, kind, and documents, an array of
    (id, kind), of the passages.
    """
    entry = lambda rule, city=True, part=None: F.struct(rule.alias("rule"), (F.col("city") if city else F.lit(None).cast("string")).alias("city"), (F.lit(None) if part is None else part).cast("string").alias("part"))
    known = lambda names: F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), F.col("type"))
    when = lambda ok, *entries: F.when(ok, F.array(*entries))
    of = lambda field, rule: F.when(right, F.transform(F.array_distinct(F.transform("documents", lambda x: x[field])), lambda x: entry(F.lit(rule), part=x)))
    right = (F.col("type") == "question") & F.col("answerable")
    wrong = (F.col("type") == "question") & ~F.col("answerable")
    found = F.array(
        F.array(entry(known(TOTAL), city=False), entry(known(BY_CITY))),
        when(right, entry(F.lit("Q-3"), part=F.lit("answerable")), entry(F.lit("Q-4"), part=F.col("question_type"))),
        when(wrong, entry(F.lit("Q-3"), part=F.lit("unanswerable")), entry(F.lit("Q-8"), part=F.col("reason"))),
        of("id", "Q-6"),
        of("kind", "Q-7"),
        when(F.col("type") == "extraction", entry(F.lit("X-2"), part=F.col("kind"))),
    )
    return labels.select(F.explode(F.flatten(F.array_compact(found))).alias("e")).select("e.*")


def label_violations(labels: DataFrame, bounds: Sequence[Bound], cities: Sequence[str]) -> DataFrame:
    """(rule, city, part, n, low, high) of counts out of their bounds; what has no labels counts 0.

    The cities are the named ones and, for the rules of a type, all that have labels of it. One pass counts for all rules; Q-5 counts the documents of Q-6.
    """
    counts = label_entries(labels).groupBy("rule", "city", "part").agg(F.count(F.lit(1)).alias("n"))
    documents = counts.filter("rule = 'Q-6'")
    counts = counts.unionByName(documents.groupBy("city").agg(F.count(F.lit(1)).alias("n")).select(F.lit("Q-5").alias("rule"), "city", F.lit(None).cast("string").alias("part"), "n"))
    spark = labels.sparkSession
    kind = "array<struct<rule:string,low:bigint,high:bigint,part:string,whole:boolean>>"
    asked = spark.createDataFrame([([(b.rule, b.low, b.high, b.part, b.whole) for b in bounds],)], f"b {kind}").select(F.explode("b").alias("b")).select("b.*")
    family = F.substring(F.element_at(F.create_map(*(F.lit(x) for p in TOTAL.items() for x in p)), F.col("type")), 1, 1).alias("family")
    named = spark.createDataFrame([(c, r[0]) for c in cities for r in TOTAL.values()], "city string, family string").unionByName(labels.select("city", family)).distinct()
    # Each city is asked for every bound: a short table of literals, not a join.
    literal = F.array(*(F.struct(*(F.lit(v).cast(t).alias(k) for k, v, t in (("rule", b.rule, "string"), ("part", b.part, "string"), ("low", b.low, "long"), ("high", b.high, "long")))) for b in bounds if not b.whole and b.rule != "Q-6"))
    each = named.select("city", F.explode(F.filter(literal, lambda b: b["rule"].startswith(F.col("family")))).alias("b")).select("b.rule", "city", "b.part", "b.low", "b.high")
    each = each.unionByName(asked.filter("whole").select("rule", F.lit(None).cast("string").alias("city"), "part", "low", "high"))
    every = documents.join(F.broadcast(asked.filter("rule = 'Q-6'").select("rule", "low", "high")), "rule").select("rule", "city", "part", "low", "high")
    same = lambda c: F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    both = each.unionByName(every).alias("x").join(counts.alias("y"), same("rule") & same("city") & same("part"), "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return both.select("x.rule", "x.city", "x.part", n.alias("n"), "low", "high").filter((F.col("n") < F.col("low")) | (F.col("n") > F.col("high")))


def metric_at(body: Column, path: str) -> Column:
    """The number at a dotted path of a JSON text; null where a part of the path is missing or the value is no number."""
    return F.get_json_object(body, "$" + "".join(f"['{p}']" for p in path.split("."))).try_cast("double")


def finalize(sentences: Column) -> Column:
    """(text, cites, reason) of an answer of checked sentences, an array of (text, cites, supported).

    Sentences without support go; if they are more than half, or all there is, the answer is declined as unsupported, as one of no sentences or null is. What is
    cited is numbered from 1 by first use: cites holds the old numbers in that order, and text the sentences with the new ones.
    """
    kept = F.filter(sentences, lambda x: F.coalesce(x["supported"], F.lit(False)))
    cites = F.array_distinct(F.flatten(F.transform(kept, lambda x: x["cites"])))
    marks = lambda x: F.array_join(F.transform(F.array_distinct(x["cites"]), lambda c: F.concat(F.lit("["), F.array_position(cites, c).cast("string"), F.lit("]"))), "")
    text = F.array_join(F.transform(kept, lambda x: F.concat_ws(" ", F.trim(x["text"]), F.nullif(marks(x), F.lit("")))), " ")
    bad = F.coalesce((F.size(kept) <= 0) | ((F.size(sentences) - F.size(kept)) * 2 > F.size(sentences)), F.lit(True))
    return F.struct(F.when(~bad, text).alias("text"), F.when(~bad, cites).alias("cites"), F.when(bad, "unsupported").alias("reason"))
