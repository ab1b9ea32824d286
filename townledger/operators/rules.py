"""Facts read from items by fixed rules: votes, amounts, motions and legislation, each with the words that it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townledger.operators import facts

# What marks a line of a vote.
MARKS = ("In Favor:", "Opposed:", "Ayes:", "Noes:", "Nays:", "Abstain:", "Absent:")
# Patterns of subjects, legislation, amounts and motions, and the kinds of legislation by their first word.
SUBJECT = r"RESOLUTION \d{4}-\d+|ORDINANCE \d+[A-Z]?|(?:CB|Res|CF|Appt|Min|IRC|Inf) \d+"
LEGISLATION = r"RESOLUTION \d{4}-\d+|ORDINANCE \d+[A-Z]?|CB \d+|Res \d+"
TYPES = {"RESOLUTION": "resolution", "Res": "resolution", "ORDINANCE": "ordinance", "CB": "council_bill"}
AMOUNT = r"\$\d[\d,]*(?:\.\d+)?"
MOTION = r"(?U)(?:Councilmember|Commissioner) (\w+) motioned to (\w+), motion was seconded by\s+(?:Councilmember|Commissioner)\s+(\w+)"
PASSED = "Passed by"

#: A fact of any kind; the fields that its kind has no use for are null.
FIELDS = {
    "kind": "string", "quote": "string", "identifier": "string", "legislation_type": "string", "title": "string", "amount_usd": "double", "mover": "string", "seconder": "string",
    "outcome": "string", "ayes": "int", "noes": "int", "abstain": "int", "absent": "int", "members": "array<struct<name:string,value:string>>",
}
FACT = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"


def _fact(kind: str, **given: Column) -> Column:
    given["kind"] = F.lit(kind)
    return F.struct(*(given.get(k, F.lit(None)).cast(v).alias(k) for k, v in FIELDS.items()))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _row_vote(line: Column) -> Column:
    """The value of a member's vote in a table row, null on other lines."""
    return F.element_at(F.create_map(*(F.lit(x) for p in facts.MEMBER.items() for x in p)), facts.spoken(line))


def members(lines: Column) -> Column:
    """(name, value) of the members that the lists after labels and the table rows name, line by line."""
    label = "|".join(facts.LABELS.values())
    listed = lambda x: F.when(_strip(x).startswith("None"), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(x, ","), _strip), lambda n: n != ""))
    value = lambda part: F.coalesce(*(F.when(part.rlike(rf"(?i)^(?:{words}):"), facts.MEMBER[vote]) for vote, words in facts.LABELS.items()))

    def of_lists(line: Column) -> Column:
        parts = F.when(F.contains(line, F.lit(":")), F.regexp_extract_all(line, F.lit(rf"(?is)\b((?:{label}):.*?)(?=\b(?:{label}):|$)"), F.lit(1))).otherwise(F.array().cast("array<string>"))
        named = lambda p: F.transform(listed(F.regexp_replace(F.regexp_replace(p, r"^[^:]*:", ""), r"^\s*\d{1,2}\s*[-–]", "")), lambda n: F.struct(n.alias("name"), value(p).alias("value")))
        return F.flatten(F.transform(parts, named))

    def of_row(line: Column) -> Column:
        row = F.struct(_strip(F.regexp_extract(line, r"(?s)^(.*)\|", 1)).alias("name"), _row_vote(line).alias("value"))
        return F.when(F.contains(line, F.lit("|")), F.filter(F.array(row), lambda m: m["value"].isNotNull())).otherwise(F.array().cast("array<struct<name:string,value:string>>"))

    return F.flatten(F.transform(lines, lambda x: F.concat(of_lists(x), of_row(x))))


def extracted(identifier: Column, title: Column, text: Column) -> Column:
    """The facts of an item: its vote (the lines from the first to the last one with a mark or a table row's vote), an
    amount for each place of one, motions, and each piece of legislation once, where it is first named."""
    return facts.held(F.split(text, "\n"), lambda lines: _extracted(identifier, title, text, lines))


def _extracted(identifier: Column, title: Column, text: Column, lines: Column) -> Column:
    """What each pattern must hold is looked for first, so that most lines meet no pattern."""
    marked = lambda x: (F.contains(x, F.lit(":")) & F.exists(F.array(*map(F.lit, MARKS)), lambda m: F.contains(x, m))) | (F.contains(x, F.lit("|")) & _row_vote(x).isNotNull())
    numbers = F.filter(F.transform(lines, lambda x, i: F.when(marked(x), i)), lambda i: i.isNotNull())
    # Each array of one holds what is used several times, so that it is worked out once.
    spans = F.filter(F.transform(F.array(numbers), lambda n: F.when(F.size(n) > 0, F.slice(lines, F.element_at(n, 1) + 1, F.element_at(n, -1) - F.element_at(n, 1) + 1))), lambda x: x.isNotNull())
    counted = F.transform(spans, lambda own: F.struct(own.alias("own"), F.array_join(own, "\n").alias("quote"), facts.votes(F.array_join(own, "\n")).alias("n")))
    subject = F.regexp_extract(text, SUBJECT, 0)
    vote = lambda v: _fact("vote", quote=v["quote"], identifier=F.when(subject != "", subject).otherwise(identifier), outcome=F.when(v["n"]["ayes"] > v["n"]["noes"], "passed").otherwise("failed"), **{k: v["n"][k] for k in facts.VOTES}, members=members(v["own"]))
    value = lambda a: F.regexp_replace(a, r"[$,]", "").try_cast("double")
    amounts = F.flatten(F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("$"))), lambda x: F.transform(F.regexp_extract_all(x, F.lit(AMOUNT), F.lit(0)), lambda a: _fact("amount", quote=x, title=title, amount_usd=value(a)))))
    who = lambda q, i: F.regexp_extract(q, MOTION, i)
    moved = F.when(F.contains(text, F.lit(" motioned to ")), F.regexp_extract_all(text, F.lit(MOTION), F.lit(0))).otherwise(F.array().cast("array<string>"))
    motions = F.transform(moved, lambda q: _fact("motion", quote=q, mover=who(q, 1), seconder=who(q, 3), outcome=F.when(F.contains(text, F.lit(PASSED)), "passed").otherwise("unknown")))
    kind = lambda n: F.element_at(F.create_map(*(F.lit(x) for p in TYPES.items() for x in p)), F.substring_index(n, " ", 1))
    first = lambda n: F.element_at(F.filter(lines, lambda x: F.contains(x, n)), 1)
    laws = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(LEGISLATION), F.lit(0))), lambda n: _fact("ordinance", quote=first(n), identifier=n, legislation_type=kind(n), title=title, outcome=F.lit("unknown")))
    return F.concat(F.transform(counted, vote), amounts, motions, laws)


def rule_facts(df: DataFrame, *keys: str, identifier: str = "identifier", title: str = "title", text: str = "text") -> DataFrame:
    """(keys, number, start, end and the fields of FACT): the facts of each row's item, numbered 1, 2, ... as they are found.

    One pass of expressions, without a shuffle. start and end are the first place of the quote in the text, in code
    points. A null or empty text has no facts; equal items each have theirs; names of white space only are no names.
    """
    rows = df.select(*keys, F.col(text).alias("_text"), F.posexplode(extracted(F.col(identifier), F.col(title), F.coalesce(F.col(text), F.lit("")))).alias("_n", "_fact"))
    at = F.call_function("locate", F.col("_fact.quote"), F.col("_text")) - 1
    return rows.select(*keys, (F.col("_n") + 1).alias("number"), at.alias("start"), (at + F.length("_fact.quote")).alias("end"), "_fact.*")


