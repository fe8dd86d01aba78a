"""Operator 4, mixing sources to target weights by hierarchical budgeting.

Documents hang below a tree of domain, language and source. A node's token budget is shared by
its children's weights; a child that cannot use its share (its supply times ``epochs`` is less)
leaves the rest to its siblings in proportion, and only what all siblings together cannot use
goes back up, as budgets are capped by capacity before they are shared. A share is
min(capacity, weight * level), and the level that spends the budget is the largest
(budget - capacities of the smaller ones) / (weights of the others) when children stand in
order of capacity over weight.

Each leaf then takes a prefix of a stream: all its documents in an order seeded for epoch 0, then
for epoch 1, and so on, until one more would pass the budget. The last, partial epoch is
cut at one key: token sums by 4,096 ranges of the key tell the range, and only that range
is summed row by row. So no task sees a whole leaf.

Null levels count as the empty name; null texts have no tokens and go with the prefix; rows of
one doc_id are taken together; children of weight 0 get nothing; an empty table gives no rows;
columns of docs stay as they are, whatever their names. Tokens are words, so that SQL can count them, unless a tokenizer is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .textkit import WORD_PATTERN, Scratch, encoder, read_table, slices, texts_of

LEVELS = ("domain", "lang", "source")
DIGITS = 3


def key(seed: int, epoch: Column, doc_id: str = "doc_id") -> Column:
    """Place of a document in an epoch's order: as good as random, the same in any engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``budget`` of each child from its parent's ``budget``, the children's ``capacity`` and ``weight``."""
    first = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")).asc(), F.col(child).asc())
    smaller = F.coalesce(F.sum("capacity").over(first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(first.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.max("at").over(Window.partitionBy(*parent))
    return nodes.withColumn("at", (F.col("budget") - smaller) / others).withColumn("budget", F.least(F.col("capacity"), F.col("weight") * level)).drop("at", "weight", "capacity")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: float, epochs: int) -> DataFrame:
    """Levels, supply and budget of each leaf; leaves: LEVELS, supply (tokens). Weights default to 1."""
    for level in LEVELS:
        table = weights.get(level, {})
        w = F.lit(1.0)
        for name, value in table.items():
            w = F.when(F.col(level) == name, float(value)).otherwise(w)
        leaves = leaves.withColumn(f"w_{level}", w)
    for level in LEVELS:
        leaves = leaves.where(F.col(f"w_{level}") > 0)
    out = leaves.agg(F.least(F.lit(float(budget)), F.coalesce(F.sum(F.col("supply").cast("double")) * epochs, F.lit(0.0))).alias("budget"))
    above: list[str] = []
    for level in LEVELS:
        nodes = leaves.groupBy(*above, level).agg((F.sum("supply") * F.lit(float(epochs))).alias("capacity"), F.max(f"w_{level}").alias("weight")).where("capacity > 0")
        nodes = nodes.join(out, above) if above else nodes.join(F.broadcast(out))  # the root is one row
        out = share(nodes, above or [F.lit(0)], level)
        above.append(level)
    return leaves.select(*LEVELS, "supply").join(out, list(LEVELS)).withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)))


def cuts(rows: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """Per leaf: whole epochs taken, and the last key taken of the epoch after them. rows: LEVELS, doc_id, tokens."""
    plan = budgets.withColumn("whole", F.expr("budget div supply").cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("supply"))
    keyed = rows.join(plan, list(LEVELS)).select(*LEVELS, "whole", "rest", "tokens", key(seed, F.col("whole")).alias("key"))
    keyed = keyed.withColumn("range", F.substring("key", 1, DIGITS))
    sums = keyed.groupBy(*LEVELS, "whole", "rest", "range").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("range"))
    sums = sums.withColumn("upto", upto)
    last = sums.where("upto > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("range", (F.col("upto") - F.col("tokens")).alias("before")), "range").alias("at")).select(*LEVELS, "at.range", "at.before")
    inside = keyed.join(last, [*LEVELS, "range"]).groupBy(*LEVELS, "range", "rest", "before", "key").agg(F.sum("tokens").alias("tokens"))
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("key"))
    taken = inside.withColumn("running", running).where("running <= rest").groupBy(*LEVELS).agg(F.max("key").alias("key"))
    # A range starts before any of its keys, so its own digits cut it off whole; a leaf with room for all has no such range.
    return plan.join(last.select(*LEVELS, "range"), list(LEVELS), "left").join(taken, list(LEVELS), "left").select(
        *LEVELS, "budget", "whole", F.coalesce("key", "range", F.when(F.col("rest") >= F.col("supply"), "~").otherwise("")).alias("cut"))


def counted(rows: DataFrame, tokenizer: str | None) -> DataFrame:
    """``rows`` with ``tokens`` instead of ``text``: words by the word rule, or ids of the tokenizer."""
    if tokenizer is None:
        return rows.withColumn("tokens", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN), F.lit(0))).cast("long")).drop("text")
    names = [c for c in rows.columns if c != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, off = encoder(tokenizer)(texts_of(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.diff(off))], [*names, "tokens"])

    return rows.mapInArrow(count, StructType([*(rows.schema[c] for c in names), StructField("tokens", LongType())]))


def mix(spark: SparkSession, docs: DataFrame, weights: dict[str, dict[str, float]], share_of_supply: float = 0.8, epochs: int = 2, seed: int = 11,
        levels: dict[str, str] | None = None, tokenizer: str | None = None, own: tuple[str, str] = ("epoch", "leaf_budget")) -> DataFrame:
    """``docs`` (doc_id, text, and what ``levels`` read) with two columns named ``own``, a row for each time that a document is taken.

    ``levels``: SQL for domain, lang and source (columns of these names by default). A column of docs that has one of the ``own`` names
    stays as it is, and the operator's gets ``mix_`` before its name.
    """
    names = docs.columns
    told = [f"mix_{c}" if c in names else c for c in own]
    mine = {c: f"c{k}" for k, c in enumerate(names)}  # no column of docs can clash with ours
    tree = [F.coalesce(F.expr((levels or {}).get(c, c)).cast("string"), F.lit("")).alias(f"__{c}") for c in LEVELS]
    held = docs.select("*", *tree).toDF(*mine.values(), *(f"at_{c}" for c in LEVELS))
    scratch = Scratch(spark, "mixing")
    rows = held.select(F.col(mine["doc_id"]).alias("doc_id"), F.col(mine["text"]).alias("text"), *(F.col(f"at_{c}").alias(c) for c in LEVELS))
    rows = scratch.table(counted(rows, tokenizer), "rows")
    leaves = scratch.table(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")), "leaves")
    total = leaves.agg(F.sum("supply")).first()[0] or 0
    budgets = scratch.table(leaf_budgets(leaves, weights, total * share_of_supply, epochs), "budgets")
    plan = scratch.table(cuts(rows, budgets, seed), "cuts").select(*(F.col(c).alias(f"at_{c}") for c in LEVELS), "budget", "whole", "cut")
    whole, none = F.col("whole"), F.array().cast("array<int>")
    partial = F.when((whole < epochs) & (key(seed, whole, mine["doc_id"]) <= F.col("cut")), F.array(whole)).otherwise(none)
    before = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(none)
    taken = held.join(plan, [f"at_{c}" for c in LEVELS])
    return taken.select(*(F.col(m).alias(c) for c, m in mine.items()), F.explode(F.concat(before, partial)).alias(told[0]), F.col("budget").alias(told[1]))


#: The example tree: sources of one and of two digits are two domains.
DOMAIN = "case when length(source) <= 4 then 'short' when source is not null then 'long' end"
WEIGHTS = {"domain": {"short": 0.6, "long": 0.4}, "lang": {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}}


def op4_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = mix(spark, docs, WEIGHTS, levels={"domain": DOMAIN})
    return got.select("doc_id", "epoch", F.expr(DOMAIN).alias("domain"), "lang", "source", "leaf_budget")


def _share_sql(name: str, above: list[str], level: str, weight: str) -> str:
    cols = ", ".join([*above, level])
    part = f"partition by {', '.join(above)}" if above else ""
    join = f"join {name}_up using ({', '.join(above)})" if above else f"cross join {name}_up"
    return f"""{level}_n as (select *, (budget - coalesce(sum(capacity) over ({part} order by capacity / weight, {level} rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over ({part} order by capacity / weight, {level} rows between current row and unbounded following) lv from
  (select {cols}, sum(supply) * cast(2 as double) capacity, {weight} weight from leaves group by {cols} having sum(supply) > 0) {join}),
{level}_b as (select {cols}, least(capacity, weight * max(lv) over ({part})) budget from {level}_n)"""


def _case(level: str) -> str:
    return "max(case " + level + " " + " ".join(f"when '{k}' then cast({v} as double)" for k, v in WEIGHTS[level].items()) + " else cast(1 as double) end)" if level in WEIGHTS else "cast(1 as double)"


SQL = f"""with r as (select doc_id, coalesce({DOMAIN}, '') domain, coalesce(lang, '') lang, coalesce(source, '') source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) tokens,
   {DOMAIN} domain0, lang lang0, source source0 from documents),
leaves as (select domain, lang, source, sum(tokens) supply from r group by all),
domain_up as (select least(sum(supply) * cast(0.8 as double), sum(supply) * cast(2 as double)) budget from leaves),
{_share_sql("domain", [], "domain", _case("domain"))},
lang_up as (select * from domain_b),
{_share_sql("lang", ["domain"], "lang", _case("lang"))},
source_up as (select * from lang_b),
{_share_sql("source", ["domain", "lang"], "source", _case("source"))},
plan as (select domain, lang, source, supply, cast(floor(budget + 1e-6) as bigint) budget, cast(floor(budget + 1e-6) as bigint) // supply whole from source_b join leaves using (domain, lang, source)),
e as (select r.*, p.budget, p.whole, p.supply, unnest([0, 1]) epoch from r join plan p using (domain, lang, source)),
s as (select *, epoch * supply + sum(tokens) over (partition by domain, lang, source, epoch order by md5('11:' || epoch || ':' || coalesce(cast(doc_id as varchar), ''))) upto from e)
select doc_id, cast(epoch as integer) epoch, domain0 domain, lang0 lang, source0 source, budget leaf_budget from s where upto <= budget"""

QUERIES = {"op4_hierarchical_mixing": op4_hierarchical_mixing}
ORACLES = {"op4_hierarchical_mixing": SQL}
