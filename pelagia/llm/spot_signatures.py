"""Operator 13, document fingerprints by spot signatures, in DataFrame functions only.

Wherever a text has one of the common words (an anchor), the ``chain`` content words that follow, ``gap`` content words
apart, form a signature with it; words of menus and lists seldom have anchors, running text has many. The set of a text's
signatures, each as its crc32, in ascending order, is its fingerprint: it depends on the text alone, so equal texts have equal
fingerprints and a change reaches only the signatures around it. A text in which no anchor is followed by a chain takes each
of its words as an anchor; one without letters or digits takes what stands between blanks as words.

Two fingerprints are as like as the Jaccard similarity of their sets. ``near_pairs`` finds what is at least ``percent`` like
without comparing all: sets are partitioned by length so that only sets of one or of neighbouring partitions can be that like,
and of each set only the signatures that the corpus holds least often, as many as a partner at that likeness can't all miss, are looked up.

The next document of each one comes from ids alone: sorted ranges of ids, whose ends meet in a table of one row a range.
Texts move once, by id and hash; the part of a text that its predecessor takes over moves with its fingerprint.
Null and empty texts have the empty fingerprint; two empty ones have likeness 1. Rows that repeat doc_id and text are one document here and get the same
answer; of different texts of one doc_id the order is that of their md5; null doc_ids come last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .periodic_runs import CRC_TABLE, crc_sql
from .textkit import Scratch, read_table

# Common words of English, French, German and Spanish.
ANCHORS = tuple("""a an the of to in is are was and that for with by on at be this it as he or not
le la les un une des du et est que qui en dans pour par sur au aux
der die das und ein eine den dem ist von zu mit im auf nicht
el los las una unos y es de del al con por para se""".split())
CHAIN, GAP = 2, 1
HALF = 1 << 31
WORD, OTHER = r"[\p{L}\p{N}]+", r"\S+"


def once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN, gap: int = GAP) -> Column:
    """The fingerprint of a text as a set: the ascending distinct crc32 of anchor and chain, joined by spaces."""
    none = F.array().cast("array<bigint>")
    name = lambda *parts: F.crc32(F.concat_ws(" ", *parts).cast("binary"))
    reach = (chain - 1) * gap + 1

    def spots(z: Column) -> Column:
        found = F.transform(z["at"], lambda i, j: F.when(i - j + reach <= F.size(z["content"]), name(F.get(z["w"], i), *(F.get(z["content"], i - j + k * gap) for k in range(chain)))))
        return F.filter(found, lambda h: h.isNotNull())

    def every(w: Column) -> Column:
        return F.transform(w, lambda x, i: name(x, *(F.get(w, i + k) for k in range(1, chain + 1))))

    def of(w: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*anchors), i)), lambda i: i.isNotNull())
        content = F.filter(w, lambda x: ~x.isin(*anchors))
        some = once(F.struct(w.alias("w"), at.alias("at"), content.alias("content")), spots)
        return once(some, lambda s: F.when(F.size(s) > 0, s).otherwise(every(w)))

    whole = F.lower(text)
    words = F.when(whole.rlike(WORD), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))).otherwise(F.regexp_extract_all(whole, F.lit(OTHER), F.lit(0)))
    return F.when(text.rlike(OTHER), F.array_sort(F.array_distinct(once(words, of)))).otherwise(none)


def told(found: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits a signature."""
    return F.array_join(F.transform(found, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones. Sets of which one is empty are not compared."""
    both = F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.size(F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(once(both, lambda k: k / (F.size(a) + F.size(b) - k).cast("double")))


def near_pairs(queries: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """(query, id, likeness) of what in ``sets`` (id, found) is at least ``percent`` like a row of ``queries`` (query, found); empty sets are like nothing here."""
    def length_class(found: Column) -> Column:
        if percent == 100:  # equal sets only
            return F.size(found).cast("long")
        return F.floor(F.log(F.size(found).cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)

    full = sets.where(F.size("found") > 0)
    common = full.select(F.explode("found").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))

    def prefixes(df: DataFrame, key: str) -> DataFrame:
        each = df.where(F.size("found") > 0).select(key, F.size("found").alias("size"), length_class(F.col("found")).alias("class"), F.explode("found").alias("sig"))
        order = Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "sig")
        keep = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1
        return each.join(common, "sig", "left").withColumn("at", F.row_number().over(order)).where(F.col("at") <= keep).select(key, "size", "class", "sig")

    ask, held = prefixes(queries, "query"), prefixes(full, "id")
    ask = ask.withColumn("class", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    pairs = ask.join(held.withColumnRenamed("size", "other"), ["sig", "class"]).where(100 * F.least("size", "other") >= percent * F.greatest("size", "other")).select("query", "id").distinct()
    both = pairs.join(queries.select("query", F.col("found").alias("__a")), "query").join(full.select("id", F.col("found").alias("__b")), "id")
    like = F.size(F.array_intersect("__a", "__b"))
    return both.withColumn("both", like).where(100 * F.col("both") >= percent * (F.size("__a") + F.size("__b") - F.col("both"))).select("query", "id", likeness(F.col("__a"), F.col("__b")).alias("likeness"))


def successors(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, before, half, times) of the documents of ``docs`` (doc_id, key, n): the key of the document that each one follows, by descending doc_id and in a ring, half of that one's length, and the rows that the document has."""
    each = docs.groupBy("doc_id", "key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times"))
    dealt = scratch.table(each.repartitionByRange(F.desc_nulls_last("doc_id"), "key").withColumn("range", F.spark_partition_id()), "ids")
    order = Window.partitionBy("range").orderBy(F.desc_nulls_last("doc_id"), "key")
    own = F.struct("key", "n")
    sort = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.col("key"))
    ends = dealt.groupBy("range").agg(F.max_by(own, sort).alias("last"))  # one row a range
    among = Window.orderBy("range")
    ends = ends.select("range", F.coalesce(F.lag("last").over(among), F.last("last").over(among.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("previous"))
    placed = dealt.withColumn("before", F.lag(own).over(order)).join(F.broadcast(ends), "range").withColumn("before", F.coalesce("before", "previous"))
    return scratch.table(placed.select("key", F.col("before.key").alias("before"), F.floor(F.col("before.n") / 2).alias("half"), "times"), "successors")


def with_next(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, found (its signatures), part and next (of the next document: as many first characters as half the text has, and its signatures) of each row of ``docs`` (doc_id, text)."""
    scratch = Scratch(spark, "spots")
    text = F.coalesce("text", F.lit(""))
    # The key holds doc_id too, so both joins below read the same two columns, and Spark deals the texts out once for both.
    keyed = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.md5(text)).alias("key"), text.alias("text"))
    doc_id = F.nullif(F.substring_index("key", ":", 1), F.lit("")).cast("long").alias("doc_id")
    after = successors(keyed.select(doc_id, "key", F.length("text").cast("long").alias("n")), scratch)
    repeated = not after.where("times > 1").isEmpty()
    small = F.transform(signatures(F.col("text")), lambda x: (x - HALF).cast("int"))  # four bytes each on their way
    parts = keyed.join(after.hint("merge"), "key").select(F.col("before").alias("key"), F.substring(F.col("text"), F.lit(1), F.col("half").cast("int")).alias("part"), small.alias("next"))
    parts = parts.dropDuplicates(["key"]) if repeated else parts  # rows that repeat a document give the same part
    found = keyed.join(parts.hint("merge"), "key").select(doc_id, "text", signatures(F.col("text")).alias("found"), "part", "next")
    return found.withColumn("next", F.transform("next", lambda x: x.cast("long") + HALF))


def op13_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = with_next(spark, read_table(spark, sf_dir, "documents"))
    n = F.length("text")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.col("part"))).withColumn("edited_found", signatures(F.col("edited")))
    return both.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), told(F.col("found")).alias("fingerprint"), told(F.col("edited_found")).alias("edited_fingerprint"),
                       likeness(F.col("found"), F.col("edited_found")).alias("near_edited"), likeness(F.col("found"), F.col("next")).alias("near_next"), F.size("found").cast("long").alias("n_signatures"))


_BYTES = "list_transform(range(0, length(hex(encode(x))), 2), lambda i: 16 * (position(hex(encode(x))[i + 1] in '0123456789ABCDEF') - 1) + position(hex(encode(x))[i + 2] in '0123456789ABCDEF') - 1)"
_ANCHORS = ", ".join(f"'{a}'" for a in sorted(set(ANCHORS)))

SQL = f"""with crc as {CRC_TABLE},
d as (select row_number() over (order by doc_id desc nulls last) k, count(*) over () many, doc_id, coalesce(text, '') t from documents),
p as (select a.k, a.doc_id, a.t, b.t u from d a join d b on b.k = case when a.k = a.many then 1 else a.k + 1 end),
e as (select k, doc_id, t, t[:length(t) - length(t) // 2] || u[:length(t) // 2] ed from p),
v as (select k, 0 kind, t from e union all select k, 1, ed from e),
w as (select k, kind, case when regexp_matches(lower(t), '{WORD}') then regexp_extract_all(lower(t), '{WORD}') else regexp_extract_all(lower(t), '{OTHER}') end w from v),
x as (select k, kind, unnest(w) w, generate_subscripts(w, 1) i from w),
y as (select *, w in ({_ANCHORS}) anchor from x),
c as (select k, kind, w, row_number() over (partition by k, kind order by i) j from y where not anchor),
a as (select *, count(*) filter (not anchor) over (partition by k, kind order by i) before from y),
s as (select a.k, a.kind, a.w || ' ' || c.w || ' ' || f.w x from a join c on c.k = a.k and c.kind = a.kind and c.j = before + 1 join c f on f.k = a.k and f.kind = a.kind and f.j = before + {1 + GAP} where anchor),
r as (select k, kind, concat_ws(' ', w, lead(w) over o, lead(w, 2) over o) x from y anti join s using (k, kind) window o as (partition by k, kind order by i)),
h as (select x, {crc_sql(_BYTES, "t")} h from (select distinct x from (select x from s union all select x from r)), crc),
g as (select distinct k, kind, h from (select * from s union all select * from r) join h using (x)),
b as (select k, kind, string_agg(lpad(printf('%x', h), 8, '0'), '' order by h) told, count(*) n from g group by k, kind),
ie as (select a.k, count(*) m from g a join g b on a.k = b.k and a.h = b.h and a.kind = 0 and b.kind = 1 group by a.k),
ix as (select a.k, count(*) m from g a join g b on b.k = (case when a.k = (select max(k) from d) then 1 else a.k + 1 end) and a.h = b.h and a.kind = 0 and b.kind = 0 group by a.k)
select doc_id, length(t) n_chars, sha256(ed) edited_sha256, coalesce(o.told, '') fingerprint, coalesce(c.told, '') edited_fingerprint,
       case when coalesce(o.n, 0) + coalesce(c.n, 0) = 0 then 1.0::double else coalesce(ie.m, 0)::double / (coalesce(o.n, 0) + coalesce(c.n, 0) - coalesce(ie.m, 0)) end near_edited,
       case when coalesce(o.n, 0) + coalesce(x.n, 0) = 0 then 1.0::double else coalesce(ix.m, 0)::double / (coalesce(o.n, 0) + coalesce(x.n, 0) - coalesce(ix.m, 0)) end near_next,
       coalesce(o.n, 0) n_signatures
from e left join b o on o.k = e.k and o.kind = 0 left join b c on c.k = e.k and c.kind = 1
left join b x on x.kind = 0 and x.k = (case when e.k = (select max(k) from d) then 1 else e.k + 1 end) left join ie on ie.k = e.k left join ix on ix.k = e.k"""

QUERIES = {"op13_spot_signatures": op13_spot_signatures}
ORACLES = {"op13_spot_signatures": SQL}
