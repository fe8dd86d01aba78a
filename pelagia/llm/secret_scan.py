"""Operator 2, secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidate spans of each whole text. The hash of every candidate's value is
counted over the corpus by distinct repositories and owners: a value that many owners hold, or few
owners in many repositories each, is a widely copied example; any other is a live-looking credential. Spans of the base
patterns always stay; spans of the wider patterns (``opaque``, ``pem``) are added where the
counts speak for a live credential and no base span overlaps; a private key is one span with its
body, whatever lies inside it, and is counted by its body. The SQL knows only the heads of keys.

A text's matches become rows; places are running sums over them, and what overlaps is told from running extremes, so
the work of a text grows with its length and matches, not with their square. Sums go by (value, owner, repository), then (value, owner), then value, each combined in the
map tasks first, so a value in a third of all rows moves one row a task. Null and empty texts
have no spans; a null owner counts as one owner of its own; repeated rows are scanned each; an
empty table gives no rows; other columns are kept out of the way by names of our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import Scratch, read_table

# The patterns of the contract. A value of `assign` shorter than 8 is dropped after the match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Wider patterns: long words that mix digits, upper and lower case; whole private keys, told apart by their bodies.
OPAQUE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9a-z_-]*[A-Z])(?=[0-9A-Z_-]*[a-z])[A-Za-z0-9_-]{24,}"
HEAD, FOOT = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
#: A body of a key ends at its END line; without one, after the last of the lines (or long words) of base64 and the header lines of encrypted keys. Possessive loops: Java runs them without recursion.
_BREAK = r"(?:\\[nr]|\s)"
_LOOSE = rf"(?:{_BREAK}*+(?:Proc-Type|DEK-Info|Comment):[^\r\n\\]*+)*+(?:{_BREAK}*+(?:[A-Za-z0-9+/=]{{32,}}+|[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:\\[nr]|[\r\n]|\z))))*+"
PEM = rf"{HEAD}([^-]*+(?:-(?!----)[^-]*+)*+(?={FOOT})|{_LOOSE})(?:{FOOT})?"
KINDS = {"assign": (ASSIGN, 2, 8), "access": (ACCESS, 0, 16), "hex": (HEX, 0, 32), "opaque": (OPAQUE, 0, 24), "pem": (PEM, 1, 0)}
BASE = ("assign", "access", "hex")
PEM_RANK = list(KINDS).index("pem")
#: A value with more distinct owners than this is a widely copied example.
MAX_OWNERS = 2
#: So is one with more distinct repositories than this for each of its owners.
MAX_PER_OWNER = 8

#: Code points of the blocks that a text is cut into before parts of it are taken.
CUT = 1024


def matches(text: Column, kind: str) -> Column:
    """Matches of one kind in order: code points since the match before, its own, and its value's hash (null if the value is too short)."""
    pattern, group, least = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), values.alias("value"))

    def told(x: Column, at: Column) -> Column:
        value = F.sha2(F.regexp_replace(x["value"], _BREAK, "") if kind == "pem" else x["value"], 256)
        return F.struct(F.lit(list(KINDS).index(kind)).alias("rank"), at.alias("at"), F.length(x["gap"]).cast("long").alias("gap"),
                        F.length(x["found"]).cast("long").alias("size"), F.when(F.length(x["value"]) >= least, value).alias("hash"))

    none = F.array().cast("array<struct<rank:int,at:int,gap:bigint,size:bigint,hash:string>>")
    return F.when(text.rlike(pattern), F.transform(F.filter(parts, lambda x: x["found"].isNotNull()), told)).otherwise(none)


def placed(found: DataFrame) -> DataFrame:
    """(row, owner, repo, rank, start, end, hash) of the matches of ``found``: start and end in code points, wider spans only where nothing of the base patterns and no private key overlaps them."""
    each = found.where(F.size("__found") > 0).select(F.col("__row").alias("row"), F.col("__owner").alias("owner"), F.col("__repo").alias("repo"), F.inline("__found")).repartition("row")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "rank").orderBy("at"))
    spans = each.withColumn("end", upto).withColumn("start", F.col("end") - F.col("size")).where("hash is not null")
    firm = (F.col("rank") < len(BASE)) | (F.col("rank") == PEM_RANK)
    own, sofar = Window.partitionBy("row"), (Window.unboundedPreceding, Window.currentRow)  # peers are part of a range
    before = F.max(F.when(firm, F.col("end"))).over(own.orderBy(F.asc("start")).rangeBetween(*sofar))
    after = F.min(F.when(firm, F.col("start"))).over(own.orderBy(F.desc("start")).rangeBetween(*sofar))
    clear = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return spans.withColumn("clear", firm | clear).where("clear").select("row", "owner", "repo", "rank", "start", "end", "hash")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories) of rows (hash, owner, repo)."""
    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repositories"))


def scan_secrets(spark: SparkSession, docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id",
                 keep: tuple[str, ...] = ("doc_id",), max_owners: int = MAX_OWNERS, max_per_owner: int = MAX_PER_OWNER) -> DataFrame:
    """The ``keep`` columns and, per row, base and spans (base and added ones): arrays of spans, each with live: boolean, both counts and where the live ones before it end."""
    scratch = Scratch(spark, "secrets")
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(*dict.fromkeys((*keep, text, owner, repository))).withColumns({
        "__row": F.monotonically_increasing_id(), "__owner": F.col(owner).cast("string"), "__repo": F.col(repository).cast("string"), "__found": F.concat(*(matches(whole, k) for k in KINDS))})
    found = scratch.table(found.select(*keep, "__row", "__owner", "__repo", "__found"), "found")
    spans = scratch.table(placed(found), "spans")
    owned = scratch.table(ownership(spans.select("hash", "owner", "repo")), "owned")  # written, so that Spark can split a hot value's join
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_per_owner * F.col("n_owners"))
    judged = spans.join(owned, "hash").withColumn("live", live).where(F.col("live") | (F.col("rank") < len(BASE)))
    before = F.max(F.when(F.col("live"), F.col("end"))).over(Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1))
    rows = judged.withColumn("before", F.coalesce(before, F.lit(0))).groupBy(F.col("row").alias("__row")).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "live", "n_owners", "n_repositories", "before"))).alias("__spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,live:boolean,n_owners:bigint,n_repositories:bigint,before:bigint>>")
    some = F.size("__found") > 0  # only these rows move
    hit = found.where(some).join(rows, "__row", "left").select(*keep, F.coalesce("__spans", none).alias("spans"))
    both = found.where(~some).select(*keep, none.alias("spans")).unionByName(hit)
    return both.select(*keep, F.filter("spans", lambda s: s["rank"] < len(BASE)).alias("base"), "spans")


def _told(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def redact(spark: SparkSession, docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with each live-looking secret replaced by ``mark``; examples stay, and rows are all kept."""
    names = docs.columns
    own = {c: f"__c{k}" for k, c in enumerate(names)}  # no column of docs can clash with ours
    text = F.col(own["text"])
    spans = scan_secrets(spark, docs.toDF(*own.values()), own["text"], own["source"], own["doc_id"], tuple(own.values()))
    live = F.filter("spans", lambda s: s["live"] & (s["end"] > s["before"]))

    def part(blocks: Column, at: Column, n: Column) -> Column:
        """``n`` code points from ``at`` on, from the blocks that hold them."""
        first = F.floor(at / CUT)
        held = F.array_join(F.slice(blocks, (first + 1).cast("int"), (F.floor((at + n - 1) / CUT) - first + 1).cast("int")), "")
        return F.when(n > 0, F.substring(held, (at - first * CUT + 1).cast("int"), n.cast("int"))).otherwise("")

    def masked(z: Column) -> Column:
        pieces = F.transform(z["live"], lambda s: F.concat(part(z["blocks"], s["before"], s["start"] - s["before"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), part(z["blocks"], z["last"], z["size"] - z["last"]))

    # A variable of a lambda is evaluated once, however many parts are taken from it.
    cut = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)).alias("blocks"), live.alias("live"), F.array_max(F.transform(live, lambda s: s["end"])).alias("last"), F.length(text).cast("long").alias("size"))
    new = F.when(F.size(live) > 0, F.transform(F.array(cut), masked)[0]).otherwise(text)
    changed = {"text": new}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.size(live) > 0, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
    return spans.select(*(changed.get(c, F.col(own[c])).alias(c) for c in names))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_secrets(spark, read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == list(KINDS).index(kind))).cast("long").alias(f"n_{kind}")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return got.select("doc_id", *(count(k) for k in BASE), F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"),
                      live.alias("n_live"), (F.size("spans") - live).cast("long").alias("n_example"))


def _found_sql(kind: str) -> str:
    """DuckDB: matches of one kind with their places. RE2 has no look-around, so an `opaque` is a maximal run, tested for its classes."""
    pattern, group, least = (HEAD, 0, 1) if kind == "pem" else KINDS[kind]
    if kind == "opaque":
        pattern = "[A-Za-z0-9_-]{24,}"
    pattern = pattern.replace("'", "''")
    tests = " and regexp_matches(val, '[0-9]') and regexp_matches(val, '[A-Z]') and regexp_matches(val, '[a-z]')" if kind == "opaque" else ""
    return f"""select rid, doc_id, source, '{kind}' kind, {list(KINDS).index(kind)} rank, st, st + length(found) en, sha256(val) h from (
      select *, sum(length(gap) + length(found)) over (partition by rid order by i) - length(found) st from (
        select rid, doc_id, source, unnest(string_split_regex(t, '{pattern}')) gap, unnest(list_append(regexp_extract_all(t, '{pattern}', 0), '')) found,
               unnest(list_append(regexp_extract_all(t, '{pattern}', {group}), '')) val, generate_subscripts(string_split_regex(t, '{pattern}'), 1) i
        from d where regexp_matches(t, '{pattern}'))) where length(found) > 0 and length(val) >= {least}{tests}"""


SQL = f"""with d as (select row_number() over () rid, doc_id, source, coalesce(text, '') t from documents),
e as ({" union all ".join(_found_sql(k) for k in KINDS)}),
c as (select * from e where rank < {len(BASE)} or not exists (select 1 from e b where b.rid = e.rid and b.rank < {len(BASE)} and b.st < e.en and e.st < b.en)),
f as (select h, count(distinct coalesce('=' || source, '')) owners, count(distinct coalesce('=' || source, '') || '/' || coalesce(cast(doc_id as varchar), '')) repos, owners <= {MAX_OWNERS} and repos <= {MAX_PER_OWNER} * owners live from c group by h),
j as (select c.*, f.live from c join f using (h) where f.live or c.rank < {len(BASE)}),
g as (select rid, {", ".join(f"count(*) filter (kind = '{k}') n_{k}" for k in BASE)},
      string_agg(kind || ':' || cast(st as bigint) || ':' || cast(en as bigint), ',' order by st, rank) filter (rank < {len(BASE)}) base,
      string_agg(kind || ':' || cast(st as bigint) || ':' || cast(en as bigint), ',' order by st, rank) spans,
      count(*) filter (live) n_live, count(*) filter (not live) n_example from j group by rid)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) n_{k}" for k in BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans,
       coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example from d left join g using (rid)"""

QUERIES = {"op2_secret_ownership": op2_secret_ownership}
ORACLES = {"op2_secret_ownership": SQL}
