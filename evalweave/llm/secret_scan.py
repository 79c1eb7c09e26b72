"""Secret scans with ownership frequency, by Spark expressions only.

Base kinds: assign (a name such as password, then : or =, then a value of 12 or more characters), access (AKIA and so on, 18
or more) and hex (16 or more). The method adds kind vendor (tokens whose form names their issuer) where the corpus says
that the value is somebody's own: hashes of all candidates are counted by distinct owner and repository, and a value that
more than MOST_OWNERS owners or MOST_REPOS repositories hold is a widely copied example, else it looks live. Base spans
stay either way; each carries its verdict.

Positions come from what lies between matches: a text is split at a kind's matches, and lengths of gaps and matches add up.
Hashes are pre-aggregated by (hash, owner, repository), and of the counts only widely copied values, which can be nobody's
own, are joined back, as written tables that Spark splits by size. Texts are not shuffled by `scan`.

Without a column for the repository the owner stands for it: then MOST_REPOS decides nothing, as in `query` and the
pipeline, whose documents have a source only.

Null text: empty. Null source: an owner of its own. Null doc_id, repeated rows: each is a row of the result. An empty
table: no rows. Other columns of the documents, whatever their names, pass through `redact` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_of

ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
VENDOR = r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
#: In the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "vendor")
MOST_OWNERS, MOST_REPOS = 2, 4
_SPAN = "struct<start:long,kind:int,end:long,hash:long>"


def _spans(text: Column, kind: int, pattern: str, at_least: int = 0) -> Column:
    """array<struct<start, kind, end, hash>> of all matches of pattern, leftmost and without overlap."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    parts = F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("gap"))

    def add(acc: Column, z: Column) -> Column:
        start = acc.at + F.length(z["gap"])
        end = start + F.coalesce(F.length(z["m"]), F.lit(0))
        # an assignment's value is what follows the name and its signs
        v = z["m"] if kind else F.regexp_extract(z["m"], f"^{pattern}$", 1)
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(v).alias("hash"))
        return F.struct(end.alias("at"), F.when(z["m"].isNotNull() & (F.length(v) >= at_least), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{_SPAN}>")
    return F.when(F.size(found) == 0, none).otherwise(F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), add, lambda acc: acc["out"]))


def candidates(text: Column) -> Column:
    """All candidates of a text, base and vendor, in order.

    A run of hexadecimal digits or of an access key is one match whatever its length, so the least length may stand in the
    pattern; an assignment that is too short still takes up its characters, so there it may not.
    """
    return F.array_sort(F.concat(_spans(text, 0, ASSIGN, at_least=12), _spans(text, 1, ACCESS), _spans(text, 2, HEX), _spans(text, 3, VENDOR)))


def widely_copied(found: DataFrame) -> DataFrame:
    """found (owner, repo, spans) -> hash of the values that many owners or repositories hold."""
    one = found.select("owner", "repo", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    by_owner = one.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("n")).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos")).filter((F.col("owners") > MOST_OWNERS) | (F.col("repos") > MOST_REPOS)).select("hash")


def _found(docs: DataFrame, text: str, owner: str, repo: str | None, keep: list[str]) -> DataFrame:
    """The columns to keep with spans (all candidates), owner and repo, and a number for each row, as a table of its own."""
    own = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    found = docs.select(*keep, own(owner).alias("owner"), own(repo or owner).alias("repo"), candidates(text_of(text)).alias("spans"))
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "secret-candidates")


def _judged(found: DataFrame) -> DataFrame:
    """found with spans array<struct<start, kind, end, hash, live>>: what stays. Only rows with a widely copied value are joined."""
    wide = materialize(widely_copied(found), "widely-copied")
    held = found.select("row", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    copied = materialize(held.join(wide, "hash").groupBy("row").agg(F.collect_list("hash").alias("copied")), "copied")
    out = found.join(copied, "row", "left").withColumn("copied", F.coalesce("copied", F.array().cast("array<long>")))
    judged = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["hash"].alias("hash"), (~F.array_contains("copied", s["hash"])).alias("live")))
    return out.withColumn("spans", F.filter(judged, lambda s: (s["kind"] < 3) | s["live"])).drop("copied")


def scan(docs: DataFrame, owner: str = "source", repo: str | None = None) -> DataFrame:
    """docs (doc_id, text, owner) -> doc_id, spans array<struct<start, kind, end, hash, live>>: what stays."""
    columns = [F.col("doc_id"), F.col("text"), F.col(owner).alias("_owner"), *([F.col(repo).alias("_repo")] if repo else [])]
    return _judged(_found(docs.select(*columns), "text", "_owner", "_repo" if repo else None, ["doc_id"])).select("doc_id", "spans")


def redact(docs: DataFrame, owner: str = "source", repo: str | None = None) -> DataFrame:
    """The documents, all columns, in which [SECRET] or, for a widely copied value, [EXAMPLE] stands for each span; n_chars follows.

    The documents are written once with their candidates; texts are shuffled only where the rows that hold a widely copied
    value are too many to broadcast.
    """
    # columns are numbered meanwhile, so that no name clashes with those of the method
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    text = at["text"]
    joined = _judged(_found(docs.toDF(*names), text, at[owner.lower()], repo and at[repo.lower()], names))

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined_ = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), (last["live"] | x["live"]).alias("live"))
        one = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["live"].alias("live"))
        return F.when((F.size(acc) > 0) & (x["start"] < F.get(acc, F.size(acc) - 1)["end"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined_))).otherwise(F.concat(acc, F.array(one)))

    merged = F.aggregate("spans", F.array().cast("array<struct<start:long,end:long,live:boolean>>"), merge)
    before = lambda i: F.coalesce(F.get(F.col("cut"), i - 1)["end"], F.lit(0))
    piece = lambda x, i: F.concat(F.substring(text, before(i).cast("int") + 1, (x["start"] - before(i)).cast("int")), F.when(x["live"], "[SECRET]").otherwise("[EXAMPLE]"))
    tail = F.substring(text, F.element_at(F.col("cut"), -1)["end"].cast("int") + 1, F.length(text))
    none = F.size("spans") == 0
    out = joined.withColumn("cut", merged).withColumn("new", F.when(none, F.col(text)).otherwise(F.concat(F.array_join(F.transform("cut", piece), ""), tail)))
    values = {c: F.col(n) for c, n in zip(docs.columns, names, strict=True)}
    for c in docs.columns:
        if c.lower() == "text":
            values[c] = F.col("new")
        elif c.lower() == "n_chars":
            values[c] = F.when(none, values[c]).otherwise(F.length("new").cast(docs.schema[c].dataType))
    return out.select(*[v.alias(c) for c, v in values.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *[of(k) for k in range(3)],
        F.sha2(named(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, '=' || source AS owner FROM documents),
kinds(k, kind, pattern, least, value) AS (VALUES
  (0, 'assign', '(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)', 12, '^(?i:(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?)'),
  (1, 'access', 'AKIA[A-Z0-9]+', 18, '^'), (2, 'hex', '[0-9a-f]{16,}', 16, '^'),
  (3, 'vendor', '(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})', 0, '^')),
m AS (
  SELECT r, owner, k, kind, least, value, text, unnest(found) AS m, generate_subscripts(found, 1) AS i, pieces
  FROM (SELECT r, owner, k, kind, least, value, text, regexp_extract_all(text, pattern) AS found, regexp_split_to_array(text, pattern) AS pieces FROM d, kinds)),
s AS (
  SELECT r, owner, k, kind, regexp_replace(m, value, '') AS v, least,
    CAST(list_sum(list_transform(pieces[1 : i], lambda x: length(x))) + sum(length(m)) OVER (PARTITION BY r, k ORDER BY i) - length(m) AS BIGINT) AS a, length(m) AS n FROM m),
c AS (SELECT *, a + n AS e FROM s WHERE length(v) >= least),
wide AS (SELECT v FROM c GROUP BY v HAVING count(DISTINCT owner) > 2),
kept AS (SELECT *, v NOT IN (SELECT v FROM wide) AS live FROM c WHERE k < 3 OR v NOT IN (SELECT v FROM wide)),
g AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, k) AS spans,
    count(*) FILTER (live) AS n_live FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (r)
"""
