"""Record resolution and table maintenance: merges, upserts with sticky states, cascades, version chains."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import fold, title_key
from lodestar.operators.selection import first_by
from lodestar.plans.registry import query
from lodestar.sources.bindings import ARTICLES, CHUNKS, FOLD, HITS, articles, chunks, record_hits
from lodestar.sources.tables import stored, table

KEY = f"CASE WHEN regexp_replace({FOLD.format(x='title')}, '[^a-z0-9]+', '', 'g') = '' THEN sha256(title) ELSE regexp_replace({FOLD.format(x='title')}, '[^a-z0-9]+', '', 'g') END"


@query("three_level_dedupe", f"WITH {ARTICLES}, h AS (SELECT article_id, sha256(body) AS sha, lower(doi) AS doi, {KEY} AS key, year, source FROM articles), a AS (SELECT *, min(article_id) OVER (PARTITION BY sha) AS by_hash, CASE WHEN doi IS NOT NULL THEN min(article_id) OVER (PARTITION BY doi) END AS by_doi, min(article_id) OVER (PARTITION BY key, year) AS by_title FROM h) SELECT article_id, CASE WHEN by_hash < article_id THEN by_hash WHEN by_doi < article_id THEN by_doi WHEN by_title < article_id THEN by_title END AS duplicate_of, CASE WHEN by_hash < article_id THEN 'hash' WHEN by_doi < article_id THEN 'doi' WHEN by_title < article_id THEN 'title' ELSE 'new' END AS reason FROM a")
def three_level_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article's earlier twin by file hash, then by DOI, then by title and year."""
    rows = articles(spark, sf_dir).select("article_id", F.sha2("body", 256).alias("sha"), F.lower("doi").alias("doi"), title_key(F.col("title")).alias("key"), "year")
    for name, keys in (("by_hash", ["sha"]), ("by_doi", ["doi"]), ("by_title", ["key", "year"])):
        rows = rows.join(rows.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.min("article_id").alias(name)), keys, "left")
    i = F.col("article_id")
    twin, why = F.lit(None).cast("long"), F.lit("new")
    for name, said in (("by_title", "title"), ("by_doi", "doi"), ("by_hash", "hash")):
        twin, why = F.when(F.col(name) < i, F.col(name)).otherwise(twin), F.when(F.col(name) < i, said).otherwise(why)
    return rows.select("article_id", twin.alias("duplicate_of"), why.alias("reason"))


@query("merged_records", f"WITH {ARTICLES}, r AS (SELECT coalesce('doi:' || lower(doi), 'title:' || {KEY} || ':' || CAST(year AS VARCHAR)) AS key, * FROM articles) SELECT key, min(article_id) AS survivor, arg_max(length(title), (length(title), -article_id)) AS longest, arg_min(lang, article_id) AS lang, max(n_chars) AS n_chars, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS merged FROM r GROUP BY key")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each canonical key: the longest title, the first language, the largest count, all sources."""
    i = F.col("article_id")
    key = F.coalesce(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("title:"), title_key(F.col("title")), F.lit(":"), F.col("year").cast("string")))
    return articles(spark, sf_dir).groupBy(key.alias("key")).agg(
        F.min("article_id").alias("survivor"),
        F.max_by(F.length("title"), F.struct(F.length("title"), -i)).cast("long").alias("longest"),
        F.min_by("lang", "article_id").alias("lang"),
        F.max("n_chars").alias("n_chars"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.count(F.lit(1)).alias("merged"),
    )


@query("twin_merge_groups", f"WITH {ARTICLES} SELECT {KEY} AS key, year, min(article_id) FILTER (doi IS NOT NULL) AS survivor, count(*) - 1 AS absorbed FROM articles GROUP BY 1, 2 HAVING count(doi) = 1 AND count(*) > 1")
def twin_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of one title and year with exactly one DOI: its row absorbs the others."""
    own = articles(spark, sf_dir).groupBy(title_key(F.col("title")).alias("key"), "year").agg(F.min(F.when(F.col("doi").isNotNull(), F.col("article_id"))).alias("survivor"), (F.count(F.lit(1)) - 1).alias("absorbed"), F.count("doi").alias("dois"))
    return own.where("dois = 1 AND absorbed > 0").drop("dois")


@query("sticky_upsert", "WITH o AS (SELECT user_id, event_type AS source, arg_max(CASE WHEN value > 60 THEN 'downloaded' WHEN value > 30 THEN 'failed' ELSE 'available' END, (ts, event_id)) AS state FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT user_id, event_type AS source, arg_max(CASE WHEN value > 60 THEN 'downloaded' WHEN value > 30 THEN 'failed' ELSE 'available' END, (ts, event_id)) AS state FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.source, n.source) AS source, CASE WHEN o.state = 'downloaded' THEN o.state WHEN n.state IS NULL THEN o.state WHEN o.state = 'failed' AND n.state <> 'downloaded' THEN o.state ELSE n.state END AS state FROM o FULL JOIN n ON n.user_id = o.user_id AND n.source = o.source")
def sticky_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New observations over old ones; what is downloaded stays so, and a failure yields to a download only."""
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("source"), "ts", "event_id", F.when(v > 60, "downloaded").when(v > 30, "failed").otherwise("available").alias("state"))
    latest = lambda df, name: df.groupBy("user_id", "source").agg(F.max_by("state", F.struct("ts", "event_id")).alias(name))
    both = latest(rows.where("event_id % 2 = 0"), "old").join(latest(rows.where("event_id % 2 = 1"), "new"), ["user_id", "source"], "full_outer")
    old, new = F.col("old"), F.col("new")
    kept = F.when(old == "downloaded", old).when(new.isNull(), old).when((old == "failed") & (new != "downloaded"), old).otherwise(new)
    return both.select("user_id", "source", kept.alias("state"))


@query("archive_merge", f"WITH {HITS}, o AS (SELECT record_id, count(*) AS n, max(theme) AS theme FROM hits WHERE hit_status = 'rejected' AND run_id % 2 = 0 GROUP BY record_id), n AS (SELECT record_id, max(CASE WHEN score < 0.03 THEN theme END) AS theme FROM hits WHERE hit_status = 'rejected' AND run_id % 2 = 1 GROUP BY record_id) SELECT coalesce(o.record_id, n.record_id) AS record_id, coalesce(o.n, 0) + CASE WHEN n.record_id IS NULL THEN 0 ELSE 1 END AS rejections, coalesce(n.theme, o.theme) AS theme FROM o FULL JOIN n ON n.record_id = o.record_id")
def archive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of rejected records after a run: counts grow, missing new values keep the old."""
    rows = record_hits(spark, sf_dir).where("hit_status = 'rejected'")
    old = rows.where("run_id % 2 = 0").groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.max("theme").alias("old_theme"))
    new = rows.where("run_id % 2 = 1").groupBy("record_id").agg(F.max(F.when(F.col("score") < 0.03, F.col("theme"))).alias("new_theme"), F.lit(1).alias("fresh"))
    both = old.join(new, "record_id", "full_outer")
    return both.select("record_id", (F.coalesce("n", F.lit(0)) + F.coalesce("fresh", F.lit(0))).alias("rejections"), F.coalesce("new_theme", "old_theme").alias("theme"))


@query("insert_or_ignore", "SELECT c_custkey, c_acctbal, 'kept' AS origin FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1, 'added' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the source whose key the target lacks are appended."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    target = rows.where("c_custkey % 3 <> 0").withColumn("origin", F.lit("kept"))
    source = rows.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("added").alias("origin"))
    return target.unionByName(source.join(target, "c_custkey", "left_anti"))


@query("cascade_delete", f"WITH {ARTICLES}, {CHUNKS} SELECT chunk_id FROM chunks WHERE article_id NOT IN (SELECT article_id FROM articles WHERE status = 'rejected')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that are left when rejected articles go."""
    gone = articles(spark, sf_dir).where("status = 'rejected'").select("article_id")
    return chunks(spark, sf_dir).join(gone, "article_id", "left_anti").select("chunk_id")


@query("manual_overrides", f"WITH {HITS}, a AS (SELECT record_id, arg_max(hit_status, (score, theme, run_id)) AS auto FROM hits GROUP BY record_id) SELECT record_id, CASE WHEN record_id % 17 = 0 THEN 'accepted' WHEN record_id % 19 = 0 THEN 'rejected' ELSE auto END AS decision FROM a")
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto = record_hits(spark, sf_dir).groupBy("record_id").agg(F.max_by("hit_status", F.struct("score", "theme", "run_id")).alias("auto"))
    i = F.col("record_id")
    manual = F.when(i % 17 == 0, "accepted").when(i % 19 == 0, "rejected")
    return auto.select("record_id", F.coalesce(manual, "auto").alias("decision"))


@query("version_chain", "WITH v AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS version, sha256(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus) AS hash, lag(sha256(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus)) OVER w AS parent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, version, hash, parent, sha256(coalesce(parent, '') || hash) AS link FROM v")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered versions, each chained to the hash of the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    h = F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), "o_orderstatus"), 256)
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(w).alias("version"), h.alias("hash"), F.lag(h).over(w).alias("parent"))
    return rows.withColumn("link", F.sha2(F.concat(F.coalesce("parent", F.lit("")), "hash"), 256))


@query("next_positions", "SELECT conv_id, max(turn) + 1 AS next_position FROM conversations GROUP BY conv_id")
def next_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_position"))


def guarded_update(rows: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """``rows(key, content_hash, status)`` with the status of ``read(key, content_hash, status)`` where the content is still what was read; others keep theirs."""
    own = read.select(key, "content_hash", F.col("status").alias("_new"))
    return rows.join(own, [key, "content_hash"], "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


@query("hash_guarded_update", "WITH now AS (SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN upper(text) ELSE text END) AS content_hash FROM documents) SELECT now.doc_id, CASE WHEN now.content_hash = md5(d.text) THEN 'indexed' ELSE 'pending' END AS status FROM now JOIN documents d USING (doc_id)")
def hash_guarded_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were read and then, one in four, changed: only unchanged ones become indexed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    now = docs.select("doc_id", F.md5(F.when(F.col("doc_id") % 4 == 0, F.upper("text")).otherwise(F.col("text"))).alias("content_hash"), F.lit("pending").alias("status"))
    return guarded_update(now, docs.select("doc_id", F.md5("text").alias("content_hash"), F.lit("indexed").alias("status")), "doc_id").select("doc_id", "status")


# --- titles that mean the same -------------------------------------------------------------------

#: Letters of a gram, the share of grams that is looked at (one in so many, finer levels for keys that need them), and the likeness from which titles mean the same.
GRAM, THIN, ALIKE = 12, (4, 2, 1), 0.96
ODD = np.uint64(0x9E3779B97F4A7C15)


def most_lost(places: np.ndarray, edits: int, gram: int) -> int:
    """How many of the grams at ``places``, in order, ``edits`` edits can destroy at most: one edit destroys those that begin within ``gram`` places."""
    n = len(places)
    if edits >= n:
        return n
    after = np.searchsorted(places, places + gram)
    own, best = after - np.arange(n), np.zeros(n + 1, np.int64)
    for _ in range(edits):
        more = np.maximum.accumulate(np.append(own + best[after], 0)[::-1])[::-1]
        if (more == best).all():
            break
        best = more
    return int(best[0])


def drawn_grams(key: str, edits: int, gram: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """``level, names, counts, first places, last places, most lost`` of a key's grams, from the coarsest level to the first at which ``edits`` edits leave a gram of it. A gram's name decides at which levels it is."""
    letters = np.frombuffer(key.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    names = np.zeros(len(letters) - gram + 1, np.uint64)
    for i in range(gram):
        names = (names ^ letters[i : i + len(names)]) * ODD
        names ^= names >> np.uint64(29)
    found = []
    for level, thin in enumerate(THIN):
        places = np.flatnonzero(names <= np.uint64((2**64 - 1) // thin))
        own, at, n = np.unique(names[places], return_inverse=True, return_counts=True)
        low, high = np.full(len(own), len(names)), np.zeros(len(own), np.int64)
        np.minimum.at(low, at, places)
        np.maximum.at(high, at, places)
        lost = most_lost(places, edits, gram)
        found.append((level, own.view(np.int64), n, low, high, lost))
        if lost < len(places):
            break
    return found


def placed_grams(keys: DataFrame, least: float) -> DataFrame:
    """``id, l, level, g, n, low, high, lost``: grams of ``keys(id, key)``, how often and between which places each occurs; ``l`` is a key's length, ``lost`` how many of a level's grams the most edits to a partner ``least`` alike can destroy.

    Keys that have no such partner but themselves are left out. Only one gram in some is looked at, those that a hash of the gram draws, so two keys draw
    the same of what they have in common. A key has as many levels, each with the grams of the one before and more, as it takes until some gram is left whatever the edits are.
    """
    ratio = (1 - least) / least
    gram = min(GRAM, int(0.5 / ratio + 1e-9)) if ratio else GRAM
    if gram < 1:
        raise ValueError("titles less alike than two thirds need not have a letter in common")
    kind = keys.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for i, key in enumerate(part.column(1).to_pylist()):
                    out += [(np.full(len(g), i), np.full(len(g), len(key)), np.full(len(g), level), g, n, low, high, np.full(len(g), lost)) for level, g, n, low, high, lost in drawn_grams(key, int(ratio * len(key) + 1e-9), gram)]
                if out:
                    i, *columns = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), *(pa.array(x, pa.int64() if at == 2 else pa.int32()) for at, x in enumerate(columns))], ["id", "l", "level", "g", "n", "low", "high", "lost"])

    return keys.where(F.floor(ratio * F.length("key") + 1e-9) > 0).select("id", "key").mapInArrow(run, f"id {kind}, l int, level int, g long, n int, low int, high int, lost int")


def title_meetings(one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    """``a, b`` of two tables of :func:`placed_grams`, or of one with itself, among them all pairs of different keys that are ``least`` alike.

    At the coarser of two keys' last levels some gram of one is kept in the other. The first that is, in one order of all grams, the rarest first, comes in either key before more
    grams than its edits can destroy have passed, at about the same place, in keys of about the same length. Grams of one table only are lost in any pair. Classes of
    length keep those apart that many keys share.
    """
    held = one.select("level", "g", F.lit(1).alias("side"))
    held = held if two is one else held.unionByName(two.select("level", "g", F.lit(2).alias("side")))
    common = held.groupBy("level", "g").agg(F.count(F.lit(1)).alias("df"), F.min("side").alias("low"), F.max("side").alias("high")).where("df > 1" if two is one else "low < high").select("level", "g", "df")

    def first(rows: DataFrame) -> DataFrame:
        passed = F.sum("n").over(Window.partitionBy("id", "level").orderBy(F.asc_nulls_first("df"), "g")) - F.col("n")
        kept = rows.join(common.hint("merge"), ["level", "g"], "left").withColumn("passed", passed).where("passed <= lost AND df IS NOT NULL")
        return stored(kept.select("id", "l", "level", "g", "low", "high"), "prefixes")

    step = -math.log(least) * 1.001  # a little more than partners' lengths can differ by, so that rounding moves none by two classes
    own_class = F.floor(F.log(F.col("l").cast("double")) / step)
    b = first(two)
    a = (b if two is one else first(one)).select(F.col("id").alias("a"), F.col("l").alias("la"), "level", "g", F.col("low").alias("la0"), F.col("high").alias("la1"), F.explode(F.sequence(own_class - 1, own_class + 1)).alias("class"))
    b = b.select(F.col("id").alias("b"), F.col("l").alias("lb"), "level", "g", F.col("low").alias("lb0"), F.col("high").alias("lb1"), own_class.alias("class"))
    edits = F.floor((1 - least) * F.greatest("la", "lb") + 1e-9)
    near = (F.abs(F.col("la") - F.col("lb")) <= edits) & (F.col("la0") <= F.col("lb1") + edits) & (F.col("lb0") <= F.col("la1") + edits)
    return a.join(b.hint("merge"), ["level", "g", "class"]).where(near).select("a", "b")


#: Letters up to which Spark's own distance serves, and from which it is sought along diagonals, whose work grows with the distance, not with the square of the length.
SHORT, LONG = 64, 4000


def distance_by_bits(a: str, b: str) -> int:
    """The edit distance, a column of the table at a time: whether a cell is one more or one less than its neighbour is a bit of a number as long as ``a``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every, last, apart = (1 << len(a)) - 1, 1 << len(a) >> 1, len(a)
    more, less = every, 0
    for x in b:
        same = places.get(x, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | (every & ~(across | more)), more & across
        apart += bool(up & last) - bool(down & last)
        up, down, same = up << 1 | 1, down << 1, same | less
        more, less = (down | ~(same | up)) & every, up & same & every
    return apart


def distance_within(a: str, b: str, most: int) -> int:
    """The edit distance of two ASCII texts if it is ``most`` or less, else -1.

    Letters' counts that differ too much rule it out. For each number of edits the farthest place on each diagonal is kept that they reach; equal letters behind it are passed eight at a time.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return -1
    eights = [np.frombuffer(x.encode("ascii") + end * 8, np.uint8) for x, end in ((a, b"\xff"), (b, b"\xfe"))]
    held, other = (np.bincount(x[:-8], minlength=128) for x in eights)
    if np.abs(held - other).sum() > 2 * most:  # an edit changes two letters' counts by one at most
        return -1
    a8, b8 = (np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, 8)).view(np.uint64).ravel() for x in eights)
    one = np.uint64(1)

    def slid(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        live = np.arange(len(x))
        while len(live):
            differ = a8[x[live]] ^ b8[x[live] + k[live]]
            same = differ == 0
            x[live] += np.where(same, 8, np.bitwise_count((differ & (~differ + one)) - one) >> 3)
            live = live[same]
        return x

    far = np.full(2 * most + 3, -2)  # diagonal k at place k + most + 1
    for edits in range(most + 1):
        low, high = max(-edits, m - n - (most - edits)), min(edits, m - n + most - edits)
        k = np.arange(low, high + 1)
        at = k + most + 1
        if edits:
            x = np.maximum(np.maximum(far[at] + 1, far[at - 1]), far[at + 1] + 1)
            x = np.minimum(x, np.minimum(n, m - k))
        else:
            x = np.zeros(len(k), np.int64)
        new = np.full(len(far), -2)
        new[at] = slid(x, k)
        far = new
        if far[m - n + most + 1] >= n:
            return edits
    return -1


@F.pandas_udf(T.IntegerType())
def distances_within(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else distance_within(x, y, m) for x, y, m in zip(a, b, most, strict=True)], dtype="Int32")


def apart_within(a: str, b: str, least: float) -> Column:
    """The edit distance of two keys if it allows a likeness of ``least``, else -1."""
    longer = F.greatest(F.length(a), F.length(b))
    most = F.floor((1 - least) * longer + 1e-9).cast("int")
    long = (longer >= SHORT) & (F.octet_length(a) == F.length(a)) & (F.octet_length(b) == F.length(b))
    # not worked out again wherever the distance is named
    asked = distances_within.asNondeterministic()(F.when(long, F.col(a)), F.when(long, F.col(b)), most)
    return F.coalesce(asked, F.when(~long, F.call_function("levenshtein", F.col(a), F.col(b), most)))


def title_pairs(keys: DataFrame, least: float = ALIKE) -> DataFrame:
    """``a, b, likeness``: all pairs of distinct ``keys(id, key)`` with a likeness of ``least`` or more, ``a < b``; the likeness is one less the edit distance over the longer length."""
    placed = stored(placed_grams(keys, least), "grams")
    return judged_titles(title_meetings(placed, placed, least).where("a < b").distinct(), keys, keys, least)


def judged_titles(met: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``a, b, likeness`` of the pairs ``met(a, b)`` of different keys that are ``least`` alike. Keys are as long as whole texts: they come to the pairs, not to the grams."""
    side = lambda keys, i, k: keys.select(F.col("id").alias(i), F.col("key").alias(k)).hint("merge")
    both = met.join(side(left, "a", "ka"), "a").join(side(right, "b", "kb"), "b").where("ka <> kb")
    found = both.withColumn("apart", apart_within("ka", "kb", least)).where("apart >= 0")
    return found.select("a", "b", (1 - F.col("apart") / F.greatest(F.length("ka"), F.length("kb"))).alias("likeness"))


def title_candidates(rows: DataFrame, least: float = ALIKE) -> DataFrame:
    """``target_id, article_id, likeness, verdict`` of different titles of ``rows(article_id, title, year, authors)`` that are ``least`` alike.

    Rows whose title keys are equal are one title, named by their least id. A pair is accepted if some of their rows are at most a year apart, or one has no year,
    and share an author, or one names none; else it is for review. Null titles have no partner.
    """
    own = rows.where("title IS NOT NULL").withColumn("key", title_key(F.col("title"))).groupBy("key").agg(
        F.min("article_id").alias("id"), F.collect_set("year").alias("years"), F.max(F.col("year").isNull()).alias("undated"), F.array_distinct(F.flatten(F.collect_set("authors"))).alias("authors"),
    )
    own = stored(own, "titles")
    side = lambda k: own.select(F.col("id").alias(k), F.col("years").alias(f"y{k}"), F.col("undated").alias(f"u{k}"), F.col("authors").alias(f"n{k}"))
    met = title_pairs(own.select("id", "key"), least).join(side("a"), "a").join(side("b"), "b")
    near = F.col("ua") | F.col("ub") | F.exists("ya", lambda x: F.exists("yb", lambda y: F.abs(x - y) <= 1))
    shared = (F.size("na") == 0) | (F.size("nb") == 0) | F.arrays_overlap("na", "nb")
    return met.select(F.col("a").alias("target_id"), F.col("b").alias("article_id"), F.round("likeness", 6).alias("likeness"), F.when(near & shared, "accepted").otherwise("review").alias("verdict"))


TITLES = f"k AS (SELECT {KEY} AS key, min(article_id) AS id, list_distinct(list(year)) AS years, list_distinct(list(source)) AS authors FROM articles WHERE title IS NOT NULL GROUP BY 1)"


@query("title_candidate_matches", f"WITH {ARTICLES}, {TITLES}, p AS (SELECT a.id AS target_id, b.id AS article_id, 1 - levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key)) AS likeness, a.years AS ya, b.years AS yb, list_has_any(a.authors, b.authors) AS shared FROM k a JOIN k b ON a.id < b.id AND least(length(a.key), length(b.key)) >= 0.96 * greatest(length(a.key), length(b.key)) - 1e-9) SELECT target_id, article_id, round(likeness, 6) AS likeness, CASE WHEN shared AND len(list_filter(ya, lambda x: len(list_filter(yb, lambda y: abs(x - y) <= 1)) > 0)) > 0 THEN 'accepted' ELSE 'review' END AS verdict FROM p WHERE likeness >= 0.96 - 1e-9")
def title_candidate_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles' titles; the source stands in for the authors."""
    return title_candidates(articles(spark, sf_dir).select("article_id", "title", "year", F.array_compact(F.array("source")).alias("authors")))


# --- gates by rules ------------------------------------------------------------------------------

# What domain and theme add by where they stand, and the bars of acceptance and review.
DOMAIN_TITLE, DOMAIN_ABSTRACT, THEME_TITLE, THEME_ABSTRACT, ACCEPT, REVIEW = 0.55, 0.25, 0.30, 0.15, 0.70, 0.45
#: Rules for the stored texts. Flags: name, where it is sought, pattern, penalty.
GATE = {"domain": r"\b(the|der|les?|el)\b", "context": "tion|ung|ment|cion", "theme": "an|en"}
FLAGS = [
    ("license", "abstract", "license|copyright", 0.40), ("dated", "year", "1900", 0.40), ("shouting", "title", "!!", 0.50), ("signs", "title", "[*#$%&]{2,}", 0.70),
    ("table", "title", "[|]", 0.50), ("address", "abstract", "@", 0.70), ("numbers", "title", "[0-9]{3,}", 0.70),
]


def relevance_gate(rows: DataFrame, gate: dict[str, str], flags: list[tuple[str, str, str, float]]) -> DataFrame:
    """``rows(title, abstract, year, ...)`` with ``score, status, flags`` by rules.

    A domain word counts if the record has technical context or the theme. Domain and theme add by where they stand; every flag takes its penalty and rejects, whatever the
    score, and so does a domain word without context. Else a score of ``ACCEPT`` with the domain in the title accepts, one of ``REVIEW`` with the domain anywhere is for review.
    """
    where = {"title": fold(F.coalesce("title", F.lit(""))), "abstract": fold(F.coalesce("abstract", F.lit("")))}
    rows = rows.withColumns({f"_{k}": x for k, x in where.items()})
    has = lambda c, k: F.col(f"_{c}").rlike(gate[k])
    context = has("title", "context") | has("abstract", "context") | has("title", "theme") | has("abstract", "theme")
    rows = rows.withColumn("_context", context).withColumn("_dt", has("title", "domain") & context).withColumn("_da", has("abstract", "domain") & context)
    bare = (has("title", "domain") | has("abstract", "domain")) & ~F.col("_context")
    found = [(name, F.coalesce(F.col("year") < int(pattern), F.lit(False)) if c == "year" else F.col(f"_{c}").rlike(pattern), penalty) for name, c, pattern, penalty in flags] + [("no_context", bare, 0.70)]
    rows = rows.withColumn("flags", F.array_compact(F.array(*[F.when(x, name) for name, x, _ in found])))
    raw = sum((F.when(x, w).otherwise(0.0) for x, w in ((F.col("_dt"), DOMAIN_TITLE), (F.col("_da"), DOMAIN_ABSTRACT), (has("title", "theme"), THEME_TITLE), (has("abstract", "theme"), THEME_ABSTRACT))), F.lit(0.0))
    raw = raw - sum((F.when(F.array_contains("flags", name), w).otherwise(0.0) for name, _, w in found), F.lit(0.0))
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 3))
    s = F.col("score")
    status = F.when(F.size("flags") > 0, "rejected").when((s >= ACCEPT) & F.col("_dt"), "accepted").when((s >= REVIEW) & (F.col("_dt") | F.col("_da")), "review").otherwise("rejected")
    return rows.withColumn("status", status).drop("_title", "_abstract", "_context", "_dt", "_da")


def gate_sql() -> str:
    flags = [(n, f"coalesce(year < {p}, false)" if c == "year" else f"regexp_matches({c[0]}, '{p}')", w) for n, c, p, w in FLAGS]
    has = lambda c, k: f"regexp_matches({c}, '{GATE[k]}')"
    bare = f"(({has('t', 'domain')} OR {has('a', 'domain')}) AND NOT context)"
    listed = "list_filter([" + ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x, _ in [*flags, ("no_context", bare, 0.7)]) + "], lambda x: x IS NOT NULL)"
    less = " - ".join(f"CASE WHEN {x} THEN {w} ELSE 0 END" for _, x, w in [*flags, ("", bare, 0.7)])
    return f"""WITH {ARTICLES}, f AS (SELECT article_id, year, {FOLD.format(x='title')} AS t, {FOLD.format(x="coalesce(split_part(body, chr(10), 2), '')")} AS a FROM articles),
 c AS (SELECT *, {has('t', 'context')} OR {has('a', 'context')} OR {has('t', 'theme')} OR {has('a', 'theme')} AS context FROM f), d AS (SELECT *, {has('t', 'domain')} AND context AS dt, {has('a', 'domain')} AND context AS da, {listed} AS flags FROM c),
 s AS (SELECT *, CAST(round(least(1, greatest(0, CASE WHEN dt THEN 0.55 ELSE 0 END + CASE WHEN da THEN 0.25 ELSE 0 END + CASE WHEN {has('t', 'theme')} THEN 0.30 ELSE 0 END + CASE WHEN {has('a', 'theme')} THEN 0.15 ELSE 0 END - {less})), 3) AS DOUBLE) AS score FROM d)
 SELECT article_id, score, array_to_string(flags, ',') AS flags, CASE WHEN len(flags) > 0 THEN 'rejected' WHEN score >= 0.7 AND dt THEN 'accepted' WHEN score >= 0.45 AND (dt OR da) THEN 'review' ELSE 'rejected' END AS status FROM s"""


@query("conservative_scope_rules", gate_sql())
def conservative_scope_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = articles(spark, sf_dir).select("article_id", "title", F.split_part("body", F.lit("\n"), F.lit(2)).alias("abstract"), "year")
    return relevance_gate(own, GATE, FLAGS).select("article_id", "score", F.array_join("flags", ",").alias("flags"), "status")


#: Ordered rules for the stored titles: verdict, what the title has, what it must not have, what the text has.
SCOPE = [
    ("rejected: noise", "[*#$%&!]{2,}", None, None), ("rejected: table", "[|]", None, None), ("rejected: homonym", "^(the|der) ", "tion|ung", None),
    ("accepted: direct", "tion|ung|ment", None, None), ("accepted: bridge", "er", None, "license"), ("accepted: material", "[aeiou]{2}", None, None),
]


def editorial_scope_of(title: Column, text: Column, rules: list[tuple[str, str, str | None, str | None]]) -> Column:
    """The verdict of the first rule that fits a folded title and text; an empty title and one that no rule fits are rejected."""
    t, b = fold(F.coalesce(title, F.lit(""))), fold(F.coalesce(text, F.lit("")))
    scope = F.lit("rejected: indirect")
    for verdict, has, lacks, said in reversed(rules):
        fits = t.rlike(has)
        fits = fits & ~t.rlike(lacks) if lacks else fits
        scope = F.when(fits & b.rlike(said) if said else fits, verdict).otherwise(scope)
    return F.when(F.trim(t) == "", "rejected: untitled").otherwise(scope)


SCOPE_SQL = " ".join(f"WHEN regexp_matches(t, '{h}')" + (f" AND NOT regexp_matches(t, '{n}')" if n else "") + (f" AND regexp_matches(b, '{b}')" if b else "") + f" THEN '{v}'" for v, h, n, b in SCOPE)


@query("editorial_scope", f"WITH {ARTICLES}, f AS (SELECT article_id, {FOLD.format(x='title')} AS t, {FOLD.format(x='body')} AS b FROM articles) SELECT article_id, CASE WHEN trim(t, ' ') = '' THEN 'rejected: untitled' {SCOPE_SQL} ELSE 'rejected: indirect' END AS scope FROM f")
def editorial_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("article_id", editorial_scope_of(F.col("title"), F.col("body"), SCOPE).alias("scope"))


# --- records of two providers --------------------------------------------------------------------

MERGED = ["title", "year", "doi", "journal"]


def merged_providers(primary: DataFrame, secondary: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """``key`` and ``MERGED`` of two providers' records, the primary's values first; records with different DOIs are an error, or with ``strict`` off left out."""
    other = secondary.select(key, *[F.col(c).alias(f"_{c}") for c in MERGED])
    both = primary.join(other, key, "left")
    clash = F.lower("doi") != F.lower("_doi")
    if strict:
        both = both.withColumn("doi", F.when(clash, F.raise_error(F.concat(F.lit("records with different DOIs: "), F.col(key).cast("string")))).otherwise(F.col("doi")))
    else:
        both = both.where(~F.coalesce(clash, F.lit(False)))
    return both.select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in MERGED])


def filled(target: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``target`` with only its missing fields taken from ``found``; ``n_filled`` counts them. What is there is never overwritten."""
    other = found.select(key, *[F.col(c).alias(f"_{c}") for c in MERGED])
    both = target.join(other, key, "left")
    n = sum((F.col(c).isNull() & F.col(f"_{c}").isNotNull()).cast("int") for c in MERGED)
    return both.select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in MERGED], n.cast("long").alias("n_filled"))


def providers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three views of the articles as records with gaps: the stored one and two providers'."""
    own = articles(spark, sf_dir).select("article_id", "title", "year", "doi", F.col("source").alias("journal"))
    gap = lambda c, n, at: F.when(F.col("article_id") % n != at, F.col(c)).alias(c)
    target = own.select("article_id", gap("title", 7, 1), gap("year", 2, 0), gap("doi", 4, 1), F.lit(None).cast("string").alias("journal"))
    first = own.select("article_id", "title", gap("year", 3, 0), gap("doi", 5, 2), gap("journal", 2, 1))
    return target, first, own.select("article_id", F.upper("title").alias("title"), "year", F.upper("doi").alias("doi"), "journal").where("article_id % 11 <> 0")


PROVIDERS = f"""WITH {ARTICLES}, t AS (SELECT article_id, CASE WHEN article_id % 7 <> 1 THEN title END AS title, CASE WHEN article_id % 2 <> 0 THEN year END AS year, CASE WHEN article_id % 4 <> 1 THEN doi END AS doi FROM articles),
 p AS (SELECT article_id, title, CASE WHEN article_id % 3 <> 0 THEN year END AS year, CASE WHEN article_id % 5 <> 2 THEN doi END AS doi, CASE WHEN article_id % 2 <> 1 THEN source END AS journal FROM articles), s AS (SELECT article_id, upper(title) AS title, year, upper(doi) AS doi, source AS journal FROM articles WHERE article_id % 11 <> 0),
 m AS (SELECT p.article_id, coalesce(p.title, s.title) AS title, coalesce(p.year, s.year) AS year, coalesce(p.doi, s.doi) AS doi, coalesce(p.journal, s.journal) AS journal FROM p LEFT JOIN s USING (article_id))"""


@query("metadata_enrichment", PROVIDERS + " SELECT t.article_id, coalesce(t.title, m.title) AS title, coalesce(t.year, m.year) AS year, coalesce(t.doi, m.doi) AS doi, m.journal, CAST(t.title IS NULL AND m.title IS NOT NULL AS BIGINT) + CAST(t.year IS NULL AND m.year IS NOT NULL AS BIGINT) + CAST(t.doi IS NULL AND m.doi IS NOT NULL AS BIGINT) + CAST(m.journal IS NOT NULL AS BIGINT) AS n_filled FROM t LEFT JOIN m USING (article_id)")
def metadata_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields of stored records from the merged records of two providers."""
    target, first, second = providers(spark, sf_dir)
    return filled(target, merged_providers(first, second, "article_id"), "article_id")


@query("cross_validated_matches", PROVIDERS + ", k AS (SELECT p.article_id, s.doi IS NOT NULL AND lower(p.doi) = lower(s.doi) AS same, 1 - levenshtein(lower(p.title), lower(s.title)) / greatest(1, length(p.title), length(s.title)) AS likeness, p.year IS NULL OR s.year IS NULL OR abs(p.year - s.year) <= 1 AS near FROM p LEFT JOIN s USING (article_id)) SELECT article_id, CASE WHEN same IS NULL OR NOT same THEN 'review: doi' WHEN likeness < 0.94 THEN 'review: title' WHEN NOT near THEN 'review: year' ELSE 'accepted' END AS verdict FROM k")
def cross_validated_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second provider confirms the first one's record: the same DOI, titles 0.94 alike, years at most one apart."""
    _, first, second = providers(spark, sf_dir)
    other = second.select("article_id", *[F.col(c).alias(f"_{c}") for c in MERGED])
    both = first.join(other, "article_id", "left")
    low, high = (F.replace(F.lower(c), F.lit("ß"), F.lit("ss")) for c in ("title", "_title"))  # in capitals a sharp s is two letters
    likeness = 1 - F.levenshtein(low, high) / F.greatest(F.lit(1), F.length(low), F.length(high))
    same = F.coalesce(F.lower("doi") == F.lower("_doi"), F.lit(False))
    near = F.col("year").isNull() | F.col("_year").isNull() | (F.abs(F.col("year") - F.col("_year")) <= 1)
    return both.select("article_id", F.when(~same, "review: doi").when(likeness < 0.94, "review: title").when(~near, "review: year").otherwise("accepted").alias("verdict"))


# --- bulk changes --------------------------------------------------------------------------------


@query("status_by_ids", f"WITH {ARTICLES} SELECT article_id, CASE WHEN article_id IN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) THEN 'indexed' ELSE status END AS status FROM articles")
def status_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of ids gets one status; however long the list is, it is joined, not spelled out."""
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("article_id")).distinct().withColumn("_new", F.lit("indexed"))
    return articles(spark, sf_dir).join(ids, "article_id", "left").select("article_id", F.coalesce("_new", "status").alias("status"))


@query("bulk_rejections", f"WITH {ARTICLES} SELECT article_id, CASE WHEN trim(split_part(body, chr(10), 2), ' ') = '' THEN 'rejected' WHEN doi IS NULL AND status IN ('validated', 'indexed') THEN 'awaiting_validation' ELSE status END AS status, CASE WHEN trim(split_part(body, chr(10), 2), ' ') = '' THEN 'no abstract' WHEN doi IS NULL AND status IN ('validated', 'indexed') THEN 'no doi' END AS reason FROM articles")
def bulk_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without an abstract are rejected; accepted ones without a DOI go back for review."""
    bare = F.trim(F.split_part("body", F.lit("\n"), F.lit(2))) == ""
    demoted = F.col("doi").isNull() & F.col("status").isin("validated", "indexed")
    return articles(spark, sf_dir).select("article_id", F.when(bare, "rejected").when(demoted, "awaiting_validation").otherwise(F.col("status")).alias("status"), F.when(bare, "no abstract").when(demoted, "no doi").alias("reason"))


@query("text_normalisation", "WITH n AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(replace(html, '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS clean FROM pages) SELECT page_id, sha256(clean) AS content_hash, CASE WHEN clean <> html THEN 'pending' ELSE 'indexed' END AS status FROM n")
def text_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts cleaned of markup; those that change are queued again."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.replace("html", F.lit("&amp;"), F.lit("&")), "<[^>]+>", " "), r"\s+", " "))
    rows = table(spark, sf_dir, "pages").select("page_id", "html", clean.alias("clean"))
    return rows.select("page_id", F.sha2("clean", 256).alias("content_hash"), F.when(F.col("clean") != F.col("html"), "pending").otherwise("indexed").alias("status"))


@query("latest_feedback", "SELECT user_id, event_type, arg_max(value > 50, (ts, event_id)) AS favourite, count(*) AS changes FROM events GROUP BY 1, 2")
def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all settings of one mark, the last one holds."""
    last = F.max_by(F.col("value") > 50, F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last.alias("favourite"), F.count(F.lit(1)).alias("changes"))


@query("restored_evidence", f"WITH {CHUNKS}, e AS (SELECT chunk_id AS old_id, article_id, text[11:60] AS excerpt FROM chunks WHERE length(text) >= 60 AND chunk_id % 3 = 0), n AS (SELECT c.chunk_id + 1000000000 AS chunk_id, c.article_id, CASE WHEN chunk_id % 7 = 0 THEN upper(text) ELSE text END AS text FROM chunks c) SELECT e.old_id, min(n.chunk_id) AS chunk_id FROM e LEFT JOIN n ON n.article_id = e.article_id AND contains(n.text, e.excerpt) GROUP BY e.old_id")
def restored_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of replaced chunks attached to the new chunks of their article that hold them word for word; null where none does."""
    own = chunks(spark, sf_dir).select("chunk_id", "article_id", "text")
    old = own.where((F.length("text") >= 60) & (F.col("chunk_id") % 3 == 0)).select(F.col("chunk_id").alias("old_id"), "article_id", F.substring("text", 11, 50).alias("excerpt"))
    new = own.select((F.col("chunk_id") + 1000000000).alias("chunk_id"), "article_id", F.when(F.col("chunk_id") % 7 == 0, F.upper("text")).otherwise(F.col("text")).alias("text"))
    met = old.join(new, "article_id").where(F.contains("text", F.col("excerpt"))).groupBy("old_id").agg(F.min("chunk_id").alias("chunk_id"))
    return old.select("old_id").join(met, "old_id", "left")
