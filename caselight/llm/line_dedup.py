"""Line dedup: later copies of repeated line runs are deleted.

Method: a suffix array over the documents' sequences of line ids, by distributed prefix
doubling, run to its end. A round orders the suffixes that still share a prefix by the ranks of
their two halves; those whose prefix is unique leave with their place in the array. A line that
occurs once, and the end of a document, are symbols of their own, smaller than all others.

Neighbours in the array give the longest common prefixes. Where the lines before two neighbours
are equal too, the prefix is that of the suffix one line earlier less one; only for the others
it is worked out, from the ranks that both had in the rounds. Intervals of prefixes of
LEAST_LINES lines and more are the runs that occur again, and their longest prefixes the maximal
runs. The first occurrence (by doc_id, then line) stays. Where a number of words is given, a run
of fewer lines counts too if it has so many words, by the intervals of smaller prefixes. Only
DataFrame functions are used.

Defined cases: a null text is empty, with one empty line; a text shorter than the run stays;
rows that repeat doc_id and text are one document; rows that repeat a doc_id alone are ordered
by a hash of the text; a null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, written

#: Fewest consecutive lines that count as a repeated run.
LEAST_LINES = 3
#: Fewest words of a run that counts with fewer lines, where long passages are to go as well.
LEAST_WORDS = 50
NO_ID = -(1 << 63)
SUFFIX = ("doc", "mark", "n")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, mark and text: a document is its id and a hash of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def line_ids(keyed: DataFrame) -> DataFrame:
    """doc, mark, n (from 0), id (the line's hash) and before (that of the line before it); repeated rows once."""
    hashed = keyed.select("doc", "mark", F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("ids"))
    once = hashed.groupBy("doc", "mark").agg(F.first("ids").alias("ids"))
    pairs = F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.when(i > 0, F.get("ids", i - 1)).alias("before")))
    return once.select("doc", "mark", F.posexplode(pairs).alias("n", "line")).select("doc", "mark", "n", "line.id", "line.before")


def _in_order(rows: DataFrame, *order: str) -> tuple[DataFrame, Column, Column]:
    """Rows in this order over all partitions, written so; each row's partition, and its place in it."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return written(sorted_), F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)


def _by_part(rows: DataFrame, part: Column, *before: Column) -> DataFrame:
    """part, and sums over all parts before it: one row for each partition, as few as those are."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(part.alias("part")).agg(*[c.alias(f"sum{i}") for i, c in enumerate(before)])
    return totals.select("part", *[F.coalesce(F.sum(f"sum{i}").over(earlier), F.lit(0)).alias(f"base{i}") for i in range(len(before))])


def _ranked(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds place, where a row stands in the order of keys and suffixes; first and start, where the
    rows of its keys and of its first key begin; and shared, whether another row has its keys.

    Rows are compared with their neighbours inside each partition. A row for each partition, its
    ends, tells what goes on from one partition to the next, however many one key fills.
    """
    sorted_, part, index = _in_order(rows, *keys, *SUFFIX)
    inside = Window.partitionBy("part").orderBy("index")
    key, lead = F.struct(*keys), F.col(keys[0])
    local = sorted_.withColumn("part", part).withColumn("index", index).drop("at")
    local = local.withColumn("prior", F.lag(key).over(inside)).withColumn("following", F.lead(key).over(inside))
    begins = lambda now, before: F.max(F.when(before.isNull() | (now != before), F.col("index"))).over(inside)
    local = local.withColumn("first", begins(key, F.col("prior"))).withColumn("start", begins(lead, F.col(f"prior.{keys[0]}")))
    ends = local.groupBy("part").agg(F.count("*").alias("n_rows"), F.min_by(key, "index").alias("head"), F.max_by(key, "index").alias("tail"), F.max("first").alias("first"), F.max("start").alias("start"))
    parts = Window.orderBy("part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("base", F.coalesce(F.sum("n_rows").over(before), F.lit(0))).withColumn("last_tail", F.lag("tail").over(parts)).withColumn("next_head", F.lead("head").over(parts))
    ends = ends.withColumn("goes_on", F.coalesce(F.col("head") == F.col("last_tail"), F.lit(False)))
    ends = ends.withColumn("lead_goes_on", F.coalesce(F.col(f"head.{keys[0]}") == F.col(f"last_tail.{keys[0]}"), F.lit(False)))
    for name, flag in (("first", "goes_on"), ("start", "lead_goes_on")):
        own = F.when((F.col(name) > 0) | ~F.col(flag), F.col("base") + F.col(name))
        ends = ends.withColumn(f"{name}_before", F.last(own, ignorenulls=True).over(before))
    ends = ends.select("part", "base", "last_tail", "next_head", "goes_on", "lead_goes_on", "first_before", "start_before")
    met = local.join(F.broadcast(ends), "part")
    at = lambda name, flag: F.when((F.col(name) == 0) & F.col(flag), F.col(f"{name}_before")).otherwise(F.col("base") + F.col(name))
    same = [F.coalesce(key == c, F.lit(False)) for c in (F.coalesce("prior", "last_tail"), F.coalesce("following", "next_head"))]
    return met.select(*rows.columns, (F.col("base") + F.col("index")).alias("place"), at("first", "goes_on").alias("first"), at("start", "lead_goes_on").alias("start"), (same[0] | same[1]).alias("shared"))


def suffix_array(lines: DataFrame) -> DataFrame:
    """doc, mark, n, before, ranks and place of every suffix whose first line occurs again.

    place orders the suffixes. ranks[k] is the place of the first suffix with the same 2^k lines,
    for as many rounds as the suffix shared those with another.
    """
    first = _ranked(lines, ("id",)).where("shared")
    state = written(first.select(*SUFFIX, "before", F.array("first").alias("ranks"), F.col("first").alias("place"), F.lit(True).alias("open")))
    by = 1
    while not state.where("open").isEmpty():
        # the suffix `by` lines on; none: the text ends there, or a line that occurs once stands there
        ahead = F.first("place").over(Window.partitionBy("doc", "mark").orderBy("n").rangeBetween(by, by))
        halves = state.withColumn("next", F.coalesce(ahead, F.lit(-1))).where("open").drop("open").withColumnRenamed("place", "rank")
        stays = (F.col("next") >= 0) & F.col("shared")
        # places count the open suffixes alone; from its start on, a group keeps its own places
        at = F.col("rank") - F.col("start") + F.when(stays, F.col("first")).otherwise(F.col("place"))
        ranks = F.when(stays, F.concat("ranks", F.array(at))).otherwise(F.col("ranks"))
        now = _ranked(halves, ("rank", "next")).select(*SUFFIX, "before", ranks.alias("ranks"), at.alias("place"), stays.alias("open"))
        state = written(state.where("not open").union(now))
        by *= 2
    return state.drop("open")


def _equal_rounds(a: Column, b: Column) -> Column:
    """In how many rounds, from the first on, two suffixes had equal ranks."""
    same = F.zip_with(F.coalesce(a, F.array().cast("array<long>")), F.coalesce(b, F.array().cast("array<long>")), lambda x, y: x == y)
    return F.size(F.filter(same, lambda s: F.coalesce(s, F.lit(False))))


def _extended(pairs: DataFrame, array: DataFrame) -> DataFrame:
    """doc, mark, n and lcp, the lines that the suffix shares with its neighbour (other: doc, mark, n).

    rounds: in how many rounds their ranks were equal. The prefix grows by the largest power of
    two that the suffixes behind it still share, as long as there is one.
    """
    grown = F.expr("if(rounds > 0, shiftleft(1, rounds - 1), 0)")
    now, done = pairs.withColumn("lcp", grown), None
    while True:
        now = written(now, "line-prefixes")
        closed = now.where("rounds <= 1").select(*SUFFIX, "lcp")
        done = closed if done is None else done.union(closed)
        now = now.where("rounds > 1")
        if now.isEmpty():
            return done
        for k, (doc, mark, n) in enumerate((("doc", "mark", "n"), ("other.doc", "other.mark", "other.n"))):
            behind = array.select(F.col("doc").alias("d"), F.col("mark").alias("m"), F.col("n").alias("i"), F.col("ranks").alias(f"ranks{k}"))
            now = now.join(behind, (F.col(doc) == F.col("d")) & (F.col(mark) == F.col("m")) & (F.col(n) + F.col("lcp") == F.col("i")), "left").drop("d", "m", "i")
        less = F.least(_equal_rounds(F.col("ranks0"), F.col("ranks1")), F.col("rounds") - 1)
        now = now.withColumn("rounds", less).drop("ranks0", "ranks1").withColumn("lcp", F.col("lcp") + grown)


def common_prefixes(lines: DataFrame) -> DataFrame:
    """doc, mark, n, part, at, lcp and ahead of the suffix array's rows.

    lcp: lines shared with the suffix before; ahead: those shared with the one behind. at orders
    the rows, over all partitions; part is the partition's number.
    """
    array = suffix_array(lines)
    sorted_, part, _ = _in_order(array, "place")
    sorted_ = sorted_.withColumn("part", part)
    mine, parts = Window.partitionBy("part").orderBy("at"), Window.orderBy("part")
    suffix = F.struct(*SUFFIX, "before", "ranks")
    ends = sorted_.groupBy("part").agg(F.max_by(suffix, "at").alias("end")).select("part", F.lag("end").over(parts).alias("end"))  # a row for each partition
    near = sorted_.join(F.broadcast(ends), "part").withColumn("other", F.coalesce(F.lag(suffix).over(mine), F.col("end")))
    rounds = _equal_rounds(F.col("ranks"), F.col("other.ranks"))
    # where the lines before are equal too, the prefix is that of the suffix one line earlier less one
    derived = F.coalesce(F.col("before") == F.col("other.before"), F.lit(False)) & (F.col("rounds") > 1)
    near = written(near.withColumn("rounds", rounds).select(*SUFFIX, "part", "at", "rounds", F.struct("other.doc", "other.mark", "other.n").alias("other"), derived.alias("derived")))
    found = near.where("not derived and rounds > 1").select(*SUFFIX, "rounds", "other")
    grown = near.drop("other").join(_extended(found, array), list(SUFFIX), "left")
    direct = F.when(F.col("rounds") < 2, F.col("rounds")).otherwise(F.col("lcp"))
    reach = F.last(F.when(~F.col("derived"), F.col("n") + direct), ignorenulls=True).over(Window.partitionBy("doc", "mark").orderBy("n"))
    known = written(grown.withColumn("lcp", (reach - F.col("n")).cast("int")).select(*SUFFIX, "part", "at", "lcp"))
    heads = known.groupBy("part").agg(F.min_by("lcp", "at").alias("head")).select("part", F.lead("head").over(parts).alias("head"))  # a row for each partition
    ahead = F.coalesce(F.lead("lcp").over(mine), F.col("head"), F.lit(0))
    return written(known.join(F.broadcast(heads), "part").withColumn("ahead", ahead).drop("head"))


def later_copies(prefixes: DataFrame, least: int) -> DataFrame:
    """doc, mark, n, stop and longest of the runs of `least` lines that occurred before.

    A run that occurs again is an interval of the array in which all prefixes are so long; its
    first suffix by document and line stays. longest: the lines of the maximal run from n on.
    """
    opens = F.when(F.col("lcp") < least, 1).otherwise(0)
    upto = F.sum(opens).over(Window.partitionBy("part").orderBy("at"))
    numbered = prefixes.join(F.broadcast(_by_part(prefixes, F.col("part"), F.sum(opens))), "part").withColumn("interval", F.col("base0") + upto)
    runs = numbered.where((F.col("lcp") >= least) | (F.col("ahead") >= least))
    first = written(runs.groupBy("interval").agg(F.min(F.struct(*SUFFIX)).alias("first")))
    later = runs.join(first, "interval").where(F.struct(*SUFFIX) != F.col("first"))
    return later.select(*SUFFIX, (F.col("n") + least).alias("stop"), F.greatest("lcp", "ahead").alias("longest"))


def long_windows(docs_keyed: DataFrame, depth: int, words: int) -> DataFrame:
    """doc, mark and n, where a window of `depth` lines begins that has so many words; repeated rows once."""
    # a text of fewer characters cannot hold them
    counted = docs_keyed.where(F.length("text") >= 2 * words - 1).select("doc", "mark", F.transform(F.split("text", "\n"), lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"))
    held = lambda i: F.aggregate(F.slice("words", i + 1, depth), F.lit(0), lambda a, b: a + b)
    return counted.select("doc", "mark", F.explode(F.array_compact(F.transform("words", lambda _, i: F.when(held(i) >= words, i)))).alias("n")).distinct()


def spans_to_delete(docs_keyed: DataFrame, least: int = LEAST_LINES, words: int | None = None) -> DataFrame:
    """doc, mark and spans (start and stop in lines, and longest) of later copies, disjoint and in order.

    words: the number from which a run counts with fewer lines than `least`; none: never.
    longest: the lines of the longest maximal run that begins in the span.
    """
    prefixes = common_prefixes(line_ids(docs_keyed))
    # each is written, so the driver never plans all of them at once
    found = [written(later_copies(prefixes, least))]
    for depth in range(1, least if words is not None else 1):
        found.append(written(later_copies(prefixes, depth).join(long_windows(docs_keyed, depth, words), list(SUFFIX), "left_semi")))
    later = functools.reduce(DataFrame.union, found)
    w = Window.partitionBy("doc", "mark").orderBy("n", "stop")
    reached = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("n") > reached, 1).otherwise(0)
    united = later.withColumn("apart", apart).withColumn("span", F.sum("apart").over(w)).groupBy("doc", "mark", "span")
    spans = united.agg(F.min("n").alias("start"), F.max("stop").alias("stop"), F.max("longest").alias("longest"))
    return spans.groupBy("doc", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "longest"))).alias("spans"))


def _kept_lines(lines: Column, spans: Column) -> Column:
    """The lines outside the spans, piece by piece."""
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["stop"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(lines)))
    pieces = F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.flatten(pieces)


def delete_repeated_lines(docs: DataFrame, least: int = LEAST_LINES, words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_deleted, spans (null: none) and the text that stays, for each row."""
    spans = spans_to_delete(_keyed(docs), least, words)
    lines = F.split("text", "\n")
    both = _keyed(docs).join(spans, ["doc", "mark"], "left").withColumn("lines", lines)
    gone = F.aggregate(F.coalesce("spans", F.array()), F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(_kept_lines(F.col("lines"), F.col("spans")), "\n"))
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return both.select(doc_id, F.size("lines").cast("long").alias("n_lines"), gone.cast("long").alias("n_deleted"), "spans", text.alias("text"))


def without_repeated_lines(docs: DataFrame, least: int = LEAST_LINES, words: int | None = LEAST_WORDS) -> DataFrame:
    """The documents with all their columns; only text changes."""
    doc, mark, own = (free_name(docs, n) for n in ("_doc", "_mark", "_spans"))
    spans = spans_to_delete(_keyed(docs), least, words).select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("spans").alias(own))
    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col(doc)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(mark))
    both = docs.join(spans, key, "left")
    changed = F.array_join(_kept_lines(F.split("text", "\n"), F.col(own)), "\n")
    return both.withColumn("text", F.when(F.col(own).isNull(), F.col("text")).otherwise(changed)).drop(doc, mark, own)


#: The same in SQL, for tables without repeated doc_ids.
ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), runs AS (
  SELECT doc_id, n, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), later AS (
  SELECT doc_id, n FROM (
    SELECT doc_id, n, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, n) AS occurrence
    FROM runs WHERE line3 IS NOT NULL
  ) WHERE occurrence > 1
), gone AS (
  SELECT DISTINCT doc_id, n + k AS n FROM later, (VALUES (0), (1), (2)) AS steps(k)
)
SELECT l.doc_id, count(*) AS n_lines, count(g.n) AS n_deleted,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE g.n IS NULL), '') AS text
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.n = l.n
GROUP BY l.doc_id
"""
