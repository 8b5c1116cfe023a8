"""A written term index: blocks of postings, document frequencies and grams of terms, read by many queries.

Postings of a term lie in blocks of BLOCK_IDS consecutive ids, each with the largest frequency in
it, in a table bucketed by term. Blocks of all terms have the same bounds, so the largest values of
a query's terms in a block add up to a bound for every document there. A query scores the few
blocks of the highest bounds first; the k-th score found leaves out all blocks that cannot reach it.

Documents are ranked by three channels in lexicographic order, never by a weighted sum: codes that
they contain, full text, and similar terms. Full text counts plain terms or stems, whichever gives
more. Similar terms (word similarity of a query's word and a term) come from the gram table: of a
word's grams, in order of rarity, only so many are looked up that a similar term must have one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import word_similarity
from ..sources.written import bucketed, written
from .ranking import best_per_query
from .retrieval import TRIGRAM_LEAST, small

#: Ids of a block.
BLOCK_IDS = 64
#: Blocks of a query that are scored before any is left out.
FIRST_BLOCKS = 8
#: Buckets of the written tables.
BUCKETS = 16
CHANNELS = ("exact", "simple", "stem", "trigram")

#: Endings that a stem loses (fixed values of this engine; three letters stay at least).
ENDINGS = (
    "ations ation ings ing edly ed ness ments ment ies es s ly "
    "иями ями ами иях ях ах иям ям ам ием ем ом ией ей ой ий ый ая яя ое ее ие ые ого его ому ему ыми ими ых их ую юю ью ия ья ов ев ть ти ла ло ли ла ет ют ит ят ут ат а я о е ы и ь у ю й"
).split()
STEM = rf"^(.{{3,}}?)(?:{'|'.join(dict.fromkeys(ENDINGS))})$"


def stem(term: Column) -> Column:
    """The term without the longest of the known endings."""
    return F.regexp_replace(term, STEM, "$1")


def grams(text: Column) -> Column:
    """Distinct 3-grams of each word of a text, with two spaces before the word and one behind."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def gram_table(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """gram, text, size (grams of the text) and df (texts that have the gram), bucketed by gram, of distinct texts (column text)."""
    own = texts.select("text", grams(F.col("text")).alias("own"))
    flat = own.select("text", F.size("own").alias("size"), F.explode("own").alias("gram"))
    common = flat.groupBy("gram").agg(F.count("*").alias("df"))
    return bucketed(flat.join(common, "gram"), "grams", "gram", buckets, ["text"])


def _with_df(table: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (with column gram) and df, how many texts of a gram table have it."""
    known = table.join(small(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.first("df").alias("df"))
    return asked.join(small(known), "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def candidates(table: DataFrame, queries: DataFrame, least: float = TRIGRAM_LEAST) -> DataFrame:
    """(query, text) pairs of a gram table that share one of the rare grams that a similar text must have.

    A text of a word similarity of `least` has so large a share of the query's grams, so it has one
    of the first ones when, in order of rarity, all but that many are taken and one more. A text
    with fewer grams than those is left out.
    """
    asked = queries.select("query").distinct().withColumn("own", grams(F.col("query"))).withColumn("needed", F.ceil(F.size("own") * least).cast("int"))
    flat = asked.select("query", "needed", F.size("own").alias("n"), F.explode("own").alias("gram"))
    order = Window.partitionBy("query").orderBy("df", "gram")
    keys = _with_df(table, flat).withColumn("place", F.row_number().over(order)).where((F.col("place") <= F.col("n") - F.col("needed") + 1) & (F.col("df") > 0))
    met = table.select("gram", "text", "size").join(small(keys.select("query", "needed", "gram")), "gram")
    return met.where("size >= needed").select("query", "text").distinct()


def similar_texts(table: DataFrame, queries: DataFrame, least: float = TRIGRAM_LEAST) -> DataFrame:
    """(query, text, similarity): texts of a gram table with a word similarity of at least `least`."""
    scored = candidates(table, queries, least).withColumn("similarity", word_similarity(F.col("query"), F.col("text")))
    return scored.where(F.col("similarity") >= least)


def containing_texts(table: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, text): texts of a gram table that contain a code, of three letters at least, found by its rarest gram."""
    inner = F.transform(F.sequence(F.lit(1), F.length("code") - 2), lambda i: F.substring(F.col("code"), i, F.lit(3)))
    flat = codes.select("code").distinct().where(F.length("code") >= 3).select("code", F.explode(inner).alias("gram"))
    rarest = _with_df(table, flat).groupBy("code").agg(F.min(F.struct("df", "gram")).alias("r")).select("code", F.col("r.gram").alias("gram"))
    return table.select("gram", "text").join(small(rarest), "gram").where(F.contains("text", "code")).select("code", "text")


@dataclass(frozen=True)
class TermIndex:
    """blocks: kind, term, block, n, top_tf, ids, tfs; terms: kind, term, df; grams: the gram table of plain terms."""

    blocks: DataFrame
    terms: DataFrame
    grams: DataFrame
    n_docs: int

    def postings(self, terms: DataFrame) -> DataFrame:
        """term, doc_id and tf of plain terms (column term)."""
        asked = small(terms.select("term").distinct())
        rows = self.blocks.where("kind = 'simple'").join(asked, "term", "left_semi")
        return _exploded(rows.select("term", "ids", "tfs")).select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


def _exploded(rows: DataFrame) -> DataFrame:
    """A row for each posting of blocks."""
    rest = [c for c in rows.columns if c not in ("ids", "tfs")]
    return rows.select(*rest, F.explode(F.arrays_zip("ids", "tfs")).alias("p")).select(*rest, F.col("p.ids").alias("doc_id"), F.col("p.tfs").alias("tf"))


def build(docs: DataFrame, doc_id: str, text: str, buckets: int = BUCKETS) -> TermIndex:
    """Indexes all texts; rows without an id are left out, and texts under one id count as one.

    Nothing meets by term alone: a term's postings are gathered by block, and its frequency is
    the sum over its blocks, so a word of every text is no hot key.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    words = rows.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    simple = words.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"))
    stems = simple.groupBy("doc_id", stem(F.col("term")).alias("term")).agg(F.sum("tf").cast("int").alias("tf"))
    both = simple.withColumn("kind", F.lit("simple")).unionByName(stems.withColumn("kind", F.lit("stem")))
    gathered = both.groupBy("kind", "term", F.floor(F.col("doc_id") / BLOCK_IDS).alias("block")).agg(
        F.count("*").cast("int").alias("n"), F.max("tf").alias("top_tf"), F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("p")
    )
    blocks = bucketed(gathered.select("kind", "term", "block", "n", "top_tf", F.col("p.doc_id").alias("ids"), F.col("p.tf").alias("tfs")), "term_blocks", "term", buckets, ["kind", "block"])
    terms = bucketed(blocks.groupBy("kind", "term").agg(F.sum("n").alias("df")), "terms", "term", buckets, ["kind"])
    found = gram_table(terms.where("kind = 'simple'").select(F.col("term").alias("text")), buckets)
    return TermIndex(blocks, terms, found, rows.select("doc_id").distinct().count())


def expanded(index: TermIndex, queries: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(query_id, channel, slot, kind, term, value): what each query (query_id, words, codes) asks of the index.

    value: a term's weight (simple, stem), its similarity (trigram) or 1 (exact); of the terms of
    one slot a document counts by the best.
    """
    weight = F.round(100 * F.log(1 + F.lit(index.n_docs) / F.col("df"))).cast("long")
    words = queries.select("query_id", F.explode(F.array_distinct("words")).alias("slot"))
    stems = words.select("query_id", stem(F.col("slot")).alias("slot")).distinct()
    parts = []
    for channel, asked in (("simple", words), ("stem", stems)):
        found = index.terms.where(F.col("kind") == channel).join(small(asked.select(F.col("slot").alias("term"), "query_id")), "term")
        parts.append(found.select("query_id", F.lit(channel).alias("channel"), F.col("term").alias("slot"), "kind", "term", weight.alias("value")))
    similar = words.join(similar_texts(index.grams, words.select(F.col("slot").alias("query"))), F.col("slot") == F.col("query"))
    milli = F.floor(1000 * F.col("similarity"))
    parts.append(similar.select("query_id", F.lit("trigram").alias("channel"), "slot", F.lit("simple").alias("kind"), F.col("text").alias("term"), milli.alias("value")))
    codes = queries.select("query_id", F.explode(F.array_distinct("codes")).alias("slot"))
    held = codes.join(containing_texts(index.grams, codes.select(F.col("slot").alias("code"))), F.col("slot") == F.col("code"))
    parts.append(held.select("query_id", F.lit("exact").alias("channel"), "slot", F.lit("simple").alias("kind"), F.col("text").alias("term"), F.lit(1).cast("long").alias("value")))
    picked = [p for p, c in zip(parts, ("simple", "stem", "trigram", "exact"), strict=True) if c in channels]
    out = picked[0]
    for more in picked[1:]:
        out = out.unionByName(more)
    return out


def _impact(tf: Column) -> Column:
    """What a term with a frequency adds; it grows with the frequency, so a block's largest one bounds it."""
    full_text = F.floor(F.col("value") * tf / (tf + 1))
    return F.when(F.col("channel").isin("simple", "stem"), full_text).otherwise(F.col("value"))


def _scores(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, exact, fts and trigram from (keys, channel, slot, impact): the best of each slot, added up."""
    best = rows.groupBy(*keys, "channel", "slot").agg(F.max("impact").alias("impact"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("impact"))), F.lit(0)).cast("long")
    return best.groupBy(*keys).agg(of("exact").alias("exact"), F.greatest(of("simple"), of("stem")).alias("fts"), of("trigram").alias("trigram"))


ORDER = ["exact", "fts", "trigram"]


def _bounded(index: TermIndex, asked: DataFrame) -> DataFrame:
    """query_id, block and the bounds of every block that holds a term of a query; no posting is read."""
    heads = index.blocks.select("kind", "term", "block", "top_tf").join(small(asked), ["kind", "term"])
    return _scores(heads.withColumn("impact", _impact(F.col("top_tf"))), ["query_id", "block"])


def _scored(index: TermIndex, asked: DataFrame, chosen: DataFrame) -> DataFrame:
    """Scores of the documents in the chosen (query_id, block)."""
    wanted = asked.join(small(chosen), "query_id")
    rows = _exploded(index.blocks.select("kind", "term", "block", "ids", "tfs").join(small(wanted), ["kind", "term", "block"]))
    return _scores(rows.withColumn("impact", _impact(F.col("tf"))), ["query_id", "doc_id"])


def _pruned(index: TermIndex, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Scores of all documents that may be among the first k of a query, ties of the last included; and the blocks read."""
    bounds = written(_bounded(index, asked), "bounds")
    by_bound = [F.desc(c) for c in ORDER]
    first = best_per_query(bounds, "query_id", [*by_bound, F.col("block")], FIRST_BLOCKS).select("query_id", "block")
    early = written(_scored(index, asked, first), "early")
    kth = best_per_query(early, "query_id", [*by_bound, F.col("doc_id")], k).where(F.col("rank") == k).select("query_id", F.struct(*ORDER).alias("kth"))
    open_ = bounds.join(first, ["query_id", "block"], "left_anti").join(small(kth), "query_id", "left")
    later = written(open_.where("kth is null or struct(exact, fts, trigram) >= kth").select("query_id", "block"), "later")
    return early.unionByName(_scored(index, asked, later)), first.unionByName(later)


def lexical_topk(index: TermIndex, queries: DataFrame, k: int, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """(query_id, doc_id, exact, fts, trigram, rank): the first k documents of each query, exactly.

    queries: query_id, words and codes (arrays of lower-case terms). Rank is by codes contained,
    then full text, then similar terms (thousandths, added over the query's words), then id.
    Similar terms have by far the most postings and decide ties only, so they are read for the
    documents that the other channels leave, and for all only where those find fewer than k.
    """
    return _search(index, queries, k, channels)[0]


def postings_read(index: TermIndex, queries: DataFrame, k: int) -> tuple[int, int]:
    """How many postings a search reads, and how many its terms have."""
    reads = _search(index, queries, k, CHANNELS)[1]
    every = expanded(index, queries).select("query_id", "kind", "term").distinct()
    sizes = index.blocks.select("kind", "term", "block", "n").join(every, ["kind", "term"])
    read = reads.distinct().withColumn("read", F.lit(True))
    found = sizes.join(read, ["query_id", "kind", "term", "block"], "left")
    row = found.agg(F.coalesce(F.sum(F.when(F.col("read"), F.col("n"))), F.lit(0)).alias("read"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    return row["read"], row["all"]


def _search(index: TermIndex, queries: DataFrame, k: int, channels: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The ranked rows, and the (query_id, kind, term, block) that were read for them."""
    order = [*[F.desc(c) for c in ORDER], F.col("doc_id")]
    columns = ["query_id", "doc_id", *ORDER]
    exact_or_text = tuple(c for c in channels if c != "trigram")
    read = lambda asked, blocks: asked.join(blocks, "query_id").select("query_id", "kind", "term", "block")
    if exact_or_text:
        asked = written(expanded(index, queries, exact_or_text), "asked")
        scored, blocks = _pruned(index, asked, k)
        reads = read(asked, blocks)
        if "trigram" not in channels:
            return best_per_query(scored, "query_id", order, k).select(*columns, "rank"), reads
        tied = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("fts")))
        left = written(scored.withColumn("place", tied).where(F.col("place") <= k).drop("place", "trigram"), "left")
        enough = left.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    similar = written(expanded(index, queries, ("trigram",)), "similar")
    if not exact_or_text:
        scored, blocks = _pruned(index, similar, k)
        return best_per_query(scored, "query_id", order, k).select(*columns, "rank"), read(similar, blocks)
    # few found: all channels at once
    some, more = _pruned(index, asked.unionByName(similar).join(enough, "query_id", "left_anti"), k)
    # enough found: their similar terms only
    own = similar.join(enough, "query_id", "left_semi")
    places = left.select("query_id", F.floor(F.col("doc_id") / BLOCK_IDS).alias("block")).distinct()
    extra = _scored(index, own, places).select("query_id", "doc_id", "trigram")
    rest = left.join(enough, "query_id", "left_semi").join(extra, ["query_id", "doc_id"], "left").withColumn("trigram", F.coalesce("trigram", F.lit(0).cast("long")))
    top = best_per_query(some.select(*columns).unionByName(rest.select(*columns)), "query_id", order, k)
    return top.select(*columns, "rank"), reads.union(read(asked.unionByName(similar), more)).union(read(own, places))
