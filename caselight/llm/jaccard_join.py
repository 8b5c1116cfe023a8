"""N-gram Jaccard join: subsets of small sets, inverted lists for large ones, with the boundary chosen by cost.

A text is the set of its distinct shingles, each a 64-bit hash; equal sets are one. Shingles have
one order for the whole corpus, from rare to common by a count table of bounded width. In it, two
linked sets share at least c of their first n - ceil(0.85 n) + c shingles, for any c. Sets below
the boundary meet in a bucket for each pair (SUBSET = 2) of those, which few others share; sets
above it meet in the lists of single shingles (c = 1), together with the small ones that are long
enough to be linked to a large one. For every class of sizes, the pairs of shingles that small sets
would list are weighed against the entries that their lists hold, and the boundary is where the
sum is least.

Members of a bucket are compared in two rounds, each followed by the components of all links found.
The first takes neighbours by size, and all pairs of a bucket of few; the second, for the other
buckets, every pair of different components that shares a shingle of its lists. So no link between
components is lost, while the copies of one group are not paired with each other all over. A pair goes on only if its sizes and a parity map of the sets (where two maps differ, so do
the sets) allow a link, and is then verified by the whole sets.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with
nothing; a text of fewer words than a shingle has one, its whole sequence; repeated rows and texts
of one set share a component; a null doc_id is never the smallest, and a group of null ids alone
has none; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import bucketed
from .common import doc_texts, keep_lineage_short, written
from .components import component_roots

SHINGLE_WORDS = 4
#: Sets link if a hundred times their intersection is at least so many times their union.
PERCENT = 85
#: Shingles of a subset that small sets are listed by.
SUBSET = 2
#: Letters to a cell of the count table, and its least and greatest width: it is broadcast, two bytes a cell.
CELL_LETTERS, LEAST_CELLS, MOST_CELLS = 50, 1 << 16, 1 << 24
#: Slices that count tables are added up in.
SLICES = 64
#: The members of larger buckets are ordered in parts of about so many, and the parts linked by their first members.
PART_MEMBERS = 10_000
#: Letters of texts that are hashed together.
BATCH_LETTERS = 6_000_000
#: Buckets of so many members are compared all with all at once.
FEW_MEMBERS = 8
#: Pairs of sets with lists of up to so many shingles are made once, those with longer ones are made distinct.
SHORT_LIST = 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ x >> np.uint64(32)


def shingle_sets(texts: list[str], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ASCII letters count in any case."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    codes, distinct = pd.factorize(np.array([w for own in words for w in own], dtype=object))
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = max(len(hashes) - width + 1, 0)
    grams = np.full(n, width, np.uint64)
    for k in range(width):
        grams = _mixed(grams * _FACTORS[k % 4] + hashes[k : k + n])
    out, at = [], 0
    for own in words:
        if len(own) >= width:
            out.append(np.unique(grams[at : at + len(own) - width + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(own), len(own))] if own else [], np.uint64))
        at += len(own)
    return out


def _batches(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    part = (batch["text"].str.len().cumsum() // BATCH_LETTERS).to_numpy()
    for k in np.unique(part):
        yield batch[part == k]


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (cells - 1)


def table_cells(texts: DataFrame) -> int:
    """The width of a count table for all texts, a power of two."""
    letters = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (letters // CELL_LETTERS).bit_length()))


def count_table(rows: DataFrame, hashes: Callable[[pd.DataFrame], Iterator[np.ndarray]], cells: int) -> np.ndarray:
    """How many hashes of all rows fall in each cell.

    A task adds up its rows and sends compressed slices; these are added up one by one, so
    neither memory nor what the driver gets grows with the input.
    """
    size = cells // SLICES

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(cells, np.uint32)
        for batch in batches:
            for found in hashes(batch):
                np.add.at(table, _cells(found, cells), 1)
        slices = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(table.reshape(SLICES, size)) if x.any()]
        yield pd.DataFrame(slices, columns=["slice", "counts"])

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch["slice"], batch["counts"], strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
        yield pd.DataFrame([(k, zlib.compress(x.tobytes(), 1)) for k, x in sums.items()], columns=["slice", "counts"])

    schema = "slice int, counts binary"
    table = np.zeros((SLICES, size), np.int64)
    for r in rows.mapInPandas(counted, schema).repartition(SLICES, "slice").mapInPandas(added, schema).collect():  # SLICES rows
        table[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return table.ravel()


def _needed(n: int) -> int:
    """The least number of shingles that a set of n shares with one that is linked to it."""
    return -(-PERCENT * n // 100)


#: Bits of a set's parity map: a bit tells whether an odd number of its shingles fall on it.
MAP_BITS = 512


def _parity(own: np.ndarray) -> np.ndarray:
    counts = np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=MAP_BITS)
    return np.packbits(counts & 1).view(np.int64)


SETS = "doc_id long, n long, set_key binary, rare array<long>, list_cost double, bits array<long>"


def _sets(texts: DataFrame, rarity: np.ndarray, width: int) -> DataFrame:
    """The columns SETS: size and key of each text's set, its first shingles, and the entries that their lists hold."""
    shared = texts.sparkSession.sparkContext.broadcast(np.log2(1 + rarity).astype(np.float16))
    usual = float(rarity.mean())
    usual += 3 * usual**0.5  # what a cell may hold of other shingles

    def one(own: np.ndarray) -> tuple:
        n = len(own)
        counts = shared.value[_cells(own, len(shared.value))]
        pick = np.lexsort((own, counts))[: min(n, n - _needed(n) + SUBSET)]
        lists = np.maximum(np.exp2(counts[pick[: n - _needed(n) + 1]].astype(np.float64)) - 1 - usual, 1.0)
        return n, xxhash.xxh3_128_digest(own.tobytes()), own[pick].view(np.int64), float(lists.sum()), _parity(own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in _batches(batch):
                rows = pd.DataFrame([one(x) for x in shingle_sets(some["text"].tolist(), width)], columns=["n", "set_key", "rare", "list_cost", "bits"])
                rows.insert(0, "doc_id", some["doc_id"].astype("Int64").values)
                yield rows

    return texts.mapInPandas(run, SETS)


def _prefix(c: int) -> Column:
    """Length of the prefix of which linked sets share c shingles."""
    return F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + c).cast("int")


def boundary(sets: DataFrame) -> int:
    """The size from which sets are looked for in lists: that of the least sum of costs over classes of sizes."""
    length = _prefix(SUBSET)
    size_class = F.floor(8 * F.log2("n"))
    costs = sets.where("n > 0").groupBy(size_class.alias("c")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum(length * (length - 1) / 2).alias("subsets"), F.sum("list_cost").alias("lists"))
    classes = sorted(costs.collect(), key=lambda r: r["c"])  # eight for each doubling
    best, found = sum(r["lists"] for r in classes), 1
    now = best
    for r in classes:
        now += r["subsets"] - r["lists"]
        if now < best:
            best, found = now, r["most"] + 1
    return found


def buckets(sets: DataFrame, large: int) -> DataFrame:
    """(bucket, id, n): small sets by subsets; large ones, and small ones within their reach, by single shingles."""
    small = sets.where((F.col("n") < large) & (F.col("n") > 1))
    first = F.slice("rare", F.lit(1), _prefix(SUBSET))
    pairs = F.flatten(F.transform(first, lambda t, i: F.transform(F.slice(first, i + 2, F.greatest(F.size(first) - i - 1, F.lit(0))), lambda u: F.xxhash64(t, u))))
    by_subset = small.select(F.explode(pairs).alias("bucket"), "id", "n")
    reach = sets.where(F.col("n") * 100 >= PERCENT * large)
    by_list = reach.select(F.explode(F.slice("rare", F.lit(1), _prefix(1))).alias("bucket"), "id", "n")
    return by_subset.union(by_list)


def _linkable(n: Column, m: Column) -> Column:
    """Whether the sizes of two sets allow a link."""
    return F.coalesce(F.least(n, m) * 100 >= PERCENT * F.greatest(n, m), F.lit(False))


def _plausible(one: str, other: str) -> Column:
    """Whether the sizes and the parity maps of two sets (structs of n and bits) allow a link."""
    n, m = F.col(f"{one}.n"), F.col(f"{other}.n")
    apart = F.lit(0)
    for k in range(MAP_BITS // 64):
        apart = apart + F.bit_count(F.col(f"{one}.bits")[k].bitwiseXOR(F.col(f"{other}.bits")[k]))
    # the sets differ in `apart` shingles at least
    return _linkable(n, m) & ((100 + PERCENT) * (n + m - apart) >= 2 * PERCENT * (n + m))


def members(listed: DataFrame, part_members: int = PART_MEMBERS) -> DataFrame:
    """Of (bucket, id, n) those with company, as (bucket, id, n, members, before): before may be linked with id.

    Within a bucket, or a part of a large one, before is the id of the next smaller set; the
    first of a part meets that of the part before it.
    """
    several = listed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    rows = listed.join(several, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / part_members)))
    last = F.lag(F.struct("n", "id"))
    chained = rows.withColumn("last", last.over(Window.partitionBy("bucket", "part").orderBy("n", "id")))
    large = F.col("members") > part_members
    heads = chained.where(F.col("last").isNull() & large)
    heads = heads.withColumn("last", last.over(Window.partitionBy("bucket").orderBy("n", "id")))
    both = chained.where(F.col("last").isNotNull() | ~large).unionByName(heads)
    before = F.when(_linkable(F.col("n"), F.col("last.n")), F.col("last.id"))
    return both.select("bucket", "id", "n", "members", before.alias("before")).where("members > 2 or before is not null")


def _id_of(key: bytes, half: int) -> int:
    return int.from_bytes(key[8 * half : 8 * half + 8], "little", signed=True)


def numbered(once: DataFrame) -> tuple[DataFrame, int]:
    """Distinct sets with id, the half of their keys that tells all of them apart; and which half that is."""
    for half in (0, 1):
        id_of = F.pandas_udf(lambda keys, half=half: keys.map(lambda k: _id_of(k, half)).astype("int64"), "long")
        sets = written(once.withColumn("id", id_of("set_key")), "jaccard-distinct")
        if sets.groupBy("id").count().where("count > 1").isEmpty():
            return sets, half
    raise ValueError("two sets share both a half of their keys")


def _tokens(texts: DataFrame, wanted: DataFrame, width: int, half: int, cells: int) -> DataFrame:
    """(id, tokens): the whole sets of the wanted ids, in buckets by id.

    A count table of the ids lets most others leave where texts are read.
    """

    def ids(batch: pd.DataFrame) -> Iterator[np.ndarray]:
        yield batch["id"].to_numpy(np.int64).view(np.uint64)

    keep = texts.sparkSession.sparkContext.broadcast(np.packbits(count_table(wanted.select("id"), ids, cells) > 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = np.unpackbits(keep.value), set()
        for batch in batches:
            for some in _batches(batch):
                rows = []
                for own in shingle_sets(some["text"].tolist(), width):
                    own_id = _id_of(xxhash.xxh3_128_digest(own.tobytes()), half)
                    if own_id not in seen and known[_cells(np.array([own_id]).view(np.uint64), cells)[0]]:
                        seen.add(own_id)
                        rows.append((own_id, own.view(np.int64)))
                yield pd.DataFrame(rows, columns=["id", "tokens"])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = texts.mapInPandas(run, "id long, tokens array<long>").repartition(n, "id").dropDuplicates(["id"])
    return bucketed(found, "jaccard_sets", "id", n, [])


def _verified(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The pairs (u, v) that are linked."""
    met = pairs.join(tokens.select(F.col("id").alias("u"), F.col("tokens").alias("x")), "u").join(tokens.select(F.col("id").alias("v"), F.col("tokens").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y"))
    return met.where(shared * 100 >= PERCENT * (F.size("x") + F.size("y") - shared)).select("u", "v")


def _pairs(u: Column, v: Column) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _plausible_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (u, v) whose sizes and parity maps allow a link."""
    side = lambda c: sets.select(F.col("id").alias(c), F.struct("n", "bits").alias(f"of_{c}"))
    return pairs.distinct().join(side("u"), "u").join(side("v"), "v").where(_plausible("of_u", "of_v")).select("u", "v")


def set_components(sets: DataFrame, texts: DataFrame, half: int, cells: int, width: int = SHINGLE_WORDS) -> DataFrame:
    """(u, root) of every set that has a smaller one in its component; sets: id, n, rare, list_cost, bits."""
    found = written(members(buckets(sets, boundary(sets))), "jaccard-members")
    few = found.where(F.col("members").between(3, FEW_MEMBERS)).select("bucket", "id", "n")
    others = few.select("bucket", F.col("id").alias("id2"), F.col("n").alias("n2"))
    all_of_few = few.join(others, "bucket").where((F.col("id") < F.col("id2")) & _linkable(F.col("n"), F.col("n2"))).select(F.col("id").alias("u"), F.col("id2").alias("v"))
    chains = found.where("before is not null").select(*_pairs(F.col("id"), F.col("before")))
    tested = keep_lineage_short(_plausible_pairs(chains.union(all_of_few), sets))
    crowded = found.where(F.col("members") > FEW_MEMBERS)
    wanted = tested.select(F.explode(F.array("u", "v")).alias("id")).union(crowded.select("id")).distinct()
    tokens = _tokens(texts, wanted, width, half, cells)
    links = keep_lineage_short(_verified(tested, tokens))
    roots = component_roots(links).withColumnRenamed("u", "id")
    named = crowded.select("bucket", "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = named.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("bucket")
    unsettled = named.join(mixed, "bucket").select("id", "root").distinct()
    rows = unsettled.join(sets.select("id", F.struct("n", "id", "bits").alias("own"), F.slice("rare", F.lit(1), _prefix(1)).alias("first")), "id")
    one = keep_lineage_short(rows.select("root", "own", F.when(F.size("first") <= SHORT_LIST, F.col("first")).alias("first"), F.explode("first").alias("shingle")))
    other = one.select("shingle", F.col("own").alias("other"), F.col("root").alias("root2"), F.col("first").alias("first2"))
    # a pair is made at the first of the shingles that both are listed by; long lists would take longer to compare than to make distinct
    where = F.col("first").isNull() | F.col("first2").isNull() | (F.array_intersect("first", "first2")[0] == F.col("shingle"))
    met = one.join(other, "shingle").where((F.col("root") < F.col("root2")) & _plausible("own", "other") & where)
    more = met.select(*_pairs(F.col("own.id"), F.col("other.id"))).distinct().join(tested, ["u", "v"], "left_anti")
    return component_roots(links.union(_verified(keep_lineage_short(more), tokens)))


def jaccard_components(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles (size of the set) and component_id (the smallest doc_id reachable by links)."""
    texts = doc_texts(docs)

    def hashes(batch: pd.DataFrame) -> Iterator[np.ndarray]:
        for some in _batches(batch):
            yield from shingle_sets(some["text"].tolist(), width)

    cells = table_cells(texts)
    rows = written(_sets(texts, count_table(texts, hashes, cells), width), "jaccard-rows")
    once = rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "rare", "list_cost", "bits")])
    sets, half = numbered(once)
    roots = set_components(sets, texts, half, cells, width).withColumnRenamed("u", "id")
    classed = sets.select("id", "set_key", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = classed.join(least, "root").select("set_key", "component_id")
    linked = rows.where("n > 0").select("doc_id", "n", "set_key").join(by_key, "set_key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))
