"""Near-duplicate documents by HyperMinHash: compressed registers, bands, corrected estimates, exact check.

Sketch. Each shingle hash picks one of ``REGISTERS`` buckets with its low bits; the least of the high
bits in a bucket is stored compressed: how many leading zeros it has and the ``MANTISSA`` bits behind
its first one. A set too small to fill the registers is hashed with several seeds (a power of two), so
that every register sees about two hashes at least; sets whose partners may use another number of seeds
are sketched with both. The registers that two sets have alike estimate their Jaccard similarity, once
the alike ones expected by collision of compressed values are taken off.

Search. Runs of ``ROWS`` compressed registers are band keys. At similarity 0.8 a pair shares none of the
32 bands with probability 5e-8. Documents with the same shingle set are one node. The members of a
bucket are compared with its hubs, never with each other; a pair goes on if its corrected estimate is
within ``MARGIN`` of the threshold, and is linked if the exact sets say so. First each document meets one
hub, the first of all its buckets in the order of a hash of the id, and links are contracted to
components. Only buckets that still hold several components go on. In those of two or three members all
pairs meet; of the larger ones each document meets one more hub, the first that lies in another component.

Completeness. Buckets of up to three members are thereby compared in full. Larger ones whose members
ended up in one component need no more. The documents of the rest (buckets that still hold several
components) are joined on the rarest shingles of their full sets: as many as two linked sets cannot both
miss. A shingle that all its documents hold within one component asks for nothing; of the others the
documents outside its main component meet all its documents. Sizes, places of the shingle and parity bits
rule out most pairs without the sets, and the others are confirmed on full sets, one pair of each component
first. All links between components of these documents are found; a common shingle costs nothing where
rarer ones decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.llm.common import maybe_in, min_components, packed, row_keys, stash, table
from stagecast.llm.shingle_sets import fingerprint, mixed, shingle_set

REGISTERS, MANTISSA, ROWS = 128, 10, 4
BANDS = REGISTERS // ROWS
PERCENT = 80
#: Below the threshold by so much, 128 registers estimate a pair at the threshold about once in 1e7.
MARGIN = 0.22
#: Rows that a task gives back at once.
AT_ONCE = 1000
#: Documents, and places of rare shingles, of one side of a block in the last step, and words of 64 parity bits of a document.
BLOCK_DOCS, BLOCK_PLACES, PARITY = 1000, 100_000, 64


def seeds_for(n: int) -> int:
    """Seeds that give the registers about two hashes each: a power of two."""
    seeds = 1
    while seeds * n < 2 * REGISTERS:
        seeds *= 2
    return seeds


def registers(hashes: np.ndarray, seeds: int) -> np.ndarray:
    """Compressed registers of a set: 0 if empty, else (leading zeros + 1, first mantissa bits) of the least."""
    salt = mixed(np.arange(1, seeds + 1, dtype=np.uint64))
    h = mixed(hashes[:, None] ^ salt[None, :]).ravel()
    low = np.uint64(REGISTERS - 1)
    ranked = np.sort(((h & low) << np.uint64(53)) | (h >> np.uint64(11)))
    bucket = (ranked >> np.uint64(53)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    least = (ranked[first] & np.uint64((1 << 53) - 1)).astype(np.float64)
    fraction, bits = np.frexp(least)                       # least = fraction * 2**bits, exact below 2**53
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    zeros = np.where(least > 0, 53 - bits, 53)
    out = np.zeros(REGISTERS, dtype=np.uint16)
    out[bucket[first]] = ((zeros + 1) << MANTISSA) | np.where(least > 0, mantissa, 0)
    return out


def band_keys(regs: np.ndarray, seeds: int) -> np.ndarray:
    """A 64-bit key for each band that is not empty."""
    packed = regs.reshape(BANDS, ROWS).view(np.uint64).ravel()
    name = mixed(np.arange(BANDS, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(seeds))
    return mixed(packed ^ name)[packed != 0].view(np.int64)


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that a register of two disjoint sets is alike by collision of compressed values.

    With a and b hashes a bucket, both minima fall into one cell of width w around x with probability
    a * b * exp(-(a + b) x) * w**2; cells of the level with z leading zeros are 2**-(z + 1 + MANTISSA) wide.
    """
    a, b = np.maximum(n_a, 1) / REGISTERS, np.maximum(n_b, 1) / REGISTERS
    total = np.zeros_like(a)
    for z in range(48):
        level = np.exp(-(a + b) * 2.0 ** -(z + 1)) - np.exp(-(a + b) * 2.0 ** -z)
        total += 2.0 ** -(z + 1 + MANTISSA) * a * b / (a + b) * level
    return total


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Corrected Jaccard estimates of rows of registers; ``n_a, n_b`` count their hashes."""
    used = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    alike = ((a == b) & (a > 0)).sum(axis=1) / used
    c = chance(n_a.astype(float), n_b.astype(float))
    return (alike - c) / (1 - c)


SKETCH = "id long, n long, f1 long, f2 long, seeds1 int, regs1 binary, seeds2 int, regs2 binary, keys array<long>"


def sketches(docs: DataFrame, width: int, percent: int = PERCENT) -> DataFrame:
    """``SKETCH`` of each row of ``docs(id, text)``: set size, set fingerprint, registers, band keys.

    ``seeds2`` is the number of seeds of the smallest possible partner, null if it is ``seeds1``.
    """
    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b[at:at + AT_ONCE] for b in batches for at in range(0, len(b), AT_ONCE)):
            rows = []
            for doc, text in zip(batch["id"], batch["text"]):
                s = shingle_set(text, width)
                doc = None if pd.isna(doc) else int(doc)
                if not len(s):
                    rows.append((doc, 0, 0, 0, None, None, None, None, None))
                    continue
                one, two = seeds_for(len(s)), seeds_for(-(-len(s) * percent // 100))
                regs = registers(s, one)
                keys, regs2 = band_keys(regs, one), None
                if two != one:
                    regs2 = registers(s, two)
                    keys = np.concatenate([keys, band_keys(regs2, two)])
                rows.append((doc, len(s), *fingerprint(s), one, regs.tobytes(), two if two != one else None,
                             None if regs2 is None else regs2.tobytes(), keys))
            out = pd.DataFrame(rows, columns=["id", "n", "f1", "f2", "seeds1", "regs1", "seeds2", "regs2", "keys"])
            yield out.astype({"id": "Int64", "seeds1": "Int32", "seeds2": "Int32"})
    return docs.mapInPandas(sketched, SKETCH)


def _plausible(percent: int):
    least = percent / 100 - MARGIN

    @F.pandas_udf("boolean")
    def plausible(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series, seeds: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(-1, REGISTERS) for s in (a, b))
        return pd.Series(estimated(x, y, (n_a * seeds).to_numpy(), (n_b * seeds).to_numpy()) >= least)
    return plausible


def _linked(percent: int) -> Column:
    """Whether the sets ``sa`` and ``sb`` (arrays of distinct hashes) are linked."""
    return F.size(F.array_intersect("sa", "sb")) * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``(id, set array<long>)`` of the documents in ``ids(id)``: only their texts are read and shuffled."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b[at:at + AT_ONCE] for b in batches for at in range(0, len(b), AT_ONCE)):
            yield pd.DataFrame({"id": batch["id"], "set": [shingle_set(t, width).view(np.int64) for t in batch["text"]]})
    some = maybe_in(docs.where("id is not null"), F.col("id"), ids.select(F.col("id").alias("key"))).where("maybe")
    return some.select("id", "text").mapInPandas(cut, "id long, set array<long>").join(ids, "id", "left_semi").distinct()


def first_hubs(met: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: each member with one hub, the first in hash order of all its buckets."""
    one = met.where("id <> low").groupBy("id").agg(F.min_by("low", F.xxhash64("low")).alias("hub"))
    return one.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def open_buckets(met: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of ``met(id, key, ...)`` in buckets that hold several components, plus ``component``."""
    named = stash(met.join(components, "id", "left").withColumn("component", F.coalesce("component", "id")), "named-buckets")
    several = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return stash(named.join(several.select("key"), "key"), "open-buckets")


def hub_pairs(met: DataFrame, known: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: members with hubs that lie in another component.

    ``met(id, key, members, low, high, component)``: in buckets of up to three members, either hub; of the
    larger buckets, one hub a document, the first in hash order. Pairs of ``known(a, b)`` are left out.
    """
    hubs = met.groupBy("key").agg(F.max(F.when(F.col("id") == F.col("low"), F.col("component"))).alias("low_in"),
                                  F.max(F.when(F.col("id") == F.col("high"), F.col("component"))).alias("high_in"))
    both = met.join(hubs, "key").select("id", "members", "component", F.explode(F.array(
        F.struct(F.col("low").alias("hub"), F.col("low_in").alias("at")),
        F.struct(F.col("high").alias("hub"), F.col("high_in").alias("at")))).alias("to"))
    both = both.where("to.at <> component").select("id", "members", F.col("to.hub").alias("hub"))
    one = both.where("members > 3").groupBy("id").agg(F.min_by("hub", F.xxhash64("hub")).alias("hub"))
    pairs = both.where("members <= 3").select("id", "hub").unionByName(one).select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are linked: plausible by their registers, then confirmed on full sets."""
    cols = ["n", "seeds1", "regs1", "seeds2", "regs2"]
    x = nodes.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    y = nodes.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    both = pairs.join(x, "a").join(y, "b").where(
        (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent))

    def common(i: int, j: int) -> Column:
        return F.col(f"a_seeds{i}") == F.col(f"b_seeds{j}")
    ways = [(1, 1), (1, 2), (2, 1), (2, 2)]
    regs_a = F.coalesce(*[F.when(common(i, j), F.col(f"a_regs{i}")) for i, j in ways])
    regs_b = F.coalesce(*[F.when(common(i, j), F.col(f"b_regs{j}")) for i, j in ways])
    seeds = F.coalesce(*[F.when(common(i, j), F.col(f"a_seeds{i}")) for i, j in ways])
    same = both.select("a", "b", regs_a.alias("ra"), regs_b.alias("rb"), "a_n", "b_n", seeds.alias("seeds")).where(
        F.col("seeds").isNotNull())
    likely = stash(same.where(_plausible(percent)("ra", "rb", "a_n", "b_n", "seeds")).select("a", "b").distinct(), "likely")
    ids = stash(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "likely-ids")
    sets = stash(_sets(docs, ids, width), "sets")
    both = likely.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return both.where(_linked(percent)).select("a", "b").distinct()


def _shingles(sets: DataFrame) -> DataFrame:
    """``(id, n, component, parity array<long>, shingles array<long>)`` of ``sets(id, n, component, set)``;
    a set is an array of hashes or their bytes.

    Each shingle flips one of ``64 * PARITY`` bits: two sets differ in at least as many shingles as their words in bits.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b[at:at + AT_ONCE] for b in batches for at in range(0, len(b), AT_ONCE)):
            hashes = [np.frombuffer(x, dtype=np.uint64) for x in batch["set"]]
            bits = [np.bincount((h >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1 for h in hashes]
            yield batch[["id", "n", "component"]].assign(
                parity=[np.packbits(x.astype(np.uint8)).view(np.int64) for x in bits], shingles=[h.view(np.int64) for h in hashes])
    return sets.mapInPandas(cut, "id long, n long, component long, parity array<long>, shingles array<long>")


def prefixes(docs: DataFrame, percent: int) -> DataFrame:
    """``(main, id, n, component, parity, asked, keys, places)``: the rare shingles of each document of ``_shingles`` that may
    lead to links, a row for each component ``main`` that holds most of the documents of one of them.

    In any one order of all shingles, two sets that are linked share one of the first n - least shared + 1 shingles
    of each. Shingles within one component come first, as they lead nowhere and need no row, then the others
    by how many documents hold them; ``places`` are those of ``keys`` in the set. ``asked`` is false in the main component.
    """
    each = docs.select("id", "component", F.explode("shingles").alias("key"))
    held = each.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
    common = held.groupBy("key").agg(F.sum("m").alias("held"), F.count(F.lit(1)).alias("parts"), F.max(F.struct(
        "m", "component"))["component"].alias("main")).where("parts > 1").drop("parts")
    ranked = each.join(common, "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("held", "key", "main"))).alias("open"))
    first = F.col("n") - F.size("open")                       # shingles that come before the open ones
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - first
    some = docs.drop("shingles").join(ranked, "id").where(length > 0).select(
        "id", "n", "component", "parity", F.transform(F.slice("open", 1, length.cast("int")), lambda x, i: F.struct(
            x["main"].alias("main"), x["key"].alias("key"), (first + i).alias("at"))).alias("open"))
    each = some.withColumn("main", F.explode(F.array_distinct("open.main"))).withColumn(
        "open", F.filter("open", lambda x: x["main"] == F.col("main")))
    return each.select("main", "id", "n", "component", "parity", (F.col("component") != F.col("main")).alias("asked"),
                       F.col("open.key").alias("keys"), F.col("open.at").alias("places"))


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of ``prefixes`` dealt to blocks ``(shard, row, col)`` of bounded size, ``asking`` tells in which role.

    The shingles of one main component are a group. Each side of it, the documents outside the main component and all, is cut into
    chunks; each chunk meets all of the other side, so that two documents meet in one block of a group, however many
    shingles they share. Groups of one block are put together to shards.
    """
    def chunks(side: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(side) / BLOCK_DOCS, F.coalesce(F.sum(F.when(
            side, F.size("keys"))), F.lit(0)) / BLOCK_PLACES)).cast("int")
    shape = stash(rows.groupBy("main").agg(chunks(F.lit(True)).alias("cols"), chunks(F.col("asked")).alias("rows"),
                                           F.count(F.lit(1)).alias("members")).where("rows > 0"), "groups")
    total = F.broadcast(shape.agg(F.greatest(F.lit(1), F.ceil(F.sum("members") / BLOCK_DOCS)).alias("shards")))
    shard = F.when((F.col("rows") == 1) & (F.col("cols") == 1), F.pmod(F.xxhash64("main"), F.col("shards"))).otherwise(F.col("main"))

    def sent(asking: bool) -> Column:
        """The blocks of a document in one role."""
        mine, other = ("rows", "cols") if asking else ("cols", "rows")
        own = F.pmod(F.xxhash64("id"), F.col(mine)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda i: F.struct(
            (own if asking else i).alias("row"), (i if asking else own).alias("col"), F.lit(asking).alias("asking")))
    both = F.concat(sent(False), F.filter(sent(True), lambda x: F.col("asked")))
    return rows.join(shape, "main").crossJoin(total).select(shard.alias("shard"), F.explode(both).alias("to"), *rows.columns).select(
        "shard", "to.row", "to.col", "to.asking", *rows.columns)


def block_pairs(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """``(a, b, x, y)`` of one block of ``_dealt``, each pair once for a group."""
    asking = rows["asking"].to_numpy(dtype=bool)
    asked, held = rows[asking], rows[~asking]
    found = [np.empty((0, 4), dtype=np.int64)]
    if len(asked) and len(held):
        main, ids, sizes, inside = (held[c].to_numpy() for c in ("main", "id", "n", "component"))
        twice = held["asked"].to_numpy(dtype=bool)            # these ask as well
        parity = np.stack(held["parity"].to_list()).view(np.uint64)
        keys, places = held["keys"].to_list(), held["places"].to_list()
        for group, i, n, c, bits, mine, at in zip(*[asked[c] for c in ("main", "id", "n", "component", "parity", "keys", "places")]):
            near = np.flatnonzero((main == group) & (inside != c) & (~twice | (ids > i)) & (
                np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * percent))
            apart = np.bitwise_count(parity[near] ^ np.asarray(bits).view(np.uint64)).sum(axis=1, dtype=np.int64)
            near = near[apart * (100 + percent) <= (sizes[near] + n) * (100 - percent)]
            seat, left = dict(zip(mine.tolist(), (n - at).tolist())), []
            for k in near:                                     # shingles from the first common one on
                first = next((j for j, key in enumerate(keys[k].tolist()) if key in seat), None)
                left.append(-1 if first is None else min(seat[keys[k][first]], sizes[k] - places[k][first]))
            near = near[np.array(left, dtype=np.int64) * (100 + percent) >= (sizes[near] + n) * percent]
            found.append(np.stack([np.minimum(ids[near], i), np.maximum(ids[near], i),
                                   np.minimum(inside[near], c), np.maximum(inside[near], c)], axis=1))
    return pd.DataFrame(np.concatenate(found), columns=["a", "b", "x", "y"])


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``(a, b, x, y)`` of ``prefixes``: pairs of different components x and y that sizes, places and parities do not rule out.

    The documents outside a main component meet all that share one of its shingles, in blocks of bounded size.
    """
    def pairs(block: pd.DataFrame) -> pd.DataFrame:
        return block_pairs(block, percent)
    return _dealt(stash(rows, "prefixes")).groupBy("shard", "row", "col").applyInPandas(
        pairs, "a long, b long, x long, y long").distinct()


def unresolved_links(met: DataFrame, components: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links that the hubs have not shown: ``(a, b)`` between components that still share a large bucket."""
    met = open_buckets(met.where("members > 3").drop("component"), components)
    if not met.limit(1).count():
        return None
    members = stash(met.select("id", "n", "component").distinct(), "members")
    sets = stash(members.join(_sets(docs, members.select("id"), width), "id"), "unresolved-sets")
    pairs = stash(prefix_pairs(prefixes(stash(_shingles(sets), "unresolved-shingles"), percent), percent), "unresolved-pairs")

    def confirmed(some: DataFrame) -> DataFrame:
        both = some.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
        return both.where(_linked(percent)).select("a", "b", "x", "y")
    # each component with one other first, in the order of a hash: most of the other pairs then lie within one
    both = pairs.withColumn("of", F.col("x")).withColumn("with", F.col("y")).unionByName(
        pairs.withColumn("of", F.col("y")).withColumn("with", F.col("x")))
    one = both.groupBy("of").agg(F.min_by(F.struct("a", "b", "x", "y"), F.struct(F.xxhash64("with"), "a", "b")).alias("p"))
    one = stash(one.select("p.*").distinct(), "first-pairs")
    links = stash(confirmed(one), "first-confirmed")
    joined = min_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    rest = pairs.join(one, ["a", "b"], "left_anti")
    for c in ("x", "y"):
        name = joined.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
        rest = rest.join(name, c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    rest = rest.where("x_in <> y_in").select("a", "b", "x", "y")
    return links.union(confirmed(rest)).select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for each row of ``df``.

    Documents are linked if 100 * shared shingles >= ``percent`` * shingles of both together;
    ``component_id`` is the least id reachable over links. Texts without words (null, empty, blank) have
    no shingles and are linked with nothing: they are their own component. Rows that repeat an id are one
    document in links, each with its own set; a null id takes no part, its component is null and it is not
    kept. Texts are read whole, however long; ids are whole numbers; other columns are not read; an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    drawn = stash(sketches(docs, width, percent), "sketches")
    part = drawn.where("n > 0 and id is not null")
    same = stash(part.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets-alike")
    first = same.select(F.col("rep").alias("id"), "f1", "f2")
    nodes = stash(part.join(first, ["id", "f1", "f2"]).dropDuplicates(["id", "f1", "f2"]), "nodes")
    bands = nodes.select("id", "n", F.explode("keys").alias("key"))
    order = F.struct(F.xxhash64("id").alias("h"), F.col("id"))
    buckets = stash(bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min(order)["id"].alias("low"),
                                             F.max(order)["id"].alias("high")).where("members > 1"), "buckets")
    met = stash(bands.join(buckets, "key"), "met")
    pairs = stash(first_hubs(met), "first-hubs")
    links = stash(verified(pairs, nodes, docs, width, percent), "first-links")
    left = open_buckets(met, min_components(links))
    links = stash(links.union(verified(hub_pairs(left, pairs), nodes, docs, width, percent)), "links")
    components = min_components(links)
    more = unresolved_links(left, components, docs, width, percent)
    if more is not None:
        components = min_components(links.union(more))
    rep = F.coalesce("rep", "id")
    named = drawn.join(same.where("copies > 1").select("f1", "f2", "rep", F.lit(True).alias("part")), ["f1", "f2"], "left").select(
        "id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), rep).otherwise(F.col("id")).alias("rep"))
    labelled = named.join(components.select(F.col("id").alias("rep"), "component"), "rep", "left")
    whole = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return labelled.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), whole.alias("component_id"),
                           F.coalesce(F.col("id") == whole, F.lit(False)).alias("kept"))


def _named(df: DataFrame, id_col: str, text_col: str, clashing: DataFrame) -> DataFrame:
    """``(node, id, text, clash)`` and ``row, k1, k2`` of ``df``: the node is the id, but a hash of id and
    text where the id is in ``clashing(id)``, whose rows differ in text."""
    k1, k2 = row_keys(id_col, text_col)
    rows = packed(df, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), k1.alias("k1"), k2.alias("k2"))
    probed = maybe_in(rows, F.col("id"), clashing.select(F.col("id").alias("key")))
    hit = probed.where("maybe").join(clashing.select("id", F.lit(True).alias("clash")), "id", "left")
    cols = ["row", "id", "text", "k1", "k2"]
    return probed.where("not maybe").select(*cols, F.lit(False).alias("clash")).unionByName(
        hit.select(*cols, F.coalesce("clash", F.lit(False)).alias("clash"))).withColumn(
        "node", F.when(F.col("clash"), F.col("k1")).otherwise(F.col("id")))


def _removed_nodes(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``(node)`` of ``_named`` rows that go: all of a component but the one with the least id, then text."""
    nodes = near_duplicates(rows, "node", "text", width, percent).where("n_shingles > 0 and node is not null").select(
        "node", "component_id").distinct()
    texts = rows.where("clash").select("node", "id", "text").dropDuplicates(["node"])
    told = stash(nodes.join(texts, "node", "left").select(
        "node", "component_id", F.struct(F.coalesce("id", "node").alias("id"), "text", "node").alias("place")), "nodes-told")
    first = told.groupBy("component_id").agg(F.min("place")["node"].alias("first"))
    return told.join(first, "component_id").where("node <> first").select("node")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                 percent: int = PERCENT) -> DataFrame:
    """One row of each near-duplicate group of ``df``, all columns: the one with the least id.

    Rows with a null id and texts without words are linked with nothing and stay. Rows that repeat an id
    and its text are one (that whose hash of all columns is least stays); different texts of one id are documents of their own (the
    least text goes first in a group that holds several of them).
    """
    k1, k2 = row_keys(id_col, text_col)
    key = F.col(id_col).cast("long")
    again = stash(df.select(key.alias("id"), k1.alias("k1"), k2.alias("k2")).where("id is not null").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high"))
        .where("n > 1").select("id", (F.col("low") != F.col("high")).alias("differ")), "repeated")
    clashing = again.where("differ").select("id")
    if clashing.limit(1).count():
        rows = _named(df, id_col, text_col, clashing)
        gone = _removed_nodes(rows, width, percent)
    else:
        rows = packed(df, key.alias("id"), key.alias("node"), k1.alias("k1"), k2.alias("k2"))
        gone = near_duplicates(df, id_col, text_col, width, percent).where("not kept and n_shingles > 0").select(
            F.col(id_col).cast("long").alias("node")).where("node is not null").distinct()
    gone = stash(gone, "removed")
    cols = ["row", "id", "k1", "k2"]
    probed = maybe_in(rows.select(*cols, "node"), F.col("node"), gone.select(F.col("node").alias("key")))
    kept = probed.where("not maybe").select(*cols).unionByName(
        probed.where("maybe").join(gone, "node", "left_anti").select(*cols))
    probed = maybe_in(kept, F.col("id"), again.select(F.col("id").alias("key")))
    once = probed.where("maybe").join(again.select("id", F.lit(True).alias("repeats")), "id", "left")
    single = once.where("repeats").groupBy("id", "k1", "k2").agg(
        F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row")
    return (probed.where("not maybe").select("row").unionByName(once.where("repeats is null").select("row"))
            .unionByName(single).select("row.*"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles at Jaccard 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
