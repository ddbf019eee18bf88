"""N-gram Jaccard join by parity sketches: every link at 0.9, none lost.

Sketch. Each shingle of a set flips one bit of a sketch of ``d + 1`` words of 64 bits. A shingle that two
sets share flips the same bit in both, so the Hamming distance of two sketches is at most the size of
their symmetric difference. At a similarity of ``percent`` that difference is at most ``d``, the share
(100 - percent) / (100 + percent) of both sizes together, so by the pigeonhole principle linked sets have
one of the ``d + 1`` words in common: words are join keys, and no link is lost (but to equal 64-bit hashes
of different shingles). A word holds some nine shingles, so those of unrelated sets are often equal in a large
table. Shingles are dealt to words by their hashes, hence a word that no differing shingle falls into has the
same shingles in both sets: a key is the word and a sum of its shingles' hashes (its tag), which
unrelated words hardly ever have in common.

Size bands. Linked sets differ in size by the factor ``percent`` / 100 at most. Bands of sizes grow by a
quarter, each with the ``d`` of its largest size; a set is sketched for its own band and, if its largest
partner lies there, for the next one, so that partners always have one kind of sketch in common. Sets so
small that ``d`` is 0 are linked with equal sets only.

Search in three steps, none of which pairs the members of a hot key with each other:

1. Equal sets are one node. Nodes are numbered by a bijection that mixes the bits of the least id, so the
   least member of a bucket is a random one of it: its hub. Buckets with the same members are one.
2. Each node is compared with one hub, the least of all its buckets: the Hamming distance of the sketches
   first, whole texts then. Links are contracted to components.
3. In each bucket that still holds several components, the nodes outside its main component are compared
   with all its nodes, in blocks of bounded size: a matrix of Hamming distances names the nodes with a
   partner within reach in another component. Only these get their exact sets, and blocks of them give the
   links between components. Buckets stay apart: linked nodes share one, while chains of buckets join most
   of a large table that have no word in common.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecast.llm.common import components, maybe_in, stash, table
from stagecast.llm.shingle_sets import fingerprint, mixed, shared, shingle_set

WIDTH, PERCENT = 3, 90
#: Least size of a band over that of the band before (more where linked sizes may differ by more).
GROWTH = 1.25
#: Rows that a task takes up and gives back at once.
AT_ONCE = 500
#: Nodes, and shingles, of one side of a block.
BLOCK_NODES, BLOCK_SHINGLES = 512, 400_000
#: Members of small groups that a task takes up at once.
SHARD_NODES = 2000


def most_apart(both: int, percent: int) -> int:
    """The largest symmetric difference of linked sets whose sizes add up to ``both``."""
    return both * (100 - percent) // (100 + percent)


def band_starts(percent: int, largest: int = 1 << 40) -> list[int]:
    """Least sizes of the bands; the first is the least size of a set with an unequal partner."""
    first = 1
    while not most_apart(2 * first + 1, percent):
        first += 1
    starts = [max(1, first)]
    while starts[-1] < largest:
        starts.append(max(starts[-1] + 1, int(starts[-1] * max(GROWTH, 100 / percent))))
    return starts


def bands_of(size: int, starts: list[int], percent: int) -> list[int]:
    """The band of a size and, if a partner may be as large, the next one."""
    own = bisect_right(starts, size) - 1
    top = bisect_right(starts, size * 100 // percent) - 1
    return [b for b in range(own, top + 1) if b >= 0]


def parity_words(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """Sketch of a set: bit p is set if an odd number of hashes is p modulo the number of bits."""
    places = (hashes % np.uint64(64 * n_words)).astype(np.int64)
    bits = (np.bincount(places, minlength=64 * n_words) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.uint64)


def word_tags(hashes: np.ndarray, n_words: int) -> bytes:
    """Two bytes for each word of a sketch: the sum of the hashes that fall into it, mixed and cut."""
    words = (hashes % np.uint64(64 * n_words)).astype(np.int64) >> 6
    parts = (mixed(hashes) >> np.uint64(48)).astype(np.float64)       # sums below 2**53 are exact
    return np.bincount(words, weights=parts, minlength=n_words).astype(np.int64).astype("<u2").tobytes()


SKETCH = ("id long, node long, n long, f1 long, f2 long, band1 int, words1 array<long>, tags1 binary, "
          "band2 int, words2 array<long>, tags2 binary")


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``SKETCH`` of each row of ``docs(id, text)``: set size, set fingerprint, sketches of one or two bands."""
    starts = band_starts(percent)

    def sketch(s: np.ndarray, band: int) -> tuple[np.ndarray, bytes]:
        n_words = most_apart(2 * (starts[band + 1] - 1), percent) + 1
        return parity_words(s, n_words).view(np.int64), word_tags(s, n_words)

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b[at:at + AT_ONCE] for b in batches for at in range(0, len(b), AT_ONCE)):
            rows = []
            for doc, text in zip(batch["id"], batch["text"]):
                s = shingle_set(text, width)
                doc = None if pd.isna(doc) else int(doc)
                node = None if doc is None else int(mixed(np.array([doc], dtype=np.int64).view(np.uint64)).view(np.int64)[0])
                drawn = [(b, *sketch(s, b)) for b in bands_of(len(s), starts, percent)] if len(s) else []
                drawn += [(None, None, None)] * (2 - len(drawn))
                rows.append((doc, node, len(s), *(fingerprint(s) if len(s) else (0, 0)), *drawn[0], *drawn[1]))
            out = pd.DataFrame(rows, columns=["id", "node", "n", "f1", "f2", "band1", "words1", "tags1", "band2", "words2", "tags2"], dtype=object)
            yield out.astype({"id": "Int64", "node": "Int64", "n": "int64", "f1": "int64", "f2": "int64", "band1": "Int32", "band2": "Int32"})
    # ids go as text: beside a null, pandas would hold numbers as floats
    return docs.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(sketched, SKETCH)


def by_band(drawn: DataFrame, same: DataFrame) -> DataFrame:
    """``(id, node, n, band, words, tags)``: the sketches of one document of each set, a row for each band.

    Copies are found by a Bloom filter of their ids, so the other rows stay where they are.
    """
    part = drawn.where("n > 0 and id is not null")
    copies = part.join(same.where("copies > 1"), ["f1", "f2"]).where("id <> rep").select("id", "f1", "f2")
    copies = stash(copies.distinct(), "copies")
    probed = maybe_in(part, F.col("id"), copies.select(F.col("id").alias("key")))
    rows = probed.where("not maybe").unionByName(probed.where("maybe").join(copies, ["id", "f1", "f2"], "left_anti"))
    return rows.select("id", "node", "n", F.explode(F.array(*[
        F.struct(*[F.col(f"{c}{i}").alias(c) for c in ("band", "words", "tags")]) for i in (1, 2)])).alias("s")).select(
        "id", "node", "n", "s.band", "s.words", "s.tags").where("band is not null")


def memberships(sketched: DataFrame) -> DataFrame:
    """``(key, band, node, low)`` of the keys that several nodes have; ``low`` is the least of them.

    A key is a word of a sketch with its tag, band and place. One aggregation names the members of buckets of two
    and three (their least, greatest and exclusive or); of buckets alike in all these one stays. The members
    of larger ones are found by a second look at the keys, of which a Bloom filter lets through hardly any
    others.
    """
    keys = sketched.select("node", "band", "tags", F.posexplode("words").alias("place", "word")).select(
        F.xxhash64("band", "place", "word", F.substring("tags", F.col("place") * 2 + 1, F.lit(2))).alias("key"), "band", "node")
    shape = ["band", "members", "low", "high", "odd"]
    buckets = stash(keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("node").alias("low"), F.max("node").alias("high"),
        F.bit_xor("node").alias("odd"), F.min("band").alias("band")).where("low <> high")
        .groupBy(*shape).agg(F.min("key").alias("key")), "buckets")
    middle = F.when(F.col("members") == 3, F.col("odd").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high")))
    few = buckets.where("members < 4").select(
        "key", "band", F.explode(F.array_compact(F.array("low", "high", middle))).alias("node"), "low")
    large = buckets.where("members > 3").select("key", "low")
    many = maybe_in(keys, F.col("key"), large.select("key")).where("maybe").join(large, "key")
    return few.unionByName(many.select("key", "band", "node", "low"))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs(id, text)`` with an id in ``ids(id)``, and hardly any others (a Bloom filter)."""
    return maybe_in(docs.where("id is not null"), F.col("id"), ids.select(F.col("id").alias("key"))).where("maybe").select("id", "text")


def _linked(width: int, percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        hub: tuple[str | None, np.ndarray] = (None, np.empty(0, dtype=np.uint64))
        out = []
        for x, y in zip(a, b):
            if hub[0] != y:
                hub = (y, shingle_set(y, width))
            p, q = shingle_set(x, width), hub[1]
            common = shared(p, q)
            out.append(100 * common >= percent * (len(p) + len(q) - common))
        return pd.Series(out, dtype=bool)
    return linked


def _apart(a: Column, b: Column) -> Column:
    """Hamming distance of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def hub_links(met: DataFrame, sketched: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(a, b)``: each node with the least hub of all its buckets, where the two are linked."""
    pairs = met.where("low < node").groupBy("node").agg(F.min("low").alias("hub"), F.min_by("band", "low").alias("band"))
    a, b = (sketched.select("band", *[F.col(c).alias(f"{x}_{c}") for c in ("id", "node", "n", "words")]) for x in "ab")
    both = pairs.select("band", F.col("node").alias("a_node"), F.col("hub").alias("b_node")).join(
        a, ["band", "a_node"]).join(b, ["band", "b_node"])
    near = _apart(F.col("a_words"), F.col("b_words")) * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)
    likely = stash(both.where(near).select("a_id", "a_node", "b_id", "b_node").distinct(), "likely")
    texts = _texts(docs, stash(likely.select(F.col("a_id").alias("id")).union(likely.select("b_id")).distinct(), "likely-ids"))
    full = likely.join(texts.select(F.col("id").alias("a_id"), F.col("text").alias("a")), "a_id").join(
        texts.select(F.col("id").alias("b_id"), F.col("text").alias("b")), "b_id")
    return full.where(_linked(width, percent)("a", "b")).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def _near(asked: pd.DataFrame, held: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each asked node's place with the places of held nodes within reach by Hamming distance."""
    matrix = np.stack([np.asarray(w, dtype=np.int64).view(np.uint64) for w in held["words"]])
    sizes = held["n"].to_numpy()
    for i, (n, words) in enumerate(zip(asked["n"], asked["words"])):
        apart = np.bitwise_count(matrix ^ np.asarray(words, dtype=np.int64).view(np.uint64)).sum(axis=1, dtype=np.int64)
        yield i, np.flatnonzero(apart * (100 + percent) <= (sizes + n) * (100 - percent))


def block_reach(asked: pd.DataFrame, held: pd.DataFrame, percent: int) -> np.ndarray:
    """The nodes of one block that are within reach of a node of another component, as rows (node, hub): nodes
    that reach each other over others of the block have one hub."""
    a_ids, h_ids = asked["node"].to_numpy(), held["node"].to_numpy()
    a_in, h_in = asked["component"].to_numpy(), held["component"].to_numpy()
    nodes = np.union1d(a_ids, h_ids)
    a_at, h_at = np.searchsorted(nodes, a_ids), np.searchsorted(nodes, h_ids)
    label, some = np.arange(len(nodes)), np.zeros(len(nodes), dtype=bool)
    for i, near in _near(asked, held, percent):
        near = near[h_in[near] != a_in[i]]
        if len(near):
            met = np.append(h_at[near], a_at[i])
            some[met] = True
            names = np.unique(label[met])
            if len(names) > 1:
                label[np.isin(label, names)] = names[0]
    return np.stack([nodes[some], nodes[label[some]]], axis=1)


def block_links(asked: pd.DataFrame, held: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Exact links of one block between components; once links of the block have joined two, none is sought."""
    _, name = np.unique(np.concatenate([asked["component"].to_numpy(), held["component"].to_numpy()]), return_inverse=True)
    own, other = name[:len(asked)], name[len(asked):]          # views: renamed together
    a_ids, h_ids = asked["node"].to_numpy(), held["node"].to_numpy()
    a_sets, h_sets = list(asked["set"]), list(held["set"])
    links = []
    for i, near in _near(asked, held, percent):
        s = np.frombuffer(a_sets[i], dtype=np.uint64)
        for k in near[other[near] != own[i]].tolist():
            if other[k] == own[i]:
                continue
            t = np.frombuffer(h_sets[k], dtype=np.uint64)
            common = shared(s, t)
            if 100 * common >= percent * (len(s) + len(t) - common):
                links.append((int(a_ids[i]), int(h_ids[k])))
                name[name == other[k]] = own[i]
    return links


def _dealt(members: DataFrame, payload: DataFrame) -> DataFrame:
    """Blocks of groups: ``members(g, band, node, n, component, asked)`` dealt to ``(g, band, row, col)``, each row
    with its columns of ``payload(node, band, ...)``, which join last: they are shuffled to their blocks and nowhere else.

    Nodes outside the main component (``asked``) meet all nodes of the group. Each side of a group is cut into
    chunks of bounded size, and each chunk is sent to the blocks of all chunks of the other side. Groups of
    one block are dealt to as many ``shard``s as make some ``SHARD_NODES`` members each, so that a call takes
    up many small ones, each node sent once (``role`` 2: asked and held); the block of a larger group is a
    shard of its own, its nodes sent as held (0) and again as asked (1).
    """
    def chunks(count: Column, shingles: Column) -> Column:
        return F.ceil(F.greatest(count / BLOCK_NODES, shingles / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    one = F.when(F.col("asked"), 1)
    shape = members.groupBy("g", "band").agg(
        chunks(F.count(F.lit(1)), F.sum("n")).alias("cols"),
        chunks(F.count(one), F.coalesce(F.sum(one * F.col("n")), F.lit(0))).alias("rows"),
        F.count(F.lit(1)).alias("members"), F.count(one).alias("n_asked")).where("n_asked > 0")

    def sent(role: bool) -> Column:
        """The blocks of a node in one role."""
        mine, other = ("rows", "cols") if role else ("cols", "rows")
        own = F.pmod(F.xxhash64("node"), F.col(mine)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda i: F.struct(
            (own if role else i).alias("row"), (i if role else own).alias("col"), F.lit(int(role)).alias("role")))
    total = F.broadcast(shape.agg(F.greatest(F.lit(1), F.ceil(F.sum("members") / SHARD_NODES)).alias("shards")))
    single = (F.col("rows") == 1) & (F.col("cols") == 1)
    shard = F.when(single, F.pmod(F.xxhash64("g"), F.col("shards"))).otherwise(F.col("g"))
    both = F.concat(sent(False), F.when(F.col("asked"), sent(True)).otherwise(F.filter(sent(True), lambda x: F.lit(False))))
    both = F.when(single, F.array(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"), F.when(
        F.col("asked"), 2).otherwise(0).alias("role")))).otherwise(both)
    return members.join(shape, ["g", "band"]).crossJoin(total).withColumn("shard", shard).select(
        "shard", "g", "band", F.explode(both).alias("at"), "node", "n", "component").select(
        "shard", "g", "band", "at.row", "at.col", "at.role", "node", "n", "component").join(payload, ["node", "band"])


def _with_main(members: DataFrame) -> DataFrame:
    """Adds ``asked``: false for the nodes of the largest component of each group."""
    sizes = members.groupBy("g", "component").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("g").agg(F.max(F.struct("m", "component"))["component"].alias("main"))
    return members.join(main, "g").withColumn("asked", F.col("component") != F.col("main")).drop("main")


def open_links(met: DataFrame, joined: DataFrame, sketched: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(a, b)``: the links between components that still share a bucket, as far as they join components."""
    named = stash(met.join(joined.select(F.col("id").alias("node"), "component"), "node", "left").withColumn(
        "component", F.coalesce("component", "node")), "named-buckets")
    # a bucket of two that are node and hub has been judged: not linked
    judged = met.where("low < node").groupBy("node").agg(F.min("low").alias("hub"))
    several = named.join(judged, "node", "left").groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"),
        F.count_if((F.col("node") != F.col("low")) & (F.col("hub") == F.col("low"))).alias("judged"))
    several = several.where("x <> y and not (members = 2 and judged > 0)")
    left = stash(named.join(several.select("key"), "key"), "open-buckets")
    members = left.select(F.col("key").alias("g"), "band", "node", "component").distinct()
    words = sketched.select("node", "band", "words")
    members = stash(_with_main(members).join(sketched.select("node", "band", "n"), ["node", "band"]), "members")

    def groups_of(rows: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, pd.DataFrame]]:
        """The groups of a shard that hold both sides, each as (g, asked, held)."""
        rows = rows.sort_values(["g", "node"], ignore_index=True)
        g, role = rows["g"].to_numpy(), rows["role"].to_numpy()
        starts = np.flatnonzero(np.diff(g, prepend=g[0] - 1 if g[0] > -2**63 else g[0] + 1))
        for first, end in zip(starts, [*starts[1:], len(g)]):
            a, h = (np.flatnonzero(role[first:end] != other) + first for other in (0, 1))
            if len(a) and len(h):
                yield int(g[first]), rows.take(a), rows.take(h)

    def reach(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(asked["band"].iloc[0], block_reach(asked, held, percent)) for _, asked, held in groups_of(rows)]
        pairs = np.concatenate([np.empty((0, 2), dtype=np.int64), *[x for _, x in found]])
        return pd.DataFrame({"band": np.repeat(np.array([b for b, _ in found], dtype=np.int32), [len(x) for _, x in found]),
                             "a": pairs[:, 0], "b": pairs[:, 1]})

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        links = [x for _, asked, held in groups_of(rows) for x in block_links(asked, held, percent)]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b[at:at + AT_ONCE] for b in batches for at in range(0, len(b), AT_ONCE)):
            yield pd.DataFrame({"id": batch["id"], "set": [shingle_set(t, width).tobytes() for t in batch["text"]]})
    block = ["shard", "row", "col"]
    near = stash(_dealt(members, words).groupBy(*block).applyInPandas(reach, "band int, a long, b long").distinct(), "within-reach")
    # nodes that reach each other, over any buckets of a band, are a group
    groups = components(near.select(F.xxhash64("a", "band").alias("a"), F.xxhash64("b", "band").alias("b")))
    some = left.select("node", "band", "component").distinct().withColumn("seat", F.xxhash64("node", "band")).join(
        groups.select(F.col("id").alias("seat"), F.col("component").alias("g")), "seat").drop("seat").join(
        sketched.select("id", "node", "n", "band"), ["node", "band"])
    some = stash(some, "reach")
    sets = _texts(docs, stash(some.select("id").distinct(), "reach-ids")).mapInPandas(cut, "id long, set binary")
    full = words.join(some.select("id", "node", "band").distinct(), ["node", "band"]).join(sets, "id").drop("id")
    return _dealt(stash(_with_main(some.drop("id")), "reach-members"), full).groupBy(*block).applyInPandas(link, "a long, b long")


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, component_id)`` for each row of ``df``.

    Documents are linked if 100 * shared shingles >= ``percent`` * shingles of both together (distinct runs
    of ``width`` words of the whole text, A-Z lower-cased; a shorter text is one shingle). ``component_id``
    is the least id reachable over links, the document's own included. Texts without words (null, empty,
    blank) have no shingles and are linked with nothing. Rows that repeat an id are one document in links,
    each with its own set; a null id takes no part, its component is null. Texts are read whole, however
    long. Ids are whole numbers; other columns are not read, whatever their names; an empty table gives an
    empty result.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    drawn = stash(sketches(docs, width, percent), "parity-sketches")
    part = drawn.where("n > 0 and id is not null")
    same = stash(part.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets-alike")
    sketched = by_band(drawn, same)
    met = stash(memberships(sketched), "memberships")
    # from here on only sketches of nodes that share a key are of use
    shared_keys = maybe_in(sketched, F.col("node"), met.select(F.col("node").alias("key"))).where("maybe")
    sketched = stash(shared_keys.select("id", "node", "n", "band", "words"), "met-sketches")
    links = stash(hub_links(met, sketched, docs, width, percent), "hub-links")
    more = stash(open_links(met, components(links, lambda c: c), sketched, docs, width, percent), "open-links")
    joined = components(links.union(more), lambda c: c)
    linked = drawn.select("id", "node").distinct().join(joined.select(F.col("id").alias("node"), "component"), "node")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    least = stash(linked.join(least, "component").select(F.col("id").alias("rep"), "least"), "least-ids")
    named = drawn.join(same.where("copies > 1").select("f1", "f2", "rep"), ["f1", "f2"], "left").select(
        "id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    return named.join(least, "rep", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "rep", "id").alias("component_id"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents on three-word shingles at Jaccard 0.9."""
    return jaccard_join(table(spark, sf_dir, "documents"))
