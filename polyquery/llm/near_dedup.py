"""Near-duplicate documents by a signature-coordinate inverted join.

Each document's distinct word shingles give a MinHash signature of `coordinates` values, each of `MINIMA`
minima under hash functions of its own, so that a coordinate agrees with the resemblance's third power
and texts that share a passage or a frequent phrase rarely meet. Documents with equal shingle sets are
one class; each class is posted once under each (coordinate, value) pair. Two classes are candidates when at least `matches` coordinates agree. Such a pair must meet among the
coordinates - matches + 1 rarest pairs of each side (a prefix in one order of all pairs, by frequency),
so only these are posted, pairs that one class alone has are skipped, and the collisions of a met pair
are counted on the two signatures. Every candidate is confirmed on the full shingle sets.

Postings of large groups are not expanded into all pairs: in each round every pair's list links the
classes of each component so far to one centre, drawn anew for each round, components merge, and lists
that lie in one component are done. In the lists that stay split, members outside the list's largest
component are strays: they alone visit all blocks of the list, in which every member resides once, so that
rows grow with members and strays, not with pairs. Within a block a visitor meets all residents: each set
has a parity sketch (one bit for each hash value, flipped by each shingle), and two sketches never differ in
more bits than the sets do in shingles, so that a pair whose sketches differ too much is ruled out for
certain. Only what is left goes on to the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from polyquery.llm.shared import all_staged, documents, dropped, ready, staged, swept
from polyquery.llm.words import U64, chunks, mix, shingles, text_bytes, word_hashes

MINIMA, COORDINATES, MATCHES = 3, 32, 5  # a pair of resemblance 0.8 agrees in 5 of 32 but for some five cases in a million
BROADCAST_ROWS = 500_000
BLOCK, BLOCK_BYTES = 4096, 32 << 20  # members of a list that reside in one block, and the bytes of their sketches
VISITORS = 512  # visitors that a task holds at once
ONE_TASK = 100_000  # links, 3 MB of them, that one task puts together; more are put together round by round
ROUNDS, WORTH = 8, 100  # centre rounds at most; fewer once less than one in WORTH of a round's pairs is linked


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return seeds[:n], seeds[n:] | U64(1)


def document_sets(column: pa.Array, k: int):
    """For chunks of the column: (from, to, shingle hashes ascending by document, bounds)."""
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        words, first = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, *shingles(words, first, k)


def digest(part: np.ndarray) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


def signed(docs: DataFrame, k: int, coordinates: int) -> DataFrame:
    """(id, n, node, signature): n distinct shingles, the set's 128-bit digest, (coordinate, value) pairs as longs.

    node and signature are null for a text without words. A third column of docs, `mark`, is passed on.
    """
    kind = docs.schema["id"].dataType.simpleString()
    marks = docs.columns[2:]

    def run(batches):
        flip, odd = multipliers(coordinates * MINIMA)
        for batch in batches:
            n, node, rows = [], [], []
            for _, _, sets, bounds in document_sets(batch.column(1), k):
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                values = np.zeros((len(size), coordinates), np.int64)
                if len(some):
                    for j in range(coordinates):
                        value = np.full(len(some), j, U64)
                        for i in range(MINIMA * j, MINIMA * j + MINIMA):
                            value = mix(value ^ np.minimum.reduceat((sets ^ flip[i]) * odd[i], bounds[some]))
                        values[some, j] = value.view(np.int64)
                n.append(size)
                node += [digest(sets[bounds[i] : bounds[i + 1]]) if size[i] else None for i in range(len(size))]
                rows.append(values)
            size = np.concatenate(n) if n else np.zeros(0, np.int64)
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int64)
            offsets = pa.array(np.arange(len(size) + 1, dtype=np.int32) * coordinates)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(node, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(flat)), *batch.columns[2:]], ["id", "n", "node", "signature", *marks])

    return docs.mapInArrow(run, f"id {kind}, n bigint, node binary, signature array<bigint>" + "".join(f", {m} bigint" for m in marks))


def parity(part: np.ndarray) -> bytes:
    """A power of two of bits, two for each shingle at least; bit h is the parity of the shingles whose hash ends in h."""
    n = max(64, 1 << (2 * len(part) - 1).bit_length())
    odd = np.bincount((part & U64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles, sketch) of documents that have words."""

    def run(batches):
        for batch in batches:
            for _, _, sets, bounds in document_sets(batch.column(1), k):
                some = np.flatnonzero(np.diff(bounds))
                parts = [sets[bounds[i] : bounds[i + 1]] for i in some]
                offsets = np.concatenate((bounds[some], bounds[-1:])).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(list(map(digest, parts)), pa.binary()), shingles, pa.array(list(map(parity, parts)), pa.binary())], ["node", "shingles", "sketch"])

    return docs.mapInArrow(run, "node binary, shingles array<bigint>, sketch binary")


def close_pairs(lists: DataFrame, percent: int, matches: int) -> DataFrame:
    """(a, b): pairs of a visitor and a resident of a block, of different components, that neither sketch nor signature rules out.

    lists: (key, block, visits, stray, node, comp, n, signature, sketch, mask), a block's residents before its
    visitors. A pair is given by the first split list alone that both are posted in; of two strays, each of
    which visits the other, by the lower one's visit.
    """

    def met(key: int, residents: list, visitors: list) -> list[tuple[bytes, bytes]]:
        strays, nodes, comps, n, signatures, sketches, masks = residents
        words, out = sketches, []
        for _, _, _, _, node, comp, size, signature, sketch, mask in visitors:
            signature = np.array(signature)
            earlier = np.int64((1 << int(np.argmax(signature == key))) - 1)
            own = np.frombuffer(sketch, np.uint64)
            for width in (len(own) // 2, len(own), 2 * len(own)):
                if width not in words:
                    continue
                at, bits = words[width]
                mine = own[:width] ^ own[width:] if width < len(own) else own
                if width > len(own):
                    bits = bits[:, : len(own)] ^ bits[:, len(own) :]
                apart = (comps[at] != comp) & (~strays[at] | (nodes[at] > node))
                apart &= 100 * np.minimum(n[at], size) >= percent * np.maximum(n[at], size)
                which = np.flatnonzero(apart)
                if not len(which):
                    continue
                differ = np.bitwise_count(bits[which] ^ mine).sum(axis=1, dtype=np.int64)
                others = at[which[differ * (100 + percent) <= (100 - percent) * (n[at[which]] + size)]]
                if not len(others):
                    continue
                same = signatures[others] == signature
                before = ((masks[others] & mask & earlier)[:, None] >> np.arange(same.shape[1]) & 1).astype(bool)
                fine = (same.sum(axis=1) >= matches) & ~(same & before).any(axis=1)
                out += [(min(node, x), max(node, x)) for x in nodes[others[fine]].tolist()]
        return out

    def at_home(held: list) -> list:
        _, _, _, strays, nodes, comps, n, signatures, sketches, masks = zip(*held, strict=True)
        width = np.array([len(x) // 8 for x in sketches])
        words = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            words[w] = at, np.frombuffer(b"".join(sketches[x] for x in at), np.uint64).reshape(len(at), w)
        return [np.array(strays), np.array(nodes, object), np.array(comps, object), np.array(n), np.array(signatures), words, np.array(masks)]

    def run(batches):
        at, held, residents = None, [], None

        def close():
            if held and residents is not None and (pairs := met(at[0], residents, held)):
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in pairs], pa.binary()) for c in (0, 1)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != at:
                    yield from close()
                    at, held, residents = row[:2], [], None
                if row[2] and residents is None:
                    if not held:
                        continue  # nobody resides here
                    residents, held = at_home(held), []
                held.append(row)
                if residents is not None and len(held) >= VISITORS:
                    yield from close()
                    held = []
        yield from close()

    return lists.mapInArrow(run, "a binary, b binary")


def split_lists(split: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """Residents and visitors of the lists (key, node, place, comp) that lie in several components, with what close_pairs
    needs, dealt by list and block. A list has a block for each BLOCK members, or BLOCK_BYTES of their sketches."""
    masks = split.groupBy("node").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place"))).alias("mask"))
    known = signatures.join(sets.select("node", "sketch", F.size("shingles").alias("n")), "node").join(masks, "node")
    sized = split.join(sets.select("node", F.octet_length("sketch").cast("bigint").alias("bytes")), "node")
    parts = sized.groupBy("key", "comp").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.sum("members") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    lists = parts.groupBy("key").agg(F.max(F.struct("members", "comp"))["comp"].alias("big"), blocks)
    rows = split.select("key", "node", "comp").join(lists, "key").withColumn("stray", F.col("comp") != F.col("big")).withColumn("home", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    home = rows.select("key", F.col("home").alias("block"), F.lit(False).alias("visits"), "stray", "node", "comp")
    away = rows.where("stray").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visits"), "stray", "node", "comp")
    rows = home.union(away).join(known, "node").select("key", "block", "visits", "stray", "node", "comp", "n", "signature", "sketch", "mask")
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "visits")


def put_together(edges: DataFrame) -> DataFrame:
    """As `components`, by union-find in one task."""
    kind = edges.schema["a"].dataType

    def run(batches):
        up = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((top(a), top(b)))
                up[high] = low
        node = pa.array(list(up), to_arrow_type(kind))
        yield pa.RecordBatch.from_arrays([node, pa.array(list(map(top, up)), node.type)], ["node", "root"])

    return edges.select("a", "b").repartition(1).mapInArrow(run, f"node {kind.simpleString()}, root {kind.simpleString()}")


def components(edges: DataFrame, few: bool = False) -> DataFrame:
    """(node, root) of every node in `edges` (a, b): the least node that can be reached. Labels spread and are shortened in turn,
    each round a written table. `few` says that there are at most ONE_TASK edges: so many rounds of tiny tables would only fill
    the driver with plans, threads and broadcasts."""
    if few:
        return staged(put_together(edges), "labels")
    both = staged(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels, before = staged(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "labels"), None
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        nxt = staged(step.join(up, "root").select("node", F.least("root", "top").alias("root"), (F.least("root", "top") != F.col("old")).alias("moved")), "labels")
        dropped(before or labels)
        labels, before = nxt.select("node", "root"), nxt
        if nxt.where("moved").isEmpty():
            dropped(both)
            return labels


def merged(found: DataFrame | None, new: DataFrame, links: int) -> DataFrame:
    """(node, root) with the links `new` (a, b), so many of them, added: components of the components that they join, not of all links."""
    few = links <= ONE_TASK
    if found is None:
        return components(new, few)
    ends = new.join(found.toDF("a", "ra"), "a", "left").join(found.toDF("b", "rb"), "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    ends = staged(ends, "ends")
    joined = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), few).toDF("root", "top")
    nodes = found.union(ends.select("a", "ra")).union(ends.select("b", "rb")).distinct()
    out = staged(nodes.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "found")
    dropped(found, joined, ends)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", coordinates: int = COORDINATES, matches: int = MATCHES, rounds: int = ROUNDS, mark: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept): documents linked when 100 * |A and B| >= percent * |A or B|.

    component_id is the smallest id that links lead to, itself included; kept marks the row with that id.
    A text that is null or without words has no shingles and is linked with nothing. Equal texts are
    linked, so of repeated rows all have one component. A null id is never a component's id unless all
    its members' ids are null; such rows and rows alone are kept. Other columns play no part. An empty
    table gives an empty table. With `mark`, a column of that name holds each text's xxhash64.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = staged(signed(docs.withColumn("mark", F.xxhash64("text")) if mark else docs, shingle, coordinates), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "n", "signature"))  # an id is null only where the whole class has none
    classes = base.where("n > 0").groupBy("node").agg(first.alias("x")).select("node", "x.id", "x.signature")
    classes = staged(classes, "classes")
    posts = classes.select("node", F.posexplode("signature").alias("place", "key"))
    often = staged(posts.groupBy("key").count().where("count > 1"), "often")
    shared = posts.join(F.broadcast(often) if often.count() <= BROADCAST_ROWS else often, "key")
    mine = W.partitionBy("node")
    prefix = coordinates - matches + 1
    shared = shared.withColumn("has", F.count("*").over(mine)).where(F.col("has") >= matches)
    shared = shared.withColumn("turn", F.row_number().over(mine.orderBy("count", "key")) + coordinates - F.col("has")).where(F.col("turn") <= prefix)
    before = staged(shared.select("node", "place", "key"), "postings")
    met = before.groupBy("key").count().where("count > 1").select("key")
    posts = staged(before.join(met, "key").select("node", "place", "key"), "postings")
    dropped(often, before)

    alive = posts.select("node").distinct().join(classes, "node")
    alive = staged(alive.select("node", "id", "signature"), "alive")
    found = None
    if not alive.isEmpty():
        wanted = alive.select("id").distinct()
        few = alive.count() <= BROADCAST_ROWS  # ids of at most so many classes are broadcast, more are joined by a shuffle
        sets = full_sets(docs.join(F.broadcast(wanted) if few else wanted, "id", "left_semi"), shingle).join(alive.select("node"), "node", "left_semi")
        nameless = alive.where("id is null").select("node")
        if not nameless.isEmpty():  # no id leads to these: all rows without one are gone through
            texts = docs.where("id is null").dropDuplicates(["text"])
            sets = sets.unionByName(full_sets(texts, shingle).join(nameless, "node", "left_semi").dropDuplicates(["node"]))
        sets = staged(sets, "sets")
        found = link(posts, alive.select("node", "signature"), sets, percent, matches, rounds)
        dropped(sets)
    dropped(posts, alive, classes)
    members = base.drop("signature")
    if found is None:
        done = members.withColumn("root", F.col("node"))
    else:
        done = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = done.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    out = done.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *([F.col("mark").alias(mark)] if mark else []))


def sets_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of the pairs' nodes alone, where so few are asked for that they can be broadcast: the others aren't shuffled."""
    if 2 * pairs.count() > BROADCAST_ROWS:
        return sets
    return sets.join(F.broadcast(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), "node", "left_semi")


def link(posts: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int, matches: int, rounds: int) -> DataFrame | None:
    """(node, root) of the nodes that have links."""
    tried: list[DataFrame] = []
    found, turn, worth = None, 0, True
    while True:
        at = posts.withColumn("comp", F.col("node")) if found is None else posts.join(found, "node", "left").select("node", "place", "key", F.coalesce("root", "node").alias("comp"))
        drawn = F.xxhash64(F.col("node"), F.lit(turn))  # each round has centres of its own
        ends = at.groupBy("key", "comp").agg(F.min_by("node", drawn).alias("node"))
        chosen = F.min(F.struct(F.xxhash64("comp", F.lit(turn)).alias("turn"), "comp", "node")).alias("head")
        lists = ends.groupBy("key").agg(chosen, F.count("*").alias("comps"))
        heads = staged(lists.where("comps > 1").select("key", "head"), "heads")
        if heads.isEmpty():
            dropped(heads)
            break
        last = turn >= rounds or not worth
        if last:
            split = staged(at.join(heads.select("key"), "key").select("key", "node", "place", "comp"), "split")
            pairs = close_pairs(split_lists(split, signatures, sets), percent, matches).distinct()
        else:
            pairs = ends.join(heads, "key").where(F.col("comp") != F.col("head.comp")).select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct()
        if tried:
            pairs = pairs.join(all_staged(tried, "a", "b"), ["a", "b"], "left_anti")
        short = F.transform("signature", lambda x: F.shiftright(x, 48).cast("smallint"))  # equal values agree, others but once in 65,536: candidates are confirmed
        left, right = signatures.select(F.col("node").alias("a"), short.alias("sa")), signatures.select(F.col("node").alias("b"), short.alias("sb"))
        agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        pairs = pairs if last else pairs.join(left, "a").join(right, "b").select("a", "b", (agree >= matches).alias("candidate"))
        both = F.size(F.array_intersect("x", "y"))
        whole = F.size("x") + F.size("y") - both
        asked = staged(pairs, "pairs")
        wanted = (asked if last else asked.where("candidate")).select("a", "b")
        some = sets_of(wanted, sets)
        x, y = some.select(F.col("node").alias("a"), F.col("shingles").alias("x")), some.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        linked = wanted.join(x, "a").join(y, "b").where(100 * both >= percent * whole)
        new = staged(linked.select("a", "b"), "edges")
        links = new.count()
        if links:
            found = merged(found, new, links)
        dropped(new, heads)
        if last:
            dropped(split, asked)
            break
        tried.append(asked)
        worth = links * WORTH >= asked.count()
        turn += 1
        swept(posts.sparkSession)
    dropped(*tried)
    return found


#: For DuckDB: all pairs through their common shingles, and everything that links reach.
SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE w END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l), r AS (
    SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.m
)
SELECT r.doc_id, any_value(coalesce(n, 0)) AS n_shingles, min(m) AS component_id, r.doc_id = min(m) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=2)
