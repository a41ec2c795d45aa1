"""Operator 4: near duplicates by a chosen-path set similarity join.

Each document's set of word shingles is embedded into ``TOKENS`` minwise tokens. A tree branches its documents recursively: the
path so far selects which minwise token a node reads next (and, for a share of the nodes, a second one, so that on average
``1 / similarity`` branches leave a node), and documents with one value go on together. Nodes of up to ``node_size`` documents
are compared exhaustively on full sets. Independent trees are repeated until a pair at the threshold shares a first node with
the target recall: a pair of similarity s is missed with probability ``(1 - s) ** trees``.

Large nodes, mostly families of near copies, never meet in one task:
- documents with equal sets are one row from the start;
- nodes that lie in one component are done, as no further link can change a component;
- where at most ``10 * node_size`` documents of a large node lie outside its largest component, those are compared with the whole
  node, so that no pair of it is lost;
- any other large node branches on, ``levels`` deep, and at every level it is also cut into blocks of ``node_size`` that share one
  pivot, which links a family in linear work however slowly its nodes shrink;
- in a node that is large at the last level and still mixed, the documents outside its largest component, however many, are compared
  with all of its blocks.

Before sets travel, the documents of a block are compared on sketches of one byte a minwise token. Those whose sketches agree as a
pair at the threshold would (less five standard errors) form candidate groups; groups that several trees find are compared once.
The sets themselves travel only for documents of candidate groups; a Bloom filter of bounded size keeps the rest from being rebuilt.

Cases: null and empty texts have no shingles and link with nothing; a class is named by its smallest id that isn't null; a text of fewer words than a shingle is one shingle; rows
with equal sets are one class; rows that share an id are told apart by their sets; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bspgraph.llm.bloom import bloom, with_maybe
from bspgraph.llm.components import connected_components
from bspgraph.llm.shared import Scratch, bounded_batches
from bspgraph.llm.textops import Words, chunks, mix, trimmed

TOKENS = 64
_rng = np.random.default_rng(20_24)
_MULT = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, TOKENS, dtype=np.uint64)
BROADCAST_ROWS = 500_000


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each document's ascending distinct 64-bit shingle hashes."""
    words = Words(texts, lower=True)
    word_hash = words.hashes()
    h, at = words.windows(word_hash, size)
    doc = words.doc[at]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for k in range(len(texts)):
        if cut[k] < cut[k + 1]:
            out.append(np.unique(h[cut[k] : cut[k + 1]]))
            continue
        own = word_hash[words.first[k] : words.first[k + 1]]
        if len(own):
            whole = np.full(1, len(own), np.uint64)
            for x in own:
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(values: np.ndarray) -> np.ndarray:
    """The minwise tokens of one set."""
    best = np.full(TOKENS, 2**64 - 1, np.uint64)
    for k in range(0, len(values), 4096):
        part = values[k : k + 4096]
        best = np.minimum(best, (part[:, None] * _MULT + _ADD).min(0))
    return (mix(best) >> np.uint64(32)).astype(np.uint32)


def digest(values: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = mix(values ^ np.uint64(0x2545F4914F6CDD1D))
    b = mix(values * np.uint64(0xDA942042E4DD58B5) + np.uint64(7))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64) + np.uint64(len(values))], np.uint64).tobytes()


def branches(root: np.ndarray, tokens: np.ndarray, similarity: float, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the nodes, level by level, of every branch that the rows take down one tree."""
    row, path = branch(np.repeat(root, len(tokens)), tokens, similarity)
    nodes = path[:, None]
    for _ in range(levels - 1):
        step, path = branch(path, tokens[row], similarity)
        row, nodes = row[step], np.concatenate([nodes[step], path[:, None]], 1)
    return row, nodes


def branch(path: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of (path, minwise tokens) rows: row numbers and new paths."""
    rows = np.arange(len(path))
    second = mix(path + np.uint64(0x51ED27)) < np.uint64(int((1 / similarity - 1) * 2**64))
    row = np.concatenate([rows, rows[second]])
    which = np.concatenate([mix(path + np.uint64(1)), mix(path[second] + np.uint64(2))])
    index = (which % np.uint64(TOKENS)).astype(np.int64)
    return row, mix(path[row] ^ mix(tokens[row, index].astype(np.uint64) + index.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _sketches(size: int, trees: int, similarity: float, levels: int):
    # The trees' first tokens are distinct ones, so that the trees are independent.
    roots = []
    for tree in range(10_000):
        root = np.array([tree], np.uint64)
        if len(roots) < trees and all(_first(root) != _first(x) for x in roots):
            roots.append(root)

    def rows(batches):
        for batch in chunks(batches, 1):
            sets = shingle_sets(batch.column(1).fill_null(""), size)
            tokens = np.stack([minwise(x) for x in sets])
            paths: list[list[list[int]]] = [[] for _ in sets]
            for tree, root in enumerate(roots):
                row, nodes = branches(root, tokens, similarity, levels)
                for r, p in zip(row.tolist(), nodes.view(np.int64).tolist(), strict=True):
                    paths[r].append([tree, *p])
            n = [len(x) for x in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([digest(x) for x in sets], pa.binary()),
                pa.array([x if k else [] for x, k in zip(paths, n, strict=True)], pa.list_(pa.list_(pa.int64()))),
                pa.array([x.astype(np.uint8).tobytes() for x in tokens], pa.binary()),
            ], ["id", "key", "n_shingles", "digest", "paths", "sketch"])

    return rows


def _first(root: np.ndarray) -> int:
    return int(mix(root + np.uint64(1))[0] % np.uint64(TOKENS))


def links_of_block(names: list[bytes], sets: list[np.ndarray], roots: list[bytes], outside: list[bool], percent: int) -> list[tuple[bytes, bytes]]:
    """Links of one block that join different components; in a two-sided block only pairs with an outsider are compared."""
    n = len(names)
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    seen: dict[bytes, int] = {}
    for k, root in enumerate(roots):
        up[k] = seen.setdefault(root, k)
    size = [len(x) for x in sets]
    order = sorted(range(n), key=size.__getitem__)
    two_sided, out = any(outside), []
    for p, i in enumerate(order):
        for j in order[p + 1 :]:
            if size[i] * 100 < percent * size[j]:
                break
            if (two_sided and not (outside[i] or outside[j])) or find(i) == find(j):
                continue
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * common >= percent * (size[i] + size[j] - common):
                up[find(i)] = find(j)
                out.append((names[i], names[j]))
    return out


def candidate_groups(sketches: np.ndarray, roots: list[bytes], outside: list[bool], least: int) -> list[list[int]]:
    """Row numbers of one block that agree in ``least`` tokens, directly or through others; groups of one component are left out."""
    n = len(roots)
    close = np.zeros((n, n), bool)
    for k in range(n):
        close[k] = (sketches[k] == sketches).sum(1) >= least
    names = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    root = np.array([names[r] for r in roots])
    close &= root[:, None] != root
    if any(outside):
        side = np.array(outside)
        close &= side[:, None] | side
    left, out = set(np.flatnonzero(close.any(1)).tolist()), []
    while left:
        group, ahead = [], [left.pop()]
        while ahead:
            k = ahead.pop()
            group.append(k)
            new = left.intersection(np.flatnonzero(close[k]).tolist())
            left -= new
            ahead += new
        out.append(sorted(group))
    return out


def _candidates(least: int):
    """Rows (block, digest, root, outside, sketch), sorted by block, to (name, digest, root, outside) of candidate groups."""
    def of(held: dict) -> list[tuple[int, bytes, bytes, bool]]:
        if len(held) < 2:
            return []
        names, rows = list(held), list(held.values())
        sketches = np.frombuffer(b"".join(x[2] for x in rows), np.uint8).reshape(len(rows), TOKENS)
        outside = [x[1] for x in rows]
        found = []
        for group in candidate_groups(sketches, [x[0] for x in rows], outside, least):
            members = sorted(names[k] for k in group)
            # Equal groups get equal names, whichever block found them.
            name = int.from_bytes(hashlib.blake2b(b"".join(members) + bytes(outside[k] for k in group), digest_size=8).digest(), "little", signed=True)
            found += [(name, names[k], rows[k][0], outside[k]) for k in group]
        return found

    def rows(batches):
        held: dict[bytes, tuple[bytes, bool, bytes]] = {}
        block = None
        for batch in batches:
            found = []
            for b, name, root, outside, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    found += of(held)
                    block, held = b, {}
                held[name] = (root, bool(outside or (name in held and held[name][1])), sketch)
            yield _groups(found)
        yield _groups(of(held))

    return rows


def _groups(found: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], ["block", "digest", "root", "outside"])


def pack_set(values: np.ndarray) -> bytes:
    """An ascending set at 48 bits a shingle, as compressed deltas: about 5 bytes each."""
    steps = np.diff(values >> np.uint64(16), prepend=np.uint64(0))
    return len(values).to_bytes(4, "little") + zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:6]).tobytes(), 1)


def unpack_set(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[:6] = np.frombuffer(zstandard.decompress(blob[4:]), np.uint8).reshape(6, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(n), dtype=np.uint64)


def _compare(percent: int):
    """Rows (block, digest, root, outside, set), sorted by block, to links; a block is held only while it is read."""
    def rows(batches):
        held: dict[bytes, tuple[np.ndarray, bytes, bool]] = {}
        block = None
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for b, name, root, outside, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    found += links_of_block(list(held), [x[0] for x in held.values()], [x[1] for x in held.values()], [x[2] for x in held.values()], percent)
                    block, held = b, {}
                old = held.get(name)
                held[name] = (unpack_set(values), root, bool(outside or (old and old[2])))
            yield _links(found)
        yield _links(links_of_block(list(held), [x[0] for x in held.values()], [x[1] for x in held.values()], [x[2] for x in held.values()], percent))

    return rows


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.binary()), pa.array([max(x) for x in found], pa.binary())], ["a", "b"])


class _Join:
    """State of one run: documents, classes, links and components so far."""

    def __init__(self, spark, docs, id_column, text_column, size, percent, trees, node_size, levels):
        self.spark, self.size, self.percent, self.node_size, self.levels = spark, size, percent, node_size, levels
        bounded_batches(spark)
        self.similarity = percent / 100
        # Of documents that meet others side by side: each is repeated once for every block of the other side.
        self.wide = node_size * 10
        self.scratch = Scratch(spark, "neardup")
        self.source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("key"))
        sketch = "id long, key long, n_shingles long, digest binary, paths array<array<long>>, sketch binary"
        self.sketches = self.scratch.save(self.source.mapInArrow(trimmed(_sketches(size, trees, self.similarity, levels)), sketch), "sketches")
        self.classes = self.scratch.save(
            self.sketches.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("keep"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")), "classes"
        )
        self.links: list[DataFrame] = []
        self.roots: DataFrame | None = None

    def rooted(self, members: DataFrame) -> DataFrame:
        """``members`` (.., digest) with the root of each."""
        if self.roots is None:
            return members.withColumn("root", F.col("digest"))
        return members.join(self.roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))

    def mixed(self, members: DataFrame, path: str) -> DataFrame:
        """Members (with root) of nodes that hold several components, with the node's size ``n``, its ``pivot`` and its last root.

        The nodes are a table of their own, so that the join with a node's many members can be split.
        """
        nodes = members.groupBy(path).agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("digest").alias("pivot")).where("r0 != r1")
        return self.scratch.save(members.join(self.scratch.save(nodes.drop("r0"), "mixed-nodes"), path), "nodes")

    def sided(self, rows: DataFrame) -> DataFrame:
        """Members of nodes with the node's largest component ``main`` and how many documents lie outside it."""
        if self.roots is None:  # every document is a component
            return rows.select("*", F.col("r1").alias("main"), (F.col("n") - 1).alias("outsiders"))
        if rows.isEmpty():
            return rows.select("*", F.col("r1").alias("main"), F.col("n").alias("outsiders"))
        parts = rows.groupBy("path", "root").agg(F.count("*").alias("c"))
        sizes = parts.groupBy("path").agg(F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("c") - F.max("c")).alias("outsiders"))
        return self.scratch.save(rows.join(self.scratch.save(sizes, "sizes"), "path"), "large")

    def meetings(self, rows: DataFrame) -> list[DataFrame]:
        """Blocks in which the documents outside a node's largest component meet all documents of the node."""
        sides, number = F.ceil(F.col("outsiders") / self.wide), F.ceil(F.col("n") / self.wide)
        spread = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
        outer = rows.where("root != main").select("path", "digest", "root", F.pmod(F.xxhash64("digest", F.lit(1)), sides).alias("side"), spread(number).alias("part"))
        inner = rows.select("path", "digest", "root", F.pmod(F.xxhash64("digest"), number).alias("part"), spread(sides).alias("side"))
        return [x.select(F.struct("path", "side", "part").alias("block"), "digest", "root", F.lit(out).alias("outside")) for x, out in ((outer, True), (inner, False))]

    def parts(self):
        """Number of blocks of a node, and a member's block."""
        n = F.ceil(F.col("n") / self.node_size)
        return n, F.pmod(F.xxhash64("digest"), n)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(digest, set) of the wanted classes, rebuilt from the texts of their representatives."""
        reps = wanted.join(self.classes.select("digest", "rep"), "digest").select("rep")
        marked = with_maybe(self.source.select("id", "text"), bloom(reps, F.xxhash64("rep")), F.xxhash64("id")).where("_maybe").select("text")
        size = self.size

        def rows(batches):
            for batch in chunks(batches, 0):
                sets = shingle_sets(batch.column(0).fill_null(""), size)
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.binary()), pa.array([pack_set(x) for x in sets], pa.binary())], ["digest", "set"])

        return marked.mapInArrow(trimmed(rows), "digest binary, set binary")

    def compare(self, blocks: DataFrame) -> None:
        """Compare (block, digest, root, outside) rows and fold the links found into the components."""
        least = math.floor(TOKENS * self.similarity - 5 * math.sqrt(TOKENS * self.similarity * (1 - self.similarity)))
        rows = blocks.join(self.classes.select("digest", "sketch"), "digest").select("block", "digest", "root", "outside", "sketch")
        groups = rows.repartition("block").sortWithinPartitions("block").mapInArrow(trimmed(_candidates(least)), "block long, digest binary, root binary, outside boolean")
        groups = self.scratch.save(groups.dropDuplicates(["block", "digest"]), "groups")
        if groups.isEmpty():
            return
        rows = groups.join(self.sets(groups.select("digest").distinct()), "digest").select("block", "digest", "root", "outside", "set")
        found = rows.repartition("block").sortWithinPartitions("block").mapInArrow(trimmed(_compare(self.percent)), "a binary, b binary")
        found = self.scratch.save(found.distinct(), "links")
        self.scratch.drop(groups)
        if found.isEmpty():
            return
        old = [self.roots.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a < b")] if self.roots is not None else []
        edges = found
        for x in old:
            edges = edges.unionByName(x)
        roots = self.scratch.save(connected_components(edges, self.scratch), "roots")
        if self.roots is not None:
            self.scratch.drop(self.roots)
        self.roots = roots
        self.scratch.drop(found)

    def descend(self, trees: Column) -> None:
        """Decide every node of the trees (``p[0]``) asked for; ``paths`` are the nodes of one branch from the first level on."""
        branches = self.rooted(self.classes.select("digest", "paths")).select("digest", "root", F.explode("paths").alias("p")).where(trees)
        left = branches.select("digest", "root", F.expr("slice(p, 2, size(p))").alias("paths"))
        blocks, number, part = [], *self.parts()
        block = lambda part: F.struct("path", F.lit(-1).cast("long").alias("side"), part.cast("long").alias("part"))
        flat = lambda df, part: df.select(block(part).alias("block"), "digest", "root", F.lit(False).alias("outside"))
        for level in range(self.levels):
            now = self.mixed(left.withColumn("path", F.col("paths")[level]), "path")
            blocks.append(flat(now.where(F.col("n") <= self.node_size), F.lit(0)))
            left = self.sided(now.where(F.col("n") > self.node_size))
            # Few documents outside the largest component meet the whole node at once.
            blocks += self.meetings(left.where(F.col("outsiders") <= self.wide))
            left = left.where(F.col("outsiders") > self.wide)
            if left.isEmpty():
                left = None
                break
            # A family of near copies is linked through its pivot here, however slowly its nodes shrink.
            blocks.append(flat(left, part))
            pivots = left.where("digest = pivot").select("path", "digest", "root", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("part"))
            blocks.append(flat(pivots, F.col("part")))
            left = left.select("paths", "path", "digest", "root")
        self.compare(reduce(DataFrame.unionByName, blocks))
        if left is None:
            return
        # Nodes that are large at the last level and still hold several components: as above, however many are outside.
        left = self.scratch.save(self.rooted(left.select("path", "digest").distinct()), "last")
        left = self.mixed(left, "path")
        if not left.isEmpty():
            self.compare(reduce(DataFrame.unionByName, self.meetings(self.sided(left))))


def _judged(
    spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80,
    recall: float = 0.99999, node_size: int = 48, levels: int = 3,
) -> DataFrame:
    """(id, key, n_shingles, component_id, stays) of every row; of each class the rows of one (id, text) stay, the least by id (nulls last), digest and key."""
    trees = max(2, math.ceil(math.log(1 - recall) / math.log(1 - percent / 100)))
    run = _Join(spark, docs, id_column, text_column, shingle, percent, trees, node_size, levels)
    # The first tree alone: it finds most links, and what it decides need not travel again for the others.
    run.descend(F.col("p")[0] == 0)
    run.descend(F.col("p")[0] > 0)
    lowest = run.classes.select("digest", "rep", F.struct("keep.none", "keep.id", "digest", "keep.key").alias("keep"))
    if run.roots is not None:
        joined = lowest.join(run.roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        least = run.scratch.save(joined.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("keep").alias("keep")), "least")
        lowest = joined.drop("keep").join(least, "root").select("digest", "component_id", "keep")
    else:
        lowest = lowest.withColumnRenamed("rep", "component_id")
    out = run.sketches.select("id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(lowest, "digest", "left")
    stays = F.col("keep").isNull() | (F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("key") == F.col("keep.key")))
    return out.select("id", "key", "n_shingles", F.coalesce("component_id", "id").alias("component_id"), stays.alias("stays"))


def near_duplicates(
    spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80,
    recall: float = 0.99999, node_size: int = 48, levels: int = 3,
) -> DataFrame:
    """(id, key, n_shingles, component_id, kept) of every row, key being the text's xxhash64; documents are linked at 100 * common >= percent * united shingles."""
    out = _judged(spark, docs, id_column, text_column, shingle, percent, recall, node_size, levels)
    return out.select(F.col("id").alias(id_column), "key", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each class: one with the least id, of several the least by digest. Rows equal in id and text are one document."""
    scratch = Scratch(spark, "kept")
    found = _judged(spark, docs, id_column, text_column, shingle, percent)
    found = scratch.save(found.select(F.col("id").alias("i"), "key", "stays"), "found")
    gone = scratch.save(found.where(~F.col("stays")).select("i", "key").distinct(), "gone")
    # Ids of the removed documents are broadcast while they are few and joined by shuffle beyond that.
    rows = gone.count()
    match = docs[id_column].cast("long").eqNullSafe(gone["i"]) & (F.xxhash64(docs[text_column]) == gone["key"])
    left = docs.join(F.broadcast(gone) if rows <= BROADCAST_ROWS else gone, match, "left_anti")
    if found.where("stays").groupBy("i", "key").count().where("count > 1").isEmpty():
        return left
    return left.dropDuplicates([id_column, text_column])


#: The query op4 in DuckDB SQL.
ORACLE = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
cut AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM t WHERE len(w) > 0),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[s : s + 2], ' ') AS g FROM cut),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS far FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.far = edges.a),
low AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY 1)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.component_id, t.doc_id) AS component_id, coalesce(low.component_id, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n ON t.doc_id = n.doc_id LEFT JOIN low ON t.doc_id = low.doc_id
"""
