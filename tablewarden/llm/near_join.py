"""N-gram Jaccard join of whole documents by signature trees.

Documents with one and the same shingle set are one node. Nodes are dealt to tasks by connected groups of
min-hash band collisions (a pair at the threshold misses all bands with probability 1e-11); inside a
group a signature tree finds the links exactly (see ``signature_tree``). A group too large for a task is
the top of a tree whose nodes are dealt out: first blocks that share pivots; then pairs of nodes, of which only
those whose ranges of sizes allow a link are formed, for the sets that the pivots left apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .pretokens import mix
from .shared import BROADCAST_BYTES, bytes_of, looked_up, looked_up_counted, stored
from .signature_tree import links
from .words import BLANK_SEPARATED, shingle_sets, text_chunks, words_of

SHINGLE = 5
BANDS, ROWS = 48, 4
#: Postings in a bucket, and shingles in a task of the tree join: both bound a task's memory.
BUCKET_POSTINGS = 1_000_000
TASK_SHINGLES = 200_000
PIVOTS = 16
_LOCAL = 400_000
#: Sets that a task remembers to have posted; one that is posted again does no harm.
_SEEN = 1_000_000

_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_TWO = np.uint64(0xA24BAED4963EE407)


def band_keys(values: np.ndarray, bounds: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Min-hash band keys of non-empty sets: an array of sets by bands."""
    n = len(bounds) - 1
    out = np.zeros((n, bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(n, b + 1, dtype=np.uint64)
        for r in range(rows):
            key = mix(key + np.minimum.reduceat(values * _FACTORS[b * rows + r], bounds[:-1]))
        out[:, b] = key
    return out


def set_ids(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of every set (zeros for an empty one)."""
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    out = [np.zeros(len(size), np.uint64) for _ in range(2)]
    if len(some):
        at = bounds[:-1][some]
        for x, seed in zip(out, (np.uint64(0), _TWO), strict=True):
            x[some] = mix(np.add.reduceat(mix(values ^ seed), at) + size[some].astype(np.uint64))
    return out[0], out[1]


class Postings:
    """A task's postings: keys that meet in the task are chained there, and one of each goes on."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.held, self.n = buckets, [], 0

    def add(self, keys: np.ndarray, nodes: np.ndarray) -> None:
        self.held.append((keys.ravel(), np.repeat(nodes, keys.shape[1])))
        self.n += keys.size

    def flush(self) -> tuple[list[int], list[bytes], np.ndarray]:
        if not self.n:
            return [], [], np.empty((0, 2), np.uint64)
        keys, nodes = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        keys, nodes, edges = chained(keys, nodes)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, nodes, bucket = keys[order], nodes[order], bucket[order]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        blobs = [np.stack([k, v]).tobytes() for k, v in zip(np.split(keys, cuts[1:]), np.split(nodes, cuts[1:]), strict=True)]
        return bucket[cuts].tolist(), blobs, edges


def chained(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least node of every key, and distinct edges from it to all other nodes of the key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
    least = nodes[first][np.cumsum(first) - 1] if len(keys) else nodes
    at = np.flatnonzero(nodes != least)
    if not len(at):
        return keys[first], nodes[first], np.empty((0, 2), np.uint64)
    # distinct edges by one sort of a fingerprint: far cheaper than by rows
    u, v = least[at], nodes[at]
    _, pick = np.unique(mix(u) + v * np.uint64(3), return_index=True)
    return keys[first], nodes[first], np.stack([u[pick], v[pick]], axis=1)


_PASS = "doc_id long, n long, s1 long, s2 long, bucket long, blob binary, u long, v long"


def _signatures(buckets: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, seen = Postings(buckets), set()
        none = lambda n, t: pa.nulls(n, t)
        names = [x.split()[0] for x in _PASS.split(", ")]

        def flushed() -> Iterator[pa.RecordBatch]:
            bucket, blobs, edges = postings.flush()
            if n := len(bucket):
                yield pa.RecordBatch.from_arrays([*(none(n, pa.int64()) for _ in range(4)), pa.array(bucket, pa.int64()), pa.array(blobs, pa.binary()), none(n, pa.int64()), none(n, pa.int64())], names=names)
            if n := len(edges):
                yield pa.RecordBatch.from_arrays([*(none(n, pa.int64()) for _ in range(5)), none(n, pa.binary()), *(pa.array(np.ascontiguousarray(edges[:, k]).view(np.int64)) for k in (0, 1))], names=names)

        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            real = np.array(pc.is_valid(batch.column(0)))
            for first, last, raw, ends in text_chunks(text):
                values, bounds = shingle_sets(words_of(raw, ends, BLANK_SEPARATED), SHINGLE)
                s1, s2 = set_ids(values, bounds)
                n = last - first
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(bounds)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.int64()), none(n, pa.int64())], names=names)
                new = []
                for i, x in enumerate(s1.tolist()):
                    if bounds[i + 1] > bounds[i] and real[first + i] and x not in seen:
                        seen.add(x)
                        new.append(i)
                if new:
                    size = np.diff(bounds)[new]
                    some = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in new])
                    postings.add(band_keys(some, np.concatenate([[0], np.cumsum(size)])), s1[new])
                if postings.n >= _LOCAL:
                    yield from flushed()
                if len(seen) > _SEEN:
                    seen.clear()
        yield from flushed()

    return scan


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in table["blob"].to_pylist()]
    keys, nodes = np.concatenate(parts, axis=1)
    _, _, edges = chained(keys, nodes)
    return pa.table({k: pa.array(np.ascontiguousarray(edges[:, i]).view(np.int64)) for i, k in enumerate("uv")})


def _sets(rows: DataFrame) -> DataFrame:
    """``doc_id, node, text, ...`` -> the rows with ``values`` (the set), where the text is the node's."""
    extra = [c for c in rows.columns if c != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            node = np.asarray(batch.column("node"))
            keep, blobs = [], []
            for first, _, raw, ends in text_chunks(text):
                values, bounds = shingle_sets(words_of(raw, ends, BLANK_SEPARATED), SHINGLE)
                s1, _ = set_ids(values, bounds)
                for i, x in enumerate(s1.view(np.int64).tolist()):
                    if x == node[first + i]:
                        keep.append(first + i)
                        blobs.append(values[bounds[i] : bounds[i + 1]].tobytes())
            some = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in extra), pa.array(blobs, pa.binary())], names=[*extra, "values"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(scan, schema + ", values binary")


def _tree_task(percent: int):
    def join(key: tuple, table: pa.Table) -> pa.Table:
        """One task's groups, each by its own tree."""
        node, label, group = (np.asarray(table[c]) for c in ("node", "label", "component"))
        blobs = table["values"]
        order = np.lexsort((node, group))
        keep = order[np.append(True, (node[order][1:] != node[order][:-1]) | (group[order][1:] != group[order][:-1]))]
        u, v = [], []
        cuts = np.flatnonzero(np.append(True, group[keep][1:] != group[keep][:-1]))
        for some in np.split(keep, cuts[1:]):
            if len(some) < 2:
                continue
            sets = [np.frombuffer(blobs[int(i)].as_buffer(), np.uint64) for i in some]
            bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            for a, b in links(np.concatenate(sets), bounds, label[some], percent):
                u.append(node[some[a]]), v.append(node[some[b]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return join


def _upto(n: Column) -> Column:
    """One row for each of 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def _tree_links(sets: DataFrame, percent: int, task_shingles: int) -> DataFrame:
    """Links between the sets of each component (``component, node, n, values``)."""
    task = _tree_task(percent)
    sizes = sets.groupBy("component").agg(F.sum("n").alias("total"))
    total = sizes.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    bins = max(int(total // task_shingles) * 2, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # groups beyond a task's size: fewer than tasks, and broadcast only if their list is small by its bytes
    large = stored(sizes.where(F.col("total") > task_shingles), "large-groups")
    some = not large.isEmpty()
    listed = large.select("component")
    whole = sets.join(F.broadcast(listed) if bytes_of(large) <= BROADCAST_BYTES else listed, "component", "left_anti") if some else sets
    whole = whole.withColumn("label", F.col("node")).withColumn("task", F.pmod(F.xxhash64("component"), F.lit(bins)))
    fields = ["component", "node", "label", "values"]
    found = stored(whole.select("task", *fields).groupBy("task").applyInArrow(task, "u long, v long"), "links")
    if not some:
        return found
    half = task_shingles // 2
    # blocks of a large group, each with the group's pivots
    blocks = F.ceil(F.col("total") / F.lit(half))
    rows = looked_up(sets, large, ["component"]).withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PIVOTS)))
    pivots = stored(rows.groupBy("component", "salt").agg(F.min("node").alias("node")).drop("salt"), "pivots")
    shared = looked_up(rows, pivots, ["component", "node"]).withColumn("block", _upto(blocks))
    first = rows.unionByName(shared).withColumn("label", F.col("node")).select("block", *fields)
    found = stored(found.union(first.groupBy("component", "block").applyInArrow(task, "u long, v long")), "links")
    # sets whose sizes lie more than one step apart cannot be similar enough: a step is one node of the tree
    labels = components(found)
    step = F.floor(F.log(100.1 / percent, F.col("n").cast("double"))).cast("int")
    named = rows.join(labels.select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("step", step)
    main = stored(named.groupBy("component", "label").agg(F.count("*").alias("m")).groupBy("component").agg(F.max_by("label", "m").alias("main")), "main-components")
    named = stored(looked_up(named, main, ["component"]).select("component", "node", "label", "main", "n", "step", "values"), "large-sets")
    rest = named.where("label <> main")
    if rest.isEmpty():
        return found
    # what the pivots did not bring into the group's main component meets every node that it may have a link to
    count = lambda df, name: stored(df.groupBy("component", "step").agg(F.ceil(F.sum("n") / F.lit(half)).alias(name)), name)
    mine, theirs = count(rest, "chunks"), count(named, "nodes")
    near = F.explode(F.array(*(F.col("step") + d for d in (-1, 0, 1))))
    left = looked_up(named.withColumn("to", near), mine.withColumnRenamed("step", "to"), ["component", "to"])
    left = looked_up(left, theirs, ["component", "step"]).withColumn("node_of", F.pmod(F.xxhash64("node", F.lit(3)), F.col("nodes"))).withColumn("chunk", _upto(F.col("chunks")))
    right = looked_up(rest.withColumn("from", near), theirs.withColumnRenamed("step", "from"), ["component", "from"])
    right = looked_up(right, mine, ["component", "step"]).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks"))).withColumn("node_of", _upto(F.col("nodes")))
    pairs = left.select("to", "chunk", F.col("step").alias("from"), "node_of", *fields).unionByName(right.select(F.col("step").alias("to"), "chunk", "from", "node_of", *fields))
    return found.union(pairs.groupBy("component", "to", "chunk", "from", "node_of").applyInArrow(task, "u long, v long"))


def near_classes(documents: DataFrame, percent: int = 80, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Words stand between white space (0x20, 0x09 to 0x0D), A-Z lower-cased; a set holds the distinct runs
    of five words, or the whole sequence if there are fewer; ``100 * intersection >= percent * union``
    links. ``component_id`` is the smallest ``doc_id`` that links reach. Null and empty texts have empty
    sets and link with nothing. A row without ``doc_id`` has its set's size and no component. Repeated
    rows stay, rows with one id and different texts each go by their text, an empty table gives an empty
    result, other columns play no part. ``percent`` below 80 weakens the bands' guarantee.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(documents.count() * BANDS // BUCKET_POSTINGS, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scanned = stored(rows.mapInArrow(_signatures(buckets), _PASS), "near-signatures")
    docs = scanned.where("s1 is not null").select("doc_id", "n", "s1", "s2")
    met = scanned.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_meet, "u long, v long")
    edges = scanned.where("u is not null").select("u", "v").union(met)
    groups = components(edges)
    classes = stored(docs.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "near-classes")
    wanted = stored(groups.join(classes, groups["node"] == classes["s1"]).select("component", "node", F.col("least").alias("doc_id"), "n"), "near-candidates")
    asked = rows.join(F.broadcast(wanted), "doc_id") if bytes_of(wanted) <= BROADCAST_BYTES else rows.join(wanted, "doc_id")
    sets = stored(_sets(asked.select("component", "node", "n", "text")), "near-sets")
    found = components(_tree_links(sets, percent, task_shingles))
    named = classes.join(found.withColumnRenamed("node", "s1"), "s1", "left")
    # a class that has neither copies nor links is its own component and needs no look-up
    several = stored(named.where("copies > 1 or component is not null").withColumn("a", F.coalesce("component", "s1")).withColumn("b", F.when(F.col("component").isNull(), F.col("s2")).otherwise(F.lit(0))), "near-several")
    least = stored(several.groupBy("a", "b").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "near-least")
    by_class = stored(looked_up_counted(several, least, ["a", "b"], "members").select("s1", "s2", "component_id", "copies"), "near-components")
    real = docs.where("n > 0 and doc_id is not null")
    out = looked_up_counted(real, by_class, ["s1", "s2"], "copies", "left").select("doc_id", "n", "component_id").unionByName(docs.where("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
