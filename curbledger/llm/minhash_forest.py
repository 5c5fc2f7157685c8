"""Near-duplicate documents by an LSH forest over MinHash signatures.

* Documents with the same set of word shingles are one node (copies are never paired).
* A node's signature has 60 MinHash values.  Each of 20 trees sorts the nodes by the signature in an
  order of its own: tree t starts at value 3t.  Nodes that share the first three values form a region.
  Within a region the sort goes on by the next values, so neighbours have the longest common
  prefixes: where a region is dense the neighbours agree to a greater depth, where it is sparse
  three values do.  Two sets of similarity 0.8 share a region in some tree with probability
  1 - (1 - 0.8 ** 3) ** 20 = 1 - 6e-7.
* First, each node is a candidate with its next neighbour in each tree, and, where that one does not agree to
  depth `DENSE`, with the next `WIDTH`: dense regions are chained by close neighbours.  The sorted orders are
  range partitions, so a region of any size spreads over blocks; block borders meet in a second step.
* Candidates are confirmed on the full sets, best supported pairs first.  Pairs whose nodes are
  connected already need no look: components are the result, and in a group of n near copies
  about n pairs are compared rather than n * n / 2.  All pairs left after `ROUNDS` rounds are compared.
* Then every region whose nodes are not all connected is compared whole: all pairs of nodes of different
  components, one by one in regions of up to `SMALL` nodes, and in blocks of about `BLOCK` nodes (on full sets, too) in
  larger ones.  So each pair that shares a region is compared or connected, however crowded the region is.
  This grows with the square of the nodes of a crowd that stay apart, such as texts of one template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbledger.llm.components import connected, extended
from curbledger.llm import words as W
from curbledger.session import discard, near, stored

TREES, DEPTH, TAIL = 20, 3, 8
VALUES = TREES * DEPTH
WIDTH = 2
DENSE = 6  # a neighbour that agrees to this depth is enough
ROUNDS = 4
SMALL = 16   # nodes of a region whose pairs are listed
BLOCK = 256  # nodes of a larger region that are compared with as many others at a time
NO_ID = -(1 << 63)  # stands for a NULL document id: before all others

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text in ascending order, and their bounds.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    w = W.split(texts, lower=True)
    h, counts = w.hashes(), w.counts()
    text = w.text_of()
    full = W.windows(h, size)
    inside = w.window_ends_inside(size)[:len(full)]
    at = np.flatnonzero(inside)
    few = np.flatnonzero((counts > 0) & (counts < size))
    up, down = W.powers(W.WORD_BASE, len(h) + 1)
    total = W.sums(h * up[:len(h)])
    whole = (total[w.first[few + 1]] - total[w.first[few]]) * down[w.first[few]] + counts[few].astype(np.uint64)
    hashes = np.concatenate([W.mixed(full[at]), W.mixed(whole)])
    owner = np.concatenate([text[at], few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            hashes, first = shingle_sets(part.column("text"), size)
            ids = np.empty((part.num_rows, 2), np.uint64)
            ids[:, 0] = W.per_text(hashes, first)
            ids[:, 1] = W.per_text(W.mixed(hashes + np.uint64(W.BYTE_BASE)), first)
            signature = np.empty((part.num_rows, VALUES), np.uint32)
            for k in range(VALUES):
                values = (((hashes * _FACTORS[k] + _ADDENDS[k])) >> np.uint64(32)).astype(np.uint32)
                signature[:, k] = W.per_text(values, first, np.minimum)
            rows = np.arange(part.num_rows + 1)
            yield pa.RecordBatch.from_arrays([
                part.column("doc"), part.column("tag"), pa.array(np.diff(first).astype(np.int64)),
                W.binaries(ids, rows * 16), W.binaries(signature, rows * 4 * VALUES),
            ], ["doc", "tag", "n_shingles", "node", "signature"])

    return run


def _region(signature: np.ndarray, t: int) -> np.ndarray:
    """Tree t's region of every node."""
    region = np.full(len(signature), t, np.uint64)
    for k in range(DEPTH * t, DEPTH * (t + 1)):
        region = W.mixed(region * np.uint64(W.BYTE_BASE) + signature[:, k])
    return region.view(np.int64)


def _signatures(part: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(part.num_rows, VALUES).astype(np.uint64)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and tree: region, the next values' low bytes in order, node."""
    for part in batches:
        n = part.num_rows
        if not n:
            continue
        node = part.column("node")
        signature = _signatures(part)
        for t in range(TREES):
            tail = np.zeros(n, np.uint64)
            for i in range(DEPTH, DEPTH + TAIL):
                tail = (tail << np.uint64(8)) | (signature[:, (DEPTH * t + i) % VALUES] & np.uint64(255))
            yield pa.RecordBatch.from_arrays([pa.array(_region(signature, t)), pa.array(tail.view(np.int64)), node], ["region", "tail", "node"])


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and tree: region, node, root."""
    for part in batches:
        if part.num_rows:
            signature = _signatures(part)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(_region(signature, t)), part.column("node"), part.column("root")], ["region", "node", "root"])


def _depths(tails: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two signature orders of one region."""
    left = (tails ^ others).view(np.uint64)
    return DEPTH + sum((left < np.uint64(1 << (8 * (TAIL - d)))).astype(np.int32) if d else np.int32(0) for d in range(1, TAIL + 1))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a sorted block (a, b, depth), and its first and last rows (a, region, tail)."""
    names = ["a", "b", "depth", "region", "tail"]
    hold = None  # the last rows so far
    head_left = WIDTH

    def border(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([rows.column("node").cast(pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()),
                                           rows.column("region"), rows.column("tail")], names)

    for part in batches:
        if not part.num_rows:
            continue
        if head_left:
            yield border(part.slice(0, head_left))
            head_left -= min(head_left, part.num_rows)
        new = 0 if hold is None else hold.num_rows
        rows = part if hold is None else pa.Table.from_batches([hold, part]).combine_chunks().to_batches()[0]
        region, tail = rows.column("region").to_numpy(), rows.column("tail").to_numpy()
        for d in range(1, WIDTH + 1):
            at = np.flatnonzero(region[d:] == region[:-d])
            at = at[at + d >= new]  # the others were seen with the batch before
            if d > 1:
                at = at[(region[at] != region[at + 1]) | (_depths(tail[at], tail[at + 1]) < DENSE)]
            if len(at):
                a, b = rows.column("node").take(pa.array(at)), rows.column("node").take(pa.array(at + d))
                yield pa.RecordBatch.from_arrays([a.cast(pa.binary()), b.cast(pa.binary()), pa.array(_depths(tail[at], tail[at + d])),
                                                  pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())], names)
        hold = rows.slice(max(0, rows.num_rows - WIDTH))
    if hold is not None:
        yield border(hold)


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, support), stored: nodes that are near neighbours in some tree; support sums up the depths."""
    rows = nodes.mapInArrow(_trees, "region long, tail long, node binary")
    blocks = rows.repartitionByRange("region", "tail", "node").sortWithinPartitions("region", "tail", "node")
    found = stored(blocks.mapInArrow(_neighbours, "a binary, b binary, depth int, region long, tail long"))
    pairs = found.filter("b IS NOT NULL").select("a", "b", "depth")
    # a few rows from each block border, in order again
    edge = found.filter("b IS NULL").select("region", "tail", F.col("a").alias("node")).distinct()
    order = Window.partitionBy("region").orderBy("tail", "node")
    following = edge.withColumn("next", F.array(*[F.lead("node", d).over(order) for d in range(1, WIDTH + 1)]))
    over = following.select(F.col("node").alias("a"), F.explode("next").alias("b"), F.lit(DEPTH).alias("depth")).filter(
        "b IS NOT NULL")
    out = stored(pairs.unionByName(over).filter("a <> b").groupBy(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("depth").alias("support")))
    discard(found)
    return out


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text_a", "text_b"):
            left, first = shingle_sets(part.column("text_a"), size)
            right, last = shingle_sets(part.column("text_b"), size)
            owner = np.concatenate([np.repeat(np.arange(part.num_rows), np.diff(first)), np.repeat(np.arange(part.num_rows), np.diff(last))])
            both = np.concatenate([left, right])
            order = np.lexsort((both, owner))
            both, owner = both[order], owner[order]
            shared = np.bincount(owner[1:][(both[1:] == both[:-1]) & (owner[1:] == owner[:-1])], minlength=part.num_rows)
            union = np.diff(first) + np.diff(last) - shared
            linked = (100 * shared >= percent * union) & (union > 0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("a", "b", "u", "v")), pa.array(linked)], ["a", "b", "u", "v", "linked"])

    return run


def _open_regions(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """(region, node, root, n), stored, of regions of n > 2 nodes that are not all connected (two nodes were neighbours)."""
    rooted = stored(nodes.select("node", "signature").join(label, "node", "left").select("node", "signature", F.coalesce("root", "node").alias("root")))
    rows = rooted.mapInArrow(_regions, "region long, node binary, root binary")
    parted = stored(rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
                    .filter("n > 2 AND low <> high").select("region", "n"))
    out = stored(rows.join(near(parted, parted.count()), "region"))
    discard(rooted, parted)
    return out


def _listed(members: DataFrame) -> DataFrame:
    """(a, b, u, v): all pairs of nodes of different components in small regions, and their roots."""
    rows = members.filter(F.col("n") <= SMALL).groupBy("region").agg(F.collect_list(F.struct("node", "root")).alias("m"))
    both = rows.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y"))
    return both.filter("x.node < y.node AND x.root <> y.root").select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.root").alias("u"), F.col("y.root").alias("v")).distinct()


def _blocked(members: DataFrame) -> DataFrame:
    """(region, i, j, own, node, root): nodes of large regions, for each pair (i, j) of blocks that theirs is in.

    The nodes of a region's largest component are blocks behind the others, and are not compared with each other.
    """
    large = members.filter(F.col("n") > SMALL)
    top = large.groupBy("region", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(F.max(F.struct("c", "root")).alias("top"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    spot = F.xxhash64("node")
    sized = large.join(top, "region").select("region", "node", "root", (F.col("root") == F.col("top.root")).alias("main"),
                                             blocks(F.col("top.c")).alias("mains"), blocks(F.col("n") - F.col("top.c")).alias("rests"))
    own = F.when(F.col("main"), F.col("rests") + F.pmod(spot, F.col("mains"))).otherwise(F.pmod(spot, F.col("rests"))).cast("int")
    others = F.sequence(F.lit(0), F.col("rests") + F.when(F.col("main"), 0).otherwise(F.col("mains")) - 1)
    return sized.select("region", own.alias("own"), F.explode(others).alias("other"), "node", "root").select(
        "region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")


def _compare(size: int, percent: int):
    """Links (a, b) between the components of one pair of blocks, none that follows from the others."""
    width = 4096  # shingles at a time

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        n, i, j = block.num_rows, block.column("i")[0].as_py(), block.column("j")[0].as_py()
        own, roots = block.column("own").to_numpy(), block.column("root").combine_chunks().dictionary_encode()
        root = roots.indices.to_numpy()
        hashes, first = shingle_sets(block.column("text").combine_chunks(), size)
        owner, counts = np.repeat(np.arange(n), np.diff(first)), np.diff(first)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        place = np.zeros(n, np.int64)
        place[left] = np.arange(len(left))
        place[right] = np.arange(len(right))
        order = np.argsort(hashes, kind="stable")
        owner, code = owner[order], np.cumsum(np.diff(hashes[order], prepend=hashes[order][:1]) != 0)
        shared = np.zeros((len(left), len(right)), np.float32)  # whole numbers, exact below 2**24
        if len(left) and len(right):
            sides = [np.bincount(code[own[owner] == k], minlength=code[-1] + 1) for k in (i, j)]
            common = (sides[0] > 0) & (sides[1] > 0) if i != j else sides[0] > 1
            kept = common[code]
            owner, code = owner[kept], (np.cumsum(common) - 1)[code[kept]]
            for at in range(0, int(common.sum()), width):
                low, high = np.searchsorted(code, (at, at + width))
                who, what = owner[low:high], code[low:high] - at
                one, two = own[who] == i, own[who] == j
                a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
                a[place[who[one]], what[one]] = 1
                b[place[who[two]], what[two]] = 1
                shared += a @ b.T
        both = shared.astype(np.int64)
        linked = 100 * both >= percent * (counts[left][:, None] + counts[right][None, :] - both)
        linked &= root[left][:, None] != root[right][None, :]
        x, y = np.nonzero(linked)
        top: dict[int, int] = {}

        def end(r: int) -> int:
            while r in top:
                r = top[r]
            return r

        out = []
        for r, s in np.unique(np.stack([root[left][x], root[right][y]], axis=1), axis=0).tolist():
            if end(r) != end(s):
                top[end(r)] = end(s)
                out.append((r, s))
        names = roots.dictionary
        return pa.table([names.take(pa.array([o[k] for o in out], pa.int32())) for k in (0, 1)], names=["a", "b"])

    return run


def near_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc (NO_ID for a NULL id), tag (a hash of the text), n_shingles, component (smallest
    doc), first (the smallest tag of that doc in the component).

    Words are lower-cased (A-Z).  Documents are linked if 100 * |intersection| >= percent * |union| of
    their sets of `shingle` words; a text without words is linked with nothing.  Rows of one id and
    different texts are documents of their own that count by that id; other columns are not read.
    The trees' depth of three is meant for percent >= 80.
    """
    if percent < 80:
        raise ValueError("the forest finds links of 80 percent and more")
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    sketches = stored(rows.mapInArrow(_sketch(shingle), "doc long, tag long, n_shingles long, node binary, signature binary"))
    some = sketches.filter("n_shingles > 0")
    nodes = stored(some.groupBy("node").agg(F.min(F.struct("doc", "tag")).alias("d"), F.first("signature").alias("signature")))
    tried = pairs = candidates(nodes.select("node", "signature"))
    wanted = nodes.select("node", "d.*").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    texts = stored(rows.join(wanted, ["doc", "tag"]).select("node", "text").dropDuplicates(["node"]))

    def confirmed(few: DataFrame) -> DataFrame:
        """Of pairs (a, b), u and v (what a and b count as in links), and whether a and b are linked."""
        both = few.select("a", "b", "u", "v").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return stored(both.mapInArrow(_confirm(shingle, percent), "a binary, b binary, u binary, v binary, linked boolean"))

    label = None
    rest = pairs.withColumns({"u": F.col("a"), "v": F.col("b")})
    for turn in range(ROUNDS + 1):
        if not rest.limit(1).count():
            break
        few = rest
        if turn < ROUNDS:  # each node's best pair
            best = rest.select(F.struct("support", "a", "b", "u", "v").alias("p"), F.explode(F.array("a", "b")).alias("node")).groupBy(
                "node").agg(F.max("p").alias("p"))
            few = best.select("p.a", "p.b", "p.u", "p.v").distinct()
        seen = confirmed(few)
        new = seen.filter("linked").select(F.col("u").alias("a"), F.col("v").alias("b"))
        label = connected(new) if label is None else extended(label, new)
        if turn < ROUNDS:
            left = rest.select("a", "b", "support").join(near(seen.select("a", "b"), seen.count()), ["a", "b"], "left_anti")
            n = label.count()
            for side, root in (("a", "u"), ("b", "v")):
                left = left.join(near(label.select(F.col("node").alias(side), F.col("root").alias(root)), n), side, "left").withColumn(
                    root, F.coalesce(root, side))
            rest = stored(left.filter("u <> v").select("a", "b", "support", "u", "v"))
            if pairs is not tried:
                discard(pairs)
            pairs = rest
        discard(seen)
    if pairs is not tried:
        discard(pairs)
    if label is not None:  # regions whose nodes are not all connected, whole
        members = _open_regions(nodes, label)
        listed = stored(_listed(members).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        blocks = _blocked(members).join(texts, "node").groupBy("region", "i", "j").applyInArrow(
            _compare(shingle, percent), "a binary, b binary")
        seen = confirmed(listed)
        new = stored(seen.filter("linked").select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(blocks))
        if new.limit(1).count():
            label = extended(label, new)
        discard(members, listed, seen, new)
    discard(tried, texts, nodes)
    if label is None:
        label = docs.sparkSession.createDataFrame([], "node binary, root binary")
    rooted = sketches.select("doc", "tag", "n_shingles", "node").join(label, "node", "left").withColumn(
        "root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")))
    # a table of its own: a root with very many documents can then be split in the join
    least = stored(rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc", "tag")).alias("least")))
    return rooted.join(least, "root", "left").select("doc", "tag", "n_shingles", F.coalesce("least.doc", "doc").alias("component"),
                                                     F.coalesce("least.tag", "tag").alias("first"))


def op3_minhash_forest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, with four-word shingles."""
    found = near_components(docs, shingle=4, percent=80)
    as_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(as_id("doc").alias("doc_id"), "n_shingles", as_id("component").alias("component_id"),
                        (F.col("doc") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The row of the smallest id of each group, with all its columns, whatever these are called.

    Of several texts of that id one stays; rows equal in id and text (the exact stage leaves none) stay or go together.
    """
    gone = near_components(docs, shingle, percent).filter("doc <> component OR tag <> first").select("doc", "tag").distinct()
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
                        F.xxhash64("text").alias("tag"))
    return keyed.join(gone, ["doc", "tag"], "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
