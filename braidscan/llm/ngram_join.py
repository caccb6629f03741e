"""N-gram Jaccard join by T-occurrence search, and its connected groups.

Two documents link when their shingle sets' Jaccard similarity reaches a bound, which
asks for an overlap of at least T shingles. The search divides a document's inverted
lists as DivideSkip does: the few *short* lists (of its rarest shingles) are merged to
find candidates, the many *long* ones are never merged but binary-probed for each
candidate.

1. Each text becomes a set of 64-bit shingle hashes; of its n shingles, `missing` may be
   absent from a partner. Its 2 * missing + 1 smallest hashes go out ("head"); partners
   share more than `missing` of their heads (T-occurrence over heads).
2. Heads are merged by hash range. Every document learns how many documents hold each
   head shingle. Copies within a task combine first, so a frequent shingle sends one
   entry for each chunk of documents, not for each document.
3. A document with too few shared head shingles links with nothing and leaves. Of the
   others, one of each set of equal texts goes through 2. again with its whole set; those
   with T shared shingles keep as many of the rarest as one must be shared: the short lists.
4. Equal sets are one class. For each short list (by size band), a few pivots are probed
   against its members. Links inside a group add nothing more, so groups of thousands of
   copies cost a few probes per member. Lists that still touch several groups are searched
   to the end, block against block: merge the short lists, probe the long ones, and keep
   one link for each two groups. No link between groups is lost.

Defined cases
  null or empty text, no word   n_shingles 0, its own component, linked with nothing
  fewer words than the shingle  one shingle: the whole sequence
  very long texts               hashed in steps of bounded size; the set of one text is held whole
  repeated rows                 rows with one doc_id count as one document for links; each row is returned
  null doc_id                   left out
  ties                          components are named by their smallest doc_id
  extra columns                 ignored
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidscan.llm import wordhash
from braidscan.operators.components import connected_components
from braidscan.runtime import Scratch

#: Words of a shingle; the bound as a fraction of 100.
WORDS, PERCENT = 4, 85
#: Documents and head entries of a chunk; pivots probed for each short list.
CHUNK_DOCS, CHUNK_ENTRIES, PIVOTS = 4096, 600_000, 3
#: Documents of a block in the last search; head entries of a hash range; bits of the grid its edges lie on.
BLOCK_DOCS, RANGE_ENTRIES, GRID_BITS = 256, 16_000_000, 8


def missing(n, percent: int):
    """How many of n shingles a partner may lack."""
    return n - (percent * n + 99) // 100


def least_shared(n, percent: int):
    """Head shingles that n's holder surely shares with any partner."""
    return missing((percent * n + 99) // 100, percent) + 1


def _batches(batch: pa.RecordBatch, max_bytes: int = 1 << 22):
    """(ids, texts) of bounded size."""
    ids, texts, size = [], [], 0
    col = batch.column(1).cast(pa.large_binary())
    for i, t in zip(batch.column(0).to_pylist(), col):
        raw = t.as_py()
        ids.append(i)
        texts.append(raw)
        size += len(raw or b"")
        if size >= max_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _sets(batch: pa.RecordBatch, k: int):
    """(doc_id, sorted distinct shingle hashes) of each row."""
    for ids, texts in _batches(batch):
        h, bounds = wordhash.words(texts)
        for j, i in enumerate(ids):
            yield i, np.unique(wordhash.shingles(h[bounds[j] : bounds[j + 1]], k))


_CHUNKS = "chunk long, ids binary, sizes binary, fp binary, head_sizes binary, heads binary"


def _chunks(docs: DataFrame, k: int, percent: int, whole: bool = False) -> DataFrame:
    schema = pa.schema([("chunk", pa.int64())] + [(c, pa.binary()) for c in ("ids", "sizes", "fp", "head_sizes", "heads")])

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, sizes, fps, head_sizes, heads, entries = [], [], [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + seq], pa.int64())]
                + [pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), b"".join(fps), np.array(head_sizes, np.int64).tobytes(), b"".join(heads))],
                schema=schema,
            )

        for b in batches:
            for i, s in _sets(b, k):
                n = len(s)
                head = s if whole else s[: min(n, 2 * missing(n, percent) + 1)]
                ids.append(i)
                sizes.append(n)
                fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                head_sizes.append(len(head))
                heads.append(head.tobytes())
                entries += len(head)
                if len(ids) >= CHUNK_DOCS or entries >= CHUNK_ENTRIES:
                    yield row()
                    seq += 1
                    ids, sizes, fps, head_sizes, heads, entries = [], [], [], [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(run, _CHUNKS)


def _edges(chunks: DataFrame) -> np.ndarray:
    """Where the heads are cut into hash ranges of like weight; their number follows the corpus, so that what a range holds stays bounded.

    Heads are their texts' smallest hashes and crowd at the low end. Each chunk's own quantiles,
    weighed by its entries, are summed into cells of a fixed grid, finer towards zero.
    """
    schema = pa.schema([("cell", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums: dict[int, int] = {}
        for b in batches:
            for heads in b.column(0):
                h = np.frombuffer(heads.as_py(), np.uint64)
                cell, n = np.unique(_cell(h), return_counts=True)
                for c, k in zip(cell.tolist(), n.tolist()):
                    sums[c] = sums.get(c, 0) + k
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], schema=schema)

    rows = chunks.select("heads").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()  # at most CELLS rows
    total = sum(r["n"] for r in rows)
    parts = max(2 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ENTRIES))
    edges, seen = [], 0
    for r in rows:
        seen += r["n"]
        if seen * parts >= (len(edges) + 1) * total:
            edges.append(_cell_end(r["cell"]))
    return np.array([e for e in edges if e < 1 << 64], np.uint64)


def _cell(h: np.ndarray) -> np.ndarray:
    """A cell of the grid for each hash: its leading zeros and the GRID_BITS bits behind the first one."""
    top = np.frexp(np.maximum(h >> np.uint64(11), np.uint64(1)).astype(np.float64))[1]  # bits of the upper 53, exactly
    rest = (h >> np.uint64(11)) << (np.uint64(53) - top.astype(np.uint64))  # the leading one at bit 52
    return (top * (1 << GRID_BITS) + ((rest >> np.uint64(52 - GRID_BITS)) & np.uint64((1 << GRID_BITS) - 1)).astype(np.int64)).astype(np.int64)


def _cell_end(cell: int) -> int:
    """The first hash behind a cell (exact from 2^20 on; below, edges merely lie lower)."""
    top, rest = cell >> GRID_BITS, (cell & ((1 << GRID_BITS) - 1)) + 1
    return -(-(((1 << GRID_BITS) + rest) << (top + 10)) // (1 << GRID_BITS))


def _shared_heads(chunks: DataFrame) -> DataFrame:
    """(chunk, hashes, counts): the head shingles that several documents hold, told to each chunk holding them."""
    edges = _edges(chunks)
    out_schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def deal(batches):
        for b in batches:
            for chunk, heads in zip(b.column(0).to_pylist(), b.column(1)):
                h, c = np.unique(np.frombuffer(heads.as_py(), np.uint64), return_counts=True)
                cuts = np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))
                c = np.minimum(c, 0xFFFF).astype(np.uint16)
                rows = [(p, h[a:z].tobytes(), c[a:z].tobytes()) for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], schema=out_schema)

    def merge(t: pa.Table) -> pa.Table:
        chunk = t["chunk"].to_pylist()
        hs = [np.frombuffer(x.as_py(), np.uint64) for x in t["hashes"]]
        h = np.concatenate(hs)
        c = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in t["counts"]]).astype(np.int64)
        owner = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        order = np.argsort(h, kind="stable")
        h, c, owner = h[order], c[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        total = np.add.reduceat(c, first)
        df = np.repeat(total, np.diff(np.concatenate((first, [len(h)]))))
        keep = df >= 2
        h, df, owner = h[keep], np.minimum(df[keep], 0xFFFFFFFF).astype(np.uint32), owner[keep]
        by = np.argsort(owner, kind="stable")
        h, df, owner = h[by], df[by], owner[by]
        cuts = np.searchsorted(owner, np.arange(len(hs) + 1))
        rows = [(chunk[j], h[a:z].tobytes(), df[a:z].tobytes()) for j, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])) if z > a]
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "hashes": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    dealt = chunks.select("chunk", "heads").mapInArrow(deal, "part int, chunk long, hashes binary, counts binary")
    return dealt.groupBy("part").applyInArrow(merge, "chunk long, hashes binary, counts binary")


def _short_lists(chunks: DataFrame, replies: DataFrame, percent: int, whole: bool = False) -> DataFrame:
    """(doc_id, n, fp, rare): documents that may have partners, with their shortest lists' shingles."""

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x.as_py(), np.uint64) for x in right["hashes"]] if len(right) else []
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        df = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in right["counts"]]) if hs else np.zeros(0, np.uint32)
        order = np.argsort(h)
        h, df = h[order], df[order]
        out: list[tuple] = []
        for r in range(len(left)):
            get = lambda c, t: np.frombuffer(left[c][r].as_py(), t)  # noqa: B023, E731
            ids, sizes, heads = get("ids", np.int64), get("sizes", np.int64), get("heads", np.uint64)
            at = np.concatenate(([0], np.cumsum(get("head_sizes", np.int64))))
            if not len(h):
                continue
            where = np.minimum(np.searchsorted(h, heads), len(h) - 1)
            seen = np.where(h[where] == heads, df[where], 1).astype(np.int64)
            some = np.concatenate(([0], np.cumsum(seen >= 2)))
            need = np.array([int(n) - missing(int(n), percent) if whole else least_shared(int(n), percent) for n in sizes])
            fp = left["fp"][r].as_py()
            for j in np.flatnonzero((some[at[1:]] - some[at[:-1]] >= need) & (sizes > 0)):
                a, z = at[j], at[j + 1]
                rank = np.lexsort((heads[a:z], seen[a:z]))[: z - a - need[j] + 1]
                rank = rank[seen[a:z][rank] >= 2]
                out.append((int(ids[j]), int(sizes[j]), fp[16 * j : 16 * j + 16], heads[a:z][rank].view(np.int64).tolist()))
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "n": pa.array(cols[1], pa.int64()), "fp": pa.array(cols[2], pa.binary()), "rare": pa.array(cols[3], pa.list_(pa.int64()))})

    return chunks.select("chunk", "ids", "sizes", "fp", "head_sizes", "heads").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(answer, "doc_id long, n long, fp binary, rare array<long>")


def _members(chunks: DataFrame) -> DataFrame:
    """(doc_id, n, fp) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary())])

    def run(batches):
        for b in batches:
            for ids, sizes, fp in zip(*(b.column(i) for i in range(3))):
                i, n, f = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(sizes.as_py(), np.int64), fp.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(n), pa.array([f[16 * j : 16 * j + 16] for j in range(len(i))], pa.binary())], schema=schema)

    return chunks.select("ids", "sizes", "fp").mapInArrow(run, "doc_id long, n long, fp binary")


def _probe(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the bound; long lists are probed by binary search."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").join(
        sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a"
    )

    def run(batches):
        for batch in batches:
            found_a, found_b = [], []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4))):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                common = int(np.count_nonzero(t[at] == s))
                if 100 * common >= percent * (len(s) + len(t) - common):
                    found_a.append(a.as_py())
                    found_b.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], schema=schema)

    return held.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _search_blocks(scratch: Scratch, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of different groups that share an open list, in tasks of bounded size.

    Documents that open lists tie together are dealt to blocks of about BLOCK_DOCS; every two
    blocks that meet in a list are searched against each other. One row per document and
    pair of blocks moves, however many lists the two blocks share.
    """
    first = scratch.put(open_.groupBy("h", "band").agg(F.min("doc_id").alias("least")), "first")
    ties = open_.join(first, ["h", "band"]).select("doc_id", "least").distinct()
    knots = connected_components(ties, "doc_id", "least").select(F.col("node").alias("doc_id"), F.col("component").alias("knot"))
    sizes = knots.groupBy("knot").agg(F.ceil(F.count("*") / BLOCK_DOCS).alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block")
    dealt = scratch.put(knots.join(sizes, "knot").select("doc_id", "knot", block), "dealt")
    meets = open_.join(dealt, "doc_id").groupBy("h", "band", "knot", "block").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    other = meets.select("h", "band", F.col("block").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    tasks = (
        meets.join(other, ["h", "band"])
        .filter((F.col("block") <= F.col("j")) & ((F.col("lo") != F.col("lo2")) | (F.col("hi") != F.col("hi2")) | (F.col("lo") != F.col("hi"))))
        .select("knot", F.col("block").alias("i"), "j")
        .distinct()
    )
    # One side of a task or both, by the block a document is in.
    sides = tasks.select("knot", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    docs = open_.groupBy("doc_id", "g").agg(F.collect_set("h").alias("rare")).join(dealt, "doc_id").join(sets, "doc_id")
    return sides.join(docs, ["knot", "block"]).groupBy("knot", "i", "j").applyInArrow(_searcher(percent), "a long, b long")


def _searcher(percent: int):
    def search(t: pa.Table) -> pa.Table:
        ids, block = t["doc_id"].to_numpy(), t["block"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t["shingles"]]
        sizes = np.array([len(s) for s in sets])
        rare = [np.array(x.as_py(), np.int64) for x in t["rare"]]
        root = t["g"].to_numpy().copy()
        # The inverted lists of block j, sorted, and the queries of block i.
        held = np.flatnonzero(block == j)
        h = np.concatenate([rare[d] for d in held]) if len(held) else np.zeros(0, np.int64)
        owner = np.repeat(held, [len(rare[d]) for d in held])
        order = np.argsort(h, kind="stable")
        h, owner = h[order], owner[order]
        out_a, out_b = [], []
        for q in np.flatnonzero(block == i):
            lo, hi = np.searchsorted(h, rare[q]), np.searchsorted(h, rare[q], "right")
            near = np.unique(np.concatenate([owner[x:y] for x, y in zip(lo, hi)])) if len(lo) else owner[:0]
            near = near[(sizes[near] * 100 >= sizes[q] * percent) & (sizes[q] * 100 >= sizes[near] * percent)]
            if i == j:
                near = near[near > q]
            for c in near:
                if root[c] == root[q]:
                    continue
                s, u = (sets[q], sets[c]) if sizes[q] <= sizes[c] else (sets[c], sets[q])
                at = np.minimum(np.searchsorted(u, s), len(u) - 1)
                common = int(np.count_nonzero(u[at] == s))
                if 100 * common >= percent * (len(s) + len(u) - common):
                    out_a.append(ids[q])
                    out_b.append(ids[c])
                    root[root == root[c]] = root[q]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return search


def _set_table(docs: DataFrame, k: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for b in batches:
            ids, sets = [], []
            for i, s in _sets(b, k):
                ids.append(i)
                sets.append(s.tobytes())
                if len(ids) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)
                    ids, sets = [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def jaccard_groups(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of documents."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "ngrams")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())

    chunks = scratch.put(_chunks(docs, words, percent), "chunks")
    alive = scratch.put(_short_lists(chunks, _shared_heads(chunks), percent).select("doc_id", "n", "fp"), "alive")
    members = scratch.put(_members(chunks), "members")
    scratch.drop("chunks")

    filled = members.filter("n > 0")
    # Aggregates are written before they meet their rows again: a join of two tables can split a group of very many copies.
    classes = scratch.put(filled.groupBy("fp", "n").agg(F.min("doc_id").alias("rep")), "classes")
    copies = filled.join(classes, ["fp", "n"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    reps = alive.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id").distinct()

    # Among one text of each class the whole sets decide; what loses its partners leaves, and takes lists with it.
    full = scratch.put(_chunks(docs.dropDuplicates(["doc_id"]).join(reps, "doc_id", "left_semi"), words, percent, whole=True), "full")
    left = scratch.put(_short_lists(full, _shared_heads(full), percent, whole=True), "left")
    # A list is cut by bands of size: partners' sizes lie in one band or in neighbouring ones.
    ratio = F.log(F.lit(100.0 / percent))
    banded = left.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / ratio + F.lit(1e-9)))
    lists = banded.select("doc_id", "n", F.explode("rare").alias("h"), "band").select("doc_id", "n", "h", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    order = [F.xxhash64(F.lit(p), F.col("doc_id")) for p in range(PIVOTS)]
    pivots = lists.groupBy("h", "band").agg(F.count("*").alias("members"), F.array(*[F.min_by(F.struct("doc_id", "n"), o) for o in order]).alias("pivots"))
    lists = scratch.put(lists.join(scratch.put(pivots.filter("members > 1"), "pivots"), ["h", "band"]), "lists")

    near = lambda p, q: (F.col(p) * 100 >= F.col(q) * percent) & (F.col(q) * 100 >= F.col(p) * percent)
    tried = (
        lists.select("doc_id", "n", F.explode("pivots").alias("p"))
        .filter(F.col("p.doc_id") != F.col("doc_id"))
        .select(F.least("doc_id", "p.doc_id").alias("a"), F.greatest("doc_id", "p.doc_id").alias("b"), "n", F.col("p.n").alias("m"))
        .filter(near("n", "m"))
        .select("a", "b")
        .distinct()
    )
    needed = lists.select("doc_id").distinct()
    sets = scratch.put(_set_table(docs.join(needed, "doc_id", "left_semi"), words).dropDuplicates(["doc_id"]), "sets")
    tried = scratch.put(tried, "tried")
    links = scratch.put(_probe(tried, sets, percent), "links")

    # What the pivots left: documents of different groups that still share a short list.
    group = connected_components(links, "a", "b") if not links.isEmpty() else spark.createDataFrame([], "node long, component long")
    held = lists.select("doc_id", "h", "band").join(group.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("g", F.coalesce("component", "doc_id"))
    mixed = held.groupBy("h", "band").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).filter("lo <> hi").select("h", "band")
    open_ = scratch.put(held.join(scratch.put(mixed, "mixed"), ["h", "band"]).select("doc_id", "h", "band", "g"), "open")
    more = scratch.put(_search_blocks(scratch, open_, sets, percent), "more")
    edges = links.unionByName(more).unionByName(copies)
    found = connected_components(scratch.put(edges, "edges"), "a", "b")
    return (
        members.select("doc_id", F.col("n").alias("n_shingles"))
        .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
