"""Operator 4: removal of repeated byte strings by suffix arrays with deep-shallow sorting.

A 100-byte string is a window. Of every window's 24-byte grams the one with the least hash is its anchor, so equal
windows have equal anchors at equal places, and only anchors (about one byte in 39) are followed up. Anchors whose
gram and whole surroundings occur earlier are repeats at once. What is left are anchors whose gram repeats in
different surroundings: their suffixes, to the right and mirrored to the left, are sorted by multikey quicksort to a
shallow depth and by blind tries beyond it; the common prefixes of neighbours tell for every window through the
anchor where it equals another, and the earliest of equals stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import groups, spans, store

GRAM = 24
SHALLOW = 64
LOWEST = -(1 << 63)
#: A gram with more different surroundings goes the way of ``_by_parts``, so that no task holds an unbounded group.
MOST = 4_000
#: Windows per part of its contexts, and of the parts of those.
WIDTHS = (16, 4, 1)


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w consecutive items; the last w - 1 places are left out."""
    out, size = x, 1
    while 2 * size <= w:
        out = op(out[:-size], out[size:])
        size *= 2
    rest = w - size
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Anchors of all windows of each text: places, gram hashes, hashes of the surroundings, and their texts."""
    w = length - GRAM + 1
    n = len(buf)
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if n < length:
        return none
    up, down = spans.powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = spans.mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]) | np.uint64(1)
    m = _slide(h, w, np.minimum)
    # windows must lie inside one text; 0 is less than any hash
    inside = np.zeros(len(m) + 1, dtype=np.int64)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    m[np.cumsum(inside[:-1]) == 0] = 0
    padded = np.zeros(len(h) + w - 1, dtype=np.uint64)
    padded[w - 1 : w - 1 + len(m)] = m
    at = np.flatnonzero(_slide(padded, w, np.maximum)[: len(h)] == h)
    doc = np.searchsorted(starts, at, side="right") - 1
    a, z = np.maximum(at - (w - 1), starts[doc]), np.minimum(at + length, ends[doc])
    around = spans.mix((total[z] - total[a]) * down[a] + (at - a).astype(np.uint64) * up[3] + (z - at).astype(np.uint64))
    return at, h[at], around, doc


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.slices(batches, "text", most=1 << 20):
            buf, starts, ends = spans.pack(batch["text"])
            at, g, c, doc = anchors(buf, starts, ends, length)
            did = batch["did"].to_numpy()[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(did), pa.array((at - starts[doc]).astype(np.int32))],
                names=["g", "c", "did", "pos"],
            )

    return docs.select("did", "text").mapInArrow(run, "g long, c long, did long, pos int")


def _sift(rows: DataFrame) -> DataFrame:
    """Rows sorted by ``g``, ``c``, ``did``, ``pos`` without ``c`` and with ``full``: whether the surroundings came before.

    Anchors alone with their gram fall away. At the borders of partitions an anchor may be handed on for comparison
    without need, which changes nothing.
    """
    schema = rows.drop("c").schema.add("full", "boolean", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_g = last_c = held = None  # held: the first anchor of a gram until its second surroundings are met
        begun = False

        def out(batch, at, full):
            found = batch.take(pa.array(at, pa.int64())).drop_columns(["c"])
            return pa.RecordBatch.from_arrays([*found.columns, pa.array([full] * len(at), pa.bool_())], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            g, c = batch["g"].to_numpy(), batch["c"].to_numpy()
            new_g, new_c = np.ones(len(g), bool), np.ones(len(g), bool)
            new_g[1:] = g[1:] != g[:-1]
            new_c[1:] = new_g[1:] | (c[1:] != c[:-1])
            if begun:
                new_g[0] = g[0] != last_g
                new_c[0] = new_g[0] or c[0] != last_c
            yield out(batch, np.flatnonzero(~new_c), True)
            r = np.flatnonzero(new_c)
            if len(r):
                first = new_g[r]
                # the first surroundings of a gram count if others of the same gram follow
                more = np.zeros(len(r), bool)
                more[:-1] = ~first[1:]
                sure = ~first | more
                if not begun:
                    sure[0] = True
                if held is not None:
                    if not first[0]:
                        yield out(held, [0], False)
                    held = None
                yield out(batch, r[sure], False)
                if not sure[-1]:
                    held = batch.slice(r[-1], 1)
            last_g, last_c, begun = g[-1], c[-1], True
        if held is not None:
            yield out(held, [0], False)

    return rows.mapInArrow(run, schema)


def _contexts(docs: DataFrame, wanted: DataFrame, count: int, length: int) -> DataFrame:
    """The bytes around anchors: ``g``, ``did``, ``pos``, ``left`` (bytes before the anchor) and ``ctx``."""
    reach = length - GRAM
    per_doc = wanted.groupBy("did").agg(F.collect_list(F.struct("pos", "g")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in spans.slices(iter([whole]), "text"):
                rows = []
                for did, text, places in zip(batch["did"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["p"].to_pylist(), strict=True):
                    for p in places:
                        a = max(p["pos"] - reach, 0)
                        rows.append((p["g"], did, p["pos"], p["pos"] - a, text[a : p["pos"] + length]))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["g", "did", "pos", "left", "ctx"]
                )

    rows = docs.select("did", "text").join(groups.small_side(per_doc, count), "did")
    return rows.mapInArrow(run, "g long, did long, pos int, left int, ctx binary")


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of strings of one length, and the common prefix of each with the one before it.

    A search goes by the branching bytes only and compares with the one leaf it ends at.
    """
    size = len(strings[0])
    root: list = [size, [0]]  # a leaf has the full depth and its strings; a node has its depth and its branches
    for k in range(1, len(strings)):
        s, node = strings[k], root
        while node[0] < size:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = strings[node[1][0]]
        if s == t:
            node[1].append(k)
            continue
        differ = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
        depth = size - (differ.bit_length() + 7) // 8
        parent, node = None, root
        while node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = [size, [k]]
            continue
        fork = [depth, {t[depth]: node, s[depth]: [size, [k]]}]
        if parent is None:
            root = fork
        else:
            parent[1][s[parent[0]]] = fork
    order, common, todo = [], [], [(root, 0)]
    while todo:
        node, above = todo.pop()
        if node[0] == size:
            order += node[1]
            common += [above] + [size] * (len(node[1]) - 1)
        else:
            todo += [(node[1][b], node[0]) for b in sorted(node[1], reverse=True)]
            todo[-1] = (todo[-1][0], above)
    return order, common


def suffix_order(group: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes sorted inside groups, and the common prefix of each with its predecessor (-1 at a new group).

    Multikey quicksort by characters of eight bytes: after each character only rows that still tie are sorted on.
    From the shallow depth on, blind tries order what still ties.
    """
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    words[:, :width] = rows
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    common = np.full(n, -1, dtype=np.int64)
    tie = np.zeros(n, dtype=np.int64)  # number of the run of ties that a place is in
    tie[1:] = np.cumsum(group[order][1:] != group[order][:-1])
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = tie[1:] != tie[:-1]
    for depth in range(min(shallow // 8, words.shape[1])):
        edge = np.append(fresh[1:], True)
        open_ = np.flatnonzero(~(fresh & edge))
        if not len(open_):
            break
        key = words[order[open_], depth]
        order[open_] = order[open_][np.lexsort((key, tie[open_]))]
        key = words[order[open_], depth]
        same = (tie[open_][1:] == tie[open_][:-1]) & (key[1:] != key[:-1])
        at = open_[1:][same]
        differ = key[1:][same] ^ key[:-1][same]
        zeros = sum((differ < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        common[at] = np.minimum(8 * depth + zeros, width)
        fresh[at] = True
        tie = np.cumsum(fresh) - 1
    edge = np.append(fresh[1:], True)
    begin, end = np.flatnonzero(fresh & ~edge), np.flatnonzero(~fresh & edge) + 1
    done = min(shallow, width)
    for a, z in zip(begin.tolist(), end.tolist(), strict=True):
        part = order[a:z]
        if done >= width:
            common[a + 1 : z] = width
            continue
        rank, lcp = blind_trie([rows[k, done:].tobytes() for k in part])
        order[a:z] = part[rank]
        common[a + 1 : z] = np.array(lcp[1:]) + done
    return order, common


def repeats(group: np.ndarray, left: np.ndarray, ctx: list[bytes], length: int) -> np.ndarray:
    """For anchors in order of place: which windows (by the bytes before the anchor) repeat one of an earlier anchor."""
    n, reach = len(group), length - GRAM
    sizes = np.array([len(c) for c in ctx], dtype=np.int64)
    flat = np.frombuffer(b"".join(ctx), dtype=np.uint8)
    first = np.cumsum(sizes) - sizes
    anchor, right = first + left, sizes - left
    col = np.arange(length)
    ahead = np.where(col < right[:, None], flat[np.minimum(anchor[:, None] + col, len(flat) - 1)], 0).astype(np.uint8)
    col = np.arange(reach)
    behind = np.where(col < left[:, None], flat[np.maximum(anchor[:, None] - 1 - col, 0)], 0).astype(np.uint8)
    order_r, common_r = suffix_order(group, ahead)
    order_l, common_l = suffix_order(group, behind, SHALLOW // 2)
    out = np.zeros((n, reach + 1), dtype=bool)
    cr, cl = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(reach + 1):
        ok = np.flatnonzero((left >= a) & (right >= length - a))
        if len(ok) < 2:
            continue
        cr[order_r] = np.cumsum(common_r < length - a)
        cl[order_l] = np.cumsum(common_l < a)
        key = cr[ok] * (n + 1) + cl[ok]
        order = np.argsort(key, kind="stable")
        out[ok[order[1:]], a] = key[order[1:]] == key[order[:-1]]
    return out


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated stretches (``did``, ``a``, ``z``) by suffix arrays of all contexts with the same gram."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        order = np.lexsort((table["pos"].to_numpy(), table["did"].to_numpy()))
        table = table.take(pa.array(order))
        did, pos = table["did"].to_numpy(), table["pos"].to_numpy().astype(np.int64)
        _, group = np.unique(table["g"].to_numpy(), return_inverse=True)
        found = repeats(group, table["left"].to_numpy().astype(np.int64), table["ctx"].to_pylist(), length)
        # runs of neighbouring windows make one stretch; more bytes before the anchor mean an earlier start
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, a = np.nonzero(edge == 1)
        _, z = np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(did[row]), pa.array(pos[row] - (z - 1)), pa.array(pos[row] - a + length)], names=["did", "a", "z"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in order of their gram; whole grams are settled together, some thousand rows at a time
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 20_000:
                continue
            g = held["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield settle(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield settle(held.combine_chunks())

    rows = contexts.select("g", "did", "pos", "left", "ctx").repartition("g").sortWithinPartitions("g")
    return rows.mapInArrow(run, "did long, a long, z long")


def _parts(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """Contexts cut by which of their windows count: those with ``lo`` to ``hi`` bytes before the anchor, ``width`` of them.

    All windows of a part hold the same bytes around the anchor, whose hash is the part's ``g``; ``c`` is the hash of the
    bytes that its windows cover. So equal windows meet in one part, a part's surroundings are fewer than the whole ones,
    and a part of one window has none besides it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in spans.slices(iter([whole]), "ctx", most=1 << 18):
                buf, begin, end = spans.pack(batch["ctx"])
                g, left, lo, hi = (batch[k].to_numpy().astype(np.int64) for k in ("g", "left", "lo", "hi"))
                anchor = begin + left
                for step in range(0, int((hi - lo).max()) + 1, width):
                    low = lo + step
                    high = np.minimum(low + width - 1, hi)
                    # windows that lie inside the text
                    some = np.flatnonzero(np.maximum(low, length - (end - anchor)) <= np.minimum(high, left))
                    low, high, at = low[some], high[some], anchor[some]
                    a, z = np.maximum(at - high, begin[some]), np.minimum(at + length - low, end[some])
                    part = (low << 32 | high).view(np.uint64)
                    key = spans.mix(spans.hash_spans(buf, at - low, at + length - high) ^ spans.mix(part))
                    around = spans.mix(spans.hash_spans(buf, a, z) ^ spans.mix((at - a << 32 | z - at).view(np.uint64)))
                    ctx = [buf[x:y].tobytes() for x, y in zip(a.tolist(), z.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), batch["did"].take(pa.array(some)),
                            batch["pos"].take(pa.array(some)), pa.array((at - a).astype(np.int32)), pa.array(ctx, pa.binary()),
                            pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                        ],
                        names=["g", "c", "did", "pos", "left", "ctx", "lo", "hi"],
                    )

    return contexts.mapInArrow(run, "g long, c long, did long, pos int, left int, ctx binary, lo int, hi int")


def _by_parts(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many surroundings: their contexts are cut into parts of ever fewer windows.

    Repeats of a part's surroundings are settled at once, parts of few surroundings by suffix arrays, and only those
    that still have very many are cut again, so a context makes a few rows instead of one per window.
    """
    hot = contexts.select("*", F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"))
    found = None
    for width in WIDTHS:
        rows = store.keep(_parts(hot, width, length), "parts")
        ordered = rows.repartitionByRange("g", "c", "did", "pos").sortWithinPartitions("g", "c", "did", "pos")
        sifted = store.keep(_sift(ordered), "sifted")
        store.drop(rows)
        full = sifted.filter("full").select(
            "did", (F.col("pos") - F.col("hi")).cast("long").alias("a"), (F.col("pos") + length - F.col("lo")).cast("long").alias("z")
        )
        open_ = sifted.filter("not full").drop("full")
        many = open_.groupBy("g").count().filter((F.col("count") > MOST) & F.lit(width > 1)).select("g")
        many = store.keep(many, "hot-grams")
        now = full.unionByName(_compare(open_.join(many, "g", "left_anti"), length))
        found = now if found is None else found.unionByName(now)
        if many.isEmpty():
            break
        hot = open_.join(many, "g", "left_semi")
    return found


def repeated_stretches(docs: DataFrame, length: int) -> DataFrame:
    """Stretches ``did``, ``a``, ``z`` of bytes in windows that start earlier too; docs: distinct ``did``, ``text``."""
    rows = store.keep(_anchor_rows(docs, length), "anchors")
    # by range over all keys, so that a gram of very many copies is dealt to several tasks
    ordered = rows.repartitionByRange("g", "c", "did", "pos").sortWithinPartitions("g", "c", "did", "pos")
    sifted = store.keep(_sift(ordered), "sifted")
    store.drop(rows)
    w = length - GRAM
    full = sifted.filter("full").select("did", (F.col("pos") - w).cast("long").alias("a"), (F.col("pos") + length).cast("long").alias("z"))
    open_ = sifted.filter("not full").select("did", "pos", "g")
    hot = store.keep(open_.groupBy("g").count().filter(F.col("count") > MOST).select("g"), "hot-grams")
    contexts = store.keep(_contexts(docs, open_, open_.count(), length), "contexts")
    found = full.unionByName(_compare(contexts.join(hot, "g", "left_anti"), length))
    if hot.isEmpty():
        return found
    return found.unionByName(_by_parts(contexts.join(hot, "g", "left_semi"), length))


def dedupe(docs: DataFrame, length: int = 100) -> DataFrame:
    """Per row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and the ``kept`` bytes.

    A byte goes if a ``length``-byte string over it also starts earlier: in a document of smaller doc_id, or earlier
    in the same one. Texts are UTF-8; null counts as empty; windows never cross documents. A null doc_id comes before
    all others. Rows that share a doc_id are ordered by a hash of their text, equal rows are one document and each get
    its result. Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text", F.lit(2)))
    # of equal texts the first stands for all; the others repeat it whole
    firsts = rows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    firsts = store.keep(firsts, "texts")
    several = firsts.filter("n > 1").select("h1", "h2", "first")
    marked = rows.join(groups.small_side(several, several.count()), ["h1", "h2"], "left")
    copy = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    marked = marked.withColumn("copy", copy)
    unique, ids = _distinct_ids(marked.filter(~copy), docs)
    found = store.keep(repeated_stretches(unique, length), "stretches")
    per_doc = found.groupBy("did").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    with_id = marked.join(ids, ["doc", "h1"], "left") if ids is not None else marked.withColumn("did", F.col("doc"))
    # stretches grow with the texts: no broadcast, which would end at some size
    joined = with_id.join(per_doc, "did", "left").select("doc_id", "text", "copy", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in spans.slices(iter([whole]), "text"):
                out = []
                for text, copied, found in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["copy"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                    n, keep, at, removed, runs = len(text), [], 0, 0, 0
                    if copied and n >= length:
                        found = [{"a": 0, "z": n}]
                    end = -1
                    for a, z in sorted((max(f["a"], 0), min(f["z"], n)) for f in found or []):
                        if a > end:
                            runs += 1
                            keep.append(text[at:a])
                        removed += max(z - max(a, at), 0)
                        end = at = max(end, z)
                    keep.append(text[max(at, 0) :])
                    left = b"".join(keep)
                    out.append((n, removed, runs, hashlib.sha256(left).hexdigest(), left))
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return joined.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def _distinct_ids(rows: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """One row per document with an id in order; where no doc_id repeats, that id is doc_id itself."""
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.select(F.col("doc").alias("did"), "text"), None
    one = rows.dropDuplicates(["doc", "h1"])
    ordered = one.select("doc", "h1").repartitionByRange("doc", "h1").sortWithinPartitions("doc", "h1")
    ids = store.keep(ordered.withColumn("did", F.monotonically_increasing_id()), "ids")
    return one.join(ids, ["doc", "h1"]).select("did", "text"), ids


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 100 bytes."""
    return dedupe(store.documents(spark, sf_dir)).drop("kept")
