"""Links between near-equal sets and their connected components, as Spark jobs.

Candidates share a band key. The members of a bucket are compared with one leader, then members of different components
with each other, inside the task that holds the bucket (or two blocks of a large one), which hands on links of the
components only. Before contents are fetched, sizes and parities of the sets refuse what can't be similar enough. That
bound is exact, so no pair that shares a key and passes the threshold is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import spans, store

#: Rows of ids (8 bytes each) that may be sent to all executors; larger tables are shuffled.
SENT_ROWS = 4_000_000
#: Bits of the parities of a set.
BITS = 512
#: Rows and elements of a block: buckets of more are compared block by block.
CELL_ROWS, CELL_SIZE = 1_536, 1 << 20

#: Keys that a task holds before it hands them on.
PACKED = 1 << 19

SetsOf = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Marks a table of counted rows for broadcasting where it is small enough."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``a``, ``b``: ``id`` and ``comp``, the least id of its component.

    Large-star and small-star rounds; each takes the least neighbour by an aggregate and joins it back, so a node
    with any number of links is no group of its own. Rounds end when every link leads straight to a least id.
    """
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = store.keep(down.distinct(), "links")
    # done: each id has one link at most, upwards or downwards, but for the least ones, which have no link downwards
    while not _ends(now).filter("n > 1 or (n = 1 and above)").isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        small = pairs.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, now = now, store.keep(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links")
        store.drop(old)
    # every id but the least of its component has one link, to the least
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp"))


def _ends(links: DataFrame) -> DataFrame:
    """Per id the number of its links to lesser ids, and whether greater ids link to it."""
    down = links.select(F.col("a").alias("id"), F.lit(1).alias("n"), F.lit(False).alias("above"))
    up = links.select(F.col("b").alias("id"), F.lit(0).alias("n"), F.lit(True).alias("above"))
    return down.unionByName(up).groupBy("id").agg(F.sum("n").alias("n"), F.max("above").alias("above"))


def joined(comps: DataFrame, more: DataFrame) -> DataFrame:
    """Components after some more links."""
    if more.isEmpty():
        return comps
    return components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more))


def _distinct(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements of each set in order, and the number of the set that each is in."""
    values, of = values.copy(), np.repeat(np.arange(len(sizes)), sizes)
    to = np.cumsum(sizes).tolist()
    for a, z in zip([0, *to], to, strict=False):
        values[a:z].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[new], of[new]


def parities(values: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    """Per set a row of ``BITS`` bits: whether an odd number of its elements fall on each.

    Elements of both sets cancel out, so two rows differ in no more bits than there are elements in one set only.
    """
    at = (spans.mix(values ^ spans.SECOND) & np.uint64(BITS - 1)).astype(np.int64)
    odd = np.bincount(of * BITS + at, minlength=count * BITS).reshape(count, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def possible(num: int, den: int, na, pa_, nb, pb) -> np.ndarray:
    """Whether den * |A and B| >= num * |A or B| can hold, by sizes and parities; exact: no such pair is refused."""
    least = np.maximum(np.abs(na - nb), np.bitwise_count(pa_ ^ pb).sum(axis=1, dtype=np.int64))
    # of na + nb elements at least so many are in one set only
    return den * (na + nb - least) >= num * (na + nb + least)


def verify(pairs: DataFrame, content: DataFrame, sets_of: SetsOf, num: int, den: int) -> DataFrame:
    """Pairs ``a``, ``b`` whose sets satisfy den * intersection >= num * union, by the contents of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in spans.slices(iter([whole]), "ta", "tb", most=1 << 20):
                sides = [_distinct(*sets_of(batch[name])) for name in ("ta", "tb")]
                (va, oa), (vb, ob) = sides
                na, nb = (np.bincount(x, minlength=batch.num_rows) for x in (oa, ob))
                # both sets of a pair side by side; what both hold is there twice
                both = np.empty(len(va) + len(vb), dtype=np.uint64)
                both[np.arange(len(va)) + (np.cumsum(nb) - nb)[oa]] = va
                both[np.arange(len(vb)) + np.cumsum(na)[ob]] = vb
                union = np.bincount(_distinct(both, na + nb)[1], minlength=batch.num_rows)
                common = na + nb - union
                ok = pa.array((den * common >= num * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([batch["a"].filter(ok), batch["b"].filter(ok)], names=["a", "b"])

    full = pairs.join(content.select(F.col("id").alias("a"), F.col("content").alias("ta")), "a")
    full = full.join(content.select(F.col("id").alias("b"), F.col("content").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _shared_keys(rows: DataFrame, by: str) -> DataFrame:
    """Rows whose key has several values of ``by``."""
    keys = rows.groupBy("key").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).filter("lo < hi").select("key")
    return rows.join(keys, "key")


def _shared(keyed: DataFrame) -> DataFrame:
    """Distinct ``key``, ``id`` of the keys with several ids, by one shuffle.

    Rows are sorted by range over both columns, so a key of very many ids is dealt to several tasks, and read in order.
    A lone id next to the border of a partition may stay; it finds no partner later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = None  # the last row, and the first id of its key while no second one is met
        for batch in batches:
            if not batch.num_rows:
                continue
            key, id_ = batch["key"].to_numpy(), batch["id"].to_numpy()
            new_key, new = np.ones(len(key), bool), np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new[1:] = new_key[1:] | (id_[1:] != id_[:-1])
            if last:
                new_key[0] = key[0] != last[0]
                new[0] = new_key[0] or id_[0] != last[1]
            at = np.flatnonzero(new)
            k, i, first = key[at], id_[at], new_key[at]
            if len(at):
                keep = ~first
                keep[:-1] |= ~first[1:]
                keep[0] |= last is None
                if held and not first[0]:
                    k, i, keep = np.append(k, held[0]), np.append(i, held[1]), np.append(keep, True)
                held = None if keep[len(at) - 1] else (key[at[-1]], id_[at[-1]])
                yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(i[keep])], names=["key", "id"])
            last = (key[-1], id_[-1])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]])], names=["key", "id"])

    ordered = keyed.select("key", "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return ordered.mapInArrow(run, "key long, id long")


def _parts(spark: SparkSession) -> int:
    """The number of parts that keys are dealt into, a power of two."""
    return 1 << max(10, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def packed(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Keys and ids as ``part``, by the first bits of the key, ``keys`` (its last 32 bits) and ``ids``: many of them in a row.

    keys_of: keys and ids of batches. Spark shuffles a row per task and part instead of one per key.
    """
    parts = _parts(rows.sparkSession)
    shift = np.uint64(64 - parts.bit_length() + 1)

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        bounds = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(bounds))
        last = keys.astype(np.uint32)
        edges = list(zip(bounds[full].tolist(), bounds[full + 1].tolist(), strict=True))
        cols = [pa.array([x[a:z].tobytes() for a, z in edges], pa.binary()) for x in (last, ids)]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *cols], names=["part", "keys", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in keys_of(batches):
            held.append(found)
            n += len(found[0])
            if n >= PACKED:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return rows.mapInArrow(run, "part int, keys binary, ids binary")


def meeting(rows: DataFrame) -> DataFrame:
    """Distinct ``key``, ``id`` of the packed keys that several ids have."""

    def settle(part: int, keys: list[bytes], ids: list[bytes]) -> pa.RecordBatch:
        key, id_ = np.frombuffer(b"".join(keys), np.uint32), np.frombuffer(b"".join(ids), np.int64)
        order = np.argsort(key)
        key = key[order]
        again = key[1:] == key[:-1]
        some = np.append(again, False) | np.append(False, again)
        key, id_ = key[some], id_[order[some]]
        order = np.lexsort((id_, key))
        key, id_ = key[order], id_[order]
        new = np.append(True, (key[1:] != key[:-1]) | (id_[1:] != id_[:-1]))[: len(key)]
        key, id_ = key[new], id_[new]
        again = key[1:] == key[:-1]
        some = (np.append(again, False) | np.append(False, again))[: len(key)]
        key = key[some].astype(np.int64) | part << 32
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(id_[some])], names=["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, ids = None, [], []
        for batch in batches:
            for part, k, i in zip(*(batch[c].to_pylist() for c in ("part", "keys", "ids")), strict=True):
                if part != last and keys:
                    yield settle(last, keys, ids)
                    keys, ids = [], []
                last = part
                keys.append(k)
                ids.append(i)
        if keys:
            yield settle(last, keys, ids)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "key long, id long")


def _with(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _sized(content: DataFrame, sets_of: SetsOf) -> DataFrame:
    """Adds ``n``, the size of each content's set, and ``odd``, its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in spans.slices(iter([whole]), "content", most=1 << 20):
                values, of = _distinct(*sets_of(batch["content"]))
                n = np.bincount(of, minlength=batch.num_rows)
                odd = parities(values, of, batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], batch["content"], pa.array(n, pa.int64()), pa.array([x.tobytes() for x in odd], pa.binary())],
                    names=["id", "content", "n", "odd"],
                )

    return content.select("id", "content").mapInArrow(run, "id long, content string, n long, odd binary")


def _bits(column: pa.Array) -> np.ndarray:
    """Parities as rows of 64-bit words."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, dtype=np.uint64).reshape(len(column), BITS // 64)


def _near_leaders(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct ``a``, ``b`` of the pairs that sizes and parities allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ok = pa.array(possible(num, den, batch["na"].to_numpy(), _bits(batch["oa"]), batch["nb"].to_numpy(), _bits(batch["ob"])))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(ok), batch["b"].filter(ok)], names=["a", "b"])

    return pairs.select("a", "na", "oa", "b", "nb", "ob").mapInArrow(run, "a long, b long").distinct()


def _whole_cells(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of whole cells (``key``, ``i``, ``j``) from rows in their order, about ``most`` bytes at a time."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.nbytes
        if n < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.flatnonzero(_cell_starts(table))[-1])
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut).to_batches()
        n = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _cell_starts(table: pa.Table) -> np.ndarray:
    """Whether a row begins a cell."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for c in ("key", "i", "j"):
        v = table[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _cells(rows: DataFrame) -> DataFrame:
    """Deals buckets into cells ``i``, ``j``: a large bucket is cut into blocks, and each pair of blocks is a cell.

    A cell has about ``CELL_ROWS`` rows or ``CELL_SIZE`` elements per block; ``block`` is the one that a row is in.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / CELL_ROWS), F.ceil(F.col("total") / CELL_SIZE)).cast("int")
    dealt = rows.join(sizes.select("key", blocks.alias("blocks")), "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = {"i": F.least("block", "other"), "j": F.greatest("block", "other")}
    return dealt.withColumns(cell).drop("blocks", "other")


def _with_partner(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of the buckets to which sizes and parities leave a partner of another component: ``key``, ``id``, ``comp``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches, 2 << 20):
            cell = np.cumsum(_cell_starts(table))
            comp, n, block = (table[c].to_numpy() for c in ("comp", "n", "block"))
            apart = table["i"].to_numpy() != table["j"].to_numpy()
            odd = _bits(table["odd"])
            found = np.zeros(len(cell), dtype=bool)
            left, step = np.arange(len(cell)), 1
            while True:
                left = left[left + step < len(cell)]
                left = left[cell[left] == cell[left + step]]
                if not len(left):
                    break
                a = left[(comp[left] != comp[left + step]) & (~apart[left] | (block[left] != block[left + step]))]
                a = a[possible(num, den, n[a], odd[a], n[a + step], odd[a + step])]
                found[a] = found[a + step] = True
                step += 1
            out = table.select(["key", "id", "comp", "n"]).filter(pa.array(found)).combine_chunks()
            yield from out.to_batches()

    dealt = _cells(rows).select("key", "i", "j", "block", "id", "comp", "n", "odd")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "key long, id long, comp long, n long").distinct()


def _common(values: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    """The number of common elements of any two of some sets."""
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    several = np.bincount(column) > 1
    inside = several[column]
    column, of = (np.cumsum(several) - 1)[column[inside]], of[inside]
    out = np.zeros((count, count), dtype=np.int32)
    total = int(several.sum())
    width = min(max((4 << 20) // count, 1), total)
    for k in range(0, total, max(width, 1)):
        a, z = np.searchsorted(column, [k, k + width])
        part = np.zeros((count, width), dtype=np.float32)
        part[of[a:z], column[a:z] - k] = 1
        out += (part @ part.T).astype(np.int32)
    return out


def _settle(rows: DataFrame, content: DataFrame, sets_of: SetsOf, num: int, den: int) -> DataFrame:
    """Links ``a``, ``b`` that join what is similar within the buckets; each row of a cell has one at most.

    All pairs of a cell are compared on their whole sets inside the task, and only their components leave it.
    """

    def links(table: pa.Table, values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        id_, comp, block = (table[c].to_numpy() for c in ("id", "comp", "block"))
        n = np.bincount(of, minlength=len(id_)).astype(np.int32)
        common = _common(values, of, len(id_))
        near = (den * common >= num * (n[:, None] + n - common)) & (common > 0) & (comp[:, None] != comp)
        if table["i"][0] != table["j"][0]:
            near &= block[:, None] != block
        label = np.arange(len(id_), dtype=np.int32)
        while True:
            least = np.minimum(np.where(near, label, np.int32(len(id_))).min(axis=1), label)
            if (least == label).all():
                break
            label = least
        some = label != np.arange(len(id_))
        return id_[some], id_[label[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (part for whole in batches for part in spans.slices(iter([whole]), "content", most=1 << 20))
        for table in _whole_cells(small, 2 << 20):
            values, of = _distinct(*sets_of(table["content"].combine_chunks()))
            bounds = [*np.flatnonzero(_cell_starts(table)).tolist(), table.num_rows]
            edges = np.searchsorted(of, bounds).tolist()
            found = [
                links(table.slice(a, z - a), values[v:w], of[v:w] - a)
                for a, z, v, w in zip(bounds[:-1], bounds[1:], edges[:-1], edges[1:], strict=True)
                if z - a > 1
            ]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = _cells(rows).join(content.select("id", "content"), "id")
    dealt = dealt.select("key", "i", "j", "block", "id", "comp", "content")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def link(
    keyed: DataFrame,
    copies: DataFrame,
    fetch: Callable[[DataFrame, int], DataFrame],
    sets_of: SetsOf,
    num: int,
    den: int,
) -> DataFrame:
    """Components of the items that share keys and are similar enough: ``id``, ``comp`` of all but the least ids.

    keyed: ``key``, ``id``. The rest as in ``link_shared``.
    """
    return link_shared(store.keep(_shared(keyed), "candidates"), copies, fetch, sets_of, num, den)


def link_shared(
    shared: DataFrame,
    copies: DataFrame,
    fetch: Callable[[DataFrame, int], DataFrame],
    sets_of: SetsOf,
    num: int,
    den: int,
) -> DataFrame:
    """Components by a written table of the distinct ``key``, ``id`` of keys with several ids.

    copies: ``id`` and ``copies``, how common an item is; the most common of a bucket leads.
    fetch: the contents (``id``, ``content``) of a table of ids with a known count.
    """
    ids = store.keep(shared.select("id").distinct(), "ids")
    count = ids.count()
    # of several contents of an id (texts under one hash) one stands for it
    content = store.keep(_sized(fetch(ids, count), sets_of), "contents")
    about = content.groupBy("id").agg(F.min(F.struct("n", "odd")).alias("s")).select("id", "s.n", "s.odd")
    about = about.join(copies.join(small_side(ids, count), "id", "left_semi"), "id")
    about = store.keep(about, "sizes")
    cand = shared.join(about, "id")

    lead = cand.groupBy("key").agg(F.min(F.struct((-F.col("copies")).alias("r"), "id", "n", "odd")).alias("l"))
    pairs = cand.join(lead, "key").filter("id <> l.id")
    size = F.least("n", "l.n")
    pairs = pairs.filter(den * size >= num * F.greatest("n", "l.n"))
    pairs = pairs.select(
        F.col("id").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"),
        F.col("l.id").alias("b"), F.col("l.n").alias("nb"), F.col("l.odd").alias("ob"),
    )
    near = store.keep(_near_leaders(pairs, num, den), "pairs")
    links = store.keep(verify(near, content, sets_of, num, den), "verified")
    comps = components(links)

    # keys that still join several components
    rest = _shared_keys(_with(shared, comps), "comp").join(about.drop("copies"), "id")
    rest = store.keep(_with_partner(rest, num, den), "rest")
    last = store.keep(_settle(rest, content, sets_of, num, den), "verified")
    return joined(comps, last)
