"""Exact set similarity join on word shingles: light sets by subsets, heavy sets by inverted lists.

*Light* sets are so small that all subsets of the overlap's size can be enumerated: two of them link if and only if
they share one. *Heavy* sets are found through inverted lists. A list stands for the content of one block of a set,
where blocks are fixed ranges of the elements' hashes. If two sets differ in at most h elements, at most h blocks
differ, so of the first h + 1 blocks that hold anything one is the same in both: each set has only so many lists.
A block holds several elements, so a passage that many documents share makes no long list by itself. A set that has
so few blocks that this says nothing is listed by single elements too. The sizes at which subsets cost more than
lists, by the length of the lists as it is measured, part light from heavy; sets near that boundary do both.

Elements that are common all over the corpus are left out of the blocks, for the same bound of h holds without
them; sets that have too little else use all of their elements too.

Chance alone lets sets share a key, the more of them the larger the corpus, until most of them hang together. So of each
list those are linked whose *sketches* allow it: a sketch counts a set's elements by ranges of their hashes, and two sets
differ in no fewer elements than their counts do. Linked sets form clusters; all links of similar sets lie inside of them.
A small cluster is compared in one task, a large one with a fixed number of pivots; what falls outside
its largest component after that is compared with the whole cluster, block by block.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, exp, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import at_work, durable, in_batches, met, remembers, rows_of, small_batches, small_side
from .graph import components

LEVEL = 1.5
_M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def mix(x):
    """A bijection of uint64 arrays that spreads the bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> 64-bit hash, remembered up to a bound. The upper 5 bits are the word's length (31 at most), so that the
    greatest hash of some words is that of a longest one."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        got = min(len(word), 31) << 59 | xxhash.xxh3_64_intdigest(word) >> 5
        if len(self) > 250_000:
            self.clear()
        self[word] = got
        return got


_WORDS = Words()
remembers("shingles", _WORDS.clear)


def word_hashes(text: str | None):
    """Hashes of the text's words, A-Z lower-cased."""
    import numpy as np

    words = text.encode("utf-8", "replace").lower().split() if text else []  # for bytes: ASCII only, in both steps
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, k: int = 5):
    """Sorted distinct hashes of the k-word shingles; of all words as one shingle if there are fewer."""
    import numpy as np

    w = word_hashes(text)
    n = min(k, len(w))
    if n == 0:
        return w
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(_M1) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def overlap(a: int, b: int, num: int, den: int) -> int:
    """Least intersection of sets of sizes a and b whose similarity is num / den or more."""
    return -(-num * (a + b) // (num + den))


@lru_cache(maxsize=100_000)
def most_apart(a: int, num: int, den: int) -> int:
    """Most elements in which a set of size a and a similar one that isn't smaller can differ."""
    b = a * den // num
    return max((a + c - 2 * overlap(a, c, num, den) for c in range(a, b + 1)), default=0) if b - a < 200 else (den - num) * (a + b) // (num + den)


@lru_cache(maxsize=None)
def sizes_to_try(a: int, num: int, den: int) -> tuple[int, ...]:
    """The sizes of subsets by which a set of size a can be found."""
    return tuple(sorted({overlap(a, b, num, den) for b in range(-(-a * num // den), a * den // num + 1)}))


@lru_cache(maxsize=16)
def boundary(num: int, den: int, list_length: float = 10.0, scan: float = 0.05) -> int:
    """The largest light set: up to it, no size costs more by subsets than by lists. The unit is a key. A heavy set
    costs its keys, and the comparison scans a list of ``list_length`` sets for each element, at ``scan`` for an entry."""
    a = 1
    while sum(comb(a + 1, c) for c in sizes_to_try(a + 1, num, den)) <= (most_apart(a + 1, num, den) + 1) * len(_levels(a + 1, num, den)) + scan * list_length * (a + 1):
        a += 1
    return a


@lru_cache(maxsize=4096)
def _subsets(a: int, c: int):
    from itertools import combinations

    import numpy as np

    return np.array(list(combinations(range(a), c)), dtype=np.int64)


def light_keys(s, num: int, den: int):
    import numpy as np

    mixed, out = mix(s), []
    for c in sizes_to_try(len(s), num, den):
        out.append(mix(mixed[_subsets(len(s), c)].sum(axis=1, dtype=np.uint64) ^ np.uint64(c << 56 | 1)))
    return np.concatenate(out)


def _levels(a: int, num: int, den: int) -> list[int]:
    """Upper ends of the size levels by which a set of size a is listed: its own, and the next if a partner's."""
    top = 8
    while top <= a:
        top = int(top * LEVEL) + 1
    out = [top]
    if a * den // num >= top:
        out.append(int(top * LEVEL) + 1)
    return out


@lru_cache(maxsize=1024)
def block_count(top: int, num: int, den: int) -> int:
    """Blocks of a level of sets up to the size ``top``: so few that they hold several elements each, yet so many
    that by seven standard deviations 1.15 times as many hold any as can differ. Small sets get more blocks."""
    need, each = most_apart(top, num, den) + 1, 6.0
    while each > 0.5:
        blocks, empty = top / each, exp(-each)
        if blocks * (1 - empty) - 7 * sqrt(blocks * empty * (1 - (1 + each) * empty)) >= 1.15 * need:
            break
        each -= 0.05
    return max(ceil(top / each), min(2 * top, 48))


def heavy_keys(s, common, num: int, den: int):
    """Keys of the blocks that stand for a set; common: sorted hashes of frequent elements."""
    import numpy as np

    need, out = most_apart(len(s), num, den) + 1, []
    usual = np.zeros(len(s), bool)
    if len(common):
        usual = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    short = False
    for top in _levels(len(s), num, den):
        blocks, found = block_count(top, num, den), 0
        for domain, part in ((1, s[~usual]), (2, s)):
            # sets that have no block in common have no more blocks than can differ, both of them
            if found >= need or not len(part):
                continue
            block = (part >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            found = len(starts)
            sums = np.add.reduceat(mix(part), starts)[:need]
            out.append(mix(sums ^ mix(block[starts[:need]] * np.uint64(_M1) + np.uint64(top << 8 | domain << 1))))
        short |= found < need
    if short:  # of the first elements in one order for all sets, as many as can differ and one more, one is in both
        first = np.concatenate((s[~usual], s[usual]))[:need]
        out.append(mix(first ^ np.uint64(0x5851F42D4C957F2D)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def keys_of(s, common, num: int, den: int, edge: int | None = None):
    """All keys of a set: two similar sets have one in common, if both have the same edge, the largest light size."""
    import numpy as np

    edge, out = edge or boundary(num, den), []
    if len(s) <= edge:
        out.append(light_keys(s, num, den))
    if len(s) * den >= num * (edge + 1):
        out.append(heavy_keys(s, common, num, den))
    return np.unique(np.concatenate(out))


def sketch(s) -> bytes:
    """Elements by ranges of their hashes, modulo 256: 4 to 8 to a range on average, 32 ranges or more."""
    import numpy as np

    bits = max(5, (max(len(s), 1) - 1).bit_length() - 3)
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8).tobytes()


def may_link(n, x, m, y, num: int, den: int):
    """Which sets of sizes n with sketches x (a row each) may be similar to those of sizes m with sketches y: all that are,
    as the counts of two sets differ by no more than the sets do."""
    import numpy as np

    while x.shape[1] > y.shape[1]:
        x = x[:, ::2] + x[:, 1::2]
    while y.shape[1] > x.shape[1]:
        y = y[:, ::2] + y[:, 1::2]
    apart = np.abs((x - y).view(np.int8)).view(np.uint8).sum(axis=1, dtype=np.int64)  # modulo 256, the nearer way round
    return apart <= n + m + 2 * (-num * (n + m) // (num + den))


def linked_in_list(sizes, sketches: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of places that join all sets of a list that may be similar, be it by way of others."""
    import numpy as np

    groups: dict[int, list[int]] = {}
    for i, x in enumerate(sketches):
        groups.setdefault(len(x), []).append(i)
    held = [(np.array(at), np.frombuffer(b"".join(sketches[i] for i in at), np.uint8).reshape(len(at), width)) for width, at in sorted(groups.items())]
    label, out = np.arange(len(sketches)), []
    for g, (at, rows) in enumerate(held):
        for i, row in zip(at.tolist(), rows, strict=True):
            for there, others in held[g:]:
                on = (there > i if others is rows else np.ones(len(there), bool)) & (label[there] != label[i])
                on &= num * np.maximum(sizes[there], sizes[i]) <= den * np.minimum(sizes[there], sizes[i])
                on = np.flatnonzero(on)
                if not len(on):
                    continue
                hits = there[on[may_link(sizes[i], row[None], sizes[there[on]], others[on], num, den)]]
                if len(hits):
                    out.extend((i, j) for j in hits.tolist())
                    label[np.isin(label, label[hits])] = label[i]
    return out


class Lists:
    """Inverted lists over some sets."""

    def __init__(self, sets):
        import numpy as np

        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.elements, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def similar(self, x, num: int, den: int):
        """Places of the sets that are similar to x."""
        import numpy as np

        lo, hi = np.searchsorted(self.elements, x, "left"), np.searchsorted(self.elements, x, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(den * both >= num * (len(x) + self.sizes - both))


def local_roots(sets, num: int, den: int) -> list[int]:
    """For each set, the first set of its component."""
    lists, root = Lists(sets), list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in lists.similar(sets[i], num, den).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def _sets(df: DataFrame, id_col: str, text_col: str, k: int, share: float, window: int = 2000) -> DataFrame:
    """(id, n, digest, name, sketch) of each row; and, without digest, of ``window`` documents in a row (n: minus the documents,
    name: the element) of the elements that are frequent, and (n: entries of all their elements' lists, no name)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    arrow = to_arrow_type(kind)
    names_of = ["id", "n", "digest", "name", "sketch"]

    def run(batches):
        import numpy as np
        import xxhash

        at_work("shingles")
        held = []

        def often():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            on = n >= max(3, len(held) * share / 2)
            m = int(on.sum())
            counts = np.append(-n[on].astype(np.int64), np.dot(n, n))
            return pa.RecordBatch.from_arrays([pa.nulls(m + 1, arrow), pa.array(counts, pa.int64()), pa.nulls(m + 1, pa.binary()), pa.array([*h[on].view(np.int64).tolist(), None], pa.int64()), pa.nulls(m + 1, pa.binary())], names_of)

        for batch in batches:
            ns, digests, names, sketches = [], [], [], []
            for _, t in rows_of(batch):
                raw = (s := shingles(t, k)).tobytes()
                ns.append(len(s))
                digests.append(xxhash.xxh3_128_digest(raw))
                names.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
                sketches.append(sketch(s))
                held.append(s)
                if len(held) >= window:
                    yield often()
                    held.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(names, pa.int64()), pa.array(sketches, pa.binary())], names_of)
        if len(held) >= window / 10:  # too few say nothing
            yield often()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind.simpleString()}, n long, digest binary, name long, sketch binary")


def common_elements(table: DataFrame, documents: int, share: float):
    """Sorted hashes of elements that about ``share`` of the documents have: no more than twice the mean set
    size over ``share``, 10 MB for sets of 600. Which of the doubtful ones are in changes the cost only."""
    import numpy as np

    counts = table.where("digest is null and name is not null").groupBy("name").agg((-F.sum("n")).alias("n")).where(F.col("n") >= max(documents * share / 2, 3.0))
    return np.sort(np.array([r.name_ for r in counts.select(F.col("name").alias("name_")).collect()], np.int64).view(np.uint64))


def _sized(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """(digest, name, rep, cluster, members) of the sets that are in a cluster."""
    got = durable(sets.select("digest", "name", "rep").join(clusters.select(F.col("node").alias("name"), F.col("component").alias("cluster")), "name"))
    members = durable(got.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")))
    return durable(met(got, members, "cluster", "members", F.xxhash64("digest")).select("digest", "name", "rep", "cluster", "members"))


def _postings(texts: DataFrame, k: int, num: int, den: int, common, edge: int) -> DataFrame:
    """(key, name) of each distinct set; a task lists a set that it has listed before only now and then."""
    import pyarrow as pa

    def run(batches):
        import numpy as np
        import xxhash

        at_work("shingles")
        seen: set[int] = set()
        for batch in batches:
            keys, names, counts = [], [], []

            def out():
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), counts))], ["key", "name"])

            for (t,) in rows_of(batch):
                s = shingles(t, k)
                if not len(s):
                    continue
                name = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                if name in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                keys.append(keys_of(s, common, num, den, edge))
                names.append(name)
                counts.append(len(keys[-1]))
                if len(keys) >= 2000:
                    yield out()
                    keys, names, counts = [], [], []
            if keys:
                yield out()

    return texts.select("text").mapInArrow(run, "key long, name long")


def _near(postings: DataFrame, sets: DataFrame, num: int, den: int, few: int = 3) -> DataFrame:
    """(a, b): names of sets that share a list and may be similar by their sketches, or others that lead from one to the other
    likewise. sets: (name, n, sketch). Of a list of ``few`` each pair is looked at once, whatever lists it is in, and of
    the longer ones those with the same members once."""
    import pyarrow as pa

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def lists(batches):
        import numpy as np

        def out(key, name):
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(key)])))
            pairs = [np.zeros((0, 2), np.int64)]
            for size in range(2, few + 1):
                at = starts[sizes == size]
                pairs += [np.stack((name[at + i], name[at + j]), 1) for j in range(size) for i in range(j)]
            pairs = np.unique(np.concatenate(pairs), axis=0)
            long = sizes > few
            held = np.repeat(long, sizes)
            alike = np.add.reduceat(mix(name.view(np.uint64)), starts)[long].view(np.int64)
            columns = [pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, ["list", "a", "b"])
            columns = [pa.array(np.repeat(alike, sizes[long])), pa.array(name[held]), pa.nulls(int(held.sum()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["list", "a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                key, name = np.concatenate((last[0], key)), np.concatenate((last[1], name))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])))
            key, name = key[new], name[new]
            cut = int(np.searchsorted(key, key[-1]))  # the last list may go on
            last = key[cut:], name[cut:]
            if cut:
                yield from out(key[:cut], name[:cut])
        if last is not None:
            yield from out(*last)

    found = durable(postings.repartition(n, "key").sortWithinPartitions("key", "name").mapInArrow(lists, "list long, a long, b long").distinct())

    def edges(got):
        a, b = zip(*got, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def pairwise(batches):
        import numpy as np

        for batch in batches:
            groups: dict[tuple[int, int], list[tuple]] = {}
            for row in rows_of(batch):
                groups.setdefault((len(row[3]), len(row[5])), []).append(row)
            for (width, other), rows in groups.items():
                a, b, sizes, x, others, y = zip(*rows, strict=True)
                x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(len(rows), w) for z, w in ((x, width), (y, other)))
                on = np.flatnonzero(may_link(np.array(sizes), x, np.array(others), y, num, den)).tolist()
                if on:
                    yield edges([(a[i], b[i]) for i in on])

    def listwise(batches):
        import numpy as np

        now, held = None, []

        def out():
            got = linked_in_list(np.array([n for _, n, _ in held]), [x for _, _, x in held], num, den)
            if got:
                yield edges([(held[i][0], held[j][0]) for i, j in got])

        for batch in batches:
            for at, name, size, x in rows_of(batch):
                if at != now:
                    if held:
                        yield from out()
                    now, held = at, []
                held.append((name, size, x))
        if held:
            yield from out()

    one = sets.select(F.col("name").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x_a"))
    two = sets.select(F.col("name").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("x_b"))
    pairs = found.where("list is null").select("a", "b").join(one, "a").join(two, "b")
    # of sets that are too different in size not even the sketches move on
    pairs = pairs.where(num * F.greatest("n_a", "n_b") <= den * F.least("n_a", "n_b"))
    some = found.where("list is not null").select("list", "a").join(one, "a").repartition(n, "list").sortWithinPartitions("list", "a")
    return (
        pairs.select("a", "b", "n_a", "x_a", "n_b", "x_b").mapInArrow(pairwise, "a long, b long")
        .unionByName(some.select("list", "a", "n_a", "x_a").mapInArrow(listwise, "a long, b long"))
    )


def similarity_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, cluster_in_task: int = 4096, pivots: int = 64, share: float = 0.001) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id`` (smallest id reachable by links, itself
    included), ``n_same`` (rows with the very same set).

    Rows link when ``den * intersection >= num * union``. A null, empty or blank text has no shingles and links with
    nothing. Ids may repeat and may be null; a component without any other id has a null one. An empty table gives
    no rows; other columns are ignored.
    """
    table = durable(_sets(small_batches(df), id_col, text_col, k, share))
    docs = table.where("digest is not null")
    same = durable(docs.where("n > 0").groupBy("digest", "name", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_same"), F.first("sketch").alias("sketch")))
    sizes = table.agg(F.count("digest").alias("docs"), F.sum(F.when(F.col("digest").isNotNull(), F.col("n"))).alias("entries"), F.sum(F.when(F.col("digest").isNull() & F.col("name").isNull(), F.col("n"))).alias("scanned")).first()
    edge = boundary(num, den, (sizes.scanned or 0) / max(sizes.entries or 0, 1))
    common = common_elements(table, sizes.docs, share)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sized = _sized(same, components(_near(_postings(texts, k, num, den, common, edge), same, num, den)))
    is_large = F.col("members") > cluster_in_task
    linked = _in_tasks(_with_text(sized.where(~is_large), texts), k, num, den)
    if sized.where(is_large).limit(1).count():
        linked = linked.unionByName(_in_blocks(_with_text(sized.where(is_large), texts), k, num, den, pivots))
    # only sets that aren't alone have anything to learn
    linked = durable(same.select("digest", "rep").join(linked, "digest"))
    first = durable(linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("sets")))
    named = met(linked, first.where("sets > 1"), "root", "sets", F.col("digest")).where("sets is not null").select("digest", "component_id", "sets")
    named = durable(same.select("digest", "rep", "n_same").join(named, "digest", "left").where("n_same > 1 or sets is not null").select("digest", F.when(F.col("sets").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"), "n_same"))
    spread = F.unhex(F.sha2(F.concat_ws("/", F.hex("digest"), F.col("id").cast("string")), 256))
    return met(docs.drop("sketch"), named, "digest", "n_same", spread, asks=F.col("n") > 0).select(
        "id", F.col("n").alias("n_shingles"),
        F.when(F.col("n_same").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_same", F.lit(1)).cast("long").alias("n_same"),
    )


def _with_text(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(cluster, members, digest, text): some sets with the texts of the rows that have their representative's id."""
    sets = small_side(sets)
    return texts.join(sets, texts.id.eqNullSafe(sets.rep)).select("cluster", "members", "digest", "text")


def _in_tasks(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(digest, root) of clusters that a task can hold."""
    import pyarrow as pa

    def run(batches):
        import numpy as np
        import xxhash

        at_work("shingles")
        now, held = None, {}

        def out():
            digests = list(held)
            roots = local_roots([np.frombuffer(held[d], np.uint64) for d in digests], num, den)
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([digests[r] for r in roots], pa.binary())], ["digest", "root"])

        for batch in batches:
            for cluster, digest, text in rows_of(batch):
                if cluster != now:
                    if held:
                        yield out()
                    now, held = cluster, {}
                raw = shingles(text, k).tobytes()
                if xxhash.xxh3_128_digest(raw) == digest:  # rows with another text may have the same id
                    held[digest] = raw
        if held:
            yield out()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("cluster", "digest", "text").repartition(n, "cluster").sortWithinPartitions("cluster", "digest").mapInArrow(run, "digest binary, root binary")


def _meet(few: DataFrame, members: DataFrame, num: int, den: int, dealt: int = 2048) -> DataFrame:
    """(a, b): similar sets. ``few``: (cluster, part, digest, raw), a bounded number for each part; each part meets all
    members of its cluster, which are dealt out ``dealt`` at a time."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        at_work("shingles")
        now, held, lists = None, {}, None
        for batch in batches:
            for cluster, part, salt, late, digest, raw in rows_of(batch):
                if (cluster, part, salt) != now:
                    now, held, lists = (cluster, part, salt), {}, None
                if not late:
                    held[digest] = np.frombuffer(raw, np.uint64)
                    continue
                if not held:
                    continue
                if lists is None:
                    names, lists = list(held), Lists(list(held.values()))
                got = [names[j] for j in lists.similar(np.frombuffer(raw, np.uint64), num, den).tolist() if names[j] != digest]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(got), pa.binary()), pa.array(got, pa.binary())], ["a", "b"])

    n = int(few.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.col("members") / dealt).cast("int")
    left = few.select("cluster", "part", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(False).alias("late"), "digest", "raw")
    right = members.join(few.select("cluster", "part").distinct(), "cluster").select("cluster", "part", F.pmod(F.hash("digest"), salts).alias("salt"), F.lit(True).alias("late"), "digest", "raw")
    both = left.unionByName(right).repartition(n, "cluster", "part", "salt").sortWithinPartitions("cluster", "part", "salt", "late", "digest")
    return both.mapInArrow(run, "a binary, b binary")


def _in_blocks(rows: DataFrame, k: int, num: int, den: int, pivots: int, block: int = 1024) -> DataFrame:
    """(digest, root) of clusters of any size: a task holds ``pivots`` sets, or about ``block``, and a stream of others."""
    import pyarrow as pa

    def run(batches):
        import xxhash

        at_work("shingles")

        def sets():
            for batch in batches:
                for cluster, members, digest, text in rows_of(batch):
                    raw = shingles(text, k).tobytes()
                    if xxhash.xxh3_128_digest(raw) == digest:
                        yield cluster, members, digest, raw

        yield from in_batches(sets(), pa.schema([("cluster", pa.int64()), ("members", pa.int64()), ("digest", pa.binary()), ("raw", pa.binary())]), lambda r: len(r[3]))

    sets = durable(rows.mapInArrow(run, "cluster long, members long, digest binary, raw binary").dropDuplicates(["digest"]))
    order = Window.partitionBy("cluster").orderBy(F.xxhash64("digest"), "digest")
    first = sets.select("cluster", "digest").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= pivots).select("digest")
    chosen = sets.join(first, "digest", "left_semi").withColumn("part", F.lit(0).cast("long"))
    edges = durable(_meet(chosen, sets, num, den))
    label = components(edges)
    labelled = durable(sets.join(label, sets.digest == label.node, "left").select("cluster", "members", "digest", "raw", F.coalesce("component", "digest").alias("label")))
    largest = labelled.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max(F.struct("count", "label"))["label"].alias("largest"))
    outside = labelled.join(largest, "cluster").where("label <> largest")
    parts = outside.withColumn("part", F.pmod(F.xxhash64("digest"), F.greatest(F.ceil(F.col("members") / block), F.lit(1))))
    final = components(edges.unionByName(_meet(parts, labelled, num, den)))
    return final.select(F.col("node").alias("digest"), F.col("component").alias("root"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that have their component's id, or no shingles: one document of each group. Rows that
    repeat an id with the same text stay together; a null id stays."""
    out = similarity_components(df, id_col, text_col, **options)
    gone = durable(out.where(F.col("component_id").isNotNull() & (F.col("id") != F.col("component_id"))).select(F.col("id").alias("gone_id")).distinct())
    gone = small_side(gone)
    return df.join(gone, df[id_col] == gone["gone_id"], "left_anti")
