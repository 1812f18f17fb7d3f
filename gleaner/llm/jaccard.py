"""Near copies by Jaccard similarity of word shingles, with adaptive multi-match prefixes.

Documents with equal shingle sets are one class, named by a hash of the set. All classes order
their shingles alike, rare ones first: a bounded table ranks the shingles that are frequent within
stretches of the corpus, the rest count as rare, ties go by hash. If the Jaccard similarity is at
least t, the prefixes of ``n - ceil(t n) + l`` shingles share at least l of them, for any l. A class
picks the l whose longer prefix is estimated to cost least, from the frequencies of the shingles
in it; two classes need as many shared prefix shingles as the smaller of their l before they are
verified on their whole sets. The frequency table only steers cost, never the result.

Pairs are never all emitted. First each posting list links its members to one pivot; verified links
make components. Of a list with several components every member outside the most common one then
names its nearest by sketches of the whole sets; the one that most of its lists name is verified, and
the links among these join components. What is left is compared by components: a member visits each
larger component that it meets in as many lists as the prefixes ask for and that sketches do not
rule out. Components are dealt in blocks of bounded size, a block holds its members' whole sets,
and a visitor gives one link a block at most. So a group of n near copies costs about n rows a
list, and no link between different components is lost. The longest lists are compared in pairs of
blocks, each a group of its own, so that no task holds such a list.

A null or empty text, or one without words, has an empty set and is linked with nothing. Repeated
rows fall in one class. Rows without an id get the id of their class, or null. An empty table gives
no rows. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.llm.common import FILTER_BITS, dealt, distinct, documents, filter_words, materialize, ranges, remove, trimmed
from gleaner.llm.components import connected_components
from gleaner.llm.shingles import set_hash, shingle_sets

#: Rows of the frequency table, local count from which a shingle enters it, shingles of a stretch.
FREQUENT, LOCAL, STRETCH = 1 << 18, 3, 1 << 20
#: Largest l, the estimated cost of verifying a candidate against that of one posting, and the other
#: classes that are expected to hold a shingle outside the frequency table.
MOST_MATCHES, VERIFY_COST, RARE = 6, 8.0, 0.5
CLASSES = "kind int, doc_id long, node long, n int, token long, seen long, sketch binary"
MIXED = "token long, n int, node long, matches int, root long, sketch binary, side int, home int, near long"
#: Bits of a set's sketch, and the members of a list from which pairs are compared by it.
SKETCH_BITS, SKETCHED = 512, 8
#: Members from which on a list is dealt to tasks in pairs of blocks, about as many as a block has.
LONG_LIST = 4096
#: Comparisons made at a time, rows of an output batch.
COMPARED, OUTPUT = 1 << 17, 1 << 16
#: Visits of a task that are put together at a time.
VISITS = 1 << 19
#: Bytes of whole sets in a block of a component, and visitors that a copy of a block takes.
BLOCK_BYTES, VISITORS = 4 << 20, 1024


def sketch(shingles: np.ndarray) -> bytes:
    """For each bit whether an odd number of shingles falls on it. Two sets' sketches differ in no
    more bits than the sets differ in shingles, so they bound the intersection from above."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _classes(batches, size: int):
    """Rows of kind 0: a document's class; of kind 1: a shingle frequent in this stretch."""
    names = ["kind", "doc_id", "node", "n", "token", "seen", "sketch"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    stretch, held, known = [], 0, set()

    def frequent():
        nonlocal stretch, held
        tokens, seen = np.unique(np.concatenate(stretch), return_counts=True)
        tokens, seen = tokens[seen >= LOCAL], seen[seen >= LOCAL]
        stretch, held = [], 0
        known.clear()
        n, none = len(tokens), pa.nulls(len(tokens))
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array(tokens.view(np.int64)), pa.array(seen), none.cast(pa.binary())], names=names)

    for batch in batches:
        nodes, counts, sketches = [], [], []
        for s in shingle_sets(batch.column(1).to_pylist(), size):
            node = set_hash(s) if len(s) else None
            nodes.append(node)
            sketches.append(sketch(s) if len(s) else None)
            counts.append(len(s))
            if len(s) and node not in known:
                known.add(node)
                stretch.append(s)
                held += len(s)
                if held >= STRETCH:
                    yield frequent()
        n, none = len(nodes), pa.nulls(len(nodes), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0).cast(pa.int64()), pa.array(nodes, kinds[2]), pa.array(counts, kinds[3]), none, none, pa.array(sketches, pa.binary())], names=names)
    if stretch:
        yield frequent()


def prefix(shingles: np.ndarray, tokens: np.ndarray, seen: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """l and the prefix of a set, given the frequency table (ascending tokens and their counts)."""
    n = len(shingles)
    shortest = n - -(-percent * n // 100) + 1
    count = np.zeros(n, np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
        count = np.where(tokens[at] == shingles, seen[at], 0)
    order = np.argsort(count, kind="stable")  # equal counts stay in order of hash
    postings = np.cumsum(count[order] + RARE)
    most = min(MOST_MATCHES, n - shortest + 1)
    # A longer prefix costs its postings; a candidate that must match l of them is likelier to be real.
    cost = [shortest + m + postings[shortest + m - 1] * (1 + VERIFY_COST / (m + 1) ** 2) for m in range(most)]
    best = int(np.argmin(cost))
    return best + 1, shingles[order[: shortest + best]]


def _prefixes(batches, size: int, percent: int, table):
    tokens, seen = table.value
    known: set[int] = set()  # copies within a task need no second posting
    for batch in batches:
        nodes, counts, matches, lists = [], [], [], []
        for s in shingle_sets(batch.column(0).to_pylist(), size):
            if not len(s) or (node := set_hash(s)) in known:
                continue
            known.add(node)
            m, p = prefix(s, tokens, seen, percent)
            nodes.append(node)
            counts.append(len(s))
            matches.append(m)
            lists.append(p.view(np.int64))
        offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        values = np.concatenate([*lists, np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(counts, pa.int32()), pa.array(matches, pa.int32()), pa.ListArray.from_arrays(offsets, values)], names=["node", "n", "matches", "tokens"])


def _runs(batches):
    """Whole runs of equal first column, in blocks of rows, from batches sorted by it."""
    rest = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(rest, rows)]
        if not len(rows[0]):
            continue
        last = np.searchsorted(rows[0], rows[0][-1], "left")
        rest = [x[last:] for x in rows]
        if last:
            yield [x[:last] for x in rows]
    if rest is not None and len(rest[0]):
        yield rest


def _postings(batches):
    """Postings of shingles that two or more classes have, each with the pivot of its list."""
    for token, n, node, matches in _runs(batches):
        new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        token, n, node, matches = token[new], n[new], node[new], matches[new]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        sizes = np.diff(np.append(starts, len(token)))
        keep = np.repeat(sizes > 1, sizes)
        # The smallest name is the pivot: lists of the same group of copies mostly agree on it.
        pivot = np.repeat(np.lexsort((node, np.repeat(np.arange(len(starts)), sizes)))[starts], sizes)
        cols = [token, node, n, matches, node[pivot], n[pivot], matches[pivot], np.repeat(sizes, sizes).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], names=["token", "node", "n", "matches", "pivot", "pivot_n", "pivot_matches", "size"])


def least_shared(n_x, matches_x, n_y, matches_y, percent: int):
    """How many prefix shingles two sets that link must share, at least; works on arrays and on columns.

    Of the two the one whose prefix ends first in the common order has all it shares with the other set
    in both prefixes, but for what its own rest holds. So the shared prefix shingles and the longer rest
    are no fewer than the intersection that a link needs; nor are they fewer than the smaller l.
    """
    column = not isinstance(n_x, np.ndarray)
    low, high = (F.least, F.greatest) if column else (np.minimum, np.maximum)
    ceiling = (lambda a, b: F.ceil(a / b)) if column else (lambda a, b: -(-a // b))
    rest = high(ceiling(percent * n_x, 100) - matches_x, ceiling(percent * n_y, 100) - matches_y)
    return high(low(matches_x, matches_y), ceiling(percent * (n_x + n_y), 100 + percent) - rest)


def _comparable(rows: np.ndarray, n, root, bits, percent: int, side, home) -> tuple[np.ndarray, np.ndarray]:
    """Which members of a list each of ``rows`` can link with, in another component, and their sketches' distances.

    In a block pair (see :func:`_block_pairs`) two members of one side, or two that are not at home, are
    compared elsewhere.
    """
    a, b = n[rows][:, None].astype(np.int64), n.astype(np.int64)
    can = (root[rows][:, None] != root) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    can &= ((side[rows][:, None] != side) | (side == 0)) & ((home[rows][:, None] | home) == 1)
    # sizes a and b link if they differ in at most (1 - t) / (1 + t) of a + b
    differ = np.bitwise_count(bits[rows][:, None] ^ bits).sum(2, dtype=np.int64)
    return can & ((100 + percent) * differ <= (100 - percent) * (a + b)), differ


def _lists(columns):
    """The lists with sketches that hold more than one component: where each begins, its columns and its bits."""
    token, root = columns[0], columns[4]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    ends = np.append(starts[1:], len(token))
    mixed = np.add.reduceat((root != root[np.repeat(starts, ends - starts)]).astype(np.int64), starts) > 0
    mixed &= np.fromiter((columns[5][s] is not None for s in starts.tolist()), bool, len(starts))
    for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist()):
        part = [x[s:e] for x in columns]
        yield s, part, np.frombuffer(b"".join(part[5]), np.uint64).reshape(e - s, -1)


def _short_pairs(columns, percent: int):
    """Places i and j of members that can link, for all lists without sketches at once."""
    token, n, root = columns[0], columns[1].astype(np.int64), columns[4]
    plain = np.fromiter((x is None for x in columns[5]), bool, len(token))
    for d in range(1, SKETCHED):
        i = np.flatnonzero((token[d:] == token[:-d]) & plain[d:] & (root[d:] != root[:-d]))
        i = i[100 * np.minimum(n[i], n[i + d]) >= percent * np.maximum(n[i], n[i + d])]
        yield i, i + d


def _steps(rows: np.ndarray, width: int):
    """``rows`` in parts whose comparison with ``width`` members takes bounded memory."""
    step = max(1, COMPARED // width)
    return (rows[i : i + step] for i in range(0, len(rows), step))


def _mixed(batches, percent: int):
    """Members of lists with several components that can link with a member of another one.

    ``near`` is the nearest such member by sketch, for members outside the list's most common component
    whose sets are small enough for it.
    """
    names = ["token", "n", "node", "matches", "root", "sketch", "side", "home", "near"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]

    def batch(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*parts), kinds)], names=names)

    parts, held = [], 0
    for columns in _runs(batches):
        found = np.zeros(len(columns[0]), bool)
        near = np.full(len(found), None, object)
        for i, j in _short_pairs(columns, percent):
            found[i] = found[j] = True
        for at, (_, n, node, _, root, _, side, home), bits in _lists(columns):
            _, number, often = np.unique(root, return_inverse=True, return_counts=True)
            for rows in _steps(np.flatnonzero(number != often.argmax()), len(n)):
                can, differ = _comparable(rows, n, root, bits, percent, side, home)
                some = can.any(1)
                found[at : at + len(n)] |= can.any(0)
                found[at + rows[some]] = True
                # of long sets the sketches are full, and their distance says nothing
                some &= (100 - percent) * 2 * n[rows].astype(np.int64) <= (100 + percent) * SKETCH_BITS // 2
                if some.any():
                    near[at + rows[some]] = node[np.where(can, differ, 1 << 30)[some].argmin(1)]
        if found.any():
            parts.append([x[found] for x in (*columns, near)])
            held += int(found.sum())
            if held >= OUTPUT:
                yield batch(parts)
                parts, held = [], 0
    if parts:
        yield batch(parts)


def _visits(batches, percent: int):
    """(x, root, need): a member that can link with some of a larger component of its list.

    ``root`` and ``weight`` order components alike in all lists; ``need`` is the least number of
    shared prefix shingles that any of these links asks for (see :func:`least_shared`). What a task's
    lists say of one visit is put together before it is given out, with the number of lists.
    """
    names = ["x", "root", "lists", "need"]

    def batch():
        x, root, need = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((root, x))
        x, root, need = x[order], root[order], need[order]
        starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (root[1:] != root[:-1])))
        lists = np.diff(np.append(starts, len(x)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (x[starts], root[starts], lists, np.minimum.reduceat(need, starts).astype(np.int64))], names=names)

    parts, held = [], 0
    for columns in _runs(batches):
        for i, j in _short_pairs(columns, percent):
            if len(i):
                _, n, node, matches, root, _, _, _, weight = columns
                need = least_shared(n[i].astype(np.int64), matches[i], n[j].astype(np.int64), matches[j], percent)
                up = (weight[i] < weight[j]) | ((weight[i] == weight[j]) & (root[i] < root[j]))
                parts.append((node[np.where(up, i, j)], root[np.where(up, j, i)], need))
                held += len(i)
        for _, (_, n, node, matches, root, _, side, home, weight), bits in _lists(columns):
            roots, first, number = np.unique(root, return_index=True, return_inverse=True)
            order = np.empty(len(roots), np.int64)
            order[np.lexsort((roots, weight[first]))] = np.arange(len(roots))
            order = order[number]  # of each member's component
            by = np.argsort(order, kind="stable")
            begins = np.flatnonzero(np.append(True, np.diff(order[by]) > 0))
            for rows in _steps(np.flatnonzero(order < len(roots) - 1), len(n)):
                can, _ = _comparable(rows, n, root, bits, percent, side, home)
                can &= order[rows][:, None] < order
                never = np.iinfo(np.int64).max
                asked = least_shared(n[rows][:, None].astype(np.int64), matches[rows][:, None], n.astype(np.int64), matches, percent)
                need = np.where(can, asked, never)[:, by]
                least = np.minimum.reduceat(need, begins, axis=1)  # a column a component
                i, k = np.nonzero(least < never)
                parts.append((node[rows[i]], root[by[begins[k]]], least[i, k]))
                held += len(i)
        if held >= VISITS:
            yield batch()
            parts, held = [], 0
    if held:
        yield batch()


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Members of long lists in groups that are compared in tasks of their own.

    Sizes fall into ranges of which only neighbours can link. The group of a range has its own
    members (home) and those of the next, parted by a hash into blocks; each pair of blocks is a
    group, whose sides are 1 and 2, or 0 for a block with itself. So every pair that can link meets
    in one group. Ranges of a single component need no comparison.
    """
    base = math.log(100 / percent) * 1.001  # a little wide, so that rounding parts no pair
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(base)).cast("int")
    ranged = members.withColumn("own", own).withColumn("range", F.explode(F.array(F.col("own"), F.col("own") - 1))).withColumn("home", (F.col("own") == F.col("range")).cast("int"))
    counts = ranged.groupBy("token", "range").agg(F.count(F.lit(1)).alias("members"), F.max("home").alias("any"), F.min("root").alias("low"), F.max("root").alias("high"))
    counts = counts.where("any = 1 and low < high").select("token", "range", F.ceil(F.col("members") / F.lit(LONG_LIST)).cast("int").alias("blocks"))
    blocks = ranged.join(counts, ["token", "range"]).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    group = F.xxhash64("token", "range", F.least("block", "other"), F.greatest("block", "other"))
    return blocks.select(group.alias("token"), "n", "node", "matches", "root", "sketch", side.alias("side"), "home")


def _filter_words(names: DataFrame) -> np.ndarray:
    """The filter of :func:`filter_words` as an array."""
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    for word, bits in filter_words(names).collect():  # at most 2**18 rows
        out[word] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return out


def _whole_sets(rows: DataFrame, classes: DataFrame, nodes: DataFrame, size: int) -> tuple[DataFrame, str]:
    """(node, tokens) for all classes in ``nodes``, written; a few others may be there as well.

    Of every class the rows with its smallest id send the set. They are picked by a filter of ids
    before a shingle is made; rows without an id are picked by their class.
    """
    spark = rows.sparkSession
    needed = nodes.distinct().join(classes, "node")
    words = spark.sparkContext.broadcast(_filter_words(needed.select(F.when(F.col("class_id").isNull(), F.col("node")).otherwise(F.xxhash64("class_id")).alias("name"))))

    def passes(name: int) -> bool:
        bit = name & ((1 << FILTER_BITS) - 1)
        return bool(int(words.value[bit >> 6]) >> (bit & 63) & 1)

    def sets(batches):
        known: set[int] = set()
        for batch in batches:
            names = batch.column(0).to_pylist()
            chosen = [i for i, name in enumerate(names) if name is None or passes(name)]
            found, data = [], []
            for i, s in zip(chosen, shingle_sets(batch.column(1).take(pa.array(chosen, pa.int64())).to_pylist(), size)):
                if len(s) and (node := set_hash(s)) not in known and (names[i] is not None or passes(node)):
                    known.add(node)
                    found.append(node)
                    data.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(data, pa.binary())], names=["node", "tokens"])

    named = rows.select(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("name"), "text")
    return materialize(named.mapInArrow(trimmed(sets), "node long, tokens binary"), "sets")


def _verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (x, y) with ``linked``: whether their whole sets are similar enough."""
    whole, path = _whole_sets(rows, classes, pairs.select(F.col("x").alias("node")).union(pairs.select("y")), size)

    def compare(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(a) + len(b) - len(distinct(np.concatenate([a, b])))
                out.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["x", "y", "linked"])

    sides = pairs.join(whole.select(F.col("node").alias("y"), F.col("tokens").alias("y_tokens")), "y")
    sides = sides.join(whole.select(F.col("node").alias("x"), F.col("tokens").alias("x_tokens")), "x")
    compared = sides.select("x", "y", "x_tokens", "y_tokens").mapInArrow(trimmed(compare), "x long, y long, linked boolean")
    out, _ = materialize(compared.distinct(), "verified")  # documents of one id may send a set twice
    remove(rows.sparkSession, path)
    return out


def _met(batches, percent: int):
    """Links of visitors with members of a block, one a visitor at most, from rows sorted by group and role."""
    group, members, table = None, [], None
    for batch in batches:
        out = []
        for g, role, node, data in zip(*(c.to_pylist() for c in batch.columns)):
            if g != group:
                group, members, table = g, [], None
            tokens = np.frombuffer(data, np.uint64)
            if role == 0:
                members.append((node, tokens))
                continue
            if not members:
                continue
            if table is None:
                sizes = np.array([len(x) for _, x in members])
                every = np.concatenate([x for _, x in members])
                order = np.argsort(every, kind="stable")
                table = every[order], np.repeat(np.arange(len(members)), sizes)[order], sizes
            values, owner, sizes = table
            low, high = np.searchsorted(values, tokens, "left"), np.searchsorted(values, tokens, "right")
            common = np.bincount(owner[ranges(low, high - low)], minlength=len(sizes))
            linked = np.flatnonzero(100 * common >= percent * (sizes + len(tokens) - common))
            if len(linked):
                out.append((node, members[linked[0]][0]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["x", "y"])


def _links_of_visits(rows: DataFrame, classes: DataFrame, roots: DataFrame, visits: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (x, y) between visitors and members of the components they visit: one at least of every
    component that a visitor links with.

    A component's members are dealt in blocks of about ``BLOCK_BYTES`` of sets, a block's visitors in
    parts of about ``VISITORS``; each block and part is a group of its own.
    """
    spark = rows.sparkSession
    named = classes.join(roots.select("node", "root"), "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    members = named.join(visits.select("root").distinct(), "root", "left_semi")
    whole, path = _whole_sets(rows, classes, members.select("node").union(visits.select("x")), size)
    counts = members.groupBy("root").agg(F.ceil(F.sum("n") * 8 / BLOCK_BYTES).cast("int").alias("blocks"))
    counts = counts.join(visits.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("parts")), "root")
    at = F.struct("root", "block", "part").alias("g")
    own = members.join(counts, "root").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    come = visits.join(counts, "root").withColumn("part", F.expr("cast(pmod(xxhash64(x), parts) as int)")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    both = own.select(at, F.lit(0).alias("role"), "node").unionByName(come.select(at, F.lit(1).alias("role"), F.col("x").alias("node")))
    sent = both.join(whole, "node").select(F.xxhash64("g.root", "g.block", "g.part").alias("g"), "role", "node", "tokens")
    links, _ = materialize(dealt(sent, "g").sortWithinPartitions("g", "role").mapInArrow(trimmed(lambda b: _met(b, percent)), "x long, y long"), "met")
    remove(spark, path)
    return links


def near_copy_components(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """A row for each document: key, n_shingles, class_id and component_id.

    Two classes link when 100 * intersection >= percent * union. component_id is the smallest key
    that links reach, class_id the smallest with the same set.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first, _ = materialize(rows.mapInArrow(trimmed(lambda b: _classes(b, size)), CLASSES), "classes", "kind")
    docs = first.where("kind = 0").select("doc_id", "node", "n")
    sketches = first.where("kind = 0 and node is not null").groupBy("node").agg(F.min("sketch").alias("sketch"))
    classes = docs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"))
    ranked = first.where("kind = 1").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(FREQUENT)
    top = sorted((t & 0xFFFFFFFFFFFFFFFF, s) for t, s in ranked.collect())  # at most FREQUENT rows
    table = spark.sparkContext.broadcast((np.array([t for t, _ in top], np.uint64), np.array([s for _, s in top], np.int64)))

    lists = rows.select("text").mapInArrow(trimmed(lambda b: _prefixes(b, size, percent, table)), "node long, n int, matches int, tokens array<long>")
    sorted_lists = lists.select(F.explode("tokens").alias("token"), "n", "node", "matches").repartition("token").sortWithinPartitions("token", "n", "node")
    postings, postings_path = materialize(sorted_lists.mapInArrow(_postings, "token long, node long, n int, matches int, pivot long, pivot_n int, pivot_matches int, size int"), "postings")

    allowed = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    need = least_shared(F.col("n"), F.col("matches"), F.col("pivot_n"), F.col("pivot_matches"), percent)
    stars = postings.where((F.col("node") != F.col("pivot")) & allowed).groupBy(F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y"), need.alias("need")).count()
    stars, _ = materialize(stars.where("count >= need").select("x", "y"), "stars")
    checked = _verified(rows, classes, stars, size, percent)
    links = checked.where("linked").select("x", "y")
    roots, _ = materialize(connected_components(links), "roots")

    large = sketches.join(postings.where(F.col("size") >= SKETCHED).select("node").distinct(), "node", "left_semi").withColumnRenamed("node", "_node")
    labelled = postings.join(roots, "node", "left").join(large, (F.col("node") == F.col("_node")) & (F.col("size") >= SKETCHED), "left")
    labelled = labelled.select("token", "n", "node", "matches", F.coalesce("root", "node").alias("root"), "sketch", "size")

    def listed(members: DataFrame) -> DataFrame:
        return dealt(members, "token").sortWithinPartitions("token", "n", "node")

    lists = labelled.where(F.col("size") <= LONG_LIST).drop("size").withColumns({"side": F.lit(0), "home": F.lit(1)})
    if postings.where(F.col("size") > LONG_LIST).limit(1).count():
        lists = lists.unionByName(_block_pairs(labelled.where(F.col("size") > LONG_LIST).drop("size"), percent))
    mixed, mixed_path = materialize(listed(lists).mapInArrow(trimmed(lambda b: _mixed(b, percent)), MIXED), "mixed")
    remove(spark, postings_path)
    met = mixed.where("near is not null").groupBy("node", "near").count()
    best = met.groupBy("node").agg(F.max_by("near", F.struct("count", "near")).alias("near"))  # of a member's lists most name it
    near = best.select(F.least("node", "near").alias("x"), F.greatest("node", "near").alias("y")).distinct()
    near, near_path = materialize(near.join(checked, ["x", "y"], "left_anti"), "near")
    if near.limit(1).count():
        links = links.unionByName(_verified(rows, classes, near, size, percent).where("linked").select("x", "y"))
        roots, _ = materialize(connected_components(links), "roots")

    weights = roots.groupBy("root").agg(F.count(F.lit(1)).alias("weight"))
    weighed = roots.join(weights, "root").select("node", F.col("root").alias("new"), "weight")
    again = mixed.join(weighed, "node", "left").select("token", "n", "node", "matches", F.coalesce("new", "node").alias("root"), "sketch", "side", "home", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"))
    visits = listed(again).mapInArrow(trimmed(lambda b: _visits(b, percent)), "x long, root long, lists long, need long")
    visits = visits.groupBy("x", "root").agg(F.sum("lists").alias("lists"), F.min("need").alias("need"))
    visits, visits_path = materialize(visits.where("lists >= need").select("x", "root"), "visits")
    if visits.limit(1).count():
        more = _links_of_visits(rows, classes, roots, visits, size, percent)
        if more.limit(1).count():
            roots, _ = materialize(connected_components(links.unionByName(more)), "roots")
    remove(spark, mixed_path, near_path, visits_path)

    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    named = classes.join(groups, "root").select("node", "class_id", "component_id")
    out = docs.join(named, "node", "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end s from w),
u as (select doc_id, len(s) n, unnest(s) g from s),
links as (
  select a.doc_id x, b.doc_id y from u a join u b on a.g = b.g and a.doc_id <> b.doc_id
  group by 1, 2 having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(x, y) as (select doc_id, doc_id from s union select r.x, l.y from reach r join links l on r.y = l.x)
select s.doc_id, len(s.s)::bigint n_shingles, min(r.y) component_id from s join reach r on r.x = s.doc_id group by 1, 2
"""
