"""Similarity join of shingle sets: prefix index with blocks skipped by position, answers derived from similar sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import TEXT_BATCH_ROWS, only, rows_below, written
from .components import connected_components

# Frequent shingles that are ordered last: a fixed number, found by counting all shingles.
FREQUENT, FREQUENT_LEAST, COUNT_EVERY = 1 << 17, 3, 1 << 21
# Lists up to this length compare the bitmaps of pairs that sizes and positions allow; longer ones those of all their sets.
PAIRED_LIST = 32
# Bits of the bitmap of a set: a power of two, at least so many, and at least so many for each of its shingles, so that two
# unlike sets differ in more bits than two that link may differ in shingles.
BITMAP, BITMAP_SHARE = 1024, 0.6
# Entries up to which a long list compares all its bitmaps, and up to which it compares them to leaders; beyond, it chains.
PAIRWISE_LIST, LEADER_LIST = 2048, 1 << 18
# Sets and shingles of a group that is verified in one task; larger clusters meet block by block.
BLOCK_SETS, BLOCK_SHINGLES = 512, 2_000_000
# Rows of some 80 bytes each up to which the clustered classes are sent to the texts; beyond, texts are shuffled by id.
BROADCAST_ROWS = 500_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets link when ``base * intersection >= part * union``."""

    words: int = 3
    part: int = 90
    base: int = 100

    def least_size(self, n):
        """Smallest set that can link with one of ``n`` shingles."""
        return -(-self.part * n // self.base)

    def prefix(self, n):
        """Shingles of a set that are indexed: two sets that link share one of them."""
        return n - self.least_size(n) + 1

    def least_overlap(self, n, m):
        return -(-self.part * (n + m) // (self.base + self.part))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles. Words lie between ASCII white space, ``A-Z`` count as lower case;
    a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxh64_intdigest(b" ".join(parts), len(parts))], np.uint64)
    h = np.fromiter(map(xxh64_intdigest, parts), np.uint64, len(parts))
    n = len(h) - words + 1
    s = h[:n].copy()
    for k in range(1, words):
        s *= _A
        s ^= s >> np.uint64(31)
        s += h[k : n + k] * _B
    s ^= s >> np.uint64(29)
    s *= _C
    s ^= s >> np.uint64(32)
    return np.unique(s)


def _binary(values: np.ndarray) -> np.ndarray:
    return values.view("i8")


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most ``FREQUENT``, sorted by hash, with their counts over all texts.

    Tasks count everything they read and pass on what occurs ``FREQUENT_LEAST`` times among some two million shingles; Spark adds
    up. Any order of shingles gives the same links, frequent ones last make the index lists short.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            keep = times >= FREQUENT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(_binary(found[keep])), pa.array(times[keep].astype("i8"))], ["token", "times"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(shingles(text, words))
                size += len(held[-1])
                if size >= COUNT_EVERY:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = texts.select("text").mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    counts = written(counts.withColumn("level", F.floor(F.log2("times") * 16).cast("int")), "frequent")
    # Levels of counts, at most some hundred, tell from which on the table fits its fixed size.
    levels = sorted(counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    sizes = np.cumsum([r["n"] for r in levels])
    fitting = [r["level"] for r, n in zip(levels, sizes, strict=True) if n <= FREQUENT]
    rows = counts.filter(F.col("level") >= (fitting[-1] if fitting else 1 << 20)).select("token", "times").toPandas()
    tokens = rows["token"].to_numpy("i8").view("u8")
    order = np.argsort(tokens)
    return tokens[order], rows["times"].to_numpy("i8")[order]


def in_order(tokens: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A set in the order of the index: rare shingles by hash, then the frequent ones by count."""
    if not len(frequent):
        return tokens
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    weight = np.where(frequent[at] == tokens, times[at], 0)
    return tokens[np.lexsort((tokens, weight))] if weight.any() else tokens


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the counts of shingles by their last bits. Sets differ in at least as many shingles as bitmaps in bits.

    Halves of a bitmap, one laid on the other, are the bitmap of half its width.
    """
    width = max(BITMAP, 1 << int(np.ceil(np.log2(max(1.0, BITMAP_SHARE * len(tokens))))))
    return np.packbits(np.bincount((tokens & np.uint64(width - 1)).astype("i8"), minlength=width) & 1).tobytes()


def stacked(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of ``width`` bytes or more as rows of 64-bit words, folded to that width."""
    rows = np.empty((len(bits), width // 8), np.uint64)
    for k, b in enumerate(bits):
        words = np.frombuffer(b, np.uint64)
        while len(words) > width // 8:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        rows[k] = words
    return rows


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart that differ in id or text, the same in every plan; null for a null text."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(ident, F.lit(":"), F.col(f"`{text_col}`").cast("string"))))


def describe_sets(texts: DataFrame, rule: Rule, frequent: np.ndarray, times: np.ndarray) -> DataFrame:
    """``row_id, doc_id, key, n, cls, bits, prefix`` of every document: size, fingerprint and bitmap of its set, indexed shingles."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in rows_below(batches, TEXT_BATCH_ROWS):
            sets = [shingles(t, rule.words) for t in batch.column("text").to_pylist()]
            prefixes = [_binary(in_order(s, frequent, times)[: rule.prefix(len(s))]) if len(s) else _binary(s) for s in sets]
            offsets = np.cumsum([0, *map(len, prefixes)]).astype("i4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_id"), batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([bitmap(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes))),
                ],
                ["row_id", "doc_id", "key", "n", "cls", "bits", "prefix"],
            )

    numbered = texts.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", row_key().alias("key"), "text")
    return numbered.mapInArrow(describe, "row_id long, doc_id long, key binary, n long, cls binary, bits binary, prefix array<long>")


def candidates_of_list(n: np.ndarray, at: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Pairs of an index list that can link. The list is sorted by (size, position); entries of one size are a block.

    Two sets share at most what lies before the shingle in either, itself, and what follows it in either. For an entry,
    blocks of too small sets are never visited, and the rest of a block is skipped at the first position from which too
    few shingles follow for the overlap that the two sizes ask for.
    """
    starts = [0, *(np.flatnonzero(np.diff(n)) + 1).tolist(), len(n)]
    sizes, places = n.tolist(), at.tolist()
    found = []
    first = 0
    for own, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        size = sizes[a]
        while sizes[starts[first]] < rule.least_size(size):
            first += 1
        for k in range(a, b):
            place = places[k]
            rest = size - place
            for block in range(first, own + 1):
                low, high = starts[block], min(starts[block + 1], k)
                if low >= high:
                    continue
                other = sizes[low]
                need = rule.least_overlap(size, other)
                for j in range(low, high):
                    after = other - places[j]
                    if after + place < need:
                        break
                    if min(place, places[j]) + min(rest, after) >= need:
                        found.append((j, k))
    return found


def forest_of_list(n: np.ndarray, bits: list[bytes], rule: Rule) -> list[tuple[int, int]]:
    """Edges that connect all pairs of a long list whose bitmaps allow them to link. The list is sorted by size.

    Sets whose bitmaps have the same width or, folded, the next one are compared: sizes of sets that link are too close
    for more.
    """
    widths = np.array([len(b) for b in bits])
    edges: list[tuple[int, int]] = []
    for width in np.unique(widths).tolist():
        own = np.flatnonzero((widths == width) | (widths == 2 * width) & (n <= n[widths == width].max() * rule.base // rule.part + 1))
        rows = stacked([bits[k] for k in own], width)
        edges += [(int(own[a]), int(own[b])) for a, b in forest_of_width(n[own], rows, rule)]
    return edges


def forest_of_width(n: np.ndarray, bits: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Up to ``PAIRWISE_LIST`` entries, each is compared to those before it and hung on one entry of every tree it may link
    with. In a longer list an entry leads: what lies within twice the widest distance of a link is hung on it, and what lies
    within that distance is done, for whatever it links with has been hung on the leader, too. Copies of one text leave
    after a few leaders.
    """
    edges: list[tuple[int, int]] = []
    if len(n) <= PAIRWISE_LIST:
        tree = np.arange(len(n))
        for k in range(1, len(n)):
            low = int(np.searchsorted(n, rule.least_size(n[k])))
            apart = np.bitwise_count(bits[low:k] ^ bits[k]).sum(axis=1, dtype="i8")
            near = np.flatnonzero((n[low:k] + n[k] - apart) // 2 >= rule.least_overlap(n[low:k], n[k])) + low
            for root, j in dict(zip(tree[near].tolist(), near.tolist(), strict=True)).items():
                edges.append((j, k))
                tree[tree == root] = k
        return edges
    pool = np.arange(len(n))
    while len(pool):
        lead, pool = pool[0], pool[1:]
        size = int(n[lead])
        # Sets that link with one of up to size / t differ from it in at most (1 - t) / t ** 2 of the leader's size.
        reach = size * (rule.base - rule.part) * rule.base // rule.part**2 + 2
        stop = int(np.searchsorted(n[pool], size * rule.base**2 // rule.part**2 + 2, "right"))
        apart = np.bitwise_count(bits[pool[:stop]] ^ bits[lead]).sum(axis=1, dtype="i8")
        edges += [(int(lead), int(k)) for k in pool[:stop][apart <= 2 * reach]]
        done = (apart <= reach) & (n[pool[:stop]] * rule.part <= size * rule.base)
        pool = np.concatenate([pool[:stop][~done], pool[stop:]])
    return edges


def by_token(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int) -> Iterator[tuple[dict[str, np.ndarray], bool, bool]]:
    """Runs of whole index lists from rows sorted by token: (columns, first list goes on from before, last one is cut).

    A list of more than ``most`` rows comes in parts, each beginning with the last row of the part before.
    """
    held: list[pa.RecordBatch] = []
    cut = False

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        found = {c: table.column(c).to_numpy() for c in names if c != "bits"}
        if "bits" in names:
            found["bits"] = table.column("bits").to_pylist()
        return found

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        token = table.column("token").to_numpy()
        last = int(np.searchsorted(token, token[-1]))
        if last:
            yield columns(table.slice(0, last)), cut, False
            cut = False
        elif len(token) > most:
            yield columns(table), cut, True
            last, cut = len(token) - 1, True
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield columns(pa.Table.from_batches(held)), cut, False


def _lists(token: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(token)) + 1
    starts, ends = np.r_[0, cuts], np.r_[cuts, len(token)]
    several = ends - starts > 1
    return zip(starts[several].tolist(), ends[several].tolist(), strict=True)


def may_link(n: np.ndarray, bits: list[bytes], pairs: np.ndarray, rule: Rule) -> np.ndarray:
    """Which pairs of sets have bitmaps that allow them to link; of two widths the wider one is folded."""
    x, y = pairs.T
    widths = np.array([min(len(bits[a]), len(bits[b])) for a, b in pairs.tolist()], "i8")
    apart = np.zeros(len(pairs), "i8")
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        words = stacked([bits[k] for k in x[at]], width) ^ stacked([bits[k] for k in y[at]], width)
        apart[at] = np.bitwise_count(words).sum(axis=1, dtype="i8")
    return (n[x] + n[y] - apart) // 2 >= rule.least_overlap(n[x], n[y])


def forest_of_pairs(n: np.ndarray, at: np.ndarray, bits: list[bytes], rule: Rule) -> list[tuple[int, int]]:
    """Edges that connect all pairs of a short list that block, position and bitmaps allow to link."""
    found = np.array(candidates_of_list(n, at, rule), "i8").reshape(-1, 2)
    tree = list(range(len(n)))
    edges = []
    for a, b in found[may_link(n, bits, found, rule)].tolist():
        if tree[a] != tree[b]:
            edges.append((a, b))
            old = tree[b]
            tree = [tree[a] if t == old else t for t in tree]
    return edges


def candidate_edges(entries: DataFrame, bitmaps: DataFrame, rule: Rule) -> DataFrame:
    """``a, b``: edges that connect all sets which can link, from index entries ``token, n, at, node`` and ``node, bits``.

    An index list keeps the entries that may have a partner in it: in a short list those that size blocks and positions do not
    rule out, in a long one all. They meet again with the bitmaps of their sets, and every list gives the edges of a
    forest over the pairs that its bitmaps allow; no list gives its pairs, so rows never outnumber the index's entries.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, goes_on, _ in by_token(batches, ("token", "n", "at", "node"), 1 << 16):
            kept = [np.zeros(0, "i8")]
            for a, b in _lists(c["token"]):
                if b - a <= PAIRED_LIST and not (goes_on and a == 0):
                    found = candidates_of_list(c["n"][a:b].astype("i8"), c["at"][a:b].astype("i8"), rule)
                    kept.append(np.unique(np.array(found, "i8")) + a)
                else:  # the first entry of a list that goes on was given with the part before
                    kept.append(np.arange(a + (goes_on and a == 0), b))
            own = np.concatenate(kept)
            yield pa.RecordBatch.from_arrays([pa.array(c[k][own]) for k in ("token", "n", "at", "node")], ["token", "n", "at", "node"])

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, goes_on, cut in by_token(batches, ("token", "n", "at", "node", "bits"), LEADER_LIST):
            found = [np.zeros((0, 2), "i8")]
            for a, b in _lists(c["token"]):
                n, bits = c["n"][a:b].astype("i8"), c["bits"][a:b]
                if goes_on and a == 0 or cut:
                    near = np.flatnonzero(n[:-1] >= rule.least_size(n[1:]))  # between two sizes that link all sizes do
                    edges = np.stack([near, near + 1], axis=1)
                else:
                    edges = forest_of_pairs(n, c["at"][a:b].astype("i8"), bits, rule) if b - a <= PAIRED_LIST else forest_of_list(n, bits, rule)
                found.append(c["node"][a:b][np.array(edges, "i8").reshape(-1, 2)])
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in pairs.T], ["a", "b"])

    ordered = entries.repartition("token").sortWithinPartitions("token", "n", "at", "node").select("token", "n", "at", "node")
    met = written(ordered.mapInArrow(meet, "token long, n int, at int, node long"), "met")
    marked = met.join(bitmaps.select("node", "bits"), "node").select("token", "n", "at", "node", "bits")
    return marked.repartition("token").sortWithinPartitions("token", "n", "at", "node").mapInArrow(hang, "a long, b long")


def verify_group(left: list[np.ndarray], right: list[np.ndarray] | None, rule: Rule) -> list[np.ndarray]:
    """For each left set the indexes of the right sets that link with it (of the later left sets, if ``right`` is None).

    Overlaps with all right sets are counted over posting lists. A set's counts are derived from those of a similar set
    before it: the lists of shingles it lacks are taken off, those of shingles it adds are put on; a set that shares less than
    half with it is counted anew.
    """
    others = left if right is None else right
    sizes = np.array([len(s) for s in others])
    tokens = np.concatenate([*others, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]

    def postings(of: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(tokens, of, "left"), np.searchsorted(tokens, of, "right")
        counts = high - low
        places = np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        return np.bincount(owner[places], minlength=len(others))

    found: list[np.ndarray] = [np.zeros(0, "i8")] * len(left)
    known = known_counts = None
    for k in np.lexsort(([s[0] for s in left], [len(s) for s in left])).tolist():
        own = left[k]
        added = np.setdiff1d(own, known, assume_unique=True) if known is not None else own
        if known is not None and 2 * len(added) < len(own):
            counts = known_counts + postings(added) - postings(np.setdiff1d(known, own, assume_unique=True))
        else:
            counts = postings(own)
        known, known_counts = own, counts
        links = np.flatnonzero(rule.base * counts >= rule.part * (len(own) + sizes - counts))
        found[k] = links[links > k] if right is None else links
    return found


def verified_links(members: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """``a, b, copies_a, copies_b``: for each group that meets in a task a forest of its links, and every set's links counted.

    ``members``: ``node, key, cls, copies, cluster, blocks``. A cluster is cut by hash into blocks of bounded size, and every
    two blocks meet in a task of their own, so no task holds an unbounded cluster. Rows with ``b`` null carry in ``copies_b`` the
    number of documents that link with ``a`` in that task.
    """

    def read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        seen = set()
        for batch in rows_below(batches, TEXT_BATCH_ROWS):
            keep, sets = [], []
            for k, (node, cls, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "cls", "text")), strict=True)):
                if node not in seen:  # not a repeated row of the same document
                    tokens = shingles(text, rule.words)
                    if xxh3_128_digest(tokens.tobytes()) == cls:
                        seen.add(node)
                        keep.append(k)
                        sets.append(tokens.tobytes())
            rest = batch.select(["node", "copies", "cluster", "blocks"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary())], ["node", "copies", "cluster", "blocks", "tokens"])

    members = written(members, "members")
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    found = texts.withColumn("key", row_key()).join(members, "key").select("node", "cls", "copies", "cluster", "blocks", "text")
    sets = found.mapInArrow(read_sets, "node long, copies long, cluster long, blocks long, tokens binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    placed = sets.withColumn("own", own).withColumn("meet", F.explode(meets)).select("cluster", F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), "own", "node", "copies", "tokens")

    def verify(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        i, j = rows["i"][0], rows["j"][0]
        sides: dict[int, list[int]] = {i: [], j: []}
        seen = set()
        for k, (node, side) in enumerate(zip(rows["node"], rows["own"], strict=True)):
            if node not in seen:
                seen.add(node)
                sides[side].append(k)
        sets = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        left, right = sides[i], sides[j]
        linked = verify_group([sets[k] for k in left], None if i == j else [sets[k] for k in right], rule)
        node, copies, links = rows["node"], rows["copies"], [0] * len(sets)
        parent = list(range(len(sets)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        forest = []
        for k, others in zip(left, linked, strict=True):
            for o in others.tolist():
                o = right[o]
                links[k] += copies[o]
                links[o] += copies[k]
                x, y = root(k), root(o)
                if x != y:
                    parent[x] = y
                    forest.append((node[k], node[o], None))
        forest += [(node[k], None, c) for k, c in enumerate(links) if c]
        columns = list(zip(*forest, strict=True)) if forest else [()] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "b", "links"), columns, strict=True)})

    return placed.groupBy("cluster", "i", "j").applyInArrow(verify, "a long, b long, links long")


def similar_documents(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents with similar shingle sets: ``doc_id, n_shingles, component_id, n_links``, one row per document.

    ``component_id`` is the smallest ``doc_id`` reachable over links, ``n_links`` the number of documents that link with this one.

    Equal sets become one class first, whatever their number. Classes are indexed by the prefixes of their sets, rare
    shingles first; an index list gives candidate edges, whose clusters are then verified exactly, block by block, with
    overlaps derived from those of similar sets. Only ids, prefixes and the texts of clustered classes are shuffled; no pair of a
    long list and no pair inside of a cluster becomes a row.

    A null or empty text, or one without words, has no shingles and links with nothing; equal rows are copies of each
    other; a null ``doc_id`` takes part (its component is the smallest id that is not null, else null); an empty table gives
    an empty result; other columns are not carried along.
    """
    described, placed = placed_sets(docs, rule, id_col, text_col)
    result = placed.select("cls", F.col("first.doc_id").alias("component_id"), "n_links")
    full = described.filter("n > 0").select("doc_id", "n", "cls").join(result, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    empty = described.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(empty)


def repeated_rows(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` (see :func:`row_key`) of every row that is not the first of its component: of the smallest id, null last, then of the smallest key."""
    described, placed = placed_sets(docs, rule, id_col, text_col)
    rows = described.filter("n > 0").select("key", "cls").join(placed.select("cls", F.col("first.key").alias("first")), "cls")
    return rows.filter("key <> first").select("key").distinct()


def placed_sets(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The described documents, and for each class of equal sets ``cls, first, n_links``: the first row of its component."""
    texts = only(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string")
    described = written(describe_sets(texts, rule, *frequent_shingles(texts, rule.words)), "sets")
    filled = described.filter("n > 0")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    classes = filled.groupBy("cls").agg(F.min("row_id").alias("node"), F.min(order).alias("low"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    classes = written(classes, "classes")
    entries = classes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token"))
    clusters = connected_components(candidate_edges(entries, classes.select("node", "n", "bits"), rule))
    known = written(classes.drop("prefix", "bits").join(clusters, "node", "left").withColumnRenamed("root", "cluster"), "clusters")
    many = known.filter("cluster IS NOT NULL")
    blocks = many.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    )
    members = many.join(blocks, "cluster").select("node", "low.key", "cls", "copies", "cluster", "blocks")
    links = written(verified_links(members, texts, rule), "links")
    groups = connected_components(links.filter("b IS NOT NULL"))
    degree = links.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    placed = known.join(groups, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("first"))
    return described, placed.join(lowest, "root").select("cls", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
