"""N-gram Jaccard join with signature trees, for connected components of near-duplicates.

Documents of one shingle set form a class. Candidates meet by prefix filter: with shingles in an order that
all documents share, rarest first, two sets of similarity t or more share one of their first
|s| - ceil(t |s|) + 1. How rare a shingle is comes from all documents: each batch sends its distinct shingles as packed
five-byte prints by bucket (``repeats``), and back comes how many there are, by powers of two; one that only one class has
joins nobody, so a document of a quarter own shingles has no candidates. Classes that share a prefix shingle are chained by
size, where neighbours are of sizes that can be similar; chained classes form a cluster, and only clusters are compared, a
cluster or a pack of small ones at a time. A batch chains its own classes and sends of each shingle only the chains, each with its least and
greatest size, so a hot shingle costs its bucket some entries a batch, however many classes have it.

In a task the sets are the leaves of a signature tree, whose nodes hold the OR of token bitmaps,
the most tokens that bitmaps hide by collision, and size ranges. A dual traversal goes down from the
root with itself and drops a pair of nodes if no set below one can have the overlap that
similarity to one below the other takes. Pairs of leaves already linked by others are left out; the rest are verified
exactly.

A cluster over ``MAX_SETS`` sets or ``MAX_TOKENS`` shingles is dealt into blocks. Blocks are joined by themselves,
then the leaders of what they found with each other, and then every set outside the cluster's
largest component with all blocks: pairs inside a component need no comparison.

Texts that are null or without words have an empty set and link with nothing, like rows with a null id (whose
component is null); repeated rows give equal rows; other columns are not read; an empty table gives an empty one, and a very
long text is hashed in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_WORDS, arrow_map, checkpoint, mix, slices, table, windows
from .graph import components, contract
from .repeats import ASK, TELL, Entries, _answer, _ask, _buckets, _of, by_bucket, count_in, deal, pack, place_of, text_hash, unpack

K, PERCENT, PRINT, MAX_SETS, MAX_TOKENS, FAN = 5, 75, 5, 2000, 2_000_000, 8


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1 if n else 0


def shingle_sets(rows: pa.RecordBatch, k: int):
    """Sorted distinct shingle hashes of each row."""
    for _, data, offs in slices(rows, "text"):
        starts, ends, first = LOWER_WORDS.cut(data, offs)
        hashes = LOWER_WORDS.hashes(data, starts, ends)
        at, grams = windows(hashes, first, k)
        bounds = np.searchsorted(at, first)
        for r in range(len(offs) - 1):
            a, b = first[r], first[r + 1]
            if 0 < b - a < k:  # the whole sequence, never equal to a shingle of k words
                yield mix(windows(hashes[a:b], np.array([0, b - a]), int(b - a))[1] ^ np.uint64(b - a))
            else:
                yield np.unique(grams[bounds[r] : bounds[r + 1]])


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _classes(k: int):
    def run(batches):
        for batch in batches:
            n, c1, c2 = [], [], []
            for tokens in shingle_sets(batch, k):
                x, y = class_of(tokens)
                n.append(len(tokens))
                c1.append(x)
                c2.append(y)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())], ["id", "h", "n", "c1", "c2"])

    return run


def prints(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :PRINT]).tobytes()


def _ask_tokens(k: int, n: int):
    def run(texts: pa.Table) -> pa.Table:
        b = _Batch(texts, k)
        order, parts = by_bucket(b.distinct, n)
        return _ask([(c, _of(texts), prints(b.distinct[order[i:j]]) + pack(b.several[order[i:j]])) for c, i, j in parts])

    return run


def rarity(blobs: list[bytes]) -> list[bytes]:
    """For each shingle 0 if one class has it, else the binary digits of how many batches do (twice if several of its classes do)."""
    sizes = [count_in(len(x), PRINT) for x in blobs]
    tokens = np.zeros((sum(sizes), 8), np.uint8)
    tokens[:, :PRINT] = np.concatenate([np.frombuffer(x, np.uint8, PRINT * n) for x, n in zip(blobs, sizes, strict=True)]).reshape(-1, PRINT)
    several = np.concatenate([unpack(x[PRINT * n :], n)[0] for x, n in zip(blobs, sizes, strict=True)])
    _, place = np.unique(tokens.view(np.uint64).ravel(), return_inverse=True)
    total = np.bincount(place, 1.0 + several)[place].astype(np.int64)
    level = np.where(total > 1, np.ceil(np.log2(total + 1)), 0).astype(np.uint8)
    return [x.tobytes() for x in np.split(level, np.cumsum(sizes)[:-1])]


class _Batch:
    """A batch's classes, each once, and its distinct shingles."""

    def __init__(self, texts: pa.Table, k: int) -> None:
        rows = Entries.batch(texts)
        self.sets, self.classes = [], []
        seen = set()
        for has_id, s in zip(rows.column("id").is_valid().to_pylist(), shingle_sets(rows, k), strict=True):
            if has_id and len(s) and (c := class_of(s)) not in seen:
                seen.add(c)
                self.sets.append(s)
                self.classes.append(c[0])
        every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        self.distinct, count = np.unique(every, return_counts=True)
        self.several = count > 1

    def prefixes(self, answers: dict[tuple[int, int], bytes], n_buckets: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, class, size of the class) of prefix shingles that several classes have."""
        level = np.zeros(len(self.distinct), np.uint8)
        order, parts = by_bucket(self.distinct, n_buckets)
        for bucket, i, j in parts:
            level[order[i:j]] = np.frombuffer(answers[1, bucket], np.uint8)
        tokens, classes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, c in zip(self.sets, self.classes, strict=True):
            own, most = level[np.searchsorted(self.distinct, s)], prefix_size(len(s), percent)
            shared = np.flatnonzero(own)
            left = most - (len(s) - len(shared))  # places that shingles of its own don't fill
            if left > 0:
                t = s[shared[np.lexsort((s[shared], own[shared]))[:left]]]
                tokens.append(t)
                classes.append(np.full(len(t), c))
                sizes.append(np.full(len(t), len(s)))
        return tuple(map(np.concatenate, (tokens, classes, sizes)))


def chained(tokens: np.ndarray, least: np.ndarray, most: np.ndarray, percent: int) -> np.ndarray:
    """Whether an entry and the next, sorted by token and least size, are of one token and have sizes near enough for a chain."""
    token = np.cumsum(np.append(False, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    wide = most.max() + 1 if len(most) else 1
    reach = np.maximum.accumulate(token * wide + most) - token * wide  # the greatest size so far
    return (tokens[1:] == tokens[:-1]) & (100 * reach[:-1] >= percent * least[1:])


def _ask_clusters(k: int, percent: int, n: int):
    """Links inside the batch, and of each prefix shingle its chains: (shingle, a class, least and greatest size)."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _ask([])
        tokens, classes, sizes = _Batch(texts, k).prefixes(Entries.by_step(answers), n, percent)
        order = np.lexsort((classes, sizes, tokens))
        tokens, classes, sizes = tokens[order], classes[order], sizes[order]
        link = chained(tokens, sizes, sizes, percent)
        links = np.stack(stars(classes[:-1][link], classes[1:][link]))
        head = np.flatnonzero(np.append(True, ~link)) if len(tokens) else np.zeros(0, np.int64)
        last = np.append(head[1:] - 1, len(tokens) - 1) if len(tokens) else head
        found = tokens[head], classes[head], sizes[head], sizes[last]
        order, parts = by_bucket(found[0], n)
        none = np.zeros((2, 0), np.int64)
        rows = []
        for i, (b, x, y) in enumerate(parts):
            own = none if i else links
            rows.append((b, _of(texts), b"".join([np.array([own.shape[1]], np.int64).tobytes(), own.tobytes(), *(c[order[x:y]].tobytes() for c in found)])))
        return _ask(rows)

    return run


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links contracted: (the smallest of a part, another of it)."""
    nodes, roots = contract(a, b)
    own = nodes != roots
    return roots[own], nodes[own]


def _stars(percent: int):
    """Classes that share a shingle and whose sizes allow similarity from one to the next, contracted: each linked with the smallest that the bucket links it with."""

    def run(batches):
        for _, _, blobs in _buckets(batches):
            links, found = [], [[], [], [], []]
            for x in blobs:
                m = int(np.frombuffer(x, np.int64, 1)[0])
                links.append(np.frombuffer(x, np.int64, 2 * m, 8).reshape(2, m))
                rest = (len(x) - 8 - 16 * m) // 32
                for j, (part, t) in enumerate(zip(found, (np.uint64, np.int64, np.int64, np.int64), strict=True)):
                    part.append(np.frombuffer(x, t, rest, 8 + 16 * m + 8 * rest * j))
            tokens, classes, least, most = map(np.concatenate, found)
            order = np.lexsort((classes, most, least, tokens))
            tokens, classes, least, most = tokens[order], classes[order], least[order], most[order]
            link = chained(tokens, least, most, percent) & (classes[1:] != classes[:-1])
            links.append(np.stack([classes[:-1][link], classes[1:][link]]))
            a, b = stars(*np.concatenate(links, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


SETS = "cluster long, blocks long, rep long, n long, tokens binary"


def _fetch(k: int):
    """The shingles of the classes' first documents."""

    def run(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if texts.num_rows and wanted.num_rows:
            clusters = {(r, c): x for r, c, *x in zip(*(wanted.column(c).to_pylist() for c in ("rep", "c1", "cluster", "blocks")), strict=True)}
            reps = pa.array(sorted({r for r, _ in clusters}), pa.int64())
            rows = Entries.batch(texts.filter(pc.is_in(texts.column("id"), value_set=reps)))
            for i, s in zip(rows.column("id").to_pylist(), shingle_sets(rows, k), strict=True):
                x = clusters.pop((i, class_of(s)[0]), None)
                if x is not None:
                    out.append((*x, i, len(s), s.tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 4, pa.binary()), strict=True)], ["cluster", "blocks", "rep", "n", "tokens"])

    return run


class Tree:
    """levels: from the leaves up, (bitmaps, hidden tokens, least size, greatest size, least group, greatest group)."""

    def __init__(self, sets: list[np.ndarray], groups: np.ndarray) -> None:
        sizes = np.array([len(s) for s in sets], np.int64)
        bits = 1 << int(np.clip(np.ceil(np.log2(4 * max(1.0, sizes.mean()))), 9, 14))
        words = bits // 64
        maps = np.zeros((len(sets), words), np.uint64)
        for m, s in zip(maps, sets, strict=True):
            at = (s % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(m, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        hidden = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, hidden, sizes, sizes, groups, groups)]
        while len(self.levels[-1][0]) > 1:
            m, h, lo, hi, g, k = self.levels[-1]
            at = np.arange(0, len(m), FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.maximum.reduceat(h, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(g, at), np.maximum.reduceat(k, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether a set under i and one under j may be as similar as asked."""
        m, h, lo, hi, g, k = self.levels[level]
        ok = (g[i] <= k[j]) & (g[j] <= k[i]) & (100 * hi[i] >= percent * lo[j]) & (100 * hi[j] >= percent * lo[i])
        at = np.flatnonzero(ok)
        step = max(1, (1 << 21) // m.shape[1])
        for a in range(0, len(at), step):
            x, y = i[at[a : a + step]], j[at[a : a + step]]
            most = np.bitwise_count(m[x] & m[y]).sum(1, dtype=np.int64) + np.minimum(h[x], h[y])
            most = np.minimum(most, np.minimum(hi[x], hi[y]))
            # J >= t means overlap >= t / (1 + t) of the sizes' sum
            ok[at[a : a + step]] = (100 + percent) * most >= percent * (lo[x] + lo[y])
        return ok

    def pairs(self, percent: int, skip):
        """Pairs of leaves i < j that may be similar, some at a time, the first leaves first; ``skip`` drops pairs not needed any more."""
        yield from self._down(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), percent, skip)

    def _down(self, level: int, i: np.ndarray, j: np.ndarray, percent: int, skip):
        if not level:
            keep = (i < j) & ~skip(i, j)
            i, j = i[keep], j[keep]
            ok = self.possible(0, i, j, percent)
            if ok.any():
                yield i[ok], j[ok]
            return
        ok = self.possible(level, i, j, percent)
        i, j = i[ok], j[ok]
        n = len(self.levels[level - 1][0])
        c, d = (x.ravel() for x in np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"))
        for a in range(0, len(i), 256):
            x = (i[a : a + 256, None] * FAN + c).ravel()
            y = (j[a : a + 256, None] * FAN + d).ravel()
            keep = (x <= y) & (y < n)
            yield from self._down(level - 1, x[keep], y[keep], percent, skip)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], groups: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all similar sets of a group; sets of equal ``known`` count as connected."""
    if len(sets) < 2:
        return []
    order = np.lexsort((np.array([len(s) for s in sets]), groups))
    sets = [sets[i] for i in order]
    label = np.arange(len(sets)) if known is None else np.unique(known[order], return_inverse=True)[1]
    out = []
    tree = Tree(sets, groups[order])
    for i, j in tree.pairs(percent, lambda i, j: label[i] == label[j]):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if label[x] != label[y] and similar(sets[x], sets[y], percent):
                label[label == label[y]] = label[x]
                out.append((int(order[x]), int(order[y])))
    return out


FOUND = "a long, b long, cluster long, rep long, n long, tokens binary"


def _join(percent: int, leaders: bool = False):
    """Links of a group; with ``leaders`` also the first set of each connected part."""

    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        reps, clusters = group.column("rep").to_numpy(), group.column("cluster").to_numpy()
        known = group.column("known").to_numpy() if "known" in group.schema.names else None
        links = forest(sets, clusters, percent, known)
        none = lambda n, t: pa.nulls(n, t)
        a, b = (pa.array([reps[x[side]] for x in links], pa.int64()) for side in (0, 1))
        out = pa.table([a, b, *(none(len(links), t) for t in (*[pa.int64()] * 3, pa.binary()))], [x.split()[0] for x in FOUND.split(", ")])
        if not leaders:
            return out.select(["a", "b"])
        label = np.arange(len(sets))
        for x, y in links:
            label[label == label[y]] = label[x]
        first = {}
        for i in np.argsort(reps, kind="stable"):
            first.setdefault(label[i], i)
        lead = group.take(pa.array(list(first.values()), pa.int64())).select(["cluster", "rep", "n", "tokens"])
        return pa.concat_tables([out, pa.table([none(len(first), pa.int64())] * 2 + lead.columns, out.schema.names).cast(out.schema)])

    return run


def _in_blocks(sets: DataFrame, percent: int, max_sets: int) -> DataFrame:
    """Links of clusters too large for one task, which are dealt into blocks."""
    sets = sets.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    join = lambda df, *keys: df.groupBy(*keys).applyInArrow(_join(percent), "a long, b long")
    found = checkpoint(sets.groupBy("cluster", "block").applyInArrow(_join(percent, True), FOUND))
    links, leaders = found.where("a is not null").select("a", "b"), found.where("rep is not null").select("cluster", "rep", "n", "tokens")
    many = leaders.groupBy("cluster").agg(F.ceil(F.count("*") / (2 * max_sets)).alias("parts"))
    leaders = leaders.join(many, "cluster").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")))
    links = checkpoint(links.unionByName(join(leaders, "cluster", "part")))
    # labels of all sets, without their shingles
    known = sets.select("cluster", "rep").join(components(links, "rep", "root"), "rep", "left").select("cluster", "rep", F.coalesce("root", "rep").alias("known"))
    known = checkpoint(known)
    largest = known.groupBy("cluster", "known").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max(F.struct("m", "known")).alias("x"))
    rest = known.join(largest.select("cluster", F.col("x.known").alias("main")), "cluster").where("known <> main").select("cluster", "rep")
    chunks = checkpoint(rest.groupBy("cluster").agg(F.ceil(F.count("*") / max_sets).alias("chunks")))
    if chunks.isEmpty():
        return links
    chunk = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("chunks"))
    # a set of the rest goes to every block but its own, where it is already
    labelled = sets.join(chunks, "cluster").join(known.select("rep", "known"), "rep").join(rest.select("rep", F.lit(True).alias("is_rest")), "rep", "left")
    to = F.when(F.col("is_rest"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = labelled.withColumn("to", F.explode(to))
    own = F.col("to") == F.col("block")
    dealt = dealt.withColumn("chunk", F.explode(F.when(own, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(chunk))))
    return links.unionByName(join(dealt.select("cluster", "to", "chunk", "rep", "n", "tokens", "known"), "cluster", "to", "chunk"))


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", max_sets: int = MAX_SETS) -> DataFrame:
    """(id, n, c1, c2, component): component is the smallest id reachable by links; (c1, c2) the class."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("h"), F.col(text_col).alias("text"))
    classes = checkpoint(arrow_map(rows, _classes(k), "id long, h long, n long, c1 long, c2 long"), tidy=True)
    texts, n = deal(docs, id_col, text_col)
    sorted_by_bucket = lambda asked: asked.repartition("bucket").sortWithinPartitions("bucket")
    asked = texts.groupBy("batch").applyInArrow(_ask_tokens(k, n), ASK)
    answers = arrow_map(sorted_by_bucket(asked), _answer(1, rarity), TELL)
    asked = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_ask_clusters(k, percent, n), ASK)
    clusters = components(arrow_map(sorted_by_bucket(asked), _stars(percent), "a long, b long"), "c1", "cluster")
    reps = classes.where("n > 0 and id is not null").groupBy("c1", "c2").agg(F.min(F.struct("id", "h")).alias("rep"), F.first("n").alias("n")).select("c1", "c2", F.col("rep.id").alias("rep"), F.col("rep.h").alias("h"), "n")
    members = checkpoint(clusters.join(reps, "c1").select("cluster", "rep", "h", "c1", "n"), tidy=True)
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / max_sets), F.ceil(F.sum("n") / MAX_TOKENS)).alias("blocks"))
    batch = place_of(F.col("rep"), F.col("h"), n).alias("batch")
    wanted = members.join(sizes, "cluster").select("cluster", "blocks", "rep", "c1", batch)
    sets = checkpoint(texts.groupBy("batch").cogroup(wanted.groupBy("batch")).applyInArrow(_fetch(k), SETS), tidy=True)
    packs = max(1, members.count() // 500)
    small = sets.where("blocks <= 1").withColumn("pack", F.pmod(F.xxhash64("cluster"), F.lit(packs)))
    links = small.groupBy("pack").applyInArrow(_join(percent), "a long, b long")
    large = sets.where("blocks > 1")
    if not large.isEmpty():
        links = links.unionByName(_in_blocks(large, percent, max_sets))
    roots = components(links, "rep", "root")
    of_class = reps.join(roots, "rep", "left").select("c1", "c2", F.coalesce("root", "rep").alias("component"))
    linked = classes.where("n > 0 and id is not null").join(of_class, ["c1", "c2"])
    alone = classes.where("n = 0 or id is null").withColumn("component", F.col("id"))
    return linked.unionByName(alone).select("id", "n", "c1", "c2", "component")


def op6_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
