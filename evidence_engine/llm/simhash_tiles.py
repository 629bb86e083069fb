"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are put into tiles of one population count each; only tiles whose counts differ by
at most the radius are paired, since a difference in counts is a lower bound of the distance. Within a pair
the tiles are cut again, in the order of the counts of their four quarters, and pieces whose counts lie
apart by more than the radius in sum are skipped too. What remains is compared by numpy exclusive-or and bit
counts, every pair, so no link is lost. A pair of tiles returns not its links but a spanning forest of them,
at most a row for each fingerprint, and the forests are joined by distributed components.

Exact copies share one fingerprint and are compared once. A pair of tiles is a unit of bounded work; tiles
of one count are dealt by hash, so none grows beyond its bound. A tile holds 65,536 rows of a few
machine words and is sent to the tiles that it meets, so what is shuffled stays far below the texts until a
count has very many tiles. Rows meet their class by lookup(): a fingerprint or a class with a large share of all
rows is not gathered in one task.

Edge cases: a null text is an empty one; texts without words have fingerprint zero and are linked like any
other; null ids never name a component, and a component of null ids only has a null one; repeated rows are
copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_engine.llm.shared import connected_components, lookup, materialize, spanning_stars, text_slices

SEED = 42


def _lane(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes made of h; the first is h itself."""
    if not k:
        return h
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """The hash of each shingle of words, repeats included; of fewer words the whole."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=False)]


def majorities(h: np.ndarray, sizes: np.ndarray, lanes: int) -> np.ndarray:
    """A row of words for each group of hashes, of these sizes: a bit is 1 if it is in over half of the group's."""
    ends, out = np.cumsum(sizes), np.zeros((len(sizes), lanes), np.uint64)
    for k in range(lanes):
        bits = np.unpackbits(_lane(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i, (n, end) in enumerate(zip(sizes, ends, strict=True)):
            ones = bits[end - n : end].sum(axis=0, dtype=np.int32)
            out[i, k] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def sketches(texts: list[str | None], shingle: int, lanes: int = 1, at_once: int = 1 << 16, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes of each text's word shingles, 64 bits a lane (a bit is 1 if it is in over half the hashes), and the
    numbers of shingles; with distinct, of the set of shingles: repeats count once in both."""
    out, size = np.zeros((len(texts), lanes), np.uint64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owner: list[int] = []

    def settle() -> None:
        out[owner] = majorities(np.array(hashes, np.uint64), size[owner], lanes)
        hashes.clear()
        owner.clear()

    for i, t in enumerate(texts):
        found = shingle_hashes(t, shingle)
        if distinct:
            found = list(set(found))
        if found:
            hashes.extend(found)
            owner.append(i)
            size[i] = len(found)
        if len(hashes) >= at_once:
            settle()
    settle()
    return out, size


def fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    return sketches(texts, shingle)[0][:, 0]


def _fingerprint(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in text_slices(batches):
            fp = fingerprints(batch.column("text").to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return run


def fingerprint_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) for every row."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_fingerprint(shingle), "id long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, piece: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of fingerprints (b None: within a), as int64 pairs."""

    def cut(x: np.ndarray):
        q = _quarters(x)
        order = np.lexsort(q.T[::-1])
        x, q = x[order], q[order]
        at = range(0, len(x), piece)
        return [x[i : i + piece] for i in at], np.array([q[i : i + piece].min(axis=0) for i in at]), np.array([q[i : i + piece].max(axis=0) for i in at])

    pieces_a, low_a, high_a = cut(a)
    pieces_b, low_b, high_b = (pieces_a, low_a, high_a) if b is None else cut(b)
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    held = 0
    for i, x in enumerate(pieces_a):
        gap = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b)).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if b is None and j < i:
                continue
            r, c = np.nonzero(np.bitwise_count(x[:, None] ^ pieces_b[j][None, :]) <= radius)
            if b is None and j == i:
                r, c = r[r < c], c[r < c]
            if len(r):
                us.append(x[r].view(np.int64))
                vs.append(pieces_b[j][c].view(np.int64))
                held += len(r)
                if held > 500_000:
                    u, v = spanning_stars(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], 0
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning_stars(np.concatenate(us), np.concatenate(vs))


def _links(radius: int):
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = (np.asarray(x.values, dtype=np.int64).view(np.uint64) if x.is_valid else None for x in (a, b))
                u, v = tile_links(a, b, radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


TILE_ROWS = 1 << 16


def tile_pairs(held: DataFrame, level: str, value: Column, reach: int, tile_rows: int) -> DataFrame | None:
    """held, whose `level` is an int -> (a, b): the values of each two tiles whose levels differ by at most reach, as
    arrays; b is null for a tile with itself. None if held is empty."""
    n_of = {r[level]: -(-r["n"] // tile_rows) for r in held.groupBy(level).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each level
    if not n_of:
        return None
    n_tiles = F.create_map(*(F.lit(x) for kv in sorted(n_of.items()) for x in kv))
    dealt = held.select(F.col(level).alias("x"), F.pmod("key", n_tiles[F.col(level)]).cast("int").alias("i"), value.alias("value")).repartition(min(4096, sum(n_of.values())), "x", "i")
    tiles = dealt.groupBy("x", "i").agg(F.collect_list("value").alias("rows"))
    # The tiles that each one meets: those of the same level that come after it, and all of the next levels.
    meets = {x: [(x + d, j) for d in range(reach + 1) for j in range(n_of.get(x + d, 0))] for x in n_of}
    cells = [(x, i, y, j) for x, n in n_of.items() for i in range(n) for y, j in meets[x] if (x, i) < (y, j)]
    alone = tiles.select(F.col("rows").alias("a"), F.lit(None).cast(tiles.schema["rows"].dataType).alias("b"))
    if not cells:
        return alone
    y = F.explode(F.filter(F.sequence(F.col("x"), F.col("x") + reach), lambda v: v.isin(*n_of))).alias("y")
    first = tiles.select("*", y).select("*", F.explode(F.sequence(F.lit(0), (n_tiles[F.col("y")] - 1).cast("int"))).alias("j")).where("x < y or i < j")
    x = F.explode(F.filter(F.sequence(F.col("x") - reach, F.col("x")), lambda v: v.isin(*n_of))).alias("w")
    second = tiles.select("*", x).select("*", F.explode(F.sequence(F.lit(0), (n_tiles[F.col("w")] - 1).cast("int"))).alias("k")).where("w < x or k < i")
    parts = min(4096, len(cells))
    left = first.select("x", "i", "y", "j", F.col("rows").alias("a")).repartition(parts, "x", "i", "y", "j")
    right = second.select(F.col("w").alias("x"), F.col("k").alias("i"), F.col("x").alias("y"), F.col("i").alias("j"), F.col("rows").alias("b")).repartition(parts, "x", "i", "y", "j")
    return alone.unionByName(left.hint("merge").join(right, ["x", "i", "y", "j"]).select("a", "b"))


def linked_fingerprints(fps: DataFrame, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """fps(fp long, distinct) -> (u, v): links of distance <= radius, as spanning forests of pairs of tiles."""
    held = fps.select("fp", F.bit_count("fp").cast("int").alias("pc"), F.xxhash64("fp").alias("key"))
    pairs = tile_pairs(held, "pc", F.col("fp"), radius, tile_rows)
    return pairs.mapInArrow(_links(radius), "u long, v long") if pairs else fps.sparkSession.createDataFrame([], "u long, v long")


def _named(rows: DataFrame, nodes: DataFrame, links: DataFrame, node: str, label: str) -> DataFrame:
    """rows with the component_id of their node. nodes(node, least, n): its smallest id and its number of rows."""
    roots = connected_components(links, label).withColumnRenamed("node", node)
    held = materialize(nodes.select(node, "least", "n").join(roots, node, "left").withColumn("root", F.coalesce("root", node)), f"{label}-named")
    classes = materialize(held.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes")), f"{label}-classes")
    found = materialize(lookup(held.select(node, "root", "n"), classes, "root", "nodes").select(node, "component_id", "n"), f"{label}-components")
    return lookup(rows, found, node, "n")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, fp long, component_id) for every row: rows reachable over links share the smallest of their ids."""
    rows = materialize(fingerprint_rows(df, id_col, text_col, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    return _named(rows, fps, linked_fingerprints(fps, radius, tile_rows), "fp", "simhash").select("id", "fp", "component_id")


# Near copies by similarity. A similarity of 0.8 leaves a distance of about a sixth of the bits, which 64 bits
# estimate too roughly: the first lane only sieves, and all lanes together say which pairs are candidates. Candidates are then
# looked at: what links them is the similarity of their sets of shingles.
LANES = 4


def shingle_sets(texts: list[str | None], shingle: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and a hash of that set."""
    from xxhash import xxh64_intdigest

    sets = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for t in texts]
    return sets, np.array([xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)


def _sketch(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]):
        for batch in text_slices(batches, max_bytes=2 << 20):
            sets, node = shingle_sets(batch.column("text").to_pylist(), shingle)
            size = np.array([len(x) for x in sets], np.int64)
            lanes = np.zeros((len(sets), LANES), np.uint64)
            if size.any():
                lanes[size > 0] = majorities(np.concatenate(sets), size[size > 0], LANES)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(node), *(pa.array(lanes[:, k].copy().view(np.int64)) for k in range(LANES)), pa.array(size)], names=["id", "node", *(f"w{k}" for k in range(LANES)), "n"])

    return run


def _sets(shingle: int):
    """Rows with the set of shingles in place of the text, but for rows whose text isn't that of their node."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in text_slices(batches):
            sets, node = shingle_sets(batch.column("text").to_pylist(), shingle)
            own = np.flatnonzero(node == np.asarray(batch.column("node")))
            kept = batch.select([c for c in batch.schema.names if c != "text"]).take(pa.array(own))
            yield kept.append_column("shingles", pa.array([sets[i].tobytes() for i in own], pa.binary()))

    return run


def radii(similarity: float) -> tuple[int, int]:
    """Bits that the first lane, and that all lanes may differ by, for candidates of at least this similarity (of sets of
    shingles): the expected distance and some three standard deviations."""
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine) / np.pi)
    wide = 64 * LANES
    return int(64 * share + 3 * np.sqrt(64 * share * (1 - share))), int(wide * share + 2.5 * np.sqrt(wide * share * (1 - share)))


def copy_links(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, similarity: float, piece: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (b None: within a). Tiles are in order of size, and pieces are
    skipped if their sizes or their population counts lie too far apart."""
    first, total = radii(similarity)

    def cut(x: dict[str, np.ndarray]):
        order = np.argsort(x["n"], kind="stable")
        x = {k: v[order] for k, v in x.items()}
        return [{k: v[i : i + piece] for k, v in x.items()} for i in range(0, len(order), piece)]

    def span(x: dict[str, np.ndarray]) -> tuple[int, int, int, int]:
        pc = np.bitwise_count(x["w0"])
        return int(x["n"][0]), int(x["n"][-1]), int(pc.min()), int(pc.max())

    pieces_a = cut(a)
    pieces_b = pieces_a if b is None else cut(b)
    spans_a, spans_b = [span(x) for x in pieces_a], [span(x) for x in pieces_b]
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    held = 0
    for i, x in enumerate(pieces_a):
        for j, y in enumerate(pieces_b):
            p, q = spans_a[i], spans_b[j]
            if b is None and j < i or max(p[0], q[0]) * similarity > min(p[1], q[1]) or max(p[2] - q[3], q[2] - p[3]) > first:
                continue
            r, c = np.nonzero(np.bitwise_count(x["w0"][:, None] ^ y["w0"][None, :]) <= first)
            if b is None and j == i:
                r, c = r[r < c], c[r < c]
            if not len(r):
                continue
            apart = sum(np.bitwise_count(x[f"w{k}"][r] ^ y[f"w{k}"][c]).astype(np.int32) for k in range(LANES))
            near = (apart <= total) & (np.minimum(x["n"][r], y["n"][c]) >= similarity * np.maximum(x["n"][r], y["n"][c]))
            if near.any():
                us.append(x["node"][r[near]])
                vs.append(y["node"][c[near]])
                held += len(us[-1])
                if held > 500_000:
                    u, v = spanning_stars(np.concatenate(us), np.concatenate(vs))
                    us, vs, held = [u], [v], 0
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning_stars(np.concatenate(us), np.concatenate(vs))


def _copies(similarity: float):
    def tile(rows) -> dict[str, np.ndarray] | None:
        if not rows.is_valid:
            return None
        found = {f: np.asarray(rows.values.field(f), dtype=np.int64) for f in ("node", "n", *(f"w{k}" for k in range(LANES)))}
        return found | {f"w{k}": found[f"w{k}"].view(np.uint64) for k in range(LANES)}

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                u, v = copy_links(tile(a), tile(b), similarity)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


#: Bytes of shingles, and texts, of one tile of a group of candidates.
GROUP_BYTES, GROUP_ROWS = 4 << 20, 8192


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, ascending, have this Jaccard similarity. Counted by one sort of both."""
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


def verified_links(rows: dict[str, np.ndarray], sets: list[np.ndarray], tile: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the real links among these candidates; if they are of two tiles, of links between these alone.

    Pairs of candidates are looked at one after the other, but for those that found links already join: whatever such a pair's
    similarity, it adds nothing. So copies of one text cost about a look each, not one for each pair."""
    first, total = radii(similarity)
    order = np.argsort(rows["n"], kind="stable")
    n, lanes, part = rows["n"][order], [rows[f"w{k}"].view(np.uint64)[order] for k in range(LANES)], tile[order]
    two = len(np.unique(part)) > 1
    label = np.arange(len(order))
    us, vs = [], []
    until = np.searchsorted(n, n / similarity + 1e-9, side="right")
    for i in range(len(order)):
        j = np.arange(i + 1, until[i])
        if two:
            j = j[part[j] != part[i]]
        j = j[label[j] != label[i]]
        j = j[np.bitwise_count(lanes[0][j] ^ lanes[0][i]) <= first]
        j = j[sum(np.bitwise_count(x[j] ^ x[i]).astype(np.int32) for x in lanes) <= total] if len(j) else j
        for k in j.tolist():
            if label[k] != label[i] and similar(sets[order[i]], sets[order[k]], similarity):
                us.append(rows["node"][order[i]])
                vs.append(rows["node"][order[k]])
                label[label == label[k]] = label[i]
    return np.array(us, np.int64), np.array(vs, np.int64)


def _verify(similarity: float):
    fields = ("node", "n", *(f"w{k}" for k in range(LANES)))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for cell in batch.column("rows"):
                held = cell.values
                _, once = np.unique(np.asarray(held.field("node")), return_index=True)  # repeated rows of one id
                held = held.take(pa.array(once))
                sets = [np.frombuffer(x, np.uint64) for x in held.field("shingles").to_pylist()]
                u, v = verified_links({f: np.asarray(held.field(f), np.int64) for f in fields}, sets, np.asarray(held.field("tile")), similarity)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def real_links(texts: DataFrame, nodes: DataFrame, candidates: DataFrame, shingle: int, similarity: float, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The links (u, v) of `candidates` that their texts' sets of shingles bear out, as spanning forests.

    Candidates are grouped by the components of their links, and only their texts, one a node, are read again. A group is cut
    into tiles by the bytes of its sets; a pair of tiles is a task's work, which looks at the pairs of candidates in it. A
    group of one tile, as nearly all are, is shuffled once."""
    lanes = [f"w{k}" for k in range(LANES)]
    grouped = connected_components(candidates, "candidates")
    roots = grouped.select(F.col("root").alias("node"), "root").distinct()
    held = nodes.where("least is not null").join(grouped.unionByName(roots), "node").select("node", "root", "least", "size", *lanes)
    held = materialize(held, "candidates")
    count = F.count(F.lit(1))
    tiles = held.groupBy("root").agg(F.greatest(F.ceil(F.sum(8 * F.col("size")) / group_bytes), F.ceil(count / GROUP_ROWS)).cast("int").alias("tiles"), count.alias("members"))
    tiles = materialize(tiles, "candidate-groups")
    dealt = lookup(held, tiles, "root", "members").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # The texts are shuffled at every size, as how many candidates there are is not bounded.
    read = texts.join(dealt.withColumnRenamed("least", "id").hint("merge"), "id").select("text", "root", "tile", "tiles", "node", F.col("size").alias("n"), *lanes)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in read.schema if f.name != "text")
    sets = read.mapInArrow(_sets(shingle), f"{kinds}, shingles binary")
    # A cell is two tiles of a group, or the tile of a group that has only one. Two tiles' cell looks between them, a tile's own cell within.
    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    row = F.struct("tile", "node", "n", *lanes, "shingles").alias("row")
    cells = cells.select("root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), row).groupBy("root", "i", "j").agg(F.collect_list("row").alias("rows"))
    return cells.select("rows").mapInArrow(_verify(similarity), "u long, v long")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, tile_rows: int = TILE_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, component_id) for every row: rows reachable over links of texts of this similarity or more share the smallest of their
    ids. Rows without an id share that of an equal set of shingles, but are linked to no other.

    The similarity is that of the sets of shingles, so a text and the same text with passages repeated are alike. Sketches
    find candidates: tiles hold texts of like numbers of distinct shingles, since such a similarity needs a ratio of sizes no
    less, so only tiles of the same and the next level are paired. Their sets decide: no two texts below the similarity
    are linked. A few pairs above it may not be candidates, as the sketches' distance is an estimate."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lanes = [f"w{k}" for k in range(LANES)]
    rows = materialize(slim.mapInArrow(_sketch(shingle), "id long, node long, " + "".join(f"{w} long, " for w in lanes) + "n long"), "sketches")
    nodes = materialize(rows.groupBy("node", *lanes, F.col("n").alias("size")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-sketches")
    level = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.lit(float(-np.log(similarity)))).cast("int")
    held = nodes.where("least is not null").select("node", F.col("size").alias("n"), *lanes, level.alias("level"), F.col("node").alias("key"))
    pairs = tile_pairs(held, "level", F.struct("node", "n", *lanes), 1, tile_rows)
    if not pairs:
        return rows.select("id", F.col("id").alias("component_id"))
    candidates = pairs.mapInArrow(_copies(similarity), "u long, v long")
    links = real_links(slim, nodes, candidates, shingle, similarity, group_bytes)
    return _named(rows.select("id", "node"), nodes, links, "node", "near-copies").select("id", "component_id")


def drop_near_duplicates(df: DataFrame, found: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """df, all columns, with one row of each component: that of the smallest id; rows with a null id stay.

    found has (id, component_id), by default of near_duplicates(). If ids repeat, one row of each such id stays; its
    texts may differ. The texts are shuffled once, at every size: how many ids stay is not bounded, so they are never
    broadcast."""
    if found is None:
        found = near_duplicates(df, id_col, text_col, shingle, radius)
    first = materialize(found.where("id = component_id").groupBy("id").agg(F.count(F.lit(1)).alias("n")), "representatives")
    chosen = df.join(first.select(F.col("id").alias(id_col)).hint("merge"), id_col, "left_semi")
    if first.where("n > 1").limit(1).count():
        again = first.where("n > 1").select(F.col("id").alias(id_col)).hint("merge")
        chosen = chosen.join(again, id_col, "left_anti").unionByName(df.join(again, id_col, "left_semi").dropDuplicates([id_col]))
    return chosen.select(df.columns).unionByName(df.where(F.col(id_col).isNull()))
