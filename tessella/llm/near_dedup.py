"""Near-duplicate classes: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

A document's set holds its distinct shingles of five words (fewer words: the whole sequence as one). Documents are linked where
100 * |intersection| >= 75 * |union|, confirmed on full sets. Equal sets are one class and are compared once. One hash pass fills
256 bins; empty bins copy from full ones by a universal hash; 51 bands of five bins make the buckets. At a likeness of 0.75 a pair
shares no bucket with probability (1 - 0.75^5)^51 = 1e-6.

Candidates: in each bucket, all members meet the one with the smallest id (a star: as many edges as members). The links found join
classes into components. Buckets that still hold several components get a second star, around another member, and large ones up to
STARS, each around another. What is left in them is compared block by block: on one byte of each of 255 bins first, where an agreement
of AGREE, eight standard deviations of its estimate below the threshold, lets a pair pass, and then on the full sets at once, so that
only links that join components leave a task. Nothing is capped: a large bucket becomes more tasks, never a longer list.

classes(exact=True) adds an exact pass for what buckets can miss: texts of different components that share one of the rarest shingles of
both (a prefix filter, which no pair above the threshold escapes) meet on full sets. It costs an exchange of all shingles.

To classes() a doc_id is a node: rows that share one are one node, and rows with a null doc_id take the component of an equal set that
has one, else null. To near_dedup() each row is a node. Null and empty texts link with nothing. Other columns pass through it untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import beside, cut, drop, only, table

SHINGLE = 5
BINS, ROWS, BANDS = 256, 5, 51
NEAR, OF = 75, 100
#: Members of a star that one task compares; members of a block in the exhaustive part.
STAR_BLOCK, BLOCK = 1000, 1500
#: Shingles that a block of the exhaustive part may hold, about.
BLOCK_SHINGLES = 1_500_000
#: Share of agreeing bins below which a pair is out: 0.75 less eight standard deviations of its estimate (0.027 each).
AGREE = 0.53
#: Stars that a bucket of more than BLOCK members gets before its blocks meet.
STARS = 6
_SEEDS = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
_PROBES = np.random.Generator(np.random.PCG64(21)).integers(0, BINS, (BINS, 4096), dtype=np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pd.Series) -> Iterator[np.ndarray]:
    """The ascending distinct 64-bit shingle hashes of each text."""
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            yield np.empty(0, np.uint64)
            continue
        codes = np.empty(len(words), object)
        codes[:] = words
        h = pd.util.hash_array(codes, categorize=False)
        n = max(1, len(words) - SHINGLE + 1)
        wide = min(SHINGLE, len(words))
        acc = np.full(n, wide, np.uint64)
        for i in range(wide):
            acc = acc * _SEEDS[0] + h[i : i + n]
            acc ^= acc >> np.uint64(29)
        yield np.unique(_mix(acc))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin; empty bins copy from full ones, chosen by a hash of the bin and the attempt."""
    bins = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    full = np.zeros(BINS, bool)
    out = np.zeros(BINS, np.uint64)
    full[bins[first]] = True
    out[bins[first]] = hashes[first]
    empty, at = np.flatnonzero(~full), 0
    while len(empty):
        if at == _PROBES.shape[1]:  # not met in practice: the nearest full bin to the right
            source = np.flatnonzero(full)
            out[empty] = out[source[np.searchsorted(source, empty) % len(source)]]
            break
        probes = _PROBES[empty, at : at + 64]
        hits = full[probes]
        found = hits.any(1)
        out[empty[found]] = out[probes[found, hits[found].argmax(1)]]
        empty, at = empty[~found], at + 64
    return out


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bands = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for pdf in batches:
        for lo in range(0, len(pdf), 500):
            part = pdf.iloc[lo : lo + 500]
            rows = []
            for doc_id, h, hashes in zip(part["doc_id"], part["h"], shingle_sets(part["text"]), strict=True):
                if not len(hashes):
                    rows.append((doc_id, h, 0, 0, 0, None, None))
                    continue
                sig = signature(hashes)
                acc = bands.copy()
                for i in range(ROWS):
                    acc = _mix(acc * _SEEDS[1] + sig[i : BANDS * ROWS : ROWS])
                whole = np.array([hashes.sum(dtype=np.uint64), np.bitwise_xor.reduce(_mix(hashes ^ _SEEDS[2]))]).view(np.int64)
                rows.append((doc_id, h, len(hashes), int(whole[0]), int(whole[1]), acc.view(np.int64), _mix(sig)[: BANDS * ROWS].astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "h", "n", "s1", "s2", "keys", "sig"]).astype({"doc_id": "Int64"})


def _starred(pdf: pd.DataFrame) -> pd.DataFrame:
    """One star's block: its centre's text first, then members; the members that are near."""
    pdf = pdf.sort_values("member", key=lambda m: m != pdf["centre"].iloc[0], kind="stable")
    sets = shingle_sets(pdf["text"])
    centre = next(sets)
    near = []
    for member, s in zip(pdf["member"].iloc[1:], sets, strict=True):
        both = len(np.intersect1d(centre, s, assume_unique=True))
        if OF * both >= NEAR * (len(centre) + len(s) - both):
            near.append(member)
    return pd.DataFrame({"a": pdf["centre"].iloc[: len(near)].to_numpy(), "b": np.array(near, np.int64)})


def _verified(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """edges (a, b, n: the size of b's set): those that are near, on full sets. Each star is dealt into blocks by members and by their
    shingles, each with its centre."""
    sizes = edges.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / STAR_BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = edges.join(sizes, "a").select(F.col("a").alias("centre"), F.col("b").alias("member"), F.expr("pmod(xxhash64(b), blocks)").alias("block"))
    centres = members.select("centre", F.col("centre").alias("member"), "block").distinct()
    held = members.unionByName(centres).join(texts.select(F.col("doc_id").alias("member"), "text"), "member")
    return held.groupBy("centre", "block").applyInPandas(_starred, "a long, b long")


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole buckets, or a block of a bucket against one (i, j): links between different components, confirmed on full sets, and only
    as many as join the components. A pair that meets in several buckets is compared in the first band of both that is equal."""
    pdf = pdf.sort_values("key", kind="stable", ignore_index=True)
    key, node, label, n, own = (pdf[c].to_numpy() for c in ("key", "node", "label", "n", "own"))
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
    bands, texts, sets, root, out = np.stack(pdf["keys"].to_numpy()), pdf["text"], {}, {}, []

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def held(row: int) -> np.ndarray:
        if row not in sets:
            sets[row] = next(shingle_sets(texts.iloc[row : row + 1]))
        return sets[row]

    bounds = [0, *(np.flatnonzero(np.diff(key)) + 1), len(pdf)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        sets.clear()
        one, two = pdf["i"].iloc[lo], pdf["j"].iloc[lo]
        left, right = (lo + np.flatnonzero(own[lo:hi] == x) for x in (one, two))
        for x in left:
            maybe = right[(node[right] > node[x] if one == two else node[right] != node[x]) & (label[right] != label[x]) & (OF * np.minimum(n[right], n[x]) >= NEAR * np.maximum(n[right], n[x]))]
            if len(maybe):
                maybe = maybe[(sig[maybe] == sig[x]).mean(1) >= AGREE]
            if len(maybe):
                maybe = maybe[bands[x][(bands[maybe] == bands[x]).argmax(1)] == key[lo]]
            mine = find(label[x])
            maybe = [y for y in maybe if find(label[y]) != mine]
            if not maybe:
                continue
            s, others = held(x), [held(y) for y in maybe]
            sizes = np.array([len(o) for o in others])
            flat = np.concatenate(others)
            hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            for y in np.array(maybe)[OF * both >= NEAR * (len(s) + sizes - both)]:
                if find(label[x]) != find(label[y]):
                    root[find(label[x])] = find(label[y])
                    out.append((node[x], node[y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _rest_links(rest: DataFrame, kept: DataFrame, texts: DataFrame) -> DataFrame:
    """The links in buckets (key, node, label) that stars left in several components. Small buckets share a task; a large one is dealt
    into blocks, by rows and by shingles, and each pair of blocks is a task."""
    sized = cut(rest.join(kept.select("node", "h", "n", "keys"), "node").where(F.array_contains("keys", F.col("key"))).select("key", "node", "label", "h", "n"))
    units = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    tasks = sized.agg(F.ceil(units).cast("int").alias("t")).first()["t"] or 1
    blocks = sized.groupBy("key").agg(F.ceil(units).cast("int").alias("blocks"))
    dealt = sized.join(blocks, "key").withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    dealt = dealt.join(kept.select("node", "h", "sig", "keys"), ["node", "h"]).join(texts.select(F.col("doc_id").alias("node"), "h", "text"), ["node", "h"])
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    shared = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(tasks))).otherwise(F.col("key"))
    return paired.groupBy((F.col("blocks") == 1).alias("small"), shared.alias("task"), "i", "j").applyInPandas(_joined, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of the edges (a, b): label is the smallest node reachable. Alternates large and small stars,
    each an aggregation that combines before the shuffle and a join, until no edge changes."""
    now, was = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        made = cut(small)
        state = made.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop(now)
        now = made
        if state == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        was = state


def _labelled(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """The buckets' rows with the component of each node; only buckets that hold more than one."""
    named = candidates.select("key", "node").join(components(links), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    return named.join(several.select("key"), "key")


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each shingle of each text with the size of its set."""
    for pdf in batches:
        for node, hashes in zip(pdf["node"], shingle_sets(pdf["text"]), strict=True):
            yield pd.DataFrame({"node": node, "n": len(hashes), "shingle": hashes.view(np.int64)})


def prefix_links(texts: DataFrame, named: DataFrame) -> DataFrame:
    """All links (a, b) between texts (doc_id, text) of different components (node, label). The shingles of a set in the order of rarity,
    then hash: two sets at the threshold share one of the first n - ceil(0.75 n) + 1 of both."""
    each = texts.select(F.col("doc_id").alias("node"), "text").mapInPandas(_exploded, "node long, n long, shingle long")
    df = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ordered = each.join(df, "shingle", "left").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "shingle"))).alias("s"))
    first = F.expr(f"cast(n - ceil(n * {NEAR} / {OF}) + 1 as int)")
    rare = ordered.select("node", "n", F.explode(F.slice("s", F.lit(1), first)).alias("s")).where("s.df > 1").select("node", "n", "s.shingle").join(named, "node", "left").withColumn("label", F.coalesce("label", "node"))
    other = rare.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "label")])
    met = rare.join(other, "shingle").where(f"node < node_b and label <> label_b and {OF} * least(n, n_b) >= {NEAR} * greatest(n, n_b)")
    return _verified(cut(met.select(F.col("node").alias("a"), F.col("node_b").alias("b"), F.col("n_b").alias("n")).distinct()), texts)


def classes(docs: DataFrame, exact: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    signed = docs.mapInPandas(_signed, "doc_id long, h long, n long, s1 long, s2 long, keys array<long>, sig binary")
    signed = cut(signed.withColumn("row", F.monotonically_increasing_id()))
    sets = signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first"))
    sets = sets.select("n", "s1", "s2", F.col("first.doc_id").alias("node"), F.col("first.row").alias("row"))
    nodes = sets.where("node is not null")
    kept = signed.where("n > 0").join(nodes.select("n", "s1", "s2", "node", "row"), ["n", "s1", "s2", "row"])
    bands = kept.select("node", "n", F.explode("keys").alias("key"))
    stars = bands.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").select("key", "a")
    candidates = cut(bands.join(stars, "key"))
    named = candidates.select(F.col("node").alias("doc_id")).distinct() if not exact else kept.select(F.col("node").alias("doc_id"))
    texts = beside(docs, cut(named), "doc_id", "left_semi", salts=1)
    texts = cut(texts.groupBy("doc_id", "h").agg(F.first("text").alias("text")))
    tried = cut(candidates.where("node <> a").select("a", F.col("node").alias("b"), "n").distinct())
    links = cut(_verified(tried, texts))

    mixed, larger = cut(_labelled(candidates, links)), F.lit(True)
    for star in range(1, STARS):
        sizes = mixed.groupBy("key").agg(F.count("*").alias("size"), F.min_by(F.struct("node", "label"), F.xxhash64("node", "key", F.lit(star))).alias("c")).where(larger)
        more = mixed.join(sizes, "key").where("label <> c.label").select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct().join(kept.select(F.col("node").alias("b"), "n"), "b")
        more = cut(more.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
        links, tried = cut(links.unionByName(_verified(more, texts))), tried.unionByName(more)
        mixed, larger = cut(_labelled(mixed.drop("label"), links)), F.col("size") > BLOCK
        if not mixed.groupBy("key").count().where(F.col("count") > BLOCK).take(1):
            break

    links = links.unionByName(_rest_links(mixed.distinct(), kept, texts))
    if exact:
        links = cut(links)
        links = links.unionByName(prefix_links(texts, components(links)))

    named = sets.join(components(links), "node", "left").select("n", "s1", "s2", F.coalesce("label", "node").alias("component_id"))
    found = signed.where("n > 0").select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"])
    lone = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n", "component_id").unionByName(lone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near texts, that of the smallest doc_id, nulls last; all columns as they were. Each row is
    a node here: rows without a doc_id and unlike texts of one doc_id stay. Of empty texts, one for each doc_id and all without one."""
    row = next(c for c in (f"row{i}" for i in range(len(docs.columns) + 1)) if c not in {x.lower() for x in docs.columns})
    held = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    names = only(held, row, "doc_id").select(F.col(row).alias("row"), F.col("doc_id").cast("bigint").alias("id"))
    found = classes(only(held, row, "text").select(F.col(row).alias("doc_id"), "text")).withColumnRenamed("doc_id", "row").join(names, "row")
    bare = F.col("n_shingles") == 0
    group = [F.when(~bare, F.col("component_id")).alias("near"), F.when(bare, F.col("id")).alias("empty"), F.when(bare & F.col("id").isNull(), F.col("row")).alias("lone")]
    kept = found.groupBy(*group).agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias(row)).select(row)
    return held.join(kept, row, "left_semi").drop(row).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
