"""Exact near-duplicate classes: a join in the metric space of Jaccard distances.

General over ``doc_id, text``: the library's own records hold no texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from nearfield.llm.common import SLICE, WordTable, blobs, kept, slices, text_rows
from nearfield.llm.components import connected_components
from nearfield.runtime import hot_key_join, materialize, positions


@dataclass(frozen=True)
class JaccardParams:
    """Texts link when 100 * shared shingles >= ``percent`` * all shingles of both.

    ``sketch_bits`` sets the size of the table of approximate shingle counts,
    ``filter_bits`` that of the filter for texts with a partner, and
    ``region_rows`` and ``region_bytes`` the largest region that one task joins.
    None of them changes the result.
    """

    words: int = 5
    percent: int = 80
    sketch_bits: int = 18
    filter_bits: int = 23
    region_rows: int = 2048
    region_bytes: int = 32 << 20

    @property
    def radius(self) -> float:
        """Largest distance of two linked texts, with room for rounding."""
        return 1 - self.percent / 100 + 1e-9


def _mix(h: np.ndarray, by: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(by)
        return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word windows.

    Texts are lower-cased in A-Z; words are runs of anything but ASCII white
    space. A text with fewer words than a window is one shingle, a text without
    words has none.
    """

    def __init__(self, words: int):
        self.words = words
        self.table = WordTable(
            lambda new: (np.array([xxhash.xxh3_64_intdigest(w) for w in new], np.uint64),)
        )

    def __call__(self, texts: list[bytes]):
        """The sets of some texts, one after the other."""
        for words in self.table.prepare([t.lower().split() for t in texts]):
            yield self.windows(self.table.numbers(words))

    def windows(self, numbers: np.ndarray) -> np.ndarray:
        if not len(numbers):
            return np.zeros(0, np.uint64)
        hashes = self.table.columns[0][numbers]
        window = min(self.words, len(hashes))
        count = len(hashes) - window + 1
        total = np.full(count, window, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(window):
                total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + count]
        return np.unique(_mix(total, 0xBF58476D1CE4E5B9))


def _node(shingles: np.ndarray) -> np.int64:
    """One number for a set of shingles: the wrapping sum of their mixed hashes."""
    with np.errstate(over="ignore"):
        return _mix(shingles, 0x94D049BB133111EB).sum(dtype=np.uint64).view(np.int64)


def _sketch(shingles: np.ndarray) -> bytes:
    """Parities of the set's members per hash slot, with two to four slots for each member.

    The sketches of two sets differ in no more bits than the sets in members.
    """
    width = max(64, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    slots = (shingles & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=width) & 1, bitorder="little").tobytes()


def _each(batches):
    for batch in batches:
        yield from slices(batch)


_SHINGLERS: dict[int, Shingler] = {}


def _sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sets of some texts; the words met are kept for later groups of this Python worker."""
    shingler = kept(_SHINGLERS, words, Shingler)
    found: list[np.ndarray] = []
    for at in range(0, len(texts), SLICE):
        found.extend(shingler(texts[at : at + SLICE]))
    return found


def shingle_counts(docs: DataFrame, params: JaccardParams) -> np.ndarray:
    """Approximate document frequency by shingle: counts per hash slot over all texts.

    The table has a fixed size; tasks sum their own texts before the shuffle.
    """
    size, shift = 1 << params.sketch_bits, np.uint64(64 - params.sketch_bits)
    words = params.words

    def count(batches):
        shingler, sums = Shingler(words), np.zeros(size, np.int64)
        for part in _each(batches):
            found = list(shingler(blobs(part)))
            slots = (np.concatenate(found) >> shift).astype(np.int64)
            sums += np.bincount(slots, minlength=size)
        seen = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(seen), pa.array(sums[seen])], names=["slot", "n"])

    rows = text_rows(docs).select("_text").mapInArrow(count, "slot bigint, n bigint")
    total = np.zeros(size, np.int64)
    for slot, n in rows.groupBy("slot").agg(F.sum("n")).collect():
        total[slot] = n
    return total


def text_profiles(docs: DataFrame, counts: np.ndarray, params: JaccardParams) -> DataFrame:
    """``doc_id, n_shingles, node, text_id, bytes, sketch, prefix`` of every text.

    ``node`` stands for the set of shingles; equal sets have equal nodes, and
    different ones do not, up to the chance of equal 64-bit hashes. ``prefix``
    has the rarest shingles of the set, as many as two linked texts must share
    one of: all but the ceil(percent * n / 100) - 1 most frequent. ``text_id``
    is the hash of the text, ``bytes`` what text and set take inside a task,
    ``sketch`` bounds the overlap of two sets from above (``likely_links``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    shift, words, percent = np.uint64(64 - params.sketch_bits), params.words, params.percent

    def profile(batches):
        shingler = Shingler(words)
        for part in _each(batches):
            sizes, nodes, prefixes, room, sketches = [], [], [], [], []
            texts = blobs(part)
            for text, found in zip(texts, shingler(texts)):
                n = len(found)
                room.append(8 * n + len(text))
                sizes.append(n)
                nodes.append(_node(found))
                sketches.append(_sketch(found))
                order = np.argsort(shared.value[(found >> shift).astype(np.int64)], kind="stable")
                length = n - (percent * n + 99) // 100 + 1 if n else 0
                prefixes.append(found[order[:length]].view(np.int64))
            lengths = np.array([len(p) for p in prefixes], np.int32)
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.record_batch(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    part.column("text_id"),
                    pa.array(room, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    pa.ListArray.from_arrays(offsets, np.concatenate(prefixes)),
                ],
                names=["doc_id", "n_shingles", "node", "text_id", "bytes", "sketch", "prefix"],
            )

    schema = (
        "doc_id bigint, n_shingles bigint, node bigint, text_id bigint, bytes bigint, sketch binary, "
        "prefix array<bigint>"
    )
    return text_rows(docs).withColumn("text_id", F.xxhash64("_text")).mapInArrow(profile, schema)


def _marks(df: DataFrame, column: str, bits: int) -> DataFrame:
    """``_slot, _mark``: a filter of ``bits`` bits for a bigint column, at most ``bits / 64`` rows."""
    place = F.pmod(column, F.lit(bits))
    marks = df.select(F.shiftright(place, 6).alias("_slot"), place.alias("_at")).select(
        "_slot", F.expr("shiftleft(1L, cast(_at & 63 as int))").alias("_mark")
    )
    return marks.groupBy("_slot").agg(F.bit_or("_mark").alias("_mark"))


def _marked(df: DataFrame, wanted: DataFrame, column: str, bits: int) -> DataFrame:
    """Rows of ``df`` whose ``column`` passes the filter of ``wanted``, all its own and few others.

    At most ``bits / 64`` rows of two numbers are broadcast.
    """
    place = F.pmod(column, F.lit(bits))
    likely = df.withColumn("_slot", F.shiftright(place, 6)).join(
        F.broadcast(_marks(wanted, column, bits)), "_slot"
    )
    likely = likely.withColumn("_at", place).filter("shiftright(_mark, cast(_at & 63 as int)) & 1L = 1L")
    return likely.select(df.columns)


def voronoi_regions(profiles: DataFrame, params: JaccardParams) -> DataFrame:
    """``pivot, node``: every set beside the pivot of each rare shingle it shares with another set.

    The pivot of a shingle is the least node that has it in its prefix; two
    linked texts share such a shingle and so its region. A set takes part once
    per different pivot, and only where another member has a size that a link
    allows. Least and largest node per shingle are summed before the shuffle;
    two rows of a shingle name both its nodes, and only shingles with more are
    looked up again, behind a filter of fixed size.
    """
    tokens = profiles.select("node", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("_n"), F.min("node").alias("pivot"), F.max("node").alias("node")
    )
    shared = materialize(shared.filter("pivot < node"), "shared-shingles")
    many = shared.filter("_n > 2").select("token", "pivot")
    bits = 1 << params.filter_bits
    looked = _marked(tokens, many, "token", bits).join(many, "token").filter("node != pivot")
    regions = shared.filter("_n = 2").select("pivot", "node")
    regions = regions.unionByName(looked.select("pivot", "node")).distinct()
    own = regions.select("pivot", F.col("pivot").alias("node")).distinct()
    return _of_fitting_size(materialize(regions.unionByName(own), "regions"), profiles, params)


def _of_fitting_size(regions: DataFrame, profiles: DataFrame, params: JaccardParams) -> DataFrame:
    """``pivot, node, bytes``: members that share a region with a set of fitting size, and pivots.

    Sizes fall into bands, so that the sizes of linked sets are at most one band apart.
    """
    sizes = profiles.groupBy("node").agg(
        F.min("n_shingles").alias("_size"), F.max("bytes").alias("bytes")
    )
    width = np.log(100 / params.percent) * 1.000001 if params.percent < 100 else 1.0
    band = F.floor(F.log("_size") / F.lit(float(width)))
    members = materialize(
        regions.join(sizes, "node").select("pivot", "node", "bytes", band.alias("band")), "region-bands"
    )
    counts = members.groupBy("pivot", "band").agg(F.count(F.lit(1)).alias("_n"))
    around = counts.select(
        "pivot", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), "_n"
    )
    fitting = around.groupBy("pivot", "band").agg(F.sum("_n").alias("_n")).filter("_n > 1").drop("_n")
    kept = hot_key_join(members, fitting, ["pivot", "band"], "node").select("pivot", "node", "bytes")
    pivots = members.filter("node = pivot").join(kept.select("pivot").distinct(), "pivot")
    return kept.unionByName(pivots.select("pivot", "node", "bytes")).distinct()


LINKS = "src bigint, dst bigint"


def _link_table(links: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*links) if links else ((), ())
    return pa.table({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})


def hot_regions(regions: DataFrame, params: JaccardParams) -> DataFrame:
    """``pivot, _rows`` of regions that one task may not hold, and how many of its sets one may."""
    weights = regions.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("bytes").alias("_sum"), F.max("bytes").alias("_most")
    )
    large = (F.col("_n") > params.region_rows) | (F.col("_sum") > params.region_bytes)
    rows = F.least(
        F.lit(params.region_rows), F.greatest(F.lit(1), F.floor(F.lit(params.region_bytes) / F.col("_most")))
    )
    return materialize(weights.filter(large).select("pivot", rows.cast("bigint").alias("_rows")), "hot-regions")


class _Sketches:
    """Sketches of one region inside a task, of one width per group of rows."""

    def __init__(self, size: np.ndarray, sketches: list[bytes], percent: int):
        self.size, self.percent = size, percent
        lengths = np.array([len(s) for s in sketches])
        self.rows = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        self.bits = {
            n: np.frombuffer(b"".join(sketches[i] for i in rows), np.uint64).reshape(len(rows), -1)
            for n, rows in self.rows.items()
        }

    def partners(self):
        """Each row with the rows, of its own width or the next, that may link with it."""
        for n, rows in self.rows.items():
            others, bits = rows, self.bits[n]
            if 2 * n in self.rows:
                left, right = np.split(self.bits[2 * n], 2, axis=1)
                others, bits = np.concatenate([rows, self.rows[2 * n]]), np.concatenate([bits, left ^ right])
            for i, row in enumerate(rows[: len(others) - 1]):
                rest = others[i + 1 :]
                differing = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1, dtype=np.int64)
                both = self.size[row] + self.size[rest]
                inside = (both - differing) // 2
                yield row, rest[100 * inside >= self.percent * (both - inside)]


def likely_links(regions: DataFrame, profiles: DataFrame, params: JaccardParams) -> DataFrame:
    """``src, dst``: enough pairs inside regions to join all sets that may be linked.

    Two sets differ in at least as many members as their sketches in bits, the
    wider one folded to the width of the other, which bounds what they share;
    no linked pair is lost. Linked sets have sizes, and so widths, within a
    factor of two.
    """
    sketches = profiles.groupBy("node").agg(F.min(F.struct("n_shingles", "sketch")).alias("_own"))
    placed = regions.select("pivot", "node").join(sketches, "node").select("pivot", "node", "_own.*")
    percent = params.percent

    def run(region: pa.Table) -> pa.Table:
        nodes = region["node"].to_numpy()
        label, links = np.arange(len(nodes)), []
        for row, others in _Sketches(region["n_shingles"].to_numpy(), region["sketch"].to_pylist(), percent).partners():
            for other in others[label[others] != label[row]]:
                a, b = label[row], label[other]
                if a != b:
                    links.append((nodes[row], nodes[other]))
                    label[label == max(a, b)] = min(a, b)
        return _link_table(links)

    return placed.groupBy("pivot").applyInArrow(run, LINKS)


def likely_regions(regions: DataFrame, profiles: DataFrame, params: JaccardParams) -> DataFrame:
    """``pivot, node, bytes``: sets that may be linked beside the least one their likely links reach.

    A set of some regions that fit one task is then in one region, or in none.
    Regions that do not fit stay as they are.
    """
    hot = hot_regions(regions, params)
    likely = likely_links(regions.join(hot, "pivot", "left_anti"), profiles, params)
    groups = connected_components(likely).select(F.col("component").alias("pivot"), "node")
    sizes = regions.groupBy("node").agg(F.max("bytes").alias("bytes"))
    groups = groups.join(sizes, "node").select("pivot", "node", "bytes")
    return groups.unionByName(regions.join(hot, "pivot", "left_semi")).distinct()


def region_texts(docs: DataFrame, profiles: DataFrame, nodes: DataFrame, params: JaccardParams) -> DataFrame:
    """``node, text``: one text for each of the sets named in ``nodes``.

    A text takes less room than its set of hashes, so texts move and tasks take
    their sets anew. A filter of ``2 ** filter_bits`` bits, whatever the number
    of nodes, drops most other texts where they lie; a join drops the rest.
    """
    one = profiles.groupBy("node").agg(F.min("text_id").alias("text_id")).join(nodes, "node", "left_semi")
    one = materialize(one, "text-ids")
    texts = text_rows(docs).select(F.xxhash64("_text").alias("text_id"), F.col("_text").alias("text"))
    texts = _marked(texts, one, "text_id", 1 << params.filter_bits).dropDuplicates(["text_id"])
    return texts.join(one, "text_id").select("node", "text")


class _Cell:
    """Sets of one region inside a task, with postings from shingles to sets."""

    def __init__(self, nodes: np.ndarray, texts: list[bytes], params: JaccardParams):
        self.nodes, self.percent, self.radius = nodes, params.percent, params.radius
        sets = _sets(texts, params.words)
        self.size = np.array([len(s) for s in sets], np.int64)
        at = np.concatenate([[0], np.cumsum(self.size)])
        owner = np.repeat(np.arange(len(sets)), self.size)
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.posting = owner[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(code))])
        self.codes = [code[a:b] for a, b in zip(at[:-1], at[1:])]
        self.label = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def distances(self, pivot: int, members: np.ndarray) -> np.ndarray:
        """Distances of a set to others; links those in reach and joins their labels."""
        code = self.codes[pivot]
        starts, ends = self.first[code], self.first[code + 1]
        lengths = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        hits = self.posting[at + np.arange(len(at))]
        inside = np.bincount(hits, minlength=len(self.size))[members]
        union = self.size[members] + self.size[pivot] - inside
        for other in members[100 * inside >= self.percent * union]:
            a, b = self.label[pivot], self.label[other]
            if a != b:
                self.links.append((self.nodes[pivot], self.nodes[other]))
                self.label[self.label == max(a, b)] = min(a, b)
        return 1 - inside / union

    def join(self, hosts: np.ndarray, members: np.ndarray) -> None:
        """Find all links of ``hosts`` with ``members`` that join different components.

        The first host is the pivot. The others are halved by their distance to
        it; each half meets, recursively, the members whose distance lies within
        the link radius of the half's own, as the triangle inequality allows.
        """
        while len(hosts):
            if (self.label[members] == self.label[hosts[0]]).all():
                return
            pivot, hosts = hosts[0], hosts[1:]
            if len(hosts) < 16:
                self.distances(pivot, members[self.label[members] != self.label[pivot]])
                continue
            d = np.full(len(self.size), np.nan)
            d[members] = self.distances(pivot, members)
            for half in np.array_split(hosts[np.argsort(d[hosts], kind="stable")], 2):
                low, high = d[half].min() - self.radius, d[half].max() + self.radius
                self.join(half, members[(d[members] >= low) & (d[members] <= high)])
            return


def _join_small(members: DataFrame, params: JaccardParams) -> DataFrame:
    """Links inside regions that fit one task."""

    def run(region: pa.Table) -> pa.Table:
        region = region.sort_by("node")
        cell = _Cell(region["node"].to_numpy(), region["text"].to_pylist(), params)
        everyone = np.arange(len(cell.nodes))
        cell.join(everyone, everyone)
        return _link_table(cell.links)

    return members.groupBy("pivot").applyInArrow(run, LINKS)


def _join_large(members: DataFrame, texts: DataFrame, params: JaccardParams) -> DataFrame:
    """Links inside regions above the limit, cut into rings around their pivot.

    Sets in reach of the pivot are linked to it and so to each other. The rest
    are cut, by distance, into rings of bounded size; a ring meets the sets of
    the region whose distance lies within the link radius of the ring's own, in
    slices of bounded size.
    """
    percent, radius = params.percent, params.radius

    def measure(batches):
        for batch in _each(batches):
            close, far = [], []
            pivots = list(set(blobs(batch, "_pivot")))
            pivot_sets = dict(zip(pivots, _sets(pivots, params.words)))
            for a, b in zip(_sets(blobs(batch, "text"), params.words), blobs(batch, "_pivot")):
                b = pivot_sets[b]
                inside = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - inside
                close.append(100 * inside >= percent * union)
                far.append(1 - inside / union)
            keep = [batch.column(n) for n in ("pivot", "node", "_rows")]
            yield pa.record_batch(
                [*keep, pa.array(far, pa.float64()), pa.array(close, pa.bool_())],
                names=["pivot", "node", "_rows", "d", "linked"],
            )

    pivots = texts.select(F.col("node").alias("pivot"), F.col("text").alias("_pivot"))
    placed = hot_key_join(members, pivots, ["pivot"], "node").select(
        "pivot", "node", "_rows", "text", "_pivot"
    )
    placed = materialize(
        placed.mapInArrow(measure, "pivot bigint, node bigint, _rows bigint, d double, linked boolean"),
        "region-distances",
    )
    direct = placed.filter("linked and node != pivot").select(
        F.col("node").alias("src"), F.col("pivot").alias("dst")
    )
    far = positions(placed.filter("not linked"), ["pivot"], ["d", "node"], "_pos")
    hosts = materialize(
        far.withColumn("ring", F.floor((F.col("_pos") - 1) / F.col("_rows"))), "region-hosts"
    )
    rings = hosts.groupBy("pivot", "ring").agg(F.min("d").alias("_low"), F.max("d").alias("_high"))
    guests = placed.select("pivot", "node", "_rows", "d").join(rings, "pivot").filter(
        (F.col("d") >= F.col("_low") - radius) & (F.col("d") <= F.col("_high") + radius)
    )
    guests = materialize(guests.select("pivot", "ring", "node", "_rows"), "region-guests")
    cuts = guests.groupBy("pivot", "ring").agg(
        F.ceil(F.count(F.lit(1)) / F.max("_rows")).cast("int").alias("_slices")
    )
    guests = guests.join(cuts, ["pivot", "ring"]).withColumn(
        "slice", F.pmod(F.xxhash64("node"), F.col("_slices")).cast("int")
    )
    guests = guests.select("pivot", "ring", "slice", "node", F.lit(False).alias("host"))
    hosts = hosts.join(cuts, ["pivot", "ring"]).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    )
    hosts = hosts.select("pivot", "ring", "slice", "node", F.lit(True).alias("host"))
    rows = hosts.unionByName(guests).groupBy("pivot", "ring", "slice", "node")
    rows = rows.agg(F.max("host").alias("host")).join(texts, "node")

    def run(cell_rows: pa.Table) -> pa.Table:
        cell_rows = cell_rows.sort_by("node")
        cell = _Cell(cell_rows["node"].to_numpy(), cell_rows["text"].to_pylist(), params)
        host = cell_rows["host"].to_numpy(zero_copy_only=False).astype(bool)
        cell.join(np.flatnonzero(host), np.arange(len(host)))
        return _link_table(cell.links)

    cells = rows.select("pivot", "ring", "slice", "node", "host", "text")
    return direct.unionByName(cells.groupBy("pivot", "ring", "slice").applyInArrow(run, LINKS))


def region_links(regions: DataFrame, texts: DataFrame, params: JaccardParams) -> DataFrame:
    """``src, dst``: links enough to join all linked sets of every region."""
    hot = hot_regions(regions, params)
    regions = regions.select("pivot", "node")
    if hot.isEmpty():
        return materialize(_join_small(regions.join(texts, "node"), params), "region-links")
    texts = materialize(texts, "region-texts")
    members = regions.join(texts, "node")
    small = _join_small(members.join(hot, "pivot", "left_anti"), params)
    spread = hot_key_join(regions, hot, ["pivot"], "node").join(texts, "node")
    return small.unionByName(_join_large(spread, texts, params))


def near_duplicates(docs: DataFrame, params: JaccardParams = JaccardParams()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document, exact at the stated similarity.

    ``component_id`` is the smallest ``doc_id`` reachable by links, the
    document's own included. Sets of shingles that are equal are one point of
    the metric space. Rare shingles name pivots; each set joins the regions of
    its pivots, and only those whose sketches allow a link stay, in one region
    with all that they may reach; inside a region, distances to the pivot and
    the triangle inequality choose what is compared, and a hot region is cut
    into rings.

    A text that is null, empty or without words has no shingles and is alone.
    Rows with a null ``doc_id`` link like others but name no component (its id
    is null where no row has one). Repeated rows are copies. An empty table
    gives an empty table; other columns are ignored.
    """
    counts = shingle_counts(docs, params)
    profiles = materialize(text_profiles(docs, counts, params), "profiles")
    full = profiles.filter("n_shingles > 0")
    regions = materialize(voronoi_regions(full, params), "fitting-regions")
    regions = materialize(likely_regions(regions, full, params), "likely-regions")
    texts = region_texts(docs, full, regions.select("node").distinct(), params)
    links = region_links(regions, texts, params)
    components = connected_components(links)
    firsts = full.groupBy("node").agg(F.min("doc_id").alias("_first"))
    labelled = firsts.join(components, "node", "left").select(
        "node", F.coalesce("component", "node").alias("_label"), "_first"
    )
    labelled = materialize(labelled, "labels")
    roots = labelled.groupBy("_label").agg(F.min("_first").alias("component_id"))
    ids = hot_key_join(labelled.select("node", "_label"), roots, ["_label"], "node")
    ids = materialize(ids.select("node", "component_id"), "component-ids")
    rows = full.select("doc_id", "n_shingles", "node")
    linked = hot_key_join(rows, ids, ["node"], "doc_id").select("doc_id", "n_shingles", "component_id")
    alone = profiles.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone)
